"""The path-template tree: one task for small nodes, rounds for large ones, one result."""
import random
import time

import pytest

from detecteval.llm import urlrules
from detecteval.session import ensure_importable

SCHEMA = "host string, tokens array<string>, label string"


@pytest.fixture(autouse=True)
def importable(spark):
    ensure_importable(spark)


def tree_of(spark, rows, **options):
    found = urlrules.template_tree(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert len({(r.host, tuple(r.tokens)) for r in found}) == len(found)
    return {(r.host, tuple(r.tokens)): (r.template, round(r.purity, 9), r.own) for r in found}


def noise(seed):
    """Hosts with skewed words, shapes, prefixes of other paths and labels that lean on a segment."""
    rng = random.Random(seed)
    rows = []
    for host in ("a", "b", "c"):
        for _ in range(250):
            path = [rng.choice("pqrs") for _ in range(rng.choice((1, 1, 2)))]
            path += [rng.choice((f"w{rng.randrange(40)}", "<number>", "<hex>", "x")) for _ in range(rng.randrange(4))]
            lean = 0.9 if path[0] in "pq" else 0.1
            rows.append((host, path, rng.choice((None, "block" if rng.random() < lean else "allow"))))
    return rows + [("a", ["/"], "allow"), ("a", ["/"], None), ("d", ["one"], None), ("e", ["<*>"], "block"), ("e", ["<~>", "z"], None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tasks_and_rounds_give_one_tree(spark, seed):
    rows = noise(seed)
    by_rounds = tree_of(spark, rows, whole=0)
    assert by_rounds == tree_of(spark, rows) == tree_of(spark, rows, whole=4000)
    assert any("<~>" in t for t, *_ in by_rounds.values()) and any("<*>" in t for t, *_ in by_rounds.values())
    assert {k[:1] + (k[1],) for k in by_rounds} == {(h, tuple(p)) for h, p, _ in rows}


def test_many_two_way_segments_end(spark):
    """A crawler trap: 400 paths of 200 segments, each of two kinds, half of them blocked."""
    rng = random.Random(3)
    rows = [("trap", [rng.choice("ab") for _ in range(200)], "block" if i % 2 else None) for i in range(400)]
    began = time.time()
    found = tree_of(spark, rows)
    assert len(found) == 400 and time.time() - began < 60
    assert tree_of(spark, rows[:0]) == {}


def test_grow_by_hand():
    """Alike branches merge, one of other labels stays; many rare names turn into a wildcard; prefixes end where they end."""
    rows = [((part, "<number>"), label, 30, part) for part, label in (("de", "block"), ("en", None), ("fr", "block"))]
    assert {r[3]: t for t, r in urlrules.grow(rows)} == {p: "/<~>/<number>" for p in ("de", "en", "fr")}
    rows.append((("it", "<number>"), "allow", 60, "it"))
    names = {r[3]: t for t, r in urlrules.grow(rows)}
    assert names["it"] == "/it/<number>" and names["en"] == "/<~>/<number>"
    rows = [((f"item{i}", "<number>"), None, 1, i) for i in range(40)]
    assert {t for t, _ in urlrules.grow(rows)} == {"/<*>/<number>"}
    rows = [(("z",) * n, None, 1, n) for n in range(1, 500)]
    assert {r[3]: t for t, r in urlrules.grow(rows)} == {n: "/z" * n for n in range(1, 500)}
    assert urlrules.grow([]) == []
