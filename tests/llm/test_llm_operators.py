"""llm operators on Spark against brute force, on small tables with odd rows."""
import collections
import hashlib
import os
import random
import re
import sys

import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle_check import compare, duck  # noqa: E402

from detecteval.llm import ann, bpe, catalog, cws, language, neardup, quality, raking, revisit, toxicity, urlrules  # noqa: E402
from detecteval.session import ensure_importable  # noqa: E402

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    ensure_importable(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    text = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, None, None, None), (4, "", "en", "b"),
            (5, "   \n\t ", "de", "b"), (6, long, "en", "c"), (7, long + " tail", "en", "c"), (None, text, "en", "a"),
            (8, "word", "fr", "a"), (9, "Éé ßö 12 ... !!", "de", "a"), (10, text + " and then some", "en", "a"),
            (11, "\x00 \u2028 \U0001F600", None, "a")]
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 0.5, 1, "x", "y") for r in rows],
        DOCS + ", score double, n_tokens int, key string, component_id string")


def truth_components(rows, size=5, percent=75):
    """Brute force over (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = collections.Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = truth_components([(r.doc_id, r.text) for r in docs.collect()])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_in_families_and_blocks(spark):
    """Families of edited copies, many of them just beyond the threshold, in small blocks."""
    rng = random.Random(1)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, " ".join(["common"] * 3 + [f"p{j}" for j in range(40)] + [f"u{i}x{j}" for j in range(60)])) for i in range(60)]
    want = truth_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_rows in (2048, 16):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, block_rows=block_rows).collect()}
        assert got == want


def test_near_duplicates_of_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 13
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[10].component_id == 1
    assert by[7].component_id == 6 and not by[7].kept
    assert by[None].component_id is None and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (3, 4, 5)) and by[8].n_shingles == 1
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(0).shuffle(ids)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 101: 100}


def test_fingerprints_follow_the_order_of_ids(spark, odd):
    rows = [(i, " ".join(f"w{random.Random(i).randrange(50)}" for _ in range(i % 40)) + "é" * (i % 3)) for i in range(0, 400, 3)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in cws.fingerprint_with_edits(docs, buckets=7).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        edited = cws.edited_text(t, nxt)
        a, b, c = cws.fingerprints_of([t.encode(), edited.encode(), nxt.encode()])
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == cws.to_text(a[None])[0] and got[i].edited_fingerprint == cws.to_text(b[None])[0]
        assert got[i].near_edited == (a == b).mean() and got[i].near_next == (a == c).mean()
    out = cws.fingerprint_with_edits(odd).collect()
    assert len(out) == 13 and len({r.fingerprint for r in out if r.doc_id in (1, 2, None)}) == 1
    one = cws.fingerprint_with_edits(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert cws.fingerprint_with_edits(odd.limit(0)).count() == 0
    plain = {r.doc_id: r.fingerprint for r in cws.fingerprint_documents(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_language_on_held_out_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = catalog.op3(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    model = language.fit(docs, "text", "lang", "doc_id")
    by = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == by[11].lang_pred == "und" and by[3].score == 0
    assert by[1].lang_pred == "en" and abs(sum(x.share for x in by[1].languages) - 1) < 1e-6
    nothing = language.fit(docs.limit(0), "text", "lang", "doc_id")
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = catalog.op6(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    out = quality.score(odd, model, carry=["score", "key"]).collect()
    assert len(out) == 13 and all(0 <= r["__score"] <= 1 and r.score == 0.5 for r in out)
    unknown = quality.fit(odd, labels.limit(0))
    assert {r["__score"] for r in quality.score(odd, unknown).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = catalog.op7(spark, sf).join(labels, "doc_id").where("held_out").collect()
    caught = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in caught) >= 0.8 * len(caught)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    model = toxicity.fit(odd, labels.limit(0))
    assert {r["__score"] for r in toxicity.score(odd, model).collect()} == {0.0}


def test_bpe_of_documents_and_odd_rows(spark, odd):
    import base64

    import public_tokenizers as P
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        want = collections.Counter()
        for r in docs.collect():
            ids = enc.encode_ordinary(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
        got = bpe.encode_documents(docs, catalog.vocabulary_path()).collect()
        assert collections.Counter(tuple(r) for r in got) == want
    ids = bpe.encode_documents(odd, catalog.vocabulary_path(), with_ids=True).where("doc_id = 8").first()
    assert ids.ids == enc.encode_ordinary("word")


@pytest.mark.parametrize("name", ["op4_raking", "op5_revisits"])
def test_sql_oracles(spark, name):
    fn, sql = catalog.QUERIES[name]
    ok, _, message = compare(fn(spark, SF), duck(SF), sql)
    assert ok, message


def test_sql_of_raking_keeps_values_without_a_target(spark, tmp_dir):
    """Null and fifth languages, a source that has no other, and null text: the SQL draws as the operator does."""
    langs = ["en", "de", "fr", "es", None, "it"]
    rows = [(i, None if i % 97 == 0 else "some words " * (i % 7) + (" | " if i % 5 == 0 else "") + ("a@b" if i % 11 == 0 else ""),
             langs[i % 6], ["src0", "src1", "web", None][i % 4]) for i in range(1500)]
    docs = spark.createDataFrame(rows + [(9000 + i, "words", None, "src2") for i in range(80)],
                                 "doc_id long, text string, lang string, source string")
    for name, part in (("all", docs), ("unnamed", docs.where("lang is null")), ("named", docs.where("lang in ('en', 'de')"))):
        part.write.parquet(f"{tmp_dir}/raking-{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/raking-{name}/documents.parquet/*.parquet')")
        ok, _, message = compare(raking.mix(part), con, raking.sql())
        assert ok, (name, message)


def test_raking_of_odd_rows(spark, odd):
    out = raking.mix(odd).collect()
    assert len(out) == 13 and all(0 <= r.probability <= 1 for r in out)
    assert {r.lang_class for r in out} <= {"en", "de", "fr", "es", "*"}
    assert raking.mix(odd.limit(0)).count() == 0


def test_raking_keeps_unknown_languages(spark, caplog):
    """Null and fifth languages keep their share of the tokens, also where a source has no other; misses are logged."""
    langs, sources = ["en"] * 5 + ["de", "fr", "es", None, "it"], ["src0", "src2", "web", "web", "web"]
    rows = [(i, "some words of prose here", langs[i // 5 % 10], sources[i % 5]) for i in range(4000)]
    rows += [(4000 + i, "some words of prose here", None, "src1") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = raking.mix(docs).collect()
    rest = [r for r in out if r.lang_class == "*"]
    assert len(rest) == 1200 and all(r.probability > 0.01 for r in rest)
    kept = [r for r in out if r.kept]
    assert {rows[r.doc_id][2] for r in kept} == {None, "it", "en", "de", "fr", "es"}
    assert abs(sum(r.lang_class == "*" for r in kept) / len(kept) - 1200 / 4400) < 0.04
    assert abs(sum(r.source_class == "src1" for r in kept) / len(kept) - 0.08) < 0.03
    assert not [m for m in caplog.messages if m.startswith(("lang", "source"))]
    raking.mix(docs.where("source = 'src1' or lang = 'en'")).collect()
    assert any(m.startswith("source") for m in caplog.messages)
    unnamed = raking.mix(docs, targets={**raking.TARGETS, "topic": {"table": 1.0}}).collect()
    assert {r.topic for r in unnamed} == {"prose"} and any(r.kept for r in unnamed)


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    schema = ("record_id long, url string, time long, status int, etag string, last_modified string, digest string, "
              "headers map<string,string>, extra int")
    rng = random.Random(2)
    rows = []
    for i in range(400):
        url = "http://hot.example/a" if rng.random() < 0.5 else rng.choice(
            ["http://x.example/p?utm_a=1", "https://X.example/p/#f", "http://x.example/q", None, "no-scheme"])
        rows.append((i, url, None if rng.random() < 0.02 else rng.randrange(100), rng.choice([200, 304, 404]),
                     rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "d1", "d2"]), rng.choice([None, "s"]),
                     rng.choice([None, {"etag": f"t{i}", "content-length": "5", "date": str(i)}]), 1))
    canon = lambda u: {"http://hot.example/a": "hot.example/a", "http://x.example/p?utm_a=1": "x.example/p",
                       "https://X.example/p/#f": "x.example/p", "http://x.example/q": "x.example/q"}.get(u, u)
    got = {r.record_id: r for r in revisit.resolve(spark.createDataFrame(rows, schema), buckets=8).collect()}
    assert len(got) == sum(r[3] == 304 for r in rows)
    for i, url, time, status, tag, day, digest, headers, _ in rows:
        if status != 304:
            continue
        before = [r for r in rows if r[3] == 200 and r[1] and url and canon(r[1]) == canon(url) and r[2] is not None
                  and time is not None and (r[2], r[0]) < (time, i)]
        hit = max(before, key=lambda r: (r[2], r[0])) if before else None
        assert got[i].response_id == (hit[0] if hit else None), (i, url)
        bare = lambda x: x and x.replace("W/", "")
        want = ("no_response" if not hit else "no_validator" if not (tag or day or digest) else "resolved" if
                (bare(tag) == bare(hit[4]) if tag else day == hit[5] if day else digest == hit[6]) else "mismatch")
        assert got[i].verdict == want
        if want == "resolved":
            allowed = {k: v for k, v in (headers or {}).items() if k in revisit.PERMITTED}
            assert got[i].headers == {**(hit[7] or {}), **allowed}


def test_ranges_follow_the_largest_url(spark):
    """Ranges are cut only where a URL holds many records, and cut them evenly, at every number of ranges."""
    hot = [("hot", float(i * i)) for i in range(2000)]
    rows = spark.createDataFrame(hot + [(f"u{i}", 5.0) for i in range(4000)], "canonical_url string, at double")
    assert revisit._edges(rows.where("canonical_url <> 'hot'"), 32) == []
    assert revisit._edges(rows.limit(0), 32) == []
    for buckets in (3, 32, 700):
        edges = revisit._edges(rows, buckets)
        placed = rows.select("canonical_url", "at", revisit._range_of(F.col("at"), edges).alias("k")).collect()
        assert all(r.k == sum(e <= r.at for e in edges) for r in placed)
        assert max(collections.Counter((r.canonical_url, r.k) for r in placed).values()) <= 6000 / buckets * 1.3 + 2


@pytest.mark.parametrize("kind", ["date", "timestamp", "double", "decimal(20,3)"])
def test_revisits_by_times_of_other_kinds(spark, kind):
    rows = [(i, "http://hot.example/a", i // 2, 200 if i % 4 == 0 else 304, '"a"') for i in range(400)]
    records = spark.createDataFrame(rows + [(None, "http://hot.example/a", None, 304, '"a"')], "record_id long, url string, day int, status int, etag string")
    time = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day"))
    records = records.select("*", (time if kind in ("date", "timestamp") else F.col("day")).cast(kind).alias("time"),
                             F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
                             F.lit(None).cast("map<string,string>").alias("headers"), F.lit("clash").alias("bucket"))
    got = {r.record_id: (r.response_id, r.verdict) for r in revisit.resolve(records, buckets=16).collect()}
    assert got == {None: (None, "no_response"), **{i: (i - i % 4, "resolved") for i in range(400) if i % 4}}
    assert revisit.resolve(records.limit(0)).count() == 0


def test_revisits_of_null_urls_are_in_the_query(spark, tmp_dir):
    pages = [(i, None if i % 3 == 0 else f"http://x.example/{i % 5}", f"text {i % 4}") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_dir}/pages.parquet")
    got = catalog.op5(spark, tmp_dir).collect()
    assert sorted(r.record_id for r in got) == [2 * i + 1 for i in range(60)]
    lost = [r for r in got if r.canonical_url is None]
    assert len(lost) == 20 and {(r.verdict, r.response_id, r.headers) for r in lost} == {("no_response", None, None)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_dir}/pages.parquet/*.parquet')")
    ok, _, message = compare(catalog.op5(spark, tmp_dir), con, catalog.QUERIES["op5_revisits"][1])
    assert ok, message


def test_url_rules_and_templates(spark):
    urls = ["http://a.example.net/en/1", "https://A.EXAMPLE.NET/EN/1?x=/en/", "http://net/", "http://xnet/a", "http://b.net",
            "http://example.com/de/x#y", "http://my-example.com/de/", "x://q.org/fr/a?b", None, "no scheme", "://", "a://b://c/d",
            "http://s.example.org/" + "/".join(["z"] * 500)]
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    rows += [(100 + i, f"http://mix.example.com/shop/item{i}/5", "h") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urlrules.judge(pages).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in urlrules.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2])) if fits else None
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (best[1] + best[2] if best else None)
        assert got[i].verdict in ("allow", "block") and (not best or got[i].verdict == best[0])
    assert {got[100 + i].template for i in range(40)} == {"/shop/<*>/<number>"}
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_templates_spread_labelled_purity(spark):
    """A branch like its blocked siblings is merged with them and rejected; a clean one is not."""
    rows = [("h", ["bad"], "block")] * 60 + [("h", ["bad"], None)] * 3 + [("h", ["good"], "allow")] * 60 + [("h", ["good"], None)] * 3
    tree = {tuple(r.tokens): r.purity for r in urlrules.template_tree(
        spark.createDataFrame(rows, "host string, tokens array<string>, label string")).collect()}
    assert tree[("bad",)] > 0.8 > 0.3 > tree[("good",)]


def test_pages_without_a_rule_follow_their_siblings(spark):
    """Unruled branches built like blocked ones are blocked; those like allowed ones, or built otherwise, are not."""
    urls = [f"http://a.example.com/{part}/{i}" for part in ("de", "en") for i in range(60)]
    urls += [f"http://b.example.org/{part}/{i}" for part in ("fr", "en") for i in range(60)]
    urls += [f"http://a.example.com/team/{name}" for name in ("ann", "bo", "cy")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in urlrules.judge(pages).collect()}
    unruled = {u: r.verdict for u, r in got.items() if r.rule is None}
    assert len(unruled) == 123
    for u, verdict in unruled.items():
        assert verdict == ("block" if "a.example.com/en/" in u else "allow"), (u, got[u])
    assert got["http://a.example.com/en/7"].template == got["http://a.example.com/de/7"].template == "/<~>/<number>"


def test_blocked_hosts_do_not_condemn_others(spark):
    """Where nearly all labelled pages are blocked, templates without blocked pages of their own are still allowed."""
    urls = [f"http://spam.net/x/{i}" for i in range(900)] + [f"http://clean.edu/a/{i}" for i in range(30)]
    urls += ["http://q.org/fr/index", "http://q.org/fr/index?page=2"]
    rules = [*urlrules.RULES[:1], ("allow", "q.org", "/fr/index")]
    urls += [f"http://q.org/fr/{i}" for i in range(20)] + [f"http://a.example.com/en/{i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in urlrules.judge(pages, rules).collect()}
    assert all(r.verdict == ("block" if r.host == "spam.net" else "allow") for r in got.values())
    assert got["http://clean.edu/a/3"].rule is None and got["http://clean.edu/a/3"].purity > 0.8
    # one allowed page is evidence for its template, however large the prior
    tree = urlrules.template_tree(spark.createDataFrame(
        [("n", ["x"], "block")] * 900 + [("c", ["y"], "allow"), ("c", ["y"], None)], "host string, tokens array<string>, label string"))
    assert {r.host: r.own for r in tree.collect()} == {"n": 1.0, "c": 0.0}


def test_templates_reach_the_end_of_deep_paths(spark):
    """Branches, dates and rules below the third segment are judged apart; nested paths end in one round."""
    urls = [f"http://d.io/a/b/c/{part}/{i}" for part in ("bad", "good") for i in range(40)]
    urls += [f"http://d.io/a/b/c/calm{j}/x/y/{i}" for j in range(2) for i in range(30)]
    urls += [f"http://n.io/2024/05/{i % 28 + 1}/{a}{b}" for i, (a, b) in enumerate((a, b) for a in "klmnop" for b in "uvwxyz")]
    urls += ["http://t.io" + "/z" * n for n in range(1, 120)]
    rules = [("block", "d.io", "/a/b/c/bad/"), ("allow", "d.io", "/a/b/c/good/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in urlrules.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    bad, good = got["http://d.io/a/b/c/bad/1"], got["http://d.io/a/b/c/good/1"]
    assert (bad.template, good.template) == ("/a/b/c/bad/<number>", "/a/b/c/good/<number>")
    assert bad.purity > 0.8 and good.purity < 0.2
    assert all(r.verdict == "allow" for u, r in got.items() if "calm" in u)
    assert {r.template for u, r in got.items() if "n.io" in u} == {"/<number>/<number>/<number>/<*>"}
    assert all(got["http://t.io" + "/z" * n].template == "/z" * n for n in (1, 3, 119))


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x[:900] = x[0]  # one vector holds a third of the rows
    rows = [(int(i), [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(5000, None, 1), (5020, [0.0] * 24, 1), (5040, [float("nan")] + [1.0] * 23, 1), (5060, [1.0, 2.0], 1),
             (5080, [None] + [1.0] * 23, 1), (5100, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(6)
    got = collections.defaultdict(list)
    for r in ann.search(table, block_rows=300).collect():
        got[r.query_id].append(r)
    assert sorted(got) == list(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        s = x @ x[q]
        s[q] = -np.inf
        true = np.lexsort((np.arange(3000), -np.round(s, 12)))[:20]
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r.vec_id != q for r in found)
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in found)
        hit += len(set(true.tolist()) & {r.vec_id for r in found})
        if q < 900:
            assert [r.vec_id for r in found if abs(r.score - x[0] @ x[0]) < 1e-9] == sorted(
                r.vec_id for r in found if abs(r.score - x[0] @ x[0]) < 1e-9)
    assert hit / (20 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[1000:1005] + rows[-3:], "vec_id long, embedding array<double>, label int")
    assert collections.Counter(r.query_id for r in ann.search(few).collect()) == {1000: 4}
    assert ann.search(table.limit(0)).count() == 0


def test_pipeline_stages_on_a_small_table(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "tokens"]
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after and after <= before
        if name == "near_duplicates":
            truth = truth_components([(r.doc_id, r.text) for r in kept.collect()])
            assert after == {i for i, (_, c) in truth.items() if c == i}
        kept = spark.createDataFrame(out.collect(), docs.schema)
    final = cp.run(spark, SF).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in kept.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for r, t in
               zip(sorted(final, key=lambda r: r.doc_id), [r.text for r in kept.orderBy("doc_id").collect()]))
