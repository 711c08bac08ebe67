"""Mixing sources to target weights (operator 4): iterative proportional fitting.

Documents fall into cells by source, language and topic. The cells' token
weights are raked: in each round they are scaled to the target share of every
source, then language, then topic, and cut at the tokens that a cell has. A
document is then sampled with the probability "cell's weight / cell's tokens",
by a hash of its doc_id.

Targets are parameters. A value without a target belongs to ``*``, whose share
is what the named ones leave, so the cells are at most the product of the
targets' sizes whatever the data hold; only their totals come to the driver. A
target whose value has no tokens is left out and the others are scaled up. Where
the named ones leave nothing but ``*`` has tokens, it keeps the share of all
tokens that it has, and the others are scaled down to the rest: no class is
dropped because it has no name; ``sql`` states the same rule. Shares that the
draw will miss, for want of tokens, are logged.

Defined cases: null text has 0 tokens, a null source or language belongs to
``*``; an empty document has its cell's probability, and a cell without tokens
has 0. Rows that share a doc_id are kept or dropped together.
"""
from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import H, TWO32, sql_hash

REST = "*"
ROUNDS = 40
DIMENSIONS = ("source", "lang", "topic")

#: Topic of a text: the first rule whose mark it contains, else ``prose``.
TOPIC_RULES = [("table", " | "), ("contact", "@"), ("legal", "icense")]
TARGETS = {
    "source": {"src0": 0.20, "src1": 0.08, "src2": 0.08},
    "lang": {"en": 0.50, "de": 0.20, "fr": 0.20, "es": 0.10},
    "topic": {"prose": 0.85, "contact": 0.08, "table": 0.04, "legal": 0.03},
}
BUDGET = 0.5
SEED = 4


def topic(text: Column, rules=TOPIC_RULES) -> Column:
    out = None
    for name, mark in rules:
        out = F.when(text.contains(mark), name) if out is None else out.when(text.contains(mark), name)
    return F.coalesce(out.otherwise("prose"), F.lit("prose")) if out is not None else F.lit("prose")


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _classed(column: Column, named) -> Column:
    return F.when(column.isin(list(named)), column).otherwise(REST)


def shares(target: dict) -> dict:
    """The named shares and what is left for all other values."""
    left = 1.0 - math.fsum(target.values())
    if left < -1e-9:
        raise ValueError("target shares exceed 1")
    return {**target, REST: max(left, 0.0)}


def _sums(weight: dict, d: int) -> dict:
    """Total weight of each value of dimension ``d``."""
    sums: dict = {}
    for c, w in weight.items():
        sums.setdefault(c[d], []).append(w)
    return {v: math.fsum(w) for v, w in sums.items()}


def goals_of(own: dict, targets: dict) -> list[dict]:
    """The share that each value with tokens is raked to, by dimension."""
    goals = []
    for d, name in enumerate(DIMENSIONS):
        held = _sums(own, d)
        present = {v: s for v, s in shares(targets[name]).items() if held.get(v, 0.0) > 0}
        scale = math.fsum(present.values())
        goal = {v: s / scale for v, s in present.items()} if scale > 0 else {}
        if REST in present and present[REST] <= 1e-9:
            rest = held[REST] / math.fsum(held.values()) if scale > 1e-9 else 1.0
            goal = {**{v: s * (1.0 - rest) for v, s in goal.items()}, REST: rest}
        goals.append(goal)
    return goals


def missed(cells: list[tuple], chances: dict, targets: dict, budget: float, slack: float = 0.01) -> list[tuple]:
    """(dimension, value, wanted, expected) shares of the budget that differ by more than ``slack``."""
    own = {c[:3]: float(c[3]) for c in cells}
    total = budget * math.fsum(own.values())
    drawn = {c: n * chances[c] for c, n in own.items()}
    out = []
    for d, goal in enumerate(goals_of(own, targets)):
        got = _sums(drawn, d)
        out += [(DIMENSIONS[d], v, s, got[v] / total) for v, s in goal.items() if total > 0 and abs(got[v] / total - s) > slack]
    return out


def rake(cells: list[tuple], targets: dict, budget: float, rounds: int = ROUNDS) -> dict:
    """Probability of each cell. ``cells``: (source, lang, topic, tokens)."""
    own = {c[:3]: float(c[3]) for c in cells}
    total = budget * math.fsum(own.values())
    weight = {c: n * budget for c, n in own.items()}
    goals = goals_of(own, targets)
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            sums = _sums(weight, d)
            weight = {c: w * goal.get(c[d], 0.0) * total / sums[c[d]] if sums[c[d]] > 0 else 0.0
                      for c, w in weight.items()}
        weight = {c: min(w, own[c]) for c, w in weight.items()}
    return {c: w / own[c] if own[c] > 0 else 0.0 for c, w in weight.items()}


def mix(docs: DataFrame, targets: dict = TARGETS, budget: float = BUDGET, seed: int = SEED, text: str = "text",
        key: str = "doc_id", source: str = "source", lang: str = "lang", rules=TOPIC_RULES,
        carry: list[str] | None = None) -> DataFrame:
    """Every row's doc_id, cell (source_class, lang_class, topic), n_tokens,
    probability and kept; with ``carry`` the named columns instead of doc_id."""
    rows = docs.select(*([docs[c] for c in carry] if carry else [docs[key].alias("doc_id")]),
                       docs[key].alias("__key"), _classed(docs[source], targets["source"]).alias("source_class"),
                       _classed(docs[lang], targets["lang"]).alias("lang_class"),
                       topic(docs[text], rules).alias("__topic"),
                       tokens(docs[text]).alias("__tokens"))
    cells = (rows.groupBy("source_class", "lang_class", "__topic").agg(F.sum("__tokens").alias("n")).collect())
    of = {r[:3]: (r[0], r[1], r[2] if r[2] in targets["topic"] else REST) for r in cells}
    held: dict = {}
    for r in cells:
        held[of[r[:3]]] = held.get(of[r[:3]], 0) + r[3]
    classes = [(*c, n) for c, n in sorted(held.items())]
    chances = rake(classes, targets, budget)
    for miss in missed(classes, chances, targets, budget):
        logging.getLogger(__name__).warning("%s %s: share %.4f wanted, %.4f expected", *miss)
    spark = docs.sparkSession
    table = spark.createDataFrame([(*c, round(chances[k], 9)) for c, k in of.items()],
                                  "source_class string, lang_class string, __topic string, probability double")
    out = rows.join(F.broadcast(table), ["source_class", "lang_class", "__topic"])  # as small as the targets and rules
    draw = H(seed, "mix", F.col("__key")) / F.lit(float(TWO32))
    return (out.withColumn("kept", draw < F.col("probability"))
            .withColumnsRenamed({"__topic": "topic", "__tokens": "n_tokens"}).drop("__key"))


def _sql_case(column: str, named) -> str:
    return f"CASE WHEN {column} IN ({', '.join(repr(v) for v in named)}) THEN {column} ELSE '{REST}' END"


def sql(targets: dict = TARGETS, budget: float = BUDGET, seed: int = SEED, rounds: int = ROUNDS) -> str:
    """DuckDB text of ``mix`` over the documents table."""
    marks = " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" for n, m in TOPIC_RULES)
    goal = lambda name: ", ".join(f"('{v}', {s!r}::DOUBLE)" for v, s in shares(targets[name]).items())
    goals = "".join(f""",
g_{n}(v, share) AS (
  SELECT v, CASE WHEN v = '{REST}' AND s <= 1e-9 THEN rest ELSE s / scale * (1 - rest) END
  FROM (SELECT v, s, sum(s) OVER () AS scale, CASE WHEN sum(s) OVER () > 1e-9 THEN
            coalesce(max(CASE WHEN v = '{REST}' AND s <= 1e-9 THEN held END) OVER () / sum(held) OVER (), 0) ELSE 1 END AS rest
        FROM (VALUES {goal(n)}) t(v, s) JOIN (SELECT {c} AS v, sum(tok) AS held FROM cells GROUP BY {c}) h USING (v) WHERE held > 0))"""
        for n, c in (("source", "source_class"), ("lang", "lang_class"), ("topic", "topic")))
    scale = lambda x, c, g: f"CASE WHEN sum({x}) OVER (PARTITION BY {c}) > 0 THEN {x} * {g} * total / sum({x}) OVER (PARTITION BY {c}) ELSE 0 END"
    return f"""WITH RECURSIVE d AS (
  SELECT doc_id, {_sql_case('source', targets['source'])} AS source_class, {_sql_case('lang', targets['lang'])} AS lang_class,
    CASE {marks} ELSE 'prose' END AS topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
cells AS (SELECT source_class, lang_class, topic, sum(n_tokens)::DOUBLE AS tok FROM d GROUP BY ALL){goals},
start AS (SELECT c.*, {budget} * sum(tok) OVER () AS total, tok * {budget} AS w, coalesce(a.share, 0) AS a, coalesce(b.share, 0) AS b,
    coalesce(t.share, 0) AS t FROM cells c LEFT JOIN g_source a ON a.v = source_class LEFT JOIN g_lang b ON b.v = lang_class
    LEFT JOIN g_topic t ON t.v = topic),
r AS (SELECT 0 AS i, * FROM start
  UNION ALL
  SELECT i + 1, source_class, lang_class, topic, tok, total, least({scale('w2', 'topic', 't')}, tok), a, b, t FROM (
    SELECT *, {scale('w1', 'lang_class', 'b')} AS w2 FROM (
      SELECT *, {scale('w', 'source_class', 'a')} AS w1 FROM r WHERE i < {rounds}))),
p AS (SELECT source_class, lang_class, topic, round(CASE WHEN tok > 0 THEN w / tok ELSE 0 END, 9) AS probability FROM r WHERE i = {rounds})
SELECT doc_id, source_class, lang_class, topic, n_tokens, probability,
  {sql_hash(str(seed), "'mix'", 'doc_id')} / {float(TWO32)!r}::DOUBLE < probability AS kept
FROM d JOIN p USING (source_class, lang_class, topic)"""
