"""URL filters (operator 9): rules, and a path-template tree for the rest.

Rules are (verdict, host, path): a rule fits its host and all subdomains when
the URL's path starts with the rule's; the longest one wins. URLs that no rule
fits are judged by the *path-template tree* of their host. Path segments become
tokens (numbers, hexadecimal names, dates by their shape; others stay literal).
Level by level, the literal children of a node turn into a wildcard where they
are many and rare, and into one merged branch where their pages are distributed
over next tokens as those of their siblings, and their labelled pages over
labels as their siblings' labelled ones (two chi-square tests, each branch
against all its siblings together, so the work is one row a branch). A branch
without labels has nothing to differ in by label, merges by its structure and
takes the purity of what it is merged with. A
template is rejected when it has labelled pages and both the blocked share of
these and its purity, that share smoothed towards the one of all labelled pages,
reach ``reject``; without any its purity is not evidence, and it is allowed.
Labels are the rules' verdicts.

The tree is built over the distinct (host, tokens, label) with their counts,
not over pages, and goes as deep as the paths do. A node whose paths hold at most
``WHOLE`` bytes is settled with all that is below it by one task (``grow``); the
tasks hold many such nodes. Larger nodes are settled a level at a time over all
tasks: a round takes every one over the tokens that its rows share (one path, or
prefixes of it: nothing to choose) to its next branching and settles that level.
Both ways give the same tree, so the rounds end when the nodes are small, however
many branchings a path has below.

Defined cases: null, or no ``://``: host, path and template are empty. Without
any labelled page nothing is rejected.
"""
from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Bytes of paths (16 more a token) of a node that one task settles to its leaves.
WHOLE = 8 << 20

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def _shape(s: Column) -> Column:
    return (F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
            .when(s.rlike(r"^[0-9]+$"), "<number>")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("<number>."), F.lower(F.regexp_extract(s, r"([A-Za-z]+)$", 1))))
            .when(s.rlike(r"^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]"), "<hex>").otherwise(s))


def path_tokens(path: Column) -> Column:
    """Tokens of the path's segments; a path without any has the token ``/``."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _shape)
    return F.when(F.size(parts) == 0, F.array(F.lit("/"))).otherwise(parts)


#: 95 % points of the chi-square distribution for 1 to 30 degrees of freedom.
CHI2_95 = [3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685,
           24.996, 26.296, 27.587, 28.869, 30.144, 31.410, 32.671, 33.924, 35.172, 36.415, 37.652, 38.885, 40.113,
           41.337, 42.557, 43.773]


def _tested(cells: DataFrame, over: str) -> DataFrame:
    """(host, node, token, b, total, children, unlike): whether a branch's pages
    are spread over the values of ``over`` unlike those of all its siblings."""
    cells = cells.groupBy("host", "node", "token", over).agg(F.sum("o").alias("o"))
    branch = cells.groupBy("host", "node", "token").agg(F.sum("o").alias("b"))
    node = branch.groupBy("host", "node").agg(F.sum("b").alias("total"), F.count(F.lit(1)).alias("children"))
    of_kind = cells.groupBy("host", "node", over).agg(F.sum("o").alias("k"))
    kinds = of_kind.groupBy("host", "node").agg(F.count(F.lit(1)).alias("kinds"))
    # chi-square of a branch against the mix of all its siblings: sum o^2 / e - b over its own cells
    test = (cells.join(of_kind, ["host", "node", over]).join(branch, ["host", "node", "token"])
            .join(node, ["host", "node"]).join(kinds, ["host", "node"])
            .groupBy("host", "node", "token", "total", "children", "b", "kinds")
            .agg((F.sum(F.col("o").cast("double") * F.col("o") / F.col("k") * F.col("total") / F.col("b")) - F.first("b")).alias("chi2")))
    free = F.least(F.greatest(F.col("kinds") - 1, F.lit(1)), F.lit(len(CHI2_95))).cast("int")
    point = F.element_at(F.array(*[F.lit(x) for x in CHI2_95]), free)
    return test.select("host", "node", "token", "b", "total", "children", (F.col("chi2") > point).alias("unlike"))


def _tail(tokens, start) -> Column:
    return F.slice(tokens, start + 1, F.greatest(F.size(tokens) - start, F.lit(0)))


def _to_branching(tree: DataFrame) -> DataFrame:
    """``tree`` with the tokens up to each node's first branching moved from
    ``rest`` to the node: those in which all rows agree with the longest one."""
    longest = tree.groupBy("host", "node").agg(F.max(F.struct(F.size("rest").alias("n"), "rest"))["rest"].alias("longest"))
    same = F.zip_with("rest", F.slice("longest", F.lit(1), F.size("rest")), lambda a, b: a == b)
    apart = F.array_position(same, F.lit(False))  # 1-based, 0 where the row is a prefix of the longest
    shared = (tree.join(longest, ["host", "node"]).groupBy("host", "node")
              .agg(F.min(F.when(apart > 0, apart - 1)).alias("shared")))
    take = F.least(F.size("rest"), F.coalesce("shared", F.size("rest"))).cast("int")
    return (tree.join(shared, ["host", "node"]).withColumn("take", take)
            .select("host", "tokens", _tail(F.col("rest"), F.col("take")).alias("rest"),
                    F.concat_ws("/", "node", F.slice("rest", F.lit(1), F.col("take"))).alias("node"), "label", "n"))


def _generalised(tree: DataFrame, many: int, rare: float) -> DataFrame:
    """``tree`` (host, tokens, rest, node, label, n) with the first token of
    ``rest``, literal, wildcard or merged, moved to the node."""
    rows = (tree.withColumn("token", F.get("rest", F.lit(0)))
            .withColumn("next", F.coalesce(F.get("rest", F.lit(1)), F.lit("<end>"))))
    rows = rows.withColumn("literal", ~F.col("token").startswith("<") & (F.col("token") != "/"))
    kind = F.when(F.col("next").startswith("<"), F.col("next")).otherwise("<name>")
    cells = checkpoint(rows.where("literal").groupBy("host", "node", "token", kind.alias("kind"), "label")
                       .agg(F.sum("n").alias("o")))
    build = _tested(cells, "kind").withColumnRenamed("unlike", "other_build")
    marks = _tested(cells.where("label is not null"), "label").select("host", "node", "token", F.col("unlike").alias("other_label"))
    alike = ~F.col("other_build") & ~F.coalesce("other_label", F.lit(False))
    chosen = (F.when((F.col("children") >= many) & (F.col("b") < rare * F.col("total")), "<*>")
              .when((F.col("children") > 1) & alike, "<~>").otherwise(F.col("token")))
    names = build.join(marks, ["host", "node", "token"], "left").select("host", "node", "token", chosen.alias("name"))
    return (rows.join(names, ["host", "node", "token"], "left")
            .select("host", "tokens", _tail(F.col("rest"), F.lit(1)).alias("rest"),
                    F.concat_ws("/", "node", F.coalesce("name", "token")).alias("node"), "label", "n"))


# -- a whole small node in one task ----------------------------------------------

def _unlike(cells: dict) -> tuple[dict, int]:
    """``cells``: (branch, kind) -> pages. For each branch (its pages, whether they are
    spread unlike those of all its siblings), and the pages of all."""
    size: dict = {}
    of_kind: dict = {}
    for (token, kind), o in cells.items():
        size[token] = size.get(token, 0) + o
        of_kind[kind] = of_kind.get(kind, 0) + o
    total = sum(size.values())
    chi2 = {token: -float(b) for token, b in size.items()}
    for (token, kind), o in cells.items():
        chi2[token] += float(o) * o / of_kind[kind] * total / size[token]
    point = CHI2_95[min(max(len(of_kind) - 1, 1), len(CHI2_95)) - 1]
    return {token: (b, chi2[token] > point) for token, b in size.items()}, total


def _names(rows: list, at: int, many: int, rare: float) -> dict:
    """Name of each literal token at position ``at`` of the paths of a node."""
    built: dict = {}
    marked: dict = {}
    for path, label, n, _ in rows:
        token = path[at]
        if token.startswith("<") or token == "/":
            continue
        follows = path[at + 1] if at + 1 < len(path) else "<end>"
        key = token, follows if follows.startswith("<") else "<name>"
        built[key] = built.get(key, 0) + n
        if label is not None:
            marked[token, label] = marked.get((token, label), 0) + n
    build, total = _unlike(built)
    marks, _ = _unlike(marked)
    names = {}
    for token, (b, other_build) in build.items():
        if len(build) >= many and b < rare * total:
            names[token] = "<*>"
        elif len(build) > 1 and not other_build and not marks.get(token, (0, False))[1]:
            names[token] = "<~>"
    return names


def grow(rows: list, node: str = "", at: int = 0, many: int = 16, rare: float = 1 / 16) -> list:
    """(template, row) of every row (path, label, pages, anything) under ``node``,
    whose paths are settled up to position ``at``."""
    out, work = [], [(node, at, rows)]
    while work:
        node, at, rows = work.pop()
        out += [(node, r) for r in rows if len(r[0]) == at]
        rows = [r for r in rows if len(r[0]) > at]
        if not rows:
            continue
        # over the tokens in which all agree with the longest path
        longest = max((r[0] for r in rows), key=lambda p: (len(p), p[at:]))
        shared = len(longest)
        for path, *_ in rows:
            end = min(len(path), shared)
            if path[at:end] != longest[at:end]:
                shared = next(i for i in range(at, end) if path[i] != longest[i])
        out += [("/".join([node, *r[0][at:]]), r) for r in rows if len(r[0]) <= shared]
        rows = [r for r in rows if len(r[0]) > shared]
        if not rows:
            continue
        node = "/".join([node, *longest[at:shared]])
        names = _names(rows, shared, many, rare)
        below: dict = {}
        for r in rows:
            below.setdefault(names.get(r[0][shared], r[0][shared]), []).append(r)
        work += [(f"{node}/{name}", shared + 1, part) for name, part in below.items()]
    return out


def _grown(tree: DataFrame, many: int, rare: float) -> DataFrame:
    """``tree`` (host, tokens, rest, node, label, n), of small nodes, to its leaves."""
    columns = ["host", "tokens", "node", "label", "n"]
    rows = (tree.select("host", "node", "tokens", (F.size("tokens") - F.size("rest")).alias("at"), "label", "n")
            .repartition("host", "node").sortWithinPartitions("host", "node"))
    schema = pa.schema([("host", pa.string()), ("tokens", pa.list_(pa.string())), ("node", pa.string()),
                        ("label", pa.string()), ("n", pa.int64())])

    def run(batches):
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        held = []
        for (host, node), group in groupby(each, key=lambda r: r[:2]):
            group = list(group)
            paths = [(r[2], r[4], r[5], None) for r in group]
            held += [(host, r[0], name, r[1], r[2]) for name, r in grow(paths, node, group[0][3], many, rare)]
            if len(held) >= 10_000:
                yield from _batches(held)
                held = []
        yield from _batches(held)

    def _batches(held):
        for lo in range(0, len(held), 10_000):
            part = list(zip(*held[lo:lo + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema)], schema=schema)
    return rows.mapInArrow(run, "host string, tokens array<string>, node string, label string, n long").select(columns)


def template_tree(pages: DataFrame, many: int = 16, rare: float = 1 / 16, strength: float = 10.0,
                  whole: int = WHOLE) -> DataFrame:
    """(host, tokens, template, purity, own) of every (host, tokens) of ``pages``
    (host, tokens, label), purity being the smoothed share of ``block`` and own
    the plain one, null without labelled pages."""
    ended = F.size("rest") == 0
    columns = ["host", "tokens", "node", "label", "n"]
    weight = F.sum(F.octet_length(F.array_join("tokens", "/")) + 16 * F.size("tokens"))
    tree = pages.groupBy("host", "tokens", "label").agg(F.count(F.lit(1)).alias("n")).select(
        "host", "tokens", F.col("tokens").alias("rest"), F.lit("").alias("node"), "label", "n")
    tree = checkpoint(tree)
    done = tree.where(ended).select(columns)
    tree = tree.where(~ended)
    while True:
        tree = checkpoint(tree.join(tree.groupBy("host", "node").agg(weight.alias("weight")), ["host", "node"]))
        done = done.unionByName(_grown(tree.where(F.col("weight") <= whole), many, rare))
        tree = tree.where(F.col("weight") > whole).drop("weight")
        if tree.isEmpty():
            break
        tree = checkpoint(_to_branching(tree))
        done = done.unionByName(tree.where(ended).select(columns))
        tree = checkpoint(_generalised(tree.where(~ended), many, rare))
        done = done.unionByName(tree.where(ended).select(columns))
        tree = tree.where(~ended)
    tree = checkpoint(done)
    counts = tree.groupBy("host", "node").agg(F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("bad"),
                                              F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("good"))
    whole = counts.agg(F.sum("bad"), F.sum("good")).first()
    bad, good = whole[0] or 0, whole[1] or 0
    prior = bad / (bad + good) if bad + good else 0.0
    purity = (F.col("bad") + strength * prior) / (F.col("bad") + F.col("good") + strength)
    own = F.when(F.col("bad") + F.col("good") > 0, F.col("bad") / (F.col("bad") + F.col("good")))
    return (tree.select("host", "tokens", "node").distinct()
            .join(counts.select("host", "node", purity.alias("purity"), own.alias("own")), ["host", "node"])
            .withColumnRenamed("node", "template"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id", reject: float = 0.8,
          **options) -> DataFrame:
    """Every row's key, host, path, rule, verdict, template and purity."""
    host, path = host_and_path(pages[url])
    rows = pages.select(pages[key].alias(key), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "tokens": path_tokens(F.col("path"))})
    tree = checkpoint(template_tree(rows.select("host", "tokens", F.col("ruled").alias("label")), **options))
    out = rows.join(tree, ["host", "tokens"])
    guilty = (F.col("own") >= reject) & (F.col("purity") >= reject)  # null without labelled pages
    return out.select(key, "host", "path", "rule",
                      F.coalesce("ruled", F.when(guilty, "block").otherwise("allow")).alias("verdict"),
                      "template", F.round("purity", 9).alias("purity"))
