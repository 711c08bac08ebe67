"""Text perturbations and token drift as column expressions.

All edits are built from Spark's regex and higher-order array functions,
so they run inside whole-stage code generation over whole texts. Random
choices are seeded hashes (``H`` for the few per-name / per-insert draws,
``position_draw`` for the per-line and per-blank-run draws): one seed makes one
sequence of draws, which depend on positions (line, run, insert number), not on
the row.
"""
from __future__ import annotations

from typing import Dict, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import H, py_hash
from ..functions.text import WS_CLASS, code_tokens, code_tokens_no_blank

# Library calls that are never renamed.
LIB_CALLS = ["strcpy", "strncpy", "memcpy", "memmove", "sprintf", "snprintf", "gets", "fgets",
             "malloc", "free", "printf", "scanf", "strcat", "strlen", "memset", "calloc",
             "realloc", "read", "write"]
# Fixed value: C type keywords that introduce a declared name.
TYPE_KW = ["int", "char", "float", "double", "long", "short", "unsigned", "signed", "void", "size_t"]
# Statements without effect; {n} is _<seed>_<k>.
DEAD_CODE_TEMPLATES = [
    "while (0) {{ break; }}",
    "{{ long idle{n} = 1; idle{n} -= 1; }}",
    "do {{ unsigned idle{n} = 3u; (void) sizeof(idle{n}); }} while (0);",
]
# Fixed value: operators that the whitespace edit may pad with spaces.
WS_OPERATORS = ["+", "-", "<", ">", "=", "=="]
# Operator patterns of the token-safe mode (maximal munch: never split
# ==, <=, >=, !=, ->, ++, --, +=, -=, <<, >>).
_SAFE_OPS = {
    "+": r"(?<![+])\+(?![+=])",
    "-": r"(?<![-])-(?![-=>])",
    "<": r"(?<![<])<(?![<=])",
    ">": r"(?<![>\-])>(?![>=])",
    "=": r"(?<![=!<>+\-*/%&|^])=(?![=])",
    "==": r"==",
}

_DECL = "(?U)(?:" + "|".join(TYPE_KW) + ")\\s+\\**\\s*([A-Za-z_]\\w*)"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row: an expression named
    inside a lambda would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rename_variables(text: Column, seed: int = 0) -> Column:
    """Names after a C type keyword, minus library calls, renamed to vN at
    word boundaries, one after another (X1, D11). Order of names is by
    seeded hash (not a process-dependent set order). The text is taken apart into
    words once, whatever the number of names: a name is always a whole word, and a
    word goes where the renames lead it (a declared ``v0`` may be renamed twice)."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(_DECL), 1))
    names = F.array_except(names, F.array(*[F.lit(x) for x in LIB_CALLS]))
    keyed = F.transform(F.array_sort(F.transform(names, lambda n: F.struct(
        H(seed, "rename", n).alias("h"), n.alias("name")))), lambda x: x["name"])

    def fresh(i):
        return F.concat(F.lit("v"), i.cast("string"))

    def target(order, i):
        later = F.transform(order, lambda n, j: F.struct(n.alias("name"), j.alias("j")))
        return F.aggregate(later, fresh(i), lambda acc, x: F.when(
            (x["j"] > i) & (x["name"] == acc), fresh(x["j"])).otherwise(acc))

    def renamed(order):
        again = F.exists(order, lambda n: n.rlike("^v[0-9]+$"))
        goals = F.when(again, F.transform(order, lambda _, i: target(order, i))).otherwise(
            F.transform(order, lambda _, i: fresh(i)))
        words = F.regexp_extract_all(text, F.lit("(?U)\\w+|\\W+"), 0)
        return _bind(F.map_from_arrays(order, goals), lambda goal: F.array_join(F.transform(
            words, lambda x: F.coalesce(F.try_element_at(goal, x), x)), ""))
    return _bind(keyed, lambda order: F.when(F.size(order) > 0, renamed(order)).otherwise(text))


def insert_dead_code(text: Column, n_inserts: int = 3, seed: int = 0) -> Column:
    """``n_inserts`` dead statements after lines ending in ';' or '{',
    keeping the line's indentation; unchanged when there is no such line
    (X2). Later inserts on the same line come first, as sequential
    insertion gives."""
    ends = "[;{]" + WS_CLASS[:-1] + "*$"
    lead = "^" + WS_CLASS[:-1] + "*"

    def inserts(pts: Column) -> Column:
        out = []
        for k in reversed(range(n_inserts)):
            h_pt = py_hash(seed, "dead_point", k)
            h_sn = py_hash(seed, "dead_snippet", k)
            snippet = DEAD_CODE_TEMPLATES[h_sn % len(DEAD_CODE_TEMPLATES)].format(n=f"_{seed}_{k}")
            out.append(F.struct(F.element_at(pts, (F.lit(h_pt) % F.size(pts)).cast("int") + 1).alias("at"),
                                F.lit(snippet).alias("s")))
        return F.array(*out)

    def insert(lines: Column, ins: Column) -> Column:
        return F.array_join(F.flatten(F.transform(lines, lambda ln, i: F.concat(
            F.array(ln),
            F.transform(F.filter(ins, lambda x: x["at"] == i),
                        lambda x: F.concat(F.regexp_extract(ln, lead, 0), x["s"]))))), "\n")

    def edit(lines: Column) -> Column:
        flags = F.transform(lines, lambda ln, i: F.when(ln.rlike(ends), i))
        return _bind(F.filter(flags, lambda i: i.isNotNull()), lambda pts: F.when(
            F.size(pts) > 0, _bind(inserts(pts), lambda ins: insert(lines, ins))))

    return F.coalesce(_bind(F.split(text, "\n", -1), edit), text)


DRAW_PRIME = (1 << 31) - 1


def draw_terms(seed: int, salt: str) -> tuple[int, int, int]:
    return tuple(py_hash(seed, salt, k) % (DRAW_PRIME - 1) + 1 for k in range(3))


def position_draw(i: Column, seed: int, salt: str) -> Column:
    """Draw number ``i`` (from 0) of a seed and salt: a quadratic polynomial modulo a
    prime, plain integer arithmetic in the loop over lines and runs."""
    a, b, c = (F.lit(x).cast("long") for x in draw_terms(seed, salt))
    i = i.cast("long")
    return ((i + a) % DRAW_PRIME) * ((i * b + c) % DRAW_PRIME) % DRAW_PRIME


def sql_position_draw(i: str, seed: int, salt: str) -> str:
    """DuckDB text of :func:`position_draw`."""
    a, b, c = draw_terms(seed, salt)
    i = f"CAST({i} AS BIGINT)"
    return f"(((({i} + {a}) % {DRAW_PRIME}) * (({i} * {b} + {c}) % {DRAW_PRIME})) % {DRAW_PRIME})"


def perturb_whitespace(text: Column, seed: int = 0, mode: str = "naive") -> Column:
    """Pad operators with p=.5 each, a blank line after a line with p=.3,
    every run of blanks becomes 1-3 spaces (X3). ``mode='naive'`` pads
    every occurrence like ``str.replace`` (splits ``==``, ``->``, D10);
    ``mode='token_safe'`` pads only whole operators."""
    out = text
    for j, op in enumerate(WS_OPERATORS):
        if py_hash(seed, "ws_op", j) / 4294967296.0 < 0.5:
            if mode == "naive":
                out = F.replace(out, F.lit(op), F.lit(f" {op} "))
            else:
                out = F.regexp_replace(out, _SAFE_OPS[op], f" {op} ")
    lines = F.split(out, "\n", -1)
    lines = F.flatten(F.transform(lines, lambda ln, i: F.when(
        position_draw(i, seed, "ws_line") % 1000 < 300, F.array(ln, F.lit(""))).otherwise(F.array(ln))))
    out = F.array_join(lines, "\n")
    return _bind(F.split(out, "[ \t]+", -1), lambda pieces: F.array_join(F.transform(
        pieces, lambda p, j: F.when(
            j < F.size(pieces) - 1, F.concat(p, F.repeat(F.lit(" "), (
                F.lit(1) + position_draw(j, seed, "ws_run") % 3).cast("int"))))
        .otherwise(p)), ""))


PERTURBATIONS = {
    "rename": lambda c, seed: rename_variables(c, seed),
    "deadcode": lambda c, seed: insert_dead_code(c, 3, seed),
    "whitespace": lambda c, seed: perturb_whitespace(c, seed, "naive"),
    "whitespace_safe": lambda c, seed: perturb_whitespace(c, seed, "token_safe"),
}


def apply_perturbation(text: Column, kind: str, seed: int = 0) -> Column:
    """Registry dispatch; a NULL result (failed edit) returns the original."""
    return F.coalesce(PERTURBATIONS[kind](text, seed), text)


def perturb(df: DataFrame, kinds: Sequence[str] = ("rename", "deadcode", "whitespace"),
            seed: int = 0, n_variants: int = 1, text_col: str = "func") -> DataFrame:
    """``(..., kind, variant, func, func_perturbed)`` for every kind and
    variant (seed + variant) in one pass: ``explode`` of an array of
    structs, one per (kind, variant) (X4, X5, A21)."""
    opts = []
    for v in range(n_variants):
        for k in kinds:
            opts.append(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("variant"),
                                 apply_perturbation(F.col(text_col), k, seed + v).alias("p")))
    out = df.withColumn("_o", F.explode(F.array(*opts)))
    return out.select(*df.columns, F.col("_o.kind").alias("kind"), F.col("_o.variant").alias("variant"),
                      F.col("_o.p").alias("func_perturbed"))


def token_drift(pert: DataFrame, keys: Sequence[str] = ("kind",), text_col: str = "func") -> DataFrame:
    """Did an edit change the token list of the whole text? Share and
    count per kind, with and without blank tokens (X6)."""
    a = code_tokens(F.col(text_col))
    b = code_tokens(F.col("func_perturbed"))
    a2 = code_tokens_no_blank(F.col(text_col))
    b2 = code_tokens_no_blank(F.col("func_perturbed"))
    ch = (a != b).cast("int")
    ch2 = (a2 != b2).cast("int")
    return pert.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ch).alias("n_changed"), F.avg(ch.cast("double")).alias("frac_changed"),
        F.sum(ch2).alias("n_changed_no_blank"), F.avg(ch2.cast("double")).alias("frac_changed_no_blank"))
