"""Column expressions over text: whitespace keys, line counts, tokens."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 29 code points that Python's Unicode-aware ``\s`` matches,
# spelled out so Java regex (Spark) and RE2 (DuckDB) agree with it.
WS_CLASS = ("[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")

# Java/RE2 text of the same class for SQL strings (one backslash per escape).
WS_CLASS_SQL = ("[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
                "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")

# Trim of the same class (Spark ``trim`` only strips ASCII space).
_LEAD = "^" + WS_CLASS[:-1] + "+"
_TRAIL = WS_CLASS[:-1] + "+$"


def ws_normalised(col: Column) -> Column:
    """Runs of Unicode whitespace -> one space, then stripped."""
    one = F.regexp_replace(col, WS_CLASS, " ")
    return F.regexp_replace(F.regexp_replace(one, "^ ", ""), " $", "")


def dedup_key(col: Column) -> Column:
    """256-bit digest of the whitespace-normalised text (bounded key width)."""
    return F.sha2(ws_normalised(col), 256)


def n_lines(col: Column) -> Column:
    """``str.count('\\n') + 1``."""
    return (F.length(col) - F.length(F.regexp_replace(col, "\n", ""))) + F.lit(1)


# Unicode word characters (letters, digits, underscore): Python's ``\w``,
# spelled so Java regex and RE2 agree.
WORD_RUN = "[\\p{L}\\p{N}_]+"


def word_tokens(col: Column) -> Column:
    """Lower-cased Unicode word tokens, length 1 kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_RUN), 0)


def code_tokens(col: Column) -> Column:
    """Word runs, punctuation runs and blank runs of the whole text."""
    return F.regexp_extract_all(col, F.lit("(?U)\\w+|[^\\w\\s]+|\\s+"), 0)


def code_tokens_no_blank(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit("(?U)\\w+|[^\\w\\s]+"), 0)
