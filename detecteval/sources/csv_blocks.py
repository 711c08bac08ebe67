"""CSV files with line breaks inside quotes, read by many tasks.

Spark reads a multi-line CSV file in one task, because only a scan from its start
tells whether a line break lies inside quotes. Here the file is read as physical
lines in byte blocks, and the quote state is an associative scan: a line starts
either at a record's start (S) or inside quotes (Q), and as a function of that state
it is one of four - ends in S, ends in Q, keeps the state, turns it. The functions of
a block compose to one of the four again, so

1. a first job reduces every block to its function and its numbers of records for
   either start (one row for each block reaches the driver: bytes / block size),
2. the driver runs over the blocks, which gives each its start state and the number
   of records before it,
3. a second job numbers the lines' records and puts them together. Lines move once,
   to their block; only a record cut by a block's end moves on.

Rules: the quote and its escape are ``"``; a field is quoted if it begins with a
quote, so a stray quote inside an unquoted field is text; after a closing quote the
field goes on to the next comma. Line breaks are ``\\n`` or ``\\r\\n`` (a break inside
a field becomes ``\\n``). Empty lines between records are no records. The first record
of each file is its header; the columns are those of the first file by path.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BODY = r'(?:[^"]++|"")*+'
_FIELD = rf'(?:"{_BODY}"[^,]*+|[^",][^,]*+)?+'
_OPENS = rf'(?:{_FIELD},)*+"{_BODY}'
#: A line that starts a record, or one that starts inside quotes, ends inside quotes.
OPEN_FROM_START = rf'\A{_OPENS}\z'
OPEN_FROM_QUOTES = rf'\A{_BODY}(?:"[^,]*+,{_OPENS})?+\z'

_BLOCK = ["file", "block"]


def _in_order():
    return Window.partitionBy(*_BLOCK).orderBy("line")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line (rising inside a block), value, opens (from S, from Q)."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"\r\z", "").alias("value"),
    ).withColumns({"_s": F.col("value").rlike(OPEN_FROM_START), "_q": F.col("value").rlike(OPEN_FROM_QUOTES)})


def _scanned(lines: DataFrame) -> DataFrame:
    """Adds what is known of the state before each line: ``_fixed`` (true: inside quotes)
    once a line of the block has set it, null before; ``_turns`` turns since then."""
    sets = F.col("_s") == F.col("_q")
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("_s") & ~F.col("_q"), 1).otherwise(0)).over(before), F.lit(0))
    return (lines.withColumn("_t", turns)
            .withColumn("_last", F.last(F.when(sets, F.struct(F.col("_s").alias("to"), F.col("_t").alias("at"))), True).over(before))
            .withColumn("_fixed", F.col("_last.to"))
            .withColumn("_turns", F.col("_t") - F.coalesce("_last.at", F.lit(0))).drop("_t", "_last"))


def _inside(start):
    """State before a line (true: inside quotes) when its block starts in ``start``."""
    return F.coalesce("_fixed", start) != (F.col("_turns") % 2 == 1)


def block_table(lines: DataFrame) -> list[dict]:
    """For each block in order: its start state and the number of records that begin before it."""
    scanned = _scanned(lines)
    facts = []
    for name, start in (("s", F.lit(False)), ("q", F.lit(True))):
        inside = _inside(start)
        after = F.when(inside, F.col("_q")).otherwise(F.col("_s"))
        facts += [F.max_by(after, "line").alias(f"end_{name}"),
                  F.sum(F.when(~inside & (F.length("value") > 0), 1).otherwise(0)).alias(f"n_{name}")]
    rows = sorted(scanned.groupBy(*_BLOCK).agg(*facts).collect(), key=lambda r: (r["file"], r["block"]))
    out, total, file, state = [], 0, None, False
    for r in rows:
        if r["file"] != file:
            file, state = r["file"], False
        name = "q" if state else "s"
        out.append({"file": file, "block": r["block"], "_start": state, "_before": total})
        total, state = total + r[f"n_{name}"], r[f"end_{name}"]
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, number, record)``: the text of each record and its number over all
    files, in the order of paths and places, whatever the block size."""
    lines = _lines(spark, path)
    blocks = block_table(lines)
    if not blocks:
        return spark.createDataFrame([], "file string, number long, record string")
    table = spark.createDataFrame([tuple(b.values()) for b in blocks], "file string, block long, _start boolean, _before long")
    # one row for each block; the blocks are cut anew if the session's file settings change in between
    known = F.coalesce("_start", F.raise_error(F.lit("the file blocks changed since they were scanned")).cast("boolean"))
    scanned = _scanned(lines).join(F.broadcast(table), _BLOCK, "left").withColumn("_start", known)
    begins = ~_inside(F.col("_start")) & (F.length("value") > 0)
    numbered = scanned.withColumn("_inside", _inside(F.col("_start"))).withColumn(
        "number", F.col("_before") + F.sum(F.when(begins, 1).otherwise(0)).over(
            _in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    own = (numbered.where(F.col("_inside") | (F.length("value") > 0)).groupBy(*_BLOCK, "number")
           .agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("_l"))
           .select("file", "number", "block", F.array_join(F.col("_l.value"), "\n").alias("part")))
    # only a block's first and last record can go on in another block
    span = Window.partitionBy(*_BLOCK)
    edge = own.withColumn("_edge", (F.col("number") == F.min("number").over(span)) | (F.col("number") == F.max("number").over(span)))
    cut = (edge.where("_edge").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("_p"))
           .select("file", "number", F.array_join(F.col("_p.part"), "\n").alias("record")))
    return edge.where("not _edge").select("file", "number", F.col("part").alias("record")).unionByName(cut)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV file or files under ``path`` with a header: string columns, and
    ``_number``, the place of the row's record among all records."""
    head = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    schema = head.schema
    rows = records(spark, path)
    first = rows.groupBy("file").agg(F.min("number").alias("number"), F.lit(True).alias("_head"))
    parsed = F.from_csv("record", _ddl(schema), {"quote": '"', "escape": '"'})
    return (rows.join(F.broadcast(first), ["file", "number"], "left").where("_head is null")
            .select(F.col("number").alias("_number"), parsed.alias("_r")).select("_number", "_r.*"))


def _ddl(schema) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema.fields)
