"""Corpus sources with drifting column names and awkward CSV/JSON content."""
import json
import os

from pyspark.sql import functions as F

from detecteval.sources.corpus import load_dataset
from detecteval.sources.results import flatten_runs, nest_runs, write_documents
from detecteval.streaming.results_log import append_results, read_latest


def test_csv_corpus_drift(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bigvul.csv")
    with open(p, "w") as f:
        f.write('processed_func,target,repo,CWE ID,commit_id\n')
        f.write('"int f() {\n  return ""x"";\n}",1,alpha,CWE-120,c1\n')
        f.write(',0,beta,,c2\n')
        f.write('"",0,beta,,c3\n')
        f.write('"void g() {}",1.0,,CWE-787,c4\n')
    df = load_dataset(spark, "csv", p)
    rows = sorted(df.select("func", "label", "project", "cwe").collect(), key=lambda r: r["func"])
    assert len(rows) == 2
    assert rows[0]["func"] == 'int f() {\n  return "x";\n}' and rows[0]["label"] == 1
    assert rows[1]["project"] == "UNKNOWN" and rows[1]["label"] == 1


def test_csv_corpus_fallback_group(spark, tmp_dir):
    p = os.path.join(tmp_dir, "nogroup.csv")
    with open(p, "w") as f:
        f.write("func,vul,file_name\nint a;,0,x.c\nint b;,1,y.c\n")
    df = load_dataset(spark, "bigvul", p)
    assert sorted(r[0] for r in df.select("project").collect()) == ["x.c", "y.c"]


def test_json_corpus(spark, tmp_dir):
    p = os.path.join(tmp_dir, "devign.json")
    json.dump([{"func": "int a;", "target": 1}, {"func": "int b;", "target": 0}], open(p, "w"))
    df = load_dataset(spark, "json", p)
    r = df.collect()
    assert len(r) == 2 and {x["project"] for x in r} == {"UNKNOWN"} and {x["cwe"] for x in r} == {""}


def test_result_log_latest_and_nesting(spark, tmp_dir):
    p = os.path.join(tmp_dir, "log")
    a = spark.createDataFrame([("m0", 0, 0.1), ("m1", 0, 0.2)], "model string, fold int, f1 double")
    append_results(a, p, "exp", batch=1)
    append_results(a.withColumn("f1", F.col("f1") + 1), p, "exp", batch=2)
    latest = read_latest(spark, p, ["model", "fold"]).orderBy("model").collect()
    assert [r["f1"] for r in latest] == [1.1, 1.2]
    docs = nest_runs(a.withColumn("seed", F.lit(0)), ["model"])
    out = os.path.join(tmp_dir, "docs")
    write_documents(docs, out)
    back = flatten_runs(spark, out).orderBy("model").collect()
    assert [r["f1"] for r in back] == [0.1, 0.2]


def test_follow_latest_stream(spark, tmp_dir):
    from detecteval.streaming.results_log import follow_latest
    p = os.path.join(tmp_dir, "log2")
    a = spark.createDataFrame([("m0", 0, 0.1), ("m1", 0, 0.2)], "model string, fold int, f1 double")
    append_results(a, p, "exp", batch=1)
    append_results(a.withColumn("f1", F.col("f1") + 1), p, "exp", batch=2)
    schema = spark.read.parquet(p).schema
    out = os.path.join(tmp_dir, "snap")
    ck = os.path.join(tmp_dir, "ck")
    q = follow_latest(spark, p, schema, ["model", "fold"], out, ck)
    q.awaitTermination(120)
    # A later cell appends again; the next run of the follower merges it.
    append_results(a.filter("model = 'm0'").withColumn("f1", F.lit(5.0)), p, "exp", batch=3)
    q = follow_latest(spark, p, schema, ["model", "fold"], out, ck)
    q.awaitTermination(120)
    snaps = sorted((int(d.split("=")[1]), d) for d in os.listdir(out) if d.startswith("_epoch="))
    latest = spark.read.parquet(os.path.join(out, snaps[-1][1])).orderBy("model").collect()
    assert [r["f1"] for r in latest] == [5.0, 1.2]


def _awkward_csv(path, rows, seed):
    """Quotes, commas and line breaks in random places; stray quotes in unquoted fields."""
    import csv
    import random
    rng = random.Random(seed)
    parts = ["x", "é", ",", '"', "\n", '""', "\n\n", " ", "if (a) {\n", "\t", "中"]
    out = []
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("func,label,note\n")
        w = csv.writer(f, lineterminator="\n")
        for i in range(rows):
            text = "f" + "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) + ";"
            if i % 50 == 7:
                text = "long " + 'a "line"\n' * 300 + "end"
            if i % 10 == 3:
                f.write(f'a 5" pipe {i},1,"q\n\n""{i}"\n')
                out.append((f'a 5" pipe {i}', "1", f'q\n\n"{i}'))
                if i % 20 == 3:
                    f.write("\n")
            else:
                w.writerow([text, i % 2, f"n{i}"])
                out.append((text, str(i % 2), f"n{i}"))
    return out


def test_csv_blocks_equal_one_task(spark, tmp_dir):
    from detecteval.sources import csv_blocks as cb
    place = os.path.join(tmp_dir, "csvs")
    os.mkdir(place)
    want = []
    for k in range(2):
        want += _awkward_csv(os.path.join(place, f"part{k}.csv"), 400, k)
    numbers = {}
    for size in ("700b", "5k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        try:
            got = cb.read_csv(spark, place).orderBy("_number").collect()
            blocks = cb.block_table(cb._lines(spark, place))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [(r["func"], r["label"], r["note"]) for r in got] == want
        numbers[size] = [r["_number"] for r in got], len(blocks)
    assert numbers["700b"][0] == numbers["5k"][0] == numbers["128m"][0]
    assert numbers["700b"][1] > 50 > numbers["128m"][1]
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(place)
    assert sorted((r["func"], r["label"], r["note"]) for r in one.collect()) == sorted(want)


def test_csv_blocks_windows_line_ends_and_headers_only(spark, tmp_dir):
    from detecteval.sources import csv_blocks as cb
    p = os.path.join(tmp_dir, "w.csv")
    with open(p, "w", newline="") as f:
        f.write('func,label\r\n"a\r\nb",1\r\n\r\nc,0\r\n"open ""end"""')
    rows = [(r["func"], r["label"]) for r in cb.read_csv(spark, p).orderBy("_number").collect()]
    assert rows == [("a\nb", "1"), ("c", "0"), ('open "end"', None)]
    q = os.path.join(tmp_dir, "h.csv")
    with open(q, "w") as f:
        f.write("func,label\n")
    assert cb.read_csv(spark, q).count() == 0


def test_equal_csv_rows_have_ids_of_their_own(spark, tmp_dir):
    p = os.path.join(tmp_dir, "same.csv")
    with open(p, "w") as f:
        f.write("func,label\n" + "int a;,1\n" * 5)
    ids = [r["row_id"] for r in load_dataset(spark, "csv", p).collect()]
    assert len(ids) == 5 and len(set(ids)) == 5
