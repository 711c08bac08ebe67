import re

from pyspark.sql import functions as F

from detecteval.functions.hashing import py_hash
from detecteval.operators import perturb as pe

TEXTS = ["int v1; int a; int v0; char b = v0+v1+a; v2 = b; float v2;", "long v3; long v2; long v1; long v0; v0 v1 v2 v3 v4",
         "int strcpy; int *p; p->q; strcpy(p)", "no names here", "", None, "int ét; double x́y = x́y + x; print q q2"]


def one_after_another(text, seed):
    decl = re.compile("(?:" + "|".join(pe.TYPE_KW) + r")\s+\**\s*([A-Za-z_]\w*)")
    names = [n for n in dict.fromkeys(decl.findall(text)) if n not in pe.LIB_CALLS]
    for i, n in enumerate(sorted(names, key=lambda n: (py_hash(seed, "rename", n), n))):
        text = re.sub(rf"\b{n}\b", f"v{i}", text)
    return text


def test_rename_equals_renames_one_after_another(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "func string")
    for seed in range(4):
        got = [r["o"] for r in df.select(pe.rename_variables(F.col("func"), seed).alias("o")).collect()]
        assert got[4:6] == ["", None]
        assert got[:4] == [one_after_another(t, seed) for t in TEXTS[:4]]
        assert "x́y" not in got[6] and re.search(r"\+ x;", got[6])


def test_rename_does_not_scan_the_text_once_a_name(spark, capsys):
    df = spark.createDataFrame([("int a;",)], "func string").select(pe.rename_variables(F.col("func"), 0).alias("o"))
    df.explain(True)
    assert "regexp_replace" not in capsys.readouterr().out
