"""Benchmark of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full with the ``noop`` sink (no collect).
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from detecteval.operators import cost as co  # noqa: E402
from detecteval.operators import curves as cv  # noqa: E402
from detecteval.operators.prep import preprocess  # noqa: E402
from detecteval.plans import fixtures as fx  # noqa: E402
from detecteval.plans import pt as ptm  # noqa: E402
from detecteval.plans import reports as rp  # noqa: E402
from detecteval.plans import transfer as tr  # noqa: E402


def lineitem_curve(spark, d):
    return cv.pr_curve(fx.scored_lineitem(spark, d), ["model"])


def lineitem_metrics(spark, d):
    return cv.compute_metrics(fx.scored_lineitem(spark, d), ["model"])


def lineitem_per_group(spark, d):
    pt = fx.scored_lineitem(spark, d)
    cur = cv.pr_curve(pt, ["model", "project"])
    return cv.threshold_max_f1(cur, ["model", "project"])


def lineitem_budget(spark, d):
    pt = fx.scored_lineitem(spark, d).withColumnRenamed("row_key", "row_id")
    return co.budget_recall(pt, ["model"])


def corpus_prep(spark, d):
    return fx.corpus(spark, d)


def transfer(spark, d):
    return tr.threshold_transfer_runs(ptm.transfer_pt(spark, d).drop("logit0", "logit1"))


def events_transfer(spark, d):
    return tr.threshold_transfer_runs(ptm.events_transfer_pt(spark, d).drop("logit0", "logit1"))


def events_adaptive(spark, d):
    return rp.adaptive_thresholds(ptm.events_transfer_pt(spark, d))


def events_drift(spark, d):
    return rp.drift_report(ptm.events_transfer_pt(spark, d))


QUERIES = {
    "corpus_prep": corpus_prep,
    "lineitem_pr_curve": lineitem_curve,
    "lineitem_metrics": lineitem_metrics,
    "lineitem_per_group_threshold": lineitem_per_group,
    "lineitem_budget_recall": lineitem_budget,
    "threshold_transfer": transfer,
    "events_threshold_transfer": events_transfer,
    "events_adaptive_calibration": events_adaptive,
    "events_drift": events_drift,
}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("detecteval-bench")
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(
        spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="de-bench-", dir="/tmp"))
    names = sys.argv[1:] or list(QUERIES)
    times = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, d).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    sf = d.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf}))


if __name__ == "__main__":
    main()
