"""Spark session helpers.

The library never creates a session on its own inside an operator; callers
pass one in. ``get_spark`` is the convenience used by tests and ``bench.py``.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "detecteval") -> SparkSession:
    master = master or os.environ.get("DETECTEVAL_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("DETECTEVAL_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("DETECTEVAL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a scratch one only when none is set.

    A folder that the caller or ``spark.checkpoint.dir`` has set stays as it is.
    Only a local session without either gets a fresh temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            named = tempfile.mkdtemp(prefix="detecteval-ckpt-", dir="/tmp")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the
    driver did. On a cluster without that folder, ship it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def checkpoint(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df, parts: int | None = None):
    """``df`` as a table written once to the shared folder of ``spark.checkpoint.dir``
    and read back: cut lineage like a checkpoint, but in compressed columns, and
    :func:`discard` frees it as soon as nothing reads it any more."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out._written_to = place
    return out


def remove_folder(spark, place: str) -> None:
    """Delete a folder of the library's own, wherever the file system of its path is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables) -> None:
    """Delete tables of :func:`written` that no later job reads."""
    for table in tables:
        remove_folder(table.sparkSession, table._written_to)
