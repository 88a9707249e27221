"""Session helpers.

`shared_dir` returns a folder under the cluster's ``spark.checkpoint.dir`` (the shared
location every executor can reach). Only when that setting is missing in a local session
is a fresh temporary folder created and registered; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(
    app: str = "spanlake",
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    driver_memory: str = "16g",
) -> SparkSession:
    """Local session with AQE on and the web UI off (used by tests and bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only if none is configured."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spanlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, name: str = "table"):
    """Cut the lineage by writing a parquet table into the shared folder and reading it
    back (one computation; a reliable ``checkpoint()`` would compute the plan twice).
    Never a local checkpoint: the files outlive any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed_table(df, name: str, keys: list[str], buckets: int | None = None):
    """The rows as a table in the shared folder, bucketed and sorted by ``keys`` (as many buckets as shuffle
    partitions by default): joins on the keys between such tables need no exchange."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, name)
    table = f"spanlake_{name}_{path[-12:]}"
    # the same hash deals rows to tasks and to buckets: one file per bucket
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


__all__ = ["bucketed_table", "get_spark", "checkpoint_root", "shared_dir", "cut_lineage"]
