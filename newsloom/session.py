"""Session set-up and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SHUFFLE_TARGET = 256 * 2**20


def shuffle_partitions(input_bytes: int, cores: int = 0) -> int:
    """How many partitions a shuffle of that many bytes should have.

    About 256 MB each and no fewer than 200 or three per core; adaptive execution
    joins the ones that turn out small.
    """
    return max(200, 3 * cores, -(-input_bytes // SHUFFLE_TARGET))


def build_session(
    app: str = "newsloom",
    master: str | None = None,
    input_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC dates on.

    ``input_bytes``, the size of what a job reads, sets the number of shuffle
    partitions. Options are given with ``__`` in place of dots.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        builder = builder.config(
            "spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes))
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names.

    A local session without one takes a folder beside the warehouse; on a cluster that
    may be a disk of the driver's machine, so there the setting is asked for.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named:
        named = sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the working folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"

