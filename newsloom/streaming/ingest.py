"""Landed listings into an append-only store, one micro-batch at a time.

Each batch of each run owns one folder of the store and overwrites it, so a batch
that is run again after a failure leaves the same rows. What is known to a batch
is all of the store but its own folder and later ones of its run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.incremental import first_per_key, known_keys


def open_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The store as a table; it is made if it is not there."""
    full = T.StructType(
        [
            *schema.fields,
            T.StructField("run", T.StringType()),
            T.StructField("batch_id", T.LongType()),
        ]
    )
    spark.createDataFrame([], full).write.mode("ignore").partitionBy(
        "run", "batch_id"
    ).parquet(path)
    return spark.read.schema(full).parquet(path)


def earlier_rows(store: DataFrame, run: str, batch_id: int) -> DataFrame:
    """What the store held before a batch of a run, also when it is run again."""
    return store.filter((F.col("run") != run) | (F.col("batch_id") < batch_id))


def write_batch(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Put the rows of a batch into its own folder of the store."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def append_new(
    batch: DataFrame,
    batch_id: int,
    path: str,
    keys: list[str],
    order: list[str],
    run: str,
) -> None:
    """Add the rows of a batch whose key the store does not hold."""
    store = open_store(batch.sparkSession, path, batch.schema)
    # Read twice, once for its keys, once for its rows; nothing of it is held.
    known = known_keys(batch, earlier_rows(store, run, batch_id), keys)
    fresh = first_per_key(batch.join(known, keys, "left_anti"), keys, order)
    write_batch(fresh, path, run, batch_id)


def compact(spark: SparkSession, path: str, out: str, files: int, keys: list[str]) -> None:
    """The rows of a store in ``files`` files a run, as a new store at ``out``.

    Rows are dealt by their keys, so a run of any size is written by ``files`` tasks and
    a task that is repeated writes the same rows. All batches of a run become its batch
    0, so a run that goes on finds them all.
    """
    rows = spark.read.parquet(path).withColumn("batch_id", F.lit(0).cast("long"))
    rows.repartition(files, *keys).write.partitionBy("run", "batch_id").parquet(out)


def ingest_stream(
    source: DataFrame,
    to_listing: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: list[str],
    order: list[str],
    run: str = "main",
) -> StreamingQuery:
    """Take in all that has landed and stop.

    ``to_listing`` turns raw rows into listing rows. Keep ``run`` for as long as
    the checkpoint is kept; a new checkpoint needs a new run name.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        append_new(to_listing(batch), batch_id, path, keys, order, run)

    return (
        source.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
