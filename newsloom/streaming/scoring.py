"""Resumable scoring: each micro-batch of titles is scored once and kept.

A failed answer goes into a ledger beside the store: the title, and how often it was
asked. The next micro-batch takes in what the ledger holds beside its own titles, so a
title is asked again under the same checkpoint although its file never comes again. What
is known to a batch is what earlier batches wrote, so a batch that is run again asks and
writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.incremental import first_per_key, last_per_key, matched, pending
from newsloom.operators.scoring import score_titles
from newsloom.streaming.ingest import earlier_rows, open_store, write_batch

#: How often a title is asked in all.
TRIES = 3


def _score_schema(
    titles: T.StructType, key: str, keys: tuple[str, ...]
) -> T.StructType:
    return T.StructType(
        [
            titles[key],
            *[T.StructField(k, T.DoubleType()) for k in keys],
            T.StructField("valid", T.BooleanType()),
            T.StructField("model", T.StringType()),
        ]
    )


def ledger_path(path: str) -> str:
    return path.rstrip("/") + "-retries"


def open_ledger(spark: SparkSession, path: str, titles: T.StructType) -> DataFrame:
    """Failed titles of the store at ``path``, one row per try, with ``tries`` so far."""
    extra = [T.StructField("tries", T.IntegerType()), T.StructField("model", T.StringType())]
    return open_store(spark, ledger_path(path), T.StructType([*titles.fields, *extra]))


def to_ask(batch: DataFrame, done: DataFrame, ledger: DataFrame, key: str, tries: int) -> DataFrame:
    """Titles of a batch and of the ledger that have no good answer and tries left.

    One row per key, with ``tries`` so far; a title that comes again counts as the one
    in the ledger.
    """
    state = last_per_key(ledger, [key], ["tries"])
    titles = batch.columns
    fresh = first_per_key(batch, [key], [key])
    fresh = matched(fresh, state.select(key, "tries"), [key], "left").select(*titles, "tries")
    again = matched(state.select(*titles, "tries"), batch, [key], "left_anti")
    both = fresh.unionByName(again).withColumn("tries", F.coalesce("tries", F.lit(0)))
    return pending(both.filter(F.col("tries") < tries), done, [key], "valid")


def score_batch(
    batch: DataFrame,
    batch_id: int,
    keys: tuple[str, ...],
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    model: str,
    key: str,
    run: str,
    tries: int = TRIES,
    **options,
) -> None:
    """Score what is to be asked and write scores, then failures into the ledger."""
    spark = batch.sparkSession
    schema = _score_schema(batch.schema, key, keys)
    store, ledger = open_store(spark, path, schema), open_ledger(spark, path, batch.schema)
    known, failed = (
        earlier_rows(df, run, batch_id).filter(F.col("model") == model).drop("model", "run", "batch_id") for df in (store, ledger)
    )
    asked = to_ask(batch, known, failed, key, tries)
    scored = score_titles(asked.drop("tries"), keys, answer, key, **options)
    write_batch(scored.withColumn("model", F.lit(model)), path, run, batch_id)
    # The answers are read back, so that no title is asked twice for the ledger.
    mine = spark.read.schema(schema).parquet(f"{path}/run={run}/batch_id={batch_id}").filter("NOT valid")
    bad = matched(asked, mine.select(key), [key], "left_semi")
    bad = bad.withColumn("tries", (F.col("tries") + 1).cast("int")).withColumn("model", F.lit(model))
    write_batch(bad, ledger_path(path), run, batch_id)


def score_stream(
    titles: DataFrame,
    keys: tuple[str, ...],
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    model: str,
    key: str = "article_id",
    run: str = "main",
    tries: int = TRIES,
    **options,
) -> StreamingQuery:
    """Score what has landed and is not scored yet, then stop.

    The batch size is the source's ``maxFilesPerTrigger``. After a kill the run
    goes on with the batch it was in; titles scored before are not scored again. A title
    without a good answer is asked in the next batches too, ``tries`` times in all; if
    no batch follows, ``retry_failed`` asks.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, batch_id, keys, answer, path, model, key, run, tries, **options)

    return (
        titles.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def retry_failed(
    spark: SparkSession,
    titles: T.StructType,
    keys: tuple[str, ...],
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    model: str,
    key: str = "article_id",
    run: str = "retry",
    tries: int = TRIES,
    **options,
) -> None:
    """Ask the ledger's titles once more, without a stream: a batch of its own.

    ``titles`` is the schema of the titles that the stream had.
    """
    written = open_store(spark, path, _score_schema(titles, key, keys)).select("run", "batch_id")
    written = written.unionByName(open_ledger(spark, path, titles).select("run", "batch_id"))
    last = written.filter(F.col("run") == run).agg(F.max("batch_id")).first()[0]
    none = spark.createDataFrame([], titles)
    score_batch(none, 0 if last is None else last + 1, keys, answer, path, model, key, run, tries, **options)
