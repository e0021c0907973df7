"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch
is first reduced to one representative per digest, with map-side combining, so a group
of copies of any size is one row when it meets the index; a sort-merge anti-join then
finds the digests that are new, without shuffling the index, and only these are appended.
The verdict is what the index says afterwards: each digest has the batch that brought
it, so a batch that is run again under its own name, after its append too, keeps the same
rows.

Texts are equal when they are identical after all white space is taken out; null is
empty. Of equal texts the one with the most code points stays, then the smallest
``doc_id`` (null last), then, for rows that are the same in both, any one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import WHITE, saved, with_row
from newsloom.session import fresh_path

BUCKETS = 64


def text_digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def text_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


class DigestIndex:
    """Digests of all texts kept so far, in a table at ``path``.

    The files last longer than the session: opening the same path with the same number
    of buckets registers the table anew. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digests_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        if not spark.catalog.tableExists(self.name):
            where = path.replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, n_points BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{where}'"
            )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def missing(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests`` (one per digest) that the index doesn't hold."""
        return digests.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame, batch: str) -> None:
        """Add rows ``digest, keep_id, n_points`` of a batch; one file per bucket that gets any."""
        (
            new.select("digest", "keep_id", "n_points", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.name, path=self.path)
        )

    def held(self, rows: DataFrame, batch: str) -> DataFrame:
        """``rows`` (one per digest) with ``index_id``, the id that the index holds for the
        digest, and ``mine``, whether it came with this batch. All digests are in the index."""
        there = self.read().select("digest", F.col("keep_id").alias("index_id"), (F.col("batch") == batch).alias("mine"))
        return rows.join(there.hint("merge"), "digest")

    def forget(self) -> None:
        """Take the table's name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def new_index(spark: SparkSession, name: str = "digest-index", buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared working folder.

    With as many buckets as the session's shuffles have partitions, ``BUCKETS`` at
    least: a bucket is then about what one task of a shuffle takes.
    """
    if buckets is None:
        buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return DigestIndex(spark, re.sub(r"\s", "_", fresh_path(spark, name)), buckets)


def _best() -> Column:
    """Order of preference within a digest, best first."""
    return F.struct(
        F.col("n_points"),
        F.col("doc_id").isNotNull(),
        -F.col("doc_id"),
        -F.col("uid"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Verdict on each row of a batch; digests that are new enter the index.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.
    ``keep_id`` is that of the index; if an earlier batch holds the text no row of
    this batch is kept. ``group_size`` counts the rows of this batch. Exactly one row of
    a new digest is kept, also where rows repeat an id. A batch without rows adds nothing.
    A batch with the same name and rows as one before has the same verdicts; without a
    name it is a batch of its own.
    """
    batch = batch or uuid.uuid4().hex
    text = F.col("text").cast("string")
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_points(text).alias("n_points"),
            text_digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digests",
    )
    groups = saved(
        rows.groupBy("digest")
        .agg(F.max_by(F.struct("doc_id", "uid", "n_points"), _best()).alias("best"), F.count("*").alias("group_size"))
        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.col("best.n_points").alias("n_points")),
        "groups",
    )
    index.append(index.missing(groups), batch)
    verdicts = index.held(groups, batch).select("digest", "group_size", F.col("index_id").alias("keep_id"), F.when(F.col("mine"), F.col("keep_uid")).alias("keep_uid"))
    # Written: what later batches add to the index does not matter any more.
    verdicts = saved(verdicts, "verdicts")
    # Rows of a group of any size: adaptive execution splits a hot digest of this join.
    return rows.join(verdicts, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_new(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; their digests enter the index.

    Ranks are limited to one before the shuffle, so copies don't travel. See
    ``deduplicate`` for the name of a batch.
    """
    batch = batch or uuid.uuid4().hex
    text = F.col("text").cast("string")
    rows = with_row(
        docs,
        doc_id=F.col("doc_id").cast("long"),
        digest=text_digest(text),
        n_points=text_points(text),
    )
    order = Window.partitionBy("digest").orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"))
    first = saved(rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank"), "first-rows")
    new = index.missing(first.select("digest", "doc_id", "n_points"))
    index.append(new.withColumnRenamed("doc_id", "keep_id"), batch)
    mine = saved(index.held(first.select("digest"), batch).where("mine").select("digest"), "kept-digests")
    return first.join(mine, "digest", "left_semi").select("row.*")
