"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by seeded hashes: the
shard is a function of ``doc_id`` and the number of shards alone (law ``key``), the
bucket within the shard of the whole record. Pass two shuffles each bucket: a
Fisher-Yates permutation of the numbers of its rows gives each its place, and the
places of a shard's buckets follow each other without gaps. Both passes are Spark
shuffles on disk; a task holds the numbers of one bucket, never its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import saved, with_row

SHARDS, SEED, BUCKET_BYTES = 16, 20, 64 * 2**20


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one for the end of the record."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with ``key`` is greatest.

    Depends on key and number of shards alone, also for null; one shard more takes rows
    only into itself, about one in ``shards + 1``.
    """
    ranks = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.greatest(*ranks)["shard"] if shards > 1 else F.lit(0)


def two_pass_shuffle(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The rows of ``docs`` as ``row`` with ``size, shard, grown_shard, bucket, slot``.

    ``slot`` is the place in the shard, gapless from 0, in random order; the same rows
    and seed always meet in the same buckets. ``grown_shard`` is the shard if there were
    one more. Rows that are equal in ``doc_id`` and text share a bucket. An empty table
    gives no rows.
    """
    key, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    spread = with_row(
        docs,
        size=record_bytes(text),
        shard=shard_of(key, shards, seed),
        grown_shard=shard_of(key, shards + 1, seed),
        spread=F.xxhash64(F.lit(seed), key, text),
        all=F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in docs.columns if c != "text"]),
    )
    total = docs.select(F.sum(record_bytes(text))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    spread = spread.withColumn("bucket", (F.col("shard") * per_shard + F.pmod("spread", F.lit(per_shard))).cast("long"))
    # As many tasks as there are buckets: what a task holds follows the bucket's bytes.
    tasks = shards * per_shard
    # How many rows a bucket has and where it begins in its shard; one row per bucket.
    counts = saved(spread.groupBy("shard", "bucket").agg(F.count("*").alias("rows")), "buckets")
    begin = F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")
    # Partitions of a fixed number in a fixed order give a repeated task the same
    # permutations: the function's random numbers follow the rows of a partition.
    buckets = counts.withColumn("begin", begin).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    places = F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), seed)
    moves = buckets.select("bucket", "begin", F.posexplode(places).alias("number", "place")).select(
        "bucket", F.col("number").cast("long").alias("spread"), (F.col("begin") + F.col("place")).alias("slot")
    )
    # Pass one: records and the moves of their bucket come to one place, in one shuffle.
    scattered = spread.withColumn("moves", F.lit(False)).unionByName(
        moves.withColumn("moves", F.lit(True)), allowMissingColumns=True
    ).repartition(tasks, "bucket")
    # Pass two: the n-th record of a bucket takes the n-th move. Ties in the order are
    # rows that are the same in all columns.
    order = Window.partitionBy("bucket", "moves").orderBy("spread", "size", "all")
    pair = Window.partitionBy("bucket", "number")
    moved = (
        scattered.withColumn("number", F.row_number().over(order))
        .withColumn("slot", F.max("slot").over(pair))
        .where("NOT moves")
    )
    return moved.select("row", "size", "shard", "grown_shard", "bucket", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Each shard as a folder of files, one for each of its buckets in order of the slots.

    Buckets are written by the tasks that have shuffled them: no record moves once more.
    The rows' own columns are in the struct ``row``, so no name clashes.
    """
    shuffled.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of written shards: ``row, size, grown_shard, bucket, slot, shard``."""
    return spark.read.parquet(path).withColumn("shard", F.col("shard").cast("int"))
