"""Running values over one long ordered run, without sorting it in one task.

A plain window partitioned by a hot key would hold all rows of that key in one
task. Here the rows of all runs are dealt into buckets by rank: ranges of (run, order)
that a sample of the rows makes about even, so a bucket's size does not depend on how
the values are spread, and a run of any size fills as many buckets as it needs. The
buckets are summed up, only the sums are scanned in order, and each row is completed
with what came before its bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.session import fresh_path

WIDTH = 65_536


def bucketed(df: DataFrame, part: list[str], order: str, width: int = WIDTH) -> DataFrame:
    """Add the bucket, unless an earlier step did.

    A bucket has about ``width`` rows; those of a run follow each other in order. The
    rows are written down with their buckets: ranges come from a sample, so all steps
    must see the same ones, and steps over the same run share one shuffle by range.
    Rows of a run that are equal in ``order`` share a bucket.
    """
    if "_bucket" in df.columns:
        return df
    spark = df.sparkSession
    buckets = max(1, -(-df.count() // width))
    ranged = df.repartitionByRange(buckets, *[F.col(c) for c in [*part, order]])
    path = fresh_path(spark, "ordered")
    ranged.withColumn("_bucket", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def with_carry(
    df: DataFrame,
    part: list[str],
    summary: dict[str, Column],
    scan: dict[str, Callable],
) -> DataFrame:
    """Join what the earlier buckets of the run sum up to.

    ``df`` has its bucket in ``_bucket``. ``summary`` gives the aggregates of a
    bucket; each ``scan`` takes the windows (buckets before, whole run) and gives
    the column to join.
    """
    run = W.partitionBy(*part)
    before = run.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*part, "_bucket").agg(
        *[agg.alias(name) for name, agg in summary.items()]
    )
    keys = [*part, "_bucket"]
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[fn(before, run).alias(name) for name, fn in scan.items()],
    )
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(carry[f"_k_{k}"])
    return df.join(carry, same, "left").drop(*[f"_k_{k}" for k in keys])


def numbered(
    df: DataFrame,
    part: list[str],
    order: str,
    name: str = "idx",
    total: str | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add the 1-based position of a row in its run, and the size of the run."""
    rows = bucketed(df, part, order, width)
    local = W.partitionBy(*part, "_bucket").orderBy(order)
    rows = with_carry(
        rows,
        part,
        {"_n": F.count(F.lit(1))},
        {
            "_before": lambda before, run: F.sum("_n").over(before),
            "_total": lambda before, run: F.sum("_n").over(run),
        },
    )
    at = F.row_number().over(local).cast("bigint") + F.coalesce("_before", F.lit(0))
    out = [*df.columns, at.alias(name)]
    if total:
        out.append(F.col("_total").alias(total))
    return rows.select(*out)


def previous(
    df: DataFrame,
    part: list[str],
    order: str,
    value: str,
    name: str,
    width: int = WIDTH,
) -> DataFrame:
    """Add the value of the row before in the run; null on the first row."""
    rows = bucketed(df, part, order, width)
    local = W.partitionBy(*part, "_bucket").orderBy(order)
    rows = with_carry(
        rows,
        part,
        {"_last": F.max_by(value, order)},
        {"_carry": lambda before, run: F.last("_last").over(before)},
    )
    is_first = F.row_number().over(local) == 1
    prev = F.when(is_first, F.col("_carry")).otherwise(F.lag(value).over(local))
    return rows.select(*df.columns, prev.alias(name))


def running(
    df: DataFrame,
    part: list[str],
    order: str,
    value: str,
    name: str,
    kind: str = "max",
    inclusive: bool = True,
    width: int = WIDTH,
) -> DataFrame:
    """Add the running ``max``, ``min`` or ``sum`` of a column in its run."""
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[kind]
    rows = bucketed(df, part, order, width)
    local = (
        W.partitionBy(*part, "_bucket")
        .orderBy(order)
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    rows = with_carry(
        rows,
        part,
        {"_agg": agg(value)},
        {"_carry": lambda before, run: agg("_agg").over(before)},
    ).withColumn("_local", agg(value).over(local))
    if kind == "sum":
        both = F.coalesce(F.col("_local") + F.col("_carry"), "_local", "_carry")
    elif kind == "max":
        both = F.greatest("_local", "_carry")
    else:
        both = F.least("_local", "_carry")
    return rows.select(*df.columns, both.alias(name))
