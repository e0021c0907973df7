"""Top-level members of big JSON objects, whatever their layout, read by many tasks.

A file is cut at every closing brace, which Spark can do from any place of it. Whether a
brace is inside a string, and how deep it is, follows from what stands before: per block
of a file the quotes and the depth are added up, for a block that begins inside a string
and one that doesn't; sums over the blocks of a file, of which there are few, tell which
of the two it is and at what depth it begins. A member ends where the depth is back at
one. Members that cross blocks are put together from their parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLOCK = ["file", "block"]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _depth(clean: Column, quotes: Column, inside: Column) -> Column:
    """How much deeper a piece and the brace behind it lead, by the state it begins in."""
    outside = F.when(inside, F.regexp_replace(clean, r'^[^"]*+("|$)', "")).otherwise(clean)
    outside = F.regexp_replace(outside, r'"[^"]*+("|$)', "")
    ends_outside = (inside.cast("int") + quotes) % 2 == 0
    return _count(outside, "{[") - _count(outside, "]") - ends_outside.cast("int")


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, at, value, quotes, before, clean``: texts between closing braces.

    ``before`` counts the quotes since the block began.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Without escapes every quote begins or ends a string.
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    rows = text.withColumn("clean", clean).withColumn("quotes", _count(F.col("clean"), '"'))
    earlier = W.partitionBy(*_BLOCK).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))


def _begins(rows: DataFrame) -> DataFrame:
    """``file, block, inside, depth``: the state each block begins in."""
    odd = F.col("before") % 2 == 1
    sums = rows.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("q"),
        F.sum(_depth(F.col("clean"), F.col("quotes"), odd)).alias("d0"),
        F.sum(_depth(F.col("clean"), F.col("quotes"), ~odd)).alias("d1"),
    )
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))
    return sums.select(*_BLOCK, "inside", F.coalesce(F.sum(deeper).over(earlier), F.lit(0)).alias("depth"))


def _parts(rows: DataFrame) -> DataFrame:
    """``file, block, part, text, ended``: the parts that a block's members have in it.

    Part 0 is what began before the block.
    """
    rows = rows.join(_begins(rows), _BLOCK)
    inside = F.col("inside") != (F.col("before") % 2 == 1)
    rows = rows.withColumn("deeper", _depth(F.col("clean"), F.col("quotes"), inside))
    order = W.partitionBy(*_BLOCK).orderBy("at")
    so_far, earlier = (order.rowsBetween(W.unboundedPreceding, last) for last in (0, -1))
    outside = (inside.cast("int") + F.col("quotes")) % 2 == 0
    rows = rows.withColumn("end", outside & (F.col("depth") + F.sum("deeper").over(so_far) == 1))
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("end").cast("int")).over(earlier), F.lit(0)))
    found = rows.groupBy(*_BLOCK, "part").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"), F.bool_or("end").alias("ended"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    return found.select(*_BLOCK, "part", text.alias("text"), "ended")


def members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``: JSON objects that together hold the members of each file's object.

    A member whose value is an object ends one; others go with the next one that does.
    """
    parts = _parts(pieces(spark, path))
    blocks = parts.groupBy(*_BLOCK).agg(F.max(F.struct("part", "ended")).alias("m"))
    # Where a block's last part goes on: in the parts 0 of blocks up to the next end.
    last = F.when(F.col("m.part") > 0, F.struct(F.col("block").alias("b"), F.col("m.part").alias("n"), F.col("m.ended").alias("e")))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # A block that ends with a member's end leaves nothing to go on with.
    first = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("e"))
    whole = F.when((F.col("m.part") == 0) & F.col("m.ended"), F.struct(F.col("block").alias("b"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("e")))
    tail = F.when(F.col("m.ended") & (F.col("m.part") > 0), F.struct(F.col("block").alias("b"), (F.col("m.part") + 1).alias("n"), F.lit(True).alias("e")))
    goes_on = F.coalesce(F.last(F.coalesce(tail, whole, last), ignorenulls=True).over(earlier), first).alias("g")
    parts = parts.join(blocks.select(*_BLOCK, goes_on), _BLOCK)
    zero = F.col("part") == 0
    owner = F.when(zero, F.struct("g.b", "g.n")).otherwise(F.struct(F.col("block").alias("b"), F.col("part").alias("n")))
    groups = parts.groupBy("file", owner.alias("owner")).agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("t"), F.bool_or("ended").alias("ended")
    )
    text = F.array_join(F.transform("t", lambda x: x["text"]), "")
    # The file's own braces, and the comma before a member.
    text = F.when(F.col("owner.b") == -1, F.regexp_replace(text, r"^\s*\{", "")).otherwise(text)
    text = F.when(F.col("ended"), text).otherwise(F.regexp_replace(text, r"[}\s]+$", ""))
    text = F.regexp_replace(text, r"^[\s,]+", "")
    return groups.select(text.alias("text")).filter("text <> ''").select(F.concat(F.lit("{"), "text", F.lit("}")).alias("value"))
