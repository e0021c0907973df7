"""What each of several filters removes, under every order they may be applied in.

A document is known by its mask, the filters it fails. In an order of filters it is
removed at the first step whose filter is in the mask. Orders are numbered by their
Lehmer rank, which is their lexicographic place, so all orders that begin with the same
letters are one interval of ranks. A mask is removed at step s by every order that begins
with s - 1 letters from outside the mask and then one of it: a few intervals. Counts are
added where an interval begins and taken away where it ends, and a running sum over the
ranks gives what every order removes at that step. No document meets an order by itself:
after one pass the work is one row per part and mask.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import saved

#: Letters of the built-in filters, in the order of their bits; the last is for copies.
LETTERS = "ABCDE"
_SUMS = ["n", "good", "toxic"]


def filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that is not null, by letter.

    Too few words, too few different words, too many capitals, symbols.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    size = F.size(words)
    return {
        "A": size < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * size,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Place of the first permutation of ``range(n)`` that begins with ``prefix``."""
    rest, rank = list(range(n)), 0
    for i, x in enumerate(prefix):
        rank += rest.index(x) * factorial(n - 1 - i)
        rest.remove(x)
    return rank


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """``(mask, step, first, after)``: ranks of orders that remove the mask at the step."""
    found = []
    for mask in range(1, 1 << n):
        inside = [i for i in range(n) if mask >> i & 1]
        outside = [i for i in range(n) if not mask >> i & 1]
        for step in range(1, len(outside) + 2):
            width = factorial(n - step)
            for head in permutations(outside, step - 1):
                for last in inside:
                    first = lehmer_rank((*head, last), n)
                    found.append((mask, step, first, first + width))
    return found


def masks(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each source by the filters they fail.

    ``conditions`` are failure conditions on the column ``text`` (never null there), by
    letter; bit i of the mask is the i-th of them. One more bit, the highest, is set for a
    text that a smaller ``doc_id`` has too. A null text is empty, a null source is the
    part ``''``, a null condition holds not. A row without ``doc_id`` has no smaller one,
    is none, and has no label; rows of the same id are documents of their own. A document
    is good or toxic if one row of ``labels`` says so.

    Copies of a text by rows of one id are counted before they are shuffled, and copies
    meet by text *and* id, so a group of copies of any size is spread.
    """
    conditions = conditions or filters(F.col("text"))
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    mask = sum(
        (F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(conditions.values())),
        F.lit(0),
    )
    rows = plain.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    rows = saved(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "audit-rows")
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << len(conditions)))
    known = known.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + late)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    known = known.join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    none = rows.where("doc_id IS NULL").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    lost = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c)
    return known.unionByName(none).groupBy("part", "mask").agg(F.sum("n").alias("total"), lost("good"), lost("toxic")).withColumnRenamed("total", "n")


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, zeros included, from ``part, mask, n, good, toxic``.

    Columns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. A part without a row in ``counted`` has none here, so an empty
    table gives none. A part has n! times n rows for n filters, whatever its size.
    """
    n = len(letters)
    orders, spark = factorial(n), counted.sparkSession
    counted = saved(counted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in _SUMS]), "audit-masks")
    # Tables of a fixed size: 840 and 120 rows for five filters.
    spans = F.broadcast(spark.createDataFrame(intervals(n), "mask int, step int, first int, after int"))
    named = ["".join(letters[i] for i in order) for order in permutations(range(n))]
    names = F.broadcast(spark.createDataFrame(list(enumerate(named)), "rank int, filter_order string"))
    # Interval ends, and a zero for every cell.
    ends = counted.join(spans, "mask").selectExpr(
        "part", "step", "inline(array(struct(first AS rank, n, good, toxic), struct(after AS rank, -n AS n, -good AS good, -toxic AS toxic)))"
    )
    zeros = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    zeros = zeros.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in _SUMS])
    deltas = ends.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in _SUMS])
    ranks = Window.partitionBy("part", "step").orderBy("rank")
    cells = deltas.select("part", "step", "rank", *[F.sum(c).over(ranks).alias(c) for c in _SUMS]).where(F.col("rank") < orders)
    cells = cells.join(names, "rank").withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    # What does not depend on the order: per part, and per part and filter.
    bits = F.explode(F.array(*[F.struct(F.lit(x).alias("filter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(letters)]))
    facts = counted.select("part", "mask", "n", bits.alias("b")).groupBy("part", F.col("b.filter").alias("filter")).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("b.bit")) > 0, F.col("n")).otherwise(F.lit(0))).alias("fails"),
        F.sum(F.when(F.col("mask") == F.col("b.bit"), F.col("n")).otherwise(F.lit(0))).alias("unique_fails"),
    )
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    return cells.join(facts, ["part", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"),
        (F.col("fails") - F.col("n")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five built-in filters over all documents."""
    return audit(masks(docs, labels))


#: The same by brute force: every order and step against every mask.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part, list_filter([
    CASE WHEN len(ws) < 50 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > least THEN 'E' END
  ], lambda x: x IS NOT NULL) AS fails FROM w
),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, fails, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
),
p AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM p, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, x)
),
o AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM p WHERE length(filter_order) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, string_split(filter_order[1:step - 1], '') AS before FROM o),
c AS (
  SELECT part, filter_order, step, filter,
    CAST(coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, before) AND NOT list_contains(fails, filter)), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, before) AND list_contains(fails, filter)), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE list_has_any(fails, before) AND list_contains(fails, filter)), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE fails = [filter]), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE NOT list_has_any(fails, before) AND list_contains(fails, filter)), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE NOT list_has_any(fails, before) AND list_contains(fails, filter)), 0) AS BIGINT) AS toxic_lost
  FROM m CROSS JOIN s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM c
"""
