"""The newsletter's flow: missing days, their links, and articles category by category.

The index and the article store only grow, by one folder a run. A store holds all
categories; an article may stand under several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import incremental as I
from newsloom.operators import newsletter as N
from newsloom.operators.extract import article_records
from newsloom.session import fresh_path

_KEYS = ["category", "article_id"]


def _next_run(spark: SparkSession, path: str | None) -> int:
    return 1 if path is None else (spark.read.parquet(path).agg(F.max("run")).first()[0] or 0) + 1


def _grow(rows: DataFrame, path: str | None, name: str) -> str:
    spark = rows.sparkSession
    out = path or fresh_path(spark, name)
    rows.write.mode("append").parquet(f"{out}/run={_next_run(spark, path)}")
    return out


def days_to_ask(spark: SparkSession, index: str | None, start: str, end: str) -> DataFrame:
    """Days from ``start`` to ``end`` that are not done.

    A day without links, or whose page failed, is asked for again until a later day
    has links.
    """
    have = spark.createDataFrame([], "nl_date date") if index is None else _done(spark, index)
    return N.missing_dates(have, start, end)


def _done(spark: SparkSession, index: str) -> DataFrame:
    return N.done_days(N.days_with_links(spark.read.parquet(index)))


def add_days(spark: SparkSession, pages: DataFrame, index: str | None) -> str:
    """Add the links of landed newsletter pages ``(nl_date, html)`` and give the index's path.

    A day without links has one row without a category, so that it counts as asked for.
    Days that are done are left as they are; a day that was asked for again gets the
    links it has by now.
    """
    if index is not None:
        pages = I.new_only(pages, _done(spark, index), ["nl_date"])
    links = N.newsletter_links(pages)
    days = pages.select("nl_date").distinct()
    empty = days.join(links.select("nl_date").distinct(), "nl_date", "left_anti")
    return _grow(links.unionByName(empty, allowMissingColumns=True), index, "newsletter-index")


def links_to_fetch(
    spark: SparkSession,
    index: str,
    store: str | None,
    siblings: list[DataFrame] = (),
    dead: DataFrame | None = None,
) -> DataFrame:
    """``category, article_id, url`` that no store holds and that are not dead-lettered.

    The newsletter's own store is told apart by category; an article that a sibling
    store of the same publisher holds (by ``article_id``) is fetched for no category.
    """
    links = N.link_ids(N.links_by_category(spark.read.parquet(index).filter("url IS NOT NULL")))
    links = I.first_per_key(links, _KEYS, ["url"])
    if store is not None:
        links = I.exclude_all(links, [spark.read.parquet(store)], keys=_KEYS)
    return I.exclude_all(links, list(siblings), dead)


def add_articles(
    spark: SparkSession, links: DataFrame, fetched: DataFrame, store: str | None, source: str = "nleec"
) -> tuple[str, DataFrame]:
    """Add the details of fetched pages ``(url, html)``; gives the store and the dead letters.

    The record of a page becomes ``data`` of each link to it, whatever the category.
    Dead letters hold the article ids of pages without a record.
    """
    once = I.last_per_key(fetched, ["url"], ["html"])
    good, dead = article_records(once, source)
    rows = links.join(good.drop("html"), "url")
    path = _grow(rows, store, f"{source}-store")
    ids = links.select("article_id", F.col("url").alias("entry")).distinct()
    return path, dead.join(ids, "entry").select(F.col("article_id").alias("entry"), "reason").distinct()


def merge_details(listing: DataFrame, details: DataFrame, key: str = "article_id") -> DataFrame:
    """Listing rows with the record of their article as ``data``; null where it is missing.

    Of several records of an article one is taken.
    """
    one = details.groupBy(key).agg(F.first("data", ignorenulls=True).alias("data"))
    return listing.join(one, key, "left")
