"""Links out of newsletter pages, and the index of links by day and category.

The index is kept flat, one row per day, category and link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions.text import (
    article_id,
    category_label,
    squeeze_ws,
    unquote,
    unwrap_redirect,
)
from newsloom.operators.extract import extract_anchors

# Category markers in a link, and link texts that are no headline.
CATEGORIES = (
    "news%2Fenvironment",
    "news%2Frenewable",
    "news%2Fcompanies",
    "news%2Feconomy",
    "news%2Fpower",
    "news%2Fcoal",
    "news%2Foil",
)
STUB_TEXTS = ("", "read more")


def drop_stub_links(links: DataFrame, text: str = "text") -> DataFrame:
    """Drop links whose text is no headline."""
    return links.filter(~F.lower(squeeze_ws(text)).isin(*STUB_TEXTS))


def tag_categories(
    links: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    href: str = "href",
    name: str = "category",
) -> DataFrame:
    """One row per link and category marker its address contains.

    The markers are a short list in the code, so they are tested as literals; no
    join is needed.
    """
    target = F.col(href)
    markers = F.array(*[F.lit(c) for c in categories])
    hits = F.filter(markers, lambda c: F.contains(target, c))
    return links.withColumn(name, F.explode(hits))


def newsletter_links(
    pages: DataFrame,
    day: str = "nl_date",
    categories: tuple[str, ...] = CATEGORIES,
    html: str = "html",
) -> DataFrame:
    """Distinct ``(nl_date, category, url)`` of newsletter pages."""
    anchors = extract_anchors(pages.select(day, html), html)
    tagged = tag_categories(drop_stub_links(anchors), categories)
    return distinct_links(
        tagged.select(
            F.col(day).alias("nl_date"),
            category_label("category").alias("category"),
            unquote(unwrap_redirect("href")).alias("url"),
        )
    )


def distinct_links(links: DataFrame) -> DataFrame:
    """Each link once per day and category."""
    return links.dropDuplicates(["nl_date", "category", "url"])


def links_by_category(index: DataFrame) -> DataFrame:
    """Each link once per category, over all days."""
    return index.select("category", "url").distinct()


def link_count(index: DataFrame) -> DataFrame:
    """How many links the index holds; one found on two days counts twice."""
    return index.agg(F.count("url").alias("n_links"))


def category_counts(index: DataFrame) -> DataFrame:
    """Distinct links per category."""
    return index.groupBy("category").agg(F.countDistinct("url").alias("n_links"))


def days_with_links(index: DataFrame) -> DataFrame:
    """Each day, and whether it has any link."""
    return index.groupBy("nl_date").agg((F.count("url") > 0).alias("has_any"))


def link_matrix(
    days: DataFrame, index: DataFrame, categories: tuple[str, ...]
) -> DataFrame:
    """The index with a row for every day and category; ``url`` null where empty."""
    labels = F.array(*[F.lit(c) for c in categories])
    asked = days.select("nl_date").distinct()
    links = distinct_links(index.select("nl_date", "category", "url")).filter(
        F.col("url").isNotNull() & F.col("category").isin(*categories)
    )
    # Only cells are joined, never the links in them: a cell may hold very many.
    full = links.select("nl_date", "category").distinct()
    empty = asked.withColumn("category", F.explode(labels)).join(
        full, ["nl_date", "category"], "left_anti"
    )
    return links.join(asked, "nl_date", "left_semi").unionByName(
        empty.withColumn("url", F.lit(None).cast("string"))
    )


def missing_dates(store: DataFrame, start: str, end: Column | str) -> DataFrame:
    """Days from ``start`` to ``end``, both included, that the store lacks."""
    have = store.select("nl_date").distinct()
    return D.date_range(store.sparkSession, start, end).join(have, "nl_date", "left_anti")


def done_days(attempts: DataFrame) -> DataFrame:
    """Days that are not asked for again.

    A day without links is only put into the index in memory; the next good day
    saves the index and so marks all days before it as done.
    """
    last_good = attempts.filter("has_any").agg(F.max("nl_date").alias("d")).scalar()
    return attempts.filter(F.col("nl_date") <= last_good).select("nl_date")


def order_by_name_length(
    categories: DataFrame, name: str = "category", seen: str = "first_seen"
) -> DataFrame:
    """Longest name first; equal lengths keep their order of arrival."""
    return categories.orderBy(F.length(name).desc(), F.col(seen))


def set_as_json(values: Column) -> Column:
    """A set of texts as a JSON array, sorted so that equal sets give equal text."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


def link_ids(links: DataFrame, url: str = "url") -> DataFrame:
    """Add the article id of each link."""
    return links.withColumn("article_id", article_id(url))
