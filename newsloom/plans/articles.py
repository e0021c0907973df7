"""From stored sources to the one article table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import conform as C
from newsloom.operators.extract import ARTICLE_FIELDS
from newsloom.sources.files import write_table
from newsloom.sources.keyed_json import read_keyed_json

# Shapes of the stores as they are read; keywords of the core sources stay raw
# JSON text, as they come as a list, as one text, or not at all.
_LISTED = (
    "url string, title string, summary string, body string,"
    "date_published string, author string, key_words array<string>"
)
STORE_SCHEMAS = {
    "ec": ARTICLE_FIELDS.simpleString()[len("struct<") : -1],
    "eec": "url string, headline string, summary string, data string",
    "nleec": "url string, headline string, summary string, data string",
    "mercom": (
        "url string, title string, body string, date string,"
        "author string, categories array<string>"
    ),
    "saur": _LISTED,
    "pvmag": _LISTED,
    "pvmag_global": _LISTED,
    "pvmag_us": _LISTED,
}


def read_source(
    spark: SparkSession, path: str | list[str], source: str, indented: bool | None = None
) -> DataFrame:
    """One source's keyed-JSON store under the common column names."""
    schema = STORE_SCHEMAS[source].replace(":", " ")
    store = read_keyed_json(spark, path, schema, indented=indented)
    return C.conform(C.unwrap_data(store, source, ARTICLE_FIELDS), source)


def article_table(
    spark: SparkSession, paths: dict[str, str | list[str]], indented: bool | None = None
) -> DataFrame:
    """All sources in one table; ``paths`` names the store file or files of each."""
    return C.union_sources(
        [read_source(spark, path, source, indented) for source, path in paths.items()]
    )


def build_articles(
    spark: SparkSession,
    paths: dict[str, str | list[str]],
    out: str,
    indented: bool | None = None,
) -> DataFrame:
    """Write the article table as Parquet and give the rows per source."""
    write_table(article_table(spark, paths, indented), out)
    return C.counts(spark.read.parquet(out))


def by_month(articles: DataFrame) -> DataFrame:
    """Articles, distinct titles and text volume per source and month."""
    return articles.groupBy(
        "source", F.date_format("date", "yyyy-MM").alias("month")
    ).agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.countDistinct("title").alias("n_titles"),
        F.sum(F.length("body")).alias("n_chars"),
        F.sum(F.when(F.col("summary").isNull(), 1).otherwise(0)).alias("n_no_summary"),
        F.sum(F.coalesce(F.size("kws"), F.lit(0))).alias("n_kws"),
    )
