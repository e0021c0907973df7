"""From landed pages to a source's store: new listing rows, then their bodies.

A store holds one folder per run of ``take_new`` and only grows. A backfill gives the
path of a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import extract as E
from newsloom.operators import incremental as I
from newsloom.session import fresh_path
from newsloom.sources.payloads import explode_posts, post_articles
from newsloom.sources.versioned import VersionedStore

# How each site's listing is read to its end: "strict" sites stop at any known row,
# the others not before their store exists.
MODES = {
    "ec": "strict",
    "mercom": "strict",
    "saur": "strict",
    "eec": "first-load",
    "pvmag": "first-load",
    "pvmag_us": "first-load",
    "pvmag_global": "first-load",
}
_PLACE = ["page", "pos"]


def listing_rows(
    landed: DataFrame, source: str, details: DataFrame | None = None
) -> DataFrame:
    """Rows of landed listing pages ``(source, page, html)``, or API answers
    ``(source, page, payload)``, with the flag ``registered``.

    An API row without content, and a row whose details are asked for and missing
    from ``details (article_id, ...)``, is listed but does not become known.
    """
    if source == "mercom":
        posts = explode_posts(landed)
        return posts.withColumn("registered", F.col("content").isNotNull())
    rows = E.extract_listing(landed, source)
    if details is None:
        return rows.withColumn("registered", F.lit(True))
    found = details.withColumn("registered", F.lit(True))
    return rows.join(found, "article_id", "left").withColumn(
        "registered", F.coalesce("registered", F.lit(False))
    )


def cursor_of(landed: DataFrame) -> list[str]:
    """The columns that name a cursor: each topic of a source has a listing of its own."""
    return ["source", "topic"] if "topic" in landed.columns else ["source"]


def take_new(
    spark: SparkSession,
    landed: DataFrame,
    source: str,
    store: str | None,
    details: DataFrame | None = None,
) -> str:
    """Add the new rows of landed listing pages to the store and give its path.

    Pages with a ``topic`` are read topic by topic, and an article may be stored under
    several. The listing is read several times to find where it stops, so it is written
    down first and pages are parsed once. Only the new rows are written.
    """
    cursor = cursor_of(landed)
    listing = fresh_path(spark, f"{source}-listing")
    listing_rows(landed, source, details).write.parquet(listing)
    rows = spark.read.parquet(listing)
    old = None if store is None else spark.read.parquet(store)
    fresh = I.take_until_known(
        rows, old, "article_id", _PLACE, cursor, MODES[source], "registered"
    ).filter("registered")
    if source == "mercom":
        fresh = post_articles(fresh)
    fresh = I.last_per_key(fresh.drop("registered"), [*cursor, "article_id"], _PLACE)
    out = fresh_path(spark, f"{source}-store") if store is None else store
    known = 0 if old is None or "run" not in old.columns else old.agg(F.max("run")).first()[0] or 0
    fresh.write.mode("append").parquet(f"{out}/run={known + 1}")
    return out


def add_listing(
    landed: DataFrame, source: str, store: VersionedStore, details: DataFrame | None = None
) -> int | None:
    """As ``take_new``, into a versioned store; two runs at once add an article once.

    The store's keys are the cursor and ``article_id``. Gives the version, or None if
    nothing was new.
    """
    cursor = cursor_of(landed)
    listing = fresh_path(store.spark, f"{source}-listing")
    listing_rows(landed, source, details).write.parquet(listing)
    fresh = I.take_until_known(
        store.spark.read.parquet(listing), store.read(), "article_id", _PLACE, cursor, MODES[source], "registered"
    ).filter("registered")
    if source == "mercom":
        fresh = post_articles(fresh)
    return store.add(fresh.drop("registered"), _PLACE)


def fill_store(store: VersionedStore, pages: DataFrame, source: str) -> int | None:
    """Bodies of fetched pages ``(url, html)`` for the rows without one, as a change.

    Only the rows that were asked for are named by it, so nothing else is written.
    """
    order = ["fetched"] if "fetched" in pages.columns else ["html"]
    once = I.last_per_key(pages, ["url"], order)
    asked = I.needs_body(store.read()).select(*store.keys, "url")
    bodies = E.article_bodies(once.join(asked.select("url").distinct(), "url"), source)
    fields = ["body", "key_words"]
    return store.change(asked.join(bodies.select("url", *fields), "url"), fields, ["url"])


def urls_to_fetch(spark: SparkSession, store: str) -> DataFrame:
    """Addresses of rows that have no body yet."""
    return I.needs_body(spark.read.parquet(store)).select("article_id", "url")


def fill_bodies(
    spark: SparkSession, store: str, pages: DataFrame, source: str
) -> str:
    """Write the bodies of fetched pages ``(url, html)`` into a new store version.

    Only rows without a body are filled; a page that was not found has null html. A
    page that landed several times counts once: by ``fetched`` the last, if there is
    such a column.
    """
    old = spark.read.parquet(store)
    order = ["fetched"] if "fetched" in pages.columns else ["html"]
    once = I.last_per_key(pages, ["url"], order)
    asked = I.needs_body(old).select("article_id", "url").distinct()
    bodies = E.article_bodies(once.join(asked, "url"), source)
    out = fresh_path(spark, f"{source}-store")
    fields = ("body", "key_words")
    empty = F.col("body").isNull() if "body" in old.columns else F.lit(True)
    whole = I.backfill(old, bodies.select("article_id", *fields), "article_id", fields, asked=empty)
    if "run" in old.columns:
        whole.write.partitionBy("run").parquet(out)
    else:
        whole.write.parquet(out)
    return out
