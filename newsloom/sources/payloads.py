"""API answers landed as JSON text, one row per answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import markup as M
from newsloom.functions.text import join_text

# Fixed value: site address in front of a post's slug.
POST_BASE = "https://www.mercomindia.com/"

POSTS_SCHEMA = (
    "data struct<posts: struct<nodes: array<struct<"
    "id: string, slug: string, date: string, content: string, title: string,"
    "categories: struct<nodes: array<struct<name: string>>>,"
    "author: struct<node: struct<name: string>>>>>>"
)
LISTING_SCHEMA = "data struct<has_reached_end: boolean>, html string"


def explode_posts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per post of an answer, in order; an answer without posts gives none."""
    keep = [c for c in payloads.columns if c != payload]
    parsed = F.from_json(payload, POSTS_SCHEMA)
    rows = payloads.select(
        *keep, F.posexplode(parsed["data"]["posts"]["nodes"]).alias("pos", "_n")
    )
    n = F.col("_n")
    return rows.select(
        *keep,
        "pos",
        n["id"].alias("article_id"),
        n["title"].alias("title"),
        F.concat(F.lit(POST_BASE), n["slug"]).alias("url"),
        n["date"].alias("date"),
        F.transform(n["categories"]["nodes"], lambda c: c["name"]).alias("categories"),
        n["content"].alias("content"),
        n["author"]["node"]["name"].alias("author"),
    )


def post_articles(posts: DataFrame) -> DataFrame:
    """Posts with their text as ``body``; posts without content are skipped."""
    content = M.strip_noise("content")
    texts = F.transform(M.paragraphs(content), lambda p: M.text_of(p, True))
    rows = posts.filter(F.col("content").isNotNull())
    return rows.withColumn("body", join_text(texts, " ", True)).drop("content")


def listing_pages(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Markup of each listing answer as ``html``, without the one past the end."""
    keep = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*keep, F.from_json(payload, LISTING_SCHEMA).alias("_p"))
    at_end = F.coalesce(F.col("_p.data.has_reached_end"), F.lit(False))
    return rows.filter(~at_end).select(*keep, F.col("_p.html").alias("html"))
