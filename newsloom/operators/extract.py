"""Pages to anchors, blocks, bodies, tags, listings and JSON-LD records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import markup as M
from newsloom.functions.text import absolutize, article_id, squeeze_ws, uuid5_dns

ARTICLE_FIELDS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "url",
            "headline",
            "description",
            "articleBody",
            "datePublished",
            "keywords",
        )
    ]
)


def extract_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link, in page order: ``pos, href, title, text``."""
    found = M.flat_blocks(M.strip_noise(html), "a")
    rows = pages.select(
        *[c for c in pages.columns if c != html],
        F.posexplode(found).alias("pos", "block"),
    )
    return rows.select(
        *[c for c in rows.columns if c != "block"],
        M.attribute(F.col("block"), "href").alias("href"),
        M.attribute(F.col("block"), "title").alias("title"),
        squeeze_ws(M.text_of(F.col("block"))).alias("text"),
    ).filter(F.col("href").isNotNull())


def extract_blocks(
    pages: DataFrame,
    tag: str,
    cls: str | None = None,
    nested: bool = False,
    html: str = "html",
) -> DataFrame:
    """Cut a listing page into its item blocks, in page order."""
    cut = M.nested_blocks if nested else M.whole_blocks
    return pages.select(
        *[c for c in pages.columns if c != html],
        F.posexplode(cut(M.strip_noise(html), tag, cls)).alias("pos", "block"),
    )


def extract_body(
    pages: DataFrame,
    container: tuple[str, str | None] | None = None,
    sep: str = "\n",
    strip_each: bool = False,
    squeeze: bool = True,
    drop_last: int = 0,
    on_missing: str = "null",
    html: str = "html",
) -> DataFrame:
    """Add ``body``, the paragraph text of the container.

    A page without the container gives null, or stops the job with
    ``on_missing="raise"``. No page (null html) always gives null.
    """
    part = F.col("_page")
    if container is not None:
        part = M.first_block(part, container[0], container[1], nested=True)
    rows = pages.withColumn("_page", M.strip_noise(html)).withColumn("_part", part)
    if container is not None and on_missing == "raise":
        missing = F.raise_error(F.lit(f"no {container[0]}.{container[1]} on page"))
        rows = rows.withColumn(
            "_part",
            F.when(
                F.col(html).isNotNull() & F.col("_part").isNull(),
                missing.cast("string"),
            ).otherwise(F.col("_part")),
        )
    body = M.paragraph_text(F.col("_part"), sep, strip_each, squeeze, drop_last)
    return rows.select(*pages.columns, body.alias("body"))


def extract_tags(
    pages: DataFrame,
    container: tuple[str, str | None],
    body: str | None = "body",
    html: str = "html",
) -> DataFrame:
    """Add ``key_words``, the link texts in the tag container.

    No container gives an empty list; no page, or no body on it, gives null.
    """
    rows = pages.withColumn("_page", M.strip_noise(html)).withColumn(
        "_part", M.first_block(F.col("_page"), container[0], container[1], nested=True)
    )
    links = F.transform(M.flat_blocks(F.col("_part"), "a"), lambda a: M.text_of(a))
    tags = F.coalesce(links, F.array().cast("array<string>"))
    there = F.col(html).isNotNull()
    if body is not None:
        there = there & F.col(body).isNotNull()
    return rows.select(*pages.columns, F.when(there, tags).alias("key_words"))


@dataclass(frozen=True)
class BodyProfile:
    """Where a site's article pages hold the text and the tags."""

    container: tuple[str, str]
    tags: tuple[str, str] | None = None
    drop_last: int = 0
    on_missing: str = "null"


# Containers of text and tags; some sites end with a paragraph that is
# no part of the article.
_MAGAZINE = BodyProfile(("div", "entry-content"), drop_last=1, on_missing="raise")
BODY_PROFILES: dict[str, BodyProfile] = {
    "saur": BodyProfile(("div", "entry-content clearfix"), ("div", "entry-tags")),
    "pvmag": _MAGAZINE,
    "pvmag_us": _MAGAZINE,
    "pvmag_global": _MAGAZINE,
}


def article_bodies(pages: DataFrame, source: str, html: str = "html") -> DataFrame:
    """Add ``body`` and ``key_words`` of a site's article pages; both null for no page."""
    profile = BODY_PROFILES[source]
    rows = extract_body(
        pages,
        profile.container,
        drop_last=profile.drop_last,
        on_missing=profile.on_missing,
        html=html,
    )
    if profile.tags is None:
        return rows.withColumn("key_words", F.lit(None).cast("array<string>"))
    return extract_tags(rows, profile.tags, html=html)


@dataclass(frozen=True)
class Pick:
    """Where one field sits inside an item block.

    ``inside`` names the elements to step into first; without ``attr`` the value
    is the element's text.
    """

    tag: str
    cls: str | tuple[str, ...] | None = None
    attr: str | None = None
    inside: tuple[tuple[str, str | None], ...] = ()
    where: dict[str, str] = field(default_factory=dict)
    strip_each: bool = True
    squeeze: bool = True

    def read(self, block: Column) -> Column:
        part = block
        for tag, cls in self.inside:
            part = M.first_block(part, tag, cls, nested=tag == "div")
        element = M.first_block(part, self.tag, self.cls, **self.where)
        if self.attr:
            value = M.attribute(element, self.attr)
        else:
            value = M.text_of(element, self.strip_each)
        return squeeze_ws(value) if self.squeeze else value


@dataclass(frozen=True)
class ListingProfile:
    """How one site lays out its listing pages."""

    block: tuple[str, str | None]
    picks: dict[str, Pick]
    key: str  # "segment", "segment:<cut>", "uuid5:title" or "attr:<name>"
    skip_without: tuple[str, ...] = ()
    raise_without: tuple[str, ...] = ()
    nested: bool = False
    base: str | None = None


_PREVIEW = {
    "title": Pick("h2", "entry-title"),
    "url": Pick("a", attr="href", inside=(("h2", "entry-title"),), squeeze=False),
    "date_published": Pick("time", "entry-published updated", attr="datetime"),
    "author": Pick("span", "entry-author"),
    "summary": Pick("p", inside=(("div", "article-lead-text"),)),
}

# The selectors of each site and the rule for its article id.
PROFILES: dict[str, ListingProfile] = {
    "ec": ListingProfile(
        block=("li", None),
        picks={
            "title": Pick("a", ("anc", "ancs"), attr="title", squeeze=False),
            "url": Pick("a", ("anc", "ancs"), attr="href", squeeze=False),
        },
        key="segment:.",
        skip_without=("url",),
        raise_without=("title",),
    ),
    "eec": ListingProfile(
        block=("li", None),
        picks={
            "title": Pick("a", strip_each=False),
            "url": Pick("a", attr="href", squeeze=False),
            "summary": Pick("p", strip_each=False),
        },
        key="segment:?",
        raise_without=("url", "summary"),
        base="https://energy.economictimes.indiatimes.com",
    ),
    "saur": ListingProfile(
        block=("article", None),
        picks={
            "title": Pick("a", "content-title-link"),
            "url": Pick("a", "content-title-link", attr="href", squeeze=False),
            "date_published": Pick(
                "span", where={"itemprop": "datePublished"}, strip_each=False
            ),
            "author": Pick("span", "vcard author"),
            "summary": Pick(
                "p", inside=(("div", "entry-summary content-list-summary"),)
            ),
        },
        key="attr:id",
        raise_without=("article_id", "url", "date_published", "author", "summary"),
    ),
    "pvmag": ListingProfile(
        block=("div", "article-preview"),
        picks=_PREVIEW,
        key="uuid5:title",
        raise_without=("title", "url", "date_published", "author", "summary"),
        nested=True,
    ),
    "pvmag_us": ListingProfile(
        block=("div", "article-preview"),
        picks=_PREVIEW,
        key="uuid5:title",
        skip_without=("title",),
        raise_without=("url", "date_published", "author"),
        nested=True,
    ),
    "pvmag_global": ListingProfile(
        block=("div", "article-preview"),
        picks=_PREVIEW,
        key="uuid5:title",
        skip_without=("title",),
        raise_without=("url", "date_published", "author"),
        nested=True,
    ),
}

LISTING_COLUMNS = ("url", "title", "date_published", "author", "summary")


def _listing_key(rule: str, block: Column) -> Column:
    kind, _, rest = rule.partition(":")
    if kind == "segment":
        return article_id("url", rest or None)
    if kind == "uuid5":
        return uuid5_dns(rest)
    return M.attribute(block, rest)


def require(df: DataFrame, columns: tuple[str, ...], policy: str) -> DataFrame:
    """Rows that lack a required field are skipped, or stop the job."""
    for name in columns:
        value = F.col(name)
        if policy == "skip":
            df = df.filter(value.isNotNull())
        else:
            missing = F.raise_error(F.lit(f"item without {name}"))
            typed = missing.cast(df.schema[name].dataType)
            df = df.withColumn(name, F.coalesce(value, typed))
    return df


def extract_listing(
    pages: DataFrame, profile: ListingProfile | str, html: str = "html"
) -> DataFrame:
    """Item metadata of listing pages, in page order.

    Adds ``pos, article_id, url, title, date_published, author, summary``; a field
    the site does not show is null.
    """
    if isinstance(profile, str):
        profile = PROFILES[profile]
    tag, cls = profile.block
    blocks = extract_blocks(pages, tag, cls, profile.nested, html)
    keep = [c for c in blocks.columns if c != "block" and c not in LISTING_COLUMNS]
    fields = []
    for name in LISTING_COLUMNS:
        pick = profile.picks.get(name)
        value = pick.read(F.col("block")) if pick else F.lit(None).cast("string")
        if name == "url" and profile.base:
            value = absolutize(value, profile.base)
        fields.append(value.alias(name))
    # Laid out through a one-row list: a filter on a field is then not pushed below
    # it, where Spark would read the field a second time.
    rows = blocks.select(*keep, "block", F.inline(F.array(F.struct(*fields))))
    rows = require(rows, profile.skip_without, "skip")
    key = _listing_key(profile.key, F.col("block"))
    rows = rows.select(*keep, key.alias("article_id"), *LISTING_COLUMNS)
    return require(rows, profile.raise_without, "raise")


def extract_jsonld(
    pages: DataFrame,
    schema: T.StructType | str = ARTICLE_FIELDS,
    n: int = 1,
    drop_breaks: bool = False,
    html: str = "html",
) -> DataFrame:
    """Add ``data`` (the record), ``data_json`` (its text) and ``problem``.

    ``problem`` is null, ``no block`` or ``bad json``.
    """
    block = M.jsonld_block(html, n, drop_breaks)
    rows = pages.withColumn("_block", block).withColumn(
        "_variant", F.try_parse_json("_block")
    )
    good = F.col("_variant").isNotNull()
    return rows.select(
        *pages.columns,
        F.when(good, F.from_json("_block", schema)).alias("data"),
        F.when(good, F.col("_block")).alias("data_json"),
        F.when(F.col("_block").isNull(), "no block")
        .when(~good, "bad json")
        .alias("problem"),
    )


# What each site does with a page lacking the block, and with broken JSON.
JSONLD_POLICIES = {
    "ec": {"no block": "raise", "bad json": "raise"},
    "eec": {"no block": "raise", "bad json": "skip"},
    "nleec": {"no block": "quarantine", "bad json": "skip"},
}


def apply_jsonld_policy(
    rows: DataFrame, source: str, key: str = "url"
) -> tuple[DataFrame, DataFrame]:
    """Split ``extract_jsonld`` output into good rows and dead letters."""
    policy = JSONLD_POLICIES[source]
    fatal = [p for p, action in policy.items() if action == "raise"]
    if fatal:
        failed = F.raise_error(F.concat(F.lit(f"{source}: "), F.col("problem")))
        rows = rows.withColumn(
            "problem",
            F.when(F.col("problem").isin(fatal), failed.cast("string")).otherwise(
                F.col("problem")
            ),
        )
    dead = [p for p, action in policy.items() if action == "quarantine"]
    good = rows.filter(F.col("problem").isNull()).drop("problem")
    letters = rows.filter(F.col("problem").isin(dead) if dead else F.lit(False))
    return good, letters.select(
        F.col(key).alias("entry"), F.col("problem").alias("reason")
    )


def article_records(
    pages: DataFrame, source: str, key: str = "url", html: str = "html"
) -> tuple[DataFrame, DataFrame]:
    """JSON-LD records of a site's article pages, and its dead letters."""
    rows = extract_jsonld(pages, drop_breaks=source == "ec", html=html)
    return apply_jsonld_policy(rows, source, key)
