"""Differently shaped sources into one typed article table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import dates as D
from newsloom.functions.text import ensure_list

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("kws", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
    ]
)

_CORE = {
    "url": "url",
    "headline": "title",
    "description": "summary",
    "articleBody": "body",
    "datePublished": "date",
    "keywords": "kws",
}
_LISTED = {
    "url": "url",
    "title": "title",
    "summary": "summary",
    "body": "body",
    "date_published": "date",
    "key_words": "kws",
}
_API = {
    "url": "url",
    "title": "title",
    "body": "body",
    "date": "date",
    "categories": "kws",
}

# Source tags, the fields each source has, and its date rule.
MAPPINGS: dict[str, dict[str, str]] = {
    "ec": _CORE,
    "eec": _CORE,
    "nleec": _CORE,
    "mercom": _API,
    "saur": _LISTED,
    "pvmag": _LISTED,
    "pvmag_global": _LISTED,
    "pvmag_us": _LISTED,
}
DATE_RULES = {
    "ec": D.lenient_date,
    "eec": D.lenient_date,
    "nleec": D.lenient_date,
    "mercom": D.strict_date,
    "saur": D.ordinal_date,
    "pvmag": D.strict_date,
    "pvmag_global": D.utc_date,
    "pvmag_us": D.utc_date,
}
NESTED_SOURCES = ("eec", "nleec")


def unwrap_data(
    store: DataFrame, source: str, schema: T.StructType, data: str = "data"
) -> DataFrame:
    """Take the article record out of the raw JSON text in column ``data``.

    Rows without a record, or with an empty one, are dropped. The newsletter
    source also drops records without the key ``articleBody``; a key with a null
    value is there.
    """
    if source not in NESTED_SOURCES:
        return store
    fields = F.json_object_keys(data)
    rows = store.filter(F.size(fields) > 0)
    if source == "nleec":
        rows = rows.filter(F.array_contains(fields, "articleBody"))
    keep = [c for c in store.columns if c != data and c not in schema.names]
    return rows.select(*keep, F.from_json(data, schema).alias("_data")).select(
        *keep, "_data.*"
    )


def conform(df: DataFrame, source: str) -> DataFrame:
    """The columns of one source under their common names, dates and tag applied.

    Keywords of the core sources are raw JSON text and become a list; the other
    sources hold a list, or null, and keep it.
    """
    mapping = MAPPINGS[source]
    rule = DATE_RULES[source]
    out = []
    for field, name in mapping.items():
        value = F.col(field)
        if name == "date":
            value = rule(value)
        elif name == "kws" and mapping is _CORE:
            value = ensure_list(value)
        out.append(value.alias(name))
    return df.select(*out, F.lit(source).alias("source"))


def conform_all(store: DataFrame, tag: str = "source") -> DataFrame:
    """Conform a store that holds all sources, each row by the rule of its source.

    One read of the store, where a frame per source would read it once for each.
    A row fills the columns of its own shape; the columns of other shapes are null.
    Rows of a source without a mapping are an error.
    """
    have = set(store.columns)
    source = F.col(tag)
    groups: dict[tuple, list[str]] = {}
    for name, mapping in MAPPINGS.items():
        groups.setdefault((id(mapping), DATE_RULES[name]), []).append(name)

    def pick(column: str):
        value = None
        for (_, rule), names in groups.items():
            mapping = MAPPINGS[names[0]]
            fields = [f for f, n in mapping.items() if n == column and f in have]
            if not fields:
                continue
            found = F.col(fields[0])
            if column == "date":
                found = rule(found)
            elif column == "kws" and mapping is _CORE:
                found = ensure_list(found)
            here = source.isin(*names)
            value = F.when(here, found) if value is None else value.when(here, found)
        return F.lit(None) if value is None else value

    known = F.when(source.isin(*MAPPINGS), source).otherwise(
        F.raise_error(F.concat(F.lit("no mapping for source "), source)).cast("string")
    )
    return store.select(
        *[
            pick(f.name).cast(f.dataType).alias(f.name)
            for f in ARTICLE_SCHEMA
            if f.name != "source"
        ],
        known.alias("source"),
    )


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in one table; a column a source lacks is null, copies stay."""
    every = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
    )
    have = set(every.columns)
    return every.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in ARTICLE_SCHEMA
        ]
    )


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame without the named columns."""
    return df.drop(*names)


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """Add the constant source tag."""
    return df.withColumn("source", F.lit(source))


def counts(df: DataFrame, by: str = "source") -> DataFrame:
    """Articles per source."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_articles"))
