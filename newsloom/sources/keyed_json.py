"""Stores that hold one JSON object ``{article id: {field: value}}`` per file.

They are an import path. New data is kept as Parquet, by source and topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from newsloom.sources.structure import members

KEY = "article_id"

# Fixed value: what ends an entry in a store written with four blanks of indent.
_ENTRY_END = "\n    },\n"


def _entries(value, schema: str):
    """Key and fields out of the text of a JSON object."""
    return F.explode(F.from_json(value, f"map<string,{schema}>", {"mode": "FAILFAST"}))


def read_keyed_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    key: str = KEY,
    indented: bool | None = None,
    missing_ok: bool = True,
    wrap: bool = True,
) -> DataFrame:
    """One row per entry: the key, then the fields of ``schema``.

    With ``wrap=False`` an entry is not an object of fields but the one value the
    schema names.

    A field of type string holding a list or an object arrives as its JSON text. A
    missing or empty file is an empty store. A file of any layout is split by its
    structure and read by many tasks. Two ways are cheaper: ``indented=True`` splits files
    written with an indent of four blanks at the end of an entry, without a shuffle, and
    may stop the job on other ones; ``indented=False`` reads small files whole, each as one
    task.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    inner = schema.simpleString() if wrap else schema[0].dataType.simpleString()
    try:
        if indented is None:
            text, value = members(spark, path), F.col("value")
        elif indented:
            text = spark.read.option("lineSep", _ENTRY_END).text(path)
            value = _whole_entry("value")
        else:
            text = spark.read.text(path, wholetext=True)
            value = F.col("value")
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            out = T.StructType([T.StructField(key, T.StringType()), *schema.fields])
            return spark.createDataFrame([], out)
        raise
    filled = text.filter(F.trim("value") != "")
    if not wrap:
        return filled.select(_entries(value, inner).alias(key, schema[0].name))
    rows = filled.select(_entries(value, inner).alias(key, "_v"))
    return rows.select(key, "_v.*")


def _whole_entry(name: str):
    """A piece of an indented file as a JSON object of its own.

    A piece has lost the brace that ends it, unless it is the last of its file; the
    first piece still has the brace that opens the file, the last the one that
    closes it.
    """
    piece = F.rtrim(F.col(name), F.lit(" \n\r\t"))
    # An object that doesn't begin as an indented store does is whole.
    compact = piece.startswith("{") & ~piece.rlike(r'^\{\r?\n    "')
    is_last = piece.endswith("\n}") | compact
    opened = F.when(piece.startswith("{"), piece).otherwise(
        F.concat(F.lit("{"), piece)
    )
    return F.when(is_last, opened).otherwise(F.concat(opened, F.lit("\n    }\n}")))


def read_keyed_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options
) -> DataFrame:
    """The entries of a store without their keys."""
    return read_keyed_json(spark, path, schema, **options).drop(KEY)


def read_link_index(
    spark: SparkSession, path: str | list[str], indented: bool | None = None
) -> DataFrame:
    """A newsletter index ``{day: {category: [link]}}`` as one row per link.

    An empty category gives one row without a link, so its day is not lost.
    """
    days = read_keyed_json(
        spark,
        path,
        "links map<string,array<string>>",
        "nl_date",
        indented,
        wrap=False,
    )
    cells = days.select(
        F.to_date("nl_date").alias("nl_date"), F.explode("links").alias("category", "urls")
    )
    return cells.select("nl_date", "category", F.explode_outer("urls").alias("url"))


def read_dead_letters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A JSON array of ids and URLs as rows ``(entry)``."""
    text = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    entries = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    return text.select(F.explode(entries).alias("entry"))


def write_store(
    df: DataFrame, path: str, by: tuple[str, ...] = ("source", "topic")
) -> None:
    """Replace the partitions of the store that ``df`` has rows for.

    Never write to the path ``df`` is read from.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def read_store(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Rows of a store written by ``write_store``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
