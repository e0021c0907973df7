"""Helpers that several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import fresh_path

#: White space of every contract here: blank and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Functions that run there name others of the package. Where the package is installed
    or on the path of the executors already, this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared working folder and read back.

    Cuts the lineage: a lost executor costs only the tasks that ran on it, and a
    frame that is used twice is computed once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` of documents, under their own types."""
    importable(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` beside the whole input row as ``row``.

    A name of an input column then never clashes with a working column;
    ``select("row.*")`` gives the input back.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *[c.alias(n) for n, c in columns.items()],
    )


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as text and ``text``, for Python functions.

    A null among numbers would make them floats on the way to pandas.
    """
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))


def ids_back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))
