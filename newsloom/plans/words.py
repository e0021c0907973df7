"""From a line corpus to the words nearest to a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import corpus as K
from newsloom.session import fresh_path
from newsloom.sources import files as I


def build_corpus(
    spark: SparkSession,
    lines: str,
    out: str,
    stopwords: list[str] | None = None,
    lemmas: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """Preprocess and shuffle a line corpus and write its tokens.

    A line's hash stands for its place, as lines of a split file have none. Equal
    lines share it and are all kept.
    """
    docs = I.read_lines(spark, lines).select(F.md5("text").alias("doc_id"), "text")
    tokens = K.preprocess(docs, "text", stopwords, lemmas)
    I.write_tokens(K.shuffled(tokens, seed), out)
    return I.read_tokens(spark, out)


def nearest_words(
    spark: SparkSession, tokens: DataFrame, word: str, k: int = K.NEAREST, **settings
) -> DataFrame:
    """Train vectors, keep them, and list the words nearest to ``word``."""
    path = fresh_path(spark, "vectors")
    I.save_vectors(K.train_vectors(tokens, **settings), path)
    return K.most_similar(I.load_vectors(spark, path), word, k)
