"""Scoring the titles of the article table, model by model, with resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scores as S
from newsloom.operators import scoring as R
from newsloom.session import fresh_path


def with_key(articles: DataFrame) -> DataFrame:
    """Articles under a key made of their address, source and title; copies share it."""
    return articles.withColumn("article_id", R.article_key())


def distinct_titles(keyed: DataFrame) -> DataFrame:
    """What a model is asked about: each key once."""
    return keyed.dropDuplicates(["article_id"])


def score_articles(
    spark: SparkSession,
    articles: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = S.SOLAR_KEYS,
    store: str | None = None,
    **tests,
) -> str:
    """Score what ``store`` has no good scores for, and give the store's path.

    The store only grows: the new scores are a folder of their own, so the model is
    asked once for each pending title and no old score is written again. Failed
    answers are kept with ``valid`` false and asked for again the next time;
    ``saved_scores`` reads one row per article.
    """
    run = fresh_path(spark, "scores") if store is None else store
    done = None if store is None else spark.read.parquet(store)
    known = 0 if done is None else done.agg(F.max("run")).first()[0] or 0
    scored = R.score_titles(distinct_titles(articles), keys, answer, done=done, **tests)
    scored.write.mode("append").parquet(f"{run}/run={known + 1}")
    return run


def saved_scores(spark: SparkSession, store: str) -> DataFrame:
    """The score of each article: a good one if there is any, the last of those."""
    return R.latest_scores(spark.read.parquet(store), order=["run"]).drop("run")


def solar_then_themes(
    spark: SparkSession,
    articles: DataFrame,
    solar_models: dict[str, Callable[[DataFrame], DataFrame]],
    theme_answer: Callable[[DataFrame], DataFrame],
    threshold: float = S.SOLAR_THRESHOLD,
) -> DataFrame:
    """Pool the solar models, then score the themes of titles past the gate.

    Copies of an article are scored once and all get the score. The pooled score is written down first, as both the gate and the result need
    it and a model must not be asked twice.
    """
    rows = with_key(articles)
    pooled = fresh_path(spark, "pooled")
    wide = R.score_wide(distinct_titles(rows), S.SOLAR_KEYS, solar_models)
    R.pool_wide(wide, list(solar_models)).write.parquet(pooled)
    solar = spark.read.parquet(pooled)
    scored = R.attach_scores(rows, solar, ["article_id"])
    themes = R.score_titles(
        distinct_titles(scored), S.THEME_KEYS, theme_answer, gate_on="solar_p", threshold=threshold
    )
    return R.attach_scores(scored, themes, ["article_id"]).select(
        "article_id", "url", "title", "solar_p", *[F.col(k) for k in S.THEME_KEYS]
    )
