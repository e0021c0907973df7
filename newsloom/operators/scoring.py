"""Scoring titles in batches: what is pending, what may be scored, what came back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import scores as S
from newsloom.operators.incremental import last_per_key, pending, upsert

# A factory takes the configuration and gives the function that answers a batch of
# prompts. It runs on the executors, once per task, so it may open a client there.
Scorer = Callable[[list[str]], list[str]]
_SCORERS: dict[str, Callable[[dict], Scorer]] = {}


def register_scorer(name: str, factory: Callable[[dict], Scorer]) -> None:
    """Make a scorer known under a name."""
    _SCORERS[name] = factory


def scorer(name: str) -> Callable[[dict], Scorer]:
    """The factory registered under a name."""
    return _SCORERS[name]


def map_answers(
    df: DataFrame,
    factory: Callable[[dict], Scorer] | str,
    config: dict | None = None,
    prompt: str = "prompt",
    answer: str = "answer",
    partitions: int | None = None,
) -> DataFrame:
    """Add the scorer's answer to each row, in Arrow batches.

    Select key and prompt before the call: all columns of ``df`` go to Python.
    ``partitions`` spreads the rows first, for a scorer that is slow.
    """
    make = scorer(factory) if isinstance(factory, str) else factory
    settings = dict(config or {})
    schema = T.StructType([*df.schema.fields, T.StructField(answer, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make(settings)
        for batch in batches:
            yield batch.assign(**{answer: list(score(batch[prompt].tolist()))})

    rows = df if partitions is None else df.repartition(partitions)
    return rows.mapInPandas(run, schema)


def map_nested_answers(
    df: DataFrame,
    factory: Callable[[dict], Scorer] | str,
    config: dict | None = None,
    prompts: str = "prompts",
    answers: str = "answers",
) -> DataFrame:
    """Answer several prompts per row; the answers keep the nesting.

    The lists of an Arrow batch are laid end to end for one scorer call and cut
    back afterwards, so no row is torn apart and nothing is shuffled.
    """
    make = scorer(factory) if isinstance(factory, str) else factory
    settings = dict(config or {})
    schema = T.StructType(
        [*df.schema.fields, T.StructField(answers, T.ArrayType(T.StringType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make(settings)
        for batch in batches:
            flat = [p for row in batch[prompts] if row is not None for p in row]
            replies = iter(score(flat))
            nested = [
                None if row is None else [next(replies) for _ in row]
                for row in batch[prompts]
            ]
            yield batch.assign(**{answers: nested})

    return df.mapInPandas(run, schema)


def gate(
    df: DataFrame, score: str = "solar_p", threshold: float = S.SOLAR_THRESHOLD
) -> DataFrame:
    """Rows whose score reaches the threshold."""
    return df.filter(F.col(score) >= F.lit(threshold))


def budget(eligible: DataFrame, index: str, max_index: int) -> DataFrame:
    """Eligible rows up to an index, and the first one above it.

    The limit is tested after a row is scored, so one row above it is scored too.
    """
    above = eligible.filter(F.col(index) > max_index)
    # Over no rows the minimum is null, and no row above the limit is kept.
    extra = above.agg(F.min(index)).scalar()
    return eligible.filter((F.col(index) <= max_index) | (F.col(index) == extra))


def attach_scores(
    articles: DataFrame, scores: DataFrame, keys: list[str]
) -> DataFrame:
    """Articles with their scores; null where there is none yet."""
    return articles.join(scores, keys, "left")


def resume(
    articles: DataFrame,
    saved: DataFrame | None,
    keys: list[str],
    columns: tuple[str, ...],
) -> DataFrame:
    """Articles with the scores saved so far; all null for a fresh start."""
    if saved is None:
        return articles.select(
            "*", *[F.lit(None).cast("double").alias(c) for c in columns]
        )
    return attach_scores(articles, saved.select(*keys, *columns), keys)


def article_key(url: str = "url", source: str = "source", title: str = "title") -> Column:
    """Key of an article that does not depend on row order.

    128 bits, as a hash of 64 would give different articles the same key once there
    are some billions of them.
    """
    parts = [F.coalesce(F.col(c), F.lit("\x00")) for c in (source, url, title)]
    return F.md5(F.concat_ws("\x1f", *parts))


def to_score(
    articles: DataFrame,
    key: str = "article_id",
    done: DataFrame | None = None,
    gate_on: str | None = None,
    threshold: float = S.SOLAR_THRESHOLD,
    index: str | None = None,
    max_index: int | None = None,
) -> DataFrame:
    """``(key, title)`` of the titles still to be scored.

    All tests come before the scorer, so it sees only rows it has to. What ``done`` holds
    counts as scored where its ``valid`` is true, or all of it without that column.
    ``index`` is a column of running numbers and needs ``max_index``.
    """
    rows = articles
    if done is not None:
        valid = "valid" if "valid" in done.columns else None
        rows = pending(articles, done, [key], valid)
    if gate_on:
        rows = gate(rows, gate_on, threshold)
    if index:
        if max_index is None:
            raise ValueError("a budget needs its greatest index")
        rows = budget(rows, index, max_index)
    return rows.select(key, "title")


def score_titles(
    articles: DataFrame,
    keys: tuple[str, ...],
    answer: Callable[[DataFrame], DataFrame],
    key: str = "article_id",
    done: DataFrame | None = None,
    on_error: str = "null",
    **tests,
) -> DataFrame:
    """``(key, <scores>, valid)`` for the titles ``to_score`` picks.

    ``answer`` takes ``(key, title)`` and adds ``answer``.
    """
    answered = answer(to_score(articles, key, done, **tests))
    scored = answered.withColumn("_s", S.parse_scores("answer", keys, on_error))
    return scored.select(
        key,
        *[F.col("_s")[k].alias(k) for k in keys],
        S.valid_scores("answer", keys).alias("valid"),
    )


def lexicon_scorer(lexicons: dict[str, list[str]]) -> Callable[[DataFrame], DataFrame]:
    """The built-in scorer, in native expressions.

    It leaves the words of the title behind for the next one, so that several such
    scorers split a title only once.
    """

    def answer(rows: DataFrame) -> DataFrame:
        if "_words" not in rows.columns:
            rows = rows.withColumn("_words", S.title_words("title"))
        return rows.withColumn("answer", S.lexicon_answer("_words", lexicons))

    return answer


def prompt_scorer(
    factory: Callable[[dict], Scorer] | str,
    template: str,
    keys: tuple[str, ...],
    wrapper: str = "mistral",
    config: dict | None = None,
    partitions: int | None = None,
    **prompt_parts,
) -> Callable[[DataFrame], DataFrame]:
    """A scorer that renders the prompt and hands it to a registered function."""

    def answer(rows: DataFrame) -> DataFrame:
        # Nothing goes to Python that need not.
        prompts = rows.drop("_words").withColumn(
            "prompt", S.render_prompt("title", template, keys, wrapper, **prompt_parts)
        )
        return map_answers(
            prompts, factory, config, "prompt", "answer", partitions
        ).drop("prompt")

    return answer


def save_scores(saved: DataFrame, batch: DataFrame, key: str = "article_id") -> DataFrame:
    """Saved scores with a new batch, one row per article, written over them."""
    return upsert(saved, batch, [key], [key])


def latest_scores(
    saved: DataFrame, keys: list[str] | str = "article_id", order: list[str] | None = None
) -> DataFrame:
    """One row per key of an append-only score table: a valid one before a failed one.

    ``order`` tells later rows from earlier ones among those.
    """
    keys = [keys] if isinstance(keys, str) else keys
    return last_per_key(saved, keys, ["valid", *(order or [])])


def score_many(
    articles: DataFrame,
    keys: tuple[str, ...],
    models: dict[str, Callable[[DataFrame], DataFrame]],
    key: str = "article_id",
    done: DataFrame | None = None,
    on_error: str = "null",
    **tests,
) -> DataFrame:
    """The same titles scored by several models: ``(key, model, label, p)``.

    The models answer one after the other over one read of the titles.
    """
    rows = to_score(articles, key, done, **tests)
    for i, answer in enumerate(models.values()):
        rows = answer(rows).withColumnRenamed("answer", f"_answer_{i}")
    scored = rows.select(
        key,
        *[S.parse_scores(f"_answer_{i}", keys, on_error).alias(f"_s_{i}")
          for i in range(len(models))],
    )
    values = [
        F.struct(
            F.lit(model).alias("model"),
            F.lit(k).alias("label"),
            F.col(f"_s_{i}")[k].alias("p"),
        )
        for i, model in enumerate(models)
        for k in keys
    ]
    return scored.select(key, F.inline(F.array(*values)))


def score_wide(
    articles: DataFrame,
    keys: tuple[str, ...],
    models: dict[str, Callable[[DataFrame], DataFrame]],
    key: str = "article_id",
    done: DataFrame | None = None,
    on_error: str = "null",
    **tests,
) -> DataFrame:
    """``(key, scores)``: one struct of the keys per model, all models in one row."""
    rows = to_score(articles, key, done, **tests)
    for i, answer in enumerate(models.values()):
        rows = answer(rows).withColumnRenamed("answer", f"_answer_{i}")
    found = [S.parse_scores(f"_answer_{i}", keys, on_error).alias(m) for i, m in enumerate(models)]
    return rows.select(key, F.struct(*found).alias("scores"))


def models_by_label(
    wide: DataFrame, models: list[str], keys: tuple[str, ...], key: str = "article_id"
) -> DataFrame:
    """One column per model for each article and label, out of ``score_wide``.

    All values of an article are in its row already, so nothing is shuffled.
    """
    rows = [
        F.struct(F.lit(k).alias("label"), *[F.col("scores")[m][k].alias(m) for m in models])
        for k in keys
    ]
    return wide.select(key, F.inline(F.array(*rows)))


def pool_wide(
    wide: DataFrame, models: list[str], label: str = "solar", key: str = "article_id"
) -> DataFrame:
    """``pool`` out of ``score_wide``: the mean log-odds within the row."""
    odds = [_log_odds(F.col("scores")[m][label]) for m in models]
    known = sum((o.isNotNull().cast("int") for o in odds), F.lit(0))
    total = sum((F.coalesce(o, F.lit(0.0)) for o in odds), F.lit(0.0))
    mean = total / F.nullif(known, F.lit(0))
    return wide.select(key, _probability(mean).alias("solar_p"))


def _log_odds(p: Column) -> Column:
    # Not before the test for null: the least of a null and a number is the number.
    near = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when(p.isNotNull(), F.ln(near / (F.lit(1.0) - near)))


def _probability(odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def wide_by_model(
    long: DataFrame, models: list[str], key: str = "article_id"
) -> DataFrame:
    """One column per model for each article and label."""
    return long.groupBy(key, "label").pivot("model", models).agg(F.first("p"))


def pool(
    long: DataFrame, label: str = "solar", key: str = "article_id"
) -> DataFrame:
    """One probability per article out of several models: mean log-odds.

    Our own definition; no step of the work rebuilt here says how the models are
    combined. Scores are kept off 0 and 1 by a millionth.
    """
    odds = F.avg(_log_odds(F.col("p")))
    return (
        long.filter(F.col("label") == label)
        .groupBy(key)
        .agg(_probability(odds).alias("solar_p"))
    )


def group_examples(examples: DataFrame) -> DataFrame:
    """Few-shot examples with all answers of a text in one sorted list."""
    return (
        examples.select("text", "answer")
        .distinct()
        .groupBy("text")
        .agg(F.array_sort(F.collect_list("answer")).alias("answers"))
    )
