"""Training logs, splits and schedules, and the title regressor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ordered import WIDTH, bucketed, numbered, previous, running
from newsloom.session import fresh_path

# Settings of the title regressor's schedule.
PATIENCE = 3
TEST_PERCENT = 10
SPLIT_SEED = 42
BATCH = 256
NOMINAL_BATCH = 512
TRAIN_EPOCHS = 40
WARMUP_SHARE = 0.15


def loss_delta(
    log: DataFrame,
    part: list[str],
    epoch: str = "epoch",
    loss: str = "loss",
    width: int = WIDTH,
) -> DataFrame:
    """Loss of each epoch out of a loss that only adds up."""
    rows = previous(log, part, epoch, loss, "_prev", width)
    delta = F.col(loss) - F.coalesce("_prev", F.lit(0.0))
    return rows.withColumn("epoch_loss", delta).drop("_prev")


def split_alternate(
    log: DataFrame, part: list[str], order: str, width: int = WIDTH
) -> DataFrame:
    """Even positions are training rows, odd ones evaluation rows."""
    rows = numbered(log, part, order, "_at", width=width)
    side = F.when((F.col("_at") - 1) % 2 == 0, "train").otherwise("eval")
    return rows.withColumn("side", side).drop("_at")


def early_stop(
    log: DataFrame,
    part: list[str],
    epoch: str = "epoch",
    loss: str = "eval_loss",
    patience: int = PATIENCE,
    width: int = WIDTH,
) -> DataFrame:
    """First epoch of each run with ``patience`` epochs since the last better one.

    Only a loss below all before it is better. Runs that never stop give no row. Best
    loss, place and place of the last better row are running values that buckets hand
    on, so no window holds more than a bucket, or the buckets' sums of a run, however
    many of its rows are better ones.
    """
    rows = log.select(*part, F.col(epoch).alias("_epoch"), F.col(loss).alias("_loss"))
    rows = bucketed(rows.filter(F.col("_loss").isNotNull()), part, "_epoch", width)
    rows = numbered(rows, part, "_epoch", "_at", width=width)
    rows = running(rows, part, "_epoch", "_loss", "_best", "min", False, width)
    better = F.col("_best").isNull() | (F.col("_loss") < F.col("_best"))
    rows = rows.withColumn("_better", F.when(better, F.col("_at")))
    rows = running(rows, part, "_epoch", "_better", "_last", "max", True, width)
    return (
        rows.filter(F.col("_at") - F.col("_last") >= patience)
        .groupBy(*part)
        .agg(F.min(F.struct("_at", "_epoch")).alias("_stop"))
        .select(*part, F.col("_stop._epoch").alias("stop_epoch"))
    )


def best_epoch(
    log: DataFrame, part: list[str], epoch: str = "epoch", loss: str = "eval_loss"
) -> DataFrame:
    """Epoch with the lowest loss, the earliest of equals."""
    return (
        log.filter(F.col(loss).isNotNull())
        .groupBy(*part)
        .agg(F.min(F.struct(loss, epoch)).alias("_b"))
        .select(*part, F.col("_b")[epoch].alias("best_epoch"))
    )


def progress(
    df: DataFrame, part: list[str], order: str, width: int = WIDTH
) -> DataFrame:
    """Add the position of each row and the number of rows in its run."""
    return numbered(df, part, order, "idx", "total", width)


def schedule(
    train: DataFrame,
    batch: int = NOMINAL_BATCH,
    epochs: int = TRAIN_EPOCHS,
    warmup: float = WARMUP_SHARE,
) -> DataFrame:
    """Training and warm-up steps for the rows at hand."""
    steps = F.count(F.lit(1)) / F.lit(float(batch)) * F.lit(epochs)
    return train.agg(steps.alias("steps")).select(
        "steps",
        F.floor(F.col("steps") * F.lit(warmup)).cast("bigint").alias("warmup_steps"),
    )


def split(
    df: DataFrame,
    key: str,
    percent: int = TEST_PERCENT,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Mark each row ``train`` or ``test`` by a hash of its key.

    The side of a row depends on key and seed alone, however often it is computed
    and whatever other rows there are.
    """
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    point = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn(
        "side", F.when(point < percent, "test").otherwise("train")
    )


def train_title_regressor(
    titles: DataFrame,
    text: str = "text",
    label: str = "label",
    features: int = 4096,
    reg: float = 0.01,
    max_iter: int = 20,
):
    """Fit a regularised linear regressor on hashed words of the title."""
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+"
            ),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="features"),
            LinearRegression(
                featuresCol="features",
                labelCol=label,
                regParam=reg,
                maxIter=max_iter,
                solver="l-bfgs",
            ),
        ]
    ).fit(titles.select(text, label))


# Strengths of regularisation tried one after the other, from strong to weak.
REG_PATH = (0.3, 0.1, 0.03, 0.01, 0.003)


def select_title_regressor(
    titles: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "label",
    path: tuple[float, ...] = REG_PATH,
    patience: int = PATIENCE,
    max_tokens: int | None = None,
    features: int = 4096,
    max_iter: int = 20,
):
    """The best regressor along a path of settings, and the log of the path.

    Texts are cut to ``max_tokens`` words, if given, and split by ``split``. Each setting is an
    epoch of the log ``(run, epoch, reg, train_loss, eval_loss)``; the path ends when
    ``patience`` settings in a row were no better on the held-out side. Features are
    computed once for all settings and written down.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if max_tokens is not None:
        words = F.slice(words, 1, max_tokens)
    rows = split(titles, key).select("side", label, words.alias("words"))
    prepare = Pipeline(
        stages=[
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="features"),
        ]
    ).fit(rows.filter("side = 'train'"))
    path_ = fresh_path(titles.sparkSession, "features")
    prepare.transform(rows).select("side", label, "features").write.parquet(path_)
    ready = titles.sparkSession.read.parquet(path_)
    train, held = ready.filter("side = 'train'"), ready.filter("side = 'test'")
    judge = RegressionEvaluator(labelCol=label, metricName="mse")
    log, models = [], []
    for epoch, reg in enumerate(path):
        trainer = LinearRegression(
            labelCol=label, regParam=reg, maxIter=max_iter, solver="l-bfgs"
        )
        models.append(trainer.fit(train))
        losses = [judge.evaluate(models[-1].transform(side)) for side in (train, held)]
        log.append(("title", epoch, reg, *losses))
        best = min(range(len(log)), key=lambda i: (log[i][4], i))
        if epoch - best >= patience:
            break
    frame = titles.sparkSession.createDataFrame(
        log, "run string, epoch int, reg double, train_loss double, eval_loss double"
    )
    chosen = best_epoch(frame, ["run"]).first()["best_epoch"]
    return PipelineModel([*prepare.stages, models[chosen]]), frame


# Length of a step and pull towards zero of the regressor trained by epochs.
RATE, DECAY = 0.05, 0.01


class EpochRegressor:
    """A linear regressor on hashed words: one weight per slot, the last one for all rows."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``prediction``."""
        weights = self.weights
        rows = df.withColumn("_slots", word_slots(F.col(text), len(weights) - 1))

        @F.pandas_udf("double")
        def predict(slots: pd.Series) -> pd.Series:
            n = np.fromiter((len(s) for s in slots), np.int64, len(slots))
            flat = np.concatenate([*slots, np.zeros(0, np.int64)]).astype(np.int64)
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights[flat], len(n))
            return pd.Series(total / np.sqrt(np.maximum(n, 1)) + weights[-1])

        return rows.withColumn("prediction", predict("_slots")).drop("_slots")


def word_slots(text: Column, features: int) -> Column:
    """The slot of each word of a text, by its hash; none of a null text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")), F.array().cast("array<int>"))


def train_epochs(
    titles: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "label",
    features: int = 4096,
    epochs: int = TRAIN_EPOCHS,
    batch: int = BATCH,
    patience: int = PATIENCE,
    rate: float = RATE,
    decay: float = DECAY,
) -> tuple[EpochRegressor, DataFrame]:
    """A regressor trained by gradient steps, and the log ``(run, epoch, train_loss, eval_loss)``.

    Rows are split by ``split``. In an epoch each task starts from the weights of the last
    one, steps through its training rows in batches and gives its weights; they are
    averaged by rows. The held-out loss follows each epoch; after ``patience`` epochs
    without a better one training ends, and the best epoch's weights are the model. What
    reaches the driver is one number per slot. Without training rows all weights are zero.
    """
    spark = titles.sparkSession
    path = fresh_path(spark, "slots")
    known = split(titles.filter(F.col(label).isNotNull()), key)
    # Rows in an order of their own, so that batches are mixed and a task repeats its steps.
    rows = known.select("side", F.col(label).cast("double").alias("y"), word_slots(F.col(text), features).alias("slots"), F.xxhash64(key).alias("h"))
    rows.sortWithinPartitions("h").write.partitionBy("side").parquet(path)
    ready = spark.read.schema("y double, slots array<int>, side string").parquet(path)
    train, held = (ready.filter(F.col("side") == side).select("y", "slots") for side in ("train", "test"))

    def passed(df: DataFrame, start: np.ndarray, steps: bool) -> tuple[np.ndarray, float]:
        """The weights after a pass, averaged, and the mean loss of the rows as they came."""

        def run(batches):
            weights, count, loss = start.copy(), 0, 0.0
            for part in batches:
                for at in range(0, len(part), batch):
                    slots, y = part["slots"][at : at + batch], part["y"][at : at + batch].to_numpy()
                    n = np.fromiter((len(s) for s in slots), np.int64, len(slots))
                    flat = np.concatenate([*slots, np.zeros(0, np.int64)]).astype(np.int64)
                    row = np.repeat(np.arange(len(n)), n)
                    share = 1 / np.sqrt(np.maximum(n, 1))
                    off = np.bincount(row, weights[flat], len(n)) * share + weights[-1] - y
                    loss, count = loss + float(off @ off), count + len(y)
                    if steps:
                        slope = np.bincount(flat, (off * share)[row], len(weights))
                        slope[-1] = off.sum()
                        weights -= rate * (slope / len(y) + decay * np.r_[weights[:-1], 0.0])
            if count:
                values = np.r_[weights * count if steps else [], loss, count]
                yield pd.DataFrame({"place": np.arange(len(values)), "value": values})

        found = df.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
        values = np.array([r["value"] for r in found.orderBy("place").collect()])
        if not len(values):
            return start, float("nan")
        return values[:-2] / values[-1], float(values[-2] / values[-1])

    weights = best = np.zeros(features + 1)
    log, least, since = [], float("inf"), 0
    for epoch in range(1, epochs + 1):
        weights, train_loss = passed(train, weights, True)
        _, eval_loss = passed(held, weights, False)
        log.append(("title", epoch, train_loss, eval_loss))
        if eval_loss < least:
            best, least, since = weights, eval_loss, 0
        else:
            since += 1
        if since >= patience:
            break
    frame = spark.createDataFrame(log, "run string, epoch int, train_loss double, eval_loss double")
    return EpochRegressor(best), frame
