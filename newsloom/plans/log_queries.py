"""Training-log, split and regressor queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import trainlog as L
from newsloom.plans.registry import query, table


def user_logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as training logs, one run per user."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("loss"),
        F.col("value").alias("eval_loss"),
    )


_RUN = "PARTITION BY user_id ORDER BY event_id"


@query(
    "w2_loss_delta",
    f"""SELECT user_id AS run, event_id AS epoch,
        round(value - coalesce(lag(value) OVER ({_RUN}), 0), 6) AS epoch_loss FROM events""",
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    rows = L.loss_delta(user_logs(spark, d), ["run"])
    return rows.select("run", "epoch", F.round("epoch_loss", 6).alias("epoch_loss"))


@query(
    "d5_epoch_losses",
    """SELECT doc_id AS epoch, source AS run, round(CAST(n_chars - coalesce(lag(n_chars) OVER
       (PARTITION BY source ORDER BY doc_id), 0) AS DOUBLE), 6) AS epoch_loss FROM documents""",
)
def d5(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "documents").select(
        F.col("source").alias("run"),
        F.col("doc_id").alias("epoch"),
        F.col("n_chars").cast("double").alias("loss"),
    )
    return L.loss_delta(log, ["run"]).select("run", "epoch", "epoch_loss")


@query(
    "w3_split_alternate",
    f"""SELECT user_id AS run, event_id AS epoch, CASE WHEN (row_number() OVER ({_RUN}) - 1) % 2 = 0
        THEN 'train' ELSE 'eval' END AS side FROM events""",
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    return L.split_alternate(user_logs(spark, d), ["run"], "epoch").select("run", "epoch", "side")


@query(
    "w4_early_stop",
    f"""WITH a AS (SELECT user_id AS run, event_id AS epoch, value,
          row_number() OVER ({_RUN}) AS pos, min(value) OVER ({_RUN}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
        b AS (SELECT *, max(CASE WHEN best IS NULL OR value < best THEN pos END) OVER (
          PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_better
          FROM a)
        SELECT run, min(epoch) AS stop_epoch FROM b WHERE pos - last_better >= 3 GROUP BY run""",
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    return L.early_stop(user_logs(spark, d), ["run"])


@query(
    "w5_best_epoch",
    """SELECT user_id AS run, arg_min(event_id, {'v': value, 'e': event_id}) AS best_epoch
       FROM events GROUP BY user_id""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return L.best_epoch(user_logs(spark, d), ["run"])


@query(
    "w6_progress",
    """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx,
       count(*) OVER (PARTITION BY source) AS total FROM documents""",
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return L.progress(docs, ["source"], "doc_id")


@query(
    "a9_schedule",
    """SELECT round(count(*) / 512.0 * 40, 6) AS steps,
       CAST(floor(count(*) / 512.0 * 40 * 0.15) AS BIGINT) AS warmup_steps FROM documents""",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    plan = L.schedule(table(spark, d, "documents"))
    return plan.select(F.round("steps", 6).alias("steps"), "warmup_steps")


@query(
    "o5_split",
    """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(doc_id || '-42'), 1, 8) AS BIGINT) % 100 < 10
       THEN 'test' ELSE 'train' END AS side FROM documents""",
)
def o5(spark: SparkSession, d: str) -> DataFrame:
    return L.split(table(spark, d, "documents"), "doc_id").select("doc_id", "side")


@query(
    "m4_title_regressor",
    """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(doc_id || '-42'), 1, 8) AS BIGINT) % 100 < 10
         THEN 'test' ELSE 'train' END AS side, CAST(quality AS DOUBLE) AS label, true AS predicted
       FROM documents JOIN labels USING (doc_id)""",
)
def m4(spark: SparkSession, d: str) -> DataFrame:
    """Values of a trained model cannot be told in SQL; rows, sides and labels can."""
    labels = table(spark, d, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("label")
    )
    rows = table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")
    sides = L.split(rows, "doc_id")
    model = L.train_title_regressor(sides.filter("side = 'train'"))
    value = F.col("prediction")
    return model.transform(sides).select(
        "doc_id", "side", "label", (~F.isnan(value) & (F.abs(value) < 1e6)).alias("predicted")
    )


@query(
    "m4_training_log",
    f"""SELECT 'title' AS run, CAST(i AS INT) AS epoch, list_extract({list(L.REG_PATH)}, CAST(i AS INT) + 1)::DOUBLE AS reg,
        true AS measured FROM range({len(L.REG_PATH)}) t(i)""",
)
def m4_log(spark: SparkSession, d: str) -> DataFrame:
    """Every setting of the path with both losses; values cannot be told in SQL."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")
    _, log = L.select_title_regressor(rows, patience=len(L.REG_PATH))
    measured = F.col("train_loss").between(0, 10) & F.col("eval_loss").between(0, 10)
    return log.select("run", "epoch", "reg", measured.alias("measured"))


@query(
    "m4_epochs",
    "SELECT 'title' AS run, true AS five_epochs, true AS ends_as_it_should, true AS best_is_kept",
)
def m4_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Training by epochs: the log's own stop and best epoch are those of the training."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")
    model, log = L.train_epochs(rows)
    last = log.groupBy("run").agg(F.max("epoch").alias("last"), F.min("eval_loss").alias("least"))
    held = L.split(rows, "doc_id").filter("side = 'test'")
    loss = model.transform(held).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)).alias("loss"))
    stops = L.early_stop(log, ["run"])
    facts = last.join(L.best_epoch(log, ["run"]), "run").join(stops, "run", "left").join(loss.withColumn("run", F.lit("title")), "run")
    return facts.select(
        "run", (F.col("last") >= 5).alias("five_epochs"),
        ((F.col("stop_epoch") == F.col("last")) | (F.col("stop_epoch").isNull() & (F.col("last") == L.TRAIN_EPOCHS))).alias("ends_as_it_should"),
        (F.abs(F.col("loss") - F.col("least")) < 1e-9).alias("best_is_kept"),
    )
