"""Texts of no language that the model has learned leave the pipeline; clean ones stay."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from newsloom.llm import langid

FOREIGN = [
    "今天天气很好,我们一起去公园散步,看到了很多美丽的花朵和可爱的小动物。",
    "วันนี้อากาศดีมาก เราไปเดินเล่นที่สวนสาธารณะด้วยกัน",
    "Сегодня хорошая погода, мы пошли гулять в парк и увидели много красивых цветов.",
    "Dzisiaj jest piękna pogoda, poszliśmy na spacer do parku i zobaczyliśmy wiele pięknych kwiatów.",
]


def test_unknown_languages_and_junk_leave(spark):
    rng = random.Random(4)
    letters = ["abcdefghijklmnopqrstuvwxyz ", "0123456789abcdef"]
    junk = FOREIGN + ["".join(rng.choices(a, k=500)) for a in letters for _ in range(3)]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = given.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], given.schema))
    kept = corpus_pipeline.identify_language(spark, docs, "").select("doc_id")
    assert not kept.where("doc_id < 0").count()
    # Rows that were not learned from stay.
    held = given.where("text IS NOT NULL").where(~langid.is_training(F.col("doc_id")))
    assert held.join(kept, "doc_id", "left_semi").count() >= 0.99 * held.count()
