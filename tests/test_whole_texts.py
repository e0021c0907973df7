"""The regressor reads texts to their end, unless it is told where to cut."""

from __future__ import annotations

from newsloom.operators import trainlog as L


def test_words_after_the_128th_count(spark):
    rows = [(i, "same " * 200 + ("good" if i % 2 else "bad"), float(i % 2)) for i in range(200)]
    titles = spark.createDataFrame(rows, "doc_id long, text string, label double")
    loss = lambda **cut: L.select_title_regressor(titles, features=256, path=(0.01,), **cut)[1].first()["train_loss"]
    assert loss() < 0.05
    assert loss(max_tokens=128) > 0.2
