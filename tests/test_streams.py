from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.functions import scores as S
from newsloom.functions.text import article_id
from newsloom.operators import scoring as R
from newsloom.operators.incremental import first_per_key
from newsloom.streaming.ingest import append_new, compact, ingest_stream
from newsloom.streaming.scoring import ledger_path, retry_failed, score_batch, score_stream

PAGES = "page int, url string"


def listing(df):
    return df.select(article_id("url", "?").alias("article_id"), "page", "url")


def land(spark, path, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, name):
    source = (
        spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp / "landed"))
    )
    ingest_stream(
        source, listing, str(tmp / "store"), str(tmp / f"ck-{name}"), ["article_id"], ["page"], name
    ).awaitTermination()
    return spark.read.parquet(str(tmp / "store"))


def keys(df):
    return sorted((r.article_id, r.page) for r in df.select("article_id", "page").collect())


def test_stream_is_batch(spark, tmp_path):
    landed = str(tmp_path / "landed")
    land(spark, landed, [(1, "h/a?x"), (2, "h/b"), (3, "h/a")])
    land(spark, landed, [(4, "h/b?y"), (5, "h/c")])
    store = run(spark, tmp_path, "one")
    # Files are taken in some order; whole keys must agree with one batch.
    batch = first_per_key(listing(spark.read.parquet(landed)), ["article_id"], ["page"])
    assert {k for k, _ in keys(store)} == {k for k, _ in keys(batch)}
    assert store.count() == 3
    # The same checkpoint takes in new files only; a new run finds all keys known.
    land(spark, landed, [(6, "h/c"), (7, "h/d")])
    store = run(spark, tmp_path, "one")
    assert store.count() == 4 and ("d", 7) in keys(store)
    assert run(spark, tmp_path, "two").count() == 4


def test_batch_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    first = listing(spark.createDataFrame([(1, "h/a"), (2, "h/b")], PAGES))
    second = listing(spark.createDataFrame([(3, "h/b"), (4, "h/c")], PAGES))
    for batch_id, batch in ((0, first), (1, second), (1, second), (0, first)):
        append_new(batch, batch_id, path, ["article_id"], ["page"], "r")
        got = keys(spark.read.parquet(path))
    assert got == [("a", 1), ("b", 2), ("c", 4)]


TITLES = "article_id int, title string"


def test_scoring_goes_on_after_a_kill(spark, tmp_path):
    landed = str(tmp_path / "titles")
    for n in range(4):
        spark.createDataFrame([(i, "sun " * i) for i in range(n * 3, n * 3 + 3)], TITLES).coalesce(
            1
        ).write.mode("append").parquet(landed)
    calls = []
    scorer = R.lexicon_scorer({"solar": ["sun"], "notSolar": []})

    def flaky(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return scorer(rows)

    def go(answer, store, checkpoint):
        source = spark.readStream.schema(TITLES).option("maxFilesPerTrigger", 1).parquet(landed)
        score_stream(
            source, S.SOLAR_KEYS, answer, str(tmp_path / store), str(tmp_path / checkpoint), "m"
        ).awaitTermination()

    with pytest.raises(Exception, match="killed"):
        go(flaky, "store", "ck")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 6
    go(flaky, "store", "ck")
    go(scorer, "once", "ck-once")

    def rows(store):
        df = spark.read.parquet(str(tmp_path / store))
        return sorted(map(tuple, df.select("article_id", "solar", "notSolar", "model").collect()))

    assert rows("store") == rows("once") and len(rows("once")) == 12
    # Batches 0 and 1 were not scored a second time: two runs after the kill.
    assert len(calls) == 5


def ledger_run(spark, tmp_path, tries=3):
    """A stream over landed titles whose scorer fails for the titles in ``bad``."""
    bad, asked = set(), []
    scorer = R.lexicon_scorer({"solar": ["sun"], "notSolar": []})

    def answer(rows):
        asked.append(sorted(r.article_id for r in rows.select("article_id").collect()))
        failed = F.col("article_id").isin(*bad) if bad else F.lit(False)
        return scorer(rows).withColumn("answer", F.when(failed, "no idea").otherwise(F.col("answer")))

    def land_titles(*ids):
        rows = spark.createDataFrame([(i, "sun " * i) for i in ids], TITLES)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))

    def go():
        source = spark.readStream.schema(TITLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
        score_stream(source, S.SOLAR_KEYS, answer, str(tmp_path / "store"), str(tmp_path / "ck"), "m", tries=tries).awaitTermination()

    def retry():
        schema = spark.createDataFrame([], TITLES).schema
        retry_failed(spark, schema, S.SOLAR_KEYS, answer, str(tmp_path / "store"), "m", tries=tries)

    def good():
        return sorted(r.article_id for r in spark.read.parquet(str(tmp_path / "store")).filter("valid").collect())

    return bad, asked, land_titles, go, retry, good


def test_a_failed_answer_is_asked_again_under_the_same_checkpoint(spark, tmp_path):
    bad, asked, land_titles, go, retry, good = ledger_run(spark, tmp_path)
    bad |= {2, 3}
    land_titles(1, 2, 3)
    go()
    assert asked == [[1, 2, 3]] and good() == [1]
    # Nothing lands: nothing is asked. Then a new title brings the old ones along.
    go()
    bad.discard(2)
    land_titles(4)
    go()
    assert asked == [[1, 2, 3], [2, 3, 4]] and good() == [1, 2, 4]
    # Never after a success; without new titles by a batch of its own.
    bad.clear()
    retry()
    retry()
    land_titles(1, 3, 5)
    go()
    assert asked[2:] == [[3], [], [5]] and good() == [1, 2, 3, 4, 5]


def test_tries_are_limited(spark, tmp_path):
    bad, asked, land_titles, go, retry, good = ledger_run(spark, tmp_path, tries=2)
    bad |= {1}
    land_titles(1)
    go()
    retry()
    retry()
    # The same title landing once more is the same title.
    land_titles(1, 2)
    go()
    assert asked == [[1], [1], [], [2]] and good() == [2]


def test_a_scoring_batch_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    titles = spark.createDataFrame([(i, "sun") for i in range(4)], TITLES)
    scorer = R.lexicon_scorer({"solar": ["sun"], "notSolar": []})
    failing = lambda rows: scorer(rows).withColumn("answer", F.when(F.col("article_id") > 1, "?").otherwise(F.col("answer")))

    def state():
        both = spark.read.parquet(path), spark.read.parquet(ledger_path(path))
        return [sorted(map(tuple, df.collect())) for df in both]

    seen = []
    for batch_id, answer in ((0, failing), (1, failing), (1, failing), (0, failing)):
        score_batch(titles, batch_id, S.SOLAR_KEYS, answer, path, "m", "article_id", "r")
        seen.append(state())
    assert seen[1] == seen[2] == seen[3]
    assert sorted((r.article_id, r.tries) for r in spark.read.parquet(ledger_path(path)).collect()) == [(2, 1), (2, 2), (3, 1), (3, 2)]


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    """The registered streams give the same rows on one file and on a folder of files."""
    import shutil

    from newsloom.plans import all_queries

    queries = all_queries()[0]
    one, many = "/root/testdata/sf0.001", str(tmp_path / "many")
    for name in ("pages", "documents"):
        spark.read.parquet(f"{one}/{name}.parquet").repartition(3).write.parquet(f"{many}/{name}.parquet")
    for name in ("st1_ingest_stream", "st2_score_stream"):
        a, b = (queries[name](spark, d) for d in (one, many))
        keys = lambda df: sorted(r.article_id for r in df.collect())
        assert keys(a) == keys(b) and keys(a)
    shutil.rmtree(many)


def test_compacted_store_is_the_same(spark, tmp_path):
    path, out = str(tmp_path / "store"), str(tmp_path / "out")
    first = listing(spark.createDataFrame([(1, "h/a"), (2, "h/b")], PAGES))
    second = listing(spark.createDataFrame([(3, "h/b"), (4, "h/c")], PAGES))
    append_new(first, 0, path, ["article_id"], ["page"], "r")
    append_new(second, 1, path, ["article_id"], ["page"], "r")
    compact(spark, path, out, 1, ["article_id"])
    assert keys(spark.read.parquet(out)) == keys(spark.read.parquet(path))
    append_new(second, 2, out, ["article_id"], ["page"], "r")
    assert keys(spark.read.parquet(out)) == keys(spark.read.parquet(path))


def test_compaction_writes_as_many_files_as_asked(spark, tmp_path):
    """Also of one run, which is all there is here."""
    path, out = str(tmp_path / "store"), str(tmp_path / "out")
    for batch in range(5):
        rows = spark.range(batch * 200, batch * 200 + 200).selectExpr("CAST(id AS int) AS page", "concat('h/', id) AS url")
        append_new(listing(rows), batch, path, ["article_id"], ["page"], "r")
    compact(spark, path, out, 4, ["article_id"])
    files = spark.read.parquet(out).inputFiles()
    assert len(files) == 4
    assert min(spark.read.parquet(f).count() for f in files) > 150
    assert keys(spark.read.parquet(out)) == keys(spark.read.parquet(path))
