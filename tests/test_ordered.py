from __future__ import annotations

import random

import pytest

from newsloom.operators import ordered as O
from newsloom.operators import trainlog as L


def logs(seed):
    rng = random.Random(seed)
    runs = {}
    for run in ("a", "b", None):
        at = sorted(rng.sample(range(300), rng.randrange(1, 60)))
        runs[run] = [(run, e, float(rng.randrange(8))) for e in at]
    return runs


def frame(spark, runs):
    rows = [r for log in runs.values() for r in log]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "run string, epoch int, loss double")


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [7, 1000])
def test_against_a_plain_loop(spark, seed, width):
    runs = logs(seed)
    df = frame(spark, runs)
    want = [
        (run, e, i + 1, len(log))
        for run, log in runs.items()
        for i, (_, e, _) in enumerate(log)
    ]
    got = O.numbered(df, ["run"], "epoch", "idx", "total", width)
    assert result(got, "run", "epoch", "idx", "total") == sorted(want, key=str)

    want = [
        (run, e, log[i - 1][2] if i else None)
        for run, log in runs.items()
        for i, (_, e, _) in enumerate(log)
    ]
    got = O.previous(df, ["run"], "epoch", "loss", "prev", width)
    assert result(got, "run", "epoch", "prev") == sorted(want, key=str)

    for kind, fn in (("sum", sum), ("min", min), ("max", max)):
        for inclusive in (True, False):
            want = []
            for run, log in runs.items():
                for i, (_, e, _) in enumerate(log):
                    past = [x for _, _, x in log[: i + inclusive]]
                    want.append((run, e, fn(past) if past else None))
            got = O.running(df, ["run"], "epoch", "loss", "v", kind, inclusive, width)
            assert result(got, "run", "epoch", "v") == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [5, 1000])
def test_early_stop(spark, seed, width):
    runs = logs(seed)
    want = []
    for run, log in runs.items():
        best, since = None, 0
        for _, epoch, loss in log:
            if best is None or loss < best:
                best, since = loss, 0
            else:
                since += 1
            if since >= 3:
                want.append((run, epoch))
                break
    got = L.early_stop(frame(spark, runs), ["run"], loss="loss", width=width)
    assert result(got, "run", "stop_epoch") == sorted(want, key=str)


def test_loss_delta_of_a_sum(spark):
    losses = [4.0, 3.0, 2.5, 2.25]
    rows = [("r", i, sum(losses[: i + 1])) for i in range(4)]
    df = spark.createDataFrame(rows, "run string, epoch int, loss double")
    got = L.loss_delta(df, ["run"], width=2).orderBy("epoch")
    assert [r.epoch_loss for r in got.collect()] == losses


def test_split_alternate_puts_summary_on_train_side(spark):
    # Alternating log rows and one summary row at the end, at an even position.
    df = spark.createDataFrame([("r", i) for i in range(5)], "run string, pos int")
    got = L.split_alternate(df, ["run"], "pos", width=2).orderBy("pos").collect()
    assert [r.side for r in got] == ["train", "eval", "train", "eval", "train"]


def test_best_epoch_takes_the_first_of_equals(spark):
    rows = [("r", 1, 0.5), ("r", 2, 0.25), ("r", 3, 0.25), ("r", 4, None)]
    df = spark.createDataFrame(rows, "run string, epoch int, eval_loss double")
    assert [tuple(r) for r in L.best_epoch(df, ["run"]).collect()] == [("r", 2)]


def test_schedule(spark):
    row = L.schedule(spark.range(1000)).first()
    assert row.steps == pytest.approx(1000 / 512 * 40)
    assert row.warmup_steps == int(0.15 * (1000 / 512 * 40))


def test_split_is_stable(spark):
    whole = {r.id: r.side for r in L.split(spark.range(5000), "id").collect()}
    part = {r.id: r.side for r in L.split(spark.range(100, 900), "id").collect()}
    assert all(whole[i] == side for i, side in part.items())
    share = sum(s == "test" for s in whole.values()) / 5000
    assert 0.08 < share < 0.12


def test_sparse_order_of_a_hot_run_has_few_rows_in_a_bucket(spark):
    """Hashed ids: no two rows near each other, and most rows in one run."""
    df = spark.range(20_000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN 'b' END AS run", "xxhash64(id) >> 4 AS at", "CAST(id AS double) AS v"
    )
    sizes = O.bucketed(df, ["run"], "at", 500).groupBy("run", "_bucket").count().collect()
    assert max(r["count"] for r in sizes) < 1000 and 40 <= len(sizes) <= 45
    got = O.numbered(df, ["run"], "at", "idx", "total", 500)
    wrong = got.selectExpr("idx", "total", "row_number() OVER (PARTITION BY run ORDER BY at) AS want").filter("idx <> want")
    assert wrong.count() == 0 and got.count() == 20_000


def bucket_sizes(df, width, order="at"):
    return [r["count"] for r in O.bucketed(df, ["run"], order, width).groupBy("run", "_bucket").count().collect()]


def test_an_outlier_does_not_widen_buckets(spark):
    """Dense values and one far out: buckets go by rank, not by value."""
    df = spark.range(200_000).selectExpr("'a' AS run", "IF(id = 7, 1000000000000000, id) AS at", "1.0D AS v")
    sizes = bucket_sizes(df, 1000)
    assert sum(sizes) == 200_000 and max(sizes) < 2000
    got = O.numbered(df, ["run"], "at", "idx", "total", 1000)
    assert got.filter("idx <> CASE WHEN at > 200000 THEN 200000 WHEN at < 7 THEN at + 1 ELSE at END OR total <> 200000").count() == 0


def test_small_runs_and_a_hot_one_share_buckets(spark):
    df = spark.range(60_000).selectExpr("IF(id % 3 = 0, id % 3000, -1) AS run", "exp(id % 600) * (id + 1) AS at", "id AS v")
    assert max(bucket_sizes(df, 500)) < 1000
    got = O.running(df, ["run"], "at", "v", "so_far", "sum", width=500)
    wrong = got.selectExpr("so_far", "sum(v) OVER (PARTITION BY run ORDER BY at) AS want").filter("so_far <> want")
    assert wrong.count() == 0 and got.count() == 60_000


def test_early_stop_of_a_falling_loss(spark):
    """Every row is a better one, so nothing can be left behind on the way."""
    df = spark.range(1_000_000).selectExpr("'a' AS run", "id AS epoch", "IF(id < 900000, -CAST(id AS double), 0D) AS eval_loss")
    sizes = bucket_sizes(df, 20_000, "epoch")
    assert len(sizes) >= 50 and max(sizes) < 40_000
    assert [tuple(r) for r in L.early_stop(df, ["run"], width=20_000).collect()] == [("a", 900_002)]
    assert L.early_stop(df.filter("epoch < 900000"), ["run"], width=20_000).count() == 0


def test_no_window_over_a_whole_run(spark):
    """Windows are by run and bucket, or over the buckets' sums."""
    df = spark.range(1000).selectExpr("'a' AS run", "id AS epoch", "rand(1) AS eval_loss")
    plan = L.early_stop(df, ["run"], width=100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        assert "_bucket" in line.split("], [")[1] or "_n" in line or "_agg" in line, line


def test_empty_run(spark):
    df = spark.createDataFrame([], "run string, epoch int, eval_loss double")
    assert L.early_stop(df, ["run"]).count() == 0 and O.numbered(df, ["run"], "epoch").count() == 0
