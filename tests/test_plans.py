"""What the plans must and must not hold."""

from __future__ import annotations

import pytest
import __spark_entry__ as entry
from newsloom.operators import incremental as I
from newsloom.session import shuffle_partitions

SF = "/root/testdata/sf0.001"
# The scorer interface is Python by nature; everything else is native.
PYTHON = {"d1_mapped_scorer", "d2_nested_prompts"}
# These run jobs of their own before they give a plan.
EAGER = ("j9_", "m2_", "m3_index", "m4_", "o3_nearest_of", "s12_", "st1_", "st2_", "s1_", "s2_", "s3_", "s4_", "s6_", "s7_", "s8_", "s9_", "op", "pipeline")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(EAGER)))
def test_plan(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    python = "MapInPandas" in text or "Python" in text
    assert python == (name in PYTHON)
    # A window or sort over all rows in one task.
    for line in text.splitlines():
        assert not ("Window [" in line and "windowspecdefinition()" in line)


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(entry.queries()["a3_category_counts"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    text = plan(entry.queries()["u1_union_sources"](spark, SF))
    assert "PushedFilters: [In(source" in text
    text = plan(entry.queries()["s5_read_table"](spark, SF))
    assert "l_shipdate" not in text


def test_ranks_are_limited_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 3 AS k", "id")
    text = plan(I.last_per_key(df, ["k"], ["id"]))
    assert text.count("WindowGroupLimit") == 2


def test_small_batch_leaves_the_store_where_it_is(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(1000).selectExpr("id AS k", "id AS v").write.parquet(path)
    store = spark.read.parquet(path)
    small = str(tmp_path / "batch")
    spark.createDataFrame([(1, 5), (2000, 6)], "k long, v long").write.parquet(small)
    batch = spark.read.parquet(small)
    text = plan(I.upsert(store, batch, ["k"], ["v"]))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    # All shuffling is between the batch's own scan and its rank.
    store_side = text[text.index("LeftAnti") : text.index("BroadcastExchange")]
    assert f"{path}]" in store_side and "hashpartitioning" not in store_side


def test_small_listing_leaves_the_store_where_it_is(spark, tmp_path):
    path, small = str(tmp_path / "store"), str(tmp_path / "listing")
    spark.range(1000).selectExpr("id AS k").write.parquet(path)
    spark.range(5).selectExpr("id * 900 AS k").write.parquet(small)
    got = I.new_only(spark.read.parquet(small), spark.read.parquet(path), ["k"])
    text = plan(got)
    assert "SortMergeJoin" not in text
    scan = text.index(f"{path}]")
    semi = text.rindex("LeftSemi", 0, scan)
    assert "Exchange" not in text[semi:scan]
    assert sorted(r.k for r in got.collect()) == [1800, 2700, 3600]


def test_one_plan_for_few_and_many_cursors(spark, tmp_path):
    """Stop places come from one plan without a job of its own, whatever their number."""
    shapes = []
    for n in (3, 20_000):
        path = str(tmp_path / f"listing-{n}")
        rows = spark.range(40_000).selectExpr(
            f"concat('s', CASE WHEN id % 2 = 0 THEN 0 ELSE id % {n} END) AS source",
            "id AS pos", "concat('k', id % 30000) AS key",
        )
        rows.write.parquet(path)
        got = I.take_until_known(spark.read.parquet(path), None, "key", ["pos"], ["source"])
        text = plan(got)
        shapes.append([line.split("(")[0].split("[")[0].strip(" :+-") for line in text.splitlines()])
        assert "_spread" in text and got.count() > 0
    assert shapes[0] == shapes[1]


def test_scores_of_a_title_stay_in_their_row(spark):
    for name in ("m7_wide_by_model", "m8_pool"):
        assert "Exchange" not in plan(entry.queries()[name](spark, SF))


def test_exclusion_leaves_the_stores_where_they_are(spark, tmp_path):
    path, small = str(tmp_path / "store"), str(tmp_path / "links")
    spark.range(1000).selectExpr("id % 3 AS category", "id AS k").write.parquet(path)
    spark.range(5).selectExpr("1L AS category", "id * 100 AS k").write.parquet(small)
    got = I.exclude_all(spark.read.parquet(small), [spark.read.parquet(path)], keys=["category", "k"])
    text = plan(got)
    assert "SortMergeJoin" not in text
    scan = text.index(f"{path}]")
    assert "Exchange" not in text[text.rindex("LeftSemi", 0, scan) : scan]
    # 100 and 400 are of category 1 in the store too.
    assert sorted(r.k for r in got.collect()) == [0, 200, 300]


@pytest.mark.parametrize("dead", [False, True])
def test_exclusion_reads_its_links_twice(spark, tmp_path, dead):
    """However many stores there are."""
    links = str(tmp_path / "links")
    spark.range(500).selectExpr("CAST(id AS string) AS k").write.parquet(links)
    stores = []
    for n in range(4):
        spark.range(n * 50, n * 50 + 40).selectExpr("CAST(id AS string) AS k").write.parquet(f"{tmp_path}/store{n}")
        stores.append(spark.read.parquet(f"{tmp_path}/store{n}"))
    gone = spark.createDataFrame([("300",), ("https://h/301",), (None,)], "entry string") if dead else None
    for count in (1, 4):
        got = I.exclude_all(spark.read.parquet(links), stores[:count], gone, keys="k")
        text = plan(got)
        assert text.count(f"{links}]") == 2
        assert got.count() == 500 - 40 * count - dead


def test_shuffle_partitions():
    assert shuffle_partitions(10**6) == 200
    assert shuffle_partitions(10**12) == 3726
    assert shuffle_partitions(10**6, cores=4000) == 12_000
    assert shuffle_partitions(10**14) == 372_530
