from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.operators import conform as C
from newsloom.operators import newsletter as N
from newsloom.plans import articles as A
from newsloom.sources import keyed_json as J


@pytest.mark.parametrize("indented", [None, False, True])
def test_keyed_json(spark, fixture_path, indented):
    df = J.read_keyed_json(
        spark, fixture_path("keyed_core.json"), "headline string, articleBody string, keywords string",
        indented=indented,
    )
    rows = {r.article_id: r for r in df.collect()}
    assert sorted(rows) == ["101", "102", "103", "104"]
    assert rows["101"].keywords == '["solar","park"]'
    assert rows["102"].articleBody == "Body {two},\n    },\nstill two"
    assert rows["103"].articleBody is None and rows["104"].headline is None


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_indented_files_of_any_length(spark, tmp_path, n):
    store = {str(i): {"v": str(i), "d": {"x": {}, "y": [1, {}]}} for i in range(n)}
    if n > 2:
        store["1"] = {}
        store[str(n - 1)] = {}
    (tmp_path / "s.json").write_text(json.dumps(store, indent=4))
    for indented in (None, True, False):
        got = J.read_keyed_json(spark, str(tmp_path / "s.json"), "v string, d string", indented=indented)
        assert {r.article_id: r.v for r in got.collect()} == {
            k: v.get("v") for k, v in store.items()
        }


def test_missing_and_empty_stores(spark, tmp_path):
    gone = J.read_keyed_json(spark, str(tmp_path / "none.json"), "v string")
    assert gone.columns == ["article_id", "v"] and gone.count() == 0
    (tmp_path / "empty.json").write_text("")
    assert J.read_keyed_json(spark, str(tmp_path / "empty.json"), "v string").count() == 0
    (tmp_path / "bad.json").write_text('{"a": {"v": ')
    with pytest.raises(Exception):
        J.read_keyed_json(spark, str(tmp_path / "bad.json"), "v string").collect()


def test_keyed_table_has_no_key(spark, fixture_path):
    df = J.read_keyed_table(spark, fixture_path("keyed_mercom.json"), "url string")
    assert df.columns == ["url"] and df.count() == 2


PATHS = {
    "ec": "keyed_core.json",
    "eec": "keyed_nested.json",
    "nleec": "keyed_nested.json",
    "mercom": "keyed_mercom.json",
    "saur": "keyed_saur.json",
    "pvmag": "keyed_pv.json",
    "pvmag_global": "keyed_pv.json",
    "pvmag_us": "keyed_pv.json",
}


def test_article_table(spark, fixture_path, tmp_path):
    paths = {source: fixture_path(name) for source, name in PATHS.items()}
    table = A.article_table(spark, paths)
    assert [f.name for f in table.schema] == [f.name for f in C.ARTICLE_SCHEMA]
    assert [f.dataType for f in table.schema] == [f.dataType for f in C.ARTICLE_SCHEMA]
    rows = {}
    for r in table.collect():
        rows.setdefault(r.source, {})[r.url or r.title] = r
    ec = rows["ec"]
    assert ec["https://news.example/101"].date == date(2024, 8, 1)
    assert ec["https://news.example/101"].kws == ["solar", "park"]
    assert ec["https://news.example/102"].kws == ["grid,wind"]
    assert ec["https://news.example/102"].date == date(2024, 8, 2)
    assert ec["https://news.example/103"].kws == [] and ec["https://news.example/103"].date is None
    # The record is taken, not the listed fields around it.
    assert set(rows["eec"]) == {"https://news.example/a", "D", "E"}
    assert rows["eec"]["D"].kws == ["7"]
    assert set(rows["nleec"]) == {"https://news.example/a", "E"}
    assert rows["mercom"]["https://m.example/p1"].summary is None
    assert rows["mercom"]["https://m.example/p1"].date == date(2024, 3, 4)
    assert rows["saur"]["https://s.example/1"].date == date(2024, 8, 1)
    assert rows["saur"]["https://s.example/2"].kws is None
    assert rows["pvmag"]["https://v.example/1"].date == date(2024, 8, 1)
    assert rows["pvmag_us"]["https://v.example/1"].date == date(2024, 7, 31)
    assert rows["pvmag_global"]["https://v.example/2"].date == date(2025, 1, 1)
    counts = A.build_articles(spark, paths, str(tmp_path / "articles.parquet"))
    got = {r.source: r.n_articles for r in counts.collect()}
    assert got == {s: len(r) for s, r in rows.items()} | {"ec": 4}


def test_union_keeps_copies(spark):
    frame = C.conform(
        spark.createDataFrame([("u", "t", "b", "2024-01-01", ["k"])] * 2, "url string, title string, body string, date string, categories array<string>"),
        "mercom",
    )
    assert C.union_sources([frame, frame]).count() == 4


def test_strict_source_stops_on_a_bad_date(spark):
    df = spark.createDataFrame(
        [("u", "t", "b", "soon", ["k"])],
        "url string, title string, body string, date string, categories array<string>",
    )
    with pytest.raises(Exception, match="unreadable date"):
        C.conform(df, "mercom").collect()


def test_newsletter_links(page):
    pages = page("newsletter_page.html").withColumn("nl_date", F.to_date(F.lit("2024-01-05")))
    got = sorted((r.category, r.url) for r in N.newsletter_links(pages).collect())
    both = "https://e.example/news/power/news/coal/13%"
    assert got == [
        ("coal", both),
        ("economy", ""),
        ("power", both),
        ("renewable", "https://e.example/news/renewable/one/11"),
    ]


INDEX = "nl_date string, category string, url string"


def index(spark):
    rows = [
        ("2024-01-01", "oil", "a"),
        ("2024-01-01", "oil", "a"),
        ("2024-01-01", "coal", "b"),
        ("2024-01-03", "oil", "a"),
        ("2024-01-03", "oil", "c"),
    ]
    df = spark.createDataFrame(rows, INDEX)
    return N.distinct_links(df.withColumn("nl_date", F.to_date("nl_date")))


def test_index_counts(spark):
    idx = index(spark)
    assert N.link_count(idx).first().n_links == 4
    assert {r.category: r.n_links for r in N.category_counts(idx).collect()} == {"oil": 2, "coal": 1}
    assert sorted(map(tuple, N.links_by_category(idx).collect())) == [
        ("coal", "b"),
        ("oil", "a"),
        ("oil", "c"),
    ]


def test_matrix_and_days(spark):
    idx = index(spark)
    days = idx.select("nl_date").unionByName(
        spark.createDataFrame([("2024-01-02",)], "nl_date string").select(F.to_date("nl_date").alias("nl_date"))
    )
    cells = N.link_matrix(days, idx, ("oil", "coal"))
    assert cells.filter("url is null").count() == 3
    assert cells.count() == 7
    has = {str(r.nl_date): r.has_any for r in N.days_with_links(cells).collect()}
    assert has == {"2024-01-01": True, "2024-01-02": False, "2024-01-03": True}
    late = N.days_with_links(cells).unionByName(
        spark.createDataFrame([("2024-01-04", False)], "nl_date string, has_any boolean").withColumn(
            "nl_date", F.to_date("nl_date")
        )
    )
    # The empty day before a good one is done, the one after it is not.
    assert sorted(str(r.nl_date) for r in N.done_days(late).collect()) == [
        "2024-01-01",
        "2024-01-02",
        "2024-01-03",
    ]


def test_missing_dates(spark):
    got = N.missing_dates(index(spark), "2023-12-31", "2024-01-04")
    assert sorted(str(r.nl_date) for r in got.collect()) == ["2023-12-31", "2024-01-02", "2024-01-04"]


def test_name_order(spark):
    rows = [("coal", 2), ("environment", 3), ("economy", 1), ("companies", 0), ("oil", 5), ("abcd", 1)]
    df = spark.createDataFrame(rows, "category string, first_seen int")
    got = [r.category for r in N.order_by_name_length(df).collect()]
    assert got == ["environment", "companies", "economy", "abcd", "coal", "oil"]


def test_set_as_json(spark):
    df = spark.createDataFrame([(["b", "a", "b"],)], "s array<string>")
    assert df.select(N.set_as_json(F.col("s"))).first()[0] == '["a","b"]'


def test_store_rewrites_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    cols = "id int, source string, topic string"
    J.write_store(spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], cols), path)
    J.write_store(spark.createDataFrame([(3, "a", "y")], cols), path)
    assert sorted(r.id for r in J.read_store(spark, path).collect()) == [1, 3]


def test_indented_file_read_by_many_tasks(spark, tmp_path):
    store = {
        str(i): {"v": "x" * (i % 97), "d": {"a": [{"b": "\n    },\n"}], "n": i}} for i in range(3000)
    }
    (tmp_path / "big.json").write_text(json.dumps(store, indent=4))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5003")
    try:
        df = J.read_keyed_json(spark, str(tmp_path / "big.json"), "v string, d string", indented=True)
        assert df.rdd.getNumPartitions() > 50
        got = {r.article_id: (r.v, json.loads(r.d)) for r in df.collect()}
        assert df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: (v["v"], v["d"]) for k, v in store.items()}


def test_one_store_of_all_sources(spark):
    rows = [
        ("ec", "u1", "H", "Aug 2, 2024", "a,b", None, None, None),
        ("mercom", "u2", None, None, None, "2024-01-02T10:00:00", ["k"], None),
        ("pvmag_us", "u3", None, None, None, None, None, "2024-12-31T22:00:00-05:00"),
    ]
    store = spark.createDataFrame(
        rows,
        "source string, url string, headline string, datePublished string, keywords string,"
        "date string, categories array<string>, date_published string",
    )
    got = {r.source: r for r in C.conform_all(store).collect()}
    assert (got["ec"].title, str(got["ec"].date), got["ec"].kws) == ("H", "2024-08-02", ["a,b"])
    assert (str(got["mercom"].date), got["mercom"].kws) == ("2024-01-02", ["k"])
    assert (str(got["pvmag_us"].date), got["pvmag_us"].kws) == ("2025-01-01", None)
    assert C.conform_all(store).schema.simpleString() == C.ARTICLE_SCHEMA.simpleString()
    other = store.withColumn("source", F.lit("elsewhere"))
    with pytest.raises(Exception, match="no mapping for source elsewhere"):
        C.conform_all(other).collect()
