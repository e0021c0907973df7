from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import incremental as I

LISTING = "source string, page int, pos int, key string, registered boolean, n int"


def random_listing(seed, keys=12, sources=("a", "b", "c", "d")):
    rng = random.Random(seed)
    rows = []
    for source in sources:
        for at in range(rng.randrange(0, 30)):
            key = f"k{rng.randrange(keys * (1 + sources.index(source)))}"
            rows.append((source, at // 7, at % 7, key, rng.random() < 0.7, at))
    rng.shuffle(rows)
    return rows


def walk(rows, store, loaded, mode, use_flag):
    """The listing read from the top, one row after the other."""
    kept = []
    for source in sorted({r[0] for r in rows}):
        known = {k for s, k in store if s == source}
        first_load = mode == "first-load" and source not in loaded
        seen = {}
        for row in sorted((r for r in rows if r[0] == source), key=lambda r: r[1:3]):
            key, registered = row[3], row[4] or not use_flag
            if (key in known or key in seen) and not first_load:
                break
            if mode == "first-load":
                seen[key] = row
            else:
                kept.append(row)
                if registered:
                    seen[key] = row
        if mode == "first-load":
            kept += seen.values()
    return sorted(kept)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("mode, flag", [("strict", None), ("strict", "registered"), ("first-load", None)])
def test_take_until_known(spark, seed, mode, flag):
    rows = random_listing(seed)
    rng = random.Random(seed + 100)
    store = [(s, f"k{rng.randrange(20)}") for s in ("a", "b", "x") for _ in range(2)]
    got = I.take_until_known(
        spark.createDataFrame(rows, LISTING),
        spark.createDataFrame(store, "source string, key string"),
        "key",
        ["page", "pos"],
        ["source"],
        mode,
        flag,
    )
    want = walk(rows, store, {s for s, _ in store}, mode, flag is not None)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_take_until_known_twice_is_once(spark):
    rows = spark.createDataFrame(random_listing(9), LISTING)
    store = spark.createDataFrame([("a", "k1")], "source string, key string")
    args = (store, "key", ["page", "pos"], ["source"])
    once = I.take_until_known(rows, *args)
    twice = I.take_until_known(once, *args)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_take_until_known_of_text_order(spark):
    rows = [("a", "p1", "x", 1), ("a", "p2", "y", 2), ("a", "p3", "x", 3)]
    df = spark.createDataFrame(rows, "source string, at string, key string, n int")
    got = I.take_until_known(df, None, "key", ["at", "n"], ["source"])
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_hot_key(spark):
    """A third of the rows are copies of one key."""
    hot = spark.range(30_000).select(
        F.lit("a").alias("source"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("key"),
    )
    got = I.take_until_known(hot, None, "key", ["pos"], ["source"])
    assert sorted(r.pos for r in got.collect()) == [0, 1, 2, 3]
    assert I.last_per_key(hot, ["key"], ["pos"]).count() == 20_001


def test_upsert(spark):
    schema = "key string, seq int, v string"
    store = spark.createDataFrame([("a", 9, "old"), ("b", 1, "old")], schema)
    batch = spark.createDataFrame([("a", 1, "new"), ("a", 2, "newer"), ("c", 1, "new")], schema)
    once = I.upsert(store, batch, ["key"], ["seq"])
    want = [("a", 2, "newer"), ("b", 1, "old"), ("c", 1, "new")]
    assert sorted(map(tuple, once.collect())) == want
    twice = I.upsert(once, batch, ["key"], ["seq"])
    assert sorted(map(tuple, twice.collect())) == want


def test_upsert_fields_keeps_the_rest(spark):
    store = spark.createDataFrame([("a", "url", "d0"), ("b", "url", "d0")], "key string, url string, data string")
    batch = spark.createDataFrame([("a", None, 1), ("c", "d1", 1)], "key string, data string, seq int")
    got = I.upsert_fields(store, batch, ["key"], ["data"], ["seq"])
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("a", "url", None),
        ("b", "url", "d0"),
        ("c", None, "d1"),
    ]


def test_backfill_writes_null_over(spark):
    store = spark.createDataFrame([("a", "x", "old"), ("b", "y", "old")], "key string, url string, body string")
    bodies = spark.createDataFrame([("a", None, ["t"])], "key string, body string, key_words array<string>")
    got = I.backfill(store, bodies, "key", ("body", "key_words")).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("a", "x", None, ["t"]), ("b", "y", "old", None)]


def test_needs_body(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "key string, body string")
    assert [r.key for r in I.needs_body(rows).collect()] == ["a"]
    assert I.needs_body(rows.drop("body")).count() == 2


def test_exclude_all(spark):
    links = spark.createDataFrame([("1", "h/1"), ("2", "h/2"), ("3", "h/3"), ("4", "h/4"), ("5", "h/5")], "article_id string, url string")
    own = spark.createDataFrame([("1",)], "article_id string")
    other = spark.createDataFrame([("2",)], "article_id string")
    dead = spark.createDataFrame([("3",), ("h/4",)], "entry string")
    keep = I.exclude_all(links, [own, other], dead)
    assert sorted(r.article_id for r in keep.collect()) == ["4", "5"]
    keep = I.exclude_all(links, [own, other], dead, normalize_keys=True)
    assert [r.article_id for r in keep.collect()] == ["5"]


def test_routing(spark):
    log = spark.createDataFrame(
        [
            ("ec", "page", "u", 500),
            ("eec", "item", "u", 404),
            ("nleec", "item", "h/7", 404),
            ("nleec", "item", "h/8", None),
            ("nleec", "page", "u", 500),
            ("mercom", "page", "u", 500),
            ("saur", "page", "u", 404),
            ("saur", "item", "u", 404),
            ("pvmag", "page", "u", 404),
            ("pvmag_us", "page", "u", 503),
            ("pvmag_us", "page", "u", 200),
            ("ec", "page", "u", None),
        ],
        "source string, kind string, url string, status int",
    )
    routed = I.route_status(log)
    assert [r.outcome for r in routed.collect()] == [
        "next",
        "skip",
        "dead",
        "dead",
        "next",
        "parse",
        "retry",
        "null body",
        "end",
        "retry",
        "ok",
        "raise",
    ]
    letters = sorted(map(tuple, I.dead_letters(routed).collect()))
    assert letters == [("7", "not found"), ("h/8", "request failed")]


def test_known_keys(spark):
    listing = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    store = spark.createDataFrame([("a",), ("a",), ("z",)], "key string")
    assert [r.key for r in I.known_keys(listing, store, ["key"]).collect()] == ["a"]
    assert [r.key for r in I.new_only(listing, store, ["key"]).collect()] == ["b"]


def test_places_out_of_range_stop_the_job(spark):
    schema = "source string, page long, pos long, key string"
    wide = spark.createDataFrame([("a", 2**31, 0, "x"), ("a", 0, 0, "x")], schema)
    with pytest.raises(Exception, match="out of range"):
        I.take_until_known(wide, None, "key", ["page", "pos"], ["source"]).collect()
    edge = spark.createDataFrame([("a", 2**31 - 1, 2**32 - 1, "x"), ("a", 0, 0, "y")], schema)
    assert I.take_until_known(edge, None, "key", ["page", "pos"], ["source"]).count() == 2


def test_exclude_all_by_category(spark):
    links = spark.createDataFrame([("oil", "1"), ("coal", "1"), ("coal", "2")], "category string, article_id string")
    own = spark.createDataFrame([("oil", "1")], "category string, article_id string")
    got = I.exclude_all(links, [own], keys=["category", "article_id"]).collect()
    assert sorted(map(tuple, got)) == [("coal", "1"), ("coal", "2")]


def test_upsert_demands_an_order(spark):
    df = spark.createDataFrame([("a", 1)], "key string, v int")
    with pytest.raises(ValueError):
        I.upsert(df, df, ["key"], [])


def test_backfill_twice_is_once(spark):
    store = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, url string")
    bodies = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("a", "two", 2)], "key string, body string, seq int")
    got = I.backfill(store, bodies, "key", ("body",), ["seq"])
    assert sorted(map(tuple, got.collect())) == [("a", "x", "two"), ("b", "y", None)]
    again = I.backfill(got, bodies.filter("seq = 1"), "key", ("body",), ["seq"])
    assert again.count() == 2 and again.filter("key = 'a'").first().body == "one"


def test_null_keys_are_keys(spark):
    """Listings without topics: what the store holds does not come again."""
    schema = "source string, topic string, article_id string, page int, pos int"
    listing = spark.createDataFrame([("s", None, "1", 1, 1), ("s", None, "2", 1, 2), ("s", "t", "1", 1, 1)], schema)
    store = listing.filter("article_id = '2'")
    part = ["source", "topic"]
    assert I.new_only(listing, store, [*part, "article_id"]).count() == 2
    assert I.pending(listing, listing, [*part, "article_id"]).count() == 0
    for mode in ("strict", "first-load"):
        got = I.take_until_known(listing, listing, "article_id", ["page", "pos"], part, mode)
        assert got.count() == 0
        got = I.take_until_known(listing, store, "article_id", ["page", "pos"], part, mode)
        assert sorted((str(r.topic), r.article_id) for r in got.collect()) == [("None", "1"), ("t", "1")]
    batch = listing.selectExpr("source", "topic", "article_id", "page + 1 AS page", "pos")
    for got in (I.upsert(listing, batch, [*part, "article_id"], ["page"]), I.upsert_fields(listing, batch, [*part, "article_id"], ["page"], ["page"])):
        assert sorted(r.page for r in got.collect()) == [2, 2, 2]
