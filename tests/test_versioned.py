"""The versioned store beside a plain dictionary, and with two writers at once."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from newsloom.plans import acquire as A
from newsloom.sources.versioned import VersionedStore

ROWS = "topic string, id int, at int, body string"


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "store"), ["topic", "id"])


def rows(spark, *given):
    return spark.createDataFrame(list(given), ROWS)


def held(store):
    got = store.read().collect()
    out = {(r.topic, r.id): (r.at, r.body) for r in got}
    assert len(out) == len(got)
    return out


def files(store):
    return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(store.path) for f in fs}


def test_random_writes_equal_a_dictionary(spark, store):
    rng = random.Random(6)
    want, before = {}, set()
    for step in range(14):
        given = [(rng.choice(["a", "b", None]), rng.randrange(8), step * 10 + i, rng.choice(["x", "y", None])) for i in range(4)]
        kind = rng.choice(["add", "add", "change", "change", "compact"]) if step else "add"
        if kind == "add":
            store.add(rows(spark, *given), ["at"])
            last = {(t, i): (at, body) for t, i, at, body in given}
            want = {**last, **want}
        elif kind == "change":
            store.change(rows(spark, *given), ["body"], ["at"])
            for t, i, _, body in given:
                if (t, i) in want:
                    want[t, i] = (want[t, i][0], body)
        else:
            store.compact()
        assert held(store) == want
        assert before <= files(store)
        before = files(store)
    versions = [e["version"] for e in store.entries()]
    assert versions == list(range(1, len(versions) + 1))


def test_changes_of_different_fields(spark, store):
    store.add(rows(spark, ("a", 1, 1, "x"), ("a", 2, 2, "y")), ["at"])
    store.change(rows(spark, ("a", 1, 7, None)), ["at"], ["at"])
    store.change(rows(spark, ("a", 1, 9, None)), ["body"], ["at"])
    store.change(rows(spark, ("a", 9, 9, "no such row")), ["body"], ["at"])
    assert held(store) == {("a", 1): (7, None), ("a", 2): (2, "y")}
    # A field that the rows do not have yet.
    store.change(rows(spark, ("a", 2, 1, "w")).withColumn("words", F.array("body")), ["words"], ["at"])
    assert {r.id: r.words for r in store.read().collect()} == {1: None, 2: ["w"]}
    # An older version is still there.
    assert {r.id: r.body for r in store.read(1).collect()} == {1: "x", 2: "y"}
    assert store.add(rows(spark, ("a", 1, 99, "late")), ["at"]) is None


def race(store, first, second):
    """``second`` happens after ``first`` has looked at the store and before it claims."""
    claim, calls = store._claim, []

    def late(version, entry):
        calls.append(version)
        if len(calls) == 1:
            second()
        return claim(version, entry)

    store._claim = late
    got = first()
    store._claim = claim
    return got, calls


def test_two_runs_at_once_add_a_key_once(spark, store):
    other = VersionedStore(spark, store.path, store.keys)
    store.add(rows(spark, ("a", 0, 0, "old")), ["at"])
    mine, theirs = rows(spark, ("a", 1, 1, "mine"), ("a", 2, 1, "mine")), rows(spark, ("a", 2, 1, "theirs"), ("a", 3, 1, "theirs"))
    got, calls = race(store, lambda: store.add(mine, ["at"]), lambda: other.add(theirs, ["at"]))
    assert calls == [2, 3] and got == 3
    assert {k[1]: v[1] for k, v in held(store).items()} == {0: "old", 1: "mine", 2: "theirs", 3: "theirs"}
    # All keys taken by the other one: nothing is left to add.
    got, _ = race(store, lambda: store.add(rows(spark, ("a", 5, 1, "mine")), ["at"]), lambda: other.add(rows(spark, ("a", 5, 1, "theirs")), ["at"]))
    assert got is None and held(store)["a", 5] == (1, "theirs")


def test_writes_during_a_compaction_are_kept(spark, store):
    other = VersionedStore(spark, store.path, store.keys)
    store.add(rows(spark, ("a", 1, 1, "x"), ("a", 2, 1, "x")), ["at"])

    def meanwhile():
        other.add(rows(spark, ("a", 3, 1, "new")), ["at"])
        other.change(rows(spark, ("a", 1, 1, "changed")), ["body"], ["at"])

    race(store, store.compact, meanwhile)
    assert {k[1]: v[1] for k, v in held(store).items()} == {1: "changed", 2: "x", 3: "new"}
    assert store.entries()[-1]["kind"] == "base" and store.entries()[-1]["upto"] == 1


def test_a_listing_and_its_bodies(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), ["source", "topic", "article_id"])
    li = lambda n: f'<li><a class="anc" title="T{n}" href="/s/{n}.cms">x</a></li>'
    pages = spark.createDataFrame([("ec", "t", 1, li(1) + li(2)), ("ec", None, 1, li(1))], "source string, topic string, page int, html string")
    assert A.add_listing(pages, "ec", store) == 1 and A.add_listing(pages, "ec", store) is None
    assert sorted((str(r.topic), r.article_id) for r in store.read().collect()) == [("None", "1"), ("t", "1"), ("t", "2")]
    store.change(store.read().filter("topic = 't' AND article_id = '1'").withColumn("body", F.lit("OLD")), ["body"], ["page"])
    html = '<div class="entry-content"><p>New</p><p>ad</p></div>'
    urls = [r.url for r in store.read().select("url").distinct().collect()]
    fetched = spark.createDataFrame([(u, html) for u in urls], "url string, html string")
    A.fill_store(store, fetched, "pvmag_us")
    assert {(str(r.topic), r.article_id): r.body for r in store.read().collect()} == {("None", "1"): "New", ("t", "1"): "OLD", ("t", "2"): "New"}
    assert A.fill_store(store, fetched, "pvmag_us") is None


def test_an_empty_store(spark, store):
    assert store.read() is None and store.version() == 0 and store.compact() is None
    assert store.add(rows(spark, ("a", 1, 1, "x")).limit(0), ["at"]) is None and store.read() is None
