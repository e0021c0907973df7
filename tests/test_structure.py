"""Stores of any layout, cut into small blocks, beside Python's own reader."""

from __future__ import annotations

import json
import random

import pytest

from newsloom.sources import keyed_json as J
from newsloom.sources.structure import members

TRICKY = ["plain", "}", "{", '"', "\\", '\\"}', "a, b", "},\n    {", "[1]}", "é日本", "", "\n\t", '{"x": "}"}']


def random_store(rng, n):
    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 3:
            return rng.choice(TRICKY)
        if kind == 3:
            return rng.choice([None, True, 1, -2.5, "x" * 40])
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(TRICKY) + str(i): value(depth - 1) for i in range(rng.randrange(4))}

    return {f"{rng.choice(TRICKY)}{i}": {"v": rng.choice(TRICKY), "d": value(3)} for i in range(n)}


LAYOUTS = [
    lambda s: json.dumps(s),
    lambda s: json.dumps(s, ensure_ascii=False, separators=(",", ":")),
    lambda s: json.dumps(s, indent=4),
    lambda s: " \n" + json.dumps(s, indent=2) + "\n\n",
    lambda s: json.dumps(s, indent="\t").replace("\n", "\r\n"),
]


@pytest.fixture
def small_blocks(spark):
    """Files of a few hundred bytes then have many blocks, each read by a task."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_random_stores(spark, tmp_path, small_blocks, layout):
    rng = random.Random(layout)
    want = []
    for n in (0, 1, 2, 9, 25):
        store = random_store(rng, n)
        (tmp_path / f"s{n}.json").write_text(LAYOUTS[layout](store), encoding="utf-8", newline="")
        want += [(k, e["v"], e["d"]) for k, e in store.items()]
    got = J.read_keyed_json(spark, str(tmp_path), "v string, d variant").selectExpr("article_id", "v", "to_json(d) AS d")
    same = lambda rows: sorted((k, v, json.dumps(d, sort_keys=True)) for k, v, d in rows)
    assert same((r.article_id, r.v, None if r.d is None else json.loads(r.d)) for r in got.collect()) == same(want)


def test_one_line_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    store = {f"k{i}": {"v": f"{i}}}", "d": {"x": [i, {"y": "{"}]}} for i in range(300)}
    (tmp_path / "one.json").write_text(json.dumps(store))
    parts = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    assert parts > 50
    got = J.read_keyed_json(spark, str(tmp_path), "v string")
    assert {r.article_id: r.v for r in got.collect()} == {k: e["v"] for k, e in store.items()}


@pytest.mark.parametrize("text", ["", "  \n", "{}", " { } \n", '{"a": {}}', '{"a":{"v":"1"},"b":{"v":null}}', '{"long": {"v": "' + "x}" * 500 + '"}}'])
def test_small_and_odd_files(spark, tmp_path, small_blocks, text):
    (tmp_path / "s.json").write_text(text)
    want = json.loads(text) if text.strip() else {}
    got = J.read_keyed_json(spark, str(tmp_path / "s.json"), "v string")
    assert {r.article_id: r.v for r in got.collect()} == {k: e.get("v") for k, e in want.items()}


def test_members_that_are_no_objects(spark, tmp_path, small_blocks):
    whole = {"a": 1, "b": {"x": "}"}, "c": "te}xt", "d": [{"y": 1}, 2], "e": {"z": {}}, "f": "end}"}
    (tmp_path / "s.json").write_text(json.dumps(whole))
    got = {}
    for r in members(spark, str(tmp_path)).collect():
        got |= json.loads(r.value)
    assert got == whole
