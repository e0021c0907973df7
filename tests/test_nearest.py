"""Nearest words beside all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from newsloom.operators import nearest as N


def frame(spark, rows):
    return spark.createDataFrame([(w, v and [None if x is None else float(x) for x in v]) for w, v in rows], "word string, vector array<float>")


def brute(rows, asked, k):
    good = {w: np.array(np.float32(v), float) for w, v in rows if w is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for a in asked:
        if a in good:
            cos = {w: good[a] @ v / math.sqrt((v @ v) * (good[a] @ good[a])) for w, v in good.items() if w != a}
            out[a] = sorted(cos.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in range(6):
        centre = [rng.gauss(0, 1) for _ in range(16)]
        out += [(f"w{c}-{i:02d}", [x + rng.gauss(0, 0.25) for x in centre]) for i in range(40)]
    # Copies of one vector, and one that is longer but points the same way.
    out += [(f"copy{i:03d}", out[3][1]) for i in range(150)] + [("long", [2 * x for x in out[3][1]])]
    return out + [(None, out[0][1]), ("none", None), ("zero", [0.0] * 16), ("hole", [None] + [1.0] * 15), ("nan", [float("nan")] * 16)]


ASKED = ["w0-00", "w1-05", "w0-03", "copy007", "long", "zero", "none", "w5-39"]


def asked_of(spark, rows):
    return N.unit(frame(spark, [r for r in rows if r[0] in ASKED]))


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.asked, r.place)):
        out.setdefault(r.asked, []).append((r.neighbour, r.similarity))
    return out


@pytest.mark.parametrize("sizes", [(16_384, 1024), (37, 3)])
def test_exact_lists(spark, rows, sizes):
    got = lists(N.nearest_exact(N.unit(frame(spark, rows).repartition(4)), asked_of(spark, rows), 7, *sizes))
    want = brute(rows, ASKED, 7)
    assert got.keys() == want.keys()
    for a, near in want.items():
        assert [s for _, s in got[a]] == pytest.approx([s for _, s in near], abs=1e-6)
        # Copies are told apart by name; the last place may be one of several equals.
        assert {w for w, s in got[a] if s > near[-1][1] + 1e-6} == {w for w, s in near if s > near[-1][1] + 1e-6}


def test_index_finds_most(spark, rows):
    vectors, asked = N.unit(frame(spark, rows).repartition(4)), asked_of(spark, rows)
    exact = N.nearest_exact(vectors, asked, 10)
    index = N.HashIndex(vectors, 11)
    found = index.nearest(asked, 10)
    # By similarity: which of several equal copies is named does not count.
    want, got = lists(exact), lists(found)
    hits = sum(sum(abs(s - t) < 1e-6 for (_, s), (_, t) in zip(want[a], got.get(a, []))) for a in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(a != w for a, near in got.items() for w, _ in near)
    # Every distinct vector is indexed, in every table.
    assert index.keys.count() == N.TABLES * index.points.count()
    # Of copies the least names stand for all; every other word is there.
    assert {w for r in index.points.collect() for w in r.names} >= {w for w, _ in rows if w and w.startswith("w")} - {"w0-03"}


def test_copies_make_no_pairs(spark):
    """All names of a vector are one point; the list is filled from them all the same."""
    rows = [(f"c{i:05d}", [1.0, 2.0]) for i in range(5000)] + [("other", [2.0, 1.0])]
    vectors = N.unit(frame(spark, rows))
    index = N.HashIndex(vectors, 4)
    assert index.points.count() == 2
    asked = vectors.filter("name IN ('c00000', 'c04999')")
    for df in (index.nearest(asked, 3), N.nearest_exact(vectors, asked, 3)):
        got = lists(df)
        assert [w for w, _ in got["c00000"]] == ["c00001", "c00002", "c00003"]
        assert [w for w, _ in got["c04999"]] == ["c00000", "c00001", "c00002"]


def test_nothing(spark):
    none = N.unit(frame(spark, []))
    assert N.nearest_exact(none, none, 3).count() == 0 and N.HashIndex(none, 4).nearest(none, 3).count() == 0


def sharing(vectors, asked, index, k):
    """The index's lists by pairs: points that share a key, compared one by one."""
    keys = {r.point: set(r["keys"]) for r in index.points.collect()}
    held = [(np.array(r.v), r.names, keys[r.point]) for r in index.points.collect()]
    out = {}
    for r in index.keyed(asked).collect():
        near = [(n, np.array(r.v) @ v) for v, names, own in held if own & set(r["keys"]) for n in names if n != r.name]
        out[r.name] = sorted(near, key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_index_compares_only_points_that_share_a_key(spark, rows, monkeypatch):
    """Narrow buckets find few; no pair of a word and a point is a row, in however many blocks."""
    monkeypatch.setattr(N, "POINTS", 37)
    monkeypatch.setattr(N, "ASKED", 3)
    monkeypatch.setattr(N, "HELD_ASKED", 1)
    vectors, asked = N.unit(frame(spark, rows).repartition(4)), asked_of(spark, rows)
    index = N.HashIndex(vectors, 8, tables=3, projections=6, bucket=0.3)
    found = index.nearest(asked, 7)
    got, want = lists(found), {a: near for a, near in sharing(vectors, asked, index, 7).items() if near}
    assert 0 < sum(map(len, got.values())) and got.keys() == want.keys()
    for a, near in want.items():
        assert [s for _, s in got[a]] == pytest.approx([s for _, s in near], abs=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Generate explode(keys" not in plan


def test_vectors_of_another_length_are_not_compared(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [1.0, 0.0, 0.0])]
    vectors = N.unit(frame(spark, rows))
    for df in (N.nearest_exact(vectors, vectors, 2), N.HashIndex(vectors, 3).nearest(vectors, 2)):
        assert {a: [w for w, _ in near] for a, near in lists(df).items()} == {"a": ["b"], "b": ["a"]}


def test_blocks_meet_in_any_partition(spark, rows):
    """Blocks of both sides find each other where small partitions are not joined into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lists(N.nearest_exact(N.unit(frame(spark, rows).repartition(4)), asked_of(spark, rows), 7, 37, 3))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute(rows, ASKED, 7)
    assert got.keys() == want.keys()
    for a, near in want.items():
        assert [s for _, s in got[a]] == pytest.approx([s for _, s in near], abs=1e-6)
