"""Packed counts and factors against dense matrices, and what they leave on disk."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from newsloom.operators import corpus as K
from newsloom.operators import packed as P
from newsloom.operators import vectors as V
from newsloom.plans import all_queries
from newsloom.session import work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def small(monkeypatch):
    """Several chunks, stripes, groups, strips and packed rows of next to no data."""
    for name, value in {"CHUNK": 50, "PAIRS": 64, "CELLS": 16, "STRIPE": 2000, "GROUP": 4 * 40 * 3, "STRIP": 4 * 40 * 2}.items():
        monkeypatch.setattr(P, name, value)


def _texts(n: int = 150):
    rng = random.Random(6)
    docs = [(rng.choices([f"w{i}" for i in range(t, t + 6)], k=rng.randint(0, 15)),) for t in rng.choices(range(30), weights=range(1, 31), k=n)]
    return [*docs, (None,), (["w3"] * 130,)]


def _dense(matrix: P.Matrix, pieces: dict, turn: np.ndarray) -> np.ndarray:
    found = matrix._strips(pieces, range(matrix.strips), "block int, data binary", _whole)
    rows = {r.block: np.frombuffer(r.data, "<f4").reshape(-1, matrix.size) for r in found.collect()}
    assert rows.keys() == set(range(matrix.blocks))
    return np.concatenate([rows[b] for b in sorted(rows)]) @ turn


def _whole(rows):
    for b, x, _ in rows:
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "data"])


def test_bytes_of_numbers():
    for numbers in ([0], [1, 255], [256, 7, 0], [2**32 - 1, 1], [2**40, 3]):
        data = P._narrow(np.array(numbers))
        assert P._wide(data, len(numbers)).tolist() == numbers
        assert len(data) == len(numbers) * max(1, -(-max(numbers).bit_length() // 8))


def test_matrix_times_factors_and_its_factors(spark, small):
    docs = spark.createDataFrame(_texts(), "tokens array<string>").repartition(3)
    words = V._written(V.number_words(K.vocabulary(docs, 5)), "words")
    n, size = words.count(), 6
    want = np.zeros((n, n))
    for r in V.information(V._written(V.cooccurrences(docs, words, 3), "pairs"), words).collect():
        want[r.i, r.j] = want[r.j, r.i] = r.w
    matrix = P.Matrix(docs, words, size, 3, "tokens", V.BLOCK)
    assert matrix.blocks > matrix.strips > 1 and len(matrix.groups) > 1
    assert len(os.listdir(matrix.path.removeprefix("file:"))) > 2

    x = matrix.random(1)
    dense, y = _dense(matrix, x, np.eye(size)), x
    for g in range(len(matrix.groups)):
        y = matrix.times(y, g)
    assert np.allclose(_dense(matrix, y, np.eye(size)), want @ dense, atol=1e-3)
    assert np.allclose(matrix.gram(y), (want @ dense).T @ (want @ dense), rtol=1e-4)

    got, x = _dense(matrix, *matrix.factor(3, 1, 0.0)), dense
    for _ in range(3):
        x = want @ (x @ V._orthonormal(x.T @ x))
    x = x @ V._orthonormal(x.T @ x, -0.25)
    assert np.allclose(got @ got.T, x @ x.T, atol=1e-3)


def test_only_vectors_and_words_stay_on_disk(spark):
    """Passes, pairs and cells are gone when the vectors are there."""
    docs = spark.createDataFrame(_texts(60), "tokens array<string>")
    folder = work_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    K.train_vectors(docs, size=4, min_count=1, epochs=3, block=8)
    new = set(os.listdir(folder)) - before
    left = {d for d in new for _, _, files in os.walk(os.path.join(folder, d)) if any(f.startswith("part-") for f in files)}
    assert {d.rsplit("-", 1)[0] for d in left} == {"ordered", "vector-words", "vectors"}


def test_saved_model_leaves_no_passes_on_disk(spark, tmp_path):
    docs = [(i, " ".join(d[0] or ["w0"])) for i, d in enumerate(_texts(60))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = work_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = all_queries()[0]["s12_save_model"](spark, str(tmp_path)).collect()
    assert len(rows) > 20 and {r.dim for r in rows} == {K.VECTOR_SIZE}
    left = {d for d in set(os.listdir(folder)) - before for _, _, files in os.walk(os.path.join(folder, d)) if any(f.startswith("part-") for f in files)}
    assert not [d for d in left if d.startswith(("factor", "vector-pairs", "vector-cells", "vector-tiles"))]


def test_factors_are_not_shuffled(spark, small, capsys):
    docs = spark.createDataFrame(_texts(), "tokens array<string>")
    words = V._written(V.number_words(K.vocabulary(docs, 5)), "words")
    matrix, seen = P.Matrix(docs, words, 6, 3, "tokens", V.BLOCK), []
    x = matrix.random(1)
    matrix._pieces = lambda rows, groups, strips: seen.append(rows) or {}
    matrix.times(x, 0)
    seen[0].explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Exchange" not in plan
    with P._apart(spark):
        assert seen[0].rdd.getNumPartitions() == matrix.strips > 1
