from __future__ import annotations

import math
import random

import numpy as np
import pytest

from newsloom.operators import corpus as K
from newsloom.operators import trainlog as L
from newsloom.operators import vectors as V
from newsloom.sources import files as I


def test_preprocess(spark, fixture_path):
    lines = I.read_lines(spark, fixture_path("corpus.txt")).selectExpr("text", "length(text) doc_id")
    got = K.preprocess(lines, stopwords=["the", "and", "weren't"]).orderBy("doc_id").collect()
    assert [r.tokens for r in got] == [
        ["second", "line", "100", "mw"],
        ["panels", "inverter", "new"],
    ]


def test_tokens(spark):
    df = spark.createDataFrame([("It's a re-run, $5 (50 %)\n\nEnd…",)], "s string")
    got = df.select(K.tokenize("s"), K.tokenize("s", keep_breaks=False)).first()
    assert got[0] == ["It's", "a", "re-run", "$", "5", "50", "\n\n", "End"]
    assert got[1] == ["It's", "a", "re-run", "$", "5", "50", "End"]


def test_stopwords_before_lower_case(spark):
    docs = spark.createDataFrame([(1, "The THE the cat")], "doc_id int, text string")
    assert K.preprocess(docs, stopwords=["the"]).first().tokens == ["cat"]


def test_lemmatize_against_a_dict(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    table = {w: f"L{w}" for w in words if rng.random() < 0.5}
    docs = [(i, [rng.choice(words) for _ in range(rng.randrange(60))]) for i in range(30)]
    got = K.lemmatize(
        spark.createDataFrame(docs, "doc_id int, tokens array<string>"),
        spark.createDataFrame(list(table.items()), "token string, lemma string"),
    )
    assert {r.doc_id: r.tokens for r in got.collect()} == {
        i: [table.get(t, t) for t in tokens] for i, tokens in docs
    }


def test_vocabulary(spark):
    docs = spark.createDataFrame([(["a", "b"],), (["a"] * 4,)], "tokens array<string>")
    assert [tuple(r) for r in K.vocabulary(docs).collect()] == [("a", 5)]
    words = spark.createDataFrame([("a",), ("z",)], "word string")
    got = K.vocab_union(K.vocabulary(docs, 1), words)
    assert {r.token: r.n for r in got.collect()} == {"a": 6, "b": 1, "z": 1}


def test_word_vector_file(spark, fixture_path):
    got = {r.word: r.vector for r in I.read_word_vectors(spark, fixture_path("vectors.txt"), 3).collect()}
    assert got == {
        "solar": [1.0, 0.0, 0.5],
        "new york": [0.5, 0.5, pytest.approx(-1e-3)],
        "word": [None, pytest.approx(0.1), pytest.approx(0.2)],
    }


def test_nearest(spark):
    rng = random.Random(5)
    vectors = {f"w{i}": [rng.uniform(-1, 1) for _ in range(6)] for i in range(50)}
    vectors["zero"] = [0.0] * 6

    def cos(a, b):
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / norm if norm else -2

    df = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    got = [r.word for r in K.most_similar(df, "w7", 5).collect()]
    want = sorted((w for w in vectors if w != "w7"), key=lambda w: -cos(vectors[w], vectors["w7"]))
    assert got == want[:5]
    assert K.most_similar(df, "no such word").count() == 0


def test_vectors_are_repeatable_and_saved(spark, tmp_path):
    docs = spark.createDataFrame(
        [([f"t{(i * j) % 9}" for j in range(12)],) for i in range(40)], "tokens array<string>"
    )
    first = K.train_vectors(docs.coalesce(1), size=4, min_count=5, epochs=2, block=4)
    again = K.train_vectors(docs.repartition(5), size=4, min_count=5, epochs=2, block=4)
    one = {r.word: r.vector for r in first.collect()}
    assert one == {r.word: r.vector for r in again.collect()}
    assert set(one) == {r.token for r in K.vocabulary(docs).collect()}
    path = str(tmp_path / "vectors")
    I.save_vectors(first, path)
    I.save_vectors(first, path)
    assert one == {r.word: r.vector for r in I.load_vectors(spark, path).collect()}


def test_synonyms_are_nearest(spark):
    """Two words that stand among the same others, never together."""
    rng = random.Random(4)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abcdefgh"]
    docs = []
    for i in range(600):
        words = rng.choices(topics[i % 8], k=20)
        if i % 8 == 2:
            words[rng.randrange(20)] = "sofa" if i % 16 == 2 else "couch"
        docs.append((words,))
    docs.append((["lonely"] * 1,))
    df = spark.createDataFrame(docs, "tokens array<string>").repartition(4)
    vectors = K.train_vectors(df, size=16, min_count=1, block=32)
    assert vectors.count() == 8 * 12 + 3
    top = [r.word for r in K.most_similar(vectors, "sofa", 3).collect()]
    assert "couch" in top and all(w == "couch" or w.startswith("c") for w in top)
    assert {r.word: set(r.vector) for r in vectors.filter("word = 'lonely'").collect()} == {"lonely": {0.0}}


def test_factors_are_those_of_the_matrix(spark):
    """Mutual information by hand and its factors by a full decomposition."""
    rng = random.Random(6)
    # Texts of a few topics, so that the singular values differ.
    docs = [rng.choices([f"w{i}" for i in range(t, t + 6)], k=rng.randint(0, 15)) for t in rng.choices(range(12), weights=range(1, 13), k=150)]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>").repartition(3)
    words = V._written(V.number_words(K.vocabulary(df, 5)), "words")
    ids = {r.token: r.word_id for r in words.collect()}
    assert sorted(ids.values()) == list(range(len(ids)))
    count = np.zeros((len(ids), len(ids)))
    for d in docs:
        for i, a in enumerate(d):
            for b in d[i + 1 : i + 4]:
                if a in ids and b in ids:
                    count[ids[a], ids[b]] += 1
                    count[ids[b], ids[a]] += 1
    n = np.array([sum(d.count(w) for d in docs) for w in sorted(ids, key=ids.get)]) ** 0.75
    with np.errstate(divide="ignore"):
        want = np.maximum(np.log(count / count.sum() / np.outer(n, n) * n.sum() ** 2), 0)
    pairs = V._written(V.cooccurrences(df, words, 3), "pairs")
    assert {(r.i, r.j): r.n for r in pairs.collect()} == {
        (i, j): (count[i, j] if i < j else count[i, i] / 2) for i in range(len(ids)) for j in range(i, len(ids)) if count[i, j]
    }
    got = np.zeros_like(want)
    for r in V.information(pairs, words).collect():
        got[r.i, r.j] = got[r.j, r.i] = r.w
    assert np.abs(got - want).max() < 1e-5
    matrix = V._written(V.tiles(V.information(pairs, words), len(ids), 4), "tiles")
    size = 6
    blocks = V.factor(matrix, len(ids), size, 60, 1, 4, tolerance=0.0)
    x = np.zeros((len(ids), size))
    for r in blocks.collect():
        part = np.frombuffer(r.data, "<f4").reshape(-1, size)
        x[4 * r.block : 4 * r.block + len(part)] = part
    u, s, _ = np.linalg.svd(want)
    assert np.allclose(np.linalg.norm(x, axis=0) ** 2, s[:size], rtol=1e-2)
    assert np.abs(x @ x.T - u[:, :size] @ np.diag(s[:size]) @ u[:, :size].T).max() < 0.1 * s[0]


def test_rows_of_blocks_share_what_is_sent(spark):
    """A product by lots of rows is the same, and a block is sent once for each lot."""
    words, size, block = 70, 3, 4
    rng = np.random.default_rng(4)
    full = np.triu(rng.random((words, words)) * (rng.random((words, words)) < 0.3)).astype("f4")
    cells = [(int(i), int(j), float(full[i, j])) for i, j in zip(*np.nonzero(full))]
    matrix = V._written(V.tiles(spark.createDataFrame(cells, "i long, j long, w float"), words, block), "tiles")
    x = V._written(V._random_blocks(spark, words, size, block, 1), "blocks")
    got = {}
    for high in (1, V.FAN, 100):
        rows = V._product(matrix, x, words, size, block, high).collect()
        got[high] = {r.block: np.frombuffer(r.data, "<f4").reshape(-1, size) for r in rows}
    dense = np.concatenate([np.frombuffer(r.data, "<f4").reshape(-1, size) for r in sorted(x.collect(), key=lambda r: r.block)])
    want = (full + np.triu(full, 1).T) @ dense
    for blocks in got.values():
        assert blocks.keys() == set(range(-(-words // block)))
        assert all((blocks[b] == got[1][b]).all() for b in blocks)
        assert np.allclose(np.concatenate([blocks[b] for b in sorted(blocks)]), want, atol=1e-4)


@pytest.mark.parametrize("rows", [[], [([],)], [(["one"],)]])
def test_vectors_of_next_to_nothing(spark, rows):
    df = spark.createDataFrame(rows, "tokens array<string>")
    assert K.train_vectors(df, size=3, min_count=1, epochs=2).count() == sum(len(r[0]) for r in rows)


def test_regressor_learns_and_is_saved(spark, tmp_path):
    rows = [(f"solar park {i}", 1.0) for i in range(30)] + [(f"coal mine {i}", 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "text string, label double")
    model = L.train_title_regressor(df, features=256)
    path = str(tmp_path / "regressor")
    I.save_model(model, path)
    got = I.load_pipeline(path).transform(df).collect()
    assert all((r.prediction > 0.5) == (r.label > 0.5) for r in got)


def test_regressor_is_chosen_on_the_held_out_side(spark):
    rng = random.Random(2)
    rows = [(i, f"solar park {rng.random()}" if i % 2 else f"coal mine {rng.random()}", float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label double")
    model, log = L.select_title_regressor(df, features=256, path=(1.0, 0.1, 0.01, 0.5, 0.6, 0.7, 0.8), patience=2)
    entries = log.orderBy("epoch").collect()
    best = min(entries, key=lambda r: (r.eval_loss, r.epoch))
    # The path ends after two settings in a row that are no better.
    assert len(entries) == min(7, best.epoch + 3)
    assert model.stages[-1].getRegParam() == best.reg
    stop = L.early_stop(log, ["run"], patience=2).collect()
    assert not stop or stop[0].stop_epoch == entries[-1].epoch
    words = df.selectExpr("label", "split(text, ' ') AS words")
    assert all((r.prediction > 0.5) == (r.label > 0.5) for r in model.transform(words).collect())


def test_epochs_learn_stop_and_keep_the_best(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["solar", "park", "sun"] if i % 2 else ["coal", "mine", "pit"], k=6)), float(i % 2)) for i in range(400)]
    df = spark.createDataFrame([*rows, (1000, None, 1.0), (1001, "sun", None)], "doc_id int, text string, label double").repartition(3)
    model, log = L.train_epochs(df, features=64, epochs=60, batch=16)
    entries = log.orderBy("epoch").collect()
    assert len(entries) >= 5 and [r.epoch for r in entries] == list(range(1, len(entries) + 1))
    assert entries[-1].train_loss < entries[0].train_loss
    stop = L.early_stop(log, ["run"]).collect()
    assert len(entries) == 60 and not stop or stop[0].stop_epoch == len(entries)
    scored = model.transform(df.filter("label IS NOT NULL AND text IS NOT NULL"))
    assert all((r.prediction > 0.5) == (r.label > 0.5) for r in scored.collect())
    held = model.transform(L.split(df.filter("label IS NOT NULL"), "doc_id").filter("side = 'test'")).collect()
    loss = sum((r.prediction - r.label) ** 2 for r in held) / len(held)
    assert loss == pytest.approx(min(r.eval_loss for r in entries))


def test_epochs_end_when_nothing_gets_better(spark):
    """Labels by chance: the loss on the held-out side does not fall for long."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(8)), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label double")
    _, log = L.train_epochs(df, features=256, epochs=200, batch=8, rate=0.5, decay=0.0)
    last = log.count()
    best = L.best_epoch(log, ["run"]).first().best_epoch
    assert last < 200 and last == best + L.PATIENCE
    assert L.early_stop(log, ["run"]).first().stop_epoch == last


def test_epochs_without_rows(spark):
    none = spark.createDataFrame([], "doc_id int, text string, label double")
    model, log = L.train_epochs(none, features=8, epochs=5)
    assert log.count() == L.PATIENCE and not model.weights.any()


def test_text_vocabulary_is_that_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "The Sun, the SUN and a sun\n\nPark"), (2, "park It's it's"), (3, None)], "doc_id int, text string")
    for stop in (["the"], []):
        want = K.vocabulary(K.preprocess(docs, stopwords=stop), 1)
        got = K.text_vocabulary(docs, 1, stopwords=stop)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_examples(spark, fixture_path):
    from newsloom.operators.scoring import group_examples

    got = group_examples(I.read_examples(spark, fixture_path("examples.json")))
    assert {r.text: r.answers for r in got.collect()} == {"Tender out": ["fi", "pa"], "New cell": ["ti"]}


def test_shuffle_repeats(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    one = [r.doc_id for r in K.shuffled(df, 1).collect()]
    again = [r.doc_id for r in K.shuffled(df.repartition(5), 1).collect()]
    other = [r.doc_id for r in K.shuffled(df, 2).collect()]
    assert one == again and one != other and sorted(one) == list(range(100)) != one


def test_token_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "doc_id int, tokens array<string>")
    I.write_tokens(docs, str(tmp_path / "t"))
    assert sorted(map(tuple, I.read_tokens(spark, str(tmp_path / "t")).collect())) == [(1, ["a", "b"]), (2, [])]


def test_stopwords_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert K.default_stopwords() == StopWordsRemover.loadDefaultStopWords("english")
