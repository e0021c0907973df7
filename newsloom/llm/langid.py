"""Language identification by string kernels.

Two texts are as alike as the n-grams of up to ``SPECTRUM`` characters that both have:
the blended-spectrum presence kernel, normalised. Nystroem landmarks, a few texts of
each language, span the space; one-versus-rest kernel ridge regression is solved in it.
The kernel is a product of presence vectors, so that texts are scored in batches as
matrix products of their presence with the weights of the landmarks' n-grams.

Trained on a bounded sample of labelled rows; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import ids_back, importable, keyed_texts, saved, with_row

#: Longest n-grams; bits of an n-gram's hash.
SPECTRUM, BITS = 3, 20
#: Bounds of training: texts and landmarks of each language. More languages than the last
#: number stop the job: a language that is not learned could never be predicted.
SAMPLE, LANDMARKS, LANGUAGES = 300, 24, 64
RIDGE = 1e-2
#: A prediction with less is rejected.
LEAST_SCORE = 0.3
#: A prediction is sure unless its lead over the second language and its share of known
#: n-grams are both less than all but this part of the language's training rows and their
#: first ``HEAD`` characters have. The heads stand for short texts.
DOUBT, HEAD = 0.005, 100
UNKNOWN = "und"
#: Characters of a text handled at once, texts in a matrix.
_STEP, _ROWS = 1 << 20, 256
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def hashed_grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the lower-cased text, in bounded parts, with repeats."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), _STEP):
        part = points[at : at + _STEP + SPECTRUM - 1].astype(np.uint64)
        whole = np.zeros(len(part), np.uint64)
        for n in range(1, SPECTRUM + 1):
            if len(part) < n:
                break
            # An n-gram's hash goes on from that of the n-gram without its last letter.
            whole = (whole[: len(part) - n + 1] + part[n - 1 :]) * _FACTORS[n - 1]
            whole ^= whole >> np.uint64(29)
            yield (whole[:_STEP] >> np.uint64(64 - BITS) if n > 1 else whole[:_STEP] % np.uint64(1 << BITS)).astype(np.int64)


def profile(texts: list[str], columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 for each text, which of the known n-grams it has; and how many it has in all."""
    out, sizes = np.zeros((len(texts), width + 1), np.float32), np.zeros((len(texts), 1))
    seen = np.zeros(1 << BITS, bool)
    for row, size, text in zip(out, sizes, texts):
        for grams in hashed_grams(text):
            seen[grams] = True
        grams = np.flatnonzero(seen)
        seen[grams] = False
        row[columns[grams]] = 1
        size[0] = len(grams)
    return out[:, :width], np.maximum(sizes, 1)


def presence(texts: list[str], columns: np.ndarray, width: int) -> np.ndarray:
    """A row of 0 and 1 for each text: which of the known n-grams it has."""
    return profile(texts, columns, width)[0]


def leads(scores: np.ndarray) -> np.ndarray:
    """How far the best language of each row is before the second; with one language, before nothing known."""
    if scores.shape[1] < 2:
        return scores[:, 0] - 0.5
    two = np.partition(scores, -2, axis=1)[:, -2:]
    return two[:, 1] - two[:, 0]


def is_training(doc_id: Column) -> Column:
    """Whether a row may be learned from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


class Model:
    """Known n-grams, languages and the weight of each n-gram for each language.

    ``least`` has for each language the lead and the share of known n-grams; with less
    of both it is not sure.
    """

    def __init__(self, columns: np.ndarray, width: int, languages: list[str], weights: np.ndarray, least: np.ndarray):
        self.columns, self.width, self.languages, self.weights, self.least = columns, width, languages, weights, least

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores from 0 to 1 for each text and language, and whether the best one is sure.

        The norm is that of all n-grams of the text: what the model has never seen counts
        against every language.
        """
        have, size = profile(texts, self.columns, self.width)
        scores = have @ self.weights / np.sqrt(size) / 2 + 0.5
        evidence = np.c_[leads(scores), have.sum(1) / size[:, 0]]
        sure = (evidence >= self.least[scores.argmax(1)]).any(1)
        return np.clip(scores, 0, 1), sure

    def scores(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1 for each text and language."""
        return self.judge(texts)[0]


def sample(docs: DataFrame, most: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """``text, lang, rank``: of each language the ``most`` texts of least id hash.

    Only rows with an id, a language and a letter whose id is not held out. Ranks are
    limited before the shuffle and made of keys alone; the texts of the bounded number
    of keys are fetched where they are.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).where(is_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    there = rows.select("lang").distinct().limit(languages + 1).count()
    if there > languages:
        raise ValueError(f"more than {languages} languages to learn; raise the bound (and the driver's memory)")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "hash")
    keys = rows.select("lang", "doc_id", F.xxhash64("text").alias("hash"))
    ranked = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    # At most ``most`` keys of each of ``languages`` languages.
    found = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(ranked), ["lang", "doc_id", "hash"])
    return found.dropDuplicates(["lang", "rank"]).select("text", "lang", "rank")


def train(docs: DataFrame, most: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of the sample; None if there is nothing to learn from.

    Sets of n-grams of the landmarks and one row of kernel values per sampled text reach
    the driver, both bounded by the parameters.
    """
    importable(docs.sparkSession)
    chosen = saved(sample(docs, most), "language-sample")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rank, text in zip(batch["lang"], batch["rank"], batch["text"]):
                grams = np.zeros(1 << BITS, bool)
                for part in hashed_grams(text):
                    grams[part] = True
                yield pd.DataFrame([(lang, rank, np.flatnonzero(grams).astype("<i4").tobytes())], columns=["lang", "rank", "grams"])

    marks = chosen.where(F.col("rank") <= landmarks).mapInPandas(sets, "lang string, rank int, grams binary")
    marks = [np.frombuffer(r.grams, "<i4") for r in sorted(marks.collect(), key=lambda r: (r.lang, r.rank))]
    if not marks:
        return None
    known = np.unique(np.concatenate(marks))
    width = len(known)
    columns = np.full(1 << BITS, width, np.int32)
    columns[known] = np.arange(width, dtype=np.int32)
    table = np.zeros((len(marks), width), np.float32)
    for row, grams in zip(table, marks):
        row[columns[grams]] = 1
    table /= np.sqrt(table.sum(1, keepdims=True))
    shared = docs.sparkSession.sparkContext.broadcast((columns, table))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, table = shared.value
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch[at : at + _ROWS]
                out = {"lang": part["lang"], "rank": part["rank"]}
                for name, texts in (("", part["text"]), ("_head", part["text"].str[:HEAD])):
                    have, size = profile(texts.tolist(), columns, table.shape[1])
                    values = have @ table.T / np.sqrt(size)
                    out[f"k{name}"] = [v.astype("<f8").tobytes() for v in values]
                    out[f"share{name}"] = have.sum(1) / size[:, 0]
                yield pd.DataFrame(out)

    rows = chosen.mapInPandas(kernel, "lang string, rank int, k binary, share double, k_head binary, share_head double").collect()
    rows.sort(key=lambda r: (r.lang, r.rank))
    languages = sorted({r.lang for r in rows})
    k = np.stack([np.frombuffer(r.k, "<f8") for r in rows])
    y = np.where(np.array([[r.lang == lang for lang in languages] for r in rows]), 1.0, -1.0)
    # A language counts as much as any other, however many rows the sample has of it.
    weight = 1 / np.maximum((y > 0).sum(0), 1)[np.argmax(y, 1)]
    weight = (weight / weight.sum())[:, None]
    inner = table.astype(np.float64) @ table.T.astype(np.float64)
    left = k.T @ (weight * k) + ridge * inner / len(marks) + 1e-9 * np.eye(len(marks))
    found = np.linalg.solve(left, k.T @ (weight * y))
    # What is evidence enough, by the rows that are told right.
    heads = np.stack([np.frombuffer(r.k_head, "<f8") for r in rows])
    scores = np.concatenate([k, heads]) @ found / 2 + 0.5
    share = np.array([r.share for r in rows] + [r.share_head for r in rows])
    truth = np.tile(np.argmax(y, 1), 2)
    right, evidence = scores.argmax(1) == truth, np.c_[leads(scores), share]
    # Landmarks know all of their own n-grams; they tell only where there is nothing else.
    other = np.tile([r.rank > landmarks for r in rows], 2)
    least = np.full((len(languages), 2), np.inf)
    for i in range(len(languages)):
        mine = right & (truth == i)
        if (told := evidence[mine & other if (mine & other).any() else mine]).size:
            # A hair less: scores are worked out in single precision later on.
            least[i] = np.quantile(told, DOUBT, axis=0, method="lower") - 1e-4
    return Model(columns, width, languages, (table.T @ found).astype(np.float32), least)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, ``hash`` of the text and ``sure``, per row.

    ``und`` with score 0 for a null text, one without a letter, or without a model.
    ``held_out`` is false for a null id, which is not learned from either.
    """
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = keyed_texts(docs).withColumn("hash", F.xxhash64("text")).withColumn("text", F.when(has, F.col("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch[at : at + _ROWS]
                lang, score, sure = np.full(len(part), UNKNOWN, object), np.zeros(len(part)), np.zeros(len(part), bool)
                there = part["text"].notna().to_numpy()
                if model is not None and there.any():
                    found, sure[there] = model.judge(part["text"][there].tolist())
                    best = found.argmax(1)
                    lang[there] = np.array(model.languages, object)[best]
                    score[there] = found[np.arange(len(best)), best]
                yield pd.DataFrame({"doc_id": part["doc_id"], "hash": part["hash"], "lang_pred": lang, "score": score, "sure": sure})

    got = ids_back(rows.mapInPandas(run, "doc_id string, hash long, lang_pred string, score double, sure boolean"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "hash", "sure")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows of ``docs`` and predict all of them."""
    return predict(docs, train(docs))


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known well enough and sure."""
    good = identify(docs).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & F.col("sure"))
    good = good.select("doc_id", "hash").distinct()
    text = F.col("text").cast("string")
    rows = with_row(docs, doc_id=F.col("doc_id").cast("long"), hash=F.xxhash64(text))
    same = [rows[c].eqNullSafe(good[c]) for c in ("doc_id", "hash")]
    return rows.join(good, same, "left_semi").select("row.*")
