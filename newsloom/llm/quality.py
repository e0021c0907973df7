"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by Jensen-Shannon distance. The references are
statistics of the whole corpus: the most frequent words of each language, and the mean
of both histograms over all documents of the language that pass the base rules; then
once more over those that are not far from this first mean, so that junk doesn't bend
it. A document without a language is held against all references and the nearest counts;
one whose language has no reference is not compared, and the base rules alone decide. Texts
below a minimum length are not compared either.

Every language has a reference. Its bins are the common words of the largest languages and
its own, then all other words. Words and references of the largest languages, a bounded
number, are sent to all tasks; those of the rest are a table that is joined by language.

Words are cut at ASCII white space. Null texts have no words and fail the base rules.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import ChainMap, Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import WHITE, importable, saved, with_row

#: Classes of characters; the rules' own symbols are one of them.
CLASSES = ["upper", "lower", "letter", "digit", "white", "mark", "symbol", "other"]
SYMBOLS = "#*$%&|<>"
#: Base rules: least words, most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Common words of a language; the largest languages, whose common words are bins of every
#: document and whose references every task has.
COMMON, LANGUAGES = 40, 64
#: Guards and thresholds: characters in words, words, distances from 0 to 1.
LEAST_CHARS, LEAST_COMMON = 200, 100
MOST_CLASS, MOST_COMMON = 0.21, 0.4
#: Rows made a matrix at once; references of the rest that texts without a language meet at once.
_ROWS, _SENT = 512, 1024

_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of every code point, by Unicode's general categories."""
    if not _TABLE:
        kinds = {"Lu": 0, "Lt": 0, "Ll": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Me": 2}
        first = {"N": 3, "Z": 4, "P": 5, "S": 6, "C": 7}
        table = np.empty(sys.maxunicode + 1, np.uint8)
        for i in range(sys.maxunicode + 1):
            c = unicodedata.category(chr(i))
            table[i] = kinds[c] if c in kinds else first[c[0]]
        table[[ord(c) for c in WHITE]] = 4
        table[[ord(c) for c in SYMBOLS]] = 6
        _TABLE.append(table)
    return _TABLE[0]


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(class_table()[points], minlength=len(CLASSES))


def repeated_words(words: list) -> int:
    """Words in three-word windows that are found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def per_million(counts: np.ndarray) -> np.ndarray:
    """Each row as whole millionths of its sum."""
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return counts * 1_000_000 // total


def distances(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``counts`` to each reference.

    A histogram without counts is at distance 1.
    """
    def shares(x):
        total = x.sum(-1, keepdims=True)
        return np.divide(x, total, out=np.zeros(x.shape), where=total > 0), total[..., 0] > 0

    (p, some), (q, there) = shares(counts.astype(float)), shares(references.astype(float))
    out = np.ones((len(p), len(q)))
    log = lambda x: np.log2(x, out=np.zeros_like(x), where=x > 0)
    own = (p * log(p)).sum(1)
    for k in np.flatnonzero(there):
        middle = (p + q[k]) / 2
        both = (own + (q[k] * log(q[k])).sum()) / 2 - (middle * log(middle)).sum(1)
        out[:, k] = np.where(some, np.sqrt(np.clip(both, 0, 1)), 1.0)
    return out


def common_words(docs: DataFrame, common: int = COMMON, languages: int | None = None) -> tuple[dict[str, list[str]], DataFrame | None]:
    """The most frequent words of each language, counted over the whole corpus.

    Ties go to the lesser word. Those of the ``LANGUAGES`` languages with most words reach
    the driver; the rest are a table ``lang, words``, None if there are no more. With a
    number of ``languages``, only so many have words at all.
    """
    text = F.translate(F.col("text").cast("string"), WHITE, " " * len(WHITE))
    word = F.explode(F.split(text, " +")).alias("word")
    counts = (
        docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), word)
        .where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    counts = saved(counts, "word-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang")
    most = LANGUAGES + 1 if languages is None else min(languages, LANGUAGES + 1)
    largest = [r.lang for r in total.limit(most).collect()]
    more, largest = len(largest) > LANGUAGES, largest[:LANGUAGES]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.where(F.col("lang").isin(largest)).withColumn("rank", rank).where(F.col("rank") <= common)
    out: dict[str, list[str]] = {}
    for r in top.select("lang", "word").orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.word)
    if not more:
        return out, None
    rest = counts.where(~F.col("lang").isin(largest))
    if languages is not None:
        rest = rest.join(total.limit(languages).select("lang"), "lang", "left_semi")
    rest = rest.withColumn("rank", rank).where(F.col("rank") <= common)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return out, saved(rest.groupBy("lang").agg(ranked["word"].alias("words")), "rest-words")


_STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, classes array<long>, places array<int>, counts array<long>"
)


def measure(docs: DataFrame, words: list[str], own: DataFrame | None = None) -> DataFrame:
    """Base counts and both histograms of every text, beside ``doc_id, lang, hash``.

    ``counts`` has the counts of the bins ``places``, the others are empty: each of
    ``words``, then all other words, then those of ``own`` (``lang, words``) that are not
    among ``words``.
    """
    importable(docs.sparkSession)
    place = {w: i for i, w in enumerate(words)}
    names = [c.split()[0] for c in _STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, mine in zip(batch["text"], batch["words"] if "words" in batch else repeat(None)):
                text = text or ""
                parts = _words(text)
                base = base_counts(text, parts)
                failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
                bins = place if mine is None else ChainMap(place, _own_bins(mine, place))
                found = {bins[word]: n for word, n in Counter(parts).items() if word in bins}
                found[len(place)] = len(parts) - sum(found.values())
                rows.append((*base, failed, class_counts(text).tolist(), list(found), list(found.values())))
            out = pd.DataFrame(rows, columns=names)
            for name in ("doc_id", "lang", "hash"):
                out[name] = batch[name].array
            yield out

    keyed = _keyed(docs)
    if own is not None:
        keyed = keyed.join(own, "lang", "left")
    got = keyed.mapInPandas(run, f"doc_id string, lang string, hash string, {_STATS}")
    return got.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("hash", F.col("hash").cast("long"))


_BLANK = {ord(c): " " for c in WHITE}


def _words(text: str) -> list[str]:
    return [p for p in text.translate(_BLANK).split(" ") if p]


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, hash, text``, ids and hashes as text for Python functions."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.xxhash64(text).cast("string").alias("hash"), text.alias("text"),
    )


def _own_bins(own: Iterable[str], place: dict[str, int]) -> dict[str, int]:
    """The bins of a language's own words, after those of ``place`` and that of other words."""
    return {w: i for i, w in enumerate((w for w in own if w not in place), len(place) + 1)}


def _dense(places: Iterable, counts: Iterable, rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width), np.int64)
    for row, at, n in zip(out, places, counts):
        row[at] = n
    return out


def _reference_rows(stats: DataFrame) -> DataFrame:
    """``lang, i, n``: sums of both histograms over all documents of each language, without zeros.

    Documents count alike, however long, as whole millionths. One row per task, language
    and bin reaches the shuffle; a task holds the sums of a bounded number of languages.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            found = [(lang, i, s[i]) for lang, s in sums.items() for i in np.flatnonzero(s)]
            sums.clear()
            return pd.DataFrame(found, columns=["lang", "i", "n"])

        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for at in range(0, len(part), _ROWS):
                    some = part[at : at + _ROWS]
                    width = 1 + max(p.max() for p in some["places"])
                    now = [np.stack(some["classes"]), _dense(some["places"], some["counts"], len(some), width)]
                    now = np.concatenate([per_million(h).sum(0) for h in now])
                    old = sums.get(lang, now[:0])
                    small, sums[lang] = sorted((old, now), key=len)
                    sums[lang][: len(small)] += small
                if len(sums) > LANGUAGES:
                    yield rows()
        yield rows()

    good = stats.select("lang", "classes", "places", "counts")
    return good.mapInPandas(run, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n"))


def references(stats: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The mean of both histograms over all documents of each of ``languages`` in ``stats``, on the driver."""
    rows = _reference_rows(stats.where(F.col("lang").isin(languages))).collect()
    found = sorted({r.lang for r in rows})
    width = max((r.i for r in rows), default=-1) + 1
    table = np.zeros((len(found), width), np.int64)
    for r in rows:
        table[found.index(r.lang), r.i] = r.n
    return table[:, : len(CLASSES)], table[:, len(CLASSES) :], found


def rest_references(stats: DataFrame, rest: DataFrame) -> DataFrame:
    """``lang, words, at, n`` for each language of ``rest`` in ``stats``: the mean of both histograms, as a table."""
    listed = F.collect_list(F.struct("i", "n"))
    rows = _reference_rows(stats).groupBy("lang").agg(listed["i"].alias("at"), listed["n"].alias("n"))
    return saved(rest.join(rows, "lang"), "rest-references")


_JUDGED = f"doc_id string, lang string, hash string, {_STATS}, class_distance double, common_distance double, kept boolean"


def _judged(stats: DataFrame, reference: Callable[[pd.Series], tuple[np.ndarray, np.ndarray] | None]) -> DataFrame:
    """``stats`` against the references that ``reference`` has for a row; rows of one language have the same."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            far = np.full((2, len(batch)), np.nan)
            codes = pd.factorize(batch["lang"])[0]
            order = np.argsort(codes, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                found = reference(batch.iloc[same[0]])
                for at in range(0, len(same) if found else 0, _ROWS):
                    rows = same[at : at + _ROWS]
                    some = batch.iloc[rows]
                    width = max(found[1].shape[1], 1 + max(p.max() for p in some["places"]))
                    common = np.pad(found[1], ((0, 0), (0, width - found[1].shape[1])))
                    far[0, rows] = distances(np.stack(some["classes"]), found[0]).min(1)
                    far[1, rows] = distances(_dense(some["places"], some["counts"], len(some), width), common).min(1)
            kept = ~batch["base_failed"].to_numpy()
            out = batch.drop(columns=["at", "n"], errors="ignore")
            for name, one, size, least, most in (
                ("class", far[0], "word_chars", LEAST_CHARS, MOST_CLASS),
                ("common", far[1], "n_words", LEAST_COMMON, MOST_COMMON),
            ):
                long_enough = batch[size].to_numpy() >= least
                out[f"{name}_distance"] = np.where(long_enough, one, np.nan)
                kept &= ~(long_enough & (one > most))
            out["kept"] = kept
            yield out

    keyed = stats.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("hash", F.col("hash").cast("string"))
    got = keyed.mapInPandas(run, _JUDGED)
    return got.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("hash", F.col("hash").cast("long"))


def judge(stats: DataFrame, classes: np.ndarray, common: np.ndarray, languages: list[str]) -> DataFrame:
    """``stats`` with ``class_distance, common_distance, kept``.

    A distance is null where a guard or the lack of references leaves it out.
    """
    place = {lang: i for i, lang in enumerate(languages)}

    def reference(row: pd.Series):
        if pd.isna(row["lang"]):
            return (classes, common) if place else None
        # A foreign reference says nothing about a language without one.
        i = place.get(row["lang"])
        return None if i is None else (classes[i : i + 1], common[i : i + 1])

    return _judged(stats, reference)


def judge_rest(stats: DataFrame, table: DataFrame) -> DataFrame:
    """``judge`` with the references of ``rest_references``, joined by language."""
    def reference(row: pd.Series):
        if row["at"] is None:
            return None
        whole = _dense([row["at"]], [row["n"]], 1, max(row["at"].max() + 1, len(CLASSES)))
        return whole[:, : len(CLASSES)], whole[:, len(CLASSES) :]

    return _judged(stats.join(table.select("lang", "at", "n"), "lang", "left"), reference)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a bin adds to the squared Jensen-Shannon distance, beyond half of its share in ``q``.

    Nothing where ``p`` is zero, so that only a text's own bins are worked out.
    """
    part = lambda x: x * np.log2(x, out=np.zeros_like(x), where=x > 0)
    return (part(p) + part(q)) / 2 - part((p + q) / 2) - q / 2


def nearest_of_rest(docs: DataFrame, words: list[str], table: DataFrame) -> DataFrame:
    """``doc_id, hash, class_near, common_near``: the least distances of texts to any reference of ``table``.

    Null below the guards. The references are sent in parts of about ``_SENT`` languages,
    one pass over ``docs`` each.
    """
    importable(docs.sparkSession)
    place, other = {w: i for i, w in enumerate(words)}, len(words)
    lots = -(-table.count() // _SENT)

    def near(k: int) -> DataFrame:
        rows = table.where(F.pmod(F.xxhash64("lang"), F.lit(lots)) == k).collect()
        classes, common = np.zeros((len(rows), len(CLASSES)), np.int64), np.zeros((len(rows), other + 1))
        own: dict[str, list[tuple[int, float]]] = {}
        for i, r in enumerate(rows):
            bins = dict(zip(r.at, r.n))
            total = sum(n for at, n in bins.items() if at >= len(CLASSES))
            for at, n in bins.items():
                if at < len(CLASSES):
                    classes[i, at] = n
                elif at - len(CLASSES) <= other:
                    common[i, at - len(CLASSES)] = n / total
            for word, at in _own_bins(r.words, place).items():
                own.setdefault(word, []).append((i, bins.get(at + len(CLASSES), 0) / total))
        shared = docs.sparkSession.sparkContext.broadcast((classes, common, own))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            classes, common, own = shared.value
            for batch in batches:
                far = np.full((2, len(batch)), np.nan)
                for i, text in enumerate(batch["text"] if len(classes) else ()):
                    parts = _words(text)
                    if sum(map(len, parts)) >= LEAST_CHARS:
                        far[0, i] = distances(class_counts(text)[None], classes).min()
                    if len(parts) >= LEAST_COMMON:
                        count = Counter(parts)
                        at = [place[w] for w in count if w in place]
                        n = np.array([count[w] for w in count if w in place], float)
                        left = np.full(len(common), len(parts) - n.sum())
                        square = 0.5 + _gain(np.broadcast_to(n / len(parts), (len(common), len(n))), common[:, at]).sum(1)
                        for word in own.keys() & count.keys():
                            some, shares = map(np.array, zip(*own[word]))
                            left[some] -= count[word]
                            square[some] += _gain(np.full(len(some), count[word] / len(parts)), shares)
                        square += _gain(left / len(parts), common[:, other])
                        far[1, i] = np.sqrt(np.clip(square, 0, 1)).min()
                yield pd.DataFrame({"doc_id": batch["doc_id"], "hash": batch["hash"], "class_near": far[0], "common_near": far[1]})

        rows = _keyed(docs).where("text IS NOT NULL").select("doc_id", "hash", "text")
        return saved(rows.mapInPandas(run, "doc_id string, hash string, class_near double, common_near double"), "rest-near")

    got = reduce(DataFrame.union, map(near, range(lots)))
    got = got.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("hash").cast("long").alias("hash"))
    return got.agg(F.min("class_near").alias("class_near"), F.min("common_near").alias("common_near"))


def _with_nearest(judged: DataFrame, near: DataFrame) -> DataFrame:
    """``judged`` with the lesser one of its distances and those of ``near``, and the verdict by them."""
    near = near.select(F.col("doc_id").alias("id"), F.col("hash").alias("text_hash"), "class_near", "common_near")
    rows = judged.join(near, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    far = {f"{x}_distance": F.least(f"{x}_distance", f"{x}_near") for x in ("class", "common")}
    bad = [F.coalesce(F.col(f"{x}_distance") > most, F.lit(False)) for x, most in (("class", MOST_CLASS), ("common", MOST_COMMON))]
    rows = rows.withColumns(far).withColumn("kept", ~F.col("base_failed") & ~bad[0] & ~bad[1])
    return rows.select(judged.columns)


def assess(docs: DataFrame) -> DataFrame:
    """Base counts, distances and verdict, one row per row of ``docs``.

    Columns: ``doc_id, lang, hash`` (of the text), the base counts, ``base_failed``, both
    distances and ``kept``. Rows of equal ids are judged by their own text and language.
    """
    words, rest = common_words(docs)
    union = sorted({w for ws in words.values() for w in ws})
    lang = F.col("lang").cast("string")
    large = F.lit(True) if rest is None else lang.isNull() | lang.isin(list(words))
    stats = saved(measure(docs.where(large), union), "quality")
    first = judge(stats, *references(stats.where("NOT base_failed"), sorted(words)))
    # Written, so that no task has two Python functions in a row: each has a worker.
    first = saved(_kept(first), "quality-kept")
    again = references(first, sorted(words))
    if rest is None:
        return judge(stats, *again).drop("classes", "places", "counts")
    small = saved(measure(docs.where(~large), union, rest), "quality-rest")
    first = judge_rest(small, rest_references(small.where("NOT base_failed"), rest))
    table = rest_references(saved(_kept(first), "quality-rest-kept"), rest)
    told = judge(stats.where("lang IS NOT NULL"), *again).unionByName(judge_rest(small, table))
    untold = judge(stats.where("lang IS NULL"), *again)
    if not table.isEmpty():
        untold = _with_nearest(untold, nearest_of_rest(docs.where(lang.isNull()), union, table))
    return told.unionByName(untold).drop("classes", "places", "counts")


def _kept(judged: DataFrame) -> DataFrame:
    return judged.where("kept").select("lang", "classes", "places", "counts")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    Rows find their verdict by id, language and text.
    """
    good = assess(docs).where("kept").select("doc_id", "lang", "hash").distinct()
    text = F.col("text").cast("string")
    rows = with_row(docs, doc_id=F.col("doc_id").cast("long"), lang=F.col("lang").cast("string"), hash=F.xxhash64(text))
    same = [rows[c].eqNullSafe(good[c]) for c in ("doc_id", "lang", "hash")]
    return rows.join(good, same, "left_semi").select("row.*")
