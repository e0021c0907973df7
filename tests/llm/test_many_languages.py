"""Quality rules where there are more languages than every task is sent references of."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import quality

LANGS = [f"l{k:02d}" for k in range(70)]


def prose(rng, k, n=120):
    return " ".join(rng.choices(["a", "on", "it", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{j}" for j in range(12))], k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for k, lang in enumerate(LANGS):
        out += [(100 * k + i, prose(rng, k, 130 - k // 2), lang) for i in range(20, 36)]
        out.append((100 * k + 5, " ".join(w.upper() + "$$##" for w in prose(rng, k).split()), lang))
        # Words of another language, in this one's letters.
        out.append((100 * k + 6, prose(rng, (k + 1) % 70), lang))
    out += [(9000 + k, prose(rng, k), None) for k in range(0, 70, 3)]
    out += [(9100, "?!$ " * 40 + prose(rng, 69).upper(), None), (9101, prose(rng, 66, 20), None), (None, prose(rng, 67), None)]
    out += [(9000, prose(rng, 71), None), (9102, None, None), (9103, None, "l69"), (9104, "", "empty"), (100 * 69, out[-1][1], "l69")]
    return out


def js(p, q):
    p, q = [np.array(x, float) / sum(x) for x in (p, q)]
    kl = lambda a, b: (a[a > 0] * np.log2(a[a > 0] / b[a > 0])).sum()
    return math.sqrt(max(0.0, (kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2))


def verdicts(rows, sent):
    """``doc_id, text`` to distances and verdict, in plain Python."""
    split = lambda text: (text or "").split()
    count = {}
    for _, text, lang in rows:
        if lang and split(text):
            count.setdefault(lang, Counter()).update(split(text))
    order = sorted(count, key=lambda x: (-count[x].total(), x))
    common = {x: [w for w, _ in sorted(count[x].items(), key=lambda y: (-y[1], y[0]))[: quality.COMMON]] for x in order}
    union = {w for x in order[:sent] for w in common[x]}
    bins = {x: sorted(union | set(common[x])) for x in order}

    def histograms(text, lang):
        words = Counter(split(text))
        own = [words[w] for w in bins[lang]]
        return quality.class_counts(text or "").tolist(), [*own, words.total() - sum(own)]

    def failed(text):
        words = split(text)
        return len(words) < 50 or 100 * quality.repeated_words(words) > 50 * len(words)

    def judged(chosen):
        refs = {}
        for _, text, lang in chosen:
            if lang:
                part = [quality.per_million(np.array([h]))[0] for h in histograms(text, lang)]
                refs[lang] = [a + b for a, b in zip(refs[lang], part)] if lang in refs else part
        out = []
        for row in rows:
            _, text, lang = row
            words, far = split(text), []
            against = [lang] if lang in refs else [] if lang else list(refs)
            for h, there in enumerate((sum(map(len, words)) >= quality.LEAST_CHARS, len(words) >= quality.LEAST_COMMON)):
                far.append(min(js(histograms(text, x)[h], refs[x][h]) for x in against) if there and against else None)
            bad = [d is not None and d > most for d, most in zip(far, (quality.MOST_CLASS, quality.MOST_COMMON))]
            out.append((row, *far, not failed(text) and not any(bad)))
        return out

    first = judged([r for r in rows if not failed(r[1])])
    return judged([r[0] for r in first if r[3]])


def close(rows):
    return Counter((i, x, *(None if d is None else round(d, 9) for d in (a, b)), kept) for i, x, a, b, kept in rows)


@pytest.mark.parametrize("sent", [64, 3])
def test_every_language_has_a_reference(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(quality, "LANGUAGES", sent)
    monkeypatch.setattr(quality, "_SENT", 4, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality.assess(docs).collect()
    by = {(r.doc_id, r.lang): r for r in got}
    for k, lang in enumerate(LANGS):
        assert by[100 * k + 21, lang].kept and not by[100 * k + 5, lang].kept and not by[100 * k + 6, lang].kept
    # A text without a language finds a language beyond the largest, too.
    assert by[9066, None].kept and by[9069, None].kept and not by[9100, None].kept
    assert close((r.doc_id, r.lang, r.class_distance, r.common_distance, r.kept) for r in got) == close(
        (r[0], r[2], *rest) for r, *rest in verdicts(rows, sent)
    )


def test_a_bound_on_languages_holds_beyond_those_sent(spark, rows, monkeypatch):
    """With a bound, the languages past it have no reference, the others do."""
    monkeypatch.setattr(quality, "LANGUAGES", 3)
    monkeypatch.setattr(quality.common_words, "__defaults__", (quality.COMMON, 8))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.assess(docs).where("lang IS NOT NULL AND common_distance IS NOT NULL").collect()
    assert {r.lang for r in got} == set(LANGS[:8])


def test_good_rows_of_many_languages_are_kept_whole(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, words int, at string")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    assert got.count() == quality.assess(docs).where("kept").count()
