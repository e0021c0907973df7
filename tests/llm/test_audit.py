"""Filter audit beside applying every order to every document."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from newsloom.llm import audit

DOCS = "doc_id long, text string, source string, mask int, n long, part string, good int, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(70)]
    texts = [None, "", " \n", "UP", "a#b", "é" * 60, "x\x85y " * 60, "THE WORD " * 40, "same " * 20_000]
    for _ in range(120):
        words = rng.choices(pool[: rng.choice((8, 40, 70))], k=rng.randint(30, 90))
        if rng.random() < 0.3:
            words[3] = rng.choice("#$%&*|")
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        texts.append(" ".join(words))
    texts += rng.choices(texts, k=80) + [texts[20]] * 70
    out = [(i, t, rng.choice(["a", "b", None, "", "hot", "hot", "hot"])) for i, t in enumerate(texts)]
    out += [(None, texts[20], "a"), (None, None, "b"), (30, texts[40], "a"), (30, texts[40], "a"), (29, texts[29], "hot")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(3)
    out = [(i, rng.randint(0, 1), rng.randint(0, 1), "x") for i in range(0, 280, 2)]
    return out + [(2, 1, None, "x"), (2, None, 1, "x"), (None, 1, 1, "x"), (9_999, 1, 1, "x")]


def brute(rows, labels):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    docs = []
    for doc, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc is not None and least[text] < doc else set()
        docs.append((source or "", fails, doc in good, doc in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = (
                    len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone),
                )
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "p", 3, "d") for r in rows], DOCS).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = [tuple(r) for r in audit.audit_filters(docs, marks).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, labels)


def test_empty_tables(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "p", 3, "d") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    assert audit.audit_filters(docs.limit(0), marks).count() == 0
    bare = audit.audit_filters(docs, marks.limit(0))
    assert bare.where("good_lost + toxic_lost > 0").count() == 0
    assert bare.count() == 600 * len({s or "" for *_, s in rows})


def test_rank_is_the_lexicographic_place():
    for n in range(1, 6):
        for rank, order in enumerate(permutations(range(n))):
            assert audit.lehmer_rank(order, n) == rank


def test_intervals_cover_each_order_once():
    """Every order removes every mask but the empty one, at exactly one step."""
    for n in range(1, 6):
        for rank, order in enumerate(permutations(range(n))):
            for mask in range(1, 1 << n):
                step = next(k for k, f in enumerate(order, 1) if mask >> f & 1)
                assert [s for m, s, a, b in audit.intervals(n) if m == mask and a <= rank < b] == [step]
        assert all(0 <= a < b <= factorial(n) for *_, a, b in audit.intervals(n))


def test_other_filters(spark):
    """Conditions are the caller's; a null condition holds not."""
    docs = spark.createDataFrame([(1, "ab", "s"), (2, "b", "s"), (3, "b", "s"), (4, None, "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = {"X": F.col("text").contains("a"), "Y": F.when(F.col("text") != "", F.col("text").contains("b"))}
    got = audit.audit(audit.masks(docs, marks, some), "XYZ").where("filter_order = 'XYZ'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.unique_fails) for r in got] == [(3, 1, 0, 0), (1, 2, 1, 1), (1, 0, 1, 0)]
