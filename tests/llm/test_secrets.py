"""Secret scan beside the patterns alone."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from newsloom.llm import secrets
from newsloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, spans string, hash long, doc string, rules int, grams string"
#: The contract's own words.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def every(text):
    found = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in r.compiled().finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
    return [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(found)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    parts = ["password", "PassWD", "passwd", "token", "TOKEN", "secret", "api_key", "ApiKey", "api__key", "key", "pass", "word", "ſecret", "toKen"]
    parts += [":", "=", ' "', "'", " ", "  ", "\n", "\t", "é", "日本", "abcdefgh", "AbC+/_.=-9", "short", "0123456789abcdef", "deadbeef" * 4, "DEADBEEF" * 4]
    parts += ["AKIA", "AKIA" + "Q1" * 6, "akia", "akia" + "Q1" * 8, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2ln", "ghp_" + "a1" * 18]
    parts += ["xoxb-1234567890-ab", "AIza" + "x" * 35, "sec", "ret", "tok", "ken", "crecret toke oken"]
    texts = [None, "", " ", "password=", "token: abc token=abcdefghij", "x" * 200_000 + " secret = 'abcdefgh' " + "f" * 100_000]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]
    texts += ['my password: "hunter2hunter2" here'] * 150
    out = list(enumerate(texts))
    return out + [(None, "token=abcdefgh1"), (None, None), (6, texts[6]), (6, texts[6]), (6, "secret=other-thing")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "d", 2, "g") for i, t in rows], DOCS).repartition(5)


def test_spans_equal_the_patterns(docs, rows):
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in secrets.find_secrets(docs).collect())
    assert got == Counter((i, tuple(every(t or ""))) for i, t in rows)


def test_base_spans_stay(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op13_secrets"](spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in rows:
        spans = base(t or "")
        kinds = Counter(k for k, *_ in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want[i, kinds["assign"], kinds["access"], kinds["hex"], digest] += 1
    assert got == want


def test_empty_table(docs):
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_queries_of_rules():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == secrets.ANY
    assert q["access"] == {frozenset(["aki", "kia"])}
    words = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    assert q["assign"] == {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
    assert q["google"] == {frozenset(["aiz", "iza"])} and len(q["github"]) == 5
    assert all(q[k] != secrets.ANY for k in ("private", "jwt", "slack"))


@pytest.mark.parametrize(
    ("pattern", "query"),
    [
        ("ab", [[]]), ("abc?d", [["abd"], ["abc", "bcd"]]), ("(?:abc)+x", [["abc"]]), ("(?:abc)*x", [[]]), ("abc|def", [["abc"], ["def"]]),
        ("abc|d", [[]]), ("abc.def", [["abc", "def"]]), ("a[bc]d", [["abd"], ["acd"]]), ("a[^b]cde", [["cde"]]), ("(?=xyz)abc", [["abc"]]),
        ("abc{2}d", [["abc"]]), (r"ABC\d+XYZ", [["abc", "xyz"]]), ("", [[]]), ("(?i:AbC)", [["abc"]]), ("abcd|bcd", [["bcd"]]),
    ],
)
def test_query_of_pattern(pattern, query):
    want = {frozenset(s) for s in query}
    got = secrets.trigram_query(pattern)
    # A query may ask for less than it could, never for more.
    assert all(any(g <= w for g in got) for w in want)
    if pattern not in ("abc{2}d",):
        assert got == want


def test_a_match_always_answers_the_query():
    """What a random pattern matches holds one set of its query as a whole."""
    rng = random.Random(5)

    def pattern(depth):
        if depth == 0:
            return rng.choice(["a", "b", "ab", "abc", "[ab]", "[^c]", ".", "cab", "B"])
        a, b = pattern(depth - 1), pattern(depth - 1)
        return rng.choice([a + b, f"(?:{a}|{b})", f"(?:{a})?{b}", f"(?:{a})+", f"(?:{a})*{b}", f"(?:{a}){{2}}", f"({a}){b}", f"(?i:{a}){b}"])

    hits = 0
    for _ in range(1500):
        p = pattern(rng.randint(1, 4))
        query = secrets.trigram_query(p)
        for _ in range(8):
            text = "".join(rng.choices("abcAB", k=rng.randint(0, 12)))
            if re.search(p, text, re.A):
                hits += 1
                low = text.lower()
                assert any(all(g in low for g in s) for s in query), (p, text, query)
    assert hits > 1000


def test_only_candidates_are_verified(spark):
    """Texts without a whole set of trigrams do not reach the patterns."""
    docs = spark.createDataFrame([(i, f"plain text {i} pas ass swo") for i in range(50)] + [(99, "password")], "doc_id long, text string")
    index = secrets.postings(secrets.scan(secrets._keyed(docs), secrets.RULES))
    assert [r.doc for r in secrets.candidates(index, secrets.RULES).collect()] == ["99"]
