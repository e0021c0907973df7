"""Single rows of a size that only one in very many has."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup as M
from newsloom.functions import text as X
from newsloom.operators import corpus as K
from newsloom.operators import extract as E

LONG = {
    "hyphens": "a-" * 300_000,
    "words": "word " * 300_000,
    "breaks": "a \n\n\t" * 200_000,
    "entities": "&amp;x &#8377; " * 60_000,
    "percent": "%41%zz" * 150_000,
}
PAGES = {
    "open comments": "<!-- x " * 100_000,
    "open scripts": "<script> x " * 60_000,
    "open paragraphs": "<article>" + "<p>x <b>y" * 60_000,
    "open divs": "<div class='b'>" * 3_000,
    "many links": "<article>" + '<a href="/x?a=1&amp;b=2">t</a>' * 20_000 + "</article>",
    "deep divs": '<div class="b">' + "<div>x" * 30_000 + "</div>" * 30_000 + "</div>",
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_texts(spark, name):
    df = spark.createDataFrame([(1, LONG[name])], "doc_id int, text string")
    start = time.time()
    row = df.select(
        F.length(X.squeeze_ws("text")),
        F.length(X.unescape_html("text")),
        F.length(X.unquote("text")),
        X.uuid5_dns("text"),
        F.size(K.tokenize("text")),
    ).first()
    assert row[4] > 0
    docs = K.preprocess(df)
    lemmas = spark.createDataFrame([("word", "w")], "token string, lemma string")
    assert K.lemmatize(docs, lemmas).count() == 1
    assert time.time() - start < 40


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(spark, name):
    df = spark.createDataFrame([(1, PAGES[name])], "page_id int, html string")
    start = time.time()
    df.select(F.length(M.strip_noise("html"))).first()
    E.extract_body(df, ("article", None)).collect()
    E.extract_anchors(df).count()
    E.extract_body(df, ("div", "b")).select(F.length("body")).collect()
    E.extract_blocks(df, "div", "b", nested=True).select(F.length("block")).collect()
    assert time.time() - start < 40
