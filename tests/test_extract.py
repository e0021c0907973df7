from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup as M
from newsloom.operators import extract as E
from newsloom.sources import payloads as P


def test_anchors(page):
    rows = E.extract_anchors(page("newsletter_page.html")).orderBy("pos").collect()
    assert [r.text for r in rows] == [
        "First story",
        "Again the first",
        "Read More",
        "Two at once",
        "No target",
        "About",
        "",
    ]
    assert rows[0].href.endswith("%2F11&mailer_id=5")


def test_ec_listing(page):
    rows = E.extract_listing(page("listing_li.html"), "ec").orderBy("pos").collect()
    assert [(r.article_id, r.title, r.url, r.pos) for r in rows] == [
        ("111", "Title & one", "/solar/articleshow/111.cms", 0),
        ("222", "Two", "/solar/articleshow/222.cms?a=1", 2),
    ]


def test_eec_listing(spark, fixture_path):
    payload = spark.read.text(fixture_path("ajax.json"), wholetext=True)
    pages = P.listing_pages(payload.withColumnRenamed("value", "payload"))
    rows = E.extract_listing(pages, "eec").orderBy("pos").collect()
    base = "https://energy.economictimes.indiatimes.com"
    assert [(r.article_id, r.url, r.title, r.summary) for r in rows] == [
        ("55", base + "/news/one/55?src=x", "One story", "Lead one"),
        ("56", base + "/news/two/56", "Two", "Lead two"),
    ]


def test_saur_listing(page):
    row = E.extract_listing(page("listing_article.html"), "saur").first()
    assert row.article_id == "post-77"
    assert (row.title, row.url) == ("Title77", "https://s.example/77")
    assert row.date_published == "Thu, Aug 1st, 2024"
    assert (row.author, row.summary) == ("Ann", 'Sum "77"')


ITEM = (
    '<div class="article-preview"><div class="x"><h2 class="entry-title">'
    '<a href="/{n}">Title {n}</a></h2></div>'
    '<time class="entry-published updated" datetime=" 2024-08-0{n} "></time>'
    '<span class="entry-author">A</span>{lead}</div>'
)
LEAD = '<div class="article-lead-text"><div>ad</div><p>Lead</p></div>'


def preview_page(spark, *items):
    html = '<div class="wrap">' + "".join(items) + "</div>"
    return spark.createDataFrame([(1, html)], "page_id int, html string")


def test_preview_listing(spark):
    bare = '<div class="article-preview"><p>no heading</p></div>'
    pages = preview_page(
        spark, ITEM.format(n=1, lead=LEAD), bare, ITEM.format(n=2, lead="")
    )
    rows = E.extract_listing(pages, "pvmag_us").orderBy("pos").collect()
    assert [(r.pos, r.title, r.url, r.summary) for r in rows] == [
        (0, "Title 1", "/1", "Lead"),
        (2, "Title 2", "/2", None),
    ]
    assert rows[0].date_published == "2024-08-01"
    assert rows[0].article_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "Title 1"))


def test_preview_listing_that_needs_all(spark):
    whole = preview_page(spark, ITEM.format(n=1, lead=LEAD))
    assert E.extract_listing(whole, "pvmag").count() == 1
    for broken in ('<div class="article-preview"></div>', ITEM.format(n=2, lead="")):
        with pytest.raises(Exception, match="item without"):
            E.extract_listing(preview_page(spark, broken), "pvmag").collect()


def test_preview_listing_without_a_date_stops(spark):
    item = ITEM.format(n=1, lead=LEAD).replace("<time", "<span").replace("</time", "</span")
    with pytest.raises(Exception, match="item without date_published"):
        E.extract_listing(preview_page(spark, item), "pvmag_global").collect()


def test_body(page):
    pages = page("article_body.html")
    container = ("div", "entry-content clearfix")
    body = E.extract_body(pages, container).first().body
    assert body == "One bold Two x Open Last"
    cut = E.extract_body(pages, container, drop_last=1).first().body
    assert cut == "One bold Two x Open"
    joined = E.extract_body(pages, container, " ", strip_each=True, squeeze=False)
    assert joined.first().body == "Onebold Two\xa0x Open Last"


def test_body_class_rules(page):
    pages = page("article_body.html")
    # One name matches any of the classes, so the first such container is taken.
    body = E.extract_body(pages, ("div", "entry-content")).first().body
    assert body == "not the exact class list"


def test_body_missing(spark, page):
    pages = page("article_body.html")
    assert E.extract_body(pages, ("div", "nothing")).first().body is None
    with pytest.raises(Exception, match="no div.nothing"):
        E.extract_body(pages, ("div", "nothing"), on_missing="raise").collect()
    none = spark.createDataFrame([(1, None)], "page_id int, html string")
    assert E.extract_body(none, ("div", "x"), on_missing="raise").first().body is None


def test_body_drop_last_of_one(spark):
    one = spark.createDataFrame([("<div><p>only</p></div>",)], "html string")
    assert E.extract_body(one, ("div", None), drop_last=1).first().body == ""


def test_tags(spark, page):
    pages = E.extract_body(page("article_body.html"), ("div", "entry-content clearfix"))
    assert E.extract_tags(pages, ("div", "entry-tags")).first().key_words == ["solar", "r & d"]
    assert E.extract_tags(pages, ("div", "no-tags")).first().key_words == []
    bodiless = pages.withColumn("body", F.lit(None).cast("string"))
    assert E.extract_tags(bodiless, ("div", "entry-tags")).first().key_words is None


def test_jsonld(page):
    row = E.extract_jsonld(page("article_jsonld.html"), drop_breaks=True).first()
    assert row.problem is None
    assert row.data.headline == "Real"
    assert row.data.articleBody == "linetwo"
    assert row.data.keywords == '["a","b"]'
    # With its line break inside a text the record is no JSON.
    assert E.extract_jsonld(page("article_jsonld.html")).first().problem == "bad json"


def test_jsonld_policies(spark):
    block = '<script type="application/ld+json">{}</script>'
    good = block + '<script type="application/ld+json">{"headline":"H"}</script>'
    bad = block + '<script type="application/ld+json">{"headline"</script>'
    pages = spark.createDataFrame(
        [("u1", good), ("u2", block), ("u3", bad)], "url string, html string"
    )
    ok, dead = E.apply_jsonld_policy(E.extract_jsonld(pages), "nleec")
    assert [r.url for r in ok.collect()] == ["u1"]
    assert [tuple(r) for r in dead.collect()] == [("u2", "no block")]
    ok, dead = E.apply_jsonld_policy(E.extract_jsonld(pages.filter("url <> 'u2'")), "eec")
    assert [r.url for r in ok.collect()] == ["u1"] and dead.count() == 0
    with pytest.raises(Exception, match="ec: bad json"):
        ok, _ = E.apply_jsonld_policy(E.extract_jsonld(pages.filter("url = 'u3'")), "ec")
        ok.collect()


def test_posts(spark, fixture_path):
    payload = spark.read.text(fixture_path("graphql.json"), wholetext=True)
    posts = P.explode_posts(payload.withColumnRenamed("value", "payload"))
    assert [(r.pos, r.article_id) for r in posts.orderBy("pos").collect()] == [
        (0, "p9"),
        (1, "p8"),
    ]
    row = P.post_articles(posts).collect()
    assert len(row) == 1
    assert row[0].body == "One &two three"
    assert row[0].categories == ["Solar", "Policy"]
    assert row[0].url.endswith("/nine") and row[0].author == "Ann"


def test_empty_answer_gives_no_rows(spark):
    end = '{"data": {"posts": {"nodes": []}}}'
    assert P.explode_posts(spark.createDataFrame([(end,)], "payload string")).count() == 0
    last = '{"data": {"has_reached_end": true}, "html": "<li></li>"}'
    assert P.listing_pages(spark.createDataFrame([(last,)], "payload string")).count() == 0


def test_nested_blocks_unclosed(spark):
    html = '<div class="b"><div>a</div>x</div><div class="b">y<div>z'
    df = spark.createDataFrame([(html,)], "html string")
    blocks = df.select(M.nested_blocks(F.col("html"), "div", "b")).first()[0]
    assert blocks == ['<div class="b"><div>a</div>x', '<div class="b">y<div>z']
    first = df.select(M.first_block(F.col("html"), "div", "b", nested=True)).first()[0]
    assert first == blocks[0]


def test_signs_that_are_no_tags(spark):
    html = '<p title="a > b">1 < 2 and <img alt="x > y" src=\'z\'>3 > 2</p><a href="/u" title="p > q">t</a>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert E.extract_body(df).first().body == "1 < 2 and 3 > 2"
    link = E.extract_anchors(df).first()
    assert (link.href, link.title, link.text) == ("/u", "p > q", "t")
    stray = spark.createDataFrame([(1, '<p class=x">one</p><p a="b>two</p>')], "i int, html string")
    assert E.extract_body(stray).first().body == "one two"
