from __future__ import annotations

import json

from pyspark.sql import functions as F

from newsloom.functions import scores as S
from newsloom.operators import incremental as I
from newsloom.operators import scoring as R
from newsloom.plans import acquire as A
from newsloom.plans import newsletters as NL
from newsloom.plans import titles as T
from newsloom.plans import words as W
from newsloom.sources import keyed_json as J


def articles(spark):
    rows = [("u1", "solar solar", "s"), ("u2", "coal", "s"), ("u3", "solar coal", "s"), ("u1", "solar solar", "s")]
    return spark.createDataFrame(rows, "url string, title string, source string")


SOLAR = R.lexicon_scorer({"solar": ["solar"], "notSolar": []})
THEMES = R.lexicon_scorer({k: [k, "solar"] for k in S.THEME_KEYS})


def test_solar_then_themes(spark):
    got = T.solar_then_themes(spark, articles(spark), {"a": SOLAR, "b": SOLAR}, THEMES, 0.7)
    rows = {r.url: r for r in got.collect()}
    assert len(rows) == 3 and got.count() == 4
    assert round(rows["u1"].solar_p, 4) == 0.75 and rows["u1"].pr == 0.75
    assert rows["u2"].pr is None and rows["u3"].pr is None


def test_copies_of_an_article_all_get_its_score(spark):
    got = T.solar_then_themes(spark, articles(spark), {"a": SOLAR}, THEMES, 0.7)
    assert [round(r.solar_p, 4) for r in got.collect() if r.url == "u1"] == [0.75, 0.75]


def counting(spark, answers):
    """A scorer that notes each title it is asked about and gives ``answers`` or a good one."""
    log = spark.sparkContext.accumulator(0)

    def make(config):
        def score(prompts):
            log.add(len(prompts))
            good = json.dumps({"solar": 0.5, "notSolar": 0.5})
            return [next((a for k, a in answers.items() if k in p), good) for p in prompts]

        return score

    return log, R.prompt_scorer(make, "{text}", S.SOLAR_KEYS)


def test_each_pending_title_is_asked_once(spark):
    rows = T.with_key(articles(spark))
    log, answer = counting(spark, {})
    store = T.score_articles(spark, rows.filter("url <> 'u2'"), answer)
    assert log.value == 2
    assert T.score_articles(spark, rows, answer, store=store) == store
    assert log.value == 3
    T.score_articles(spark, rows, answer, store=store)
    assert log.value == 3 and T.saved_scores(spark, store).count() == 3


def test_failed_answers_are_asked_again(spark):
    rows = T.with_key(articles(spark))
    key = rows.filter("url = 'u2'").first().article_id
    log, bad = counting(spark, {"coal": "no idea"})
    store = T.score_articles(spark, rows.filter("url <> 'u3'"), bad)
    assert log.value == 2
    got = {r.article_id: r for r in T.saved_scores(spark, store).collect()}
    assert got[key].solar is None and not got[key].valid
    T.score_articles(spark, rows.filter("url <> 'u3'"), bad, store=store)
    assert log.value == 3
    log, good = counting(spark, {})
    T.score_articles(spark, rows.filter("url <> 'u3'"), good, store=store)
    assert log.value == 1
    got = {r.article_id: r for r in T.saved_scores(spark, store).collect()}
    assert got[key].solar == 0.5 and got[key].valid and len(got) == 2
    T.score_articles(spark, rows.filter("url <> 'u3'"), good, store=store)
    assert log.value == 1


def test_words(spark, tmp_path):
    lines = tmp_path / "corpus.txt"
    lines.write_text("\n".join(["solar panel park"] * 9 + ["coal mine pit"] * 9))
    # Equal lines have equal keys and are all kept.
    lemmas = spark.createDataFrame([("panel", "board"), ("pit", "hole")], "token string, lemma string")
    tokens = W.build_corpus(spark, str(lines), str(tmp_path / "tokens"), lemmas=lemmas)
    got = sorted(" ".join(r.tokens) for r in tokens.collect())
    assert got == ["coal mine hole"] * 9 + ["solar board park"] * 9
    near = W.nearest_words(spark, tokens, "solar", 3, size=4, epochs=1, min_count=2)
    assert len({r.word for r in near.collect()} - {"solar"}) == 3


def test_link_index_and_dead_letters(spark, tmp_path):
    index = {"2024-01-01": {"oil": ["a", "b"], "coal": []}, "2024-01-02": {"oil": []}}
    (tmp_path / "nl.json").write_text(json.dumps(index, indent=4))
    want = [
        ("2024-01-01", "coal", None),
        ("2024-01-01", "oil", "a"),
        ("2024-01-01", "oil", "b"),
        ("2024-01-02", "oil", None),
    ]
    for indented in (None, False, True):
        got = J.read_link_index(spark, str(tmp_path / "nl.json"), indented)
        assert sorted(((str(r.nl_date), r.category, r.url) for r in got.collect()), key=str) == want
    (tmp_path / "errors.json").write_text('["1", "https://h/2"]')
    dead = J.read_dead_letters(spark, str(tmp_path / "errors.json"))
    links = spark.createDataFrame([("1",), ("2",)], "article_id string")
    left = I.exclude_all(links, [links.limit(0)], dead)
    assert [r.article_id for r in left.select(F.col("article_id")).collect()] == ["2"]


def landed(spark, pages):
    rows = [("pvmag_us", n, html) for n, html in enumerate(pages)]
    return spark.createDataFrame(rows, "source string, page int, html string")


def item(n):
    return (
        f'<div class="article-preview"><h2 class="entry-title"><a href="h/{n}">T{n}</a></h2>'
        f'<time class="entry-published updated" datetime="2024-01-0{n}"></time>'
        '<span class="entry-author">A</span></div>'
    )


def test_listing_then_bodies(spark):
    first = A.take_new(spark, landed(spark, [item(3) + item(2), item(2) + item(1)]), "pvmag_us", None)
    # A first load does not stop at a repeat.
    assert sorted(r.title for r in spark.read.parquet(first).collect()) == ["T1", "T2", "T3"]
    second = A.take_new(spark, landed(spark, [item(5) + item(4) + item(3) + item(6)]), "pvmag_us", first)
    titles = {r.title: r.page for r in spark.read.parquet(second).collect()}
    assert sorted(titles) == ["T1", "T2", "T3", "T4", "T5"]
    assert A.urls_to_fetch(spark, second).count() == 5
    pages = spark.createDataFrame(
        [
            ("h/1", '<div class="entry-content"><p>One</p><p>ad</p></div>'),
            ("h/2", None),
            ("h/9", "<p>nobody asked</p>"),
        ],
        "url string, html string",
    )
    third = A.fill_bodies(spark, second, pages, "pvmag_us")
    bodies = {r.title: r.body for r in spark.read.parquet(third).collect()}
    assert bodies == {"T1": "One", "T2": None, "T3": None, "T4": None, "T5": None}
    assert A.urls_to_fetch(spark, third).count() == 4
    # A page that is fetched again does not replace a body that is there.
    again = pages.withColumn("html", F.lit('<div class="entry-content"><p>X</p><p>ad</p></div>'))
    fourth = A.fill_bodies(spark, third, again, "pvmag_us")
    bodies = {r.title: r.body for r in spark.read.parquet(fourth).collect()}
    assert bodies["T1"] == "One" and bodies["T2"] == "X"


def test_api_rows_without_content_stay_unknown(spark):
    def answer(*posts):
        nodes = [
            {"id": i, "slug": i, "date": "2024-01-01", "content": c, "title": i,
             "categories": {"nodes": []}, "author": {"node": {"name": "A"}}}
            for i, c in posts
        ]
        return json.dumps({"data": {"posts": {"nodes": nodes}}})

    rows = [
        ("mercom", 0, answer(("a", "<p>x</p>"), ("b", None), ("b", "<p>y</p>"))),
        ("mercom", 1, answer(("c", "<p>z</p>"), ("a", "<p>w</p>"), ("d", "<p>v</p>"))),
    ]
    frame = spark.createDataFrame(rows, "source string, page int, payload string")
    store = spark.read.parquet(A.take_new(spark, frame, "mercom", None))
    assert {r.article_id: r.body for r in store.collect()} == {"a": "x", "b": "y", "c": "z"}


def test_article_records(spark, page):
    from newsloom.operators.extract import article_records

    pages = page("article_jsonld.html").withColumn("url", F.lit("u"))
    good, dead = article_records(pages, "ec")
    assert good.first().data.headline == "Real" and dead.count() == 0
    good, dead = article_records(pages, "eec")
    assert good.count() == 0 and dead.count() == 0


def test_saur_bodies(page):
    from newsloom.operators.extract import article_bodies

    row = article_bodies(page("article_body.html"), "saur").first()
    assert row.body == "One bold Two x Open Last" and row.key_words == ["solar", "r & d"]


def test_topics_are_cursors_of_their_own(spark):
    """One article may be listed under several topics; each topic has its own end."""

    def li(n):
        return f'<li><a class="anc" title="T{n}" href="/s/{n}.cms">x</a></li>'

    def pages(**topics):
        rows = [("ec", t, 0, "".join(map(li, ns))) for t, ns in topics.items()]
        return spark.createDataFrame(rows, "source string, topic string, page int, html string")

    def rows(store):
        got = spark.read.parquet(store).collect()
        assert len(got) == len({(r.topic, r.article_id) for r in got})
        return sorted((r.topic, int(r.article_id)) for r in got)

    store = A.take_new(spark, pages(solar=[1, 2, 5, 6], wind=[3, 1, 4]), "ec", None)
    want = [("solar", n) for n in (1, 2, 5, 6)] + [("wind", n) for n in (1, 3, 4)]
    assert rows(store) == sorted(want)
    before = set(spark.read.parquet(store).inputFiles())
    assert A.take_new(spark, pages(solar=[1, 2, 5, 6], wind=[3, 1, 4]), "ec", store) == store
    assert rows(store) == sorted(want)
    A.take_new(spark, pages(solar=[9, 1, 8], wind=[2, 7, 3]), "ec", store)
    assert rows(store) == sorted([*want, ("solar", 9), ("wind", 2), ("wind", 7)])
    assert before <= set(spark.read.parquet(store).inputFiles())


def test_a_page_landed_twice_fills_once(spark):
    store = A.take_new(spark, landed(spark, [item(2) + item(1)]), "pvmag_us", None)
    html = '<div class="entry-content"><p>{}</p><p>ad</p></div>'
    pages = spark.createDataFrame(
        [("h/1", html.format("Old"), 1), ("h/1", html.format("New"), 2)], "url string, html string, fetched int"
    )
    got = spark.read.parquet(A.fill_bodies(spark, store, pages, "pvmag_us"))
    assert {r.title: r.body for r in got.collect()} == {"T1": "New", "T2": None} and got.count() == 2


def test_a_backfill_keeps_stored_bodies(spark, tmp_path):
    """An article may stand under several topics, filled in one and not in the other."""
    store = str(tmp_path / "store")
    rows = [("a", "1", "h/1", "OLD BODY"), ("b", "1", "h/1", None), ("a", "2", "h/2", None), ("b", "2", "h/2", "KEPT")]
    spark.createDataFrame(rows, "topic string, article_id string, url string, body string").write.parquet(store)
    html = '<div class="entry-content"><p>New</p><p>ad</p></div>'
    pages = spark.createDataFrame([("h/1", None), ("h/2", html)], "url string, html string")
    got = spark.read.parquet(A.fill_bodies(spark, store, pages, "pvmag_us"))
    assert {(r.topic, r.article_id): r.body for r in got.collect()} == {
        ("a", "1"): "OLD BODY", ("b", "1"): None, ("a", "2"): "New", ("b", "2"): "KEPT",
    }


def test_rows_without_details_may_come_again(spark):
    def li(n):
        return f'<li><a class="anc" title="T{n}" href="/s/{n}.cms">x</a></li>'

    rows = [("ec", 1, li(1) + li(2)), ("ec", 2, li(2) + li(3) + li(1) + li(4))]
    pages = spark.createDataFrame(rows, "source string, page int, html string")
    details = spark.createDataFrame([("1", "H1"), ("3", "H3"), ("4", "H4")], "article_id string, headline string")
    store = spark.read.parquet(A.take_new(spark, pages, "ec", None, details))
    # 2 failed twice and stopped nothing; the second 1 did stop the listing.
    assert {r.article_id: r.headline for r in store.collect()} == {"1": "H1", "3": "H3"}


def test_newsletter_from_days_to_articles(spark):
    def link(category, n):
        return f'<a href="https://r/?url=https%3A%2F%2Fh%2Fnews%2F{category}%2F{n}&mailer_id=1">Story {n}</a>'

    def pages(**days):
        rows = [(f"2024-01-{d[1:]}", html) for d, html in days.items()]
        return spark.createDataFrame(rows, "nl_date string, html string").withColumn("nl_date", F.to_date("nl_date"))

    asked = [str(r.nl_date) for r in NL.days_to_ask(spark, None, "2024-01-01", "2024-01-03").collect()]
    assert sorted(asked) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    index = NL.add_days(spark, pages(d01=link("oil", 1) + link("coal", 2), d02="<p>none</p>"), None)
    def left():
        return sorted(str(r.nl_date) for r in NL.days_to_ask(spark, index, "2024-01-01", "2024-01-05").collect())

    # No later day has links yet, so the day without any is asked for again.
    assert left() == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]
    # A day that is done is left as it is; a new one is added, and one without a page counts as empty.
    again = NL.add_days(spark, pages(d01=link("oil", 9), d03=link("oil", 3) + link("oil", 1), d04=None), index)
    assert again == index
    assert left() == ["2024-01-04", "2024-01-05"]
    # What was empty has links by now.
    NL.add_days(spark, pages(d04=link("oil", 1)), index)
    assert left() == ["2024-01-05"]
    days = spark.read.parquet(index).filter("url IS NOT NULL").groupBy("nl_date").count().collect()
    assert {str(r.nl_date): r["count"] for r in days} == {"2024-01-01": 2, "2024-01-03": 2, "2024-01-04": 1}

    sibling = spark.createDataFrame([("3",)], "article_id string")
    links = NL.links_to_fetch(spark, index, None, [sibling])
    assert sorted((r.category, r.article_id) for r in links.collect()) == [("coal", "2"), ("oil", "1")]
    record = '<script type="application/ld+json">{}</script><script type="application/ld+json">{"headline": "H"}</script>'
    fetched = links.select("url", F.when(F.col("article_id") == "1", record).otherwise("<p>gone</p>").alias("html"))
    store, dead = NL.add_articles(spark, links, fetched.unionByName(fetched), None)
    got = spark.read.parquet(store).collect()
    assert [(r.category, r.article_id, r.data.headline) for r in got] == [("oil", "1", "H")]
    assert [tuple(r) for r in dead.collect()] == [("2", "no block")]
    assert NL.links_to_fetch(spark, index, store, [sibling], dead).count() == 0


def test_details_are_merged_into_a_listing(spark):
    listing = spark.createDataFrame([("1", "a"), ("2", "b")], "article_id string, title string")
    details = spark.createDataFrame([("1", "x"), ("1", None), ("9", "y")], "article_id string, data string")
    got = sorted(map(tuple, NL.merge_details(listing, details).collect()))
    assert got == [("1", "a", "x"), ("2", "b", None)]
