from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from newsloom.functions import scores as S
from newsloom.operators import scoring as R


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "s string").select(expr).first()[0]


@pytest.mark.parametrize(
    "answer, ok, scores",
    [
        ('{"solar": 0.9, "notSolar": 0.1}', True, (0.9, 0.1)),
        ('{"solar":0.9,"notSolar":1e-1}', True, (0.9, 0.1)),
        ('{\n  "solar": 2.0 ,\n\t"notSolar": -1}\n', True, (2.0, -1.0)),
        ('{"solar": "0.4", "notSolar": "0.6"}', False, (0.4, 0.6)),
        ('{"notSolar": 0.1, "solar": 0.9}', False, (0.9, 0.1)),
        ('{"solar": 0.9, "notSolar": 0.1, "x": 1}', False, (0.9, 0.1)),
        ('{"solar": 0.9}', False, (0.9, None)),
        ('{"solar": 0.9, "notSolar": 00.1}', False, (None, None)),
        ('{"solar": high, "notSolar": 0.1}', False, (None, None)),
        ("no json", False, (None, None)),
        (None, None, (None, None)),
    ],
)
def test_answers(spark, answer, ok, scores):
    assert one(spark, answer, S.valid_scores("s", S.SOLAR_KEYS)) is ok
    got = one(spark, answer, S.parse_scores("s", S.SOLAR_KEYS))
    if None not in scores or answer in ('{"solar": 0.9}', None):
        assert (got.solar, got.notSolar) == scores
    else:
        assert got.notSolar is None or got.solar is None


def test_raise_on_a_bad_answer(spark):
    for bad in ('{"solar": 0.9}', "no json", '{"solar": "x", "notSolar": 1}'):
        with pytest.raises(Exception, match="no score"):
            one(spark, bad, S.parse_scores("s", S.SOLAR_KEYS, "raise"))
    assert one(spark, '{"solar":1,"notSolar":"0"}', S.parse_scores("s", S.SOLAR_KEYS, "raise"))


def test_range_check(spark):
    scored = S.parse_scores("s", S.SOLAR_KEYS)
    check = F.transform(F.array(scored), lambda x: S.in_range(x, S.SOLAR_KEYS))[0]
    assert one(spark, '{"solar": 1, "notSolar": 0}', check) is True
    assert one(spark, '{"solar": 1.1, "notSolar": 0}', check) is False
    assert one(spark, '{"solar": 1}', check) is False


@pytest.mark.parametrize("wrapper", sorted(S.WRAPPERS))
def test_prompt_keeps_odd_titles(spark, wrapper):
    title = "50 % more {text} for {frmt} 'x' \\ $1"
    got = one(spark, title, S.render_prompt("s", "A {frmt} B {text} C", ("k",), wrapper))
    inner = "A " + S.answer_form(("k",)) + " B " + title + " C"
    assert got == S.WRAPPERS[wrapper].replace("{prompt}", inner)


def test_template_lines():
    assert S.join_template_lines("a\nb\n{text}") == "a\n b\n {text}"


def test_payloads(spark):
    body = json.loads(one(spark, 'say "hi" %\n', S.score_payload("s")))
    assert body == {
        "prompt": 'say "hi" %\n',
        "dynatemp_range": 0.0,
        "cache_prompt": True,
        "temperature": 0.5,
    }
    api = json.loads(one(spark, "x", S.api_payload("q", F.lit(3))))
    assert api == {"query": "q", "variables": {"offset": 45, "size": 15}}
    listing = json.loads(one(spark, "oil-news", S.listing_payload("s", F.lit(2))))
    assert listing == {"cat_name": "oil-and-gas", "sub_cat_name": "", "is_ajax": True, "page": 2}


def test_gate_and_budget(spark):
    rows = spark.range(20).select("id", (F.col("id") % 2 == 1).alias("ok"))
    eligible = rows.filter("ok")
    got = sorted(r.id for r in R.budget(eligible, "id", 10).collect())
    assert got == [1, 3, 5, 7, 9, 11]
    assert R.budget(eligible, "id", 100).count() == 10
    scored = spark.createDataFrame([(1, 0.69), (2, 0.6899), (3, None)], "id int, solar_p double")
    assert [r.id for r in R.gate(scored).collect()] == [1]


def make_counter(config):
    def score(prompts):
        return [json.dumps({"solar": len(p) / config["by"], "notSolar": 0}) for p in prompts]

    return score


def titles(spark, n=8):
    return spark.createDataFrame(
        [(str(i), "t" * i, i / 10) for i in range(n)], "article_id string, title string, solar_p double"
    )


def test_mapped_scorer_sees_only_what_it_has_to(spark):
    R.register_scorer("length", make_counter)
    done = spark.createDataFrame([("7",)], "article_id string")
    answer = R.prompt_scorer("length", "{text}", S.SOLAR_KEYS, "mistral", {"by": 1.0}, partitions=3)
    got = R.score_titles(
        titles(spark), S.SOLAR_KEYS, answer, done=done, gate_on="solar_p", threshold=0.4
    )
    extra = len("<s>[INST][/INST]")
    assert {r.article_id: r.solar for r in got.collect()} == {
        str(i): float(i + extra) for i in (4, 5, 6)
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    top, below = plan.split("MapInPandas", 1)
    assert "solar_p" in below and "solar_p" not in top


def test_nested_prompts(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "bb"]), (2, []), (3, None), (4, ["ccc"])], "id int, prompts array<string>"
    )
    got = R.map_nested_answers(rows, make_counter, {"by": 1.0}).collect()
    answers = {r.id: r.answers for r in got}
    assert [json.loads(a)["solar"] for a in answers[1]] == [1.0, 2.0]
    assert answers[2] == [] and answers[3] is None and len(answers[4]) == 1


def test_many_models_and_pool(spark):
    models = {
        "one": R.lexicon_scorer({"solar": ["t"], "notSolar": []}),
        "two": R.prompt_scorer(make_counter, "{text}", S.SOLAR_KEYS, config={"by": 100.0}),
    }
    long = R.score_many(titles(spark, 3), S.SOLAR_KEYS, models)
    assert long.count() == 3 * 2 * 2
    wide = R.wide_by_model(long, ["one", "two"])
    assert set(wide.columns) == {"article_id", "label", "one", "two"}
    by_key = {}
    for r in long.filter("label = 'solar'").collect():
        by_key.setdefault(r.article_id, []).append(min(max(r.p, 1e-6), 1 - 1e-6))
    for r in R.pool(long).collect():
        odds = sum(math.log(p / (1 - p)) for p in by_key[r.article_id]) / 2
        assert r.solar_p == pytest.approx(1 / (1 + math.exp(-odds)))


def test_resume_and_save(spark):
    articles = spark.createDataFrame([("1",), ("2",)], "article_id string")
    fresh = R.resume(articles, None, ["article_id"], ("solar",))
    assert [r.solar for r in fresh.collect()] == [None, None]
    saved = spark.createDataFrame([("1", 0.5)], "article_id string, solar double")
    again = R.resume(articles, saved, ["article_id"], ("solar",)).orderBy("article_id")
    assert [r.solar for r in again.collect()] == [0.5, None]
    batch = spark.createDataFrame([("1", 0.7), ("2", 0.2)], "article_id string, solar double")
    merged = R.save_scores(saved, batch).orderBy("article_id")
    assert [tuple(r) for r in merged.collect()] == [("1", 0.7), ("2", 0.2)]


def test_article_key_is_stable(spark):
    df = spark.createDataFrame([("u", "s", "t"), ("u", "s", "t2")], "url string, source string, title string")
    keys = [r[0] for r in df.select(R.article_key()).collect()]
    assert len(set(keys)) == 2


def test_prompt_settings_from_tables(spark):
    shots = spark.createDataFrame([("b", "2"), ("a", "1"), ("a {text}", "0")], "text string, answer string")
    labels = spark.createDataFrame([("pr", "Policy")], "key string, name string")
    rows = spark.createDataFrame([("T {x} %",), (None,)], "title string")
    prompt = S.render_prompt(
        "title", "{labels}{examples}Title: {text}", S.SOLAR_KEYS,
        labels=S.settings_text(labels, "key", "name", "{0}: {1}\n"),
        examples=S.settings_text(shots, "text", "answer", "Title: {0}\nAnswer: {1}\n"),
    )
    want = S.render_prompt(
        "title", "{labels}{examples}Title: {text}", S.SOLAR_KEYS,
        labels={"pr": "Policy"}, examples=[("a", "1")],
    )
    got = [r[0] for r in rows.select(prompt).collect()]
    assert got[0] == (
        "<s>[INST]pr: Policy\nTitle: a\nAnswer: 1\nTitle: a {text}\nAnswer: 0\nTitle: b\nAnswer: 2\nTitle: T {x} %[/INST]"
    )
    assert got[1] is None
    assert rows.select(want).first()[0].endswith("Title: a\nAnswer: 1\nTitle: T {x} %[/INST]")
    with pytest.raises(Exception, match="more than 2 rows"):
        rows.select(S.settings_text(shots, "text", "answer", "{0}={1};", most=2)).collect()
