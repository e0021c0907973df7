"""Scoring queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scores as S
from newsloom.operators import scoring as R
from newsloom.plans.registry import query, quote, sql_list, table

# Word lists that occur in the given texts, one stand-in for each model.
LEXICONS = {
    "gemma": ["the", "of", "and", "that"],
    "llama": ["der", "die", "und", "ist", "the"],
    "mistral": ["le", "la", "de", "que", "the", "and"],
}
THEME_LEXICONS = {
    "pr": ["the", "der", "le"],
    "mi": ["and", "und", "la"],
    "ti": ["that", "die", "de"],
    "pa": ["with", "mit", "que"],
    "fi": ["for", "ist", "un"],
}


def solar_lexicon(model: str) -> dict[str, list[str]]:
    return {"solar": LEXICONS[model], "notSolar": []}


def titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("title"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _share(words: list[str]) -> str:
    return (
        f"round((len(list_filter({_WORDS}, lambda w: list_contains({sql_list(words)}, w))) + 1)"
        f" / (len({_WORDS}) + 2), 6)"
    )


def _solar_sql(model: str) -> str:
    p = _share(LEXICONS[model])
    return f"SELECT doc_id, {p} AS solar, round(1.0 - {p}, 6) AS not_solar FROM documents"


@query(
    "m6_score_titles",
    f"""SELECT doc_id, solar, not_solar, true AS valid FROM ({_solar_sql('gemma')})
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def m6(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select("doc_id")
    scored = R.score_titles(
        titles(spark, d), S.SOLAR_KEYS, R.lexicon_scorer(solar_lexicon("gemma")), "doc_id", done
    )
    return scored.withColumnRenamed("notSolar", "not_solar")


@query(
    "m6_score_themes",
    "SELECT d.doc_id, "
    + ", ".join(f"{_share(ws)} AS {k}" for k, ws in THEME_LEXICONS.items())
    + """, true AS valid FROM documents d JOIN labels l USING (doc_id)
        WHERE quality * 0.5 + toxic * 0.25 >= 0.5""",
)
def m6_themes(spark: SparkSession, d: str) -> DataFrame:
    """Themes behind a gate on a score made of the labels."""
    solar = table(spark, d, "labels").select(
        "doc_id", (F.col("quality") * 0.5 + F.col("toxic") * 0.25).alias("solar_p")
    )
    return R.score_titles(
        R.attach_scores(titles(spark, d), solar, ["doc_id"]),
        S.THEME_KEYS,
        R.lexicon_scorer(THEME_LEXICONS),
        "doc_id",
        gate_on="solar_p",
        threshold=0.5,
    )


@query(
    "m6_save_scores",
    f"""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN s.solar ELSE CAST(l.quality AS DOUBLE) END
        AS solar FROM ({_solar_sql('gemma')}) s LEFT JOIN labels l USING (doc_id)""",
)
def m6_save(spark: SparkSession, d: str) -> DataFrame:
    """Score what is pending and write it over the saved scores."""
    saved = table(spark, d, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("solar")
    )
    batch = R.score_titles(
        titles(spark, d), S.SOLAR_KEYS, R.lexicon_scorer(solar_lexicon("gemma")), "doc_id", saved
    )
    return R.save_scores(saved, batch.select("doc_id", "solar"), "doc_id")


def _models() -> dict:
    return {m: R.lexicon_scorer(solar_lexicon(m)) for m in LEXICONS}


def many(spark: SparkSession, d: str) -> DataFrame:
    return R.score_many(titles(spark, d), S.SOLAR_KEYS, _models(), "doc_id")


def wide(spark: SparkSession, d: str) -> DataFrame:
    return R.score_wide(titles(spark, d), S.SOLAR_KEYS, _models(), "doc_id")


_MANY = " UNION ALL ".join(
    f"""SELECT doc_id, '{m}' AS model, 'solar' AS label, solar AS p FROM ({_solar_sql(m)})
        UNION ALL SELECT doc_id, '{m}', 'notSolar', not_solar FROM ({_solar_sql(m)})"""
    for m in LEXICONS
)


@query("m7_score_many", _MANY)
def m7(spark: SparkSession, d: str) -> DataFrame:
    return many(spark, d)


@query(
    "m7_wide_by_model",
    "SELECT doc_id, label, "
    + ", ".join(f"max(CASE WHEN model = '{m}' THEN p END) AS {m}" for m in LEXICONS)
    + f" FROM ({_MANY}) GROUP BY doc_id, label",
)
def m7_wide(spark: SparkSession, d: str) -> DataFrame:
    return R.models_by_label(wide(spark, d), list(LEXICONS), S.SOLAR_KEYS, "doc_id")


@query(
    "m8_pool",
    f"""SELECT doc_id, round(1 / (1 + exp(-avg(ln(q / (1 - q))))), 6) AS solar_p
        FROM (SELECT doc_id, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM ({_MANY})
              WHERE label = 'solar') GROUP BY doc_id""",
)
def m8(spark: SparkSession, d: str) -> DataFrame:
    pooled = R.pool_wide(wide(spark, d), list(LEXICONS), "solar", "doc_id")
    return pooled.select("doc_id", F.round("solar_p", 6).alias("solar_p"))


_WEAK = "CASE WHEN doc_id % 3 = 1 THEN NULL ELSE quality END"


@query(
    "m6_resume_failed",
    f"""SELECT doc_id, solar FROM ({_solar_sql('gemma')}) WHERE doc_id NOT IN
        (SELECT doc_id FROM labels WHERE {_WEAK} IS NOT NULL)""",
)
def m6_failed(spark: SparkSession, d: str) -> DataFrame:
    """Titles asked again: those without a score and those whose answer was no good."""
    saved = table(spark, d, "labels").selectExpr("doc_id", f"{_WEAK} IS NOT NULL AS valid")
    answer = R.lexicon_scorer(solar_lexicon("gemma"))
    batch = R.score_titles(titles(spark, d), S.SOLAR_KEYS, answer, "doc_id", saved)
    return batch.select("doc_id", "solar")


@query(
    "p12_gate",
    "SELECT event_id, value / (1 + value) AS solar_p FROM events WHERE value / (1 + value) >= 0.69",
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        "event_id", (F.col("value") / (1 + F.col("value"))).alias("solar_p")
    )
    return R.gate(rows)


@query(
    "o4_budget",
    """SELECT event_id, event_type FROM events WHERE value >= 10 AND (event_id <= 5000
       OR event_id = (SELECT min(event_id) FROM events WHERE value >= 10 AND event_id > 5000))""",
)
def o4(spark: SparkSession, d: str) -> DataFrame:
    eligible = table(spark, d, "events").filter("value >= 10").select("event_id", "event_type")
    return R.budget(eligible, "event_id", S.MAX_INDEX)


@query(
    "j6_attach_scores",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.attach_scores(docs, table(spark, d, "labels"), ["doc_id"])


@query(
    "j7_resume",
    """SELECT 'saved' AS kind, d.doc_id, CAST(l.quality AS DOUBLE) AS solar_p
       FROM documents d LEFT JOIN labels l USING (doc_id)
       UNION ALL SELECT 'fresh', doc_id, CAST(NULL AS DOUBLE) FROM documents""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    saved = table(spark, d, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("solar_p")
    )
    parts = [
        R.resume(docs, table_, ["doc_id"], ("solar_p",)).withColumn("kind", F.lit(kind))
        for kind, table_ in (("saved", saved), ("fresh", None))
    ]
    return parts[0].unionByName(parts[1]).select("kind", "doc_id", "solar_p")


# A few lines of settings, as a configuration file would give them.
_SHOTS = [("Tender for a 300 MW park", "pa"), ("Bank lends 20 % more", "fi")]


def _template(wrapper: str) -> str:
    labels = "".join(f"{k}: {v}\n" for k, v in S.THEMES.items())
    shots = "".join(f"Title: {t}\nAnswer: {a}\n" for t, a in _SHOTS)
    text = S.WRAPPERS[wrapper].replace("{prompt}", S.SCORE_TEMPLATE)
    return (
        text.replace("{frmt}", S.answer_form(S.THEME_KEYS))
        .replace("{labels}", labels)
        .replace("{examples}", shots)
    )


@query(
    "j8_few_shot_prompts",
    f"SELECT doc_id, replace({quote(_template('phi'))}, '{{text}}', text) AS prompt FROM documents",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    prompt = S.render_prompt(
        "text", S.SCORE_TEMPLATE, S.THEME_KEYS, "phi", labels=S.THEMES, examples=_SHOTS
    )
    return table(spark, d, "documents").select("doc_id", prompt.alias("prompt"))


_SHORTEST = "SELECT text, item_id FROM benchmark ORDER BY length(text), item_id LIMIT 3"


@query(
    "j8_examples_from_table",
    f"""SELECT conv_id, turn, '<s>[INST]Form.' || chr(10) || (SELECT string_agg('Title: ' || text || chr(10) ||
          'Answer: ' || item_id || chr(10), '' ORDER BY text, CAST(item_id AS VARCHAR)) FROM ({_SHORTEST}))
          || 'Title: ' || text || '[/INST]' AS prompt FROM conversations""",
)
def j8_table(spark: SparkSession, d: str) -> DataFrame:
    """Few-shot examples that are rows of a table: its three shortest ones."""
    few = table(spark, d, "benchmark").orderBy(F.length("text"), "item_id").limit(3)
    shots = S.settings_text(few, "text", "item_id", "Title: {0}\nAnswer: {1}\n")
    prompt = S.render_prompt("text", "Form.\n{examples}Title: {text}", S.THEME_KEYS, "mistral", examples=shots)
    return table(spark, d, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query(
    "a10_group_examples",
    """SELECT text, array_to_string(list_sort(list(DISTINCT answer)), '|') AS answers
       FROM (SELECT source AS text, lang AS answer FROM documents) GROUP BY text""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    examples = table(spark, d, "documents").select(
        F.col("source").alias("text"), F.col("lang").alias("answer")
    )
    return R.group_examples(examples).select(
        "text", F.array_join("answers", "|").alias("answers")
    )


def make_letter_counter():
    """A scorer written in Python: how often a letter occurs, and the length.

    Made inside a function, it travels to the executors whole, whether or not this
    package is installed there.
    """

    def letter_counter(config: dict):
        letter = config["letter"]

        def score(prompts: list[str]) -> list[str]:
            return [
                f'{{"solar": {p.count(letter)}, "notSolar": {len(p)}}}' for p in prompts
            ]

        return score

    return letter_counter


R.register_scorer("letter-counter", make_letter_counter())


@query(
    "d1_mapped_scorer",
    """SELECT doc_id, CAST(len(text) - len(replace(text, 'e', '')) AS DOUBLE) AS solar,
       CAST(len(text) AS DOUBLE) AS not_solar, true AS valid FROM documents""",
)
def d1(spark: SparkSession, d: str) -> DataFrame:
    def answer(rows: DataFrame) -> DataFrame:
        return R.map_answers(rows, "letter-counter", {"letter": "e"}, prompt="title")

    scored = R.score_titles(titles(spark, d), S.SOLAR_KEYS, answer, "doc_id")
    return scored.withColumnRenamed("notSolar", "not_solar")


@query(
    "d2_nested_prompts",
    """SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)),
         lambda x: '{"solar": ' || (len(x) - len(replace(x, 'a', ''))) || ', "notSolar": '
           || len(x) || '}'), '|') AS answers FROM conversations""",
)
def d2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.split("text", "\n").alias("prompts")
    )
    nested = R.map_nested_answers(rows, "letter-counter", {"letter": "a"})
    return nested.select("conv_id", "turn", F.array_join("answers", "|").alias("answers"))
