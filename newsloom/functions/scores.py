"""Prompts, request payloads and model answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import bind

# Answer keys, the answer form shown in a prompt, gate and budget.
SOLAR_KEYS = ("solar", "notSolar")
THEME_KEYS = ("pr", "mi", "ti", "pa", "fi")
SOLAR_THRESHOLD = 0.69
MAX_INDEX = 5000

# Chat markers around a prompt, by model family.
WRAPPERS = {
    "phi": (
        "\n<|system|>\nYou are a helpful assistant.<|end|>\n<|user|>\n"
        "{prompt}<|end|>\n<|assistant|>\n"
    ),
    "gemma": "<start_of_turn>user\n{prompt}<end_of_turn>\n<start_of_turn>model\n",
    "llama": (
        "\n<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n"
        "<|eot_id|><|start_header_id|>user<|end_header_id|>\n{prompt}\n"
        "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    ),
    "mistral": "<s>[INST]{prompt}[/INST]",
}

# Theme codes and their names.
THEMES = {
    "pr": "Policy and Regulation",
    "mi": "Market and Industry Trends/Developments",
    "ti": "Technology and Innovation",
    "pa": "Project Announcements/Development",
    "fi": "Finance and Investment",
}

# Our own wording; callers pass their template in its place.
SCORE_TEMPLATE = (
    "Give the probability of each category for the news title below.\n"
    "{labels}{examples}Answer with JSON of this form only:\n{frmt}\nTitle: {text}\n"
)

# Parameters every request carries.
REQUEST_OPTIONS = {"dynatemp_range": 0.0, "cache_prompt": True}

# The listing module and category name of each topic.
LISTING_CATEGORIES = {
    "renewable-news": "Renewable",
    "oil-news": "oil-and-gas",
    "coal-news": "coal",
    "power-news": "power",
}
API_PAGE_SIZE = 15


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def answer_form(keys: tuple[str, ...]) -> str:
    """The answer form shown to the model."""
    lines = ",\n".join(f'    "{k}": "number"' for k in keys)
    return "\n{\n" + lines + "\n}\n"


def join_template_lines(text: str) -> str:
    """A template file as it is used: its lines joined by a blank."""
    return " ".join(text.splitlines(keepends=True))


def render_prompt(
    title: Column | str,
    template: str,
    keys: tuple[str, ...],
    wrapper: str = "mistral",
    labels: dict[str, str] | Column | None = None,
    examples: list[tuple[str, str]] | Column | None = None,
) -> Column:
    """The whole prompt for a title.

    Answer form, label definitions and few-shot examples are settings of a few
    lines, so they go into the plan as text; only the title is filled in per row.
    It goes in last, so braces and percent signs in it stay as they are. Labels and
    examples may also be columns: the one text that ``settings_text`` makes of a table.
    """
    given = {}
    for name, value in (("labels", labels), ("examples", examples)):
        if isinstance(value, Column):
            given[name] = value
    label_text, example_text = "\x00labels\x00", "\x00examples\x00"
    if "labels" not in given:
        label_text = "".join(f"{k}: {v}\n" for k, v in (labels or {}).items())
    if "examples" not in given:
        example_text = "".join(f"Title: {t}\nAnswer: {a}\n" for t, a in (examples or []))
    filled = (
        template.replace("{frmt}", answer_form(keys))
        .replace("{labels}", label_text)
        .replace("{examples}", example_text)
    )
    filled = WRAPPERS[wrapper].replace("{prompt}", filled)
    pieces = []
    for i, part in enumerate(filled.split("{text}")):
        if i:
            pieces.append(_col(title))
        for k, piece in enumerate(part.split("\x00")):
            # Every second piece names what a column holds.
            pieces.append(given[piece] if k % 2 else F.lit(piece))
    return F.concat(*pieces)


def settings_text(rows, first: str, second: str, form: str, most: int = 200) -> Column:
    """The rows of a small table as one text, in order of their two columns.

    ``form`` has ``{0}`` and ``{1}`` for the columns. More than ``most`` rows stop the
    job: what goes into every prompt is a setting, not a corpus.
    """
    start, middle, end = (F.lit(x) for x in re.split(r"\{[01]\}", form))
    pair = F.struct(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
    few = rows.select(pair.alias("p")).orderBy("p").limit(most + 1)
    lines = F.transform(
        F.array_sort(F.collect_list("p")), lambda p: F.concat(start, p["a"], middle, p["b"], end)
    )
    many = F.raise_error(F.lit(f"more than {most} rows for a prompt")).cast("string")
    text = F.when(F.count(F.lit(1)) > most, many).otherwise(F.array_join(lines, ""))
    return few.agg(text.alias("text")).scalar()


def score_payload(prompt: Column | str, temperature: float = 0.5) -> Column:
    """JSON body of a scoring request."""
    fields = [_col(prompt).alias("prompt")]
    for name, value in {**REQUEST_OPTIONS, "temperature": temperature}.items():
        fields.append(F.lit(value).alias(name))
    return F.to_json(F.struct(*fields))


def listing_payload(topic: Column | str, page: Column | str) -> Column:
    """JSON parameters of a listing request for a topic and page."""
    topic, page = _col(topic), _col(page)
    names = F.create_map(
        *[F.lit(x) for pair in LISTING_CATEGORIES.items() for x in pair]
    )
    page_fields = [F.lit(True).alias("is_ajax"), page.alias("page")]
    return (
        F.when(topic == "all-news", F.to_json(F.struct(*page_fields)))
        .when(
            topic == "economy-news",
            F.to_json(
                F.struct(
                    F.lit("economy").alias("q"),
                    page_fields[0],
                    F.lit("").alias("action"),
                    page_fields[1],
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    names[topic].alias("cat_name"),
                    F.lit("").alias("sub_cat_name"),
                    *page_fields,
                )
            )
        )
    )


def api_payload(query: str, page: Column | str) -> Column:
    """JSON body of a paged API request; pages count from 0."""
    offset = _col(page) * F.lit(API_PAGE_SIZE)
    return F.to_json(
        F.struct(
            F.lit(query).alias("query"),
            F.struct(
                offset.alias("offset"), F.lit(API_PAGE_SIZE).alias("size")
            ).alias("variables"),
        )
    )


def parse_scores(
    answer: Column | str, keys: tuple[str, ...], on_error: str = "null"
) -> Column:
    """Struct of doubles out of a JSON answer.

    A number and a number in quotes are both read. A missing key, bad JSON or an
    unreadable number gives null for that score, or stops the job with
    ``on_error="raise"``.
    """
    answer = _col(answer)
    # As text first: a double field would turn a quoted number into null.
    texts = F.from_json(answer, ", ".join(f"`{k}` string" for k in keys))

    def read(found: Column) -> Column:
        out = []
        for k in keys:
            value = found[k].try_cast("double")
            if on_error == "raise":
                failed = F.raise_error(F.concat(F.lit(f"no score {k} in "), answer))
                value = F.when(value.isNotNull() | answer.isNull(), value).otherwise(
                    failed.cast("double")
                )
            out.append(value.alias(k))
        return F.struct(*out)

    # Bound, as each key would otherwise have the answer parsed for itself.
    return bind(texts, read)


def answer_pattern(keys: tuple[str, ...]) -> str:
    """Pattern of a well-formed answer: exactly the keys, in order, JSON numbers."""
    space = r"( |\n[ \t]{0,20})?"
    integral = r"(0|[1-9][0-9]{0,15})"
    number = rf"-?{integral}(\.[0-9]{{1,16}})?([eE][-+]?{integral})?"
    pairs = [rf'"{k}"{space}:{space}{number}{space}' for k in keys]
    body = f",{space}".join(pairs)
    return rf"\A\{{{space}{body}\}}{space}\z"


def valid_scores(answer: Column | str, keys: tuple[str, ...]) -> Column:
    """Whether the answer has exactly the form asked for."""
    return _col(answer).rlike(answer_pattern(keys))


def in_range(scores: Column, keys: tuple[str, ...]) -> Column:
    """Whether every score is a probability; the form alone allows any number."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.coalesce(scores[k].between(0.0, 1.0), F.lit(False))
    return ok


def title_words(title: Column | str) -> Column:
    """Lower-cased words of a title."""
    return F.regexp_extract_all(
        F.lower(_col(title)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)
    )


def _share(words: Column, listed: list[str]) -> Column:
    hits = F.size(F.filter(words, lambda w: w.isin(*listed)))
    return F.round((hits + F.lit(1)) / (F.size(words) + F.lit(2)), 6)


def lexicon_answer(words: Column | str, lexicons: dict[str, list[str]]) -> Column:
    """JSON answer of the built-in scorer: share of the words in each list.

    Shares are smoothed, ``(hits + 1) / (words + 2)``. A list that is empty takes
    what the first one leaves, ``1 - p``.
    """
    words = _col(words)
    shares = F.array(*[_share(words, listed) for listed in lexicons.values() if listed])

    def answer(found: Column) -> Column:
        scores, at = [], 0
        for key, listed in lexicons.items():
            if listed:
                p, at = found[at], at + 1
            else:
                p = F.round(F.lit(1.0) - found[0], 6)
            scores.append(p.alias(key))
        return F.to_json(F.struct(*scores))

    return bind(shares, answer)
