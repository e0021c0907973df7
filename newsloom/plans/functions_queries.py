"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import scores as S
from newsloom.functions import text as X
from newsloom.plans.registry import query, quote, sql_squeeze, sql_uuid5, table


@query("f1_squeeze_ws", f"SELECT doc_id, {sql_squeeze('text')} AS squeezed FROM documents")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", X.squeeze_ws("text").alias("squeezed")
    )


@query(
    "f2_strip_breaks",
    "SELECT doc_id, replace(replace(text, chr(10), ''), chr(9), '') AS stripped "
    "FROM documents",
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", X.strip_breaks("text").alias("stripped")
    )


def ordinal_text(day: Column) -> Column:
    """A day as ``Thu, Aug 1st, 2024``."""
    n = F.dayofmonth(day)
    suffix = (
        F.when(n.isin(1, 21, 31), "st")
        .when(n.isin(2, 22), "nd")
        .when(n.isin(3, 23), "rd")
        .otherwise("th")
    )
    return F.concat(
        F.date_format(day, "EEE, MMM d"), suffix, F.date_format(day, ", yyyy")
    )


def _order_day() -> Column:
    return F.to_date("o_orderdate")


@query(
    "f3_strip_ordinal",
    "SELECT o_orderkey, strftime(o_orderdate, '%a, %b %-d, %Y') AS written FROM orders",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", X.strip_ordinal(ordinal_text(_order_day())).alias("written")
    )


@query(
    "f4_article_id",
    """SELECT page_id, seg AS whole, split_part(seg, '.', 1) AS cut_dot,
       split_part(seg, '?', 1) AS cut_query
       FROM (SELECT page_id, string_split(url, '/')[-1] AS seg FROM pages)""",
)
def f4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id",
        X.article_id("url").alias("whole"),
        X.article_id("url", ".").alias("cut_dot"),
        X.article_id("url", "?").alias("cut_query"),
    )


def redirect_links(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses, the secure ones inside a redirect link."""
    url = F.col("url")
    inside = F.concat(
        F.lit("https://mail.example.com/go?url="),
        F.url_encode(url),
        F.lit("&mailer_id="),
        F.col("page_id").cast("string"),
        F.lit("&mailer_id=0"),
    )
    return table(spark, d, "pages").select(
        "page_id", "url", F.when(url.startswith("https"), inside).otherwise(url).alias("href")
    )


@query(
    "f5_unwrap_redirect",
    """SELECT page_id,
       CASE WHEN url LIKE 'https%' THEN url_encode(url) ELSE '' END AS target,
       CASE WHEN url LIKE 'https%' THEN url ELSE '' END AS decoded FROM pages""",
)
def f5(spark: SparkSession, d: str) -> DataFrame:
    target = X.unwrap_redirect("href")
    return redirect_links(spark, d).select(
        "page_id", target.alias("target"), X.unquote(target).alias("decoded")
    )


@query("f6_unquote", "SELECT doc_id, url_decode(text) AS decoded FROM documents")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", X.unquote("text").alias("decoded")
    )


@query(
    "f7_absolutize",
    """SELECT page_id, 'https://site.example/' || ltrim(path, '/') AS full_url,
       'https://site.example/' || path AS joined
       FROM (SELECT page_id, CASE WHEN url LIKE 'https%' THEN '/' || seg ELSE seg END AS path
             FROM (SELECT page_id, url, string_split(url, '/')[4] AS seg FROM pages))""",
)
def f7(spark: SparkSession, d: str) -> DataFrame:
    seg = F.get(F.split("url", "/"), F.lit(3))
    path = F.when(F.col("url").startswith("https"), F.concat(F.lit("/"), seg)).otherwise(seg)
    return table(spark, d, "pages").select(
        "page_id",
        X.absolutize(path, "https://site.example").alias("full_url"),
        X.absolutize(path, "https://site.example/", add_slash=False).alias("joined"),
    )


@query("f8_uuid5", f"SELECT doc_id, {sql_uuid5('text')} AS article_id FROM documents")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", X.uuid5_dns("text").alias("article_id")
    )


@query("f9_lower", "SELECT doc_id, lower(text) AS lowered FROM documents")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower("text").alias("lowered"))


@query(
    "f10_category_label",
    "SELECT doc_id, lang || '-' || source AS label FROM documents",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    marker = F.concat(F.lit(X.CATEGORY_PREFIX), F.col("lang"), F.lit("-"), F.col("source"))
    return table(spark, d, "documents").select(
        "doc_id", X.category_label(marker).alias("label")
    )


def raw_keywords() -> Column:
    """Keywords as raw JSON text: a list, one text, a number, or nothing."""
    return (
        F.when(F.col("lang") == "en", F.to_json(F.array("lang", "source")))
        .when(F.col("lang") == "fr", F.concat_ws(",", "lang", "source"))
        .when(F.col("lang") == "de", F.col("n_chars").cast("string"))
    )


@query(
    "f11_ensure_list",
    """SELECT doc_id,
       CASE lang WHEN 'en' THEN lang || '|' || source WHEN 'fr' THEN lang || ',' || source
                 WHEN 'de' THEN CAST(n_chars AS VARCHAR) ELSE '' END AS kws,
       CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 WHEN 'de' THEN 1 ELSE 0 END AS n_kws
       FROM documents""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    kws = X.ensure_list(raw_keywords())
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(kws, "|").alias("kws"), F.size(kws).alias("n_kws")
    )


def written_dates() -> Column:
    """Order days in the many forms the lenient rule meets, by order priority."""
    day = _order_day()
    form = F.col("o_orderpriority")
    return (
        F.when(form == "1-URGENT", F.concat(day.cast("string"), F.lit("T01:30:00+05:30")))
        .when(form == "2-HIGH", F.date_format(day, "MMM d, yyyy"))
        .when(form == "3-MEDIUM", F.date_format(day, "EEE, dd MMM yyyy 'at' ").substr(1, 17))
        .when(form == "4-NOT SPECIFIED", F.concat(F.lit("sometime in "), F.year(day)))
        .otherwise(F.concat(F.month(day), F.lit("/"), F.dayofmonth(day), F.lit("/"), F.year(day)))
    )


@query(
    "f12_lenient_date",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
       ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", D.lenient_date(written_dates()).cast("string").alias("day")
    )


@query(
    "f13_strict_date",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", D.strict_date(F.col("ts").cast("string")).cast("string").alias("day")
    )


@query(
    "f14_utc_date",
    "SELECT event_id, CAST(CAST(ts - INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS day "
    "FROM events",
)
def f14(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat(
        F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T")),
        F.lit("+05:30"),
    )
    return table(spark, d, "events").select(
        "event_id", D.utc_date(written).cast("string").alias("day")
    )


@query(
    "f15_ordinal_date",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        D.ordinal_date(ordinal_text(_order_day())).cast("string").alias("day"),
    )


@query(
    "f16_date_range",
    """SELECT CAST(CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate),
       INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day FROM orders""",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    first = orders.agg(F.to_date(F.min("o_orderdate"))).scalar()
    last = orders.agg(F.to_date(F.max("o_orderdate"))).scalar()
    return D.date_range(spark, first, last).select(
        F.col("nl_date").cast("string").alias("day")
    )


@query(
    "f17_day_text",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
       strftime(o_orderdate - INTERVAL 2 DAY, '%Y-%m-%d') AS newest FROM orders""",
)
def f17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        D.day_text("o_orderdate").alias("day"),
        D.day_text(D.newsletter_end(_order_day())).alias("newest"),
    )


def odd_answers() -> Column:
    """Event properties as model answers, good and bad, by event type."""
    number = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return (
        F.when(kind == "view", F.col("props"))
        .when(kind == "click", F.concat(F.lit('{"k": "'), number, F.lit('.5"}')))
        .when(kind == "purchase", F.concat(F.lit('{"j": '), number, F.lit("}")))
        .when(kind == "error", F.concat(F.lit('{"k": '), number))
        .otherwise(F.lit('{"k": "high"}'))
    )


@query(
    "f18_parse_scores",
    """SELECT event_id, CASE event_type
         WHEN 'view' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE)
         WHEN 'click' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5
         END AS k FROM events""",
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn(
        "s", S.parse_scores(odd_answers(), ("k",))
    )
    return rows.select("event_id", "s.k")


def formed_answers() -> Column:
    """Two-key answers, well-formed or not, by event type."""
    n = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    solar = F.concat(F.lit('"solar": '), n)
    other = F.lit('"notSolar": 0.5e-1')
    return (
        F.when(kind == "view", F.concat(F.lit("{"), solar, F.lit(", "), other, F.lit("}")))
        .when(kind == "click", F.concat(F.lit("{"), other, F.lit(", "), solar, F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit("{\n"), solar, F.lit(" ,\n\t"), other, F.lit(" }")))
        .when(kind == "error", F.concat(F.lit("{"), solar, F.lit(', "x": 1}')))
        .otherwise(F.concat(F.lit('{"solar": 0'), n, F.lit(', "notSolar": -1}')))
    )


@query(
    "f19_valid_scores",
    """SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'purchase' THEN true
       WHEN 'signup' THEN false ELSE false END AS valid FROM events""",
)
def f19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", S.valid_scores(formed_answers(), S.SOLAR_KEYS).alias("valid")
    )


def _filled(wrapper: str, keys: tuple[str, ...]) -> str:
    text = S.WRAPPERS[wrapper].replace("{prompt}", S.SCORE_TEMPLATE)
    return (
        text.replace("{frmt}", S.answer_form(keys))
        .replace("{labels}", "")
        .replace("{examples}", "")
    )


@query(
    "f20_render_prompt",
    f"""SELECT doc_id, replace({quote(_filled('gemma', S.SOLAR_KEYS))}, '{{text}}', text)
        AS prompt FROM documents""",
)
def f20(spark: SparkSession, d: str) -> DataFrame:
    prompt = S.render_prompt("text", S.SCORE_TEMPLATE, S.SOLAR_KEYS, "gemma")
    return table(spark, d, "documents").select("doc_id", prompt.alias("prompt"))


@query(
    "f21_payloads",
    """SELECT event_id,
       CASE event_type
         WHEN 'view' THEN '{"is_ajax":true,"page":' || user_id || '}'
         WHEN 'click' THEN '{"q":"economy","is_ajax":true,"action":"","page":' || user_id || '}'
         WHEN 'error' THEN '{"cat_name":"oil-and-gas","sub_cat_name":"","is_ajax":true,"page":'
                           || user_id || '}'
         ELSE '{"sub_cat_name":"","is_ajax":true,"page":' || user_id || '}' END AS listing,
       '{"query":"q","variables":{"offset":' || user_id * 15 || ',"size":15}}' AS api,
       '{"prompt":' || to_json(event_type) || ',"dynatemp_range":0.0,"cache_prompt":true,'
         || '"temperature":0.5}' AS score
       FROM events""",
)
def f21(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    topic = (
        F.when(kind == "view", "all-news")
        .when(kind == "click", "economy-news")
        .when(kind == "error", "oil-news")
        .otherwise("other-news")
    )
    return table(spark, d, "events").select(
        "event_id",
        S.listing_payload(topic, "user_id").alias("listing"),
        S.api_payload("q", "user_id").alias("api"),
        S.score_payload("event_type").alias("score"),
    )


@query(
    "f22_join_text",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
       lambda x: trim(x)), ' ') AS joined FROM documents""",
)
def f22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", X.join_text(F.split("text", "\n"), " ", True).alias("joined")
    )


@query(
    "f23_unescape_html",
    """SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'),
       '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS plain FROM pages""",
)
def f23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", X.unescape_html("html").alias("plain")
    )


@query(
    "f23_unescape_numeric",
    """SELECT doc_id, 'a' || CASE WHEN n BETWEEN 128 AND 159 THEN substr(m, n - 127, 1) ELSE chr(n) END
         || '© ' || doc_id || chr(n + 256) || '&x' AS plain
       FROM (SELECT doc_id, CAST(CASE WHEN doc_id % 300 < 192 THEN 32 + doc_id % 95 ELSE 128 + doc_id % 128 END AS INT) AS n,
               '€' || chr(129) || '‚ƒ„…†‡ˆ‰Š‹Œ' || chr(141) || 'Ž' || chr(143) || chr(144) || '‘’“”•–—˜™š›œ' || chr(157) || 'žŸ' AS m
             FROM documents)""",
)
def f23_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with and without closing sign, of C1 controls too, and a bare name."""
    n = F.expr("CASE WHEN doc_id % 300 < 192 THEN 32 + doc_id % 95 ELSE 128 + doc_id % 128 END")
    text = F.concat(
        F.lit("a&#"), n.cast("string"), F.lit("&copy "), F.col("doc_id").cast("string"),
        F.lit("&#x"), F.hex(n + 256), F.lit(";&x"),
    )
    return table(spark, d, "documents").select("doc_id", X.unescape_html(text).alias("plain"))


@query(
    "f24_predicates",
    """SELECT page_id, contains(url, 'blog') AS has_blog, starts_with(url, 'https') AS secure,
       string_split(url, '/')[4] IN ('en', 'fr') AS listed FROM pages""",
)
def f24(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        url.contains("blog").alias("has_blog"),
        url.startswith("https").alias("secure"),
        F.get(F.split(url, "/"), F.lit(3)).isin("en", "fr").alias("listed"),
    )


@query(
    "f25_element_access",
    """SELECT doc_id, w[1] AS first_line, w[-1] AS last_line, w[5] AS fifth_line, lang AS inner_field
       FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS w FROM documents)""",
)
def f25(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    nested = F.struct(F.struct("lang").alias("inner")).alias("outer")
    return table(spark, d, "documents").select("doc_id", lines.alias("w"), nested).select(
        "doc_id",
        F.get("w", F.lit(0)).alias("first_line"),
        F.element_at("w", -1).alias("last_line"),
        F.get("w", F.lit(4)).alias("fifth_line"),
        F.col("outer.inner.lang").alias("inner_field"),
    )


@query(
    "f26_json_kind",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'list' WHEN 'fr' THEN 'text'
       WHEN 'de' THEN 'text' ELSE 'absent' END AS kind FROM documents""",
)
def f26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", X.json_kind(raw_keywords()).alias("kind")
    )


@query(
    "d4_elementwise",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
         ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
       o_orderpriority AS kws FROM orders""",
)
def d4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        D.lenient_date(written_dates()).cast("string").alias("day"),
        F.array_join(X.ensure_list("o_orderpriority"), "|").alias("kws"),
    )


@query(
    "p20_default_value",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'Headline DNE') AS headline "
    "FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def p20(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select(
        "doc_id",
        X.or_default(F.col("quality").cast("string"), "Headline DNE").alias("headline"),
    )
