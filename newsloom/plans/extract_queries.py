"""Pages and payloads taken apart, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import markup as M
from newsloom.functions.text import squeeze_ws
from newsloom.operators import conform as C
from newsloom.operators import extract as E
from newsloom.operators import incremental as I
from newsloom.operators import newsletter as N
from newsloom.plans.registry import query, sql_squeeze, sql_uuid5, table
from newsloom.sources import payloads as P

_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', '', 'g'), "
    "'(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), "
    "'(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
)
CLEAN = _CLEAN.format(html="html")
UNESCAPE = (
    "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
    "'&middot;', '·'), '&amp;', '&')"
)


def sql_text(x: str) -> str:
    return UNESCAPE.format(x=f"regexp_replace({x}, '<[^>]*>', '', 'g')")


_ANCHORS = f"""
  SELECT page_id, url, CAST(pos - 1 AS INT) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
         {sql_squeeze(sql_text('a'))} AS text
  FROM (SELECT page_id, url, unnest(xs) AS a, generate_subscripts(xs, 1) AS pos
        FROM (SELECT page_id, url,
                     regexp_extract_all({CLEAN}, '(?is)<a\\b[^>]*>.*?</a>') AS xs FROM pages))
"""


@query("p1_anchors", f"SELECT page_id, pos, href, text FROM ({_ANCHORS})")
def p1(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    return E.extract_anchors(pages).select("page_id", "pos", "href", "text")


def jsonld_pages(spark: SparkSession, d: str) -> DataFrame:
    """Article pages made of the documents: good, without the block, or broken."""
    record = F.to_json(
        F.struct(
            F.concat(F.lit("https://x.example/"), F.col("doc_id")).alias("url"),
            F.col("source").alias("headline"),
            F.col("text").alias("articleBody"),
            F.array("lang", "source").alias("keywords"),
        )
    )
    open_ld = F.lit('<script type="application/ld+json">')
    close = F.lit("</script>")
    site = F.concat(open_ld, F.lit('{"@type":"Organization"}'), close)
    cut = F.concat(F.lit("{"), record)
    html = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("<!--"), open_ld, close, F.lit("-->"), site))
        .when(F.col("lang") == "de", F.concat(site, open_ld, cut, close))
        .otherwise(F.concat(site, F.lit("<p>x</p>"), open_ld, record, close))
    )
    return table(spark, d, "documents").select("doc_id", html.alias("html"))


@query(
    "p2_jsonld",
    """SELECT doc_id, CASE WHEN lang IN ('en', 'es') THEN source END AS headline,
       CASE WHEN lang IN ('en', 'es') THEN text END AS body,
       CASE WHEN lang IN ('en', 'es') THEN '["' || lang || '","' || source || '"]' END AS keywords,
       CASE lang WHEN 'fr' THEN 'no block' WHEN 'de' THEN 'bad json' END AS problem
       FROM documents""",
)
def p2(spark: SparkSession, d: str) -> DataFrame:
    rows = E.extract_jsonld(jsonld_pages(spark, d))
    return rows.select(
        "doc_id",
        F.col("data.headline").alias("headline"),
        F.col("data.articleBody").alias("body"),
        F.col("data.keywords").alias("keywords"),
        "problem",
    )


@query(
    "p2_jsonld_quarantine",
    """SELECT 'good' AS kind, CAST(doc_id AS VARCHAR) AS entry FROM documents
       WHERE lang IN ('en', 'es')
       UNION ALL SELECT 'dead', CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'fr'""",
)
def p2_quarantine(spark: SparkSession, d: str) -> DataFrame:
    rows = E.extract_jsonld(jsonld_pages(spark, d))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    good, dead = E.apply_jsonld_policy(rows, "nleec", "doc_id")
    return good.select(F.lit("good").alias("kind"), F.col("doc_id").alias("entry")).unionByName(
        dead.select(F.lit("dead").alias("kind"), "entry")
    )


@query(
    "p3_blocks",
    f"""SELECT page_id, CAST(pos - 1 AS INT) AS pos, {sql_text('b')} AS item
        FROM (SELECT page_id, unnest(xs) AS b, generate_subscripts(xs, 1) AS pos
              FROM (SELECT page_id, regexp_extract_all({CLEAN}, '(?is)<li\\b[^>]*>.*?</li>') AS xs
                    FROM pages))""",
)
def p3(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    return E.extract_blocks(pages, "li").select(
        "page_id", "pos", M.text_of(F.col("block")).alias("item")
    )


@query(
    "p3_blocks_nested_list",
    """SELECT page_id, CAST(pos AS INT) AS pos, item FROM (SELECT page_id, unnest([0, 1, 2, 3]) AS pos,
         unnest(['M' || page_id || '12', '1', '2', url]) AS item FROM pages)""",
)
def p3_nested_list(spark: SparkSession, d: str) -> DataFrame:
    """An outer item is whole, and the items it holds are items too."""
    item = F.concat(
        F.lit("<ul><li>M"), F.col("page_id").cast("string"),
        F.lit("<ul><li>1</li><li>2</li></ul></li><li>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</li></ul>"),
    )
    pages = table(spark, d, "pages").select("page_id", item.alias("html"))
    return E.extract_blocks(pages, "li").select(
        "page_id", "pos", M.text_of(F.col("block")).alias("item")
    )


@query(
    "p3_nested_blocks",
    f"""SELECT page_id, 0 AS pos, {sql_text("regexp_extract(c, '(?s)<div class=.ad.>(.*?)</div>', 1)")}
        AS item FROM (SELECT page_id, {CLEAN} AS c FROM pages)
        WHERE c LIKE '%<div class="ad">%'""",
)
def p3_nested(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    return E.extract_blocks(pages, "div", "ad", nested=True).select(
        "page_id", "pos", M.text_of(F.col("block")).alias("item")
    )


def sql_paragraphs(html: str = CLEAN) -> str:
    inside = f"regexp_extract({html}, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"
    return (
        f"list_transform(string_split_regex({inside}, '(?i)<p(\\s[^>]*)?>')[2:], "
        "lambda p: string_split_regex(p, '(?i)</p\\s*>')[1])"
    )


def _sql_body(paras: str, sep: str = "chr(10)") -> str:
    texts = f"list_transform({paras}, lambda p: {sql_text('p')})"
    return sql_squeeze(f"array_to_string({texts}, {sep})")


@query("p4_body", f"SELECT page_id, {_sql_body(sql_paragraphs())} AS body FROM pages")
def p4(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    return E.extract_body(pages, ("article", None)).select("page_id", "body")


@query(
    "p4_body_joined",
    f"""SELECT page_id, array_to_string(list_transform({sql_paragraphs()}, lambda p:
        array_to_string(list_transform(string_split_regex(p, '<[^>]*>'),
          lambda t: trim({UNESCAPE.format(x='t')}, ' ' || chr(10) || chr(9))), '')), ' ')
        AS body FROM pages""",
)
def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    return E.extract_body(
        pages, ("article", None), sep=" ", strip_each=True, squeeze=False
    ).select("page_id", "body")


@query(
    "p5_drop_last",
    f"""SELECT page_id, {_sql_body('ps[:-2]')} AS body
        FROM (SELECT page_id, {sql_paragraphs()} AS ps FROM pages)""",
)
def p5(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    return E.extract_body(pages, ("article", None), drop_last=1).select("page_id", "body")


@query(
    "p6_tags",
    f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(
          regexp_extract({CLEAN}, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a\\b[^>]*>.*?</a>'),
          lambda a: {sql_text('a')}), '|') AS tags, 0 AS n_missing FROM pages""",
)
def p6(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    found = E.extract_tags(pages, ("nav", None), body=None)
    tags = found.select("page_id", "html", F.array_join("key_words", "|").alias("tags"))
    absent = E.extract_tags(tags, ("div", "entry-tags"), body=None)
    return absent.select("page_id", "tags", F.size("key_words").alias("n_missing"))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """A listing page per document: a full item, one without heading, a bare one."""
    lines = F.split("text", "\n")
    title = _escape(F.get(lines, F.lit(0)))
    lead = _escape(F.element_at(lines, -1))
    doc = F.col("doc_id").cast("string")

    def item(*parts: Column) -> Column:
        return F.concat(F.lit('<div class="list article-preview">'), *parts, F.lit("</div>"))

    def head(prefix: str) -> Column:
        return F.concat(
            F.lit(f'<h2 class="entry-title"><a href="/{prefix}/'),
            doc,
            F.lit('?a=1&amp;b=2">\n'),
            F.lit("" if prefix == "a" else "More: "),
            title,
            F.lit(" </a></h2>"),
        )

    time = F.concat(
        F.lit('<time class="entry-published updated" datetime="2024-01-'),
        F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0"),
        F.lit('T01:30:00+05:30">January</time>'),
    )
    author = F.concat(F.lit('<span class="entry-author"> '), F.col("source"), F.lit("</span>"))
    summary = F.concat(
        F.lit('<div class="article-lead-text"><div>ad</div><p>'), lead, F.lit("</p></div>")
    )
    nothing = F.lit("<div><p>no heading</p></div>")
    html = F.concat(
        F.lit('<html><!-- <div class="article-preview"></div> --><div class="wrap">'),
        item(head("a"), time, author, summary),
        item(nothing, time),
        item(head("b"), time, author),
        F.lit("</div></html>"),
    )
    return table(spark, d, "documents").select("doc_id", html.alias("html"))


def _sql_listing(prefix: str, lead: str, pos: int, title: str) -> str:
    return f"""SELECT doc_id, {pos} AS pos, {sql_uuid5('title')} AS article_id,
      '/{prefix}/' || doc_id || '?a=1&b=2' AS url, title, source AS author,
      '2024-01-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') || 'T01:30:00+05:30'
        AS date_published, {lead} AS summary
      FROM (SELECT *, {sql_squeeze(title)} AS title FROM documents)"""


@query(
    "p7_listing",
    _sql_listing("a", sql_squeeze("string_split(text, chr(10))[-1]"), 0, "string_split(text, chr(10))[1]")
    + " UNION ALL "
    + _sql_listing("b", "CAST(NULL AS VARCHAR)", 2, "'More: ' || string_split(text, chr(10))[1]"),
)
def p7(spark: SparkSession, d: str) -> DataFrame:
    return E.extract_listing(listing_pages(spark, d), "pvmag_us")


@query(
    "p7_page_meta",
    f"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
        {sql_squeeze(sql_text("regexp_extract(c, '(?s)<title>(.*?)</title>', 1)"))} AS title,
        {sql_squeeze(sql_text("regexp_extract(c, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading
        FROM (SELECT page_id, html, {CLEAN} AS c FROM pages)""",
)
def p7_meta(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", M.strip_noise("html").alias("page"))
    page = F.col("page")
    return pages.select(
        "page_id",
        M.attribute(M.first_block(page, "html"), "lang").alias("lang"),
        squeeze_ws(M.text_of(M.first_block(page, "title"))).alias("title"),
        squeeze_ws(M.text_of(M.first_block(page, "h1"))).alias("heading"),
    )


@query(
    "p9_unwrap_data",
    """SELECT doc_id, source AS headline, CASE WHEN lang = 'es' THEN NULL ELSE text END AS body
       FROM documents WHERE lang IN ('en', 'es')""",
)
def p9(spark: SparkSession, d: str) -> DataFrame:
    # English: full record; Spanish: the key holds null; German: no such key;
    # French: an empty record for short texts, none for the others.
    lang = F.col("lang")
    full = F.to_json(
        F.struct(F.col("source").alias("headline"), F.col("text").alias("articleBody"))
    )
    null_body = F.concat(F.lit('{"headline":"'), F.col("source"), F.lit('","articleBody":null}'))
    no_body = F.concat(F.lit('{"headline":"'), F.col("source"), F.lit('"}'))
    data = (
        F.when(lang == "en", full)
        .when(lang == "es", null_body)
        .when(lang == "de", no_body)
        .when(F.col("n_chars") < 1000, F.lit("{}"))
    )
    rows = table(spark, d, "documents").select("doc_id", data.alias("data"))
    return C.unwrap_data(rows, "nleec", E.ARTICLE_FIELDS).select(
        "doc_id", "headline", F.col("articleBody").alias("body")
    )


@query(
    "p16_stub_links",
    f"""SELECT page_id, pos, href, text FROM ({_ANCHORS})
        WHERE lower(text) NOT IN ('', 'read more')""",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    stubs = F.lit('<a href="/more">\n Read <b>MORE</b> </a><a href="/none"><br></a>')
    pages = table(spark, d, "pages").select("page_id", F.concat("html", stubs).alias("html"))
    return N.drop_stub_links(E.extract_anchors(pages)).drop("title")


_PARTS = ("blog.", "/en/", "/fr/", "page=", ".example.com")


@query(
    "p17_tag_categories",
    "SELECT page_id, url, c AS category FROM (SELECT page_id, url, "
    "unnest(list_filter(['blog.', '/en/', '/fr/', 'page=', '.example.com'], "
    "lambda c: contains(url, c))) AS c FROM pages)",
)
def p17(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return N.tag_categories(pages, _PARTS, href="url")


@query(
    "p18_drop_failed",
    "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
)
def p18(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(
        table(spark, d, "labels"), "doc_id", "left"
    )
    return I.drop_failed(rows, ["quality"]).select("doc_id", "quality")


def post_payloads(spark: SparkSession, d: str) -> DataFrame:
    """API answers of up to 15 posts, as a site pages them, made of the documents."""
    doc = F.col("doc_id").cast("string")
    paras = F.concat(
        F.lit("<p>"), F.replace(_escape(F.col("text")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>")
    )
    node = F.struct(
        doc.alias("id"),
        F.concat(F.lit("slug-"), doc).alias("slug"),
        F.lit("2024-05-01T10:00:00").alias("date"),
        F.when(F.col("lang") != "es", paras).alias("content"),
        F.col("source").alias("title"),
        F.struct(
            F.array(F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))).alias(
                "nodes"
            )
        ).alias("categories"),
        F.struct(F.struct(F.col("source").alias("name")).alias("node")).alias("author"),
    )
    offset = F.floor(F.col("doc_id") / 15)
    answers = (
        table(spark, d, "documents")
        .groupBy(offset.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", node.alias("n")))).alias("ns"))
    )
    nodes = F.transform("ns", lambda x: x["n"])
    answer = F.struct(F.struct(F.struct(nodes.alias("nodes")).alias("posts")).alias("data"))
    # Null content is written out, as the site does.
    return answers.select(
        "page", F.to_json(answer, {"ignoreNullFields": "false"}).alias("payload")
    )


@query(
    "s11_posts",
    """SELECT CAST(floor(doc_id / 15) AS BIGINT) AS page,
         CAST(row_number() OVER (PARTITION BY floor(doc_id / 15) ORDER BY doc_id) - 1 AS INT) AS pos,
         CAST(doc_id AS VARCHAR) AS article_id, source AS title, source AS author,
         'slug-' || doc_id AS slug, '2024-05-01T10:00:00' AS date,
         lang || '|' || source AS categories, lang <> 'es' AS has_content
       FROM documents""",
)
def s11(spark: SparkSession, d: str) -> DataFrame:
    posts = P.explode_posts(post_payloads(spark, d))
    return posts.select(
        "page",
        "pos",
        "article_id",
        "title",
        "author",
        F.substring_index("url", "/", -1).alias("slug"),
        "date",
        F.array_join("categories", "|").alias("categories"),
        F.col("content").isNotNull().alias("has_content"),
    )


@query(
    "s11_post_bodies",
    """SELECT CAST(doc_id AS VARCHAR) AS article_id,
         array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' ') AS body
       FROM documents WHERE lang <> 'es'""",
)
def s11_bodies(spark: SparkSession, d: str) -> DataFrame:
    posts = P.explode_posts(post_payloads(spark, d))
    return P.post_articles(posts).select("article_id", "body")


@query(
    "s11_listing_pages",
    """SELECT doc_id, '<li>' || text || '</li>' AS html FROM documents WHERE lang <> 'de'""",
)
def s11_listing(spark: SparkSession, d: str) -> DataFrame:
    answer = F.to_json(
        F.struct(
            F.struct((F.col("lang") == "de").alias("has_reached_end")).alias("data"),
            F.concat(F.lit("<li>"), F.col("text"), F.lit("</li>")).alias("html"),
        )
    )
    rows = table(spark, d, "documents").select("doc_id", answer.alias("payload"))
    return P.listing_pages(rows)


@query(
    "s11_event_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def s11_props(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"))
