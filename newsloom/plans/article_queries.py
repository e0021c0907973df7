"""Conforming, incremental and newsletter queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import squeeze_ws, uuid5_dns
from newsloom.operators import conform as C
from newsloom.operators import extract as E
from newsloom.operators import incremental as I
from newsloom.operators import newsletter as N
from newsloom.plans import articles as A
from newsloom.plans import newsletters as NL
from newsloom.plans.extract_queries import _ANCHORS
from newsloom.plans.functions_queries import ordinal_text, raw_keywords
from newsloom.plans.registry import query, sql_squeeze, sql_uuid5, table
from newsloom.session import fresh_path
from newsloom.sources.versioned import VersionedStore

# Which given source stands for which shape.
SHAPES = {
    "ec": ("src0", "src1", "src2"),
    "eec": ("src3", "src4"),
    "nleec": ("src5", "src6"),
    "mercom": ("src7", "src8", "src9"),
    "saur": ("src10", "src11", "src12"),
    "pvmag": ("src13", "src14"),
    "pvmag_global": ("src15", "src16"),
    "pvmag_us": ("src17", "src18", "src19"),
}


def day_of_doc() -> Column:
    """A day for each document, as the table has none."""
    return F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("n_chars") % 366).cast("int"))


def _shape_columns() -> dict[str, dict[str, Column]]:
    """The columns of each source's store, made of a document."""
    day = day_of_doc()
    lines = F.split("text", "\n")
    title = squeeze_ws(F.get(lines, F.lit(0)))
    lead = F.element_at(lines, -1)
    url = F.concat(F.lit("https://x.example/"), uuid5_dns("text"))
    iso = F.concat(day.cast("string"), F.lit("T01:30:00+05:30"))
    core = {
        "url": url,
        "headline": title,
        "description": lead,
        "articleBody": F.col("text"),
        "datePublished": F.when(F.col("lang") == "es", "no date").otherwise(iso),
        "keywords": raw_keywords(),
    }
    listed = {
        "url": url,
        "title": title,
        "summary": F.when(F.col("lang") != "fr", lead),
        "body": F.col("text"),
        "date_published": iso,
        "key_words": F.lit(None).cast("array<string>"),
    }
    api = {
        "url": url,
        "title": title,
        "body": F.col("text"),
        "date": iso,
        "categories": F.array("lang", "source"),
    }
    saur = {**listed, "date_published": ordinal_text(day), "key_words": F.array("lang")}
    shapes = dict.fromkeys(("ec", "eec", "nleec"), core)
    shapes |= dict.fromkeys(("pvmag", "pvmag_global", "pvmag_us"), listed)
    return {**shapes, "mercom": api, "saur": saur}


def source_frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The documents as the stores of the eight sources, each in its own shape."""
    docs = table(spark, d, "documents")
    shapes = _shape_columns()
    return {
        tag: docs.filter(F.col("source").isin(*given)).select(
            *[value.alias(name) for name, value in shapes[tag].items()]
        )
        for tag, given in SHAPES.items()
    }


def source_store(spark: SparkSession, d: str) -> DataFrame:
    """The documents as one store of all sources, each row in its source's shape."""
    columns: dict[str, Column] = {}
    for tag, shape in _shape_columns().items():
        here = F.col("source").isin(*SHAPES[tag])
        for name, value in shape.items():
            old = columns.get(name)
            columns[name] = F.when(here, value) if old is None else old.when(here, value)
    tag = F.lit(None).cast("string")
    for name, given in SHAPES.items():
        tag = F.when(F.col("source").isin(*given), name).otherwise(tag)
    return table(spark, d, "documents").select(
        *[value.alias(name) for name, value in columns.items()], tag.alias("source")
    )


def articles(spark: SparkSession, d: str) -> DataFrame:
    return C.union_sources([C.conform(f, tag) for tag, f in source_frames(spark, d).items()])


_TAG = "CASE " + " ".join(
    f"WHEN source IN ({', '.join(repr(s) for s in given)}) THEN '{tag}'"
    for tag, given in SHAPES.items()
) + " END"
_UTC = "('pvmag_global', 'pvmag_us')"


def sql_articles(tag: str) -> str:
    """SQL for the article table, each document in the shape of its tag."""
    return f"""
  SELECT doc_id, tag AS source, 'https://x.example/' || {sql_uuid5('text')} AS url,
    {sql_squeeze('string_split(text, chr(10))[1]')} AS title, text AS body,
    CASE WHEN tag = 'mercom' OR (lang = 'fr' AND tag NOT IN ('ec', 'eec', 'nleec')) THEN NULL
         ELSE string_split(text, chr(10))[-1] END AS summary,
    CASE WHEN tag IN ('ec', 'eec', 'nleec') AND lang = 'es' THEN NULL
         WHEN tag IN {_UTC} THEN day - 1 ELSE day END AS date,
    CASE WHEN tag IN ('ec', 'eec', 'nleec') THEN
           CASE lang WHEN 'en' THEN [lang, source] WHEN 'fr' THEN [lang || ',' || source]
                     WHEN 'de' THEN [CAST(n_chars AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END
         WHEN tag = 'mercom' THEN [lang, source] WHEN tag = 'saur' THEN [lang] END AS kws
  FROM (SELECT *, {tag} AS tag, DATE '2024-01-01' + CAST(n_chars % 366 AS INT) AS day
        FROM documents)
"""


SQL_ARTICLES = sql_articles(_TAG)


@query(
    "u1_articles_by_source_month",
    f"""SELECT source, strftime(date, '%Y-%m') AS month, count(*) AS n_articles,
        count(DISTINCT title) AS n_titles, CAST(sum(length(body)) AS BIGINT) AS n_chars,
        CAST(sum(CASE WHEN summary IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_no_summary,
        CAST(sum(coalesce(len(kws), 0)) AS BIGINT) AS n_kws
        FROM ({SQL_ARTICLES}) GROUP BY ALL""",
)
def u1_month(spark: SparkSession, d: str) -> DataFrame:
    return A.by_month(C.conform_all(source_store(spark, d)))


@query(
    "u1_union_sources",
    f"""SELECT source, url, title, summary, body, CAST(date AS VARCHAR) AS date,
        array_to_string(kws, '|') AS kws FROM ({SQL_ARTICLES})""",
)
def u1(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select(
        "source",
        "url",
        "title",
        "summary",
        "body",
        F.col("date").cast("string").alias("date"),
        F.array_join("kws", "|").alias("kws"),
    )


@query(
    "u1_union_other_columns",
    """SELECT 'documents' AS kind, doc_id AS id, text, lang, CAST(NULL AS VARCHAR) AS role
       FROM documents
       UNION ALL SELECT 'conversations', conv_id, text, NULL, role FROM conversations""",
)
def u1_other(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text", "lang"
    )
    turns = table(spark, d, "conversations").select(
        F.lit("conversations").alias("kind"), F.col("conv_id").alias("id"), "text", "role"
    )
    return docs.unionByName(turns, allowMissingColumns=True)


_FAMILIES = ("ec", "mercom", "saur", "pvmag_us")


@query(
    "p8_conform",
    " UNION ALL ".join(
        f"""SELECT source, url, title, summary, body, CAST(date AS VARCHAR) AS date
            FROM ({sql_articles(repr(tag))})"""
        for tag in _FAMILIES
    ),
)
def p8(spark: SparkSession, d: str) -> DataFrame:
    """All documents in the shape of each family of sources."""
    docs = table(spark, d, "documents")
    shapes = _shape_columns()
    frames = [
        C.conform(docs.select(*[v.alias(n) for n, v in shapes[tag].items()]), tag)
        for tag in _FAMILIES
    ]
    return C.union_sources(frames).select(
        "source", "url", "title", "summary", "body", F.col("date").cast("string").alias("date")
    )


@query("p10_tag_source", "SELECT doc_id, 'mercom' AS source FROM documents")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return C.tag_source(table(spark, d, "documents").select("doc_id"), "mercom")


@query("p11_drop_columns", "SELECT doc_id, lang, n_chars FROM documents")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_columns(table(spark, d, "documents"), "text", "source")


@query("a6_counts", "SELECT source, count(*) AS n_articles FROM documents GROUP BY source")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return C.counts(table(spark, d, "documents"))


# --- incremental ---------------------------------------------------------------


def doc_listing(spark: SparkSession, d: str) -> DataFrame:
    """The documents as listings of their sources, 15 items a page."""
    return table(spark, d, "documents").select(
        "source",
        F.md5("text").alias("article_id"),
        F.floor(F.col("doc_id") / 15).alias("page"),
        (F.col("doc_id") % 15).alias("pos"),
        "doc_id",
        "n_chars",
    )


_LISTING = """SELECT source, md5(text) AS article_id, CAST(floor(doc_id / 15) AS BIGINT) AS page,
  doc_id % 15 AS pos, doc_id, n_chars FROM documents"""


def toxic_store(spark: SparkSession, d: str) -> DataFrame:
    """Documents labelled toxic, as what the store already holds."""
    labels = table(spark, d, "labels").filter("toxic = 1")
    rows = table(spark, d, "documents").join(labels, "doc_id")
    return rows.select("source", F.md5("text").alias("article_id"))


_STORE = """SELECT source, md5(text) AS article_id FROM documents JOIN labels USING (doc_id)
  WHERE toxic = 1"""


@query(
    "j1_new_only",
    f"""SELECT source, article_id, doc_id FROM ({_LISTING}) l WHERE NOT EXISTS
        (SELECT 1 FROM ({_STORE}) s WHERE s.source = l.source AND s.article_id = l.article_id)""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    fresh = I.new_only(doc_listing(spark, d), toxic_store(spark, d), ["source", "article_id"])
    return fresh.select("source", "article_id", "doc_id")


def _sql_prefix(known: str) -> str:
    return f"""SELECT source, article_id, doc_id FROM (
      SELECT *, max(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY source
        ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
      FROM (SELECT *, {known} AS known FROM ({_LISTING}) l)) WHERE stopped = 0"""


_IN_STORE = f"""EXISTS (SELECT 1 FROM ({_STORE}) s
  WHERE s.source = l.source AND s.article_id = l.article_id)"""
_REPEAT = "row_number() OVER (PARTITION BY source, article_id ORDER BY page, pos) > 1"


@query("w1_take_until_known", _sql_prefix(f"({_IN_STORE}) OR ({_REPEAT})"))
def w1(spark: SparkSession, d: str) -> DataFrame:
    kept = I.take_until_known(
        doc_listing(spark, d), toxic_store(spark, d), "article_id", ["page", "pos"], ["source"]
    )
    return kept.select("source", "article_id", "doc_id")


_BY_TOPIC = "SELECT source, lang AS topic, md5(text) AS article_id, doc_id FROM documents"


@query(
    "w1_take_until_known_by_topic",
    f"""SELECT source, topic, article_id, doc_id FROM (
          SELECT *, max(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY source, topic
            ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
          FROM (SELECT *, row_number() OVER (PARTITION BY source, topic, article_id ORDER BY doc_id) > 1
                OR EXISTS (SELECT 1 FROM ({_BY_TOPIC}) s JOIN labels USING (doc_id) WHERE toxic = 1
                  AND s.source = l.source AND s.topic = l.topic AND s.article_id = l.article_id) AS known
                FROM ({_BY_TOPIC}) l)) WHERE stopped = 0""",
)
def w1_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """Each topic of a source is a cursor of its own."""
    listing = table(spark, d, "documents").select(
        "source", F.col("lang").alias("topic"), F.md5("text").alias("article_id"), "doc_id"
    )
    store = listing.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id")
    cursor = ["source", "topic"]
    return I.take_until_known(listing, store, "article_id", ["doc_id"], cursor).select(
        *cursor, "article_id", "doc_id"
    )


@query(
    "w1_take_until_known_registered",
    _sql_prefix(
        f"""({_IN_STORE}) OR coalesce(sum(CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END) OVER
        (PARTITION BY source, article_id ORDER BY page, pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0"""
    ),
)
def w1_registered(spark: SparkSession, d: str) -> DataFrame:
    listing = doc_listing(spark, d).withColumn("registered", F.col("n_chars") >= 200)
    kept = I.take_until_known(
        listing,
        toxic_store(spark, d),
        "article_id",
        ["page", "pos"],
        ["source"],
        registered="registered",
    )
    return kept.select("source", "article_id", "doc_id")


@query(
    "w1_take_until_known_by_user",
    """SELECT user_id, event_id FROM (
         SELECT *, max(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
           ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
         FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) > 1
               AS known FROM events)) WHERE stopped = 0""",
)
def w1_by_user(spark: SparkSession, d: str) -> DataFrame:
    kept = I.take_until_known(
        table(spark, d, "events"), None, "props", ["event_id"], ["user_id"]
    )
    return kept.select("user_id", "event_id")


@query(
    "w1_take_until_known_first_load",
    f"""WITH loaded AS (SELECT DISTINCT source FROM ({_STORE}) WHERE source <> 'src3'),
        store AS (SELECT * FROM ({_STORE}) WHERE source <> 'src3'),
        flagged AS (SELECT *, EXISTS (SELECT 1 FROM store s WHERE s.source = l.source
            AND s.article_id = l.article_id) OR ({_REPEAT}) AS known,
            source NOT IN (SELECT source FROM loaded) AS first_load FROM ({_LISTING}) l),
        kept AS (SELECT *, max(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY source
            ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
            FROM flagged)
        SELECT source, article_id, max(doc_id) AS doc_id FROM kept
        WHERE first_load OR stopped = 0 GROUP BY source, article_id""",
)
def w1_first_load(spark: SparkSession, d: str) -> DataFrame:
    store = toxic_store(spark, d).filter("source <> 'src3'")
    kept = I.take_until_known(
        doc_listing(spark, d), store, "article_id", ["page", "pos"], ["source"], "first-load"
    )
    return kept.select("source", "article_id", "doc_id")


@query(
    "w7_last_per_key",
    "SELECT article_id, max(doc_id) AS doc_id FROM "
    f"({_LISTING}) GROUP BY article_id",
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    last = I.last_per_key(doc_listing(spark, d), ["article_id"], ["page", "pos"])
    return last.select("article_id", "doc_id")


@query(
    "o6_listing_order",
    f"SELECT source, article_id, page, pos FROM ({_LISTING}) ORDER BY source, page, pos",
)
def o6(spark: SparkSession, d: str) -> DataFrame:
    return (
        doc_listing(spark, d)
        .orderBy("source", "page", "pos")
        .select("source", "article_id", "page", "pos")
    )


def _exclusion(spark: SparkSession, d: str, normalize: bool) -> DataFrame:
    docs = table(spark, d, "documents")
    article_id = F.col("doc_id").cast("string").alias("article_id")
    url = F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    links = docs.select(article_id, url.alias("url"))
    labels = table(spark, d, "labels")
    own = labels.filter("toxic = 1").select(article_id)
    sibling = labels.filter("quality = 0").select(article_id)
    dead = docs.filter(F.col("lang").isin("es", "de")).select(
        F.when(F.col("lang") == "es", F.col("doc_id").cast("string")).otherwise(url).alias("entry")
    )
    return I.exclude_all(links, [own, sibling], dead, normalize_keys=normalize)


def _sql_exclusion(langs: str) -> str:
    return f"""SELECT CAST(doc_id AS VARCHAR) AS article_id, 'https://x.example/' || doc_id AS url
      FROM documents WHERE lang NOT IN ({langs})
      AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)"""


@query("j2_exclude_all", _sql_exclusion("'es'"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    return _exclusion(spark, d, False)


@query("j2_exclude_all_normalized", _sql_exclusion("'es', 'de'"))
def j2_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _exclusion(spark, d, True)


@query(
    "j3_missing_dates",
    """SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS nl_date FROM (
         SELECT unnest(generate_series(DATE '1994-12-01', DATE '2002-01-31', INTERVAL 1 DAY)) AS day)
       WHERE CAST(day AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
)
def j3(spark: SparkSession, d: str) -> DataFrame:
    store = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("nl_date"))
    missing = N.missing_dates(store, "1994-12-01", "2002-01-31")
    return missing.select(F.col("nl_date").cast("string").alias("nl_date"))


@query(
    "j4_backfill",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text
         WHEN toxic = 1 THEN NULL ELSE 'q' || quality END AS body,
         CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'good' END AS key_words
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    store = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    bodies = table(spark, d, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 0, F.concat(F.lit("q"), F.col("quality"))).alias("body"),
        F.when(F.col("quality") == 1, "good").alias("key_words"),
    )
    return I.backfill(store, bodies, "doc_id", ("body", "key_words"))


@query(
    "j4_backfill_twice",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text ELSE 'second' || quality END AS body
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def j4_twice(spark: SparkSession, d: str) -> DataFrame:
    """A page that landed twice fills its row once, with what landed last."""
    store = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    bodies = table(spark, d, "labels").select(
        "doc_id",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("landed"), F.concat(F.lit(word), F.col("quality")).alias("body"))
            for i, word in ((1, "first"), (2, "second"))
        ])),
    )
    return I.backfill(store, bodies, "doc_id", ("body",), ["landed"])


@query(
    "j4_backfill_topics",
    """WITH s AS (SELECT doc_id, source AS topic, doc_id % 97 AS article_id, CASE WHEN lang = 'en' THEN n_chars END AS body FROM documents),
        b AS (SELECT doc_id % 97 AS article_id, arg_max(quality, doc_id) AS body FROM labels GROUP BY 1)
       SELECT doc_id, topic, s.article_id, coalesce(s.body, b.body) AS body FROM s LEFT JOIN b USING (article_id)""",
)
def j4_topics(spark: SparkSession, d: str) -> DataFrame:
    """An article stands under many topics; only rows without a body are filled."""
    article_id = (F.col("doc_id") % 97).alias("article_id")
    body = F.when(F.col("lang") == "en", F.col("n_chars")).alias("body")
    store = table(spark, d, "documents").select("doc_id", F.col("source").alias("topic"), article_id, body)
    bodies = table(spark, d, "labels").select(article_id, "doc_id", F.col("quality").cast("long").alias("body"))
    return I.backfill(store, bodies, "article_id", ("body",), ["doc_id"], asked=F.col("body").isNull())


@query(
    "j5_merge_on_read",
    """SELECT d.doc_id, d.source AS topic, CASE WHEN toxic = 1 THEN NULL WHEN l.doc_id IS NOT NULL THEN 'q' || quality
         WHEN lang = 'en' THEN 'first' ELSE lang END AS body, CASE WHEN quality = 1 THEN 'good' END AS key_words
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def j5_versions(spark: SparkSession, d: str) -> DataFrame:
    """Rows in two runs, a change before and one after a compaction; a null overwrites."""
    store = VersionedStore(spark, fresh_path(spark, "versions"), ["topic", "doc_id"])
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("topic"), F.col("lang").alias("body"))
    store.add(rows.filter("body <> 'de'"), ["doc_id"])
    store.add(rows, ["doc_id"])
    english = rows.filter("body = 'en'").withColumn("body", F.lit("first"))
    store.change(english, ["body"], ["doc_id"])
    store.compact()
    labels = table(spark, d, "labels").join(rows.select("doc_id", "topic"), "doc_id")
    body = F.when(F.col("toxic") == 0, F.concat(F.lit("q"), F.col("quality"))).alias("body")
    words = F.when(F.col("quality") == 1, "good").alias("key_words")
    store.change(labels.select("topic", "doc_id", body, words), ["body", "key_words"], ["doc_id"])
    return store.read().select("doc_id", "topic", "body", "key_words")


@query(
    "j3_days_to_ask",
    """WITH i AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderdate < DATE '2001-03-01' AND o_orderstatus <> 'P' AS good FROM orders)
       SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS nl_date FROM (
         SELECT unnest(generate_series(DATE '1994-12-01', DATE '2002-01-31', INTERVAL 1 DAY)) AS day)
       WHERE CAST(day AS DATE) NOT IN (SELECT day FROM i WHERE day <= (SELECT max(day) FROM i WHERE good))""",
)
def j3_ask(spark: SparkSession, d: str) -> DataFrame:
    """Days without links after the last good one are asked for again."""
    good = (F.col("o_orderdate") < F.lit("2001-03-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "P")
    index = fresh_path(spark, "index")
    table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("nl_date"), F.when(good, F.col("o_orderkey").cast("string")).alias("url")
    ).write.parquet(index)
    days = NL.days_to_ask(spark, index, "1994-12-01", "2002-01-31")
    return days.select(F.col("nl_date").cast("string").alias("nl_date"))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(
        F.md5("text").alias("article_id"), "doc_id", "lang", "source"
    )
    labels = table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


_TURNS = """SELECT md5(text) AS article_id, doc_id, lang, source,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 1 END AS turn FROM documents"""


@query(
    "j5_upsert",
    f"""SELECT article_id, doc_id, lang, source FROM (SELECT *, row_number() OVER (
          PARTITION BY article_id ORDER BY turn DESC, doc_id DESC) AS rn FROM ({_TURNS}))
        WHERE rn = 1""",
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    store, batch = _labelled(spark, d)
    store = I.last_per_key(store, ["article_id"], ["doc_id"])
    return I.upsert(store, batch, ["article_id"], ["doc_id"])


@query(
    "j5_upsert_fields",
    f"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, turn
          ORDER BY doc_id DESC) AS rn FROM ({_TURNS})) WHERE rn = 1),
        store AS (SELECT * FROM last WHERE turn = 0), batch AS (SELECT * FROM last WHERE turn = 1)
        SELECT coalesce(s.article_id, b.article_id) AS article_id, s.lang AS lang,
          CASE WHEN b.article_id IS NOT NULL THEN b.doc_id ELSE s.doc_id END AS doc_id,
          CASE WHEN b.article_id IS NOT NULL THEN b.source ELSE s.source END AS source
        FROM store s FULL JOIN batch b ON s.article_id = b.article_id""",
)
def j5_fields(spark: SparkSession, d: str) -> DataFrame:
    store, batch = _labelled(spark, d)
    store = I.last_per_key(store, ["article_id"], ["doc_id"])
    return I.upsert_fields(store, batch, ["article_id"], ["doc_id", "source"], ["doc_id"])


@query(
    "p13_pending",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN "
    "(SELECT doc_id FROM labels WHERE toxic = 0)",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("p")
    )
    return I.pending(table(spark, d, "documents"), scores, ["doc_id"], "p").select("doc_id", "lang")


@query(
    "p14_needs_body",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return I.needs_body(rows, "quality").select("doc_id")


def fetch_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a fetch log: users stand for sites, event types for answers."""
    names = ["ec", "eec", "nleec", "mercom", "saur", "pvmag", "pvmag_us", "pvmag_global"]
    sources = F.array(*[F.lit(n) for n in names])
    kind = F.when(F.col("value") < 10, "page").otherwise("item")
    status = (
        F.when(F.col("event_type") == "view", 200)
        .when(F.col("event_type") == "click", 404)
        .when(F.col("event_type") == "purchase", 500)
        .when(F.col("event_type") == "signup", 301)
    )
    source = F.get(sources, (F.col("user_id") % 8).cast("int"))
    return table(spark, d, "events").select(
        "event_id",
        source.alias("source"),
        # The API site has no article pages.
        F.when(source == "mercom", "page").otherwise(kind).alias("kind"),
        F.concat(F.lit("https://x.example/"), F.col("event_id")).alias("url"),
        status.alias("status"),
    )


_LOG = """SELECT *, CASE WHEN source = 'mercom' THEN 'page' WHEN value < 10 THEN 'page' ELSE 'item' END
    AS kind, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'purchase' THEN 500
             WHEN 'signup' THEN 301 END AS status
  FROM (SELECT *, ['ec','eec','nleec','mercom','saur','pvmag','pvmag_us','pvmag_global'][user_id % 8 + 1]
        AS source FROM events)"""
_ROUTED = f"""SELECT event_id, source, kind, status, CASE
    WHEN status = 200 THEN 'ok'
    WHEN status IS NULL AND source = 'nleec' AND kind = 'item' THEN 'dead'
    WHEN status IS NULL THEN 'raise'
    WHEN source IN ('ec', 'eec') THEN CASE kind WHEN 'page' THEN 'next' ELSE 'skip' END
    WHEN source = 'nleec' THEN CASE WHEN kind = 'page' THEN 'next'
         WHEN status = 404 THEN 'dead' ELSE 'skip' END
    WHEN source = 'mercom' THEN 'parse'
    WHEN kind = 'item' THEN 'null body'
    WHEN source LIKE 'pvmag%' AND status = 404 THEN 'end'
    ELSE 'retry' END AS outcome FROM ({_LOG})"""


@query("p15_route_status", f"SELECT event_id, source, kind, outcome FROM ({_ROUTED})")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return I.route_status(fetch_log(spark, d)).select("event_id", "source", "kind", "outcome")


@query(
    "p15_dead_letters",
    f"""SELECT CASE WHEN status = 404 THEN CAST(event_id AS VARCHAR)
          ELSE 'https://x.example/' || event_id END AS entry,
        CASE WHEN status = 404 THEN 'not found' ELSE 'request failed' END AS reason
        FROM ({_ROUTED}) WHERE outcome = 'dead'""",
)
def p15_dead(spark: SparkSession, d: str) -> DataFrame:
    return I.dead_letters(I.route_status(fetch_log(spark, d)))


# --- newsletter index ----------------------------------------------------------


def event_index(spark: SparkSession, d: str) -> DataFrame:
    """Events as newsletter links: a day, a category, a link; with copies."""
    return table(spark, d, "events").select(
        F.to_date("ts").alias("nl_date"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("u"), F.col("user_id")).alias("url"),
    )


_INDEX = """SELECT CAST(ts AS DATE) AS nl_date, event_type AS category, 'u' || user_id AS url
  FROM events"""


@query("a1_links_by_category", f"SELECT DISTINCT category, url FROM ({_INDEX})")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return N.links_by_category(event_index(spark, d))


@query("a2_link_count", f"SELECT count(*) AS n_links FROM (SELECT DISTINCT * FROM ({_INDEX}))")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return N.link_count(N.distinct_links(event_index(spark, d)))


@query(
    "a3_category_counts",
    f"SELECT category, count(DISTINCT url) AS n_links FROM ({_INDEX}) GROUP BY category",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    return N.category_counts(event_index(spark, d))


@query(
    "a7_days_with_links",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS nl_date,
       count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) > 0 AS has_any
       FROM orders GROUP BY 1""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("nl_date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("url"),
    )
    days = N.days_with_links(index)
    return days.select(F.col("nl_date").cast("string").alias("nl_date"), "has_any")


@query(
    "a7_done_days",
    """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day,
         count(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 1 END) > 0 AS good
         FROM orders GROUP BY 1)
       SELECT CAST(day AS VARCHAR) AS nl_date FROM days
       WHERE day <= (SELECT max(day) FROM days WHERE good)""",
)
def a7_done(spark: SparkSession, d: str) -> DataFrame:
    good = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    index = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("nl_date"), F.when(good, F.col("o_orderkey")).alias("url")
    )
    done = N.done_days(N.days_with_links(index))
    return done.select(F.col("nl_date").cast("string").alias("nl_date"))


_CATS = ("click", "error", "purchase", "signup", "view", "never")


@query(
    "a11_link_matrix",
    f"""SELECT CAST(g.nl_date AS VARCHAR) AS nl_date, g.category, i.url
        FROM (SELECT nl_date, unnest(['click','error','purchase','signup','view','never']) AS category
              FROM (SELECT DISTINCT nl_date FROM ({_INDEX}))) g
        LEFT JOIN (SELECT DISTINCT * FROM ({_INDEX})) i
        ON g.nl_date = i.nl_date AND g.category = i.category""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    index = event_index(spark, d)
    matrix = N.link_matrix(index, index, _CATS)
    return matrix.withColumn("nl_date", F.col("nl_date").cast("string"))


@query(
    "o1_order_by_name_length",
    """SELECT category, first_seen FROM (SELECT event_type AS category, min(event_id) AS first_seen
       FROM events GROUP BY 1) ORDER BY length(category) DESC, first_seen""",
)
def o1(spark: SparkSession, d: str) -> DataFrame:
    seen = (
        table(spark, d, "events")
        .groupBy(F.col("event_type").alias("category"))
        .agg(F.min("event_id").alias("first_seen"))
    )
    return N.order_by_name_length(seen)


@query("u3_link_union", f"SELECT DISTINCT href FROM ({_ANCHORS})")
def u3(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    return E.extract_anchors(pages).select("href").distinct()


@query(
    "u4_distinct_links",
    f"SELECT DISTINCT CAST(nl_date AS VARCHAR) AS nl_date, category, url FROM ({_INDEX})",
)
def u4(spark: SparkSession, d: str) -> DataFrame:
    links = N.distinct_links(event_index(spark, d))
    return links.withColumn("nl_date", F.col("nl_date").cast("string"))


@query(
    "s10_sets_as_json",
    f"""SELECT p.page_id, coalesce(to_json(list_sort(list_distinct(hs)))::VARCHAR, '[]') AS links
        FROM pages p LEFT JOIN (SELECT page_id, list(href) AS hs FROM ({_ANCHORS}) GROUP BY page_id) a
        USING (page_id)""",
)
def s10(spark: SparkSession, d: str) -> DataFrame:
    # The set is gathered inside the page it comes from; no rows are brought together.
    from newsloom.functions import markup as M

    page = table(spark, d, "pages").select("page_id", M.strip_noise("html").alias("page"))
    links = F.transform(M.flat_blocks(F.col("page"), "a"), lambda a: M.attribute(a, "href"))
    return page.select("page_id", N.set_as_json(links).alias("links"))


def newsletter_pages(spark: SparkSession, d: str) -> DataFrame:
    """Newsletter pages that link the articles of a source on one language's page."""

    def link(category: str, text: str) -> Column:
        target = F.concat(
            F.lit("https%3A%2F%2Fx.example%2F"), F.lit(f"{category}%2F"), F.col("doc_id").cast("string")
        )
        return F.concat(
            F.lit('<a href="https://m.example/?url='), target,
            F.lit(f'&amp;mailer_id=7"><b>{text}</b></a>'),
        )

    solar = link("news%2Frenewable", "Solar  up")
    html = F.concat(
        F.lit("<p>Hello</p>"),
        solar,
        solar,
        link("news%2Foil", " Read   More "),
        F.when(F.col("lang") == "fr", link("news%2Fcoal%2Fnews%2Fpower", "Both")).otherwise(""),
    )
    return table(spark, d, "documents").select(
        day_of_doc().alias("nl_date"), html.alias("html")
    )


@query(
    "p17_newsletter_links",
    """SELECT DISTINCT CAST(DATE '2024-01-01' + CAST(n_chars % 366 AS INT) AS VARCHAR) AS nl_date,
         c AS category, 'https://x.example/' || p || '/' || doc_id AS url
       FROM (SELECT *, unnest(CASE WHEN lang = 'fr' THEN ['renewable', 'coal', 'power']
                                   ELSE ['renewable'] END) AS c FROM documents)
       CROSS JOIN LATERAL (SELECT CASE c WHEN 'renewable' THEN 'news/renewable'
                                  ELSE 'news/coal/news/power' END AS p)""",
)
def newsletter(spark: SparkSession, d: str) -> DataFrame:
    links = N.newsletter_links(newsletter_pages(spark, d))
    return links.withColumn("nl_date", F.col("nl_date").cast("string"))
