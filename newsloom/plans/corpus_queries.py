"""Corpus, vocabulary and word-vector queries over whole tables."""

from __future__ import annotations

from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import truncate_tokens
from newsloom.operators import corpus as K
from newsloom.operators import nearest as NN
from newsloom.plans.registry import query, quote, sql_list, table
from newsloom.session import fresh_path
from newsloom.sources import files as I

STOP = K.default_stopwords()
# The other engine has no possessive groups; nothing follows this one, so it is the same.
SQL_TOKEN = K.TOKEN.replace(")*+", ")*")

_TOKENS = f"""SELECT doc_id, list_filter(regexp_extract_all(text, {quote(SQL_TOKEN)}),
  lambda t: NOT list_contains({sql_list(STOP)}, lower(t))) AS kept FROM documents"""
SQL_CORPUS = f"SELECT doc_id, list_transform(kept, lambda t: lower(t)) AS tokens FROM ({_TOKENS})"
_WORDS = f"SELECT doc_id, unnest(tokens) AS token FROM ({SQL_CORPUS})"
SQL_VOCAB = f"SELECT token, count(*) AS n FROM ({_WORDS}) GROUP BY token HAVING count(*) >= 5"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return K.preprocess(table(spark, d, "documents"))


def stored_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The same, written down first, for steps that read it more than once."""
    path = fresh_path(spark, "tokens")
    I.write_tokens(corpus(spark, d), path)
    return I.read_tokens(spark, path)


@query(
    "p19_filter_tokens",
    f"SELECT doc_id, array_to_string(kept, ' ') AS kept FROM ({_TOKENS})",
)
def p19(spark: SparkSession, d: str) -> DataFrame:
    kept = K.drop_stopwords(K.tokenize("text"), STOP)
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, " ").alias("kept"))


@query(
    "m1_preprocess",
    f"SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM ({SQL_CORPUS})",
)
def m1(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("a4_vocabulary", SQL_VOCAB)
def a4(spark: SparkSession, d: str) -> DataFrame:
    return K.text_vocabulary(table(spark, d, "documents"))


@query("a5_corpus_size", "SELECT count(*) AS n_docs FROM documents")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return K.corpus_size(table(spark, d, "documents"))


@query("a8_token_counts", f"SELECT doc_id, CAST(len(tokens) AS INT) AS n_tokens FROM ({SQL_CORPUS})")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return K.token_counts(corpus(spark, d))


# Plural forms whose singular is in the vocabulary too.
_LEMMAS = f"""SELECT v.token, left(v.token, len(v.token) - 1) AS lemma FROM ({SQL_VOCAB}) v
  WHERE v.token LIKE '%s' AND left(v.token, len(v.token) - 1) IN (SELECT token FROM ({SQL_VOCAB}))"""


def plural_lemmas(vocab: DataFrame) -> DataFrame:
    """A lemma table out of the corpus itself: plural to singular."""
    # A word stands under itself, and a plural under its singular too.
    forms = vocab.select(
        "token",
        F.explode(
            F.array(
                F.struct(F.col("token").alias("lemma"), F.lit(False).alias("plural")),
                F.struct(
                    F.when(
                        F.col("token").endswith("s"),
                        F.expr("left(token, length(token) - 1)"),
                    ).alias("lemma"),
                    F.lit(True).alias("plural"),
                ),
            )
        ).alias("f"),
    ).select("token", "f.*")
    return (
        forms.filter(F.col("lemma").isNotNull())
        .groupBy("lemma")
        .agg(
            F.max(F.when(F.col("plural"), F.col("token"))).alias("token"),
            F.bool_or(~F.col("plural")).alias("known"),
        )
        .filter(F.col("known") & F.col("token").isNotNull())
        .select("token", "lemma")
    )


@query(
    "j9_lemmatize",
    f"""WITH lemmas AS ({_LEMMAS}),
        pos AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i
                FROM ({SQL_CORPUS}))
        SELECT c.doc_id, coalesce(t.tokens, '') AS tokens FROM documents c LEFT JOIN
        (SELECT doc_id, string_agg(coalesce(lemma, pos.token), ' ' ORDER BY i) AS tokens
         FROM pos LEFT JOIN lemmas ON pos.token = lemmas.token GROUP BY doc_id) t
        ON c.doc_id = t.doc_id""",
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    docs = stored_corpus(spark, d)
    done = K.lemmatize(docs, plural_lemmas(K.vocabulary(docs)))
    return done.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "u2_vocab_union",
    f"""SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT token, n FROM ({SQL_VOCAB}) UNION ALL
          SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token, 1 AS n FROM conversations)
        GROUP BY token""",
)
def u2(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select(
        F.explode(F.split(F.lower("text"), " ")).alias("word")
    )
    return K.vocab_union(K.text_vocabulary(table(spark, d, "documents")), words.distinct())


@query("o2_shuffled", "SELECT doc_id, lang, source FROM documents")
def o2(spark: SparkSession, d: str) -> DataFrame:
    return K.shuffled(table(spark, d, "documents"), 42).select("doc_id", "lang", "source")


def _sql_nearest(word: int, k: int) -> str:
    return f"""SELECT vec_id, round(similarity, 6) AS similarity FROM (
      SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]),
        CAST(q.embedding AS DOUBLE[])) AS similarity
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {word}) q
      WHERE e.vec_id <> {word} ORDER BY similarity DESC, e.vec_id LIMIT {k})"""


def _nearest(spark: SparkSession, d: str, word: int, k: int) -> DataFrame:
    near = K.most_similar(table(spark, d, "embeddings"), word, k, "vec_id", "embedding")
    return near.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("o3_most_similar", _sql_nearest(0, 20))
def o3(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 0, K.NEAREST)


@query("m3_nearest_words", _sql_nearest(7, 10))
def m3(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 7, 10)


def _words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those asked for: every fiftieth."""
    vectors = table(spark, d, "embeddings")
    return (NN.unit(v, "vec_id", "embedding") for v in (vectors, vectors.filter("vec_id % 50 = 0")))


_SQL_PAIRS = """SELECT q.vec_id AS asked, e.vec_id AS neighbour,
    list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS similarity
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0"""


@query(
    "o3_nearest_of_many",
    f"""SELECT asked, CAST(place AS INT) AS place, neighbour, round(similarity, 6) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, neighbour) AS place
        FROM ({_SQL_PAIRS})) WHERE place <= 20""",
)
def o3_many(spark: SparkSession, d: str) -> DataFrame:
    near = NN.nearest_exact(*_words(spark, d), K.NEAREST)
    return near.withColumn("similarity", F.round("similarity", 6))


@query(
    "m3_index_recall",
    "SELECT count(*) AS asked, 20 * count(*) AS neighbours, true AS found_most FROM embeddings WHERE vec_id % 50 = 0",
)
def m3_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index beside the exact way: nine in ten of all neighbours, or more."""
    vectors, asked = _words(spark, d)
    index = NN.HashIndex(vectors, K.NEAREST + 1)
    exact = NN.nearest_exact(vectors, asked, K.NEAREST, every=index.points)
    found = index.nearest(asked, K.NEAREST)
    return NN.recall(exact, found).agg(
        F.count("*").alias("asked"), F.sum("n").alias("neighbours"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("found_most")
    )


@query(
    "m2_train_vectors",
    f"SELECT token AS word, {K.VECTOR_SIZE} AS dim, true AS finite FROM ({SQL_VOCAB})",
)
def m2(spark: SparkSession, d: str) -> DataFrame:
    """Values of a trainer cannot be told in SQL; vocabulary and shape can."""
    vectors = K.train_vectors(stored_corpus(spark, d))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))
    return vectors.select(
        "word", F.size("vector").alias("dim"), finite.alias("finite")
    )


@query(
    "m5_truncate_tokens",
    f"SELECT doc_id, array_to_string(tokens[1:128], ' ') AS tokens FROM ({SQL_CORPUS})",
)
def m5(spark: SparkSession, d: str) -> DataFrame:
    cut = truncate_tokens("tokens", 128)
    return corpus(spark, d).select("doc_id", F.array_join(cut, " ").alias("tokens"))


@query(
    "d3_batched_tokenizer",
    """SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'),
       lambda w: w <> ''), ' ') AS words FROM documents""",
)
def d3(spark: SparkSession, d: str) -> DataFrame:
    tokenizer = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+")
    return tokenizer.transform(table(spark, d, "documents")).select(
        "doc_id", F.array_join("words", " ").alias("words")
    )
