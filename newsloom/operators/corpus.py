"""Text to tokens, vocabulary, word vectors and nearest words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import packed as P
from newsloom.operators import vectors as V

# Words with inner apostrophes or hyphens, single symbols, and runs of line breaks.
# Punctuation never becomes a token; line breaks do. The group is possessive, as a
# group that may step back is matched by recursion and a long enough chain of
# hyphens would overflow the stack.
_WORD = r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*+"
TOKEN_NO_BREAKS = _WORD + r"|\p{S}"
TOKEN = TOKEN_NO_BREAKS + r"|[\r\n]+"

# Word-vector settings and the length of a nearest-words list.
VECTOR_SIZE = 300
MIN_COUNT = 5
EPOCHS = 30
NEAREST = 20


# The English stop words that Spark comes with.
STOPWORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him
    his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above
    below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor
    not only own same so than too very s t can will just don should now i'll you'll
    he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's
    she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
    haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
    mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
"""


def default_stopwords() -> list[str]:
    """Spark's English list; it can be had without a session here."""
    return STOPWORDS.split()


def tokenize(text: Column | str, keep_breaks: bool = True) -> Column:
    """Tokens of a text, in order and as written."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = TOKEN if keep_breaks else TOKEN_NO_BREAKS
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def drop_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens that are no stop word in any case."""
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*stopwords))


def preprocess(
    docs: DataFrame,
    text: str = "text",
    stopwords: list[str] | None = None,
    lemmas: DataFrame | None = None,
    keep_breaks: bool = True,
    key: str = "doc_id",
) -> DataFrame:
    """``(key, tokens)``: tokenized, stop words out, lemma taken, lower-cased."""
    stopwords = default_stopwords() if stopwords is None else stopwords
    tokens = drop_stopwords(tokenize(text, keep_breaks), stopwords)
    rows = docs.select(key, tokens.alias("tokens"))
    if lemmas is not None:
        rows = lemmatize(rows, lemmas, key)
    return rows.withColumn("tokens", F.transform("tokens", F.lower))


def lemmatize(docs: DataFrame, lemmas: DataFrame, key: str = "doc_id") -> DataFrame:
    """Replace each token by its lemma from ``(token, lemma)``; unknown ones stay.

    Only tokens that change their form leave a document: they are looked up with their
    places, gathered per document, sorted in among its tokens and take the place of the
    one before them, in one pass. Documents that share a key do no harm. The lemma table
    has one row per token.
    """
    forms = lemmas.select("token", "lemma").filter("lemma IS NOT NULL AND token <> lemma")
    asked = docs.select(key, F.posexplode("tokens").alias("i", "token"))
    found = (
        asked.join(forms, "token")
        .groupBy(F.col(key).alias("_key"))
        .agg(F.collect_set(F.struct("i", F.col("token").alias("w"), F.lit(1).alias("f"), F.col("lemma").alias("l"))).alias("_new"))
    )
    none = F.lit(None).cast("string").alias("l")
    plain = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t.alias("w"), F.lit(0).alias("f"), none))
    both = F.array_sort(F.concat(plain, "_new")).alias("_both")

    def form(x: Column, j: Column) -> Column:
        after = F.get("_both", j + 1)
        changed = (after["f"] == 1) & (after["i"] == x["i"]) & (after["w"] == x["w"])
        return F.when(x["f"] == 0, F.when(changed, after["l"]).otherwise(x["w"]))

    rest = [c for c in docs.columns if c != "tokens"]
    rows = docs.join(found, docs[key] == found["_key"], "left").select(*rest, "tokens", "_new", both)
    return rows.select(
        *rest,
        # A new form itself leaves a null; tokens are never null.
        F.when(F.col("_new").isNull(), F.col("tokens"))
        .otherwise(F.array_compact(F.transform("_both", form)))
        .alias("tokens"),
    )


def vocabulary(
    docs: DataFrame, min_count: int = MIN_COUNT, tokens: str = "tokens"
) -> DataFrame:
    """Tokens seen at least ``min_count`` times: ``(token, n)``."""
    return (
        docs.select(F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


def text_vocabulary(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    text: str = "text",
    stopwords: list[str] | None = None,
    keep_breaks: bool = True,
) -> DataFrame:
    """``vocabulary`` of texts as ``preprocess`` would leave them, without lemmas.

    Tokens are counted as written first; stop words are dropped and case is folded on
    the distinct tokens only.
    """
    stopwords = default_stopwords() if stopwords is None else stopwords
    raw = (
        docs.select(F.explode(tokenize(text, keep_breaks)).alias("raw"))
        .groupBy("raw")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = raw.select(F.lower("raw").alias("token"), "n")
    if stopwords:
        rows = rows.filter(~F.col("token").isin(*stopwords))
    return rows.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def corpus_size(docs: DataFrame) -> DataFrame:
    """How many documents the corpus has."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def token_counts(docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Tokens per document."""
    return docs.select(key, F.size(tokens).alias("n_tokens"))


def vocab_union(corpus: DataFrame, pretrained: DataFrame) -> DataFrame:
    """Corpus vocabulary ``(token, n)`` with the words of a pretrained list added.

    A word of the list counts once, as if the list were one more document.
    """
    words = pretrained.select(F.col("word").alias("token"), F.lit(1).cast("bigint").alias("n"))
    return (
        corpus.select("token", "n")
        .unionByName(words)
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
    )


def shuffled(docs: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """The rows in a random order that a seed repeats."""
    return docs.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def train_vectors(
    docs: DataFrame,
    size: int = VECTOR_SIZE,
    min_count: int = MIN_COUNT,
    epochs: int = EPOCHS,
    seed: int = 42,
    window: int = V.WINDOW,
    tokens: str = "tokens",
    block: int = V.BLOCK,
) -> DataFrame:
    """``(word, vector)`` of each word seen ``min_count`` times, trained on the corpus.

    Vectors are the leading factors of the words' mutual information, found in at most
    ``epochs`` passes over it; the passes end when one finds nothing more. The same corpus
    and seed give the same vectors, however the corpus is spread. Where the corpus has
    fewer directions than ``size`` the last numbers are zero. ``docs`` is read twice.
    """
    words = V._written(V.number_words(vocabulary(docs, min_count, tokens)), "vector-words")
    return P.Matrix(docs, words, size, window, tokens, block).vectors(epochs, seed)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision."""
    a = a.cast("array<double>")
    b = b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def most_similar(
    vectors: DataFrame,
    word,
    k: int = NEAREST,
    name: str = "word",
    vector: str = "vector",
) -> DataFrame:
    """The ``k`` words nearest to ``word`` by cosine, the word itself left out.

    The one query vector is looked up first and put into the plan as a literal, so
    the table is read once and each task keeps its own best ``k``.
    """
    asked = vectors.filter(F.col(name) == word).select(vector).first()
    schema = "`{}` {}, similarity double".format(
        name, vectors.schema[name].dataType.simpleString()
    )
    if asked is None:
        return vectors.sparkSession.createDataFrame([], schema)
    query = [float(x) for x in asked[0]]
    norm = sum(x * x for x in query) ** 0.5
    literal = F.array(*[F.lit(x) for x in query])
    row = F.col(vector).cast("array<double>")
    product = F.aggregate(
        F.zip_with(row, literal, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p
    )
    square = F.aggregate(row, F.lit(0.0), lambda s, p: s + p * p)
    return (
        vectors.filter(F.col(name) != word)
        .select(name, F.try_divide(product, F.sqrt(square) * F.lit(norm)).alias("similarity"))
        .orderBy(F.col("similarity").desc(), name)
        .limit(k)
    )


