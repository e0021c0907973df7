"""URL filter: rules first, then logistic regression on hashed character n-grams.

Rules are settings: a host and a path prefix with a verdict. URLs that no rule fits are
judged by a logistic regression on hashed character n-grams of host and path. It is
trained from a small labelled table, a sample of bounded size of URLs that rules judge.
All of it is DataFrame code; training runs in Spark's own optimiser.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import saved

#: (host, path prefix, verdict) of the filter.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: n-gram sizes, hashed features, most labelled URLs of each verdict.
SIZES, FEATURES, LABELLED = (2, 3, 4), 1 << 14, 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _until(text: Column, stops: str) -> Column:
    """``text`` up to the first of the ASCII characters ``stops``."""
    first = F.translate(text, stops, stops[0] * len(stops))
    return F.substring_index(first, stops[0], 1)


def host_of(url: Column) -> Column:
    """After the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(_until(_rest(url), "/?#"), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host to ``?``, ``#`` or the end."""
    rest = _rest(url)
    size = F.length(_until(rest, "/?#"))
    tail = F.substring(rest, size + 1, F.length(rest))
    before = F.length(_until(tail, "?#"))
    return F.coalesce(F.substring(tail, F.lit(1), before), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Shortest first: each longer rule that fits goes over it.
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column, sizes=SIZES) -> Column:
    """All character n-grams of a marked text, with repeats."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.concat(*map(of_size, sizes))


def features(df: DataFrame, size: int = FEATURES) -> DataFrame:
    """``df`` (with ``host`` and ``path``) and the hashed n-grams as ``features``."""
    marked = df.withColumn("grams", grams(F.concat(F.lit("^"), "host", F.lit("|"), "path", F.lit("$"))))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=size, binary=True).transform(marked).drop("grams")


def labelled(judged: DataFrame, most: int = LABELLED) -> DataFrame:
    """The labelled table: of each verdict, the distinct URLs of least hash, bounded.

    ``judged`` has ``host, path, rule, verdict``.
    """
    urls = judged.where(F.col("rule").isNotNull()).select("host", "path", "verdict").distinct()
    urls = urls.withColumn("order", F.xxhash64("host", "path"))
    halves = [urls.where(F.col("verdict") == v).orderBy("order", "host", "path").limit(most) for v in ("allow", "block")]
    return halves[0].unionByName(halves[1]).drop("order")


def train(table: DataFrame, size: int = FEATURES, max_iter: int = 30, penalty: float = 0.01):
    """A model of ``host, path, verdict``, or the only verdict, or "allow" if none."""
    found = sorted(r[0] for r in table.select("verdict").distinct().limit(2).collect())
    if len(found) < 2:
        return (found or ["allow"])[0]
    rows = features(table, size).select("features", (F.col("verdict") == "block").cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=penalty, standardization=False).fit(rows)


def filter_urls(pages: DataFrame, rules=RULES, most: int = LABELLED, size: int = FEATURES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score``, one row per row of ``pages``.

    Null urls and such without ``://`` have an empty host and path, which no rule fits;
    the model judges them as it does any other. ``block_score`` is the model's
    probability, null where a rule decides. Other columns of ``pages`` don't matter.
    """
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict")
    )
    model = train(saved(labelled(judged, most), "labelled-urls"), size)
    if isinstance(model, str):
        score = F.lit(float(model == "block"))
        scored = judged.withColumn("score", score)
    else:
        scored = model.setProbabilityCol("probability").setPredictionCol("").setRawPredictionCol("").transform(features(judged, size))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", own).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("block_score"),
    )
