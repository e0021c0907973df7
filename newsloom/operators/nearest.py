"""Nearest words of many words at once: exactly in blocks, or over a hash index.

Words are points on the unit sphere. Equal points are one point, with as many of their
names as a list of neighbours can hold, so copies of a vector make no pairs among
themselves. The exact way multiplies blocks of points with blocks of asked words. The
index has for each point the keys of random projections in several tables; only points
that share a key with an asked word are compared with it, block by block too, so that
pairs are never rows: a block hands on the best of each word alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from newsloom.session import fresh_path

#: Tables of an index, projections of a key, width of a projection's bucket, seed.
TABLES, PROJECTIONS, BUCKET, SEED = 24, 4, 0.5, 5
#: Points and asked words that a task multiplies at once, and how many times as many it
#: is given at most; blocks of points from which on blocks grow instead.
POINTS, ASKED, HELD_POINTS, HELD_ASKED, BLOCKS = 16_384, 1024, 4, 64, 32
#: Rows of a product that are searched at once.
SEARCHED = 128


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def unit(vectors: DataFrame, name: str = "word", vector: str = "vector") -> DataFrame:
    """``name, v``: vectors of length one. Rows without a direction are left out: null
    names, null, empty and zero vectors, and such that hold a null or no finite number."""
    v = F.col("v")
    rows = vectors.select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("name").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = rows.withColumn("length", F.sqrt(_dot(v, v))).filter((F.col("length") > 0) & (F.col("length") < float("inf")))
    return rows.select("name", F.transform(v, lambda x: x / F.col("length")).alias("v"))


def points(vectors: DataFrame, most: int) -> DataFrame:
    """``point, v, names``: distinct vectors with the ``most`` least of their names."""
    rows = vectors.withColumn("point", F.xxhash64("v"))
    order = W.partitionBy("point").orderBy("name")
    few = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    return few.groupBy("point").agg(F.any_value("v").alias("v"), F.array_sort(F.collect_list("name")).alias("names"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _listed(found: DataFrame, all_points: DataFrame, k: int) -> DataFrame:
    """The ``k`` best names for each asked word of ``asked, point, similarity``."""
    named = found.join(all_points.select("point", F.explode("names").alias("neighbour")), "point")
    named = named.filter(F.col("neighbour") != F.col("asked"))
    best = W.partitionBy("asked").orderBy(F.desc("similarity"), "neighbour")
    ranked = named.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return ranked.select("asked", "place", "neighbour", "similarity")


def _best(every: DataFrame, words: DataFrame, k: int, points_: int, asked_: int, keyed: bool = False) -> DataFrame:
    """``asked, point, similarity``: the ``k + 1`` best points of each asked word.

    With ``keyed`` only points are compared that share one of their ``keys`` with the word.
    A task is given one block of points and one lot of asked words. Blocks and lots are as
    large as it can hold, since each block is sent every asked word.
    """
    n, m = every.count(), words.count()
    blocks = max(1, min(-(-n // points_), BLOCKS), -(-n // (points_ * HELD_POINTS)))
    lots = max(1, -(-m // (asked_ * HELD_ASKED)))

    def dealt(df: DataFrame, key: str, mine: str, n: int, other: str, m: int) -> DataFrame:
        # Of one type on both sides: numbers that differ in it are hashed to different partitions.
        return df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    keys = ["keys"] if keyed else []
    left = dealt(every.select("point", "v", F.get("names", F.lit(0)).alias("first"), *keys), "point", "block", blocks, "lot", lots)
    right = dealt(words.select("asked", "v", *keys), "asked", "lot", lots, "block", blocks)

    def shares(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Which of two lists of keys (a row per vector, a column per table) have one in common."""
        out = np.zeros((len(mine), len(theirs)), bool)
        for a, b in zip(mine.T, theirs.T):
            keys, place = np.unique(a, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, b), len(keys) - 1)
            kind = np.int16 if len(keys) < 2**15 else np.int32
            out |= place.astype(kind)[:, None] == np.where(keys[at] == b, at, -1).astype(kind)[None, :]
        return out

    def top(rows: np.ndarray, order: np.ndarray, similar: np.ndarray, most: int) -> np.ndarray:
        """Places of the ``most`` best entries of each row; equal ones go by ``order``."""
        by = np.lexsort((order, -similar, rows))
        first = np.flatnonzero(np.r_[True, rows[by][1:] != rows[by][:-1]])
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
        return by[place < most]

    def near(x: np.ndarray, y: np.ndarray, kx, ky, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``x``, rows of ``y`` and similarities of the best of each row of ``x``."""
        found = []
        for at in range(0, len(y), points_):
            chosen = np.arange(at, min(len(y), at + points_))
            if keyed:
                shared = shares(kx, ky[chosen])
                some = shared.any(0)
                chosen, shared = chosen[some], shared[:, some]
            if not len(chosen):
                continue
            similar = x @ y[chosen].T
            if keyed:
                similar[~shared] = -np.inf
            for row in range(0, len(x), SEARCHED):
                part = similar[row : row + SEARCHED]
                # Of equal similarities at the end all are looked at, the least names stay.
                cut = part.shape[1] - (k + 1)
                least = np.partition(part, cut, 1)[:, cut : cut + 1] if cut > 0 else -np.inf
                r, c = np.nonzero((part >= least) & (part > -np.inf))
                best = top(r, order[chosen[c]], part[r, c], k + 1)
                found.append((row + r[best], chosen[c[best]], part[r[best], c[best]]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        rows, cols, similar = map(np.concatenate, zip(*found))
        best = top(rows, order[cols], similar, k + 1)
        return rows[best], cols[best], similar[best]

    def best(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"asked": those["asked"][:0], "point": these["point"][:0], "first": these["first"][:0], "similarity": np.zeros(0)})]
        alike = dict(iter(these.groupby(these["v"].str.len())))
        for length, part in those.groupby(those["v"].str.len()):
            if length not in alike:
                continue
            mine = alike[length]
            y, order = np.stack(mine["v"]), mine["first"].rank(method="first").to_numpy()
            ky = np.stack(mine["keys"]) if keyed else None
            if keyed:
                # Words of a key follow each other, so that they are compared with fewer points.
                part = part.iloc[np.argsort([keys[0] for keys in part["keys"]], kind="stable")]
            for at in range(0, len(part), asked_):
                some = part.iloc[at : at + asked_]
                kx = np.stack(some["keys"]) if keyed else None
                rows, cols, similar = near(np.stack(some["v"]), y, kx, ky, order)
                out.append(pd.DataFrame({
                    "asked": some["asked"].to_numpy()[rows], "point": mine["point"].to_numpy()[cols],
                    "first": mine["first"].to_numpy()[cols], "similarity": similar,
                }))
        return pd.concat(out) if len(out) < 2 else pd.concat(out[1:])

    kinds = [df.schema[c].dataType for df, c in ((words, "asked"), (every, "names"))]
    schema = f"asked {kinds[0].simpleString()}, point long, first {kinds[1].elementType.simpleString()}, similarity double"
    found = left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInPandas(best, schema)
    # Each point has a name at least: of the best points that many are enough.
    order = W.partitionBy("asked").orderBy(F.desc("similarity"), "first")
    ranked = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1)
    return ranked.select("asked", "point", "similarity")


def nearest_exact(vectors: DataFrame, asked: DataFrame, k: int, points_: int = POINTS, asked_: int = ASKED, every: DataFrame | None = None) -> DataFrame:
    """``asked, place, neighbour, similarity``: the ``k`` words nearest to each asked word.

    Both frames are ``name, v`` of ``unit``; a word is no neighbour of itself. Equal
    similarities go by name. A task multiplies blocks of points with blocks of asked
    words and hands on the best of each word alone. ``every`` are the ``points`` of
    ``vectors`` with ``k + 1`` names, where they are written already.
    """
    every = _written(points(vectors, k + 1), "points") if every is None else every
    words = _written(asked.withColumnRenamed("name", "asked"), "asked")
    return _listed(_best(every, words, k, points_, asked_), every, k)


class HashIndex:
    """An index of unit vectors ``name, v`` by random projections, written under ``path``.

    Each point has ``tables`` keys, each of ``projections`` numbers cut into buckets. More
    tables find more; more projections, or narrower buckets, compare less. Each point is
    in the index, and no bucket is cut short.
    """

    def __init__(self, vectors: DataFrame, most: int, tables: int = TABLES, projections: int = PROJECTIONS, bucket: float = BUCKET, seed: int = SEED):
        self.tables, self.projections, self.bucket, self.seed = tables, projections, bucket, seed
        self.points = _written(self.keyed(points(vectors, most)), "points")
        self.keys = self.points.select("point", F.explode("keys").alias("key"))

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` and the ``keys`` of each vector ``v``, one for each table."""
        tables, projections, bucket, seed = self.tables, self.projections, self.bucket, self.seed

        def run(batches):
            for batch in batches:
                for _, part in batch.groupby(batch["v"].str.len()):
                    x = np.stack(part["v"])
                    rng = np.random.default_rng([seed, x.shape[1]])
                    axes = rng.standard_normal((x.shape[1], tables * projections))
                    axes /= np.linalg.norm(axes, axis=0)
                    shift = rng.random(tables * projections)
                    cells = np.floor(x @ axes / bucket + shift).astype(np.int64)
                    cells = cells.reshape(len(x), tables, projections)
                    # One number for the table and its buckets.
                    mix = np.uint64(0x9E3779B97F4A7C15)
                    keys = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * mix, cells.shape[:2]).copy()
                    for p in range(projections):
                        keys = (keys ^ cells[:, :, p].view(np.uint64)) * mix
                        keys ^= keys >> np.uint64(31)
                    yield part.assign(keys=list(keys.view(np.int64)))

        return rows.mapInPandas(run, StructType([*rows.schema, StructField("keys", ArrayType(LongType()))]))

    def nearest(self, asked: DataFrame, k: int) -> DataFrame:
        """As ``nearest_exact``, among the points that share a key with an asked word."""
        words = _written(self.keyed(asked.withColumnRenamed("name", "asked")), "asked")
        return _listed(_best(self.points, words, k, POINTS, ASKED, keyed=True), self.points, k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``asked, n, hits``: how many of each word's neighbours were found."""
    hit = found.select("asked", "neighbour", F.lit(1).alias("hit"))
    return exact.join(hit, ["asked", "neighbour"], "left").groupBy("asked").agg(
        F.count("*").alias("n"), F.count("hit").alias("hits")
    )
