"""Near-duplicates by SimHash, with BK-trees for the search.

Documents become 64-bit fingerprints; equal ones are one point from then on, however
many copies there are. Points that differ in at most ``RADIUS`` bits link.

The trees are shards. Each fingerprint is cut into ``PARTS`` parts; two that differ in
at most ``RADIUS`` bits agree in at least ``PARTS - RADIUS`` of them, so both are found
under a shard key made of these parts. A shard's BK-tree hangs each point under its
parent by the integer Hamming distance to it, and a search from a node at distance d
follows only the edges d - radius to d + radius. Trees go to their points by a shuffle on
the shard key: as a broadcast they would be all fingerprints of the corpus on every
executor. A task grows all trees of its bucket at once, level by level.

Of a tree only a spanning set of links leaves the task, never all pairs. Components of
the links are found by joins on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import ids_back, importable, keyed_texts, saved, with_row

WORDS, RADIUS, PARTS, SEED = 3, 2, 4, 42
#: Points of a bucket of trees, and (query, node) pairs that a search holds at once.
BUCKET, FRONT = 60_000, 1 << 19
#: Shingles whose bits are counted at once.
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned SimHash of the whole text's word shingles, repeats included.

    A-Z are lower-cased; words are cut at ASCII white space; shingles are joined by a
    blank. Fewer words than a shingle: all of them are one. No word (or null): 0. A bit
    is set if it is set in more than half of the shingles' XXH64.
    """
    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return int.from_bytes(digest(joined, seed), "big")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        hashes = b"".join(
            [digest(joined[a:b], seed) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` columns ``doc_id`` and the fingerprint as a signed long ``fp``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = np.fromiter(map(fingerprint, batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": got.view(np.int64)})

    return ids_back(keyed_texts(docs).mapInPandas(run, "doc_id string, fp long"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """BK-trees of many shards as arrays, grown level by level.

    ``shard`` and ``points`` are sorted by shard; a shard's first point is its root.
    """

    def __init__(self, shard: np.ndarray, points: np.ndarray):
        self.points, n = points, len(points)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, int)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        waiting, node = np.flatnonzero(~first), self.root[~first]
        while len(waiting):
            d = distance(points[waiting], points[node]).astype(np.int64)
            _, place, group = np.unique(node * 65 + d, return_index=True, return_inverse=True)
            child = waiting[place]
            self.parent[child], self.edge[child] = node[place], d[place]
            stays = np.ones(len(waiting), bool)
            stays[place] = False
            node, waiting = child[group][stays], waiting[stays]
        # Children in order of (parent, edge): those of an edge range are a slice.
        self.kids = np.flatnonzero(self.parent >= 0)
        self.kids = self.kids[np.lexsort((self.edge[self.kids], self.parent[self.kids]))]
        self.keys = self.parent[self.kids] * 65 + self.edge[self.kids]

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (point, other point of its shard) at most ``radius`` apart.

        The front of the search is a stack of bounded slices, depth first.
        """
        n = len(self.points)
        stack = [(np.arange(a, min(n, a + FRONT)), self.root[a : a + FRONT]) for a in range(0, n, FRONT)]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = distance(self.points[query], self.points[node]).astype(np.int64)
            near = (d <= radius) & (node < query)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            count = high - low
            some = count > 0
            query, low, count = query[some], low[some], count[some]
            if len(query):
                # Bounded parts: one node may have 65 children.
                cuts = np.flatnonzero(np.diff(np.cumsum(count) // FRONT)) + 1
                for q, lo, c in zip(*(np.split(x, cuts) for x in (query, low, count))):
                    steps = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    stack.append((np.repeat(q, c), self.kids[np.repeat(lo, c) + steps]))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each point's component, by pointer jumping."""
    label = np.arange(n)

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if (up == x).all():
                return x
            x = up

    for a, b in pairs:
        while True:
            a, b = top(a), top(b)
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    return top(np.arange(n))


def part_masks(parts: int) -> list[int]:
    """The 64 bits cut into ``parts`` of nearly equal width."""
    cuts = [round(i * 64 / parts) for i in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def halves(mask: int) -> list[int]:
    """A run of bits as two runs."""
    low, width = mask & -mask, mask.bit_count()
    first = low * ((1 << width // 2) - 1)
    return [first, mask - first]


def shard_masks(radius: int = RADIUS, parts: int = PARTS) -> tuple[list[int], list[tuple[int, int]]]:
    """Masks of the bits that a near pair must share, one of them at least.

    The second list has finer masks ``(number of the mask, mask)`` for shards that are
    too large: of the bits left, cut in halves, a near pair shares all but ``radius``.
    """
    every = part_masks(parts)
    top, finer = [], []
    for chosen in combinations(every, parts - radius):
        rest = [h for m in every if m not in chosen for h in halves(m)]
        for more in combinations(rest, len(rest) - radius):
            finer.append((len(top), sum(chosen) + sum(more)))
        top.append(sum(chosen))
    return top, finer


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def shards(points: DataFrame, radius: int = RADIUS, parts: int = PARTS, limit: int = BUCKET) -> DataFrame:
    """``part, key, fp``: the shards of distinct points, each of a bounded size.

    A key is the fingerprint's bits under a mask. A shard of more than ``limit`` points
    is cut once more by finer masks; what is left free then, 16 bits for a radius of 2,
    bounds its points. Points alone in their shard are left out: they have no pair there.
    """
    top, finer = shard_masks(radius, parts)
    keys = ", ".join(f"struct({k} AS part, fp & {_signed(m)}L AS key)" for k, m in enumerate(top))
    by = Window.partitionBy("part", "key")
    first = (
        points.selectExpr("fp", f"inline(array({keys}))")
        .withColumn("n", F.count("*").over(by))
        .where("n > 1")
    )
    rows = [(k, len(top) + i, _signed(m)) for i, (k, m) in enumerate(finer)]
    masks = points.sparkSession.createDataFrame(rows, "part int, finer int, mask long")
    # A table of a fixed number of rows.
    large = first.where(F.col("n") > limit).join(F.broadcast(masks), "part")
    large = large.select(F.col("finer").alias("part"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return first.where(F.col("n") <= limit).select("part", "key", "fp").unionByName(large)


def links(points: DataFrame, n: int, radius: int = RADIUS, parts: int = PARTS, limit: int = BUCKET) -> DataFrame:
    """Spanning links ``a, b`` between the ``n`` distinct ``fp`` of ``points``."""
    importable(points.sparkSession)
    buckets = max(1, -(-comb(parts, radius) * n // BUCKET))
    sharded = shards(points, radius, parts, limit)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "key", "fp"], kind="stable")
        part, key = group["part"].to_numpy(), group["key"].to_numpy()
        shard = np.r_[0, np.cumsum((part[1:] != part[:-1]) | (key[1:] != key[:-1]))]
        points = group["fp"].to_numpy().view(np.uint64)
        forest = Forest(shard, points)
        label = spanning(len(points), forest.within(radius))
        linked = np.flatnonzero(label != np.arange(len(points)))
        return pd.DataFrame({"a": points[label[linked]].view(np.int64), "b": points[linked].view(np.int64)})

    bucket = F.pmod(F.xxhash64("part", "key"), F.lit(buckets)).alias("bucket")
    return sharded.select(bucket, "part", "key", "fp").groupBy("bucket").applyInPandas(run, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of links ``a, b``; root is the least node.

    Alternates large stars (greater neighbours go to the least one) and small stars
    (lesser neighbours go to the least one) until nothing changes. Each round is a
    written table.
    """
    edges = saved(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = saved(small.where("u != v").distinct(), "small-star")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(points: DataFrame, radius: int, parts: int) -> DataFrame:
    """``fp, root`` for distinct ``fp``: the least fingerprint that links reach."""
    found = components(links(points.select("fp"), points.count(), radius, parts))
    # Only points with links are in there; all others are their own component.
    near = points.join(found, F.col("fp") == F.col("node"), "left")
    return near.withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach, itself included (null
    if all ids in reach are null). Rows of equal ids are rows of their own.
    """
    rows = saved(fingerprints(docs), "fingerprints")
    roots = saved(_named(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, parts), "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(roots.join(ids, "root").select("fp", "component_id"), "named")
    # A fingerprint of very many copies: adaptive execution splits it in this join.
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """One row of each component, all columns: the one with the smallest ``doc_id``.

    Null ids come last. Of rows with the same id and fingerprint the least hash of the
    text stays, and of rows that are equal in that too, one.
    """
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    text_hash = F.xxhash64(F.col("text").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = np.fromiter(map(fingerprint, batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "hash": batch["hash"], "fp": got.view(np.int64)})

    rows = keyed_texts(docs).withColumn("hash", F.xxhash64("text"))
    rows = ids_back(rows.mapInPandas(run, "doc_id string, hash long, fp long"))
    points = saved(rows.groupBy("fp").agg(F.min(rank).alias("least")), "points")
    best = _named(points, radius, parts).groupBy("root").agg(F.min("least").alias("least"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    stay = best.select(F.coalesce("least.doc_id", F.lit(-(2**63))).alias("key"), F.col("least.hash").alias("hash"))
    # The best of several components may be equal where rows repeat: one row each.
    copy = Window.partitionBy("key", "hash").orderBy(F.lit(1))
    full = with_row(docs, doc_id=F.col("doc_id").cast("long"), hash=text_hash).withColumn("key", key)
    full = full.join(stay, ["key", "hash"], "left_semi")
    return full.withColumn("copy", F.row_number().over(copy)).where("copy = 1").select("row.*")
