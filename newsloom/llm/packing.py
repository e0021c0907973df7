"""Best-fit packing by a grouping genetic algorithm on islands.

A document becomes pieces of at most ``size`` tokens; only a longer document is cut.
Pieces that fill a sequence stand alone. The rest is dealt by hash into blocks of a
bounded number of pieces. Each block is packed by several islands: populations of
packings whose genes are whole sequences. A child takes well-filled sequences of one
parent, injects them into the other, drops the sequences that hold a doubled piece and
puts the displaced pieces back where they fit best. After each epoch the best packing
of an island moves to the next island of its block. Sequences that stay badly filled
are packed again, all blocks together, as long as that saves sequences.

A block is one row of an epoch's table, so a task holds one block at a time, and an
epoch is a written table, so a lost executor repeats one epoch's tasks at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import vocabulary
from newsloom.llm.common import ids_back, importable, keyed_texts, saved

SIZE = 2048
#: Pieces in a block, islands of a block, packings of an island, epochs, children of
#: an island in an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, CHILDREN = 8192, 4, 4, 3, 4
#: Numbers of sequences that a block has for itself; hashes deal it about ``BLOCK``.
_STRIDE = 1 << 24
#: Bytes of ids that a task hands on at once.
_CHUNK = 8 * 2**20
#: Sequences filled less than this are packed again across blocks.
WELL_FILLED = 0.97


def token_pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids``.

    A document's tokens are its ids and then id 0, so null and empty texts are one
    piece of one token. ``ids`` is binary, little-endian unsigned 32-bit. Rows of equal
    ``doc_id`` are different documents.
    """

    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path, library=True)
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = bpe.encode(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, piece, at // 4, len(part) // 4, part))
                held += len(ids)
                if held > _CHUNK:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    schema = "doc_id string, piece int, start long, length long, ids binary"
    return ids_back(keyed_texts(docs).mapInPandas(run, schema))


def best_fit(lengths: np.ndarray, order: np.ndarray, room: list[int], genes: np.ndarray, size: int):
    """Put pieces in ``order`` into the fullest sequence that has room, or a new one.

    ``room`` is the free space of the sequences there are; both it and ``genes``, the
    sequence of each piece, are changed. Sequences wait in a stack for each free space,
    and a number with a bit for each free space in use finds the tightest at once.
    """
    stacks: dict[int, list[int]] = {}
    used = 0
    for b, free in enumerate(room):
        if free:
            stacks.setdefault(free, []).append(b)
            used |= 1 << free
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fit = used >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                used &= ~(1 << free)
        else:
            free, b = size, len(room)
            room.append(size)
        genes[i] = b
        free -= n
        room[b] = free
        if free:
            stacks.setdefault(free, []).append(b)
            used |= 1 << free


def fills(lengths: np.ndarray, genes: np.ndarray) -> np.ndarray:
    return np.bincount(genes, lengths).astype(np.int64)


def fitness(lengths: np.ndarray, genes: np.ndarray, size: int) -> float:
    """Mean square of the fill over sequences: fewer and fuller is better."""
    full = fills(lengths, genes)
    full = full[full > 0] / size
    return float((full * full).mean()) - 2.0 * len(full)


def cross(lengths, into, source, rng: np.random.Generator, size: int) -> np.ndarray:
    """A child: well-filled sequences of ``source`` injected into ``into``."""
    full = fills(lengths, source)
    # Well filled, with chance: the fuller half, of it one in two.
    good = full >= np.median(full[full > 0])
    injected = good & (rng.random(len(full)) < 0.5)
    placed = injected[source]
    # Sequences of the other parent that hold an injected piece go as a whole.
    hit = np.zeros(int(into.max()) + 1, bool)
    hit[into[placed]] = True
    # Some of its badly filled ones go too: the change that keeps search moving.
    spare = fills(lengths, into)
    hit |= (spare < size * 0.99) & (rng.random(len(hit)) < 0.3)
    kept = ~hit[into] & ~placed
    child = np.full(len(lengths), -1, np.int64)
    new, child[placed] = np.unique(source[placed], return_inverse=True)
    rest, moved = np.unique(into[kept], return_inverse=True)
    child[kept] = moved + len(new)
    room = (size - np.bincount(child[child >= 0], lengths[child >= 0], len(new) + len(rest))).astype(int).tolist()
    loose = np.flatnonzero(child < 0)
    # Longest first, with a little noise so that children differ.
    loose = loose[np.argsort(-lengths[loose] * (1 + 0.02 * rng.random(len(loose))))]
    best_fit(lengths, loose, room, child, size)
    return child


def first_packings(lengths: np.ndarray, rng: np.random.Generator, count: int, size: int) -> list[np.ndarray]:
    """Best fit, longest first, and noisy variants of it."""
    out = []
    for k in range(count):
        order = np.argsort(-lengths * (1 + 0.1 * (k > 0) * rng.random(len(lengths))), kind="stable")
        genes = np.full(len(lengths), -1, np.int64)
        best_fit(lengths, order, [], genes, size)
        out.append(genes)
    return out


def epoch(lengths, packings, seed: list[int], children: int, count: int, size: int):
    """One epoch of one island; the best packing comes first."""
    rng = np.random.default_rng(seed)
    packings = packings or first_packings(lengths, rng, count, size)
    ranked = sorted(((fitness(lengths, g, size), -k, g) for k, g in enumerate(packings)), key=lambda x: x[:2], reverse=True)
    for k in range(children):
        a, b = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
        child = cross(lengths, ranked[a][2], ranked[b][2], rng, size)
        ranked.append((fitness(lengths, child, size), -len(packings) - k, child))
        ranked = sorted(ranked, key=lambda x: x[:2], reverse=True)[:count]
    return [g for *_, g in ranked]


_STATE = "block long, island int, uids binary, lengths binary, packings array<binary>, fitness double"


def _blocks(items: DataFrame, block: int, n: int, seed: int) -> DataFrame:
    """One row per block: its pieces, longest first. Bounded by the deal."""
    blocks = max(1, -(-n // block))
    return (
        items.groupBy(F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(blocks)).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items"))
    )


def _start(blocks: DataFrame, islands: int) -> DataFrame:
    """Islands of each block, without packings yet."""

    def run(batches):
        for batch in batches:
            for block, items in zip(batch["block"], batch["items"]):
                uids = np.array([i["uid"] for i in items], "<i8").tobytes()
                lengths = np.array([i["length"] for i in items], "<i8").tobytes()
                yield pd.DataFrame(
                    [(block, k, uids, lengths, [], 0.0) for k in range(islands)],
                    columns=["block", "island", "uids", "lengths", "packings", "fitness"],
                )

    return blocks.mapInPandas(run, _STATE)


def _evolve(state: DataFrame, number: int, children: int, count: int, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<i8")
                packings = [np.frombuffer(p, "<i4").astype(np.int64) for p in row.packings]
                got = epoch(lengths, packings, [int(row.block), int(row.island), number], children, count, size)
                yield pd.DataFrame(
                    [(row.block, row.island, row.uids, row.lengths, [g.astype("<i4").tobytes() for g in got], fitness(lengths, got[0], size))],
                    columns=["block", "island", "uids", "lengths", "packings", "fitness"],
                )

    # An island is a row of work: deal islands, not bytes, over the tasks.
    return state.repartition("block", "island").mapInPandas(run, _STATE)


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """The best packing of each island moves to the next island of the block."""
    elite = state.select(
        "block",
        ((F.col("island") + 1) % islands).cast("int").alias("island"),
        F.col("packings")[0].alias("elite"),
    )
    return state.join(elite, ["block", "island"]).select(
        "block", "island", "uids", "lengths",
        F.concat(F.array("elite"), "packings").alias("packings"), "fitness",
    )


def _pack_once(items: DataFrame, n: int, seed: int, block: int, size: int) -> DataFrame:
    """``uid, length, block, bin, place`` of ``items`` by the islands' best packing."""
    state = saved(_start(_blocks(items, block, n, seed), ISLANDS), "pack-start")
    for number in range(EPOCHS):
        if number:
            state = _migrate(state, ISLANDS)
        state = saved(_evolve(state, 1000 * seed + number, CHILDREN, POPULATION, size), "pack-epoch")
    best = state.groupBy("block").agg(
        F.max_by(F.struct("uids", "lengths", F.col("packings")[0].alias("genes")), F.struct("fitness", -F.col("island"))).alias("b")
    )

    def run(batches):
        for batch in batches:
            for block_, b in zip(batch["block"], batch["b"]):
                uids, lengths = np.frombuffer(b["uids"], "<i8"), np.frombuffer(b["lengths"], "<i8")
                genes = np.frombuffer(b["genes"], "<i4")
                order = np.argsort(genes, kind="stable")
                ends = np.cumsum(lengths[order])
                genes_ = genes[order]
                first = np.r_[True, genes_[1:] != genes_[:-1]] if len(genes_) else np.zeros(0, bool)
                starts = ends - lengths[order]
                base = starts[first][np.cumsum(first) - 1]
                full = fills(lengths, genes)
                yield pd.DataFrame(
                    {"uid": uids[order], "length": lengths[order], "block": block_, "bin": genes_, "place": starts - base, "fill": full[genes_]}
                )

    return best.mapInPandas(run, "uid long, length long, block long, bin int, place long, fill long")


def pack(items: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """``uid, sequence_id, offset`` for ``uid, length`` (1 to ``size``); ``uid`` is unique
    and not negative.

    An empty table gives an empty plan. Equal lengths are told apart by ``uid``.
    """
    importable(items.sparkSession)
    items = items.select("uid", "length")
    # Packed sequences are numbered from 0 on, sequences of one whole piece below 0.
    whole = items.where(F.col("length") == size).select(
        "uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    loose = items.where(F.col("length") < size)
    n = loose.count()
    first = saved(_pack_once(loose, n, 1, block, size), "packed")
    bad = F.col("fill") < WELL_FILLED * size
    again = first.where(bad)
    m, bins = again.agg(F.count("*"), F.count_distinct("block", "bin")).first()
    done = first
    # One more round is worth it only where several blocks left something over.
    if n > block and m:
        second = saved(_pack_once(again.select("uid", "length"), m, 2, block, size), "packed")
        if second.agg(F.count_distinct("block", "bin")).first()[0] < bins:
            done = first.where(~bad).withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    if "round" not in done.columns:
        done = done.withColumn("round", F.lit(1))
    number = F.col("block") * _STRIDE + F.col("bin") * 2 + F.col("round") - 1
    packed = done.select("uid", number.alias("sequence_id"), F.col("place").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, digest=None) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    ``digest`` makes columns of the pieces' ``ids`` to keep in their place, so that
    the ids themselves are not written; without it they are kept.
    """
    pieces = token_pieces(docs, path, size)
    kept = pieces.select("doc_id", "piece", "start", "length", *(digest or [F.col("ids")]))
    kept = saved(kept.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return kept.join(pack(kept, size), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id, ids``; ``packed`` needs ``ids``.

    A sequence gathers at most its size in tokens.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.expr("aggregate(r, X'', (a, x) -> concat(a, x.ids))").alias("ids")
    )
