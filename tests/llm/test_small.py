"""Each operator on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from newsloom.llm import bpe, exact, packing, sharding, simhash, urls, warc
from newsloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, hash string, digest int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def rows():
    """Odd documents: extra columns have the names operators work with."""
    rng = random.Random(5)
    words = ["the", "reing", "ción", "Über", "a", "b,", "x<|endoftext|>y", "it's", "ΑΣ", "ﬁ", "12"]
    texts = [None, "", " \t\n", "one", "one two", "one two three", "ONE two three", "日本語 テキスト"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["same text again and again"] * 30 + [" same text again  and again"] * 3
    texts += ["word " * 9000, "x" * 20000, "\x1c\x85\xa0 b", "it's\x0bso"]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(None, "one two"), (None, None), (7, texts[7]), (7, "other"), (3, "one"), (3, "one")]
    return [(i, t, "en", "s", 1, "r", 2, "h", 3) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# BPE


def test_bpe_equals_library(docs, rows, library):
    want = Counter()
    for doc, text in pairs(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False).encode()
        want[doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, PATH).collect())) == want


def test_bpe_random_characters(library):
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(0x250), *range(0x300, 0x390), 0x3A3, 0x130, 0x2028, 0x3000, 0xAC00, 0x1F600, 0xE000)]
    pool += ["'s", "'LL", "<|endoftext|>", "<|", "ing", "  ", "\r\n", "ab" * 50]
    own = bpe.vocabulary(PATH)
    for _ in range(1500):
        text = "".join(rng.choices(pool, k=rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    own = bpe.vocabulary(PATH)
    word = "xqzjvkwqq"
    symbols = list(word[:-1]) + [word[-1] + own.end]
    cuts = own.cut(symbols)
    assert len(cuts) > 1 and sum(cuts, []) == symbols
    for a, b in zip(cuts, cuts[1:]):
        assert (a[-1], b[0]) not in own.inside
    # The two ways to merge agree.
    for text in ("ththoninging" * 6, "aaaaaaaaab" * 9):
        symbols = list(text[:-1]) + [text[-1] + own.end]
        short, long = own._merge(list(symbols[:60])), own._merge_long(list(symbols[:60]))
        assert short == long


def test_bpe_encode_decode_and_empty(docs, none, rows):
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert back.count() == len(rows)
    assert bpe.round_trip(none, PATH).count() == 0


# Packing


def test_pieces_and_plan(docs, rows, none, library):
    got = packing.pack_documents(docs, PATH, size=64).collect()
    want = Counter()
    for doc, text in pairs(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[doc, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.02 * sum(r.length for r in got) / 64 + 2
    assert packing.pack_documents(none, PATH).count() == 0


def test_sequences_hold_their_ids(docs, spark):
    packed = packing.pack_documents(docs, PATH, size=64)
    one = packed.where("sequence_id = 0").orderBy("offset").collect()
    got = packing.sequences(packed).where("sequence_id = 0").first()
    assert bytes(got.ids) == b"".join(bytes(r.ids) for r in one)


def test_packing_over_blocks_and_equal_lengths(spark):
    items = spark.range(3000).selectExpr("id AS uid", "id % 700 + 1 AS length").cache()
    plan = packing.pack(items, 1024, block=256).join(items, "uid")
    full = {r[0]: r[1] for r in plan.groupBy("sequence_id").sum("length").collect()}
    assert sum(full.values()) == items.groupBy().sum("length").first()[0]
    assert max(full.values()) <= 1024
    assert len(full) <= sum(full.values()) / 1024 * 1.01 + 1
    same = spark.range(1000).selectExpr("id AS uid", "600L AS length")
    assert packing.pack(same, 1024, block=128).select("sequence_id").distinct().count() == 1000
    assert packing.pack(same.where("false"), 1024).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 300)
    a, b = packing.first_packings(lengths, rng, 2, 64)
    for _ in range(20):
        child = packing.cross(lengths, a, b, rng, 64)
        assert (child >= 0).all() and packing.fills(lengths, child).max() <= 64
        a, b = b, child


# Sharding


def test_shards(docs, rows, none):
    got = sharding.two_pass_shuffle(docs, bucket_bytes=2000).collect()
    want = Counter((d, t, len((t or "").encode()) + 1) for d, t in pairs(rows))
    assert Counter((r.row.doc_id, r.row.text, r.size) for r in got) == want
    slots, by_id = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        by_id[r.row.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 16)
        assert r.row.digest == 3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.two_pass_shuffle(none).count() == 0


def test_shards_mix_and_repeat(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    first = {r.row.doc_id: (r.shard, r.slot) for r in sharding.two_pass_shuffle(docs, 4).collect()}
    again = {r.row.doc_id: (r.shard, r.slot) for r in sharding.two_pass_shuffle(docs.repartition(3), 4).collect()}
    assert first == again
    order = [d for d, p in sorted(first.items(), key=lambda x: x[1]) if p[0] == 0]
    up = sum(a < b for a, b in zip(order, order[1:])) / len(order)
    assert 0.4 < up < 0.6
    grown = [r for r in sharding.two_pass_shuffle(docs, 4).collect() if r.grown_shard != r.shard]
    assert 0.15 < len(grown) / 4000 < 0.25


def test_written_shards_are_the_documents(spark, docs, rows, tmp_path):
    """What is read back: every row once, places gapless, files in order of the places."""
    out = str(tmp_path / "shards")
    planned = {(r.shard, r.slot): r.row for r in sharding.two_pass_shuffle(docs, 4, bucket_bytes=20_000).collect()}
    sharding.write_shards(sharding.two_pass_shuffle(docs, 4, bucket_bytes=20_000), out)
    got = sharding.read_shards(spark, out)
    assert {(r.shard, r.slot): r.row for r in got.collect()} == planned
    assert Counter((r.doc_id, r.text) for r in planned.values()) == Counter(pairs(rows))
    files = defaultdict(list)
    for r in got.select("slot", "bucket", "shard", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("at")).collect():
        files[r.file].append((r.at, r.bucket, r.slot))
    for places in files.values():
        order = [x[1:] for x in sorted(places)]
        assert order == sorted(order)


def test_sharding_query_reads_what_was_written(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_shard"](spark, str(tmp_path))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(rows))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got.collect()) == want
    assert any("/shards-" in f for f in got.inputFiles())


# WARC

PAGES = "page_id long, url string, html string, payload string, revisit int"


def test_warc_round_trip(spark):
    big = "<p>é</p>\r\n" * 200
    tricky = "a" * 600 + "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n" * 20 + "WARC/1.1\r\n"
    rows = [(1, "http://a/", big), (2, "http://b/ c", big), (9, "http://c/", big), (3, None, None), (4, "u\r\nX: y", "")]
    rows += [(5, "http://d/", "small"), (6, "http://d/", "small"), (7, "t", tricky), (8, "t", tricky), (10, "", "WARC/1.1\r\n")]
    rows += [(9, "http://c/", big), (None, "n", big), (None, "n", "only null" * 200), (11, "http://e/", "y" * 300_000), (12, "z", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], PAGES).repartition(3)
    got = warc.archive_round_trip(pages).collect()
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h in best and best[h] >= 0 and i != best[h]
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None] += 1
    assert Counter((r.page_id, r.full_bytes, r.capture.payload_digest, r.capture.type, r.refers_to) for r in got) == want
    assert all(r.request.fields.startswith("GET ") for r in got)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_warc_keeps_payloads(spark, tmp_path):
    rows = [(1, "http://a/", "é\r\nWARC/1.1\r\nx"), (2, "http://b/", "two")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    nested = warc.assemble(warc.read_archives(spark, path)).collect()
    assert {r.metadata.page_id: bytes(r.capture.payload).decode() for r in nested} == {1: rows[0][2], 2: "two"}


def test_warc_records_without_partner(spark):
    schema = "type string, record_id string, concurrent_to string, fields string, payload_digest string, payload_bytes long"
    records = spark.createDataFrame(
        [("response", "a", None, None, "d", 5), ("request", "r1", "a", "GET", None, None), ("request", "r0", "a", "GET", None, None),
         ("metadata", "m", "gone", "page-id: 4", None, None), ("revisit", "b", None, None, "none", None)],
        schema,
    ).selectExpr("*", "'x' AS date", "'u' AS target_uri")
    got = {r.record_id: r for r in warc.resolve(warc.assemble(records)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].request.record_id == "r0" and got["a"].metadata is None
    assert got["b"].refers_to is None and got["b"].full_bytes is None


# Exact deduplication


def squeeze(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def test_exact(spark, docs, rows, none):
    got = exact.deduplicate(docs, exact.new_index(spark)).collect()
    groups = defaultdict(list)
    for doc, text in pairs(rows):
        groups[squeeze(text)].append((-len(text or ""), doc is None, doc or 0))
    want = Counter()
    for doc, text in pairs(rows):
        _, void, keep = min(groups[squeeze(text)])
        want[doc, None if void else keep, len(groups[squeeze(text)]), hashlib.sha256(squeeze(text).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact.deduplicate(none, exact.new_index(spark)).count() == 0


def test_exact_index_lasts(spark, docs, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a  b"), (5, "d"), (6, " d")], "doc_id long, text string")
    assert {r.doc_id for r in exact.deduplicate(first, index).collect() if r.kept} == {1, 3}
    index.forget()
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.deduplicate(second, index).collect()}
    assert got == {4: (1, 1, False), 5: (6, 2, False), 6: (6, 2, True)}
    assert index.read().count() == 3
    # The same rows as another batch: nothing is new.
    assert not any(r.kept for r in exact.deduplicate(second, index).collect())
    assert exact.keep_new(second, index).count() == 0
    assert index.read().count() == 3


def test_exact_batch_may_be_run_again(spark, tmp_path):
    """The driver is lost after the append: the batch under its own name keeps its rows."""
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    first = spark.createDataFrame([(1, "a b"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a  b"), (5, "d"), (6, " d"), (6, " d")], "doc_id long, text string")
    exact.deduplicate(first, index, "one")
    want = sorted(map(tuple, exact.deduplicate(second, index, "two").collect()))
    assert [r[:4] for r in want if r[3]] == [(6, 6, 3, True)]
    assert sorted(map(tuple, exact.deduplicate(second.repartition(3), index, "two").collect())) == want
    assert index.read().count() == 3
    assert [r.doc_id for r in exact.keep_new(second, index, "two").collect()] == [6]
    assert exact.keep_new(second, index, "three").count() == 0
    index.forget()


def test_exact_keeps_whole_rows(spark, docs, rows):
    got = exact.keep_new(docs, exact.new_index(spark))
    assert got.columns == docs.columns
    assert got.count() == len({squeeze(t) for _, t in pairs(rows)})


def test_exact_anti_join_leaves_the_index_unshuffled(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "i"), 4)
    new = spark.createDataFrame([("x", 1, 2)], "digest string, keep_id long, n_points long")
    index.append(new, "b")
    plan = index.missing(new.repartition(3))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "SortMergeJoin" in plan
    assert plan.index("Exchange") < plan.index("Bucketed: true") and plan.count("Exchange hashpartitioning") == 1
    index.forget()


# URLs


def naive_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    cut = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:cut]


def test_urls(spark):
    names = ["http://A.Example.ORG/en/12", "https://example.org/es/x?y=/z", "x://sub.example.org/en/2", "u://org", "u://org/", "u://notorg.com/de/", "u://notorg/de/",
             "u://com/fr/#f", "u://a.com?/fr/", "u://É.com/fr/x://y", None, "", "no url", "://", "a://b://c/d", "u://example.org/en/1", "u://xexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(names)] + [(None, None, "", "")], "page_id long, url string, host string, features string")
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(names) + 1
    for r in got:
        if r.page_id is None:
            continue
        host, path = naive_parts(names[r.page_id])
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")
        assert (r.block_score is None) == bool(best)
    assert urls.filter_urls(pages.where("false")).count() == 0
    lone = urls.filter_urls(pages.where("page_id IN (4, 10)")).collect()
    assert {r.verdict for r in lone} == {"allow"}


def test_url_model_learns(spark):
    rows = [(i, f"http://a{i}.com/{'de' if i % 2 else 'fr'}/{i * 7919 % 5000}") for i in range(400)]
    rows += [(1000 + i, f"http://b{i}.net/{'de' if i % 2 else 'fr'}/{i * 31}") for i in range(100)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    right = sum((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    assert right >= 90


def test_grams(spark):
    got = spark.createDataFrame([("ab",), ("",)], "t string").select(urls.grams(urls.F.col("t"), (2, 3))).collect()
    assert got[0][0] == ["ab", "ab"] and got[1][0] == ["", ""]


# SimHash


def naive_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(rows):
    prints = [naive_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, prints[i], least.get(top(i))) for i, (doc, _) in enumerate(rows)]


def test_near_duplicates(docs, rows, none):
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter(naive_components(pairs(rows)))
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each(docs, rows, none):
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    want = {c for _, _, c in naive_components(pairs(rows))}
    assert set(ids) == want and len(ids) - len(want) <= 2
    assert simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("limit", [simhash.BUCKET, 3])
@pytest.mark.parametrize("radius, parts", [(2, 4), (4, 6), (1, 2)])
def test_links_of_close_points(spark, radius, parts, limit):
    rng = random.Random(1)
    points = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        points.add(centre)
        for _ in range(120):
            points.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    points |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, 15, 2**63, 2**64 - 1}
    points = sorted(points)
    frame = spark.createDataFrame([(p - (p >> 63 << 64),) for p in points], "fp long")
    found = {(r.node, r.root) for r in simhash.components(simhash.links(frame, len(points), radius, parts, limit)).collect()}
    root = {p: p for p in points}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if (p ^ q).bit_count() <= radius:
                root[top(p)] = top(q)
    groups = defaultdict(set)
    for p in points:
        groups[top(p)].add(p - (p >> 63 << 64))
    want = {(m, min(g)) for g in groups.values() for m in g if m != min(g)}
    assert {x for x in found if x[0] != x[1]} == want


@pytest.mark.parametrize("radius, parts", [(2, 4), (4, 6), (3, 5)])
def test_masks_leave_no_near_pair_out(radius, parts):
    rng = random.Random(9)
    top, finer = simhash.shard_masks(radius, parts)
    for _ in range(2000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        hit = [k for k, m in enumerate(top) if not m & apart]
        assert hit and any(not m & apart for k, m in finer if k == hit[0])


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(2**40)]))
    shard = np.sort(rng.integers(0, 3, len(points)))
    got = {(int(a), int(b)) for x, y in simhash.Forest(shard, points).within(2) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(points)) for j in range(i) if shard[i] == shard[j] and (int(points[i]) ^ int(points[j])).bit_count() <= 2}
    assert got == want


def test_long_chain_is_one_component(spark):
    chain = [(1 << i) - 1 for i in range(60)]
    frame = spark.createDataFrame([(c,) for c in chain], "fp long")
    found = simhash.components(simhash.links(frame, len(chain))).where("node != root").collect()
    assert {r.root for r in found} == {0} and len(found) == len(chain) - 1


def test_normal_form_is_stable_below_the_marks():
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) for c in range(0x250))
