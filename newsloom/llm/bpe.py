"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never
be merged, so a text may be cut there; the fragments are encoded alone and their ids
put one behind the other. The end of a word is such a place for every pair, since the
mark of a word's end is part of its last symbol.

The result is that of the tokenizers library for vocabularies of this kind: byte-level
symbols, a mark at the end of a word, lower case, white space dropped, no decoder.
Null texts are empty; an empty text has no ids and decodes to an empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ids_back, keyed_texts

#: Texts of these characters alone are in NFC, and Python's lower case, white space
#: and letters are the library's for them. Others go through the library's own rules.
_UNUSUAL = re.compile("[\x1c-\x1f\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbeɐ-\U0010ffff]")
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Words of a generation of a cache, and characters of a word in it: a bound of its bytes.
_KEPT, _LONGEST = 250_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Fragments(dict):
    """Ids, as little-endian 32-bit numbers, of words met so far; others on demand.

    Holds two generations of a bounded number of words, also from one task to the next.
    When the young one is full it becomes the old one; a word of the old one that is met
    again is young again, so what is met often stays.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.encode(word)
        # Very long words are not kept.
        if len(word) <= _LONGEST:
            if len(self) >= _KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class Bpe:
    """One vocabulary, read from a tokenizers file.

    With ``library`` the words are merged by the library's own model in place of forced
    boundaries and merges here; the ids are the same.
    """

    def __init__(self, path: str, library: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        rules = Tokenizer.from_file(path)
        self._normalizer, self._splitter = rules.normalizer, rules.pre_tokenizer
        self._model = rules.model if library else None
        self._symbols = byte_symbols()
        self._shown = str.maketrans(dict(enumerate(self._symbols)))
        self.pieces = Fragments(self._encode_piece)
        self.words = Fragments(self._encode_word)
        self.fragments = Fragments(lambda key: self._merged(list(key)))
        self.vocab: dict[str, int] = model["vocab"]
        n = max([*self.vocab.values(), *self.special.values()]) + 1
        self._packed = [struct.pack("<I", i) for i in range(n)]
        if library:
            return
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.tokens = [b""] * n
        for token, i in {**self.vocab, **self.special}.items():
            self.tokens[i] = token.encode()
        self.inside = {p for token in self.vocab for p in self._pairs(self._split(token))}

    def _split(self, token: str) -> list[str]:
        """Symbols of a token, the mark of the word's end with the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    @staticmethod
    def _pairs(symbols: list[str]) -> Iterator[tuple[str, str]]:
        return zip(symbols, symbols[1:])

    def cut(self, symbols: list[str]) -> list[list[str]]:
        """Fragments between pairs that stand inside no token."""
        if self.inside.issuperset(zip(symbols, symbols[1:])):
            return [symbols]
        out, start = [], 0
        for i, pair in enumerate(self._pairs(symbols), 1):
            if pair not in self.inside:
                out.append(symbols[start:i])
                start = i
        return [*out, symbols[start:]]

    def _merge(self, parts: list[str]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until none is left.

        Long runs take a heap over a linked list, which stays n log n.
        """
        if len(parts) > 64:
            return self._merge_long(parts)
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        import heapq

        ranks, n = self.ranks, len(parts)
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        heap = [
            (ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks
        ]
        heapq.heapify(heap)
        live: list[str | None] = list(parts)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if live[i] is not None else -1
            if j < 0 or (live[i], live[j]) != pair:
                continue
            live[i], live[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (live[a], live[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [p for p in live if p is not None]

    def _merged(self, fragment: list[str]) -> bytes:
        return b"".join([self._packed[self.vocab[p]] for p in self._merge(fragment) if p in self.vocab])

    def _encode_symbols(self, fragment: list[str]) -> bytes:
        return self.fragments[tuple(fragment)]

    def _encode_word(self, word: str) -> bytes:
        """A word of the pre-tokenizer, lower-cased."""
        if self._model is not None:
            # Printable ASCII characters stand for themselves.
            if not (word.isascii() and word.isprintable()):
                word = word.encode().decode("latin-1").translate(self._shown)
            return b"".join([self._packed[t.id] for t in self._model.tokenize(word)])
        table = self._symbols
        symbols = [table[b] for b in word.encode()]
        if symbols:
            symbols[-1] += self.end
        fragments = self.cut(symbols)
        # A word without a cut is kept as a word already.
        if len(fragments) == 1:
            return self._merged(symbols)
        return b"".join(map(self._encode_symbols, fragments))

    def _encode_piece(self, piece: str) -> bytes:
        """What stands between two white-space characters in a usual text."""
        low = piece.lower()
        if low.isalpha():
            # One word; a piece that is its own lower case is kept as a piece already.
            return self._encode_word(low) if low == piece else self.words[low]
        return b"".join(map(self.words.__getitem__, _PIECES.findall(low)))

    def _encode_plain(self, text: str) -> bytes:
        """A stretch without special tokens."""
        if not _UNUSUAL.search(text):
            return b"".join(map(self.pieces.__getitem__, text.split()))
        normal = self._normalizer.normalize_str(text)
        table = {s: b for b, s in enumerate(self._symbols)}
        return b"".join(
            self.words[bytes(table[s] for s in w).decode("utf-8", "surrogateescape")]
            for w, _ in self._splitter.pre_tokenize_str(normal)
        )

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self._special.search(text):
            return self._encode_plain(text)
        out, start = [], 0
        for m in self._special.finditer(text):
            out.append(self._encode_plain(text[start : m.start()]))
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            start = m.end()
        return b"".join([*out, self._encode_plain(text[start:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens with blanks between them, special ones included."""
        got = np.frombuffer(ids, "<u4").tolist()
        return b" ".join(map(self.tokens.__getitem__, got))


_OPEN: dict[tuple[str, bool], Bpe] = {}


def vocabulary(path: str, library: bool = False) -> Bpe:
    """The vocabulary of a file, read once in each Python worker."""
    if (path, library) not in _OPEN:
        _OPEN[path, library] = Bpe(path, library)
    return _OPEN[path, library]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) of every text.

    Rows are kept one for one, with repeated and null ids; other columns do not
    matter. ``path`` is a tokenizers file that each executor can open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "ids": [bpe.encode(t) for t in batch["text"]]}
            )

    return ids_back(keyed_texts(docs).mapInPandas(run, "doc_id string, ids binary"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of encoded documents, special tokens included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = (b"" if i is None else bytes(i) for i in batch["ids"])
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "text": [bpe.decode(i).decode() for i in ids]}
            )

    keyed = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return ids_back(keyed.mapInPandas(run, "doc_id string, text string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass: ``doc_id``, ``n_tokens`` and both digests.

    The ids of a text go from one half to the other inside a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = bpe.encode(text)
                rows.append(
                    (
                        len(ids) // 4,
                        hashlib.sha256(ids).hexdigest(),
                        hashlib.sha256(bpe.decode(ids)).hexdigest(),
                    )
                )
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return ids_back(keyed_texts(docs).mapInPandas(run, schema))
