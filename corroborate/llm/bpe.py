"""BPE encoding and decoding (operator 2) with a pair occurrence index.

All words of a batch that were not met before lie in one array of symbols. An
index maps each pair of neighbouring symbols to its positions. The pairs' ranks
are taken in ascending order; a rank's pair is merged at all its positions from
left to right, and the lists of the pairs that this breaks or makes are updated.
A merge makes only pairs of higher rank than its own, so one ascending pass over
the active ranks does what a search for the lowest rank in each word would do.
The index covers the words of one slice of a partition that were not met before, so
its size is bounded, whatever the partition's. Decoding takes ids alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import body, slices, table

#: A word's ids, as four bytes each: small to remember, and joined at no cost.
Word = bytes
IDS = np.dtype("<i4")
#: Beyond every id: a pair is left * WIDE + right. END follows each word and is in no rule; GONE marks what a merge took.
WIDE, END, GONE = 1 << 20, (1 << 20) - 1, -1
#: Words whose ids a worker remembers (some 200 bytes each); beyond it only those met lately stay.
WORDS_KEPT = 400_000
#: Bytes of text that are indexed at once (some 90 bytes of index each).
SLICE = 500_000
#: Longer runs (no space for thousands of characters) are encoded but not remembered.
LONGEST_KEPT = 256


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _bytes_of_chars()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(chars[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.id_of_byte = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: By rank: left symbol, right symbol, the symbol that takes their place.
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        #: Ranks by right symbol for each left one, and by left symbol for each right one.
        self.followed: dict[int, dict[int, int]] = {}
        self.preceded: dict[int, dict[int, int]] = {}
        for rank, (a, b, _) in enumerate(self.rules):
            self.followed.setdefault(a, {})[b] = rank
            self.preceded.setdefault(b, {})[a] = rank
        codes = np.array([a * WIDE + b for a, b, _ in self.rules], dtype=np.int64)
        self.pair_ranks = np.argsort(codes)
        self.pairs = codes[self.pair_ranks]
        self.symbol_of_byte = np.array([*self.id_of_byte[:255], END], dtype=np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, Word] = {}
        self.older: dict[str, Word] = {}

    def encode_words(self, words: list[str]) -> list[Word]:
        """Ids of each word, by one pass over a pair occurrence index of all of them."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        joined = np.frombuffer(b"\xff".join(raw) + b"\xff", dtype=np.uint8)  # no UTF-8 text has the byte ff
        first = self.symbol_of_byte[joined]
        pair = first[:-1] * WIDE + first[1:]
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        at = np.flatnonzero(self.pairs[found] == pair)
        rank = self.pair_ranks[found[at]]
        order = np.lexsort((at, rank))
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        places = dict(zip(rank[np.r_[0, cuts]].tolist() if len(rank) else [], (x.tolist() for x in np.split(at, cuts)), strict=False))
        active = list(places)  # in ascending order, so a heap
        symbols = first.tolist()
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        rules, push, pop = self.rules, heapq.heappush, heapq.heappop
        while active:
            rank = pop(active)
            left_symbol, right_symbol, merged = rules[rank]
            with_right, with_left = self.followed.get(merged), self.preceded.get(merged)  # most symbols are in no further rule
            spots = places.pop(rank)
            for spot in sorted(spots) if left_symbol == right_symbol else spots:  # only aaa depends on the order
                right = after[spot]
                if symbols[spot] != left_symbol or symbols[right] != right_symbol:
                    continue  # another merge took one of the two
                symbols[spot], symbols[right] = merged, GONE
                after[spot] = far = after[right]
                before[far] = spot
                if with_right is not None and (made := with_right.get(symbols[far])) is not None:
                    if made in places:
                        places[made].append(spot)
                    else:
                        places[made] = [spot]
                        push(active, made)
                if with_left is not None and (left := before[spot]) >= 0 and (made := with_left.get(symbols[left])) is not None:
                    if made in places:
                        places[made].append(left)
                    else:
                        places[made] = [left]
                        push(active, made)
        flat = np.array(symbols, dtype=IDS)
        flat = flat[flat != GONE]
        ends = (np.flatnonzero(flat == END) * IDS.itemsize).tolist()
        joined = flat.tobytes()
        return [joined[start:end] for start, end in zip([0, *(e + IDS.itemsize for e in ends)], ends, strict=False)]

    def pieces(self, text: str) -> list[str | int]:
        """Words of the text, and the ids of special tokens that stand in it."""
        if not self.split_special or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else self.words.findall(part)
        return out

    def encode_all(self, texts: list[str], kept: int = WORDS_KEPT) -> Iterator[list[Word]]:
        """The encoded words of each text."""
        pieces = [self.pieces(t) for t in texts]
        known, older = self.known, self.older
        if len(known) > kept // 2:  # what has been met lately stays
            known, older = self.known, self.older = {}, known
        new = []
        for p in set().union(*pieces).difference(known):
            if isinstance(p, int):
                known[p] = np.array([p], dtype=IDS).tobytes()
            elif p in older:
                known[p] = older[p]
            else:
                new.append(p)
        known.update(zip(new, self.encode_words(new), strict=True))
        for ps in pieces:
            yield [known[p] for p in ps]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del known[p]

    @staticmethod
    def packed(words: list[Word]) -> np.ndarray:
        return np.frombuffer(b"".join(words), dtype=IDS)

    @classmethod
    def ids(cls, words: list[Word]) -> list[int]:
        return cls.packed(words).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids, special tokens as they are written; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(name: str) -> ByteBpe:
    """The vocabulary of that name, read once per worker."""
    if name not in _LOADED:
        _LOADED[name] = ByteBpe(public_tokenizers.path(name))
    return _LOADED[name]


def _column(values: tuple, kind: str) -> pa.Array:
    if kind != "array<int>":
        return pa.array(values)
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))


def _encoded(docs: DataFrame, vocabulary: str, columns: dict[str, str], of) -> DataFrame:
    """doc_id and ``columns`` (name: type) of every row; ``of`` makes a column's values from (bpe, texts, words of each)."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in slices(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            rows = [of(bpe, text, words) for text, words in zip(texts, bpe.encode_all(texts), strict=True)]
            made = [_column(c, columns[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)] if rows else [pa.array([], pa.null())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {t}" for n, t in columns.items())]))


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row of ``docs`` (doc_id, text).

    Special tokens' strings in a text become their ids, none are added. A null text is
    empty and gives no ids; rows may repeat, null ids stay null; other columns are not
    read. Any other text decodes to itself.
    """
    return _encoded(docs, vocabulary, {"ids": "array<int>", "decoded": "string"}, lambda bpe, _, words: ((ids := bpe.packed(words)), bpe.decode(ids.tolist())))


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids: array of int); null ids are none and decode to an empty text, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (the ids decode to the text) of every row; rules as in encode()."""

    def of(bpe: ByteBpe, text: str, words: list[Word]) -> tuple[int, np.ndarray, bool]:
        ids = bpe.packed(words)
        return len(ids), ids, bpe.decode(ids.tolist()) == text

    return _encoded(docs, vocabulary, {"n_tokens": "long", "ids": "array<int>", "round_trip": "boolean"}, of)


def encode_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """As encode(), with digests in the place of ids and decoded text, so neither leaves its task."""

    def of(bpe: ByteBpe, _: str, words: list[Word]) -> tuple[int, str, str]:
        ids = bpe.ids(words)
        listed = ",".join(map(str, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest()

    return _encoded(docs, vocabulary, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, of)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
