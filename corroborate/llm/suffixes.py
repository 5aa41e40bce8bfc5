"""Substring dedup (operator 10) by minimiser grouping.

Each window of 100 bytes is named by its least-hashed k-gram, so equal windows have equal
grams at equal offsets, and a run of neighbouring windows shares one. Places that share a
gram are grouped; a group of one repeats nothing. In the others, the bytes that all windows
of a gram cover are compared by digest, so equal ones mean equal windows without looking at
them; only where they diverge, at the rims of repeats, are the windows themselves compared.
No suffix is sorted and there are no cover ranks, as README says.

The grams hold about 2.7 % of the positions, where an arithmetic difference cover for
100 bytes holds 12 % or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from corroborate.llm.common import checkpointed, shuffle_parts, slices, table
from corroborate.llm.spans import cut, keyed, on_tuples

#: Length of a repeat, and of the k-gram whose least hash makes a window's sample.
LENGTH, GRAM = 100, 28
#: Positions that fit below a hash; longer texts are sampled piece by piece.
POSITION_BITS = 24
PIECE = 4_000_000

#: Runs that a task holds to find repeats among its own documents, and contexts of a bucket that it holds.
HELD, CONTEXTS_HELD = 300_000, 20_000
WHOLE, RIM, WIDE = 0, 1, 2

_BYTE = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position, by joining hashes of powers of two."""
    power, width, h = 0x9E3779B97F4A7C15, 1, _BYTE[data]
    parts, whole, done = [], None, 0
    while width <= gram:
        if gram & width:
            parts.append((width, h, power))
        if width * 2 <= gram:
            h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        width *= 2
    n = len(data) - gram + 1
    for width, h, power in reversed(parts):
        piece = h[done : done + n]
        whole = piece.copy() if whole is None else whole * np.uint64(power) + piece
        done += width
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(32)
    return whole


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def samples(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of at least ``length`` bytes: its number, and for each run of windows that share a sample the
    sample's gram hash and the first and last window start. A very long text comes in several pieces."""
    below = np.uint64((1 << POSITION_BITS) - 1)
    pieces = []
    for n, data in enumerate(texts):
        for at in range(0, max(1, len(data) - length + 1), PIECE):
            piece = data[at : at + PIECE + length - 1]
            if len(piece) >= length:
                pieces.append((n, at, piece))
    while pieces:
        size, some = 0, []
        while pieces and (not some or size + len(pieces[-1][2]) <= PIECE):
            some.append(pieces.pop())
            size += len(some[-1][2])
        h = gram_hashes(np.frombuffer(b"".join(p for _, _, p in some), dtype=np.uint8), gram)
        packed = h & ~below | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(packed, length - gram + 1) & below).astype(np.int64)
        start = 0
        for n, at, piece in some:
            own = place[start : start + len(piece) - length + 1]
            ends = np.r_[np.flatnonzero(np.diff(own)), len(own) - 1]
            yield n, h[own[ends]].view(np.int64), np.r_[0, ends[:-1] + 1] + at, ends + at
            start += len(piece)


#: A place is start * 2^31 + (last - start) * 2^24 + th, so that places of a document sort by start.
#: Less than zero (its complement): all windows of the place are known to start earlier, too.
_ROWS = "gram long, context long, doc long, place long"


def _start(place: int) -> int:
    return place >> 31


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(gram, context, doc, place) of each run of windows of (doc, th, text) that share a sample.

    Of runs with one context only the earliest that this task holds goes on as it is;
    the others are known to repeat it. So a passage that a third of all documents have
    sends a few rows per task into its bucket.
    """
    held: dict[tuple[int, int], tuple[int, int]] = {}
    for batch in slices(batches, 2):
        docs, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data = [t.encode("utf-8") for t in batch.column(2).to_pylist()]
        for n, grams, first, last in samples(data):
            own, doc = data[n], docs[n]
            places = (first << 31 | (last - first) << 24 | ths[n]).tolist()
            for gram, s, e, place in zip(grams.tolist(), first.tolist(), (last + LENGTH).tolist(), places, strict=True):
                key = gram, xxh3_64_intdigest(own[s:e]) - (1 << 63)
                was = held.get(key)
                if was is None:
                    held[key] = doc, place
                    continue
                old, new = (was[0], _start(was[1])), (doc, s)
                if old < new:
                    yield doc ^ gram, 0, doc, ~place
                elif new < old:
                    held[key] = doc, place
                    yield was[0] ^ gram, 0, was[0], ~was[1]
                else:  # another text of the same doc_id
                    yield *key, doc, place
        if len(held) > HELD:
            yield from ((*k, *v) for k, v in held.items())
            held = {}
    yield from ((*k, *v) for k, v in held.items())


def _buckets(batches: Iterator[pa.RecordBatch], held: int = CONTEXTS_HELD) -> Iterator[tuple]:
    """(gram, doc, place, kind) from a part sorted by gram, doc and place, bucket by bucket.

    WHOLE: all windows of the place start earlier, too. RIM: the first place of a context in
    a bucket with several. WIDE: the same in a bucket with too many contexts to hold.
    """
    gram, firsts, rims, wide = None, {}, [], False

    def closed() -> Iterator[tuple]:
        if wide or len(firsts) > 1:
            yield from ((gram, doc, place, WIDE if wide else RIM) for doc, place in rims)

    for batch in batches:
        for g, context, doc, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place < 0:
                yield g, doc, ~place, WHOLE
                continue
            if g != gram:
                yield from closed()
                gram, firsts, rims, wide = g, {}, [], False
            own = doc, _start(place)
            first = firsts.get(context)
            if first is not None and first < own:
                yield g, doc, place, WHOLE
                continue
            if first is None and not wide:
                firsts[context] = own
            rims.append((doc, place))
            if len(rims) > held:
                wide = True
                yield from closed()
                rims = []
    yield from closed()


def _rim_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc, th, start, last) of windows that start earlier, too; from contexts sorted by gram, doc and place."""
    gram, seen = None, {}
    for batch in batches:
        for g, doc, place, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != gram:
                gram, seen = g, {}
            start, th = _start(place), place & 0xFFFFFF
            for at in range(len(context) - LENGTH + 1):
                own = doc, start + at
                if seen.setdefault(context[at : at + LENGTH], own) < own:
                    yield doc, th, start + at, start + at


def _parts(place: str) -> list:
    p = F.col(place)
    start, spread = F.shiftright(p, 31), F.shiftright(p, 24).bitwiseAND(F.lit(127))
    return [p.bitwiseAND(F.lit((1 << 24) - 1)).alias("th"), start.alias("start"), (start + spread).alias("last")]


def _contexts(texts: DataFrame, rims: DataFrame) -> DataFrame:
    """(gram, doc, place, context): the bytes that the windows of each rim cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1_000_000):
            grams, docs, places, contexts = [], [], [], []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8")
                for r in found:
                    place = r["place"]
                    grams.append(r["gram"])
                    docs.append(doc)
                    places.append(place)
                    contexts.append(data[_start(place) : _start(place) + (place >> 24 & 127) + LENGTH])
            columns = [*(pa.array(c, pa.int64()) for c in (grams, docs, places)), pa.array(contexts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "doc", "place", "context"])

    mine = rims.select("doc", _parts("place")[0], F.struct("gram", "place").alias("r")).groupBy("doc", "th").agg(F.collect_list("r").alias("rims"))
    return texts.join(mine, ["doc", "th"]).select("doc", "text", "rims").mapInArrow(run, "gram long, doc long, place long, context binary")


def _named_windows(contexts: DataFrame) -> DataFrame:
    """(name, name2, doc, th, start): every window of ``contexts`` with a digest of its bytes in two longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, place, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(len(context) - LENGTH + 1):
                    name = xxh3_128_digest(context[at : at + LENGTH])
                    yield int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True), doc, place & 0xFFFFFF, _start(place) + at

    names = "name name2 doc th start"
    return contexts.select("doc", "place", "context").mapInArrow(on_tuples(run, names), ", ".join(f"{n} long" for n in names.split()))


def repeats(texts: DataFrame, by_key: DataFrame) -> DataFrame:
    """(doc, th, start, end) spans that cover each byte of a window that also starts earlier, and no others.

    ``by_key``: the same texts, partitioned by doc and th.
    """
    parts = shuffle_parts(texts.sparkSession)
    sampled = texts.select("doc", "th", "text").mapInArrow(on_tuples(_sampled, "gram context doc place"), _ROWS)
    buckets = sampled.repartition(parts, "gram").sortWithinPartitions("gram", "doc", "place")
    found = checkpointed(buckets.mapInArrow(on_tuples(_buckets, "gram doc place kind"), "gram long, doc long, place long, kind long"))
    whole = found.filter(F.col("kind") == WHOLE).select("doc", *_parts("place"))

    rims = _contexts(by_key, found.filter(F.col("kind") == RIM)).repartition(parts, "gram").sortWithinPartitions("gram", "doc", "place")
    rest = rims.mapInArrow(on_tuples(_rim_windows, "doc th start last"), "doc long, th long, start long, last long")

    # Buckets with too many contexts for one task: their windows meet by name.
    windows = _named_windows(_contexts(by_key, found.filter(F.col("kind") == WIDE)))
    named = windows.groupBy("name", "name2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = (F.col("doc") > F.col("first.doc")) | (F.col("doc") == F.col("first.doc")) & (F.col("start") > F.col("first.start"))
    wide = windows.join(named, ["name", "name2"]).filter(later).select("doc", "th", "start", F.col("start").alias("last"))
    return whole.union(rest).union(wide).select("doc", "th", "start", (F.col("last") + LENGTH).alias("end"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): its UTF-8 bytes less each byte covered by 100 bytes that also start earlier.

    Earlier: a lesser doc_id (null first), or the same doc_id and a lesser start. Rows that
    share a doc_id are compared by start alone, so fully repeated rows all stay. A null
    text is empty; texts of fewer than 100 bytes stay whole; other columns are not read.
    """
    texts = keyed(docs)
    by_key = texts.repartition(shuffle_parts(docs.sparkSession), "doc", "th")
    return cut(by_key, repeats(texts, by_key))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
