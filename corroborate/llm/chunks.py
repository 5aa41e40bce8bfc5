"""Substring dedup (operator 3) by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh3_128_digest

from corroborate.llm.common import shuffle_parts, slices, table
from corroborate.llm.spans import cut, keyed, on_tuples

#: Bytes that decide on a cut (the gear hash has as many bits), the least and the greatest chunk, and one cut in so many bytes.
WINDOW, LEAST, MOST, ONE_IN = 32, 32, 1024, 16
#: What the query calls a repeated passage: shorter runs of repeated chunks are stock phrases and stay.
LEAST_RUN = 64

GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] at every byte, by doubling the window it has seen."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, width * 2
    return h


def chunk_ends(cuts: np.ndarray, size: int) -> list[int]:
    """Ends of the chunks of a document of ``size`` bytes; ``cuts``: ends that the hash allows, ascending."""
    ends, start = [], 0
    for end in cuts.tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            start = end
            ends.append(start)
    while size - start > MOST:
        start += MOST
        ends.append(start)
    if size - start >= LEAST or not ends:
        ends.append(size)
    else:  # a short rest belongs to the last chunk
        ends[-1] = size
    return ends


def chunks_of(data: bytes) -> list[int]:
    if not data:
        return []
    h = gear(np.frombuffer(data, dtype=np.uint8))
    cuts = np.flatnonzero(h[WINDOW - 1 :] < (1 << WINDOW) // ONE_IN) + WINDOW  # the highest bits have seen the whole window
    return chunk_ends(cuts, len(data))


#: A span is start * 2^31 + end. Less than zero (its complement): the chunk is known to stand earlier, too.
_ROWS = "hi lo doc th span"
#: Chunks that a task holds to find repeats among its own documents.
HELD = 300_000


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(hi, lo, doc, th, span) of every chunk of (doc, th, text), hi and lo being its digest.

    Of one digest only the earliest that this task holds goes on as it is, so a passage that
    a third of all documents have sends a few rows per task to where its copies meet.
    """
    held: dict[bytes, tuple[int, int, int]] = {}

    def row(digest: bytes, doc: int, th: int, span: int) -> tuple:
        return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), doc, th, span

    for batch in slices(batches, 2):
        for doc, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, start = text.encode("utf-8"), 0
            for end in chunks_of(data):
                digest, span = xxh3_128_digest(data[start:end]), start << 31 | end
                was = held.get(digest)
                if was is None:
                    held[digest] = doc, th, span
                elif (was[0], was[2] >> 31) < (doc, start):
                    yield doc, start, doc, th, ~span
                elif (doc, start) < (was[0], was[2] >> 31):
                    held[digest] = doc, th, span
                    yield was[0], was[2], was[0], was[1], ~was[2]
                else:  # another text of the same doc_id
                    yield row(digest, doc, th, span)
                start = end
        if len(held) > HELD:
            yield from (row(k, *v) for k, v in held.items())
            held = {}
    yield from (row(k, *v) for k, v in held.items())


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc, th, start, end) of chunks that stand earlier, too, from a part sorted by digest, doc and span."""
    digest, first = None, (0, 0)
    for batch in batches:
        for hi, lo, doc, th, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if span < 0:
                yield doc, th, ~span >> 31, ~span & 0x7FFFFFFF
            elif (hi, lo) != digest:
                digest, first = (hi, lo), (doc, span >> 31)
            elif first < (doc, span >> 31):
                yield doc, th, span >> 31, span & 0x7FFFFFFF


def repeats(texts: DataFrame) -> DataFrame:
    """(doc, th, start, end) of every chunk of ``texts`` (as keyed) that also stands earlier (lesser doc_id, or same doc_id and lesser start)."""
    found = texts.select("doc", "th", "text").mapInArrow(on_tuples(_chunked, _ROWS), ", ".join(f"{n} long" for n in _ROWS.split()))
    met = found.repartition(shuffle_parts(texts.sparkSession), "hi", "lo").sortWithinPartitions("hi", "lo", "doc", "span")
    return met.mapInArrow(on_tuples(_later, "doc th start end"), "doc long, th long, start long, end long")


def substring_dedup(docs: DataFrame, least_run: int = 1) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): its UTF-8 bytes less the runs of chunks that repeat earlier ones.

    A chunk's first place (least doc_id, null first; then least start) stays. Runs of
    fewer than ``least_run`` bytes stay, too (none by default). A null text is empty; fully repeated rows
    are one document and all stay; other columns are not read.
    """
    texts = keyed(docs)
    return cut(texts, repeats(texts), least_run)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), LEAST_RUN)
