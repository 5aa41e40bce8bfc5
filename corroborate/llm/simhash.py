"""SimHash near-dedup (operator 8) by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Fingerprints within two bits
agree on one segment and differ by up to two bits in the other, or differ by one
bit in each. Small Hamming balls (radius 1) are enumerated within a segment; to
keep a table's buckets small however many fingerprints share a segment, its key
also takes half of the other segment, in which a second ball is enumerated. What
a key fetches is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from corroborate.llm.common import body, checkpointed, slices, table
from corroborate.operators.components import components

SEED = 42


def shingle_digests(text: str, words: int) -> bytes:
    """XXH64 digests (8 bytes each, big-endian) of the word shingles of a text, A-Z lowered."""
    found = text.encode("utf-8").lower().split()  # on bytes, both know ASCII alone
    if not found:
        return b""
    line = b" ".join(found)
    if len(found) <= words:
        return xxh64_digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return b"".join([xxh64_digest(line[s:e], SEED) for s, e in zip(starts[: 1 - words].tolist() if words > 1 else starts.tolist(), ends[words - 1 :].tolist(), strict=True)])


def majority(digests: bytes, width: int = 64) -> int:
    """The bits set in over half of the digests, as a signed number of 64 bits; 0 for none."""
    if not digests:
        return 0
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(-1, width)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """id (doc_id) and fp (long) of each row; a null text is empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fp = [majority(shingle_digests(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), body().alias("text")).mapInArrow(run, "id long, fp long")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


#: Table and mask of each probe: which bits of a fingerprint are flipped before the table's key is taken.
#: Left segment: bits 32-63, right: 0-31. Tables 0, 1: left and the upper, lower half of right; 2, 3: right and the upper, lower half of left.
EXACT = [(t, 0) for t in range(4)]
FLIPS = [
    *((0, 1 << bit) for bit in range(16, 32)),  # equal left, one bit each in the halves of right
    *((t, 1 << bit) for t in (0, 1) for bit in range(32, 64)),  # a bit of left, and one half of right is equal
    *((2, 1 << bit) for bit in range(48, 64)),  # equal right, one bit each in the halves of left
]


def _key(t: Column, fp: Column) -> Column:
    """48 bits of the fingerprint by table, and the table's number above them."""
    left, right = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [
        F.shiftrightunsigned(fp, 16),
        F.shiftleft(left, 16).bitwiseOR(fp.bitwiseAND(F.lit(0xFFFF))),
        F.shiftleft(right, 16).bitwiseOR(F.shiftrightunsigned(fp, 48)),
        F.shiftleft(right, 16).bitwiseOR(left.bitwiseAND(F.lit(0xFFFF))),
    ]
    chosen = F.when(t == 0, parts[0])
    for n in (1, 2, 3):
        chosen = chosen.when(t == n, parts[n])
    return chosen.bitwiseOR(F.shiftleft(t.cast("long"), 48))


def _probes(fps: DataFrame, masks: list[tuple[int, int]], out: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).cast("long").alias("m")) for t, m in masks))
    probe = fps.select("fp", F.explode(rows).alias("p")).filter(F.col("fp").bitwiseAND(F.col("p.m")) == 0)  # of two, the one without the bit probes
    return probe.select(_key(F.col("p.t"), F.col("fp").bitwiseXOR(F.col("p.m"))).alias("key"), F.col("fp").alias(out))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fps`` (fp) that differ in one or two bits."""
    index = _probes(fps, EXACT, "b")
    probes = _probes(fps, EXACT + FLIPS, "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, 2)
    return probes.join(index, "key").filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_dedup(docs: DataFrame, words: int = 3) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with fingerprint and component.

    Fingerprints link at two or fewer differing bits; component_id is the least doc_id
    that links reach (null only where no row of the component has one). Texts without
    words have fingerprint 0 and link like any other; repeated rows share a component.
    Rows of one fingerprint are first gathered to one, so groups of copies cost no pairs.
    """
    rows = checkpointed(fingerprints(docs, words))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
