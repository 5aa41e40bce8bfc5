"""Exact dedup (operator 4) on a cuckoo-filter index.

A filter slot holds a short fingerprint; beside it, in the same bucket, lies the
full key. A fingerprint hit counts only after the full keys agree, so false
positives of the filter never merge texts. When an insertion finds no free slot
the table doubles and is refilled from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import WS, body, checkpointed, fresh, hinted, shuffle_parts, table

SLOTS = 4
KICKS = 200
#: A map task hands on what it has gathered once so many digests are live in it.
LIVE_PER_TASK = 200_000
#: Digests that meet in one reduce task.
DIGESTS_PER_PART = 250_000


class CuckooIndex:
    """Live digests (at least 10 bytes, spread evenly) with a value each: put, get, delete; grows by itself."""

    def __init__(self, buckets: int = 1024):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)
        self.live = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(key[:2], "little") | 1 << 16
        one = int.from_bytes(key[2:10], "little") & self.mask
        return fingerprint, one, self._other(one, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self.mask)

    def _find(self, key: bytes) -> int:
        fingerprint, *buckets = self._places(key)
        for bucket in buckets:
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == fingerprint and self.keys[at] == key:
                    return at
        return -1

    def get(self, key: bytes):
        at = self._find(key)
        return None if at < 0 else self.values[at]

    def put(self, key: bytes, value) -> None:
        """Insert the key, or give a live one a new value."""
        at = self._find(key)
        if at >= 0:
            self.values[at] = value
        elif (homeless := self._push(key, value)) is not None:
            self._grow([*self.items(), homeless])

    def _push(self, key: bytes, value) -> tuple | None:
        """Place the key, moving others to their second bucket; returns the one that finds no place."""
        fingerprint, one, two = self._places(key)
        for bucket in (one, two):
            if self._fill(bucket, fingerprint, key, value):
                return None
        bucket = one
        for kick in range(KICKS):
            at = bucket * SLOTS + kick % SLOTS
            fingerprint, self.prints[at] = self.prints[at], fingerprint
            key, self.keys[at] = self.keys[at], key
            value, self.values[at] = self.values[at], value
            bucket = self._other(bucket, fingerprint)
            if self._fill(bucket, fingerprint, key, value):
                return None
        return key, value

    def _fill(self, bucket: int, fingerprint: int, key: bytes, value) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[at]:
                self.prints[at], self.keys[at], self.values[at] = fingerprint, key, value
                self.live += 1
                return True
        return False

    def _grow(self, stored: list[tuple]) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._push(k, v) is None for k, v in stored):
                return

    def delete(self, key: bytes) -> bool:
        at = self._find(key)
        if at < 0:
            return False
        self.prints[at], self.keys[at], self.values[at] = 0, None, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


_PART = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("points", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])
_PART_DDL = "digest binary, n long, points long, id long, row long"
_LIVE = pa.schema([("digest", pa.binary()), ("n", pa.int64())])


def _sent(index: CuckooIndex, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for at in range(0, len(rows), 20_000):
        some = rows[at : at + 20_000]
        columns = [[k for k, _ in some], *([v[i] for _, v in some] for i in range(len(schema) - 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of one digest become one: sizes add up, the better row stays. Hands on at ``most`` live digests."""
    index, last = CuckooIndex(), 1 << 63
    for batch in batches:
        for key, n, points, doc, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            was = index.get(key)
            if was is None:
                index.put(key, (n, points, doc, row))
                continue
            new = (-points, last if doc is None else doc, row) < (-was[1], last if was[2] is None else was[2], was[3])
            index.put(key, (was[0] + n, *((points, doc, row) if new else was[1:])))
        if most and index.live >= most:
            yield from _sent(index, _PART)
            index = CuckooIndex()
    yield from _sent(index, _PART)


def _net(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
    """Insertions (n > 0) less deletions (n < 0) of each digest; at the end only live digests remain."""
    index = CuckooIndex()
    for batch in batches:
        for key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = n + (index.get(key) or (0,))[0]
            if total:
                index.put(key, (total,))
            else:
                index.delete(key)
        if not final and index.live >= LIVE_PER_TASK:
            yield from _sent(index, _LIVE)
            index = CuckooIndex()
    if final:
        for key in [k for k, v in index.items() if v[0] < 0]:
            index.delete(key)
    yield from _sent(index, _LIVE)


def text_digest() -> Column:
    """SHA-256 of ``text`` without the characters of [\\x20\\x09-\\x0D], 32 bytes; null is empty."""
    return F.unhex(F.sha2(F.translate(body(), WS, "").cast("binary"), 256))


def live_digests(changes: DataFrame) -> DataFrame:
    """Digests that are live after all ``changes`` (digest binary, n: copies put in, or taken out if negative), with their number."""
    part = changes.select("digest", F.col("n").cast("long")).mapInArrow(partial(_net, final=False), "digest binary, n long")
    return part.repartition(shuffle_parts(changes.sparkSession), "digest").mapInArrow(partial(_net, final=True), "digest binary, n long")


def groups(rows: DataFrame, n_rows: int) -> DataFrame:
    """One row per digest of ``rows`` (digest, points, id, row): n copies, and points, id, row of the one that stays.

    Map tasks fold their own rows first, so a digest that a third of all rows share
    sends one row per task.
    """
    part = rows.select("digest", F.lit(1).cast("long").alias("n"), "points", "id", "row").mapInArrow(partial(_fold, most=LIVE_PER_TASK), _PART_DDL)
    return part.repartition(shuffle_parts(rows.sparkSession, n_rows, DIGESTS_PER_PART), "digest").mapInArrow(partial(_fold, most=None), _PART_DDL)


def digested(docs: DataFrame, *node: Column) -> DataFrame:
    """id, code points, digest and a number for each row (and ``node``, if given); checkpointed, so the texts are read once."""
    return checkpointed(
        docs.select(
            *(n.alias("node") for n in node),
            F.col("doc_id").cast("long").alias("id"),
            F.length(body()).cast("long").alias("points"),
            text_digest().alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (needs doc_id, text) with its group of equal texts.

    Texts are equal without the characters of [\\x20\\x09-\\x0D]; null is empty, and all
    empty texts form a group. The row with most code points stays, then the smallest
    doc_id (null last), then the first row: of fully repeated rows one stays. Columns
    other than doc_id and text are not read, whatever their names. An empty table
    gives an empty result.
    """
    rows = digested(docs)
    best = groups(rows, rows.count()).select("digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
    return rows.join(best, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (a pipeline stage); rules as in exact_dedup.

    Only ids and hashes are shuffled: rows whose (doc_id, text) does not stay are taken out by
    an anti-join. Rows that repeat a doc_id and a text fully are set apart, and one of each stays.
    """
    rows = digested(docs, F.xxhash64(F.col("doc_id").cast("long"), body()))
    best = checkpointed(groups(rows, rows.count()).filter("n > 1").select("digest", F.col("row").alias("keep_row")))
    met = checkpointed(rows.join(best, "digest").select("node", "row", (F.col("row") == F.col("keep_row")).alias("stays")))
    named = met.groupBy("node").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    node = fresh(docs, "node")
    gone = checkpointed(named.filter("n > 1 or not stays").select(F.col("node").alias(node), "stays"))
    key = F.xxhash64(F.col("doc_id").cast("long"), body())
    kept = docs.join(hinted(gone.select(node)), key == F.col(node), "left_anti")
    repeated = gone.filter("stays").select(node)
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.withColumn(node, key).join(hinted(repeated), node, "left_semi").dropDuplicates([node]).drop(node))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t ORDER BY length(x) DESC, doc_id)
"""
