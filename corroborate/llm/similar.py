"""Near-duplicate groups by the similarity of shingle sets (the pipeline's form of operator 8).

As in operator 8, fingerprints are indexed by multi-index hashing and small Hamming balls; what
they link is decided on the shingle sets. At a similarity of 0.8 two fingerprints of 64 bits
differ in some 10, out of reach of Hamming balls, so a second index gives the rest: in one order
for all texts, two sets of that similarity share one of their first shingles. Sizes and parity
bitmaps drop pairs that cannot have it, where they meet; rows that are joined are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from corroborate.llm.common import body, checkpointed, fresh, hinted, shuffle_parts, slices
from corroborate.llm.simhash import SEED, links, majority, shingle_digests
from corroborate.operators.components import components

#: Longs of a set's bitmap. Two bitmaps differ in no more bits than the sets differ in members.
LONGS = 16
#: Rows of a bucket that first meet in one place: smaller buckets are then done, others are so dealt into small blocks.
FIRST = 32
#: Rows of a block of a large bucket, pairs whose bitmaps are compared at once, and shingles of texts that are compared in one place.
BLOCK, AT_ONCE, TOGETHER = 1000, 50_000, 1_000_000
#: One in so many documents tells which shingles are common, from so many of them, and how many are named at most.
SAMPLE, COMMON, NAMED = 16, 4, 65_536


def _distinct(digests: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(digests, dtype=">u8").astype(np.int64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles' digests, sorted."""
    return _distinct(shingle_digests(text, words))


def bitmap(shingles: np.ndarray) -> list[int]:
    """LONGS longs: whether an odd number of shingles falls on each bit."""
    bits = np.bincount(shingles & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


class Order:
    """One order for all shingles: common ones (with an estimate of their texts) last, others by their digest.

    Which ones are common changes the size of buckets and no result.
    """

    def __init__(self, counts: list[tuple[int, int]]):
        counts = sorted(counts)
        self.tokens = np.array([t for t, _ in counts], dtype=np.int64)
        self.n = np.array([n for _, n in counts], dtype=np.int64)

    def _common(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(shingles), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
        return np.where(self.tokens[at] == shingles, self.n[at], 0)

    def prefix(self, shingles: np.ndarray, similarity: float) -> np.ndarray:
        """The first shingles, of which two sets of ``similarity`` or more share one at least."""
        n = len(shingles)
        return shingles[np.lexsort((shingles, self._common(shingles)))][: n - math.ceil(similarity * n - 1e-9) + 1]


def _digests(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    """Batches of node, doc and text, with the rows that have shingles, and the digests of these."""
    for batch in slices(batches, 2, 1_000_000):
        digests = [shingle_digests(t, words) for t in batch.column(2).to_pylist()]
        kept = [n for n, d in enumerate(digests) if d]
        yield batch, kept, [digests[n] for n in kept]


def _order(texts: DataFrame, words: int) -> Order:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, digests in _digests(batches, words):
            for d in digests:
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(d))], names=["token"])

    counts = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return Order([(r.token, r.n) for r in counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(NAMED).collect()])


PAIRS = "a long, b long, na long, nb long"


def _pairs_of(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Pairs of (node, k) of two sides."""
    (a, ka), (b, kb) = left, right
    swap = a > b
    columns = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, kb, ka) >> 32, np.where(swap, ka, kb) >> 32
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "na", "nb"])


def _may_be(n: np.ndarray, n2: np.ndarray, bits: np.ndarray, bits2: np.ndarray, similarity: float) -> np.ndarray:
    """Whether bitmaps allow for the similarity of sets of ``n`` and ``n2`` shingles."""
    shared = (n + n2 - np.bitwise_count(bits ^ bits2).sum(axis=1, dtype=np.int64)) // 2  # at most
    return shared >= similarity * (n + n2 - shared)


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """PAIRS that multi-index hashing finds: rows with the first one of their fingerprint, and first ones whose fingerprints differ in two bits at most."""
    first = checkpointed(rows.groupBy("fp").agg(F.min(F.struct("k", "node")).alias("first")))
    same = rows.join(first, "fp").select(F.struct("k", "node").alias("x"), F.col("first").alias("y"))
    side = lambda name, to: first.select(F.col("fp").alias(name), F.col("first").alias(to))
    near = links(first.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    ends = F.array_sort(F.array(F.struct(F.col("x.node").alias("node"), F.shiftright("x.k", 32).alias("n")), F.struct(F.col("y.node").alias("node"), F.shiftright("y.k", 32).alias("n")))).alias("e")
    return same.union(near).filter("x.node <> y.node").select(ends).select(F.col("e")[0]["node"].alias("a"), F.col("e")[1]["node"].alias("b"), F.col("e")[0]["n"].alias("na"), F.col("e")[1]["n"].alias("nb")).distinct()


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with root (the node itself where nothing joined it) and weight, the rows of that root."""
    weight = roots.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
    return rows.join(hinted(checkpointed(roots.join(weight, "root"))), "node", "left").withColumns({"root": F.coalesce("root", "node"), "weight": F.coalesce("weight", F.lit(1))})


def _buckets(met: DataFrame, *more: Column) -> DataFrame:
    """(token, n) and ``more``: the buckets of ``met`` (token, node, root) in which different roots meet, and their rows."""
    sizes = met.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *more)
    return checkpointed(sizes.filter("low < high").drop("low", "high"))


def _meeting(met: DataFrame) -> DataFrame:
    """The rows of ``met`` (token, node, k, root) in buckets in which different roots meet, with n, the bucket's rows; ``met`` is shuffled once."""
    bucket = Window.partitionBy("token")
    sized = met.withColumns({"n": F.count(F.lit(1)).over(bucket), "low": F.min("root").over(bucket), "high": F.max("root").over(bucket)})
    return checkpointed(sized.filter("low < high").drop("low", "high"))


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of a batch, and the bitmaps if it has them."""
    bits = [batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)] if "bits" in batch.schema.names else []
    return [*(batch.column(n).to_numpy() for n in names), *bits]


def _allowed(pairs: DataFrame, side: DataFrame, similarity: float) -> DataFrame:
    """The PAIRS whose bitmaps allow for the similarity."""
    both = pairs.join(side.select(F.col("node").alias("a"), F.col("bits").alias("ba")), "a").join(side.select(F.col("node").alias("b"), F.col("bits").alias("bb")), "b")
    distance = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, d: total + d)
    shared = F.floor((F.col("na") + F.col("nb") - distance) / 2)  # at most
    return both.filter(shared >= similarity * (F.col("na") + F.col("nb") - shared)).select("a", "b", "na", "nb")


def _first_met(met: DataFrame, side: DataFrame, similarity: float) -> DataFrame:
    """PAIRS of different roots that meet in one bucket, sizes and bitmaps allowing; of larger buckets than FIRST those in one of its small blocks."""

    def compared(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, block, node, root, k, *bits = columns
        new = np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])]
        starts = np.flatnonzero(new)
        after = np.repeat(np.r_[starts[1:], len(token)], np.diff(np.r_[starts, len(token)])) - np.arange(len(token))
        n, at, far = k >> 32, np.arange(len(token)), 0
        while len(at := at[after[at] > (far := far + 1)]):  # each row with the one ``far`` after it in its cell
            one, two = at, at + far
            ok = (root[one] != root[two]) & (np.minimum(n[one], n[two]) >= np.maximum(n[one], n[two]) * similarity)
            one, two = one[ok], two[ok]
            if bits:
                ok = _may_be(n[one], n[two], bits[0][one], bits[0][two], similarity)
                one, two = one[ok], two[ok]
            if len(one):
                yield _pairs_of((node[one], k[one]), (node[two], k[two]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch, ("token", "block", "node", "root", "k"))
            held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            whole = last[-1] + 1 if len(last) else 0  # the last cell may go on
            yield from compared([c[:whole] for c in held])
            held = [c[whole:] for c in held]
        if held is not None:
            yield from compared(held)

    # By token, too, so that the rows of a large group meet others in each of their buckets.
    block = F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("n") / FIRST)).alias("block")

    def found(rows: DataFrame, *bits: str) -> DataFrame:
        dealt = rows.select("token", block, "node", "root", "k", *bits).repartition(shuffle_parts(met.sparkSession), "token", "block").sortWithinPartitions("token", "block")
        return dealt.mapInArrow(run, PAIRS).distinct()

    # Rows of small buckets make few pairs: these are looked up, in place of a bitmap for each row.
    small = _allowed(checkpointed(found(met.filter(F.col("n") <= FIRST))), side, similarity)
    return small.union(found(met.filter(F.col("n") > FIRST).join(side, "node"), "bits")).distinct()


def _others_met(met: DataFrame, side: DataFrame, similarity: float) -> DataFrame:
    """PAIRS of different roots that meet in one of the buckets of ``met``, sizes and bitmaps allowing.

    A bucket is dealt in blocks; rows of its greatest root stay in theirs, the others also visit
    all other blocks, so rows that are joined already cost no comparisons.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(home: list[np.ndarray], guest: list[np.ndarray], own: bool) -> Iterator[pa.RecordBatch]:
            node, k, root, block, bits = home
            node2, k2, root2, block2, bits2 = guest
            n, n2 = k >> 32, k2 >> 32
            ok = root2[:, None] != root[None, :]
            small, large = np.minimum(n2[:, None], n[None, :]), np.maximum(n2[:, None], n[None, :])
            ok &= small >= large * similarity
            # Of two rows that visit each other's block, the one of the lower block counts.
            ok &= np.triu(np.ones(ok.shape, dtype=bool), 1) if own else (block2 < 0)[:, None] | (block < 0)[None, :] | (block2[:, None] < block[None, :])
            all_g, all_h = np.nonzero(ok)
            for at in range(0, len(all_g), AT_ONCE):
                g, h = all_g[at : at + AT_ONCE], all_h[at : at + AT_ONCE]
                left = _may_be(n2[g], n[h], bits2[g], bits[h], similarity)
                if left.any():
                    g, h = g[left], h[left]
                    yield _pairs_of((node2[g], k2[g]), (node[h], k[h]))

        cell, home, guests, size = None, [], [], 0

        def joined(parts: list) -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*parts, strict=True)]

        def closed() -> Iterator[pa.RecordBatch]:
            if home and guests:
                own, others = joined(home), joined(guests)
                for at in range(0, len(others[0]), BLOCK):
                    yield from compared(own, [c[at : at + BLOCK] for c in others], False)
            guests.clear()

        def inner() -> Iterator[pa.RecordBatch]:
            if home:
                own = joined(home)
                yield from compared(own, own, True)

        for batch in batches:
            tokens, blocks, guest = (batch.column(name).to_numpy() for name in ("token", "block", "guest"))
            data = _columns(batch, ("node", "k", "root", "visits"))
            cuts = np.flatnonzero((np.diff(tokens) != 0) | (np.diff(blocks) != 0) | (np.diff(guest) != 0)) + 1
            for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(tokens)].tolist(), strict=True):
                if start == end:
                    continue
                key = tokens[start], blocks[start]
                if key != cell:
                    yield from closed()
                    yield from inner()
                    cell, home, size = key, [], 0
                part = [c[start:end] for c in data]
                if guest[start]:
                    guests.append(part)
                    size += end - start
                    if size > 4 * BLOCK:
                        yield from closed()
                        size = 0
                else:
                    home.append(part)
        yield from closed()
        yield from inner()

    rows = met.join(side, "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    free = F.col("root") != F.col("top")
    # visits: the row's own block if it visits others, else -1.
    rows = rows.select("token", "node", "k", "root", "bits", F.when(free, own).otherwise(F.lit(-1)).alias("visits"), own.alias("own"), F.explode(F.when(free, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"))
    rows = rows.select("token", "block", (F.col("own") != F.col("block")).cast("int").alias("guest"), *("node", "k", "root", "visits", "bits"))
    dealt = rows.repartition(shuffle_parts(met.sparkSession), "token", "block").sortWithinPartitions("token", "block", "guest")
    return dealt.mapInArrow(run, PAIRS).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of the PAIRS whose shingle sets have ``similarity`` or more.

    Pairs are gathered around the least text that their first one meets, in cells of some
    TOGETHER shingles, and each text is sent once to each of its cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in slices(batches, 3, 1_000_000):
            a, b = [], []
            for key, one, two, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != cell:
                    cell, sets = key, {}
                if two is None:
                    sets[one] = shingle_set(text, words)
                    continue
                s, t = sets[one], sets[two]
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if shared >= similarity * (len(s) + len(t) - shared):
                    a.append(one)
                    b.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    left = checkpointed(pairs)
    least = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a")).groupBy("u").agg(F.min("v").alias("least"))
    around = left.join(least.select(F.col("u").alias("a"), F.least("u", "least").alias("cell")), "a")
    weight = around.select("cell", F.col("a").alias("node"), F.col("na").alias("n")).union(around.select("cell", "b", "nb")).distinct().groupBy("cell").agg(F.ceil(F.sum("n") / TOGETHER).alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    placed = around.join(weight, "cell").select(F.xxhash64("cell", F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))).alias("key"), "a", "b")
    placed = checkpointed(placed)
    asked = checkpointed(placed.select("key", F.col("a").alias("node")).union(placed.select("key", "b")).distinct())
    sent = texts.select("node", "text").join(hinted(asked), "node").select("key", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    stream = sent.unionByName(placed.withColumn("text", F.lit(None).cast("string")))
    met = stream.repartition(shuffle_parts(texts.sparkSession), "key").sortWithinPartitions(F.col("key"), F.col("b").asc_nulls_first())
    return checkpointed(met.select("key", "a", "b", "text").mapInArrow(run, "a long, b long"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, keep): documents in groups linked by ``similarity`` or more, with the one that stays (least doc_id, null first).

    node is xxhash64(doc_id, text). The similarity is that of the sets of shingles of ``words``
    words, and all pairs that have it are linked: those whose fingerprints are near first, then,
    of rows that these have not joined, those that share one of their first shingles.
    Texts without words (nulls, too) link to
    nothing, rows that repeat are one document, an empty table has no groups.
    """
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(F.xxhash64(doc_id, body()).alias("node"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("doc"), body().alias("text"))
    order = _order(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch, kept, digests in _digests(batches, words):
            at, sets = pa.array(kept, pa.int64()), [_distinct(d) for d in digests]
            # The number of shingles, and a hash of all of them.
            keys = [len(s) << 32 | int.from_bytes(xxh64_digest(s.tobytes(), SEED)[:4], "big") for s in sets]
            columns = [pa.array(keys, pa.int64()), pa.array([majority(d) for d in digests], pa.int64()), pa.array([bitmap(s) for s in sets], lists), pa.array([order.prefix(s, similarity) for s in sets], lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["node", "doc", "k", "fp", "bits", "prefix"])

    rows = checkpointed(texts.mapInArrow(run, "node long, doc long, k long, fp long, bits array<long>, prefix array<long>"))
    found = _verified(_by_fingerprint(rows), texts, words, similarity)
    roots = components(found)
    side = rows.select("node", "bits").dropDuplicates(["node"])
    met = _named(rows.select("node", "k", "prefix"), roots).select("node", "k", "root", F.explode("prefix").alias("token"))
    met = _meeting(met)
    more = _verified(_first_met(met, side, similarity), texts, words, similarity)
    if not more.isEmpty():
        found = checkpointed(found.union(more))
        roots = components(found)
    large = met.filter(F.col("n") > FIRST).select("token", "node", "k").distinct()
    if not large.isEmpty():
        large = _named(large, roots)
        large = checkpointed(large.join(hinted(_buckets(large, F.max_by("root", F.struct("weight", "root")).alias("top"))), "token"))
        more = _verified(_others_met(large, side, similarity), texts, words, similarity)
        if not more.isEmpty():
            roots = components(found.union(more))
    grouped = roots.join(rows.select("node", "doc").distinct(), "node")
    return grouped.join(grouped.groupBy("root").agg(F.min(F.struct("doc", "node"))["node"].alias("keep")), "root").select("node", "keep")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less all but one document of each near-duplicate group, with all their columns (a pipeline stage).

    Fully repeated rows are one document and stay together; other rules as in similar_groups().
    """
    node = fresh(docs, "node")
    gone = checkpointed(similar_groups(docs, words, similarity).filter("node <> keep").select(F.col("node").alias(node)).distinct())
    return docs.join(hinted(gone), F.xxhash64(F.col("doc_id").cast("long"), body()) == F.col(node), "left_anti")
