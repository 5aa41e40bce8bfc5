"""Cross-tokenizer alignment (operator 11): a postings cogroup.

Two tokenizers read the same bytes. Where a token of each ends at the same byte, the two
are linked, and the offsets of all links cut both token rows into groups. Tokens are never
empty, so a link closes each group and there are as many links as groups.

A task aligns a block of documents and turns the links into postings: for each id of side
B, which ids of side A it was linked with, in which document, how often. Postings are
shuffled by their B id and sorted; the corpus-wide counts of that id's pairs come first in
the stream, so their maximum is known when its postings pass, and neither is held as a
whole. What postings add to their documents is summed in dense slots of a block, handed on
packed, and added up by block.

B ids are dealt to a fixed number of buckets, and a bucket's postings to as many groups of
blocks as its size asks for, so a hot id is read by many tasks; a bucket's counts (bounded
by the vocabularies) are sent to each of its groups. A document is in one group of each
bucket, so it gets as many sums as there are buckets, however large the corpus is.

Both tokenizers are cut where neither can join: before spaces. What was found for a run of
spaces and the characters up to the next space is remembered, so most text is looked up.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import body, checkpointed, shuffle_parts, slices, table

#: Text of a block, and of what is aligned at once (characters); documents of a block (a place in it is 16 bits).
BLOCK_BYTES, SEGMENT, DOCS = 4_000_000, 1_000_000, 4096
#: Units that a worker remembers, their characters, and the longest that stays beyond a block.
UNITS_KEPT, CHARS_KEPT, LONGEST_KEPT = 250_000, 16_000_000, 64
#: Buckets of B ids; postings that a group of blocks has of a bucket.
BUCKETS, SHARE = 16, 2_000_000
#: Blocks whose sums a task holds, and pairs.
BLOCKS_HELD, PAIRS_HELD = 256, 1_000_000
#: A pair is b * WIDE + a; a posting is pair * WIDE + the document's place.
WIDE = 1 << 16

_UNIT = re.compile(" +[^ ]*")
#: White space before a space that more of it (or the end) follows: side A reads across such a cut.
_OPEN = re.compile(r"[^\S ] (?:\s|$)")


class Pair:
    """The two tokenizers, and what was found for units met lately."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(a), "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.a = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        #: Whether no piece goes on with a space after another character, so side B can be cut there.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        #: Side B puts no space before nothing.
        self.last_space = self.b.encode("a ")[-1:]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.a_bytes[rank] = word
        self.a_len, self.b_len = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self._names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []
        self.sizes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self._flat: tuple | None = None

    def units(self, text: str) -> list[str]:
        """A space and the text, cut where each part has the same tokens alone as in the whole."""
        text = f" {text}"
        if not self.cuts:
            return [text]
        found = _UNIT.findall(text)
        if not _OPEN.search(text):
            return found
        out: list[str] = []
        for unit in found:
            if out and out[-1][-1] != " " and out[-1][-1].isspace() and (len(unit) < 2 or unit[1].isspace()):
                out[-1] += unit
            else:
                out.append(unit)
        return out

    def _align(self, units: list[str]) -> None:
        """Remember the alignment of units, which are tokenized as one text: tokens do not go beyond one. A unit with other bytes is marked by None."""
        text = "".join(units)
        raw = text.encode()
        a, b = self.a.encode_ordinary(text), self.b.encode(text[1:]) if len(text) > 1 else self.last_space
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw or b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            if len(units) > 1:
                for unit in units:
                    self._align([unit])
                return
            self.number[units[0]] = len(self.groups)
            self.groups.append(None)
            self.sizes.append(np.zeros((1, 3), dtype=np.int64))
            return
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        _, at_a, at_b = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        ends = np.cumsum([len(u) for u in units] if len(raw) == len(text) else [len(u.encode()) for u in units])
        link_ends = np.searchsorted(a_end[at_a], ends, "right")
        cuts = np.stack([np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right"), link_ends], axis=1)
        self.sizes.append(np.diff(cuts, axis=0, prepend=0))
        self.codes.append(b[at_b] * WIDE + a[at_a])
        names = self._names
        a_names, b_names = [names[i] for i in a.tolist()], [names[i] for i in b.tolist()]
        groups, i, j = [], 0, 0
        for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            groups.append(f"{a_names[i]}|{b_names[j]}" if x - i == 1 == y - j else f"{','.join(a_names[i:x])}|{','.join(b_names[j:y])}")
            i, j = x, y
        start, number = 0, len(self.groups)
        for unit, end in zip(units, link_ends.tolist(), strict=True):
            self.number[unit] = number
            self.groups.append(";".join(groups[start:end]))
            number, start = number + 1, end
        self._flat = None

    def _learn(self, units: set[str]) -> None:
        held: list[str] = []
        size = 0
        for unit in sorted(units):
            self.chars += len(unit)
            if len(unit) > LONGEST_KEPT or unit[-1].isspace():
                self._align([unit])  # side A joins white space with what follows
                continue
            held.append(unit)
            size += len(unit)
            if size > 50_000:
                self._align(held)
                held, size = [], 0
        if held:
            self._align(held)
        self._flat = None

    def look_up(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of some units; and of all remembered ones: sizes (tokens of A, of B, links), codes of links, and where a unit's begin."""
        new = set(units).difference(self.number)
        if new:
            self._learn(new)
        if self._flat is None:
            sizes = np.concatenate(self.sizes) if self.sizes else np.zeros((0, 3), dtype=np.int64)
            codes = np.concatenate(self.codes) if self.codes else np.zeros(0, dtype=np.int64)
            self.sizes, self.codes = [sizes], [codes]
            self._flat = sizes, codes, np.cumsum(sizes[:, 2]) - sizes[:, 2]
        return np.fromiter(map(self.number.__getitem__, units), dtype=np.int64, count=len(units)), *self._flat

    def full(self) -> bool:
        return len(self.number) > UNITS_KEPT or self.chars > CHARS_KEPT

    def trim(self, often: list[str]) -> None:
        """Forget all but the short ones of ``often``."""
        kept = [u for u in often[: UNITS_KEPT // 2] if len(u) <= LONGEST_KEPT]
        numbers, sizes, codes, starts = self.look_up(kept)
        groups = [self.groups[n] for n in numbers.tolist()]
        links = _ranges(starts[numbers], sizes[numbers, 2])
        self._forget()
        self.number, self.chars = dict(zip(kept, range(len(kept)), strict=True)), sum(map(len, kept))
        self.groups, self.sizes, self.codes = groups, [sizes[numbers]], [codes[links]]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_LOADED: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """The two tokenizers, read once per worker."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Pair(a, b)
    return _LOADED[a, b]


def _segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut between a character that is no white space and a space (which is left out, as units put one before)."""
    start = 0
    while len(text) - start > most:
        at = start + most
        while (at := text.find(" ", at)) > 0 and text[at - 1].isspace():
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:] if start else text


class _Block:
    """Documents of one block as they are aligned."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.rows: list[tuple] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.parts: list[tuple[int, str, bool]] = []
        self.waiting = self.bytes = 0
        self.state: dict[int, list] = {}

    def add(self, doc_id: int | None, text: str | None) -> None:
        place = len(self.rows)
        self.rows.append((doc_id, text))
        for n, part in enumerate((_segments(text) if self.pair.cuts else [text]) if text else ()):
            self.parts.append((place, part, n > 0))
            self.waiting += len(part)
            if self.waiting >= SEGMENT:
                self.align()
        self.bytes += len(text or "")

    def align(self) -> None:
        units = [self.pair.units(part) for _, part, _ in self.parts]
        flat = [u for us in units for u in us]
        if not flat:
            return
        numbers, sizes, codes, starts = self.pair.look_up(flat)
        counts = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        ends = np.cumsum(counts)
        groups, totals = self.pair.groups, np.add.reduceat(sizes[numbers], ends - counts, axis=0)
        places = np.repeat(np.array([p for p, _, _ in self.parts]), counts)
        for (place, _, more), start, end, total in zip(self.parts, (ends - counts).tolist(), ends.tolist(), totals, strict=True):
            own = self.state.setdefault(place, [0, 0, 0, hashlib.sha256()])
            listed = [groups[n] for n in numbers[start:end].tolist()]
            if own[3] is None or None in listed:
                own[:] = [0, 0, 0, None]
                continue
            own[:3] = (own[:3] + total).tolist()
            own[3].update(b";" * more + ";".join(listed).encode())
        links = sizes[numbers, 2]
        posted = codes[_ranges(starts[numbers], links)] * WIDE + np.repeat(places, links)
        self.found.append(np.unique(posted, return_counts=True))
        self.parts, self.waiting = [], 0
        if self.pair.full():
            often, times = np.unique(numbers, return_counts=True)
            again = set(often[times > 1].tolist())
            self.pair.trim([u for u, n in self.pair.number.items() if n in again])

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents that have tokens, in order, each at most 255 times; more times are further postings."""
        self.align()
        codes = np.concatenate([c for c, _ in self.found] or [np.zeros(0, dtype=np.int64)])
        times = np.concatenate([t for _, t in self.found] or [np.zeros(0, dtype=np.int64)])
        if len(self.found) > 1:
            order = np.argsort(codes, kind="stable")
            codes, times = codes[order], times[order]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            codes, times = codes[first], np.add.reduceat(times, first) if len(first) else times
        without = np.array([p for p, own in self.state.items() if own[3] is None], dtype=np.int64)
        if len(without):
            good = ~np.isin(codes % WIDE, without)
            codes, times = codes[good], times[good]
        if len(times) and times.max() > 255:
            parts = -(-times // 255)
            last = np.cumsum(parts) - 1
            left = times - 255 * (parts - 1)
            codes, times = np.repeat(codes, parts), np.full(int(parts.sum()), 255, dtype=np.int64)
            times[last] = left
        return codes, times

    def documents(self, number: int) -> pa.RecordBatch:
        done = [self.state.get(p, [0, 0, 0, None]) for p in range(len(self.rows))]
        columns = {
            "doc_id": pa.array([r[0] for r in self.rows], pa.int64()), "block": pa.array([number] * len(done), pa.int64()), "place": pa.array(range(len(done)), pa.int32()),
            **{name: pa.array([d[n] for d in done], pa.int64()) for n, name in enumerate(("n_a", "n_b", "n_groups"))},
            "groups_sha256": pa.array(["" if d[3] is None else d[3].hexdigest() for d in done]),
        }
        return _row(len(done), columns)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("b", pa.int32()), ("a_ids", pa.binary()), ("places", pa.binary()), ("times", pa.binary())])
_TYPES = "doc_id long, block long, place int, n_a long, n_b long, n_groups long, groups_sha256 string, b int, a_ids binary, places binary, times binary"


def _row(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _packed(values: np.ndarray, cuts: np.ndarray, kind: str) -> pa.Array:
    """A row of bytes for each range between cuts."""
    data = np.ascontiguousarray(values.astype(kind))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Rows of documents and rows of postings of ``docs`` (doc_id, text), side by side, at rest.

    A row with ``place`` is a document: block and place name it, with its tokens on both sides,
    groups and the digest of these. A row with ``b`` has a block's postings of that id, packed: ids of
    side A (16 bits each), places in the block (16), times (8).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, seq = pair(a, b), TaskContext.get().partitionId() << 27
        block = _Block(both)

        def out() -> Iterator[pa.RecordBatch]:
            codes, times = block.postings()
            yield block.documents(seq)
            ids = codes // (WIDE * WIDE)
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            cuts = np.append(first, len(codes))
            columns = {
                "block": pa.array(np.full(len(first), seq)), "b": pa.array(ids[first], pa.int32()),
                "a_ids": _packed(codes // WIDE % WIDE, cuts, "<u2"), "places": _packed(codes % WIDE, cuts, "<u2"), "times": _packed(times, cuts, "u1"),
            }
            whole = _row(len(first), columns)
            for at in range(0, len(first), 4096):
                yield whole.slice(at, 4096)

        for batch in slices(batches, 1, BLOCK_BYTES):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block.rows and (block.bytes + len(text or "") > BLOCK_BYTES or len(block.rows) == DOCS):
                    yield from out()
                    block, seq = _Block(both), seq + 1
                block.add(doc_id, text)
        if block.rows:
            yield from out()

    return checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, _TYPES))


def _unpack(batch: pa.RecordBatch, name: str, kind: str, start: int = 0, end: int | None = None) -> np.ndarray:
    """The packed values of rows start to end, one row after the other."""
    column = batch.column(name)
    at = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype="u1")[at[start] : at[len(column) if end is None else end]].view(kind) if at[-1] > at[0] else np.zeros(0, dtype=kind)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(b, a, n): how many links of the corpus hold each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def summed() -> np.ndarray:
            if not held:
                return np.zeros((0, 2), dtype=np.int64)
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows[:, 0])]
            first = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
            return np.column_stack([rows[first, 0], np.add.reduceat(rows[:, 1], first)]) if len(first) else rows

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0] // WIDE, pa.int32()), pa.array(part[:, 0] % WIDE, pa.int32()), pa.array(part[:, 1])], names=["b", "a", "n"])

        for batch in batches:
            ids = _unpack(batch, "a_ids", "<u2").astype(np.int64)
            if not len(ids):
                continue
            lengths = np.diff(np.frombuffer(batch.column("a_ids").buffers()[1], dtype="<i4")[batch.column("a_ids").offset :][: batch.num_rows + 1]) // 2
            codes = np.repeat(batch.column("b").to_numpy().astype(np.int64), lengths) * WIDE + ids
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            held.append(np.column_stack([codes[first], np.add.reduceat(_unpack(batch, "times", "u1").astype(np.int64), first)]))
            size += len(first)
            if size > 3 * PAIRS_HELD:
                held = [summed()]
                size = len(held[0])
                if size > PAIRS_HELD:
                    yield from out(held[0])
                    held, size = [], 0
        yield from out(summed())

    found = postings.select("b", "a_ids", "times").mapInArrow(run, "b int, a int, n long")
    return found.groupBy("b", "a").agg(F.sum("n").alias("n"))


def contributions(postings: DataFrame, share: int = SHARE) -> DataFrame:
    """(block, place, n_best, count_sum): of each document that has links, those whose pair is the most frequent of its B id, and the sum of their pairs' counts."""
    spark = postings.sparkSession
    bucket = F.pmod(F.hash("b"), F.lit(BUCKETS))
    sizes = postings.groupBy(bucket.alias("bucket"), "block").agg(F.sum(F.length("times")).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    groups = {r["bucket"]: max(-(-r["n"] // share), -(-3 * r["blocks"] // (2 * BLOCKS_HELD))) for r in sizes.collect()}  # a row for each bucket
    dealt = F.element_at(F.array(*(F.lit(groups.get(k, 1)) for k in range(BUCKETS))), bucket + 1)
    none = F.lit(None).cast("binary")
    totals = pair_counts(postings).groupBy("b").agg(F.collect_list(F.struct("a", "n")).alias("pairs"))
    counts = totals.select(bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), dealt - 1)).alias("part"), "b", F.lit(-1).cast("long").alias("block"), F.col("pairs.a").alias("a"), F.col("pairs.n").alias("n"), none.alias("a_ids"), none.alias("places"), none.alias("times"))
    posted = postings.select(bucket.alias("bucket"), F.pmod(F.xxhash64("block"), dealt).cast("int").alias("part"), "b", "block", F.lit(None).cast("array<int>").alias("a"), F.lit(None).cast("array<bigint>").alias("n"), "a_ids", "places", "times")
    parts = max(BUCKETS, 2 * sum(groups.values()))
    stream = counts.unionByName(posted).repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part", "b", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, top = np.zeros(WIDE, dtype=np.int64), 0
        slots: dict[int, int] = {}
        best, total = np.zeros((2, BLOCKS_HELD * DOCS), dtype=np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            blocks, where, cuts = sorted(slots, key=slots.get), [], [0]
            for n in range(len(blocks)):
                own = np.flatnonzero(total[n * DOCS : (n + 1) * DOCS]) + n * DOCS
                where.append(own)
                cuts.append(cuts[-1] + len(own))
            if blocks:
                at, cuts = np.concatenate(where), np.array(cuts)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), _packed(at % DOCS, cuts, "<u2"), _packed(best[at], cuts, "<i8"), _packed(total[at], cuts, "<i8")], names=["block", "places", "best", "total"])
            slots.clear()
            best[:] = 0
            total[:] = 0

        for batch in batches:
            ids, blocks = batch.column("b").to_numpy(), batch.column("block").to_numpy()
            heads = np.flatnonzero(blocks < 0)
            for start, end in zip(np.append(0, heads) if not len(heads) or heads[0] else heads, np.append(heads[1:] if len(heads) and not heads[0] else heads, len(ids)), strict=True):
                if start < end and blocks[start] < 0:
                    count[:] = 0
                    n = batch.column("n").slice(start, 1).flatten().to_numpy()
                    count[batch.column("a").slice(start, 1).flatten().to_numpy()] = n
                    top, start = n.max(), start + 1
                for at in range(start, end, BLOCKS_HELD // 2):
                    to = min(end, at + BLOCKS_HELD // 2)
                    if len(slots) + to - at > BLOCKS_HELD:
                        yield from out()
                    bases = np.array([slots.setdefault(x, len(slots)) for x in blocks[at:to].tolist()], dtype=np.int64) * DOCS
                    a, times = _unpack(batch, "a_ids", "<u2", at, to), _unpack(batch, "times", "u1", at, to).astype(np.int64)
                    offsets = np.frombuffer(batch.column("times").buffers()[1], dtype="<i4")[batch.column("times").offset :][at : to + 1]
                    slot = np.repeat(bases, np.diff(offsets)) + _unpack(batch, "places", "<u2", at, to)
                    n = count[a]
                    np.add.at(best, slot, np.where(n == top, times, 0))
                    np.add.at(total, slot, n * times)
        yield from out()

    packed = stream.mapInArrow(run, "block long, places binary, best binary, total binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, total = None, np.zeros(DOCS, dtype=np.int64), np.zeros(DOCS, dtype=np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total) if last is not None else np.zeros(0, dtype=np.int64)
            columns = [pa.array([last] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(best[at]), pa.array(total[at])]
            best[:] = 0
            total[:] = 0
            return pa.RecordBatch.from_arrays(columns, names=["block", "place", "n_best", "count_sum"])

        for batch in batches:
            for n, block in enumerate(batch.column(0).to_pylist()):
                if block != last:
                    yield out()
                    last = block
                at = _unpack(batch, "places", "<u2", n, n + 1)
                best[at] += _unpack(batch, "best", "<i8", n, n + 1)
                total[at] += _unpack(batch, "total", "<i8", n, n + 1)
        yield out()

    return packed.repartition(shuffle_parts(spark), "block").sortWithinPartitions("block").mapInArrow(add, "block long, place int, n_best long, count_sum long")


def crosstok(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", share: int = SHARE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its tokens on both sides, groups, links and what the corpus says of these.

    A null or empty text has no tokens, nor has one that a side does not give back byte by byte: zeros
    and an empty digest. Rows may repeat, each counts in the corpus; null ids stay null; other columns
    are not read; an empty table gives an empty result.
    """
    rows = aligned(docs, a, b)
    found = rows.filter("b IS NULL").select("doc_id", "block", "place", "n_a", "n_b", "n_groups", "groups_sha256")
    added = contributions(rows.filter("b IS NOT NULL").select("block", "b", "a_ids", "places", "times"), share)
    both = found.join(added, ["block", "place"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok(table(spark, sf_dir, "documents"))
