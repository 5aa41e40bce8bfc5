"""Source divergence audit (operator 13) by two-dimensional group-block tiling.

A group is a source of a language. Tasks count terms per group and hand counts on; all counts
of a term of a language meet, terms of too few documents go, and what is left of one slice of
the vocabulary is packed as a count vector for each group. Groups are dealt to blocks; a
vector is sent to each pair of blocks that its group is in. A task takes such a tile for some
slices of the vocabulary, one chunk after the other, and adds to the submatrix of its pairs;
the submatrices of a tile are added up. A large vocabulary is dealt to more tasks. Terms that neither side of a tile has add the same
amount each, so they are counted, not visited.

All sums are of whole numbers. A probability is 1 + floor(10^9 * (count + 2) / (N + 2V)); its
division is done in three steps of 1000 where it would not fit 63 bits, which holds up to
9 * 10^15 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import body, checkpointed, hinted, shuffle_parts, slices, table

#: Documents of a language that must hold a term, ranks of terms that are returned.
LEAST_DOCS, TOP = 10, 10
#: Groups of a block, terms of a chunk, and of the part of a vocabulary that a task takes for its tile.
BLOCK, CHUNK, RANGE = 64, 4096, 32_768
#: (group, term) counts that a task holds before it hands them on, and rows of a chunk that are packed at once.
ENTRIES_HELD, ROWS_HELD = 300_000, 500_000
#: Bytes of a text that are split at once.
PART = 1_000_000
SCALE = 1_000_000_000

#: A-Z become a-z, other ASCII becomes a space; bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in parts."""
    data = data.translate(_TERMS)
    start = 0
    while len(data) - start > PART:
        if (end := data.find(b" ", start + PART)) < 0:
            break
        yield data[start:end].split()
        start = end
    yield data[start:].split() if start else data.split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, summed in part; ``docs`` has lang, source and text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[dict, dict]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in groups.items():
                terms = list(n)
                for at in range(0, len(terms), 20_000):
                    part = terms[at : at + 20_000]
                    columns = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([t.decode() for t in part], pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "d"])
            groups.clear()

        for batch in slices(batches, 2):
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = groups.get((lang, source))
                if own is None:
                    own = groups[lang, source] = {}, {}
                n, d = own
                before, seen = len(n), set()
                for words in _words(text):
                    for word in words:
                        n[word] = n.get(word, 0) + 1
                    seen.update(words)
                for word in seen:
                    d[word] = d.get(word, 0) + 1
                size += len(n) - before
                if size > ENTRIES_HELD:
                    yield from out()
                    size = 0
        yield from out()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, d long")


def packed(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Count vectors and vocabulary of the terms of ``least`` documents or more of their language, by chunk, at rest.

    A row with a source has numbers (16 bits, in the order of terms) and counts (64) of its terms in chunk
    (lang, h, sub), perhaps not all; a row without has terms, joined by NUL, and the language's counts. ``terms``
    is how many, ``total`` the sum.
    """
    spark = counts.sparkSession
    tasks = shuffle_parts(spark)
    slice_of = F.pmod(F.xxhash64("term"), F.lit(4 * tasks)).cast("int")
    summed = counts.withColumn("h", slice_of).repartition(tasks, "lang", "h").groupBy("lang", "h", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "h", "term")
    kept = summed.withColumns({"docs": F.sum("d").over(of_term), "all": F.sum("n").over(of_term)}).filter(F.col("docs") >= least)
    numbered = kept.select("lang", "h", (F.dense_rank().over(Window.partitionBy("lang", "h").orderBy("term")) - 1).cast("long").alias("k"), "term", "source", "n", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size, told = None, 0, -1

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal told
            rows = pa.Table.from_batches(held).combine_chunks()
            lang, h, sub = key
            k, n = rows["k"].to_numpy(), rows["n"].to_numpy()
            first = np.flatnonzero(np.diff(k, prepend=told) > 0)
            made = []
            if len(first):
                told = int(k[first[-1]])
                all_n = rows["all"].to_numpy()[first]
                made.append((None, k[first], all_n, "\0".join(rows["term"].take(pa.array(first)).to_pylist())))
            names = rows["source"].combine_chunks().dictionary_encode()
            names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
            codes = names.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = order[start:end]
                made.append((names.dictionary[int(codes[at[0]])].as_py(), k[at], n[at], None))
            columns = [
                pa.array([lang] * len(made), pa.string()), pa.array([h] * len(made), pa.int32()), pa.array([sub] * len(made), pa.int32()), pa.array([m[0] for m in made], pa.string()),
                pa.array([(m[1] % CHUNK).astype("<u2").tobytes() for m in made], pa.binary()), pa.array([m[2].astype("<i8").tobytes() for m in made], pa.binary()), pa.array([m[3] for m in made], pa.string()),
                pa.array([len(m[1]) for m in made], pa.int64()), pa.array([int(m[2].sum()) for m in made], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "h", "sub", "source", "numbers", "counts", "words", "terms", "total"])

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, chunks = batch.column("lang"), batch.column("k").to_numpy() // CHUNK
            codes = np.stack([langs.dictionary_encode().indices.to_numpy(), batch.column("h").to_numpy(), chunks])
            heads = np.append(np.flatnonzero(np.any(np.diff(codes, axis=1, prepend=-1) != 0, axis=0)), batch.num_rows)
            for start, end in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                own = (langs[start].as_py(), int(codes[1, start]), int(codes[2, start]))
                if own != key or size > ROWS_HELD:
                    if held:
                        yield from out()
                    if key is None or own[:2] != key[:2]:
                        told = -1
                    held, key, size = [], own, 0
                held.append(batch.slice(start, end - start))
                size += end - start
        if held:
            yield from out()

    return checkpointed(numbered.mapInArrow(run, "lang string, h int, sub int, source string, numbers binary, counts binary, words string, terms long, total long"))


def probability(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole) for each count."""
    rest = count.astype(np.int64) + 2
    if not len(rest) or int(rest.max()) < (1 << 63) // SCALE:
        return 1 + rest * SCALE // whole
    out = np.zeros_like(rest)
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)): below 2^63, as p and q are at most SCALE + 1."""
    apart = p - q
    return apart * apart // (p + q)


def _groups(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, block, blocks, n, v, lang_n): every group, its block and its language's number of blocks, and the sums its probabilities need."""
    found = docs.select("lang", "source").distinct()
    sizes = vectors.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("total").alias("n"))
    of_lang = vectors.filter("source IS NULL").groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("total").alias("lang_n"))
    blocks = found.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = found.join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").join(blocks, "lang")
    zero = F.lit(0).cast("long")
    return checkpointed(rows.select("lang", "source", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), "blocks", *(F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n"))))


def _longs(column: pa.Array, n: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(column[n].as_buffer(), dtype=kind)


def _ranges() -> Column:
    """How many parts a language's vocabulary is dealt to."""
    return F.greatest(F.lit(1), F.ceil(F.col("v") / RANGE)).cast("int")


def top_terms(vectors: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value): of each group and part of the vocabulary the ``top`` terms that it has beyond its language, and so all that can be among its first."""
    placed = groups.withColumn("ranges", _ranges())
    by_lang = placed.select("lang", "blocks", "ranges").distinct()
    own = vectors.filter("source IS NOT NULL").join(hinted(placed), ["lang", "source"]).select("lang", "block", F.pmod("h", "ranges").alias("part"), "h", "sub", "source", "numbers", "counts", "words", "n", "v", "lang_n")
    none = [F.lit(0).cast("long").alias(c) for c in ("n", "v", "lang_n")]
    words = vectors.filter("source IS NULL").join(by_lang, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("h", "ranges").alias("part"), "h", "sub", "source", "numbers", "counts", "words", *none)
    stream = words.unionByName(own).repartition(shuffle_parts(vectors.sparkSession), "lang", "block", "part").sortWithinPartitions("lang", "block", "part", "h", "sub", F.col("source").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, names, all_n = None, None, [""] * CHUNK, np.zeros(CHUNK, dtype=np.int64)
        best: dict[str, list[tuple[int, bytes, str]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(key[0], source, name, -f) for source, found in best.items() for f, _, name in sorted(found)[:top]]
            made = list(zip(*rows, strict=True)) or [[]] * 4
            best.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in made[:3]), pa.array(made[3], pa.int64())], names=["lang", "source", "item", "value"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "block", "part", "h", "sub", "source", "words", "n", "v", "lang_n")]
            for i, (lang, block, part, h, sub, source, listed, n, v, lang_n) in enumerate(zip(*columns, strict=True)):
                if (lang, block, part) != key:
                    yield out()
                    key, chunk = (lang, block, part), None
                if (h, sub) != chunk:
                    chunk = h, sub
                    all_n[:] = 0
                numbers, counts = _longs(batch.column("numbers"), i, "<u2"), _longs(batch.column("counts"), i)
                if source is None:
                    all_n[numbers] = counts
                    for k, word in zip(numbers.tolist(), listed.split("\0"), strict=True):
                        names[k] = word
                    continue
                p, q = probability(counts, n + 2 * v), probability(all_n[numbers], lang_n + 2 * v)
                more = np.flatnonzero((p > q) & (counts > 0))
                value, numbers = divergence(p[more], q[more]), numbers[more].astype(np.int64)
                first = np.lexsort((numbers, -value))[:top]  # numbers are in the order of terms
                held = best.setdefault(source, [])
                held += [(-f, names[k].encode(), names[k]) for k, f in zip(numbers[first].tolist(), value[first].tolist(), strict=True)]
                if len(held) > 20 * top:
                    held[:] = sorted(held)[:top]
        yield out()

    return stream.mapInArrow(run, "lang string, source string, item string, value long")


def pair_sums(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergence of every two sources a < b of a language, summed over its kept terms."""
    spark = vectors.sparkSession
    tasks = shuffle_parts(spark)
    placed = groups.withColumn("ranges", _ranges())
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tile = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    none = F.lit(None).cast("binary")
    here = placed.select("*", others).select("*", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("part")).select("lang", *tile, "part", F.lit(-1).alias("h"), F.lit(0).alias("sub"), "source", "block", none.alias("numbers"), none.alias("counts"), "n", "v")
    own = vectors.filter("source IS NOT NULL").select("lang", "source", "h", "sub", "numbers", "counts").join(hinted(placed), ["lang", "source"])
    sent = own.select("*", others).select("lang", *tile, F.pmod("h", "ranges").alias("part"), "h", "sub", "source", "block", "numbers", "counts", "n", "v")
    stream = here.unionByName(sent).repartition(tasks, "lang", "i", "j", "part").sortWithinPartitions("lang", "i", "j", "part", "h", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "i", "j", "part", "h", "sub", "source", "block", "n", "v")]
            for r, (lang, i, j, part, h, sub, source, block, n, v) in enumerate(zip(*columns, strict=True)):
                if tile is None or tile.key != (lang, i, j, part):
                    if tile:
                        yield from tile.out()
                    tile = _Tile(lang, i, j, part)
                if h < 0:
                    tile.group(source, block, n, v)
                else:
                    tile.vector((h, sub), source, _longs(batch.column("numbers"), r, "<u2"), _longs(batch.column("counts"), r))
        if tile:
            yield from tile.out()

    found = stream.mapInArrow(run, "lang string, a string, b string, value long, seen long, unseen long, v long")
    # Terms that neither group has are alike: each adds ``unseen``.
    summed = found.groupBy("lang", "a", "b").agg((F.sum("value") + F.max("unseen") * (F.max("v") - F.sum("seen"))).alias("value"))
    return summed


class _Tile:
    """The submatrix of two blocks of groups, over some chunks of the vocabulary."""

    def __init__(self, *key):
        self.key = key
        self.names: tuple[list[str], list[str]] = [], []
        self.whole: tuple[list[int], list[int]] = [], []
        self.place: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.v = self.seen = 0
        self.chunk: tuple | None = None
        self.held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.sums: np.ndarray | None = None

    def group(self, source: str, block: int, n: int, v: int) -> None:
        _, i, j, _ = self.key
        self.v = v
        for side in {0} if i == j else {0 if block == i else 1}:
            self.place[side][source] = len(self.names[side])
            self.names[side].append(source)
            self.whole[side].append(n + 2 * v)

    def vector(self, chunk: tuple, source: str, numbers: np.ndarray, counts: np.ndarray) -> None:
        if chunk != self.chunk:
            self.add()
            self.chunk = chunk
        for side in (0, 1):
            if source in self.place[side]:
                self.held.append((side, self.place[side][source], numbers, counts))

    def _right(self) -> int:
        """Which side the columns are: a tile of one block with itself has one side alone."""
        return 0 if self.key[1] == self.key[2] else 1

    def add(self) -> None:
        if self.sums is None:
            self.sums = np.zeros((len(self.names[0]), len(self.names[self._right()])), dtype=np.int64)
        if not self.held:
            return
        terms = np.unique(np.concatenate([x[2] for x in self.held]))
        counts = [np.zeros((len(names), len(terms)), dtype=np.int64) for names in self.names]
        for side, row, numbers, own in self.held:
            counts[side][row, np.searchsorted(terms, numbers)] += own
        p = [np.stack([probability(c, w) for c, w in zip(counts[s], self.whole[s], strict=True)]) if self.whole[s] else counts[s] for s in (0, 1)]
        for row in range(len(self.names[0])):
            start = row + 1 if self._right() == 0 else 0
            self.sums[row, start:] += divergence(p[0][row], p[self._right()][start:]).sum(axis=1)
        self.seen += len(terms)
        self.held = []

    def out(self) -> Iterator[pa.RecordBatch]:
        self.add()
        lang, right = self.key[0], self._right()
        zero = [np.array([probability(np.zeros(1), w)[0] if w else 1 for w in side]) for side in self.whole]
        for row, name in enumerate(self.names[0]):
            start = row + 1 if right == 0 else 0
            others = self.names[right][start:]
            if not others:
                continue
            ordered = [(name, x) if name.encode() < x.encode() else (x, name) for x in others]
            m = len(others)
            columns = [pa.array([lang] * m, pa.string()), *(pa.array([o[k] for o in ordered], pa.string()) for k in (0, 1)), pa.array(self.sums[row, start:]), pa.array([self.seen] * m, pa.int64()), pa.array(divergence(zero[0][row], zero[right][start:])), pa.array([self.v] * m, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value", "seen", "unseen", "v"])


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """How far the sources of a language diverge, in pairs (part ``pair``), and by which terms (part ``term``).

    Nulls in text, lang and source read as empty; a group without terms is compared like any other; a language
    without kept terms has pairs of value 0; repeated rows are as many documents; other columns are not read;
    an empty table gives an empty result. Ties are ranked by the item's UTF-8.
    """
    rows = docs.select(body("lang").alias("lang"), body("source").alias("source"), body().alias("text"))
    vectors = packed(term_counts(rows), least)
    groups = _groups(rows, vectors)
    pairs = pair_sums(vectors, groups)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    paired = pairs.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", rank)
    termed = top_terms(vectors, groups, top).select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", rank).filter(F.col("rank") <= top)
    return paired.unionByName(termed)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS big_n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.big_n + 2 * v.v)::HUGEINT AS p
  FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (
  SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 2)) // (sum(x.n) OVER (PARTITION BY x.lang) + 2 * v.v)::HUGEINT AS q
  FROM (SELECT kept.lang, kept.term, coalesce(sum(c.n), 0) AS n FROM kept LEFT JOIN c USING (lang, term) GROUP BY ALL) x
  JOIN v ON v.lang = x.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
