"""LM scoring (operator 5) by prediction by partial matching.

The model is a trie of byte contexts with counts of the bytes that followed. Spark
counts the longest byte grams; grams that share their last two bytes of context meet
in one part, which holds the branch of the trie above them and gives each gram the
probability of its last byte. A byte that its context never saw is coded by an escape
to the next shorter context, where the bytes of the longer one are excluded; below
the empty context all bytes are alike. Of each distinct byte that a context saw,
half a count goes to its escape.

Texts are scored in chunks of some megabytes. A chunk asks the model only for the
grams and words that stand in it, so the model is never whole in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from corroborate.llm.common import body, checkpointed, shuffle_parts, slices, table

#: Bytes of context. Up to 6 fit a key.
ORDER = 5
#: No UTF-8 text has these bytes: the end of a text, which is coded, too, and what precedes its first byte.
END, PAD = 0xFE, 0xFF
#: What can follow any context: the bytes of UTF-8 below END, and END.
SYMBOLS = 255
#: Text that meets in one task, and is looked at at once.
CHUNK_BYTES, BLOCK_BYTES = 16_000_000, 2_000_000
#: Words a task holds before it hands on their counts.
WORDS_HELD = 300_000
#: Entries of a table that several levels of the trie share.
SMALL_TABLE = 1_000_000
#: Entries of a table from gram codes to gram numbers; beyond it codes are sorted.
TABLE = 16_000_000
#: Keys: grams are below 2^56, words have bit 62, the end of texts is a word of its own.
END_WORD = 1 << 61


def word_key(word: bytes) -> int:
    return xxh3_64_intdigest(word) >> 2 | 1 << 62


def grams(symbols: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of order + 1 bytes, as keys, and the number of the one that ends at each byte from ``order`` on.

    Walks the trie of the block's grams level by level, for all positions at once.
    """
    present = np.flatnonzero(np.bincount(symbols, minlength=256))
    dense = np.zeros(256, dtype=np.int32)
    dense[present] = np.arange(len(present))
    last, width = dense[symbols], len(present)
    ids, keys = last, present.astype(np.int64)
    level = 0
    while level < order:
        steps, size = 1, len(keys) * width
        while level + steps < order and size * width <= SMALL_TABLE:
            steps, size = steps + 1, size * width
        if size <= TABLE:
            code = ids[: len(ids) - steps]
            for n in range(1, steps + 1):
                code = code * np.int32(width) + last[level + n : len(last) - steps + n]
            seen = np.zeros(size, dtype=bool)
            seen[code] = True
            distinct = np.flatnonzero(seen)
            number = np.empty(size, dtype=np.int32)
            number[distinct] = np.arange(len(distinct), dtype=np.int32)
            ids = number[code]
        else:
            distinct, ids = np.unique(ids[:-1].astype(np.int64) * width + last[level + 1 :], return_inverse=True)
            ids = ids.astype(np.int32)
        keys = keys[distinct // width**steps]
        for n in reversed(range(steps)):
            keys = keys << 8 | present[distinct // width**n % width]
        level += steps
    return keys, ids


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about BLOCK_BYTES."""
    start = size = 0
    for n, text in enumerate(texts):
        if n > start and size + len(text) > BLOCK_BYTES:
            yield start, n
            start, size = n, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def coded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of some texts as grams() gives them, and where each text begins among the numbers."""
    pad = bytes([PAD]) * order
    symbols = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), dtype=np.uint8)
    sizes = np.array([len(t) + order + 1 for t in texts])
    keys, ids = grams(symbols, order)
    return keys, ids, np.cumsum(sizes) - sizes


def _lowered(column: pa.Array) -> pa.Array:
    """Texts with A-Z lowered."""
    return pc.ascii_lower(column)


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the number of the one at each place, and where each text's words begin and the last ones end."""
    split = pc.ascii_split_whitespace(texts)
    found, ends = split.flatten(), np.cumsum(np.r_[0, pc.list_value_length(split).to_numpy()])
    real = pc.not_equal(found, "").to_numpy(zero_copy_only=False)  # white space at a text's rim leaves empty ones
    coded = (found if real.all() else found.filter(pa.array(real))).dictionary_encode()
    return _bytes(coded.dictionary), coded.indices.to_numpy(), np.r_[0, np.cumsum(real)][ends]


def _counts(order: int):
    """From (training, text): (key, n) with the number of times each gram and word stands in training texts, 0 included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out(keys, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        def flushed() -> Iterator[pa.RecordBatch]:
            yield out([word_key(w) for w in words], list(words.values()))
            words.clear()

        for batch in slices(batches, 1):  # of 4 MB: larger blocks hand on fewer counts
            if not batch.num_rows:
                continue
            training, texts = batch.column(0).to_pylist(), _bytes(_lowered(batch.column(1)))
            keys, ids, begin = coded(texts, order)
            weight = np.zeros(len(ids), dtype=bool)
            for at, trains, text in zip(begin.tolist(), training, texts, strict=True):
                weight[at : at + len(text) + 1] = trains
            n = np.bincount(ids[weight], minlength=len(keys))
            ours = keys & 0xFF != PAD
            yield out(keys[ours], n[ours])
            for trains, text in zip(training, texts, strict=True):
                if trains:
                    words.update(text.split())
                else:
                    for word in text.split():
                        words.setdefault(word, 0)
            yield out([END_WORD], [sum(training)])
            if len(words) > WORDS_HELD:
                yield from flushed()
        yield from flushed()

    return run


def _asked(order: int):
    """The distinct keys of one chunk of (chunk, doc_id, held_out, text)."""

    def run(chunk: tuple, texts: pa.Table) -> pa.Table:
        lowered = _lowered(texts["text"].combine_chunks())
        data = _bytes(lowered)
        found = [keys[keys & 0xFF != PAD] for keys, _, _ in (coded(data[start:end], order) for start, end in blocks(data))]
        words = [END_WORD, *map(word_key, words_of(lowered)[0])]
        keys = np.concatenate([np.unique(np.concatenate(found)), np.unique(np.array(words, dtype=np.int64))])
        return pa.table({"chunk": pa.array(np.full(len(keys), chunk[0].as_py()), pa.int32()), "key": pa.array(keys)})

    return run


def _scored(order: int, total: int, distinct: int):
    """Scores of one chunk's texts, with the chunk's part of the model (key, value: log10 of a gram's probability, or a word's count)."""

    def run(chunk: tuple, texts: pa.Table, model: pa.Table) -> pa.Table:
        lowered, n_texts = _lowered(texts["text"].combine_chunks()), texts.num_rows
        data = _bytes(lowered)
        keys, values = model["key"].to_numpy(), model["value"].to_numpy()
        by_key = np.argsort(keys)
        keys, values = keys[by_key], values[by_key]
        scores = np.zeros(n_texts)
        for start, end in blocks(data):
            own, ids, begin = coded(data[start:end], order)
            value = np.where(own & 0xFF == PAD, 0.0, values[np.minimum(np.searchsorted(keys, own), len(keys) - 1)])
            scores[start:end] = np.add.reduceat(value[ids], begin)
        words, at, begin = words_of(lowered)
        counts = values[np.searchsorted(keys, np.array([*map(word_key, words), END_WORD], dtype=np.int64))]
        logs = np.log10((counts + 1) / (total + distinct + 1))
        known, each = np.r_[0, np.cumsum(counts[:-1][at] > 0)], logs[:-1][at]
        bounds, end = begin.tolist(), float(logs[-1])
        n_tokens, n_known = np.diff(begin) + 1, np.diff(known[begin]) + int(counts[-1] > 0)
        base = [math.fsum([*each[a:b].tolist(), end]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table(
            {
                "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([total] * n_texts, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores),
            }
        )

    return run


def _grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, number = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(number, weights=n, minlength=len(distinct)).astype(np.int64)


def _found(keys: np.ndarray, table: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
    """``values`` of the sorted ``table`` at ``keys``."""
    if not len(table):
        return np.full(len(keys), missing, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def _log10(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(a, 1) / np.maximum(b, 1))


def _logs(order: int, pairs: np.ndarray):
    """From (key, n), all grams of some two last bytes of context together: (key, value).

    ``pairs``: counts of the last context byte with what follows, 256 x 256; contexts of one
    byte and of none are looked up in it.
    """
    singles = pairs.sum(axis=0)
    n0, d0 = int(singles.sum()), int((singles > 0).sum())
    n1, d1 = pairs.sum(axis=1), (pairs > 0).sum(axis=1)
    left_n1, left_d1 = n0 - ((pairs > 0) * singles).sum(axis=1), d0 - d1  # of the empty context, less what one byte of context saw

    def values(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        trained = n > 0
        last, byte = keys >> 8 & 0xFF, keys & 0xFF
        value = np.full(len(keys), -math.log10(max(1, SYMBOLS - d0)))  # below the empty context

        def stepped(c, total, distinct, entered):
            """One level: the byte is coded, or an escape and what is below; levels not entered change nothing."""
            coded = _log10(2 * c - 1, 2 * total)
            escaped = np.where(distinct > 0, _log10(distinct, 2 * total), 0.0) + value
            return np.where(entered & (total > 0), np.where(c > 0, coded, escaped), value)

        levels = [(singles[byte], np.full(len(keys), n0), np.full(len(keys), d0)), (pairs[last, byte], n1[last], d1[last])]
        left = [(left_n1[last], left_d1[last])]
        below_g, below_c, below_n, below_d = None, None, None, None
        for k in range(2, order + 1):
            g, c = _grouped(keys[trained] & ((1 << 8 * (k + 1)) - 1), n[trained])
            y, total = _grouped(g >> 8, c)
            distinct = np.bincount(np.searchsorted(y, g >> 8), minlength=len(y))
            short = g & ((1 << 8 * k) - 1)
            saw = pairs[short >> 8 & 0xFF, short & 0xFF] if k == 2 else _found(short, below_g, below_c, 0)
            saw = np.bincount(np.searchsorted(y, g >> 8), weights=saw, minlength=len(y)).astype(np.int64)
            z = y & ((1 << 8 * (k - 1)) - 1)
            shorter_n, shorter_d = (n1[z], d1[z]) if k == 2 else (_found(z, below_y, below_n, 0), _found(z, below_y, below_d, 0))
            own_y = keys >> 8 & ((1 << 8 * k) - 1)
            levels.append((_found(keys & ((1 << 8 * (k + 1)) - 1), g, c, 0), _found(own_y, y, total, 0), _found(own_y, y, distinct, 0)))
            left.append((_found(own_y, y, shorter_n - saw, 0), _found(own_y, y, shorter_d - distinct, 0)))
            below_g, below_c, below_y, below_n, below_d = g, c, y, total, distinct
        deepest = sum((total > 0).astype(int) for _, total, _ in levels) - 1  # contexts that were seen are a suffix chain
        for k in range(order + 1):
            c, total, distinct = levels[k]
            fresh = deepest == k
            if k < order:
                total, distinct = np.where(fresh, total, left[k][0]), np.where(fresh, distinct, left[k][1])
            value = stepped(c, total, distinct, deepest >= k)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            keys = rows["key"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values(keys, rows["n"].to_numpy()))], names=["key", "value"])

    return run


def gram_logs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 of the probability of each gram's last byte after the bytes before it, for all grams of ``counts`` (key, n).

    Grams meet by their last two context bytes: contexts of two bytes or more are then
    whole in one part. Counts of the 65,536 byte pairs, which shorter contexts need, go to every task.
    """
    pairs = np.zeros((256, 256), dtype=np.int64)
    for row in counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("p")).agg(F.sum("n").alias("n")).collect():
        pairs[row["p"] >> 8, row["p"] & 0xFF] = row["n"]
    parts = shuffle_parts(counts.sparkSession)
    met = counts.repartition(parts, F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    return met.select("key", "n").mapInArrow(_logs(order, pairs), "key long, value double")


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with log10 probabilities of its text, A-Z lowered.

    Rows where ``held_out`` is false train the model and the base; all are scored with both.
    The base adds one to each word's count. A null text is empty: it is one end of text.
    Without training rows every symbol is alike. Rows may repeat; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), body().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + order + 1), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / CHUNK_BYTES))
    counts = rows.select((~F.col("held_out")).alias("training"), "text").mapInArrow(_counts(order), "key long, n long")
    counts = checkpointed(counts.groupBy("key").agg(F.sum("n").alias("n")))
    is_word = F.col("key") >= END_WORD
    total, distinct = counts.filter(is_word & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = gram_logs(counts.filter(~is_word), order).union(counts.filter(is_word).select("key", F.col("n").cast("double").alias("value")))

    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    chunks = rows.select(chunk.alias("chunk"), "doc_id", "held_out", "text").repartition(parts, "chunk")
    asked = chunks.groupBy("chunk").applyInArrow(_asked(order), "chunk int, key long")
    answers = asked.join(model, "key").select("chunk", "key", "value")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(order, total, distinct), schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score_texts(table(spark, sf_dir, "documents"), F.pmod(fold, F.lit(7)) == 2)
