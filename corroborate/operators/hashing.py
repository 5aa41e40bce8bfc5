"""SHA-256 over sorted lines, read as a stream."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What list_sha256() counts of each document beside its hash: rows by a value, and those of them with a flag.
TALLY = "array<struct<value: string, rows: long, flagged: long>>"


def sorted_sha256(lines: DataFrame, order: list[str]) -> DataFrame:
    """(key, h, tally): hash of ``before``, the lines joined by commas, and ``after``, of each key.

    ``lines``: key (string), line, before and after (the same in all rows of a key), the
    columns of ``order``, and perhaps value and flag, which are counted in tally. A key's lines are sorted by Spark,
    which spills, and hashed as they come, so no row holds them all. SHA-256 is a chain, so one task reads a key: a key is a
    document of bounded size, or a bucket of tree_sha256().
    """
    counted = ["value", "flag"] if "value" in lines.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("h", pa.string()), ("tally", pa.list_(pa.struct([("value", pa.string()), ("rows", pa.int64()), ("flagged", pa.int64())])))])

        def done() -> pa.RecordBatch:
            state.update(end.encode())
            totals = [{"value": v, "rows": sum(n for (w, _), n in tally.items() if w == v), "flagged": tally[v, True]} for v in dict.fromkeys(v for v, _ in tally)]
            return pa.RecordBatch.from_pylist([{"key": key, "h": state.hexdigest(), "tally": totals}], schema=schema)

        key, state, end, tally = None, None, "", Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, (texts, *more) = batch.column(0), (c.to_pylist() for c in (batch.column(i) for i in (1, *range(4, batch.num_columns))))
            starts = [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for i, j in pairwise(starts):
                k = keys[i].as_py()
                if state is not None and k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        yield done()
                    key, state, end, tally = k, hashlib.sha256(batch.column(2)[i].as_py().encode()), batch.column(3)[i].as_py(), Counter()
                state.update(",".join(texts[i:j]).encode())
                tally.update(zip(*(c[i:j] for c in more)))
        if state is not None:
            yield done()

    dealt = lines.repartition("key").sortWithinPartitions("key", *order, "line")
    return dealt.select("key", "line", "before", "after", *counted).mapInArrow(run, f"key string, h string, tally {TALLY}")


def list_sha256(rows: DataFrame, key: str, line: Column, order: list[str], before: Column | None = None, after: Column | None = None, tally: tuple[str, str] | None = None) -> DataFrame:
    """(key, sha256): hash of the JSON list of each document's lines, in ``order``, between ``before`` and ``after``.

    With ``tally``, names of a text and a boolean column, there is a column tally of their counts, from the same reading.
    """
    named = [] if tally is None else [F.col(tally[0]).alias("value"), F.col(tally[1]).alias("flag")]
    kept = rows.select(F.col(key).cast("string").alias("key"), line.alias("line"), (F.lit("[") if before is None else before).alias("before"), (F.lit("]") if after is None else after).alias("after"), *order, *named)
    return sorted_sha256(kept, order).select(F.col("key").cast(rows.schema[key].dataType).alias(key), F.col("h").alias("sha256"), *([] if tally is None else ["tally"]))


def tree_leaves(rows: DataFrame, key: str, line: Column, digits: int = 3) -> DataFrame:
    """(key, bucket, rows, sha256): the leaves of tree_sha256(), one for each bucket of lines by the first digits of their digest."""
    dealt = rows.select(F.col(key).alias("k"), F.sha2(line, 256).alias("line"))
    named = dealt.select(F.concat_ws("\n", "k", F.substring("line", 1, digits)).alias("key"), "line", F.lit("").alias("before"), F.lit("").alias("after"))
    counts = named.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    leaves = counts.join(sorted_sha256(named, []), "key")
    return leaves.select(F.substring_index("key", "\n", 1).cast(rows.schema[key].dataType).alias(key), F.substring_index("key", "\n", -1).alias("bucket"), "rows", F.col("h").alias("sha256"))


def tree_root(leaves: DataFrame, key: str) -> DataFrame:
    """(key, rows, sha256) of leaves: at most 16^digits of a key."""
    listed = F.array_sort(F.collect_list(F.struct("bucket", "sha256")))
    return leaves.groupBy(key).agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.transform(listed, lambda x: x["sha256"]), ","), 256).alias("sha256"))


def tree_sha256(rows: DataFrame, key: str, line: Column, digits: int = 3) -> DataFrame:
    """(key, rows, sha256) for sets of any size: a hash tree over the lines, whatever their order.

    Lines are dealt to 16^``digits`` buckets by their digest; each bucket is hashed sorted, and
    the buckets' hashes once more, so a large set is read by many tasks.
    """
    return tree_root(tree_leaves(rows, key, line, digits), key)
