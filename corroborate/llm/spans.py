"""Byte spans of documents: a key for each text, and cutting spans out of the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import body, slices

NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (the same, null as the least long), th (24 bits of a hash of the text) and text (null as empty).

    (doc, th) names a text: rows that repeat a doc_id with another text differ in th;
    fully repeated rows share the key and everything that is found for it.
    """
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.pmod(F.xxhash64(body()), F.lit(1 << 24)).alias("th"), body().alias("text")
    )


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans as maximal runs; those that touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def gathered(spans: DataFrame) -> DataFrame:
    """One row per text of ``spans`` (doc, th, start, end: longs below 2^31) with all its spans, packed as start * 2^31 + end."""
    packed = F.shiftleft(F.col("start"), 31).bitwiseOR(F.col("end"))
    return spans.select("doc", "th", packed.alias("p")).groupBy("doc", "th").agg(F.collect_list("p").alias("spans"))


def cut(texts: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """Every row of ``texts`` (as keyed) with what is left once the runs of ``spans`` of ``least`` bytes or more are cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, removed, runs, shas, places = [], [], [], [], []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8")
                found = [r for r in merged([(p >> 31, p & 0x7FFFFFFF) for p in packed or ()]) if r[1] - r[0] >= least]
                sha, at = hashlib.sha256(), 0
                for start, end in found:
                    sha.update(data[at:start])
                    at = end
                sha.update(data[at:])
                n.append(len(data))
                removed.append(sum(end - start for start, end in found))
                runs.append(len(found))
                shas.append(sha.hexdigest())
                places.append(",".join(f"{start}:{end}" for start, end in found))
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas), pa.array(places)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    both = texts.join(gathered(spans), ["doc", "th"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string")


def _batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Tuples of longs as batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)


def on_tuples(run, names: str):
    """``run``, which yields tuples of longs, as a function from batches to batches."""
    names = names.split()

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(run(batches), names)

    return batched
