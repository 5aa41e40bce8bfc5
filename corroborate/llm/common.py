"""Small helpers shared by the text operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.storage import checkpointed  # noqa: F401

#: ASCII white space as the contracts name it: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
#: Rows of a few longs that are broadcast at most (some 16 MB).
BROADCAST_ROWS = 500_000


def shuffle_parts(spark: SparkSession, rows: int = 0, per_part: int = 1) -> int:
    """Partitions for a shuffle: the session's number, or more if a part would exceed ``per_part``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` has not, whatever the case."""
    have = {c.lower() for c in rows.columns}
    name = f"__{name}"
    while name in have:
        name += "_"
    return name


def hinted(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (of a few numbers, and at rest: a checkpoint), marked for broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``most`` bytes of text (or one row), so long texts do not pile up in a worker."""
    for batch in batches:
        start = size = 0
        for n, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if n > start and size + (length or 0) > most:
                yield batch.slice(start, n - start)
                start, size = n, 0
            size += length or 0
        yield batch.slice(start)
