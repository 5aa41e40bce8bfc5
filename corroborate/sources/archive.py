"""Tar archives of any size, read as ranges.

Spark reads an archive in pieces of one length, many tasks at once, so no row and no task holds
it. Blocks that look like member headers are found in all pieces; a walk over these alone, from
each header to where its member must end, tells members from data that only looks like them. Then
the members' ranges meet the pieces they lie in, and each member is hashed, and its layer
inflated, as a stream of sorted parts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.storage import checkpointed

#: Bytes of a block, and of a piece: the first of these that divides the archive's length.
BLOCK, PIECES = 512, (1 << 20, 1 << 16, 10_240, 512)
#: Bytes of a name that stands in a member of its own.
LONGEST_NAME = 1 << 16
#: Kinds of members by their type, and types that only name or describe the next member.
KINDS = {"0": "file", "\0": "file", "7": "file", "1": "hardlink", "2": "symlink", "3": "device", "4": "device", "5": "directory", "6": "fifo"}
NAMING = ("L", "K", "x", "g")
_GZIP = b"\x1f\x8b"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(archive, piece, at, size, content) of one archive: its pieces, the place of each, and the length of all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).getLen()
    if not length or length % BLOCK:
        raise ValueError(f"{path}: {length} bytes are no archive")
    size = next(p for p in PIECES if length % p == 0)
    # Records of one length are a Hadoop input format that DataFrame readers lack; it splits a file anywhere.
    rows = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(size)})
    parts = rows.map(lambda kv: (path, kv[0] // size, kv[0], length, kv[1]))
    return spark.createDataFrame(parts, "archive string, piece long, at long, size long, content binary")


def _number(field: bytes) -> int:
    """A header's number: octal digits, or big-endian bytes after a mark."""
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    return int(field.split(b"\0")[0].strip() or b"0", 8)


def _text(field: bytes) -> str:
    return field.split(b"\0")[0].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()


def headers(parts: DataFrame) -> DataFrame:
    """(archive, at, size, length, type, name, link) of blocks with a header's mark and sum; ``size`` is the archive's, ``length`` the member's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, at, size, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "size", "content")), strict=True):
                blocks = np.frombuffer(content, dtype=np.uint8).reshape(-1, BLOCK)
                for k in np.flatnonzero((blocks[:, 257:262] == np.frombuffer(b"ustar", dtype=np.uint8)).all(axis=1)).tolist():
                    raw = blocks[k].tobytes()
                    try:
                        if _number(raw[148:156]) != sum(raw[:148]) + 8 * 32 + sum(raw[156:]):
                            continue
                        length = _number(raw[124:136])
                    except ValueError:
                        continue
                    prefix, name = (_text(raw[345:500]) if raw[257:263] == b"ustar\0" else ""), _text(raw[:100])
                    rows.append((archive, at + k * BLOCK, size, length, chr(raw[156]), f"{prefix}/{name}" if prefix else name, _text(raw[157:257])))
            made = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=["archive", "at", "size", "length", "type", "name", "link"])

    return parts.select("archive", "at", "size", "content").mapInArrow(run, "archive string, at long, size long, length long, type string, name string, link string")


def entries(found: DataFrame) -> DataFrame:
    """(archive, seq, at, length, type, name, link, end) of the members among ``found`` (headers()), in order; one task walks an archive's headers. ``end`` is where the archive must end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, due, seq = None, 0, 0
        for batch in batches:
            rows = []
            for name, at, size, length, kind, member, link in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != archive:
                    archive, due, seq = name, 0, 0
                if at == due:
                    held = 0 if kind in "123456" else length
                    due = at + BLOCK + -(-held // BLOCK) * BLOCK
                    if due > size:
                        raise ValueError(f"{member!r} of {archive} goes beyond its archive")
                    rows.append((archive, seq, at + BLOCK, held, kind, member, link, due))
                    seq += 1
            made = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=["archive", "seq", "at", "length", "type", "name", "link", "end"])

    dealt = found.repartition("archive").sortWithinPartitions("archive", "at")
    return dealt.select("archive", "at", "size", "length", "type", "name", "link").mapInArrow(run, "archive string, seq long, at long, length long, type string, name string, link string, end long")


def _read(own: DataFrame, parts: DataFrame) -> DataFrame:
    """(archive, seq, sha256, observed, inflated, text) of entries with bytes: each one's parts meet in order and are hashed, and inflated where they are a gzip stream.

    ``inflated`` is null for what is none, or breaks off. ``text`` has the bytes of naming entries.
    """
    size = F.octet_length("content")
    first, last = F.floor(F.col("e.at") / F.col("step")), F.floor((F.col("e.at") + F.col("e.length") - 1) / F.col("step"))
    step = parts.groupBy("archive").agg(F.max(size).alias("step"))
    ranged = own.filter("length > 0").select(F.struct("*").alias("e"), "archive").join(step, "archive")
    ranged = ranged.select("archive", "e", F.explode(F.sequence(first, last)).alias("piece"))
    met = ranged.join(parts.select("archive", "piece", F.col("at").alias("from"), "content"), ["archive", "piece"])
    start = F.greatest(F.col("e.at") - F.col("from"), F.lit(0))
    stop = F.least(F.col("e.at") + F.col("e.length") - F.col("from"), size.cast("long"))
    cut = met.select("archive", F.col("e.seq").alias("seq"), "piece", F.col("e.type").isin(*NAMING).alias("naming"), F.substring("content", start.cast("int") + 1, (stop - start).cast("int")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, size, inflate, inflated, text = None, None, 0, None, None, b""

        def done() -> pa.RecordBatch:
            whole = inflated if inflate is None or inflate.eof else None
            columns = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([sha.hexdigest()]), pa.array([size], pa.int64()), pa.array([whole], pa.int64()), pa.array([text.decode("utf-8", "replace") if naming else None], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "seq", "sha256", "observed", "inflated", "text"])

        naming = False
        for batch in batches:
            for archive, seq, is_name, part in zip(*(batch.column(c).to_pylist() for c in ("archive", "seq", "naming", "part")), strict=True):
                if (archive, seq) != key:
                    if key:
                        yield done()
                    key, sha, size, inflate, inflated, text, naming = (archive, seq), hashlib.sha256(), 0, None, None, b"", is_name
                    if part[:2] == _GZIP:
                        inflate, inflated = zlib.decompressobj(31), 0
                sha.update(part)
                size += len(part)
                if naming and len(text) <= LONGEST_NAME:
                    text += part
                if inflate is not None and inflated is not None:
                    try:
                        rest = part
                        while rest and not inflate.eof:
                            inflated += len(inflate.decompress(rest, 1 << 20))
                            rest = inflate.unconsumed_tail
                    except zlib.error:
                        inflated = None
        if key:
            yield done()

    dealt = cut.repartition("archive", "seq").sortWithinPartitions("archive", "seq", "piece")
    return dealt.mapInArrow(run, "archive string, seq long, sha256 string, observed long, inflated long, text string")


def stream_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, seq, path, kind, size, sha256, target, inflated) of each member of some tar archives; ``paths`` are a handful of files of any size.

    Names that stand in members of their own (long names, extended headers) are taken from there. A file's hash is of
    its bytes; inflated is the size of what a gzip member holds. An archive that breaks off, or is followed by anything but
    empty blocks, raises an error.
    """
    parts = None
    for path in paths:
        parts = pieces(spark, path) if parts is None else parts.unionByName(pieces(spark, path))
    own = checkpointed(entries(headers(parts)))
    _check_ends(own, parts)
    read = own.join(_read(own, parts), ["archive", "seq"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, long_name, long_link = None, None, None
        for batch in batches:
            rows = []
            for own, seq, length, kind, name, link, sha, observed, inflated, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != archive:
                    archive, long_name, long_link = own, None, None
                if kind in NAMING:
                    value = (text or "").rstrip("\0")
                    fields = _extended(value) if kind == "x" else {}
                    long_name = value if kind == "L" else fields.get("path", long_name)
                    long_link = value if kind == "K" else fields.get("linkpath", long_link)
                    continue
                if length and observed != length:
                    raise ValueError(f"{name!r} of {archive} breaks off")
                shown = KINDS.get(kind, "other")
                rows.append((own, seq, long_name or name, shown, length, sha or (hashlib.sha256().hexdigest() if shown == "file" else None), (long_link or link) if shown in ("symlink", "hardlink") else None, inflated))
                long_name = long_link = None
            made = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=["archive", "seq", "path", "kind", "size", "sha256", "target", "inflated"])

    ordered = read.repartition("archive").sortWithinPartitions("archive", "seq").select("archive", "seq", "length", "type", "name", "link", "sha256", "observed", "inflated", "text")
    found = ordered.mapInArrow(run, "archive string, seq long, path string, kind string, size long, sha256 string, target string, inflated long")
    return found.withColumn("path", F.regexp_replace(F.regexp_replace("path", "(?<=.)/+$", ""), "^(\\./)+", ""))


def _extended(text: str) -> dict[str, str]:
    """Fields of an extended header: lines of length, blank, key=value."""
    out, raw = {}, text.encode()
    while raw:
        head, _, _ = raw.partition(b" ")
        if not head.isdigit() or int(head) <= len(head):
            break
        key, _, value = raw[len(head) + 1 : int(head) - 1].partition(b"=")
        out[key.decode()] = value.decode("utf-8", "replace")
        raw = raw[int(head) :]
    return out


def _check_ends(own: DataFrame, parts: DataFrame) -> None:
    """Raise unless each archive has a member and its last one is followed by an empty block, or by nothing."""
    ends = own.groupBy("archive").agg(F.max("end").alias("end"))
    size = F.octet_length("content")
    known = parts.select("archive").distinct().join(ends, "archive", "left")
    after = parts.join(ends, "archive").filter((F.col("at") <= F.col("end")) & (F.col("end") < F.col("at") + size))
    block = F.substring("content", (F.col("end") - F.col("at")).cast("int") + 1, F.lit(BLOCK))
    odd = after.filter(block != F.lit(bytes(BLOCK))).select("archive").union(known.filter("end is null").select("archive"))
    if wrong := [r.archive for r in odd.limit(5).collect()]:
        raise ValueError(f"no whole archives: {wrong}")


def member_violations(members: DataFrame, most_members: int, most_bytes: int, longest_path: int = 4096) -> DataFrame:
    """(archive, path, rule) of members (as stream_members()) that no root file system may have: paths beyond the root or too long, repeated ones, hard links and special files; and archives beyond a budget (path is null)."""
    path = F.col("path")
    unsafe = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)|\\|\x00") | (F.octet_length("path") > longest_path)
    root = path.isin("", ".")
    rules = F.array_compact(F.array(F.when(unsafe, "path"), F.when(root & (F.col("kind") != "directory"), "root"), F.when(~F.col("kind").isin("file", "symlink", "directory"), "kind"), F.when((F.col("kind") == "symlink") & ((F.octet_length("target") > longest_path) | (F.col("target") == "")), "target")))
    each = members.select("archive", "path", F.explode(rules).alias("rule"))
    twice = members.filter(~root).groupBy("archive", "path").count().filter("count > 1").select("archive", "path", F.lit("repeated").alias("rule"))
    totals = members.filter(~root).groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("bytes"))
    over = F.array_compact(F.array(F.when(F.col("n") > most_members, "members"), F.when(F.col("bytes") > most_bytes, "bytes")))
    return each.unionByName(twice).unionByName(totals.select("archive", F.lit(None).cast("string").alias("path"), F.explode(over).alias("rule")))


def layer_sums(members: DataFrame) -> DataFrame:
    """(archive, seq, path, compressed, uncompressed, layer, total): gzip layers of archives in order, the number of each and the running sum of what they hold."""
    running = Window.partitionBy("archive").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    layers = members.filter("kind = 'file' and inflated is not null")
    return layers.select("archive", "seq", "path", F.col("size").alias("compressed"), F.col("inflated").alias("uncompressed"), F.count(F.lit(1)).over(running).alias("layer"), F.sum("inflated").over(running).alias("total"))


def layer_violations(members: DataFrame, most_layers: int, most_compressed: int, most_uncompressed: int) -> DataFrame:
    """(archive, path, rule): the layer at which an archive exceeds its budget of layers or of uncompressed bytes, and each member with more compressed bytes than one may have."""
    sums = layer_sums(members)
    large = members.filter((F.col("kind") == "file") & (F.col("size") > most_compressed)).select("archive", "path", F.lit("compressed").alias("rule"))
    many = sums.filter(F.col("layer") == most_layers + 1).select("archive", "path", F.lit("layers").alias("rule"))
    beyond = sums.filter((F.col("total") > most_uncompressed) & (F.col("total") - F.col("uncompressed") <= most_uncompressed)).select("archive", "path", F.lit("uncompressed").alias("rule"))
    return large.unionByName(many).unionByName(beyond)
