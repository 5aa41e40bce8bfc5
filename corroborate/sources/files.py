"""Files as tables: strict JSON, text lists, archives and spreadsheets, read on executors from binaryFile rows."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one archive: members and bytes.
MEMBERS, BYTES = 100_000, 1 << 30
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, content) of each file below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def strict_json(files: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """(path, sha256, data) of JSON objects with just these keys; a repeated key or text that is no JSON raises an error."""
    raw = F.decode("content", "UTF-8")
    fine = F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, sorted(keys)))
    checked = F.when(F.to_json(F.parse_json(raw)).isNotNull() & F.coalesce(fine, F.lit(False)), raw).otherwise(F.raise_error(F.concat(F.lit("keys of "), "path")))
    return files.select("path", "sha256", F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("data"))


def package_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, architecture, version) of lines with three words; blank lines are skipped, others raise an error."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).filter("w[0] <> ''")
    fine = F.when(F.size("w") == 3, F.col("w")).otherwise(F.raise_error(F.lit("a package line needs three words")))
    return words.select(fine.alias("w")).select(F.col("w")[0].alias("name"), F.col("w")[1].alias("architecture"), F.col("w")[2].alias("version"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an INI file's ``key = value`` lines."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*([#;\[]|$)"))
    return lines.select(F.trim(F.regexp_extract("value", r"^([^=]*)=(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^([^=]*)=(.*)$", 2)).alias("value"))


def tar_members(files: DataFrame) -> DataFrame:
    """(archive, path, kind, size, sha256, target) of each member of tar archives (path, content); unsafe names or sizes raise an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                rows, total, seen = [], 0, set()
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        name = m.name.removeprefix("./")
                        total += m.size
                        if not name or name in (".",):
                            continue
                        if name.startswith("/") or ".." in name.split("/") or name in seen or len(seen) >= MEMBERS or total > BYTES:
                            raise ValueError(f"member {m.name!r} of {archive}")
                        seen.add(name)
                        kind = "file" if m.isreg() else "symlink" if m.issym() else "directory" if m.isdir() else "other"
                        digest = hashlib.sha256(tar.extractfile(m).read()).hexdigest() if kind == "file" else None
                        rows.append((archive, name, kind, m.size, digest, m.linkname if kind == "symlink" else None))
                yield pd.DataFrame(rows, columns=["archive", "path", "kind", "size", "sha256", "target"])

    return files.select("path", "content").mapInPandas(run, "archive string, path string, kind string, size long, sha256 string, target string")


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(files: DataFrame) -> DataFrame:
    """(workbook, sheet, row, cells: array of strings by column) of each row with a value in XLSX workbooks (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for workbook, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if sum(i.file_size for i in z.infolist()) > BYTES:
                        raise ValueError(f"size of {workbook}")
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(_SHEET + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
                    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
                        for row in ElementTree.fromstring(z.read(name)).iter(_SHEET + "row"):
                            cells: dict[int, str] = {}
                            for c in row.iter(_SHEET + "c"):
                                value = c.findtext(_SHEET + "v")
                                text = "".join(t.text or "" for t in c.iter(_SHEET + "t")) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value else value
                                if text:
                                    cells[_number(re.match("[A-Z]+", c.get("r"))[0])] = text
                            if cells:
                                rows.append((workbook, name.rsplit("/", 1)[1][:-4], int(row.get("r")), [cells.get(i, "") for i in range(max(cells) + 1)]))
                yield pd.DataFrame(rows, columns=["workbook", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "workbook string, sheet string, row int, cells array<string>")


def header_maps(rows: DataFrame, header_row: int = 1) -> DataFrame:
    """(workbook, sheet, row, fields: map from header to cell): rows below the header, short ones filled up."""
    headers = rows.filter(F.col("row") == header_row).select("workbook", "sheet", F.col("cells").alias("headers"))
    both = rows.filter(F.col("row") > header_row).join(headers, ["workbook", "sheet"])
    filled = F.transform("headers", lambda _, i: F.coalesce(F.get("cells", i), F.lit("")))
    return both.select("workbook", "sheet", "row", F.map_from_arrays("headers", filled).alias("fields"))
