"""What a source tree uses or declares and an inventory lacks. Trees are tables of files (project, path, text)."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Imports (at the start of a line, the first of a list), names in manifests, folders that hold no source of a
#: project, endings of C and C++ sources, and files at the top that declare what a project needs.
IMPORT = r"^[ \t]*(?:from|import)[ \t]+([a-zA-Z_][\w.]*)"
REQUIREMENT = r"^\s*([A-Za-z0-9_.-]+)"
EXCLUDED = ("__pycache__", "venv", ".venv", "env", ".env", "node_modules", "build", "dist", ".tox", ".eggs", "site-packages")
C_ENDINGS = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".ino")
DECLARATIONS = ("requirements.txt", "requirements.in", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "Pipfile.lock", "poetry.lock")
C_DECLARATIONS = ("platformio.ini", "library.json", "library.properties", "conanfile.txt", "CONANFILE.txt", "vcpkg.json")


def _parents() -> Column:
    parts = F.split("path", "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_source() -> Column:
    """Whether no folder above the file is excluded or begins with a dot."""
    return ~F.exists(_parents(), lambda p: p.isin(*EXCLUDED) | p.startswith("."))


def _ends(endings: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for ending in endings:
        found = found | F.col("path").endswith(ending)
    return found


def _name() -> Column:
    return F.substring_index("path", "/", -1)


def import_gaps(files: DataFrame, components: DataFrame, stdlib: frozenset[str] = sys.stdlib_module_names) -> DataFrame:
    """(project, module, missing): imported modules that are neither of the library nor local; missing if no component (project, name) has the name."""
    sources = files.filter(_ends((".py",)) & is_source())
    # Java: only \n ends a line, and \w is any alphabet's.
    found = sources.select("project", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?mdU)" + IMPORT), F.lit(1)))).alias("m"))
    found = found.select("project", F.substring_index("m", ".", 1).alias("module")).filter(~F.col("module").isin(*sorted(stdlib))).distinct()
    local = sources.select("project", F.explode(F.concat(F.array(F.regexp_replace(_name(), r"\.py$", "")), _parents())).alias("module")).distinct()
    named = components.select("project", F.lower("name").alias("low"), F.lit(False).alias("lacks")).distinct()
    third = found.join(local, ["project", "module"], "left_anti").withColumn("low", F.lower("module"))
    return third.join(named, ["project", "low"], "left").select("project", "module", F.coalesce("lacks", F.lit(True)).alias("missing"))


def requirement_references(files: DataFrame) -> DataFrame:
    """(project, referenced): files that requirements files (by name, or in a folder ``requirements``) include with -r or --requirement."""
    lists = files.filter(_ends((".txt",)) & is_source() & (_name().startswith("requirements") | (F.try_element_at(_parents(), F.lit(-1)) == "requirements")))
    lines = lists.select("project", F.explode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line"))
    words = lines.select("project", F.split(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""), r"(?U)\s+").alias("t"))
    return words.filter((F.size("t") >= 2) & F.col("t")[0].isin("-r", "--requirement")).select("project", F.col("t")[1].alias("referenced")).distinct()


def requirement_gaps(files: DataFrame, components: DataFrame) -> DataFrame:
    """(project, name): names that the first manifest.json with a domain requires and no component has, whatever the case."""
    manifests = files.filter((_name() == "manifest.json") & is_source() & F.coalesce(F.array_contains(F.json_object_keys("text"), "domain"), F.lit(False)))
    first = manifests.groupBy("project").agg(F.min_by(F.get_json_object("text", "$.requirements"), "path").alias("r"))
    listed = F.from_json("r", "array<variant>")
    texts = F.transform(F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    names = first.select("project", F.explode(texts).alias("r")).select("project", F.regexp_extract("r", REQUIREMENT, 1).alias("name")).filter("name <> ''").distinct()
    named = components.select("project", F.lower("name").alias("low")).distinct()
    return names.withColumn("low", F.lower("name")).join(named, ["project", "low"], "left_anti").select("project", "name")


def zero_components(files: DataFrame, components: DataFrame) -> DataFrame:
    """(project, component_count, and for Python and C whether there are sources, a declaration at the top, and neither declaration nor component for the sources)."""
    kinds = {"python": ((".py",), DECLARATIONS), "c": (C_ENDINGS, C_DECLARATIONS)}
    seen = files.groupBy("project").agg(
        *(F.bool_or(_ends(endings) & is_source()).alias(f"{k}_sources") for k, (endings, _) in kinds.items()), *(F.bool_or(F.col("path").isin(*declared)).alias(f"{k}_declared") for k, (_, declared) in kinds.items())
    )
    counted = components.groupBy("project").agg(F.count(F.lit(1)).alias("component_count"))
    rows = seen.join(counted, "project", "left").withColumn("component_count", F.coalesce("component_count", F.lit(0)))
    for k in kinds:
        rows = rows.withColumn(f"zero_{k}", (F.col("component_count") == 0) & F.col(f"{k}_sources") & ~F.col(f"{k}_declared"))
    return rows
