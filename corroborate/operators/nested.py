"""Nested component lists as flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.storage import checkpointed

DEEPEST = 32
#: Types of components.
TYPES = (
    "application", "framework", "library", "container", "platform", "operating-system", "device", "device-driver", "firmware", "file", "machine-learning-model", "data", "cryptographic-asset",
)


#: What a component says of itself.
COMPONENT = "`bom-ref` string, type string, `group` string, name string, version string, purl string, cpe string, hashes array<struct<alg: string, content: string>>"


def components(documents: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(doc, ref, parent, depth, type, group, name, version, purl, cpe, hashes, below) of every component in ``documents`` (doc, raw: JSON text with nested ``components``).

    One step per level that occurs, each checkpointed, so that a level is parsed once and its
    plan does not hold those above it; deeper than ``deepest`` is an error.
    """
    level = documents.select("doc", F.lit(None).cast("string").alias("parent"), F.from_json(F.get_json_object("raw", "$.components"), "array<string>").alias("below"))
    rows, depth = None, 0
    while True:
        items = level.select("doc", "parent", F.explode("below").alias("raw")).select(
            "doc", "parent", F.from_json("raw", COMPONENT).alias("c"), F.from_json(F.get_json_object("raw", "$.components"), "array<string>").alias("below")
        )
        hashes = F.transform("c.hashes", lambda h: F.concat_ws(":", h["alg"], h["content"]))
        items = checkpointed(items.select("doc", F.col("c.bom-ref").alias("ref"), "parent", F.lit(depth).alias("depth"), "c.type", "c.group", "c.name", "c.version", "c.purl", "c.cpe", hashes.alias("hashes"), "below"))
        rows = items if rows is None else rows.union(items)
        level = items.filter(F.size("below") > 0).select("doc", F.col("ref").alias("parent"), "below")
        depth += 1
        if level.isEmpty():
            return rows.drop("below")
        if depth > deepest:
            raise ValueError(f"components nest deeper than {deepest}")


def flatten(documents: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(doc, ref, parent, depth, name) of every component in ``documents``."""
    return components(documents, deepest).select("doc", "ref", "parent", "depth", "name")


def projection_violations(documents: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(doc, ref, rule) of components without ref or name, of no known type, with a package URL or CPE that is none, or whose ref a document repeats."""
    rows = components(documents)
    plain = lambda c, *starts: F.col(c).isNull() | (~F.col(c).rlike(r"\s") & F.greatest(*(F.col(c).startswith(s) for s in (*starts, starts[0]))))
    rules = {"ref": F.col("ref") != "", "name": F.col("name") != "", "type": F.col("type").isin(*types), "purl": plain("purl", "pkg:"), "cpe": plain("cpe", "cpe:2.3:", "cpe:/")}
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    twice = rows.filter("ref is not null").groupBy("doc", "ref").count().filter("count > 1").select("doc", "ref", F.lit("repeated").alias("rule"))
    return rows.select("doc", "ref", F.explode(broken).alias("rule")).union(twice)


def services_and_tools(documents: DataFrame) -> DataFrame:
    """(doc, kind, ref, vendor, group, name, version) of a document's services and of the tools that made it, which are a list, or an object with components and services."""
    service = "array<struct<`bom-ref`: string, `group`: string, name: string, version: string>>"
    tool = "array<struct<vendor: string, name: string, version: string>>"
    none = F.lit(None).cast("string")
    at = lambda path, schema: F.explode(F.from_json(F.get_json_object("raw", path), schema)).alias("s")
    parts = [documents.select("doc", F.lit(kind).alias("kind"), at(path, service)).select("doc", "kind", F.col("s.bom-ref").alias("ref"), none.alias("vendor"), "s.group", "s.name", "s.version")
             for kind, path in (("service", "$.services"), ("tool", "$.metadata.tools.components"), ("tool", "$.metadata.tools.services"))]
    listed = documents.filter(F.get_json_object("raw", "$.metadata.tools").startswith("[")).select("doc", F.lit("tool").alias("kind"), at("$.metadata.tools", tool))
    parts.append(listed.select("doc", "kind", none.alias("ref"), "s.vendor", none.alias("group"), "s.name", "s.version"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
