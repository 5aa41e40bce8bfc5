"""An image's description (SPDX 3 elements, one JSON text a row) as packages, files and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import UNKNOWN, canonical_json
from corroborate.operators.hashing import list_sha256
from corroborate.operators.relations import file_states, package_states

_ELEMENT = """type string, spdxId string, name string, software_primaryPurpose string, software_packageVersion string, software_packageUrl string, suppliedBy string, scope string,
    externalIdentifier array<struct<identifier: string>>, verifiedUsing array<struct<algorithm: string, hashValue: string>>, `from` string, relationshipType string, to array<string>"""


def elements(graph: DataFrame) -> DataFrame:
    """The elements of ``graph`` (raw) with the fields that matter."""
    return graph.select(F.from_json("raw", _ELEMENT).alias("e")).select("e.*")


def _edges(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.filter(F.col("type").isin("Relationship", "LifecycleScopedRelationship") & F.col("relationshipType").isin(*kinds)).select(F.col("from").alias("src"), "scope", F.explode("to").alias("dst"))


def packages(found: DataFrame) -> DataFrame:
    """(source_id, name, version, producer, identifiers) of installed packages; the producer is the supplier's name where an agent has it."""
    agents = found.filter(F.col("type").isin("Organization", "Person")).select(F.col("spdxId").alias("suppliedBy"), F.nullif("name", F.lit("")).alias("producer"))
    installed = found.filter("type = 'software_Package' and software_primaryPurpose = 'install'")
    listed = F.array_compact(F.concat(F.array(F.nullif("software_packageUrl", F.lit(""))), F.coalesce(F.transform("externalIdentifier", lambda x: F.nullif(x["identifier"], F.lit(""))), F.array().cast("array<string>"))))
    return installed.join(agents, "suppliedBy", "left").select(
        F.col("spdxId").alias("source_id"), "name", F.coalesce("software_packageVersion", F.lit(UNKNOWN)).alias("version"), F.coalesce("producer", F.lit(UNKNOWN)).alias("producer"), F.array_sort(F.array_distinct(listed)).alias("identifiers")
    )


def expected_files(found: DataFrame, image: str) -> DataFrame:
    """(path, sha256, owners) of the files that the image's archive contains; two hashes of one path are an error."""
    roots = found.filter((F.col("type") == "software_Package") & (F.col("software_primaryPurpose") == "archive") & (F.col("name") == image)).select(F.col("spdxId").alias("src"))
    held = _edges(found, ("contains", "hasPart"))
    files = found.filter("type = 'software_File'").select(
        F.col("spdxId").alias("dst"), F.regexp_replace("name", r"^\.?/+", "").alias("path"), F.get(F.filter("verifiedUsing", lambda h: h["algorithm"] == "sha256"), 0)["hashValue"].alias("sha")
    )
    owners = held.join(packages(found).select(F.col("source_id").alias("src")), "src").select("dst", F.col("src").alias("owner"))
    rows = held.join(roots, "src").select("dst").distinct().join(files, "dst").join(owners, "dst", "left")
    grouped = rows.groupBy("path").agg(F.collect_set("sha").alias("shas"), F.array_sort(F.collect_set("owner")).alias("owners"))
    sha = F.when(F.size("shas") > 1, F.raise_error(F.concat(F.lit("two hashes of "), "path")).cast("string")).otherwise(F.coalesce(F.get("shas", F.lit(0)), F.lit(UNKNOWN)))
    return grouped.select("path", sha.alias("sha256"), "owners")


def runtime_dependencies(found: DataFrame) -> DataFrame:
    """(src, dst) of packages that need each other at run time."""
    own = packages(found).select("source_id")
    edges = _edges(found, ("dependsOn",)).filter("scope is null or scope = 'runtime'").select("src", "dst").distinct()
    return edges.join(own.withColumnRenamed("source_id", "src"), "src", "left_semi").join(own.withColumnRenamed("source_id", "dst"), "dst", "left_semi")


def package_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(logical_key, name, change, from_version, to_version) of packages (architecture, name, version) by architecture:name, unchanged ones too; a repeated key is an error."""

    def keyed(packages: DataFrame, version: str) -> DataFrame:
        rows = packages.groupBy(F.concat_ws(":", "architecture", "name").alias("logical_key")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias(f"{version}_name"), F.min("version").alias(version))
        once = F.when(F.col("n") == 1, F.col("logical_key")).otherwise(F.raise_error(F.concat(F.lit("repeated package "), "logical_key")))
        return rows.select(once.alias("logical_key"), f"{version}_name", version)

    both = keyed(before, "from_version").join(keyed(after, "to_version"), "logical_key", "full")
    change = F.when(F.col("from_version_name").isNull(), "ADDED").when(F.col("to_version_name").isNull(), "REMOVED").when(F.col("from_version") != F.col("to_version"), "UPDATED").otherwise("UNCHANGED")
    return both.select("logical_key", F.coalesce("to_version_name", "from_version_name").alias("name"), change.alias("change"), "from_version", "to_version")


def rootfs_totals(members: DataFrame) -> DataFrame:
    """(archive, entry_count, regular_file_count, symlink_count, expanded_regular_bytes, regular_exact_set_sha256, symlink_exact_set_sha256) of archives (as files.tar_members)."""
    is_file, is_link = F.col("kind") == "file", F.col("kind") == "symlink"
    totals = members.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if(is_file).alias("regular_file_count"), F.count_if(is_link).alias("symlink_count"), F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("expanded_regular_bytes")
    )
    regular = list_sha256(members.filter(is_file), "archive", canonical_json("path", "sha256", "size"), ["path"]).withColumnRenamed("sha256", "regular_exact_set_sha256")
    links = list_sha256(members.filter(is_link), "archive", canonical_json("path", "target"), ["path"]).withColumnRenamed("sha256", "symlink_exact_set_sha256")
    both = totals.join(regular, "archive", "left").join(links, "archive", "left")
    none = F.sha2(F.lit("[]"), 256)
    return both.withColumns({c: F.coalesce(c, none) for c in ("regular_exact_set_sha256", "symlink_exact_set_sha256")})


def analysis(installed: DataFrame, described: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(finding_type, subject, status, details): packages of the manifest against descriptions, and files of the metadata against the image."""
    packages = package_states(installed, described)
    why = F.when(F.col("status") == "MISSING_FROM_SBOM", "description").when(F.col("status") == "UNKNOWN", "ambiguous_description").when(F.col("status") == "NOT_IN_RELEASE", "manifest").otherwise("")
    files = file_states(expected, observed)
    return packages.select(F.lit("COMPONENT").alias("finding_type"), F.col("name").alias("subject"), "status", why.alias("details")).union(files.select(F.lit("FILE"), "path", "status", "details"))
