"""Relationships and A/B differences: groupings and full outer joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import UNKNOWN


def relationship_conflicts(claims: DataFrame) -> DataFrame:
    """(src, dst, status, details) of endpoints whose claims (src, rel, dst) are unknown or disagree."""
    kinds = claims.groupBy("src", "dst").agg(F.array_sort(F.collect_set("rel")).alias("kinds"))
    unknown = F.array_contains("kinds", UNKNOWN)
    status = F.when(unknown, "UNKNOWN").when(F.size("kinds") > 1, "CONFLICT")
    return kinds.select("src", "dst", status.alias("status"), F.when(unknown, F.array(F.lit("relationship"))).otherwise(F.col("kinds")).alias("details")).filter(F.col("status").isNotNull())


def relationship_projection(claims: DataFrame) -> DataFrame:
    """One row per (src, rel, dst) of ``claims`` with the lanes and the number of claims."""
    return claims.groupBy("src", "rel", "dst").agg(F.array_sort(F.collect_set("lane_id")).alias("lanes"), F.count(F.lit(1)).alias("n_claims"))


def declared_relationships(found: DataFrame, declared: DataFrame, mapping: DataFrame) -> DataFrame:
    """(src, rel, dst, status) of found (src, rel, dst: populations) against declared (src, rel, dst: candidates).

    ``mapping``: candidate_id, population_id. A declared end without a population is UNKNOWN.
    """
    ends = [mapping.select(F.col("candidate_id").alias(e), F.col("population_id").alias(f"p_{e}")) for e in ("src", "dst")]
    mapped = declared.join(ends[0], "src", "left").join(ends[1], "dst", "left")
    lost = F.col("p_src").isNull() | F.col("p_dst").isNull()
    ours = mapped.filter(~lost).select(F.col("p_src").alias("src"), "rel", F.col("p_dst").alias("dst")).distinct().withColumn("declared", F.lit(True))
    both = found.select("src", "rel", "dst").distinct().withColumn("found", F.lit(True)).join(ours, ["src", "rel", "dst"], "full")
    status = F.when(F.col("found") & F.col("declared"), "MATCHED").when(F.col("found"), "MISSING_FROM_SBOM").otherwise("NOT_IN_RELEASE")
    return both.select("src", "rel", "dst", status.alias("status")).union(mapped.filter(lost).select("src", "rel", "dst", F.lit("UNKNOWN")))


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed_fields): ADDED, REMOVED or MODIFIED rows of two releases."""
    left = before.select(key, *(F.col(f).alias(f"b_{f}") for f in fields), F.lit(True).alias("in_b"))
    right = after.select(key, *(F.col(f).alias(f"a_{f}") for f in fields), F.lit(True).alias("in_a"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")), f) for f in sorted(fields))))
    change = F.when(F.col("in_b").isNull(), "ADDED").when(F.col("in_a").isNull(), "REMOVED").when(F.size(changed) > 0, "MODIFIED")
    listed = F.when(change == "MODIFIED", changed).otherwise(F.array().cast("array<string>"))
    return left.join(right, key, "full").select(key, change.alias("change"), listed.alias("changed_fields")).filter(F.col("change").isNotNull())


def set_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one side alone, as sets, with change REMOVED or ADDED."""
    return before.subtract(after).withColumn("change", F.lit("REMOVED")).unionByName(after.subtract(before).withColumn("change", F.lit("ADDED")))


def file_states(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, status, details) of files (path, sha256) that metadata expects and that an image holds."""
    both = expected.select("path", F.col("sha256").alias("e")).join(observed.select("path", F.col("sha256").alias("o")), "path", "full")
    cases = [
        (F.col("e").isNull(), "MISSING_FROM_SBOM", "path"), (F.col("o").isNull(), "NOT_IN_RELEASE", "path"),
        (F.col("e") == UNKNOWN, "UNKNOWN", "build_metadata_sha256"), (F.col("e") != F.col("o"), "CONFLICT", "sha256"),
    ]
    status: Column = F.lit("MATCHED")
    details: Column = F.lit("")
    for when, state, why in reversed(cases):
        status, details = F.when(when, state).otherwise(status), F.when(when, why).otherwise(details)
    return both.select("path", status.alias("status"), details.alias("details"))


def package_states(manifest: DataFrame, described: DataFrame) -> DataFrame:
    """(name, status, version_differs) of installed packages (name, version) against described ones, and described ones that are not installed.

    No description is MISSING_FROM_SBOM, several are UNKNOWN, one is MATCHED whatever its version.
    """
    known = described.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("v"))
    status = F.when(F.col("n").isNull(), "MISSING_FROM_SBOM").when(F.col("n") > 1, "UNKNOWN").otherwise("MATCHED")
    own = manifest.join(known, "name", "left").select("name", status.alias("status"), F.coalesce((F.col("n") == 1) & (F.col("v") != F.col("version")), F.lit(False)).alias("version_differs"))
    rest = described.join(manifest, "name", "left_anti").select("name", F.lit("NOT_IN_RELEASE").alias("status"), F.lit(False).alias("version_differs"))
    return own.unionByName(rest)


def dependency_rows(refs: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("DEPENDS_ON", "DYNAMICALLY_LINKS")) -> DataFrame:
    """(ref, depends_on): sorted targets of each ref's dependencies, an empty list where it has none."""
    targets = edges.filter(F.col("rel").isin(*kinds)).groupBy(F.col("src").alias("ref")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    return refs.select("ref").distinct().join(targets, "ref", "left").select("ref", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def broken_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, problem): ends that do not exist, edges to oneself, repeated edges."""
    known = nodes.select(F.col("node").alias("dst")).distinct()
    dangling = edges.select("src", "dst").join(known, "dst", "left_anti").select("src", "dst", F.lit("dangling").alias("problem")).distinct()
    own = edges.filter("src = dst").select("src", "dst", F.lit("self").alias("problem")).distinct()
    twice = edges.groupBy("src", "rel", "dst").count().filter("count > 1").select("src", "dst", F.lit("repeated").alias("problem")).distinct()
    return dangling.union(own).union(twice)


def contains_edges(root: DataFrame, packages: DataFrame) -> DataFrame:
    """(src, rel, dst): the one root contains every package. ``root`` (ref) has one row; more are an error."""
    only = root.agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref"))
    one = only.select(F.when(F.col("n") == 1, F.col("ref")).otherwise(F.raise_error(F.lit("not one root"))).alias("src"))
    return packages.select(F.lit("CONTAINS").alias("rel"), F.col("ref").alias("dst")).join(F.broadcast(one)).select("src", "rel", "dst")
