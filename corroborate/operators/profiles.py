"""Isolated observations of one product compared: findings with their evidence, and what could not be named.

Observations: profile_id, profile_kind, run_id, bom_ref, name, version, purl, cpe, logical_key (null where
nothing names the component), hashes (array of ALGORITHM:value). Populations are never merged. A finding's
evidence is rows, however many there are; its id is hashed from them as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import canonical_json
from corroborate.operators.hashing import list_sha256

#: Kinds of findings and what they say.
CONFLICT, STALE, PORTABLE = "VERSION_CONFLICT", "STALE_PORTABLE_RUNTIME", "PORTABLE_RUNTIME"
EXPLANATIONS = {
    CONFLICT: "version strings differ across isolated evidence profiles; no version ordering is inferred",
    STALE: "portable runtime version differs from source/OCI observations; stale is a review label, not semantic version ordering",
}
_ORDER = ["profile_kind", "profile_id", "bom_ref"]


def evidence(observations: DataFrame) -> DataFrame:
    """The observations that a finding rests on, with its code.

    VERSION_CONFLICT: all of a key that has several versions and several kinds of profile.
    STALE_PORTABLE_RUNTIME: portable ones whose version no other profile has, where others have
    any, and all of the others.
    """
    named = observations.filter("logical_key is not null")
    keys = named.groupBy("logical_key").agg(((F.min("version") < F.max("version")) & (F.min("profile_kind") < F.max("profile_kind"))).alias("torn"))
    torn = named.join(keys.filter("torn").select("logical_key"), "logical_key", "left_semi").withColumn("code", F.lit(CONFLICT))
    portable, others = named.filter(F.col("profile_kind") == PORTABLE), named.filter(F.col("profile_kind") != PORTABLE)
    known = others.filter("version is not null").select("logical_key", "version").distinct()
    stale = portable.filter("version is not null").join(known, ["logical_key", "version"], "left_anti").join(known.select("logical_key").distinct(), "logical_key", "left_semi")
    about = others.join(stale.select("logical_key").distinct(), "logical_key", "left_semi")
    return torn.unionByName(stale.unionByName(about).withColumn("code", F.lit(STALE)))


def findings(evidence: DataFrame) -> DataFrame:
    """(finding_id, code, logical_key, state, explanation) of ``evidence``; the id is made of all that a finding says."""
    record = canonical_json("bom_ref", "cpe", "hashes", "logical_key", "name", F.col("run_id").alias("observation_run_id"), "profile_id", "profile_kind", "purl", "version")
    said = F.create_map(*(F.lit(x) for pair in EXPLANATIONS.items() for x in pair))[F.col("code")]
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    rows = evidence.withColumn("finding", F.concat_ws("\n", "code", "logical_key"))
    before = F.concat(F.lit('{"code":'), quoted(F.col("code")), F.lit(',"evidence":['))
    after = F.concat(F.lit('],"explanation":'), quoted(said), F.lit(',"logical_key":'), quoted(F.col("logical_key")), F.lit(',"state":"OPEN"}'))
    hashed = list_sha256(rows, "finding", record, _ORDER, before, after)
    code = F.substring_index("finding", "\n", 1)
    return hashed.select(
        F.concat(F.lit("selftest-finding-"), "sha256").alias("finding_id"), code.alias("code"), F.expr("substring(finding, instr(finding, chr(10)) + 1)").alias("logical_key"), F.lit("OPEN").alias("state")
    ).withColumn("explanation", said)


def unidentified(observations: DataFrame) -> DataFrame:
    """(profile_id, profile_kind, bom_ref, name, version) of components that nothing names, with the count of their profile."""
    rows = observations.filter("logical_key is null").select("profile_id", "profile_kind", "bom_ref", "name", "version")
    counts = rows.groupBy("profile_id").agg(F.count(F.lit(1)).alias("count"))
    return rows.join(F.broadcast(counts), "profile_id")  # as many rows as profiles


def observation_violations(observations: DataFrame) -> DataFrame:
    """(rule, subject) that forbid a comparison: fewer than two profiles, or a kind or an id with several."""
    each = observations.select("profile_id", "profile_kind", "run_id").distinct()
    few = each.agg(F.countDistinct("profile_id").alias("n")).filter("n < 2").select(F.lit("profiles").alias("rule"), F.col("n").cast("string").alias("subject"))
    kinds = each.groupBy("profile_kind").agg(F.countDistinct("profile_id").alias("n")).filter("n > 1").select(F.lit("profile_kind").alias("rule"), F.col("profile_kind").alias("subject"))
    ids = each.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("profile_id").alias("rule"), F.col("profile_id").alias("subject"))
    return few.union(kinds).union(ids)
