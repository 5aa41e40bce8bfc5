"""Observations of scan profiles, sealed over their components.

An observation binds one projection (a document's head, its components and dependencies, each a
line of JSON) to one profile. Components and dependencies enter by the root of a hash tree, so a
projection of any size is sealed by many tasks. The canonical hash covers all that is observed; the
run id leaves out what a scanner makes anew each time (serial numbers, the hash of the raw bytes),
so scans of the same inputs share it.

profiles: profile_id, profile_kind, independence_domain, comparison_namespace, product_name, declared_version, target_kind,
target_label, blindspots, scanner (name, version, binary_sha256, config_sha256), max_components;
heads: profile_id, raw (the projection's head as JSON text), source_sha256, raw_size, root_id, input_sha256, file_count, total_bytes, scanner;
components, dependencies: profile_id, line (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.document import canonical_text, scrubbed
from corroborate.functions.text import canonical_json, is_safe_id, is_sha256, is_text, stable_id
from corroborate.operators.hashing import tree_sha256
from corroborate.operators.rules import violations

# Statuses that no observation may change, what a kind of profile implies, mandatory limits of what is said, the pinned scanner.
STATUSES = {
    "schema_version": "1.0", "classification": "SELF_TEST_NOT_CUSTOMER_EVIDENCE", "generator_output_status": "GENERATOR_OUTPUT_CANDIDATE", "release_status": "NOT_RELEASED",
    "product_conformity_status": "NO_PRODUCT_CONFORMITY_STATUS", "manufacturer_approval_status": "NOT_PROVIDED", "milestone_scope": "M3A_NOT_YOCTO_M3B",
}
DOMAINS = {"SOURCE_DIRECTORY": "SOURCE_DECLARATION", "OCI_ARCHIVE": "BUILT_OCI_ARTIFACT", "PORTABLE_RUNTIME": "PORTABLE_RUNTIME_OBSERVATION"}
TARGETS = {"SOURCE_DIRECTORY": "dir", "OCI_ARCHIVE": "docker-archive", "PORTABLE_RUNTIME": "dir"}
BLINDSPOTS = ("NO_CRA_OR_PRE7_CONFORMITY_CLAIM", "NO_CUSTOMER_OR_MANUFACTURER_CONTEXT", "NOT_YOCTO_M3B")
SCANNER = ("syft", "1.50.0")
MOST_COMPONENTS = 100_000
RUN_PREFIX = "selftest-run"

#: Fields that a scanner makes anew: null, or left out, in what names a run.
NULLED, DROPPED = ["serial_number"], ["source_sha256"]
_BODY = sorted(["blindspots", "cyclonedx_evidence", "independence_domain", "input_identity", "profile_id", "profile_kind", "scan_contract", "scanner_identity", "subject", *STATUSES])


def _known(kind: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[kind]


def _rooted(lines: DataFrame, name: str) -> DataFrame:
    """(profile_id, name_rows, name_sha256, name_semantic): roots over lines as they are, and without what a scanner makes anew."""
    text = F.coalesce(canonical_text(F.col("line")), F.lit(""))
    whole = tree_sha256(lines, "profile_id", text).select("profile_id", F.col("rows").alias(f"{name}_rows"), F.col("sha256").alias(f"{name}_sha256"))
    stable = tree_sha256(lines, "profile_id", scrubbed(text, NULLED, DROPPED)).select("profile_id", F.col("sha256").alias(f"{name}_semantic"))
    return whole.join(stable, "profile_id")


def sealed(profiles: DataFrame, heads: DataFrame, components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row per profile: the observation, with semantic_sha256, canonical_sha256 and run_id.

    A scanner other than the profile's, more components than its limit, and lines or heads that are no JSON stop it.
    """
    empty = F.sha2(F.lit(""), 256)
    rows = heads.withColumnRenamed("scanner", "scanner_identity").join(profiles, "profile_id")
    for name, lines in (("components", components), ("dependencies", dependencies)):
        bad = lines.filter(canonical_text(F.col("line")).isNull()).groupBy("profile_id").agg(F.count(F.lit(1)).alias(f"{name}_bad"))
        rows = rows.join(_rooted(lines, name), "profile_id", "left").join(bad, "profile_id", "left")
        rows = rows.withColumns({f"{name}_rows": F.coalesce(f"{name}_rows", F.lit(0).cast("long")), f"{name}_sha256": F.coalesce(f"{name}_sha256", empty), f"{name}_semantic": F.coalesce(f"{name}_semantic", empty)})
    head = canonical_text(F.col("raw"))
    checks = {"scanner identity": F.col("scanner_identity") == F.col("scanner"), "component limit": F.col("components_rows") <= F.col("max_components"), "JSON": head.isNotNull() & F.col("components_bad").isNull() & F.col("dependencies_bad").isNull()}
    fine = F.col("profile_id")
    for what, ok in checks.items():
        fine = F.when(F.coalesce(ok, F.lit(False)), fine).otherwise(F.raise_error(F.concat(F.lit(f"{what} of profile "), "profile_id")))
    rows = rows.withColumn("profile_id", fine)
    semantic = canonical_json(F.col("components_semantic").alias("components"), F.col("dependencies_semantic").alias("dependencies"), scrubbed(head, NULLED, DROPPED).alias("head"))
    evidence = F.struct(F.col("components_rows").alias("component_count"), F.col("components_sha256"), F.col("dependencies_sha256"), F.col("dependencies_rows").alias("dependency_rows"), head.alias("head"), F.sha2(semantic, 256).alias("semantic_sha256"), F.col("source_sha256"))
    rows = rows.select(
        "profile_id", *(F.lit(v).alias(k) for k, v in STATUSES.items()), "profile_kind", "independence_domain", F.struct("comparison_namespace", "declared_version", "product_name").alias("subject"), F.struct("target_kind", "target_label").alias("scan_contract"), F.array_sort("blindspots").alias("blindspots"),
        F.struct("file_count", "root_id", F.col("input_sha256").alias("sha256"), "total_bytes").alias("input_identity"), F.struct(*(F.col(f"scanner_identity.{f}").alias(f) for f in ("binary_sha256", "config_sha256", "name", "version"))).alias("scanner_identity"), evidence.alias("cyclonedx_evidence"), "raw_size",
    )
    return rows.withColumns(_names())


def _names() -> dict[str, Column]:
    """canonical_sha256 and run_id of an observation's row."""
    return {"canonical_sha256": F.sha2(canonical_json(*_BODY), 256), "run_id": _run_id()}


def _run_id() -> Column:
    inner = F.struct(*(F.col(f"cyclonedx_evidence.{f}").alias(f) for f in ("component_count", "dependency_rows", "semantic_sha256")))
    return stable_id(RUN_PREFIX, *(inner.alias(f) if f == "cyclonedx_evidence" else F.col(f) for f in _BODY))


def observation_violations(observations: DataFrame) -> DataFrame:
    """(profile_id, rule) of sealed observations that break a rule, each rule on its own: fixed statuses, kind with domain and target, safe names, mandatory limits, the pinned scanner, and both names derived again."""
    c = F.col
    names = _names()
    checks = {k: c(k) == v for k, v in STATUSES.items()} | {
        "profile_kind": c("profile_kind").isin(*DOMAINS), "independence_domain": c("independence_domain") == _known(c("profile_kind"), DOMAINS), "target_kind": c("scan_contract.target_kind") == _known(c("profile_kind"), TARGETS),
        "profile_id": is_safe_id(c("profile_id")), "comparison_namespace": is_safe_id(c("subject.comparison_namespace")), "product_name": is_text(c("subject.product_name")), "declared_version": is_text(c("subject.declared_version")), "target_label": is_safe_id(c("scan_contract.target_label")),
        "blindspots": F.forall(F.array(*map(F.lit, BLINDSPOTS)), lambda b: F.array_contains("blindspots", b)) & (F.size("blindspots") == F.size(F.array_distinct("blindspots"))),
        "input_identity": is_text(c("input_identity.root_id")) & is_sha256(c("input_identity.sha256")) & (c("input_identity.file_count") >= 1) & (c("input_identity.total_bytes") >= 1),
        "scanner": (c("scanner_identity.name") == SCANNER[0]) & (c("scanner_identity.version") == SCANNER[1]) & is_sha256(c("scanner_identity.binary_sha256")) & is_sha256(c("scanner_identity.config_sha256")),
        "components": c("cyclonedx_evidence.component_count") <= MOST_COMPONENTS,
        "canonical_sha256": c("canonical_sha256") == names["canonical_sha256"], "run_id": c("run_id") == names["run_id"],
    }
    return violations(observations, "profile_id", {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})


def profile_violations(profiles: DataFrame) -> DataFrame:
    """(profile_id, rule) of scan profiles that break a rule: what an observation takes from its profile, and its limits."""
    c = F.col
    checks = {
        "profile_id": is_safe_id(c("profile_id")), "profile_kind": c("profile_kind").isin(*DOMAINS), "independence_domain": c("independence_domain") == _known(c("profile_kind"), DOMAINS), "target_kind": c("target_kind") == _known(c("profile_kind"), TARGETS),
        "comparison_namespace": is_safe_id(c("comparison_namespace")), "product_name": is_text(c("product_name")), "declared_version": is_text(c("declared_version")), "target_label": is_safe_id(c("target_label")),
        "scanner": (c("scanner.name") == SCANNER[0]) & (c("scanner.version") == SCANNER[1]) & is_sha256(c("scanner.binary_sha256")) & is_sha256(c("scanner.config_sha256")), "max_components": c("max_components").between(1, MOST_COMPONENTS),
        "blindspots": F.forall(F.array(*map(F.lit, BLINDSPOTS)), lambda b: F.array_contains("blindspots", b)) & (F.size("blindspots") == F.size(F.array_distinct("blindspots"))),
    }
    return violations(profiles, "profile_id", {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})


def validation_rows(observations: DataFrame) -> DataFrame:
    """What a scan package says of each profile; the document's root is counted as a component."""
    e = "cyclonedx_evidence."
    return observations.select(
        "profile_id", "profile_kind", F.col(f"{e}source_sha256").alias("raw_sha256"), "raw_size", F.col(f"{e}semantic_sha256").alias("semantic_sha256"), (F.col(f"{e}component_count") + 1).alias("component_count"), F.col(f"{e}dependency_rows").alias("dependency_row_count"), F.lit("MECHANICALLY_VALID").alias("status"),
    )


def scan_dashboard(observations: DataFrame, findings: DataFrame, run_id: str, namespace: str) -> DataFrame:
    """(run_id, kind, subject, status, details): what a reader is shown of a scan package: its release, each profile and each open finding (as profiles.findings())."""
    of_run = F.lit(run_id).alias("run_id")
    release = observations.sparkSession.createDataFrame([(run_id, "release", namespace, "NOT_RELEASED", "MULTI_PROFILE_OBSERVATION")], "run_id string, kind string, subject string, status string, details string")
    own = observations.select(of_run, F.lit("profile").alias("kind"), F.col("profile_id").alias("subject"), F.lit("PROFILE_ISOLATED_OPEN").alias("status"), F.concat_ws(" ", "profile_kind", "subject.declared_version", (F.col("cyclonedx_evidence.component_count") + 1).cast("string"), "run_id").alias("details"))
    return release.union(own).union(findings.select(of_run, F.lit("conflict"), "finding_id", "state", F.concat_ws(": ", "code", "explanation")))
