"""Registries of runtimes and of statement issuers: their rules, as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import fully, is_https_url, is_relative_path, is_safe_id, is_sha256
from corroborate.operators.rules import violations

#: Fixed values of the registries.
CATEGORIES = ("scanner", "validator", "model_server", "schema", "signing")
RUNTIME_STATUSES = ("REGISTERED_NOT_ACQUIRED", "LOCALLY_OBSERVED", "FROZEN")
ISSUER_STATUSES = ("ADMITTED_FOR_VEX_INTAKE", "NOT_ADMITTED")
HASHES = ("artifact_sha256", "config_sha256", "dependency_manifest_sha256")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule) of keys that stand more than once."""
    return rows.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("rule"))


def runtime_rules() -> dict[str, Column]:
    hashed = [F.col(h).isNull() | is_sha256(F.col(h)) for h in HASHES]
    return {
        "runtime_id": is_safe_id(F.col("runtime_id")), "category": F.col("category").isin(*CATEGORIES), "status": F.col("status").isin(*RUNTIME_STATUSES),
        "source_url": is_https_url(F.col("source_url")), "resolved_commit": fully(F.col("resolved_commit"), "[0-9a-f]{40}"), "hashes": hashed[0] & hashed[1] & hashed[2],
        "frozen": (F.col("status") != "FROZEN") | (F.col(HASHES[0]).isNotNull() & F.col(HASHES[1]).isNotNull() & F.col(HASHES[2]).isNotNull()),
    }


def runtime_violations(runtimes: DataFrame) -> DataFrame:
    """(runtime_id, rule) of runtimes that break a rule; frozen ones need all three hashes."""
    return violations(runtimes, "runtime_id", runtime_rules()).union(repeated(runtimes, "runtime_id"))


def issuer_rules() -> dict[str, Column]:
    key, path, receipt = F.col("public_key_sha256"), F.col("public_key_path"), F.col("acquisition_receipt_ref")
    admitted = F.col("status") == ISSUER_STATUSES[0]
    return {
        "issuer_id": is_safe_id(F.col("issuer_id")), "status": F.col("status").isin(*ISSUER_STATUSES), "key_hash": key.isNull() | is_sha256(key),
        "admitted": ~admitted | (key.isNotNull() & is_relative_path(path) & is_relative_path(receipt)), "not_admitted": admitted | (key.isNull() & path.isNull() & receipt.isNull()),
    }


def issuer_violations(issuers: DataFrame) -> DataFrame:
    """(issuer_id, rule) of issuers that break a rule: admitted ones have a key with its hash and receipt, others none of them."""
    return violations(issuers, "issuer_id", issuer_rules()).union(repeated(issuers, "issuer_id"))


#: Fixed values of sources.
ADMITTED = {
    "ADMITTED_FOR_INTERNAL_DEVELOPMENT": "internal_development_allowed", "ADMITTED_FOR_EVALUATION": "evaluation_allowed",
    "ADMITTED_FOR_TRAINING": "training_allowed", "ADMITTED_FOR_PUBLIC_REGRESSION": "evaluation_allowed",
}
PURPOSES = ("internal_development_allowed", "evaluation_allowed", "training_allowed")
USES = (*PURPOSES, "fixture_distribution_allowed", "raw_redistribution_allowed", "adapter_distribution_allowed", "weight_distribution_allowed", "shipping_examples_allowed")
FLOATING = ("main", "master", "head", "latest", "stable")


def source_rules() -> dict[str, Column]:
    admission, acquired, ref = F.col("admission_status"), F.col("acquisition_status"), F.lower("ref_name")
    admitted, reviewed = admission.isin(*ADMITTED), F.col("rights_status") == "RIGHTS_REVIEWED"
    used = F.lit(False)
    for use in USES:
        used = used | F.col(use)
    whole = ~F.exists("evidence_sha256", lambda h: h.isNull())
    own = F.lit(False)
    for name, purpose in ADMITTED.items():
        own = own | (admission == name) & F.col(purpose) & (F.col("usage_status") == name)
    one = sum((F.col(p).cast("int") for p in PURPOSES), F.lit(0)) == 1
    decided = F.col("rights_decision_sha256").isNotNull()
    return {
        "dataset_id": is_safe_id(F.col("dataset_id")), "resolved_commit": fully(F.col("resolved_commit"), "[0-9a-f]{40}"),
        "root_id": F.col("root_id") == F.concat_ws("@", "dataset_id", "resolved_commit"), "floating": ~(ref.isin(*FLOATING) | ref.startswith("refs/heads/")),
        "tag": (F.col("ref_type") == "annotated_tag") & F.col("tag_object").isNotNull() | (F.col("ref_type") == "commit") & F.col("tag_object").isNull(),
        "pending": (admission != "REGISTERED_PENDING_REVIEW") | (acquired == "REGISTERED_PENDING_ACQUISITION"),
        "quarantine": (admission != "QUARANTINE_ACQUIRED") | acquired.isin("ACQUIRED_UNSEALED", "FROZEN_VERIFIED_TECHNICAL"),
        "frozen": (acquired != "FROZEN_VERIFIED_TECHNICAL") | (F.col("archive_sha256").isNotNull() & whole), "rejected": (admission != "REJECT") | ~(F.col("acquisition_allowed") | used),
        "use_needs_rights": ~used | (whole & reviewed & decided), "rights_need_decision": ~reviewed | decided, "admission_needs_rights": ~(admitted | (admission == "RIGHTS_REVIEWED")) | reviewed,
        "use_needs_admission": ~used | admitted, "usage_status": admitted | (F.col("usage_status") == "NOT_ADMITTED"), "purpose": ~admitted | own & one,
        "regression_split": (admission != "ADMITTED_FOR_PUBLIC_REGRESSION") | (F.col("split") == "PUBLIC_REGRESSION"), "release": admitted | (F.col("release_status") == "NOT_APPROVED"),
        "training": ~F.col("training_allowed") | (F.col("split") == "TRAIN") & ~F.exists("scopes", lambda s: ~s["training_allowed"]),
        "redistribution": ~F.col("raw_redistribution_allowed") | ~F.exists("scopes", lambda s: ~s["raw_redistribution_allowed"]),
        "limits": F.col("max_files").between(1, 1_000_000) & F.col("max_total_bytes").between(1, 20_000_000_000),
    }


def source_violations(sources: DataFrame) -> DataFrame:
    """(dataset_id, rule) of sources whose pin floats or whose admission, rights, use and split do not agree.

    Columns: dataset_id, root_id, ref_type, ref_name, resolved_commit, tag_object, archive_sha256,
    evidence_sha256 (array, null where a hash is missing), scopes (array of training_allowed,
    raw_redistribution_allowed), admission_status, split, acquisition_status, rights_status, usage_status,
    release_status, rights_decision_sha256, acquisition_allowed, the columns of USES, max_files, max_total_bytes.
    """
    return violations(sources, "dataset_id", source_rules()).union(repeated(sources, "dataset_id"))


#: What fields of a source may say, and hosts that sources may be acquired from.
CONTROLLED = {
    "split": ("TRAIN", "DEV", "PUBLIC_REGRESSION", "SEALED_BLIND_HOLDOUT", "CUSTOMER_SHADOW", "DEV_BUILD_YOCTO"),
    "admission_status": ("REGISTERED_PENDING_REVIEW", "QUARANTINE_ACQUIRED", "RIGHTS_REVIEWED", *ADMITTED, "REJECT"),
    "acquisition_status": ("REGISTERED_PENDING_ACQUISITION", "ACQUIRED_UNSEALED", "FROZEN_VERIFIED_TECHNICAL", "REJECTED"),
    "rights_status": ("AWAITING_LICENSE_EVIDENCE", "AWAITING_NAMED_REVIEW", "RIGHTS_REVIEWED", "REJECTED"), "usage_status": ("NOT_ADMITTED", *ADMITTED),
    "format_validation_status": ("NOT_ASSESSED", "MECHANICALLY_VALIDATED", "REJECTED"), "release_status": ("NOT_APPROVED", "APPROVED_FOR_SCOPED_USE", "REJECTED"),
}
HOSTS = ("github.com", "git.openembedded.org", "git.yoctoproject.org")
SAID = ("redistribution_status", "access_terms_status", "tdm_reservation_status", "submodules_status", "lfs_status", "generated_content_status", "binary_content_status", "attribution_status")


def _said(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) != ""


def source_document_rules() -> dict[str, Column]:
    """What a source's document must say besides source_rules(): texts, formats, closed lists, and that no right is granted before a decision is verified.

    Columns: as of source_rules(), and name, notes, source_type, upstream_url, lineage_group, expression, review_status, evidence_paths,
    evidence_hashes (map), purposes, revalidation_triggers, rights_decision_ref, the columns of SAID, allow_submodules, execute_code.
    """
    c, unique = F.col, lambda name: (F.size(name) > 0) & (F.size(name) == F.size(F.array_distinct(name))) & F.forall(name, lambda x: F.coalesce(x != "", F.lit(False)))
    optional_hash = lambda x: x.isNull() | is_sha256(x)
    used = c("acquisition_allowed").isNull()
    for use in USES:
        used = used | c(use)
    texts = c("name").isNotNull()
    for name in ("name", "notes", "lineage_group", "expression", "review_status", *SAID):
        texts = texts & _said(name)
    names = F.transform("scopes", lambda s: s["scope"])
    decisions = c("acquisition_allowed").isNotNull()
    for use in USES:
        decisions = decisions & c(use).isNotNull()
    return {
        "texts": texts, "source_type": c("source_type") == "git", "upstream_url": is_https_url(c("upstream_url"), HOSTS), "ref_name": _said("ref_name"),
        "tag_object": c("tag_object").isNull() | fully(c("tag_object"), "[0-9a-f]{40}"), "archive_sha256": optional_hash(c("archive_sha256")),
        "evidence_paths": unique("evidence_paths") & F.forall("evidence_paths", is_relative_path), "evidence_cover": F.array_sort(F.map_keys("evidence_hashes")) == F.array_sort("evidence_paths"),
        "evidence_hashes": F.forall(F.map_values("evidence_hashes"), optional_hash), "scopes": (F.size("scopes") > 0) & (F.size(names) == F.size(F.array_distinct(names))),
        "scope_texts": F.forall("scopes", lambda s: (F.trim(F.coalesce(s["scope"], F.lit(""))) != "") & (F.trim(F.coalesce(s["expression"], F.lit(""))) != "") & s["training_allowed"].isNotNull() & s["raw_redistribution_allowed"].isNotNull()),
        "dataset_form": fully(c("dataset_id"), "[a-z0-9][a-z0-9._-]{2,127}"), **{name: c(name).isin(*values) for name, values in CONTROLLED.items()}, "purposes": unique("purposes"), "decisions": decisions,
        "rights_decision_ref": c("rights_decision_ref").isNull() | is_relative_path(c("rights_decision_ref")), "rights_decision_sha256": optional_hash(c("rights_decision_sha256")), "rights_decision": c("rights_decision_ref").isNull() == c("rights_decision_sha256").isNull(),
        "triggers": unique("revalidation_triggers"), "phase_one": ~((c("rights_status") == "RIGHTS_REVIEWED") | c("admission_status").isin(*ADMITTED) | used), "submodules": ~c("allow_submodules"), "execute_code": ~c("execute_code"),
    }


def lookups(requests: DataFrame, rows: DataFrame, key: str, admitted: Column | None = None) -> DataFrame:
    """``requests`` (with ``key``) and what keeps each from being bound to one row of ``rows``: unknown, repeated, not admitted; null where it is bound.

    Rows are counted by key before they are joined, so a key that repeats makes no further rows.
    """
    fine = F.lit(True) if admitted is None else F.coalesce(admitted, F.lit(False))
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(fine).alias("fine"))
    both = requests.join(counted, key, "left")
    problem = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(~F.col("fine"), "not admitted")
    return both.withColumn("problem", problem).drop("n", "fine")
