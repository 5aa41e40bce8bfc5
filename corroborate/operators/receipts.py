"""Documents that bind others: release records, cards of findings, attestations, signature receipts, handoffs, and hashes less some fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import NAMESPACE, UNKNOWN, canonical_json, is_relative_path, is_safe_id, is_sha256, is_text, stable_id
from corroborate.operators.binding import utc
from corroborate.operators.hashing import list_sha256
from corroborate.operators.rules import violations

#: Fixed values.
SYNTHETIC = "SYNTHETIC_NOT_EVIDENCE"
RELEASE_FILES = ("release.json", "evidence/build-manifest.json", "evidence/artifact-inventory.json")
STATEMENT_TYPE, SIGNING_SCHEMA, SIGNING_SCHEME = "https://in-toto.io/Statement/v1", f"{NAMESPACE}.signature-receipt/v1", "cosign-key-based-offline"
DIRECTION, HANDOFF_CLASS = "SBOM_TO_EUVD_ONLY", "SELF_TEST_NOT_CUSTOMER_EVIDENCE"
DECLARED_BINDING = "CALLER_DECLARED_NOT_INDEPENDENTLY_VERIFIED"
SIGN_FLAGS = ("--tlog-upload=false", "--use-signing-config=false", "--new-bundle-format=false", "--output-signature")
VERIFY_FLAGS = ("--signature", "--insecure-ignore-tlog=true")
ONLINE_FLAGS = ("--upload", "--rekor-url", "--fulcio-url", "--oidc", "--identity-token", "--certificate", "--cert-email", "--bundle")


def is_origin_path(column: Column) -> Column:
    """A normalised relative path that may begin with one parent part."""
    return F.coalesce(is_relative_path(F.when(column.startswith("../"), F.substring(column, F.lit(4), F.length(column))).otherwise(column)), F.lit(False))


def is_hash(algorithm: Column, value: Column, supplier: Column) -> Column:
    """SHA-256 with lower-case hex; only a supplier's hash may lack either (null, or UNKNOWN)."""
    algorithm, value = F.coalesce(algorithm, F.lit(UNKNOWN)), F.coalesce(value, F.lit(UNKNOWN))
    fine = algorithm.isin("SHA-256", UNKNOWN) & ((value == UNKNOWN) | is_sha256(value))
    return fine & (F.coalesce(supplier, F.lit(False)) | (algorithm != UNKNOWN) & (value != UNKNOWN))


def hash_violations(hashes: DataFrame) -> DataFrame:
    """(component_id, rule) of component hashes (component_id, kind: observed or supplier, algorithm, value)."""
    return violations(hashes, "component_id", {"hash": is_hash(F.col("algorithm"), F.col("value"), F.col("kind") == "supplier")})


def release_violations(releases: DataFrame) -> DataFrame:
    """(release_id, rule) of release records whose texts, ids, paths, hashes or times are not as they must be."""
    texts = ("manufacturer", "product", "product_version", "architecture", "hardware_revision", "sbom_author", "sbom_version")
    at, cutoff = utc(F.col("release_timestamp")), utc(F.col("evidence_cutoff"))
    rules = {c: is_text(F.col(c), allow_unknown=False) for c in texts} | {c: is_safe_id(F.col(c)) for c in ("release_id", "build_id")}
    rules |= {
        "classification": F.col("classification") == SYNTHETIC, "artifact_sha256": is_sha256(F.col("artifact_sha256")), "times": at.isNotNull() & cutoff.isNotNull() & (cutoff <= at),
        "artifact_relative_path": is_relative_path(F.col("artifact_relative_path")) & ~F.col("artifact_relative_path").isin(*RELEASE_FILES),
    }
    return violations(releases, "release_id", rules)


def object_hash(rows: DataFrame, key: str, without: list[str], prefix: str = "") -> DataFrame:
    """(key, sha256): hash of the canonical JSON of each row, less the columns of ``without``; with a prefix it is an id."""
    fields = [F.col(c) for c in sorted(rows.columns) if c not in without]
    digest = F.sha2(canonical_json(*fields), 256)
    return rows.select(key, (F.concat(F.lit(prefix + "-"), digest) if prefix else digest).alias("sha256"))


def profile_cards(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(conflict_id, claim_id, value, evidence_id): claims of cards about the versions in findings (as operators.profiles); evidence without a version is left to violations."""
    met = findings.select(F.col("finding_id"), "code", "logical_key").join(evidence.filter("version <> ''"), ["code", "logical_key"])
    claim = stable_id("claim", F.col("bom_ref"), F.col("finding_id"), F.col("profile_id"), F.col("version"))
    return met.select(F.col("finding_id").alias("conflict_id"), claim.alias("claim_id"), F.col("version").alias("value"), F.col("run_id").alias("evidence_id"))


def card_set_hash(cards: DataFrame) -> DataFrame:
    """(card_set_id, sha256): hash of each sealed set's cards (card_set_id, conflict_id, claims: array of structs) by conflict_id."""
    return list_sha256(cards, "card_set_id", canonical_json("claims", "conflict_id"), ["conflict_id"])


def attestation_violations(statements: DataFrame) -> DataFrame:
    """(doc, rule) of in-toto statements (doc, raw: JSON text): type, predicate, and one subject with a name and a SHA-256."""
    at = lambda p: F.get_json_object("raw", p)
    subject = F.from_json(at("$.subject"), "array<struct<name: string, digest: struct<sha256: string>>>")
    rules = {
        "type": at("$._type") == STATEMENT_TYPE, "predicateType": at("$.predicateType") != "", "subject": F.size(subject) == 1, "name": F.get(subject, 0)["name"] != "",
        "digest": is_sha256(F.get(subject, 0)["digest"]["sha256"]), "predicate": at("$.predicate").startswith("{"),
    }
    return violations(statements, "doc", rules)


def signature_violations(receipts: DataFrame) -> DataFrame:
    """(key_id, rule) of signature receipts: fixed values, names, and hashes of subject, signature and tool."""
    full = ("subject_name", "signature_path", "key_id", "signed_at_utc", "tool_name", "tool_version")
    rules = {"schema_version": F.col("schema_version") == SIGNING_SCHEMA, "scheme": F.col("scheme") == SIGNING_SCHEME}
    rules |= {c: F.col(c) != "" for c in full} | {c: is_sha256(F.col(c)) for c in ("subject_sha256", "signature_sha256", "tool_sha256")}
    return violations(receipts, "key_id", rules)


def offline_violations(commands: DataFrame) -> DataFrame:
    """(command_id, rule) of signing commands (command_id, argv: array) that might go online or use no key."""
    verb, has = F.get("argv", F.lit(1)), lambda f: F.array_contains("argv", f)
    needed = lambda flags: F.forall(F.array(*map(F.lit, flags)), lambda f: F.array_contains("argv", f))
    online = F.exists("argv", lambda a: F.greatest(*(a.contains(f) for f in ONLINE_FLAGS)) | a.contains("--tlog-upload") & ~a.contains("false"))
    rules = {
        "verb": verb.isin("sign-blob", "verify-blob"), "key": has("--key"), "sign": (verb != "sign-blob") | needed(SIGN_FLAGS), "verify": (verb != "verify-blob") | needed(VERIFY_FLAGS), "online": ~online
    }
    return violations(commands, "command_id", rules)


def handoffs(components: DataFrame, sources: DataFrame) -> DataFrame:
    """One handoff per inventory: an id of what it binds, and how many of its components (cyclonedx_sha256, purl, version) have a package URL and a version.

    sources: source_run_id, source_binding_status, source_profile_id, source_root_completion_sha256, cyclonedx_sha256, endpoint.
    """
    own = stable_id("euvd", F.col("cyclonedx_sha256"), F.lit(DIRECTION).alias("direction"), F.col("endpoint"), F.col("source_binding_status"), F.col("source_profile_id"), F.col("source_root_completion_sha256"), F.col("source_run_id"))
    full = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    counts = components.groupBy("cyclonedx_sha256").agg(F.count(F.lit(1)).alias("component_record_count"), full("purl").alias("with_purl"), full("version").alias("with_version"))
    return sources.join(counts, "cyclonedx_sha256", "left").select(
        own.alias("handoff_id"), F.lit(HANDOFF_CLASS).alias("classification"), F.lit(DIRECTION).alias("direction"), "source_run_id", "source_binding_status", "cyclonedx_sha256",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("component_record_count", "with_purl", "with_version")),
    )


def handoff_violations(sources: DataFrame, profiles: tuple[str, ...]) -> DataFrame:
    """(source_run_id, rule) of handoff sources: a declared binding names no verified root, any other names a profile and a root's hash."""
    declared = F.col("source_binding_status") == DECLARED_BINDING
    root, profile = F.col("source_root_completion_sha256"), F.col("source_profile_id")
    rules = {"source_run_id": is_safe_id(F.col("source_run_id")), "declared": ~declared | root.isNull() & profile.isNull(), "verified": declared | profile.isin(*profiles) & is_sha256(root), "cyclonedx_sha256": is_sha256(F.col("cyclonedx_sha256"))}
    return violations(sources, "source_run_id", rules)


def source_listing(sources: DataFrame) -> DataFrame:
    """What a reader is shown of source registry entries (dataset_id, and the structs pin and governance)."""
    return sources.select("dataset_id", F.col("pin.resolved_commit").alias("commit"), F.col("governance.admission_status").alias("admission"), "governance.split", "governance.training_allowed")


def arm_differences(results: DataFrame, recorded: DataFrame) -> DataFrame:
    """(arm_id, field): where recorded metrics (arm_id, results, valid, rate) are not what the results (arm_id, valid) come to."""
    now = results.groupBy("arm_id").agg(F.count(F.lit(1)).alias("now_results"), F.count_if("valid").alias("now_valid")).withColumn("now_rate", F.col("now_valid") / F.col("now_results"))
    both = recorded.join(now, "arm_id", "full")
    return both.select("arm_id", F.explode(F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"now_{f}")), f) for f in ("results", "valid", "rate"))))).alias("field"))


