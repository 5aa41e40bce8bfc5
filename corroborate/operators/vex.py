"""Vulnerability statements and hits: intake rules, narrowing, receipts and what binds them.

Statements: vex_document_sha256, position (in their document), statement_id, vex_format, issuer_id,
vulnerability_id, status, justification, detail, first_issued_utc, last_updated_utc, purls.
Hits: handoff_id, cyclonedx_sha256, position, hit_id, vulnerability_id, purl, original_status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import NAMESPACE, canonical_json, fully, is_sha256, purl_canonical
from corroborate.operators.hashing import list_sha256
from corroborate.operators.rules import violations
from corroborate.storage import checkpointed

#: Formats, and what a statement may say.
CYCLONEDX, OPENVEX = "cyclonedx-bom", "openvex"
STATUSES = ("not_affected", "affected", "fixed", "unknown")
JUSTIFICATIONS = {
    CYCLONEDX: (
        "code_not_present", "code_not_reachable", "requires_configuration", "requires_dependency", "requires_environment",
        "protected_by_compiler", "protected_at_runtime", "protected_at_perimeter", "protected_by_mitigating_control",
    ),
    OPENVEX: (
        "vulnerable_code_not_present", "vulnerable_code_not_in_execute_path", "vulnerable_code_cannot_be_controlled_by_adversary", "inline_mitigations_already_exist",
    ),
}
#: Fixed values of receipts.
INTAKE_SCHEMA, NARROWING_SCHEMA = f"{NAMESPACE}.vex-intake-receipt/v1", f"{NAMESPACE}.narrowing-reconcile-receipt/v1"
DIRECTION, FACT_WRITE, CLASSIFICATION = "EUVD_TO_SBOM_NARROWING_ONLY", "EVIDENCE_ANNOTATION_ONLY_NO_HIT_DELETION", "SELF_TEST_NOT_CUSTOMER_EVIDENCE"
NO_MATCH, CONTRADICTORY, BINDING_FAILED = "RETAINED_OPEN_NO_VEX_MATCH", "RETAINED_OPEN_CONTRADICTORY_VEX", "VEX_INTAKE_BINDING_FAILED"
#: Hits of one matcher document at most.
HITS = 200_000
#: Documents of statements that are sent to all tasks at most: their hashes, some 100 MB.
DOCUMENTS = 500_000


def is_purl(column: Column) -> Column:
    return F.coalesce(fully(column, r"pkg:[A-Za-z0-9.\-+]+/.+"), F.lit(False))


def eligible() -> Column:
    return F.coalesce(F.col("status") == "not_affected", F.lit(False))


def statement_violations(statements: DataFrame) -> DataFrame:
    """(statement_id, rule) of statements that break a rule; a justification is needed whatever the status."""
    allowed = F.when(F.col("vex_format") == CYCLONEDX, F.array(*map(F.lit, JUSTIFICATIONS[CYCLONEDX]))).otherwise(F.array(*map(F.lit, JUSTIFICATIONS[OPENVEX])))
    rules = {
        "vulnerability_id": F.col("vulnerability_id") != "", "status": F.col("status").isin(*STATUSES),
        "justification": F.array_contains(allowed, F.col("justification")), "purls": (F.size("purls") > 0) & F.forall("purls", is_purl),
    }
    return violations(statements, "statement_id", rules)


def narrow(hits: DataFrame, statements: DataFrame, keys: tuple[str, ...] = ("vulnerability_id", "purl")) -> DataFrame:
    """One decision per row of ``hits``; ``keys`` may also name vex_document_sha256, where hits name their document, and hits may say if it is ``trusted``.

    A hit is narrowed if statements for its vulnerability and package all say not_affected.
    No statement, or one that says otherwise, keeps it open; every hit is kept in any case.
    Statements are gathered by vulnerability and package first, so a hit meets one row.
    """
    pointer = F.struct("vex_document_sha256", "position", F.struct("justification", "status", "vulnerability_id").alias("said"))
    said = statements.select("statement_id", "vulnerability_id", "vex_document_sha256", "status", pointer.alias("p"), F.explode(F.array_distinct(F.transform("purls", purl_canonical))).alias("purl")).filter("purl is not null")
    said = said.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~eligible()).alias("against"), F.array_sort(F.collect_list("statement_id")).alias("ids"), F.array_sort(F.collect_list("p")).alias("ps")
    )
    said = said.select(*keys, "n", "against", "ids", F.to_json(F.transform("ps", lambda p: p["said"]), {"ignoreNullFields": "false"}).alias("said"))
    asked = hits.withColumn("purl", purl_canonical(F.col("purl")))
    found = F.col("n").isNotNull()
    reason = F.when(~found, NO_MATCH).when(F.col("against") > 0, CONTRADICTORY)
    none = F.array().cast("array<string>")
    if "trusted" in hits.columns:
        reason = F.when(~F.col("trusted"), BINDING_FAILED).otherwise(reason)
    pointers = F.coalesce("said", F.lit("[]"))
    return asked.join(said, list(keys), "left").select(
        "handoff_id", "cyclonedx_sha256", "position", "hit_id", "vulnerability_id", "purl", "original_status", (found & (F.col("against") == 0)).alias("narrowed"), reason.alias("reason"),
        F.coalesce("n", F.lit(0)).alias("n_statements"), F.coalesce("ids", none).alias("pointers"), pointers.alias("vex_pointers"),
    )


def narrow_bound(hits: DataFrame, statements: DataFrame, receipts: DataFrame) -> DataFrame:
    """Decisions as of narrow(), where each handoff names its statement document (hits: vex_document_sha256).

    Hits whose document has no receipt, or one that its statements do not bear out, all stay open.
    """
    receipts = checkpointed(receipts)
    failed = binding_violations(receipts, statements).select("vex_document_sha256")
    good = checkpointed(receipts.select("vex_document_sha256").join(failed, "vex_document_sha256", "left_anti").distinct())
    # Documents are few beside their statements and hits, which then need not be dealt once more.
    if good.limit(DOCUMENTS + 1).count() <= DOCUMENTS:
        good = F.broadcast(good)
    known = hits.join(good.withColumn("known", F.lit(True)), "vex_document_sha256", "left").withColumn("trusted", F.coalesce("known", F.lit(False))).drop("known")
    return narrow(known, statements.join(good, "vex_document_sha256", "left_semi"), ("vulnerability_id", "purl", "vex_document_sha256"))


def hit_violations(hits: DataFrame, most: int = HITS) -> DataFrame:
    """(handoff_id, rule): documents of hits with an empty field, a package that is none, an inventory hash that is none, or too many hits."""
    full = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    rules = {
        "handoff_id": full("handoff_id"), "cyclonedx_sha256": is_sha256(F.col("cyclonedx_sha256")), "vulnerability_id": full("vulnerability_id"),
        "original_status": full("original_status"), "purl": purl_canonical(F.col("purl")).isNotNull(),
    }
    many = hits.groupBy("handoff_id").count().filter(F.col("count") > most).select("handoff_id", F.lit("hits").alias("rule"))
    return violations(hits, "handoff_id", rules).distinct().union(many)


def absent_purls(hits: DataFrame, components: DataFrame) -> DataFrame:
    """Package URLs of hits that no component (purl) has: any row stops a run."""
    known = components.select(purl_canonical(F.col("purl")).alias("purl")).distinct()
    return hits.select(purl_canonical(F.col("purl")).alias("purl")).distinct().join(known, "purl", "left_anti")


def statement_json() -> Column:
    return canonical_json(
        "detail", "first_issued_utc", "issuer_id", "justification", "last_updated_utc", eligible().alias("narrowing_eligible"), F.col("purls").alias("product_purls"), "status", "vex_document_sha256", "vex_format", "vulnerability_id"
    )


def statement_hashes(statements: DataFrame) -> DataFrame:
    """(vex_document_sha256, sha256): hash of each document's statements, all their fields, in the order of vulnerability and packages."""
    rows = statements.withColumn("joined", F.array_join("purls", "|"))
    return list_sha256(rows, "vex_document_sha256", statement_json(), ["vulnerability_id", "joined", "position"])


def intake_receipts(statements: DataFrame, signatures: DataFrame) -> DataFrame:
    """One receipt per document of ``statements``; signatures: vex_document_sha256, signature_sha256, binary_sha256 (of the tool)."""
    counts = statements.groupBy("vex_document_sha256").agg(F.min("vex_format").alias("vex_format"), F.min("issuer_id").alias("issuer_id"), F.count(F.lit(1)).alias("statement_count"), F.count_if(eligible()).alias("narrowing_eligible_count"))
    hashed = statement_hashes(statements).withColumnRenamed("sha256", "statements_canonical_sha256")
    return counts.join(hashed, "vex_document_sha256").join(signatures, "vex_document_sha256", "left").select(
        F.lit(INTAKE_SCHEMA).alias("schema_version"), "vex_format", "vex_document_sha256", "signature_sha256", "issuer_id", "binary_sha256", "statements_canonical_sha256", "statement_count", "narrowing_eligible_count"
    )


def receipt_violations(receipts: DataFrame) -> DataFrame:
    """(vex_document_sha256, rule) of intake receipts whose structure is not as it must be."""
    rules = {"schema_version": F.col("schema_version") == INTAKE_SCHEMA, "vex_format": F.col("vex_format").isin(CYCLONEDX, OPENVEX), "issuer_id": F.col("issuer_id") != ""}
    rules |= {c: F.length(c) == 64 for c in ("vex_document_sha256", "signature_sha256", "statements_canonical_sha256", "binary_sha256")}
    rules |= {"statement_count": F.col("statement_count") > 0, "narrowing_eligible_count": F.col("narrowing_eligible_count").between(F.lit(0), F.col("statement_count"))}
    return violations(receipts, "vex_document_sha256", rules)


def binding_violations(receipts: DataFrame, statements: DataFrame) -> DataFrame:
    """(vex_document_sha256, rule): what of a receipt its document's statements, read afresh, do not bear out; "document" where there are none."""
    none = receipts.sparkSession.createDataFrame([], "vex_document_sha256 string, signature_sha256 string, binary_sha256 string")
    fields = ("vex_format", "issuer_id", "statement_count", "narrowing_eligible_count", "statements_canonical_sha256")
    # One receipt a document is left of each side's statements, and what was shuffled for the one goes before the other is read.
    receipts = checkpointed(receipts)
    now = checkpointed(intake_receipts(statements, none).select("vex_document_sha256", *(F.col(f).alias(f"now_{f}") for f in fields)))
    both = receipts.join(now, "vex_document_sha256", "left")
    gone = F.col("now_statement_count").isNull()
    broken = F.array_compact(F.array(F.when(gone, "document"), *(F.when(~gone & ~F.col(f).eqNullSafe(F.col(f"now_{f}")), f) for f in fields)))
    return both.select("vex_document_sha256", F.explode(broken).alias("rule")).unionByName(receipt_violations(receipts)).distinct()


def decision_json() -> Column:
    """A decision as its document holds it; pointers are JSON already."""
    tail = F.to_json(F.struct(F.col("purl").alias("product_purl"), F.col("reason").alias("rejection_reason")), {"ignoreNullFields": "false"})
    head = F.to_json(F.struct(F.col("narrowed").alias("narrowed_by_trusted_vex"), F.lit(True).alias("original_hit_preserved"), F.col("original_status")), {"ignoreNullFields": "false"})
    ends = F.to_json(F.struct("vulnerability_id"))
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    return F.concat(F.lit("{"), inner(head), F.lit(","), inner(tail), F.lit(',"vex_pointers":'), F.col("vex_pointers"), F.lit(","), inner(ends), F.lit("}"))


def decision_hashes(decisions: DataFrame) -> DataFrame:
    """(handoff_id, sha256): hash of each document's decisions in the order of its hits."""
    return list_sha256(decisions, "handoff_id", decision_json(), ["position"])


def reconcile_id(handoff_id: Column, cyclonedx_sha256: Column, statements_sha256: Column, hits_sha256: Column) -> Column:
    return F.sha2(F.concat_ws("\n", handoff_id, cyclonedx_sha256, statements_sha256, hits_sha256), 256)


def narrowing_counts(decisions: DataFrame) -> DataFrame:
    """One row: hits, narrowed and retained ones by reason; narrowed and retained add up to all."""
    return decisions.agg(
        F.count(F.lit(1)).alias("hits"), F.count_if("narrowed").alias("narrowed"), F.count_if(~F.col("narrowed")).alias("retained"),
        F.count_if(F.col("reason") == NO_MATCH).alias("no_match"), F.count_if(F.col("reason") == CONTRADICTORY).alias("contradictory"),
    )


def narrowing_receipts(decisions: DataFrame, bindings: DataFrame) -> DataFrame:
    """One receipt per handoff of ``decisions``.

    bindings: handoff_id, source_binding_status, vex_document_sha256, signature_sha256, issuer_id,
    statements_canonical_sha256, narrowing_eligible_count, matcher_hits_sha256, operator_max_receipt_age_days.
    """
    # Hash and counts come from one reading of the decisions.
    read = list_sha256(decisions, "handoff_id", decision_json(), ["position"], tally=("cyclonedx_sha256", "narrowed")).select("handoff_id", F.col("sha256").alias("decisions_canonical_sha256"), F.explode("tally").alias("t"))
    counts = read.select("handoff_id", F.col("t.value").alias("cyclonedx_sha256"), F.col("t.rows").alias("total_hits"), F.col("t.flagged").alias("narrowed_count"), (F.col("t.rows") - F.col("t.flagged")).alias("not_narrowed_count"), "decisions_canonical_sha256")
    rows = counts.join(bindings, "handoff_id")
    own = reconcile_id(F.col("handoff_id"), F.col("cyclonedx_sha256"), F.col("statements_canonical_sha256"), F.col("matcher_hits_sha256"))
    return rows.select(
        F.lit(NARROWING_SCHEMA).alias("schema_version"), F.lit(CLASSIFICATION).alias("classification"), own.alias("reconcile_id"), F.lit(DIRECTION).alias("direction"), F.lit(FACT_WRITE).alias("fact_write"),
        F.lit(True).alias("original_handoff_untouched"), "handoff_id", "cyclonedx_sha256", "source_binding_status", "issuer_id", "vex_document_sha256", "signature_sha256", "statements_canonical_sha256",
        "narrowing_eligible_count", "operator_max_receipt_age_days", "matcher_hits_sha256", "total_hits", "narrowed_count", "not_narrowed_count", "decisions_canonical_sha256",
    )


def narrowing_receipt_violations(receipts: DataFrame) -> DataFrame:
    """(handoff_id, rule) of narrowing receipts: fixed values, hashes, counts that add up, and an id that derives from what it binds."""
    own = reconcile_id(F.col("handoff_id"), F.col("cyclonedx_sha256"), F.col("statements_canonical_sha256"), F.col("matcher_hits_sha256"))
    rules = {
        "schema_version": F.col("schema_version") == NARROWING_SCHEMA, "classification": F.col("classification") == CLASSIFICATION, "direction": F.col("direction") == DIRECTION, "fact_write": F.col("fact_write") == FACT_WRITE,
        "original_handoff_untouched": F.col("original_handoff_untouched"), "handoff_id": F.col("handoff_id") != "", "source_binding_status": F.col("source_binding_status").isNotNull(), "issuer_id": F.col("issuer_id") != "",
        **{c: is_sha256(F.col(c)) for c in ("cyclonedx_sha256", "vex_document_sha256", "signature_sha256", "statements_canonical_sha256", "matcher_hits_sha256", "decisions_canonical_sha256", "reconcile_id")},
        "narrowing_eligible_count": F.col("narrowing_eligible_count") >= 0, "operator_max_receipt_age_days": F.col("operator_max_receipt_age_days") >= 0,
        "counts": (F.least("total_hits", "narrowed_count", "not_narrowed_count") >= 0) & (F.col("narrowed_count") + F.col("not_narrowed_count") == F.col("total_hits")), "rederived": F.col("reconcile_id") == own,
    }
    return violations(receipts, "handoff_id", rules)
