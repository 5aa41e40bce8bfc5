"""Inventory, statement and image documents as tables, from their JSON text (doc, raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import UNKNOWN, openvex_purl, purl_canonical
from corroborate.operators.nested import flatten
from corroborate.operators.vex import CYCLONEDX, OPENVEX

_PROVENANCE = "struct<kind: string, locator: string, source_available: boolean>"
_HASH = "struct<algorithm: string, value: string>"
LANE = f"""lane_id string, source_kind string, subject struct<producer: string, name: string, version: string, identifiers: array<string>, role: string>,
    artifact struct<relative_path: string, sha256: string>, relationships array<struct<`from`: string, type: string, to: string>>,
    components array<struct<component_id: string, component_role: string, producer: string, name: string, version: string, identifiers: array<string>,
    provenance: {_PROVENANCE}, observed_hash: {_HASH}, supplier_hash: {_HASH}>>"""


def _concrete_list(values):
    return F.filter(values, lambda v: v.isNotNull() & (v != UNKNOWN))


def lane_records(documents: DataFrame) -> DataFrame:
    """Matching records of evidence lanes: the subject as a root row, and every component."""
    data = documents.select(F.from_json("raw", LANE, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    known = lambda c: F.coalesce(c, F.lit(UNKNOWN))
    root = data.select(
        "lane_id", F.lit("ROOT").alias("component_id"), known(F.col("subject.producer")).alias("producer"), known(F.col("subject.name")).alias("name"), known(F.col("subject.version")).alias("version"),
        _concrete_list(F.col("subject.identifiers")).alias("identifiers"), F.array(F.concat(F.lit("SHA-256:"), "artifact.sha256")).alias("hashes"),
        F.array().cast("array<string>").alias("provenances"), _concrete_list(F.array("subject.role")).alias("roles"), F.array().cast("array<string>").alias("supplier_hashes"),
    )
    c = data.select("lane_id", F.explode("components").alias("c"))
    rows = c.select(
        "lane_id", "c.component_id", known(F.col("c.producer")).alias("producer"), known(F.col("c.name")).alias("name"), known(F.col("c.version")).alias("version"),
        _concrete_list(F.coalesce("c.identifiers", F.array().cast("array<string>"))).alias("identifiers"),
        F.array_compact(F.array(F.when(F.nullif(F.col("c.observed_hash.algorithm"), F.lit(UNKNOWN)).isNotNull() & F.nullif(F.col("c.observed_hash.value"), F.lit(UNKNOWN)).isNotNull(), F.concat_ws(":", "c.observed_hash.algorithm", "c.observed_hash.value")))).alias("hashes"),
        F.array_compact(F.array(F.when(F.nullif(F.col("c.provenance.kind"), F.lit(UNKNOWN)).isNotNull() & F.nullif(F.col("c.provenance.locator"), F.lit(UNKNOWN)).isNotNull(), F.concat_ws(":", "c.provenance.kind", "c.provenance.locator")))).alias("provenances"),
        _concrete_list(F.array("c.component_role")).alias("roles"),
        F.array_compact(F.array(F.when(F.col("c.supplier_hash").isNotNull(), F.concat_ws(":", known(F.col("c.supplier_hash.algorithm")), known(F.col("c.supplier_hash.value")))))).alias("supplier_hashes"),
    )
    return root.unionByName(rows)


def lane_relationships(documents: DataFrame) -> DataFrame:
    """(lane_id, src, rel, dst) of evidence lanes."""
    data = documents.select(F.from_json("raw", LANE, {"mode": "FAILFAST"}).alias("d")).select("d.lane_id", F.explode("d.relationships").alias("r"))
    return data.select("lane_id", F.col("r.from").alias("src"), F.col("r.type").alias("rel"), F.col("r.to").alias("dst"))


def cyclonedx_components(documents: DataFrame) -> DataFrame:
    """Every component of CycloneDX documents, nested ones included: doc, ref, parent, depth, name."""
    return flatten(documents)


_OPENVEX = "array<struct<vulnerability: struct<name: string, `@id`: string>, products: array<struct<`@id`: string>>, status: string, justification: string, impact_statement: string, action_statement: string>>"
_CYCLONEDX_VEX = "array<struct<id: string, analysis: struct<state: string, justification: string, detail: string, firstIssued: string, lastUpdated: string>, affects: array<struct<ref: string>>>>"


def statements(documents: DataFrame, issuer: str = "") -> DataFrame:
    """The statements (as of operators.vex) of OpenVEX and CycloneDX documents; one that is neither, or has no statement, raises an error.

    An OpenVEX product is a package URL as it stands, a CycloneDX reference in its canonical form.
    """
    openvex = F.coalesce(F.get_json_object("raw", "$['@context']").contains("openvex"), F.lit(False))
    kind = F.when(openvex, OPENVEX).when(F.get_json_object("raw", "$.bomFormat") == "CycloneDX", CYCLONEDX).otherwise(F.raise_error(F.concat(F.lit("no statement document: "), "doc")))
    found = documents.select("doc", "raw", F.sha2("raw", 256).alias("vex_document_sha256"), kind.alias("vex_format"))
    full = lambda c: F.nullif(c, F.lit(""))
    sorted_set = lambda a: F.array_sort(F.array_distinct(F.array_compact(a)))

    def listed(field: str, schema: str) -> Column:
        each = F.from_json(F.get_json_object("raw", f"$.{field}"), schema)
        return F.posexplode(F.when(F.coalesce(F.size(each), F.lit(0)) > 0, each).otherwise(F.raise_error(F.concat(F.lit("no statements: "), "doc")))).alias("position", "s")

    head = [F.col("vex_document_sha256"), F.col("position").cast("long").alias("position"), F.lit(issuer).alias("issuer_id"), F.concat_ws("#", "doc", "position").alias("statement_id"), F.col("vex_format")]
    none = F.lit(None).cast("string")
    left = found.filter(F.col("vex_format") == OPENVEX).select("doc", "vex_document_sha256", "vex_format", listed("statements", _OPENVEX)).select(
        *head, F.coalesce(full(F.col("s.vulnerability.name")), F.col("s.vulnerability")["@id"]).alias("vulnerability_id"), "s.status", "s.justification",
        F.coalesce(full(F.col("s.impact_statement")), F.col("s.action_statement")).alias("detail"), none.alias("first_issued_utc"), none.alias("last_updated_utc"),
        sorted_set(F.transform("s.products", lambda p: openvex_purl(p["@id"]))).alias("purls"),
    )
    right = found.filter(F.col("vex_format") == CYCLONEDX).select("doc", "vex_document_sha256", "vex_format", listed("vulnerabilities", _CYCLONEDX_VEX)).select(
        *head, F.col("s.id").alias("vulnerability_id"), F.col("s.analysis.state").alias("status"), F.col("s.analysis.justification").alias("justification"), F.col("s.analysis.detail").alias("detail"),
        F.col("s.analysis.firstIssued").alias("first_issued_utc"), F.col("s.analysis.lastUpdated").alias("last_updated_utc"), sorted_set(F.transform("s.affects", lambda a: purl_canonical(a["ref"]))).alias("purls"),
    )
    return left.unionByName(right)


_HITS = "struct<source: struct<matcher_name: string, matcher_version: string, handoff_id: string, cyclonedx_sha256: string>, hits: array<struct<vulnerability_id: string, product_purl: string, original_status: string>>>"


def matcher_hits(documents: DataFrame, most_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Hits (as of operators.vex) of matcher documents (doc, raw) with just the fields that they must have; others, and larger ones, raise an error.

    What the fields say is judged by vex.hit_violations().
    """
    exact = lambda raw, keys: F.coalesce(F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, keys)), F.lit(False))
    each = F.from_json(F.get_json_object("raw", "$.hits"), "array<string>")
    fine = exact(F.col("raw"), ["hits", "source"]) & exact(F.get_json_object("raw", "$.source"), ["cyclonedx_sha256", "handoff_id", "matcher_name", "matcher_version"])
    fine = fine & each.isNotNull() & F.forall(each, lambda h: exact(h, ["original_status", "product_purl", "vulnerability_id"])) & (F.octet_length("raw") <= most_bytes)
    data = documents.select("doc", F.from_json(F.when(fine, F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("no matcher hits: "), "doc"))), _HITS, {"mode": "FAILFAST"}).alias("d"))
    rows = data.select("doc", "d.source", F.posexplode("d.hits").alias("position", "h"))
    return rows.select(
        "source.handoff_id", "source.cyclonedx_sha256", F.col("position").cast("long").alias("position"), F.concat_ws("#", "doc", "position").alias("hit_id"), "h.vulnerability_id", purl_canonical(F.col("h.product_purl")).alias("purl"), "h.original_status"
    )
