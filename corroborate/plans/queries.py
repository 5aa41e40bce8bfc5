"""Named queries: each runs an operator over the carriers. Lists are joined into strings so that rows compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions import document
from corroborate.functions import text as fx
from corroborate.operators import binding, cluster, evaluation, evidence, export, gaps, imagegraph, nested, observation, pinned, profiles, provenance, receipts, reconcile, registry, relations, release, rules, vex
from corroborate.plans.carriers import spark_view
from corroborate.sources import image
from corroborate.storage import checkpointed

QUERIES = {}


def query(f):
    """Register a query: its parameters after the first name carriers."""
    names = f.__code__.co_varnames[: f.__code__.co_argcount]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*(spark_view(spark, sf_dir, n) for n in names))

    QUERIES[f.__name__] = run
    return f


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query
def narrow_hits(hits, vex):
    return joined(_vex.narrow(hits, vex), "pointers").drop("cyclonedx_sha256", "position")


@query
def narrow_counts(hits, vex):
    return _vex.narrowing_counts(_vex.narrow(hits, vex))


@query
def purl_presence_gate(hits, lane_build):
    parts = lane_build.select(F.explode("identifiers").alias("i")).select(F.concat(F.regexp_replace("i", "@.*", ""), F.lit("?arch=a")).alias("purl"))
    return _vex.absent_purls(hits, parts)


@query
def vex_violations(vex):
    return _vex.statement_violations(vex)


@query
def vex_receipt(vex, vex_signatures):
    return _vex.intake_receipts(vex, vex_signatures).drop("statements_canonical_sha256")


@query
def vex_set_hash(vex):
    return _vex.statement_hashes(vex)


@query
def vex_receipt_violations(vex, vex_signatures):
    receipts = _vex.intake_receipts(vex, vex_signatures)
    more = F.when(F.col("vex_document_sha256").endswith("4"), F.col("statement_count") + 1).otherwise(F.col("narrowing_eligible_count"))
    return _vex.receipt_violations(receipts.withColumn("narrowing_eligible_count", more))


def _tampered(vex, vex_signatures):
    """Receipts of documents, three of which no longer say what they did."""
    was = F.col("vex_document_sha256")
    said = vex.withColumn("detail", F.when(was.endswith("8"), F.lit("other")).otherwise(F.col("detail"))).filter(~(was.endswith("2") & (F.col("position") % 9 == 0)))
    return _vex.intake_receipts(said.withColumn("issuer_id", F.when(was.endswith("1"), F.lit("else")).otherwise(F.col("issuer_id"))), vex_signatures.filter("binary_sha256 <> 'short'"))


@query
def vex_binding(vex, vex_signatures):
    return _vex.binding_violations(_tampered(vex, vex_signatures), vex.filter("vex_document_sha256 not like '%5'"))


@query
def narrow_bound(hits, vex, vex_signatures):
    return _vex.narrow_bound(hits, vex, _tampered(vex, vex_signatures)).select("hit_id", "narrowed", "reason", "n_statements")


@query
def hit_violations(hits):
    odd = F.when(F.col("position") % 7 == 0, F.lit("urn:x")).otherwise(F.col("purl"))
    return _vex.hit_violations(hits.withColumn("purl", F.when(F.col("handoff_id").endswith("3"), odd).otherwise(F.col("purl"))), 500)


@query
def narrowing_receipts(hits, vex):
    return _vex.narrowing_receipts(_vex.narrow(hits, vex), _bindings(hits)).drop("decisions_canonical_sha256")


@query
def narrowing_receipt_violations(hits, vex):
    receipts = _vex.narrowing_receipts(_vex.narrow(hits, vex), _bindings(hits))
    receipts = receipts.withColumn("narrowed_count", F.when(F.col("handoff_id") == "h1", F.col("narrowed_count") + 1).otherwise(F.col("narrowed_count")))
    receipts = receipts.withColumn("matcher_hits_sha256", F.when(F.col("handoff_id") == "h2", F.lit("c" * 64)).otherwise(F.col("matcher_hits_sha256")))
    return _vex.narrowing_receipt_violations(receipts.withColumn("direction", F.when(F.col("handoff_id") == "h4", F.lit("OTHER")).otherwise(F.col("direction"))))


def _bindings(hits):
    fixed = {"source_binding_status": "BOUND", "vex_document_sha256": "1" * 64, "signature_sha256": "2" * 64, "issuer_id": "issuer", "statements_canonical_sha256": "3" * 64, "matcher_hits_sha256": "4" * 64}
    return hits.select("handoff_id").distinct().select("handoff_id", *(F.lit(v).alias(k) for k, v in fixed.items()), F.lit(5).alias("narrowing_eligible_count"), F.lit(30).alias("operator_max_receipt_age_days"))


@query
def purl_names(named):
    return named.select("id", fx.purl_canonical(F.col("ref")).alias("canonical"), fx.purl_key(F.col("ref")).alias("purl_key"), fx.cpe_key(F.col("cpe")).alias("cpe_key"), fx.openvex_purl(F.col("ref")).alias("openvex_purl"))


@query
def component_names(named):
    return named.select(
        "id", fx.component_type(F.col("roles")).alias("component_type"), fx.hash_name(F.col("algorithm")).alias("hash_name"), fx.hash_fits(F.col("algorithm"), F.col("digest")).alias("hash_fits"),
        fx.fragment(F.col("ref")).alias("fragment"), fx.stable_id("name", F.col("id"), F.col("name")).alias("stable_id"),
        fx.error_path(F.array(F.lit("components"), F.col("id").cast("string"), F.lit("name"))).alias("error_path"), F.sha2(F.concat_ws("\n", "name", "ref", "cpe"), 256).alias("reconcile_id"),
    )


@query
def uuid_names(named):
    return named.select("id", fx.uuid5_url(F.col("ref")).alias("uuid"))


@query
def scalar_forms(texts):
    letters = F.element_at(F.array(*map(F.lit, ("A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"))), (F.pmod("id", F.lit(7)) + 1).cast("int"))
    code = F.base64(F.encode("safe_id", "UTF-8"))
    return texts.select(
        "id", letters.alias("letters"), fx.column_number(letters).cast("int").alias("column_number"), F.octet_length(F.unbase64(code)).alias("decoded_bytes"), F.sha2(F.unbase64(code), 256).alias("decoded_sha256"),
        F.substring("url", 1, 12).alias("cut"), F.greatest(F.lit(0), F.bround(F.col("id") / F.lit(2.0)).cast("long")).alias("elapsed_ms"),
        F.date_format(F.to_timestamp(F.lit("2026-01-02T03:04:05Z"), "yyyy-MM-dd'T'HH:mm:ssX"), "yyyyMMddHHmmss").alias("stamp"),
    )


@query
def claims_unpivot(lane_build):
    return evidence.claims(lane_build, ["producer", "name", "version"])


@query
def pair_matches(records):
    return cluster.pair_matches(records)


@query
def population(records):
    return joined(cluster.population(records).withColumn("members", F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["lane_id"], s["component_id"])), ",")).drop("sources"), "identifiers", "hashes", "provenances", "roles", "supplier_hashes", "lanes", "conflict_fields", "critical_unknown_fields", "nonblocking_unknown_fields")


@query
def best_match(candidate, records):
    return reconcile.best_matches(candidate, cluster.population(records)).select("candidate_id", "population_id", "score", "n_populations")


@query
def five_state(candidate, records):
    return joined(reconcile.five_states(candidate, cluster.population(records)), "details")


@query
def status_counts(candidate, records):
    return reconcile.status_counts(reconcile.five_states(candidate, cluster.population(records)))


@query
def export_components(records):
    rows = cluster.population(records)
    primary = F.array_min(F.filter("identifiers", lambda i: i.startswith("pkg:")))
    return rows.select("population_id", "name", "version", primary.alias("purl"), fx.component_type(F.col("roles")).alias("type"), F.array_join("hashes", ",").alias("hashes"))


_LISTS = ("details", "claim_ids", "evidence_ids")


def _analysed(records, candidate, lane_edges, candidate_edges, lanes, declared="SYNTHETIC_RECONCILED"):
    return release.analyse(cluster.population(records), candidate, lane_edges, candidate_edges, lanes, declared)


@query
def release_analysis(records, candidate, lane_edges, candidate_edges, lanes):
    return joined(_analysed(records, candidate, lane_edges, candidate_edges, lanes), *_LISTS)


@query
def release_counts(records, candidate, lane_edges, candidate_edges, lanes):
    return joined(release.counts(_analysed(records, candidate, lane_edges, candidate_edges, lanes, "SYNTHETIC_RECONCILIATION_OPEN")), "blocking_statuses")


@query
def release_relationships(records, lane_edges, lanes):
    return joined(release.relationship_projection(release.relationship_claims(lane_edges, lanes), cluster.population(records)), "lanes", "claim_ids", "evidence_ids")


@query
def unmapped_claims(records, lane_edges, lanes):
    return release.unmapped_claims(release.relationship_claims(lane_edges, lanes), cluster.population(records.filter("component_id not like '%9'")))


@query
def limitations(records):
    return joined(binding.limitations(cluster.population(records)), "fields")


@query
def supplier_conflict(records):
    rows = cluster.population(records).filter(F.array_contains("conflict_fields", "supplier_hash"))
    return joined(rows.select("population_id", "supplier_hashes"), "supplier_hashes")


@query
def export_gate(records, candidate):
    population = checkpointed(cluster.population(records))
    return release.gate_violations(population, reconcile.five_states(candidate, population).select(F.coalesce("population_id", "candidate_id").alias("finding_id"), "status"))


@query
def relationship_conflicts(rel_claims):
    return joined(relations.relationship_conflicts(rel_claims), "details")


@query
def relationship_projection(rel_claims):
    return joined(relations.relationship_projection(rel_claims), "lanes")


@query
def relationship_full_outer(rel_claims, rel_declared, rel_mapping):
    return relations.declared_relationships(rel_claims, rel_declared, rel_mapping)


@query
def dependency_rows(rel_claims):
    refs = rel_claims.select(F.col("src").alias("ref")).union(rel_claims.select("dst"))
    return joined(relations.dependency_rows(refs, rel_claims), "depends_on")


@query
def reference_integrity(rel_declared, rel_mapping):
    edges = rel_declared.unionByName(rel_declared.filter("src like '%1'"))
    return relations.broken_references(edges, rel_mapping.filter("population_id not like '%7'").select(F.col("candidate_id").alias("node")))


@query
def contains_root(installed):
    root = installed.sparkSession.createDataFrame([("image",)], "ref string")
    return relations.contains_edges(root, installed.select(F.col("name").alias("ref")))


@query
def release_diff(release_a, release_b):
    return joined(relations.diff(release_a, release_b, "item", ["version", "producer", "name"]), "changed_fields")


@query
def relation_diff(rel_claims):
    pair = rel_claims.select("src", "rel", "dst")
    return relations.set_difference(pair.filter("src not like '%3'"), pair.filter("dst not like '%2'"))


@query
def image_diff(files_expected, files_observed):
    return joined(relations.diff(files_expected, files_observed, "path", ["sha256"]), "changed_fields")


@query
def file_reconcile(files_expected, files_observed):
    return relations.file_states(files_expected, files_observed)


@query
def package_name_join(installed, described):
    return relations.package_states(installed, described)


@query
def version_conflict(profiles):
    return joined(evidence.version_conflicts(profiles.filter("logical_key is not null")), "versions", "kinds")


@query
def stale_portable(profiles):
    return joined(evidence.stale_portable(profiles.filter("logical_key is not null")), "stale", "reference")


@query
def unidentified(profiles):
    return evidence.unidentified(profiles)


@query
def coverage(profiles):
    return evidence.coverage(profiles.withColumn("version", F.when(F.col("version") == "7", "").otherwise(F.col("version"))), ["logical_key", "version"])


@query
def manifest_totals(manifest):
    return evidence.manifest_totals(manifest)


@query
def exact_set_hash(manifest):
    return evidence.exact_set_hash(manifest)


@query
def manifest_difference(manifest, tree):
    return evidence.manifest_difference(manifest, tree)


@query
def import_gaps(source_files, source_components):
    return gaps.import_gaps(source_files, source_components)


@query
def requirement_refs(source_files):
    return gaps.requirement_references(source_files)


@query
def requirement_gaps(source_files, source_components):
    return gaps.requirement_gaps(source_files, source_components)


@query
def zero_component(source_files, source_components):
    return gaps.zero_components(source_files, source_components)


@query
def exact_keys(json_docs):
    return json_docs.select("event_id", rules.exact_keys(F.col("raw"), ["k"]).alias("exact"))


@query
def rule_violations(texts):
    checks = {
        "text": fx.is_text(F.col("value"), allow_unknown=False), "safe_id": fx.is_safe_id(F.col("safe_id")), "path": fx.is_relative_path(F.col("path")),
        "items": fx.is_unique_texts(F.col("items")), "url": fx.is_https_url(F.col("url")), "ordered": rules.in_order(F.col("items")),
    }
    return rules.violations(texts, "id", checks)


@query
def claim_links(card_claims):
    cited = card_claims.select(F.concat_ws("/", "conflict_id", "claim_id").alias("claim_id"), F.array("evidence_id").alias("evidence_ids"))
    return evidence.dangling_claims(cited, card_claims.filter("evidence_id <> 'ev2'").select("evidence_id").distinct())


@query
def conflict_cards(card_claims):
    return joined(evidence.conflict_cards(card_claims).drop("claims", "bytes"), "claim_ids", "evidence")


@query
def rule_advice(card_claims):
    return joined(evidence.rule_advice(evidence.conflict_cards(card_claims)), "claim_refs", "evidence_refs", "questions")


@query
def advice_violations(card_claims):
    cards = evidence.conflict_cards(card_claims)
    case, none = F.pmod("conflict_id", F.lit(9)), F.array().cast("array<string>")
    advice = evidence.rule_advice(cards).withColumns(
        {
            "claim_refs": F.when(case == 0, F.array(F.lit("cl999"))).when(case == 3, F.concat("claim_refs", "claim_refs")).otherwise(F.col("claim_refs")),
            "evidence_refs": F.when(case.isin(1, 4), none).otherwise(F.col("evidence_refs")),
            "action": F.when(case == 2, "delete_all").when(case == 4, "abstain").otherwise(F.col("action")),
            "explanation": F.when(case == 5, "a\nb").otherwise(F.col("explanation")),
            "questions": F.when(case == 6, F.transform(F.sequence(F.lit(1), F.lit(17)), lambda n: n.cast("string"))).when(case == 7, F.array(F.lit("q"), F.lit("q"))).otherwise(F.col("questions")),
            "authority_boundary": F.when(case == 7, "NONE").otherwise(F.col("authority_boundary")),
        }
    )
    return evidence.advice_violations(advice, cards)


@query
def arm_metrics(arm_results):
    return evidence.arm_metrics(arm_results)


@query
def run_catalogue(run_findings):
    return evidence.run_catalogue(run_findings)


@query
def nested_flatten(nested):
    return _nested.flatten(nested)


@query
def runtime_registry(runtimes):
    return registry.runtime_violations(runtimes)


@query
def issuer_registry(issuers):
    return registry.issuer_violations(issuers)


@query
def image_packages(image_graph):
    return joined(image.packages(image.elements(image_graph)), "identifiers")


@query
def image_files(image_graph):
    return joined(image.expected_files(image.elements(image_graph), "image"), "owners")


@query
def image_dependencies(image_graph):
    return image.runtime_dependencies(image.elements(image_graph))


@query
def image_reference_errors(image_graph):
    return export.spdx_reference_errors(image_graph)


@query
def finding_claims(candidate, records):
    population = checkpointed(cluster.population(records))
    findings = reconcile.five_states(candidate, population).filter("status = 'CONFLICT' and population_id is not null").select(F.col("population_id").alias("finding_id"), "population_id", "details")
    sources = population.select("population_id", F.explode("sources").alias("s")).select("population_id", "s.lane_id", "s.component_id")
    return evidence.finding_claims(findings, sources, evidence.claims(records, ["producer", "name", "version"]))


@query
def run_record(candidate, records):
    return export.run_record(reconcile.five_states(candidate, cluster.population(records)), valid=False)


def _hashed(records):
    """A population whose hashes are hex of their algorithm's length."""
    return cluster.population(records).withColumn("hashes", F.transform("hashes", lambda h: F.concat(F.lit("sha256:"), F.sha2(h, 256))))


@query
def cyclonedx_lines(records):
    return export.cyclonedx_components(_hashed(records), "run-1")


@query
def spdx_packages(records):
    return export.spdx_packages(_hashed(records), "run-1")


@query
def cyclonedx_properties(rel_claims):
    return export.cyclonedx_properties(rel_claims.select("src", "rel", "dst").distinct(), "run-1")


@query
def export_heads(export_release):
    return export.cyclonedx_head(export_release).union(export.spdx_head(export_release))


@query
def export_binding(export_release):
    was = export_release.withColumn("build_id", F.when(F.col("run_id").endswith("7"), F.lit("other")).otherwise(F.col("build_id")))
    now = export_release.withColumn("artifact_sha256", F.when(F.col("run_id").endswith("3"), F.lit("b" * 64)).otherwise(F.col("artifact_sha256"))).filter("run_id not like '%9'")
    return export.pair_violations(export.cyclonedx_head(was), export.spdx_head(now), export_release)


@query
def run_dashboard(records, candidate):
    population = checkpointed(cluster.population(records))
    findings = reconcile.five_states(candidate, population).withColumn("finding_id", F.coalesce("population_id", "candidate_id"))
    return export.dashboard("run-1", population, findings)


@query
def profile_findings(observations):
    return profiles.findings(profiles.evidence(observations))


@query
def profile_evidence(observations):
    return profiles.evidence(observations).select("code", "logical_key", "profile_kind", "bom_ref", "version")


@query
def unidentified_list(observations):
    return profiles.unidentified(observations)


@query
def observation_rules(observations):
    return profiles.observation_violations(observations.withColumn("profile_kind", F.when(F.col("profile_id") == "p-run", "OCI_ARCHIVE").otherwise(F.col("profile_kind"))))


@query
def release_rules(release_records):
    return receipts.release_violations(release_records)


@query
def hash_rules(component_hashes):
    return receipts.hash_violations(component_hashes)


@query
def release_hashes(release_records):
    return receipts.object_hash(release_records, "release_id", ["release_timestamp", "evidence_cutoff", "sbom_author"], "analysis-run")


@query
def profile_cards(observations):
    rested = profiles.evidence(observations)
    return receipts.profile_cards(profiles.findings(rested), rested)


@query
def card_set_hash(card_claims):
    cards = evidence.conflict_cards(card_claims).select((F.col("conflict_id") % 7).cast("string").alias("card_set_id"), "conflict_id", "claims")
    return receipts.card_set_hash(cards)


@query
def attestation_rules(attestations):
    return receipts.attestation_violations(attestations)


@query
def signature_rules(signed):
    return receipts.signature_violations(signed)


@query
def offline_rules(commands):
    return receipts.offline_violations(commands)


@query
def handoffs(inventory_parts, handoff_sources):
    return receipts.handoffs(inventory_parts, handoff_sources)


@query
def handoff_rules(handoff_sources):
    return receipts.handoff_violations(handoff_sources, ("profile-1",))


@query
def arm_differences(arm_results, recorded_arms):
    return receipts.arm_differences(arm_results, recorded_arms)


@query
def package_diff(packages_a, packages_b):
    return image.package_diff(packages_a, packages_b)


@query
def rootfs_totals(rootfs):
    return image.rootfs_totals(rootfs)


@query
def image_analysis(installed, described, files_expected, files_observed):
    return image.analysis(installed, described, files_expected, files_observed)


@query
def nested_components(nested):
    return joined(_nested.components(nested), "hashes")


@query
def projection_rules(nested):
    return _nested.projection_violations(nested)


@query
def spdx_lines(rel_claims):
    return export.spdx_relationships(rel_claims.select("src", "rel", "dst").filter("rel <> 'UNKNOWN'").distinct(), "run-1")


@query
def export_dependency_errors(rel_claims):
    refs = rel_claims.select(F.col("src").alias("ref")).distinct()
    return export.dependency_errors(refs.filter("ref not like '%4'"), relations.dependency_rows(refs.filter("ref not like '%5'"), rel_claims.filter("src not like '%5'")))


@query
def candidate_identifiers(typed):
    none = F.lit(None).cast("string")
    listed = [("PURL", "purl", none), ("SYNTHETIC_URN", "urn", none), ("COMPONENT_ROLE", "role", none), ("PROVENANCE", "provenance", none), ("OBSERVED_HASH", "digest", F.col("algorithm")), ("SUPPLIER_HASH", "purl", F.col("algorithm"))]
    rows = typed.select("candidate_id", F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).alias("value"), a.alias("algorithm")) for t, c, a in listed)).alias("typed"))
    return joined(binding.split_identifiers(rows), "identifiers", "roles", "provenances", "hashes", "supplier_hashes")


@query
def comparison_keys(named):
    return binding.comparison_keys(named.withColumnRenamed("ref", "purl")).select("id", "logical_key")


@query
def timestamp_violations(releases):
    return binding.timestamp_violations(releases)


@query
def document_mismatches(releases, release_evidence):
    return binding.mismatches(releases, release_evidence, "release_id", ["product", "build_id"])


@query
def layer_budget(layers):
    return binding.layer_budget(layers, 600, 15_000)


@query
def arm_coverage(card_claims, arm_cards):
    return binding.arm_coverage(card_claims, arm_cards)


@query
def field_claims(records):
    sources = cluster.population(records).select("population_id", F.explode("sources").alias("s")).select("population_id", "s.lane_id", "s.component_id")
    return joined(binding.field_claims(sources, evidence.claims(records, ["producer", "name", "version"])), "claim_ids")


@query
def decision_set_hash(hits, vex):
    return _vex.decision_hashes(_vex.narrow(hits, vex))


@query
def status_guard(served):
    return binding.status_violations(served)


@query
def namespace_rules(profiles):
    rows = profiles.filter("logical_key is not null").select(F.col("logical_key").alias("profile_id"), "profile_kind", F.lit("n").alias("namespace"))
    return binding.namespaces(rows)


def _exported(records, lane_edges, lanes, one_release):
    """A population of which the record b1 is the root, as its release names it even where evidence differs, and its relationships."""
    population = checkpointed(_hashed(records))
    top = F.exists("sources", lambda s: s["component_id"] == "b1")
    named = one_release.select(F.col("manufacturer").alias("producer"), F.col("product").alias("name"), F.col("product_version").alias("version")).first().asDict()
    population = population.withColumns({"roles": F.when(top, F.array(F.lit("ROOT_PRODUCT"))).otherwise(F.col("roles"))} | {c: F.when(top, F.lit(v)).otherwise(F.col(c)) for c, v in named.items()})
    found = release.relationship_projection(release.relationship_claims(lane_edges, lanes), population).filter("relationship <> 'UNKNOWN'")
    return population, checkpointed(found.select(F.col("source_population_id").alias("src"), F.col("relationship").alias("rel"), F.col("target_population_id").alias("dst"), "relationship_id", "evidence_ids"))


@query
def export_resolves(records, lane_edges, lanes, one_release):
    lines = export.spdx_document(*_exported(records, lane_edges, lanes, one_release), one_release)
    errors = export.spdx_reference_errors(lines.select(F.col("line").alias("raw")))
    return lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).union(errors.agg(F.lit("unresolved"), F.count(F.lit(1))))


@query
def cyclonedx_document(records, lane_edges, lanes, one_release):
    lines = checkpointed(export.cyclonedx_document(*_exported(records, lane_edges, lanes, one_release), one_release))
    field = lambda path: F.get_json_object("line", path)
    refs = lines.filter("part in ('head', 'components')").select(F.coalesce(field("$.metadata.component.bom-ref"), field("$.bom-ref")).alias("ref"))
    rows = lines.filter("part = 'dependencies'").select(field("$.ref").alias("ref"), F.from_json(field("$.dependsOn"), "array<string>").alias("depends_on"))
    counted = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.concat_ws(" ", field("$.metadata.component.name"), field("$.metadata.component.type"))).alias("root"))
    return counted.union(export.dependency_errors(refs, rows).agg(F.lit("errors"), F.count(F.lit(1)), F.lit("")))


@query
def release_graph_diff(records_a, records_b, lane_edges_a, lane_edges_b, lanes):
    before, after = (checkpointed(cluster.population(r)) for r in (records_a, records_b))
    edges = [release.relationship_projection(release.relationship_claims(e, lanes), p) for e, p in ((lane_edges_a, before), (lane_edges_b, after))]
    components = release.component_changes(before, after).select(F.lit("component").alias("kind"), F.array_join("source_component_ids", ",").alias("subject"), "change", F.array_join("changed_fields", ",").alias("changed_fields"), "previous", "current")
    none = F.lit(None).cast("string")
    between = release.relationship_changes(before, after, *edges).select(F.lit("relationship"), F.concat_ws("|", F.array_join("from", ","), "relationship", F.array_join("to", ",")), "change", F.lit(""), none, none)
    return components.union(between)


def _graph(*parts):
    return imagegraph.derive(*parts)


@query
def image_evidence(img_images, img_inputs):
    return imagegraph.evidence(img_images, img_inputs)


@query
def image_heads(img_images, img_inputs):
    return imagegraph.heads(img_images, img_inputs)


@query
def image_graph_lines(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    return imagegraph.lines(_graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends))


@query
def image_summary(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    graph = _graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends)
    return joined(imagegraph.summary(graph, img_expected, img_observed), "blocking_statuses")


@query
def image_projections(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    graph = _graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends)
    release_rows = imagegraph.release_projection(graph, imagegraph.summary(graph, img_expected, img_observed))
    return release_rows.select("image", F.lit("release").alias("kind"), F.col("release_id").alias("subject"), F.concat_ws(" ", "product", "product_version", "build_id", "artifact_sha256", "status").alias("said")).union(
        imagegraph.component_projection(graph).select("image", F.lit("component"), "population_id", F.concat_ws(" ", "name", "status"))
    )


def _recorded(lines):
    """What might be recorded of a graph: packages of other versions, relationships that are gone, findings that were renamed with their status, and rows that repeat."""
    kind, id_ = F.col("kind"), F.col("id")
    other = F.regexp_replace("line", '"version":"[^"]*"', '"version":"0"')
    status = F.regexp_replace("line", '"status":"CONFLICT"', '"status":"MATCHED"')
    rows = lines.filter(~((kind == "relationship") & id_.like("%0")))
    rows = rows.withColumn("line", F.when((kind == "population") & id_.like("%1"), other).when((kind == "file") & id_.like("%2"), status).otherwise(F.col("line")))
    renamed = (kind == "component") & id_.like("%3")
    rows = rows.withColumn("id", F.when(renamed, F.concat(F.lit("x-"), "id")).otherwise(id_))
    return rows.unionByName(rows.filter((kind == "field") & id_.like("%4")))


@query
def image_graph_differences(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    lines = imagegraph.lines(_graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends))
    return imagegraph.differences(lines, _recorded(lines))


@query
def image_misnamed(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    lines = imagegraph.lines(_graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends))
    return imagegraph.misnamed(_recorded(lines))


@query
def image_canonical(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    return imagegraph.canonical_hashes(imagegraph.lines(_graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends)))


def _named(heads):
    """A short stand-in for the hash of each image's lines."""
    return heads.select("image", F.sha2(F.concat(F.lit("canonical "), F.col("image").cast("string")), 256).alias("canonical_sha256"))


@query
def image_cyclonedx(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    graph = _graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends)
    return imagegraph.cyclonedx(graph, _named(graph.heads))


@query
def image_spdx(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    graph = _graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends)
    return imagegraph.spdx(graph, _named(graph.heads)).filter("part <> 'membership'")


@query
def semantic_hash(json_bodies):
    raw = F.col("raw")
    return json_bodies.select("doc", document.canonical_sha256(raw).alias("canonical"), document.semantic_sha256(raw).alias("semantic"), document.semantic_sha256(raw, [], ["serial_number", "run_id"]).alias("stable"), F.sha2(document.without_top(document.canonical_text(raw), ["serial_number", "run_id"]), 256).alias("body"))


@query
def candidate_round_trip(candidate_lists):
    return candidate_lists.select("doc", F.array_join(document.candidate_errors(F.col("raw")), ",").alias("errors"))


def _scanner(version):
    return F.struct(F.lit("syft").alias("name"), version.alias("version"), F.lit("c" * 64).alias("binary_sha256"), F.lit("d" * 64).alias("config_sha256")).alias("scanner")


def _observed(obs_profiles, obs_heads, obs_components, obs_dependencies):
    own = obs_profiles.select("*", _scanner(F.col("scanner_version"))).drop("scanner_version")
    return observation.sealed(own, obs_heads.join(own.select("profile_id", "scanner"), "profile_id"), obs_components, obs_dependencies)


@query
def observations_sealed(obs_profiles, obs_heads, obs_components, obs_dependencies):
    rows = _observed(obs_profiles, obs_heads, obs_components, obs_dependencies)
    return rows.select("profile_id", "canonical_sha256", "run_id", F.col("cyclonedx_evidence.semantic_sha256").alias("semantic_sha256"))


@query
def observation_envelope_rules(obs_profiles, obs_heads, obs_components, obs_dependencies):
    rows = checkpointed(_observed(obs_profiles, obs_heads, obs_components, obs_dependencies))
    changed = rows.withColumn("release_status", F.when(F.col("profile_id").endswith("5"), "RELEASED").otherwise(F.col("release_status")))
    return observation.observation_violations(changed)


@query
def scan_profile_rules(obs_profiles):
    return observation.profile_violations(obs_profiles.select("*", _scanner(F.col("scanner_version"))))


@query
def scan_validation(obs_profiles, obs_heads, obs_components, obs_dependencies):
    return observation.validation_rows(_observed(obs_profiles, obs_heads, obs_components, obs_dependencies)).drop("semantic_sha256")


def _pins(files):
    return files.select("path", F.sha2("raw", 256).alias("sha256"), "max_bytes", "kind")


def _bytes(files):
    return files.select("path", F.octet_length("raw").alias("size"), F.encode("raw", "UTF-8").alias("content"))


@query
def registry_load(reg_files):
    case = F.pmod(F.regexp_extract("path", "([0-9]+)", 1).cast("int"), F.lit(11))
    seen = reg_files.withColumn("raw", F.when(case == 1, F.concat("raw", F.lit(" "))).otherwise(F.col("raw"))).filter(case != 7)
    pins = _pins(reg_files).withColumn("kind", F.when(case == 3, "vex-issuer-registry").otherwise(F.col("kind"))).filter(case != 6)
    return pinned.load(_bytes(seen), pins).select("path", "kind", "problem", F.col("body").isNotNull().alias("admitted"))


@query
def registry_entries(reg_files, reg_sources):
    files = reg_files.unionByName(reg_sources)
    loaded = checkpointed(pinned.load(_bytes(files), _pins(files)))
    return pinned.entry_violations(loaded)


@query
def registry_entry_hashes(reg_files):
    loaded = pinned.load(_bytes(reg_files), _pins(reg_files))
    return pinned.entries(loaded, "image-profile-registry").select("path", "position", "entry_sha256")


@query
def image_profile_rules(image_profiles, image_payloads):
    lane = lambda name, domain, fixed: F.struct(F.col(name).alias("lane_id"), F.lit(fixed[0]).alias("adapter_id"), domain.alias("independence_domain"))
    rows = image_profiles.withColumns({"build": lane("build_lane", F.col("build_domain"), imagegraph.BUILD), "artifact": lane("artifact_lane", F.lit("ARTIFACT_OBSERVATION"), imagegraph.ARTIFACT)})
    return imagegraph.profile_violations(rows, image_payloads)


@query
def issuer_lookups(vex_signatures, issuers):
    asked = vex_signatures.select("vex_document_sha256", F.concat(F.lit("is"), F.regexp_extract("vex_document_sha256", "^0*([0-9]+)$", 1)).alias("issuer_id"))
    return registry.lookups(asked, issuers.union(issuers.filter("issuer_id like '%3'")), "issuer_id", F.col("status") == "ADMITTED_FOR_VEX_INTAKE")


@query
def conflict_lookups(arm_cards, card_claims):
    return registry.lookups(arm_cards, card_claims.select("conflict_id", "claim_id").filter("claim_id = 'cl100' or conflict_id % 5 = 0"), "conflict_id")


@query
def profile_lookups(handoff_sources, obs_profiles):
    asked = handoff_sources.select("source_run_id", F.regexp_replace("source_run_id", "run-", "prof-").alias("profile_id"))
    trusted = obs_profiles.filter("independence_domain <> 'SPOOFED'")
    return registry.lookups(asked, trusted.union(trusted.filter("profile_id like '%7'")), "profile_id")


@query
def finding_provenance(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends):
    graph = _graph(img_images, img_inputs, img_manifest, img_native, img_expected, img_observed, img_depends)
    return provenance.finding_files(graph.findings, imagegraph.evidence(img_images, img_inputs)).drop("finding_id", "lane_id").groupBy("image", "role", "relative_path", "sha256", "size").agg(F.count(F.lit(1)).alias("findings"))


@query
def input_records(export_release):
    return provenance.input_records(export_release)


@query
def tool_records(lane_edges, lanes):
    kinds = lane_edges.select("lane_id", F.concat(F.lit("run-"), F.substring("src", 2, 2)).alias("run_id")).distinct()
    return provenance.tool_records(kinds.select("run_id", F.lit("c").alias("classification"), "lane_id", F.concat(F.lit("adapter-"), "lane_id").alias("adapter_id"), F.lit("1.0").alias("adapter_version"), F.upper("lane_id").alias("independence_domain")))


@query
def evaluation_differences(card_claims):
    cards = checkpointed(evidence.conflict_cards(card_claims))
    case = F.pmod("conflict_id", F.lit(8))
    none = F.lit(None).cast("string")
    advice = evidence.rule_advice(cards).withColumn("action", F.when(case.isin(3, 7), "delete_all").otherwise(F.col("action")))
    text = F.to_json(F.struct("action", "authority_boundary", "claim_refs", "evidence_refs", "explanation", "questions"))
    rows = advice.select("conflict_id", text.alias("advice"))
    response = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.struct(F.col("advice").alias("content")).alias("message"))).alias("choices")))
    changed = F.when(case == 1, F.regexp_replace("response", "claims differ", "claims diffeR")).otherwise(F.col("response"))
    failed = case.isin(4, 6, 7)
    rows = rows.withColumn("response", response).select(
        F.lit("model:m").alias("arm_id"), F.lit("m").alias("model_id"), "conflict_id", F.when(failed, evaluation.FAILED).otherwise(evaluation.VALID).alias("status"), F.lit(5).alias("elapsed_ms"),
        F.when(case == 2, F.regexp_replace("advice", "claims differ", "claims agree")).when(~failed, F.col("advice")).alias("advice"), F.when(~failed, F.sha2("advice", 256)).alias("advice_sha256"),
        F.when(case == 5, "***").when(case != 6, F.base64(F.encode(changed, "UTF-8"))).alias("payload"), F.octet_length("response").alias("byte_count"), F.sha2("response", 256).alias("response_sha256"), F.when(case == 6, F.when(F.col("conflict_id") % 16 == 6, "ModelDisabledError").otherwise("Odd")).otherwise(none).alias("error_type"),
    )
    rows = rows.withColumn("payload", F.regexp_replace("payload", "[\r\n]", "")).filter(F.pmod("conflict_id", F.lit(40)) != 32)
    spark = cards.sparkSession
    recorded = spark.createDataFrame([("model:m", -1, -1, 1.0)], "arm_id string, results long, valid long, rate double")
    gates = spark.createDataFrame([*evaluation.GATES.items(), ("safety_gate", "PASS")], "gate string, value string")
    return evaluation.evaluation_differences(rows, cards, recorded, gates)


_vex, _nested = vex, nested
