"""Graphs of built images: derived from their parts, exported, and derived again to check recorded ones.

Parts, one row of many images each:
images: image, profile_id, profile_sha256, image_name, upstream_release, build_id, architecture, release_timestamp, reference_builder, build_lane, artifact_lane;
inputs: image, role, relative_path, sha256, url, size, media_type;
manifest: image, name, architecture, version; native: image, source_id, name, version, producer, identifiers (as sources.image.packages());
expected: image, path, sha256, owners; observed: image, path, sha256; depends: image, src, dst (source ids).

Every element is named by its content, so a graph that is recorded elsewhere is checked by one
full join of element ids: nothing is compared as a document.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import NAMESPACE, UNKNOWN, canonical_json, fully, is_https_url, is_relative_path, is_safe_id, is_sha256, is_text, stable_id, uuid5_url
from corroborate.operators.hashing import list_sha256, tree_sha256
from corroborate.operators.reconcile import STATES
from corroborate.operators.relations import dependency_rows
from corroborate.operators.rules import violations
from corroborate.storage import checkpointed

# Adapters and domains of the two lanes, roles of inputs, formats of ids and statuses.
ADAPTER_VERSION = "1.0.0"
BUILD = ("yocto-spdx-3.0.1-build-metadata", "BUILD_METADATA")
ARTIFACT = ("rootfs-tar-artifact-observation", "ARTIFACT_OBSERVATION")
ROLES = ("build_spdx", "image_manifest", "qemuboot", "rootfs_archive", "testdata")
MANIFEST_URN, ROOT_URN = "urn:yocto-manifest:", "urn:yocto-reference:"
RUN_PREFIX, EVIDENCE_PREFIX, FINDING_PREFIX = "yocto-reference-run", "yocto-evidence", "yocto-finding"
ROOT, PACKAGE = "REFERENCE_IMAGE_ROOT", "RUNTIME_PACKAGE"
TECHNICAL = {"OPEN": "REFERENCE_RECONCILIATION_OPEN", "CLOSED": "REFERENCE_RECONCILIATION_CLOSED_NOT_GROUND_TRUTH"}
CLASSIFICATION, CANDIDATE, NO_STATUS = "PUBLIC_BUILD_REFERENCE_NOT_CUSTOMER_EVIDENCE", "GENERATOR_OUTPUT_CANDIDATE", "NO_PRODUCT_CONFORMITY_STATUS"
SPDX_NAMES = {"CONTAINS": "contains", "DEPENDS_ON": "dependsOn"}

#: Fields of each kind of element, and the one that names it.
FIELDS = {
    "population": ("population_id", "architecture critical_unknown_fields discovery_lanes evidence_ids file_paths identifiers kind name population_id producer producer_evidence_ids roles version"),
    "relationship": ("relationship_id", "evidence_ids relationship relationship_id source_population_id target_population_id"),
    "component": ("finding_id", "candidate_source_id details evidence_ids finding_id finding_type population_id status"),
    "field": ("finding_id", "details evidence_ids field finding_id finding_type population_id status"),
    "file": ("finding_id", "details evidence_ids expected_sha256 finding_id finding_type observed_sha256 path status"),
}
KINDS = {"COMPONENT_IDENTITY": "component", "COMPONENT_FIELD": "field", "ROOTFS_FILE": "file"}


class Graph(NamedTuple):
    """``heads`` (a row per image), ``population``, ``relationships`` and ``findings`` of all kinds."""

    heads: DataFrame
    population: DataFrame
    relationships: DataFrame
    findings: DataFrame


def _none() -> Column:
    return F.array().cast("array<string>")


def _sorted(*columns: str) -> Column:
    return F.array_sort(F.array(*columns))


def evidence(images: DataFrame, inputs: DataFrame) -> DataFrame:
    """``inputs`` with lane_id, adapter_id, independence_domain, hash_kind and the evidence_id that names them."""
    rows = inputs.join(images.select("image", "build_lane", "artifact_lane"), "image")
    archive = F.col("role") == "rootfs_archive"
    lane, adapter, domain = F.when(archive, F.col("artifact_lane")).otherwise(F.col("build_lane")), F.when(archive, ARTIFACT[0]).otherwise(BUILD[0]), F.when(archive, ARTIFACT[1]).otherwise(BUILD[1])
    rows = rows.select("image", "role", "relative_path", "sha256", "url", "size", "media_type", lane.alias("lane_id"), adapter.alias("adapter_id"), domain.alias("independence_domain"), F.when(archive, "RELEASE_ARTIFACT_HASH").otherwise("BUILD_OBSERVED_HASH").alias("hash_kind"))
    body = ["adapter_id", F.lit(ADAPTER_VERSION).alias("adapter_version"), "independence_domain", "lane_id", "relative_path", "role", "sha256"]
    return rows.withColumn("evidence_id", stable_id(EVIDENCE_PREFIX, *body))


def heads(images: DataFrame, inputs: DataFrame) -> DataFrame:
    """``images`` with the evidence ids of the inputs, the archive's hash and the run_id; an image without just one input of each role is an error."""
    found = evidence(images, inputs).groupBy("image").agg(
        F.array_sort(F.collect_list("role")).alias("roles"),
        *(F.max(F.when(F.col("role") == role, F.col("evidence_id"))).alias(name) for role, name in (("build_spdx", "build_evidence"), ("image_manifest", "manifest_evidence"), ("rootfs_archive", "artifact_evidence"))),
        F.max(F.when(F.col("role") == "rootfs_archive", F.col("sha256"))).alias("artifact_sha256"),
        F.array_sort(F.collect_list(F.when(F.col("role") != "rootfs_archive", F.col("evidence_id")))).alias("build_ids"),
        F.sort_array(F.collect_list(F.struct("role", F.struct("media_type", "relative_path", "role", "sha256", "size", "url").alias("said")))).alias("inputs"),
    )
    rows = images.join(found, "image", "left")
    whole = F.when(F.col("roles") == F.array(*map(F.lit, ROLES)), F.col("image")).otherwise(F.raise_error(F.concat(F.lit("inputs of image "), F.col("image").cast("string"))))
    lane = lambda name, ids, fixed: F.struct(F.lit(fixed[0]).alias("adapter_id"), F.lit(ADAPTER_VERSION).alias("adapter_version"), ids.alias("evidence_ids"), F.lit(fixed[1]).alias("independence_domain"), F.col(name).alias("lane_id"))
    both = F.array_sort(F.array(lane("build_lane", F.col("build_ids"), BUILD), lane("artifact_lane", F.array("artifact_evidence"), ARTIFACT)), lambda a, b: F.when(a["lane_id"] < b["lane_id"], -1).otherwise(1))
    run_id = stable_id(RUN_PREFIX, F.transform("inputs", lambda x: x["said"]).alias("inputs"), both.alias("lanes"), "profile_id", "profile_sha256")
    return rows.select(whole.alias("image"), *(c for c in images.columns if c != "image"), "build_evidence", "manifest_evidence", "artifact_evidence", "artifact_sha256", run_id.alias("run_id"))


def _finding(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with finding_type and the finding_id that names their content; fields of other kinds are null."""
    finding_type = next(t for t, k in KINDS.items() if k == kind)
    rows = rows.withColumn("finding_type", F.lit(finding_type))
    rows = rows.withColumn("finding_id", stable_id(FINDING_PREFIX, *(f for f in FIELDS[kind][1].split() if f != "finding_id")))
    every = ["population_id", "candidate_source_id", "field", "path", "expected_sha256", "observed_sha256"]
    return rows.select("image", "finding_type", "finding_id", "status", "details", "evidence_ids", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in every))


def derive(images: DataFrame, inputs: DataFrame, manifest: DataFrame, native: DataFrame, expected: DataFrame, observed: DataFrame, depends: DataFrame) -> Graph:
    """The graphs of all images.

    An installed package has the description of its name, if there is just one. Joins are by image and name,
    source or path, so a large image is read by as many tasks as it has keys.
    """
    head = checkpointed(heads(images, inputs))
    lanes = head.select("image", "build_lane", "artifact_lane", "build_evidence", "manifest_evidence", "artifact_evidence")
    by_name = native.groupBy("image", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source_id", "version", "producer", "identifiers")).alias("native"))
    owned = expected.select("image", "path", F.explode("owners").alias("source_id")).groupBy("image", "source_id").agg(F.array_sort(F.collect_set("path")).alias("file_paths"))
    one = F.when(F.col("n") == 1, F.col("native"))
    met = manifest.join(by_name, ["image", "name"], "left").withColumn("native", one).withColumn("source_id", F.col("native.source_id"))
    met = met.join(owned, ["image", "source_id"], "left").join(lanes, "image")
    own = F.concat_ws(":", F.lit(MANIFEST_URN[:-1]), "architecture", "name", "version")
    said = F.coalesce(F.filter("native.identifiers", lambda i: i != UNKNOWN), _none())
    producer = F.coalesce("native.producer", F.lit(UNKNOWN))
    unknown = producer == UNKNOWN
    versions_differ = ~F.col("native.version").isin(UNKNOWN) & (F.col("native.version") != F.col("version"))
    packages = checkpointed(
        met.select(
            "image", stable_id("population", "architecture", F.lit(PACKAGE).alias("kind"), "name").alias("population_id"), F.lit(PACKAGE).alias("kind"), producer.alias("producer"), "name", "version", "architecture",
            F.array_sort(F.array_distinct(F.concat(F.array(own), said))).alias("identifiers"), F.array(F.lit(PACKAGE)).alias("roles"), F.array("build_lane").alias("discovery_lanes"), _sorted("build_evidence", "manifest_evidence").alias("evidence_ids"),
            F.when(unknown, _none()).otherwise(F.array("build_evidence")).alias("producer_evidence_ids"), F.coalesce("file_paths", _none()).alias("file_paths"), F.when(unknown, F.array(F.lit("producer"))).otherwise(_none()).alias("critical_unknown_fields"),
            "source_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(versions_differ, F.lit(False)).alias("versions_differ"),
        )
    )
    roots = head.select(
        "image", stable_id("population", "build_id", F.lit(ROOT).alias("kind")).alias("population_id"), F.lit(ROOT).alias("kind"), F.lit(UNKNOWN).alias("producer"), F.col("image_name").alias("name"), F.col("upstream_release").alias("version"), "architecture",
        F.array(F.concat(F.lit(ROOT_URN), "build_id")).alias("identifiers"), F.array(F.lit(ROOT)).alias("roles"), _sorted("build_lane", "artifact_lane").alias("discovery_lanes"), _sorted("build_evidence", "artifact_evidence").alias("evidence_ids"),
        _none().alias("producer_evidence_ids"), _none().alias("file_paths"), _none().alias("critical_unknown_fields"),
    )
    population = packages.drop("source_id", "n", "versions_differ").unionByName(roots)
    return Graph(head, population, _relationships(packages, roots, depends, lanes), _findings(packages, manifest, native, expected, observed, lanes))


def _relationships(packages: DataFrame, roots: DataFrame, depends: DataFrame, lanes: DataFrame) -> DataFrame:
    root = roots.select("image", F.col("population_id").alias("source_population_id"))
    held = packages.join(root, "image").select("image", "source_population_id", F.lit("CONTAINS").alias("relationship"), F.col("population_id").alias("target_population_id"), "evidence_ids")
    known = packages.filter("source_id is not null").select("image", "source_id", "population_id")
    ends = [known.select("image", F.col("source_id").alias(end), F.col("population_id").alias(f"{name}_population_id")) for end, name in (("src", "source"), ("dst", "target"))]
    needed = depends.distinct().join(ends[0], ["image", "src"]).join(ends[1], ["image", "dst"]).join(lanes, "image")
    needed = needed.select("image", "source_population_id", F.lit("DEPENDS_ON").alias("relationship"), "target_population_id", F.array("build_evidence").alias("evidence_ids"))
    rows = held.unionByName(needed)
    named = rows.withColumn("relationship_id", stable_id("relationship", "evidence_ids", "relationship", "source_population_id", "target_population_id"))
    return named.dropDuplicates(["image", "relationship_id"])


def _findings(packages: DataFrame, manifest: DataFrame, native: DataFrame, expected: DataFrame, observed: DataFrame, lanes: DataFrame) -> DataFrame:
    status = F.when(F.col("n") == 0, "MISSING_FROM_SBOM").when(F.col("n") > 1, "UNKNOWN").otherwise("MATCHED")
    why = F.when(F.col("n") == 0, F.array(F.lit("installed_package"))).when(F.col("n") > 1, F.array(F.lit("ambiguous_native_spdx_identity")))
    why = why.when(F.col("versions_differ"), F.array(F.lit("MANIFEST_PKGV_AND_NATIVE_SPDX_PV_HAVE_DIFFERENT_VERSION_SEMANTICS"))).otherwise(_none())
    met = packages.select("image", "population_id", F.col("source_id").alias("candidate_source_id"), status.alias("status"), why.alias("details"), "evidence_ids")
    fields = packages.filter(F.col("producer") == UNKNOWN).select("image", "population_id", F.lit("producer").alias("field"), F.lit("UNKNOWN").alias("status"), F.array(F.lit("NO_PER_COMPONENT_PRODUCER_EVIDENCE")).alias("details"), "evidence_ids")
    rest = native.join(manifest.select("image", "name").distinct(), ["image", "name"], "left_anti").join(lanes, "image")
    rest = rest.select("image", F.lit(None).cast("string").alias("population_id"), F.col("source_id").alias("candidate_source_id"), F.lit("NOT_IN_RELEASE").alias("status"), F.array("name").alias("details"), F.array("build_evidence").alias("evidence_ids"))
    sides = expected.select("image", "path", F.col("sha256").alias("expected_sha256")).join(observed.select("image", "path", F.col("sha256").alias("observed_sha256")), ["image", "path"], "full").join(lanes, "image")
    e, o, both = F.col("expected_sha256"), F.col("observed_sha256"), _sorted("build_evidence", "artifact_evidence")
    file_status = F.when(e.isNull(), "MISSING_FROM_SBOM").when(o.isNull(), "NOT_IN_RELEASE").when(e == UNKNOWN, "UNKNOWN").when(e != o, "CONFLICT").otherwise("MATCHED")
    file_why = F.when(e.isNull() | o.isNull(), F.array(F.lit("path"))).when(e == UNKNOWN, F.array(F.lit("build_metadata_sha256"))).when(e != o, F.array(F.lit("sha256"))).otherwise(_none())
    file_ids = F.when(e.isNull(), F.array("artifact_evidence")).when(o.isNull(), F.array("build_evidence")).otherwise(both)
    files = sides.select("image", "path", "expected_sha256", "observed_sha256", file_status.alias("status"), file_why.alias("details"), file_ids.alias("evidence_ids"))
    return _finding(met.unionByName(rest), "component").unionByName(_finding(fields, "field")).unionByName(_finding(files, "file"))


def summary(graph: Graph, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """A row per image: findings in each state, the files' exact-set hashes, blocking statuses, state and technical status."""
    counted = graph.findings.groupBy("image").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATES), F.count_if(F.col("expected_sha256").isNotNull()).alias("expected_file_count"), F.count_if(F.col("observed_sha256").isNotNull()).alias("observed_file_count"))
    empty = F.sha2(F.lit("[]"), 256)
    hashes = [list_sha256(expected, "image", canonical_json(F.col("owners").alias("owner_source_ids"), "path", "sha256"), ["path"]).withColumnRenamed("sha256", "expected_exact_set_sha256"), list_sha256(observed, "image", canonical_json("path", "sha256"), ["path"]).withColumnRenamed("sha256", "observed_exact_set_sha256")]
    rows = graph.heads.select("image", "run_id").join(counted, "image", "left").join(hashes[0], "image", "left").join(hashes[1], "image", "left")
    rows = rows.na.fill(0).withColumns({c: F.coalesce(c, empty) for c in ("expected_exact_set_sha256", "observed_exact_set_sha256")})
    blocking = F.array_sort(F.array_compact(F.array(*(F.when(F.col(s.lower()) > 0, s) for s in STATES[1:]))))
    state = F.when(F.size("blocking_statuses") == 0, "CLOSED").otherwise("OPEN")
    return rows.withColumn("blocking_statuses", blocking).withColumn("state", state).withColumn("technical_status", F.when(state == "OPEN", TECHNICAL["OPEN"]).otherwise(TECHNICAL["CLOSED"]))


def _lines(rows: DataFrame, kind: str) -> DataFrame:
    name, fields = FIELDS[kind]
    return rows.select("image", F.lit(kind).alias("kind"), F.col(name).alias("id"), canonical_json(*fields.split()).alias("line"))


def lines(graph: Graph) -> DataFrame:
    """(image, kind, id, line): every element as canonical JSON; what is recorded of a graph, and what it is checked by."""
    found = _lines(graph.population, "population").unionByName(_lines(graph.relationships, "relationship"))
    for finding_type, kind in KINDS.items():
        found = found.unionByName(_lines(graph.findings.filter(F.col("finding_type") == finding_type), kind))
    return found


def differences(derived: DataFrame, recorded: DataFrame) -> DataFrame:
    """(image, kind, id, problem): where recorded lines depart from derived ones.

    An element is missing, extra, changed (another line under its id) or repeated. One shuffle by id; elements are
    counted before they meet, so a repeated one is one row.
    """
    digest = lambda side: F.struct(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("line")).alias("low"), F.max(F.xxhash64("line")).alias("high"), F.min(F.sha2("line", 256)).alias("line")).alias(side)
    keys = ["image", "kind", "id"]
    both = derived.groupBy(*keys).agg(digest("d")).join(recorded.groupBy(*keys).agg(digest("r")), keys, "full")
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("d").isNull(), "extra").when((F.col("r.line") != F.col("d.line")) | (F.col("r.low") != F.col("r.high")), "changed").when(F.col("r.n") != F.col("d.n"), "repeated")
    return both.select(*keys, problem.alias("problem")).filter("problem is not null")


def misnamed(recorded: DataFrame) -> DataFrame:
    """(image, kind, id) of recorded relationships and findings whose id is not what their own content gives."""
    text, lists, inner = F.col("line"), ("details", "evidence_ids"), {"relationship": "relationship", "component": FINDING_PREFIX, "field": FINDING_PREFIX, "file": FINDING_PREFIX}
    wrong = None
    for kind, prefix in inner.items():
        name, fields = FIELDS[kind]
        types = ", ".join(f"{f} {'array<string>' if f in lists else 'string'}" for f in fields.split())
        rows = recorded.filter(F.col("kind") == kind).select("image", "kind", "id", F.from_json(text, types).alias("e"))
        own = stable_id(prefix, *(F.col(f"e.{f}").alias(f) for f in fields.split() if f != name))
        rows = rows.filter(~own.eqNullSafe(F.col("id")) | ~F.col(f"e.{name}").eqNullSafe(F.col("id"))).select("image", "kind", "id")
        wrong = rows if wrong is None else wrong.unionByName(rows)
    return wrong


def release_projection(graph: Graph, states: DataFrame) -> DataFrame:
    """What a reader is told of each image's release; ``states``: as summary()."""
    rows = graph.heads.join(states.select("image", "technical_status"), "image")
    return rows.select(
        "image", F.col("profile_id").alias("release_id"), F.col("image_name").alias("product"), F.col("upstream_release").alias("product_version"), "build_id", "artifact_sha256", "release_timestamp", "reference_builder",
        F.lit(None).cast("string").alias("manufacturer_role"), F.lit(NO_STATUS).alias("product_conformity_status"), F.col("technical_status").alias("status"),
    )


def component_projection(graph: Graph) -> DataFrame:
    """Every component with its status: unknown while a critical field is."""
    return graph.population.withColumn("status", F.when(F.size("critical_unknown_fields") > 0, "UNKNOWN").otherwise("MATCHED"))


def _ref(run_id: Column, kind: str, identity: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), uuid5_url(F.concat(run_id, F.lit(f":{kind}:"), identity)))


def _primary(identifiers: str) -> Column:
    return F.array_min(F.filter(identifiers, lambda i: i.startswith("pkg:")))


def canonical_hashes(found: DataFrame) -> DataFrame:
    """(image, canonical_sha256): a hash tree over the lines of each image."""
    return tree_sha256(found, "image", F.col("line")).select("image", F.col("sha256").alias("canonical_sha256"))


def _component_line(run_id: Column) -> Column:
    prop = lambda name, value: F.struct(F.lit(f"{NAMESPACE}:{name}").alias("name"), value.alias("value"))
    each = lambda name, listed: F.transform(listed, lambda x: prop(name, x))
    known = F.col("producer") != UNKNOWN
    properties = F.concat(
        F.array(prop("component-kind", F.col("kind")), prop("producer-evidence-status", F.when(known, "PER_COMPONENT_EVIDENCED").otherwise("UNKNOWN"))), each("identifier", F.array_sort("identifiers")), each("evidence-id", F.col("evidence_ids")),
    )
    return F.struct(
        _ref(run_id, "component", F.col("population_id")).alias("bom-ref"), F.col("name"), properties.alias("properties"), F.when(known, F.col("producer")).alias("publisher"), _primary("identifiers").alias("purl"),
        F.when(F.col("kind") == ROOT, "operating-system").otherwise("library").alias("type"), F.col("version"),
    )


def cyclonedx(graph: Graph, canonical: DataFrame) -> DataFrame:
    """(image, part, line) of every image's CycloneDX document: head (with the root component), components, dependencies and properties."""
    head = graph.heads.join(canonical, "image")
    run = F.col("run_id")
    population = graph.population.join(head.select("image", "run_id"), "image")
    root = population.filter(F.col("kind") == ROOT).select("image", _component_line(run).alias("component"))
    named = {"build-id": F.col("build_id"), "canonical-sha256": F.col("canonical_sha256"), "classification": F.lit(CLASSIFICATION), "release-artifact-sha256": F.col("artifact_sha256"), "run-id": run, "generator-output-status": F.lit(CANDIDATE), "product-conformity-status": F.lit(NO_STATUS)}
    properties = F.array(*(F.struct(F.lit(f"{NAMESPACE}:{n}").alias("name"), v.alias("value")) for n, v in named.items()))
    metadata = F.struct(F.array(F.struct(F.lit(f"{NAMESPACE} candidate generator").alias("name"))).alias("authors"), F.col("component"), properties.alias("properties"), F.col("release_timestamp").alias("timestamp"))
    body = F.struct(F.lit("https://cyclonedx.org/schema/bom-1.7.schema.json").alias("$schema"), F.lit("CycloneDX").alias("bomFormat"), metadata.alias("metadata"), _ref(run, "bom", F.col("profile_id")).alias("serialNumber"), F.lit("1.7").alias("specVersion"), F.lit(1).alias("version"))
    top = head.join(root, "image").select("image", F.lit("head").alias("part"), F.to_json(body).alias("line"))
    components = population.filter(F.col("kind") != ROOT).select("image", F.lit("components").alias("part"), F.to_json(_component_line(run)).alias("line"))
    edges = graph.relationships.join(head.select("image", "run_id"), "image").select("image", _ref(run, "component", F.col("source_population_id")).alias("src"), F.col("relationship").alias("rel"), _ref(run, "component", F.col("target_population_id")).alias("dst"))
    # References name their run, so rows of different images do not meet.
    refs = population.select("image", _ref(run, "component", F.col("population_id")).alias("ref"))
    rows = dependency_rows(refs, edges, ("DEPENDS_ON", "CONTAINS")).join(refs, "ref")
    dependencies = rows.select("image", F.lit("dependencies").alias("part"), canonical_json(F.col("depends_on").alias("dependsOn"), "ref").alias("line"))
    said = edges.select("image", F.lit("properties").alias("part"), canonical_json(F.lit(f"{NAMESPACE}:relationship").alias("name"), F.concat_ws("|", "src", "rel", "dst").alias("value")).alias("line"))
    return top.unionByName(components).unionByName(dependencies).unionByName(said)


def _short(column: Column, digits: int) -> Column:
    return F.substring(F.sha2(column, 256), 1, digits)


def spdx(graph: Graph, canonical: DataFrame) -> DataFrame:
    """(image, part, line) of every image's SPDX document; all ids come from one prefix, so references resolve.

    The elements that a document and its inventory list are named in lines of their own (part ``membership``:
    document, element), as a list would hold an image in one row.
    """
    head = graph.heads.join(canonical, "image")
    base = F.concat(F.lit(f"https://example.invalid/{NAMESPACE}/image/"), _short(F.col("run_id"), 24))
    head = head.withColumns({"base": base, "creation": F.concat(F.lit("_:creation-"), _short(F.col("run_id"), 20))})
    at = lambda kind: F.concat("base", F.lit(f"/{kind}"))
    generator, tool, document, sbom = at("organization/candidate-generator"), at(f"tool/{NAMESPACE}"), at("document/reference"), at("sbom/reference")
    package = lambda c: F.concat("base", F.lit("/package/"), _short(F.col(c), 32))
    bound = F.concat(F.lit(f"{NAMESPACE}:binding="), canonical_json("build_id", "canonical_sha256", F.lit(CLASSIFICATION).alias("classification"), F.col("artifact_sha256").alias("release_artifact_sha256"), "run_id"))
    both = F.array(F.lit("core"), F.lit("software"))
    top = [
        F.struct(F.col("creation").alias("@id"), F.col("release_timestamp").alias("created"), F.array(generator).alias("createdBy"), F.array(tool).alias("createdUsing"), F.lit("3.0.1").alias("specVersion"), F.lit("CreationInfo").alias("type")),
        F.struct(F.lit("GENERATOR_ONLY_NOT_MANUFACTURER").alias("comment"), F.col("creation").alias("creationInfo"), F.lit(f"{NAMESPACE} candidate generator").alias("name"), generator.alias("spdxId"), F.lit("Organization").alias("type")),
        F.struct(F.col("creation").alias("creationInfo"), F.lit(NAMESPACE).alias("name"), tool.alias("spdxId"), F.lit("Tool").alias("type")),
        F.struct(bound.alias("comment"), F.col("creation").alias("creationInfo"), F.concat("build_id", F.lit(" SPDX candidate document")).alias("name"), both.alias("profileConformance"), F.array(sbom).alias("rootElement"), document.alias("spdxId"), F.lit(f"{CANDIDATE}; {NO_STATUS}; public reference is not ground truth.").alias("summary"), F.lit("SpdxDocument").alias("type")),
        F.struct(bound.alias("comment"), F.col("creation").alias("creationInfo"), F.concat("build_id", F.lit(" generator output candidate")).alias("name"), both.alias("profileConformance"), F.array(package("root")).alias("rootElement"), F.array(F.lit("build")).alias("software_sbomType"), sbom.alias("spdxId"), F.lit("software_Sbom").alias("type")),
    ]
    roots = graph.population.filter(F.col("kind") == ROOT).select("image", F.col("population_id").alias("root"))
    heads_ = head.join(roots, "image").select("image", F.lit("head").alias("part"), F.explode(F.array(*map(F.to_json, top))).alias("line"))
    named = head.select("image", "base", "creation")
    agent = lambda c: F.concat("base", F.lit("/organization/"), _short(F.col(c), 32))
    population = graph.population.join(named, "image")
    known = F.col("producer") != UNKNOWN
    agents = population.filter(known).select("image", "base", "creation", "producer").distinct().select("image", F.lit("agents").alias("part"), canonical_json(F.col("creation").alias("creationInfo"), F.col("producer").alias("name"), agent("producer").alias("spdxId"), F.lit("Organization").alias("type")).alias("line"))
    outer = F.transform("identifiers", lambda i: F.struct(F.when(i.startswith("pkg:"), "packageUrl").otherwise("other").alias("externalIdentifierType"), i.alias("identifier"), F.lit("ExternalIdentifier").alias("type")))
    comment = F.concat(F.lit(f"{CANDIDATE};{NO_STATUS};producer="), "producer", F.lit(";evidence_ids="), F.array_join("evidence_ids", ","))
    body = F.struct(
        comment.alias("comment"), F.col("creation").alias("creationInfo"), outer.alias("externalIdentifier"), F.col("name"), _primary("identifiers").alias("software_packageUrl"), F.col("version").alias("software_packageVersion"),
        F.when(F.col("kind") == ROOT, "application").otherwise("library").alias("software_primaryPurpose"), package("population_id").alias("spdxId"), F.when(known, agent("producer")).alias("suppliedBy"), F.lit("software_Package").alias("type"),
    )
    packages = population.select("image", F.lit("packages").alias("part"), F.to_json(body).alias("line"))
    kinds = F.create_map(*(F.lit(x) for pair in SPDX_NAMES.items() for x in pair))
    kind = F.coalesce(kinds[F.col("relationship")], F.raise_error(F.concat(F.lit("no name for "), "relationship")))
    own = F.concat("base", F.lit("/relationship/"), _short(F.col("relationship_id"), 32))
    edges = graph.relationships.join(named, "image")
    relationships = edges.select("image", F.lit("relationships").alias("part"), canonical_json(F.concat(F.lit("evidence_ids="), F.array_join("evidence_ids", ",")).alias("comment"), F.col("creation").alias("creationInfo"), package("source_population_id").alias("from"), kind.alias("relationshipType"), own.alias("spdxId"), F.array(package("target_population_id")).alias("to"), F.lit("Relationship").alias("type")).alias("line"))
    ids = population.select("image", "base", package("population_id").alias("id")).unionByName(edges.select("image", "base", own.alias("id")))
    lists = F.explode(F.array(document, sbom)).alias("owner")
    listed = ids.select("image", "base", "id", lists).unionByName(named.select("image", "base", sbom.alias("id"), document.alias("owner")))
    membership = listed.select("image", F.lit("membership").alias("part"), canonical_json(F.array("id").alias("element"), F.col("owner").alias("from")).alias("line"))
    return heads_.unionByName(agents).unionByName(packages).unionByName(relationships).unionByName(membership)


# An image profile's origin, scope, limits, suffixes of payloads by role.
ORIGIN = "downloads.yoctoproject.org"
SCOPE = ("INSTALLED_PACKAGES", "ROOTFS_REGULAR_FILES", "ROOTFS_SYMLINKS")
LIMITS = {"max_json_bytes": (1024, 512 << 20), "max_rootfs_files": (1, 1_000_000), "max_rootfs_expanded_bytes": (1, 32 << 30), "max_path_bytes": (64, 16_384), "zstd_timeout_seconds": (1, 900)}
SUFFIXES = {"build_spdx": r"\.spdx\.json", "image_manifest": r"\.manifest", "testdata": r"\.testdata\.json", "qemuboot": r"\.qemuboot\.conf", "rootfs_archive": r"\.tar(\.zst)?"}
REVISIONS = ("openembedded_core", "bitbake", "meta_yocto")


def _listed(name: str) -> Column:
    return (F.size(name) > 0) & (F.size(name) == F.size(F.array_distinct(name))) & F.forall(name, lambda x: is_text(x))


def profile_violations(profiles: DataFrame, payloads: DataFrame) -> DataFrame:
    """(profile_id, rule) of image profiles, and of their payloads (profile_id, role, url, relative_path, sha256, max_bytes, media_type), that break a rule.

    profiles: profile_id, classification, upstream_release, release_notes_url, the columns of REVISIONS, image_name, machine, architecture,
    build_timestamp, build_id, reference_builder, release_timestamp, build and artifact (structs lane_id, adapter_id, independence_domain),
    included, declared_exclusions, blindspots, the columns of LIMITS. Payloads are counted per profile before they meet it.
    """
    c = F.col
    stamp = F.date_format(F.try_to_timestamp("build_timestamp", F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisions = F.lit(True)
    for name in REVISIONS:
        revisions = revisions & fully(c(name), "[0-9a-f]{40}")
    limits = F.lit(True)
    for name, (low, high) in LIMITS.items():
        limits = limits & c(name).between(low, high)
    lane = lambda name, fixed: is_safe_id(c(f"{name}.lane_id")) & (c(f"{name}.adapter_id") == fixed[0]) & (c(f"{name}.independence_domain") == fixed[1])
    checks = {
        "profile_id": is_safe_id(c("profile_id")), "classification": c("classification") == CLASSIFICATION, "upstream_release": is_text(c("upstream_release")), "release_notes_url": is_https_url(c("release_notes_url"), (ORIGIN,)), "revisions": revisions,
        **{name: is_safe_id(c(name)) for name in ("image_name", "machine", "architecture", "build_id")}, "build_timestamp": fully(c("build_timestamp"), "[0-9]{14}"), "same_build": stamp == c("release_timestamp"), "reference_builder": is_text(c("reference_builder")),
        "build_lane": lane("build", BUILD), "artifact_lane": lane("artifact", ARTIFACT), "lanes": c("build.lane_id") != c("artifact.lane_id"), "included": F.array_sort("included") == F.array(*map(F.lit, SCOPE)),
        "declared_exclusions": _listed("declared_exclusions"), "blindspots": _listed("blindspots"), "limits": limits,
    }
    own = violations(profiles, "profile_id", {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    base = lambda name: F.substring_index(name, "/", -1)
    suffix = F.lit(False)
    for role, pattern in SUFFIXES.items():
        suffix = suffix | (c("role") == role) & c("relative_path").rlike(pattern + r"\z")
    each = {
        "payload_role": c("role").isin(*ROLES), "payload_path": is_relative_path(c("relative_path")), "payload_url": is_https_url(c("url"), (ORIGIN,)), "payload_name": base("url") == base("relative_path"), "payload_suffix": suffix,
        "payload_sha256": is_sha256(c("sha256")), "payload_bytes": c("max_bytes").between(1, 4 << 30), "payload_media": is_text(c("media_type"), 128),
    }
    parts = violations(payloads, "profile_id", {k: F.coalesce(v, F.lit(False)) for k, v in each.items()}).distinct()
    counted = payloads.groupBy("profile_id").agg(F.array_sort(F.collect_list("role")).alias("roles"), F.countDistinct("relative_path").alias("paths"))
    both = profiles.select("profile_id").distinct().join(counted, "profile_id", "left")
    sets = violations(both, "profile_id", {"payload_roles": F.coalesce(c("roles") == F.array(*map(F.lit, ROLES)), F.lit(False)), "payload_paths": F.coalesce(c("paths") == F.size("roles"), F.lit(False))})
    twice = profiles.groupBy("profile_id").count().filter("count > 1").select("profile_id", F.lit("repeated").alias("rule"))
    return own.union(parts).union(sets).union(twice)
