"""Inventories as JSON lines and sealed packages.

One element of a document is one row of JSON: an export of any size is written by many
tasks, and a document is its head and its lines.
"""

from __future__ import annotations

import hashlib
import json
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions.text import NAMESPACE, UNKNOWN, canonical_json, component_type, fragment, hash_fits, hash_name, stable_id, uuid5_url
from corroborate.operators.hashing import tree_leaves, tree_root
from corroborate.operators.relations import dependency_rows
from corroborate.operators.rules import assert_none
from corroborate.storage import checkpointed

#: Relationship names in the second format.
SPDX_NAMES = {"CONTAINS": "contains", "DEPENDS_ON": "dependsOn", "DYNAMICALLY_LINKS": "hasDynamicLink", "GENERATED_FROM": "packagedBy"}
#: Fields of SPDX elements that name other elements.
REFERENCES = ("creationInfo", "from", "suppliedBy")
REFERENCE_LISTS = ("createdBy", "createdUsing", "element", "rootElement", "to", "originatedBy")


def bom_ref(run_id: str, population_id: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), uuid5_url(F.concat(F.lit(run_id + ":"), population_id)))


def primary_purl(identifiers: str) -> Column:
    return F.array_min(F.filter(identifiers, lambda i: i.startswith("pkg:")))


def _known(population: DataFrame) -> DataFrame:
    """``population`` with evidence_ids and supplier_hashes, empty where it has none."""
    none = F.array().cast("array<string>")
    for c in ("evidence_ids", "supplier_hashes"):
        if c not in population.columns:
            population = population.withColumn(c, none)
    return population


def _said_hashes(hashes: str) -> Column:
    """Those of a list of algorithm:value that say a value, whatever they know of the algorithm."""
    return F.filter(hashes, lambda h: F.substring_index(h, ":", -1) != UNKNOWN)


def component_properties() -> Column:
    """Name and value of what the format has no field for: identifiers, roles, evidence, lanes, supplier hashes."""
    named = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(f"{NAMESPACE}:{name}").alias("name"), v.alias("value")))
    return F.concat(
        named("identifier", F.array_sort("identifiers")), named("component-role", F.array_sort("roles")), named("evidence-id", F.array_sort("evidence_ids")), named("discovery-lane", F.array_sort("lanes")),
        named("supplier-declared-hash", F.array_sort(_said_hashes("supplier_hashes"))),
    )


def normal_hashes(hashes: str) -> Column:
    """algorithm:value as sorted structs alg, content with the formats' names; values that are no hex of their algorithm's length go. Null for none."""
    each = F.transform(hashes, lambda h: F.struct(hash_name(F.substring_index(h, ":", 1)).alias("alg"), F.lower(F.substring_index(h, ":", -1)).alias("content"), hash_fits(F.substring_index(h, ":", 1), F.substring_index(h, ":", -1)).alias("fits")))
    kept = F.array_sort(F.array_distinct(F.transform(F.filter(each, lambda h: h["fits"]), lambda h: F.struct(h["alg"].alias("alg"), h["content"].alias("content")))))
    return F.when(F.size(kept) > 0, kept)


def _component(run_id: str) -> Column:
    return F.struct(
        bom_ref(run_id, F.col("population_id")).alias("bom-ref"), normal_hashes("hashes").alias("hashes"), F.col("name"), component_properties().alias("properties"), F.col("producer").alias("publisher"),
        primary_purl("identifiers").alias("purl"), component_type(F.col("roles")).alias("type"), F.col("version"),
    )


def cyclonedx_components(population: DataFrame, run_id: str) -> DataFrame:
    """(population_id, line): one component object each; fields without a value are left out."""
    return _known(population).select("population_id", F.to_json(_component(run_id)).alias("line"))


def cyclonedx_properties(relationships: DataFrame, run_id: str) -> DataFrame:
    """(line): one property object for each relationship (src, rel, dst)."""
    value = F.concat_ws("|", bom_ref(run_id, F.col("src")), "rel", bom_ref(run_id, F.col("dst")))
    return relationships.select(canonical_json(F.lit(f"{NAMESPACE}:relationship").alias("name"), value.alias("value")).alias("line"))


#: What both documents bind: name of the property, and field of the release.
BINDING = {"classification": "classification", "run-id": "run_id", "canonical-sha256": "canonical_sha256", "build-id": "build_id", "release-artifact-sha256": "artifact_sha256"}


def root_components(population: DataFrame, release: DataFrame) -> DataFrame:
    """(run_id, population_id) of the one component that each release (run_id, manufacturer, product, product_version) is about; none or several are an error."""
    bound = release.select("run_id", F.col("manufacturer").alias("producer"), F.col("product").alias("name"), F.col("product_version").alias("version"))
    tops = population.filter(F.array_contains("roles", "ROOT_PRODUCT")).select("population_id", "producer", "name", "version")
    found = bound.join(tops, ["producer", "name", "version"], "left").groupBy("run_id").agg(F.count("population_id").alias("n"), F.min("population_id").alias("population_id"))
    return found.select("run_id", F.when(F.col("n") == 1, F.col("population_id")).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" root components")))).alias("population_id"))


def cyclonedx_head(release: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(run_id, line): the document of each release less its components, dependencies and properties, which are lines of their own.

    release: run_id, classification, canonical_sha256, build_id, artifact_sha256, release_timestamp, sbom_author.
    roots: run_id, component (a struct), which the document is about.
    """
    release = release.withColumn("component", F.lit(None).cast("string")) if roots is None else release.join(roots, "run_id")
    named = [F.struct(F.lit(f"{NAMESPACE}:{n}").alias("name"), F.col(c).alias("value")) for n, c in BINDING.items()]
    named.append(F.struct(F.lit(f"{NAMESPACE}:technical-state").alias("name"), F.lit("SYNTHETIC_RECONCILIATION_CLOSED").alias("value")))
    metadata = F.struct(F.array(F.struct(F.col("sbom_author").alias("name"))).alias("authors"), F.col("component"), F.array(*named).alias("properties"), F.col("release_timestamp").alias("timestamp"))
    body = F.struct(
        F.lit("https://cyclonedx.org/schema/bom-1.7.schema.json").alias("$schema"), F.lit("CycloneDX").alias("bomFormat"), metadata.alias("metadata"), F.concat(F.lit("urn:uuid:"), uuid5_url(F.col("run_id"))).alias("serialNumber"),
        F.lit("1.7").alias("specVersion"), F.lit(1).alias("version"),
    )
    return release.select("run_id", F.to_json(body).alias("line"))


def cyclonedx_dependencies(population: DataFrame, relationships: DataFrame, run_id: str) -> DataFrame:
    """(ref, line): one dependency object for every component, empty ones too."""
    rows = dependency_rows(population.select(F.col("population_id").alias("ref")), relationships)
    targets = F.array_sort(F.transform("depends_on", lambda d: bom_ref(run_id, d)))
    return rows.select("ref", canonical_json(targets.alias("dependsOn"), bom_ref(run_id, F.col("ref")).alias("ref")).alias("line"))


def spdx_id(run_id: Column, kind: str, identity: Column) -> Column:
    return F.concat(F.lit(f"https://example.invalid/{NAMESPACE}/"), fragment(run_id), F.lit(f"/{kind}/"), fragment(identity))


def _creation(run_id: Column) -> Column:
    return F.concat(F.lit("_:creation-"), F.substring(F.sha2(run_id, 256), 1, 20))


def spdx_packages(population: DataFrame, run_id: str) -> DataFrame:
    """(population_id, line): one package object each; fields without a value are left out."""
    run = F.lit(run_id)
    kind = lambda i: F.when(i.startswith("pkg:"), "packageUrl").otherwise("other")
    outer = lambda k, i: F.struct(k.alias("externalIdentifierType"), i.alias("identifier"), F.lit("ExternalIdentifier").alias("type"))
    identifiers = F.concat(F.transform(F.array_sort("identifiers"), lambda i: outer(kind(i), i)), F.transform(F.array_sort(_said_hashes("supplier_hashes")), lambda h: outer(F.lit("other"), F.concat(F.lit("supplier-declared-hash:"), h))))
    verified = F.transform(normal_hashes("hashes"), lambda h: F.struct(F.lit("sha256").alias("algorithm"), h["content"].alias("hashValue"), F.lit("Hash").alias("type")))
    body = F.struct(
        F.concat(F.lit("classification=SYNTHETIC_NOT_EVIDENCE; evidence_ids="), F.array_join("evidence_ids", ",")).alias("comment"), _creation(run).alias("creationInfo"), identifiers.alias("externalIdentifier"), F.col("name"),
        primary_purl("identifiers").alias("software_packageUrl"), F.col("version").alias("software_packageVersion"), component_type(F.col("roles")).alias("software_primaryPurpose"), spdx_id(run, "package", F.col("population_id")).alias("spdxId"),
        spdx_id(run, "organization", F.col("producer")).alias("suppliedBy"), F.lit("software_Package").alias("type"), verified.alias("verifiedUsing"),
    )
    return _known(population).select("population_id", F.to_json(body).alias("line"))


def spdx_agents(population: DataFrame, run_id: str, author: str) -> DataFrame:
    """(line): one organization object for each producer, and for the author."""
    run = F.lit(run_id)
    names = population.select(F.col("producer").alias("name")).union(population.sparkSession.createDataFrame([(author,)], "name string")).distinct()
    return names.select(canonical_json(_creation(run).alias("creationInfo"), F.col("name"), spdx_id(run, "organization", F.col("name")).alias("spdxId"), F.lit("Organization").alias("type")).alias("line"))


def spdx_head(release: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(run_id, line): creation, tool, document and inventory objects of each release; what these list are lines of their own.

    release: as of cyclonedx_head(), with release_id, product, product_version; roots: run_id, population_id.
    Without roots there is no inventory, which is about its root.
    """
    run = F.col("run_id")
    created, tool = _creation(run), spdx_id(run, "tool", F.lit(NAMESPACE))
    bound = canonical_json("build_id", "canonical_sha256", "classification", F.col("artifact_sha256").alias("release_artifact_sha256"), "run_id")
    comment = F.concat(F.lit(f"{NAMESPACE}:binding="), bound)
    lines = F.array(
        F.to_json(F.struct(created.alias("@id"), F.col("release_timestamp").alias("created"), F.array(spdx_id(run, "organization", F.col("sbom_author"))).alias("createdBy"), F.array(tool).alias("createdUsing"), F.lit("3.0.1").alias("specVersion"), F.lit("CreationInfo").alias("type"))),
        F.to_json(F.struct(created.alias("creationInfo"), F.lit(NAMESPACE).alias("name"), tool.alias("spdxId"), F.lit("Tool").alias("type"))),
        F.to_json(F.struct(comment.alias("comment"), created.alias("creationInfo"), F.concat_ws(" ", "product", "product_version", F.lit("SPDX document")).alias("name"), F.array(F.lit("core"), F.lit("software")).alias("profileConformance"),
                           F.array(spdx_id(run, "sbom", F.col("release_id"))).alias("rootElement"), spdx_id(run, "document", F.col("release_id")).alias("spdxId"), F.lit("SpdxDocument").alias("type"))),
    )
    top = release.select("run_id", F.explode(lines).alias("line"))
    if roots is None:
        return top
    inventory = F.to_json(
        F.struct(
            comment.alias("comment"), created.alias("creationInfo"), F.concat_ws(" ", "product", "product_version", F.lit("synthetic build SBOM")).alias("name"), F.array(F.lit("core"), F.lit("software")).alias("profileConformance"), F.array(spdx_id(run, "package", F.col("population_id"))).alias("rootElement"),
            F.array(F.lit("build")).alias("software_sbomType"), spdx_id(run, "sbom", F.col("release_id")).alias("spdxId"), F.lit("software_Sbom").alias("type"),
        )
    )
    return top.unionByName(release.join(roots, "run_id").select("run_id", inventory.alias("line")))


def pair_violations(cyclonedx: DataFrame, spdx: DataFrame, release: DataFrame) -> DataFrame:
    """(run_id, field) of what the heads of the two documents (run_id, line) bind otherwise than each other or than their release."""
    listed = F.from_json(F.get_json_object("line", "$.metadata.properties"), "array<struct<name: string, value: string>>")
    values = F.map_from_entries(listed)
    left = cyclonedx.select("run_id", *(values[f"{NAMESPACE}:{n}"].alias(f"c_{c}") for n, c in BINDING.items()))
    comment = F.get_json_object("line", "$.comment")
    bound = F.substring_index(comment, f"{NAMESPACE}:binding=", -1)
    right = spdx.filter(F.get_json_object("line", "$.type") == "SpdxDocument").select("run_id", *(F.get_json_object(bound, "$." + ("release_artifact_sha256" if c == "artifact_sha256" else c)).alias(f"s_{c}") for c in BINDING.values()))
    both = release.join(left, "run_id", "left").join(right, "run_id", "left")
    broken = F.array_compact(F.array(*(F.when(~(F.col(f"c_{c}").eqNullSafe(F.col(c) if c != "run_id" else F.col("run_id")) & F.col(f"s_{c}").eqNullSafe(F.col(c) if c != "run_id" else F.col("run_id"))), c) for c in BINDING.values())))
    return both.select("run_id", F.explode(broken).alias("field"))


def spdx_relationships(relationships: DataFrame, run_id: str) -> DataFrame:
    """(line) of each relationship (src, rel, dst: populations; perhaps relationship_id, evidence_ids); a kind without a name in the format is an error."""
    run, none = F.lit(run_id), F.array().cast("array<string>")
    if "relationship_id" not in relationships.columns:
        relationships = relationships.withColumn("relationship_id", stable_id("relationship", F.col("rel").alias("relationship"), F.col("src").alias("source_population_id"), F.col("dst").alias("target_population_id")))
    if "evidence_ids" not in relationships.columns:
        relationships = relationships.withColumn("evidence_ids", none)
    names = F.create_map(*(F.lit(x) for pair in SPDX_NAMES.items() for x in pair))
    kind = F.coalesce(names[F.col("rel")], F.raise_error(F.concat(F.lit("no name for "), "rel")))
    body = canonical_json(
        F.concat(F.lit("evidence_ids="), F.array_join("evidence_ids", ",")).alias("comment"), _creation(run).alias("creationInfo"), spdx_id(run, "package", F.col("src")).alias("from"), kind.alias("relationshipType"),
        spdx_id(run, "relationship", F.col("relationship_id")).alias("spdxId"), F.array(spdx_id(run, "package", F.col("dst"))).alias("to"), F.lit("Relationship").alias("type"),
    )
    return relationships.select(body.alias("line"))


def _run(release: DataFrame) -> tuple[str, str]:
    """run_id and author of the one release of an export."""
    rows = release.select("run_id", "sbom_author").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} releases in one export")
    return rows[0]["run_id"], rows[0]["sbom_author"]


def cyclonedx_document(population: DataFrame, relationships: DataFrame, release: DataFrame) -> DataFrame:
    """(part, line): the whole CycloneDX document of one release (as of spdx_head(), with manufacturer), whose root component is in its head."""
    run_id, _ = _run(release)
    root = root_components(population, release)
    top = _known(population).join(root, "population_id").select("run_id", _component(run_id).alias("component"))
    rest = _known(population).join(root, "population_id", "left_anti")
    parts = {
        "head": cyclonedx_head(release, top), "components": cyclonedx_components(rest, run_id),
        "dependencies": cyclonedx_dependencies(population, relationships, run_id), "properties": cyclonedx_properties(relationships, run_id),
    }
    return _parts(parts)


def spdx_document(population: DataFrame, relationships: DataFrame, release: DataFrame) -> DataFrame:
    """(part, line): the whole SPDX document of one release. Every element has its id from spdx_id(), so references resolve.

    Elements that the document and its inventory list stand in lines of their own (part ``membership``), one a line.
    """
    run_id, author = _run(release)
    run = F.lit(run_id)
    packages, edges = spdx_packages(population, run_id), spdx_relationships(relationships, run_id)
    ids = packages.select(F.get_json_object("line", "$.spdxId").alias("id")).unionByName(edges.select(F.get_json_object("line", "$.spdxId").alias("id")))
    document, sbom = ((spdx_id(run, kind, F.col("release_id"))) for kind in ("document", "sbom"))
    owners = release.select(document.alias("document"), sbom.alias("sbom")).first()
    listed = ids.select("id", F.explode(F.array(F.lit(owners["document"]), F.lit(owners["sbom"]))).alias("owner")).unionByName(release.select(sbom.alias("id"), document.alias("owner")))
    parts = {
        "head": spdx_head(release, root_components(population, release)), "agents": spdx_agents(population, run_id, author), "packages": packages, "relationships": edges,
        "membership": listed.select(canonical_json(F.array("id").alias("element"), F.col("owner").alias("from")).alias("line")),
    }
    return _parts(parts)


def _parts(parts: dict[str, DataFrame]) -> DataFrame:
    found = None
    for name, rows in parts.items():
        own = rows.select(F.lit(name).alias("part"), "line")
        found = own if found is None else found.unionByName(own)
    return found


def spdx_reference_errors(elements: DataFrame) -> DataFrame:
    """(id, problem) of elements (raw: JSON text): repeated ids, references to none, and documents that are not one."""
    named = elements.select("raw", F.coalesce(F.get_json_object("raw", "$.spdxId"), F.get_json_object("raw", "$['@id']")).alias("id"))
    single = [F.get_json_object("raw", f"$.{f}") for f in REFERENCES]
    several = [F.coalesce(F.from_json(F.get_json_object("raw", f"$.{f}"), "array<string>"), F.array().cast("array<string>")) for f in REFERENCE_LISTS]
    cited = named.select("id", F.explode(F.array_compact(F.concat(F.array(*single), *several))).alias("ref"))
    lost = cited.join(named.select(F.col("id").alias("ref")).filter("ref is not null").distinct(), "ref", "left_anti").select("id", F.concat(F.lit("unresolved "), "ref").alias("problem"))
    twice = named.filter("id is not null").groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("problem"))
    documents = elements.agg(F.count_if(F.get_json_object("raw", "$.type") == "SpdxDocument").alias("n")).filter("n <> 1")
    return lost.union(twice).union(documents.select(F.lit(None).cast("string"), F.concat(F.col("n").cast("string"), F.lit(" documents"))))


def dependency_errors(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(ref, problem) of an export's components (ref) and dependencies (ref, depends_on)."""
    known = components.select("ref")
    twice = known.groupBy("ref").count().filter("count > 1").select("ref", F.lit("repeated").alias("problem"))
    strange = dependencies.select("ref").join(known, "ref", "left_anti").select("ref", F.lit("row without component").alias("problem"))
    targets = dependencies.select(F.explode("depends_on").alias("ref")).distinct().join(known, "ref", "left_anti").select("ref", F.lit("unknown target").alias("problem"))
    without = known.distinct().join(dependencies, "ref", "left_anti").select("ref", F.lit("component without row").alias("problem"))
    return twice.union(strange).union(targets).union(without)


#: Digits of a line's digest that name its leaf in a package's hash tree.
LEAF_DIGITS = 3


def write_package(spark: SparkSession, path: str, parts: dict[str, DataFrame], digits: int = 0) -> DataFrame:
    """Write each part (a DataFrame of one string column) as text below ``path``, which must be new, its leaves, and its manifest last.

    The manifest has a row per part: rows and the root of the hash tree over its lines; LEAVES has the tree's
    leaves. With ``digits`` a part's lines are dealt to 16^digits folders by their digest, so what is
    wanted of one leaf is read from one folder.
    """
    for name, lines in parts.items():
        rows = lines.select(F.col(lines.columns[0]).alias("value"))
        if digits:
            dealt = rows.withColumn("folder", F.concat(F.lit("h"), F.substring(F.sha2("value", 256), 1, digits)))
            dealt.repartition("folder").write.mode("errorifexists").partitionBy("folder").text(f"{path}/{name}")
        else:
            rows.write.mode("errorifexists").text(f"{path}/{name}")
    names = list(parts)
    leaves = tree_leaves(_package_lines(spark, path, names), "name", F.col("value"), LEAF_DIGITS)
    leaves.write.mode("errorifexists").json(f"{path}/LEAVES")
    manifest = _roots(spark, sealed_leaves(spark, path), names)
    manifest.write.mode("errorifexists").json(f"{path}/MANIFEST")
    return manifest


def _package_lines(spark: SparkSession, path: str, names: list[str], leaves: DataFrame | None = None) -> DataFrame:
    """(name, value) of a package's lines as they are on disk; those of some leaves (name, bucket) alone, if they are given."""
    found = spark.createDataFrame([], "name string, value string")
    for name in names:
        rows = spark.read.text(f"{path}/{name}")
        if leaves is not None:
            own = leaves.filter(F.col("name") == name).select("bucket")
            if "folder" in rows.columns:
                folders = [r.folder for r in own.select(F.concat(F.lit("h"), F.substring("bucket", 1, _folder_digits(rows))).alias("folder")).distinct().collect()]  # folders of a part: a known few
                rows = rows.filter(F.col("folder").isin(folders))
            rows = rows.withColumn("bucket", F.substring(F.sha2("value", 256), 1, LEAF_DIGITS)).join(own, "bucket", "left_semi")
        found = found.union(rows.select(F.lit(name).alias("name"), "value"))
    return found


def _folder_digits(rows: DataFrame) -> int:
    return len(rows.inputFiles()[0].split("folder=h")[1].split("/")[0])


def sealed_leaves(spark: SparkSession, path: str) -> DataFrame:
    """(name, bucket, rows, sha256) as the package was sealed."""
    return spark.read.schema("name string, bucket string, rows long, sha256 string").json(f"{path}/LEAVES")


def _roots(spark: SparkSession, leaves: DataFrame, names: list[str]) -> DataFrame:
    hashed = tree_root(leaves, "name")
    return spark.createDataFrame([(n,) for n in names], "name string").join(hashed, "name", "left").select("name", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))


def package_manifest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, rows, sha256) of a package's parts as they are on disk; the hash is a tree over their lines, so no task holds a part. An empty part has none."""
    return _roots(spark, tree_leaves(_package_lines(spark, path, names), "name", F.col("value"), LEAF_DIGITS), names)


def package_differences(spark: SparkSession, path: str) -> DataFrame:
    """(name) of parts that no longer are what the package's manifest says."""
    said = _manifest(spark, path)
    now = package_manifest(spark, path, _names(said))
    return said.exceptAll(now).select("name")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, rows long, sha256 string").json(f"{path}/MANIFEST")


def _names(manifest: DataFrame) -> list[str]:
    return [r.name for r in manifest.select("name").collect()]  # a package has a handful of parts


def leaf_differences(spark: SparkSession, path: str, regenerated: dict[str, DataFrame]) -> DataFrame:
    """(name, bucket, problem): leaves of a package that are not what its own inputs give.

    Three trees meet by leaf: the sealed one, that of the lines on disk, and that of the lines derived again
    (``regenerated``, parts as of write_package()). ``disk``: lines changed since they were sealed; ``derived``: the
    sealed leaf is not what is derived; ``manifest`` (no bucket): leaves that the manifest does not stand for;
    ``part`` (no bucket): parts that the package or the derivation alone has.
    """
    said = _manifest(spark, path)
    names = _names(said)
    sealed = sealed_leaves(spark, path)
    derived = spark.createDataFrame([], "name string, value string")
    for name, lines in regenerated.items():
        derived = derived.union(lines.select(F.lit(name).alias("name"), F.col(lines.columns[0]).alias("value")))
    trees = {"disk": _package_lines(spark, path, names), "derived": derived}
    both = sealed.select("name", "bucket", F.col("sha256").alias("sealed"))
    for which, lines in trees.items():
        own = tree_leaves(lines, "name", F.col("value"), LEAF_DIGITS)
        both = both.join(own.select("name", "bucket", F.col("sha256").alias(which)), ["name", "bucket"], "full")
    wrong = [F.when(~F.col("sealed").eqNullSafe(F.col(which)), which) for which in trees]
    leaves = both.select("name", "bucket", F.explode(F.array_compact(F.array(*wrong))).alias("problem"))
    unsaid = _roots(spark, sealed, names).exceptAll(said).select("name", F.lit(None).cast("string").alias("bucket"), F.lit("manifest").alias("problem"))
    other = sorted(set(names) ^ set(regenerated))
    parts = spark.createDataFrame([(n, None, "part") for n in other], "name string, bucket string, problem string")
    return leaves.unionByName(unsaid).unionByName(parts)


def line_differences(spark: SparkSession, path: str, regenerated: dict[str, DataFrame]) -> DataFrame:
    """(name, bucket, line, on_disk, derived): lines of the leaves that differ, and how often each side has them. Equal leaves are hashed, and not read again."""
    leaves = checkpointed(leaf_differences(spark, path, regenerated).filter("bucket is not null").select("name", "bucket").distinct())
    names = [n for n in _names(_manifest(spark, path)) if n in regenerated]
    bucket = F.substring(F.sha2("value", 256), 1, LEAF_DIGITS).alias("bucket")
    disk = _package_lines(spark, path, names, leaves).select("name", bucket, F.col("value").alias("line"), F.lit(1).alias("d"), F.lit(0).alias("r"))
    for name in names:
        lines = regenerated[name]
        again = lines.select(F.lit(name).alias("name"), F.col(lines.columns[0]).alias("value")).select("name", bucket, F.col("value").alias("line"), F.lit(0).alias("d"), F.lit(1).alias("r"))
        disk = disk.unionByName(again.join(leaves.filter(F.col("name") == name).select("bucket"), "bucket", "left_semi"))
    counted = disk.groupBy("name", "bucket", "line").agg(F.sum("d").alias("on_disk"), F.sum("r").alias("derived"))
    return counted.filter("on_disk <> derived")


#: Parts of a closed run's package, and of an open one's, which holds no export.
CLOSED_PARTS = ("cyclonedx", "spdx", "findings", "population", "relationships", "inputs", "tools", "validation", "dashboard", "run")
OPEN_PARTS = ("findings", "population", "relationships", "inputs", "tools", "run")


def write_run_package(spark: SparkSession, path: str, parts: dict[str, DataFrame], gate: DataFrame | None) -> str:
    """Write a closed run's package if ``gate`` (violations) is empty, or an open one's if ``gate`` is None; returns the hash that names it.

    A package has just the parts of its kind. Its COMPLETE mark holds the manifest's hash and is
    written last, so a package without one was cut short.
    """
    wanted = OPEN_PARTS if gate is None else CLOSED_PARTS
    if set(parts) != set(wanted):
        raise ValueError(f"parts {sorted(parts)} of a package that needs {sorted(wanted)}")
    if gate is not None:
        assert_none(gate)
    write_package(spark, path, parts)
    sealed = _sealed(spark, path)
    spark.createDataFrame([(sealed,)], "manifest_sha256 string").coalesce(1).write.mode("errorifexists").json(f"{path}/COMPLETE")
    return sealed


#: Parts of an image's package, and of a scan package, whose envelope stands beside them.
IMAGE_PARTS = ("component-population", "cyclonedx", "dashboard", "evidence-graph", "inputs", "reconciliation", "run", "spdx", "validation")
SCAN_PARTS = ("dashboard", "inputs", "profile-observations", "raw", "reconciliation", "run", "validation")
IMAGE_STATUS, SCAN_STATUS = "PUBLIC_BUILD_REFERENCE_PIPELINE_PASS_OPEN_CANDIDATE", "SELF_TEST_PIPELINE_PASS_OPEN_OBSERVATION"
SCAN_PREDICATE = f"{NAMESPACE}.selftest-pack/v1"


def _complete(spark: SparkSession, path: str, fields: dict[str, str]) -> None:
    """The mark of a whole package, written last."""
    names = sorted(fields)
    row = spark.createDataFrame([tuple(fields[n] for n in names)], ", ".join(f"{n} string" for n in names))
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/COMPLETE")


def write_image_package(spark: SparkSession, path: str, parts: dict[str, DataFrame], run_id: str, canonical_sha256: str, derived: dict[str, DataFrame] | None = None, digits: int = 1) -> str:
    """Seal an image's package; returns the hash that names it.

    ``derived``: the parts as they are derived from the packaged inputs. A package that differs from these in any line is
    not marked as complete, so it is never taken for one.
    """
    if set(parts) != set(IMAGE_PARTS):
        raise ValueError(f"parts {sorted(parts)} of a package that needs {sorted(IMAGE_PARTS)}")
    write_package(spark, path, parts, digits)
    if derived is not None:
        assert_none(leaf_differences(spark, path, derived))
    sealed = _sealed(spark, path)
    _complete(spark, path, {"status": IMAGE_STATUS, "run_id": run_id, "canonical_graph_sha256": canonical_sha256, "manifest_sha256": sealed})
    return sealed


def write_scan_package(spark: SparkSession, path: str, parts: dict[str, DataFrame], run_id: str, canonical_sha256: str, digits: int = 1) -> str:
    """Seal a scan package with its attestation; returns the hash that names it.

    The attestation's subject is the comparison's canonical hash, its predicate the hashes of what is packed. It stands
    beside the parts, as the manifest that it names cannot name it; the mark of completeness binds both.
    """
    if set(parts) != set(SCAN_PARTS):
        raise ValueError(f"parts {sorted(parts)} of a package that needs {sorted(SCAN_PARTS)}")
    manifest = write_package(spark, path, parts, digits)
    sealed = _sealed(spark, path)
    board = F.col("sha256").alias("dashboard_sha256")
    said = F.struct(F.lit("SELF_TEST_NOT_CUSTOMER_EVIDENCE").alias("classification"), board, F.lit(sealed).alias("manifest_sha256"), F.lit(run_id).alias("run_id"))
    row = manifest.filter("name = 'dashboard'").select(attestation("canonical-reconciliation", F.lit(canonical_sha256), SCAN_PREDICATE, said).alias("value"), "sha256").first()
    spark.createDataFrame([(row["value"],)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/STATEMENT")
    _complete(spark, path, {"status": SCAN_STATUS, "run_id": run_id, "canonical_reconciliation_sha256": canonical_sha256, "dashboard_sha256": row["sha256"], "manifest_sha256": sealed, "statement_sha256": hashlib.sha256(row["value"].encode()).hexdigest()})
    return sealed


def sealed_package_violations(spark: SparkSession, path: str, regenerated: dict[str, DataFrame], trusted_sha256: str | None = None) -> DataFrame:
    """(name, bucket, problem) of an image or scan package against what its inputs give: leaves as of leaf_differences(), and a mark, a statement or an anchor that does not bind it."""
    if not _exists(spark, f"{path}/COMPLETE"):
        return spark.createDataFrame([("COMPLETE", None, "missing")], "name string, bucket string, problem string")
    mark, sealed, wrong = spark.read.json(f"{path}/COMPLETE").first().asDict(), _sealed(spark, path), []
    if mark["manifest_sha256"] != sealed:
        wrong.append("COMPLETE")
    if trusted_sha256 is not None and trusted_sha256 != sealed:
        wrong.append("anchor")
    if "statement_sha256" in mark:
        text = spark.read.text(f"{path}/STATEMENT").first()["value"]
        about, body = json.loads(text)["subject"][0], json.loads(text)["predicate"]
        bound = about["digest"]["sha256"] == mark["canonical_reconciliation_sha256"] and all(body[k] == mark[k] for k in ("manifest_sha256", "dashboard_sha256", "run_id"))
        if hashlib.sha256(text.encode()).hexdigest() != mark["statement_sha256"] or not bound:
            wrong.append("STATEMENT")
    marks = spark.createDataFrame([(n, None, "unbound") for n in wrong], "name string, bucket string, problem string")
    return leaf_differences(spark, path, regenerated).unionByName(marks)


def _sealed(spark: SparkSession, path: str) -> str:
    manifest = _manifest(spark, path)
    listed = F.array_sort(F.collect_list(F.struct("name", "rows", "sha256")))  # a package has a handful of parts
    return manifest.agg(F.sha2(F.to_json(listed), 256).alias("h")).first()["h"]


def run_package_violations(spark: SparkSession, path: str, trusted_sha256: str) -> list[str]:
    """What is wrong with a package: parts that changed, a manifest or a mark that is not the one that was trusted."""
    mark = [r.manifest_sha256 for r in spark.read.schema("manifest_sha256 string").json(f"{path}/COMPLETE").collect()]
    found = [f"part {r.name}" for r in package_differences(spark, path).collect()]
    sealed = _sealed(spark, path)
    return found + (["complete"] if mark != [sealed] else []) + (["trusted"] if sealed != trusted_sha256 else [])


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not be there, in one step: of several writers at once one gets True."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop looks first and creates then; the operating system does both at once
        try:
            os.close(os.open(fs.makeQualified(target).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(target, False).close()
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise


def _release_claim(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)


def register_run(spark: SparkSession, registry: str, run: DataFrame) -> None:
    """Enter one ``run`` (run_id, classification, package, dashboard_sha256) into the registry's folder.

    The id is claimed first, by a file that only one writer can create, and the entry is published after that in a
    folder of its own, so writers of different runs do not meet and of two writers of one id the second fails.
    A writer that cannot publish gives its claim back.
    """
    rows = run.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} runs to register")
    key = hashlib.sha256(rows[0]["run_id"].encode()).hexdigest()[:32]
    mark = f"{registry}/_claims/{key}"
    if not claim(spark, mark):
        raise ValueError(f"run {rows[0]['run_id']} is registered, or being registered")
    try:
        spark.createDataFrame(rows, run.schema).coalesce(1).write.mode("errorifexists").parquet(f"{registry}/entry={key}")
    except Exception:
        if not _exists(spark, f"{registry}/entry={key}/_SUCCESS"):
            _release_claim(spark, mark)
        raise


def registered_runs(spark: SparkSession, registry: str) -> DataFrame:
    """All entries of a registry."""
    return spark.read.parquet(registry).drop("entry")


def registered_run(spark: SparkSession, registry: str, run_id: str, dashboard: bytes) -> DataFrame:
    """The one row of a run in the registry, whose dashboard must have the hash that it was registered with."""
    rows = registered_runs(spark, registry).filter(F.col("run_id") == run_id)
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("*")).alias("r"))
    fine = (F.col("n") == 1) & (F.col("r.dashboard_sha256") == F.sha2(F.lit(dashboard), 256))
    return counted.select(F.when(fine, F.col("r")).otherwise(F.raise_error(F.lit(f"run {run_id} is not registered with this dashboard"))).alias("r")).select("r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def dashboard(run_id: str, population: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, kind, subject, status, details): what a reader is shown of a run, its components and all findings but the matched ones."""
    own = population.select(F.lit(run_id).alias("run_id"), F.lit("component").alias("kind"), F.col("population_id").alias("subject"), F.concat_ws(" ", "producer", "name", "version").alias("status"), F.lit("").alias("details"))
    return own.union(findings.filter(F.col("status") != "MATCHED").select(F.lit(run_id), F.lit("finding"), "finding_id", "status", F.array_join("details", ",")))


def run_record(findings: DataFrame, valid: bool) -> DataFrame:
    """One row: state of a run's findings (status) and what may be said of it."""
    state = F.when(F.count_if(F.col("status") != "MATCHED") == 0, "CLOSED").otherwise("OPEN")
    serialization = F.lit("MECHANICALLY_VALID") if valid else F.when(state == "OPEN", "NOT_RUN_RECONCILIATION_OPEN").otherwise("INVALID")
    return findings.agg(state.alias("reconciliation_state"), serialization.alias("serialization_status"), ((state == "CLOSED") & F.lit(valid)).alias("engineering_pass"), F.count_if(F.col("status") != "MATCHED").alias("open_findings"))


def attestation(subject: str, sha256: Column, predicate_type: str, predicate: Column) -> Column:
    """An in-toto statement about one subject, as JSON."""
    about = F.struct(F.struct(sha256.alias("sha256")).alias("digest"), F.lit(subject).alias("name"))
    return F.to_json(F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), predicate.alias("predicate"), F.lit(predicate_type).alias("predicateType"), F.array(about).alias("subject")))
