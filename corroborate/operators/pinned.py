"""Documents that are read by a pin: no entry leaves before bytes, size, kind and shape of its document are right.

pins: path, sha256, max_bytes, kind. A document is one bounded row, as its pin's size is a limit that is
checked first; its entries are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions.document import canonical_sha256, canonical_text
from corroborate.operators import registry
from corroborate.operators.rules import violations

#: Kinds of registries, the list of entries in each, and the key of an entry. The last has no type of its own.
KINDS = {"source-dataset-registry": ("sources", "dataset_id"), "runtime-registry": ("runtimes", "runtime_id"), "vex-issuer-registry": ("issuers", "issuer_id"), "image-profile-registry": ("profiles", "profile_id")}
UNTYPED = ("image-profile-registry",)
SCHEMA_VERSION = "1.0"
#: Bytes of the largest document that any pin may allow.
MOST_BYTES = 8 << 20


def pinned_files(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """(path, size, content) of files below ``path``; content is null, and was not read, beyond MOST_BYTES. ``path`` is relative to the folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = F.expr("substring(path, instr(path, root) + length(root))")
    rows = found.withColumn("root", F.lit(path.rstrip("/") + "/"))
    small = rows.filter(F.col("length") <= MOST_BYTES).select(own.alias("path"), F.col("length").alias("size"), "content")
    large = rows.filter(F.col("length") > MOST_BYTES).select(own.alias("path"), F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def _mapped(column: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[column]


def load(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(path, kind, sha256, size, problem, body) of every pinned or found document; body is its canonical JSON, and null where there is a problem.

    The first problem counts: unpinned, missing, size, sha256, json, kind (unknown, or not the pinned one), keys, schema_version, entries.
    """
    both = pins.withColumn("pinned", F.lit(True)).join(files.select("path", "size", "content").withColumn("found", F.lit(True)), "path", "full")
    both = both.withColumn("raw", F.decode("content", "UTF-8")).withColumn("body", canonical_text(F.col("raw")))
    field = lambda name: F.get_json_object("body", f"$.{name}")
    listed = _mapped(F.col("kind"), {k: v[0] for k, v in KINDS.items()})
    untyped = F.col("kind").isin(*UNTYPED)
    said = F.when(untyped, F.when(field("registry_type").isNull(), F.col("kind"))).otherwise(field("registry_type"))
    keys = F.when(untyped, F.array(listed, F.lit("schema_version"))).otherwise(F.array(listed, F.lit("registry_type"), F.lit("schema_version"), F.lit("updated_at")))
    entries = F.try_parse_json(F.element_at(F.from_json("body", "map<string,string>"), listed)).try_cast("array<variant>")
    checks = {
        "unpinned": F.col("pinned"), "missing": F.col("found"), "size": (F.col("size") <= F.col("max_bytes")) & F.col("content").isNotNull(), "sha256": F.sha2("content", 256) == F.col("sha256"), "json": F.col("body").isNotNull(),
        "kind": (F.col("kind").isin(*KINDS)) & (said == F.col("kind")), "keys": F.array_sort(F.json_object_keys("body")) == F.array_sort(keys), "schema_version": field("schema_version") == SCHEMA_VERSION, "entries": F.size(entries) > 0,
    }
    problem = F.lit(None).cast("string")
    for name, fine in reversed(checks.items()):
        problem = F.when(~F.coalesce(fine, F.lit(False)), name).otherwise(problem)
    rows = both.withColumn("problem", problem)
    return rows.select("path", "kind", F.when(F.col("found"), F.sha2("content", 256)).alias("sha256"), "size", "problem", F.when(F.col("problem").isNull(), F.col("body")).alias("body"))


def entries(loaded: DataFrame, kind: str) -> DataFrame:
    """(path, entry, entry_sha256, position) of the entries of one kind of document, as canonical JSON with its hash."""
    rows = loaded.filter((F.col("kind") == kind) & F.col("problem").isNull())
    listed = F.try_parse_json(F.element_at(F.from_json("body", "map<string,string>"), KINDS[kind][0])).try_cast("array<variant>")
    each = rows.select("path", F.posexplode(listed).alias("position", "v")).withColumn("entry", F.to_json("v"))
    return each.select("path", "position", "entry", canonical_sha256(F.col("entry")).alias("entry_sha256"))


_RUNTIME = "runtime_id string, category string, name string, version string, source_url string, resolved_commit string, license_expression string, status string, artifact_sha256 string, config_sha256 string, dependency_manifest_sha256 string, notes string"
_ISSUER = "issuer_id string, display_name string, identity_kind string, public_key_path string, public_key_sha256 string, acquisition_receipt_ref string, status string, boundary string"
_SOURCE = """dataset_id string, root_id string, name string, source_type string, upstream_url string, lineage_group string, notes string,
    pin struct<ref_type: string, ref_name: string, resolved_commit: string, tag_object: string, acquisition_artifact_sha256: string>,
    license struct<expression: string, review_status: string, evidence_paths: array<string>, evidence_hashes: map<string, string>, content_scopes: array<struct<scope: string, expression: string, training_allowed: boolean, raw_redistribution_allowed: boolean>>>,
    governance struct<admission_status: string, purposes: array<string>, split: string, acquisition_allowed: boolean, internal_development_allowed: boolean, evaluation_allowed: boolean, training_allowed: boolean, fixture_distribution_allowed: boolean,
        raw_redistribution_allowed: boolean, adapter_distribution_allowed: boolean, weight_distribution_allowed: boolean, shipping_examples_allowed: boolean, redistribution_status: string, access_terms_status: string, tdm_reservation_status: string,
        submodules_status: string, lfs_status: string, generated_content_status: string, binary_content_status: string, attribution_status: string, acquisition_status: string, rights_status: string, usage_status: string, format_validation_status: string,
        release_status: string, rights_decision_ref: string, rights_decision_sha256: string, revalidation_triggers: array<string>>,
    acquisition struct<allow_submodules: boolean, execute_code: boolean, max_files: long, max_total_bytes: long>"""


def _typed(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Entries with their fields, their subject (path and key), and the names of their fields."""
    parsed = rows.select("path", F.from_json("entry", schema).alias("e"), F.array_sort(F.json_object_keys("entry")).alias("keys"))
    return parsed.select("path", "keys", "e.*").withColumn("subject", F.concat_ws("#", "path", key))


def _exact(schema: str) -> Column:
    from pyspark.sql.types import StructType

    names = sorted(StructType.fromDDL(schema).fieldNames())
    return F.col("keys") == F.array(*map(F.lit, names))


def source_rows(loaded: DataFrame) -> DataFrame:
    """Sources with the columns that registry.source_rules() and registry.source_document_rules() read."""
    rows = _typed(entries(loaded, "source-dataset-registry"), "dataset_id", _SOURCE)
    rows = rows.select("*", "pin.*", "license.*", "governance.*", "acquisition.*").drop("pin", "license", "governance", "acquisition")
    return rows.withColumns({"archive_sha256": F.col("acquisition_artifact_sha256"), "evidence_sha256": F.map_values("evidence_hashes"), "scopes": F.col("content_scopes")})


def entry_violations(loaded: DataFrame) -> DataFrame:
    """(subject, rule) of all entries of all admitted registries, each against the rules of its kind; an id counts as repeated within its document."""
    runtimes = _typed(entries(loaded, "runtime-registry"), "runtime_id", _RUNTIME)
    issuers = _typed(entries(loaded, "vex-issuer-registry"), "issuer_id", _ISSUER)
    sources = source_rows(loaded)
    found = None
    for rows, rules in (
        (runtimes, registry.runtime_rules() | {"keys": _exact(_RUNTIME)}),
        (issuers, registry.issuer_rules() | {"keys": _exact(_ISSUER), "identity_kind": F.col("identity_kind") == "cosign-offline-key"}),
        (sources, registry.source_rules() | registry.source_document_rules() | {"keys": _exact(_SOURCE)}),
    ):
        own = violations(rows, "subject", {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}).union(registry.repeated(rows, "subject"))
        found = own if found is None else found.union(own)
    return found


def find_source(loaded: DataFrame, dataset_id: str) -> DataFrame:
    """The one source of that id, which must be there once, not rejected and allowed to be acquired; anything else is an error."""
    rows = source_rows(loaded).filter(F.col("dataset_id") == dataset_id)
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("dataset_id", "root_id", "admission_status", "acquisition_allowed")).alias("s"))
    fine = (F.col("n") == 1) & (F.col("s.admission_status") != "REJECT") & F.col("s.acquisition_allowed")
    return one.select(F.when(fine, F.col("s")).otherwise(F.raise_error(F.lit(f"source {dataset_id} cannot be acquired"))).alias("s")).select("s.*")
