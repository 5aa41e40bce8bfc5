"""Which bytes a finding rests on: from findings over evidence to files, and what was run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import canonical_json


def finding_files(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(image, finding_id, role, relative_path, sha256, size, lane_id): the files that each finding (image, finding_id, evidence_ids) rests on.

    evidence: image, evidence_id, role, relative_path, sha256, size, lane_id. The join is closed: evidence that no file
    stands for, and a finding without any, stop it. A file of an image carries most of its findings; Spark splits such a key's rows.
    """
    each = findings.select("image", "finding_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    both = each.join(evidence.select("image", "evidence_id", "role", "relative_path", "sha256", "size", "lane_id"), ["image", "evidence_id"], "left")
    rooted = F.when(F.col("sha256").isNotNull(), F.col("finding_id")).otherwise(F.raise_error(F.concat(F.lit("no file for "), "finding_id")))
    return both.select("image", rooted.alias("finding_id"), "role", "relative_path", "sha256", "size", "lane_id")


def file_findings(files: DataFrame) -> DataFrame:
    """(image, role, relative_path, sha256, findings): how many findings (as of finding_files()) rest on each file, the other way round."""
    return files.groupBy("image", "role", "relative_path", "sha256").agg(F.countDistinct("finding_id").alias("findings"))


def input_records(release: DataFrame) -> DataFrame:
    """(release_id, line): the provenance record of each release's inputs, as canonical JSON."""
    record = F.struct(*sorted(release.columns))
    body = canonical_json(F.col("build_id"), F.col("classification"), F.col("artifact_sha256").alias("release_artifact_sha256"), F.col("release_id"), record.alias("release_record"), F.lit("1.0").alias("schema_version"))
    return release.select("release_id", body.alias("line"))


def tool_records(lanes: DataFrame) -> DataFrame:
    """(run_id, line): what was run for each run: its lanes (run_id, classification, lane_id, adapter_id, adapter_version, independence_domain), and no model, as rules alone decide."""
    said = F.struct("adapter_id", "adapter_version", "independence_domain", "lane_id")
    rows = lanes.groupBy("run_id", "classification").agg(F.array_sort(F.collect_list(F.struct("lane_id", said.alias("said")))).alias("lanes"))  # a run has a handful of lanes
    null = F.lit(None).cast("string")
    body = canonical_json(F.col("classification"), null.alias("config"), F.transform("lanes", lambda x: x["said"]).alias("lane_identities"), null.alias("model_card"), F.lit("1.0").alias("schema_version"))
    return rows.select("run_id", body.alias("line"))
