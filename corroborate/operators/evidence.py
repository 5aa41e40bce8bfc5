"""Claims, manifests, profiles, cards and other groupings over evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions.text import UNKNOWN, canonical_json, stable_id
from corroborate.operators.hashing import list_sha256
from corroborate.operators.rules import violations

#: Claims on one conflict card at most: the first by id.
CARD_CLAIMS = 64
#: Bytes of a card's claims at most, and questions of an advice.
CARD_BYTES, QUESTIONS = 32 * 1024, 16
#: What an advice may do, and the bounds that it must state.
ACTIONS = ("suggest_mapping", "suggest_merge", "ask_for_evidence", "explain_conflict", "abstain")
BOUNDARIES = ("NO_FACT_WRITE_NO_STATE_CHANGE_NO_RELEASE_OR_CONFORMITY_AUTHORITY", "NO_FACT_WRITE_NO_STATE_CHANGE_HUMAN_REVIEW_REQUIRED")


def claims(records: DataFrame, fields: list[str]) -> DataFrame:
    """(claim_id, lane_id, component_id, field, value): one claim per field and per identifier of ``records``.

    Nulls become UNKNOWN, booleans true or false. The id is made of the claim's content.
    """
    named = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(UNKNOWN)).alias("value")) for f in fields]
    listed = F.when(F.size("identifiers") > 0, F.col("identifiers")).otherwise(F.array(F.lit(UNKNOWN)))
    several = F.transform(listed, lambda i: F.struct(F.lit("identifier").alias("field"), i.alias("value")))
    rows = records.select("lane_id", "component_id", F.explode(F.concat(F.array(*named), several)).alias("c")).select("lane_id", "component_id", "c.field", "c.value")
    source = F.col("component_id").alias("source_component_id")
    return rows.withColumn("claim_id", stable_id("claim", F.col("field"), F.col("lane_id"), source, F.col("value")))


def dangling_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (claim_id, evidence_ids) that cite evidence which is not there: any row stops a run."""
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id"))
    return cited.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("claim_id", "evidence_id")


def manifest_totals(files: DataFrame) -> DataFrame:
    """One row: file_count, total_bytes and executables of files (path, sha256, size, executable)."""
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.count_if("executable").alias("executables"))


def exact_set_hash(files: DataFrame) -> DataFrame:
    """(root_id, exact_set_sha256): hash of each root's list of files (root_id, path, sha256, size, executable), sorted by path."""
    entry = canonical_json(F.col("executable"), F.col("path").alias("relative_path"), F.col("sha256"), F.col("size"))
    tail = F.to_json(F.struct("root_id"))
    hashed = list_sha256(files, "root_id", entry, ["path"], F.lit('{"files":['), F.concat(F.lit("],"), F.substring(tail, F.lit(2), F.length(tail))))
    return hashed.withColumnRenamed("sha256", "exact_set_sha256")


def manifest_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, side): entries (path, size, executable) of one side alone."""
    keys = ["path", "size", "executable"]
    missing = left.select(*keys).exceptAll(right.select(*keys)).select("path", F.lit("missing").alias("side"))
    return missing.union(right.select(*keys).exceptAll(left.select(*keys)).select("path", F.lit("extra").alias("side")))


def version_conflicts(observations: DataFrame) -> DataFrame:
    """(logical_key, versions, kinds) of keys with two versions and two kinds of profile (profile_kind, logical_key, version)."""
    grouped = observations.groupBy("logical_key").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_set("profile_kind")).alias("kinds"))
    return grouped.filter((F.size("versions") > 1) & (F.size("kinds") > 1))


def stale_portable(observations: DataFrame, portable: str = "PORTABLE_RUNTIME") -> DataFrame:
    """(logical_key, stale, reference): portable versions that no other profile has, where others have any."""
    is_portable = F.col("profile_kind") == portable
    grouped = observations.groupBy("logical_key").agg(
        F.array_sort(F.collect_set(F.when(is_portable, F.col("version")))).alias("portable"), F.array_sort(F.collect_set(F.when(~is_portable, F.col("version")))).alias("reference")
    )
    stale = F.array_except("portable", "reference")
    return grouped.filter((F.size("reference") > 0) & (F.size(stale) > 0)).select("logical_key", F.array_sort(stale).alias("stale"), "reference")


def unidentified(observations: DataFrame) -> DataFrame:
    """(profile_kind, n) of observations without a key."""
    return observations.groupBy("profile_kind").agg(F.count_if(F.col("logical_key").isNull()).alias("n"))


def coverage(components: DataFrame, columns: list[str]) -> DataFrame:
    """One row: components, and those with each column neither null nor empty."""
    return components.agg(F.count(F.lit(1)).alias("components"), *(F.count_if(F.col(c).isNotNull() & (F.col(c) != "")).alias(f"with_{c}") for c in columns))


def conflict_cards(claims: DataFrame, most: int = CARD_CLAIMS, longest: int = CARD_BYTES) -> DataFrame:
    """(conflict_id, n_claims, claims, claim_ids, evidence, bytes, fits): one card per conflict of claims (conflict_id, claim_id, value, evidence_id).

    A card shows the first ``most`` claims by id; n_claims counts all of the conflict, fits says
    whether all are shown and the card's claims have at most ``longest`` bytes of JSON.
    """
    merged = claims.groupBy("conflict_id", "claim_id").agg(F.min("value").alias("value"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_refs"))
    first, all_of = Window.partitionBy("conflict_id").orderBy("claim_id"), Window.partitionBy("conflict_id")
    kept = merged.withColumn("place", F.row_number().over(first)).withColumn("n", F.count(F.lit(1)).over(all_of)).filter(F.col("place") <= most)
    cards = kept.groupBy("conflict_id").agg(
        F.max("n").alias("n_claims"), F.array_sort(F.collect_list(F.struct("claim_id", "evidence_refs", "value"))).alias("claims"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_refs")))).alias("evidence")
    )
    size = F.octet_length(F.to_json("claims", {"ignoreNullFields": "false"})).cast("long")
    cards = cards.select("conflict_id", "n_claims", "claims", F.col("claims.claim_id").alias("claim_ids"), "evidence", size.alias("bytes"))
    return cards.withColumn("fits", (F.col("n_claims") <= most) & (F.col("bytes") <= longest))


def rule_advice(cards: DataFrame) -> DataFrame:
    """The advice that needs no model: cite all claims and all evidence and ask for more."""
    return cards.select(
        "conflict_id", F.lit(BOUNDARIES[0]).alias("authority_boundary"), F.lit("ask_for_evidence").alias("action"), F.col("claim_ids").alias("claim_refs"), F.col("evidence").alias("evidence_refs"),
        F.lit("claims differ").alias("explanation"), F.array(F.lit("which source holds")).alias("questions"),
    )


def advice_rules() -> dict[str, Column]:
    """What advice beside its card (claim_ids, evidence) must keep to."""
    unique = lambda c: F.size(c) == F.size(F.array_distinct(c))
    plain = lambda c: (c != "") & ~c.rlike(r"[\x00-\x1f]")
    return {
        "card": F.col("claim_ids").isNotNull(), "boundary": F.col("authority_boundary").isin(*BOUNDARIES), "action": F.col("action").isin(*ACTIONS),
        "claims": unique("claim_refs") & (F.size(F.array_except("claim_refs", "claim_ids")) == 0), "evidence": unique("evidence_refs") & (F.size(F.array_except("evidence_refs", "evidence")) == 0),
        "cites": (F.col("action") == "abstain") | (F.size("evidence_refs") > 0), "explanation": plain(F.col("explanation")),
        "questions": unique("questions") & (F.size("questions") <= QUESTIONS) & F.forall("questions", lambda q: F.coalesce(plain(q), F.lit(False))),
    }


def advice_violations(advice: DataFrame, cards: DataFrame) -> DataFrame:
    """(conflict_id, rule) of advice that cites what its card lacks or the same twice, does what none may, or lacks evidence, explanation or questions.

    advice: conflict_id, authority_boundary, action, claim_refs, evidence_refs, explanation, questions; a null breaks its rule.
    """
    rows = advice.join(cards.select("conflict_id", "claim_ids", "evidence"), "conflict_id", "left")
    return violations(rows, "conflict_id", advice_rules())


def arm_metrics(results: DataFrame) -> DataFrame:
    """(arm_id, results, valid, rate, gate): per arm of results (arm_id, valid); the gate is open if every arm's rate is 1."""
    arms = results.groupBy("arm_id").agg(F.count(F.lit(1)).alias("results"), F.count_if("valid").alias("valid"))
    arms = arms.withColumn("rate", F.col("valid") / F.col("results"))
    return arms.join(F.broadcast(arms.agg((F.min("rate") == 1.0).alias("gate"))))  # one row


def run_catalogue(findings: DataFrame) -> DataFrame:
    """(run_id, findings, open_findings, status) of each run, in the order of ids."""
    rows = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("status") != "MATCHED").alias("open_findings"))
    return rows.withColumn("status", F.when(F.col("open_findings") > 0, "OPEN").otherwise("CLOSED"))


def one_row(rows: DataFrame, condition: Column, what: str) -> DataFrame:
    """The one row that meets the condition; none or several raise an error when it is read."""
    found = rows.filter(condition).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("*")).alias("row"))
    return found.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit(f"not exactly one {what}"))).alias("row")).select("row.*")


def finding_claims(findings: DataFrame, sources: DataFrame, claims: DataFrame, most: int = CARD_CLAIMS) -> DataFrame:
    """(finding_id, claim_id, value): claims of a finding's records, of the fields that it names (all if none), the first ``most`` by id.

    findings: finding_id, population_id, details; sources: population_id, lane_id, component_id;
    claims: claim_id, lane_id, component_id, field, value.
    """
    met = findings.join(sources, "population_id").join(claims, ["lane_id", "component_id"]).filter((F.size("details") == 0) | F.array_contains(F.col("details"), F.col("field")))
    first = Window.partitionBy("finding_id").orderBy("claim_id")
    return met.select("finding_id", "claim_id", "value").distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("place")
