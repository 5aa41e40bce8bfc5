"""A release analysed whole: component, relationship and declaration findings with ids, claims and evidence.

Edges: lane_id, src, rel, dst (component ids of the lane). Lanes: lane_id, evidence_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions.text import UNKNOWN, stable_id
from corroborate.operators.reconcile import STATES, five_states
from corroborate.operators.rules import assert_none
from corroborate.storage import checkpointed

#: What a candidate may declare, for a closed and for an open reconciliation.
DECLARED = {"CLOSED": "SYNTHETIC_RECONCILED", "OPEN": "SYNTHETIC_RECONCILIATION_OPEN"}
#: Columns of a finding beside its id; those that are not null in a kind of finding make its id.
_SCALARS = ("population_id", "candidate_id", "source_population_id", "relationship", "target_population_id", "source_candidate_id", "target_candidate_id", "status")
_LISTS = ("details", "claim_ids", "evidence_ids")
#: What a finding's id is made of, by its type.
BODIES = {
    "COMPONENT": ("candidate_id", "details", "evidence_ids", "finding_type", "population_id", "status"),
    "RELATIONSHIP": ("claim_ids", "details", "evidence_ids", "finding_type", "source_population_id", "status", "target_population_id"),
    "CANDIDATE_RELATIONSHIP": ("claim_ids", "details", "evidence_ids", "finding_type", "relationship", "source_population_id", "status", "target_population_id"),
    "UNMAPPED": ("claim_ids", "details", "evidence_ids", "finding_type", "relationship", "source_candidate_id", "status", "target_candidate_id"),
    "DECLARED_STATUS_MISMATCH": ("claim_ids", "details", "evidence_ids", "finding_type", "status"),
}


def _none() -> Column:
    return F.array().cast("array<string>")


def _finding(rows: DataFrame, body: str) -> DataFrame:
    """``rows`` as findings of one kind: columns that they lack are null, or empty lists."""
    kind = "CANDIDATE_RELATIONSHIP" if body == "UNMAPPED" else body
    have = set(rows.columns)
    rows = rows.select(
        F.lit(kind).alias("finding_type"), *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in _SCALARS), *(F.col(c) if c in have else _none().alias(c) for c in _LISTS)
    )
    return rows.withColumn("finding_id", stable_id("finding", *(F.col(c) for c in BODIES[body])))


def population_evidence(population: DataFrame, lanes: DataFrame) -> DataFrame:
    """(population_id, evidence_ids) of the lanes in which a population was found."""
    each = population.select("population_id", F.explode("lanes").alias("lane_id")).join(lanes, "lane_id")
    return each.groupBy("population_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def component_findings(candidates: DataFrame, population: DataFrame, lanes: DataFrame) -> DataFrame:
    states = five_states(candidates, population).join(population_evidence(population, lanes), "population_id", "left")
    return _finding(states.withColumn("evidence_ids", F.coalesce("evidence_ids", _none())), "COMPONENT")


def relationship_claims(edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """``edges`` with evidence_id and a claim_id that names the claim's content; evidence_id is null where the lane is not known."""
    rows = edges.join(lanes, "lane_id", "left")
    claim = stable_id("relationship-claim", F.array("evidence_id").alias("evidence_ids"), F.col("lane_id"), F.col("rel").alias("relationship"), F.col("src").alias("source_component_id"), F.col("dst").alias("target_component_id"))
    return rows.withColumn("claim_id", claim)


def sources(population: DataFrame) -> DataFrame:
    """(population_id, lane_id, component_id) of every record."""
    return population.select("population_id", F.explode("sources").alias("s")).select("population_id", "s.lane_id", "s.component_id")


def _mapped(claims: DataFrame, population: DataFrame) -> DataFrame:
    own = sources(population)
    for end in ("src", "dst"):
        claims = claims.join(own.select("lane_id", F.col("component_id").alias(end), F.col("population_id").alias(f"p_{end}")), ["lane_id", end], "left")
    return claims


def unmapped_claims(claims: DataFrame, population: DataFrame) -> DataFrame:
    """(lane_id, src, dst, claim_id) of claims of an unknown lane or with an end that is in no population: any row stops a run."""
    return _mapped(claims, population).filter("p_src is null or p_dst is null or evidence_id is null").select("lane_id", "src", "dst", "claim_id")


def population_errors(population: DataFrame, lanes: DataFrame) -> DataFrame:
    """(subject, rule): records of lanes that are not known, and records that are in two populations, which no edge could be mapped to."""
    own = sources(population)
    strange = own.join(lanes, "lane_id", "left_anti").select(F.concat_ws("/", "lane_id", "component_id").alias("subject"), F.lit("lane").alias("rule"))
    twice = own.groupBy("lane_id", "component_id").count().filter("count > 1").select(F.concat_ws("/", "lane_id", "component_id").alias("subject"), F.lit("repeated source").alias("rule"))
    return strange.unionByName(twice)


def _gathered(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.array_sort(F.collect_set("relationship")).alias("kinds"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.array_sort(F.collect_set("lane_id")).alias("lanes")
    )


def relationship_projection(claims: DataFrame, population: DataFrame) -> DataFrame:
    """(relationship_id, source_population_id, relationship, target_population_id, lanes, claim_ids, evidence_ids): one row per relationship."""
    rows = _mapped(claims, population).filter("p_src is not null and p_dst is not null").select(
        F.col("p_src").alias("source_population_id"), F.col("rel").alias("relationship"), F.col("p_dst").alias("target_population_id"), "lane_id", "claim_id", "evidence_id"
    )
    rows = _gathered(rows, "source_population_id", "relationship", "target_population_id").drop("kinds")
    own = stable_id("relationship", F.col("claim_ids"), F.col("lanes").alias("discovery_lanes"), F.col("evidence_ids"), F.col("relationship"), F.col("source_population_id"), F.col("target_population_id"))
    return rows.withColumn("relationship_id", own)


def relationship_findings(projection: DataFrame) -> DataFrame:
    """Ends whose relationship is unknown, or of several kinds."""
    ends = projection.groupBy("source_population_id", "target_population_id").agg(
        F.array_sort(F.collect_set("relationship")).alias("kinds"), F.array_sort(F.flatten(F.collect_list("claim_ids"))).alias("claim_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids")
    )
    unknown = F.array_contains("kinds", UNKNOWN)
    status = F.when(unknown, "UNKNOWN").when(F.size("kinds") > 1, "CONFLICT")
    return _finding(ends.withColumn("status", status).filter("status is not null").withColumn("details", F.when(unknown, F.array(F.lit("relationship"))).otherwise(F.col("kinds"))), "RELATIONSHIP")


def declared_findings(projection: DataFrame, declared: DataFrame, components: DataFrame) -> DataFrame:
    """Relationships that the candidate declares (src, rel, dst: candidate ids) against those found; ``components``: findings."""
    mapping = components.filter("candidate_id is not null and population_id is not null").groupBy("candidate_id").agg(F.max_by("population_id", "finding_id").alias("population_id"))
    ends = [mapping.select(F.col("candidate_id").alias(e), F.col("population_id").alias(f"p_{e}")) for e in ("src", "dst")]
    both = declared.select("src", F.col("rel").alias("relationship"), "dst").join(ends[0], "src", "left").join(ends[1], "dst", "left")
    lost = F.col("p_src").isNull() | F.col("p_dst").isNull()
    unknown = both.filter(lost).select(F.col("src").alias("source_candidate_id"), "relationship", F.col("dst").alias("target_candidate_id"), F.lit("UNKNOWN").alias("status"), F.array(F.lit("candidate_relationship_endpoint_not_reconciled")).alias("details"))
    keys = ["source_population_id", "relationship", "target_population_id"]
    said = both.filter(~lost).select(F.col("p_src").alias(keys[0]), "relationship", F.col("p_dst").alias(keys[2])).distinct().withColumn("said", F.lit(True))
    met = projection.select(*keys, "claim_ids", "evidence_ids", F.lit(True).alias("found")).join(said, keys, "full")
    status = F.when(F.col("found") & F.col("said"), "MATCHED").when(F.col("found"), "MISSING_FROM_SBOM").otherwise("NOT_IN_RELEASE")
    details = F.when(status == "MATCHED", _none()).when(status == "MISSING_FROM_SBOM", F.array(F.lit("candidate_relationship_missing"))).otherwise(F.array(F.lit("candidate_relationship_not_supported_by_discovery")))
    met = met.select(*keys, status.alias("status"), details.alias("details"), F.coalesce("claim_ids", _none()).alias("claim_ids"), F.coalesce("evidence_ids", _none()).alias("evidence_ids"))
    return _finding(met, "CANDIDATE_RELATIONSHIP").unionByName(_finding(unknown, "UNMAPPED"))


def counts(findings: DataFrame) -> DataFrame:
    """One row: findings in each state, blocking_statuses (all but MATCHED that occur) and state."""
    rows = findings.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATES))
    blocking = F.array_sort(F.array_compact(F.array(*(F.when(F.col(s.lower()) > 0, s) for s in STATES[1:]))))
    return rows.withColumn("blocking_statuses", blocking).withColumn("state", F.when(F.size("blocking_statuses") == 0, "CLOSED").otherwise("OPEN"))


def status_mismatch(findings: DataFrame, declared_status: str) -> DataFrame:
    """A finding, if what the candidate declares is not what the other findings come to; a status that none may declare is an error."""
    if declared_status not in DECLARED.values():
        raise ValueError(f"declared status {declared_status!r}")
    computed = F.when(F.col("state") == "CLOSED", DECLARED["CLOSED"]).otherwise(DECLARED["OPEN"])
    rows = counts(findings).filter(computed != declared_status)
    return _finding(rows.select(F.lit("CONFLICT").alias("status"), F.array(F.lit(f"declared={declared_status}"), F.concat(F.lit("computed="), computed)).alias("details")), "DECLARED_STATUS_MISMATCH")


def analyse(population: DataFrame, candidates: DataFrame, edges: DataFrame, declared: DataFrame, lanes: DataFrame, declared_status: str) -> DataFrame:
    """All findings of a release. Records or claims of an unknown lane, and claims whose ends are in no population, stop it."""
    population = checkpointed(population)
    assert_none(population_errors(population, lanes))
    claims = relationship_claims(edges, lanes)
    assert_none(unmapped_claims(claims, population))
    projection = checkpointed(relationship_projection(claims, population))
    components = checkpointed(component_findings(candidates, population, lanes))
    # Each kind in a step of its own: their shuffle files are never there together.
    found = components.unionByName(checkpointed(relationship_findings(projection))).unionByName(checkpointed(declared_findings(projection, declared, components)))
    return found.unionByName(status_mismatch(found, declared_status))


#: Fields that a component may change between releases; an added or removed one is shown with all but the last.
COMPARED = ("producer", "name", "version", "identifiers", "hashes")


def _keyed(population: DataFrame) -> DataFrame:
    """``population`` with ``key``, the sorted set of its component ids; two populations of one key are an error, as nothing would tell them apart."""
    key = F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["component_id"])))
    rows = population.select("population_id", key.alias("key"), *COMPARED)
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return rows.withColumn("n", n).withColumn("key", F.when(F.col("n") == 1, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.array_join("key", ","))).cast("array<string>"))).drop("n")


def component_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_component_ids, change, changed_fields, previous, current) of populations of two releases.

    Both sides meet on the set of component ids, hashed and compared as an array. previous and current are JSON of
    the changed fields, or of all but the hashes where a component is added or removed.
    """
    sides = [side.select("key", F.struct(*COMPARED).alias(name)) for side, name in ((_keyed(before), "b"), (_keyed(after), "a"))]
    both = sides[0].join(sides[1], "key", "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), f) for f in COMPARED)))
    change = F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "REMOVED").when(F.size(changed) > 0, "MODIFIED")

    def shown(side: str) -> Column:
        kept = lambda f: F.when(F.when(F.col("change") == "MODIFIED", F.array_contains("changed_fields", f)).otherwise(f != COMPARED[-1]), F.col(f"{side}.{f}")).alias(f)
        return F.when(F.col(side).isNotNull(), F.to_json(F.struct(*map(kept, COMPARED))))

    rows = both.withColumn("change", change).filter("change is not null").withColumn("changed_fields", F.when(F.col("change") == "MODIFIED", changed).otherwise(_none()))
    return rows.select(F.col("key").alias("source_component_ids"), "change", "changed_fields", shown("b").alias("previous"), shown("a").alias("current"))


def relationship_changes(before: DataFrame, after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(from, relationship, to, change): relationships (as relationship_projection()) that one release alone has, between sets of component ids."""

    def keyed(population: DataFrame, edges: DataFrame) -> DataFrame:
        keys = _keyed(population)
        ends = [keys.select(F.col("population_id").alias(f"{end}_population_id"), F.col("key").alias(name)) for end, name in (("source", "from"), ("target", "to"))]
        return edges.join(ends[0], "source_population_id").join(ends[1], "target_population_id").select("from", "relationship", "to").distinct()

    names = ["from", "relationship", "to"]
    both = keyed(before, edges_before).withColumn("b", F.lit(True)).join(keyed(after, edges_after).withColumn("a", F.lit(True)), names, "full")
    return both.filter("a is null or b is null").select(*names, F.when(F.col("b").isNull(), "ADDED").otherwise("REMOVED").alias("change"))


def gate_violations(population: DataFrame, findings: DataFrame) -> DataFrame:
    """(subject, rule): what keeps a release from being exported: open findings, and components with conflicts, unknowns or no identifier."""
    blocking = findings.filter(F.col("status") != "MATCHED").select(F.col("finding_id").alias("subject"), F.lit("open").alias("rule"))
    full = lambda c: (F.col(c) != "") & (F.col(c) != UNKNOWN)
    fine = {"conflicts": F.size("conflict_fields") == 0, "unknowns": F.size("critical_unknown_fields") == 0, "identifier": F.size("identifiers") > 0} | {c: full(c) for c in ("producer", "name", "version")}
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in fine.items())))
    empty = population.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("population").alias("subject"), F.lit("empty").alias("rule"))
    return blocking.union(population.select(F.col("population_id").alias("subject"), F.explode(broken).alias("rule"))).union(empty)
