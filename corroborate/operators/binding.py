"""What must hold between documents, and keys and hashes that bind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import UNKNOWN, canonical_json, cpe_key, fully, purl_key
from corroborate.operators.hashing import tree_sha256

#: Statuses that data of no customer may not have, classifications of references, and the status that these must have.
FORBIDDEN = ("SBOM_RELEASE_AUTHORIZED_BY_MANUFACTURER", "SBOM_ARTIFACT_RELEASED", "CRA_COMPLIANT", "CONFORMITY_CONFIRMED", "CAB_APPROVED", "CERTIFIED")
REFERENCES = ("PUBLIC_BUILD_REFERENCE_NOT_CUSTOMER_EVIDENCE", "SELF_TEST_NOT_CUSTOMER_EVIDENCE")
NO_CONFORMITY = "NO_PRODUCT_CONFORMITY_STATUS"
#: Arms of one evaluation at most.
ARMS = 1000


def _texts(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != UNKNOWN))))


def split_identifiers(candidates: DataFrame) -> DataFrame:
    """Typed identifiers (array of type, value, algorithm) as the arrays of a candidate: identifiers, roles, provenances, hashes, supplier_hashes.

    A provenance is kind:locator and is kept only with both parts; a hash needs its algorithm.
    """

    def of(*kinds: str) -> Column:
        return F.transform(F.filter("typed", lambda t: t["type"].isin(*kinds)), lambda t: t["value"])

    hashes, supplied = (F.transform(F.filter("typed", lambda t: (t["type"] == kind) & t["algorithm"].isNotNull()), lambda t: F.concat_ws(":", t["algorithm"], t["value"])) for kind in ("OBSERVED_HASH", "SUPPLIER_HASH"))
    sources = F.filter(of("PROVENANCE"), lambda p: (F.size(F.split(p, ":", 2)) == 2) & (F.split(p, ":", 2)[0] != "") & (F.split(p, ":", 2)[1] != ""))
    return candidates.select(
        "candidate_id", _texts(of("PURL", "SYNTHETIC_URN")).alias("identifiers"), _texts(of("COMPONENT_ROLE")).alias("roles"), _texts(sources).alias("provenances"), _texts(hashes).alias("hashes"), _texts(supplied).alias("supplier_hashes")
    )


def comparison_keys(components: DataFrame) -> DataFrame:
    """``components`` (purl, cpe) with logical_key: the package URL's, else the CPE's, else null."""
    return components.withColumn("logical_key", F.coalesce(purl_key(F.col("purl")), F.when(cpe_key(F.col("cpe")).isNotNull(), F.concat(F.lit("cpe:"), cpe_key(F.col("cpe"))))))


def utc(column: Column) -> Column:
    """A timestamp written as YYYY-MM-DDTHH:MM:SS[.f]Z, or null."""
    return F.when(fully(column, r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z"), F.try_to_timestamp(column))


def timestamp_violations(releases: DataFrame) -> DataFrame:
    """(release_id, rule) of releases whose times (release_timestamp, evidence_cutoff) are no times, or whose cutoff is later."""
    at, cutoff = utc(F.col("release_timestamp")), utc(F.col("evidence_cutoff"))
    rule = F.when(at.isNull() | cutoff.isNull(), "format").when(cutoff > at, "order")
    return releases.select("release_id", rule.alias("rule")).filter("rule is not null")


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of fields in which two documents of one key differ; a key on one side alone differs in its key."""
    l, r = left.select(key, *(F.col(f).alias(f"l_{f}") for f in fields), F.lit(1).alias("in_l")), right.select(key, *(F.col(f).alias(f"r_{f}") for f in fields), F.lit(1).alias("in_r"))
    alone = F.col("in_l").isNull() | F.col("in_r").isNull()
    different = F.array_compact(F.array(F.when(alone, key), *(F.when(~alone & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f) for f in fields)))
    return l.join(r, key, "full").select(key, F.explode(different).alias("field"))


def layer_budget(members: DataFrame, most_members: int, most_bytes: int) -> DataFrame:
    """(archive, members, bytes, largest, within): totals of archives (archive, path, size) against a budget."""
    totals = members.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return totals.withColumn("within", (F.col("members") <= most_members) & (F.col("bytes") <= most_bytes))


def arm_coverage(cards: DataFrame, results: DataFrame) -> DataFrame:
    """(arm_id, conflict_id, problem): cards that an arm has no result for or several, and results without a card."""
    arms = results.select("arm_id").distinct()
    # Every card is asked of every arm.
    if (n := arms.limit(ARMS + 1).count()) > ARMS:
        raise ValueError(f"{n} arms or more")
    asked = cards.select("conflict_id").distinct().join(F.broadcast(arms))
    given = results.groupBy("arm_id", "conflict_id").agg(F.count(F.lit(1)).alias("n"))
    both = asked.withColumn("asked", F.lit(True)).join(given, ["arm_id", "conflict_id"], "full")
    problem = F.when(F.col("asked").isNull(), "no card").when(F.col("n").isNull(), "no result").when(F.col("n") > 1, "several results")
    return both.select("arm_id", "conflict_id", problem.alias("problem")).filter("problem is not null")


def field_claims(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(population_id, field, claim_ids) of the claims (claim_id, lane_id, component_id, field) of each population's records."""
    met = sources.join(claims, ["lane_id", "component_id"])
    return met.groupBy("population_id", "field").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))


def ordered_hash(rows: DataFrame, position: str, fields: list[str]) -> DataFrame:
    """One row: a hash of the rows in the order of ``position``, whatever order they are read in; sets may have any size."""
    line = canonical_json(F.col(position).alias("at"), *(F.col(f) for f in sorted(fields)))
    return tree_sha256(rows.withColumn("set", F.lit("")), "set", line).select(F.col("sha256").alias("ordered_sha256"))


def status_violations(rows: DataFrame) -> DataFrame:
    """(run_id, rule) of served rows that are not a customer's and claim more than they may.

    Rows whose classification is neither synthetic nor a reference are passed over. Of the
    others, no column ``status`` or ``..._status`` may hold a word of FORBIDDEN, whatever its case;
    references carry no manufacturer_role, and NO_CONFORMITY as product_conformity_status.
    """
    reference = F.col("classification").isin(*REFERENCES)
    guarded = F.coalesce(reference | F.col("classification").startswith("SYNTHETIC"), F.lit(False))
    named = [c for c in rows.columns if c == "status" or c.endswith("_status")]
    broken = F.array_compact(
        F.array(
            F.when(reference & F.col("manufacturer_role").isNotNull(), "manufacturer_role"),
            F.when(reference & ~F.col("product_conformity_status").eqNullSafe(F.lit(NO_CONFORMITY)), "product_conformity"),
            *(F.when(F.upper(F.col(c)).isin(*FORBIDDEN), c) for c in named),
        )
    )
    return rows.filter(guarded).select("run_id", F.explode(broken).alias("rule"))


def limitations(population: DataFrame) -> DataFrame:
    """(population_id, fields): rows with unknown fields that block nothing."""
    return population.filter(F.size("nonblocking_unknown_fields") > 0).select("population_id", F.col("nonblocking_unknown_fields").alias("fields"))


def root_of(population: DataFrame, identity: dict[str, str]) -> DataFrame:
    """(population_id) of the one row that is the release itself: its producer, name and version, with the root role. None or several are an error."""
    same = F.array_contains("roles", "ROOT_PRODUCT")
    for field, value in identity.items():
        same = same & (F.col(field) == value)
    only = population.agg(F.count_if(same).alias("n"), F.min(F.when(same, F.col("population_id"))).alias("population_id"))
    return only.select(F.when(F.col("n") == 1, F.col("population_id")).otherwise(F.raise_error(F.lit("not one root"))).alias("population_id"))


def namespaces(observations: DataFrame) -> DataFrame:
    """(problem) of observations (profile_id, profile_kind, namespace): more than one namespace, repeated ids or kinds."""
    counts = observations.agg(F.countDistinct("namespace").alias("names"), F.count(F.lit(1)).alias("n"), F.countDistinct("profile_id").alias("ids"), F.countDistinct("profile_kind").alias("kinds"))
    problems = F.array_compact(F.array(F.when(F.col("names") != 1, "namespace"), F.when(F.col("ids") < F.col("n"), "profile_id"), F.when(F.col("kinds") < F.col("n"), "profile_kind")))
    return counts.select(F.explode(problems).alias("problem"))
