"""Entity resolution across evidence lanes.

Records: lane_id, component_id, producer, name, version (UNKNOWN where not known) and the
arrays identifiers, hashes, provenances, roles (without UNKNOWN). They may carry supplier_hashes,
whose parts may be UNKNOWN one by one (ALGORITHM:UNKNOWN, UNKNOWN:value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import UNKNOWN, concrete, stable_id
from corroborate.operators.components import components

TRIPLE = ("producer", "name", "version")


def _side(records: DataFrame, suffix: str) -> DataFrame:
    return records.select(*(F.col(c).alias(f"{c}_{suffix}") for c in ("lane_id", "component_id", "identifiers", "hashes", "provenances")), *(concrete(F.col(c)).alias(f"{c}_{suffix}") for c in TRIPLE))


def _agree(kind: str) -> tuple[Column, Column]:
    left, right = F.col(f"{kind}_l"), F.col(f"{kind}_r")
    return (F.size(left) > 0) & (F.size(right) > 0), F.arrays_overlap(left, right)


def pair_matches(records: DataFrame) -> DataFrame:
    """(lane_l, id_l, lane_r, id_r), lane_l < lane_r: records of two lanes that are one component.

    Records with identifiers on both sides must share one; others must agree on producer,
    name and version. Then shared hashes decide where both have some, else provenances.
    Two equi-joins find all candidates, so no pair is compared that cannot match.
    """
    left, right = _side(records, "l"), _side(records, "r")
    both_hashed, same_hash = _agree("hashes")
    both_sourced, same_source = _agree("provenances")
    ladder = F.when(both_hashed, same_hash).when(both_sourced, same_source).otherwise(True)
    by_id = left.withColumn("i", F.explode("identifiers_l")).join(right.withColumn("i", F.explode("identifiers_r")), "i")
    same_triple = [F.col(f"{c}_l") == F.col(f"{c}_r") for c in TRIPLE]
    bare = (F.size("identifiers_l") == 0) | (F.size("identifiers_r") == 0)
    by_triple = left.join(right, [*same_triple, F.col("lane_id_l") < F.col("lane_id_r"), bare])
    found = by_id.filter("lane_id_l < lane_id_r").drop("i").unionByName(by_triple).filter(ladder)
    return found.select(F.col("lane_id_l").alias("lane_l"), F.col("component_id_l").alias("id_l"), F.col("lane_id_r").alias("lane_r"), F.col("component_id_r").alias("id_r")).distinct()


def _node(lane: str, component: str) -> Column:
    return F.concat_ws("\x1f", lane, component)


def _class_links(keyed: DataFrame, bare: bool) -> DataFrame:
    """Edges (a, b) among records of one key (key, node, lane_id, hashes, provenances, named) that connect what pairwise matches connect.

    Records alike in all that a match looks at are one class; classes are paired, and the
    members of those that match are linked to one of them, so copies cost no pairs.
    """
    alike = ["key", "lane_id", "hashes", "provenances", "named"]
    classes = keyed.groupBy(*alike).agg(F.min("node").alias("rep"))
    left, right = (classes.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("lane_id", "hashes", "provenances", "named", "rep"))) for side in "lr")
    both_hashed, same_hash = _agree("hashes")
    both_sourced, same_source = _agree("provenances")
    ladder = F.when(both_hashed, same_hash).when(both_sourced, same_source).otherwise(True)
    met = left.join(right, "key").filter((F.col("lane_id_l") < F.col("lane_id_r")) & ladder)
    if bare:
        met = met.filter(~(F.col("named_l") & F.col("named_r")))
    ends = met.select(F.col("rep_l").alias("a"), F.col("rep_r").alias("b")).distinct()
    matched = met.select("key", F.col("rep_l").alias("rep")).union(met.select("key", "rep_r")).distinct()
    members = keyed.join(classes, alike).join(matched, ["key", "rep"], "left_semi").filter("node <> rep")
    return ends.union(members.select("node", "rep"))


def links(records: DataFrame) -> DataFrame:
    """Edges (a, b) between records' nodes, with the components of pair_matches()."""
    rows = records.select(
        _node("lane_id", "component_id").alias("node"), "lane_id", F.array_sort("hashes").alias("hashes"), F.array_sort("provenances").alias("provenances"), (F.size("identifiers") > 0).alias("named"), "identifiers",
        F.array(*(concrete(F.col(c)) for c in TRIPLE)).alias("triple"),
    )
    by_id = rows.select(F.explode(F.array_distinct("identifiers")).alias("key"), "node", "lane_id", "hashes", "provenances", "named")
    by_triple = rows.filter(~F.exists("triple", lambda t: t.isNull())).select(F.to_json("triple").alias("key"), "node", "lane_id", "hashes", "provenances", "named")
    return _class_links(by_id, bare=False).union(_class_links(by_triple, bare=True)).distinct()


def clustered(records: DataFrame) -> DataFrame:
    """``records`` with cluster: the least record that a chain of pairwise matches reaches."""
    roots = components(links(records))
    rows = records.withColumn("node", _node("lane_id", "component_id"))
    return rows.join(roots, "node", "left").withColumn("cluster", F.coalesce("root", "node")).drop("root", "node")


def _union(arrays: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(arrays))))


def concrete_hashes(hashes: str | Column) -> Column:
    """Those of a list of algorithm:value that know both."""
    return F.filter(hashes, lambda h: ~h.startswith(UNKNOWN + ":") & ~h.endswith(":" + UNKNOWN))


def _several_per_algorithm(hashes: str) -> Column:
    """Whether a list of algorithm:value names two values of one algorithm."""
    names = F.transform(concrete_hashes(hashes), lambda h: F.substring_index(h, ":", 1))
    return F.size(names) > F.size(F.array_distinct(names))


def population(records: DataFrame) -> DataFrame:
    """One row per cluster: single values or UNKNOWN, unions of arrays, conflicts and unknowns.

    Conflicts are kept: a field with two values is UNKNOWN and named in conflict_fields.
    Different identifiers enrich and never conflict.
    """
    if "supplier_hashes" not in records.columns:
        records = records.withColumn("supplier_hashes", F.array().cast("array<string>"))
    sets = [F.array_sort(F.collect_set(concrete(F.col(c)))).alias(f"{c}_set") for c in TRIPLE]
    rows = clustered(records).groupBy("cluster").agg(
        *sets, _union("identifiers").alias("identifiers"), _union("hashes").alias("hashes"), _union("provenances").alias("provenances"), _union("roles").alias("roles"), _union("supplier_hashes").alias("supplier_hashes"),
        F.array_sort(F.collect_set("lane_id")).alias("lanes"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_list(F.struct("lane_id", "component_id"))).alias("sources"),
    )
    for c in TRIPLE:
        rows = rows.withColumn(c, F.when(F.size(f"{c}_set") == 1, F.col(f"{c}_set")[0]).otherwise(UNKNOWN))
    conflicts = [
        F.when(F.size("roles") > 1, "component_role"), F.when(F.col("members") > F.size("lanes"), "identity"), F.when(F.size("name_set") > 1, "name"),
        F.when(_several_per_algorithm("hashes"), "observed_hash"), F.when(F.size("producer_set") > 1, "producer"), F.when(_several_per_algorithm("supplier_hashes"), "supplier_hash"), F.when(F.size("version_set") > 1, "version"),
    ]
    unknowns = [F.when(F.size("identifiers") == 0, "identifier"), *(F.when(F.col(c) == UNKNOWN, c) for c in ("name", "producer", "version"))]
    half = lambda ok, name: F.when(F.exists("supplier_hashes", ok), name)
    quiet = [half(lambda h: h.startswith(UNKNOWN + ":") & ~h.endswith(":" + UNKNOWN), "supplier_hash_algorithm"), half(lambda h: ~h.startswith(UNKNOWN + ":") & h.endswith(":" + UNKNOWN), "supplier_hash_value")]
    source = F.transform("sources", lambda s: F.struct(s["lane_id"].alias("lane_id"), s["component_id"].alias("source_component_id")))
    return rows.select(
        stable_id("population", source.alias("source_components")).alias("population_id"), *TRIPLE, "identifiers", "hashes", "provenances", "roles", "supplier_hashes", "lanes", "sources",
        F.array_compact(F.array(*conflicts)).alias("conflict_fields"), F.array_compact(F.array(*unknowns)).alias("critical_unknown_fields"), F.array_compact(F.array(*quiet)).alias("nonblocking_unknown_fields"),
    )
