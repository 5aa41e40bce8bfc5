"""What only larger tables showed: merged components, names that many components have, rules of many documents."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corroborate.operators import reconcile, rules, vex
from corroborate.plans import queries

RECORD = "lane_id string, component_id string, producer string, name string, version string, identifiers array<string>, hashes array<string>, provenances array<string>, roles array<string>"


def test_a_root_whose_evidence_differs_is_named_by_its_release(spark):
    records = spark.createDataFrame(
        [("build", "b1", "P", "n", "1", ["pkg:generic/n"], ["SHA-256:h"], [], []), ("artifact", "a1", "P", "n", "2", ["pkg:generic/n"], ["SHA-256:h"], [], []), ("build", "b2", "P", "m", "1", ["pkg:generic/m"], [], [], [])], RECORD
    )
    edges = spark.createDataFrame([("build", "b1", "DEPENDS_ON", "b2")], "lane_id string, src string, rel string, dst string")
    lanes = spark.createDataFrame([("build", "e1"), ("artifact", "e2")], "lane_id string, evidence_id string")
    fields = "run_id classification canonical_sha256 build_id artifact_sha256 release_timestamp sbom_author release_id manufacturer product product_version".split()
    release = spark.createDataFrame([("run-1", "c", "c", "b", "a", "t", "w", "r", "P", "n", "1")], ", ".join(f"{f} string" for f in fields))
    found = {r.part: (r.n, r.root) for r in queries.cyclonedx_document(records, edges, lanes, release).collect()}
    assert found == {"head": (1, "n application"), "components": (1, ""), "dependencies": (2, ""), "properties": (1, ""), "errors": (0, "")}
    assert {r.part: r.n for r in queries.export_resolves(records, edges, lanes, release).collect()} == {"head": 4, "agents": 2, "packages": 2, "relationships": 1, "membership": 7, "unresolved": 0}


SIDE = "producer string, name string, version string, identifiers array<string>, hashes array<string>, provenances array<string>, roles array<string>"


def sides(spark, candidates, population):
    none = F.array().cast("array<string>")
    rows = spark.createDataFrame(population, "population_id string, " + SIDE).withColumns({"supplier_hashes": none, "conflict_fields": none, "critical_unknown_fields": none})
    return spark.createDataFrame(candidates, "candidate_id string, " + SIDE), rows


def test_names_of_many_components_make_no_pairs(spark):
    row = lambda i: (f"x{i:04}", "P", "n", str(i), [], [], ["source:s"], ["LIBRARY"])
    candidates, population = sides(spark, [row(i) for i in range(700)], [row(i + 10_000) for i in range(700)])
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    found = reconcile.five_states(candidates, population)
    assert {(r.status, *r.details): r.n for r in found.groupBy("status", "details").agg(F.count("*").alias("n")).collect()} == {("UNKNOWN", "ambiguous_identity"): 700}
    assert size() - before < 5_000_000  # 490,000 pairs tie


def test_best_matches_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    some = lambda values, most: rng.sample(values, rng.randint(0, most))

    def row(name):
        return (name, rng.choice(["P", "Q", "UNKNOWN"]), rng.choice(["n", "m", "UNKNOWN"]), rng.choice(["1", "2", "UNKNOWN"]), some(["i1", "i2", "i3", "i4"], 2), some(["h1", "h2", "h3"], 2) if rng.random() < 0.3 else [], some(["s1", "s2"], 2), some(["r1", "r2"], 2))

    left, right = [row(f"c{i}") for i in range(60)], [row(f"p{i}") for i in range(60)]
    want = set()
    for c in left:
        scores = {}
        for p in right:
            shared = [bool(set(c[k]) & set(p[k])) for k in (4, 5, 6, 7)]
            if shared[0] or (not c[4] or not p[4]) and c[1] == p[1] != "UNKNOWN" and c[2] == p[2] != "UNKNOWN":
                scores[p[0]] = (100 if shared[0] else 10) + 5 * (c[3] == p[3] != "UNKNOWN") + 1000 * shared[1] + 500 * shared[2] + 100 * shared[3]
        best = [p for p, score in scores.items() if score == max(scores.values())]
        want |= {(c[0], p, scores[p], len(best)) for p in best}
    found = [tuple(r) for r in reconcile.best_matches(*sides(spark, left, right)).select("candidate_id", "population_id", "score", "n_populations").collect()]
    assert sorted(found) == sorted(want) and len({r[3] for r in want}) > 5
    # The five states come to the same counts as these pairs.
    candidates, population = sides(spark, left, right)
    ambiguous = {p for _, p, _, ties in want if ties > 1} | {p for p in (r[1] for r in want) if sum(r[1] == p for r in want) > 1}
    states = reconcile.five_states(candidates, population).collect()
    assert {r.population_id for r in states if r.details == ["ambiguous_identity"]} == ambiguous
    assert {r.candidate_id for r in states if r.population_id is None} == {c[0] for c in left} - {r[0] for r in want}


STATEMENT = "vex_document_sha256 string, position long, statement_id string, vex_format string, issuer_id string, vulnerability_id string, status string, justification string, detail string, first_issued_utc string, last_updated_utc string, purls array<string>"


def statements(spark):
    said = lambda doc, i, status: (doc * 64, i, f"s{doc}{i}", "openvex", "who", f"V-{i % 3}", status, None, None, None, None, [f"pkg:generic/p{i}?arch=a"])
    return spark.createDataFrame([said(doc, i, "not_affected" if i % 4 else "affected") for doc in "ab" for i in range(9)], STATEMENT)


def asked(spark):
    rows = [("h1", "c" * 64, i, f"hit{i}", f"V-{i % 3}", f"pkg:generic/p{i}?arch=a&x=1", "affected", "abe"[i % 3] * 64) for i in range(12)]
    return spark.createDataFrame(rows, "handoff_id string, cyclonedx_sha256 string, position long, hit_id string, vulnerability_id string, purl string, original_status string, vex_document_sha256 string")


def test_statements_are_not_shuffled_for_two_receipts_at_once(spark):
    rows = statements(spark)
    receipts = vex.intake_receipts(rows, spark.createDataFrame([(d * 64, "5" * 64, "6" * 64) for d in "ab"], "vex_document_sha256 string, signature_sha256 string, binary_sha256 string"))
    changed = rows.withColumn("issuer_id", F.when(F.col("vex_document_sha256").startswith("b"), "else").otherwise(F.col("issuer_id")))
    broken = vex.binding_violations(receipts, changed)
    assert sorted((r[0][0], r.rule) for r in broken.collect()) == [("b", "issuer_id"), ("b", "statements_canonical_sha256")]
    assert "MapInArrow" not in broken._jdf.queryExecution().toString()  # both hashes are made before they are compared
    found = vex.narrow_bound(asked(spark), changed, receipts)
    # Every third hit names document a, the others b, which is changed, or e, which is not there.
    want = lambda i: (False, vex.BINDING_FAILED, 0) if i % 3 else (False, vex.NO_MATCH, 0) if i >= 9 else (True, None, 1) if i % 4 else (False, vex.CONTRADICTORY, 1)
    assert {r.hit_id: (r.narrowed, r.reason, r.n_statements) for r in found.collect()} == {f"hit{i}": want(i) for i in range(12)}
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_decisions_are_read_once_for_a_receipt(spark):
    hits = asked(spark).withColumn("cyclonedx_sha256", F.when(F.col("position") < 4, "d" * 64).otherwise("c" * 64))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    decisions = vex.narrow(hits, statements(spark)).mapInArrow(counted, vex.narrow(hits, statements(spark)).schema)
    bound = queries._bindings(hits)
    found = {(r.handoff_id, r.cyclonedx_sha256[0], r.total_hits, r.narrowed_count, r.not_narrowed_count) for r in vex.narrowing_receipts(decisions, bound).collect()}
    assert found == {("h1", "d", 4, 3, 1), ("h1", "c", 8, 3, 5)}
    assert read.value == 12


def test_rules_that_hold_leave_no_shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    written = lambda: sum(f.getName().startswith("shuffle_") for f in _files(env))
    before = written()
    rules.assert_none(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count().filter("count > 10"))
    assert written() <= before
    with pytest.raises(ValueError, match="rules broken"):
        rules.assert_none(spark.range(10).groupBy("id").count())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _files(env):
    found = env.blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]
