"""Goldens, metamorphic and mutation tests of the operators on small inputs."""

import hashlib
import io
import json
import tarfile
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from corroborate.functions import text as fx
from corroborate.operators import binding, cluster, components, evidence, export, gaps, nested, profiles, reconcile, registry, relations, release, rules, vex
from corroborate.sources import documents, files, image

RECORD = "lane_id string, component_id string, producer string, name string, version string, identifiers array<string>, hashes array<string>, provenances array<string>, roles array<string>"


def records(spark, *rows):
    return spark.createDataFrame([(*r[:5], *map(list, r[5:])) for r in rows], RECORD)


CASE = [
    ("build", "b1", "acme", "app", "1", ["pkg:generic/app@1"], ["SHA-256:a"], [], ["LIBRARY"]),
    ("artifact", "a1", "acme", "app", "1", ["pkg:generic/app@1"], ["SHA-256:a"], [], ["LIBRARY"]),
    ("build", "b2", "acme", "crypto", "1.0", ["pkg:generic/crypto"], ["SHA-256:c"], [], ["LIBRARY"]),
    ("artifact", "a2", "acme", "crypto", "9.9", ["pkg:generic/crypto"], ["SHA-256:c"], [], ["LIBRARY"]),
    ("artifact", "a3", "UNKNOWN", "UNKNOWN", "UNKNOWN", [], ["SHA-256:z"], [], []),
    ("build", "b4", "acme", "same", "2", ["pkg:generic/same"], ["SHA-256:1"], [], ["LIBRARY"]),
    ("artifact", "a4", "acme", "same", "2", ["pkg:generic/same"], ["SHA-256:2"], [], ["LIBRARY"]),
]


def test_pairs_follow_the_ladder(spark):
    found = {(r.id_l, r.id_r) for r in cluster.pair_matches(records(spark, *CASE)).collect()}
    assert found == {("a1", "b1"), ("a2", "b2")}  # a4 and b4 share an id, not a hash


def test_population_keeps_conflicts(spark):
    rows = {r["sources"][0]["component_id"]: r for r in cluster.population(records(spark, *CASE)).collect()}
    assert len(rows) == 5
    assert rows["a2"]["version"] == "UNKNOWN" and rows["a2"]["conflict_fields"] == ["version"]
    assert rows["a3"]["critical_unknown_fields"] == ["identifier", "name", "producer", "version"]
    body = json.dumps({"source_components": [{"lane_id": "artifact", "source_component_id": "a1"}, {"lane_id": "build", "source_component_id": "b1"}]}, separators=(",", ":"))
    assert rows["a1"]["population_id"] == "population-" + hashlib.sha256(body.encode()).hexdigest()


def test_population_does_not_depend_on_order(spark):
    one = cluster.population(records(spark, *CASE)).drop("sources")
    two = cluster.population(records(spark, *CASE[::-1]).repartition(7)).drop("sources")
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_five_states(spark):
    population = cluster.population(records(spark, *CASE))
    candidates = spark.createDataFrame(
        [
            ("c1", "acme", "app", "1", ["pkg:generic/app@1"], ["SHA-256:a"], [], []), ("c2", "acme", "crypto", "1.0", ["pkg:generic/crypto"], [], [], []),
            ("c3", "UNKNOWN", "x", "1", [], [], [], []), ("c4", "acme", "none", "1", ["pkg:generic/none"], [], [], []), ("c5", "acme", "same", "2", ["pkg:generic/same"], [], [], []),
        ],
        "candidate_id string, producer string, name string, version string, identifiers array<string>, hashes array<string>, provenances array<string>, roles array<string>",
    )
    found = reconcile.five_states(candidates, population)
    states = sorted((r.candidate_id or "", r.status) for r in found.collect())
    # c5 ties for two populations: both are ambiguous and it has no row of its own.
    assert states == [("", "UNKNOWN"), ("", "UNKNOWN"), ("", "UNKNOWN"), ("c1", "MATCHED"), ("c2", "CONFLICT"), ("c3", "UNKNOWN"), ("c4", "NOT_IN_RELEASE")]
    assert reconcile.status_counts(found).first().state == "OPEN"


def test_empty_inputs(spark):
    none = records(spark)
    assert cluster.population(none).isEmpty()
    assert evidence.manifest_totals(spark.createDataFrame([], "path string, sha256 string, size long, executable boolean")).first().file_count == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(edges)
    assert found.count() == 201 and found.select("root").distinct().collect()[0].root == 0


def test_uuid(spark):
    names = ["", "run:é", "pkg:generic/a@1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fx.uuid5_url(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_whole_matches_only(spark):
    row = spark.createDataFrame([("a" * 64 + "\n", "id\n", "a\n")], "s string, i string, p string")
    got = row.select(fx.is_sha256(F.col("s")), fx.is_safe_id(F.col("i")), fx.is_text(F.col("p"))).first()
    assert list(got) == [False, False, False]


@pytest.mark.parametrize(("path", "fine"), [("a/b", True), ("a/.b", True), ("..a", True), ("/a", False), ("a//b", False), ("a/./b", False), ("../a", False), ("a/", False), ("", False), ("a\\b", False), (None, False)])
def test_relative_paths(spark, path, fine):
    assert spark.createDataFrame([(path,)], "p string").select(fx.is_relative_path(F.col("p"))).first()[0] is fine


STATEMENT = "vex_document_sha256 string, position long, issuer_id string, statement_id string, vulnerability_id string, vex_format string, status string, justification string, detail string, first_issued_utc string, last_updated_utc string, purls array<string>"


def said(spark, *rows):
    """Statements of one document from (id, vulnerability, status, purls)."""
    return spark.createDataFrame([("d" * 64, n, "is", i, v, "openvex", s, "vulnerable_code_not_present", None, None, None, p) for n, (i, v, s, p) in enumerate(rows)], STATEMENT)


def asked(spark, *rows):
    schema = "handoff_id string, cyclonedx_sha256 string, position long, hit_id string, vulnerability_id string, purl string, original_status string, vex_document_sha256 string"
    return spark.createDataFrame([("h", "a" * 64, n, i, v, p, "affected", "d" * 64) for n, (i, v, p) in enumerate(rows)], schema)


HITS = [("h1", "V1", "pkg:a/b@1?arch=x&package-id=3"), ("h2", "V1", "pkg:a/b@1?arch=y"), ("h3", "V2", "pkg:b/c"), ("h4", "V2", "pkg:b/c")]
SAID = [("s1", "V1", "not_affected", ["pkg:a/b@1?arch=x", "pkg:a/b@1?arch=x&z=1"]), ("s2", "V2", "not_affected", ["pkg:b/c"]), ("s3", "V2", "affected", ["pkg:b/c?q=1"])]


def test_narrowing_ladder(spark):
    got = {r.hit_id: (r.narrowed, r.reason, r.n_statements) for r in vex.narrow(asked(spark, *HITS), said(spark, *SAID)).collect()}
    no, against = "RETAINED_OPEN_NO_VEX_MATCH", "RETAINED_OPEN_CONTRADICTORY_VEX"
    assert got == {"h1": (True, None, 1), "h2": (False, no, 0), "h3": (False, against, 2), "h4": (False, against, 2)}


def test_receipts_bind_statements(spark):
    """A receipt is borne out by its statements; any change in them is seen, and hits then stay open."""
    statements = said(spark, *SAID)
    signatures = spark.createDataFrame([("d" * 64, "e" * 64, "f" * 64)], "vex_document_sha256 string, signature_sha256 string, binary_sha256 string")
    receipts = vex.intake_receipts(statements, signatures)
    listed = [
        {"detail": None, "first_issued_utc": None, "issuer_id": "is", "justification": "vulnerable_code_not_present", "last_updated_utc": None, "narrowing_eligible": s == "not_affected", "product_purls": p, "status": s,
         "vex_document_sha256": "d" * 64, "vex_format": "openvex", "vulnerability_id": v} for _, v, s, p in sorted(SAID, key=lambda r: (r[1], "|".join(r[3])))
    ]
    want = hashlib.sha256(json.dumps(listed, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    assert receipts.first().statements_canonical_sha256 == want
    assert vex.binding_violations(receipts, statements).isEmpty()
    assert {r.narrowed for r in vex.narrow_bound(asked(spark, *HITS), statements, receipts).collect()} == {True, False}
    changed = statements.withColumn("justification", F.lit("inline_mitigations_already_exist"))
    assert [r.rule for r in vex.binding_violations(receipts, changed).collect()] == ["statements_canonical_sha256"]
    assert {(r.narrowed, r.reason) for r in vex.narrow_bound(asked(spark, *HITS), changed, receipts).collect()} == {(False, "VEX_INTAKE_BINDING_FAILED")}


def test_decision_hash_is_that_of_the_list(spark):
    decisions = vex.narrow(asked(spark, *HITS), said(spark, *SAID))
    listed = [
        {"narrowed_by_trusted_vex": r.narrowed, "original_hit_preserved": True, "original_status": r.original_status, "product_purl": r.purl, "rejection_reason": r.reason, "vex_pointers": json.loads(r.vex_pointers), "vulnerability_id": r.vulnerability_id}
        for r in sorted(decisions.collect(), key=lambda r: r.position)
    ]
    assert vex.decision_hashes(decisions).first().sha256 == hashlib.sha256(json.dumps(listed, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def test_matcher_documents(spark):
    good = {"source": {"matcher_name": "m", "matcher_version": "1", "handoff_id": "h", "cyclonedx_sha256": "a" * 64}, "hits": [{"vulnerability_id": "V", "product_purl": "pkg:a/b?x=1", "original_status": "s"}]}
    read = lambda d: documents.matcher_hits(spark.createDataFrame([("d", json.dumps(d))], "doc string, raw string")).collect()
    assert [(r.hit_id, r.purl) for r in read(good)] == [("d#0", "pkg:a/b")]
    for bad in (good | {"more": 1}, good | {"hits": [{"vulnerability_id": "V"}]}, {"source": {}, "hits": []}):
        with pytest.raises(Exception, match="no matcher hits"):
            read(bad)
    hits = asked(spark, ("h1", "V", "urn:x"), ("h2", "", "pkg:a/b"))
    assert {r.rule for r in vex.hit_violations(hits, 1).collect()} == {"purl", "vulnerability_id", "hits"}


def test_exact_set_hash_is_that_of_the_list(spark):
    schema = "root_id string, path string, sha256 string, size long, executable boolean"
    rows = [("r", f"p{i}", "k", i, False) for i in range(50)] + [("q", "p", "k", 1, True)]
    listed = [{"relative_path": p, "sha256": s, "size": n, "executable": x} for r, p, s, n, x in sorted(rows, key=lambda r: r[1]) if r == "r"]
    want = hashlib.sha256(json.dumps({"root_id": "r", "files": listed}, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    got = {r.root_id: r.exact_set_sha256 for r in evidence.exact_set_hash(spark.createDataFrame(rows[::-1], schema).repartition(5)).collect()}
    assert got["r"] == want and set(got) == {"r", "q"}


URLS = [
    ("https://a.example/x", True), ("https://a.example", False), ("https://a.example/", False), ("https://a.example/x?q=1", False), ("https://a.example/x#f", False), ("https://a.example:443/x", True),
    ("https://a.example:444/x", False), ("https://u@a.example/x", False), ("http://a.example/x", False), ("https://a.example/x y", False), ("https://a.example/x\\y", False), ("https:///x", False), (None, False),
]


@pytest.mark.parametrize(("url", "fine"), URLS)
def test_urls(spark, url, fine):
    assert spark.createDataFrame([(url,)], "u string").select(fx.is_https_url(F.col("u"))).first()[0] is fine


def test_urls_of_known_hosts(spark):
    rows = spark.createDataFrame([("https://GitHub.com/x",), ("https://a.example/x",)], "u string")
    assert [r[0] for r in rows.select(fx.is_https_url(F.col("u"), ("github.com",))).collect()] == [True, False]


def test_served_statuses(spark):
    schema = "run_id string, classification string, status string, product_conformity_status string, manufacturer_role string, note string"
    rows = [
        ("a", "SYNTHETIC_X", "NOT_APPROVED", None, "maker", "CERTIFIED"), ("b", "SYNTHETIC_X", "certified", None, None, None), ("c", "CUSTOMER", "CERTIFIED", "CAB_APPROVED", "maker", None),
        ("d", "SELF_TEST_NOT_CUSTOMER_EVIDENCE", "open", "NO_PRODUCT_CONFORMITY_STATUS", None, None), ("e", "SELF_TEST_NOT_CUSTOMER_EVIDENCE", None, None, "maker", None), ("f", None, "CERTIFIED", None, None, None),
    ]
    got = {(r.run_id, r.rule) for r in binding.status_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("b", "status"), ("e", "manufacturer_role"), ("e", "product_conformity")}


def test_source_trees(spark):
    files = [
        ("a", "venv/x.py", "import gone"), ("a", "main.py", "import os\nfrom lib.deep import y\n import lörtlich"), ("a", "node_modules/n.py", "import other"), ("b", ".tox/only.py", ""), ("b", "src/x.ino", ""),
        ("c", "x.py", ""), ("c", "Pipfile.lock", ""), ("d", "x.py", ""), ("d", "sub/requirements.txt", ""), ("a", "build/requirements.txt", "-r no.txt"), ("a", "requirements/x.txt", "\t-r\tyes.txt\r\n#-r no.txt"),
        ("a", "m/manifest.json", '{"domain": null, "requirements": ["_x==1", 3, "LIB"]}'), ("a", "l/manifest.json", '{"requirements": ["never"]}'), ("a", "dist/manifest.json", '{"domain": 1, "requirements": ["never"]}'),
    ]
    files = spark.createDataFrame(files, "project string, path string, text string")
    parts = spark.createDataFrame([("a", "lib")], "project string, name string")
    assert {(r.module, r.missing) for r in gaps.import_gaps(files, parts).collect()} == {("lib", False), ("lörtlich", True)}
    assert [r.referenced for r in gaps.requirement_references(files).collect()] == ["yes.txt"]
    assert [r.name for r in gaps.requirement_gaps(files, parts).collect()] == ["_x"]
    got = {r.project: (r.zero_python, r.zero_c) for r in gaps.zero_components(files, parts).collect()}
    assert got == {"a": (False, False), "b": (False, True), "c": (False, False), "d": (True, False)}


def test_cards_show_the_first_claims_and_count_all(spark):
    claims = spark.createDataFrame([(1, f"c{n:03}", "v", f"e{n % 2}") for n in range(70)] + [(2, "c", "v", "e"), (2, "c", "v", "f")], "conflict_id int, claim_id string, value string, evidence_id string")
    got = {r.conflict_id: (r.n_claims, len(r.claim_ids), r.evidence, r.fits) for r in evidence.conflict_cards(claims).collect()}
    assert got == {1: (70, 64, ["e0", "e1"], False), 2: (1, 1, ["e", "f"], True)}


def test_rules_stop_a_run(spark):
    found = rules.violations(spark.createDataFrame([("a", None)], "k string, v string"), "k", {"v": F.col("v") == "x"})
    with pytest.raises(ValueError, match="rules broken"):
        rules.assert_none(found)


def test_one_row(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert evidence.one_row(rows, F.col("k") == "a", "key").count() == 1
    with pytest.raises(Exception, match="not exactly one key"):
        evidence.one_row(rows, F.col("k") == "b", "key").collect()


def test_too_deep(spark):
    raw = '{"name":"x"}'
    for _ in range(4):
        raw = f'{{"components":[{raw}]}}'
    docs = spark.createDataFrame([(1, raw)], "doc int, raw string")
    assert nested.flatten(docs).count() == 4
    with pytest.raises(ValueError):
        nested.flatten(docs, deepest=2)


def test_diff_lists_changed_fields(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q")], "k int, v string, w string")
    b = spark.createDataFrame([(1, "z", None), (3, "y", "q")], "k int, v string, w string")
    got = {r.k: (r.change, r.changed_fields) for r in relations.diff(a, b, "k", ["w", "v"]).collect()}
    assert got == {1: ("MODIFIED", ["v"]), 2: ("REMOVED", []), 3: ("ADDED", [])}


def test_archive_and_workbook(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo("bin/x")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
        link = tarfile.TarInfo("bin/y")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        tar.addfile(link)
    found = {r.path: r for r in files.tar_members(files.file_identities(spark, str(tmp_path / "a.tar"))).collect()}
    assert found["bin/x"].sha256 == hashlib.sha256(b"abc").hexdigest() and found["bin/y"].target == "x"

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>third</t></is></c></row><row r="2"><c r="A2"><v>5</v></c></row><row r="3"/></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>first</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = files.sheet_rows(files.file_identities(spark, str(tmp_path / "b.xlsx")))
    assert [r.cells for r in rows.orderBy("row").collect()] == [["first", "", "third"], ["5"]]


def test_unsafe_archive_is_refused(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        tar.addfile(tarfile.TarInfo("../x"))
    with pytest.raises(Exception, match="member"):
        files.tar_members(files.file_identities(spark, str(tmp_path / "a.tar"))).collect()


def test_strict_json(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good/a.json").write_text('{"a": 1, "b": "x"}')
    good = files.strict_json(files.file_identities(spark, str(tmp_path / "good")), ["a", "b"], "a int, b string")
    assert good.first().data.b == "x"
    for n, text in enumerate(('{"a": 1}', '{"a": 1, "b": "x", "c": 2}', '{"a": 1, "a": 2, "b": "x"}', "[1]", '{"a": NaN, "b": "x"}')):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "a.json").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            files.strict_json(files.file_identities(spark, str(tmp_path / str(n))), ["a", "b"], "a int, b string").collect()


def test_lists_and_settings(spark, tmp_path):
    (tmp_path / "m.txt").write_text("zlib arm 1.2\n\nbusybox arm 1.36\n")
    assert {r.name: r.version for r in files.package_list(spark, str(tmp_path / "m.txt")).collect()} == {"zlib": "1.2", "busybox": "1.36"}
    (tmp_path / "q.conf").write_text("[config]\nmachine = arm\n# note\n")
    assert {r.key: r.value for r in files.settings(spark, str(tmp_path / "q.conf")).collect()} == {"machine": "arm"}


def test_lane_documents(spark):
    lane = {"lane_id": "build", "source_kind": "BUILD", "subject": {"producer": "acme", "name": "p", "version": "1", "identifiers": ["urn:p"], "role": "ROOT_PRODUCT"}, "artifact": {"relative_path": "a.tar", "sha256": "f" * 64},
            "components": [{"component_id": "c", "component_role": "LIBRARY", "producer": None, "name": "n", "version": "1", "identifiers": ["UNKNOWN"], "provenance": {"kind": "source", "locator": "x", "source_available": True}, "observed_hash": {"algorithm": "SHA-256", "value": "a"}, "supplier_hash": {"algorithm": None, "value": None}}],
            "relationships": [{"from": "ROOT", "type": "CONTAINS", "to": "c"}]}
    docs = spark.createDataFrame([("d", json.dumps(lane))], "doc string, raw string")
    rows = {r.component_id: r for r in documents.lane_records(docs).collect()}
    assert rows["c"].producer == "UNKNOWN" and rows["c"].identifiers == [] and rows["c"].provenances == ["source:x"] and rows["ROOT"].hashes == ["SHA-256:" + "f" * 64]
    assert documents.lane_relationships(docs).first().dst == "c"


def test_statement_documents(spark):
    openvex = {"@context": "https://openvex.dev/ns", "statements": [{"vulnerability": {"name": "", "@id": "V1"}, "products": [{"@id": "pkg:a?x=1"}, {"@id": "urn:b"}], "status": "fixed", "justification": "j"}]}
    cdx = {"bomFormat": "CycloneDX", "vulnerabilities": [{"id": "V2", "analysis": {"state": "not_affected", "justification": "code_not_present"}, "affects": [{"ref": "pkg:a?x=1&arch=q"}, {"ref": "bom"}]}]}
    docs = spark.createDataFrame([("o", json.dumps(openvex)), ("c", json.dumps(cdx))], "doc string, raw string")
    got = {r.vulnerability_id: (r.vex_format, r.purls) for r in documents.statements(docs).collect()}
    assert got == {"V1": ("openvex", ["pkg:a?x=1"]), "V2": ("cyclonedx-bom", ["pkg:a?arch=q"])}
    with pytest.raises(Exception, match="no statement document"):
        documents.statements(spark.createDataFrame([("x", "{}")], "doc string, raw string")).collect()


def test_export_lines(spark):
    population = cluster.population(records(spark, *CASE))
    rows = {json.loads(r.line)["bom-ref"]: json.loads(r.line) for r in export.cyclonedx_components(population, "run-1").collect()}
    ids = [r.population_id for r in population.collect()]
    assert set(rows) == {"urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, "run-1:" + i)) for i in ids}
    app = next(r for r in rows.values() if r["name"] == "app")
    assert app["purl"] == "pkg:generic/app@1" and app["type"] == "library" and "hashes" not in app  # a is no SHA-256
    assert {"name": "corroborate:identifier", "value": "pkg:generic/app@1"} in app["properties"]
    edges = spark.createDataFrame([(ids[0], "DEPENDS_ON", ids[1]), (ids[0], "CONTAINS", ids[2])], "src string, rel string, dst string")
    lines = {r.ref: json.loads(r.line) for r in export.cyclonedx_dependencies(population, edges, "run-1").collect()}
    assert len(lines) == len(ids) and len(lines[ids[0]]["dependsOn"]) == 1 and lines[ids[1]]["dependsOn"] == []


def test_unnamed_relationship_is_an_error(spark):
    with pytest.raises(Exception, match="no name for ODD"):
        export.spdx_relationships(spark.createDataFrame([("a", "ODD", "b")], "src string, rel string, dst string"), "x:").collect()


def test_package_is_sealed(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {n}",) for n in range(100)], "line string").repartition(3)
    path = str(tmp_path / "run")
    export.write_package(spark, path, {"components": lines, "dependencies": lines.limit(0)})
    assert export.package_differences(spark, path).isEmpty()
    with pytest.raises(Exception):  # noqa: B017
        export.write_package(spark, path, {"components": lines})
    lines.limit(99).write.mode("overwrite").text(f"{path}/components")
    assert [r.name for r in export.package_differences(spark, path).collect()] == ["components"]


def test_attestation(spark):
    row = spark.createDataFrame([("ab", 1)], "h string, n int").select(export.attestation("x.json", F.col("h"), "https://example.invalid/p", F.struct("n")))
    got = json.loads(row.first()[0])
    assert got["subject"] == [{"digest": {"sha256": "ab"}, "name": "x.json"}] and got["predicate"] == {"n": 1}


def test_ordered_hash_is_bound_to_the_order(spark):
    rows = spark.createDataFrame([(n, f"v{n % 3}") for n in range(40)], "p long, v string")
    whole = binding.ordered_hash(rows, "p", ["v"]).first()[0]
    assert binding.ordered_hash(rows.repartition(7), "p", ["v"]).first()[0] == whole
    swapped = rows.withColumn("p", F.when(F.col("p") == 0, 1).when(F.col("p") == 1, 0).otherwise(F.col("p")))
    assert binding.ordered_hash(swapped, "p", ["v"]).first()[0] != whole


def test_root_and_limitations(spark):
    rows = spark.createDataFrame([("p1", "acme", "prod", "1", ["ROOT_PRODUCT"], []), ("p2", "acme", "lib", "1", ["LIBRARY"], ["supplier_hash_algorithm"])], "population_id string, producer string, name string, version string, roles array<string>, nonblocking_unknown_fields array<string>")
    assert [r.population_id for r in binding.root_of(rows, {"producer": "acme", "name": "prod", "version": "1"}).collect()] == ["p1"]
    assert [r.population_id for r in binding.limitations(rows).collect()] == ["p2"]


FINE = {
    "dataset_id": "d", "root_id": "d@" + "a" * 40, "ref_type": "commit", "ref_name": "v1", "resolved_commit": "a" * 40, "tag_object": None, "archive_sha256": "b" * 64, "evidence_sha256": ["c" * 64],
    "scopes": [(True, True)], "admission_status": "ADMITTED_FOR_TRAINING", "split": "TRAIN", "acquisition_status": "FROZEN_VERIFIED_TECHNICAL", "rights_status": "RIGHTS_REVIEWED",
    "usage_status": "ADMITTED_FOR_TRAINING", "release_status": "NOT_APPROVED", "rights_decision_sha256": "e" * 64, "acquisition_allowed": True, "internal_development_allowed": False,
    "evaluation_allowed": False, "training_allowed": True, "fixture_distribution_allowed": False, "raw_redistribution_allowed": False, "adapter_distribution_allowed": False,
    "weight_distribution_allowed": False, "shipping_examples_allowed": False, "max_files": 10, "max_total_bytes": 10,
}
BROKEN = [
    ({"ref_name": "Main"}, {"floating"}), ({"root_id": "x"}, {"root_id"}), ({"tag_object": "f" * 40}, {"tag"}), ({"archive_sha256": None}, {"frozen"}), ({"evidence_sha256": [None]}, {"frozen", "use_needs_rights"}),
    ({"split": "DEV"}, {"training"}), ({"scopes": [(False, True)]}, {"training"}), ({"evaluation_allowed": True}, {"purpose"}), ({"max_files": 0}, {"limits"}), ({"rights_decision_sha256": None}, {"use_needs_rights", "rights_need_decision"}),
    ({"admission_status": "REJECT"}, {"rejected", "use_needs_admission", "usage_status"}), ({"raw_redistribution_allowed": True, "scopes": [(True, False)]}, {"redistribution"}), ({}, set()),
]


def test_source_registry_mutations(spark):
    booleans = [k for k, v in FINE.items() if isinstance(v, bool)]
    kinds = {k: "boolean" for k in booleans} | {"evidence_sha256": "array<string>", "scopes": "array<struct<training_allowed: boolean, raw_redistribution_allowed: boolean>>", "max_files": "int", "max_total_bytes": "long"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in FINE)
    rows = [FINE | {"dataset_id": f"d{n}", "root_id": f"d{n}@" + "a" * 40} | change for n, (change, _) in enumerate(BROKEN)]
    got = {}
    for r in registry.source_violations(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect():
        got.setdefault(r.dataset_id, set()).add(r.rule)
    assert got == {f"d{n}": rules for n, (_, rules) in enumerate(BROKEN) if rules}


# A release whole

TWO_LANES = [
    ("build", "b1", "acme", "prod", "1", ["pkg:generic/prod@1"], ["SHA-256:a"], [], ["ROOT_PRODUCT"]), ("artifact", "a1", "acme", "prod", "1", ["pkg:generic/prod@1"], ["SHA-256:a"], [], ["ROOT_PRODUCT"]),
    ("build", "b2", "acme", "lib", "2", ["pkg:generic/lib@2"], [], [], ["LIBRARY"]), ("artifact", "a2", "acme", "lib", "2", ["pkg:generic/lib@2"], [], [], ["LIBRARY"]),
]


def release_parts(spark, *more):
    candidates = [("c1", "acme", "prod", "1", ["pkg:generic/prod@1"], [], [], []), ("c2", "acme", "lib", "2", ["pkg:generic/lib@2"], [], [], [])]
    schema = "candidate_id string, producer string, name string, version string, identifiers array<string>, hashes array<string>, provenances array<string>, roles array<string>"
    edges = spark.createDataFrame([("build", "b1", "DEPENDS_ON", "b2"), ("artifact", "a1", "DEPENDS_ON", "a2"), *more], "lane_id string, src string, rel string, dst string")
    declared = spark.createDataFrame([("c1", "DEPENDS_ON", "c2")], "src string, rel string, dst string")
    lanes = spark.createDataFrame([("build", "e1"), ("artifact", "e2")], "lane_id string, evidence_id string")
    return cluster.population(records(spark, *TWO_LANES)), spark.createDataFrame(candidates, schema), edges, declared, lanes


def test_release_closes_when_all_agree(spark):
    parts = release_parts(spark)
    found = release.analyse(*parts, "SYNTHETIC_RECONCILED")
    rows = found.collect()
    assert {r.status for r in rows} == {"MATCHED"} and len(rows) == 3 and release.counts(found).first().state == "CLOSED"
    edge = next(r for r in rows if r.finding_type == "CANDIDATE_RELATIONSHIP")
    assert edge.evidence_ids == ["e1", "e2"] and len(edge.claim_ids) == 2
    body = {k: edge[k] for k in ("claim_ids", "details", "evidence_ids", "finding_type", "relationship", "source_population_id", "status", "target_population_id")}
    assert edge.finding_id == "finding-" + hashlib.sha256(json.dumps(body, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    assert release.gate_violations(parts[0], found).isEmpty()


def test_release_opens_on_one_disagreement(spark):
    parts = release_parts(spark, ("build", "b1", "CONTAINS", "b2"))
    found = release.analyse(*parts, "SYNTHETIC_RECONCILED").collect()
    got = {(r.finding_type, r.status) for r in found}
    assert got == {("COMPONENT", "MATCHED"), ("RELATIONSHIP", "CONFLICT"), ("CANDIDATE_RELATIONSHIP", "MATCHED"), ("CANDIDATE_RELATIONSHIP", "MISSING_FROM_SBOM"), ("DECLARED_STATUS_MISMATCH", "CONFLICT")}
    assert next(r for r in found if r.finding_type == "DECLARED_STATUS_MISMATCH").details == ["declared=SYNTHETIC_RECONCILED", "computed=SYNTHETIC_RECONCILIATION_OPEN"]
    with pytest.raises(ValueError, match="declared status"):
        release.analyse(*parts, "FINE")
    lost = release.unmapped_claims(release.relationship_claims(parts[2].union(spark.createDataFrame([("build", "b1", "CONTAINS", "b9")], parts[2].schema)), parts[4]), parts[0])
    assert [r.dst for r in lost.collect()] == ["b9"]


def test_supplier_hashes(spark):
    rows = records(spark, *TWO_LANES[2:]).withColumn("supplier_hashes", F.when(F.col("lane_id") == "build", F.array(F.lit("SHA-256:x"), F.lit("UNKNOWN:y"))).otherwise(F.array(F.lit("SHA-256:UNKNOWN"))))
    one = cluster.population(rows).first()
    assert one.conflict_fields == [] and one.nonblocking_unknown_fields == ["supplier_hash_algorithm", "supplier_hash_value"]
    torn = cluster.population(rows.withColumn("supplier_hashes", F.array(F.concat(F.lit("SHA-256:"), "lane_id")))).first()
    assert torn.conflict_fields == ["supplier_hash"]
    candidate = release_parts(spark)[1].filter("candidate_id = 'c2'")
    state = lambda h: reconcile.five_states(candidate.withColumn("supplier_hashes", F.array(F.lit(h))), cluster.population(rows)).first()
    assert state("SHA-256:x").status == "MATCHED" and state("SHA-256:z").details == ["supplier_hash"] and state("SHA-256:UNKNOWN").status == "MATCHED"


def test_run_package_is_closed_or_not_written(spark, tmp_path):
    line = spark.createDataFrame([("x",)], "value string")
    none, some = spark.createDataFrame([], "subject string, rule string"), spark.createDataFrame([("f", "open")], "subject string, rule string")
    parts, path = {n: line for n in export.CLOSED_PARTS}, str(tmp_path / "run")
    with pytest.raises(ValueError, match="rules broken"):
        export.write_run_package(spark, path, parts, some)
    with pytest.raises(ValueError, match="parts"):
        export.write_run_package(spark, path, {"run": line}, none)
    sealed = export.write_run_package(spark, path, parts, none)
    assert export.run_package_violations(spark, path, sealed) == [] and export.run_package_violations(spark, path, "0" * 64) == ["trusted"]
    line.union(line).write.mode("overwrite").text(f"{path}/spdx")
    assert export.run_package_violations(spark, path, sealed) == ["part spdx"]
    export.write_run_package(spark, str(tmp_path / "open"), {n: line for n in export.OPEN_PARTS}, None)


def test_run_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    run = lambda i: spark.createDataFrame([(i, "SYNTHETIC", "p", hashlib.sha256(b"board").hexdigest())], "run_id string, classification string, package string, dashboard_sha256 string")
    export.register_run(spark, path, run("r1"))
    export.register_run(spark, path, run("r2"))
    with pytest.raises(ValueError, match="registered"):
        export.register_run(spark, path, run("r1"))
    assert export.registered_run(spark, path, "r2", b"board").first().run_id == "r2"
    with pytest.raises(Exception, match="is not registered"):
        export.registered_run(spark, path, "r2", b"other").collect()


def test_export_pair_binds_one_release(spark):
    row = ("run-1", "SYNTHETIC_NOT_EVIDENCE", "c" * 64, "b1", "a" * 64, "2026-01-05T00:00:00Z", "author", "rel-1", "prod", "1")
    names = "run_id classification canonical_sha256 build_id artifact_sha256 release_timestamp sbom_author release_id product product_version".split()
    one = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))
    heads = export.cyclonedx_head(one), export.spdx_head(one)
    assert json.loads(heads[0].first().line)["metadata"]["properties"][1] == {"name": "corroborate:run-id", "value": "run-1"}
    assert export.pair_violations(*heads, one).isEmpty()
    assert [r.field for r in export.pair_violations(*heads, one.withColumn("build_id", F.lit("b2"))).collect()] == ["build_id"]


def test_profiles_compared(spark):
    """The case of three profiles: one key, versions 2.31.0, 2.31.0 and 2.28.0."""
    schema = "profile_id string, profile_kind string, run_id string, bom_ref string, name string, version string, purl string, cpe string, logical_key string, hashes array<string>"
    rows = [(f"p{n}", kind, f"run{n}", f"r{n}", "lib", v, None, None, "purl:pkg:generic/lib", []) for n, (kind, v) in enumerate((("SOURCE_DIRECTORY", "2.31.0"), ("OCI_ARCHIVE", "2.31.0"), ("PORTABLE_RUNTIME", "2.28.0")))]
    rows += [("p0", "SOURCE_DIRECTORY", "run0", "u", "odd", None, None, None, None, [])]
    observations = spark.createDataFrame(rows, schema)
    rested = profiles.evidence(observations)
    assert sorted(r.code for r in profiles.findings(rested).collect()) == ["STALE_PORTABLE_RUNTIME", "VERSION_CONFLICT"] and rested.count() == 6
    assert [(r.bom_ref, r["count"]) for r in profiles.unidentified(observations).collect()] == [("u", 1)]
    assert profiles.observation_violations(observations).isEmpty()


def test_packages_of_two_images(spark):
    schema = "architecture string, name string, version string"
    before = spark.createDataFrame([("cortexa57", "demo", "1.0-r0"), ("all", "same", "1")], schema)
    after = spark.createDataFrame([("cortexa57", "demo", "2.0-r0"), ("all", "same", "1"), ("all", "new", "1")], schema)
    assert {(r.logical_key, r.change) for r in image.package_diff(before, after).collect()} == {("cortexa57:demo", "UPDATED"), ("all:same", "UNCHANGED"), ("all:new", "ADDED")}
    with pytest.raises(Exception, match="repeated package"):
        image.package_diff(before.union(before), after).collect()


def test_services_and_tools(spark):
    docs = [{"services": [{"bom-ref": "s", "name": "api"}], "metadata": {"tools": {"components": [{"name": "scan", "version": "1"}]}}}, {"metadata": {"tools": [{"vendor": "v", "name": "old"}]}}]
    found = nested.services_and_tools(spark.createDataFrame([(str(n), json.dumps(d)) for n, d in enumerate(docs)], "doc string, raw string"))
    assert {(r.doc, r.kind, r.vendor, r.name) for r in found.collect()} == {("0", "service", None, "api"), ("0", "tool", None, "scan"), ("1", "tool", "v", "old")}


def test_class_links_connect_what_pairs_connect(spark):
    """Random records of three lanes: the components of the classes' links are those of all pairs."""
    import random

    rng, rows = random.Random(4), []
    for n in range(120):
        some = lambda kind, k, most: sorted({f"{kind}{rng.randrange(k)}" for _ in range(rng.randrange(most))})
        rows.append((f"lane{n % 3}", f"c{n}", rng.choice(["x", "UNKNOWN"]), rng.choice(["n1", "n2"]), "1", some("pkg:p", 6, 3), some("SHA-256:h", 4, 2), some("source:s", 3, 2), []))
    table = records(spark, *rows)
    pairs = cluster.pair_matches(table)
    joined = lambda a, b: F.concat_ws("\x1f", a, b)
    want = components.components(pairs.select(joined("lane_l", "id_l").alias("a"), joined("lane_r", "id_r").alias("b")))
    got = components.components(cluster.links(table))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
