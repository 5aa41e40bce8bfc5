"""Image graphs, exports, packages, registry and documents: what queries over the tables do not show."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from corroborate.functions import document
from corroborate.operators import export, imagegraph, observation, release
from corroborate.plans.carriers import spark_view
from corroborate.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
PARTS = "img_images img_inputs img_manifest img_native img_expected img_observed img_depends".split()


@pytest.fixture(scope="module")
def graph(spark):
    views = [spark_view(spark, SF, n).filter("image in (1, 2)").coalesce(1).cache() for n in PARTS]
    made = imagegraph.derive(*views)
    return imagegraph.Graph(*(d.coalesce(1).cache() for d in made)), views


def test_image_exports_resolve(graph):
    """Every reference of an image's whole SPDX document is an element of it, and the document lists every element."""
    made, _ = graph
    canonical = imagegraph.canonical_hashes(imagegraph.lines(made))
    lines = imagegraph.spdx(made, canonical).filter("image = 1").select(F.col("line").alias("raw"))
    assert export.spdx_reference_errors(lines).isEmpty()
    raw = [json.loads(r.raw) for r in lines.collect()]
    ids = {x["spdxId"] for x in raw if x["type" if "type" in x else "from"] in ("software_Package", "Relationship")}
    document_id = next(x["spdxId"] for x in raw if x.get("type") == "SpdxDocument")
    assert {e for x in raw if "element" in x and x["from"] == document_id for e in x["element"]} == ids | {x["spdxId"] for x in raw if x.get("type") == "software_Sbom"}
    without = lines.filter("raw not like '%software_Sbom%'")
    assert {r.problem.split("/")[-2] for r in export.spdx_reference_errors(without).collect()} == {"sbom"}


def test_a_recorded_graph_is_checked_element_by_element(graph):
    made, _ = graph
    lines = imagegraph.lines(made)
    assert imagegraph.differences(lines, lines).isEmpty() and imagegraph.misnamed(lines).isEmpty()
    one = lines.filter("kind = 'file'").limit(1).first()
    tampered = lines.withColumn("line", F.when(F.col("id") == one.id, F.lit(one.line.replace('"status":"', '"status":"X'))).otherwise(F.col("line")))
    assert [(r.id, r.problem) for r in imagegraph.differences(lines, tampered).collect()] == [(one.id, "changed")]
    assert [r.id for r in imagegraph.misnamed(tampered).collect()] == [one.id]


def test_an_image_needs_each_input_once(graph):
    _, views = graph
    with pytest.raises(Exception, match="inputs of image"):
        imagegraph.heads(views[0], views[1].filter("role <> 'qemuboot' or image <> 1")).collect()
    with pytest.raises(Exception, match="inputs of image"):
        imagegraph.heads(views[0], views[1].union(views[1].filter("role = 'qemuboot'"))).collect()


def test_image_package_is_checked_by_regeneration(spark, graph, tmp_path, monkeypatch):
    """One line changed in one of many files is named by part, leaf and line; equal leaves are not read again. Three parts of a package's nine."""
    monkeypatch.setattr(export, "IMAGE_PARTS", ("run", "spdx", "validation"))
    made, _ = graph
    run_id, canonical = made.heads.filter("image = 1").first().run_id, "c" * 64
    named = made.heads.select("image", F.lit(canonical).alias("canonical_sha256"))
    one = lambda text: spark.createDataFrame([(text,)], "line string")
    lines = [(r.line,) for r in imagegraph.spdx(made, named).filter("image = 1").select("line").collect()]
    parts = {"run": one(run_id), "spdx": spark.createDataFrame(lines, "line string"), "validation": one("MECHANICALLY_VALID")}
    path = str(tmp_path / "pack")
    export.write_image_package(spark, path, parts, run_id, canonical)
    assert [(r.name, r.problem) for r in export.sealed_package_violations(spark, path, parts, "0" * 64).collect()] == [("anchor", "unbound")]
    files = sorted((tmp_path / "pack" / "spdx").glob("folder=*/part-*.txt"))
    assert len(files) > 5 and all(f.parent.name.startswith("folder=h") for f in files)
    target = files[3]
    first, *rest = target.read_text().splitlines()
    (target.parent / f".{target.name}.crc").unlink()
    target.write_text("\n".join([first.replace('"', "'"), *rest]) + "\n")
    assert {(r.line, r.on_disk, r.derived) for r in export.line_differences(spark, path, parts).collect()} == {(first, 0, 1), (first.replace('"', "'"), 1, 0)}
    changed = parts | {"run": parts["run"].select(F.concat("line", F.lit(" ")).alias("line"))}
    assert {(r.name, r.problem) for r in export.leaf_differences(spark, path, changed).collect()} == {("spdx", "disk"), ("run", "derived")}
    with pytest.raises(ValueError, match="rules broken"):
        export.write_image_package(spark, str(tmp_path / "other"), parts, run_id, canonical, derived=changed)
    assert [r.name for r in export.sealed_package_violations(spark, str(tmp_path / "other"), parts).collect()] == ["COMPLETE"]
    with pytest.raises(ValueError, match="parts"):
        export.write_image_package(spark, str(tmp_path / "few"), {"run": parts["run"]}, run_id, canonical)


def test_scan_package_binds_its_statement(spark, tmp_path):
    line = spark.createDataFrame([("x",), ("y",)], "line string")
    parts = {n: line for n in export.SCAN_PARTS}
    path = str(tmp_path / "scan")
    sealed = export.write_scan_package(spark, path, parts, "run-1", "c" * 64)
    assert export.sealed_package_violations(spark, path, parts, sealed).isEmpty()
    text = json.loads(spark.read.text(f"{path}/STATEMENT").first().value)
    assert text["subject"][0]["digest"]["sha256"] == "c" * 64 and text["predicate"]["manifest_sha256"] == sealed
    target = next((tmp_path / "scan" / "STATEMENT").glob("part-*.txt"))
    (target.parent / f".{target.name}.crc").unlink()
    target.write_text(target.read_text().replace("run-1", "run-2"))
    assert [r.name for r in export.sealed_package_violations(spark, path, parts).collect()] == ["STATEMENT"]


def test_two_writers_of_one_run(spark, tmp_path):
    """Of several writers of one id at once, one registers it; others' runs are not touched."""
    path = str(tmp_path / "registry")
    run = lambda i, board: spark.createDataFrame([(i, "c", "p", board)], "run_id string, classification string, package string, dashboard_sha256 string")
    done, failed = [], []

    def write(board, i="same"):
        try:
            export.register_run(spark, path, run(i, board))
            done.append(board)
        except ValueError as e:
            failed.append(str(e))

    threads = [threading.Thread(target=write, args=(f"b{n}",)) for n in range(6)] + [threading.Thread(target=write, args=("other", "other"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = {r.run_id: r.dashboard_sha256 for r in export.registered_runs(spark, path).collect()}
    assert len(done) == 2 and len(failed) == 5 and all("registered" in f for f in failed)
    assert rows == {"same": next(b for b in done if b != "other"), "other": "other"}


def test_a_writer_that_fails_gives_its_claim_back(spark, tmp_path):
    path = str(tmp_path / "registry")
    bad = spark.createDataFrame([("r", "c", "p", "d")], "run_id string, classification string, package string, dashboard_sha256 string")
    key = __import__("hashlib").sha256(b"r").hexdigest()[:32]
    (tmp_path / "registry").mkdir()
    (tmp_path / "registry" / f"entry={key}").write_text("in the way")
    with pytest.raises(Exception):  # noqa: B017
        export.register_run(spark, path, bad)
    (tmp_path / "registry" / f"entry={key}").unlink()
    export.register_run(spark, path, bad)
    assert export.registered_runs(spark, path).count() == 1


def test_analysis_stops_on_what_it_cannot_map(spark):
    names = "records candidate lane_edges candidate_edges lanes".split()
    records, candidate, edges, declared, lanes = (spark_view(spark, SF, n) for n in names)
    from corroborate.operators import cluster

    population = cluster.population(records.filter("cast(substr(component_id, 2) as int) < 25"))
    own = population.select(F.explode("sources").alias("s")).select("s.lane_id", F.col("s.component_id").alias("c"))
    fine = edges.join(own.withColumnRenamed("c", "src"), ["lane_id", "src"], "left_semi").join(own.withColumnRenamed("c", "dst"), ["lane_id", "dst"], "left_semi").select("lane_id", "src", "rel", "dst")
    release.analyse(population, candidate, fine, declared, lanes, "SYNTHETIC_RECONCILED")
    for lane, dst in (("build", "nowhere"), ("other", "b1")):
        lost = fine.union(spark.createDataFrame([(lane, own.first().c, "CONTAINS", dst)], fine.schema))
        with pytest.raises(ValueError, match="rules broken"):
            release.analyse(population, candidate, lost, declared, lanes, "SYNTHETIC_RECONCILED")
    with pytest.raises(ValueError, match="lane"):
        release.analyse(population, candidate, fine, declared, lanes.filter("lane_id = 'build'"), "SYNTHETIC_RECONCILED")


def test_release_diff_needs_one_population_a_key(spark):
    rows = spark.createDataFrame([("p1", [("l", "a"), ("m", "b")], "x"), ("p2", [("m", "a"), ("l", "b")], "y")], "population_id string, sources array<struct<lane_id: string, component_id: string>>, producer string")
    rows = rows.select("*", *(F.col("producer").alias(c) for c in ("name", "version")), F.array("producer").alias("identifiers"), F.array("producer").alias("hashes"))
    with pytest.raises(Exception, match="repeated key"):
        release.component_changes(rows, rows).collect()
    one = rows.filter("population_id = 'p1'")
    changed = one.withColumn("hashes", F.array(F.lit("z")))
    found = release.component_changes(one, changed).first()
    assert (found.source_component_ids, found.change, found.changed_fields, found.previous, found.current) == (["a", "b"], "MODIFIED", ["hashes"], '{"hashes":["x"]}', '{"hashes":["z"]}')


def test_documents_in_one_form(spark):
    rows = spark.createDataFrame([('{"b":[{"z":1,"a":{"serial_number":"q\\"run_id\\":1"}}],"a":"\\"serial_number\\":2"}',), ('{"a":{"serial_number":{"x":1}}}',), ("no json",)], "raw string")
    text = document.canonical_text(F.col("raw"))
    good = rows.filter("raw like '%b%z%'").select(document.scrubbed(text, ["serial_number"], ["z"]).alias("s"), text.alias("t")).first()
    assert json.loads(good.t)["a"] == '"serial_number":2' and json.loads(good.s) == {"a": '"serial_number":2', "b": [{"a": {"serial_number": None}}]}
    with pytest.raises(Exception, match="no scalar"):
        rows.filter("raw like '%x%'").select(document.scrubbed(text, ["serial_number"], [])).collect()
    assert rows.filter("raw = 'no json'").select(document.semantic_sha256(F.col("raw")).alias("h")).first().h is None
    long = spark.createDataFrame([(json.dumps({"serial_number": "x" * 200_000, "k": ['a"' * 50_000]}),)], "raw string")
    assert long.select(F.length(document.scrubbed(document.canonical_text(F.col("raw")), ["serial_number"], [])).alias("n")).first().n < 160_000


def test_observation_stops_beyond_its_profile(spark):
    names = "obs_profiles obs_heads obs_components obs_dependencies".split()
    profiles, heads, components, dependencies = (spark_view(spark, SF, n) for n in names)
    scanner = F.struct(F.lit("syft").alias("name"), F.lit("1.50.0").alias("version"), F.lit("c" * 64).alias("binary_sha256"), F.lit("d" * 64).alias("config_sha256")).alias("scanner")
    profiles, heads = profiles.select("*", scanner), heads.select("*", scanner)
    again = components.withColumn("line", F.regexp_replace("line", '"serial_number": "s', '"serial_number": "other'))
    first, second = (observation.sealed(profiles, heads, c, dependencies).select("profile_id", "run_id", "canonical_sha256").orderBy("profile_id").collect() for c in (components, again))
    assert [r.run_id for r in first] == [r.run_id for r in second] and [r.canonical_sha256 for r in first] != [r.canonical_sha256 for r in second]
    for broken, what in ((profiles.withColumn("max_components", F.lit(1)), "component limit"), (profiles.withColumn("scanner", scanner.withField("version", F.lit("2"))), "scanner identity")):
        with pytest.raises(Exception, match=what):
            observation.sealed(broken, heads, components, dependencies).collect()
    with pytest.raises(Exception, match="JSON"):
        observation.sealed(profiles, heads, components.withColumn("line", F.lit("{")), dependencies).collect()


def test_scan_dashboard(spark):
    obs = spark.createDataFrame([("p", "OCI_ARCHIVE", "r", ("1.0",), (4,))], "profile_id string, profile_kind string, run_id string, subject struct<declared_version: string>, cyclonedx_evidence struct<component_count: int>")
    findings = spark.createDataFrame([("f", "OPEN", "C", "why")], "finding_id string, state string, code string, explanation string")
    assert [tuple(r) for r in observation.scan_dashboard(obs, findings, "run", "space").collect()] == [
        ("run", "release", "space", "NOT_RELEASED", "MULTI_PROFILE_OBSERVATION"), ("run", "profile", "p", "PROFILE_ISOLATED_OPEN", "OCI_ARCHIVE 1.0 5 r"), ("run", "conflict", "f", "OPEN", "C: why")
    ]


def test_every_new_query_is_registered():
    assert {"image_graph_differences", "release_graph_diff", "semantic_hash", "candidate_round_trip", "observations_sealed", "export_resolves"} <= set(QUERIES)
