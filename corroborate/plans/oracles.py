"""DuckDB SQL for the queries, written from their rules and not from the Spark plans."""

from __future__ import annotations

import re

from corroborate.plans.carriers import duckdb_views

ORACLES: dict[str, str] = {}


def oracle(name: str, views: str, body: str, before: str = "") -> None:
    ORACLES[name] = f"WITH RECURSIVE {duckdb_views(*views.split())}{before}\n{body}"


_CANON = """CASE WHEN starts_with({r}, 'pkg:') THEN split_part({r}, '?', 1) || CASE WHEN contains({r}, '?') AND len(list_filter(string_split(substr({r}, strpos({r}, '?') + 1), '&'), lambda q: starts_with(q, 'arch=') OR starts_with(q, 'distro='))) > 0
    THEN '?' || array_to_string(list_filter(string_split(substr({r}, strpos({r}, '?') + 1), '&'), lambda q: starts_with(q, 'arch=') OR starts_with(q, 'distro=')), '&') ELSE '' END END"""
_CANON_P, _CANON_H, _CANON_REF = (_CANON.format(r=r) for r in ("x.p", "h.purl", "ref"))

_TEXT = lambda v: f"coalesce('\"' || {v} || '\"', 'null')"
_POINTER = f"""'{{"justification":' || {_TEXT('justification')} || ',"status":"' || status || '","vulnerability_id":"' || s.vulnerability_id || '"}}'"""
_SAID = f""", said AS (SELECT DISTINCT statement_id, vulnerability_id, status, justification, vex_document_sha256, position, {_CANON_P} AS purl FROM (SELECT *, unnest(purls) AS p FROM vex) x),
asked AS (SELECT * EXCLUDE (purl), {_CANON_H} AS purl FROM hits h)"""
_DECIDED = lambda on: f"""decided AS (SELECT a.handoff_id, a.position, hit_id, a.vulnerability_id, a.purl, original_status, count(statement_id) > 0 AND count(statement_id) FILTER (status <> 'not_affected') = 0 AS narrowed,
    CASE WHEN count(statement_id) = 0 THEN 'RETAINED_OPEN_NO_VEX_MATCH' WHEN count(*) FILTER (status <> 'not_affected') > 0 THEN 'RETAINED_OPEN_CONTRADICTORY_VEX' END AS reason,
    count(statement_id) AS n_statements, coalesce(string_agg(statement_id, ',' ORDER BY statement_id), '') AS pointers, '[' || coalesce(string_agg(CASE WHEN statement_id IS NOT NULL THEN {_POINTER} END, ',' ORDER BY s.vex_document_sha256, s.position), '') || ']' AS vex_pointers
    FROM asked a LEFT JOIN said s ON a.vulnerability_id = s.vulnerability_id AND a.purl = s.purl{on} GROUP BY ALL)"""  # noqa: E731
_NARROW = _SAID + ", " + _DECIDED("")
oracle("narrow_hits", "hits vex", "SELECT * EXCLUDE (position) FROM decided", _NARROW)
oracle("narrow_counts", "hits vex", "SELECT count(*) AS hits, count(*) FILTER (narrowed) AS narrowed, count(*) FILTER (NOT narrowed) AS retained, count(*) FILTER (reason = 'RETAINED_OPEN_NO_VEX_MATCH') AS no_match, count(*) FILTER (reason = 'RETAINED_OPEN_CONTRADICTORY_VEX') AS contradictory FROM decided", _NARROW)
oracle("purl_presence_gate", "hits lane_build", f"SELECT DISTINCT {_CANON_H} AS purl FROM hits h WHERE {_CANON_H} NOT IN (SELECT split_part(unnest(identifiers), '@', 1) || '?arch=a' FROM lane_build)")
_STATUS_OK = "status IN ('not_affected', 'affected', 'fixed', 'unknown')"
oracle("vex_violations", "vex", f"""SELECT statement_id, 'status' AS rule FROM vex WHERE NOT {_STATUS_OK}
UNION ALL SELECT statement_id, 'justification' FROM vex WHERE justification IS NULL OR (vex_format = 'openvex') <> (justification IN ('vulnerable_code_not_present', 'inline_mitigations_already_exist'))
UNION ALL SELECT statement_id, 'purls' FROM vex WHERE len(purls) = 0 OR len(list_filter(purls, lambda p: NOT regexp_full_match(p, 'pkg:[A-Za-z0-9.+-]+/.+'))) > 0""")
_STATEMENT = f"""'{{"detail":' || {_TEXT('detail')} || ',"first_issued_utc":null,"issuer_id":"' || issuer_id || '","justification":' || {_TEXT('justification')} || ',"last_updated_utc":' || {_TEXT('last_updated_utc')} || ',"narrowing_eligible":' || CASE WHEN status = 'not_affected' THEN 'true' ELSE 'false' END
    || ',"product_purls":[' || array_to_string(list_transform(purls, lambda p: '"' || p || '"'), ',') || '],"status":"' || status || '","vex_document_sha256":"' || vex_document_sha256 || '","vex_format":"' || vex_format || '","vulnerability_id":"' || vulnerability_id || '"}}'"""
_RECEIPTS = lambda t: f"""SELECT 'corroborate.vex-intake-receipt/v1' AS schema_version, min(vex_format) AS vex_format, vex_document_sha256, any_value(signature_sha256) AS signature_sha256, min(issuer_id) AS issuer_id, any_value(binary_sha256) AS binary_sha256,
    sha256('[' || string_agg({_STATEMENT}, ',' ORDER BY vulnerability_id, array_to_string(purls, '|'), position) || ']') AS statements_canonical_sha256, count(*) AS statement_count, count(*) FILTER (status = 'not_affected') AS narrowing_eligible_count
    FROM {t} LEFT JOIN vex_signatures USING (vex_document_sha256) GROUP BY vex_document_sha256"""  # noqa: E731
oracle("vex_receipt", "vex vex_signatures", f"SELECT * EXCLUDE (statements_canonical_sha256) FROM ({_RECEIPTS('vex')})")
oracle("vex_set_hash", "vex vex_signatures", f"SELECT vex_document_sha256, statements_canonical_sha256 AS sha256 FROM ({_RECEIPTS('vex')})")
oracle("vex_receipt_violations", "vex vex_signatures", f"SELECT vex_document_sha256, 'narrowing_eligible_count' AS rule FROM ({_RECEIPTS('vex')}) WHERE vex_document_sha256 LIKE '%4' UNION ALL SELECT vex_document_sha256, 'binary_sha256' FROM ({_RECEIPTS('vex')}) WHERE vex_document_sha256 LIKE '%7'")
_BINDING = f""", was AS (SELECT * REPLACE (CASE WHEN vex_document_sha256 LIKE '%8' THEN 'other' ELSE detail END AS detail, CASE WHEN vex_document_sha256 LIKE '%1' THEN 'else' ELSE issuer_id END AS issuer_id) FROM vex WHERE NOT (vex_document_sha256 LIKE '%2' AND position % 9 = 0)),
said_was AS ({_RECEIPTS('was')}), said_now AS ({_RECEIPTS('vex')}),
broken AS (SELECT vex_document_sha256, unnest(list_filter([CASE WHEN vex_document_sha256 LIKE '%5' AND {{gone}} THEN 'document' END, CASE WHEN w.issuer_id <> n.issuer_id THEN 'issuer_id' END, CASE WHEN w.statement_count <> n.statement_count THEN 'statement_count' END,
    CASE WHEN w.narrowing_eligible_count <> n.narrowing_eligible_count THEN 'narrowing_eligible_count' END, CASE WHEN w.statements_canonical_sha256 <> n.statements_canonical_sha256 THEN 'statements_canonical_sha256' END,
    CASE WHEN vex_document_sha256 LIKE '%7' THEN 'binary_sha256' END, CASE WHEN vex_document_sha256 LIKE '%7' THEN 'signature_sha256' END], lambda x: x IS NOT NULL)) AS rule FROM said_was w JOIN said_now n USING (vex_document_sha256))"""
oracle("vex_binding", "vex vex_signatures", "SELECT * FROM broken", _BINDING.replace("{gone}", "true"))
oracle("narrow_bound", "hits vex vex_signatures", """SELECT hit_id, narrowed, reason, n_statements FROM decided WHERE vex_document_sha256 IN (SELECT vex_document_sha256 FROM vex) AND vex_document_sha256 NOT IN (SELECT vex_document_sha256 FROM broken)
UNION ALL SELECT hit_id, false, 'VEX_INTAKE_BINDING_FAILED', 0 FROM hits WHERE vex_document_sha256 NOT IN (SELECT vex_document_sha256 FROM vex) OR vex_document_sha256 IN (SELECT vex_document_sha256 FROM broken)""",
    _SAID + ", " + _DECIDED(" AND a.vex_document_sha256 = s.vex_document_sha256").replace("SELECT a.handoff_id,", "SELECT a.vex_document_sha256, a.handoff_id,") + _BINDING.replace("{gone}", "false"))
oracle("hit_violations", "hits", "SELECT DISTINCT handoff_id, 'purl' AS rule FROM hits WHERE handoff_id LIKE '%3' AND position % 7 = 0 UNION ALL SELECT DISTINCT handoff_id, 'cyclonedx_sha256' FROM hits WHERE NOT regexp_full_match(cyclonedx_sha256, '[0-9a-f]{64}') UNION ALL SELECT handoff_id, 'hits' FROM hits GROUP BY 1 HAVING count(*) > 500")
_NARROWING_RECEIPT = """SELECT 'corroborate.narrowing-reconcile-receipt/v1' AS schema_version, 'SELF_TEST_NOT_CUSTOMER_EVIDENCE' AS classification, sha256(d.handoff_id || chr(10) || cyclonedx_sha256 || chr(10) || repeat('3', 64) || chr(10) || repeat('4', 64)) AS reconcile_id, 'EUVD_TO_SBOM_NARROWING_ONLY' AS direction,
    'EVIDENCE_ANNOTATION_ONLY_NO_HIT_DELETION' AS fact_write, true AS original_handoff_untouched, d.handoff_id, cyclonedx_sha256, 'BOUND' AS source_binding_status, 'issuer' AS issuer_id, repeat('1', 64) AS vex_document_sha256, repeat('2', 64) AS signature_sha256, repeat('3', 64) AS statements_canonical_sha256,
    5 AS narrowing_eligible_count, 30 AS operator_max_receipt_age_days, repeat('4', 64) AS matcher_hits_sha256, count(*) AS total_hits, count(*) FILTER (narrowed) AS narrowed_count, count(*) FILTER (NOT narrowed) AS not_narrowed_count
    FROM decided d JOIN (SELECT DISTINCT handoff_id, cyclonedx_sha256 FROM hits) USING (handoff_id) GROUP BY d.handoff_id, cyclonedx_sha256"""
oracle("narrowing_receipts", "hits vex", _NARROWING_RECEIPT, _NARROW)
oracle("narrowing_receipt_violations", "hits vex", "SELECT handoff_id, 'counts' AS rule FROM hits WHERE handoff_id = 'h1' GROUP BY 1 UNION ALL SELECT handoff_id, 'rederived' FROM hits WHERE handoff_id = 'h2' GROUP BY 1 UNION ALL SELECT handoff_id, 'direction' FROM hits WHERE handoff_id = 'h4' GROUP BY 1")
oracle("purl_names", "named", f"""SELECT id, {_CANON_REF} AS canonical, CASE WHEN starts_with(ref, 'pkg:') THEN 'purl:' || regexp_replace(split_part(split_part(ref, '#', 1), '?', 1), '@[^@/]*$', '') END AS purl_key,
CASE WHEN starts_with(cpe, 'cpe:2.3:') AND len(string_split(cpe, ':')) = 13 THEN array_to_string(list_concat(list_slice(string_split(cpe, ':'), 1, 5), ['*'], list_slice(string_split(cpe, ':'), 7, 13)), ':') END AS cpe_key,
CASE WHEN starts_with(ref, 'pkg:') THEN ref END AS openvex_purl FROM named""")
oracle("component_names", "named", r"""SELECT id, CASE WHEN list_has_any(roles, ['ROOT_PRODUCT', 'TOP_LEVEL']) THEN 'application' WHEN list_contains(roles, 'BINARY_ONLY_FIRMWARE') THEN 'firmware' ELSE 'library' END AS component_type,
CASE algorithm WHEN 'md5' THEN 'MD5' WHEN 'sha-1' THEN 'SHA-1' WHEN 'Odd' THEN 'ODD' ELSE 'SHA-256' END AS hash_name,
regexp_full_match(lower(digest), '[0-9a-f]+') AND (algorithm = 'Odd' OR length(digest) = CASE algorithm WHEN 'md5' THEN 32 WHEN 'sha-1' THEN 40 ELSE 64 END) AS hash_fits,
coalesce(nullif(substr(trim(regexp_replace(ref, '[^A-Za-z0-9._~-]+', '-', 'g'), '-'), 1, 48), ''), 'id') || '-' || substr(sha256(ref), 1, 16) AS fragment,
'name-' || sha256('{"id":' || id || ',"name":"' || name || '"}') AS stable_id, '$.components[' || id || '].name' AS error_path, sha256(name || chr(10) || ref || chr(10) || cpe) AS reconcile_id FROM named""")
oracle("scalar_forms", "texts", """SELECT id, ['A', 'Z', 'AA', 'AZ', 'BA', 'ZZ', 'AAA'][CAST(id % 7 AS INT) + 1] AS letters, [0, 25, 26, 51, 52, 701, 702][CAST(id % 7 AS INT) + 1] AS column_number,
strlen(safe_id) AS decoded_bytes, sha256(safe_id) AS decoded_sha256, left(url, 12) AS cut, CASE WHEN id % 2 = 0 THEN id // 2 WHEN (id // 2) % 2 = 0 THEN id // 2 ELSE id // 2 + 1 END AS elapsed_ms, '20260102030405' AS stamp FROM texts""")
oracle("claims_unpivot", "lane_build", """SELECT *, 'claim-' || sha256('{"field":"' || field || '","lane_id":"' || lane_id || '","source_component_id":"' || component_id || '","value":"' || value || '"}') AS claim_id FROM (
SELECT lane_id, component_id, 'producer' AS field, producer AS value FROM lane_build UNION ALL SELECT lane_id, component_id, 'name', name FROM lane_build UNION ALL SELECT lane_id, component_id, 'version', version FROM lane_build
UNION ALL SELECT lane_id, component_id, 'identifier', unnest(CASE WHEN len(identifiers) = 0 THEN ['UNKNOWN'] ELSE identifiers END) FROM lane_build)""")

_PAIRS = """, pairs AS (SELECT DISTINCT l.lane_id AS lane_l, l.component_id AS id_l, r.lane_id AS lane_r, r.component_id AS id_r FROM records l JOIN records r ON l.lane_id < r.lane_id
AND CASE WHEN len(l.identifiers) > 0 AND len(r.identifiers) > 0 THEN list_has_any(l.identifiers, r.identifiers)
    ELSE l.producer <> 'UNKNOWN' AND l.name <> 'UNKNOWN' AND l.version <> 'UNKNOWN' AND l.producer = r.producer AND l.name = r.name AND l.version = r.version END
AND CASE WHEN len(l.hashes) > 0 AND len(r.hashes) > 0 THEN list_has_any(l.hashes, r.hashes) WHEN len(l.provenances) > 0 AND len(r.provenances) > 0 THEN list_has_any(l.provenances, r.provenances) ELSE true END)"""
oracle("pair_matches", "records", "SELECT * FROM pairs", _PAIRS)
_POPULATION = _PAIRS + """, nodes AS (SELECT *, lane_id || chr(31) || component_id AS node FROM records),
near AS (SELECT lane_l || chr(31) || id_l AS a, lane_r || chr(31) || id_r AS b FROM pairs),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
roots AS (SELECT a AS node, min(b) AS cluster FROM reach GROUP BY a),
own AS (SELECT n.*, cluster FROM nodes n JOIN roots USING (node)),
grouped AS (SELECT cluster, list_sort(list_distinct(list(nullif(producer, 'UNKNOWN')))) AS ps, list_sort(list_distinct(list(nullif(name, 'UNKNOWN')))) AS ns, list_sort(list_distinct(list(nullif(version, 'UNKNOWN')))) AS vs,
    list_sort(list_distinct(flatten(list(identifiers)))) AS identifiers, list_sort(list_distinct(flatten(list(hashes)))) AS hashes, list_sort(list_distinct(flatten(list(provenances)))) AS provenances, list_sort(list_distinct(flatten(list(roles)))) AS roles, list_sort(list_distinct(flatten(list(supplier_hashes)))) AS supplier_hashes,
    list_sort(list_distinct(list(lane_id))) AS lanes, count(*) AS members, count(DISTINCT lane_id) AS n_lanes,
    string_agg('{"lane_id":"' || lane_id || '","source_component_id":"' || component_id || '"}', ',' ORDER BY lane_id, component_id) AS js, string_agg(lane_id || '/' || component_id, ',' ORDER BY lane_id, component_id) AS listed
    FROM own GROUP BY cluster),
population AS (SELECT 'population-' || sha256('{"source_components":[' || js || ']}') AS population_id, CASE WHEN len(ps) = 1 THEN ps[1] ELSE 'UNKNOWN' END AS producer, CASE WHEN len(ns) = 1 THEN ns[1] ELSE 'UNKNOWN' END AS name, CASE WHEN len(vs) = 1 THEN vs[1] ELSE 'UNKNOWN' END AS version,
    identifiers, hashes, provenances, roles, supplier_hashes, lanes, listed AS members,
    list_filter([CASE WHEN len(roles) > 1 THEN 'component_role' END, CASE WHEN g.members > n_lanes THEN 'identity' END, CASE WHEN len(ns) > 1 THEN 'name' END, CASE WHEN len(hashes) > 1 THEN 'observed_hash' END, CASE WHEN len(ps) > 1 THEN 'producer' END, CASE WHEN len(list_filter(supplier_hashes, lambda h: h NOT LIKE '%UNKNOWN%')) > 1 THEN 'supplier_hash' END, CASE WHEN len(vs) > 1 THEN 'version' END], lambda x: x IS NOT NULL) AS conflict_fields,
    list_filter([CASE WHEN list_contains(supplier_hashes, 'UNKNOWN:v') THEN 'supplier_hash_algorithm' END, CASE WHEN list_contains(supplier_hashes, 'SHA-256:UNKNOWN') THEN 'supplier_hash_value' END], lambda x: x IS NOT NULL) AS nonblocking_unknown_fields,
    list_filter([CASE WHEN len(identifiers) = 0 THEN 'identifier' END, CASE WHEN len(ns) <> 1 THEN 'name' END, CASE WHEN len(ps) <> 1 THEN 'producer' END, CASE WHEN len(vs) <> 1 THEN 'version' END], lambda x: x IS NOT NULL) AS critical_unknown_fields
    FROM grouped g)"""
_J = lambda *cs: ", ".join(f"array_to_string({c}, ',') AS {c}" for c in cs)
oracle("population", "records", f"SELECT population_id, producer, name, version, members, {_J('identifiers', 'hashes', 'provenances', 'roles', 'supplier_hashes', 'lanes', 'conflict_fields', 'critical_unknown_fields', 'nonblocking_unknown_fields')} FROM population", _POPULATION)
oracle("export_components", "records", f"""SELECT population_id, name, version, list_min(list_filter(identifiers, lambda i: starts_with(i, 'pkg:'))) AS purl, 'library' AS type, {_J('hashes')} FROM population""", _POPULATION)
_BEST = _POPULATION + """, scored AS (SELECT c.candidate_id, p.population_id, CASE WHEN len(c.identifiers) > 0 AND len(p.identifiers) > 0 THEN 100 ELSE 10 END + CASE WHEN c.version <> 'UNKNOWN' AND c.version = p.version THEN 5 ELSE 0 END
    + CASE WHEN list_has_any(c.hashes, p.hashes) THEN 1000 ELSE 0 END + CASE WHEN list_has_any(c.provenances, p.provenances) THEN 500 ELSE 0 END + CASE WHEN list_has_any(c.roles, p.roles) THEN 100 ELSE 0 END AS score
    FROM candidate c JOIN population p ON CASE WHEN len(c.identifiers) > 0 AND len(p.identifiers) > 0 THEN list_has_any(c.identifiers, p.identifiers) ELSE c.producer <> 'UNKNOWN' AND c.name <> 'UNKNOWN' AND c.producer = p.producer AND c.name = p.name END),
best AS (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS n_populations FROM (SELECT *, max(score) OVER (PARTITION BY candidate_id) AS top FROM scored) WHERE score = top)"""
oracle("best_match", "candidate records", "SELECT candidate_id, population_id, score, n_populations FROM best", _BEST)
_STATES = _BEST + """, per AS (SELECT population_id, count(*) AS n, max(n_populations) AS ties, min(candidate_id) AS one FROM best GROUP BY 1),
met AS (SELECT p.*, coalesce(n, 0) AS n, ties, one, c.producer AS c_producer, c.name AS c_name, c.version AS c_version, c.identifiers AS ci, c.hashes AS ch, c.provenances AS cp, c.roles AS cr, c.supplier_hashes AS cs, list_filter(p.supplier_hashes, lambda h: h NOT LIKE '%UNKNOWN%') AS ps FROM population p LEFT JOIN per USING (population_id) LEFT JOIN candidate c ON c.candidate_id = one),
judged AS (SELECT *, list_sort(list_filter([CASE WHEN producer = 'UNKNOWN' OR c_producer = 'UNKNOWN' THEN 'producer' END, CASE WHEN name = 'UNKNOWN' OR c_name = 'UNKNOWN' THEN 'name' END, CASE WHEN version = 'UNKNOWN' OR c_version = 'UNKNOWN' THEN 'version' END,
    CASE WHEN len(ci) = 0 OR len(identifiers) = 0 THEN 'identifier' END, CASE WHEN len(cr) > 0 AND len(roles) = 0 THEN 'component_role' END, CASE WHEN len(cp) > 0 AND len(provenances) = 0 THEN 'provenance' END, CASE WHEN len(ch) > 0 AND len(hashes) = 0 THEN 'observed_hash' END, CASE WHEN len(cs) > 0 AND len(ps) = 0 THEN 'supplier_hash' END], lambda x: x IS NOT NULL)) AS unknowns,
    list_sort(list_filter([CASE WHEN producer <> c_producer THEN 'producer' END, CASE WHEN name <> c_name THEN 'name' END, CASE WHEN version <> c_version THEN 'version' END,
    CASE WHEN NOT list_has_any(ci, identifiers) THEN 'identifier' END, CASE WHEN len(cr) > 0 AND NOT list_has_any(cr, roles) THEN 'component_role' END, CASE WHEN len(cp) > 0 AND NOT list_has_any(cp, provenances) THEN 'provenance' END, CASE WHEN len(ch) > 0 AND NOT list_has_any(ch, hashes) THEN 'observed_hash' END, CASE WHEN len(cs) > 0 AND NOT list_has_any(cs, ps) THEN 'supplier_hash' END], lambda x: x IS NOT NULL)) AS differs FROM met),
findings AS (SELECT population_id, CASE WHEN n = 1 AND (len(conflict_fields) > 0 OR ties = 1) THEN one END AS candidate_id,
    CASE WHEN len(conflict_fields) > 0 THEN 'CONFLICT' WHEN n > 1 OR n = 1 AND ties > 1 THEN 'UNKNOWN' WHEN n = 0 AND len(critical_unknown_fields) > 0 THEN 'UNKNOWN' WHEN n = 0 THEN 'MISSING_FROM_SBOM'
        WHEN len(critical_unknown_fields) > 0 OR len(unknowns) > 0 THEN 'UNKNOWN' WHEN len(differs) > 0 THEN 'CONFLICT' ELSE 'MATCHED' END AS status,
    array_to_string(CASE WHEN len(conflict_fields) > 0 THEN conflict_fields WHEN n > 1 OR n = 1 AND ties > 1 THEN ['ambiguous_identity'] WHEN n = 0 THEN critical_unknown_fields
        WHEN len(critical_unknown_fields) > 0 THEN critical_unknown_fields WHEN len(unknowns) > 0 THEN unknowns ELSE differs END, ',') AS details FROM judged
    UNION ALL SELECT NULL, candidate_id, CASE WHEN producer = 'UNKNOWN' OR len(identifiers) = 0 THEN 'UNKNOWN' ELSE 'NOT_IN_RELEASE' END, concat_ws(',', CASE WHEN len(identifiers) = 0 THEN 'identifier' END, CASE WHEN producer = 'UNKNOWN' THEN 'producer' END)
    FROM candidate WHERE candidate_id NOT IN (SELECT candidate_id FROM best))"""
oracle("five_state", "candidate records", "SELECT * FROM findings", _STATES)
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("MATCHED", "CONFLICT", "MISSING_FROM_SBOM", "NOT_IN_RELEASE", "UNKNOWN"))
oracle("status_counts", "candidate records", f"SELECT {_COUNTS}, CASE WHEN count(*) FILTER (status <> 'MATCHED') = 0 THEN 'CLOSED' ELSE 'OPEN' END AS state FROM findings", _STATES)

oracle("limitations", "records", "SELECT population_id, array_to_string(nonblocking_unknown_fields, ',') AS fields FROM population WHERE len(nonblocking_unknown_fields) > 0", _POPULATION)
oracle("supplier_conflict", "records", "SELECT population_id, array_to_string(supplier_hashes, ',') AS supplier_hashes FROM population WHERE list_contains(conflict_fields, 'supplier_hash')", _POPULATION)
oracle("export_gate", "candidate records", """SELECT coalesce(population_id, candidate_id) AS subject, 'open' AS rule FROM findings WHERE status <> 'MATCHED'
UNION ALL SELECT population_id, unnest(list_filter([CASE WHEN len(conflict_fields) > 0 THEN 'conflicts' END, CASE WHEN len(critical_unknown_fields) > 0 THEN 'unknowns' END, CASE WHEN len(identifiers) = 0 THEN 'identifier' END, CASE WHEN producer = 'UNKNOWN' THEN 'producer' END, CASE WHEN name = 'UNKNOWN' THEN 'name' END, CASE WHEN version = 'UNKNOWN' THEN 'version' END], lambda x: x IS NOT NULL)) FROM population""", _STATES)
_LIST = lambda v: f"('[' || CASE WHEN {v} = '' THEN '' ELSE '\"' || replace({v}, ',', '\",\"') || '\"' END || ']')"
_CLAIM_OF = """'relationship-claim-' || sha256('{"evidence_ids":["' || evidence_id || '"],"lane_id":"' || lane_id || '","relationship":"' || rel || '","source_component_id":"' || src || '","target_component_id":"' || dst || '"}')"""
_EDGES = f""", member AS (SELECT population_id, unnest(string_split(members, ',')) AS m FROM population),
edge AS (SELECT e.*, evidence_id, {_CLAIM_OF} AS claim_id, s.population_id AS s, d.population_id AS d FROM lane_edges e JOIN lanes USING (lane_id) LEFT JOIN member s ON s.m = lane_id || '/' || src LEFT JOIN member d ON d.m = lane_id || '/' || dst),
projected AS (SELECT s, rel, d, string_agg(DISTINCT lane_id, ',' ORDER BY lane_id) AS lanes, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids FROM edge WHERE s IS NOT NULL AND d IS NOT NULL GROUP BY s, rel, d)"""
oracle("release_relationships", "records lane_edges lanes", f"""SELECT s AS source_population_id, rel AS relationship, d AS target_population_id, lanes, claim_ids, evidence_ids, 'relationship-' || sha256('{{"claim_ids":' || {_LIST('claim_ids')} || ',"discovery_lanes":' || {_LIST('lanes')} || ',"evidence_ids":' || {_LIST('evidence_ids')} || ',"relationship":"' || rel || '","source_population_id":"' || s || '","target_population_id":"' || d || '"}}') AS relationship_id FROM projected""", _POPULATION + _EDGES)
oracle("unmapped_claims", "records lane_edges lanes", f"SELECT lane_id, src, dst, {_CLAIM_OF} AS claim_id FROM lane_edges JOIN lanes USING (lane_id) WHERE src LIKE '%9' OR dst LIKE '%9' OR (lane_id = 'artifact' AND dst NOT IN (SELECT component_id FROM records))")
_ALL = _EDGES + f""", with_evidence AS (SELECT f.*, coalesce((SELECT string_agg(evidence_id, ',' ORDER BY evidence_id) FROM lanes WHERE list_contains(p.lanes, lane_id)), '') AS evidence_ids FROM findings f LEFT JOIN population p USING (population_id)),
component AS (SELECT 'COMPONENT' AS finding_type, population_id, candidate_id, CAST(NULL AS VARCHAR) AS source_population_id, CAST(NULL AS VARCHAR) AS relationship, CAST(NULL AS VARCHAR) AS target_population_id, CAST(NULL AS VARCHAR) AS source_candidate_id, CAST(NULL AS VARCHAR) AS target_candidate_id, status, details, '' AS claim_ids, evidence_ids,
    'finding-' || sha256('{{"candidate_id":' || {_TEXT('candidate_id')} || ',"details":' || {_LIST('details')} || ',"evidence_ids":' || {_LIST('evidence_ids')} || ',"finding_type":"COMPONENT","population_id":' || {_TEXT('population_id')} || ',"status":"' || status || '"}}') AS finding_id FROM with_evidence),
ends AS (SELECT s, d, string_agg(DISTINCT rel, ',' ORDER BY rel) AS kinds, count(DISTINCT rel) AS n, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids FROM edge WHERE s IS NOT NULL AND d IS NOT NULL GROUP BY s, d),
torn AS (SELECT s, d, CASE WHEN kinds LIKE '%UNKNOWN%' THEN 'UNKNOWN' ELSE 'CONFLICT' END AS status, CASE WHEN kinds LIKE '%UNKNOWN%' THEN 'relationship' ELSE kinds END AS details, claim_ids, evidence_ids FROM ends WHERE n > 1 OR kinds = 'UNKNOWN'),
mapping AS (SELECT candidate_id, max_by(population_id, finding_id) AS p FROM component WHERE candidate_id IS NOT NULL AND population_id IS NOT NULL GROUP BY 1),
asked AS (SELECT e.*, a.p AS s, b.p AS d FROM candidate_edges e LEFT JOIN mapping a ON a.candidate_id = src LEFT JOIN mapping b ON b.candidate_id = dst),
met_edges AS (SELECT coalesce(f.s, m.s) AS s, coalesce(f.rel, m.rel) AS rel, coalesce(f.d, m.d) AS d, coalesce(claim_ids, '') AS claim_ids, coalesce(evidence_ids, '') AS evidence_ids, CASE WHEN m.s IS NULL THEN 'MISSING_FROM_SBOM' WHEN f.s IS NULL THEN 'NOT_IN_RELEASE' ELSE 'MATCHED' END AS status,
    CASE WHEN m.s IS NULL THEN 'candidate_relationship_missing' WHEN f.s IS NULL THEN 'candidate_relationship_not_supported_by_discovery' ELSE '' END AS details FROM projected f FULL JOIN (SELECT DISTINCT s, rel, d FROM asked WHERE s IS NOT NULL AND d IS NOT NULL) m ON f.s = m.s AND f.rel = m.rel AND f.d = m.d),
all_findings AS (SELECT * FROM component
UNION ALL SELECT 'RELATIONSHIP', NULL, NULL, s, NULL, d, NULL, NULL, status, details, claim_ids, evidence_ids, 'finding-' || sha256('{{"claim_ids":' || {_LIST('claim_ids')} || ',"details":' || {_LIST('details')} || ',"evidence_ids":' || {_LIST('evidence_ids')} || ',"finding_type":"RELATIONSHIP","source_population_id":"' || s || '","status":"' || status || '","target_population_id":"' || d || '"}}') FROM torn
UNION ALL SELECT 'CANDIDATE_RELATIONSHIP', NULL, NULL, s, rel, d, NULL, NULL, status, details, claim_ids, evidence_ids, 'finding-' || sha256('{{"claim_ids":' || {_LIST('claim_ids')} || ',"details":' || {_LIST('details')} || ',"evidence_ids":' || {_LIST('evidence_ids')} || ',"finding_type":"CANDIDATE_RELATIONSHIP","relationship":"' || rel || '","source_population_id":"' || s || '","status":"' || status || '","target_population_id":"' || d || '"}}') FROM met_edges
UNION ALL SELECT 'CANDIDATE_RELATIONSHIP', NULL, NULL, NULL, rel, NULL, src, dst, 'UNKNOWN', 'candidate_relationship_endpoint_not_reconciled', '', '', 'finding-' || sha256('{{"claim_ids":[],"details":["candidate_relationship_endpoint_not_reconciled"],"evidence_ids":[],"finding_type":"CANDIDATE_RELATIONSHIP","relationship":"' || rel || '","source_candidate_id":"' || src || '","status":"UNKNOWN","target_candidate_id":"' || dst || '"}}') FROM asked WHERE s IS NULL OR d IS NULL)"""
oracle("release_analysis", "candidate records lane_edges candidate_edges lanes", """SELECT * FROM all_findings UNION ALL SELECT 'DECLARED_STATUS_MISMATCH', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'CONFLICT', 'declared=SYNTHETIC_RECONCILED,computed=SYNTHETIC_RECONCILIATION_OPEN', '', '',
'finding-' || sha256('{"claim_ids":[],"details":["declared=SYNTHETIC_RECONCILED","computed=SYNTHETIC_RECONCILIATION_OPEN"],"evidence_ids":[],"finding_type":"DECLARED_STATUS_MISMATCH","status":"CONFLICT"}')""", _STATES + _ALL)
oracle("release_counts", "candidate records lane_edges candidate_edges lanes", f"SELECT {_COUNTS}, (SELECT string_agg(DISTINCT status, ',' ORDER BY status) FROM all_findings WHERE status <> 'MATCHED') AS blocking_statuses, 'OPEN' AS state FROM all_findings", _STATES + _ALL)

oracle("relationship_conflicts", "rel_claims", """SELECT src, dst, CASE WHEN bool_or(rel = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'CONFLICT' END AS status, CASE WHEN bool_or(rel = 'UNKNOWN') THEN 'relationship' ELSE string_agg(DISTINCT rel, ',' ORDER BY rel) END AS details
FROM rel_claims GROUP BY src, dst HAVING bool_or(rel = 'UNKNOWN') OR count(DISTINCT rel) > 1""")
oracle("relationship_projection", "rel_claims", "SELECT src, rel, dst, string_agg(DISTINCT lane_id, ',' ORDER BY lane_id) AS lanes, count(*) AS n_claims FROM rel_claims GROUP BY ALL")
oracle("relationship_full_outer", "rel_claims rel_declared rel_mapping", """SELECT coalesce(f.src, m.s) AS src, coalesce(f.rel, m.rel) AS rel, coalesce(f.dst, m.d) AS dst, CASE WHEN m.s IS NULL THEN 'MISSING_FROM_SBOM' WHEN f.src IS NULL THEN 'NOT_IN_RELEASE' ELSE 'MATCHED' END AS status
FROM (SELECT DISTINCT src, rel, dst FROM rel_claims) f FULL JOIN (SELECT s, rel, d FROM mapped WHERE s IS NOT NULL AND d IS NOT NULL) m ON f.src = m.s AND f.rel = m.rel AND f.dst = m.d
UNION ALL SELECT src, rel, dst, 'UNKNOWN' FROM mapped WHERE s IS NULL OR d IS NULL""", ", mapped AS (SELECT r.*, a.population_id AS s, b.population_id AS d FROM rel_declared r LEFT JOIN rel_mapping a ON a.candidate_id = src LEFT JOIN rel_mapping b ON b.candidate_id = dst)")
oracle("dependency_rows", "rel_claims", "SELECT ref, coalesce(string_agg(DISTINCT dst, ',' ORDER BY dst) FILTER (rel IN ('DEPENDS_ON', 'DYNAMICALLY_LINKS')), '') AS depends_on FROM (SELECT src AS ref FROM rel_claims UNION SELECT dst FROM rel_claims) LEFT JOIN rel_claims ON src = ref GROUP BY ref")
oracle("reference_integrity", "rel_declared rel_mapping", "SELECT DISTINCT src, dst, 'dangling' AS problem FROM rel_declared WHERE dst NOT IN (SELECT candidate_id FROM rel_mapping WHERE population_id NOT LIKE '%7') UNION ALL SELECT src, dst, 'repeated' FROM rel_declared WHERE src LIKE '%1'")
oracle("contains_root", "installed", "SELECT 'image' AS src, 'CONTAINS' AS rel, name AS dst FROM installed")
oracle("release_diff", "release_a release_b", """SELECT item, CASE WHEN a IS NULL THEN 'ADDED' WHEN b IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change, CASE WHEN a AND b THEN concat_ws(',', CASE WHEN p THEN 'producer' END, CASE WHEN v THEN 'version' END) ELSE '' END AS changed_fields
FROM (SELECT item, x.a, y.b, x.producer <> y.producer AS p, x.version <> y.version AS v FROM (SELECT *, true AS a FROM release_a) x FULL JOIN (SELECT *, true AS b FROM release_b) y USING (item)) WHERE a IS NULL OR b IS NULL OR p OR v""")
oracle("relation_diff", "rel_claims", "SELECT *, 'REMOVED' AS change FROM (SELECT src, rel, dst FROM rel_claims WHERE src NOT LIKE '%3' EXCEPT SELECT src, rel, dst FROM rel_claims WHERE dst NOT LIKE '%2') UNION ALL SELECT *, 'ADDED' FROM (SELECT src, rel, dst FROM rel_claims WHERE dst NOT LIKE '%2' EXCEPT SELECT src, rel, dst FROM rel_claims WHERE src NOT LIKE '%3')")
oracle("image_diff", "files_expected files_observed", "SELECT path, CASE WHEN e.sha256 IS NULL THEN 'ADDED' WHEN o.sha256 IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change, CASE WHEN e.sha256 <> o.sha256 THEN 'sha256' ELSE '' END AS changed_fields FROM files_expected e FULL JOIN files_observed o USING (path) WHERE e.sha256 IS DISTINCT FROM o.sha256")
oracle("file_reconcile", "files_expected files_observed", """SELECT path, CASE WHEN e.sha256 IS NULL THEN 'MISSING_FROM_SBOM' WHEN o.sha256 IS NULL THEN 'NOT_IN_RELEASE' WHEN e.sha256 = 'UNKNOWN' THEN 'UNKNOWN' WHEN e.sha256 <> o.sha256 THEN 'CONFLICT' ELSE 'MATCHED' END AS status,
CASE WHEN e.sha256 IS NULL OR o.sha256 IS NULL THEN 'path' WHEN e.sha256 = 'UNKNOWN' THEN 'build_metadata_sha256' WHEN e.sha256 <> o.sha256 THEN 'sha256' ELSE '' END AS details FROM files_expected e FULL JOIN files_observed o USING (path)""")
oracle("package_name_join", "installed described", """SELECT i.name, CASE count(d.name) WHEN 0 THEN 'MISSING_FROM_SBOM' WHEN 1 THEN 'MATCHED' ELSE 'UNKNOWN' END AS status, count(d.name) = 1 AND min(d.version) <> min(i.version) AS version_differs FROM installed i LEFT JOIN described d USING (name) GROUP BY i.name
UNION ALL SELECT name, 'NOT_IN_RELEASE', false FROM described WHERE name NOT IN (SELECT name FROM installed)""")
oracle("version_conflict", "profiles", "SELECT logical_key, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, string_agg(DISTINCT profile_kind, ',' ORDER BY profile_kind) AS kinds FROM profiles WHERE logical_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT version) > 1 AND count(DISTINCT profile_kind) > 1")
oracle("stale_portable", "profiles", "SELECT p.logical_key, string_agg(DISTINCT p.version, ',' ORDER BY p.version) AS stale, any_value(reference) AS reference FROM profiles p JOIN (SELECT logical_key, list(version) AS vs, string_agg(DISTINCT version, ',' ORDER BY version) AS reference FROM profiles WHERE profile_kind <> 'PORTABLE_RUNTIME' AND version IS NOT NULL GROUP BY 1) r USING (logical_key) WHERE profile_kind = 'PORTABLE_RUNTIME' AND p.version IS NOT NULL AND NOT list_contains(vs, p.version) GROUP BY 1")
oracle("unidentified", "profiles", "SELECT profile_kind, count(*) FILTER (logical_key IS NULL) AS n FROM profiles GROUP BY 1")
oracle("coverage", "profiles", "SELECT count(*) AS components, count(logical_key) AS with_logical_key, count(*) FILTER (version <> '7') AS with_version FROM profiles")
oracle("manifest_totals", "manifest", "SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (executable) AS executables FROM manifest")
oracle("exact_set_hash", "manifest", """SELECT root_id, sha256('{"files":[' || string_agg('{"executable":' || CASE WHEN executable THEN 'true' ELSE 'false' END || ',"relative_path":"' || path || '","sha256":"' || sha256 || '","size":' || size || '}', ',' ORDER BY path) || '],"root_id":"' || root_id || '"}') AS exact_set_sha256 FROM manifest GROUP BY root_id""")
oracle("manifest_difference", "manifest tree", "SELECT path, 'missing' AS side FROM (SELECT path, size, executable FROM manifest EXCEPT ALL SELECT path, size, executable FROM tree) UNION ALL SELECT path, 'extra' FROM (SELECT path, size, executable FROM tree EXCEPT ALL SELECT path, size, executable FROM manifest)")
_SOURCE = "NOT regexp_matches(path, '(^|/)([.][^/]*|__pycache__|venv|env|node_modules|build|dist|site-packages)/')"
oracle("import_gaps", "source_files source_components", f"""SELECT DISTINCT project, module, NOT EXISTS (SELECT 1 FROM source_components c WHERE c.project = m.project AND lower(c.name) = lower(module)) AS missing FROM (SELECT project, split_part(unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:from|import)[ \t]+([a-zA-Z_][a-zA-Z0-9_.]*)', 1)), '.', 1) AS module FROM source_files WHERE path LIKE '%.py' AND {_SOURCE}) m
WHERE module <> 'os' AND NOT EXISTS (SELECT 1 FROM source_files f WHERE f.project = m.project AND path LIKE '%.py' AND {_SOURCE} AND (list_contains(string_split(path, '/')[:-2], module) OR string_split(path, '/')[-1] = module || '.py'))""")
oracle("requirement_refs", "source_files", f"SELECT DISTINCT project, t[2] AS referenced FROM (SELECT project, string_split(trim(unnest(string_split(text, chr(10)))), ' ') AS t FROM source_files WHERE path LIKE '%.txt' AND {_SOURCE} AND (regexp_matches(path, '(^|/)requirements[^/]*$') OR regexp_matches(path, '(^|/)requirements/[^/]*$'))) WHERE t[1] IN ('-r', '--requirement')")
oracle("requirement_gaps", "source_files source_components", f"""SELECT DISTINCT project, name FROM (SELECT project, regexp_extract(trim(unnest(list_filter(CAST(r AS JSON[]), lambda x: json_type(x) = 'VARCHAR')) ->> '$'), '^[A-Za-z0-9._-]*') AS name FROM (SELECT project, arg_min(json_extract(text, '$.requirements'), path) AS r FROM source_files WHERE path LIKE '%/manifest.json' AND {_SOURCE} AND list_contains(json_keys(text), 'domain') GROUP BY project)) g
WHERE NOT EXISTS (SELECT 1 FROM source_components c WHERE c.project = g.project AND lower(c.name) = lower(g.name))""")
_DECLARED_PY, _DECLARED_C = "path IN ('requirements.txt', 'requirements.in', 'poetry.lock', 'setup.py')", "path IN ('vcpkg.json', 'conanfile.txt')"
oracle("zero_component", "source_files source_components", f"""SELECT *, component_count = 0 AND python_sources AND NOT python_declared AS zero_python, component_count = 0 AND c_sources AND NOT c_declared AS zero_c FROM (
SELECT project, (SELECT count(*) FROM source_components c WHERE c.project = f.project) AS component_count, bool_or(path LIKE '%.py' AND {_SOURCE}) AS python_sources, bool_or({_DECLARED_PY}) AS python_declared, bool_or(regexp_matches(path, '[.](c|hpp)$') AND {_SOURCE}) AS c_sources, bool_or({_DECLARED_C}) AS c_declared FROM source_files f GROUP BY project)""")
oracle("exact_keys", "json_docs", "SELECT event_id, raw LIKE '{%' AND json_keys(raw) = ['k'] AS exact FROM json_docs")
oracle("rule_violations", "texts", """SELECT id, 'text' AS rule FROM texts WHERE id % 9 < 3 UNION ALL SELECT id, 'safe_id' FROM texts WHERE id % 8 < 3 UNION ALL SELECT id, 'path' FROM texts WHERE id % 7 < 5
UNION ALL SELECT id, 'items' FROM texts WHERE id % 3 > 0 UNION ALL SELECT id, 'url' FROM texts WHERE NOT regexp_full_match(url, '(?i:https)://[^/?#@:]+(:443)?/[^?# ]+') UNION ALL SELECT id, 'ordered' FROM texts WHERE id % 3 = 1""")
oracle("claim_links", "card_claims", "SELECT conflict_id || '/' || claim_id AS claim_id, evidence_id FROM card_claims WHERE evidence_id = 'ev2'")
_FIRST = "(SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY claim_id) AS place FROM card_claims)"
oracle("conflict_cards", "card_claims", f"SELECT conflict_id, any_value(n) AS n_claims, string_agg(DISTINCT claim_id, ',' ORDER BY claim_id) AS claim_ids, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence, any_value(n) <= 64 AS fits FROM {_FIRST} JOIN (SELECT conflict_id, count(DISTINCT claim_id) AS n FROM card_claims GROUP BY 1) USING (conflict_id) WHERE place <= 64 GROUP BY 1")
oracle("rule_advice", "card_claims", f"SELECT conflict_id, 'NO_FACT_WRITE_NO_STATE_CHANGE_NO_RELEASE_OR_CONFORMITY_AUTHORITY' AS authority_boundary, 'ask_for_evidence' AS action, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_refs, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_refs, 'claims differ' AS explanation, 'which source holds' AS questions FROM {_FIRST} WHERE place <= 64 GROUP BY 1")
oracle("advice_violations", "card_claims", """SELECT DISTINCT conflict_id, unnest(CASE conflict_id % 9 WHEN 0 THEN ['claims'] WHEN 1 THEN ['cites'] WHEN 2 THEN ['action'] WHEN 3 THEN ['claims'] WHEN 5 THEN ['explanation'] WHEN 6 THEN ['questions'] WHEN 7 THEN ['questions', 'boundary'] ELSE [] END) AS rule FROM card_claims""")
oracle("arm_metrics", "arm_results", "SELECT arm_id, count(*) AS results, count(*) FILTER (valid) AS valid, count(*) FILTER (valid) / count(*) AS rate, (SELECT bool_and(valid) FROM arm_results) AS gate FROM arm_results GROUP BY arm_id")
oracle("run_catalogue", "run_findings", "SELECT run_id, count(*) AS findings, count(*) FILTER (status <> 'MATCHED') AS open_findings, CASE WHEN count(*) FILTER (status <> 'MATCHED') > 0 THEN 'OPEN' ELSE 'CLOSED' END AS status FROM run_findings GROUP BY 1")
oracle("nested_flatten", "nested", """SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END AS doc, r[1] AS ref, r[2] AS parent, CAST(r[3] AS INT) AS depth, r[4] AS name FROM (SELECT p_partkey, unnest([['r' || p_partkey, NULL, '0', p_name], ['s' || p_partkey, NULL, '0', 'last'], ['k' || p_partkey, 'r' || p_partkey, '1', 'kid'], ['d' || p_partkey, 'k' || p_partkey, '2', 'deep']]) AS r FROM part)""")
oracle("runtime_registry", "runtimes", """SELECT runtime_id, 'runtime_id' AS rule FROM runtimes WHERE starts_with(runtime_id, '-') UNION ALL SELECT runtime_id, 'category' FROM runtimes WHERE category = 'other' UNION ALL SELECT runtime_id, 'status' FROM runtimes WHERE status = 'GONE'
UNION ALL SELECT runtime_id, 'source_url' FROM runtimes WHERE source_url LIKE 'ftp%' UNION ALL SELECT runtime_id, 'resolved_commit' FROM runtimes WHERE length(resolved_commit) < 40 UNION ALL SELECT runtime_id, 'hashes' FROM runtimes WHERE config_sha256 LIKE 'B%'
UNION ALL SELECT runtime_id, 'frozen' FROM runtimes WHERE status = 'FROZEN' AND artifact_sha256 IS NULL UNION ALL SELECT runtime_id, 'repeated' FROM runtimes GROUP BY runtime_id HAVING count(*) > 1""")
oracle("issuer_registry", "issuers", """SELECT issuer_id, 'status' AS rule FROM issuers WHERE status = 'ODD' UNION ALL SELECT issuer_id, 'key_hash' FROM issuers WHERE public_key_sha256 = 'short'
UNION ALL SELECT issuer_id, 'admitted' FROM issuers WHERE status LIKE 'ADM%' AND (public_key_sha256 IS NULL OR coalesce(public_key_path, '../') LIKE '../%' OR acquisition_receipt_ref IS NULL)
UNION ALL SELECT issuer_id, 'not_admitted' FROM issuers WHERE status NOT LIKE 'ADM%' AND (public_key_sha256 IS NOT NULL OR public_key_path IS NOT NULL OR acquisition_receipt_ref IS NOT NULL)""")
oracle("image_packages", "image_graph", """SELECT 'p' || p_partkey AS source_id, 'n' || p_partkey AS name, CASE WHEN p_partkey % 6 = 0 THEN 'UNKNOWN' ELSE CAST(p_size AS VARCHAR) END AS version, coalesce(n_name, 'UNKNOWN') AS producer, 'a' || p_partkey || ',pkg:generic/p' || p_partkey AS identifiers
FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 40 WHERE p_partkey % 10 <> 0""")
oracle("image_files", "image_graph", "SELECT 'usr/f' || p_partkey AS path, CASE WHEN p_partkey % 8 = 0 THEN 'UNKNOWN' ELSE 'h' || p_partkey END AS sha256, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 10 <> 0 THEN 'p' || p_partkey ELSE '' END AS owners FROM part WHERE p_partkey % 5 <> 0")
oracle("image_dependencies", "image_graph", "SELECT 'p' || a.p_partkey AS src, 'p' || b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 4 <> 0 AND a.p_partkey % 10 <> 0 AND b.p_partkey % 10 <> 0")
oracle("image_reference_errors", "image_graph", """SELECT 'd' || p_partkey AS id, 'unresolved none' AS problem FROM part UNION ALL SELECT 'd' || p_partkey, 'unresolved p' || (p_partkey + 1) FROM part WHERE p_partkey + 1 NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'p' || p_partkey, 'unresolved org' || (p_partkey % 40) FROM part WHERE p_partkey % 40 NOT IN (SELECT n_nationkey FROM nation)""")
_CLAIMS = """, all_claims AS (SELECT lane_id, component_id, 'producer' AS field, producer AS value FROM records UNION ALL SELECT lane_id, component_id, 'name', name FROM records UNION ALL SELECT lane_id, component_id, 'version', version FROM records
UNION ALL SELECT lane_id, component_id, 'identifier', unnest(CASE WHEN len(identifiers) = 0 THEN ['UNKNOWN'] ELSE identifiers END) FROM records)"""
oracle("finding_claims", "candidate records", """SELECT DISTINCT f.population_id AS finding_id, 'claim-' || sha256('{"field":"' || field || '","lane_id":"' || c.lane_id || '","source_component_id":"' || c.component_id || '","value":"' || value || '"}') AS claim_id, value
FROM findings f JOIN population p USING (population_id) JOIN all_claims c ON list_contains(string_split(p.members, ','), c.lane_id || '/' || c.component_id) WHERE f.status = 'CONFLICT' AND (details = '' OR list_contains(string_split(details, ','), field))""", _STATES + _CLAIMS)
oracle("run_record", "candidate records", "SELECT CASE WHEN count(*) FILTER (status <> 'MATCHED') = 0 THEN 'CLOSED' ELSE 'OPEN' END AS reconciliation_state, CASE WHEN count(*) FILTER (status <> 'MATCHED') = 0 THEN 'INVALID' ELSE 'NOT_RUN_RECONCILIATION_OPEN' END AS serialization_status, false AS engineering_pass, count(*) FILTER (status <> 'MATCHED') AS open_findings FROM findings", _STATES)
oracle("export_dependency_errors", "rel_claims", """SELECT DISTINCT src AS ref, 'row without component' AS problem FROM rel_claims WHERE src LIKE '%4' UNION ALL SELECT DISTINCT src, 'component without row' FROM rel_claims WHERE src LIKE '%5'
UNION ALL SELECT DISTINCT dst, 'unknown target' FROM rel_claims WHERE src NOT LIKE '%5' AND rel IN ('DEPENDS_ON', 'DYNAMICALLY_LINKS') AND dst NOT IN (SELECT src FROM rel_claims WHERE src NOT LIKE '%4')""")

oracle("candidate_identifiers", "typed", "SELECT candidate_id, CASE WHEN purl = 'UNKNOWN' THEN urn ELSE purl || ',' || urn END AS identifiers, role AS roles, CASE WHEN provenance LIKE 'source:_%' THEN provenance ELSE '' END AS provenances, coalesce(algorithm || ':' || digest, '') AS hashes, coalesce(algorithm || ':' || purl, '') AS supplier_hashes FROM typed")
oracle("comparison_keys", "named", """SELECT id, coalesce(CASE WHEN starts_with(ref, 'pkg:') THEN 'purl:' || regexp_replace(split_part(split_part(ref, '#', 1), '?', 1), '@[^@/]*$', '') END,
CASE WHEN starts_with(cpe, 'cpe:2.3:') AND len(string_split(cpe, ':')) = 13 THEN 'cpe:' || array_to_string(list_concat(list_slice(string_split(cpe, ':'), 1, 5), ['*'], list_slice(string_split(cpe, ':'), 7, 13)), ':') END) AS logical_key FROM named""")
oracle("timestamp_violations", "releases", "SELECT release_id, CASE WHEN release_id % 7 < 2 THEN 'format' ELSE 'order' END AS rule FROM releases WHERE release_id % 7 < 2 OR release_id % 5 = 0")
oracle("document_mismatches", "releases release_evidence", """SELECT release_id, 'release_id' AS field FROM releases WHERE release_id % 11 = 0 UNION ALL SELECT release_id, 'product' FROM releases WHERE release_id % 11 <> 0 AND release_id % 3 = 0
UNION ALL SELECT release_id, 'build_id' FROM releases WHERE release_id % 11 <> 0 AND release_id % 4 = 0""")
oracle("layer_budget", "layers", "SELECT archive, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest, count(*) <= 600 AND sum(size) <= 15000 AS within FROM layers GROUP BY archive")
oracle("arm_coverage", "card_claims arm_cards", """SELECT coalesce(a.arm_id, g.arm_id) AS arm_id, coalesce(a.conflict_id, g.conflict_id) AS conflict_id, CASE WHEN a.conflict_id IS NULL THEN 'no card' WHEN g.n IS NULL THEN 'no result' ELSE 'several results' END AS problem
FROM (SELECT DISTINCT arm_id, c.conflict_id FROM arm_cards, (SELECT DISTINCT conflict_id FROM card_claims) c) a FULL JOIN (SELECT arm_id, conflict_id, count(*) AS n FROM arm_cards GROUP BY ALL) g ON a.arm_id = g.arm_id AND a.conflict_id = g.conflict_id WHERE a.conflict_id IS NULL OR g.n IS NULL OR g.n > 1""")
oracle("field_claims", "records", """SELECT population_id, field, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids FROM (SELECT p.population_id, field, 'claim-' || sha256('{"field":"' || field || '","lane_id":"' || c.lane_id || '","source_component_id":"' || c.component_id || '","value":"' || value || '"}') AS claim_id
FROM population p JOIN all_claims c ON list_contains(string_split(p.members, ','), c.lane_id || '/' || c.component_id)) GROUP BY ALL""", _POPULATION + _CLAIMS)
oracle("status_guard", "served", """SELECT run_id, unnest(list_filter([CASE WHEN ref AND manufacturer_role IS NOT NULL THEN 'manufacturer_role' END, CASE WHEN ref AND product_conformity_status IS DISTINCT FROM 'NO_PRODUCT_CONFORMITY_STATUS' THEN 'product_conformity' END,
CASE WHEN status = 'certified' THEN 'status' END, CASE WHEN product_conformity_status = 'CAB_APPROVED' THEN 'product_conformity_status' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, classification NOT LIKE 'SYN%' AS ref FROM served WHERE classification <> 'REAL')""")
oracle("namespace_rules", "profiles", "SELECT unnest(['profile_id', 'profile_kind']) AS problem")
_UUID = lambda d: f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || substr('89ab', CAST('0x' || substr({d}, 17, 1) AS INT) % 4 + 1, 1) || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"
_NAMESPACE = r"'\x6B\xA7\xB8\x11\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB"
oracle("uuid_names", "named", f"SELECT id, {_UUID('d')} AS uuid FROM (SELECT id, sha1({_NAMESPACE} || encode(ref)) AS d FROM named)")
_PROPERTY = lambda name, values: f"""list_transform({values}, lambda v: '{{"name":"corroborate:{name}","value":"' || v || '"}}')"""
_SUPPLIED = "list_filter(supplier_hashes, lambda h: h NOT LIKE '%:UNKNOWN')"
_PURL_OF = "list_min(list_filter(identifiers, lambda i: starts_with(i, 'pkg:')))"
_HEX = lambda key, before, after: f"""CASE WHEN len(hashes) = 0 THEN '' ELSE {key} || array_to_string(list_transform(list_sort(list_transform(hashes, lambda h: sha256(h))), lambda h: '{before}' || h || '{after}'), ',') || ']' END"""
oracle("cyclonedx_lines", "records", f"""SELECT population_id, '{{"bom-ref":"urn:uuid:' || {_UUID('d')} || '"' || {_HEX("',\"hashes\":['", '{"alg":"SHA-256","content":"', '"}')} || ',"name":"' || name || '","properties":[' ||
array_to_string(list_concat({_PROPERTY('identifier', 'identifiers')}, {_PROPERTY('component-role', 'roles')}, {_PROPERTY('discovery-lane', 'lanes')}, {_PROPERTY('supplier-declared-hash', _SUPPLIED)}), ',') || '],"publisher":"' || producer || '"'
|| CASE WHEN len(identifiers) = 0 THEN '' ELSE ',"purl":"' || {_PURL_OF} || '"' END || ',"type":"library","version":"' || version || '"}}' AS line FROM (SELECT *, sha1({_NAMESPACE} || encode('run-1:' || population_id)) AS d FROM population)""", _POPULATION)
_FRAGMENT = lambda v: f"substr(trim(regexp_replace({v}, '[^A-Za-z0-9._~-]+', '-', 'g'), '-'), 1, 48) || '-' || substr(sha256({v}), 1, 16)"
_ID = lambda run, kind, v: f"'https://example.invalid/corroborate/' || {_FRAGMENT(run)} || '/{kind}/' || {_FRAGMENT(v)}"
oracle("spdx_packages", "records", f"""SELECT population_id, '{{"comment":"classification=SYNTHETIC_NOT_EVIDENCE; evidence_ids=","creationInfo":"_:creation-' || substr(sha256('run-1'), 1, 20) || '","externalIdentifier":[' || array_to_string(list_concat(
list_transform(identifiers, lambda i: '{{"externalIdentifierType":"packageUrl","identifier":"' || i || '","type":"ExternalIdentifier"}}'), list_transform({_SUPPLIED}, lambda h: '{{"externalIdentifierType":"other","identifier":"supplier-declared-hash:' || h || '","type":"ExternalIdentifier"}}')), ',')
|| '],"name":"' || name || '"' || CASE WHEN len(identifiers) = 0 THEN '' ELSE ',"software_packageUrl":"' || {_PURL_OF} || '"' END || ',"software_packageVersion":"' || version || '","software_primaryPurpose":"library","spdxId":"' || {_ID("'run-1'", 'package', 'population_id')}
|| '","suppliedBy":"' || {_ID("'run-1'", 'organization', 'producer')} || '","type":"software_Package"' || {_HEX("',\"verifiedUsing\":['", '{"algorithm":"sha256","hashValue":"', '","type":"Hash"}')} || '}}' AS line FROM population""", _POPULATION)
_REF = lambda c: f"(SELECT 'urn:uuid:' || {_UUID('d')} FROM (SELECT sha1({_NAMESPACE} || encode('run-1:' || {c})) AS d))"
oracle("cyclonedx_properties", "rel_claims", f"""SELECT '{{"name":"corroborate:relationship","value":"urn:uuid:' || {_UUID('s')} || '|' || rel || '|urn:uuid:' || {_UUID('d')} || '"}}' AS line FROM (SELECT DISTINCT rel, sha1({_NAMESPACE} || encode('run-1:' || src)) AS s, sha1({_NAMESPACE} || encode('run-1:' || dst)) AS d FROM rel_claims)""")
_P = lambda n, v: f"""'{{"name":"corroborate:{n}","value":"' || {v} || '"}}'"""
oracle("export_heads", "export_release", f"""SELECT run_id, '{{"$schema":"https://cyclonedx.org/schema/bom-1.7.schema.json","bomFormat":"CycloneDX","metadata":{{"authors":[{{"name":"' || sbom_author || '"}}],"properties":[' || concat_ws(',', {_P('classification', 'classification')}, {_P('run-id', 'run_id')}, {_P('canonical-sha256', 'canonical_sha256')},
{_P('build-id', 'build_id')}, {_P('release-artifact-sha256', 'artifact_sha256')}, {_P('technical-state', "'SYNTHETIC_RECONCILIATION_CLOSED'")}) || '],"timestamp":"' || release_timestamp || '"}},"serialNumber":"urn:uuid:' || {_UUID('d')} || '","specVersion":"1.7","version":1}}' AS line FROM (SELECT *, sha1({_NAMESPACE} || encode(run_id)) AS d FROM export_release)
UNION ALL SELECT run_id, '{{"@id":"' || c || '","created":"' || release_timestamp || '","createdBy":["' || {_ID('run_id', 'organization', 'sbom_author')} || '"],"createdUsing":["' || {_ID('run_id', 'tool', "'corroborate'")} || '"],"specVersion":"3.0.1","type":"CreationInfo"}}' FROM created
UNION ALL SELECT run_id, '{{"creationInfo":"' || c || '","name":"corroborate","spdxId":"' || {_ID('run_id', 'tool', "'corroborate'")} || '","type":"Tool"}}' FROM created
UNION ALL SELECT run_id, '{{"comment":"corroborate:binding={{\\"build_id\\":\\"' || build_id || '\\",\\"canonical_sha256\\":\\"' || canonical_sha256 || '\\",\\"classification\\":\\"' || classification || '\\",\\"release_artifact_sha256\\":\\"' || artifact_sha256 || '\\",\\"run_id\\":\\"' || run_id || '\\"}}","creationInfo":"' || c || '","name":"' || product || ' 1.0 SPDX document","profileConformance":["core","software"],"rootElement":["'
|| {_ID('run_id', 'sbom', 'release_id')} || '"],"spdxId":"' || {_ID('run_id', 'document', 'release_id')} || '","type":"SpdxDocument"}}' FROM created""".replace("\\\\", "\\"), ", created AS (SELECT *, '_:creation-' || substr(sha256(run_id), 1, 20) AS c FROM export_release)")
oracle("export_binding", "export_release", "SELECT run_id, 'build_id' AS field FROM export_release WHERE run_id LIKE '%7' UNION ALL SELECT run_id, 'artifact_sha256' FROM export_release WHERE run_id LIKE '%3' UNION ALL SELECT run_id, unnest(['classification', 'run_id', 'canonical_sha256', 'build_id', 'artifact_sha256']) FROM export_release WHERE run_id LIKE '%9'")
oracle("run_dashboard", "candidate records", "SELECT 'run-1' AS run_id, 'component' AS kind, population_id AS subject, producer || ' ' || name || ' ' || version AS status, '' AS details FROM population UNION ALL SELECT 'run-1', 'finding', coalesce(population_id, candidate_id), status, details FROM findings WHERE status <> 'MATCHED'", _STATES)
_OBSERVED = """, torn_keys AS (SELECT logical_key FROM observations WHERE logical_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT version) > 1 AND count(DISTINCT profile_kind) > 1),
known AS (SELECT logical_key, list(version) FILTER (version IS NOT NULL) AS vs FROM observations WHERE profile_kind <> 'PORTABLE_RUNTIME' AND logical_key IS NOT NULL GROUP BY 1 HAVING count(version) > 0),
stale_rows AS (SELECT o.* FROM observations o JOIN known USING (logical_key) WHERE profile_kind = 'PORTABLE_RUNTIME' AND version IS NOT NULL AND NOT list_contains(vs, version)),
rested AS (SELECT 'VERSION_CONFLICT' AS code, o.* FROM observations o WHERE logical_key IN (SELECT logical_key FROM torn_keys) UNION ALL SELECT 'STALE_PORTABLE_RUNTIME', * FROM stale_rows
    UNION ALL SELECT 'STALE_PORTABLE_RUNTIME', o.* FROM observations o WHERE profile_kind <> 'PORTABLE_RUNTIME' AND logical_key IN (SELECT logical_key FROM stale_rows)),
worded AS (SELECT *, CASE code WHEN 'VERSION_CONFLICT' THEN 'version strings differ across isolated evidence profiles; no version ordering is inferred' ELSE 'portable runtime version differs from source/OCI observations; stale is a review label, not semantic version ordering' END AS explanation FROM rested)"""
oracle("profile_evidence", "observations", "SELECT code, logical_key, profile_kind, bom_ref, version FROM rested", _OBSERVED)
oracle("profile_findings", "observations", f"""SELECT code, logical_key, 'OPEN' AS state, explanation, 'selftest-finding-' || sha256('{{"code":"' || code || '","evidence":[' || string_agg('{{"bom_ref":"' || bom_ref || '","cpe":' || {_TEXT('cpe')} || ',"hashes":[' || CASE WHEN len(hashes) = 0 THEN '' ELSE '"' || hashes[1] || '"' END || '],"logical_key":"' || logical_key || '","name":"' || name
|| '","observation_run_id":"' || run_id || '","profile_id":"' || profile_id || '","profile_kind":"' || profile_kind || '","purl":' || {_TEXT('purl')} || ',"version":' || {_TEXT('version')} || '}}', ',' ORDER BY profile_kind, profile_id, bom_ref) || '],"explanation":"' || explanation || '","logical_key":"' || logical_key || '","state":"OPEN"}}') AS finding_id FROM worded GROUP BY code, logical_key, explanation""", _OBSERVED)
oracle("unidentified_list", "observations", "SELECT profile_id, profile_kind, bom_ref, name, version, count(*) OVER (PARTITION BY profile_id) AS count FROM observations WHERE logical_key IS NULL")
oracle("observation_rules", "observations", "SELECT 'profile_kind' AS rule, 'OCI_ARCHIVE' AS subject")
_V = lambda view, key, rules: f"SELECT {key}, unnest(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{rule}' END" for rule, when in rules.items()) + f"], lambda x: x IS NOT NULL)) AS rule FROM {view}"
oracle("release_rules", "release_records", _V("release_records", "release_id", {"release_id": "release_id = '-bad'", "classification": "classification = 'REAL'", "manufacturer": "manufacturer = 'UNKNOWN'", "artifact_relative_path": "artifact_relative_path <> 'artifact/a.tar'", "artifact_sha256": "artifact_sha256 LIKE 'A%'", "times": "evidence_cutoff > release_timestamp"}))
oracle("hash_rules", "component_hashes", _V("component_hashes", "component_id", {"hash": "algorithm = 'MD5' OR value = 'xyz' OR (kind = 'observed' AND (algorithm IS NULL OR value = 'UNKNOWN'))"}))
oracle("release_hashes", "release_records", """SELECT release_id, 'analysis-run-' || sha256('{' || concat_ws(',', '"architecture":"' || architecture || '"', '"artifact_relative_path":"' || artifact_relative_path || '"', '"artifact_sha256":"' || artifact_sha256 || '"', '"build_id":"' || build_id || '"', '"classification":"' || classification || '"', '"hardware_revision":"' || hardware_revision || '"',
'"manufacturer":"' || manufacturer || '"', '"product":"' || product || '"', '"product_version":"' || product_version || '"', '"release_id":"' || release_id || '"', '"sbom_version":"' || sbom_version || '"') || '}') AS sha256 FROM release_records""")
oracle("profile_cards", "observations", f"""SELECT finding_id AS conflict_id, 'claim-' || sha256('{{"bom_ref":"' || bom_ref || '","finding_id":"' || finding_id || '","profile_id":"' || profile_id || '","version":"' || version || '"}}') AS claim_id, version AS value, run_id AS evidence_id FROM rested JOIN (SELECT code, logical_key, finding_id FROM named_findings) USING (code, logical_key) WHERE version IS NOT NULL""",
    _OBSERVED + ", named_findings AS (" + ORACLES["profile_findings"][ORACLES["profile_findings"].rindex("SELECT code, logical_key, 'OPEN'"):] + ")")
oracle("card_set_hash", "card_claims", f"""SELECT CAST(conflict_id % 7 AS VARCHAR) AS card_set_id, sha256('[' || string_agg('{{"claims":[' || claims || '],"conflict_id":' || conflict_id || '}}', ',' ORDER BY conflict_id) || ']') AS sha256 FROM (
SELECT conflict_id, string_agg('{{"claim_id":"' || claim_id || '","evidence_refs":["' || evidence_id || '"],"value":"' || value || '"}}', ',' ORDER BY claim_id) AS claims FROM {_FIRST} WHERE place <= 64 GROUP BY 1) GROUP BY 1""")
oracle("attestation_rules", "attestations", _V("(SELECT *, CAST(doc AS INT) AS k FROM attestations)", "doc", {"type": "k % 7 = 0", "predicateType": "k % 5 = 0", "subject": "k % 4 = 0", "digest": "k % 3 = 0", "predicate": "k % 11 = 0"}))
oracle("signature_rules", "signed", _V("signed", "key_id", {"scheme": "scheme = 'keyless'", "signature_path": "signature_path = ''", "signature_sha256": "signature_sha256 = 'x'", "tool_version": "tool_version IS NULL"}))
oracle("offline_rules", "commands", _V("commands", "command_id", {"verb": "command_id % 7 = 5", "key": "command_id % 7 IN (3, 5)", "sign": "command_id % 7 IN (2, 5)", "verify": "command_id % 7 = 5", "online": "command_id % 7 IN (4, 6)"}))
oracle("handoffs", "inventory_parts handoff_sources", f"""SELECT 'euvd-' || sha256('{{"cyclonedx_sha256":"' || s.cyclonedx_sha256 || '","direction":"SBOM_TO_EUVD_ONLY","endpoint":"' || endpoint || '","source_binding_status":"' || source_binding_status || '","source_profile_id":' || {_TEXT('source_profile_id')} || ',"source_root_completion_sha256":' || {_TEXT('source_root_completion_sha256')} || ',"source_run_id":"' || source_run_id || '"}}') AS handoff_id,
'SELF_TEST_NOT_CUSTOMER_EVIDENCE' AS classification, 'SBOM_TO_EUVD_ONLY' AS direction, source_run_id, source_binding_status, s.cyclonedx_sha256, count(p.cyclonedx_sha256) AS component_record_count, count(purl) AS with_purl, count(nullif(version, '')) AS with_version FROM handoff_sources s LEFT JOIN inventory_parts p USING (cyclonedx_sha256) GROUP BY ALL""")
oracle("handoff_rules", "handoff_sources", _V("handoff_sources", "source_run_id", {"declared": "source_binding_status LIKE 'CALLER%' AND (source_root_completion_sha256 IS NOT NULL OR source_profile_id IS NOT NULL)", "verified": "source_binding_status = 'VERIFIED_ROOT' AND (source_root_completion_sha256 IS NULL OR coalesce(source_profile_id, 'odd') <> 'profile-1')"}))
oracle("arm_differences", "arm_results recorded_arms", "SELECT 'arm-quality' AS arm_id, unnest(['results', 'valid', 'rate']) AS field UNION ALL SELECT 'arm-gone', unnest(['results', 'valid', 'rate']) UNION ALL SELECT 'arm-any', unnest(['results', 'valid', 'rate'])")
oracle("package_diff", "packages_a packages_b", """SELECT coalesce(a.k, b.k) AS logical_key, coalesce(b.name, a.name) AS name, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' WHEN a.version <> b.version THEN 'UPDATED' ELSE 'UNCHANGED' END AS change, a.version AS from_version, b.version AS to_version
FROM (SELECT *, architecture || ':' || name AS k FROM packages_a) a FULL JOIN (SELECT *, architecture || ':' || name AS k FROM packages_b) b ON a.k = b.k""")
oracle("rootfs_totals", "rootfs", """SELECT archive, count(*) AS entry_count, count(*) FILTER (kind = 'file') AS regular_file_count, count(*) FILTER (kind = 'symlink') AS symlink_count, CAST(coalesce(sum(size) FILTER (kind = 'file'), 0) AS BIGINT) AS expanded_regular_bytes,
sha256('[' || coalesce(string_agg('{"path":"' || path || '","sha256":"' || sha256 || '","size":' || size || '}', ',' ORDER BY path) FILTER (kind = 'file'), '') || ']') AS regular_exact_set_sha256,
sha256('[' || coalesce(string_agg('{"path":"' || path || '","target":"' || target || '"}', ',' ORDER BY path) FILTER (kind = 'symlink'), '') || ']') AS symlink_exact_set_sha256 FROM rootfs GROUP BY archive""")
oracle("image_analysis", "installed described files_expected files_observed", """SELECT 'COMPONENT' AS finding_type, i.name AS subject, CASE count(d.name) WHEN 0 THEN 'MISSING_FROM_SBOM' WHEN 1 THEN 'MATCHED' ELSE 'UNKNOWN' END AS status, CASE count(d.name) WHEN 0 THEN 'description' WHEN 1 THEN '' ELSE 'ambiguous_description' END AS details FROM installed i LEFT JOIN described d USING (name) GROUP BY i.name
UNION ALL SELECT 'COMPONENT', name, 'NOT_IN_RELEASE', 'manifest' FROM described WHERE name NOT IN (SELECT name FROM installed)
UNION ALL SELECT 'FILE', path, CASE WHEN e.sha256 IS NULL THEN 'MISSING_FROM_SBOM' WHEN o.sha256 IS NULL THEN 'NOT_IN_RELEASE' WHEN e.sha256 = 'UNKNOWN' THEN 'UNKNOWN' WHEN e.sha256 <> o.sha256 THEN 'CONFLICT' ELSE 'MATCHED' END,
CASE WHEN e.sha256 IS NULL OR o.sha256 IS NULL THEN 'path' WHEN e.sha256 = 'UNKNOWN' THEN 'build_metadata_sha256' WHEN e.sha256 <> o.sha256 THEN 'sha256' ELSE '' END FROM files_expected e FULL JOIN files_observed o USING (path)""")
oracle("nested_components", "nested", """SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END AS doc, r[1] AS ref, r[2] AS parent, CAST(r[3] AS INT) AS depth, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS "group", r[4] AS name, r[5] AS version, r[6] AS purl, r[7] AS cpe, r[8] AS hashes FROM (SELECT p_partkey, unnest([
['r' || p_partkey, NULL, '0', p_name, CAST(p_size AS VARCHAR), 'pkg:generic/p' || p_partkey || '@1', NULL, 'SHA-256:h' || p_partkey], ['s' || p_partkey, NULL, '0', 'last', NULL, NULL, NULL, NULL], ['k' || p_partkey, 'r' || p_partkey, '1', 'kid', NULL, NULL, 'cpe:2.3:a', NULL], ['d' || p_partkey, 'k' || p_partkey, '2', 'deep', NULL, NULL, NULL, NULL]]) AS r FROM part)""")
oracle("projection_rules", "nested", """SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END AS doc, unnest(['r' || p_partkey, 's' || p_partkey, 'k' || p_partkey, 'd' || p_partkey]) AS ref, 'type' AS rule FROM part
UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END, 'k' || p_partkey, 'cpe' FROM part WHERE false""")
oracle("decision_set_hash", "hits vex", """SELECT handoff_id, sha256('[' || string_agg('{"narrowed_by_trusted_vex":' || CASE WHEN narrowed THEN 'true' ELSE 'false' END || ',"original_hit_preserved":true,"original_status":"' || original_status || '","product_purl":"' || purl || '","rejection_reason":' || coalesce('"' || reason || '"', 'null')
|| ',"vex_pointers":' || vex_pointers || ',"vulnerability_id":"' || vulnerability_id || '"}', ',' ORDER BY position) || ']') AS sha256 FROM decided GROUP BY handoff_id""", _NARROW)

_J = lambda l: f"""'[' || array_to_string(list_transform({l}, lambda x: '"' || x || '"'), ',') || ']'"""
_IMG = "img_images img_inputs img_manifest img_native img_expected img_observed img_depends"
_EVIDENCE = """, img_ev AS (SELECT i.*, CASE WHEN role = 'rootfs_archive' THEN artifact_lane ELSE build_lane END AS lane_id, CASE WHEN role = 'rootfs_archive' THEN 'rootfs-tar-artifact-observation' ELSE 'yocto-spdx-3.0.1-build-metadata' END AS adapter_id,
    CASE WHEN role = 'rootfs_archive' THEN 'ARTIFACT_OBSERVATION' ELSE 'BUILD_METADATA' END AS independence_domain, CASE WHEN role = 'rootfs_archive' THEN 'RELEASE_ARTIFACT_HASH' ELSE 'BUILD_OBSERVED_HASH' END AS hash_kind FROM img_inputs i JOIN img_images USING (image)),
img_evidence AS (SELECT *, 'yocto-evidence-' || sha256('{"adapter_id":"' || adapter_id || '","adapter_version":"1.0.0","independence_domain":"' || independence_domain || '","lane_id":"' || lane_id || '","relative_path":"' || relative_path || '","role":"' || role || '","sha256":"' || sha256 || '"}') AS evidence_id FROM img_ev)"""
oracle("image_evidence", _IMG, "SELECT * FROM img_evidence", _EVIDENCE)
_LANE = lambda lane, ids, adapter, domain: f"""'{{"adapter_id":"{adapter}","adapter_version":"1.0.0","evidence_ids":' || {_J(ids)} || ',"independence_domain":"{domain}","lane_id":"' || {lane} || '"}}'"""
_LANES = [_LANE("build_lane", "build_ids", "yocto-spdx-3.0.1-build-metadata", "BUILD_METADATA"), _LANE("artifact_lane", "[artifact_evidence]", "rootfs-tar-artifact-observation", "ARTIFACT_OBSERVATION")]
_HEADS = _EVIDENCE + f""", img_ids AS (SELECT image, max(evidence_id) FILTER (role = 'build_spdx') AS build_evidence, max(evidence_id) FILTER (role = 'image_manifest') AS manifest_evidence, max(evidence_id) FILTER (role = 'rootfs_archive') AS artifact_evidence, max(sha256) FILTER (role = 'rootfs_archive') AS artifact_sha256,
    list_sort(list(evidence_id) FILTER (role <> 'rootfs_archive')) AS build_ids, string_agg('{{"media_type":"' || media_type || '","relative_path":"' || relative_path || '","role":"' || role || '","sha256":"' || sha256 || '","size":' || size || ',"url":"' || url || '"}}', ',' ORDER BY role) AS said FROM img_evidence GROUP BY image),
img_heads AS (SELECT i.*, build_evidence, manifest_evidence, artifact_evidence, artifact_sha256, 'yocto-reference-run-' || sha256('{{"inputs":[' || said || '],"lanes":[' || CASE WHEN build_lane < artifact_lane THEN {_LANES[0]} || ',' || {_LANES[1]} ELSE {_LANES[1]} || ',' || {_LANES[0]} END
    || '],"profile_id":"' || profile_id || '","profile_sha256":"' || profile_sha256 || '"}}') AS run_id FROM img_images i JOIN img_ids USING (image))"""
oracle("image_heads", _IMG, "SELECT * FROM img_heads", _HEADS)
_PAIR = lambda a, b: f"list_sort([{a}, {b}])"
_BODY = lambda **fields: "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in sorted(fields.items())) + " || '}'"
_Q = lambda v: f"coalesce('\"' || {v} || '\"', 'null')"
_NAMED = lambda prefix, **fields: f"'{prefix}-' || sha256({_BODY(**fields)})"
_POP = {"kind": _Q("kind"), "producer": _Q("producer"), "name": _Q("name"), "version": _Q("version"), "architecture": _Q("architecture"), "identifiers": _J("identifiers"), "roles": _J("[kind]"), "discovery_lanes": _J("discovery_lanes"), "evidence_ids": _J("evidence_ids"),
        "producer_evidence_ids": _J("producer_evidence_ids"), "file_paths": _J("file_paths"), "critical_unknown_fields": _J("critical")}
_REL = {"source_population_id": _Q("src"), "relationship": _Q("rel"), "target_population_id": _Q("dst"), "evidence_ids": _J("evidence_ids")}
_SAID = {"details": _J("details"), "evidence_ids": _J("evidence_ids"), "status": _Q("status"), "finding_type": _Q("finding_type")}
_FIND = {"component": _SAID | {"population_id": _Q("population_id"), "candidate_source_id": _Q("source_id")}, "field": _SAID | {"population_id": _Q("population_id"), "field": "'\"producer\"'"}, "file": _SAID | {"path": _Q("path"), "expected_sha256": _Q("e"), "observed_sha256": _Q("o")}}
_NONE = "CAST([] AS VARCHAR[])"
_ROWS = _HEADS + f""", img_by AS (SELECT image, name, count(*) AS n, min(source_id) AS source_id, min(version) AS v, min(producer) AS producer, min(identifiers) AS identifiers FROM img_native GROUP BY ALL),
img_met AS (SELECT m.image, m.name, m.version, m.architecture, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN source_id END AS source_id, CASE WHEN n = 1 THEN v END AS v, CASE WHEN n = 1 THEN producer ELSE 'UNKNOWN' END AS producer, CASE WHEN n = 1 THEN list_filter(identifiers, lambda i: i <> 'UNKNOWN') ELSE {_NONE} END AS said FROM img_manifest m LEFT JOIN img_by USING (image, name)),
img_owned AS (SELECT image, owner AS source_id, list_sort(list(DISTINCT path)) AS file_paths FROM (SELECT image, path, unnest(owners) AS owner FROM img_expected) GROUP BY ALL),
img_packages AS (SELECT m.*, 'RUNTIME_PACKAGE' AS kind, {_NAMED('population', architecture=_Q('architecture'), kind="'\"RUNTIME_PACKAGE\"'", name=_Q('name'))} AS population_id, list_sort(list_distinct(list_concat(['urn:yocto-manifest:' || architecture || ':' || name || ':' || version], said))) AS identifiers, [build_lane] AS discovery_lanes,
    {_PAIR('build_evidence', 'manifest_evidence')} AS evidence_ids, CASE WHEN producer = 'UNKNOWN' THEN {_NONE} ELSE [build_evidence] END AS producer_evidence_ids, coalesce(file_paths, {_NONE}) AS file_paths, CASE WHEN producer = 'UNKNOWN' THEN ['producer'] ELSE {_NONE} END AS critical, build_evidence, artifact_evidence
    FROM img_met m LEFT JOIN img_owned USING (image, source_id) JOIN (SELECT image, build_lane, build_evidence, manifest_evidence, artifact_evidence FROM img_heads) USING (image)),
img_root AS (SELECT image, {_NAMED('population', build_id=_Q('build_id'), kind="'\"REFERENCE_IMAGE_ROOT\"'")} AS population_id, 'REFERENCE_IMAGE_ROOT' AS kind, 'UNKNOWN' AS producer, image_name AS name, upstream_release AS version, architecture, ['urn:yocto-reference:' || build_id] AS identifiers, {_PAIR('build_lane', 'artifact_lane')} AS discovery_lanes,
    {_PAIR('build_evidence', 'artifact_evidence')} AS evidence_ids, {_NONE} AS producer_evidence_ids, {_NONE} AS file_paths, {_NONE} AS critical FROM img_heads),
img_population AS (SELECT image, population_id, kind, producer, name, version, architecture, identifiers, discovery_lanes, evidence_ids, producer_evidence_ids, file_paths, critical FROM img_packages UNION ALL SELECT * FROM img_root),
img_edges AS (SELECT p.image, r.population_id AS src, 'CONTAINS' AS rel, p.population_id AS dst, p.evidence_ids FROM img_packages p JOIN img_root r USING (image)
    UNION ALL SELECT DISTINCT d.image, a.population_id, 'DEPENDS_ON', b.population_id, [a.build_evidence] FROM img_depends d JOIN img_packages a ON a.image = d.image AND a.source_id = d.src JOIN img_packages b ON b.image = d.image AND b.source_id = d.dst),
img_components AS (SELECT image, population_id, source_id, 'COMPONENT_IDENTITY' AS finding_type, CASE n WHEN 0 THEN 'MISSING_FROM_SBOM' WHEN 1 THEN 'MATCHED' ELSE 'UNKNOWN' END AS status, CASE WHEN n = 0 THEN ['installed_package'] WHEN n > 1 THEN ['ambiguous_native_spdx_identity'] WHEN v NOT IN ('UNKNOWN', version) THEN ['MANIFEST_PKGV_AND_NATIVE_SPDX_PV_HAVE_DIFFERENT_VERSION_SEMANTICS'] ELSE {_NONE} END AS details, evidence_ids FROM img_packages
    UNION ALL SELECT n.image, NULL, n.source_id, 'COMPONENT_IDENTITY', 'NOT_IN_RELEASE', [n.name], [build_evidence] FROM img_native n JOIN img_heads USING (image) WHERE NOT EXISTS (SELECT 1 FROM img_manifest m WHERE m.image = n.image AND m.name = n.name)),
img_fields AS (SELECT image, population_id, 'COMPONENT_FIELD' AS finding_type, 'UNKNOWN' AS status, ['NO_PER_COMPONENT_PRODUCER_EVIDENCE'] AS details, evidence_ids FROM img_packages WHERE producer = 'UNKNOWN'),
img_files AS (SELECT image, path, e, o, 'ROOTFS_FILE' AS finding_type, CASE WHEN e IS NULL THEN 'MISSING_FROM_SBOM' WHEN o IS NULL THEN 'NOT_IN_RELEASE' WHEN e = 'UNKNOWN' THEN 'UNKNOWN' WHEN e <> o THEN 'CONFLICT' ELSE 'MATCHED' END AS status,
    CASE WHEN e IS NULL OR o IS NULL THEN ['path'] WHEN e = 'UNKNOWN' THEN ['build_metadata_sha256'] WHEN e <> o THEN ['sha256'] ELSE {_NONE} END AS details, CASE WHEN e IS NULL THEN [artifact_evidence] WHEN o IS NULL THEN [build_evidence] ELSE {_PAIR('build_evidence', 'artifact_evidence')} END AS evidence_ids
    FROM (SELECT coalesce(x.image, y.image) AS image, coalesce(x.path, y.path) AS path, x.sha256 AS e, y.sha256 AS o FROM img_expected x FULL JOIN img_observed y ON x.image = y.image AND x.path = y.path) JOIN img_heads USING (image)),
img_lines AS (SELECT image, 'population' AS kind, population_id AS id, {_BODY(**_POP, population_id=_Q('population_id'))} AS line FROM img_population
    UNION ALL SELECT image, 'relationship', id, {_BODY(**_REL, relationship_id=_Q('id'))} FROM (SELECT *, {_NAMED('relationship', **_REL)} AS id FROM img_edges)
    UNION ALL SELECT image, 'component', id, {_BODY(**_FIND['component'], finding_id=_Q('id'))} FROM (SELECT *, {_NAMED('yocto-finding', **_FIND['component'])} AS id FROM img_components)
    UNION ALL SELECT image, 'field', id, {_BODY(**_FIND['field'], finding_id=_Q('id'))} FROM (SELECT *, {_NAMED('yocto-finding', **_FIND['field'])} AS id FROM img_fields)
    UNION ALL SELECT image, 'file', id, {_BODY(**_FIND['file'], finding_id=_Q('id'))} FROM (SELECT *, {_NAMED('yocto-finding', **_FIND['file'])} AS id FROM img_files))"""
oracle("image_graph_lines", _IMG, "SELECT * FROM img_lines", _ROWS)
_STATUS_NAMES = ("MATCHED", "CONFLICT", "MISSING_FROM_SBOM", "NOT_IN_RELEASE", "UNKNOWN")
_SUMMARY = _ROWS + f""", img_said AS (SELECT image, status, false AS e, false AS o FROM img_components UNION ALL SELECT image, status, false, false FROM img_fields UNION ALL SELECT image, status, e IS NOT NULL, o IS NOT NULL FROM img_files),
img_counts AS (SELECT image, {', '.join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in _STATUS_NAMES)}, count(*) FILTER (e) AS expected_file_count, count(*) FILTER (o) AS observed_file_count FROM img_said GROUP BY image),
img_summary AS (SELECT h.image, run_id, {', '.join(s.lower() for s in _STATUS_NAMES)}, expected_file_count, observed_file_count, coalesce(x.h, sha256('[]')) AS expected_exact_set_sha256, coalesce(y.h, sha256('[]')) AS observed_exact_set_sha256,
    concat_ws(',', {', '.join(f"CASE WHEN {s.lower()} > 0 THEN '{s}' END" for s in _STATUS_NAMES[1:])}) AS blocking_statuses, CASE WHEN {' + '.join(s.lower() for s in _STATUS_NAMES[1:])} > 0 THEN 'OPEN' ELSE 'CLOSED' END AS state,
    CASE WHEN {' + '.join(s.lower() for s in _STATUS_NAMES[1:])} > 0 THEN 'REFERENCE_RECONCILIATION_OPEN' ELSE 'REFERENCE_RECONCILIATION_CLOSED_NOT_GROUND_TRUTH' END AS technical_status FROM img_heads h JOIN img_counts USING (image)
    LEFT JOIN (SELECT image, sha256('[' || string_agg('{{"owner_source_ids":' || {_J('owners')} || ',"path":"' || path || '","sha256":"' || sha256 || '"}}', ',' ORDER BY path) || ']') AS h FROM img_expected GROUP BY image) x USING (image)
    LEFT JOIN (SELECT image, sha256('[' || string_agg('{{"path":"' || path || '","sha256":"' || sha256 || '"}}', ',' ORDER BY path) || ']') AS h FROM img_observed GROUP BY image) y USING (image))"""
oracle("image_summary", _IMG, "SELECT * FROM img_summary", _SUMMARY)
oracle("image_projections", _IMG, """SELECT h.image, 'release' AS kind, profile_id AS subject, concat_ws(' ', image_name, upstream_release, build_id, artifact_sha256, technical_status) AS said FROM img_heads h JOIN img_summary USING (image)
UNION ALL SELECT image, 'component', population_id, name || ' ' || CASE WHEN len(critical) > 0 THEN 'UNKNOWN' ELSE 'MATCHED' END FROM img_population""", _SUMMARY)
oracle("image_graph_differences", _IMG, """SELECT image, kind, id, CASE kind WHEN 'relationship' THEN 'missing' WHEN 'field' THEN 'repeated' ELSE 'changed' END AS problem FROM img_lines
WHERE (kind = 'relationship' AND id LIKE '%0') OR (kind = 'population' AND id LIKE '%1') OR (kind = 'file' AND id LIKE '%2' AND contains(line, '"status":"CONFLICT"')) OR (kind = 'field' AND id LIKE '%4')
UNION ALL SELECT image, kind, unnest([id, 'x-' || id]), unnest(['missing', 'extra']) FROM img_lines WHERE kind = 'component' AND id LIKE '%3'""", _ROWS)
oracle("image_misnamed", _IMG, """SELECT image, kind, CASE kind WHEN 'component' THEN 'x-' || id ELSE id END AS id FROM img_lines WHERE (kind = 'component' AND id LIKE '%3') OR (kind = 'file' AND id LIKE '%2' AND contains(line, '"status":"CONFLICT"'))""", _ROWS)
oracle("image_canonical", _IMG, """SELECT image, sha256(string_agg(h, ',' ORDER BY b)) AS canonical_sha256 FROM (SELECT image, substr(d, 1, 3) AS b, sha256(string_agg(d, ',' ORDER BY d)) AS h FROM (SELECT image, sha256(line) AS d FROM img_lines) GROUP BY ALL) GROUP BY image""", _ROWS)
_IMG_UUID = lambda kind, v: f"(SELECT 'urn:uuid:' || {_UUID('d')} FROM (SELECT sha1({_NAMESPACE} || encode(run_id || ':{kind}:' || {v})) AS d))"
_IMG_EXPORT = _ROWS + f""", img_canon AS (SELECT *, sha256('canonical ' || image) AS canonical_sha256 FROM img_heads), img_refs AS (SELECT p.*, run_id, {_IMG_UUID('component', 'population_id')} AS ref FROM img_population p JOIN img_heads USING (image)),
img_links AS (SELECT e.image, a.ref AS src, rel, b.ref AS dst FROM (SELECT DISTINCT * FROM img_edges) e JOIN img_refs a ON a.image = e.image AND a.population_id = e.src JOIN img_refs b ON b.image = e.image AND b.population_id = e.dst)"""
_IMG_COMPONENT = f"""'{{"bom-ref":"' || ref || '","name":"' || name || '","properties":[' || array_to_string(list_concat(['{{"name":"corroborate:component-kind","value":"' || kind || '"}}', '{{"name":"corroborate:producer-evidence-status","value":"' || CASE WHEN producer = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PER_COMPONENT_EVIDENCED' END || '"}}'],
{_PROPERTY('identifier', 'list_sort(identifiers)')}, {_PROPERTY('evidence-id', 'evidence_ids')}), ',') || ']' || CASE WHEN producer = 'UNKNOWN' THEN '' ELSE ',"publisher":"' || producer || '"' END || coalesce(',"purl":"' || {_PURL_OF} || '"', '') || ',"type":"' || CASE WHEN kind = 'REFERENCE_IMAGE_ROOT' THEN 'operating-system' ELSE 'library' END || '","version":"' || version || '"}}'"""
oracle("image_cyclonedx", _IMG, f"""SELECT image, 'head' AS part, '{{"$schema":"https://cyclonedx.org/schema/bom-1.7.schema.json","bomFormat":"CycloneDX","metadata":{{"authors":[{{"name":"corroborate candidate generator"}}],"component":' || {_IMG_COMPONENT} || ',"properties":[' || concat_ws(',', {_P('build-id', 'build_id')}, {_P('canonical-sha256', 'canonical_sha256')},
{_P('classification', "'PUBLIC_BUILD_REFERENCE_NOT_CUSTOMER_EVIDENCE'")}, {_P('release-artifact-sha256', 'artifact_sha256')}, {_P('run-id', 'run_id')}, {_P('generator-output-status', "'GENERATOR_OUTPUT_CANDIDATE'")}, {_P('product-conformity-status', "'NO_PRODUCT_CONFORMITY_STATUS'")}) || '],"timestamp":"' || release_timestamp || '"}},"serialNumber":"' || {_IMG_UUID('bom', 'profile_id')} || '","specVersion":"1.7","version":1}}' AS line
FROM img_canon JOIN (SELECT image, ref, name, kind, producer, identifiers, evidence_ids, version FROM img_refs WHERE kind = 'REFERENCE_IMAGE_ROOT') USING (image)
UNION ALL SELECT image, 'components', {_IMG_COMPONENT} FROM img_refs WHERE kind <> 'REFERENCE_IMAGE_ROOT'
UNION ALL SELECT r.image, 'dependencies', '{{"dependsOn":' || {_J("coalesce(list_sort(list(DISTINCT dst) FILTER (dst IS NOT NULL)), CAST([] AS VARCHAR[]))")} || ',"ref":"' || ref || '"}}' FROM img_refs r LEFT JOIN img_links ON src = ref GROUP BY r.image, ref
UNION ALL SELECT image, 'properties', '{{"name":"corroborate:relationship","value":"' || src || '|' || rel || '|' || dst || '"}}' FROM img_links""", _IMG_EXPORT)
_S = lambda v, n: f"substr(sha256({v}), 1, {n})"
_OBJECT = lambda **fields: _BODY(**{("@id" if k == "id" else k): (v if v.startswith("'[") or v.startswith("CASE") else _Q(v)) for k, v in fields.items()})
_BOUND = r"""'corroborate:binding={\"build_id\":\"' || build_id || '\",\"canonical_sha256\":\"' || canonical_sha256 || '\",\"classification\":\"PUBLIC_BUILD_REFERENCE_NOT_CUSTOMER_EVIDENCE\",\"release_artifact_sha256\":\"' || artifact_sha256 || '\",\"run_id\":\"' || run_id || '\"}'"""
_CORE = "'[\"core\",\"software\"]'"
_PKG = lambda v: f"base || '/package/' || {_S(v, 32)}"
_TOP = [
    _OBJECT(id="c", created="release_timestamp", createdBy="""'["' || base || '/organization/candidate-generator"]'""", createdUsing="""'["' || base || '/tool/corroborate"]'""", specVersion="'3.0.1'", type="'CreationInfo'"),
    _OBJECT(comment="'GENERATOR_ONLY_NOT_MANUFACTURER'", creationInfo="c", name="'corroborate candidate generator'", spdxId="base || '/organization/candidate-generator'", type="'Organization'"),
    _OBJECT(creationInfo="c", name="'corroborate'", spdxId="base || '/tool/corroborate'", type="'Tool'"),
    _OBJECT(comment=_BOUND, creationInfo="c", name="build_id || ' SPDX candidate document'", profileConformance=_CORE, rootElement="""'["' || base || '/sbom/reference"]'""", spdxId="base || '/document/reference'", summary="'GENERATOR_OUTPUT_CANDIDATE; NO_PRODUCT_CONFORMITY_STATUS; public reference is not ground truth.'", type="'SpdxDocument'"),
    _OBJECT(comment=_BOUND, creationInfo="c", name="build_id || ' generator output candidate'", profileConformance=_CORE, rootElement=f"""'["' || {_PKG('root')} || '"]'""", software_sbomType="'[\"build\"]'", spdxId="base || '/sbom/reference'", type="'software_Sbom'"),
]
_IMG_SPDX = _IMG_EXPORT + f""", img_based AS (SELECT h.*, 'https://example.invalid/corroborate/image/' || {_S('run_id', 24)} AS base, '_:creation-' || {_S('run_id', 20)} AS c, r.population_id AS root FROM img_canon h JOIN img_root r USING (image)),
img_told AS (SELECT p.*, base, c FROM img_population p JOIN (SELECT image, base, c FROM img_based) USING (image))"""
oracle("image_spdx", _IMG, f"""SELECT image, 'head' AS part, unnest([{', '.join(_TOP)}]) AS line FROM img_based
UNION ALL SELECT image, 'agents', {_OBJECT(creationInfo='c', name='producer', spdxId="base || '/organization/' || " + _S('producer', 32), type="'Organization'")} FROM (SELECT DISTINCT image, base, c, producer FROM img_told WHERE producer <> 'UNKNOWN')
UNION ALL SELECT image, 'packages', '{{"comment":"GENERATOR_OUTPUT_CANDIDATE;NO_PRODUCT_CONFORMITY_STATUS;producer=' || producer || ';evidence_ids=' || array_to_string(evidence_ids, ',') || '","creationInfo":"' || c || '","externalIdentifier":[' || array_to_string(list_transform(identifiers, lambda i: '{{"externalIdentifierType":"' || CASE WHEN starts_with(i, 'pkg:') THEN 'packageUrl' ELSE 'other' END || '","identifier":"' || i || '","type":"ExternalIdentifier"}}'), ',')
|| '],"name":"' || name || '"' || coalesce(',"software_packageUrl":"' || {_PURL_OF} || '"', '') || ',"software_packageVersion":"' || version || '","software_primaryPurpose":"' || CASE WHEN kind = 'REFERENCE_IMAGE_ROOT' THEN 'application' ELSE 'library' END || '","spdxId":"' || {_PKG('population_id')} || '"' || CASE WHEN producer = 'UNKNOWN' THEN '' ELSE ',"suppliedBy":"' || base || '/organization/' || {_S('producer', 32)} || '"' END || ',"type":"software_Package"}}' FROM img_told
UNION ALL SELECT image, 'relationships', {_OBJECT(comment="'evidence_ids=' || array_to_string(evidence_ids, ',')", creationInfo='c', **{'from': _PKG('src')}, relationshipType="(CASE rel WHEN 'CONTAINS' THEN 'contains' ELSE 'dependsOn' END)", spdxId="base || '/relationship/' || " + _S('id', 32), to=f"""'["' || {_PKG('dst')} || '"]'""", type="'Relationship'")}
FROM (SELECT e.*, base, c, {_NAMED('relationship', **_REL)} AS id FROM img_edges e JOIN img_based USING (image))""", _IMG_SPDX)

oracle("spdx_lines", "rel_claims", f"""SELECT '{{"comment":"evidence_ids=","creationInfo":"_:creation-' || substr(sha256('run-1'), 1, 20) || '","from":"' || {_ID("'run-1'", 'package', 'src')} || '","relationshipType":"' || CASE rel WHEN 'CONTAINS' THEN 'contains' WHEN 'DEPENDS_ON' THEN 'dependsOn' ELSE 'hasDynamicLink' END || '","spdxId":"' || {_ID("'run-1'", 'relationship', 'rid')}
|| '","to":["' || {_ID("'run-1'", 'package', 'dst')} || '"],"type":"Relationship"}}' AS line FROM (SELECT DISTINCT src, rel, dst, 'relationship-' || sha256('{{"relationship":"' || rel || '","source_population_id":"' || src || '","target_population_id":"' || dst || '"}}') AS rid FROM rel_claims WHERE rel <> 'UNKNOWN')""")
_EXPORTED = _POPULATION + _EDGES + ", kept_edges AS (SELECT s, rel, d FROM projected WHERE rel <> 'UNKNOWN')"
oracle("export_resolves", "records lane_edges lanes one_release", """SELECT 'head' AS part, 4 AS n UNION ALL SELECT 'agents', count(DISTINCT producer) + 1 FROM population UNION ALL SELECT 'packages', count(*) FROM population UNION ALL SELECT 'relationships', count(*) FROM kept_edges
UNION ALL SELECT 'membership', 2 * ((SELECT count(*) FROM population) + (SELECT count(*) FROM kept_edges)) + 1 UNION ALL SELECT 'unresolved', 0""", _EXPORTED)
oracle("cyclonedx_document", "records lane_edges lanes one_release", """SELECT 'head' AS part, 1 AS n, product || ' application' AS root FROM one_release UNION ALL SELECT 'components', count(*) - 1, '' FROM population UNION ALL SELECT 'dependencies', count(*), '' FROM population UNION ALL SELECT 'properties', count(*), '' FROM kept_edges UNION ALL SELECT 'errors', 0, ''""", _EXPORTED)
_WITH = lambda suffix: re.sub(r"\b(pairs|nodes|near|both_ways|reach|roots|own|grouped|population|records|member|edge|projected|lane_edges)\b(?!-)", rf"\1_{suffix}", _POPULATION + _EDGES)
_KEYED = lambda suffix: f"keyed_{suffix} AS (SELECT *, list_sort(list_distinct(list_transform(string_split(members, ','), lambda m: split_part(m, '/', 2)))) AS key FROM population_{suffix})"
_LINKED = lambda suffix: f"linked_{suffix} AS (SELECT DISTINCT array_to_string(a.key, ',') || '|' || rel || '|' || array_to_string(b.key, ',') AS subject FROM projected_{suffix} JOIN keyed_{suffix} a ON a.population_id = s JOIN keyed_{suffix} b ON b.population_id = d)"
_FIELD_JSON = {"producer": _Q, "name": _Q, "version": _Q, "identifiers": _J, "hashes": _J}
_SHOWN = lambda side, when: "'{' || concat_ws(',', " + ", ".join(f"""CASE WHEN {when(f)} THEN '"{f}":' || {j(f"{side}.{f}")} END""" for f, j in _FIELD_JSON.items()) + ") || '}'"
_CHANGED = {f: f"(a.{f} IS DISTINCT FROM b.{f})" for f in _FIELD_JSON}
_BESIDE = lambda f: "true" if f != "hashes" else "false"
oracle("release_graph_diff", "records_a records_b lane_edges_a lane_edges_b lanes", f"""SELECT 'component' AS kind, array_to_string(coalesce(a.key, b.key), ',') AS subject, CASE WHEN a.key IS NULL THEN 'ADDED' WHEN b.key IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change,
CASE WHEN a.key IS NULL OR b.key IS NULL THEN '' ELSE concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _CHANGED.items())}) END AS changed_fields,
CASE WHEN a.key IS NULL THEN NULL WHEN b.key IS NULL THEN {_SHOWN('a', _BESIDE)} ELSE {_SHOWN('a', _CHANGED.get)} END AS previous, CASE WHEN b.key IS NULL THEN NULL WHEN a.key IS NULL THEN {_SHOWN('b', _BESIDE)} ELSE {_SHOWN('b', _CHANGED.get)} END AS current
FROM keyed_a a FULL JOIN keyed_b b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR {' OR '.join(_CHANGED.values())}
UNION ALL SELECT 'relationship', coalesce(x.subject, y.subject), CASE WHEN x.subject IS NULL THEN 'ADDED' ELSE 'REMOVED' END, '', NULL, NULL FROM linked_a x FULL JOIN linked_b y ON x.subject = y.subject WHERE x.subject IS NULL OR y.subject IS NULL""",
    _WITH("a") + _WITH("b") + ", " + ", ".join([_KEYED("a"), _KEYED("b"), _LINKED("a"), _LINKED("b")]))

_BODY_OF = lambda serial, run: f"""'{{"a":{{"k":null' || {run} || '}},"b":[{{"x":"' || p_name || '","y":1}},2.5]' || {serial} || '}}'"""
_RUN = """',"run_id":"' || CASE WHEN p_partkey % 2 = 0 THEN 'r' ELSE 'q' END || '"'"""
_SERIAL = r"""',"serial_number":' || CASE WHEN p_partkey % 2 = 0 THEN '"urn:' || p_partkey || ' \"run_id\":"' ELSE '7' END"""
_IF_WHOLE = lambda v: f"CASE WHEN p_partkey % 2 = 1 AND p_partkey % 7 = 0 THEN NULL ELSE sha256({v}) END"
oracle("semantic_hash", "json_bodies", f"""SELECT p_partkey AS doc, {_IF_WHOLE(_BODY_OF(_SERIAL, _RUN))} AS canonical, {_IF_WHOLE(_BODY_OF("',\"serial_number\":null'", _RUN))} AS semantic, {_IF_WHOLE(_BODY_OF("''", "''"))} AS stable, {_IF_WHOLE(_BODY_OF("''", _RUN))} AS body FROM part""")
oracle("candidate_round_trip", "candidate_lists", "SELECT p_partkey AS doc, ['', '0:identifiers', '0:keys', '0:source_available', '0:roles', '0:observed_hashes', 'order', '0:keys', 'list'][CAST(p_partkey % 9 AS INT) + 1] AS errors FROM part")
_TREE = lambda name, view, line: f"""{name} AS (SELECT profile_id, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY b)) AS root FROM (SELECT profile_id, substr(d, 1, 3) AS b, count(*) AS n, sha256(string_agg(d, ',' ORDER BY d)) AS h FROM (SELECT profile_id, sha256({line}) AS d FROM {view}) GROUP BY ALL) GROUP BY profile_id)"""
_CO = lambda serial: f"""'{{"bom_ref":"o' || o_orderkey || '","name":"' || o_orderpriority || '","serial_number":' || {serial} || '}}'"""
_OBS_LINES = "(SELECT *, 'prof-' || o_custkey AS profile_id FROM orders)"
_DEP = """'{"depends_on":[],"ref":"o' || o_orderkey || '"}'"""
_OBS = ", " + ", ".join([
    _TREE("co_whole", _OBS_LINES, _CO("'\"s' || o_orderkey || '\"'")), _TREE("co_stable", _OBS_LINES, _CO("'null'")), _TREE("de_whole", _OBS_LINES + " WHERE o_orderkey % 3 = 0", _DEP),
    """obs_rows AS (SELECT p.*, h.source_sha256, h.raw_size, h.file_count, coalesce(a.n, 0) AS components, coalesce(a.root, sha256('')) AS co, coalesce(b.root, sha256('')) AS co_s, coalesce(d.n, 0) AS dependencies, coalesce(d.root, sha256('')) AS de,
    '{"root":{"name":"' || product_name || '","version":"1.0"},"serial_number":"urn:' || substr(profile_id, 6) || '","spec":"1.7"}' AS head, '{"root":{"name":"' || product_name || '","version":"1.0"},"serial_number":null,"spec":"1.7"}' AS head_s
    FROM obs_profiles p JOIN obs_heads h USING (profile_id) LEFT JOIN co_whole a USING (profile_id) LEFT JOIN co_stable b USING (profile_id) LEFT JOIN de_whole d USING (profile_id))""",
    """obs_semantic AS (SELECT *, sha256('{"components":"' || co_s || '","dependencies":"' || de || '","head":"' || replace(head_s, '"', '\\"') || '"}') AS semantic_sha256 FROM obs_rows)""".replace("\\\\", "\\"),
])
_ENVELOPE = lambda evidence: f"""'{{"blindspots":' || {_J('list_sort(blindspots)')} || ',"classification":"SELF_TEST_NOT_CUSTOMER_EVIDENCE","cyclonedx_evidence":' || {evidence} || ',"generator_output_status":"GENERATOR_OUTPUT_CANDIDATE","independence_domain":"' || independence_domain || '","input_identity":{{"file_count":' || file_count || ',"root_id":"root","sha256":"' || repeat('b', 64) || '","total_bytes":10}},"manufacturer_approval_status":"NOT_PROVIDED","milestone_scope":"M3A_NOT_YOCTO_M3B","product_conformity_status":"NO_PRODUCT_CONFORMITY_STATUS",'
|| '"profile_id":"' || profile_id || '","profile_kind":"' || profile_kind || '","release_status":"NOT_RELEASED","scan_contract":{{"target_kind":"' || target_kind || '","target_label":"' || target_label || '"}},"scanner_identity":{{"binary_sha256":"' || repeat('c', 64) || '","config_sha256":"' || repeat('d', 64) || '","name":"syft","version":"' || scanner_version || '"}},"schema_version":"1.0","subject":{{"comparison_namespace":"space","declared_version":"1.0","product_name":"' || product_name || '"}}}}'"""  # noqa: E731
_EVIDENCE_ALL = r"""'{"component_count":' || components || ',"components_sha256":"' || co || '","dependencies_sha256":"' || de || '","dependency_rows":' || dependencies || ',"head":"' || replace(head, '"', '\"') || '","semantic_sha256":"' || semantic_sha256 || '","source_sha256":"' || source_sha256 || '"}'"""
_EVIDENCE_RUN = """'{"component_count":' || components || ',"dependency_rows":' || dependencies || ',"semantic_sha256":"' || semantic_sha256 || '"}'"""
oracle("observations_sealed", "obs_profiles obs_heads", f"SELECT profile_id, sha256({_ENVELOPE(_EVIDENCE_ALL)}) AS canonical_sha256, 'selftest-run-' || sha256({_ENVELOPE(_EVIDENCE_RUN)}) AS run_id, semantic_sha256 FROM obs_semantic", _OBS)
_KEY = "CAST(substr(profile_id, 6) AS INT)"
_PROFILE_RULES = {"independence_domain": f"{_KEY} % 11 = 0", "target_kind": f"{_KEY} % 13 = 0", "blindspots": f"{_KEY} % 17 = 0", "target_label": f"{_KEY} % 19 = 0", "scanner": f"{_KEY} % 23 = 0"}
oracle("scan_profile_rules", "obs_profiles", _V("obs_profiles", "profile_id", _PROFILE_RULES))
oracle("observation_envelope_rules", "obs_profiles obs_heads", _V("obs_profiles", "profile_id", _PROFILE_RULES | {"input_identity": f"{_KEY} % 7 = 0", "release_status": f"{_KEY} % 10 = 5", "canonical_sha256": f"{_KEY} % 10 = 5", "run_id": f"{_KEY} % 10 = 5"}))
oracle("scan_validation", "obs_profiles obs_heads", "SELECT profile_id, profile_kind, source_sha256 AS raw_sha256, raw_size, components + 1 AS component_count, dependencies AS dependency_row_count, 'MECHANICALLY_VALID' AS status FROM obs_semantic", _OBS)

_FILE = "CAST(regexp_extract(path, '([0-9]+)', 1) AS INT)"
oracle("registry_load", "reg_files", f"""SELECT path, kind, problem, problem IS NULL AS admitted FROM (SELECT path, CASE WHEN {_FILE} % 11 = 6 THEN NULL ELSE kind END AS kind, CASE {_FILE} % 11 WHEN 1 THEN 'sha256' WHEN 2 THEN 'kind' WHEN 3 THEN 'kind' WHEN 4 THEN 'keys' WHEN 5 THEN 'json' WHEN 6 THEN 'unpinned' WHEN 7 THEN 'missing' WHEN 8 THEN 'size'
WHEN 0 THEN CASE WHEN {_FILE} % 2 = 0 THEN 'schema_version' END END AS problem FROM reg_files)""")
_SOURCE_RULES = {1: ["texts"], 2: ["source_type"], 3: ["upstream_url"], 4: ["floating"], 5: ["archive_sha256"], 6: ["evidence_paths"], 7: ["evidence_cover"], 8: ["scopes"], 9: ["quarantine"], 10: ["purposes"], 11: ["split"], 12: ["use_needs_rights", "use_needs_admission", "phase_one"],
                 13: ["phase_one"], 14: ["release"], 15: ["rights_decision_ref"], 16: ["triggers"], 17: ["submodules"], 18: ["execute_code"], 19: ["limits"]}
oracle("registry_entries", "reg_files reg_sources", f"""SELECT path || '#rt1' AS subject, unnest(list_filter([CASE WHEN k % 4 = 0 THEN 'category' END, CASE WHEN k % 3 = 0 THEN 'frozen' END, CASE WHEN k % 7 = 0 THEN 'repeated' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT path, {_FILE} AS k FROM reg_files) WHERE k % 11 IN (1, 6, 7) OR (k % 11 = 0 AND k % 2 = 1)
UNION ALL SELECT path || '#is' || k, 'identity_kind' FROM (SELECT path, {_FILE} AS k FROM reg_files) WHERE k % 11 = 9 AND k % 2 = 0
UNION ALL SELECT path || '#ds-' || k, unnest(CASE k % 20 {' '.join(f"WHEN {n} THEN {rules!r}" for n, rules in _SOURCE_RULES.items())} ELSE CAST([] AS VARCHAR[]) END) FROM (SELECT path, {_FILE} AS k FROM reg_sources)""")
oracle("registry_entry_hashes", "reg_files", f"""SELECT path, 0 AS position, sha256('{{"profile_id":"p' || {_FILE} || '"}}') AS entry_sha256 FROM reg_files WHERE {_FILE} % 11 = 10""")
_IP = "CAST(substr(profile_id, 4) AS INT) % 16"
oracle("image_profile_rules", "image_profiles", _V("image_profiles", "profile_id", {"classification": f"{_IP} = 1", "release_notes_url": f"{_IP} = 2", "revisions": f"{_IP} = 3", "image_name": f"{_IP} = 4", "build_timestamp": f"{_IP} = 5", "same_build": f"{_IP} IN (5, 6)", "lanes": f"{_IP} = 7", "build_lane": f"{_IP} = 8", "included": f"{_IP} = 9",
    "declared_exclusions": f"{_IP} = 10", "limits": f"{_IP} = 11", "payload_suffix": f"{_IP} = 12", "payload_roles": f"{_IP} = 12", "payload_name": f"{_IP} = 13", "payload_sha256": f"{_IP} = 14", "payload_bytes": f"{_IP} = 15"}))
oracle("issuer_lookups", "vex_signatures issuers", """SELECT vex_document_sha256, issuer_id, CASE WHEN n IS NULL THEN 'unknown' WHEN issuer_id LIKE '%3' THEN 'repeated' WHEN s <> 'ADMITTED_FOR_VEX_INTAKE' THEN 'not admitted' END AS problem
FROM (SELECT vex_document_sha256, 'is' || regexp_extract(vex_document_sha256, '^0*([0-9]+)$', 1) AS issuer_id FROM vex_signatures) LEFT JOIN (SELECT issuer_id, count(*) AS n, min(status) AS s FROM issuers GROUP BY 1) USING (issuer_id)""")
oracle("conflict_lookups", "arm_cards card_claims", """SELECT arm_id, conflict_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'repeated' END AS problem FROM arm_cards LEFT JOIN (SELECT conflict_id, count(*) AS n FROM card_claims WHERE claim_id = 'cl100' OR conflict_id % 5 = 0 GROUP BY 1) USING (conflict_id)""")
oracle("profile_lookups", "handoff_sources obs_profiles", """SELECT source_run_id, profile_id, CASE WHEN k % 11 = 0 THEN 'unknown' WHEN k % 10 = 7 THEN 'repeated' END AS problem FROM (SELECT source_run_id, replace(source_run_id, 'run-', 'prof-') AS profile_id, CAST(substr(source_run_id, 5) AS INT) AS k FROM handoff_sources)""")

oracle("finding_provenance", _IMG, """SELECT image, role, relative_path, sha256, size, count(*) AS findings FROM (SELECT image, unnest(evidence_ids) AS evidence_id FROM (SELECT image, evidence_ids FROM img_components UNION ALL SELECT image, evidence_ids FROM img_fields UNION ALL SELECT image, evidence_ids FROM img_files)) JOIN img_evidence USING (image, evidence_id) GROUP BY ALL""", _ROWS)
_RELEASE = ", ".join(f"""'"{c}":"' || {c} || '"'""" for c in sorted("run_id classification canonical_sha256 build_id artifact_sha256 release_timestamp sbom_author release_id product product_version".split()))
oracle("input_records", "export_release", f"""SELECT release_id, '{{"build_id":"' || build_id || '","classification":"' || classification || '","release_artifact_sha256":"' || artifact_sha256 || '","release_id":"' || release_id || '","release_record":{{' || concat_ws(',', {_RELEASE}) || '}},"schema_version":"1.0"}}' AS line FROM export_release""")
oracle("tool_records", "lane_edges", """SELECT run_id, '{"classification":"c","config":null,"lane_identities":[' || string_agg('{"adapter_id":"adapter-' || lane_id || '","adapter_version":"1.0","independence_domain":"' || upper(lane_id) || '","lane_id":"' || lane_id || '"}', ',' ORDER BY lane_id) || '],"model_card":null,"schema_version":"1.0"}' AS line FROM (SELECT DISTINCT lane_id, 'run-' || substr(src, 2, 2) AS run_id FROM lane_edges) GROUP BY run_id""")
oracle("evaluation_differences", "card_claims", """SELECT 'model:m' AS arm_id, conflict_id, unnest(CASE conflict_id % 8 WHEN 1 THEN ['response_sha256', 'rederived'] WHEN 2 THEN ['advice_sha256', 'rederived'] WHEN 3 THEN ['rederived'] WHEN 4 THEN ['validates'] WHEN 5 THEN ['base64', 'rederived'] WHEN 6 THEN CASE WHEN conflict_id % 16 = 6 THEN CAST([] AS VARCHAR[]) ELSE ['transport'] END ELSE CAST([] AS VARCHAR[]) END) AS rule
FROM (SELECT DISTINCT conflict_id FROM card_claims) WHERE conflict_id % 40 <> 32 UNION ALL SELECT DISTINCT 'model:m', conflict_id, 'omitted' FROM card_claims WHERE conflict_id % 40 = 32 UNION ALL SELECT 'model:m', NULL, unnest(['results', 'valid', 'rate']) UNION ALL SELECT NULL, NULL, 'safety_gate'""")
