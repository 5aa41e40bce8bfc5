"""The driver's tables dressed as evidence: one text per view, for Spark and for DuckDB.

ARR(...) is an array of strings and NONE the empty one; all else is SQL that both read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PURL = "'pkg:generic/p' || CAST(p_partkey AS STRING) || '@' || CAST(p_size AS STRING)"

VIEWS = {
    "lane_build": f"""
        SELECT 'build' AS lane_id, 'b' || CAST(p_partkey AS STRING) AS component_id, CASE WHEN p_partkey % 37 = 0 THEN 'UNKNOWN' ELSE p_brand END AS producer,
               p_name AS name, CAST(p_size AS STRING) AS version,
               CASE WHEN p_partkey % 11 = 0 THEN NONE ELSE ARR({_PURL}) END AS identifiers,
               ARR('SHA-256:h' || CAST(p_partkey AS STRING)) AS hashes,
               CASE WHEN p_partkey % 4 = 0 THEN NONE ELSE ARR('source:' || p_brand) END AS provenances, ARR('LIBRARY') AS roles,
               CASE p_partkey % 8 WHEN 0 THEN ARR('SHA-256:v' || CAST(p_partkey AS STRING)) WHEN 1 THEN ARR('UNKNOWN:v') WHEN 2 THEN ARR('SHA-256:UNKNOWN') WHEN 3 THEN ARR('UNKNOWN:UNKNOWN') ELSE NONE END AS supplier_hashes
        FROM part""",
    "lane_artifact": f"""
        SELECT 'artifact' AS lane_id, 'a' || CAST(p_partkey AS STRING) AS component_id, p_brand AS producer, p_name AS name,
               CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS STRING) AS version,
               CASE WHEN p_partkey % 11 = 0 THEN NONE WHEN p_partkey % 5 = 0 THEN ARR({_PURL}, 'pkg:generic/alias' || CAST(p_partkey AS STRING)) ELSE ARR({_PURL}) END AS identifiers,
               CASE WHEN p_partkey % 19 = 0 THEN NONE WHEN p_partkey % 17 = 0 THEN ARR('SHA-256:x' || CAST(p_partkey AS STRING)) ELSE ARR('SHA-256:h' || CAST(p_partkey AS STRING)) END AS hashes,
               CASE WHEN p_partkey % 6 = 0 THEN ARR('source:other') ELSE ARR('source:' || p_brand) END AS provenances,
               CASE WHEN p_partkey % 41 = 0 THEN ARR('FIRMWARE') ELSE ARR('LIBRARY') END AS roles,
               CASE WHEN p_partkey % 48 = 0 THEN ARR('SHA-256:other') WHEN p_partkey % 8 = 0 THEN ARR('SHA-256:v' || CAST(p_partkey AS STRING)) ELSE NONE END AS supplier_hashes
        FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""",
    "records": "SELECT * FROM lane_build UNION ALL SELECT * FROM lane_artifact",
    "candidate": f"""
        SELECT 'c' || CAST(p_partkey AS STRING) AS candidate_id, p_brand AS producer, p_name AS name,
               CAST(CASE WHEN p_partkey % 23 = 0 THEN p_size + 5 ELSE p_size END AS STRING) AS version,
               CASE WHEN p_partkey % 3 = 0 THEN NONE ELSE ARR({_PURL}) END AS identifiers,
               CASE WHEN p_partkey % 2 = 0 THEN ARR('SHA-256:h' || CAST(p_partkey AS STRING)) ELSE NONE END AS hashes, NONE AS provenances,
               CASE WHEN p_partkey % 29 = 0 THEN ARR('FIRMWARE') ELSE NONE END AS roles,
               CASE WHEN p_partkey % 40 = 8 THEN ARR('SHA-256:w') WHEN p_partkey % 8 = 0 OR p_partkey % 10 = 7 THEN ARR('SHA-256:v' || CAST(p_partkey AS STRING)) ELSE NONE END AS supplier_hashes
        FROM part WHERE p_partkey % 13 <> 0
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 5 = 0 THEN 'UNKNOWN' ELSE 'Nation' END, n_name, '1', ARR('pkg:generic/nation' || CAST(n_nationkey AS STRING)), NONE, NONE, NONE, NONE FROM nation""",
    "lanes": "SELECT 'build' AS lane_id, 'evidence-1' AS evidence_id UNION ALL SELECT 'artifact', 'evidence-2'",
    "lane_edges": """
        SELECT 'build' AS lane_id, 'b' || CAST(p_partkey AS STRING) AS src, CASE p_partkey % 7 WHEN 0 THEN 'CONTAINS' WHEN 1 THEN 'UNKNOWN' ELSE 'DEPENDS_ON' END AS rel, 'b' || CAST(p_partkey - 1 AS STRING) AS dst FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'artifact', 'a' || CAST(l_partkey AS STRING), CASE WHEN l_partkey % 5 = 0 THEN 'DYNAMICALLY_LINKS' ELSE 'DEPENDS_ON' END, 'a' || CAST(l_partkey - 1 AS STRING) FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey - 1 IN (SELECT l_partkey FROM lineitem)""",
    "records_a": "SELECT * FROM records WHERE CAST(substr(component_id, 2) AS INT) % 25 <> 8",
    "records_b": """
        SELECT lane_id, component_id, producer, name, CASE WHEN CAST(substr(component_id, 2) AS INT) % 9 = 0 THEN version || 'x' ELSE version END AS version, identifiers, CASE WHEN CAST(substr(component_id, 2) AS INT) % 15 = 4 THEN NONE ELSE hashes END AS hashes, provenances, roles, supplier_hashes
        FROM records WHERE CAST(substr(component_id, 2) AS INT) % 14 <> 3""",
    "lane_edges_a": "SELECT * FROM lane_edges WHERE src IN (SELECT component_id FROM records_a) AND dst IN (SELECT component_id FROM records_a)",
    "lane_edges_b": "SELECT lane_id, src, CASE WHEN src LIKE '%5' THEN 'GENERATED_FROM' ELSE rel END AS rel, dst FROM lane_edges WHERE src IN (SELECT component_id FROM records_b) AND dst IN (SELECT component_id FROM records_b)",
    "one_release": """
        SELECT 'run-1' AS run_id, 'SYNTHETIC_NOT_EVIDENCE' AS classification, repeat('c', 64) AS canonical_sha256, 'build-1' AS build_id, repeat('a', 64) AS artifact_sha256, '2026-01-05T00:00:00Z' AS release_timestamp, 'author' AS sbom_author, 'rel-1' AS release_id,
               p_brand AS manufacturer, p_name AS product, CAST(p_size AS STRING) AS product_version FROM part WHERE p_partkey = 1""",
    "candidate_edges": """
        SELECT 'c' || CAST(p_partkey AS STRING) AS src, CASE WHEN p_partkey % 11 = 0 THEN 'CONTAINS' ELSE 'DEPENDS_ON' END AS rel, 'c' || CAST(p_partkey - 1 AS STRING) AS dst FROM part WHERE p_partkey > 0 AND p_partkey % 4 <> 0
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'DEPENDS_ON', 'c1' FROM nation""",
    "rel_claims": """
        SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'build' ELSE 'artifact' END AS lane_id, 'p' || CAST(l_partkey AS STRING) AS src,
               CASE WHEN l_orderkey % 50 = 4 THEN 'UNKNOWN' WHEN l_orderkey % 5 = 0 THEN 'CONTAINS' WHEN l_orderkey % 5 = 1 THEN 'DYNAMICALLY_LINKS' ELSE 'DEPENDS_ON' END AS rel,
               's' || CAST(l_suppkey AS STRING) AS dst
        FROM lineitem""",
    "rel_declared": """
        SELECT DISTINCT 'cp' || CAST(l_partkey AS STRING) AS src, CASE WHEN l_partkey % 9 = 0 THEN 'CONTAINS' ELSE 'DEPENDS_ON' END AS rel, 'cs' || CAST(l_suppkey AS STRING) AS dst
        FROM lineitem WHERE (l_partkey + l_suppkey) % 7 <> 0""",
    "rel_mapping": """
        SELECT 'cp' || CAST(p_partkey AS STRING) AS candidate_id, 'p' || CAST(p_partkey AS STRING) AS population_id FROM part WHERE p_partkey % 10 <> 3
        UNION ALL SELECT 'cs' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey AS STRING) FROM supplier""",
    "release_a": "SELECT o_orderkey AS item, CAST(o_custkey AS STRING) AS version, o_orderpriority AS producer, o_orderstatus AS name FROM orders WHERE o_orderkey % 10 <> 0",
    "release_b": "SELECT o_orderkey AS item, CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS version, CASE WHEN o_orderkey % 12 = 0 THEN 'none' ELSE o_orderpriority END AS producer, o_orderstatus AS name FROM orders WHERE o_orderkey % 10 <> 1",
    "hits": """
        SELECT 'h' || CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 40 END AS STRING) AS handoff_id, lpad(CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 40 END AS STRING), 64, 'a') AS cyclonedx_sha256,
               l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS position,
               CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS hit_id, 'V-' || CAST(l_suppkey % 50 AS STRING) AS vulnerability_id,
               'pkg:generic/p' || CAST(l_partkey AS STRING) || '?arch=' || CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END || '&package-id=' || CAST(l_linenumber AS STRING) AS purl, 'affected' AS original_status,
               lpad(CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 WHEN l_suppkey % 40 = 7 THEN 999999 ELSE l_suppkey % 40 END AS STRING), 64, '0') AS vex_document_sha256
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""",
    "vex": """
        SELECT lpad(CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 ELSE s_suppkey END AS STRING), 64, '0') AS vex_document_sha256, s_suppkey * 1000000000 + p_partkey AS position, 'issuer' AS issuer_id,
               'st' || CAST(s_suppkey AS STRING) || '-' || CAST(p_partkey AS STRING) AS statement_id, 'V-' || CAST(s_suppkey % 50 AS STRING) AS vulnerability_id,
               CASE WHEN s_suppkey % 2 = 0 THEN 'openvex' ELSE 'cyclonedx-bom' END AS vex_format,
               CASE (s_suppkey + p_partkey) % 7 WHEN 0 THEN 'affected' WHEN 1 THEN 'fixed' WHEN 2 THEN 'odd' ELSE 'not_affected' END AS status,
               CASE p_partkey % 4 WHEN 0 THEN 'code_not_present' WHEN 1 THEN 'vulnerable_code_not_present' WHEN 2 THEN 'inline_mitigations_already_exist' END AS justification,
               CASE WHEN p_partkey % 5 = 0 THEN 'detail ' || CAST(p_partkey AS STRING) END AS detail, CAST(NULL AS STRING) AS first_issued_utc, CASE WHEN p_partkey % 6 = 0 THEN '2026-01-01T00:00:00Z' END AS last_updated_utc,
               CASE WHEN p_partkey % 31 = 0 THEN NONE WHEN p_partkey % 13 = 0 THEN ARR('urn:p' || CAST(p_partkey AS STRING)) WHEN p_partkey % 17 = 0 THEN ARR('pkg:nothing')
                    ELSE ARR('pkg:generic/p' || CAST(p_partkey AS STRING) || '?arch=a&package-id=0', 'pkg:generic/p' || CAST(p_partkey AS STRING) || '?package-id=9&arch=b', 'pkg:generic/p' || CAST(p_partkey AS STRING) || '?arch=a') END AS purls
        FROM (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem)""",
    "vex_signatures": """
        SELECT DISTINCT vex_document_sha256, lpad('5', 64, '5') AS signature_sha256, CASE WHEN vex_document_sha256 LIKE '%7' THEN 'short' ELSE lpad('6', 64, '6') END AS binary_sha256 FROM vex""",
    "profiles": """
        SELECT 'SOURCE' AS profile_kind, CASE WHEN p_partkey % 21 = 0 THEN NULL ELSE 'purl:pkg:generic/p' || CAST(p_partkey AS STRING) END AS logical_key, CAST(p_size AS STRING) AS version FROM part
        UNION ALL SELECT 'OCI', 'purl:pkg:generic/p' || CAST(p_partkey AS STRING), CAST(CASE WHEN p_partkey % 8 = 0 THEN p_size + 1 ELSE p_size END AS STRING) FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT 'PORTABLE_RUNTIME', CASE WHEN p_partkey % 33 = 0 THEN NULL ELSE 'purl:pkg:generic/p' || CAST(p_partkey AS STRING) END, CASE WHEN p_partkey % 15 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN CAST(p_size + 2 AS STRING) ELSE CAST(p_size AS STRING) END FROM part WHERE p_partkey % 3 = 0""",
    "observations": """
        SELECT 'p-src' AS profile_id, 'SOURCE_DIRECTORY' AS profile_kind, 'run-1' AS run_id, 's' || CAST(p_partkey AS STRING) AS bom_ref, p_name AS name, CAST(p_size AS STRING) AS version, CAST(NULL AS STRING) AS cpe, NONE AS hashes,
               CASE WHEN p_partkey % 21 <> 0 THEN 'pkg:generic/p' || CAST(p_partkey AS STRING) || '@1' END AS purl, CASE WHEN p_partkey % 21 <> 0 THEN 'purl:pkg:generic/p' || CAST(p_partkey AS STRING) END AS logical_key FROM part
        UNION ALL SELECT 'p-oci', 'OCI_ARCHIVE', 'run-2', 'o' || CAST(p_partkey AS STRING), p_name, CAST(CASE WHEN p_partkey % 8 = 0 THEN p_size + 1 ELSE p_size END AS STRING), NULL, NONE, 'pkg:generic/p' || CAST(p_partkey AS STRING), 'purl:pkg:generic/p' || CAST(p_partkey AS STRING) FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT 'p-oci', 'OCI_ARCHIVE', 'run-2', 'q' || CAST(p_partkey AS STRING), p_name, NULL, 'cpe:2.3:a', ARR('SHA-256:h'), NULL, 'purl:pkg:generic/p' || CAST(p_partkey AS STRING) FROM part WHERE p_partkey % 6 = 0
        UNION ALL SELECT 'p-run', 'PORTABLE_RUNTIME', 'run-3', 'r' || CAST(p_partkey AS STRING), p_name, CASE WHEN p_partkey % 15 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN CAST(p_size + 2 AS STRING) ELSE CAST(p_size AS STRING) END, NULL, NONE, NULL, CASE WHEN p_partkey % 33 <> 0 THEN 'purl:pkg:generic/p' || CAST(p_partkey AS STRING) END FROM part WHERE p_partkey % 3 = 0""",
    "packages_a": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'arm' ELSE 'x86' END AS architecture, 'n' || CAST(p_partkey AS STRING) AS name, CAST(p_size AS STRING) AS version FROM part WHERE p_partkey % 9 <> 1",
    "packages_b": "SELECT CASE WHEN p_partkey % 22 = 0 THEN 'all' WHEN p_partkey % 2 = 0 THEN 'arm' ELSE 'x86' END AS architecture, 'n' || CAST(p_partkey AS STRING) AS name, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS STRING) AS version FROM part WHERE p_partkey % 9 <> 2",
    "rootfs": """
        SELECT 'image' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 20 END AS STRING) AS archive, 'd/' || CAST(o_orderkey AS STRING) AS path, CASE WHEN o_orderkey % 20 = 7 OR o_orderkey % 7 = 0 THEN 'symlink' WHEN o_orderkey % 11 = 0 THEN 'directory' ELSE 'file' END AS kind,
               o_orderkey % 1000 AS size, 'k' || CAST(o_custkey AS STRING) AS sha256, 'to/' || CAST(o_custkey AS STRING) AS target FROM orders""",
    "export_release": """
        SELECT 'run-' || CAST(c_custkey AS STRING) AS run_id, 'SYNTHETIC_NOT_EVIDENCE' AS classification, lpad(CAST(c_custkey AS STRING), 64, 'c') AS canonical_sha256, 'build-' || CAST(c_custkey AS STRING) AS build_id, lpad(CAST(c_custkey AS STRING), 64, 'a') AS artifact_sha256,
               '2026-01-05T00:00:00Z' AS release_timestamp, 'author ' || CAST(c_nationkey AS STRING) AS sbom_author, 'rel-' || CAST(c_custkey AS STRING) AS release_id, c_mktsegment AS product, '1.0' AS product_version FROM customer""",
    "release_records": """
        SELECT CASE WHEN c_custkey % 19 = 0 THEN '-bad' ELSE 'rel-' || CAST(c_custkey AS STRING) END AS release_id, CASE WHEN c_custkey % 11 = 0 THEN 'REAL' ELSE 'SYNTHETIC_NOT_EVIDENCE' END AS classification, CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' ELSE c_name END AS manufacturer, c_mktsegment AS product,
               '1' AS product_version, 'b' AS build_id, 'arm' AS architecture, 'r1' AS hardware_revision, 'a' AS sbom_author, '1' AS sbom_version, CASE c_custkey % 4 WHEN 0 THEN 'release.json' WHEN 1 THEN '../a.tar' ELSE 'artifact/a.tar' END AS artifact_relative_path,
               CASE WHEN c_custkey % 7 = 0 THEN repeat('A', 64) ELSE repeat('a', 64) END AS artifact_sha256, '2026-01-05T00:00:00Z' AS release_timestamp, CASE WHEN c_custkey % 3 = 0 THEN '2026-01-06T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS evidence_cutoff FROM customer""",
    "component_hashes": """
        SELECT 'c' || CAST(p_partkey AS STRING) AS component_id, CASE WHEN p_partkey % 2 = 0 THEN 'observed' ELSE 'supplier' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'SHA-256' WHEN 1 THEN 'MD5' END AS algorithm, CASE p_partkey % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'xyz' ELSE repeat('a', 64) END AS value FROM part""",
    "attestations": """
        SELECT CAST(s_suppkey AS STRING) AS doc, '{"_type": "' || CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE 'https://in-toto.io/Statement/v1' END || '", "predicateType": "' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'p' END || '", "subject": [{"name": "n", "digest": {"sha256": "' || CASE WHEN s_suppkey % 3 = 0 THEN 'short' ELSE repeat('a', 64) END || '"}}' ||
               CASE WHEN s_suppkey % 4 = 0 THEN ', {"name": "m"}' ELSE '' END || '], "predicate": ' || CASE WHEN s_suppkey % 11 = 0 THEN '[]' ELSE '{}' END || '}' AS raw FROM supplier""",
    "signed": """
        SELECT 'key' || CAST(c_custkey AS STRING) AS key_id, 'corroborate.signature-receipt/v1' AS schema_version, CASE WHEN c_custkey % 6 = 0 THEN 'keyless' ELSE 'cosign-key-based-offline' END AS scheme, 'n' AS subject_name, repeat('a', 64) AS subject_sha256, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'p' END AS signature_path,
               CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE repeat('b', 64) END AS signature_sha256, '2026' AS signed_at_utc, 'cosign' AS tool_name, CASE WHEN c_custkey % 10 <> 0 THEN '3' END AS tool_version, repeat('c', 64) AS tool_sha256 FROM customer""",
    "commands": """
        SELECT o_orderkey AS command_id, CASE o_orderkey % 7 WHEN 0 THEN ARR('cosign', 'sign-blob', '--key', 'k', '--tlog-upload=false', '--use-signing-config=false', '--new-bundle-format=false', '--output-signature', 's') WHEN 1 THEN ARR('cosign', 'verify-blob', '--key', 'k', '--signature', 's', '--insecure-ignore-tlog=true')
               WHEN 2 THEN ARR('cosign', 'sign-blob', '--key', 'k') WHEN 3 THEN ARR('cosign', 'verify-blob', '--signature', 's', '--insecure-ignore-tlog=true') WHEN 4 THEN ARR('cosign', 'verify-blob', '--key', 'k', '--signature', 's', '--insecure-ignore-tlog=true', '--rekor-url=x') WHEN 5 THEN ARR('cosign') ELSE ARR('cosign', 'verify-blob', '--key', 'k', '--signature', 's', '--insecure-ignore-tlog=true', '--tlog-upload') END AS argv FROM orders""",
    "inventory_parts": "SELECT lpad(CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 30 END AS STRING), 64, 'd') AS cyclonedx_sha256, CASE WHEN p_partkey % 4 <> 0 THEN 'pkg:p' END AS purl, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '1' END AS version FROM part",
    "handoff_sources": """
        SELECT 'run-' || CAST(c_custkey AS STRING) AS source_run_id, CASE WHEN c_custkey % 2 = 0 THEN 'CALLER_DECLARED_NOT_INDEPENDENTLY_VERIFIED' ELSE 'VERIFIED_ROOT' END AS source_binding_status, CASE c_custkey % 3 WHEN 0 THEN 'profile-1' WHEN 1 THEN 'odd' END AS source_profile_id,
               CASE WHEN c_custkey % 5 <> 0 THEN repeat('e', 64) END AS source_root_completion_sha256, lpad(CAST(c_custkey % 40 AS STRING), 64, 'd') AS cyclonedx_sha256, 'http://127.0.0.1:1' AS endpoint FROM customer""",
    "recorded_arms": "SELECT 'arm-quality' AS arm_id, CAST(7 AS BIGINT) AS results, CAST(3 AS BIGINT) AS valid, CAST(0.5 AS DOUBLE) AS rate UNION ALL SELECT 'arm-gone', CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1.0 AS DOUBLE)",
    "files_expected": "SELECT 'd/' || CAST(o_orderkey AS STRING) AS path, CASE WHEN o_orderkey % 14 = 0 THEN 'UNKNOWN' ELSE 'k' || CAST(o_custkey AS STRING) END AS sha256 FROM orders WHERE o_orderkey % 5 <> 0",
    "files_observed": "SELECT 'd/' || CAST(o_orderkey AS STRING) AS path, 'k' || CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS sha256 FROM orders WHERE o_orderkey % 6 <> 0",
    "manifest": "SELECT 'r' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 30 END AS STRING) AS root_id, 'f/' || CAST(o_orderkey AS STRING) AS path, 'k' || CAST(o_custkey AS STRING) AS sha256, o_orderkey % 1000 AS size, o_orderkey % 4 = 0 AS executable FROM orders",
    "tree": "SELECT 'f/' || CAST(o_orderkey AS STRING) AS path, 'k' AS sha256, CASE WHEN o_orderkey % 16 = 0 THEN 1 ELSE o_orderkey % 1000 END AS size, o_orderkey % 4 = 0 AS executable FROM orders WHERE o_orderkey % 25 <> 0",
    "installed": "SELECT 'p' || CAST(p_partkey AS STRING) AS name, CAST(p_size AS STRING) AS version FROM part WHERE p_partkey % 5 <> 0",
    "described": "SELECT 'p' || CAST(p_partkey AS STRING) AS name, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS STRING) AS version FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'second' FROM part WHERE p_partkey % 18 = 1",
    "source_files": """
        SELECT CASE WHEN p_partkey % 3 = 0 THEN 'hot' ELSE 'j' || CAST(p_partkey % 60 AS STRING) END AS project,
               CASE p_partkey % 9 WHEN 0 THEN 'venv/lib/a.py' WHEN 1 THEN 'src/.hidden/b.py' WHEN 2 THEN 'build/gen.py' WHEN 3 THEN 'x/site-packages/c/d.py' WHEN 4 THEN 'src/a.c' ELSE 'pkg' || CAST(p_partkey % 3 AS STRING) || '/mod' || CAST(p_partkey % 7 AS STRING) || '.py' END AS path,
               'import os' || chr(10) || '  import numpy' || CAST(p_partkey % 4 AS STRING) || '.linalg as n' || chr(10) || 'from mod' || CAST(p_partkey % 5 AS STRING) || ' import x' || chr(10) || 'from pkg0.deep import y' || chr(10) || '# import never' || chr(10) || 'import Lib' || CAST(p_partkey % 9 AS STRING) AS text FROM part
        UNION ALL SELECT 'j' || CAST(o_orderkey % 60 AS STRING), CASE o_orderkey % 8 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'requirements/prod.txt' WHEN 2 THEN 'venv/requirements.txt' WHEN 3 THEN 'docs/requirements/deep/no.txt' WHEN 4 THEN 'sub/requirements-dev.txt' ELSE 'notes.txt' END,
               'numpy' || chr(10) || '-r base' || CAST(o_orderkey % 11 AS STRING) || '.txt' || chr(10) || '# -r no.txt' || chr(10) || '  --requirement dev' || CAST(o_orderkey % 8 AS STRING) || '.txt  ' || chr(10) || '-rnot.txt' FROM orders WHERE o_orderkey % 60 < 50
        UNION ALL SELECT 'j' || CAST(s_suppkey % 60 AS STRING), CASE WHEN s_suppkey % 5 = 0 THEN 'node_modules/manifest.json' ELSE 'custom/' || lpad(CAST(s_suppkey AS STRING), 9, '0') || '/manifest.json' END,
               CASE WHEN s_suppkey % 7 = 0 THEN '{"requirements": ["hidden"]}' ELSE '{"domain": "d", "requirements": ["client-' || CAST(s_suppkey % 5 AS STRING) || '==1.0", 7, "_lib>=2", "Lib1>=2"]}' END FROM supplier
        UNION ALL SELECT 'z' || CAST(c_custkey % 12 AS STRING), CASE c_custkey % 6 WHEN 0 THEN 'requirements.in' WHEN 1 THEN 'poetry.lock' WHEN 2 THEN 'vcpkg.json' WHEN 3 THEN 'README' ELSE 'sub/setup.py.txt' END, '' FROM customer
        UNION ALL SELECT 'z' || CAST(s_suppkey % 12 AS STRING), CASE WHEN s_suppkey % 4 = 0 THEN 'venv/only.py' WHEN s_suppkey % 4 = 1 THEN 'main.py' ELSE 'src/main.hpp' END, '' FROM supplier""",
    "source_components": """
        SELECT CASE WHEN p_partkey % 3 = 0 THEN 'hot' ELSE 'j' || CAST(p_partkey % 60 AS STRING) END AS project, CASE p_partkey % 5 WHEN 0 THEN 'numpy1' WHEN 1 THEN 'LIB1' WHEN 2 THEN 'client-2' ELSE 'other' || CAST(p_partkey AS STRING) END AS name FROM part
        UNION ALL SELECT 'z' || CAST(s_suppkey % 12 AS STRING), 'some' FROM supplier WHERE s_suppkey % 12 > 8""",
    "json_docs": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{"k": 1, "extra": 2}' WHEN event_id % 10 = 1 THEN '{"j": 1}' WHEN event_id % 10 = 2 THEN '[1]' ELSE props END AS raw FROM events""",
    "texts": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'UNKNOWN' WHEN o_orderkey % 9 = 2 THEN 'a' || chr(10) ELSE o_orderpriority END AS value,
               CASE WHEN o_orderkey % 8 = 0 THEN '-x' WHEN o_orderkey % 8 = 1 THEN 'a b' WHEN o_orderkey % 8 = 2 THEN 'id' || chr(10) ELSE 'id:' || CAST(o_orderkey AS STRING) END AS safe_id,
               CASE o_orderkey % 7 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'a//b' WHEN 3 THEN './a' WHEN 4 THEN 'a/b/' ELSE 'a/.b/c..d' END AS path,
               CASE o_orderkey % 3 WHEN 0 THEN ARR('a', 'b') WHEN 1 THEN ARR('a', 'a') ELSE NONE END AS items,
               CASE o_orderkey % 11 WHEN 0 THEN 'http://a.example.org/x' WHEN 1 THEN 'https://user@a.example.org/x' WHEN 2 THEN 'https://a.example.org:8/x' WHEN 3 THEN 'https://localhost/' WHEN 4 THEN 'https://a.example.org/x?y' WHEN 5 THEN 'https://a.example.org'
                    WHEN 6 THEN 'https://a.example.org:443/x' WHEN 7 THEN 'https://a.example.org/x#f' WHEN 8 THEN 'https://localhost/x/y.tar.gz' WHEN 9 THEN 'https://a.example.org/a b' ELSE 'HTTPS://A.example.org/x' END AS url
        FROM orders""",
    "named": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE 'pkg:generic/' || replace(p_name, ' ', '/') || '@' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '?distro=d&x=1&arch=a' WHEN p_partkey % 4 = 1 THEN '?x=1' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '#sub/p' ELSE '' END END AS ref,
               CASE WHEN p_partkey % 7 = 0 THEN 'cpe:/a:v:p' WHEN p_partkey % 9 = 0 THEN 'cpe:2.3:a:v:p' ELSE 'cpe:2.3:a:v:p' || CAST(p_partkey AS STRING) || ':' || CAST(p_size AS STRING) || ':*:*:*:*:*:*:*' END AS cpe,
               CASE p_partkey % 4 WHEN 0 THEN ARR('LIBRARY') WHEN 1 THEN ARR('ROOT_PRODUCT', 'LIBRARY') WHEN 2 THEN ARR('BINARY_ONLY_FIRMWARE') ELSE NONE END AS roles,
               CASE p_partkey % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha-1' WHEN 2 THEN 'Odd' ELSE 'sha256' END AS algorithm,
               CASE WHEN p_partkey % 5 = 0 THEN 'xyz' WHEN p_partkey % 3 = 0 THEN 'ABCDEF0123456789abcdef0123456789' ELSE '0123456789012345678901234567890123456789' END AS digest, p_name AS name
        FROM part""",
    "card_claims": "SELECT conv_id AS conflict_id, 'cl' || CAST(100 + turn AS STRING) AS claim_id, role AS value, 'ev' || CAST(turn % 3 AS STRING) AS evidence_id FROM conversations",
    "arm_results": "SELECT 'arm-quality' AS arm_id, quality = 1 AS valid FROM labels UNION ALL SELECT 'arm-any', quality >= 0 FROM labels",
    "run_findings": "SELECT 'run-' || CAST(o_custkey % 40 AS STRING) AS run_id, CASE WHEN o_custkey % 40 < 10 THEN 'MATCHED' WHEN o_orderstatus = 'F' THEN 'CONFLICT' ELSE 'MATCHED' END AS status FROM orders",
    "nested": """SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END AS doc, '{"components": [{"bom-ref": "r' || CAST(p_partkey AS STRING) || '", "name": "' || p_name || '", "version": "' || CAST(p_size AS STRING) || '", "purl": "pkg:generic/p' || CAST(p_partkey AS STRING) || '@1", "hashes": [{"alg": "SHA-256", "content": "h' || CAST(p_partkey AS STRING) || '"}], "components": [{"bom-ref": "k' || CAST(p_partkey AS STRING) || '", "name": "kid", "cpe": "cpe:2.3:a", "components": [{"bom-ref": "d' || CAST(p_partkey AS STRING) || '", "name": "deep"}]}]}, {"bom-ref": "s' || CAST(p_partkey AS STRING) || '", "name": "last"}]}' AS raw FROM part""",
    "runtimes": """
        SELECT CASE WHEN s_suppkey % 20 = 0 THEN 'same' WHEN s_suppkey % 20 = 1 THEN '-bad' ELSE 'rt' || CAST(s_suppkey AS STRING) END AS runtime_id, CASE s_suppkey % 4 WHEN 0 THEN 'scanner' WHEN 1 THEN 'schema' WHEN 2 THEN 'signing' ELSE 'other' END AS category,
               CASE s_suppkey % 3 WHEN 0 THEN 'FROZEN' WHEN 1 THEN 'LOCALLY_OBSERVED' ELSE 'GONE' END AS status, CASE WHEN s_suppkey % 6 = 0 THEN 'ftp://x.example.org' ELSE 'https://x.example.org/r' END AS source_url,
               CASE WHEN s_suppkey % 7 = 0 THEN 'abc' ELSE '0123456789012345678901234567890123456789' END AS resolved_commit,
               CASE WHEN s_suppkey % 2 = 0 THEN repeat('a', 64) END AS artifact_sha256, CASE WHEN s_suppkey % 9 = 0 THEN repeat('B', 64) ELSE repeat('b', 64) END AS config_sha256, repeat('c', 64) AS dependency_manifest_sha256
        FROM supplier""",
    "issuers": """
        SELECT 'is' || CAST(c_custkey AS STRING) AS issuer_id, CASE c_custkey % 5 WHEN 0 THEN 'NOT_ADMITTED' WHEN 1 THEN 'ODD' ELSE 'ADMITTED_FOR_VEX_INTAKE' END AS status,
               CASE WHEN c_custkey % 3 = 0 THEN repeat('a', 64) WHEN c_custkey % 3 = 1 THEN 'short' END AS public_key_sha256, CASE WHEN c_custkey % 4 = 0 THEN '../k' WHEN c_custkey % 4 < 3 THEN 'keys/k' END AS public_key_path,
               CASE WHEN c_custkey % 2 = 0 THEN 'r/x' END AS acquisition_receipt_ref
        FROM customer""",
    "image_graph": """
        SELECT '{"type": "SpdxDocument", "spdxId": "doc", "rootElement": ["arch"]}' AS raw
        UNION ALL SELECT '{"type": "software_Package", "spdxId": "arch", "name": "image", "software_primaryPurpose": "archive"}'
        UNION ALL SELECT '{"type": "Organization", "spdxId": "org' || CAST(n_nationkey AS STRING) || '", "name": "' || n_name || '"}' FROM nation
        UNION ALL SELECT '{"type": "software_Package", "spdxId": "p' || CAST(p_partkey AS STRING) || '", "name": "n' || CAST(p_partkey AS STRING) || '", "software_primaryPurpose": "' || CASE WHEN p_partkey % 10 = 0 THEN 'source' ELSE 'install' END || '", "software_packageUrl": "pkg:generic/p' || CAST(p_partkey AS STRING) || '"' ||
               CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ', "software_packageVersion": "' || CAST(p_size AS STRING) || '"' END || ', "suppliedBy": "org' || CAST(p_partkey % 40 AS STRING) || '", "externalIdentifier": [{"identifier": "a' || CAST(p_partkey AS STRING) || '"}]}' FROM part
        UNION ALL SELECT '{"type": "software_File", "spdxId": "f' || CAST(p_partkey AS STRING) || '", "name": "./usr/f' || CAST(p_partkey AS STRING) || '", "verifiedUsing": [' || CASE WHEN p_partkey % 8 = 0 THEN '' ELSE '{"algorithm": "sha256", "hashValue": "h' || CAST(p_partkey AS STRING) || '"}' END || ']}' FROM part
        UNION ALL SELECT '{"type": "Relationship", "spdxId": "r' || CAST(p_partkey AS STRING) || '", "from": "p' || CAST(p_partkey AS STRING) || '", "relationshipType": "contains", "to": ["f' || CAST(p_partkey AS STRING) || '"]}' FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT '{"type": "Relationship", "spdxId": "q' || CAST(p_partkey AS STRING) || '", "from": "arch", "relationshipType": "contains", "to": ["f' || CAST(p_partkey AS STRING) || '"]}' FROM part WHERE p_partkey % 5 <> 0
        UNION ALL SELECT '{"type": "LifecycleScopedRelationship", "spdxId": "d' || CAST(p_partkey AS STRING) || '", "from": "p' || CAST(p_partkey AS STRING) || '", "relationshipType": "dependsOn", "scope": "' || CASE WHEN p_partkey % 4 = 0 THEN 'build' ELSE 'runtime' END || '", "to": ["p' || CAST(p_partkey + 1 AS STRING) || '", "none"]}' FROM part""",
    "typed": """
        SELECT 'c' || CAST(p_partkey AS STRING) AS candidate_id, CASE WHEN p_partkey % 4 = 0 THEN 'UNKNOWN' ELSE 'pkg:generic/p' || CAST(p_partkey AS STRING) END AS purl, 'urn:p' || CAST(p_partkey AS STRING) AS urn, 'LIBRARY' AS role,
               CASE p_partkey % 3 WHEN 0 THEN 'source:' || p_brand || ':x' WHEN 1 THEN 'source:' ELSE 'nothing' END AS provenance, CASE WHEN p_partkey % 2 = 0 THEN 'SHA-256' END AS algorithm, 'h' || CAST(p_partkey AS STRING) AS digest
        FROM part""",
    "releases": """
        SELECT c_custkey AS release_id, CASE WHEN c_custkey % 7 = 0 THEN '2026-02-30T00:00:00Z' WHEN c_custkey % 7 = 1 THEN '2026-01-05 00:00:00Z' ELSE '2026-01-05T00:00:00Z' END AS release_timestamp,
               CASE WHEN c_custkey % 5 = 0 THEN '2026-01-05T00:00:00.5Z' WHEN c_custkey % 5 = 1 THEN '2026-01-05T00:00:00Z' ELSE '2025-12-31T23:59:59Z' END AS evidence_cutoff, c_mktsegment AS product, c_name AS build_id
        FROM customer""",
    "release_evidence": "SELECT c_custkey AS release_id, CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END AS product, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS build_id FROM customer WHERE c_custkey % 11 <> 0",
    "layers": "SELECT 'image' || CAST(l_suppkey AS STRING) AS archive, CAST(l_orderkey AS STRING) AS path, CAST(l_quantity AS BIGINT) AS size FROM lineitem",
    "arm_cards": "SELECT 'arm' || CAST(turn % 2 AS STRING) AS arm_id, CASE WHEN conv_id % 9 = 0 THEN conv_id + 1000000 ELSE conv_id END AS conflict_id FROM conversations WHERE turn < 3",
    "served": """
        SELECT 'run-' || CAST(c_custkey AS STRING) AS run_id, CASE c_custkey % 5 WHEN 0 THEN 'REAL' WHEN 1 THEN 'PUBLIC_BUILD_REFERENCE_NOT_CUSTOMER_EVIDENCE' WHEN 2 THEN 'SELF_TEST_NOT_CUSTOMER_EVIDENCE' ELSE 'SYNTHETIC_X' END AS classification,
               CASE c_custkey % 3 WHEN 0 THEN 'NOT_APPROVED' WHEN 1 THEN 'certified' ELSE 'open' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'CAB_APPROVED' WHEN 1 THEN 'NO_PRODUCT_CONFORMITY_STATUS' END AS product_conformity_status,
               CASE WHEN c_custkey % 7 = 0 THEN 'manufacturer' END AS manufacturer_role, 'CERTIFIED' AS note
        FROM customer""",
    "json_bodies": """
        SELECT p_partkey AS doc, CASE WHEN p_partkey % 2 = 0 THEN '{"b": [{"y": 1, "x": "' || p_name || '"}, 2.50], "serial_number": "urn:' || CAST(p_partkey AS STRING) || ' \\\\\\"run_id\\\\\\":", "a": {"run_id": "r", "k": null}}'
               WHEN p_partkey % 7 = 0 THEN '{"a": 1, "a": 2}' ELSE '{"a": {"k": null, "run_id": "q"}, "serial_number": 7, "b": [{"x": "' || p_name || '", "y": 1}, 2.5]}' END AS raw FROM part""",
    "candidate_lists": """
        SELECT p_partkey AS doc, CASE WHEN p_partkey % 9 = 8 THEN '{"components": []}' ELSE '[' || CASE WHEN p_partkey % 9 = 6 THEN '{"candidate_id": "c9", "producer": "p", "name": "n", "version": "1", "identifiers": [], "roles": [], "provenances": [], "observed_hashes": [], "supplier_hashes": []}, ' ELSE '' END
               || '{"version": "' || CAST(p_size AS STRING) || '", "candidate_id": "c1", "producer": "' || p_brand || '", "name": "n", "identifiers": [' || CASE WHEN p_partkey % 9 = 1 THEN '"b", "a"' ELSE '"a", "b"' END || '], "roles": [' || CASE WHEN p_partkey % 9 = 4 THEN '"R", "R"' ELSE '"R"' END || '], ' || CASE WHEN p_partkey % 9 = 2 THEN '"extra": 1, ' ELSE '' END
               || '"provenances": [{"kind": "k", "locator": "l", "source_available": "' || CASE WHEN p_partkey % 9 = 3 THEN 'YES' ELSE 'UNKNOWN' END || '"}], "observed_hashes": [{"algorithm": "SHA-256", "value": "b"}, {"algorithm": "SHA-256", "value": "' || CASE WHEN p_partkey % 9 = 5 THEN 'a' ELSE 'c' END || '"}], "supplier_hashes": [' || CASE WHEN p_partkey % 9 = 7 THEN '{"algorithm": "MD5"}' ELSE '' END || ']}]' END AS raw FROM part""",
    "obs_profiles": """
        SELECT 'prof-' || CAST(c_custkey AS STRING) AS profile_id, CASE c_custkey % 3 WHEN 0 THEN 'SOURCE_DIRECTORY' WHEN 1 THEN 'OCI_ARCHIVE' ELSE 'PORTABLE_RUNTIME' END AS profile_kind, CASE WHEN c_custkey % 11 = 0 THEN 'SPOOFED' WHEN c_custkey % 3 = 0 THEN 'SOURCE_DECLARATION' WHEN c_custkey % 3 = 1 THEN 'BUILT_OCI_ARTIFACT' ELSE 'PORTABLE_RUNTIME_OBSERVATION' END AS independence_domain,
               'space' AS comparison_namespace, c_name AS product_name, '1.0' AS declared_version, CASE WHEN c_custkey % 13 = 0 THEN 'file' WHEN c_custkey % 3 = 1 THEN 'docker-archive' ELSE 'dir' END AS target_kind, CASE WHEN c_custkey % 19 = 0 THEN '-x' ELSE 'target' END AS target_label,
               CASE WHEN c_custkey % 17 = 0 THEN ARR('NOT_YOCTO_M3B', 'OTHER') ELSE ARR('OTHER', 'NOT_YOCTO_M3B', 'NO_CUSTOMER_OR_MANUFACTURER_CONTEXT', 'NO_CRA_OR_PRE7_CONFORMITY_CLAIM') END AS blindspots, CASE WHEN c_custkey % 23 = 0 THEN '1.49.0' ELSE '1.50.0' END AS scanner_version, 100000 AS max_components FROM customer""",
    "obs_heads": """
        SELECT 'prof-' || CAST(c_custkey AS STRING) AS profile_id, '{"spec": "1.7", "serial_number": "urn:' || CAST(c_custkey AS STRING) || '", "root": {"version": "1.0", "name": "' || c_name || '"}}' AS raw, lpad(CAST(c_custkey AS STRING), 64, 'a') AS source_sha256, c_custkey * 3 AS raw_size, 'root' AS root_id, repeat('b', 64) AS input_sha256, c_custkey % 7 AS file_count, 10 AS total_bytes FROM customer""",
    "obs_components": """SELECT 'prof-' || CAST(o_custkey AS STRING) AS profile_id, '{"name": "' || o_orderpriority || '", "serial_number": "s' || CAST(o_orderkey AS STRING) || '", "bom_ref": "o' || CAST(o_orderkey AS STRING) || '"}' AS line FROM orders""",
    "obs_dependencies": """SELECT 'prof-' || CAST(o_custkey AS STRING) AS profile_id, '{"ref": "o' || CAST(o_orderkey AS STRING) || '", "depends_on": []}' AS line FROM orders WHERE o_orderkey % 3 = 0""",
    "reg_files": """
        SELECT 'reg/' || CAST(c_custkey AS STRING) || '.json' AS path, CASE c_custkey % 11 WHEN 2 THEN 'odd-registry' WHEN 3 THEN 'vex-issuer-registry' WHEN 9 THEN 'vex-issuer-registry' WHEN 10 THEN 'image-profile-registry' ELSE 'runtime-registry' END AS kind, CASE WHEN c_custkey % 11 = 8 THEN 10 ELSE 100000 END AS max_bytes,
               CASE c_custkey % 11 WHEN 5 THEN '{"registry_type": ' WHEN 10 THEN '{"schema_version": "1.0", "profiles": [{"profile_id": "p' || CAST(c_custkey AS STRING) || '"}]}'
               WHEN 9 THEN '{"registry_type": "vex-issuer-registry", "schema_version": "1.0", "updated_at": "2026-01-01", "issuers": [{"issuer_id": "is' || CAST(c_custkey AS STRING) || '", "status": "NOT_ADMITTED", "display_name": "d", "identity_kind": "' || CASE WHEN c_custkey % 2 = 0 THEN 'other' ELSE 'cosign-offline-key' END || '", "public_key_path": null, "public_key_sha256": null, "acquisition_receipt_ref": null, "boundary": "b"}]}'
               ELSE '{' || CASE WHEN c_custkey % 11 = 4 THEN '"more": 1, ' ELSE '' END || '"schema_version": "' || CASE WHEN c_custkey % 11 = 0 AND c_custkey % 2 = 0 THEN '2.0' ELSE '1.0' END || '", "registry_type": "' || CASE WHEN c_custkey % 11 = 2 THEN 'odd-registry' ELSE 'runtime-registry' END || '", "updated_at": "2026-01-01", "runtimes": [{"runtime_id": "rt1", "category": "' || CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'scanner' END
                 || '", "name": "n", "version": "1", "source_url": "https://x.example.org/r", "resolved_commit": "' || repeat('a', 40) || '", "license_expression": "MIT", "status": "FROZEN", "artifact_sha256": "' || repeat('b', 64) || '", "config_sha256": "' || repeat('c', 64) || '", "dependency_manifest_sha256": ' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || repeat('d', 64) || '"' END || ', "notes": "n"}'
                 || CASE WHEN c_custkey % 7 = 0 THEN ', {"runtime_id": "rt1", "category": "scanner", "name": "n", "version": "1", "source_url": "https://x.example.org/r", "resolved_commit": "' || repeat('a', 40) || '", "license_expression": "MIT", "status": "LOCALLY_OBSERVED", "artifact_sha256": null, "config_sha256": null, "dependency_manifest_sha256": null, "notes": "n"}' ELSE '' END || ']}' END AS raw FROM customer""",
    "reg_sources": """
        SELECT 'src/' || CAST(s_suppkey AS STRING) || '.json' AS path, 'source-dataset-registry' AS kind, 100000 AS max_bytes,
               '{"registry_type": "source-dataset-registry", "schema_version": "1.0", "updated_at": "2026-01-01", "sources": [{"dataset_id": "ds-' || CAST(s_suppkey AS STRING) || '", "root_id": "ds-' || CAST(s_suppkey AS STRING) || '@' || repeat('a', 40) || '", "name": "' || CASE WHEN s_suppkey % 20 = 1 THEN ' ' ELSE 'n' END || '", "notes": "n", "source_type": "' || CASE WHEN s_suppkey % 20 = 2 THEN 'zip' ELSE 'git' END
               || '", "upstream_url": "https://' || CASE WHEN s_suppkey % 20 = 3 THEN 'example.org' ELSE 'github.com' END || '/a/b", "lineage_group": "g", "pin": {"ref_type": "commit", "ref_name": "' || CASE WHEN s_suppkey % 20 = 4 THEN 'Main' ELSE 'v1' END || '", "resolved_commit": "' || repeat('a', 40) || '", "tag_object": null, "acquisition_artifact_sha256": ' || CASE WHEN s_suppkey % 20 = 5 THEN '"x"' ELSE 'null' END
               || '}, "license": {"expression": "MIT", "review_status": "r", "evidence_paths": ["LICENSE"' || CASE WHEN s_suppkey % 20 = 6 THEN ', "../x"' ELSE '' END || '], "evidence_hashes": {"LICENSE": null' || CASE WHEN s_suppkey % 20 = 6 THEN ', "../x": null' WHEN s_suppkey % 20 = 7 THEN ', "other": null' ELSE '' END || '}, "content_scopes": [{"scope": "all", "expression": "MIT", "training_allowed": false, "raw_redistribution_allowed": false}' || CASE WHEN s_suppkey % 20 = 8 THEN ', {"scope": "all", "expression": "MIT", "training_allowed": true, "raw_redistribution_allowed": false}' ELSE '' END
               || ']}, "governance": {"admission_status": "' || CASE WHEN s_suppkey % 20 = 9 THEN 'QUARANTINE_ACQUIRED' ELSE 'REGISTERED_PENDING_REVIEW' END || '", "purposes": ["p"' || CASE WHEN s_suppkey % 20 = 10 THEN ', "p"' ELSE '' END || '], "split": "' || CASE WHEN s_suppkey % 20 = 11 THEN 'ODD' ELSE 'DEV' END || '", "acquisition_allowed": true, "internal_development_allowed": false, "evaluation_allowed": ' || CASE WHEN s_suppkey % 20 = 12 THEN 'true' ELSE 'false' END
               || ', "training_allowed": false, "fixture_distribution_allowed": false, "raw_redistribution_allowed": false, "adapter_distribution_allowed": false, "weight_distribution_allowed": false, "shipping_examples_allowed": false, "redistribution_status": "s", "access_terms_status": "s", "tdm_reservation_status": "s", "submodules_status": "s", "lfs_status": "s", "generated_content_status": "s", "binary_content_status": "s", "attribution_status": "s", "acquisition_status": "REGISTERED_PENDING_ACQUISITION", "rights_status": "'
               || CASE WHEN s_suppkey % 20 = 13 THEN 'RIGHTS_REVIEWED' ELSE 'AWAITING_NAMED_REVIEW' END || '", "usage_status": "NOT_ADMITTED", "format_validation_status": "NOT_ASSESSED", "release_status": "' || CASE WHEN s_suppkey % 20 = 14 THEN 'APPROVED_FOR_SCOPED_USE' ELSE 'NOT_APPROVED' END || '", "rights_decision_ref": ' || CASE WHEN s_suppkey % 20 = 13 THEN '"r/d"' WHEN s_suppkey % 20 = 15 THEN '"/abs"' ELSE 'null' END
               || ', "rights_decision_sha256": ' || CASE WHEN s_suppkey % 20 IN (13, 15) THEN '"' || repeat('e', 64) || '"' ELSE 'null' END || ', "revalidation_triggers": [' || CASE WHEN s_suppkey % 20 = 16 THEN '' ELSE '"t"' END || ']}, "acquisition": {"allow_submodules": ' || CASE WHEN s_suppkey % 20 = 17 THEN 'true' ELSE 'false' END || ', "execute_code": ' || CASE WHEN s_suppkey % 20 = 18 THEN 'true' ELSE 'false' END || ', "max_files": ' || CASE WHEN s_suppkey % 20 = 19 THEN '0' ELSE '10' END || ', "max_total_bytes": 1000}}]}' AS raw FROM supplier""",
    "image_profiles": """
        SELECT 'ip-' || CAST(c_custkey AS STRING) AS profile_id, CASE WHEN c_custkey % 16 = 1 THEN 'REAL' ELSE 'PUBLIC_BUILD_REFERENCE_NOT_CUSTOMER_EVIDENCE' END AS classification, 'yocto-6' AS upstream_release, CASE WHEN c_custkey % 16 = 2 THEN 'https://example.org/n' ELSE 'https://downloads.yoctoproject.org/notes' END AS release_notes_url,
               repeat('a', 40) AS openembedded_core, CASE WHEN c_custkey % 16 = 3 THEN repeat('A', 40) ELSE repeat('b', 40) END AS bitbake, repeat('c', 40) AS meta_yocto, CASE WHEN c_custkey % 16 = 4 THEN 'a b' ELSE 'image' END AS image_name, 'qemu' AS machine, 'arm' AS architecture, CASE WHEN c_custkey % 16 = 5 THEN '20260105' ELSE '20260105010203' END AS build_timestamp, 'b1' AS build_id, 'builder' AS reference_builder,
               CASE WHEN c_custkey % 16 = 6 THEN '2026-01-05T01:02:04Z' ELSE '2026-01-05T01:02:03Z' END AS release_timestamp, CASE WHEN c_custkey % 16 = 7 THEN 'm' ELSE 'l' END AS build_lane, 'm' AS artifact_lane, CASE WHEN c_custkey % 16 = 8 THEN 'ODD' ELSE 'BUILD_METADATA' END AS build_domain,
               CASE WHEN c_custkey % 16 = 9 THEN ARR('INSTALLED_PACKAGES') ELSE ARR('ROOTFS_SYMLINKS', 'INSTALLED_PACKAGES', 'ROOTFS_REGULAR_FILES') END AS included, CASE WHEN c_custkey % 16 = 10 THEN ARR('x', 'x') ELSE ARR('x') END AS declared_exclusions, ARR('b') AS blindspots, 1024 AS max_json_bytes, CASE WHEN c_custkey % 16 = 11 THEN 0 ELSE 5 END AS max_rootfs_files, 7 AS max_rootfs_expanded_bytes, 64 AS max_path_bytes, 900 AS zstd_timeout_seconds FROM customer""",
    "image_payloads": "SELECT 'ip-' || CAST(c_custkey AS STRING) AS profile_id, CASE WHEN c_custkey % 16 = 12 AND role = 'testdata' THEN 'qemuboot' ELSE role END AS role, 'https://downloads.yoctoproject.org/d/' || CASE WHEN c_custkey % 16 = 13 AND role = 'testdata' THEN 'y' ELSE 'x' END || suffix AS url, 'in/x' || suffix AS relative_path, CASE WHEN c_custkey % 16 = 14 THEN 'short' ELSE repeat('f', 64) END AS sha256, CASE WHEN c_custkey % 16 = 15 THEN 0 ELSE 10 END AS max_bytes, 'application/json' AS media_type FROM ("
        + " UNION ALL ".join(f"SELECT c_custkey, '{role}' AS role, '{suffix}' AS suffix FROM customer" for role, suffix in (("rootfs_archive", ".tar.zst"), ("build_spdx", ".spdx.json"), ("image_manifest", ".manifest"), ("qemuboot", ".qemuboot.conf"), ("testdata", ".testdata.json"))) + ")",
    "img_part": "SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 20 END AS image FROM part",
    "img_images": """
        SELECT image, 'profile-' || CAST(image AS STRING) AS profile_id, repeat('f', 64) AS profile_sha256, 'image' || CAST(image AS STRING) AS image_name, 'release-6' AS upstream_release, 'build-' || CAST(image AS STRING) AS build_id, 'arm' AS architecture,
               '2026-01-05T00:00:00Z' AS release_timestamp, 'builder' AS reference_builder, CASE WHEN image % 2 = 0 THEN 'lane-b' ELSE 'lane-z' END AS build_lane, 'lane-m' AS artifact_lane FROM (SELECT DISTINCT image FROM img_part)""",
    "img_inputs": "SELECT image, role, 'in/' || role AS relative_path, lpad(CAST(image AS STRING), 64, 'e') AS sha256, 'https://example.org/' || role AS url, image * 10 + 5 AS size, 'application/json' AS media_type FROM ("
        + " UNION ALL ".join(f"SELECT image, '{role}' AS role FROM img_images" for role in ("rootfs_archive", "build_spdx", "image_manifest", "qemuboot", "testdata")) + ")",
    "img_manifest": "SELECT image, 'n' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_partkey % 4 = 0 THEN 'all' ELSE 'arm' END AS architecture, CAST(p_size AS STRING) AS version FROM img_part WHERE p_partkey % 5 <> 0",
    "img_native": """
        SELECT image, 's' || CAST(p_partkey AS STRING) AS source_id, 'n' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_partkey % 6 = 0 THEN 'UNKNOWN' WHEN p_partkey % 4 = 0 THEN 'other' ELSE CAST(p_size AS STRING) END AS version, CASE WHEN p_partkey % 8 = 0 THEN 'UNKNOWN' ELSE p_brand END AS producer,
               CASE WHEN p_partkey % 9 = 0 THEN ARR('UNKNOWN') ELSE ARR('cpe:p' || CAST(p_partkey AS STRING), 'pkg:generic/p' || CAST(p_partkey AS STRING)) END AS identifiers FROM img_part WHERE p_partkey % 7 <> 0
        UNION ALL SELECT image, 't' || CAST(p_partkey AS STRING), 'n' || CAST(p_partkey AS STRING), 'second', 'UNKNOWN', ARR('UNKNOWN') FROM img_part WHERE p_partkey % 18 = 1""",
    "img_expected": "SELECT image, 'usr/f' || CAST(p_partkey AS STRING) AS path, CASE WHEN p_partkey % 8 = 0 THEN 'UNKNOWN' ELSE 'h' || CAST(p_partkey AS STRING) END AS sha256, CASE WHEN p_partkey % 3 = 1 THEN NONE ELSE ARR('s' || CAST(p_partkey - p_partkey % 60 AS STRING), 's' || CAST(p_partkey AS STRING)) END AS owners FROM img_part WHERE p_partkey % 5 <> 3",
    "img_observed": "SELECT image, 'usr/f' || CAST(p_partkey AS STRING) AS path, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE 'h' || CAST(p_partkey AS STRING) END AS sha256 FROM img_part WHERE p_partkey % 6 <> 0",
    "img_depends": "SELECT image, 's' || CAST(p_partkey AS STRING) AS src, 's' || CAST(p_partkey + 60 AS STRING) AS dst FROM img_part",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(text: str) -> set[str]:
    return {w for w in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("ARR(", "array(").replace("NONE", "cast(array() as array<string>)")
    used = {n: spark_view(spark, sf_dir, n) for n in _needs(text)}
    for n in used:
        text = re.sub(rf"(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
    # Braces of JSON text are not parameters.
    text = re.sub(r"'[^']*'", lambda m: m[0].replace("{", "{{").replace("}", "}}"), text)
    return spark.sql(text, **used)


def duckdb_views(*names: str) -> str:
    """WITH clauses for the views and those that they need."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            for n in sorted(_needs(VIEWS[name])):
                add(n)
            done.append(name)

    for name in names:
        add(name)
    return ",\n".join(f"{n} AS ({VIEWS[n].replace('ARR(', 'list_value(').replace('NONE', 'CAST([] AS VARCHAR[])')})" for n in done)
