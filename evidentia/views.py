"""Evidence tables derived from the given tables; the SQL is accepted by Spark and by DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark".split()

VIEWS = {
    "v_components": """SELECT p_partkey AS component_id, p_brand AS path, p_partkey AS line, p_partkey + p_size AS end_line,
        p_name AS name, p_type AS kind FROM part""",
    "v_findings": """SELECT o_orderkey AS finding_id, o_orderkey % 97 AS component_id,
        CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS screening_priority,
        concat('rule.', CAST(o_custkey % 12 AS STRING)) AS rule_id, concat('class', CAST(o_custkey % 5 AS STRING)) AS failure_class,
        CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'unreviewed' ELSE 'rejected' END AS disposition,
        o_orderkey % 12 AS severity, o_custkey % 12 AS occurrence, (o_orderkey + o_custkey) % 12 AS detection,
        o_orderkey % 23 = 0 AS hazard_linked, o_orderkey % 19 = 0 AS revalidation_required FROM orders""",
    "v_prev_run": "SELECT o_orderkey AS finding_id, o_custkey AS fingerprint, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0",
    "v_cur_run": """SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS fingerprint,
        o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0""",
    "v_obligations": """SELECT o_orderkey AS finding_id, o_orderkey * 10 AS obligation_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 17 <> 0
        UNION ALL SELECT o_orderkey, o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 13 = 0""",
    "v_spans": """SELECT user_id AS trace_id, event_id AS span_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_span_id,
        event_type AS component, ts, value AS latency_ms, event_type = 'error' AS error FROM events""",
    "v_tree_edges": "SELECT p_partkey AS target, CAST(floor(p_partkey / 3) AS BIGINT) AS source FROM part WHERE p_partkey > 0",
    "v_channel_edges": """SELECT DISTINCT l_suppkey AS source, l_partkey AS target,
        CASE l_returnflag WHEN 'R' THEN 'native_ast' WHEN 'A' THEN 'external_static' ELSE 'runtime_observed' END AS channel FROM lineitem""",
    "v_predictions": """SELECT l.doc_id, d.lang AS stratum, d.source AS repository, l.quality = 1 AS expected, d.n_chars % 3 <> 0 AS predicted,
        (d.n_chars % 101) / CAST(100 AS DOUBLE) AS confidence FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_tool_predictions": """SELECT l.doc_id, t.tool, l.quality = 1 AS expected,
        CASE t.tool WHEN 'a' THEN d.n_chars % 3 <> 0 WHEN 'b' THEN d.n_chars % 5 <> 0 ELSE l.toxic = 0 END AS predicted
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (SELECT 'a' AS tool UNION ALL SELECT 'b' UNION ALL SELECT 'c') t""",
    "v_claims": "SELECT doc_id AS claim_id, source AS component, doc_id % 4 = 0 AS suggestion, text AS claim FROM documents",
    "v_clients": """SELECT page_id AS endpoint_id, url, CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'UNKNOWN' END AS method FROM pages""",
    "v_routes": "SELECT page_id AS route_id, url, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS method FROM pages WHERE page_id % 2 = 0",
    "v_scan_results": """SELECT p.p_brand AS path, l.l_partkey + l.l_linenumber AS line, l.l_returnflag AS tool, l.l_suppkey % 9 AS rule_id
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_coverage_points": """SELECT p.p_brand AS path, l.l_partkey AS line, max(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity > 45 THEN 1 ELSE 0 END) AS executed
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, l.l_partkey""",
    "v_changes": "SELECT user_id, ts AS effective_at, event_id AS version FROM events WHERE event_type = 'signup'",
    "v_vectors": """SELECT DISTINCT l_partkey AS decision, l_quantity > 25 AS c1, l_discount > 0.05 AS c2, l_tax > 0.04 AS c3,
        l_quantity > 25 AND (l_discount > 0.05 OR l_tax > 0.04) AS outcome FROM lineitem""",
    "v_scenarios": """SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e1,
        max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS e2, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS e3
        FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "v_blocks": "SELECT l_orderkey AS diagram, l_linenumber AS block, max(l_discount) AS rate FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "v_hierarchy": """SELECT concat('c', CAST(c_custkey AS STRING)) AS node, concat('n', CAST(c_nationkey AS STRING)) AS parent FROM customer
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation""",
    "v_receipts": "SELECT CAST(ts AS DATE) AS day, count(*) AS runs, avg(value) AS mean_value, max(value) AS peak FROM events GROUP BY CAST(ts AS DATE)",
    "v_advisories": "SELECT p_partkey AS advisory_id, lower(replace(p_name, ' ', '-')) AS package, p_size AS introduced, p_size + 20 AS fixed FROM part WHERE p_partkey % 5 = 0",
    "v_sbom": "SELECT p_partkey AS bom_ref, lower(replace(p_name, ' ', '_')) AS package, p_size AS version FROM part",
    "v_aliases": "SELECT p_partkey AS record, p_partkey % 40 AS alias FROM part UNION ALL SELECT p_partkey, p_partkey % 40 + 1 FROM part WHERE p_partkey % 8 <> 0",
    "v_decision_obs": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'proof_of_concept' ELSE 'active' END AS exploitation,
        CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS automatable FROM orders""",
    "v_named_components": """SELECT p_partkey AS component_id, concat('f', CAST(p_partkey % 700 AS STRING)) AS name,
        concat(replace(p_name, ' ', '_'), '.f', CAST(p_partkey % 700 AS STRING)) AS qualname, concat(p_brand, '/', p_type, '.py') AS path, p_partkey AS line FROM part""",
    "v_named_spans": """SELECT e.event_id AS span_id, e.user_id AS trace_id, CASE WHEN e.event_id % 4 = 0 THEN concat(replace(p.p_name, ' ', '_'), '.f', CAST(p.p_partkey % 700 AS STRING)) END AS component_attr,
        CASE e.event_id % 4 WHEN 1 THEN concat(p.p_brand, '/', p.p_type, '.py:', replace(p.p_name, ' ', '_'), '.f', CAST(p.p_partkey % 700 AS STRING)) WHEN 2 THEN concat('f', CAST(p.p_partkey % 700 AS STRING)) END AS function_attr,
        CASE WHEN e.event_id % 5 = 0 THEN concat('f', CAST(p.p_partkey % 700 AS STRING)) ELSE e.event_type END AS name, concat('/app/', p.p_brand, '/', p.p_type, '.py') AS file
        FROM events e JOIN part p ON p.p_partkey = e.event_id % 1999""",
    "v_observed_edges": "SELECT l_suppkey AS source, l_partkey AS target, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_returnflag = 'R'",
    "v_call_sites": """SELECT l_suppkey AS component_id, l_orderkey AS ord, concat('m.f', CAST(l_partkey % 700 AS STRING)) AS reference,
        CASE l_linestatus WHEN 'F' THEN 'unresolved' ELSE 'unique_static_target' END AS resolution, CAST(l_quantity AS BIGINT) AS line FROM lineitem WHERE l_returnflag = 'A'""",
    "v_tree_events": "SELECT p_brand AS tree, concat('e', CAST(p_partkey % 5 AS STRING)) AS node, avg(p_retailprice) / 5000 AS p FROM part GROUP BY p_brand, concat('e', CAST(p_partkey % 5 AS STRING))",
    "v_order_blocks": """SELECT l_orderkey AS tree, CAST(l_linenumber AS STRING) AS node, exp(-(max(l_discount) + 0.01)) AS value, exp(-(max(l_discount) + 0.02)) AS low, exp(-(max(l_discount) + 0.005)) AS high
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_work_obligations": """SELECT o_orderkey * 10 + n AS obligation_id, o_orderkey AS finding_id, CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'candidate' ELSE 'verification_planned' END AS assurance_status,
        CASE o_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' WHEN 2 THEN 'collected_unreviewed' ELSE 'sufficient' END AS evidence_status, CASE WHEN o_custkey % 9 = 8 THEN 2 ELSE 0 END AS gaps,
        CASE WHEN o_custkey % 11 <> 0 THEN 'r1' ELSE '' END AS reviewer, CASE WHEN o_custkey % 13 <> 0 THEN 'because' END AS rationale,
        CASE WHEN o_orderkey % 4 = 2 THEN 'proposed' ELSE 'implemented' END AS implementation, CASE o_custkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'review' ELSE 'analysis' END AS verification_method,
        CASE WHEN o_custkey % 29 = 0 THEN 'retired' ELSE 'active' END AS source_status
        FROM orders CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) k WHERE o_orderstatus = 'F' AND o_orderkey % 17 <> 0 AND (n = 0 OR o_orderkey % 13 = 0)""",
    "v_executions": """SELECT l_orderkey * 10 AS obligation_id, l_shipdate AS ran_at, concat(CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS execution_id,
        CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'passed' END AS status, l_quantity > 15 AS reviewed FROM lineitem WHERE l_returnflag <> 'A'""",
    "v_review_items": """SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 31 = 0 THEN 'retired' ELSE 'active' END AS source_status,
        CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS status, o_orderkey % 1900 = 1 AS revalidation_required,
        split_part('high,medium,low,manual', ',', CAST(o_custkey % 4 + 1 AS INT)) AS screening_priority,
        split_part('changed,impacted,moved,new,manual,unchanged', ',', CAST(o_orderkey % 6 + 1 AS INT)) AS source_change,
        concat('m', CAST(o_custkey % 40 AS STRING), '.py') AS path, o_custkey % 500 AS line,
        split_part('unreviewed,needs_information,accepted,rejected', ',', CAST(o_custkey % 4 + 1 AS INT)) AS disposition FROM orders""",
    "v_diagnostics": """SELECT l_orderkey AS item_id, CASE WHEN l_suppkey % 50 = 0 THEN 'closure.incomplete' ELSE 'review.unreviewed' END AS rule_id,
        CASE l_linenumber % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'information' END AS level FROM lineitem WHERE l_quantity > 30""",
    "v_tree_nodes": """SELECT concat(p_brand, '/', CAST(p_size AS STRING)) AS tree_id, CAST(p_size AS BIGINT) AS hazard_id, p_partkey AS event_id, p_size % 4 <> 0 AS explicit,
        split_part('basic,undeveloped,intermediate', ',', CAST(p_partkey % 3 + 1 AS INT)) AS event_type, p_partkey % 5 <> 0 AS selects FROM part""",
    "v_tree_links": """SELECT DISTINCT concat(p_brand, '/', CAST(p_size AS STRING)) AS tree_id, p_partkey AS event_id, l_orderkey AS finding_id
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_partkey % 7 <> 0""",
    "v_finding_hazards": """SELECT o_orderkey AS finding_id, CAST(o_custkey % 60 AS BIGINT) AS hazard_id FROM orders
        UNION ALL SELECT l_orderkey, CAST(p_size AS BIGINT) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1""",
    "v_finding_links": """SELECT o_orderkey AS finding_id, 'source_provenance' AS dimension FROM orders JOIN part ON p_partkey = o_orderkey % 97
        UNION ALL SELECT o_orderkey, 'component' FROM orders WHERE o_orderkey % 97 > 0 UNION ALL SELECT o_orderkey, 'hazards' FROM orders WHERE o_orderkey % 23 = 0
        UNION ALL SELECT o_orderkey, 'requirements' FROM orders WHERE o_custkey % 4 = 1 UNION ALL SELECT o_orderkey, 'guidance' FROM orders WHERE o_custkey % 3 = 0
        UNION ALL SELECT o_orderkey, 'verification_readiness' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 'sfta' FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT l_orderkey, 'interfaces' FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, 'component_relationships' FROM lineitem WHERE l_discount > 0.05
        UNION ALL SELECT l_orderkey, 'cascade_analysis' FROM lineitem WHERE l_tax > 0.06 UNION ALL SELECT l_orderkey, 'timing_and_resilience' FROM lineitem WHERE l_quantity > 45
        UNION ALL SELECT l_orderkey, 'verification' FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT l_orderkey, 'evidence' FROM lineitem WHERE l_linenumber = 5
        UNION ALL SELECT user_id, 'semantic_exposure' FROM events""",
    "v_vuln_decisions": """SELECT l_orderkey * 10 + l_linenumber AS id, split_part('affected,affected,affected,unresolved,not_affected,withdrawn', ',', CAST(l_suppkey % 6 + 1 AS INT)) AS applicability,
        CASE WHEN l_partkey % 7 = 0 THEN 'not_assessed' ELSE 'reachable' END AS reachability, CASE WHEN l_partkey % 11 = 0 THEN 'not_assessed' ELSE 'exposed' END AS exposure,
        CASE WHEN l_partkey % 13 = 0 THEN 'not_assessed' ELSE 'minor' END AS safety_impact, CASE WHEN l_orderkey % 13 = 0 THEN 'unassigned' ELSE 'attend' END AS ssvc,
        split_part('unassigned,planned,completed,accepted', ',', CAST(l_orderkey % 4 + 1 AS INT)) AS remediation, split_part('unassigned,not_affected,fixed,affected', ',', CAST(l_linenumber % 4 + 1 AS INT)) AS vex,
        CASE WHEN l_returnflag = 'R' THEN '' WHEN l_returnflag = 'A' THEN 'ev' END AS verified_by, CASE WHEN l_linestatus = 'F' THEN 'csaf' END AS csaf, CASE WHEN l_quantity > 25 THEN 'poam' ELSE '' END AS poam FROM lineitem""",
    "v_measures": """SELECT n.n_nationkey AS measure_id, n.n_regionkey AS requirement_id, avg(s.s_acctbal) AS value, 100.0 AS uncertainty, 3000.0 AS threshold
        FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_regionkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; the tables it names are passed as arguments, so no temporary views remain."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """The SQL with the derived tables that it names put before it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not names:
        return sql
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    return f"WITH {'RECURSIVE ' if 'WITH RECURSIVE' in sql else ''}{parts}" + (f", {body}" if body != sql else f" {sql}")
