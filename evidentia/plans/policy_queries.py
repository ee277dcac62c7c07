"""Queries of fixed policies and of what findings, trees and campaigns amount to (P, J, A, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import joins as J
from evidentia.operators import policies as P
from evidentia.operators import ranking as R
from evidentia.operators import stats as S
from evidentia.operators import workflow as K
from evidentia.plans.catalog import query
from evidentia.views import table, view

RULES = ("resilience.circuit_breaker_trip,resilience.retry,storage.write,persistence.commit,state.machine,timing.order,resource.pool,detection.alert,configuration.flag,environment.var,"
         "interface.contract_drift,interface.timeout,common_cause.power,outbound.call,data.range,logic.branch")
CLASSES = "calculation,data,security,logic,functional,other"
RULED = f"""r AS (SELECT p_partkey, split_part('{RULES}', ',', CAST(p_partkey % 16 AS INT) + 1) AS rule_id, split_part('{CLASSES}', ',', CAST(p_size % 6 AS INT) + 1) AS failure_class,
    CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS trigger FROM part)"""
METHOD = """CASE WHEN regexp_matches(rule_id, '^(resilience[.]circuit_breaker_|storage[.]|persistence[.]|detection[.])') THEN 'fault_injection_test' WHEN starts_with(rule_id, 'state.') THEN 'state_transition_test'
    WHEN starts_with(rule_id, 'timing.') THEN 'concurrency_test' WHEN starts_with(rule_id, 'resource.') THEN 'stress_test' WHEN regexp_matches(rule_id, '^(configuration|environment)[.]') THEN 'configuration_inspection'
    WHEN starts_with(rule_id, 'interface.contract') THEN 'contract_test' WHEN starts_with(rule_id, 'interface.') THEN 'integration_test' WHEN starts_with(rule_id, 'common_cause.') THEN 'architecture_review'
    WHEN failure_class IN ('calculation', 'data') THEN 'property_test' WHEN failure_class = 'security' OR regexp_matches(rule_id, 'access|auth|trust|outbound') THEN 'security_test'
    WHEN failure_class = 'logic' THEN 'property_test' WHEN failure_class = 'functional' THEN 'unit_test' ELSE 'integration_test' END"""
VERBS = " ".join(f"WHEN '{m}' THEN '{v}'" for m, v in P.STIMULI.items())


@query(f"""WITH {RULED}, m AS (SELECT p_partkey, trigger, {METHOD} AS method FROM r)
    SELECT p_partkey, method, CASE method {VERBS} END || ' ' || coalesce(trigger, 'the documented failure condition') || '.' AS description,
    method IN ('fault_injection_test', 'concurrency_test', 'stress_test', 'security_test') AS injection_required FROM m""")
def p20_verification_method(spark, sf_dir):
    pick = lambda names, i: F.split_part(F.lit(names), F.lit(","), (i + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(RULES, F.col("p_partkey") % 16).alias("rule_id"), pick(CLASSES, F.col("p_size") % 6).alias("failure_class"),
                                               F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("trigger"))
    rows = rows.withColumn("method", P.verification_method(F.col("rule_id"), F.col("failure_class")))
    return rows.select("p_partkey", "method", P.stimulus(F.col("method"), F.col("trigger")).alias("s")).select("p_partkey", "method", "s.*")


#: How the query's customers come by each dimension.
DIMENSIONS = {
    "authorization_scope": "c_custkey % 2 = 0", "data_flow": "c_custkey % 3 = 0", "concurrency": "c_custkey % 5 < 2", "state_machine": "c_nationkey % 2 = 0",
    "exception_propagation": "c_nationkey % 3 = 0", "deployment_topology": "c_custkey % 7 < 3", "shared_fate": "c_nationkey % 5 < 2", "contract_semantics": "c_acctbal > 3000",
    "interfaces": "c_mktsegment IN ('BUILDING', 'MACHINERY')", "timing_and_resilience": "c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')",
}


@query(f"""WITH d AS (SELECT c_custkey, {', '.join(f'{c} AS {n}' for n, c in DIMENSIONS.items())} FROM customer)
    SELECT c_custkey, concat_ws(',', CASE WHEN authorization_scope AND contract_semantics THEN 'authorization_context_at_contract_boundary' END, CASE WHEN authorization_scope AND data_flow THEN 'authorization_context_crosses_data_flow' END,
    CASE WHEN concurrency AND state_machine THEN 'concurrent_state_transition' END, CASE WHEN contract_semantics AND interfaces THEN 'contract_at_interface_boundary' END,
    CASE WHEN contract_semantics AND data_flow THEN 'contract_carries_interprocedural_data' END, CASE WHEN exception_propagation AND state_machine THEN 'exception_during_state_transition' END,
    CASE WHEN exception_propagation AND timing_and_resilience THEN 'exception_near_resilience_or_side_effect_semantics' END, CASE WHEN deployment_topology AND shared_fate THEN 'shared_fate_on_declared_deployment' END,
    CASE WHEN (concurrency OR state_machine) AND timing_and_resilience THEN 'state_or_concurrency_near_resilience_semantics' END) AS exposures FROM d""")
def p25_compound_exposure(spark, sf_dir):
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in DIMENSIONS.items()]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(P.compound_exposure(found), ",").alias("exposures"))


DIAGNOSED = """d AS (SELECT item_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'error' AND rule_id <> 'review.unreviewed') AS blocking_errors,
    count(*) FILTER (level = 'warning') AS warnings FROM v_diagnostics GROUP BY item_id)"""


@query(f"""WITH {DIAGNOSED}, w AS (SELECT finding_id, CASE WHEN min(assurance_status) = 'verified' THEN 'resolved' ELSE 'open' END AS readiness FROM v_work_obligations GROUP BY finding_id),
    s AS (SELECT f.finding_id, CASE WHEN source_status <> 'active' THEN 'historical,none' WHEN revalidation_required THEN 'revalidation_required,revalidate_finding'
    WHEN blocking_errors > 0 THEN 'blocked_by_validation,resolve_quality_gate_diagnostics' WHEN disposition = 'unreviewed' THEN 'awaiting_finding_review,review_finding'
    WHEN disposition = 'needs_information' THEN 'needs_information,collect_missing_information' WHEN disposition = 'accepted' AND readiness = 'resolved' THEN 'accepted_resolved,none'
    WHEN disposition = 'accepted' THEN 'accepted_assurance_work,execute_test' ELSE 'rejected,none' END AS s
    FROM v_review_items f LEFT JOIN d ON item_id = f.finding_id LEFT JOIN w ON w.finding_id = f.finding_id)
    SELECT finding_id, split_part(s, ',', 1) AS state, split_part(s, ',', 2) AS next_action FROM s""")
def p27_review_state(spark, sf_dir):
    blocking = view(spark, sf_dir, "v_diagnostics").where("level = 'error' and rule_id <> 'review.unreviewed'").groupBy(F.col("item_id").alias("finding_id")).agg(F.count("*").alias("blocking"))
    ready = view(spark, sf_dir, "v_work_obligations").groupBy("finding_id").agg(F.when(F.min("assurance_status") == "verified", "resolved").otherwise("open").alias("readiness"))
    rows = view(spark, sf_dir, "v_review_items").join(blocking, "finding_id", "left").join(ready, "finding_id", "left")
    state = P.review_state(*[F.col(c) for c in ("source_status", "revalidation_required", "blocking", "disposition", "readiness")], F.lit("execute_test"))
    return rows.select("finding_id", state.alias("s")).select("finding_id", "s.*")


@query("""WITH s AS (SELECT *, coalesce(verified_by, '') = '' AS unverified, concat_ws(',', CASE WHEN vex = 'unassigned' THEN 'vex_state_required' END,
        CASE WHEN coalesce(csaf, '') = '' THEN 'csaf_publication_or_documented_nonapplicability_required' END, CASE WHEN remediation IN ('planned', 'accepted') AND coalesce(poam, '') = '' THEN 'poam_tracking_required' END) AS left_open FROM v_vuln_decisions),
    t AS (SELECT id, left_open, CASE WHEN applicability = 'unresolved' THEN 'version_review:version_applicability_unresolved'
    WHEN applicability IN ('not_affected', 'withdrawn') AND vex NOT IN ('not_affected', 'fixed') THEN 'publication:governed_vex_disposition_required' WHEN applicability IN ('not_affected', 'withdrawn') THEN 'version_not_affected:'
    WHEN reachability = 'not_assessed' THEN 'reachability_review:reachability_evidence_required' WHEN exposure = 'not_assessed' THEN 'exposure_review:deployment_exposure_evidence_required'
    WHEN safety_impact = 'not_assessed' OR ssvc = 'unassigned' THEN 'priority_review:safety_impact_and_ssvc_decision_required' WHEN remediation = 'unassigned' THEN 'remediation:authorized_remediation_or_acceptance_required'
    WHEN remediation IN ('planned', 'completed') AND unverified THEN 'verification:remediation_verification_evidence_required' WHEN left_open <> '' THEN 'publication:' || left_open ELSE 'complete:' END AS x FROM s)
    SELECT id, split_part(x, ':', 1) AS stage, split_part(x, ':', 2) AS blockers FROM t""")
def p28_vuln_stage(spark, sf_dir):
    names = ["applicability", "reachability", "exposure", "safety_impact", "ssvc", "remediation", "vex", "verified_by", "csaf", "poam"]
    stage = P.vuln_stage(*[F.col(c) for c in names])
    return view(spark, sf_dir, "v_vuln_decisions").select("id", stage.alias("s")).select("id", "s.stage", F.array_join("s.blockers", ",").alias("blockers"))


@query(f"""WITH {DIAGNOSED}, c AS (SELECT finding_id, screening_priority, source_change, path, line, revalidation_required, coalesce(errors, 0) AS errors, coalesce(blocking_errors, 0) AS blocking_errors, coalesce(warnings, 0) AS warnings, status
    FROM v_review_items LEFT JOIN d ON item_id = finding_id WHERE source_status = 'active' AND screening_priority IN ('high', 'medium', 'manual'))
    SELECT finding_id, screening_priority, source_change, path, line, revalidation_required, errors, blocking_errors, warnings FROM c WHERE NOT (status = 'closed' AND errors = 0 AND NOT revalidation_required)
    ORDER BY revalidation_required DESC, blocking_errors > 0 DESC, coalesce(nullif(list_position(['changed', 'impacted', 'moved', 'new', 'manual'], source_change), 0), 10), list_position(['high', 'medium', 'low', 'manual'], screening_priority),
    path, line, finding_id LIMIT 100""")
def w01_review_queue(spark, sf_dir):
    return R.review_queue(view(spark, sf_dir, "v_review_items"), view(spark, sf_dir, "v_diagnostics"), 100, "medium")


MAPPINGS = [
    ("m0", "*", "c0", ["base"], "unreviewed"), ("m1", "rule.*", "c1", ["safety", "base"], "approved"), ("m2", "rule.7", "c2", ["security"], "approved"),
    ("m3", "rule.1", "c3", ["base"], "independent_rejected"), ("m4", "rule.2", "c4", ["other"], "approved"), ("m5", "rule.3", "c1", ["security", "safety"], None),
]


@query("""SELECT finding_id, mapping_id, citation, profiles FROM v_findings JOIN (VALUES ('m1', 'rule.*', 'c1', 'safety'), ('m2', 'rule.7', 'c2', 'security'), ('m5', 'rule.3', 'c1', 'security,safety')) m(mapping_id, selector, citation, profiles)
    ON selector = rule_id OR selector = 'rule.*' AND starts_with(rule_id, 'rule.')""")
def j20_cite(spark, sf_dir):
    mappings = spark.createDataFrame(MAPPINGS, "mapping_id string, selector string, citation string, profiles array<string>, review_status string")
    return J.cite_profiles(view(spark, sf_dir, "v_findings"), mappings, ["security", "safety", "security"]).withColumn("profiles", F.array_join("profiles", ","))


@query("""WITH p AS (SELECT DISTINCT l.tree_id, l.event_id, l.finding_id, e.hazard_id FROM v_tree_links l JOIN v_tree_nodes e ON e.tree_id = l.tree_id AND e.event_id = l.event_id),
    h AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS hazard_id FROM part WHERE p_size <> 9 UNION SELECT 55 UNION SELECT 56)
    SELECT 'uncovered_event' AS gap_type, tree_id, event_id, hazard_id, NULL AS finding_id FROM v_tree_nodes e WHERE explicit AND selects AND event_type IN ('basic', 'undeveloped') AND NOT EXISTS (SELECT 1 FROM v_tree_links l WHERE l.tree_id = e.tree_id AND l.event_id = e.event_id)
    UNION ALL SELECT 'hazard_mismatch', tree_id, event_id, hazard_id, finding_id FROM p WHERE NOT EXISTS (SELECT 1 FROM v_finding_hazards f WHERE f.finding_id = p.finding_id AND f.hazard_id = p.hazard_id)
    UNION ALL SELECT DISTINCT 'unmapped_finding', NULL, CAST(NULL AS BIGINT), hazard_id, finding_id FROM v_finding_hazards f WHERE hazard_id IN (SELECT hazard_id FROM h) AND NOT EXISTS (SELECT 1 FROM p WHERE f.finding_id = p.finding_id AND f.hazard_id = p.hazard_id)
    UNION ALL SELECT 'hazard_without_tree', NULL, NULL, hazard_id, NULL FROM h WHERE hazard_id NOT IN (SELECT hazard_id FROM v_tree_nodes)""")
def j22_tree_gaps(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").where("p_size <> 9").select(F.col("p_size").cast("long").alias("hazard_id"))
    hazards = sizes.union(spark.range(55, 57).toDF("hazard_id"))
    return J.tree_gaps(view(spark, sf_dir, "v_tree_nodes"), view(spark, sf_dir, "v_tree_links"), view(spark, sf_dir, "v_finding_hazards"), hazards)


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn, role) AS o, list_sort(list(DISTINCT role)) AS oe, sum(coalesce(length(text), 0)) AS duration, count(*) AS n FROM conversations GROUP BY conv_id),
    s AS (SELECT o, CASE WHEN conv_id % 3 = 0 THEN o ELSE list_slice(o, 1, 2) END AS p, oe, CASE WHEN conv_id % 4 = 0 THEN ['audit', 'user'] ELSE oe END AS pe, duration, CASE WHEN conv_id % 5 <> 0 THEN 600 END AS deadline,
      split_part('open,closed,not_applicable', ',', CAST(conv_id % 3 + 1 AS INT)) AS eb, CASE WHEN n % 2 = 0 THEN 'open' ELSE 'closed' END AS ob, CASE WHEN conv_id % 7 <> 0 THEN n * 10 END AS rec, CASE WHEN conv_id % 2 = 0 THEN 50 END AS rd FROM t),
    e AS (SELECT *, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || '>' || p[i + 1])) AS ps, list_distinct(list_transform(range(1, len(o)), lambda i: o[i] || '>' || o[i + 1])) AS os FROM s),
    c AS (SELECT count(*) AS n, sum(len(ps)) AS p, sum(len(os)) AS o, sum(len(list_intersect(ps, os))) AS m, sum(len(pe)) AS ep, sum(len(oe)) AS eo, sum(len(list_intersect(pe, oe))) AS em, count(*) FILTER (p = o) AS sp, count(*) FILTER (pe = oe) AS se,
      count(deadline) AS dn, count(*) FILTER (eb <> 'not_applicable') AS bn, count(rd) AS rn, count(*) FILTER (duration <= deadline) AS dk, count(*) FILTER (eb = ob) AS bk, count(*) FILTER (rec <= rd) AS rk FROM e)
    SELECT n AS scenarios, round(m / p, 6) AS path_edge_precision, round(m / o, 6) AS path_edge_recall, round(em / ep, 6) AS effect_precision, round(em / eo, 6) AS effect_recall, round(sp / n, 6) AS exact_path_rate, round(se / n, 6) AS exact_effect_rate,
    dn AS deadline_population, bn AS breaker_population, rn AS recovery_population, round(dk / dn, 6) AS deadline_conformance, round(bk / bn, 6) AS breaker_accuracy, round(rk / rn, 6) AS recovery_conformance,
    CAST(o - m AS BIGINT) AS unexpected_edges, CAST(p - m AS BIGINT) AS unobserved_edges, CAST(eo - em AS BIGINT) AS unexpected_effects, CAST(ep - em AS BIGINT) AS unobserved_effects FROM c""")
def a16_path_metrics(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("observed_path"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("duration"), F.count("*").alias("n"))
    conv, seen = F.col("conv_id"), F.array_distinct("observed_path")
    return S.path_metrics(turns.select(
        "observed_path", F.when(conv % 3 == 0, F.col("observed_path")).otherwise(F.slice("observed_path", 1, 2)).alias("predicted_path"), seen.alias("observed_effects"),
        F.when(conv % 4 == 0, F.array(F.lit("user"), F.lit("audit"))).otherwise(seen).alias("predicted_effects"), "duration", F.when(conv % 5 != 0, 600).alias("deadline"),
        F.split_part(F.lit("open,closed,not_applicable"), F.lit(","), (conv % 3 + 1).cast("int")).alias("expected_breaker"), F.when(F.col("n") % 2 == 0, "open").otherwise("closed").alias("observed_breaker"),
        F.when(conv % 7 != 0, F.col("n") * 10).alias("recovery"), F.when(conv % 2 == 0, 50).alias("recovery_deadline")))


@query("""WITH u AS (SELECT 'mode' || CAST(l_linenumber AS VARCHAR) AS resource, sum(l_quantity) FILTER (l_returnflag = 'R') AS b, sum(l_quantity) FILTER (l_returnflag = 'A') AS c FROM lineitem GROUP BY 1)
    SELECT resource, round(c / nullif(b, 0), 9) AS ratio, CASE WHEN c / nullif(b, 0) IS NULL THEN 'incomplete' WHEN c / b <= 1.0 THEN 'pass' ELSE 'fail' END AS state FROM u""")
def a23_resource_ratios(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("mode"), F.col("l_linenumber").cast("string")).alias("resource"), "l_returnflag", "l_quantity")
    use = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy("resource").agg(F.sum("l_quantity").alias("value"))
    limits = lines.select("resource").distinct().withColumn("most", F.lit(1.0))
    return P.resource_ratios(use("R"), use("A"), limits).withColumn("ratio", F.round("ratio", 9))


CHAIN = f"""c AS (SELECT o.o_orderkey AS finding_id, {', '.join(f"coalesce(bool_or(dimension = '{d}'), false) AS {d}" for d in P.DIMENSIONS)}
    FROM orders o LEFT JOIN v_finding_links l ON l.finding_id = o.o_orderkey GROUP BY o.o_orderkey)"""
LACKS = " + ".join(f"(NOT {d})::INT" for d in P.DIMENSIONS)


def _chain(spark, sf_dir):
    return P.finding_chain(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id")), view(spark, sf_dir, "v_finding_links"))


@query(f"WITH {CHAIN} SELECT *, {LACKS} AS missing, round(100 * (14 - ({LACKS})) / 14, 1) AS completeness FROM c")
def a43_finding_chain(spark, sf_dir):
    return _chain(spark, sf_dir)


@query(f"WITH {CHAIN} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, '{p}' AS priority, count(*) FILTER (NOT {d}) AS findings FROM c" for d, p in P.DIMENSIONS.items()))
def a43_missing_dimensions(spark, sf_dir):
    return P.missing_dimensions(_chain(spark, sf_dir))


@query("""WITH a AS (SELECT finding_id FROM v_review_items WHERE source_status = 'active' AND disposition = 'accepted'), o AS (SELECT * FROM v_work_obligations WHERE source_status = 'active'),
    x AS (SELECT o.*, assurance_status IN ('verified', 'accepted_risk', 'closed', 'not_applicable') AS terminal, assurance_status IN ('confirmed', 'control_implemented', 'verification_planned', 'test_proposed', 'evidence_collected', 'partially_verified', 'verified', 'residual_risk_review')
        AND reviewer <> '' AND coalesce(rationale, '') <> '' AND gaps = 0 AS ready, finding_id IN (SELECT finding_id FROM a) AS applies, obligation_id IN (SELECT obligation_id FROM v_executions) AS ran FROM o),
    f AS (SELECT a.finding_id, count(x.finding_id) AS n, coalesce(bool_and(ready), false) AS ready, coalesce(bool_and(terminal), false) AS terminal FROM a LEFT JOIN x ON x.finding_id = a.finding_id GROUP BY a.finding_id),
    p AS (SELECT count(*) AS findings, count(*) FILTER (n <> 1) AS cardinality_gaps, count(*) FILTER (n = 1 AND ready) AS planning_ready, count(*) FILTER (n = 1 AND terminal) AS verified FROM f),
    q AS (SELECT count(*) AS active_obligations, count(*) FILTER (applies) AS applicable_obligations, count(*) FILTER (applies AND gaps > 0) AS planning_gaps, count(*) FILTER (applies AND assurance_status NOT IN ('not_applicable', 'accepted_risk')) AS test_required,
        count(*) FILTER (applies AND assurance_status NOT IN ('not_applicable', 'accepted_risk') AND implementation = 'implemented') AS implemented_tests, count(*) FILTER (applies AND assurance_status NOT IN ('not_applicable', 'accepted_risk') AND ran) AS executed_obligations,
        count(*) FILTER (applies AND evidence_status = 'sufficient') AS sufficient_evidence FROM x),
    e AS (SELECT count(*) AS executions, count(*) FILTER (NOT reviewed) AS unreviewed_executions, count(*) FILTER (status IN ('failed', 'timeout', 'error')) AS failed_executions FROM v_executions)
    SELECT *, round(100 * planning_ready / nullif(findings, 0), 1) AS planning_percent, round(100 * implemented_tests / nullif(test_required, 0), 1) AS implementation_percent, round(100 * verified / nullif(findings, 0), 1) AS verification_percent,
    cardinality_gaps = 0 AS register_complete, cardinality_gaps = 0 AND planning_ready = findings AS plan_ready, cardinality_gaps = 0 AND verified = findings AS verification_complete FROM p, q, e""")
def a45_assurance_progress(spark, sf_dir):
    return K.assurance_progress(view(spark, sf_dir, "v_review_items"), view(spark, sf_dir, "v_work_obligations"), view(spark, sf_dir, "v_executions"))


@query("""WITH p AS (SELECT doc_id AS id, repository, expected, doc_id % 5 AS frozen_at FROM v_predictions WHERE doc_id % 20 <> 0), o AS (SELECT doc_id AS id, doc_id % 7 AS observed_at FROM labels WHERE doc_id % 25 <> 0),
    a AS (SELECT id, count(*) AS p, max(frozen_at) AS f FROM p GROUP BY id), b AS (SELECT id, count(*) AS o, min(observed_at) AS t FROM o GROUP BY id),
    c AS (SELECT count(p) AS planned, count(o) AS observed, count(*) FILTER (o IS NULL) AS missing, count(*) FILTER (p IS NULL) AS unplanned, count(*) FILTER (p > 1 OR o > 1) AS repeated, count(*) FILTER (t < f) AS early FROM a FULL JOIN b ON a.id = b.id),
    r AS (SELECT repository, count(*) AS n, count(DISTINCT expected) AS d FROM p GROUP BY repository)
    SELECT c.*, g.*, missing = 0 AND unplanned = 0 AND repeated = 0 AND early = 0 AND unbalanced = 0 AND largest <= 0.4 AS passed FROM c, (SELECT count(*) AS repositories, count(*) FILTER (d < 2) AS unbalanced, max(n) / sum(n) AS largest FROM r) g""")
def a67_plan_vs_outcome(spark, sf_dir):
    plan = view(spark, sf_dir, "v_predictions").where("doc_id % 20 <> 0").select(F.col("doc_id").alias("id"), "repository", F.col("expected").alias("decision"), (F.col("doc_id") % 5).alias("frozen_at"))
    outcomes = table(spark, sf_dir, "labels").where("doc_id % 25 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("observed_at"))
    return P.plan_vs_outcome(plan, outcomes, 0.4)
