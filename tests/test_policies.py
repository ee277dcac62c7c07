"""Fixed policies, queues, gaps and campaigns: hand-made rows, and every query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from evidentia.operators import joins, policies, ranking, stats, workflow
from evidentia.plans import catalog, policy_queries

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == policy_queries.__name__)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_methods_and_stimuli(spark):
    rows = spark.createDataFrame([("interface.contract_x", "data"), ("interface.y", None), ("a.auth", "logic"), ("b", "logic"), (None, "functional"), (None, None)], "r string, c string")
    got = [r[0] for r in rows.select(policies.verification_method(F.col("r"), F.col("c"))).collect()]
    assert got == ["contract_test", "integration_test", "security_test", "property_test", "unit_test", "integration_test"]
    s = spark.createDataFrame([("stress_test", "load"), ("unknown", ""), (None, None)], "m string, t string").select(policies.stimulus(F.col("m"), F.col("t")).alias("s")).collect()
    assert [(r.s.description, r.s.injection_required) for r in s] == [
        ("Apply bounded load and resource pressure representing load.", True), ("Stimulate the documented failure condition.", False), ("Stimulate the documented failure condition.", False)]


def test_exposures_need_all_their_dimensions(spark):
    rows = spark.createDataFrame([(["state_machine", "timing_and_resilience"],), (["concurrency", "state_machine"],), ([],), (None,)], "d array<string>")
    got = [r[0] for r in rows.select(policies.compound_exposure(F.col("d"))).collect()]
    assert got == [["state_or_concurrency_near_resilience_semantics"], ["concurrent_state_transition"], [], []]


def test_review_states(spark):
    rows = [("active", False, 0, "accepted", "open"), ("active", None, None, "accepted", "resolved"), ("active", True, 2, "rejected", ""), ("active", False, 2, "unreviewed", ""), ("gone", True, 2, None, None), ("active", False, 0, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b boolean, c int, d string, e string")
    got = [tuple(r.s) for r in df.select(policies.review_state(*[F.col(c) for c in "abcde"], F.lit("go on")).alias("s")).collect()]
    assert got == [("accepted_assurance_work", "go on"), ("accepted_resolved", "none"), ("revalidation_required", "revalidate_finding"), ("blocked_by_validation", "resolve_quality_gate_diagnostics"),
                   ("historical", "none"), ("rejected", "none"), ("historical", "none")]


def test_vulnerability_stages(spark):
    full = ["affected", "yes", "yes", "minor", "act", "planned", "affected", "ref", "c", "p"]
    change = lambda **k: [k.get(f"x{i}", v) for i, v in enumerate(full)]
    rows = [full, change(x0=None), change(x0="withdrawn"), change(x0="withdrawn", x6="fixed"), change(x3=None), change(x7=""), change(x6=None, x8=None, x9=""), change(x5="accepted", x7=None)]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} string" for i in range(10)))
    got = [(r.s.stage, len(r.s.blockers)) for r in df.select(policies.vuln_stage(*[F.col(f"x{i}") for i in range(10)]).alias("s")).collect()]
    assert got == [("complete", 0), ("version_review", 1), ("publication", 1), ("version_not_affected", 0), ("priority_review", 1), ("verification", 1), ("publication", 3), ("complete", 0)]


def test_queue_order_and_what_is_left_out(spark):
    item = "finding_id int, source_status string, status string, revalidation_required boolean, screening_priority string, source_change string, path string, line int"
    rows = [(1, "active", "open", False, "low", "new", "b", 1), (2, "active", "open", False, "low", "new", "a", 9), (3, "active", "closed", False, "high", "changed", "a", 1), (4, "active", "closed", True, "low", None, None, None),
            (5, "active", "open", False, "low", "x", "a", 1), (6, "gone", "open", True, "high", "changed", "a", 1), (7, "active", "closed", None, "high", "moved", "a", 1)]
    diagnostics = spark.createDataFrame([(5, "closure", "error"), (7, "review.unreviewed", "error"), (7, "w", "warning"), (None, "w", "warning")], "item_id int, rule_id string, level string")
    got = ranking.review_queue(spark.createDataFrame(rows, item), diagnostics, 10).collect()
    assert [r.finding_id for r in got] == [4, 5, 7, 2, 1] and (got[2].errors, got[2].blocking_errors, got[2].warnings) == (1, 0, 1)
    assert [r.finding_id for r in ranking.review_queue(spark.createDataFrame(rows, item), diagnostics, 10, "high").collect()] == [7]
    assert ranking.review_queue(spark.createDataFrame([], item), diagnostics, 10).count() == 0


def test_tree_gaps_of_four_kinds(spark):
    events = spark.createDataFrame([("t", 1, "e1", True, "basic", True), ("t", 1, "e2", True, "basic", True), ("u", 2, "e3", False, "basic", True)], "tree_id string, hazard_id int, event_id string, explicit boolean, event_type string, selects boolean")
    links = spark.createDataFrame([("t", "e1", 10), ("t", "e1", 11)], "tree_id string, event_id string, finding_id int")
    named = spark.createDataFrame([(10, 1), (12, 2), (12, 2), (12, 99)], "finding_id int, hazard_id int")
    got = {tuple(r) for r in joins.tree_gaps(events, links, named, spark.createDataFrame([(1,), (2,), (3,)], "hazard_id int")).collect()}
    assert got == {("uncovered_event", "t", "e2", 1, None), ("hazard_mismatch", "t", "e1", 1, 11), ("unmapped_finding", None, None, 2, 12), ("hazard_without_tree", None, None, 3, None)}


def test_path_metrics_on_own_populations(spark):
    schema = ("predicted_path array<string>, observed_path array<string>, predicted_effects array<string>, observed_effects array<string>, duration int, deadline int, expected_breaker string, observed_breaker string, "
              "recovery int, recovery_deadline int")
    rows = [(["a", "b", "c"], ["a", "b"], ["x", "y"], ["y", "x"], 5, 5, "open", "closed", None, 3), (["a"], None, [], ["z"], 9, None, "not_applicable", "open", 2, None), ([], [], None, None, None, 4, None, None, 2, 3)]
    r = stats.path_metrics(spark.createDataFrame(rows, schema)).first()
    assert (r.path_edge_precision, r.path_edge_recall, r.effect_precision, r.effect_recall) == (0.5, 1.0, 1.0, round(2 / 3, 6))
    assert (r.exact_path_rate, r.exact_effect_rate) == (round(1 / 3, 6), round(2 / 3, 6))
    assert (r.deadline_population, r.deadline_conformance, r.breaker_population, r.breaker_accuracy, r.recovery_population, r.recovery_conformance) == (2, 0.5, 1, 0.0, 2, 0.5)
    empty = stats.path_metrics(spark.createDataFrame([], schema)).first()
    assert (empty.scenarios, empty.path_edge_precision, empty.unexpected_edges) == (0, None, 0)


def test_progress_counts_only_single_obligations(spark):
    findings = spark.createDataFrame([(1, "accepted", None), (2, "accepted", "active"), (3, "accepted", "active"), (4, "rejected", "active")], "finding_id int, disposition string, source_status string")
    o = "obligation_id int, finding_id int, assurance_status string, evidence_status string, gaps int, reviewer string, rationale string, implementation string, source_status string"
    rows = [(10, 1, "verified", "sufficient", 0, "r", "w", "implemented", "active"), (20, 2, "verified", None, 0, "r", "w", None, None), (21, 2, "verified", None, 0, "r", "w", None, "active"), (40, 4, "closed", None, 1, None, None, None, "active")]
    runs = spark.createDataFrame([(10, "passed", True), (10, "failed", None)], "obligation_id int, status string, reviewed boolean")
    r = workflow.assurance_progress(findings, spark.createDataFrame(rows, o), runs).first()
    assert (r.findings, r.cardinality_gaps, r.planning_ready, r.verified, r.applicable_obligations, r.test_required, r.implemented_tests, r.executed_obligations) == (3, 2, 1, 1, 3, 3, 1, 1)
    assert (r.planning_percent, r.unreviewed_executions, r.failed_executions, r.plan_ready) == (33.3, 1, 1, False)
    none = workflow.assurance_progress(findings.where("false"), spark.createDataFrame([], o), runs.where("false")).first()
    assert (none.findings, none.planning_percent, none.verification_complete) == (0, None, True)


def test_campaign(spark):
    plan = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 1), (3, "b", "x", 1), (4, "b", "y", 9)], "id int, repository string, decision string, frozen_at int")
    seen = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 2)], "id int, observed_at int")
    r = policies.plan_vs_outcome(plan, seen, 0.5).first()
    assert (r.early, r.largest, r.passed) == (1, 0.5, False)
    assert policies.plan_vs_outcome(plan.withColumn("frozen_at", F.lit(0)), seen, 0.5).first().passed
    assert policies.plan_vs_outcome(plan.where("false"), seen.where("false"), 0.5).first().passed is False


def test_chain_passes_over_unknown_dimensions(spark):
    links = spark.createDataFrame([(1, "sfta"), (1, "sfta"), (1, "other"), (None, "sfta")], "finding_id int, dimension string")
    got = policies.finding_chain(spark.createDataFrame([(1,), (2,)], "finding_id int"), links).orderBy("finding_id").collect()
    assert [(r.sfta, r.missing, r.completeness) for r in got] == [(True, 13, 7.1), (False, 14, 0.0)]


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for t in os.listdir(SMALL):
        base.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SMALL}/{t}'")
    found = base.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    rows = lambda names, data: sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in data), key=repr)
    want, df = rows(columns, found.fetchall()), catalog.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == want and want
