"""Queries of composite jobs: each runs a whole job and reports its figures as (section, key, value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import jobs
from evidentia.functions import columns as C
from evidentia.plans import aggregates, assurance_queries, claim_queries, join_queries, mapping_queries, rankings, review_queries, vulnerability_queries, workflow_queries  # noqa: F401  their SQL is used
from evidentia.plans.catalog import ORACLES, query
from evidentia.views import table, view


def figures(section: str, source: str, key: str = "key", value: str = "count(*)", group: str | None = "key") -> str:
    return f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, CAST({value} AS DOUBLE) AS value FROM {source}" + (f" GROUP BY {group}" if group else "")


def of(name: str, what: str = "*") -> str:
    """A registered query's SQL as a table."""
    return f"(SELECT {what} FROM ({ORACLES[name]}))"


RESCANNED = of("j34_merge_rescan")
REACHED = f"""WITH RECURSIVE m AS (SELECT * FROM {RESCANNED}), s AS (SELECT DISTINCT new_id % 97 AS node FROM m WHERE change IN ('changed', 'new', 'moved')),
    c AS (SELECT node, node AS caller FROM s UNION SELECT c.node, e.source FROM c JOIN v_tree_edges e ON e.target = c.caller)"""


@query(f"{REACHED} {figures('change', 'm', 'change', group='change')} UNION ALL {figures('impacted', 'm', chr(39) + 'all' + chr(39), group=None)} WHERE change = 'unchanged' AND new_id % 97 IN (SELECT caller FROM c WHERE node <> caller) UNION ALL "
       "SELECT 'violation', 'review.stale', CAST(count(*) AS DOUBLE) FROM v_prev_run p JOIN v_cur_run n USING (finding_id) WHERE p.fingerprint <> n.fingerprint")
def c01_rescan_job(spark, sf_dir):
    scan = view(spark, sf_dir, "v_cur_run").withColumn("component_id", F.col("finding_id") % 97)
    out = jobs.rescan(view(spark, sf_dir, "v_prev_run"), scan, view(spark, sf_dir, "v_tree_edges"))
    violations = out["violations"].groupBy("rule_id").agg(F.count("*").alias("n"))
    return jobs.report(change=(out["summary"], "change", "n"), impacted=(out["impacted"].agg(F.count("*").alias("n")), F.lit("all"), "n"), violation=(violations, "rule_id", "n"))


MAPPED = f"""a AS (SELECT * FROM {of('j02_map_component')}), b AS (SELECT * FROM {of('j03_map_by_path_suffix')}),
    m AS (SELECT s.*, coalesce(a.component_id, b.component_id) AS component_id, CASE WHEN a.method <> 'unmapped' THEN a.method ELSE coalesce(b.method, 'unmapped') END AS method
      FROM (SELECT span_id, trace_id, lag(span_id) OVER (PARTITION BY trace_id ORDER BY span_id) AS parent_span_id FROM v_named_spans) s LEFT JOIN a ON a.span_id = s.span_id LEFT JOIN b ON b.span_id = s.span_id AND a.method = 'unmapped'),
    e AS (SELECT p.component_id AS source, c.component_id AS target FROM m c JOIN m p ON p.span_id = c.parent_span_id AND p.trace_id = c.trace_id)"""


@query(f"""WITH {MAPPED} {figures('method', 'm', 'method', group='method')} UNION ALL
    SELECT 'alignment', CASE WHEN source IS NULL OR target IS NULL THEN 'unmapped' WHEN (source, target) IN (SELECT (source, target) FROM v_observed_edges) THEN 'corroborated' ELSE 'runtime_only' END, CAST(count(*) AS DOUBLE) FROM e GROUP BY 2""")
def c02_trace_job(spark, sf_dir):
    from pyspark.sql.window import Window

    spans = view(spark, sf_dir, "v_named_spans").withColumn("parent_span_id", F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("span_id"))).withColumn("function", F.coalesce("function_attr", "name"))
    out = jobs.trace(spans, view(spark, sf_dir, "v_named_components"), view(spark, sf_dir, "v_observed_edges"), ["component_attr", "function_attr"])
    return jobs.report(method=(out["methods"], "method", "n"), alignment=(out["alignment"], "alignment", "n"))


@query(f"""WITH x AS (SELECT * FROM {of("a41_fuse_channels")}), f AS (SELECT component_id AS c FROM v_findings)
    {figures('classification', 'x', 'classification', group='classification')} UNION ALL SELECT 'chain', CAST(n AS VARCHAR), CAST(count(*) AS DOUBLE) FROM (SELECT CASE WHEN c IN (SELECT source FROM x) THEN 0 ELSE 1 END + CASE WHEN c IN (SELECT target FROM x) THEN 0 ELSE 1 END AS n FROM f) GROUP BY n""")
def c03_fusion_job(spark, sf_dir):
    edges = view(spark, sf_dir, "v_channel_edges")
    channels = {c: edges.where(F.col("channel") == c) for c in ("native_ast", "external_static", "runtime_observed")}
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node"))
    out = jobs.fusion(nodes, channels, view(spark, sf_dir, "v_findings"))
    return jobs.report(classification=(out["leads"], "classification", "n"), chain=(out["chain"].groupBy("missing").agg(F.count("*").alias("n")), "missing", "n"))


@query(f"""WITH r AS (SELECT 'src/' || path AS path, line, tool, CASE WHEN rule_id % 3 = 0 THEN 'CWE-' || CAST(rule_id AS VARCHAR) ELSE 'r' || CAST(rule_id AS VARCHAR) END AS taxon FROM v_scan_results), p AS (SELECT * FROM {of('j06_suffix_range_map')}),
    c AS (SELECT path, line, taxon, count(DISTINCT tool) AS n FROM r GROUP BY 1, 2, 3)
    {figures('status', 'p', 'status', group='status')} UNION ALL SELECT 'clusters', status || CASE WHEN n > 1 THEN '/many' ELSE '/one' END, CAST(count(*) AS DOUBLE) FROM c JOIN p USING (path, line) GROUP BY 2""")
def c04_scan_fusion_job(spark, sf_dir):
    r = view(spark, sf_dir, "v_scan_results")
    text = lambda p: F.concat(F.lit(p), F.col("rule_id").cast("string"))
    results = r.select(F.concat(F.lit("src/"), "path").alias("path"), "line", "tool", text("r").alias("rule_id"), F.when(F.col("rule_id") % 3 == 0, F.array(text("CWE-"))).otherwise(F.array().cast("array<string>")).alias("taxa"))
    out = jobs.scan_fusion(results, view(spark, sf_dir, "v_components"))
    clusters = out["clusters"].groupBy(F.concat_ws("/", "status", F.when(F.col("multi_tool"), "many").otherwise("one")).alias("key")).agg(F.count("*").alias("n"))
    return jobs.report(status=(out["status"], "status", "n"), clusters=(clusters, "key", "n"))


RULES = [(1, "track", {}), (2, "attend", {"state": ["affected", "unresolved"]}), (3, "act", {"state": ["affected"], "exploitation": ["active"]})]


@query(f"""WITH x AS (SELECT * FROM {of('j16_vuln_applicability')}), g AS (SELECT bom_ref, advisory_id % 50 AS grp, min(CASE state WHEN 'affected' THEN 1 WHEN 'unresolved' THEN 2 WHEN 'not_affected' THEN 3 ELSE 4 END) AS r, bool_or(known_exploited) AS k FROM x GROUP BY 1, 2)
    {figures('state', 'g', "['affected', 'unresolved', 'not_affected', 'withdrawn'][r]", group='r')} UNION ALL SELECT 'outcome', CASE WHEN r = 1 AND k THEN 'act' WHEN r <= 2 THEN 'attend' ELSE 'track' END, CAST(count(*) AS DOUBLE) FROM g GROUP BY 2""")
def c05_vuln_job(spark, sf_dir):
    sbom, advisories, kev, epss = vulnerability_queries.inputs(spark, sf_dir)
    aliases = advisories.select("advisory_id", (F.col("advisory_id") % 50).alias("alias"))
    out = jobs.vulnerability(sbom, advisories, aliases, kev, epss, spark.createDataFrame(RULES, "rule_order int, outcome string, allowed map<string,array<string>>"))
    return jobs.report(state=(out["states"], "state", "n"), outcome=(out["outcomes"], "outcome", "n"))


@query(f"""WITH c AS (SELECT * FROM {of('a02_confusion')}), b AS (SELECT * FROM {of('a12_metric_bounds')}), k AS (SELECT * FROM {of('a10_krippendorff_alpha')}), e AS (SELECT sum(n * abs(mean_confidence - accuracy)) / sum(n) AS ece FROM {of('a05_calibration_bins')})
    SELECT 'figure' AS section, key, round(value, 6) AS value FROM (SELECT unnest([{{'key': 'recall', 'value': recall}}, {{'key': 'conservative_low', 'value': conservative_low}}, {{'key': 'ece', 'value': ece}}, {{'key': 'alpha', 'value': alpha}},
      {{'key': 'passed', 'value': CASE WHEN conservative_low >= 0.6 AND ece <= 0.1 AND alpha >= 0.667 AND recall >= 0.6 THEN 1.0 ELSE 0.0 END}}], recursive := true) FROM c, b, k, e)""")
def c06_benchmark_job(spark, sf_dir):
    v = jobs.benchmark(view(spark, sf_dir, "v_predictions"), view(spark, sf_dir, "v_tool_predictions"), 0.6)["verdict"]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in ("recall", "conservative_low", "ece", "alpha", "passed")])
    return v.select(F.inline(pairs)).select(F.lit("figure").alias("section"), "key", F.round("value", 6).alias("value"))


@query(f"""WITH t AS (SELECT tool, avg(CAST(expected = predicted AS INT)) AS a FROM v_tool_predictions GROUP BY tool), p AS (SELECT * FROM {of('a13_mcnemar')}), q AS (SELECT * FROM {of('a14_disagreements')})
    SELECT 'accuracy' AS section, tool AS key, round(a, 9) AS value FROM t UNION ALL SELECT 'p', tool_a || '/' || tool_b, p FROM p UNION ALL SELECT 'disagreements', 'all', CAST(count(*) AS DOUBLE) FROM q
    UNION ALL SELECT 'passed', 'all', CASE WHEN (SELECT count(*) FROM q) <= 0.25 * (SELECT count(DISTINCT doc_id) FROM v_tool_predictions) THEN 1.0 ELSE 0.0 END""")
def c07_differential_job(spark, sf_dir):
    out = jobs.differential(view(spark, sf_dir, "v_tool_predictions"), 0.25)
    v = out["verdict"]
    return jobs.report(accuracy=(out["tools"], "tool", F.round("accuracy", 9)), p=(out["pairs"], F.concat_ws("/", "tool_a", "tool_b"), F.round("p", 7)), disagreements=(v, F.lit("all"), "disagreements"), passed=(v, F.lit("all"), F.col("passed").cast("int")))


WINDOWS = "w AS (SELECT user_id, min(ts) AS started_at, min(ts) + INTERVAL 3 DAY AS ended_at FROM events GROUP BY user_id)"


@query(f"""WITH {WINDOWS}, h AS (SELECT w.user_id, count(e.event_id) AS n, avg(CAST(e.event_type = 'error' AS INT)) AS r, quantile_disc(e.value, 0.95) AS p FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= started_at AND e.ts < ended_at GROUP BY 1),
    v AS (SELECT w.user_id, count(*) FILTER (effective_at <= started_at) AS had, count(*) FILTER (effective_at > started_at AND effective_at < ended_at) AS inside FROM w LEFT JOIN v_changes c ON c.user_id = w.user_id GROUP BY 1),
    x AS (SELECT user_id, concat_ws(',', CASE WHEN had = 0 THEN 'has_version' END, CASE WHEN NOT coalesce(r <= 0.3 AND p <= 95, false) THEN 'health' END, CASE WHEN inside > 0 THEN 'one_version' END) AS failed FROM v LEFT JOIN h USING (user_id))
    SELECT 'failed' AS section, failed AS key, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY failed""")
def c08_tevv_job(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_type") == "error").alias("error"), F.col("value").alias("latency_ms"))
    windows = events.groupBy("user_id").agg(F.min("ts").alias("started_at")).withColumn("ended_at", F.col("started_at") + F.expr("interval 3 days"))
    out = jobs.tevv(events, windows, view(spark, sf_dir, "v_changes"), ["user_id"], 0.3, 95.0)
    return jobs.report(failed=(out["windows"].groupBy("failed").agg(F.count("*").alias("n")), "failed", "n"))


@query(f"""WITH l AS (SELECT * FROM {of('j37_leakage_pairs')}), m AS (SELECT * FROM {of('a23_noninferior')})
    SELECT 'leaks' AS section, reason AS key, CAST(count(*) AS DOUBLE) AS value FROM l GROUP BY reason UNION ALL SELECT 'metrics', state, CAST(count(*) AS DOUBLE) FROM m GROUP BY state
    UNION ALL SELECT 'passed', 'all', CASE WHEN (SELECT count(*) FROM l) = 0 AND (SELECT count(*) FROM m WHERE state <> 'pass') = 0 THEN 1.0 ELSE 0.0 END""")
def c09_release_job(spark, sf_dir):
    shape = lambda df, i: df.where("text is not null").select(F.col(i).alias("id"), F.md5("text").alias("content"), C.tokens(F.col("text")).alias("tokens"))
    lines = table(spark, sf_dir, "lineitem")
    value = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_linenumber").alias("metric")).agg(F.count("*").alias("value"))
    out = jobs.release(shape(table(spark, sf_dir, "documents"), "doc_id"), shape(table(spark, sf_dir, "benchmark"), "item_id"), value("R"), value("A"), 0.2, 10)
    return jobs.report(leaks=(jobs.counted(out["leaks"], "reason"), "reason", "n"), metrics=(jobs.counted(out["metrics"], "state"), "state", "n"), passed=(out["verdict"], F.lit("all"), F.col("passed").cast("int")))


@query(f"""WITH s AS (SELECT * FROM {of('a35_corroboration')}), f AS (SELECT * FROM {of('a28_families')})
    SELECT 'component' AS section, CAST(component_id AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM v_findings GROUP BY component_id UNION ALL SELECT 'families', 'all', CAST(count(*) AS DOUBLE) FROM f
    UNION ALL SELECT 'grade', CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END, score FROM s""")
def c10_diagnostics_job(spark, sf_dir):
    out = jobs.diagnostics(view(spark, sf_dir, "v_findings"), *workflow_queries.corroborated(spark, sf_dir))
    return jobs.report(component=(out["components"], "component_id", "n"), families=(out["families"].agg(F.count("*").alias("n")), F.lit("all"), "n"), grade=(out["runtime"], "grade", "score"))


@query(f"""WITH s AS (SELECT * FROM {of('w08_stratified_sample')}), b AS (SELECT (row_number() OVER (ORDER BY finding_id) - 1) // 100 AS batch FROM s),
    c AS (SELECT rule_id, failure_class, sum(CASE screening_priority WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 1 END) AS w FROM v_findings GROUP BY 1, 2), p AS (SELECT failure_class, count(*) AS n FROM v_obligations JOIN v_findings USING (finding_id) GROUP BY 1)
    SELECT 'weight' AS section, rule_id || '/' || failure_class AS key, CAST(w AS DOUBLE) AS value FROM c UNION ALL SELECT 'sample', rule_id, CAST(count(*) AS DOUBLE) FROM s GROUP BY rule_id UNION ALL SELECT 'batch', CAST(batch AS VARCHAR), CAST(count(*) AS DOUBLE) FROM b GROUP BY batch
    UNION ALL SELECT 'portfolio', failure_class, CAST(n AS DOUBLE) FROM p""")
def c11_workbench_job(spark, sf_dir):
    out = jobs.workbench(view(spark, sf_dir, "v_findings"), view(spark, sf_dir, "v_obligations"))
    portfolio = out["portfolio"].groupBy("failure_class").agg(F.sum("obligations").alias("n"))
    return jobs.report(weight=(out["clusters"], F.concat_ws("/", "rule_id", "failure_class"), "weight"), sample=(jobs.counted(out["sample"], "rule_id"), "rule_id", "n"), batch=(jobs.counted(out["batches"], "batch"), "batch", "n"), portfolio=(portfolio, "failure_class", "n"))


@query(f"""WITH d AS (SELECT * FROM {of('j32_diff_runs')}), i AS (SELECT * FROM {of('j33_invalidated')}) {figures('change', 'd', 'change', group='change')} UNION ALL SELECT 'invalidated', 'all', CAST(count(*) AS DOUBLE) FROM i
    UNION ALL SELECT 'population', CASE WHEN change = 'new' THEN 'extra' ELSE 'missing' END, CAST(count(*) AS DOUBLE) FROM d WHERE change IN ('new', 'removed') GROUP BY 2""")
def c12_pr_diff_job(spark, sf_dir):
    out = jobs.pr_diff(view(spark, sf_dir, "v_prev_run"), view(spark, sf_dir, "v_cur_run"), ["fingerprint", "status"])
    return jobs.report(change=(out["summary"], "change", "n"), invalidated=(out["invalidated"].agg(F.count("*").alias("n")), F.lit("all"), "n"), population=(jobs.counted(out["same_population"], "side"), "side", "n"))


# ---- finer results of joins whose first queries count less


@query("""WITH m AS (SELECT b.* FROM (%s) b) SELECT coalesce(new_id, old_id) AS finding_id, change, p.status AS review, c.fingerprint AS fingerprint, p.status IS NOT NULL AND change IN ('changed', 'moved', 'removed') AS revalidate
    FROM m LEFT JOIN v_prev_run p ON p.finding_id = old_id LEFT JOIN v_cur_run c ON c.finding_id = new_id""" % ORACLES["j34_merge_rescan"])
def j34_rescan_rows(spark, sf_dir):
    from evidentia.operators import joins as J

    prev, cur = view(spark, sf_dir, "v_prev_run").withColumn("review", F.col("status")), view(spark, sf_dir, "v_cur_run").drop("status")
    return J.rescan_rows(prev, cur.withColumn("mark", F.col("fingerprint")), ["review"], ["mark"]).withColumnRenamed("mark", "fingerprint")


@query(f"WITH {WINDOWS} SELECT w.user_id, started_at, count(*) AS changes, min(effective_at) AS first_change FROM w JOIN v_changes c ON c.user_id = w.user_id AND effective_at > started_at AND effective_at < ended_at GROUP BY 1, 2")
def j26_changes_inside(spark, sf_dir):
    from evidentia.operators import joins as J

    windows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("started_at")).withColumn("ended_at", F.col("started_at") + F.expr("interval 3 days"))
    return J.changes_inside(windows, view(spark, sf_dir, "v_changes"), ["user_id"])


@query("""WITH h AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, avg(CAST(event_type = 'error' AS INT)) AS error_rate, quantile_disc(value, 0.95) AS p95, count(*) AS evaluations, avg(CAST(event_id % 10 <> 0 AS INT)) AS pass_rate FROM events GROUP BY 1),
    d AS (SELECT *, abs((p95 - arg_min(p95, day) OVER ()) / arg_min(p95, day) OVER ()) AS drift FROM h)
    SELECT day, requests, round(error_rate, 9) AS error_rate, p95, evaluations, round(pass_rate, 9) AS pass_rate, round(drift, 9) AS drift, error_rate <= 0.22 AND p95 <= 95 AND drift <= 0.02 AND evaluations >= 100 AND pass_rate >= 0.88 AS passed FROM d""")
def a37_health_drift(spark, sf_dir):
    from evidentia.operators import stats as S

    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    health = S.window_health(e.select("day", (F.col("event_type") == "error").alias("error"), F.col("value").alias("latency_ms")), "day", 1.0, 1e9).drop("passed")
    out = S.health_drift(health, "day", e.select("day", (F.col("event_id") % 10 != 0).alias("passed")), {"error_rate": 0.22, "p95": 95.0, "drift": 0.02, "evaluations": 100, "pass_rate": 0.88})
    return out.withColumns({c: F.round(c, 9) for c in ("error_rate", "pass_rate", "drift")})


@query("""WITH b AS (SELECT p.p_brand AS path, l.l_partkey AS line, l.l_partkey + l.l_linenumber AS to_line, max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS executed FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3)
    SELECT c.component_id, count(*) AS branches, count(*) FILTER (executed = 1) AS taken, count(*) FILTER (executed = 1) / count(*) AS rate FROM b JOIN v_components c ON c.path = b.path AND b.line BETWEEN c.line AND c.end_line GROUP BY 1""")
def j07_branch_coverage(spark, sf_dir):
    from evidentia.operators import joins as J

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    points = lines.groupBy(F.col("p_brand").alias("path"), F.col("l_partkey").alias("line"), (F.col("l_partkey") + F.col("l_linenumber")).alias("to_line")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("executed"))
    return J.branch_coverage(points, view(spark, sf_dir, "v_components"))[0]


KINDS = ["src/a{0}.py", "tests/test_{0}.py", "web/x{0}.tsx", "web/y{0}.mjs", "a/{0}.scss", "t/{0}.html", "requirements-{0}.txt", ".github/workflows/w{0}.yml", "d/Dockerfile.{0}", "k8s/{0}.yaml", "api/openapi{0}.json", "db/migrations/{0}.txt", "docs/{0}.md",
         "out/{0}.sarif", "out/coverage{0}.xml", "out/junit{0}.xml", "conf/{0}.ini", "img/{0}.png", "other/{0}.bin"]
NAMES = ["python_source", "python_test", "typescript_source", "javascript_source", "stylesheet", "user_interface", "dependency_manifest", "ci_configuration", "container_or_deployment", "infrastructure", "api_or_data_schema", "database_schema_or_migration",
         "documentation", "static_analysis_result", "coverage_result", "test_result", "configuration", "binary_or_generated", "unclassified"]


@query(f"SELECT p_partkey, {NAMES!r}[p_partkey % {len(NAMES)} + 1] AS kind FROM part")
def p12_artifact_kind(spark, sf_dir):
    k = F.col("p_partkey")
    paths = F.array(*[F.concat(F.lit(a), k.cast("string"), F.lit(b)) for a, b in (x.split("{0}") for x in KINDS)])
    return table(spark, sf_dir, "part").select("p_partkey", C.artifact_kind(F.element_at(paths, (k % len(KINDS) + 1).cast("int"))).alias("kind"))


@query("""WITH o AS (SELECT finding_id, list(assurance_status) AS a, list(evidence_status) AS e, bool_or(implementation = 'implemented') AS i FROM v_work_obligations GROUP BY 1),
    x AS (SELECT obligation_id // 10 AS finding_id, count(*) AS n, arg_max(status, (ran_at, execution_id)) AS s, arg_max(reviewed, (ran_at, execution_id)) AS r FROM v_executions GROUP BY 1)
    SELECT f.finding_id, CASE WHEN list_contains(a, 'verified') AND list_contains(e, 'sufficient') THEN 'verified_with_sufficient_evidence' WHEN s = 'failed' THEN 'execution_failed' WHEN s = 'passed' AND r THEN 'reviewed_execution_recorded' WHEN s = 'passed' THEN 'execution_review_pending'
      WHEN coalesce(i, false) THEN 'implementation_registered' WHEN severity > 5 AND detection > 5 THEN 'candidate_tests_and_coverage' WHEN severity > 5 THEN 'candidate_tests_only' WHEN detection > 5 THEN 'coverage_observation_only' ELSE 'no_verification_signal' END AS posture
    FROM v_findings f LEFT JOIN o ON o.finding_id = f.finding_id LEFT JOIN x ON x.finding_id = f.finding_id""")
def p26_evidence_posture(spark, sf_dir):
    o = view(spark, sf_dir, "v_work_obligations").groupBy("finding_id").agg(F.collect_set("assurance_status").alias("a"), F.collect_set("evidence_status").alias("e"), F.bool_or(F.col("implementation") == "implemented").alias("i"))
    x = view(spark, sf_dir, "v_executions").groupBy(F.floor(F.col("obligation_id") / 10).alias("finding_id")).agg(F.count("*").alias("n"), F.max(F.struct("ran_at", "execution_id", "status", "reviewed")).alias("x"))
    none = F.array().cast("array<string>")
    rows = view(spark, sf_dir, "v_findings").join(o, "finding_id", "left").join(x, "finding_id", "left")
    posture = C.evidence_posture(F.coalesce("a", none), F.coalesce("e", none), F.col("x.status"), F.col("x.reviewed"), F.coalesce("n", F.lit(0)), F.coalesce("i", F.lit(False)), F.col("severity") > 5, F.col("detection") > 5)
    return rows.select("finding_id", posture.alias("posture"))
