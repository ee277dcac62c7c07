"""Queries of aggregations and statistics (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import stats as S
from evidentia.plans.catalog import query
from evidentia.plans.join_queries import j01_parent_child
from evidentia.views import table, view

CONFUSION = """count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (NOT expected AND predicted) AS fp,
    count(*) FILTER (expected AND NOT predicted) AS fn, count(*) FILTER (NOT expected AND NOT predicted) AS tn"""
RATIOS = """tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity,
    (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1"""


def rounded(df, *columns, digits: int = 9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT disposition, screening_priority, failure_class, count(*) AS n, count(*) FILTER (severity BETWEEN 1 AND 10) AS rated FROM v_findings GROUP BY GROUPING SETS ((), (disposition), (screening_priority), (failure_class), (disposition, screening_priority))")
def a01_run_summary(spark, sf_dir):
    f = view(spark, sf_dir, "v_findings")
    sets = [[], [F.col("disposition")], [F.col("screening_priority")], [F.col("failure_class")], [F.col("disposition"), F.col("screening_priority")]]
    return f.groupingSets(sets, "disposition", "screening_priority", "failure_class").agg(F.count("*").alias("n"), F.count_if(F.col("severity").between(1, 10)).alias("rated"))


@query(f"WITH c AS (SELECT {CONFUSION} FROM v_predictions) SELECT tp, fp, fn, tn, {RATIOS} FROM c")
def a02_confusion(spark, sf_dir):
    return S.confusion(view(spark, sf_dir, "v_predictions"))


@query(f"""WITH c AS (SELECT stratum, {CONFUSION} FROM v_predictions GROUP BY stratum), p AS (SELECT stratum, tp, tp + fn AS n, tp / (tp + fn) AS p, 1.959963984540054 AS z FROM c)
    SELECT stratum, tp, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low,
    round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high FROM p""")
def a03_wilson(spark, sf_dir):
    c = S.confusion(view(spark, sf_dir, "v_predictions"), "stratum").withColumn("n", F.col("tp") + F.col("fn"))
    return rounded(S.with_wilson(c, "tp", "n").select("stratum", "tp", "n", "low", "high"), "low", "high")


@query("SELECT round(avg(pow(confidence - CAST(expected = predicted AS INTEGER), 2)), 9) AS brier FROM v_predictions")
def a04_brier(spark, sf_dir):
    return rounded(S.brier(view(spark, sf_dir, "v_predictions")), "brier")


@query("SELECT CAST(least(floor(confidence * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, round(avg(CAST(expected = predicted AS INTEGER)), 9) AS accuracy FROM v_predictions GROUP BY 1")
def a05_calibration_bins(spark, sf_dir):
    return rounded(S.calibration_bins(view(spark, sf_dir, "v_predictions")), "mean_confidence", "accuracy")


@query("""WITH r AS (SELECT row_number() OVER w AS k, sum(CAST(expected <> predicted AS INTEGER)) OVER w AS e, count(*) OVER () AS n FROM v_predictions WINDOW w AS (ORDER BY confidence DESC, doc_id ROWS UNBOUNDED PRECEDING))
    SELECT k, round(k / n, 9) AS coverage, round(e / k, 9) AS risk FROM r WHERE k = 1 OR k % 10 = 0 OR k = n""")
def a06_risk_coverage(spark, sf_dir):
    return rounded(S.risk_coverage(view(spark, sf_dir, "v_predictions"), "doc_id"), "coverage", "risk")


@query("""WITH b AS (SELECT stratum, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(expected = predicted AS INTEGER)) AS a FROM v_predictions GROUP BY 1, 2)
    SELECT stratum, round(sum(n * abs(c - a)) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY stratum""")
def a07_calibration_by_stratum(spark, sf_dir):
    return rounded(S.expected_calibration_error(view(spark, sf_dir, "v_predictions"), 10, "stratum"), "ece")


@query("""WITH a AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type <> 'error' AS passed, value AS latency FROM events),
    c AS (SELECT case_id, arg_min(passed, attempt) AS f, bool_or(passed) FILTER (attempt <= 3) AS y, bool_or(passed) AND bool_or(NOT passed) AS flaky, avg(latency) AS l FROM a GROUP BY case_id)
    SELECT count(*) AS cases, round(avg(CAST(f AS INTEGER)), 9) AS pass_1, round(avg(CAST(y AS INTEGER)), 9) AS pass_k, round(avg(CAST(flaky AS INTEGER)), 9) AS flaky_rate, round(avg(l), 6) AS mean_latency FROM c""")
def a08_pass_at_k(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.row_number().over(w).alias("attempt"), (F.col("event_type") != "error").alias("passed"), F.col("value").alias("latency"))
    return rounded(rounded(S.pass_at_k(a, 3), "pass_1", "pass_k", "flaky_rate"), "mean_latency", digits=6)


@query("""WITH a AS (SELECT o_custkey AS case_id, o_orderkey AS attempt, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS resolved, o_orderstatus = 'P' AS flaky, o_orderkey % 7 = 0 AS unsafe, o_totalprice AS cost, o_orderkey % 100 AS tokens FROM orders),
    f AS (SELECT case_id, arg_min(CASE WHEN resolved THEN 1 WHEN NOT resolved THEN 0 ELSE -1 END, attempt) AS r FROM a GROUP BY case_id),
    c AS (SELECT count(*) AS cases, avg(CASE WHEN r >= 0 THEN r END) AS rr FROM f)
    SELECT cases, round(rr, 9) AS resolved_rate, attempts, round(fl, 9) AS flaky_attempt_rate, round(un, 9) AS unsafe_rate, round(la, 6) AS mean_latency, round(tk, 6) AS mean_tokens, round(co, 6) AS mean_cost
    FROM c, (SELECT count(*) AS attempts, avg(CAST(flaky AS INTEGER)) AS fl, avg(CAST(unsafe AS INTEGER)) AS un, avg(tokens / 10) AS la, avg(tokens) AS tk, avg(cost) AS co FROM a)""")
def a08_attempt_rates(spark, sf_dir):
    key = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), key.alias("attempt"), F.when(key % 4 > 0, key % 4 == 1).alias("resolved"), (F.col("o_orderstatus") == "P").alias("flaky"),
                                              (key % 7 == 0).alias("unsafe"), (key % 100 / 10).alias("latency"), (key % 100).alias("tokens"), F.col("o_totalprice").alias("cost"))
    return rounded(rounded(S.attempt_rates(a), "resolved_rate", "flaky_attempt_rate", "unsafe_rate"), "mean_latency", "mean_tokens", "mean_cost", digits=6)


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS yy, count(*) FILTER (quality = 1 AND toxic <> 1) AS yn, count(*) FILTER (quality <> 1 AND toxic = 1) AS ny, count(*) FILTER (quality <> 1 AND toxic <> 1) AS nn FROM labels),
    p AS (SELECT n, (yy + nn) / n AS s, ((yy + yn) * (yy + ny) + (nn + yn) * (nn + ny)) / (n * n) AS e FROM c) SELECT n, round((s - e) / (1 - e), 9) AS kappa FROM p""")
def a09_cohen_kappa(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))  # noqa: E741
    return rounded(S.cohen_kappa(l, "a", "b"), "kappa")


ALPHA = """s AS (SELECT CAST(sum(m) AS BIGINT) AS n, sum(t) AS t, sum(m * (m - 1)) AS pairs, sum(2 * t * (m - t)) AS d FROM i) SELECT n, round(1 - (d / pairs) / (2 * t * (n - t) / (n * (n - 1))), 9) AS alpha FROM s"""


@query(f"WITH i AS (SELECT doc_id, count(*) AS m, count(*) FILTER (predicted) AS t FROM v_tool_predictions GROUP BY doc_id), {ALPHA}")
def a10_krippendorff_alpha(spark, sf_dir):
    return rounded(S.krippendorff_alpha(view(spark, sf_dir, "v_tool_predictions"), "doc_id", "predicted"), "alpha")


@query(f"WITH i AS (SELECT doc_id, count(*) AS m, count(*) FILTER (predicted) AS t FROM v_tool_predictions WHERE (doc_id + CASE tool WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END) % 4 > 0 AND (tool = 'a' OR doc_id % 7 > 0) GROUP BY doc_id), {ALPHA}")
def a10_alpha_with_gaps(spark, sf_dir):
    number = F.when(F.col("tool") == "a", 0).when(F.col("tool") == "b", 1).otherwise(2)
    rated = ((F.col("doc_id") + number) % 4 > 0) & ((F.col("tool") == "a") | (F.col("doc_id") % 7 > 0))
    # a missing rating is a null as well as a missing row
    rows = view(spark, sf_dir, "v_tool_predictions").withColumn("predicted", F.when(rated, F.col("predicted"))).where(rated | (F.col("doc_id") % 2 == 0))
    return rounded(S.krippendorff_alpha(rows, "doc_id", "predicted"), "alpha")


@query("""WITH c AS (SELECT repository, count(*) FILTER (expected = predicted) AS k, count(*) AS n, row_number() OVER (ORDER BY repository) - 1 AS no FROM v_predictions GROUP BY repository), m AS (SELECT count(*) AS m FROM c),
    d AS (SELECT r.rep, ((((r.rep * 7919 + i.i * 104729 + 7) * 1103515245) % 2147483648) >> 8) % m AS no FROM range(400) r(rep), m, range((SELECT m FROM m)) i(i)),
    x AS (SELECT rep, sum(k) / sum(n) AS x FROM d JOIN c ON c.no = d.no GROUP BY rep)
    SELECT round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high, count(*) AS reps FROM x""")
def a11_cluster_bootstrap(spark, sf_dir):
    c = view(spark, sf_dir, "v_predictions").groupBy(F.col("repository").alias("cluster")).agg(F.count_if(F.col("expected") == F.col("predicted")).alias("k"), F.count("*").alias("n"))
    return rounded(S.cluster_bootstrap(c, 400, 7), "low", "high")


@query("""WITH r AS (SELECT doc_id, tool, expected = predicted AS ok FROM v_tool_predictions),
    c AS (SELECT a.tool AS tool_a, b.tool AS tool_b, count(*) FILTER (a.ok AND NOT b.ok) AS left_only, count(*) FILTER (NOT a.ok AND b.ok) AS right_only, count(*) FILTER (a.ok = b.ok) AS agree FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.tool < b.tool GROUP BY 1, 2)
    SELECT *, round(CASE WHEN left_only + right_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(left_only, right_only) + 1),
      lambda i: exp(lgamma(left_only + right_only + 1) - lgamma(i + 1) - lgamma(left_only + right_only - i + 1) - (left_only + right_only) * ln(2))))) END, 7) AS p FROM c""")
def a13_mcnemar(spark, sf_dir):
    return rounded(S.mcnemar(view(spark, sf_dir, "v_tool_predictions")), "p", digits=7)


@query("SELECT doc_id, count(*) FILTER (predicted) AS yes FROM v_tool_predictions GROUP BY doc_id HAVING count(DISTINCT predicted) > 1")
def a14_disagreements(spark, sf_dir):
    return S.disagreements(view(spark, sf_dir, "v_tool_predictions"))


@query("""WITH s AS (SELECT s_nationkey AS participant, abs((s_acctbal - 5000) / 1500.0) AS z FROM supplier)
    SELECT participant, count(*) AS items, count(*) FILTER (z > 3) AS action, bool_and(z <= 3) AS passed FROM s GROUP BY participant""")
def a15_proficiency(spark, sf_dir):
    status = C.zscore_status(F.col("s_acctbal"), F.lit(5000.0), F.lit(1500.0))
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("participant")).agg(F.count("*").alias("items"), F.count_if(status == "action").alias("action"), F.bool_and(status != "action").alias("passed"))


@query("""WITH e AS (SELECT DISTINCT source, target FROM v_channel_edges WHERE channel = 'native_ast'), a AS (SELECT DISTINCT source, target FROM v_channel_edges WHERE channel = 'runtime_observed'),
    c AS (SELECT count(*) FILTER (e.source IS NOT NULL AND a.source IS NOT NULL) AS tp, count(*) FILTER (e.source IS NULL) AS fp, count(*) FILTER (a.source IS NULL) AS fn FROM e FULL JOIN a ON e.source = a.source AND e.target = a.target)
    SELECT tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c""")
def a17_graph_pr(spark, sf_dir):
    e = view(spark, sf_dir, "v_channel_edges")
    return S.graph_pr(e.where("channel = 'native_ast'"), e.where("channel = 'runtime_observed'"))


@query(f"""WITH v AS (SELECT *, CASE WHEN confidence >= 0.66 THEN 'high' WHEN confidence >= 0.33 THEN 'medium' ELSE 'low' END AS level FROM v_predictions), c AS (SELECT level, {CONFUSION} FROM v GROUP BY level),
    p AS (SELECT level, round(tp / nullif(tp + fp, 0), 9) AS precision, CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS no FROM c)
    SELECT level, precision, coalesce(precision <= lag(precision) OVER (ORDER BY no), true) AS in_order FROM p""")
def a20_monotone_precision(spark, sf_dir):
    level = F.when(F.col("confidence") >= 0.66, "high").when(F.col("confidence") >= 0.33, "medium").otherwise("low")
    return rounded(S.monotone_precision(view(spark, sf_dir, "v_predictions").withColumn("level", level), "level", ["high", "medium", "low"]), "precision")


@query("""SELECT rule_id, count(*) AS n, count(*) FILTER (disposition = 'accepted') AS accepted, CASE WHEN count(*) FILTER (disposition <> 'unreviewed') = 0 THEN 'unreviewed' WHEN count(*) FILTER (disposition <> 'unreviewed') < 5 THEN 'insufficient' ELSE 'observed' END AS state,
    round(100 * count(*) FILTER (disposition = 'accepted') / nullif(count(*) FILTER (disposition <> 'unreviewed'), 0), 6) AS accepted_pct FROM v_findings GROUP BY rule_id""")
def a26_hotspots(spark, sf_dir):
    reviewed, accepted = F.count_if(F.col("disposition") != "unreviewed"), F.count_if(F.col("disposition") == "accepted")
    g = view(spark, sf_dir, "v_findings").groupBy("rule_id").agg(F.count("*").alias("n"), accepted.alias("accepted"), reviewed.alias("reviewed"))
    state = F.when(F.col("reviewed") == 0, "unreviewed").when(F.col("reviewed") < 5, "insufficient").otherwise("observed")
    return g.select("rule_id", "n", "accepted", state.alias("state"), F.round(C.ratio(100 * F.col("accepted"), F.col("reviewed")), 6).alias("accepted_pct"))


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS rule, l_suppkey AS item FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY item) AS k FROM s)
    SELECT rule, count(*) AS affected, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FILTER (k <= 10) AS samples, count(*) > 50 AS over_budget FROM r GROUP BY rule""")
def a27_warning_budget(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule"), F.col("l_suppkey").alias("item")).distinct()
    return S.review_leads(s, "rule", "item", 10).select("rule", F.col("n").alias("affected"), F.col("first_items").alias("samples"), (F.col("n") > 50).alias("over_budget"))


@query("SELECT url LIKE '%?%' AS has_query, page_id % 4 AS kind, count(*) AS n, round(100 * count(*) FILTER (length(html) > 1500) / count(*), 6) AS large_pct FROM pages GROUP BY GROUPING SETS ((), (1), (2))")
def a29_inventory_summary(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.contains("url", F.lit("?")).alias("has_query"), (F.col("page_id") % 4).alias("kind"), (F.length("html") > 1500).alias("large"))
    return p.groupingSets([[], [F.col("has_query")], [F.col("kind")]], "has_query", "kind").agg(F.count("*").alias("n"), F.round(100 * F.count_if("large") / F.count("*"), 6).alias("large_pct"))


@query("SELECT event_type, error, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, value > 50 AS error FROM events) GROUP BY CUBE (event_type, error)")
def a36_telemetry_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("error", F.col("value") > 50).cube("event_type", "error").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, round(avg(CAST(error AS INTEGER)), 9) AS error_rate, quantile_disc(latency_ms, 0.95) AS p95, avg(CAST(error AS INTEGER)) <= 0.21 AND quantile_disc(latency_ms, 0.95) <= 95 AS passed FROM v_spans GROUP BY 1""")
def a37_window_health(spark, sf_dir):
    return rounded(S.window_health(view(spark, sf_dir, "v_spans").withColumn("day", F.to_date("ts").cast("string")), "day", 0.21, 95), "error_rate")


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT e.event_type, count(*) AS n, max(m) AS median, round(median(abs(value - m)), 9) AS mad, round(stddev_samp(value), 6) AS stdev, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1""")
def a39_perf_stats(spark, sf_dir):
    return rounded(rounded(S.perf_stats(table(spark, sf_dir, "events"), "event_type", "value").drop("cv_pct"), "mad"), "stdev", "mean", digits=6)


@query("""WITH f AS (SELECT arg_min(mean_value, day) AS a, arg_max(mean_value, day) AS b, count(*) AS n FROM v_receipts) SELECT n, round((b - a) / a * 100, 3) AS change_pct, round((b - a) / a * 100, 3) <= 10 AS passed FROM f""")
def a40_perf_history(spark, sf_dir):
    f = view(spark, sf_dir, "v_receipts").agg(F.count("*").alias("n"), F.min_by("mean_value", "day").alias("a"), F.max_by("mean_value", "day").alias("b"))
    return f.select("n", C.pct_change(F.col("b"), F.col("a")).alias("change_pct"), (C.pct_change(F.col("b"), F.col("a")) <= 10).alias("passed"))


FUSED = """SELECT source, target, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(DISTINCT channel) AS corroboration,
    CASE WHEN count(DISTINCT channel) >= 3 THEN 'fully_corroborated' WHEN count(DISTINCT channel) = 2 AND bool_or(channel = 'runtime_observed') THEN 'runtime_corroborated' WHEN count(DISTINCT channel) = 2 THEN 'statically_corroborated'
    WHEN bool_or(channel = 'runtime_observed') THEN 'runtime_only' WHEN bool_or(channel = 'external_static') THEN 'external_only' ELSE 'native_only' END AS classification FROM v_channel_edges GROUP BY source, target"""


@query(FUSED)
def a41_fuse_channels(spark, sf_dir):
    return S.fuse_channels(view(spark, sf_dir, "v_channel_edges"))


@query(f"""WITH f AS ({FUSED}), r AS (SELECT classification, source * 1000000 + target AS item, row_number() OVER (PARTITION BY classification ORDER BY source * 1000000 + target) AS k FROM f)
    SELECT classification, count(*) AS n, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FILTER (k <= 25) AS first_items, greatest(0, count(*) - 25) AS omitted FROM r GROUP BY classification""")
def a42_review_leads(spark, sf_dir):
    f = a41_fuse_channels(spark, sf_dir).withColumn("item", F.col("source") * 1000000 + F.col("target"))
    return S.review_leads(f, "classification", "item")


@query("""SELECT event_type, count(*) AS n, avg(value) <= 55 AS mean_ok, max(value) <= 99.5 AS peak_ok, CASE WHEN avg(value) > 55 AND max(value) > 99.5 THEN 'mean,peak' WHEN avg(value) > 55 THEN 'mean' WHEN max(value) > 99.5 THEN 'peak' ELSE '' END AS failed, avg(value) <= 55 AND max(value) <= 99.5 AS passed FROM events GROUP BY event_type""")
def a46_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.avg("value") <= 55).alias("mean_ok"), (F.max("value") <= 99.5).alias("peak_ok"))
    return S.gate(e, {"mean": F.col("mean_ok"), "peak": F.col("peak_ok")})


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS excluded, round(count(*) FILTER (quality = 0) / count(*), 9) AS exclusion_rate FROM labels")
def a47_item_quality(spark, sf_dir):
    g = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") == 0).alias("excluded"))
    return g.withColumn("exclusion_rate", F.round(C.ratio(F.col("excluded"), F.col("n")), 9))


@query("SELECT p_type, count(*) AS modules, CAST(sum(p_size) AS BIGINT) AS size, count(*) FILTER (p_size > 45) AS over_ceiling, round(100 * max(p_size) / sum(p_size), 6) AS largest_pct FROM part GROUP BY p_type")
def a54_size_ratchet(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("modules"), F.sum("p_size").alias("size"), F.count_if(F.col("p_size") > 45).alias("over_ceiling"), F.round(100 * F.max("p_size") / F.sum("p_size"), 6).alias("largest_pct"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def a55_duplicate_rate(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k"))
    return keys.agg(F.sum("k").alias("n"), (F.sum("k") - F.count("*")).alias("duplicates"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def a57_outcomes(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])


@query("""WITH o AS (SELECT finding_id, count(*) AS n FROM v_obligations GROUP BY finding_id), f AS (SELECT finding_id FROM v_findings WHERE disposition = 'accepted')
    SELECT count(*) AS accepted, count(n) AS covered, count(*) - count(n) AS uncovered, count(*) FILTER (n > 1) AS doubled, round(100 * count(n) / count(*), 6) AS coverage_pct FROM f LEFT JOIN o USING (finding_id)""")
def a62_assignment_overlap(spark, sf_dir):
    o = view(spark, sf_dir, "v_obligations").groupBy("finding_id").agg(F.count("*").alias("n"))
    f = view(spark, sf_dir, "v_findings").where("disposition = 'accepted'").select("finding_id").join(o, "finding_id", "left")
    return f.agg(F.count("*").alias("accepted"), F.count("n").alias("covered"), F.count_if(F.col("n").isNull()).alias("uncovered"), F.count_if(F.col("n") > 1).alias("doubled"), F.round(100 * F.count("n") / F.count("*"), 6).alias("coverage_pct"))


@query("""SELECT n_regionkey AS parent, CASE WHEN bool_and(n_nationkey % 2 = 0) THEN 'supported' WHEN bool_or(n_nationkey % 2 = 0) THEN 'partially_supported' ELSE 'unsupported' END AS state FROM nation GROUP BY 1""")
def a66_claim_rollup(spark, sf_dir):
    ok = F.col("n_nationkey") % 2 == 0
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.when(F.bool_and(ok), "supported").when(F.bool_or(ok), "partially_supported").otherwise("unsupported").alias("state"))


@query("""SELECT e.source, e.target, count(*) AS n FROM (SELECT p.component AS source, c.component AS target FROM v_spans c JOIN v_spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id) e GROUP BY 1, 2""")
def a33_import_summary(spark, sf_dir):
    return j01_parent_child(spark, sf_dir).groupBy("source", "target").agg(F.count("*").alias("n"))
