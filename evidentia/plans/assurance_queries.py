"""Queries of assurance work (P, J, A, W, U, V, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import assurance as S
from evidentia.operators import quality as Q
from evidentia.plans.catalog import query
from evidentia.views import table, view


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '\.[A-Za-z0-9]+$', '') AS m FROM pages),
    q AS (SELECT page_id, regexp_replace(m, '^/+|/+$', '', 'g') AS m FROM p), r AS (SELECT page_id, m, regexp_extract(m, '([^/]*)$', 1) AS leaf FROM q)
    SELECT page_id, replace(m, '/', '.') AS module, leaf, regexp_replace(leaf, '^test_|_test$', '', 'g') AS stem FROM r""")
def p34_test_module_key(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", S.module_key(path).alias("k")).select("page_id", "k.*")


CASCADE = """WITH t AS (SELECT component_id, path, line, kind FROM v_components WHERE component_id % 2 = 0), a AS (SELECT path, line, min(component_id) AS c FROM t GROUP BY path, line HAVING count(DISTINCT component_id) = 1),
    b AS (SELECT path, kind, min(component_id) AS c FROM t GROUP BY path, kind HAVING count(DISTINCT component_id) = 1)
    SELECT v.component_id AS node, coalesce(a.c, b.c) AS component_id, CASE WHEN a.c IS NOT NULL THEN 1 WHEN b.c IS NOT NULL THEN 2 END AS method
    FROM v_components v LEFT JOIN a ON a.path = v.path AND a.line = v.line LEFT JOIN b ON b.path = v.path AND b.kind = v.kind"""


@query(CASCADE)
def j09_map_graph_nodes(spark, sf_dir):
    rows = view(spark, sf_dir, "v_components")
    nodes = rows.select(F.col("component_id").alias("node"), "path", "line", "kind")
    return S.map_cascade(nodes, rows.where("component_id % 2 = 0"), [["path", "line"], ["path", "kind"]], "component_id").select("node", "component_id", "method")


@query("""SELECT DISTINCT * FROM (SELECT CAST(finding_id AS VARCHAR) AS source, CAST(component_id AS VARCHAR) AS target, 'allocated_to' AS relation FROM v_findings
    UNION ALL SELECT CAST(finding_id AS VARCHAR), failure_class, 'may_fail_as' FROM v_findings UNION ALL SELECT CAST(obligation_id AS VARCHAR), CAST(finding_id AS VARCHAR), 'mitigates' FROM v_obligations) x""")
def j23_trace_edges(spark, sf_dir):
    findings = view(spark, sf_dir, "v_findings")
    return S.trace_edges(allocated_to=findings.select("finding_id", "component_id"), may_fail_as=findings.select("finding_id", "failure_class"), mitigates=view(spark, sf_dir, "v_obligations").select("obligation_id", "finding_id"))


@query("""WITH a AS (SELECT doc_id, max(toxic) = 1 AS excluded FROM labels GROUP BY doc_id), s AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars % 3 <> 0)
    SELECT coalesce(a.doc_id, s.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'outside' WHEN excluded AND s.doc_id IS NOT NULL THEN 'excluded_scored' WHEN excluded THEN 'excluded' WHEN s.doc_id IS NOT NULL THEN 'scored' ELSE 'unscored' END AS state
    FROM a FULL JOIN s ON a.doc_id = s.doc_id""")
def j24_population_score_join(spark, sf_dir):
    audit = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("excluded"))
    return S.score_population(audit, table(spark, sf_dir, "documents").where("n_chars % 3 <> 0"), "doc_id")


@query("""SELECT n_nationkey AS objective, count(DISTINCT c_custkey) AS n, CASE WHEN count(c_custkey) > 0 THEN 'linked' WHEN n_nationkey % 2 = 1 THEN 'not_applicable' ELSE 'unlinked' END AS state
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY n_nationkey""")
def j30_crosswalk(spark, sf_dir):
    links = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("objective"), F.col("c_custkey").alias("finding_id"))
    return S.crosswalk(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("objective")), links, F.col("objective") % 2 == 0)


TIERS = """WITH c AS (SELECT component_id, kind, name FROM v_components), t AS (SELECT component_id AS test_id, kind, name FROM v_components WHERE component_id % 3 = 0),
    m AS (SELECT t.test_id, 2 AS tier, c.component_id FROM t JOIN c ON c.name = t.name AND c.component_id % 50 = 1 UNION ALL SELECT t.test_id, 1, c.component_id FROM t JOIN c ON c.kind = t.kind AND c.component_id % 40 = 2),
    b AS (SELECT test_id, max(tier) AS tier FROM m GROUP BY test_id), g AS (SELECT test_id, tier, count(DISTINCT component_id) AS ties, min(component_id) AS component_id FROM m JOIN b USING (test_id, tier) GROUP BY test_id, tier)"""


def _tests(spark, sf_dir):
    rows = view(spark, sf_dir, "v_components").select("component_id", "kind", "name")
    tests = rows.where("component_id % 3 = 0").select(F.col("component_id").alias("test_id"), "kind", "name")
    tiers = {2: (rows.where("component_id % 50 = 1"), "name"), 1: (rows.where("component_id % 40 = 2"), "kind")}
    return tests, tiers


@query(TIERS + """ SELECT t.test_id, g.tier, CASE WHEN ties = 1 THEN g.component_id END AS component_id, CASE WHEN ties IS NULL THEN 'unmapped' WHEN ties > 1 THEN 'ambiguous' ELSE 'mapped' END AS state FROM t LEFT JOIN g ON g.test_id = t.test_id""")
def j31_attribute_tests(spark, sf_dir):
    tests, tiers = _tests(spark, sf_dir)
    return S.attribute_by(tests, "test_id", tiers, "component_id")


@query(TIERS + " SELECT test_id, tier, ties, CASE WHEN ties = 1 THEN component_id END AS component_id FROM g")
def w12_strongest_tier(spark, sf_dir):
    tests, tiers = _tests(spark, sf_dir)
    return S.strongest_by(tests, "test_id", tiers, "component_id").select("test_id", "tier", "ties", "component_id")


@query("""WITH p AS (SELECT o_orderkey AS obligation_id, o_custkey AS finding_id, o_orderpriority AS method, o_orderstatus AS status, o_custkey % 7 AS mark FROM orders WHERE o_orderkey % 10 <> 0),
    n AS (SELECT o_orderkey AS obligation_id, o_custkey AS finding_id, o_orderpriority AS method, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey % 7 END AS mark FROM orders),
    q AS (SELECT finding_id, method, arg_min(status, obligation_id) AS status, arg_min(mark, obligation_id) AS mark FROM p GROUP BY finding_id, method)
    SELECT n.obligation_id, CASE WHEN p.obligation_id IS NOT NULL THEN 'id' WHEN q.finding_id IS NOT NULL THEN 'pair' END AS via,
    CASE WHEN p.obligation_id IS NOT NULL THEN CASE WHEN p.mark = n.mark THEN p.status ELSE 'stale' END WHEN q.finding_id IS NOT NULL THEN CASE WHEN q.mark = n.mark THEN q.status ELSE 'stale' END ELSE 'new' END AS state
    FROM n LEFT JOIN p ON p.obligation_id = n.obligation_id LEFT JOIN q ON q.finding_id = n.finding_id AND q.method = n.method""")
def j35_carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obligation_id"), F.col("o_custkey").alias("finding_id"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("mark"))
    return S.carry_forward(rows.where("obligation_id % 10 <> 0"), rows.withColumn("mark", F.when(F.col("obligation_id") % 11 == 0, -1).otherwise(F.col("mark"))).drop("status"), "mark")


@query("""WITH u AS (SELECT p_partkey AS item, p_brand AS near, p_type AS far, p_name AS tag FROM part), m AS (SELECT * FROM u WHERE item % 37 = 5),
    a AS (SELECT near, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM m GROUP BY near), b AS (SELECT far, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM m GROUP BY far)
    SELECT item, CASE WHEN a.tags IS NOT NULL THEN 'near' WHEN b.tags IS NOT NULL THEN 'far' ELSE 'none' END AS tier, coalesce(a.tags, b.tags) AS tags FROM u LEFT JOIN a ON a.near = u.near LEFT JOIN b ON b.far = u.far WHERE item % 37 <> 5""")
def j43_propose_mapping(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("near"), F.col("p_type").alias("far"), F.col("p_name").alias("tag"))
    return S.propose_mapping(rows.where("item % 37 <> 5"), rows.where("item % 37 = 5"), "item", "near", "far", "tag").withColumn("tags", F.array_join("tags", ","))


@query("""WITH s AS (SELECT DISTINCT p_brand || '.' || p_type AS scope FROM part WHERE p_size < 3 UNION SELECT DISTINCT p_brand FROM part WHERE p_size = 3),
    c AS (SELECT p_partkey, p_brand || '.' || p_type || '.' || p_name AS qualname FROM part) SELECT p_partkey, scope FROM c JOIN s ON qualname = scope OR starts_with(qualname, scope || '.')""")
def j48_breaker_scope_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    scopes = part.where("p_size < 3").select(F.concat_ws(".", "p_brand", "p_type").alias("scope")).union(part.where("p_size = 3").select("p_brand")).distinct()
    items = part.select("p_partkey", F.concat_ws(".", "p_brand", "p_type", "p_name").alias("qualname"))
    return S.nested_under(items, "qualname", scopes, "scope").select("p_partkey", "scope")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p, l_returnflag AS rule FROM lineitem WHERE l_quantity > 20), a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p, l_returnflag AS rule FROM lineitem WHERE l_quantity < 40),
    j AS (SELECT coalesce(e.rule, a.rule) AS rule, e.k IS NOT NULL AS e, a.k IS NOT NULL AS a FROM e FULL JOIN a ON e.k = a.k AND e.p = a.p AND e.rule = a.rule),
    g AS (SELECT rule, grouping(rule)::INT AS whole, count(*) FILTER (WHERE e AND a) AS matched, count(*) FILTER (WHERE e AND NOT a) AS missing, count(*) FILTER (WHERE a AND NOT e) AS unexpected FROM j GROUP BY GROUPING SETS ((), (rule)))
    SELECT *, matched / (matched + unexpected) AS precision, matched / (matched + missing) AS recall FROM g""")
def a18_corpus_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("rule"), "l_quantity")
    return S.precision_recall(rows.where("l_quantity > 20"), rows.where("l_quantity < 40"), ["k", "p"], "rule")


@query("""WITH j AS (SELECT p.finding_id, c.finding_id IS NOT NULL AND p.fingerprint IS NOT DISTINCT FROM c.fingerprint AS a, c.finding_id IS NOT NULL AND p.status IS NOT DISTINCT FROM c.status AS b FROM v_prev_run p LEFT JOIN v_cur_run c ON p.finding_id = c.finding_id)
    SELECT 'fingerprint' AS field, count(*) AS n, count(*) FILTER (WHERE a) AS exact FROM j UNION ALL SELECT 'status', count(*), count(*) FILTER (WHERE b) FROM j UNION ALL SELECT '*', count(*), count(*) FILTER (WHERE a AND b) FROM j""")
def a19_claim_eval(spark, sf_dir):
    return S.claim_eval(view(spark, sf_dir, "v_prev_run"), view(spark, sf_dir, "v_cur_run"), "finding_id", ["fingerprint", "status"])


@query("""WITH b AS (SELECT l_linenumber AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT l_linenumber AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT coalesce(b.k, c.k) AS metric, c.v - b.v AS delta, CASE WHEN c.v - b.v IS NULL THEN 'incomplete' WHEN c.v - b.v >= -10 THEN 'pass' ELSE 'fail' END AS state FROM b FULL JOIN c ON b.k = c.k""")
def a23_noninferior(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("metric"), "l_returnflag").agg(F.count("*").alias("value"))
    return S.noninferior(counts.where("l_returnflag = 'R'"), counts.where("l_returnflag = 'A'"), "metric", 10)


@query("""WITH w AS (SELECT user_id, max(event_id) % 40 AS declared, user_id % 3 AS dropped, CASE WHEN user_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS sampling FROM events GROUP BY user_id), n AS (SELECT user_id, count(*) AS seen FROM events WHERE event_type <> 'error' GROUP BY user_id)
    SELECT w.user_id, declared, coalesce(seen, 0) AS seen, declared = coalesce(seen, 0) AND dropped = 0 AND sampling = 1 AS complete FROM w LEFT JOIN n ON n.user_id = w.user_id""")
def a38_collection_complete(spark, sf_dir):
    events, user = table(spark, sf_dir, "events"), F.col("user_id")
    windows = events.groupBy("user_id").agg((F.max("event_id") % 40).alias("declared")).select("user_id", "declared", (user % 3).alias("dropped"), F.when(user % 5 == 0, 0.5).otherwise(1.0).alias("sampling"))
    return S.collection_complete(windows, events.where("event_type <> 'error'"), "user_id")


@query("""SELECT stratum, count(*) AS n, count(*) FILTER (WHERE expected = predicted) / count(*) AS accuracy, count(*) FILTER (WHERE predicted AND expected) / nullif(count(*) FILTER (WHERE predicted), 0) AS kept_rate,
    count(*) FILTER (WHERE predicted AND NOT expected) / nullif(count(*) FILTER (WHERE predicted), 0) AS unsafe_rate FROM v_predictions GROUP BY stratum""")
def a48_decision_quality(spark, sf_dir):
    e, p = F.col("expected"), F.col("predicted")
    return view(spark, sf_dir, "v_predictions").groupBy("stratum").agg(F.count("*").alias("n"), (F.count_if(e == p) / F.count("*")).alias("accuracy"), F.try_divide(F.count_if(p & e), F.count_if(p)).alias("kept_rate"), F.try_divide(F.count_if(p & ~e), F.count_if(p)).alias("unsafe_rate"))


@query("""SELECT count(*) AS findings, round(100.0 * count(*) FILTER (WHERE disposition <> 'unreviewed') / count(*), 6) AS reviewed, round(100.0 * count(*) FILTER (WHERE severity > 0 AND occurrence > 0 AND detection > 0) / count(*), 6) AS rated FROM v_findings""")
def a64_outcome_scorecard(spark, sf_dir):
    rated = (F.col("severity") > 0) & (F.col("occurrence") > 0) & (F.col("detection") > 0)
    def percent(c):
        return F.round(100 * F.try_divide(F.count_if(c), F.count("*")), 6)
    return view(spark, sf_dir, "v_findings").agg(F.count("*").alias("findings"), percent(F.col("disposition") != "unreviewed").alias("reviewed"), percent(rated).alias("rated"))





@query("""WITH s AS (SELECT conv_id, turn, role FROM conversations WHERE turn % 2 = 0 OR conv_id % 2 = 0), t AS (SELECT DISTINCT conv_id, role FROM conversations)
    SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position FROM s UNION ALL SELECT conv_id, role, NULL FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = t.conv_id AND s.role = t.role)""")
def w14_ordered_sites(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return S.source_sites(rows.where("turn % 2 = 0 or conv_id % 2 = 0"), rows, "conv_id", "turn", "role")


@query("""SELECT source, target, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM v_channel_edges WHERE source IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND target IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY source, target""")
def g01_call_graph(spark, sf_dir):
    edges = view(spark, sf_dir, "v_channel_edges")
    nodes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    names = ["native_ast", "external_static", "runtime_observed"]
    return S.call_graph(nodes, **{n: edges.where(F.col("channel") == n) for n in names}).withColumn("channels", F.array_join("channels", ","))


@query("SELECT 'closure.incomplete' AS rule_id, 'error' AS level, CAST(finding_id AS VARCHAR) AS item_id, 'value not allowed' AS message FROM v_findings WHERE disposition = 'accepted' AND (severity = 0 OR occurrence = 0 OR NOT hazard_linked)")
def v05_accepted_incomplete(spark, sf_dir):
    bad = (F.col("disposition") == "accepted") & ((F.col("severity") == 0) | (F.col("occurrence") == 0) | ~F.col("hazard_linked"))
    return Q.not_allowed(view(spark, sf_dir, "v_findings"), "finding_id", bad, "closure.incomplete")


@query("""SELECT 'events.integrity' AS rule_id, 'error' AS level, CAST(event_id AS VARCHAR) AS item_id, 'value not allowed' AS message FROM (SELECT event_id, value, count(*) OVER (PARTITION BY event_id) AS n FROM events) x
    WHERE n > 1 OR value IS NULL OR value < 25 OR isnan(value) OR isinf(value)""")
def v13_event_integrity(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    repeated = events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")
    rows = S.linked_flags(events, "event_id", repeated=repeated)
    v = F.col("value")
    return Q.not_allowed(rows, "event_id", F.col("repeated") | v.isNull() | (v < 25) | F.isnan(v) | (F.abs(v) == float("inf")), "events.integrity")
