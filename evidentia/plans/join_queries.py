"""Queries of joins (J), sets (U) and quality rules (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import joins as J
from evidentia.operators import quality as Q
from evidentia.operators import sets as U
from evidentia.plans.catalog import query
from evidentia.views import table, view

EDGES = "SELECT p.component AS source, c.component AS target, c.trace_id, c.span_id, c.parent_span_id FROM v_spans c JOIN v_spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id"


@query(EDGES)
def j01_parent_child(spark, sf_dir):
    return J.parent_child(view(spark, sf_dir, "v_spans")).select("trace_id", "span_id", "parent_span_id", "source", "target")


STATIC = "SELECT source, target FROM (VALUES ('click', 'purchase'), ('view', 'click'), ('signup', 'view'), ('click', 'click'), ('view', 'view')) s(source, target)"


@query(f"""SELECT e.span_id, e.source, e.target, CASE WHEN s.source IS NULL THEN 'runtime_only' ELSE 'corroborated' END AS alignment
    FROM ({EDGES}) e LEFT JOIN ({STATIC}) s ON e.source = s.source AND e.target = s.target""")
def j04_align_static(spark, sf_dir):
    static = spark.createDataFrame([("click", "purchase"), ("view", "click"), ("signup", "view"), ("click", "click"), ("view", "view")], "source string, target string")
    return J.align_static(j01_parent_child(spark, sf_dir), static).select("span_id", "source", "target", "alignment")


@query("""WITH m AS (SELECT r.path, r.line, c.component_id, c.end_line - c.line AS width FROM (SELECT DISTINCT path, line FROM v_scan_results) r
      LEFT JOIN v_components c ON r.path = c.path AND r.line BETWEEN c.line AND c.end_line),
    k AS (SELECT *, rank() OVER (PARTITION BY path, line ORDER BY width) AS r FROM m),
    g AS (SELECT path, line, count(component_id) AS n, min(component_id) AS c FROM k WHERE r = 1 GROUP BY path, line)
    SELECT path, line, CASE WHEN n = 0 THEN 'unmapped' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS status, CASE WHEN n = 1 THEN c END AS component_id FROM g""")
def j06_range_map(spark, sf_dir):
    points = view(spark, sf_dir, "v_scan_results").select("path", "line").distinct()
    return J.range_map(points, view(spark, sf_dir, "v_components"), ["path", "line"])


@query("""SELECT c.component_id, count(DISTINCT p.line) AS executable, count(DISTINCT CASE WHEN p.executed = 1 THEN p.line END) AS executed
    FROM v_coverage_points p JOIN v_components c ON p.path = c.path AND p.line BETWEEN c.line AND c.end_line GROUP BY c.component_id""")
def j07_coverage_by_component(spark, sf_dir):
    return J.coverage_by_component(view(spark, sf_dir, "v_coverage_points"), view(spark, sf_dir, "v_components"))


@query("""SELECT r.id, c.component_id FROM (SELECT p_partkey AS id, p_brand || ':' || p_name || ':' || CAST(p_partkey // 2 AS VARCHAR) AS ref FROM part) r
    JOIN (SELECT component_id, path || ':' || name || ':' || CAST(component_id AS VARCHAR) AS ref FROM v_components) c ON r.ref = c.ref""")
def j08_resolve_references(spark, sf_dir):
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(":", "p_brand", "p_name", F.floor(F.col("p_partkey") / 2).cast("string")).alias("ref"))
    catalog = view(spark, sf_dir, "v_components").select("component_id", F.concat_ws(":", "path", "name", F.col("component_id").cast("string")).alias("ref"))
    return J.map_unique(refs, catalog, "ref", "component_id").where("component_id is not null").select("id", "component_id")


@query("""WITH n AS (SELECT DISTINCT source, target FROM v_channel_edges WHERE channel = 'native_ast'), x AS (SELECT DISTINCT source, target FROM v_channel_edges WHERE channel = 'external_static'),
    k AS (SELECT source AS n FROM n UNION SELECT target FROM n)
    SELECT x.source, x.target, CASE WHEN n.source IS NOT NULL THEN 'corroborated' WHEN x.source IN (SELECT n FROM k) AND x.target IN (SELECT n FROM k) THEN 'external_only' ELSE 'outside' END AS state
    FROM x LEFT JOIN n ON x.source = n.source AND x.target = n.target""")
def j10_reconcile_edges(spark, sf_dir):
    e = view(spark, sf_dir, "v_channel_edges")
    return J.reconcile_edges(e.where("channel = 'external_static'"), e.where("channel = 'native_ast'"))


def _endpoint(column: str) -> str:
    p = f"regexp_replace(regexp_replace(trim({column}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[?#].*$', '')"
    p = f"regexp_replace({p}, '/+', '/', 'g')"
    return f"CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/$', '') ELSE {p} END"


PATHS = f"c AS (SELECT endpoint_id, method, {_endpoint('url')} AS path FROM v_clients), r AS (SELECT route_id, method, {_endpoint('url')} AS path FROM v_routes), " \
    "m AS (SELECT c.endpoint_id, r.route_id, c.path FROM c JOIN r ON c.path = r.path WHERE c.path LIKE '/%' AND (c.method = 'UNKNOWN' OR r.method = 'ANY' OR c.method = r.method)), " \
    "x AS (SELECT endpoint_id, path FROM c WHERE path LIKE '/%' AND path IN (SELECT path FROM r) AND endpoint_id NOT IN (SELECT endpoint_id FROM m))"


@query(f"WITH {PATHS} SELECT endpoint_id, route_id, path FROM m")
def j11_match_endpoints(spark, sf_dir):
    return J.match_endpoints(view(spark, sf_dir, "v_clients"), view(spark, sf_dir, "v_routes"))


@query(f"WITH {PATHS} SELECT endpoint_id, path FROM x")
def j12_method_mismatch(spark, sf_dir):
    return J.method_mismatch(view(spark, sf_dir, "v_clients"), view(spark, sf_dir, "v_routes"))


@query(f"""WITH {PATHS} SELECT 'client' AS side, endpoint_id AS id FROM c WHERE endpoint_id NOT IN (SELECT endpoint_id FROM m) AND endpoint_id NOT IN (SELECT endpoint_id FROM x)
    UNION ALL SELECT 'route', route_id FROM r WHERE route_id NOT IN (SELECT route_id FROM m)""")
def j13_unmatched_endpoints(spark, sf_dir):
    return J.unmatched_endpoints(view(spark, sf_dir, "v_clients"), view(spark, sf_dir, "v_routes"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' END AS decision FROM pages")
def j15_apply_dispositions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    decisions = pages.where("page_id % 5 < 2").select("page_id", F.when(F.col("page_id") % 5 == 0, "accepted").otherwise("rejected").alias("decision"))
    return J.apply_dispositions(pages.select("page_id"), decisions, ["page_id"])[0]


@query("""SELECT bom_ref, advisory_id, CASE WHEN s.version >= introduced AND s.version < fixed THEN 'affected' ELSE 'not_affected' END AS state
    FROM v_sbom s JOIN v_advisories a ON translate(s.package, '_.', '--') = translate(a.package, '_.', '--')""")
def j16_vuln_match(spark, sf_dir):
    return J.vuln_match(view(spark, sf_dir, "v_sbom"), view(spark, sf_dir, "v_advisories"))


@query("""SELECT coalesce(a.id, k.id, e.id) AS id, a.id IS NOT NULL AS in_base, k.id IS NOT NULL AS in_kev, e.id IS NOT NULL AS in_epss, k.due, e.score
    FROM (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 0) a FULL JOIN (SELECT p_partkey AS id, p_brand AS due FROM part WHERE p_partkey % 7 = 0) k ON a.id = k.id
    FULL JOIN (SELECT p_partkey AS id, p_retailprice AS score FROM part WHERE p_partkey % 3 = 0) e ON coalesce(a.id, k.id) = e.id""")
def j18_merge_intel(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return J.merge_intel(part.where("id % 5 = 0").select("id"), kev=part.where("id % 7 = 0").select("id", F.col("p_brand").alias("due")), epss=part.where("id % 3 = 0").select("id", F.col("p_retailprice").alias("score")))


@query("""SELECT id, CASE WHEN exploitation = 'active' AND automatable = 'yes' THEN 'act' WHEN exploitation = 'active' THEN 'attend' WHEN automatable = 'yes' THEN 'track_closely' ELSE 'track' END AS outcome FROM v_decision_obs""")
def j19_decision_table(spark, sf_dir):
    rules = spark.createDataFrame([(1, "track", {}), (2, "track_closely", {"automatable": ["yes"]}), (3, "attend", {"exploitation": ["active"]}), (4, "act", {"exploitation": ["active"], "automatable": ["yes"]})],
                                  "rule_order int, outcome string, allowed map<string,array<string>>")
    return J.decision_table(view(spark, sf_dir, "v_decision_obs"), rules, ["exploitation", "automatable"]).select("id", "outcome")


@query("""WITH r AS (SELECT p_partkey AS ord, 'o' || CAST(p_partkey AS VARCHAR) AS outcome, p_brand AS brand, p_size AS size, p_partkey % 3 AS n FROM part),
    m AS (SELECT p_partkey, ord, r.outcome FROM part JOIN r ON (n = 0 OR brand = p_brand) AND (n = 1 OR size = p_size OR size + 1 = p_size) WHERE n < 2 OR (brand = p_brand AND (size = p_size OR size + 1 = p_size)))
    SELECT p.p_partkey AS id, CASE WHEN p_size % 13 = 0 THEN 'undecided' ELSE coalesce(max_by(outcome, ord), 'undecided') END AS outcome FROM part p LEFT JOIN m USING (p_partkey) GROUP BY p.p_partkey, p_size""")
def j19_rules_of_a_table(spark, sf_dir):
    """Every part is a rule too: on its size and the next one, its brand, or both; sizes that 13 divides are unknown."""
    part = table(spark, sf_dir, "part")
    size, brand = F.array(F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")), F.array("p_brand")
    allowed = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("size"), size)).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("brand"), brand)).otherwise(F.create_map(F.lit("size"), size, F.lit("brand"), brand))
    rules = part.select(F.col("p_partkey").alias("rule_order"), F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("outcome"), allowed.alias("allowed"))
    obs = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 13 != 0, F.col("p_size").cast("string")).alias("size"))
    return J.decision_table(obs, rules, ["size", "brand"]).select("id", "outcome")


@query("""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired, count(*) FILTER (b IS NULL) AS base_only, count(*) FILTER (a IS NULL) AS current_only, CAST(0 AS BIGINT) AS repeated, false AS comparable
    FROM (SELECT doc_id AS a FROM labels WHERE doc_id % 9 <> 0) FULL JOIN (SELECT doc_id AS b FROM labels WHERE doc_id % 11 <> 0) ON a = b""")
def j25_paired_cohort(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select("doc_id")
    return J.paired_cohort(ids.where("doc_id % 9 <> 0"), ids.where("doc_id % 11 <> 0"), "doc_id")


@query("""WITH k AS (SELECT DISTINCT l_suppkey AS c, l_linenumber AS i FROM lineitem WHERE NOT (l_suppkey % 5 = 0 AND l_linenumber = 1)), d AS (SELECT s_suppkey AS c, s_suppkey % 7 = 0 AS hidden, s_suppkey % 3 = 0 AS other, s_suppkey % 11 = 0 AS twice FROM supplier),
    p AS (SELECT a.c AS base, b.c AS current, a.hidden OR b.hidden AS h, a.other <> b.other AS o, a.twice OR b.twice AS t FROM d a JOIN d b ON b.c = a.c + 1),
    n AS (SELECT base, current, (SELECT count(*) FROM k WHERE c = base) AS x, (SELECT count(*) FROM k WHERE c = current) AS y, (SELECT count(*) FROM k k1 JOIN k k2 ON k1.i = k2.i WHERE k1.c = base AND k2.c = current) AS z FROM p),
    r AS (SELECT base, current, CASE WHEN h THEN 'unknown digest' WHEN o THEN 'other digest' WHEN t THEN 'repeated case' WHEN z = 0 THEN 'no shared case' WHEN z <> x OR z <> y THEN 'other cases' ELSE '' END AS reason FROM p JOIN n USING (base, current))
    SELECT base, current, reason = '' AS comparable, reason FROM r""")
def j25_like_for_like(spark, sf_dir):
    """Suppliers are cohorts whose cases are line numbers; each is compared with the next."""
    c = F.col("s_suppkey")
    cohorts = table(spark, sf_dir, "supplier").select(c.alias("cohort"), F.when(c % 7 == 0, "0" * 64).otherwise(F.sha2(F.lit("d"), 256)).alias("dataset_sha256"), F.sha2((c % 3 == 0).cast("string"), 256).alias("oracle_sha256"))
    cases = table(spark, sf_dir, "lineitem").where("not (l_suppkey % 5 = 0 and l_linenumber = 1)").select(F.col("l_suppkey").alias("cohort"), F.col("l_linenumber").cast("string").alias("id")).distinct()
    twice = cases.where("cohort % 11 = 0")
    pairs = cohorts.select(F.col("cohort").alias("base")).join(cohorts.select(F.col("cohort").alias("current"), (F.col("cohort") - 1).alias("base")), "base")
    return J.like_for_like(cohorts, cases.unionByName(twice), pairs)


@query("""SELECT e.event_id, (SELECT max_by(c.version, (c.effective_at, c.version)) FROM v_changes c WHERE c.user_id = e.user_id AND c.effective_at <= e.ts) AS version FROM events e""")
def j26_version_as_of(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return J.version_as_of(events, view(spark, sf_dir, "v_changes"), ["user_id"]).select("event_id", "version")


@query("""WITH w AS (SELECT user_id, min(ts) AS started_at, min(ts) + INTERVAL 3 DAY AS ended_at FROM events GROUP BY user_id)
    SELECT w.user_id, count(*) AS n FROM events e JOIN w ON e.user_id = w.user_id AND e.ts >= w.started_at AND e.ts < w.ended_at GROUP BY w.user_id""")
def j27_events_in_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    windows = events.groupBy("user_id").agg(F.min("ts").alias("started_at")).withColumn("ended_at", F.expr("started_at + interval 3 days"))
    return J.events_in_windows(events, windows, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, o_orderdate AS effective_at, o_orderkey AS version, o_orderkey - o_orderkey % 3 AS previous_version FROM orders),
    l AS (SELECT *, lag(version) OVER w AS v, lag(effective_at) OVER w AS t FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY effective_at, version))
    SELECT o_custkey, version, v IS NULL OR v = previous_version AS linked, t IS NULL OR t < effective_at AS increasing FROM l""")
def j28_change_chain(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("effective_at"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") - F.col("o_orderkey") % 3).alias("previous_version"))
    return J.change_chain(c, ["o_custkey"]).select("o_custkey", "version", "linked", "increasing")


@query("""SELECT coalesce(p.finding_id, c.finding_id) AS finding_id, CASE WHEN p.finding_id IS NULL THEN 'new' WHEN c.finding_id IS NULL THEN 'removed' WHEN p.fingerprint <> c.fingerprint OR p.status <> c.status THEN 'changed' ELSE 'same' END AS change,
    CASE WHEN p.finding_id IS NOT NULL AND c.finding_id IS NOT NULL AND p.fingerprint <> c.fingerprint THEN 'fingerprint' ELSE '' END AS fields FROM v_prev_run p FULL JOIN v_cur_run c ON p.finding_id = c.finding_id""")
def j32_diff_runs(spark, sf_dir):
    return J.diff_runs(view(spark, sf_dir, "v_prev_run"), view(spark, sf_dir, "v_cur_run"), "finding_id", ["fingerprint", "status"])


@query("SELECT p.finding_id FROM v_prev_run p JOIN v_cur_run c ON p.finding_id = c.finding_id WHERE p.status = 'F' AND p.fingerprint <> c.fingerprint")
def j33_invalidated(spark, sf_dir):
    p, c = view(spark, sf_dir, "v_prev_run"), view(spark, sf_dir, "v_cur_run").select("finding_id", F.col("fingerprint").alias("now"))
    return p.where("status = 'F'").join(c, "finding_id").where("fingerprint <> now").select("finding_id")


@query("""WITH b AS (SELECT p.finding_id AS o, p.fingerprint AS om, c.finding_id AS n, c.fingerprint AS nm FROM v_prev_run p FULL JOIN v_cur_run c ON p.finding_id = c.finding_id),
    g AS (SELECT om, min(o) AS o FROM b WHERE n IS NULL GROUP BY om HAVING count(*) = 1), k AS (SELECT nm, min(n) AS n FROM b WHERE o IS NULL GROUP BY nm HAVING count(*) = 1),
    m AS (SELECT g.o, k.n FROM g JOIN k ON g.om = k.nm)
    SELECT o AS old_id, n AS new_id, CASE WHEN om = nm THEN 'unchanged' ELSE 'changed' END AS change FROM b WHERE o IS NOT NULL AND n IS NOT NULL UNION ALL SELECT o, n, 'moved' FROM m
    UNION ALL SELECT o, NULL, 'removed' FROM b WHERE n IS NULL AND o NOT IN (SELECT o FROM m) UNION ALL SELECT NULL, n, 'new' FROM b WHERE o IS NULL AND n NOT IN (SELECT n FROM m)""")
def j34_merge_rescan(spark, sf_dir):
    return J.merge_rescan(view(spark, sf_dir, "v_prev_run"), view(spark, sf_dir, "v_cur_run"))


@query("""WITH p AS (SELECT a.decision, 'c1' AS condition, a.outcome <> b.outcome AS x FROM v_vectors a JOIN v_vectors b ON a.decision = b.decision AND a.c1 AND NOT b.c1 AND a.c2 = b.c2 AND a.c3 = b.c3
      UNION ALL SELECT a.decision, 'c2', a.outcome <> b.outcome FROM v_vectors a JOIN v_vectors b ON a.decision = b.decision AND a.c2 AND NOT b.c2 AND a.c1 = b.c1 AND a.c3 = b.c3
      UNION ALL SELECT a.decision, 'c3', a.outcome <> b.outcome FROM v_vectors a JOIN v_vectors b ON a.decision = b.decision AND a.c3 AND NOT b.c3 AND a.c1 = b.c1 AND a.c2 = b.c2)
    SELECT d.decision, c.condition, coalesce(bool_or(x), false) AS covered FROM (SELECT DISTINCT decision FROM v_vectors) d CROSS JOIN (VALUES ('c1'), ('c2'), ('c3')) c(condition)
    LEFT JOIN p ON p.decision = d.decision AND p.condition = c.condition GROUP BY d.decision, c.condition""")
def j38_mcdc_pairs(spark, sf_dir):
    return J.mcdc_pairs(view(spark, sf_dir, "v_vectors"), ["c1", "c2", "c3"])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 13 <> 0)")
def j40_unknown_refs(spark, sf_dir):
    catalog = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return J.unknown_refs(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), catalog, "l_partkey")


@query("""SELECT coalesce(e.adapter, o.adapter) AS adapter, count(e.entity) AS expected, count(o.entity) AS observed, count(*) FILTER (o.entity IS NULL) AS missing, count(*) FILTER (e.entity IS NULL) AS unexpected
    FROM (SELECT DISTINCT l_returnflag AS adapter, l_partkey AS entity FROM lineitem WHERE l_quantity > 10) e FULL JOIN (SELECT DISTINCT l_returnflag AS adapter, l_partkey AS entity FROM lineitem WHERE l_quantity < 40) o
    ON e.adapter = o.adapter AND e.entity = o.entity GROUP BY 1""")
def j42_accounting(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("adapter"), F.col("l_partkey").alias("entity"), "l_quantity")
    return J.accounting(li.where("l_quantity > 10"), li.where("l_quantity < 40"), ["adapter", "entity"])


@query("SELECT requirement_id, bool_and(coalesce(value - uncertainty >= threshold, false)) AS satisfied FROM v_measures GROUP BY requirement_id")
def j49_requirement_satisfaction(spark, sf_dir):
    ok = C.measure_pass(F.col("value"), F.col("uncertainty"), F.col("threshold"), F.lit("minimum"))
    return view(spark, sf_dir, "v_measures").groupBy("requirement_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("satisfied"))


@query("""SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN a.source IS NULL THEN 'right' WHEN b.source IS NULL THEN 'left' ELSE 'both' END AS side
    FROM (SELECT DISTINCT source, target FROM v_channel_edges WHERE channel = 'native_ast') a FULL JOIN (SELECT DISTINCT source, target FROM v_channel_edges WHERE channel = 'runtime_observed') b ON a.source = b.source AND a.target = b.target""")
def u01_edge_set_ops(spark, sf_dir):
    e = view(spark, sf_dir, "v_channel_edges")
    return U.edge_set_ops(e.where("channel = 'native_ast'"), e.where("channel = 'runtime_observed'"))


@query("SELECT event_id, user_id FROM events")
def u02_append_new(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return U.append_new(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0 or event_id % 3 = 0"), ["event_id"])


@query("SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS evidence, min(l_orderkey) AS first_evidence FROM lineitem GROUP BY l_suppkey, l_partkey")
def u03_merge_evidence(spark, sf_dir):
    return U.merge_evidence(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], "l_orderkey")


@query("""SELECT doc_id, 'missing' AS side FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id, 'extra' FROM labels WHERE quality = 0 AND toxic = 0""")
def u04_population_equal(spark, sf_dir):
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return U.population_equal(l.where("quality = 1").select("doc_id"), l.where("quality = 1 and toxic = 0 or quality = 0 and toxic = 0").select("doc_id"))


@query("SELECT 'ids.duplicate' AS rule_id, 'error' AS level, l_orderkey || '/' || l_linenumber AS item_id, 'identifier repeats' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def v01_duplicate_ids(spark, sf_dir):
    return Q.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT 'values.range' AS rule_id, 'error' AS level, CAST(finding_id AS VARCHAR) AS item_id, 'value not allowed' AS message FROM v_findings WHERE NOT severity BETWEEN 1 AND 10")
def v02_not_allowed(spark, sf_dir):
    return Q.not_allowed(view(spark, sf_dir, "v_findings"), "finding_id", ~F.col("severity").between(1, 10))


@query("SELECT 'refs.dangling' AS rule_id, 'error' AS level, CAST(l_orderkey AS VARCHAR) AS item_id, 'reference has no target' AS message FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)")
def v03_dangling(spark, sf_dir):
    catalog = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return Q.dangling(table(spark, sf_dir, "lineitem"), "l_orderkey", catalog, "l_suppkey")


@query("SELECT 'catalog.unused' AS rule_id, 'warning' AS level, CAST(c_custkey AS VARCHAR) AS item_id, 'nothing links to it' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def v04_unused(spark, sf_dir):
    return Q.unused(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", table(spark, sf_dir, "orders"))


@query("""SELECT 'obligations.cardinality' AS rule_id, 'error' AS level, CAST(f.finding_id AS VARCHAR) AS item_id, 'not exactly one' AS message FROM v_findings f
    LEFT JOIN (SELECT finding_id, count(*) AS n FROM v_obligations GROUP BY finding_id) o ON f.finding_id = o.finding_id WHERE f.disposition = 'accepted' AND coalesce(n, 0) <> 1""")
def v08_cardinality(spark, sf_dir):
    return Q.cardinality(view(spark, sf_dir, "v_findings").where("disposition = 'accepted'"), view(spark, sf_dir, "v_obligations"), "finding_id")


@query("SELECT 'review.stale' AS rule_id, 'warning' AS level, CAST(p.finding_id AS VARCHAR) AS item_id, 'reviewed version is not current' AS message FROM v_prev_run p JOIN v_cur_run c ON p.finding_id = c.finding_id WHERE p.fingerprint <> c.fingerprint")
def v07_stale(spark, sf_dir):
    return Q.stale(view(spark, sf_dir, "v_prev_run"), view(spark, sf_dir, "v_cur_run"), "finding_id", "fingerprint")
