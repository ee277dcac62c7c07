"""Queries of review work (A, J, P, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import reviews as R
from evidentia.plans.catalog import query
from evidentia.views import table, view

WEIGHT = "CASE screening_priority WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 1 END"
CLUSTERS = f"""SELECT rule_id, failure_class, count(*) AS n, sum({WEIGHT})::BIGINT AS weight, first(finding_id ORDER BY {WEIGHT} DESC, finding_id) AS representative,
    array_to_string(list_sort(list(finding_id))[1:250], ',') AS members FROM v_findings GROUP BY rule_id, failure_class"""


def _clusters(spark, sf_dir):
    return R.review_clusters(view(spark, sf_dir, "v_findings"), ["rule_id", "failure_class"]).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(CLUSTERS)
def a24_review_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"SELECT * FROM ({CLUSTERS}) c WHERE n > 1 ORDER BY weight DESC, representative LIMIT 20")
def w16_consolidation_queue(spark, sf_dir):
    return R.consolidation_queue(_clusters(spark, sf_dir), 20)


@query(f"SELECT rule_id, failure_class, count(*) AS obligations, sum({WEIGHT})::BIGINT AS weight FROM v_obligations o JOIN v_findings f ON o.finding_id = f.finding_id GROUP BY rule_id, failure_class")
def a25_evidence_portfolio(spark, sf_dir):
    return R.evidence_portfolio(view(spark, sf_dir, "v_obligations"), view(spark, sf_dir, "v_findings"), ["rule_id", "failure_class"])


@query(f"""SELECT component_id, failure_class, first(finding_id ORDER BY {WEIGHT} DESC, finding_id) AS representative, count(*) FILTER (WHERE screening_priority = 'high') AS high,
    count(*) FILTER (WHERE screening_priority = 'medium') AS medium, count(*) FILTER (WHERE screening_priority = 'low') AS low FROM v_findings GROUP BY component_id, failure_class""")
def a28_families(spark, sf_dir):
    return R.families(view(spark, sf_dir, "v_findings"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS linked, round(100.0 * count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) / count(*), 2) AS percent FROM customer")
def a30_coverage_metrics(spark, sf_dir):
    return R.share_linked(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'observed' WHEN b.k IS NULL THEN 'missing' ELSE 'unknown' END AS state
    FROM (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 10) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k""")
def a34_instrumentation_coverage(spark, sf_dir):
    expected = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("k"))
    return R.instrumentation_coverage(expected, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), "k")


@query("""SELECT o_orderpriority AS kind, count(*) FILTER (WHERE o_orderstatus = 'F') AS current, count(*) FILTER (WHERE o_orderstatus <> 'F') AS stale,
    CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'F') = 0 THEN 'current' ELSE 'stale' END AS state FROM orders GROUP BY o_orderpriority""")
def a63_freshness(spark, sf_dir):
    return R.freshness(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "kind"), "kind", F.col("o_orderstatus") == "F")


@query("""WITH p AS (SELECT event_type AS phase, sum(value) AS cost FROM events GROUP BY event_type), s AS (SELECT phase, cost, cost / (SELECT sum(cost) FROM p) * 1000 AS target FROM p)
    SELECT phase, round(cost, 2) AS cost, round(target, 4) AS target, CASE WHEN cost > target THEN 'over' ELSE 'within' END AS state FROM s""")
def a65_phase_targets(spark, sf_dir):
    phases = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.sum("value").alias("cost"))
    return R.phase_targets(phases, 1000.0).select("phase", F.round("cost", 2).alias("cost"), F.round("target", 4).alias("target"), "state")


@query("""SELECT c_custkey AS node, word FROM customer, (VALUES ('no'), ('more'), ('less'), ('late')) w(word) WHERE NOT EXISTS (SELECT 1 FROM orders
    WHERE o_custkey = c_custkey AND word = CASE o_orderkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'more' WHEN 2 THEN 'less' ELSE 'late' END)""")
def j41_guideword_gaps(spark, sf_dir):
    m = F.col("o_orderkey") % 4
    recorded = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.when(m == 0, "no").when(m == 1, "more").when(m == 2, "less").otherwise("late").alias("word")).distinct()
    return R.guideword_gaps(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), ["no", "more", "less", "late"], recorded)


@query(r"""WITH b AS (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal, min(item_id) AS item_id FROM benchmark GROUP BY 1)
    SELECT d.doc_id AS claim_id, b.item_id FROM documents d LEFT JOIN b ON lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))) = b.normal""")
def j45_context_claims(spark, sf_dir):
    normal = C.claim_text(F.col("text")).alias("normal")
    return R.context_claims(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), normal), table(spark, sf_dir, "benchmark").select("item_id", normal))


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS region, l_partkey % 97 AS component_id FROM lineitem WHERE l_returnflag = 'R')
    SELECT region, component_id FROM u WHERE region IN (SELECT region FROM u GROUP BY region HAVING count(*) > 1)""")
def j46_shared_fate(spark, sf_dir):
    return R.shared_fate(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("region"), (F.col("l_partkey") % 97).alias("component_id")))


@query("""WITH b AS (SELECT p_partkey AS k, p_size AS budget FROM part WHERE p_size <> 7) SELECT e.source, e.target, CASE WHEN x.k IS NULL OR y.k IS NULL THEN 'incomplete' WHEN y.budget > x.budget THEN 'exceeds' ELSE 'compatible' END AS state
    FROM v_tree_edges e LEFT JOIN b x ON e.source = x.k LEFT JOIN b y ON e.target = y.k""")
def j47_timing_edges(spark, sf_dir):
    budgets = table(spark, sf_dir, "part").where("p_size <> 7").select(F.col("p_partkey").alias("component_id"), F.col("p_size").alias("budget"))
    return R.timing_edges(view(spark, sf_dir, "v_tree_edges"), budgets)


@query("SELECT p_partkey, 'pypi' AS ecosystem, replace(p_name, ' ', '-') AS name, CAST(p_size AS VARCHAR) AS version FROM part")
def p05_purl_parts(spark, sf_dir):
    purl = F.concat(F.lit("pkg:PyPI/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@"), F.col("p_size").cast("string"), F.lit("?arch=any"))
    return table(spark, sf_dir, "part").select("p_partkey", C.purl_parts(purl).alias("p")).select("p_partkey", "p.*")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), 'password|secret|key') THEN 'secret' END,
    CASE WHEN regexp_matches(lower(text), '@') THEN 'contact' END) AS tags FROM documents""")
def p24_surface_tags(spark, sf_dir):
    tags = R.surface_tags(F.col("text"), {"legal": ["license", "copyright"], "secret": ["password", "secret", "key"], "contact": ["@"]})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id")
def w15_first_last(spark, sf_dir):
    return R.first_last(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""SELECT path, failure_class, count(*) AS n, array_to_string(list_sort(list(finding_id))[1:100], ',') AS members FROM v_findings f JOIN v_components c ON f.component_id = c.component_id GROUP BY path, failure_class""")
def w06_similarity_cluster(spark, sf_dir):
    rows = view(spark, sf_dir, "v_findings").join(view(spark, sf_dir, "v_components").select("component_id", "path"), "component_id")
    keys = ["path", "failure_class"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(R.first_members(rows, keys, "finding_id", 100), keys).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))
