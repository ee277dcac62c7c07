"""Queries of queues and samples (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.columns import priority_score
from evidentia.operators import ranking as R
from evidentia.plans.catalog import query
from evidentia.views import table, view

SCORE = "CASE screening_priority WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 1 END"


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "v_findings").withColumn("score", priority_score(F.col("screening_priority")))


@query(f"""WITH r AS (SELECT component_id, failure_class, finding_id, CAST({SCORE} AS BIGINT) AS score, row_number() OVER (PARTITION BY component_id, failure_class ORDER BY {SCORE} DESC, finding_id) AS k,
    count(*) OVER (PARTITION BY component_id, failure_class) AS members FROM v_findings) SELECT component_id, failure_class, finding_id, score, members FROM r WHERE k = 1""")
def w02_group_families(spark, sf_dir):
    return R.families(view(spark, sf_dir, "v_findings"))


@query(f"""WITH r AS (SELECT finding_id, component_id, hazard_linked, sum(CASE WHEN hazard_linked THEN 0 ELSE 1 END) OVER (PARTITION BY component_id ORDER BY {SCORE} DESC, finding_id ROWS UNBOUNDED PRECEDING) AS n FROM v_findings)
    SELECT finding_id, component_id FROM r WHERE hazard_linked OR n <= 3""")
def w03_cap_per_component(spark, sf_dir):
    return R.cap_per_component(_scored(spark, sf_dir), 3, F.col("hazard_linked")).select("finding_id", "component_id")


@query(f"SELECT finding_id, {SCORE} AS score, row_number() OVER (PARTITION BY {SCORE}, component_id ORDER BY finding_id) AS round FROM v_findings")
def w04_diversify(spark, sf_dir):
    return R.diversify(_scored(spark, sf_dir)).select("finding_id", "score", "round")


@query(f"""WITH r AS (SELECT finding_id, {SCORE} AS score, CAST(CASE WHEN revalidation_required AND hazard_linked THEN 0 WHEN row_number() OVER (PARTITION BY revalidation_required AND hazard_linked, screening_priority ORDER BY finding_id) <= 20 THEN 1 ELSE 2 END AS BIGINT) AS phase FROM v_findings)
    SELECT finding_id, phase FROM r ORDER BY phase, score DESC, finding_id LIMIT 200""")
def w05_priority_reserve(spark, sf_dir):
    return R.priority_reserve(_scored(spark, sf_dir).withColumn("protected", F.col("revalidation_required") & F.col("hazard_linked")), 200)


@query(f"""WITH r AS (SELECT component_id, finding_id, {SCORE} AS score, row_number() OVER (PARTITION BY component_id ORDER BY {SCORE} DESC, finding_id) > 1 AS again FROM v_findings)
    SELECT component_id, finding_id, again FROM r ORDER BY again, score DESC, finding_id LIMIT 150""")
def w07_component_diverse(spark, sf_dir):
    return R.component_diverse(_scored(spark, sf_dir), 150)


@query("""WITH s AS (SELECT rule_id, least(count(*), greatest(5, least(30, ceil(2 * log2(count(*) + 1))))) AS target FROM v_findings GROUP BY 1), a AS (SELECT rule_id, screening_priority, finding_id, row_number() OVER (PARTITION BY rule_id, screening_priority ORDER BY finding_id) AS round FROM v_findings),
    b AS (SELECT rule_id, finding_id, row_number() OVER (PARTITION BY rule_id ORDER BY round, screening_priority, finding_id) AS place FROM a) SELECT rule_id, finding_id, place FROM b JOIN s USING (rule_id) WHERE place <= target""")
def w08_stratified_sample(spark, sf_dir):
    return R.stratified_sample(view(spark, sf_dir, "v_findings"), "rule_id", ["screening_priority"], "finding_id")


@query("SELECT finding_id, (row_number() OVER (ORDER BY finding_id) - 1) // 100 AS batch FROM v_findings")
def w09_batches(spark, sf_dir):
    return R.batches(view(spark, sf_dir, "v_findings").select("finding_id"), "finding_id", 100)


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w10_latest_execution(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("SELECT l_returnflag, l_orderkey, l_partkey, l_quantity, rank FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_partkey, l_quantity, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_partkey) AS rank FROM lineitem) WHERE rank <= 20")
def w13_per_rule_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_quantity").distinct()
    return R.top_per_group(rows, "l_returnflag", [F.desc("l_quantity"), "l_orderkey", "l_partkey"], 20)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, failure_class ORDER BY finding_id) AS k, {SCORE} AS s FROM v_findings)
    SELECT rule_id, failure_class, count(*) AS n, CAST(sum(s) AS BIGINT) AS weight, arg_min(finding_id, (-s, finding_id)) AS representative, string_agg(CAST(finding_id AS VARCHAR), ',' ORDER BY finding_id) FILTER (k <= 250) AS members FROM r GROUP BY 1, 2""")
def a24_clusters_with_members(spark, sf_dir):
    return R.review_clusters(view(spark, sf_dir, "v_findings"))
