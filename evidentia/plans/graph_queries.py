"""Queries of graph jobs (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import graphs as G
from evidentia.plans.catalog import query
from evidentia.views import table, view

CLOSURE = """WITH RECURSIVE c AS (SELECT target AS node, source AS caller, CAST(1 AS BIGINT) AS depth FROM v_tree_edges WHERE target % 10 = 0 UNION ALL
    SELECT c.node, e.source, c.depth + 1 FROM c JOIN v_tree_edges e ON e.target = c.caller)"""


@query(f"{CLOSURE} SELECT node, caller, depth FROM c")
def g02_upstream_closure(spark, sf_dir):
    edges = view(spark, sf_dir, "v_tree_edges")
    return G.upstream_closure(edges, edges.where("target % 10 = 0").select(F.col("target").alias("node")))


@query(f"{CLOSURE} SELECT caller AS node, count(*) AS reasons, min(node) AS first_reason FROM c GROUP BY caller")
def g04_impact(spark, sf_dir):
    edges = view(spark, sf_dir, "v_tree_edges")
    seeds = edges.where("target % 10 = 0").select(F.col("target").alias("node"))
    return G.impact(seeds, G.upstream_closure(edges, seeds))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.record AS a, b.record AS b FROM v_aliases a JOIN v_aliases b ON a.alias = b.alias), r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen AND e.b < 41)
    SELECT node, min(seen) AS label FROM r GROUP BY node""")
def g06_alias_components(spark, sf_dir):
    """Records and aliases are two kinds of nodes of one graph, so a common alias costs its rows, not their pairs."""
    v = view(spark, sf_dir, "v_aliases")
    edges = v.select(F.col("record").alias("a"), (F.col("alias") + (1 << 40)).alias("b"))
    return G.components(edges).where(F.col("node") < 1 << 40)


@query("""WITH RECURSIVE a AS (SELECT node, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM v_hierarchy UNION ALL SELECT a.node, h.parent, a.depth + 1 FROM a JOIN v_hierarchy h ON h.node = a.ancestor) SELECT node, ancestor, depth FROM a""")
def g07_ancestors(spark, sf_dir):
    return G.ancestors(view(spark, sf_dir, "v_hierarchy"))


@query("SELECT user_id, e1 + e2 + e3 = 3 AS and_gate, e1 + e2 + e3 > 0 AS or_gate, e1 + e2 + e3 >= 2 AS vote_gate, e1 = 1 AND e2 = 1 AS inhibit_gate FROM v_scenarios")
def g08_evaluate_trees(spark, sf_dir):
    return G.evaluate_gates(view(spark, sf_dir, "v_scenarios"), 2).select("user_id", "and_gate", "or_gate", "vote_gate", "inhibit_gate")


@query("SELECT diagram, round(exp(-sum(rate)), 9) AS reliability, count(*) AS blocks, max(rate) AS worst_rate FROM v_blocks GROUP BY diagram")
def g11_block_reliability(spark, sf_dir):
    return G.series_reliability(view(spark, sf_dir, "v_blocks")).withColumn("reliability", F.round("reliability", 9))


@query("""WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS node, CAST(1 AS DOUBLE) AS product UNION ALL SELECT e.target, r.product * (1 + e.target % 3) FROM r JOIN v_tree_edges e ON e.source = r.node)
    SELECT node, max(product) AS product FROM r GROUP BY node""")
def g12_retry_amplification(spark, sf_dir):
    edges = view(spark, sf_dir, "v_tree_edges").withColumn("attempts", (1 + F.col("target") % 3).cast("double"))
    return G.retry_amplification(edges, table(spark, sf_dir, "part").where("p_partkey = 0").select(F.col("p_partkey").alias("node"))).select("node", "product")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey AS tip, CAST(p_partkey AS VARCHAR) AS path, 0 AS d FROM part UNION ALL
    SELECT c.node, e.source, c.path || '>' || CAST(e.source AS VARCHAR), c.d + 1 FROM c JOIN v_tree_edges e ON e.target = c.tip WHERE c.d < 4)
    SELECT node, path, d = 4 AND tip IN (SELECT target FROM v_tree_edges) AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d DESC) AS r FROM c) WHERE r = 1 AND d > 0""")
def g03_cascade_paths(spark, sf_dir):
    starts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    paths, _ = G.cascade_paths(view(spark, sf_dir, "v_tree_edges"), starts, 5, 4)
    return paths.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "truncated")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS root, p_partkey AS source, p_partkey AS target, [p_partkey] AS path, 0 AS depth FROM part WHERE p_size = 1 UNION ALL
    SELECT c.root, e.source, e.target, list_append(c.path, e.target), c.depth + 1 FROM c JOIN v_tree_edges e ON e.source = c.target WHERE c.depth < 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, path[1:depth], target) AS step FROM c WHERE depth > 0)
    SELECT root, CAST(step AS INTEGER) AS step, source, target, depth FROM r WHERE step <= 20""")
def g05_reachable_sequence(spark, sf_dir):
    roots = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    return G.reachable_sequence(view(spark, sf_dir, "v_tree_edges"), roots, 3, 20)
