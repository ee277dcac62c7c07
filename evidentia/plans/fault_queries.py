"""Queries of fault trees and reliability diagrams: one tree for each brand, one diagram for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import faults as T
from evidentia.plans.catalog import query
from evidentia.storage import saved
from evidentia.views import table, view

#: top = pair or rest; pair = e0 and e1; rest = any(e1, e2) and e3 and e4; trees of odd brands ask for two of e0, e1, e2 instead.
GATES = [("top", "or", 0, ["pair", "rest"]), ("pair", "and", 0, ["e0", "e1"]), ("rest", "inhibit", 0, ["any", "e3", "e4"]), ("any", "or", 0, ["e1", "e2"]), ("any2", "vote", 2, ["e0", "e1", "e2"])]
ODD = "CAST(substr(tree, 7) AS INT) % 2 = 1"


def _spread(trees: DataFrame, gates: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The same gates in every tree."""
    rows = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.array(*[F.lit(c) for c in cs]).alias("children")) for n, kind, k, cs in gates])
    g = trees.select("tree", F.explode(rows).alias("g")).select("tree", "g.*")
    return g.select("tree", "node", "kind", "k"), g.select("tree", "node", F.explode("children").alias("child"))


def _brand_trees(spark, sf_dir):
    events = view(spark, sf_dir, "v_tree_events")
    gates, inputs = _spread(events.select("tree").distinct(), GATES)
    inputs = inputs.withColumn("child", F.when((F.col("node") == "rest") & (F.col("child") == "any") & F.expr(ODD), "any2").otherwise(F.col("child")))
    return events.select("tree", "node", "p", (F.col("p") * 0.5).alias("low"), (F.col("p") * 1.5).alias("high")), gates, inputs


def _top(p: str) -> str:
    e = [f"({p}{i})" for i in range(5)]
    rest = f"{e[3]} * {e[4]}"
    plain = f"{e[1]} * (1 - (1 - {e[0]}) * (1 - {rest})) + (1 - {e[1]}) * {e[2]} * {rest}"
    vote = f"{e[1]} * (1 - (1 - {e[0]}) * (1 - {e[2]} * {rest})) + (1 - {e[1]}) * {e[0]} * {e[2]} * {rest}"
    return f"CASE WHEN {ODD} THEN {vote} ELSE {plain} END"


WIDE = "w AS (SELECT tree, " + ", ".join(f"max(CASE WHEN node = 'e{i}' THEN p END) AS p{i}" for i in range(5)) + " FROM v_tree_events GROUP BY tree), " \
    "b AS (SELECT tree, " + ", ".join(f"p{i}, p{i} * 0.5 AS l{i}, p{i} * 1.5 AS h{i}" for i in range(5)) + " FROM w)"


@query(f"WITH {WIDE} SELECT tree, 'computed' AS status, round({_top('p')}, 9) AS probability, round({_top('l')}, 9) AS low, round({_top('h')}, 9) AS high FROM b")
def g09_tree_probability(spark, sf_dir):
    rows, _ = T.tree_probability(*_brand_trees(spark, sf_dir))
    return rows.select("tree", "status", *[F.round(c, 9).alias(c) for c in ("probability", "low", "high")])


def _importance(i: int) -> str:
    forced = lambda v: ", ".join(f"CAST({v} AS DOUBLE) AS p{j}" if j == i else f"p{j}" for j in range(5))
    return f"SELECT a.tree, 'e{i}' AS event, round(x - y, 9) AS importance FROM (SELECT tree, {_top('p')} AS x FROM (SELECT tree, {forced(1)} FROM w)) a JOIN (SELECT tree, {_top('p')} AS y FROM (SELECT tree, {forced(0)} FROM w)) z USING (tree)"


@query(f"WITH {WIDE} " + " UNION ALL ".join(_importance(i) for i in range(5)))
def g09_event_importance(spark, sf_dir):
    return T.tree_probability(*_brand_trees(spark, sf_dir))[1].withColumn("importance", F.round("importance", 9))


@query(f"""WITH t AS (SELECT DISTINCT p_brand AS tree FROM part) SELECT tree, 'e0,e1' AS cut_set FROM t UNION ALL SELECT tree, unnest(CASE WHEN {ODD} THEN ['e0,e2,e3,e4', 'e1,e2,e3,e4'] ELSE ['e1,e3,e4', 'e2,e3,e4'] END) FROM t""")
def g10_cut_sets(spark, sf_dir):
    terms, _ = T.cut_sets(*_brand_trees(spark, sf_dir))
    return terms.select("tree", F.array_join("cut_set", ",").alias("cut_set"))


NESTED = [("top", "vote", 2, ["a", "b", "e3"]), ("a", "or", 0, ["e1", "e2"]), ("b", "and", 0, ["a", "c"]), ("c", "inhibit", 0, ["e2", "e3"])]


@query("""WITH s AS (SELECT user_id, day, e1 = 1 AS e1, e2 = 1 AS e2, e3 = 1 AS e3 FROM v_scenarios), v AS (SELECT *, e1 OR e2 AS a, e2 AND e3 AS c FROM s)
    SELECT user_id, day, node, value FROM (SELECT user_id, day, unnest([{'node': 'a', 'value': a}, {'node': 'c', 'value': c}, {'node': 'b', 'value': a AND c},
      {'node': 'top', 'value': CAST(a AS INT) + CAST(a AND c AS INT) + CAST(e3 AS INT) >= 2}], recursive := true) FROM v)""")
def g08_nested_trees(spark, sf_dir):
    states = view(spark, sf_dir, "v_scenarios").select("user_id", "day", F.lit("t").alias("tree"), F.explode(F.array(*[F.struct(F.lit(e).alias("node"), (F.col(e) == 1).alias("value")) for e in ("e1", "e2", "e3")])).alias("x"))
    gates, inputs = _spread(spark.range(1).select(F.lit("t").alias("tree")), NESTED)
    return T.evaluate_trees(states.select("user_id", "day", "tree", "x.*"), gates, inputs, ["user_id", "day"]).select("user_id", "day", "node", "value")


@query("""WITH n AS (SELECT tree, count(*) AS n, sum(ln(value)) AS s, exp(sum(ln(1 - value))) AS f, sum(value / (1 - value)) AS odds, min(value) AS m FROM v_order_blocks GROUP BY tree)
    SELECT tree AS diagram, round(0.9 * CASE tree % 3 WHEN 0 THEN exp(s) WHEN 1 THEN 1 - f ELSE CASE WHEN n < 2 THEN 0 ELSE 1 - f - f * odds END END + 0.1 * m, 8) AS value FROM n""")
def g11_diagrams(spark, sf_dir):
    blocks = saved(view(spark, sf_dir, "v_order_blocks"))
    inputs = blocks.select("tree", F.lit("top").alias("node"), F.col("node").alias("child"))
    kind = F.when(F.col("tree") % 3 == 0, "series").when(F.col("tree") % 3 == 1, "parallel").otherwise("vote")
    gates = blocks.select("tree").distinct().select("tree", F.lit("top").alias("node"), kind.alias("kind"), F.lit(2).alias("k"), F.lit(0.1).alias("beta"))
    return T.block_reliability(blocks, gates, inputs).select("diagram", F.round("value", 8).alias("value"))


_RATES = """WITH b AS (SELECT l_orderkey AS tree, l_linenumber AS node, max(l_discount) + 0.01 AS f, min(l_quantity) AS r FROM lineitem GROUP BY 1, 2),
    u AS (SELECT tree, node, r / (f + r) AS v, r * 0.5 / (f * 2 + r * 0.5) AS lo, r * 2 / (f * 0.5 + r * 2) AS hi FROM b), m AS (SELECT tree, count(*) AS n, sum(ln(v)) AS sv, sum(ln(lo)) AS sl, sum(ln(hi)) AS sh FROM u GROUP BY tree)"""


def _rates(spark, sf_dir):
    """Lines as repaired blocks in series, by order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tree"), F.col("l_linenumber").cast("string").alias("node")).agg((F.max("l_discount") + 0.01).alias("failure"), F.min("l_quantity").cast("double").alias("repair"))
    f, r = F.col("failure"), F.col("repair")
    blocks = T.availability(rows.withColumns({"failure_low": f * 0.5, "failure_high": f * 2, "repair_low": r * 0.5, "repair_high": r * 2}))
    blocks = saved(blocks)
    inputs = blocks.select("tree", F.lit("top").alias("node"), F.col("node").alias("child"))
    gates = blocks.select("tree").distinct().select("tree", F.lit("top").alias("node"), F.lit("series").alias("kind"), F.lit(0).alias("k"), F.lit(0.0).alias("beta"))
    return blocks, gates, inputs


@query(f"{_RATES} SELECT tree AS diagram, round(exp(sv), 8) AS value, round(exp(sl), 8) AS low, round(exp(sh), 8) AS high FROM m")
def g11_availability(spark, sf_dir):
    return T.block_reliability(*_rates(spark, sf_dir)).select("diagram", *[F.round(c, 8).alias(c) for c in ("value", "low", "high")])


@query(f"{_RATES} SELECT tree AS diagram, CAST(node AS VARCHAR) AS block, round(exp(sv - ln(v)), 8) AS importance FROM u JOIN m USING (tree)")
def g11_block_importance(spark, sf_dir):
    return T.block_importance(*_rates(spark, sf_dir)).withColumn("importance", F.round("importance", 8))


@query("""SELECT finding_id, e AS event_id FROM (SELECT finding_id, unnest(list_filter([CASE WHEN finding_id IN (5, 7) THEN 'named' END, CASE WHEN rule_id LIKE 'rule.1%' AND lower(disposition) LIKE '%accept%' THEN 'globs' END,
    CASE WHEN failure_class LIKE 'class_' AND rule_id IN ('rule.2', 'rule.3') OR finding_id = 11 THEN 'both' END], lambda x: x IS NOT NULL)) AS e FROM v_findings)""")
def j21_match_events(spark, sf_dir):
    selectors = [{"event_id": "named", "finding_ids": [5, 7]}, {"event_id": "globs", "component_patterns": ["rule.1*"], "failure_patterns": ["*ACCEPT*"]},
                 {"event_id": "both", "finding_ids": [11], "component_patterns": ["rule.[23]"]}]
    return T.match_events(view(spark, sf_dir, "v_findings"), selectors, component="rule_id", text="disposition").select("finding_id", "event_id")
