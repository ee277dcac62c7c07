"""Groups, ladders and coverage of review work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def priority_weight(priority: Column) -> Column:
    return F.when(priority == "high", 8).when(priority == "medium", 3).when(priority == "low", 1).otherwise(2).cast("long")


def first_members(rows: DataFrame, keys: list[str], id_col: str, k: int) -> DataFrame:
    """The k least identifiers of each group, sorted; rank limits are applied before the shuffle, so a large group stays small."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(id_col))).where(F.col("__n") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(id_col)).alias("members"))


def review_clusters(findings: DataFrame, keys: list[str], k: int = 250) -> DataFrame:
    """Size, weight, representative (greatest weight, then least identifier) and first members of each group."""
    weight = priority_weight(F.col("screening_priority"))
    sums = findings.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.min(F.struct((-weight).alias("w"), F.col("finding_id")))["finding_id"].alias("representative"))
    return sums.join(first_members(findings, keys, "finding_id", k), keys)


def consolidation_queue(clusters: DataFrame, k: int) -> DataFrame:
    """The k heaviest clusters of two members or more."""
    return clusters.where("n > 1").orderBy(F.desc("weight"), "representative").limit(k)


def evidence_portfolio(obligations: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    rows = obligations.join(findings, "finding_id")
    return rows.groupBy(*keys).agg(F.count("*").alias("obligations"), F.sum(priority_weight(F.col("screening_priority"))).alias("weight"))


def families(findings: DataFrame) -> DataFrame:
    """Each component and class once: best row and number by priority."""
    p = F.col("screening_priority")
    return findings.groupBy("component_id", "failure_class").agg(
        F.min(F.struct((-priority_weight(p)).alias("w"), F.col("finding_id")))["finding_id"].alias("representative"), *[F.count_if(p == x).alias(x) for x in ("high", "medium", "low")])


def share_linked(population: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """One row: how many of a population have a link, in percent (null for none)."""
    rows = population.select(key).distinct().join(linked.select(key).distinct().withColumn("l", F.lit(1)), key, "left")
    return rows.agg(F.count("*").alias("total"), F.count("l").alias("linked"), F.round(100 * F.try_divide(F.count("l"), F.count("*")), 2).alias("percent"))


def instrumentation_coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, state): observed, missing or unknown (observed but not expected)."""
    a, b = expected.select(key).distinct().withColumn("e", F.lit(True)), observed.select(key).distinct().withColumn("o", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("e") & F.col("o"), "observed").when(F.col("e"), "missing").otherwise("unknown").alias("state"))


def freshness(evidence: DataFrame, kind: str, baseline: Column) -> DataFrame:
    """By kind: current, stale, or missing where no evidence names a baseline."""
    current, some = F.count_if(baseline), F.count(baseline)
    return evidence.groupBy(kind).agg(current.alias("current"), (some - current).alias("stale"), F.when(some == 0, "missing").when(current == some, "current").otherwise("stale").alias("state"))


def phase_targets(phases: DataFrame, target: float) -> DataFrame:
    """(phase, cost) scaled to a total; the few phases are summed before the window."""
    share = F.col("cost") / F.sum("cost").over(Window.partitionBy(F.lit(1)))
    return phases.select("phase", "cost", (share * target).alias("target"), F.when(F.col("cost") > share * target, "over").otherwise("within").alias("state"))


def guideword_gaps(nodes: DataFrame, words: list[str], recorded: DataFrame) -> DataFrame:
    """Pairs of a node and a word that nobody recorded."""
    return nodes.select("node", F.explode(F.array(*[F.lit(w) for w in words])).alias("word")).join(recorded, ["node", "word"], "left_anti")


def shared_fate(uses: DataFrame) -> DataFrame:
    """(region, component) for every dependency that more than one component has."""
    shared = uses.groupBy("region").agg(F.countDistinct("component_id").alias("n")).where("n > 1").select("region")
    return uses.select("region", "component_id").distinct().join(shared, "region")


def timing_edges(edges: DataFrame, budgets: DataFrame) -> DataFrame:
    """exceeds where the callee's budget is greater than the caller's, compatible, or incomplete where one has none."""
    a, b = budgets.select(F.col("component_id").alias("source"), F.col("budget").alias("caller")), budgets.select(F.col("component_id").alias("target"), F.col("budget").alias("callee"))
    state = F.when(F.col("caller").isNull() | F.col("callee").isNull(), "incomplete").when(F.col("callee") > F.col("caller"), "exceeds").otherwise("compatible")
    return edges.join(a, "source", "left").join(b, "target", "left").select("source", "target", state.alias("state"))


def surface_tags(text: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules of which a keyword occurs."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(rf"\Q{w}\E" for w in words)), F.lit(name)) for name, words in rules.items()]))


def context_claims(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """(claim_id, item_id): the least catalogue entry with equal ``normal`` text, or null for a lead that isn't catalogued."""
    known = catalog.groupBy("normal").agg(F.min("item_id").alias("item_id"))
    return claims.join(known, "normal", "left").select("claim_id", "item_id")


def first_last(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
