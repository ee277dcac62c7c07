"""Queues, diversity limits, reserves, samples and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.columns import priority_score
from evidentia.storage import saved


#: What comes first in the queue; all else comes last.
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2, "manual": 3}
CHANGE_RANK = {"changed": 0, "impacted": 1, "moved": 2, "new": 3, "manual": 4}


def _rank(names: dict[str, int], c: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(c)], F.lit(9))


def review_queue(findings: DataFrame, diagnostics: DataFrame, limit: int, minimum: str = "low") -> DataFrame:
    """The first ``limit`` findings to review (the limit is the feature), with their diagnostics (item_id, rule_id, level) counted.

    Left out are findings that aren't active, closed ones without errors that needn't be validated again, and those below the
    least priority (but manual ones).  First come those to validate again, then those with errors other than being unreviewed,
    then by kind of change, priority, path, line and identifier."""
    if minimum not in ("high", "medium", "low"):
        raise ValueError("minimum is high, medium or low")
    error = F.col("level") == "error"
    found = diagnostics.groupBy(F.col("item_id").alias("finding_id")).agg(
        F.count_if(error).alias("errors"), F.count_if(error & ~F.col("rule_id").eqNullSafe(F.lit("review.unreviewed"))).alias("blocking_errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    rows = findings.join(found, "finding_id", "left").fillna(0, ["errors", "blocking_errors", "warnings"]).withColumn("revalidation_required", F.coalesce("revalidation_required", F.lit(False)))
    done = F.col("status").eqNullSafe(F.lit("closed")) & (F.col("errors") == 0) & ~F.col("revalidation_required")
    priority = _rank(PRIORITY_RANK, "screening_priority")
    wanted = (F.col("screening_priority") == "manual") | (priority <= PRIORITY_RANK[minimum])
    rows = rows.where((F.col("source_status") == "active") & ~done & wanted)
    order = [F.desc("revalidation_required"), F.desc(F.col("blocking_errors") > 0), _rank(CHANGE_RANK, "source_change"), priority, F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), F.col("finding_id")]
    return rows.orderBy(*order).limit(limit).select("finding_id", "screening_priority", "source_change", "path", "line", "revalidation_required", "errors", "blocking_errors", "warnings")


def families(findings: DataFrame) -> DataFrame:
    """The best finding of each (component, class), and the family's size."""
    best = F.min(F.struct((-priority_score(F.col("screening_priority"))).alias("s"), "finding_id"))
    return findings.groupBy("component_id", "failure_class").agg(best.alias("b"), F.count("*").alias("members")).select("component_id", "failure_class", F.col("b.finding_id").alias("finding_id"), (-F.col("b.s")).cast("long").alias("score"), "members")


def cap_per_component(findings: DataFrame, k: int, protected: Column) -> DataFrame:
    """At most k a component; protected rows are exempt and don't count."""
    w = Window.partitionBy("component_id").orderBy(F.desc("score"), "finding_id").rowsBetween(Window.unboundedPreceding, 0)
    return findings.withColumn("protected", protected).withColumn("n", F.sum(F.when(~F.col("protected"), 1).otherwise(0)).over(w)).where(F.col("protected") | (F.col("n") <= k)).drop("n")


def diversify(findings: DataFrame) -> DataFrame:
    """Rounds across components within each score: (score, round) order the queue."""
    w = Window.partitionBy("score", "component_id").orderBy("finding_id")
    return findings.withColumn("round", F.row_number().over(w).cast("long"))


def priority_reserve(findings: DataFrame, limit: int) -> DataFrame:
    """Protected first, then at least a tenth of the limit for each priority, then the rest, up to the limit."""
    least = max(1, limit // 10)
    w = Window.partitionBy("screening_priority").orderBy("finding_id")
    # the reserve is ranked under a bound, which Spark applies before it shuffles; the rest is only ordered
    reserve = findings.where(~F.col("protected")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= least).select("finding_id", F.lit(1).alias("reserved"))
    phase = F.when(F.col("protected"), 0).when(F.col("reserved") == 1, 1).otherwise(2)
    rows = findings.join(reserve, "finding_id", "left").withColumn("phase", phase)
    return rows.orderBy("phase", F.desc("score"), "finding_id").limit(limit).select("finding_id", F.col("phase").cast("long").alias("phase"))


def stratified_sample(findings: DataFrame, rule: str, strata: list[str], item: str) -> DataFrame:
    """Round robin over strata until each rule has min(n, max(5, min(30, ceil(2 log2(n + 1))))) rows."""
    sizes = findings.groupBy(rule).agg(F.count("*").alias("n"))
    target = F.least(F.col("n"), F.greatest(F.lit(5), F.least(F.lit(30), F.ceil(2 * F.log2(F.col("n") + 1)))))
    # no rule takes more than 30, so no stratum gives more: a bound that Spark applies before it shuffles
    turn = findings.withColumn("round", F.row_number().over(Window.partitionBy(rule, *strata).orderBy(item))).where(F.col("round") <= 30)
    placed = turn.withColumn("place", F.row_number().over(Window.partitionBy(rule).orderBy("round", *strata, item)))
    return placed.join(sizes.select(rule, target.alias("target")), rule).where("place <= target").select(rule, item, F.col("place").cast("long").alias("place"))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Batch numbers of at most ``size`` rows in the order of a key: ranks come from ranges, so no task holds all rows."""
    placed = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = saved(placed)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    return placed.join(starts, "part").withColumn("batch", F.floor((F.col("at") - F.col("first") + F.col("n0")) / size)).drop("part", "at", "first", "n0")


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def latest(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max(F.struct(ts, tie)).alias("m")).select(key, f"m.{ts}", f"m.{tie}")


def component_diverse(df: DataFrame, n: int) -> DataFrame:
    """One row a component first, then the rest, up to n."""
    w = Window.partitionBy("component_id").orderBy(F.desc("score"), "finding_id")
    return df.withColumn("again", F.row_number().over(w) > 1).orderBy("again", F.desc("score"), "finding_id").limit(n).select("component_id", "finding_id", "again")


def review_clusters(findings: DataFrame, most: int = 250) -> DataFrame:
    """Groups by (rule, class): size, representative, weight, first members."""
    w = Window.partitionBy("rule_id", "failure_class").orderBy("finding_id")
    score = priority_score(F.col("screening_priority"))
    members = findings.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("rule_id", "failure_class").agg(F.array_join(F.array_sort(F.collect_list("finding_id")), ",").alias("members"))
    g = findings.groupBy("rule_id", "failure_class").agg(F.count("*").alias("n"), F.sum(score).alias("weight"), F.min(F.struct((-score).alias("s"), "finding_id")).alias("b"))
    return g.join(members, ["rule_id", "failure_class"]).select("rule_id", "failure_class", "n", "weight", F.col("b.finding_id").alias("representative"), "members")
