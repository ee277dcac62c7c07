"""Statistics of predictions, ratings, measurements and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.columns import binomial_p, ratio, wilson
from evidentia.storage import saved


def _count(c: Column) -> Column:
    return F.count_if(c)


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn and the usual ratios; null where a denominator is 0; unknown labels are left out."""
    e, p = F.col("expected"), F.col("predicted")
    counts = df.where(e.isNotNull() & p.isNotNull()).groupBy(*by).agg(_count(e & p).alias("tp"), _count(~e & p).alias("fp"), _count(e & ~p).alias("fn"), _count(~e & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def with_wilson(df: DataFrame, k: str, n: str) -> DataFrame:
    w = wilson(F.col(k), F.col(n))
    return df.withColumns({"low": w["low"], "high": w["high"]})


def outcome(df: DataFrame) -> Column:
    return (F.col("expected") == F.col("predicted")).cast("double")


def brier(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("confidence") - outcome(df), 2)).alias("brier"))


def calibration_bins(df: DataFrame, n: int = 10, *by: str) -> DataFrame:
    """Equal bins, the last closed at 1; empty ones are absent."""
    b = F.least(F.floor(F.col("confidence") * n), F.lit(n - 1))
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(outcome(df)).alias("accuracy"))


def expected_calibration_error(df: DataFrame, n: int = 10, *by: str) -> DataFrame:
    bins = calibration_bins(df, n, *by)
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def risk_coverage(df: DataFrame, key: str, every: int = 10) -> DataFrame:
    """Error among the k most confident, for k = 1, every tenth and all; ranks run over ranges, not in one task."""
    placed = df.withColumn("wrong", 1 - outcome(df)).repartitionByRange(F.desc("confidence"), key).sortWithinPartitions(F.desc("confidence"), key)
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).select(key, "wrong", "part", "at", "confidence")
    placed = saved(placed)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("wrong").alias("w")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"), F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    w = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumns({"k": F.count("*").over(w), "errors": F.sum("wrong").over(w)}).join(starts, "part").withColumns({"k": F.col("k") + F.col("n0"), "errors": F.col("errors") + F.col("w0")})
    return ranked.where((F.col("k") == 1) | (F.col("k") % every == 0) | (F.col("k") == F.col("all"))).select("k", (F.col("k") / F.col("all")).alias("coverage"), (F.col("errors") / F.col("k")).alias("risk"))


def pass_at_k(attempts: DataFrame, k: int) -> DataFrame:
    """By case and then over all: first attempts, any of the first k, cases that both pass and fail."""
    cases = attempts.groupBy("case_id").agg(F.min_by("passed", "attempt").alias("first"), F.bool_or(F.when(F.col("attempt") <= k, F.col("passed"))).alias("any"), (F.bool_or("passed") & F.bool_or(~F.col("passed"))).alias("flaky"), F.avg("latency").alias("latency"))
    return cases.agg(F.count("*").alias("cases"), F.avg(F.col("first").cast("double")).alias("pass_1"), F.avg(F.col("any").cast("double")).alias("pass_k"), F.avg(F.col("flaky").cast("double")).alias("flaky_rate"), F.avg("latency").alias("mean_latency"))


def attempt_rates(attempts: DataFrame) -> DataFrame:
    """One row over (case_id, attempt, resolved, flaky, unsafe, latency, tokens, cost): how many cases and attempts, the share of first
    attempts that resolved their case (of those that tell), of attempts that were flaky or unsafe, and means over the attempts
    that have a number.  Null where there is nothing to divide by."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    firsts = attempts.groupBy("case_id").agg(F.min_by("resolved", "attempt").alias("resolved")).agg(F.count("*").alias("cases"), share("resolved").alias("resolved_rate"))
    every = attempts.agg(F.count("*").alias("attempts"), share("flaky").alias("flaky_attempt_rate"), share("unsafe").alias("unsafe_rate"), *[F.avg(c).alias(f"mean_{c}") for c in ("latency", "tokens", "cost")])
    # two tables of one row
    return firsts.join(F.broadcast(every))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    c = df.agg(F.count("*").alias("n"), _count(F.col(a) & F.col(b)).alias("yy"), _count(F.col(a) & ~F.col(b)).alias("yn"), _count(~F.col(a) & F.col(b)).alias("ny"), _count(~F.col(a) & ~F.col(b)).alias("nn"))
    seen = (F.col("yy") + F.col("nn")) / F.col("n")
    chance = ((F.col("yy") + F.col("yn")) * (F.col("yy") + F.col("ny")) + (F.col("nn") + F.col("yn")) * (F.col("nn") + F.col("ny"))) / (F.col("n") * F.col("n"))
    return c.select("n", ratio(seen - chance, 1 - chance).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, item: str, value: str) -> DataFrame:
    """Nominal, two values, missing ratings allowed: all pairs of ratings of an item are pooled over the items, and single
    ratings count among the values that chance is taken from.  Null where no item has two ratings."""
    items = ratings.where(F.col(value).isNotNull()).groupBy(item).agg(F.count("*").alias("m"), _count(F.col(value)).alias("t"))
    sums = items.agg(F.sum("m").alias("n"), F.sum("t").alias("t"), F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"), F.sum(2 * F.col("t") * (F.col("m") - F.col("t"))).alias("d"))
    seen = ratio(F.col("d"), F.col("pairs"))
    expected = F.coalesce(ratio(2 * F.col("t") * (F.col("n") - F.col("t")), F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return sums.select("n", F.when((expected == 0) & (seen == 0), 1.0).otherwise(1 - ratio(seen, expected)).alias("alpha"))


def mcnemar(pred: DataFrame) -> DataFrame:
    """For each two tools: cases that only one got right, agreements, exact two-sided p."""
    right = pred.select("doc_id", "tool", (F.col("expected") == F.col("predicted")).alias("right"))
    a, b = right.select("doc_id", F.col("tool").alias("tool_a"), F.col("right").alias("ra")), right.select("doc_id", F.col("tool").alias("tool_b"), F.col("right").alias("rb"))
    c = a.join(b, "doc_id").where("tool_a < tool_b").groupBy("tool_a", "tool_b").agg(_count(F.col("ra") & ~F.col("rb")).alias("left_only"), _count(~F.col("ra") & F.col("rb")).alias("right_only"), _count(F.col("ra") == F.col("rb")).alias("agree"))
    return c.withColumn("p", binomial_p(F.least("left_only", "right_only"), F.col("left_only") + F.col("right_only")))


def disagreements(pred: DataFrame, case: str = "doc_id") -> DataFrame:
    return pred.groupBy(case).agg(F.countDistinct("predicted").alias("answers"), _count(F.col("predicted")).alias("yes")).where("answers > 1").select(case, "yes")


def cluster_bootstrap(clusters: DataFrame, reps: int, seed: int, confidence: float = 0.95, by: str | None = None) -> DataFrame:
    """(by, low, high, reps): percentile interval of sum(k)/sum(n), resampling whole clusters, of each stratum on its own if there
    are strata; no clusters, no row.

    Draw i of repetition r is a whole-number congruence, so that any engine recomputes it.  Clusters (cluster, k, n) are
    numbered by name within their stratum; each stands for as many draws as there are repetitions, so all strata are drawn
    in one pass, one row a draw."""
    rows = clusters.select((F.col(by) if by else F.lit("all")).alias("stratum"), "cluster", "k", "n")
    order = [F.col("stratum").asc_nulls_first(), F.col("cluster").asc_nulls_first()]
    rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    placed = rows.join(starts, "part").select("stratum", (F.col("start") + F.col("at")).alias("no"), "k", "n")
    sizes = placed.groupBy(F.col("stratum").alias("its")).agg(F.count("*").alias("m"), F.min("no").alias("first"))
    numbered = saved(placed.join(sizes, F.col("stratum").eqNullSafe(F.col("its"))).select("stratum", "m", (F.col("no") - F.col("first")).alias("no"), "k", "n"))
    draws = numbered.select(F.col("stratum").alias("its"), "m", F.col("no").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    draw = F.shiftright((F.col("rep") * 7919 + F.col("i") * 104729 + seed) * 1103515245 % 2147483648, 8) % F.col("m")
    drawn = draws.select("its", "rep", draw.alias("drawn")).join(numbered, F.col("its").eqNullSafe(F.col("stratum")) & (F.col("drawn") == F.col("no")))
    sums = drawn.groupBy("stratum", "rep").agg((F.sum("k") / F.sum("n")).alias("x"))
    tail = (1 - confidence) / 2
    out = sums.groupBy("stratum").agg(F.percentile("x", tail).alias("low"), F.percentile("x", 1 - tail).alias("high"), F.count("*").alias("reps"))
    return out.withColumnRenamed("stratum", by) if by else out.drop("stratum")


def graph_pr(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Edges expected and found; null ratios without a denominator."""
    a, b = expected.select("source", "target").distinct().withColumn("e", F.lit(1)), actual.select("source", "target").distinct().withColumn("a", F.lit(1))
    c = a.join(b, ["source", "target"], "full").agg(_count(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), _count(F.col("e").isNull()).alias("fp"), _count(F.col("a").isNull()).alias("fn"))
    return c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def path_metrics(scenarios: DataFrame) -> DataFrame:
    """One row on how observed cascades bear out the predicted ones: steps of paths, effects, deadlines, breakers and recovery.

    Scenarios are (predicted_path, observed_path, predicted_effects, observed_effects arrays, duration, deadline, expected_breaker,
    observed_breaker, recovery, recovery_deadline).  Deadlines, breakers and recovery count only over scenarios that set one (a
    deadline that isn't null, a breaker other than not_applicable); what wasn't observed doesn't conform.  Null arrays are empty; a
    ratio over nothing is null."""
    steps = lambda c: F.array_distinct(F.transform(F.slice(c, 2, F.size(c) + 1), lambda x, i: F.struct(F.get(c, i).alias("a"), x.alias("b"))))
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    names = ["predicted_path", "observed_path", "predicted_effects", "observed_effects"]
    rows = scenarios.withColumns({c: array(c) for c in names}).withColumns({c: F.array_sort(F.array_distinct(c)) for c in names[2:]})
    rows = rows.withColumns({"pe": steps(F.col("predicted_path")), "oe": steps(F.col("observed_path"))})
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    timed, guarded, recovers = F.col("deadline").isNotNull(), F.col("expected_breaker") != "not_applicable", F.col("recovery_deadline").isNotNull()
    c = rows.agg(
        F.count("*").alias("scenarios"), size("pe").alias("p"), size("oe").alias("o"), size(F.array_intersect("pe", "oe")).alias("m"),
        size("predicted_effects").alias("ep"), size("observed_effects").alias("eo"), size(F.array_intersect("predicted_effects", "observed_effects")).alias("em"),
        F.count_if(F.col("predicted_path") == F.col("observed_path")).alias("same_paths"), F.count_if(F.col("predicted_effects") == F.col("observed_effects")).alias("same_effects"),
        F.count_if(timed).alias("deadline_population"), F.count_if(guarded).alias("breaker_population"), F.count_if(recovers).alias("recovery_population"),
        F.count_if(timed & (F.col("duration") <= F.col("deadline"))).alias("in_time"), F.count_if(guarded & (F.col("observed_breaker") == F.col("expected_breaker"))).alias("as_expected"),
        F.count_if(recovers & (F.col("recovery") <= F.col("recovery_deadline"))).alias("recovered"))
    of = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    return c.select(
        "scenarios", of("m", "p").alias("path_edge_precision"), of("m", "o").alias("path_edge_recall"), of("em", "ep").alias("effect_precision"), of("em", "eo").alias("effect_recall"),
        of("same_paths", "scenarios").alias("exact_path_rate"), of("same_effects", "scenarios").alias("exact_effect_rate"), "deadline_population", "breaker_population", "recovery_population",
        of("in_time", "deadline_population").alias("deadline_conformance"), of("as_expected", "breaker_population").alias("breaker_accuracy"), of("recovered", "recovery_population").alias("recovery_conformance"),
        (F.col("o") - F.col("m")).alias("unexpected_edges"), (F.col("p") - F.col("m")).alias("unobserved_edges"), (F.col("eo") - F.col("em")).alias("unexpected_effects"), (F.col("ep") - F.col("em")).alias("unobserved_effects"))


def monotone_precision(df: DataFrame, level: str, order: list[str]) -> DataFrame:
    """Precision by level, and whether it doesn't fall from one to the next."""
    p = confusion(df, level).select(level, "precision", reduce(lambda a, kv: F.when(F.col(level) == kv[1], kv[0]).otherwise(a), enumerate(order), F.lit(-1)).alias("no")).where("no >= 0")
    return p.select(level, "precision", F.coalesce(F.col("precision") <= F.lag("precision").over(Window.orderBy("no")), F.lit(True)).alias("in_order"))


def perf_stats(runs: DataFrame, by: str, x: str) -> DataFrame:
    """Median, median absolute deviation, spread, nearest-rank 95th percentile."""
    mid = runs.groupBy(by).agg(F.median(x).alias("median"))
    out = runs.join(mid, by).groupBy(by).agg(F.count("*").alias("n"), F.max("median").alias("median"), F.median(F.abs(F.col(x) - F.col("median"))).alias("mad"), F.stddev_samp(x).alias("stdev"), F.avg(x).alias("mean"), F.expr(f"percentile_disc(0.95) within group (order by {x})").alias("p95"))
    return out.withColumn("cv_pct", ratio(F.col("stdev"), F.col("mean")) * 100)


def nearest_rank(x: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) within group (order by {x})")


def window_health(events: DataFrame, by: str, error_limit: float, p95_limit: float) -> DataFrame:
    """Requests, error rate, nearest-rank p95 and the gate for each window."""
    out = events.groupBy(by).agg(F.count("*").alias("requests"), F.avg(F.col("error").cast("double")).alias("error_rate"), nearest_rank("latency_ms", 0.95).alias("p95"))
    return out.withColumn("passed", (F.col("error_rate") <= error_limit) & (F.col("p95") <= p95_limit))


def health_drift(health: DataFrame, by: str, evaluations: DataFrame, policy: dict[str, float]) -> DataFrame:
    """Windows (by, requests, error_rate, p95) with their evaluations' pass rate (by, passed), the relative drift of their p95
    against the first window's, and whether they keep the policy's limits."""
    rate = evaluations.groupBy(by).agg(F.count("*").alias("evaluations"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    base = health.agg(F.min_by("p95", by).alias("base"))
    rows = health.join(rate, by, "left").join(F.broadcast(base)).withColumn("drift", F.abs(ratio(F.col("p95") - F.col("base"), F.col("base"))))
    keeps = (F.col("error_rate") <= policy["error_rate"]) & (F.col("p95") <= policy["p95"]) & (F.col("drift") <= policy["drift"]) & (F.col("evaluations") >= policy["evaluations"]) & (F.col("pass_rate") >= policy["pass_rate"])
    return rows.select(by, "requests", "error_rate", "p95", "evaluations", "pass_rate", "drift", F.coalesce(keeps, F.lit(False)).alias("passed"))


def fuse_channels(edges: DataFrame) -> DataFrame:
    """The channels that know each ordered pair, and what they amount to."""
    g = edges.groupBy("source", "target").agg(F.array_sort(F.collect_set("channel")).alias("c"))
    has = lambda x: F.array_contains("c", x)
    kind = F.when(F.size("c") >= 3, "fully_corroborated").when((F.size("c") == 2) & has("runtime_observed"), "runtime_corroborated").when(F.size("c") == 2, "statically_corroborated").when(has("runtime_observed"), "runtime_only").when(has("external_static"), "external_only").otherwise("native_only")
    return g.select("source", "target", F.array_join("c", ",").alias("channels"), F.size("c").cast("long").alias("corroboration"), kind.alias("classification"))


def review_leads(df: DataFrame, kind: str, item: str, k: int = 25) -> DataFrame:
    """Count, first k items and how many more, by kind.  Ranks are bounded before items are gathered."""
    w = Window.partitionBy(kind).orderBy(item)
    first = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy(kind).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("first_items"))
    return df.groupBy(kind).agg(F.count("*").alias("n")).join(first, kind).withColumn("omitted", F.greatest(F.lit(0), F.col("n") - k))


def gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """passed, and the names of failed checks, for each row."""
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(checks.items())])), ",")
    return df.withColumn("failed", failed).withColumn("passed", F.col("failed") == "")
