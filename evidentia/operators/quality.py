"""Data-quality rules: each gives violations (rule_id, level, item_id, message); validate() is their union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RULES: dict[str, Callable[..., DataFrame]] = {}


def violations(df: DataFrame, rule: str, level: str, item: str, message: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), F.col(item).cast("string").alias("item_id"), F.lit(message).alias("message"))


def duplicate_ids(df: DataFrame, *keys: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("item", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return violations(repeated, "ids.duplicate", "error", "item", "identifier repeats")


def not_allowed(df: DataFrame, item: str, bad: Column, rule: str = "values.range") -> DataFrame:
    return violations(df.where(bad), rule, "error", item, "value not allowed")


def dangling(df: DataFrame, item: str, catalog: DataFrame, key: str, rule: str = "refs.dangling") -> DataFrame:
    return violations(df.join(catalog.select(key).distinct(), key, "left_anti"), rule, "error", item, "reference has no target")


def unused(catalog: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    return violations(catalog.join(rows.select(key).distinct(), key, "left_anti"), "catalog.unused", "warning", key, "nothing links to it")


def cardinality(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with other than one child."""
    n = children.groupBy(key).agg(F.count("*").alias("n"))
    return violations(parents.join(n, key, "left").where("coalesce(n, 0) <> 1"), "obligations.cardinality", "error", key, "not exactly one")


def stale(rows: DataFrame, current: DataFrame, key: str, mark: str) -> DataFrame:
    now = current.select(key, F.col(mark).alias("now"))
    return violations(rows.join(now, key).where(~F.col(mark).eqNullSafe(F.col("now"))), "review.stale", "warning", key, "reviewed version is not current")


def register_rule(name: str, fn: Callable[..., DataFrame]) -> None:
    """A user's rule; its violations carry its name."""
    if name in _RULES:
        raise ValueError(f"a rule named {name} is there already")
    _RULES[name] = fn


def run_registered(*args: DataFrame) -> DataFrame:
    return validate(*[fn(*args).withColumn("rule_id", F.lit(name)) for name, fn in sorted(_RULES.items())])


def validate(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure_incomplete(findings: DataFrame) -> DataFrame:
    """Closed findings that were not accepted, not verified, or have no ratings after the action."""
    closed = findings.where("closed")
    parts = {"not accepted": F.col("disposition") != "accepted", "not verified": ~F.coalesce("verified", F.lit(False)), "no ratings after the action": F.col("post_rpn").isNull()}
    return validate(*[violations(closed.where(F.coalesce(t, F.lit(True))), "closure.incomplete", "error", "finding_id", m) for m, t in parts.items()])


def unmapped_rate(spans: DataFrame, by: str, most: float) -> DataFrame:
    """Imports of which more than ``most`` of the spans have no component."""
    rate = spans.groupBy(by).agg(F.avg(F.col("component").isNull().cast("double")).alias("rate"))
    return violations(rate.where(F.col("rate") > most), "trace.unmapped", "warning", by, "too many spans have no component")


def instrumentation_gaps(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected components or relations that nothing observed."""
    missing = expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")
    return violations(missing.withColumn("item", F.concat_ws("/", *[F.col(k).cast("string") for k in keys])), "trace.instrumentation", "warning", "item", "expected, not observed")


def reviewer_diversity(reviews: DataFrame, key: str, least: int) -> DataFrame:
    few = reviews.groupBy(key).agg(F.countDistinct("reviewer").alias("n")).where(F.col("n") < least)
    return violations(few, "review.diversity", "warning", key, "too few reviewers")


def cause_without_effect(components: DataFrame) -> DataFrame:
    bare = components.where("kind = 'common_cause'").where(F.size(F.coalesce("affected", F.array().cast("array<bigint>"))) == 0)
    return violations(bare, "common_cause.unlinked", "error", "component_id", "common cause affects no component")


def stored_summary(stored: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of a stored summary that recomputation doesn't give, and those it gives that aren't stored."""
    a = stored.select(*keys, F.struct(*values).alias("a"))
    b = recomputed.select(*keys, F.struct(*values).alias("b"))
    off = a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).withColumn("item", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return violations(off, "summary.mismatch", "error", "item", "stored summary is not what the rows give")


def vex_consistency(decisions: DataFrame) -> DataFrame:
    """Decisions (decision_id, status, justification, action, refs): known states, not_affected with a justification, affected with
    an action, references, and each identifier once."""
    parts = {
        "unknown status": ~F.col("status").isin("not_affected", "affected", "fixed", "under_investigation"),
        "not_affected without justification": (F.col("status") == "not_affected") & (F.coalesce("justification", F.lit("")) == ""),
        "affected without action": (F.col("status") == "affected") & (F.coalesce("action", F.lit("")) == ""),
        "no references": F.size(F.coalesce("refs", F.array().cast("array<string>"))) <= 0,
    }
    return validate(duplicate_ids(decisions, "decision_id"), *[violations(decisions.where(t), "vex.consistency", "error", "decision_id", m) for m, t in parts.items()])


def arithmetic(results: DataFrame, item: str, digits: int = 6) -> DataFrame:
    """Stored results (expected, actual, missing, unexpected, matched, precision, recall) whose counts or ratios don't follow."""
    near = lambda stored, a, b: ~F.coalesce(F.abs(stored - a / b) <= 0.5 * 10.0**-digits, F.lit(False)) & (b > 0) | (b == 0) & stored.isNotNull()
    m, e, a = F.col("matched"), F.col("expected"), F.col("actual")
    parts = {"matched is not expected less missing": m != e - F.col("missing"), "matched is not actual less unexpected": m != a - F.col("unexpected"),
             "recall doesn't follow": near(F.col("recall"), m, e), "precision doesn't follow": near(F.col("precision"), m, a)}
    return validate(*[violations(results.where(t), "results.arithmetic", "error", item, text) for text, t in parts.items()])
