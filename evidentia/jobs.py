"""Composite jobs: what a user runs.  Each composes operators and gives named tables; ``report`` puts their figures in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import assurance, claims, graphs, joins, mapping, quality, ranking, reviews, sets, stats, workflow
from evidentia.operators import vulnerabilities as vulns
from evidentia.storage import saved

Tables = dict[str, DataFrame]


def report(**parts: tuple[DataFrame, str | Column, str | Column]) -> DataFrame:
    """(section, key, value) of one figure a row, from tables with their key and figure."""
    rows = []
    for section, (df, key, value) in parts.items():
        key, value = (F.col(x) if isinstance(x, str) else x for x in (key, value))
        rows.append(df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value")))
    return reduce(DataFrame.unionByName, rows)


def counted(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def rescan(prev: DataFrame, scan: DataFrame, edges: DataFrame, component: str = "component_id") -> Tables:
    """A new scan merged into the run before: how each finding moved, the unchanged ones that a change reaches, evidence that no
    longer holds, rule violations, and a summary."""
    merged = saved(joins.merge_rescan(prev, scan))
    changed = merged.where("change in ('changed', 'new', 'moved')").join(scan.select(F.col("finding_id").alias("new_id"), F.col(component).alias("node")), "new_id").select("node").distinct()
    impacted = graphs.impact(changed, graphs.upstream_closure(edges, changed))
    reached = merged.where("change = 'unchanged'").join(scan.select(F.col("finding_id").alias("new_id"), F.col(component).alias("node")), "new_id").join(impacted.select("node"), "node", "left_semi")
    violations = quality.validate(quality.duplicate_ids(scan, "finding_id"), quality.stale(prev, scan, "finding_id", "fingerprint"))
    return {"merged": merged, "impacted": reached, "violations": violations, "summary": counted(merged, "change")}


def trace(spans: DataFrame, components: DataFrame, static: DataFrame, attributes: list[str], known: DataFrame | None = None) -> Tables:
    """Spans to components (by name, then by path), edges between parents and children, how they stand to static ones, and
    what of it is new to the ``known`` spans."""
    own = spans if known is None else spans.join(known.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti")
    by_name = mapping.map_component(own, components, attributes)
    rest = own.join(by_name.where("method = 'unmapped'").select("span_id"), "span_id", "left_semi")
    by_path = mapping.map_by_path_suffix(rest, components)
    mapped = saved(by_name.where("method <> 'unmapped'").select("span_id", "component_id", "method").unionByName(by_path))
    every = saved(own.join(mapped, "span_id", "left").withColumn("method", F.coalesce("method", F.lit("unmapped"))))
    edges = joins.parent_child(every.select("trace_id", "span_id", "parent_span_id", F.col("component_id").alias("component")))
    aligned = joins.align_static(edges, static)
    return {"spans": every, "edges": aligned, "methods": counted(every, "method"), "alignment": counted(aligned, "alignment")}


def fusion(nodes: DataFrame, channels: Tables, findings: DataFrame, component: str = "component_id", k: int = 25) -> Tables:
    """All call edges between known nodes, fused by channel, with review leads and the findings' links."""
    parts = [e.select("source", "target", F.lit(name).alias("channel")) for name, e in channels.items()]
    known = nodes.select("node").distinct()
    edges = reduce(DataFrame.unionByName, parts).join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    fused = saved(stats.fuse_channels(edges))
    leads = stats.review_leads(fused.withColumn("item", F.concat_ws(">", "source", "target")), "classification", "item", k)
    chain = assurance.linked_flags(findings.select(component, "finding_id"), component, calls=fused.select(F.col("source").alias(component)), called=fused.select(F.col("target").alias(component)))
    return {"edges": fused, "leads": leads, "chain": chain}


def scan_fusion(results: DataFrame, components: DataFrame) -> Tables:
    """Scanner results mapped to components, and clusters at one place under one taxon (or rule) with the tools that agree."""
    places = mapping.suffix_range_map(results.select("path", "line"), components, ["path", "line"])
    taxa = results.withColumn("taxon", F.explode(C.taxa_or_rule(F.col("taxa"), F.col("rule_id"))))
    clusters = taxa.groupBy("path", "line", "taxon").agg(F.count("*").alias("results"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.countDistinct("tool").alias("n_tools"))
    clusters = clusters.join(places, ["path", "line"]).withColumn("multi_tool", F.col("n_tools") > 1)
    return {"places": places, "clusters": clusters, "status": counted(places, "status")}


def vulnerability(sbom: DataFrame, advisories: DataFrame, aliases: DataFrame, kev: DataFrame, epss: DataFrame, rules: DataFrame) -> Tables:
    """Advisories merged by alias, matched to components, decided by a table of rules, and counted.

    Aliases are (advisory_id, alias); a merged advisory is named by its least identifier."""
    hub = aliases.select(F.concat(F.lit("a:"), F.col("advisory_id").cast("string")).alias("a"), F.concat(F.lit("b:"), F.col("alias").cast("string")).alias("b"))
    labels = graphs.components(hub).where("node like 'a:%'").select(F.substring("node", 3, 40).alias("id"), "label")
    merged = saved(advisories.join(labels, advisories["advisory_id"].cast("string") == F.col("id"), "left").select(advisories["*"], F.coalesce("label", F.concat(F.lit("a:"), F.col("advisory_id").cast("string"))).alias("group")))
    state = vulns.vuln_worst(sbom, merged, kev, epss)
    state = saved(state.select("bom_ref", "group", "state", F.when(F.col("known_exploited"), "active").otherwise("none").alias("exploitation"), "epss"))
    decided = saved(joins.decision_table(state, rules, ["state", "exploitation"]))
    return {"matches": decided, "states": counted(decided, "state"), "outcomes": counted(decided, "outcome")}


def benchmark(predictions: DataFrame, ratings: DataFrame, floor: float, reps: int = 60, seed: int = 17) -> Tables:
    """Confusion with bounds, calibration and agreement, and one verdict."""
    c = stats.confusion(predictions)
    bounds = workflow.metric_bounds(predictions.select(F.col("repository").alias("cluster"), (F.col("expected") == F.col("predicted")).cast("long").alias("k"), F.lit(1).cast("long").alias("n")), reps, seed, floor)
    ece = stats.expected_calibration_error(predictions)
    alpha = stats.krippendorff_alpha(ratings, "doc_id", "predicted")
    # four tables of one row
    row = c.join(F.broadcast(bounds.select("conservative_low"))).join(F.broadcast(ece.select("ece"))).join(F.broadcast(alpha.select("alpha")))
    verdict = stats.gate(row, {"accuracy": F.col("conservative_low") >= floor, "calibration": F.col("ece") <= 0.1, "agreement": F.col("alpha") >= 0.667, "recall": F.col("recall") >= floor})
    return {"verdict": verdict, "bounds": bounds}


def differential(predictions: DataFrame, most_disagreement: float) -> Tables:
    """Each tool's confusion, paired tests between tools, and the cases they answer differently."""
    by_tool, pairs, queue = stats.confusion(predictions, "tool"), stats.mcnemar(predictions), saved(stats.disagreements(predictions))
    share = predictions.agg(F.countDistinct("doc_id").alias("cases")).join(F.broadcast(queue.agg(F.count("*").alias("disagreements"))))
    verdict = stats.gate(share, {"disagreement": F.col("disagreements") <= most_disagreement * F.col("cases")})
    return {"tools": by_tool, "pairs": pairs, "queue": queue, "verdict": verdict}


def tevv(events: DataFrame, windows: DataFrame, changes: DataFrame, keys: list[str], error_limit: float, p95_limit: float) -> Tables:
    """Events in their windows, the version in force at each window's start and changes inside one, health, and a verdict a window."""
    inside = joins.events_in_windows(events, windows, keys)
    health = stats.window_health(inside, keys[0], error_limit, p95_limit)
    version = joins.version_as_of(windows, changes, keys, ts="started_at").select(*keys, "version")
    broken = joins.changes_inside(windows, changes, keys).select(*keys, F.col("changes").alias("changes_inside"))
    rows = windows.select(*keys).join(health.withColumnRenamed("passed", "healthy"), keys, "left").join(version, keys, "left").join(broken, keys, "left")
    rows = rows.withColumn("changes_inside", F.coalesce("changes_inside", F.lit(0)))
    return {"windows": stats.gate(rows, {"health": F.col("healthy"), "one_version": F.col("changes_inside") == 0, "has_version": F.col("version").isNotNull()})}


def release(candidates: DataFrame, references: DataFrame, base: DataFrame, candidate: DataFrame, threshold: float, margin: float) -> Tables:
    """Leakage between corpora, metrics that must not fall, and a verdict."""
    leaks = saved(claims.leakage_pairs(candidates, references, threshold, ["content"]))
    kept = saved(assurance.noninferior(base, candidate, "metric", margin))
    row = leaks.agg(F.count("*").alias("leaks")).join(F.broadcast(kept.agg(F.count_if(F.col("state") != "pass").alias("worse"))))
    return {"leaks": leaks, "metrics": kept, "verdict": stats.gate(row, {"disjoint": F.col("leaks") == 0, "noninferior": F.col("worse") == 0})}


def diagnostics(findings: DataFrame, components: DataFrame, sites: DataFrame, edges: DataFrame, spans: DataFrame) -> Tables:
    """Where findings gather, finding families, how much of the code was seen running, and a grade for it."""
    score = workflow.corroboration(components, sites, edges, spans)
    return {"components": counted(findings, "component_id"), "families": reviews.families(findings), "runtime": score.withColumn("grade", C.grade(F.col("score")))}


def workbench(findings: DataFrame, obligations: DataFrame, batch: int = 100) -> Tables:
    """What reviewers work on: clusters, verification portfolio, a stratified sample and batches of it."""
    sample = saved(ranking.stratified_sample(findings, "rule_id", ["screening_priority"], "finding_id"))
    return {
        "clusters": reviews.review_clusters(findings, ["rule_id", "failure_class"]), "portfolio": reviews.evidence_portfolio(obligations, findings, ["rule_id", "failure_class"]),
        "sample": sample, "batches": ranking.batches(sample.select("finding_id"), "finding_id", batch),
    }


def pr_diff(base: DataFrame, head: DataFrame, fields: list[str]) -> Tables:
    """A base and a head run: what changed, and evidence that no longer holds."""
    diff = saved(joins.diff_runs(base, head, "finding_id", fields))
    return {"diff": diff, "invalidated": joins.invalidated(base, head), "summary": counted(diff, "change"), "same_population": sets.population_equal(base.select("finding_id"), head.select("finding_id"))}
