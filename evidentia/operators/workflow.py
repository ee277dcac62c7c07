"""Work states, progress, studies, triage, cohorts and bounds of metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.columns import ratio, wilson
from evidentia.operators.stats import cluster_bootstrap

#: States of an obligation.
TERMINAL = ["verified", "accepted_risk", "closed", "not_applicable"]
PLANNING_READY = ["confirmed", "control_implemented", "verification_planned", "test_proposed", "evidence_collected", "partially_verified", "verified", "residual_risk_review"]
#: Work states in their order, each with its next action.
WORK_STATES = [
    ("contract_gap", "repair_assurance_register"), ("definition_required", "define_assurance_contract"), ("plan_review_required", "review_assurance_plan"),
    ("execution_remediation_required", "remediate_execution"), ("evidence_remediation_required", "remediate_evidence"), ("ready_for_implementation", "implement_test"),
    ("ready_for_execution", "execute_test"), ("evidence_review_required", "review_execution_evidence"), ("verification_review_required", "complete_verification_review"), ("resolved", "none"),
]


def latest_execution(executions: DataFrame) -> DataFrame:
    """Each obligation's last execution by (ran_at, execution_id)."""
    return executions.groupBy("obligation_id").agg(F.max(F.struct("ran_at", "execution_id", "status", "reviewed")).alias("x"), F.count("*").alias("executions")).select("obligation_id", "executions", "x.*")


def work_queue(findings: DataFrame, obligations: DataFrame, executions: DataFrame) -> DataFrame:
    """(finding_id, obligation_id, priority, component, state, next_action, automation_eligible, state_order) of accepted findings;
    order by state_order, priority (high, medium, low), component and finding_id.

    Obligations: (obligation_id, finding_id, assurance_status, evidence_status, gaps, reviewer, rationale, implementation)."""
    counted = obligations.groupBy("finding_id").agg(F.count("*").alias("n"), F.min(F.struct("obligation_id", "assurance_status", "evidence_status", "gaps", "reviewer", "rationale", "implementation")).alias("o"))
    rows = findings.join(counted, "finding_id", "left").select("finding_id", "priority", "component", F.coalesce("n", F.lit(0)).alias("n"), "o.*")
    rows = rows.join(latest_execution(executions), "obligation_id", "left")
    ready = F.col("assurance_status").isin(PLANNING_READY) & (F.coalesce("reviewer", F.lit("")) != "") & (F.coalesce("rationale", F.lit("")) != "")
    evidence = F.coalesce("evidence_status", F.lit("missing"))
    state = (
        F.when(F.col("n") != 1, "contract_gap").when(F.col("assurance_status").isin(TERMINAL), "resolved").when(F.coalesce("gaps", F.lit(0)) > 0, "definition_required")
        .when(~F.coalesce(ready, F.lit(False)), "plan_review_required").when(F.coalesce("implementation", F.lit("")) != "implemented", "ready_for_implementation")
        .when(F.col("executions").isNull(), "ready_for_execution").when(F.col("status").isin("failed", "timeout", "error"), "execution_remediation_required")
        .when(evidence.isin("insufficient", "partial", "stale"), "evidence_remediation_required")
        .when(~F.coalesce("reviewed", F.lit(False)) | evidence.isin("missing", "collected_unreviewed"), "evidence_review_required").otherwise("verification_review_required")
    )
    order = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(WORK_STATES) for x in (s, i)])
    action = F.create_map(*[F.lit(x) for kv in WORK_STATES for x in kv])
    out = rows.withColumn("state", state)
    return out.select("finding_id", F.when(F.col("n") == 1, F.col("obligation_id")).alias("obligation_id"), "priority", "component", "state", action[F.col("state")].alias("next_action"),
                      F.col("state").isin("ready_for_implementation", "ready_for_execution").alias("automation_eligible"), order[F.col("state")].alias("state_order"))


def assurance_summary(obligations: DataFrame, executions: DataFrame) -> DataFrame:
    """(measure, value, n): active obligations by status, method and evidence, executions by status, and totals."""
    active = obligations.where("source_status = 'active'")
    by = lambda df, c, name: df.groupBy(F.coalesce(c, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "value", "n")
    total = lambda df, name, test: df.agg(F.count_if(test).alias("n")).select(F.lit(name).alias("measure"), F.lit("").alias("value"), "n")
    parts = [
        by(active, "assurance_status", "status"), by(active, "verification_method", "method"), by(active, "evidence_status", "evidence"), by(executions, "status", "execution"),
        total(obligations, "active_obligations", F.col("source_status") == "active"), total(obligations, "retired_obligations", F.col("source_status") != "active"),
        total(active, "implemented_tests", F.col("implementation") == "implemented"), total(active, "planning_gaps", F.col("gaps") > 0), total(executions, "reviewed_executions", F.col("reviewed")),
    ]
    return reduce(DataFrame.unionByName, parts)


def assurance_progress(findings: DataFrame, obligations: DataFrame, executions: DataFrame) -> DataFrame:
    """One row on how far accepted findings (finding_id, disposition, source_status) are planned, tested and verified, with gates.

    A finding counts as planned or verified only by exactly one active obligation that is; obligations that don't apply or whose
    risk is accepted need no test.  Percentages over nothing are null, and the gates then hold."""
    active = obligations.where(F.coalesce("source_status", F.lit("active")) == "active")
    accepted = findings.where((F.coalesce("source_status", F.lit("active")) == "active") & (F.col("disposition") == "accepted")).select("finding_id").distinct()
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    ready = F.coalesce(F.col("assurance_status").isin(PLANNING_READY) & text("reviewer") & text("rationale") & (F.coalesce("gaps", F.lit(0)) == 0), F.lit(False))
    terminal = F.coalesce(F.col("assurance_status").isin(TERMINAL), F.lit(False))
    by_finding = active.groupBy("finding_id").agg(F.count("*").alias("n"), F.bool_and(ready).alias("ready"), F.bool_and(terminal).alias("terminal"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    a = accepted.join(by_finding, "finding_id", "left").agg(
        F.count("*").alias("findings"), F.count_if(~one).alias("cardinality_gaps"), F.count_if(one & F.col("ready")).alias("planning_ready"), F.count_if(one & F.col("terminal")).alias("verified"))
    runs = executions.select("obligation_id").distinct().withColumn("ran", F.lit(True))
    own = active.join(accepted.withColumn("applies", F.lit(True)), "finding_id", "left").join(runs, "obligation_id", "left")
    applies = F.col("applies").isNotNull()
    tested = applies & ~F.coalesce(F.col("assurance_status").isin("not_applicable", "accepted_risk"), F.lit(False))
    b = own.agg(
        F.count("*").alias("active_obligations"), F.count_if(applies).alias("applicable_obligations"), F.count_if(applies & (F.col("gaps") > 0)).alias("planning_gaps"),
        F.count_if(tested).alias("test_required"), F.count_if(tested & (F.col("implementation") == "implemented")).alias("implemented_tests"), F.count_if(tested & F.col("ran")).alias("executed_obligations"),
        F.count_if(applies & (F.col("evidence_status") == "sufficient")).alias("sufficient_evidence"))
    c = executions.agg(F.count("*").alias("executions"), F.count_if(~F.coalesce("reviewed", F.lit(False))).alias("unreviewed_executions"),
                       F.count_if(F.col("status").isin("failed", "timeout", "error")).alias("failed_executions"))
    # three tables of one row
    row = a.join(F.broadcast(b)).join(F.broadcast(c))
    percent = lambda k, n: F.round(100 * ratio(F.col(k), F.col(n)), 1)
    whole = F.col("cardinality_gaps") == 0
    return row.withColumns({
        "planning_percent": percent("planning_ready", "findings"), "implementation_percent": percent("implemented_tests", "test_required"), "verification_percent": percent("verified", "findings"),
        "register_complete": whole, "plan_ready": whole & (F.col("planning_ready") == F.col("findings")), "verification_complete": whole & (F.col("verified") == F.col("findings"))})


def metric_bounds(metrics: DataFrame, reps: int, seed: int, floor: float, by: str | None = None) -> DataFrame:
    """(metric or by, k, n, wilson_low, bootstrap_low, conservative_low, passed) from one row (cluster, k, n, by) a repository:
    the lesser of the score interval's and the cluster bootstrap's lower bound, against a floor.

    All strata are summed and resampled in one pass; without rows there are no bounds."""
    rows = metrics.select((F.col(by) if by else F.lit("all")).alias("stratum"), "cluster", "k", "n").groupBy("stratum", "cluster").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    totals = rows.groupBy("stratum").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    drawn = cluster_bootstrap(rows, reps, seed, by="stratum").select(F.col("stratum").alias("its"), F.col("low").alias("bootstrap_low"))
    both = totals.join(drawn, F.col("stratum").eqNullSafe(F.col("its"))).select("stratum", "k", "n", wilson(F.col("k"), F.col("n"))["low"].alias("wilson_low"), "bootstrap_low")
    low = F.least("wilson_low", "bootstrap_low")
    return both.withColumn("conservative_low", low).withColumn("passed", F.coalesce(F.col("conservative_low") >= floor, F.lit(False)))


def segment_features(repositories: DataFrame, field: str) -> DataFrame:
    """(label, repositories, expected, actual, matched, precision, recall) for each label of a multi-valued field."""
    g = repositories.select("repository", F.explode(F.array_distinct(field)).alias("label"), "expected", "actual", "matched").groupBy("label").agg(
        F.countDistinct("repository").alias("repositories"), *[F.sum(c).alias(c) for c in ("expected", "actual", "matched")])
    return g.withColumns({"precision": ratio(F.col("matched"), F.col("actual")), "recall": ratio(F.col("matched"), F.col("expected"))})


def compare_eval(before: DataFrame, after: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, before, after, delta, passed): a metric may fall by its limit (0 where none is set); one that only one side
    has, or that is null, has no delta and doesn't pass."""
    a, b = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    rows = a.join(b, "metric", "full").join(limits, "metric", "left").withColumn("delta", F.round(F.col("after") - F.col("before"), 4))
    return rows.select("metric", "before", "after", "delta", F.coalesce(F.col("delta") >= -F.coalesce("most_fall", F.lit(0.0)), F.lit(False)).alias("passed"))


def guidance_coverage(findings: DataFrame, links: DataFrame, reuse: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(strongest, findings, pct), and (citation_id, uses, broadly_reused), from links (finding_id, citation_id, strength)."""
    order = ["direct", "supporting", "contextual"]
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strength")).cast("int"), F.lit(0))
    best = links.where(rank > 0).groupBy("finding_id").agg(F.min(rank).alias("rank"))
    name = reduce(lambda c, i: F.when(F.col("rank") == i + 1, order[i]).otherwise(c), range(3), F.lit("uncited"))
    total = findings.count()
    kinds = findings.join(best, "finding_id", "left").groupBy(name.alias("strongest")).agg(F.count("*").alias("findings"))
    uses = links.join(findings.select("finding_id"), "finding_id", "left_semi").groupBy("citation_id").agg(F.count("*").alias("uses"))
    return kinds.withColumn("pct", 100 * F.col("findings") / F.lit(max(total, 1))), uses.withColumn("broadly_reused", F.col("uses") >= reuse * total)


def review_expiry(mappings: DataFrame, as_of: str) -> DataFrame:
    """(mapping_id, state) of approved mappings that have an expiry: current, expired before the day, or invalid."""
    day = F.when(F.col("expires_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_to_date(expires_at)"))
    rows = mappings.where("decision = 'approved' and trim(coalesce(expires_at, '')) <> ''")
    return rows.select("mapping_id", F.when(day.isNull(), "invalid").when(day < F.lit(as_of).cast("date"), "expired").otherwise("current").alias("state"))


def corroboration(components: DataFrame, sites: DataFrame, edges: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: observed components, static edges that were seen, runtime-only edges, open call sites, and the score.

    Sites: (component_id, target) with a null target where unresolved."""
    ids = components.select("component_id").distinct()
    inside = lambda df, c: df.join(ids.withColumnRenamed("component_id", c), c, "left_semi")
    static = inside(sites.where("target is not null"), "target").select(F.col("component_id").alias("source"), "target").distinct()
    runtime = inside(inside(edges, "source"), "target").select("source", "target").distinct()
    seen = reduce(DataFrame.unionByName, [edges.select(F.col(c).alias("component_id")) for c in ("source", "target")] + [spans.select("component_id")])
    one = [
        ids.agg(F.count("*").alias("eligible")), inside(seen, "component_id").agg(F.countDistinct("component_id").alias("observed")),
        static.withColumn("s", F.lit(1)).join(runtime.withColumn("r", F.lit(1)), ["source", "target"], "full").agg(
            F.count("s").alias("static_edges"), F.count("r").alias("runtime_edges"), F.count_if(F.col("s").isNotNull() & F.col("r").isNotNull()).alias("corroborated"), F.count_if(F.col("s").isNull()).alias("runtime_only")),
        sites.join(ids.select(F.col("component_id").alias("target"), F.lit(True).alias("known")), "target", "left").agg(F.count("*").alias("call_sites"), F.count_if(F.col("known").isNull()).alias("unresolved")),
    ]
    # four tables of one row each
    row = reduce(lambda a, b: a.join(F.broadcast(b)), one)
    pct = lambda a, b: F.round(ratio(F.col(a) * 100.0, F.col(b)), 1)
    row = row.withColumns({"component_pct": F.coalesce(pct("observed", "eligible"), F.lit(0.0)), "static_edge_pct": pct("corroborated", "static_edges"), "unresolved_pct": pct("unresolved", "call_sites")})
    return row.withColumn("score", F.round(F.when(F.col("static_edge_pct").isNull(), F.col("component_pct")).otherwise((F.col("component_pct") + F.col("static_edge_pct")) / 2), 1))


def segment_decisions(memberships: DataFrame, samples: DataFrame) -> DataFrame:
    """(segment, samples, expected_proposed, actual_proposed, decision_accuracy, fault_categories) of samples (sample_id,
    expected, actual, category)."""
    rows = memberships.distinct().join(samples, "sample_id")
    proposed = lambda c: F.count_if(F.col(c) == "proposed")
    return rows.groupBy("segment").agg(F.count("*").alias("samples"), proposed("expected").alias("expected_proposed"), proposed("actual").alias("actual_proposed"),
                                       F.round(F.avg((F.col("expected") == F.col("actual")).cast("double")), 4).alias("decision_accuracy"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("fault_categories"))


def study_results(studies: DataFrame, least_participants: int, most_errors: int) -> DataFrame:
    """(id, task_success_rate, passed) of usability studies."""
    rate = ratio(F.col("successful_tasks"), F.col("task_attempts"))
    passed = (F.col("participants") >= least_participants) & (rate >= 0.9) & (F.col("critical_errors") <= most_errors) & (F.col("satisfaction") >= F.col("least_satisfaction")) & F.col("accessible")
    return studies.select("id", F.coalesce(F.round(rate, 6), F.lit(0.0)).alias("task_success_rate"), F.coalesce(passed, F.lit(False)).alias("passed"))


def proof_results(records: DataFrame) -> DataFrame:
    return records.select("id", ((F.col("properties") > 0) & (F.col("proved") == F.col("properties")) & (F.col("counterexamples") == 0)).alias("passed"))


def recovery_results(exercises: DataFrame) -> DataFrame:
    met = F.col("restored") & (F.col("recovery_s") <= F.col("rto_s")) & (F.col("loss_s") <= F.col("rpo_s")) & (F.col("unresolved") == 0)
    return exercises.select("id", F.coalesce(met, F.lit(False)).alias("passed"))


def source_health(sources: DataFrame) -> DataFrame:
    """One row of counts; complete is verified, at its own address and revision, with a later review date, licence, digest and
    reviewer.  'unassigned' stands for what is missing."""
    given = reduce(lambda a, b: a & b, [F.col(c) != "unassigned" for c in ("revision", "license_id", "reviewer")])
    digest = F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("sha256") != "0" * 64)
    complete = (F.col("status") == "verified") & (F.col("observed_url") == F.col("canonical_url")) & (F.col("next_review_at") > F.col("observed_at")) & given & digest
    return sources.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.coalesce(complete, F.lit(False))).alias("complete"),
                       F.count_if(F.col("adapter_mode") != "contract-only").alias("native"), F.count_if(F.col("adapter_mode") == "contract-only").alias("contract_only"))


def crash_triage(crashes: DataFrame) -> DataFrame:
    """(campaign, crashes, duplicate_ids, inconsistent, unresolved, complete): a crash is not reproducible exactly if it wasn't
    reproduced, and a fixed one names its revision."""
    allowed = F.col("disposition").isin("open", "fixed", "accepted", "not_reproducible", "duplicate")
    wrong = ~allowed | ((F.col("disposition") == "not_reproducible") == F.col("reproduced")) | ((F.col("disposition") == "fixed") & F.coalesce("fixed_in", F.lit("unassigned")).isin("", "unassigned"))
    ids = crashes.groupBy("campaign", "crash_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("reproduced") & (F.col("disposition") == "open")).alias("open"),
                                                      F.count_if(F.coalesce("finding_ref", F.lit("")) == "").alias("unlinked"))
    out = ids.groupBy("campaign").agg(F.sum("n").alias("crashes"), F.sum(F.col("n") - 1).alias("duplicate_ids"), F.sum("wrong").alias("inconsistent"), F.sum("open").alias("unresolved"), F.sum("unlinked").alias("unlinked"))
    return out.withColumn("complete", (F.col("duplicate_ids") == 0) & (F.col("inconsistent") == 0) & (F.col("unlinked") == 0)).drop("unlinked")


def mutation_ratchet(results: DataFrame, groups: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(group, killed, survived, other, score) and the mutants (mutant, groups) that fall in no group or in several.

    Results are (mutant, exit_code): 1 and 3 killed, 0 and 33 survived, anything else counts as other.  Groups are the user's globs."""
    from evidentia.functions.columns import glob_match

    hits = F.array_compact(F.array(*[F.when(glob_match(F.col("mutant"), g), F.lit(n)) for n, g in sorted(groups.items())]))
    rows = results.withColumn("hits", hits)
    status = F.when(F.col("exit_code").isin(1, 3), "killed").when(F.col("exit_code").isin(0, 33), "survived").otherwise("other")
    g = rows.where(F.size("hits") == 1).select(F.col("hits")[0].alias("group"), status.alias("s")).groupBy("group").agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("killed", "survived", "other")])
    return g.withColumn("score", ratio(F.col("killed"), F.col("killed") + F.col("survived"))), rows.where(F.size("hits") != 1).select("mutant", F.size("hits").alias("groups"))


def mcdc_summary(pairs: DataFrame, requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decision, conditions, covered, complete) from pairs (decision, condition, covered), and (requirement, covered): all of
    its decisions, one at least, are complete."""
    d = pairs.groupBy("decision").agg(F.count("*").alias("conditions"), F.count_if("covered").alias("covered")).withColumn("complete", F.col("conditions") == F.col("covered"))
    r = requirements.join(d.select("decision", "complete"), "decision", "left").groupBy("requirement").agg(F.coalesce(F.bool_and(F.coalesce("complete", F.lit(False))), F.lit(False)).alias("covered"))
    return d, r


def adapter_contributions(entities: DataFrame) -> DataFrame:
    """(adapter_id, entities, alone): what each adapter contributed, and what no other did."""
    n = F.size(F.array_distinct("adapter_ids"))
    rows = entities.select(F.explode(F.array_distinct("adapter_ids")).alias("adapter_id"), (n == 1).alias("alone"))
    return rows.groupBy("adapter_id").agg(F.count("*").alias("entities"), F.count_if("alone").alias("alone"))


def cohort_projection(evaluations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One cohort row (repository, expected, actual, matched) for each qualified repository, and (repository, reasons) of the
    others: no expected cases, matched beyond either side, labels that were not independent, or a repeated repository."""
    n = evaluations.groupBy("repository").agg(F.count("*").alias("n"), F.first("expected").alias("expected"), F.first("actual").alias("actual"), F.first("matched").alias("matched"), F.bool_and("independent").alias("independent"))
    tests = {"no_expected_cases": F.col("expected") <= 0, "not_independent": ~F.col("independent"), "repeated": F.col("n") > 1, "matched_too_many": (F.col("matched") > F.col("expected")) | (F.col("matched") > F.col("actual"))}
    reasons = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in sorted(tests.items())])), ",")
    rows = n.withColumn("reasons", reasons)
    return rows.where("reasons = ''").select("repository", "expected", "actual", "matched"), rows.where("reasons <> ''").select("repository", "reasons")


def label_projection(claims: DataFrame, by: list[str]) -> DataFrame:
    """Counts of independently labelled claims (label supported, predicted supported) and how many were right."""
    known = claims.where("label is not null and independent")
    return known.groupBy(*by).agg(F.count("*").alias("claims"), F.count_if(F.col("label") == F.col("predicted")).alias("right"), F.count_if(F.col("label") & ~F.col("predicted")).alias("missed"),
                                  F.count_if(~F.col("label") & F.col("predicted")).alias("wrongly_supported")).withColumn("accuracy", ratio(F.col("right"), F.col("claims")))


def projection_ledger(sections: DataFrame, declarations: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(section, records, status): empty, provenance_only, projected, registered_without_projection or unmapped.

    Declarations: (section, mode, kinds, channels); entities by kind and relations by channel tell what was projected."""
    kinds = entities.groupBy("kind").agg(F.count("*").alias("n"))
    channels = relations.groupBy("channel").agg(F.count("*").alias("n"))
    a = declarations.select("section", F.explode("kinds").alias("kind")).join(kinds, "kind").select("section", "n")
    b = declarations.select("section", F.explode("channels").alias("channel")).join(channels, "channel").select("section", "n")
    projected = a.unionByName(b).groupBy("section").agg(F.sum("n").alias("projected"))
    rows = sections.groupBy("section").agg(F.sum("records").alias("records")).join(declarations.select("section", "mode"), "section", "left").join(projected, "section", "left")
    status = (F.when(F.col("records") == 0, "empty").when(F.col("mode") == "provenance_only", "provenance_only").when(F.col("projected") > 0, "projected")
              .when(F.col("mode").isNotNull() & (F.col("mode") != "unmapped"), "registered_without_projection").otherwise("unmapped"))
    return rows.select("section", "records", F.coalesce("projected", F.lit(0)).alias("projected"), status.alias("status"))


def common_cause_candidates(components: DataFrame, findings: DataFrame, cut_sets: DataFrame) -> DataFrame:
    """(candidate, source, involved, linked): common-cause components with what they affect and their own findings, and the
    cut sets of approved trees with the findings they name."""
    own = findings.groupBy("component_id").agg(F.count("*").alias("linked"))
    cause = components.where("kind = 'common_cause'").join(own, "component_id", "left")
    a = cause.select(F.concat(F.lit("component:"), F.col("component_id").cast("string")).alias("candidate"), F.lit("project_defined_common_cause").alias("source"), F.size("affected").cast("long").alias("involved"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"))
    b = cut_sets.select(F.concat(F.lit("cut_set:"), F.col("cut_set_id")).alias("candidate"), F.lit("approved_cut_set").alias("source"), F.lit(0).cast("long").alias("involved"), F.size("finding_ids").cast("long").alias("linked"))
    return a.unionByName(b)


def evidence_packets(components: DataFrame, findings: DataFrame, edges: DataFrame, limit: int, per_component: int) -> DataFrame:
    """One record a component: its first findings, the callees observed from it and what was left out, for the ``limit``
    components with most findings.  Lists are ranked and bounded before they are gathered."""

    def first(df: DataFrame, key: str, item: str, name: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(item)
        top = df.select(key, item).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_component)
        got = top.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
        return df.groupBy(key).agg(F.countDistinct(item).alias(f"{name}_total")).join(got, key)

    f = first(findings, "component_id", "finding_id", "findings")
    e = first(edges, "source", "target", "callees").withColumnRenamed("source", "component_id")
    rows = components.select("component_id", "name").join(f, "component_id", "left").join(e, "component_id", "left")
    total = F.coalesce("findings_total", F.lit(0))
    return rows.select("component_id", "name", "findings", "callees", (total - F.coalesce(F.size("findings"), F.lit(0))).alias("omitted_findings"), total.alias("total")).orderBy(F.desc("total"), "component_id").limit(limit)


def review_dispositions(unmatched: DataFrame, k: int, decisions: dict[str, list[str]]) -> DataFrame:
    """(side, rank, id, decisions, omitted): the first k unmatched records of each side, the decisions one may take, and how many
    more there are."""
    w = Window.partitionBy("side").orderBy("id")
    totals = unmatched.groupBy("side").agg(F.count("*").alias("n"))
    choices = F.create_map(*[x for s, d in sorted(decisions.items()) for x in (F.lit(s), F.lit(",".join(d)))])
    first = unmatched.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return first.join(totals, "side").select("side", "rank", "id", choices[F.col("side")].alias("decisions"), F.greatest(F.lit(0), F.col("n") - k).alias("omitted"))
