"""Fixed policies of assurance: what verifies a finding, which exposures meet, where a review and a vulnerability stand, and
how whole a finding's links are.  Columns that are null count as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.assurance import by_prefix, holding, ladder

#: The first prefix that a rule begins with names the method.
METHOD_BY_PREFIX = [
    ("resilience.circuit_breaker_", "fault_injection_test"), ("storage.", "fault_injection_test"), ("persistence.", "fault_injection_test"),
    ("state.", "state_transition_test"), ("timing.", "concurrency_test"), ("resource.", "stress_test"), ("detection.", "fault_injection_test"),
    ("configuration.", "configuration_inspection"), ("environment.", "configuration_inspection"), ("interface.contract", "contract_test"),
    ("interface.", "integration_test"), ("common_cause.", "architecture_review"),
]
#: Words in a rule that call for a test of security.
SECURITY_WORDS = ["access", "auth", "trust", "untrusted", "outbound"]
#: How each method brings about what triggers a failure.
STIMULI = {
    "fault_injection_test": "Inject or force", "property_test": "Generate boundary, invalid, and adversarial inputs representing",
    "fuzz_test": "Generate malformed and unexpected inputs representing", "state_transition_test": "Drive the component through valid and invalid transitions representing",
    "concurrency_test": "Control scheduling and repeat interleavings representing", "stress_test": "Apply bounded load and resource pressure representing",
    "security_test": "Submit unauthorized or adversarial requests representing", "configuration_inspection": "Evaluate valid, missing, and conflicting configuration representing",
    "architecture_review": "Inspect and challenge architectural independence for", "contract_test": "Provide compatible, missing, malformed, and incompatible contracts representing",
    "unit_test": "Invoke the component with controlled inputs representing", "integration_test": "Stimulate the representative boundary with",
    "static_analysis": "Evaluate the source and configuration for",
}
#: Methods that need something injected.
INJECTED = ["fault_injection_test", "concurrency_test", "stress_test", "security_test"]
#: Exposures and the dimensions that must meet; of those in one tuple any will do.
EXPOSURES = {
    "authorization_context_at_contract_boundary": [("authorization_scope",), ("contract_semantics",)],
    "authorization_context_crosses_data_flow": [("authorization_scope",), ("data_flow",)],
    "concurrent_state_transition": [("concurrency",), ("state_machine",)],
    "contract_at_interface_boundary": [("contract_semantics",), ("interfaces",)],
    "contract_carries_interprocedural_data": [("contract_semantics",), ("data_flow",)],
    "exception_during_state_transition": [("exception_propagation",), ("state_machine",)],
    "exception_near_resilience_or_side_effect_semantics": [("exception_propagation",), ("timing_and_resilience",)],
    "shared_fate_on_declared_deployment": [("deployment_topology",), ("shared_fate",)],
    "state_or_concurrency_near_resilience_semantics": [("concurrency", "state_machine"), ("timing_and_resilience",)],
}
#: A finding's dimensions of links, each with the priority of closing its gap.
DIMENSIONS = {
    "component": "high", "source_provenance": "high", "guidance": "medium", "verification": "medium", "evidence": "low", "requirements": "low", "hazards": "low",
    "sfta": "low", "interfaces": "low", "component_relationships": "low", "cascade_analysis": "low", "timing_and_resilience": "low", "semantic_exposure": "low",
    "verification_readiness": "low",
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def verification_method(rule: Column, failure_class: Column) -> Column:
    """The method by the rule's prefix, else by the kind of failure and by words in the rule."""
    secure = (failure_class == "security") | reduce(lambda a, b: a | b, [rule.contains(w) for w in SECURITY_WORDS])
    by_class = ladder([(failure_class.isin("calculation", "data"), "property_test"), (secure, "security_test"), (failure_class == "logic", "property_test"),
                       (failure_class == "functional", "unit_test")], "integration_test")
    found = by_prefix(rule, METHOD_BY_PREFIX, "")
    return F.when(found != "", found).otherwise(by_class)


def stimulus(method: Column, trigger: Column) -> Column:
    """struct(description, injection_required) of a draft stimulus for what triggers the failure."""
    verbs = F.create_map(*[F.lit(x) for pair in STIMULI.items() for x in pair])
    what = F.when(_text(trigger) != "", trigger).otherwise("the documented failure condition")
    described = F.concat(F.coalesce(verbs[method], F.lit("Stimulate")), F.lit(" "), what, F.lit("."))
    return F.struct(described.alias("description"), F.coalesce(method.isin(INJECTED), F.lit(False)).alias("injection_required"))


def compound_exposure(dimensions: Column) -> Column:
    """Exposures, in order, whose dimensions are all in the array."""
    has = lambda names: F.arrays_overlap(dimensions, F.array(*[F.lit(n) for n in names]))
    return holding({name: reduce(lambda a, b: a & b, [has(n) for n in needed]) for name, needed in EXPOSURES.items()})


def review_state(source_status: Column, revalidate: Column, blocking_errors: Column, disposition: Column, readiness: Column, next_action: Column) -> Column:
    """struct(state, next_action) of a finding's review; accepted findings go on with their readiness' next action."""
    accepted = disposition == "accepted"
    rules = [
        (source_status != "active", "historical", F.lit("none")), (source_status.isNull(), "historical", F.lit("none")),
        (revalidate, "revalidation_required", F.lit("revalidate_finding")), (blocking_errors > 0, "blocked_by_validation", F.lit("resolve_quality_gate_diagnostics")),
        (disposition == "unreviewed", "awaiting_finding_review", F.lit("review_finding")), (disposition == "needs_information", "needs_information", F.lit("collect_missing_information")),
        (accepted & (readiness == "resolved"), "accepted_resolved", F.lit("none")), (accepted, "accepted_assurance_work", _text(next_action)),
    ]
    made = [F.when(c, F.struct(F.lit(state).alias("state"), action.alias("next_action"))) for c, state, action in rules]
    return F.coalesce(*made, F.struct(F.lit("rejected").alias("state"), F.lit("none").alias("next_action")))


def vuln_stage(applicability: Column, reachability: Column, exposure: Column, safety_impact: Column, ssvc: Column, remediation: Column, vex: Column,
               verified_by: Column, csaf: Column, poam: Column) -> Column:
    """struct(stage, blockers): where a vulnerability's handling stands and what holds it up; empty references count as none."""
    unset = lambda c, mark: F.coalesce(c, F.lit(mark)) == mark
    empty = lambda c: _text(c) == ""
    closed, settled = applicability.isin("not_affected", "withdrawn"), F.coalesce(vex.isin("not_affected", "fixed"), F.lit(False))
    open_points = holding({
        "vex_state_required": unset(vex, "unassigned"), "csaf_publication_or_documented_nonapplicability_required": empty(csaf),
        "poam_tracking_required": remediation.isin("planned", "accepted") & empty(poam),
    })
    one = lambda name: F.array(F.lit(name))
    rules = [
        (unset(applicability, "unresolved"), "version_review", one("version_applicability_unresolved")), (closed & ~settled, "publication", one("governed_vex_disposition_required")),
        (closed, "version_not_affected", F.array().cast("array<string>")), (unset(reachability, "not_assessed"), "reachability_review", one("reachability_evidence_required")),
        (unset(exposure, "not_assessed"), "exposure_review", one("deployment_exposure_evidence_required")),
        (unset(safety_impact, "not_assessed") | unset(ssvc, "unassigned"), "priority_review", one("safety_impact_and_ssvc_decision_required")),
        (unset(remediation, "unassigned"), "remediation", one("authorized_remediation_or_acceptance_required")),
        (remediation.isin("planned", "completed") & empty(verified_by), "verification", one("remediation_verification_evidence_required")),
        (F.size(open_points) > 0, "publication", open_points),
    ]
    made = [F.when(c, F.struct(F.lit(stage).alias("stage"), blockers.alias("blockers"))) for c, stage, blockers in rules]
    return F.coalesce(*made, F.struct(F.lit("complete").alias("stage"), F.array().cast("array<string>").alias("blockers")))


def finding_chain(findings: DataFrame, links: DataFrame, key: str = "finding_id", dimensions: list[str] | None = None) -> DataFrame:
    """A flag for each dimension that a finding has links (key, dimension) in, how many lack, and the percentage linked.

    Links of all dimensions are counted in one pass, so a further dimension costs no further join; others than those named are
    passed over."""
    names = list(DIMENSIONS) if dimensions is None else dimensions
    seen = links.groupBy(key).agg(*[F.bool_or(F.col("dimension") == n).alias(n) for n in names])
    rows = findings.select(key).join(seen, key, "left").select(key, *[F.coalesce(n, F.lit(False)).alias(n) for n in names])
    missing = sum((~F.col(n)).cast("int") for n in names)
    return rows.withColumn("missing", missing).withColumn("completeness", F.round(100 * (len(names) - F.col("missing")) / len(names), 1))


def missing_dimensions(chain: DataFrame) -> DataFrame:
    """(dimension, priority, findings) that lack links, from the flags of finding_chain."""
    names = [n for n in DIMENSIONS if n in chain.columns]
    counted = chain.agg(*[F.count_if(~F.col(n)).alias(n) for n in names])
    priority = F.create_map(*[F.lit(x) for n in names for x in (n, DIMENSIONS[n])])
    return counted.unpivot([], names, "dimension", "findings").select("dimension", priority[F.col("dimension")].alias("priority"), "findings")


def plan_vs_outcome(plan: DataFrame, outcomes: DataFrame, cap: float) -> DataFrame:
    """One row on a campaign's plan (id, repository, decision, frozen_at) against its outcomes (id, observed_at).

    It passes if both name the same samples, each once, none was observed before it was frozen, every repository has samples of
    two decisions or more, and none holds more than ``cap`` of all.  Without samples it doesn't pass."""
    planned = plan.groupBy("id").agg(F.count("*").alias("p"), F.max("frozen_at").alias("frozen_at"))
    observed = outcomes.groupBy("id").agg(F.count("*").alias("o"), F.min("observed_at").alias("observed_at"))
    both = planned.join(observed, "id", "full").agg(
        F.count("p").alias("planned"), F.count("o").alias("observed"), F.count_if(F.col("o").isNull()).alias("missing"), F.count_if(F.col("p").isNull()).alias("unplanned"),
        F.count_if((F.col("p") > 1) | (F.col("o") > 1)).alias("repeated"), F.count_if(F.col("observed_at") < F.col("frozen_at")).alias("early"))
    places = plan.groupBy("repository").agg(F.count("*").alias("n"), F.countDistinct("decision").alias("decisions")).agg(
        F.count("*").alias("repositories"), F.count_if(F.col("decisions") < 2).alias("unbalanced"), F.try_divide(F.max("n"), F.sum("n")).alias("largest"))
    # two tables of one row
    row = both.join(F.broadcast(places))
    clean = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in ("missing", "unplanned", "repeated", "early", "unbalanced")])
    return row.withColumn("passed", F.coalesce(clean & (F.col("planned") > 0) & (F.col("largest") <= cap), F.lit(False)))


def resource_ratios(base: DataFrame, candidate: DataFrame, limits: DataFrame, key: str = "resource") -> DataFrame:
    """(key, ratio, state) of a candidate's use of each limited resource (key, most) over the base's: pass, fail, or incomplete
    where a value lacks or the base used nothing."""
    rows = limits.join(base.select(key, F.col("value").alias("base")), key, "left").join(candidate.select(key, F.col("value").alias("candidate")), key, "left")
    ratio = F.try_divide("candidate", "base")
    return rows.select(key, ratio.alias("ratio"), ladder([(ratio.isNull(), "incomplete"), (ratio <= F.col("most"), "pass")], "fail").alias("state"))
