"""Queries of work states, progress, studies, triage, cohorts and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import joins as J
from evidentia.operators import quality as Q
from evidentia.operators import workflow as K
from evidentia.plans.catalog import query
from evidentia.views import table, view


def _accepted(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_findings").where("disposition = 'accepted'").select("finding_id", F.col("screening_priority").alias("priority"), F.col("component_id").alias("component"))


STATES = ", ".join(f"('{s}', '{a}', {i})" for i, (s, a) in enumerate(K.WORK_STATES))
QUEUE = f"""o AS (SELECT finding_id, count(*) AS n, min(obligation_id) AS obligation_id FROM v_work_obligations GROUP BY finding_id),
    x AS (SELECT obligation_id, count(*) AS executions, arg_max(status, (ran_at, execution_id, status, reviewed)) AS status, arg_max(reviewed, (ran_at, execution_id, status, reviewed)) AS reviewed FROM v_executions GROUP BY obligation_id),
    r AS (SELECT f.finding_id, f.screening_priority AS priority, f.component_id AS component, coalesce(o.n, 0) AS n, w.*, x.executions, x.status, x.reviewed FROM v_findings f LEFT JOIN o ON o.finding_id = f.finding_id
      LEFT JOIN v_work_obligations w ON w.obligation_id = o.obligation_id LEFT JOIN x ON x.obligation_id = o.obligation_id WHERE f.disposition = 'accepted'),
    q AS (SELECT finding_id, CASE WHEN n = 1 THEN obligation_id END AS obligation_id, priority, component, CASE WHEN n <> 1 THEN 'contract_gap' WHEN assurance_status = 'verified' THEN 'resolved' WHEN gaps > 0 THEN 'definition_required'
      WHEN assurance_status = 'candidate' OR reviewer = '' OR rationale IS NULL THEN 'plan_review_required' WHEN implementation <> 'implemented' THEN 'ready_for_implementation' WHEN executions IS NULL THEN 'ready_for_execution'
      WHEN status = 'failed' THEN 'execution_remediation_required' WHEN evidence_status = 'partial' THEN 'evidence_remediation_required' WHEN NOT reviewed OR evidence_status IN ('missing', 'collected_unreviewed') THEN 'evidence_review_required'
      ELSE 'verification_review_required' END AS state FROM r)"""


@query(f"""WITH {QUEUE} SELECT q.finding_id, q.obligation_id, q.priority, q.component, q.state, s.a AS next_action, q.state IN ('ready_for_implementation', 'ready_for_execution') AS automation_eligible, s.i AS state_order
    FROM q JOIN (VALUES {STATES}) s(n, a, i) ON s.n = q.state""")
def w11_work_queue(spark, sf_dir):
    return K.work_queue(_accepted(spark, sf_dir), view(spark, sf_dir, "v_work_obligations"), view(spark, sf_dir, "v_executions"))


def _by(column: str, name: str, source: str = "v_work_obligations WHERE source_status = 'active'") -> str:
    return f"SELECT '{name}' AS measure, {column} AS value, count(*) AS n FROM {source} GROUP BY {column}"


@query(" UNION ALL ".join([
    _by("assurance_status", "status"), _by("verification_method", "method"), _by("evidence_status", "evidence"), _by("status", "execution", "v_executions"),
    *[f"SELECT '{n}', '', count(*) FILTER ({t}) FROM {s}" for n, t, s in (
        ("active_obligations", "source_status = 'active'", "v_work_obligations"), ("retired_obligations", "source_status <> 'active'", "v_work_obligations"),
        ("implemented_tests", "source_status = 'active' AND implementation = 'implemented'", "v_work_obligations"), ("planning_gaps", "source_status = 'active' AND gaps > 0", "v_work_obligations"),
        ("reviewed_executions", "reviewed", "v_executions"))]]))
def a44_assurance_summary(spark, sf_dir):
    return K.assurance_summary(view(spark, sf_dir, "v_work_obligations"), view(spark, sf_dir, "v_executions"))


Z = 1.959963984540054
DRAWS = """c AS (SELECT stratum, cluster, k, n, row_number() OVER (PARTITION BY stratum ORDER BY cluster) - 1 AS no, count(*) OVER (PARTITION BY stratum) AS m FROM g),
    d AS (SELECT s.stratum, r.rep, c.k, c.n FROM (SELECT DISTINCT stratum, m FROM c) s CROSS JOIN (SELECT unnest(range(60)) AS rep) r CROSS JOIN (SELECT unnest(range(1000)) AS i) i
      JOIN c ON c.stratum = s.stratum AND c.no = ((((r.rep * 7919 + i.i * 104729 + 17) * 1103515245) % 2147483648) >> 8) % s.m WHERE i.i < s.m),
    b AS (SELECT stratum, quantile_cont(x, 0.025) AS low FROM (SELECT stratum, rep, sum(k) / sum(n) AS x FROM d GROUP BY 1, 2) GROUP BY stratum),
    t AS (SELECT stratum, CAST(sum(k) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS n FROM g GROUP BY stratum)"""
BOUNDS = f"""SELECT stratum, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(w, 9) AS wilson_low, round(low, 9) AS bootstrap_low, round(least(w, low), 9) AS conservative_low, least(w, low) >= 0.6 AS passed
    FROM (SELECT *, greatest(0, (k / n + {Z} * {Z} / (2 * n) - {Z} * sqrt((k / n) * (1 - k / n) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n)) AS w FROM t JOIN b USING (stratum))"""


@query(f"WITH g AS (SELECT 'all' AS stratum, repository AS cluster, count(*) FILTER (predicted = expected) AS k, count(*) AS n FROM v_predictions GROUP BY repository), {DRAWS} {BOUNDS}")
def a12_metric_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir, None)


@query(f"WITH g AS (SELECT stratum, repository AS cluster, count(*) FILTER (predicted = expected) AS k, count(*) AS n FROM v_predictions GROUP BY 1, 2), {DRAWS} {BOUNDS}")
def a12_stratum_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir, "stratum")


def _bounds(spark, sf_dir, by):
    rows = view(spark, sf_dir, "v_predictions").select(F.col("repository").alias("cluster"), (F.col("expected") == F.col("predicted")).cast("long").alias("k"), F.lit(1).cast("long").alias("n"), "stratum")
    out = K.metric_bounds(rows, 60, 17, 0.6, by)
    return out.select("stratum", "k", "n", *[F.round(c, 9).alias(c) for c in ("wilson_low", "bootstrap_low", "conservative_low")], "passed")


@query("""WITH r AS (SELECT source AS repository, unnest(list_distinct([lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END])) AS label, n_chars % 50 AS expected, n_chars % 40 AS actual, n_chars % 30 AS matched FROM documents),
    g AS (SELECT label, count(DISTINCT repository) AS repositories, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(matched) AS BIGINT) AS matched FROM r WHERE label IS NOT NULL GROUP BY label)
    SELECT *, CASE WHEN actual <> 0 THEN matched / actual END AS precision, CASE WHEN expected <> 0 THEN matched / expected END AS recall FROM g""")
def a21_segment_features(spark, sf_dir):
    labels = F.array_compact(F.array("lang", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("repository"), labels.alias("labels"), *[(F.col("n_chars") % m).alias(c) for c, m in (("expected", 50), ("actual", 40), ("matched", 30))])
    return K.segment_features(rows, "labels")


@query("""WITH b AS (SELECT stratum AS metric, round(avg(CAST(predicted = expected AS INT)), 6) AS value FROM v_predictions WHERE doc_id % 2 = 0 GROUP BY 1), a AS (SELECT stratum AS metric, round(avg(CAST(predicted = expected AS INT)), 6) AS value FROM v_predictions WHERE doc_id % 3 > 0 AND stratum <> 'es' GROUP BY 1)
    SELECT coalesce(b.metric, a.metric) AS metric, b.value AS before, a.value AS after, round(a.value - b.value, 4) AS delta, coalesce(round(a.value - b.value, 4) >= -CASE WHEN coalesce(b.metric, a.metric) = 'en' THEN 0.05 ELSE 0.0 END, false) AS passed FROM b FULL JOIN a ON a.metric = b.metric""")
def a22_compare_eval(spark, sf_dir):
    p = view(spark, sf_dir, "v_predictions")
    value = lambda df: df.groupBy(F.col("stratum").alias("metric")).agg(F.round(F.avg((F.col("predicted") == F.col("expected")).cast("int")), 6).alias("value"))
    limits = spark.createDataFrame([("en", 0.05)], "metric string, most_fall double")
    return K.compare_eval(value(p.where("doc_id % 2 = 0")), value(p.where("doc_id % 3 > 0 and stratum <> 'es'")), limits)


LINKS = """l AS (SELECT l_orderkey AS finding_id, 'c' || CAST(l_linenumber AS VARCHAR) AS citation_id, CASE l_returnflag WHEN 'R' THEN 'direct' WHEN 'A' THEN 'supporting' ELSE CASE WHEN l_quantity > 25 THEN 'contextual' ELSE 'other' END END AS strength FROM lineitem)"""


@query(f"""WITH {LINKS}, b AS (SELECT finding_id, min(CASE strength WHEN 'direct' THEN 1 WHEN 'supporting' THEN 2 WHEN 'contextual' THEN 3 END) AS r FROM l GROUP BY 1)
    SELECT coalesce(['direct', 'supporting', 'contextual'][r], 'uncited') AS strongest, count(*) AS findings, round(100.0 * count(*) / (SELECT count(*) FROM v_findings), 9) AS pct FROM v_findings LEFT JOIN b USING (finding_id) GROUP BY 1""")
def a31_guidance_coverage(spark, sf_dir):
    return _guidance(spark, sf_dir)[0].withColumn("pct", F.round("pct", 9))


@query(f"WITH {LINKS} SELECT citation_id, count(*) AS uses, count(*) >= 0.5 * (SELECT count(*) FROM v_findings) AS broadly_reused FROM l WHERE finding_id IN (SELECT finding_id FROM v_findings) GROUP BY citation_id")
def a31_citation_reuse(spark, sf_dir):
    return _guidance(spark, sf_dir)[1]


def _guidance(spark, sf_dir):
    strength = F.when(F.col("l_returnflag") == "R", "direct").when(F.col("l_returnflag") == "A", "supporting").when(F.col("l_quantity") > 25, "contextual").otherwise("other")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("citation_id"), strength.alias("strength"))
    return K.guidance_coverage(view(spark, sf_dir, "v_findings"), links, 0.5)


EXPIRY = "CASE WHEN o_orderkey % 7 = 0 THEN 'soon' WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""SELECT o_orderkey AS mapping_id, CASE WHEN {EXPIRY} = 'soon' THEN 'invalid' WHEN {EXPIRY} < '1998-01-01' THEN 'expired' ELSE 'current' END AS state FROM orders WHERE o_orderstatus = 'F' AND {EXPIRY} <> ''""")
def a32_review_expiry(spark, sf_dir):
    expires = F.when(F.col("o_orderkey") % 7 == 0, "soon").when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mapping_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("decision"), expires.alias("expires_at"))
    return K.review_expiry(rows, "1998-01-01")


@query("""WITH ids AS (SELECT p_partkey AS c FROM part WHERE p_partkey % 3 <> 0), sites AS (SELECT l_suppkey AS c, CASE WHEN l_quantity > 10 THEN l_partkey END AS t FROM lineitem), run AS (SELECT l_suppkey AS s, l_partkey AS t FROM lineitem WHERE l_returnflag = 'R'),
    st AS (SELECT DISTINCT c AS s, t FROM sites WHERE t IN (FROM ids)), ru AS (SELECT DISTINCT s, t FROM run WHERE s IN (FROM ids) AND t IN (FROM ids)), seen AS (SELECT s AS c FROM run UNION SELECT t FROM run UNION SELECT user_id FROM events),
    n AS (SELECT (SELECT count(*) FROM ids) AS eligible, (SELECT count(*) FROM seen WHERE c IN (FROM ids)) AS observed, (SELECT count(*) FROM st) AS static_edges, (SELECT count(*) FROM ru) AS runtime_edges,
      (SELECT count(*) FROM st JOIN ru USING (s, t)) AS corroborated, (SELECT count(*) FROM sites) AS call_sites, (SELECT count(*) FROM sites WHERE t IS NULL OR t NOT IN (FROM ids)) AS unresolved),
    p AS (SELECT *, runtime_edges - corroborated AS runtime_only, round(100.0 * observed / eligible, 1) AS component_pct, round(100.0 * corroborated / static_edges, 1) AS static_edge_pct, round(100.0 * unresolved / call_sites, 1) AS unresolved_pct FROM n)
    SELECT *, round((component_pct + static_edge_pct) / 2, 1) AS score FROM p""")
def a35_corroboration(spark, sf_dir):
    return K.corroboration(*corroborated(spark, sf_dir))


def corroborated(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    components = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("component_id"))
    sites = lines.select(F.col("l_suppkey").alias("component_id"), F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("target"))
    edges = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return components, sites, edges, table(spark, sf_dir, "events").select(F.col("user_id").alias("component_id"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'refused' ELSE 'proposed' END AS e, CASE WHEN n_chars % 4 = 0 THEN 'refused' ELSE 'proposed' END AS a, CASE WHEN n_chars % 5 = 0 THEN 'k' || CAST(n_chars % 3 AS VARCHAR) END AS c, lang, source FROM documents),
    m AS (SELECT doc_id, lang AS segment FROM documents UNION SELECT doc_id, source FROM documents)
    SELECT m.segment, count(*) AS samples, count(*) FILTER (e = 'proposed') AS expected_proposed, count(*) FILTER (a = 'proposed') AS actual_proposed, round(avg(CAST(e = a AS INT)), 4) AS decision_accuracy, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS fault_categories FROM m JOIN s USING (doc_id) GROUP BY 1""")
def a49_segment_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pick = lambda m: F.when(F.col("n_chars") % m == 0, "refused").otherwise("proposed")
    samples = d.select(F.col("doc_id").alias("sample_id"), pick(3).alias("expected"), pick(4).alias("actual"), F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("k"), (F.col("n_chars") % 3).cast("string"))).alias("category"))
    return K.segment_decisions(d.select(F.col("doc_id").alias("sample_id"), F.explode(F.array("lang", "source")).alias("segment")), samples)


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE round((o_custkey % 10 - o_orderkey % 2) / (o_custkey % 10), 6) END AS task_success_rate,
    coalesce(o_custkey % 20 >= 5 AND o_custkey % 10 > 0 AND (o_custkey % 10 - o_orderkey % 2) / (o_custkey % 10) >= 0.9 AND o_orderkey % 3 <= 1 AND o_totalprice >= 100000 AND o_orderstatus <> 'P', false) AS passed FROM orders""")
def a50_study_results(spark, sf_dir):
    studies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("participants"), (F.col("o_custkey") % 10).alias("task_attempts"), (F.col("o_custkey") % 10 - F.col("o_orderkey") % 2).alias("successful_tasks"),
                                                    (F.col("o_orderkey") % 3).alias("critical_errors"), F.col("o_totalprice").alias("satisfaction"), F.lit(100000.0).alias("least_satisfaction"), (F.col("o_orderstatus") != "P").alias("accessible"))
    return K.study_results(studies, 5, 1)


@query("SELECT o_orderkey AS id, o_orderstatus = 'F' AND o_custkey % 90 <= 60 AND o_orderkey % 30 <= 20 AND o_custkey % 4 = 0 AS passed FROM orders")
def a50_recovery_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("restored"), (F.col("o_custkey") % 90).alias("recovery_s"), F.lit(60).alias("rto_s"), (F.col("o_orderkey") % 30).alias("loss_s"), F.lit(20).alias("rpo_s"), (F.col("o_custkey") % 4).alias("unresolved"))
    return K.recovery_results(rows)


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN 'verified' ELSE 'candidate' END AS status, s_acctbal FROM supplier)
    SELECT count(*) AS sources, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'verified' AND k % 5 <> 0 AND k % 7 <> 0 AND s_acctbal > 0) AS complete, count(*) FILTER (k % 3 <> 0) AS native, count(*) FILTER (k % 3 = 0) AS contract_only FROM s""")
def a51_source_health(spark, sf_dir):
    k = F.col("s_suppkey")
    either = lambda test, text: F.when(test, text).otherwise("unassigned")
    rows = table(spark, sf_dir, "supplier").select(
        F.when(k % 4 != 0, "verified").otherwise("candidate").alias("status"), F.lit("u").alias("canonical_url"), F.when(k % 5 != 0, "u").otherwise("v").alias("observed_url"), either(k % 7 != 0, "r1").alias("revision"), F.lit("mit").alias("license_id"),
        F.lit("someone").alias("reviewer"), F.sha2(k.cast("string"), 256).alias("sha256"), F.lit(0.0).alias("observed_at"), F.col("s_acctbal").alias("next_review_at"), F.when(k % 3 != 0, "native").otherwise("contract-only").alias("adapter_mode"))
    return K.source_health(rows)


CRASHES = """c AS (SELECT user_id % 20 AS campaign, event_id % 9973 AS crash_id, event_type = 'error' OR event_id % 2 = 0 AS reproduced, CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' WHEN 2 THEN 'accepted' WHEN 3 THEN 'not_reproducible' ELSE 'duplicate' END AS disposition,
    CASE WHEN event_id % 10 = 1 THEN 'rev' ELSE 'unassigned' END AS fixed_in, CASE WHEN event_id % 97 = 0 THEN '' ELSE 'f' END AS finding_ref FROM events)"""


@query(f"""WITH {CRASHES}, i AS (SELECT campaign, crash_id, count(*) AS n, count(*) FILTER ((disposition = 'not_reproducible') = reproduced OR (disposition = 'fixed' AND fixed_in = 'unassigned')) AS w, count(*) FILTER (reproduced AND disposition = 'open') AS o, count(*) FILTER (finding_ref = '') AS u FROM c GROUP BY 1, 2)
    SELECT campaign, CAST(sum(n) AS BIGINT) AS crashes, CAST(sum(n - 1) AS BIGINT) AS duplicate_ids, CAST(sum(w) AS BIGINT) AS inconsistent, CAST(sum(o) AS BIGINT) AS unresolved, sum(n - 1) = 0 AND sum(w) = 0 AND sum(u) = 0 AS complete FROM i GROUP BY campaign""")
def a52_crash_triage(spark, sf_dir):
    e = F.col("event_id")
    disposition = F.element_at(F.array(*[F.lit(x) for x in ("open", "fixed", "accepted", "not_reproducible", "duplicate")]), (e % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("campaign"), (e % 9973).alias("crash_id"), ((F.col("event_type") == "error") | (e % 2 == 0)).alias("reproduced"), disposition.alias("disposition"),
                                                 F.when(e % 10 == 1, "rev").otherwise("unassigned").alias("fixed_in"), F.when(e % 97 == 0, "").otherwise("f").alias("finding_ref"))
    return K.crash_triage(rows)


@query("""WITH m AS (SELECT event_type || '.m' || CAST(event_id AS VARCHAR) AS mutant, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 33 WHEN 2 THEN 7 ELSE 1 END AS x, event_type FROM events)
    SELECT CASE WHEN event_type IN ('click', 'view') THEN 'looks' ELSE 'buys' END AS "group", count(*) FILTER (x = 1) AS killed, count(*) FILTER (x IN (0, 33)) AS survived, count(*) FILTER (x = 7) AS other, count(*) FILTER (x = 1) / count(*) FILTER (x <> 7) AS score FROM m WHERE event_type IN ('click', 'view', 'purchase') AND NOT (event_type = 'purchase' AND mutant LIKE '%77') GROUP BY 1""")
def a53_mutation_ratchet(spark, sf_dir):
    code = F.when(F.col("event_id") % 6 == 0, 0).when(F.col("event_id") % 6 == 1, 33).when(F.col("event_id") % 6 == 2, 7).otherwise(1)
    rows = table(spark, sf_dir, "events").select(F.concat_ws(".m", "event_type", F.col("event_id").cast("string")).alias("mutant"), code.alias("exit_code"))
    return K.mutation_ratchet(rows, {"looks": ["click.*", "view.*"], "buys": ["purchase.*"], "more": ["purchase.*77"]})[0]


@query("""WITH v AS (SELECT DISTINCT decision, c1, c2, c3, outcome FROM v_vectors), p AS (
      SELECT decision, 'c1' AS condition, bool_or(covered) AS covered FROM (SELECT decision, c2, c3, (max(CASE WHEN c1 THEN outcome::INT END) > min(CASE WHEN NOT c1 THEN outcome::INT END) OR max(CASE WHEN NOT c1 THEN outcome::INT END) > min(CASE WHEN c1 THEN outcome::INT END)) AS covered FROM v GROUP BY 1, 2, 3) GROUP BY 1
      UNION ALL SELECT decision, 'c2', bool_or(covered) FROM (SELECT decision, c1, c3, (max(CASE WHEN c2 THEN outcome::INT END) > min(CASE WHEN NOT c2 THEN outcome::INT END) OR max(CASE WHEN NOT c2 THEN outcome::INT END) > min(CASE WHEN c2 THEN outcome::INT END)) AS covered FROM v GROUP BY 1, 2, 3) GROUP BY 1
      UNION ALL SELECT decision, 'c3', bool_or(covered) FROM (SELECT decision, c1, c2, (max(CASE WHEN c3 THEN outcome::INT END) > min(CASE WHEN NOT c3 THEN outcome::INT END) OR max(CASE WHEN NOT c3 THEN outcome::INT END) > min(CASE WHEN c3 THEN outcome::INT END)) AS covered FROM v GROUP BY 1, 2, 3) GROUP BY 1),
    d AS (SELECT decision, count(*) AS conditions, count(*) FILTER (coalesce(covered, false)) AS covered FROM p GROUP BY 1)
    SELECT n_regionkey AS requirement, coalesce(bool_and(coalesce(conditions = covered, false)), false) AS covered FROM nation LEFT JOIN d ON decision = n_nationkey GROUP BY 1""")
def a56_mcdc_summary(spark, sf_dir):
    requirements = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("requirement"), F.col("n_nationkey").cast("long").alias("decision"))
    return K.mcdc_summary(J.mcdc_pairs(view(spark, sf_dir, "v_vectors"), ["c1", "c2", "c3"]), requirements)[1]


@query("""WITH e AS (SELECT l_orderkey, list_distinct(list(l_shipmode)) AS ids FROM (SELECT l_orderkey, 'a' || CAST(l_suppkey % 7 AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY 1), x AS (SELECT unnest(ids) AS adapter_id, len(ids) AS n FROM e)
    SELECT adapter_id, count(*) AS entities, count(*) FILTER (n = 1) AS alone FROM x GROUP BY 1""")
def a58_adapter_contributions(spark, sf_dir):
    name = F.concat(F.lit("a"), (F.col("l_suppkey") % 7).cast("string"))
    return K.adapter_contributions(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name).alias("adapter_ids")))


COHORT = """r AS (SELECT source AS repository, sum(n_chars % 7) AS expected, sum(n_chars % 6) AS actual, sum(CASE WHEN n_chars % 7 < n_chars % 6 THEN n_chars % 7 ELSE n_chars % 5 END) AS matched, bool_and(n_chars % 50 <> 1) AS independent FROM documents GROUP BY 1)"""


@query(f"WITH {COHORT} SELECT repository, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, CAST(matched AS BIGINT) AS matched FROM r WHERE expected > 0 AND matched <= expected AND matched <= actual AND independent")
def a59_cohort_projection(spark, sf_dir):
    return _cohort(spark, sf_dir)[0]


@query(f"""WITH {COHORT} SELECT * FROM (SELECT repository, array_to_string(list_filter([CASE WHEN matched > expected OR matched > actual THEN 'matched_too_many' END, CASE WHEN expected <= 0 THEN 'no_expected_cases' END, CASE WHEN NOT independent THEN 'not_independent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r) WHERE reasons <> ''""")
def a59_disqualified(spark, sf_dir):
    return _cohort(spark, sf_dir)[1]


def _cohort(spark, sf_dir):
    c = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repository")).agg(F.sum(c % 7).alias("expected"), F.sum(c % 6).alias("actual"), F.sum(F.when(c % 7 < c % 6, c % 7).otherwise(c % 5)).alias("matched"), F.bool_and(c % 50 != 1).alias("independent"))
    return K.cohort_projection(rows)


@query("""WITH c AS (SELECT d.source, d.lang, l.quality = 1 AS label, d.n_chars % 3 <> 0 AS predicted, d.n_chars % 4 <> 0 AS independent FROM labels l JOIN documents d USING (doc_id))
    SELECT lang, count(*) AS claims, count(*) FILTER (label = predicted) AS right, count(*) FILTER (label AND NOT predicted) AS missed, count(*) FILTER (NOT label AND predicted) AS wrongly_supported, count(*) FILTER (label = predicted) / count(*) AS accuracy FROM c WHERE independent GROUP BY lang""")
def a60_label_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 3 != 0).alias("predicted"), (F.col("n_chars") % 4 != 0).alias("independent"))
    return K.label_projection(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("label")).join(d, "doc_id"), ["lang"])


@query("""WITH s AS (SELECT lang AS section, CAST(sum(CASE WHEN lang = 'es' THEN 0 ELSE 1 END) AS BIGINT) AS records FROM documents GROUP BY 1), d AS (SELECT * FROM (VALUES ('en', 'semantic', 'source1', 'x'), ('fr', 'provenance_only', 'none', 'none'), ('de', 'semantic', 'none', 'none')) v(section, mode, kind, channel)),
    p AS (SELECT section, (SELECT count(*) FROM documents WHERE source = kind) + (SELECT count(*) FROM events WHERE event_type = CASE channel WHEN 'x' THEN 'click' END) AS projected FROM d)
    SELECT s.section, records, CAST(coalesce(projected, 0) AS BIGINT) AS projected, CASE WHEN records = 0 THEN 'empty' WHEN mode = 'provenance_only' THEN 'provenance_only' WHEN projected > 0 THEN 'projected' WHEN mode IS NOT NULL THEN 'registered_without_projection' ELSE 'unmapped' END AS status FROM s LEFT JOIN d USING (section) LEFT JOIN p USING (section)""")
def a61_projection_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sections = d.select(F.col("lang").alias("section"), F.when(F.col("lang") == "es", 0).otherwise(1).alias("records"))
    declared = spark.createDataFrame([("en", "semantic", ["source1"], ["click"]), ("fr", "provenance_only", [], []), ("de", "semantic", ["none"], [])], "section string, mode string, kinds array<string>, channels array<string>")
    return K.projection_ledger(sections, declared, d.select(F.col("source").alias("kind")), table(spark, sf_dir, "events").select(F.col("event_type").alias("channel")))


@query("""WITH c AS (SELECT n_nationkey AS k, count(s_suppkey) AS involved FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1), f AS (SELECT component_id, count(*) AS n FROM v_findings GROUP BY 1)
    SELECT 'component:' || CAST(k AS VARCHAR) AS candidate, 'project_defined_common_cause' AS source, involved, coalesce(n, 0) AS linked FROM c LEFT JOIN f ON component_id = k
    UNION ALL SELECT 'cut_set:' || rule_id, 'approved_cut_set', 0, count(*) FROM v_findings WHERE hazard_linked GROUP BY rule_id""")
def j36_common_cause_candidates(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.collect_set("s_suppkey").alias("affected"))
    components = table(spark, sf_dir, "nation").join(suppliers, F.col("n_nationkey") == F.col("n"), "left").select(F.col("n_nationkey").alias("component_id"), F.when(F.col("n_nationkey") % 2 == 0, "common_cause").otherwise("plain").alias("kind"), F.coalesce("affected", F.array().cast("array<bigint>")).alias("affected"))
    findings = view(spark, sf_dir, "v_findings")
    cuts = findings.where("hazard_linked").groupBy(F.col("rule_id").alias("cut_set_id")).agg(F.collect_list("finding_id").alias("finding_ids"))
    return K.common_cause_candidates(components, findings, cuts)


@query("""WITH f AS (SELECT component_id, finding_id, row_number() OVER (PARTITION BY component_id ORDER BY finding_id) AS r, count(*) OVER (PARTITION BY component_id) AS n FROM (SELECT DISTINCT component_id, finding_id FROM v_findings)),
    g AS (SELECT component_id, string_agg(CAST(finding_id AS VARCHAR), ',' ORDER BY finding_id) FILTER (r <= 5) AS findings, max(n) AS n FROM f GROUP BY 1),
    e AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS r FROM (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem)), h AS (SELECT source, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS callees FROM e WHERE r <= 5 GROUP BY 1)
    SELECT p_partkey AS component_id, p_name AS name, findings, callees, CAST(coalesce(n - least(n, 5), 0) AS BIGINT) AS omitted_findings, coalesce(n, 0) AS total FROM part LEFT JOIN g ON g.component_id = p_partkey LEFT JOIN h ON h.source = p_partkey ORDER BY total DESC, p_partkey LIMIT 50""")
def j50_evidence_packets(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("component_id"), F.col("p_name").alias("name"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    out = K.evidence_packets(parts, view(spark, sf_dir, "v_findings"), edges, 50, 5)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("component_id", "name", listed("findings").alias("findings"), listed("callees").alias("callees"), F.col("omitted_findings").cast("long").alias("omitted_findings"), "total")


@query("""WITH u AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'client' ELSE 'route' END AS side, page_id AS id FROM pages WHERE page_id % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY id) AS rank, count(*) OVER (PARTITION BY side) AS n FROM u)
    SELECT side, CAST(rank AS INTEGER) AS rank, id, CASE side WHEN 'client' THEN 'external,mapped' ELSE 'unused,documented' END AS decisions, greatest(0, n - 20) AS omitted FROM r WHERE rank <= 20""")
def j51_review_dispositions(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("page_id % 3 <> 0").select(F.when(F.col("page_id") % 2 == 0, "client").otherwise("route").alias("side"), F.col("page_id").alias("id"))
    return K.review_dispositions(rows, 20, {"client": ["external", "mapped"], "route": ["unused", "documented"]})


V = "SELECT '{0}' AS rule_id, '{1}' AS level, CAST({2} AS VARCHAR) AS item_id, '{3}' AS message FROM {4}"


@query(" UNION ALL ".join(V.format("closure.incomplete", "error", "finding_id", m, f"v_findings WHERE finding_id % 2 = 0 AND {t}") for m, t in (
    ("not accepted", "disposition <> 'accepted'"), ("not verified", "NOT revalidation_required"), ("no ratings after the action", "NOT (severity BETWEEN 1 AND 10 AND occurrence BETWEEN 1 AND 10)"))))
def v06_closure_incomplete(spark, sf_dir):
    post = F.when(F.col("severity").between(1, 10) & F.col("occurrence").between(1, 10), F.col("severity") * F.col("occurrence"))
    return Q.closure_incomplete(view(spark, sf_dir, "v_findings").select("finding_id", (F.col("finding_id") % 2 == 0).alias("closed"), "disposition", F.col("revalidation_required").alias("verified"), post.alias("post_rpn")))


@query(V.format("trace.unmapped", "warning", "d", "too many spans have no component", "(SELECT user_id AS d, avg(CAST(event_type = 'view' AS INT)) AS r FROM events GROUP BY 1) WHERE r > 0.2") + " UNION ALL "
       + V.format("trace.instrumentation", "warning", "concat(user_id, '/', t)", "expected, not observed", "(SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(['error', 'signup']) AS t) WHERE (user_id, t) NOT IN (SELECT (user_id, event_type) FROM events)"))
def v09_trace_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spans = e.select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("component"))
    expected = e.select("user_id", F.explode(F.array(F.lit("error"), F.lit("signup"))).alias("event_type"))
    return Q.validate(Q.unmapped_rate(spans, "user_id", 0.2), Q.instrumentation_gaps(expected, e, ["user_id", "event_type"]))


@query(V.format("review.diversity", "warning", "k", "too few reviewers", "(SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) < 4)") + " UNION ALL "
       + V.format("common_cause.unlinked", "error", "n_nationkey", "common cause affects no component", "nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"))
def v10_reviewers_and_causes(spark, sf_dir):
    reviews = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("reviewer"))
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n")).agg(F.collect_set("s_suppkey").alias("affected"))
    causes = table(spark, sf_dir, "nation").join(rich, F.col("n_nationkey") == F.col("n"), "left").select(F.col("n_nationkey").alias("component_id"), F.lit("common_cause").alias("kind"), "affected")
    return Q.validate(Q.reviewer_diversity(reviews, "o_custkey", 4), Q.cause_without_effect(causes))


@query(V.format("summary.mismatch", "error", "k", "stored summary is not what the rows give", "(SELECT component_id AS k, count(*) AS n, count(*) FILTER (finding_id % 50 <> 0) AS m FROM v_findings GROUP BY 1) WHERE n <> m"))
def v11_stored_summary(spark, sf_dir):
    f = view(spark, sf_dir, "v_findings")
    count = lambda df: df.groupBy("component_id").agg(F.count("*").alias("n"))
    return Q.stored_summary(count(f.where("finding_id % 50 <> 0")), count(f), ["component_id"], ["n"])


@query("WITH d AS (SELECT o_orderkey - o_orderkey % 100 // 99 AS id, CASE o_custkey % 6 WHEN 0 THEN 'not_affected' WHEN 1 THEN 'affected' WHEN 2 THEN 'fixed' WHEN 3 THEN 'maybe' ELSE 'under_investigation' END AS s, o_orderkey % 3 AS m FROM orders) "
       + V.format("ids.duplicate", "error", "id", "identifier repeats", "(SELECT id FROM d GROUP BY id HAVING count(*) > 1)") + " UNION ALL "
       + " UNION ALL ".join(V.format("vex.consistency", "error", "id", m, f"d WHERE {t}") for m, t in (("unknown status", "s = 'maybe'"), ("not_affected without justification", "s = 'not_affected' AND m <> 0"), ("affected without action", "s = 'affected' AND m <> 1"), ("no references", "m = 2"))))
def v12_vex_consistency(spark, sf_dir):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 3
    status = F.when(F.col("o_custkey") % 6 == 0, "not_affected").when(F.col("o_custkey") % 6 == 1, "affected").when(F.col("o_custkey") % 6 == 2, "fixed").when(F.col("o_custkey") % 6 == 3, "maybe").otherwise("under_investigation")
    rows = table(spark, sf_dir, "orders").select((k - F.floor(k % 100 / 99)).alias("decision_id"), status.alias("status"), F.when(m == 0, "code not reachable").alias("justification"), F.when(m == 1, "update").alias("action"), F.when(m != 2, F.array(F.lit("ref"))).alias("refs"))
    return Q.vex_consistency(rows)


@query("WITH r AS (SELECT doc_id, n_chars % 20 AS e, n_chars % 15 AS a, least(n_chars % 20, n_chars % 15) AS m FROM documents), s AS (SELECT *, CASE WHEN doc_id % 10 = 3 THEN m + 1 ELSE m END AS mm FROM r) "
       + " UNION ALL ".join(V.format("results.arithmetic", "error", "doc_id", m, f"s WHERE {t}") for m, t in (
           ("matched is not expected less missing", "mm <> m"), ("matched is not actual less unexpected", "mm <> m"), ("recall doesn''t follow", "e > 0 AND ((doc_id % 7 = 0 AND mm > 0) OR (doc_id % 7 <> 0 AND mm <> m))"), ("precision doesn''t follow", "a > 0 AND mm <> m"))))
def v14_arithmetic(spark, sf_dir):
    c, d = F.col("n_chars"), F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", (c % 20).alias("expected"), (c % 15).alias("actual"), F.least(c % 20, c % 15).alias("m"))
    rows = rows.withColumn("matched", F.when(d % 10 == 3, F.col("m") + 1).otherwise(F.col("m")))
    rows = rows.withColumns({"missing": F.col("expected") - F.col("m"), "unexpected": F.col("actual") - F.col("m"), "precision": F.when(F.col("actual") > 0, F.round(F.col("m") / F.col("actual"), 6)),
                             "recall": F.when(F.col("expected") > 0, F.when(d % 7 == 0, 0.0).otherwise(F.round(F.col("m") / F.col("expected"), 6)))})
    return Q.arithmetic(rows, "doc_id")
