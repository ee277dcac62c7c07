"""Queries of sources and sinks (S): given tables go through a file format and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.plans.catalog import query
from evidentia.sources import readers as R
from evidentia.sources import writers as W
from evidentia.storage import new_folder
from evidentia.views import table, view


@query("SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id, event_type AS name, event_id * 1000 AS start_ns, 'svc' AS service FROM events")
def s02_read_spans(spark, sf_dir):
    path = new_folder(spark)
    text = lambda c: F.struct(F.col(c).cast("string").alias("stringValue"))
    span = F.struct(F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.col("event_type").alias("name"), (F.col("event_id") * 1000).cast("string").alias("startTimeUnixNano"),
                    F.array(F.struct(F.lit("kind").alias("key"), text("event_type").alias("value"))).alias("attributes"))
    service = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit("svc").alias("stringValue")).alias("value")))
    resource = F.struct(F.struct(service.alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))
    table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("g"), resource.alias("r")).groupBy("g").agg(F.collect_list("r").alias("resourceSpans")).drop("g").write.json(path)
    return R.read_spans(spark, path, lines=True).select("trace_id", "span_id", "name", "start_ns", F.col("attributes")["service.name"].alias("service"))


@query("SELECT p_brand AS path, p_partkey AS line, 'rule' || CAST(p_size % 7 AS VARCHAR) AS rule_id, p_name AS message, p_type AS tool FROM part")
def s04_scan_results_round_trip(spark, sf_dir):
    path = new_folder(spark)
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), F.col("p_partkey").alias("end_line"), F.lit(1).alias("column"), F.concat(F.lit("rule"), (F.col("p_size") % 7).cast("string")).alias("rule_id"), F.col("p_name").alias("message"), F.col("p_type").alias("tool"))
    W.write_scan_results(own, path)
    return R.read_scan_results(spark, path, lines=True).select("path", "line", "rule_id", "message", "tool")


@query("SELECT finding_id, screening_priority, CASE WHEN rule_id LIKE 'rule%' THEN '''=' || rule_id END AS rule, 'a | ' || disposition AS notes FROM v_findings")
def s18_findings_csv_round_trip(spark, sf_dir):
    path = new_folder(spark)
    f = view(spark, sf_dir, "v_findings").select("finding_id", "screening_priority", F.concat(F.lit("="), "rule_id").alias("rule"), F.array(F.lit("a"), "disposition").alias("notes"))
    W.write_findings_csv(f, path)
    return spark.read.csv(path, header=True, escape='"', schema="finding_id long, screening_priority string, rule string, notes string")


@query("SELECT finding_id, disposition, failure_class AS baseline_id FROM v_findings")
def s20_evidence_round_trip(spark, sf_dir):
    path = new_folder(spark)
    f = view(spark, sf_dir, "v_findings").select("finding_id", "disposition", F.col("failure_class").alias("baseline_id"))
    W.write_evidence(f, path)
    W.write_evidence(f.where("baseline_id = 'class1'"), path)
    return spark.read.parquet(path).select("finding_id", "disposition", "baseline_id")


def _text(c):
    return F.col(c).cast("string")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS finding_id, CAST(o_custkey % 50 AS VARCHAR) AS component_id, 'rule' || CAST(o_custkey % 7 AS VARCHAR) AS rule_id, o_orderstatus AS disposition, CAST(CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 11 END AS INTEGER) AS severity FROM orders")
def s01_analysis_findings(spark, sf_dir):
    return _analysis(spark, sf_dir)["findings"].select("finding_id", "component_id", "rule_id", "disposition", "severity")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS obligation_id, CAST(o_custkey % 3 AS INTEGER) AS gaps, o_orderpriority AS assurance_status, CASE WHEN o_custkey % 2 = 0 THEN 'implemented' ELSE 'proposed' END AS implementation FROM orders")
def s01_analysis_obligations(spark, sf_dir):
    return _analysis(spark, sf_dir)["obligations"].select("obligation_id", "gaps", "assurance_status", "implementation")


def _analysis(spark, sf_dir):
    """Orders as run documents, and back."""
    path = new_folder(spark)
    review = F.struct(F.col("o_orderstatus").alias("disposition"), F.when(F.col("o_custkey") % 11 > 0, (F.col("o_custkey") % 11).cast("string")).otherwise("unrated").alias("severity"))
    item = F.struct(_text("o_orderkey").alias("id"), (F.col("o_custkey") % 50).cast("string").alias("component_id"), F.struct(F.concat(F.lit("rule"), (F.col("o_custkey") % 7).cast("string")).alias("rule_id")).alias("scanner"), review.alias("review"))
    gaps = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("o_custkey") % 3).cast("int"))
    obligation = F.struct(_text("o_orderkey").alias("id"), F.col("o_orderpriority").alias("assurance_status"), gaps.alias("planning_gaps"), F.struct(F.when(F.col("o_custkey") % 2 == 0, "implemented").otherwise("proposed").alias("implementation_status")).alias("automation"))
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("g"), item.alias("i"), obligation.alias("o"))
    docs = rows.groupBy("g").agg(F.collect_list("i").alias("items"), F.struct(F.collect_list("o").alias("obligations")).alias("assurance"))
    docs.write.option("maxRecordsPerFile", 1).json(path)
    return R.read_analysis(spark, path)


@query("SELECT s_name AS path, s_suppkey AS line, CAST(CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS executed, false AS reject FROM supplier")
def s05_coverage_round_trip(spark, sf_dir):
    path = new_folder(spark)
    hit = lambda n: F.when(F.col("s_nationkey") % 2 == n, F.array("s_suppkey")).otherwise(F.array().cast("array<long>"))
    files = F.map_from_entries(F.collect_list(F.struct(F.col("s_name"), F.struct(hit(0).alias("executed_lines"), hit(1).alias("missing_lines")))))
    table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000)).agg(files.alias("files")).select("files").write.option("maxRecordsPerFile", 1).json(path)
    return R.read_coverage(spark, path)


@query("SELECT 'bom' || CAST(p_partkey AS VARCHAR) AS bom_ref, 'pypi' AS ecosystem, p_name AS name, CAST(p_size AS VARCHAR) AS version FROM part")
def s07_sbom_round_trip(spark, sf_dir):
    path = new_folder(spark)
    part = F.struct(F.concat(F.lit("bom"), _text("p_partkey")).alias("bom-ref"), F.concat(F.lit("pkg:pypi/"), F.translate("p_name", " ", "-"), F.lit("@"), _text("p_size")).alias("purl"), F.col("p_name").alias("name"), _text("p_size").alias("version"))
    table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000)).agg(F.collect_list(part).alias("components")).select("components").write.option("maxRecordsPerFile", 1).json(path)
    return R.read_sbom(spark, path).select("bom_ref", "ecosystem", "name", "version")


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target FROM lineitem")
def s10_adjacency_round_trip(spark, sf_dir):
    path = new_folder(spark)
    lists = table(spark, sf_dir, "lineitem").groupBy(_text("l_suppkey").alias("s")).agg(F.collect_set(_text("l_partkey")).alias("t"))
    lists.groupBy(F.floor(F.col("s").cast("long") / 100)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("s", "t")))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_adjacency(spark, path)


@query("SELECT c_name AS entity_id, 'Customer' AS kind, c_mktsegment AS label FROM customer")
def s12_lifecycle_entities(spark, sf_dir):
    path = new_folder(spark)
    element = F.struct(F.col("c_name").alias("@id"), F.lit("Customer").alias("@type"), F.col("c_mktsegment").alias("name"), F.array(F.struct((F.col("c_nationkey")).cast("string").alias("target"), F.lit("in").alias("kind"))).alias("relationships"))
    table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 1000)).agg(F.collect_list(element).alias("elements")).select("elements").write.option("maxRecordsPerFile", 1).json(path)
    return R.read_lifecycle_model(spark, path)[0]


@query("SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id, event_type AS name, user_id % 10 AS batch FROM events")
def f04_explode_spans(spark, sf_dir):
    span = F.struct(_text("user_id").alias("traceId"), _text("event_id").alias("spanId"), F.col("event_type").alias("name"))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(span).alias("spans")).select((F.col("user_id") % 10).alias("batch"), F.to_json(F.struct("spans")).alias("body"))
    return R.explode_spans(docs).select("trace_id", "span_id", "name", "batch")


@query("SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id, CASE WHEN event_id % 2 = 1 THEN 'root' END AS parent_span_id, event_type AS name, user_id % 10 AS batch FROM events")
def f04_spans_of(spark, sf_dir):
    """By SQL alone; traces of even users are nested in resources."""
    parent = F.when(F.col("event_id") % 2 == 1, "root").otherwise("")
    span = F.struct(_text("user_id").alias("traceId"), _text("event_id").alias("spanId"), parent.alias("parentSpanId"), F.col("event_type").alias("name"))
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(span).alias("spans"))
    nested = F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans")))
    docs = grouped.select((F.col("user_id") % 10).alias("batch"), F.when(F.col("user_id") % 2 == 0, nested).otherwise(F.to_json(F.struct("spans"))).alias("body"))
    R.register_spans_of(spark)
    return spark.sql("SELECT trace_id, span_id, parent_span_id, name, batch FROM (SELECT batch, spans_of(body) AS spans FROM {docs}) LATERAL VIEW inline(spans) s AS trace_id, span_id, parent_span_id, name", docs=docs)


@query("SELECT c_custkey, sha256('{\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"c_name\":\"' || c_name || '\"}') AS digest FROM customer")
def p03_row_digest(spark, sf_dir):
    from evidentia.functions.columns import row_digest

    return table(spark, sf_dir, "customer").select("c_custkey", row_digest("c_name", "c_custkey").alias("digest"))


@query("SELECT finding_id, array_to_string(CASE WHEN finding_id % 3 = 0 THEN ['t' || CAST(severity AS VARCHAR), 'u'] ELSE [rule_id] END, ',') AS keys FROM v_findings")
def p35_taxa_or_rule(spark, sf_dir):
    from evidentia.functions.columns import taxa_or_rule

    taxa = F.when(F.col("finding_id") % 3 == 0, F.array(F.concat(F.lit("t"), _text("severity")), F.lit("u"))).otherwise(F.array().cast("array<string>"))
    return view(spark, sf_dir, "v_findings").select("finding_id", F.array_join(taxa_or_rule(taxa, F.col("rule_id")), ",").alias("keys"))
