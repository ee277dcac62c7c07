"""Readers of evidence files into flat tables.

Every file is one JSON document unless said otherwise, .gz too; with ``lines`` every line is one, and large files are split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import columns as C

_ANY = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:struct<values:array<struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>"
_PAIRS = f"array<struct<key:string,value:{_ANY}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_PAIRS}>"
_SCOPES = f"array<struct<spans:array<{_SPAN}>>>"
_OTLP = f"resourceSpans array<struct<resource:struct<attributes:{_PAIRS}>,scopeSpans:{_SCOPES},instrumentationLibrarySpans:{_SCOPES}>>, spans array<{_SPAN}>, " \
    f"traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string, attributes {_PAIRS}"


def _document(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def decode_any_value(value: Column) -> Column:
    """Text of a typed value; an array as JSON text."""
    one = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.coalesce(one(value), F.to_json(F.transform(value["arrayValue"]["values"], one)))


def decode_pairs(pairs: Column) -> Column:
    """A map of key and value lists; of equal keys the last counts, pairs without key don't."""
    last = F.filter(pairs, lambda p, i: p["key"].isNotNull() & (p["key"] != "") & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(F.coalesce(last, F.array()), lambda p: F.struct(p["key"], decode_any_value(p["value"]))))


def _over(low: Column, high: Column) -> Column:
    """Both maps; equal keys take the second's value."""
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def read_spans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(trace_id, span_id, parent_span_id, name, start_ns, end_ns, attributes) of a list, an object with ``spans``, or an OTLP document.

    A resource's attributes lie under its spans'; where scopeSpans is missing the older name of the list is read."""
    docs = _document(spark, path, _OTLP, lines)
    none = F.create_map().cast("map<string,string>")
    plain = docs.select(F.explode(F.coalesce("spans", F.array())).alias("s"), none.alias("below"))
    listed = docs.where("spanId is not null").select(F.struct(*[F.col(c) for c in "traceId spanId parentSpanId name startTimeUnixNano endTimeUnixNano attributes".split()]).alias("s"), none.alias("below"))
    resources = docs.select(F.explode("resourceSpans").alias("r"))
    scopes = resources.select(F.explode(F.coalesce("r.scopeSpans", "r.instrumentationLibrarySpans")).alias("scope"), decode_pairs(F.col("r.resource.attributes")).alias("below"))
    spans = plain.unionByName(listed).unionByName(scopes.select(F.explode("scope.spans").alias("s"), "below"))
    return spans.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("s.name").alias("name"),
        F.col("s.startTimeUnixNano").try_cast("long").alias("start_ns"), F.col("s.endTimeUnixNano").try_cast("long").alias("end_ns"),
        _over(F.col("below"), decode_pairs(F.col("s.attributes"))).alias("attributes"))


def read_genai_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans with an attribute gen_ai.*; ``reject`` is true for an identity that occurs more than once."""
    spans = read_spans(spark, path).where(F.exists(F.map_keys("attributes"), lambda k: k.startswith("gen_ai.")))
    counts = spans.groupBy("trace_id", "span_id").agg(F.count("*").alias("same"))
    return spans.join(counts, ["trace_id", "span_id"]).withColumn("reject", F.col("same") > 1).drop("same")


def read_scan_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, run, result, tool, tool_version, rule_id, level, message, path, line, end_line, column) of SARIF 2.1.0 files, by the first location.

    Without a region a result is on line 1, column 1; ``reject`` is true where the location is missing or its lines are in disorder."""
    region = "region:struct<startLine:long,endLine:long,startColumn:long>"
    schema = f"version string, runs array<struct<tool:struct<driver:struct<name:string,version:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>," \
        f"locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,{region}>>>>>>>"
    runs = _document(spark, path, schema, lines).select(F.input_file_name().alias("file"), F.posexplode("runs").alias("run", "r"))
    at = runs.select("file", "run", "r.tool.driver", F.posexplode("r.results").alias("result", "x")).withColumn("place", F.try_element_at("x.locations", F.lit(1))["physicalLocation"])
    line = F.coalesce("place.region.startLine", F.lit(1))
    rows = at.select("file", "run", "result", F.col("driver.name").alias("tool"), F.col("driver.version").alias("tool_version"), F.col("x.ruleId").alias("rule_id"), F.col("x.level").alias("level"),
                     F.col("x.message.text").alias("message"), F.col("place.artifactLocation.uri").alias("path"), line.cast("long").alias("line"),
                     F.coalesce("place.region.endLine", line).cast("long").alias("end_line"), F.coalesce("place.region.startColumn", F.lit(1)).cast("long").alias("column"))
    return rows.withColumn("reject", F.col("path").isNull() | (F.col("line") < 1) | (F.col("column") < 1) | (F.col("end_line") < F.col("line")))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, executed, reject): a line both executed and missing is rejected."""
    files = _document(spark, path, "files map<string,struct<executed_lines:array<long>,missing_lines:array<long>>>").select(F.explode("files").alias("path", "f"))
    points = files.select("path", F.explode("f.executed_lines").alias("line"), F.lit(1).alias("e")).unionByName(files.select("path", F.explode("f.missing_lines").alias("line"), F.lit(0).alias("e")))
    return points.groupBy("path", "line").agg(F.max("e").alias("executed"), (F.min("e") != F.max("e")).alias("reject"))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """(advisory_id, aliases, withdrawn, ecosystem, package, events) of one or many advisories."""
    affected = "affected array<struct<package:struct<ecosystem:string,name:string,purl:string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>"
    docs = _document(spark, path, f"id string, aliases array<string>, withdrawn string, {affected}").select("*", F.explode_outer("affected").alias("a"))
    events = F.transform(F.flatten(F.transform("a.ranges", lambda r: F.flatten(F.transform(r["events"], F.map_entries)))), lambda e: F.struct(e["key"].alias("kind"), e["value"].alias("version")))
    return docs.select(F.col("id").alias("advisory_id"), "aliases", F.col("withdrawn").isNotNull().alias("withdrawn"), F.col("a.package.ecosystem").alias("ecosystem"), C.normalize_package(F.col("a.package.name")).alias("package"), events.alias("events"))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """(cve, due_date) of a catalogue of exploited vulnerabilities."""
    return _document(spark, path, "vulnerabilities array<struct<cveID:string,dueDate:string>>").select(F.inline("vulnerabilities")).select(F.upper("cveID").alias("cve"), F.to_date("dueDate").alias("due_date"))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """(cve, epss, percentile) of a score list in CSV with a comment above its header."""
    return spark.read.schema("cve string, epss double, percentile double").csv(path, header=True, comment="#")


def read_sbom(spark: SparkSession, path: str) -> DataFrame:
    """(bom_ref, purl, ecosystem, name, version) of a component list."""
    parts = _document(spark, path, "components array<struct<`bom-ref`:string,purl:string,name:string,version:string>>").select(F.inline("components"))
    return parts.select(F.col("bom-ref").alias("bom_ref"), "purl", C.purl_parts(F.col("purl"))["ecosystem"].alias("ecosystem"), "name", "version")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of objects {caller: [callee, ...]}, each edge once."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return docs.select(F.explode("m").alias("source", "t")).select("source", F.explode("t").alias("target")).distinct()


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges of an external graph."""
    docs = _document(spark, path, "nodes array<struct<id:string,label:string,source_file:string,source_location:string>>, "
                     "edges array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_location:string>>")
    return docs.select(F.inline("nodes")), docs.select(F.inline("edges"))


def read_scorecards(spark: SparkSession, path: str) -> DataFrame:
    """(repository, name, score, bucket): -1 is inconclusive, 0 to 10 a rating."""
    rows = _document(spark, path, "repo struct<name:string>, checks array<struct<name:string,score:double>>").select(F.col("repo.name").alias("repository"), F.inline("checks"))
    return rows.withColumn("bucket", F.when(F.col("score") < 0, "inconclusive").when(F.col("score") < 5, "low").when(F.col("score") < 8, "medium").otherwise("high"))


def read_test_reports(spark: SparkSession, path: str) -> DataFrame:
    """(outcome, n) of test cases in JUnit files."""
    part = "struct<_message:string,_VALUE:string>"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(f"_name string, _classname string, failure {part}, error {part}, skipped string").load(path)
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return cases.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, kind) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), C.artifact_kind(F.col("path")).alias("kind"))


def read_case_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, evidence, unique) of a manifest's cases."""
    cases = _document(spark, path, "cases array<struct<case_id:string,evidence:array<string>>>").select(F.inline("cases"))
    return cases.groupBy("case_id").agg(F.sum(F.size(F.coalesce("evidence", F.array().cast("array<string>")))).alias("evidence"), (F.count("*") == 1).alias("unique"))


_SOURCE = "struct<path:string,line:long,end_line:long>"
_SITE = "struct<order:long,line:long,reference:string,resolution:string,internal_target_component_ids:array<string>,awaited:boolean>"
_COMPONENT = f"struct<id:string,name:string,qualname:string,kind:string,source:{_SOURCE},affected_component_ids:array<string>,call_sites:array<{_SITE}>,called_by:array<string>>"
_REVIEW = "struct<disposition:string,severity:string,occurrence:string,detection:string,reviewer:string,rationale:string>"
_ITEM = f"struct<id:string,component_id:string,source_status:string,source_change:string,source:{_SOURCE},scanner:struct<rule_id:string,failure_class:string,screening_priority:string,confidence:string>,review:{_REVIEW},linked_hazards:array<string>>"
_OBLIGATION = "struct<id:string,finding_id:string,source_status:string,verification_method:string,assurance_status:string,evidence_status:string,planning_gaps:array<string>,automation:struct<implementation_status:string>>"
_EXECUTION = "struct<id:string,obligation_id:string,status:string,reviews:array<struct<reviewer:string>>>"


def read_analysis(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of run documents (gzip too), each with its run (the file): components, call_sites, called_by, findings,
    obligations, executions.  Every file is one document, read once for each table that is used, with only its columns."""
    docs = _document(spark, path, f"schema_version string, components array<{_COMPONENT}>, items array<{_ITEM}>, assurance struct<obligations:array<{_OBLIGATION}>,executions:array<{_EXECUTION}>>")
    docs = docs.withColumn("run", F.input_file_name())
    of = lambda c: docs.select("run", F.explode(c).alias("x"))
    parts, items = of("components"), of("items")
    place = [F.col("x.source.path").alias("path"), F.col("x.source.line").alias("line"), F.col("x.source.end_line").alias("end_line")]
    sites = parts.select("run", F.col("x.id").alias("component_id"), F.explode("x.call_sites").alias("s"))
    rating = lambda c: F.col(f"x.review.{c}").try_cast("int").alias(c)
    return {
        "components": parts.select("run", F.col("x.id").alias("component_id"), "x.name", "x.qualname", "x.kind", *place, F.col("x.affected_component_ids").alias("affected")),
        "call_sites": sites.select("run", "component_id", F.col("s.order").alias("ord"), "s.line", "s.reference", "s.resolution", F.col("s.internal_target_component_ids").alias("targets"), "s.awaited"),
        "called_by": parts.select("run", F.col("x.id").alias("target_component_id"), F.explode("x.called_by").alias("caller_reference")),
        "findings": items.select("run", F.col("x.id").alias("finding_id"), "x.component_id", *place, "x.source_status", "x.source_change", "x.scanner.rule_id", "x.scanner.failure_class", "x.scanner.screening_priority",
                                 "x.review.disposition", rating("severity"), rating("occurrence"), rating("detection"), "x.review.reviewer", "x.linked_hazards"),
        "obligations": of("assurance.obligations").select("run", F.col("x.id").alias("obligation_id"), "x.finding_id", "x.source_status", "x.verification_method", "x.assurance_status", "x.evidence_status",
                                                          F.size(F.coalesce("x.planning_gaps", F.array().cast("array<string>"))).alias("gaps"), F.col("x.automation.implementation_status").alias("implementation")),
        "executions": of("assurance.executions").select("run", F.col("x.id").alias("execution_id"), "x.obligation_id", "x.status", (F.size(F.coalesce("x.reviews", F.array())) > 0).alias("reviewed")),
    }


def read_lifecycle_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, kind, label) and relations (source, target, kind) of a model's elements in JSON."""
    docs = _document(spark, path, "elements array<struct<`@id`:string,`@type`:string,name:string,relationships:array<struct<target:string,kind:string>>>>").select(F.inline("elements"))
    entities = docs.select(F.col("@id").alias("entity_id"), F.col("@type").alias("kind"), F.col("name").alias("label"))
    return entities, docs.select(F.col("@id").alias("source"), F.explode("relationships").alias("r")).select("source", "r.target", "r.kind")


def read_requirements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of requirement objects in XML: SPEC-OBJECT elements, and SPEC-RELATION elements between them."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    entities = xml("SPEC-OBJECT", "_IDENTIFIER string, `_LONG-NAME` string").select(F.col("_IDENTIFIER").alias("entity_id"), F.lit("requirement").alias("kind"), F.col("_LONG-NAME").alias("label"))
    ends = "struct<`SPEC-OBJECT-REF`:string>"
    relations = xml("SPEC-RELATION", f"_IDENTIFIER string, SOURCE {ends}, TARGET {ends}")
    return entities, relations.select(F.col("SOURCE.SPEC-OBJECT-REF").alias("source"), F.col("TARGET.SPEC-OBJECT-REF").alias("target"), F.lit("relation").alias("kind"))


def read_perf_receipts(spark: SparkSession, path: str) -> DataFrame:
    """(generated_at, environment, median_seconds, p95_seconds, peak_bytes, version, policy); receipts from before policies
    were kept get the default one."""
    docs = _document(spark, path, "generated_at string, environment map<string,string>, summary struct<median_seconds:double,p95_seconds:double,maximum_peak_traced_bytes:long>, tool struct<version:string>, policy struct<repeats:int,warmup:int>")
    default = F.struct(F.lit(2).alias("repeats"), F.lit(0).alias("warmup"))
    return docs.select(F.col("generated_at").try_cast("timestamp").alias("generated_at"), "environment", "summary.median_seconds", "summary.p95_seconds", F.col("summary.maximum_peak_traced_bytes").alias("peak_bytes"),
                       "tool.version", F.coalesce("policy", default).alias("policy"))


def register_spans_of(spark: SparkSession) -> None:
    """Make ``spans_of(body)`` known to the session's SQL: the spans of a trace document, JSON text, as an array of (trace_id,
    span_id, parent_span_id, name), which ``LATERAL VIEW inline`` makes rows of.

    It is an expression in Catalyst, so a query that uses it stays one pass over the documents.  A table function of the same
    body would be joined back to its documents by their text, which shuffles every text twice."""
    nested = "flatten(flatten(transform(d.resourceSpans, r -> transform(coalesce(r.scopeSpans, r.instrumentationLibrarySpans), s -> s.spans))))"
    span = "struct(s.traceId AS trace_id, s.spanId AS span_id, nullif(s.parentSpanId, '') AS parent_span_id, s.name AS name)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION spans_of(body STRING) RETURNS ARRAY<STRUCT<trace_id: STRING, span_id: STRING, parent_span_id: STRING, name: STRING>> "
        f"RETURN transform(array_compact(transform(array(from_json(body, '{_OTLP}')), d -> concat(coalesce(d.spans, array()), coalesce({nested}, array()))))[0], s -> {span})")


def explode_spans(documents: DataFrame, column: str = "body") -> DataFrame:
    """Spans of trace documents held as JSON text in a column, one row a span, beside the documents' other columns."""
    spans = F.from_json(F.col(column), _OTLP)
    docs = documents.withColumn("d", spans)
    others = [c for c in documents.columns if c != column]
    plain = docs.select(*others, F.explode(F.coalesce("d.spans", F.array())).alias("s"))
    nested = F.flatten(F.flatten(F.transform("d.resourceSpans", lambda r: F.transform(F.coalesce(r["scopeSpans"], r["instrumentationLibrarySpans"]), lambda s: s["spans"]))))
    traced = docs.select(*others, F.explode(F.coalesce(nested, F.array())).alias("s"))
    return plain.unionByName(traced).select(*others, F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("s.name").alias("name"))
