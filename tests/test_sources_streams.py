"""Readers on tiny files, and streams against their batch twins."""

import json

import __spark_entry__
from pyspark.sql import functions as F

from evidentia.sources import readers as R
from evidentia.storage import new_folder
from evidentia.streaming import jobs as S


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_spans_of_three_layouts(spark, tmp_path):
    attribute = lambda k, **v: {"key": k, "value": v}
    span = {"traceId": "t", "spanId": "1", "parentSpanId": "", "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": "x", "attributes": [attribute("a", intValue="1"), attribute("a", stringValue="2"), attribute("l", arrayValue={"values": [{"boolValue": True}]})]}
    otlp = put(tmp_path / "o.json", {"resourceSpans": [{"resource": {"attributes": [attribute("a", stringValue="0"), attribute("service.name", stringValue="s")]}, "instrumentationLibrarySpans": [{"spans": [span]}]}]})
    row = R.read_spans(spark, otlp).first()
    assert (row.parent_span_id, row.start_ns, row.end_ns) == (None, 5, None)
    assert row.attributes == {"a": "2", "service.name": "s", "l": '["true"]'}
    assert R.read_spans(spark, put(tmp_path / "l.json", [span, span])).count() == 2
    assert R.read_spans(spark, put(tmp_path / "s.json", {"spans": [span]})).count() == 1
    span["attributes"] = [attribute("gen_ai.system", stringValue="m")]
    assert [r.reject for r in R.read_genai_spans(spark, put(tmp_path / "g.json", [span, span])).collect()] == [True, True]


def test_scan_results_defaults_and_rejects(spark, tmp_path):
    at = lambda region: [{"physicalLocation": {"artifactLocation": {"uri": "f"}, **region}}]
    results = [{"ruleId": "r", "locations": at({})}, {"ruleId": "r", "locations": at({"region": {"startLine": 9, "endLine": 3}})}, {"ruleId": "r"}]
    rows = R.read_scan_results(spark, put(tmp_path / "r.sarif", {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t"}}, "results": results}]})).orderBy("result").collect()
    assert [(r.tool, r.line, r.end_line, r.column, r.reject) for r in rows] == [("t", 1, 1, 1, False), ("t", 9, 3, 1, True), ("t", 1, 1, 1, True)]


def test_small_readers(spark, tmp_path):
    assert {tuple(r) for r in R.read_adjacency(spark, put(tmp_path / "a.json", {"a": ["b", "c", "b"], "d": []})).collect()} == {("a", "b"), ("a", "c")}
    cover = R.read_coverage(spark, put(tmp_path / "c.json", {"files": {"f": {"executed_lines": [1, 2], "missing_lines": [2, 3]}}}))
    assert {tuple(r) for r in cover.collect()} == {("f", 1, 1, False), ("f", 2, 1, True), ("f", 3, 0, False)}
    assert [tuple(r) for r in R.read_epss(spark, put(tmp_path / "e.csv", "#model:v1\ncve,epss,percentile\nCVE-1,0.5,0.9\n")).collect()] == [("CVE-1", 0.5, 0.9)]
    bom = R.read_sbom(spark, put(tmp_path / "b.json", {"components": [{"bom-ref": "x", "purl": "pkg:pypi/n@1", "name": "n", "version": "1"}]})).first()
    assert tuple(bom) == ("x", "pkg:pypi/n@1", "pypi", "n", "1")
    adv = {"id": "A", "aliases": ["CVE-1"], "affected": [{"package": {"ecosystem": "PyPI", "name": "A_b"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}
    row = R.read_advisories(spark, put(tmp_path / "v.json", [adv])).first()
    assert (row.package, row.withdrawn, [tuple(e) for e in row.events]) == ("a-b", False, [("introduced", "0"), ("fixed", "2")])
    xml = "<testsuite><testcase name='a'/><testcase name='b'><failure message='m'>t</failure></testcase><testcase name='c'><skipped/></testcase></testsuite>"
    got = {r.outcome: r.n for r in R.read_test_reports(spark, put(tmp_path / "t.xml", xml)).collect()}
    assert got.get("passed", 0) + got.get("skipped", 0) == 2 and got["failed"] == 1
    manifest = R.read_case_manifest(spark, put(tmp_path / "m.json", {"cases": [{"case_id": "a", "evidence": ["e"]}, {"case_id": "a"}, {"case_id": "b"}]}))
    assert {tuple(r) for r in manifest.collect()} == {("a", 1, False), ("b", 0, True)}


def test_breaker_opens_probes_and_closes():
    b = S.Breaker(2, 10, 2)
    seen = [b.see(at, failed) for at, failed in [(0, True), (1, True), (5, False), (11, False), (12, False), (13, True)]]
    assert seen == [("closed", "closed", False), ("closed", "open", False), ("open", "open", True), ("half_open", "half_open", False), ("half_open", "closed", False), ("closed", "closed", False)]


def test_stream_of_breakers_is_the_batch_replay(spark):
    queries, sf_dir = __spark_entry__.queries(), "/root/testdata/sf0.001"
    a, b = queries["st03_breakers"](spark, sf_dir), queries["f03_breakers"](spark, sf_dir)
    # what the watermark hasn't passed yet isn't given out
    passed = b.selectExpr("*", "max(at_us) over () as newest").where("at_us div 1000 <= newest div 1000 - 3600000").drop("newest")
    rows = sorted(map(tuple, a.collect()), key=repr)
    assert rows and rows == sorted(map(tuple, passed.collect()), key=repr) and any(r[-1] for r in rows)


def test_breakers_of_many_services_share_state(spark):
    S.rocks(spark)
    services = 1500
    rows = spark.range(services * 3).selectExpr("id % 1500 as service", "id as event_id", "(id div 1500 + 1) * 10000000000 as at_us", "true as failed", "'closed' as logged_before", "cast(null as string) as logged_after")
    events = rows.withColumn("ts", F.timestamp_micros("at_us"))
    query = S.replay_breakers_stream(S.in_order(events, 3)).writeStream.format("memory").queryName("many_breakers").option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    # state is kept by bucket, not by service
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) < services
    told = spark.table("many_breakers").groupBy("at_us", "state_before", "state_after").count().collect()
    assert {tuple(r) for r in told} == {(10_000_000_000, "closed", "closed", services), (20_000_000_000, "closed", "open", services)}


def test_slices_of_time_where_the_newest_repeats(spark):
    events = spark.createDataFrame([(i, min(i, 5)) for i in range(40)], "event_id long, at long").withColumn("ts", F.timestamp_micros(F.col("at") * 1_000_000))
    files = S.in_order(events, 4)
    assert sorted(r.event_id for r in S.drained(files.select("event_id")).collect()) == list(range(40))


def test_edges_over_many_batches(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([("a", "b", str(n % 2)), ("a", "c", "x")], "source string, target string, channel string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, target string, channel string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = {(r.target, tuple(r.channels), r.seen) for r in S.rolling_edges(stream).select("target", "channels", F.col("seen")).collect()}
    assert rows == {("b", ("0", "1"), 3), ("c", ("x",), 3)}
