"""Queries of benchmark results, evaluation logs, taxonomies and other evidence files: given tables go through files and come back.

Documents that hold many rows grow in number with the table: a thousand identifiers each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import graphs as G
from evidentia.plans.catalog import query
from evidentia.sources import benchmarks as B
from evidentia.sources import readers as R
from evidentia.storage import new_folder
from evidentia.views import table

PER_DOCUMENT = 1000


def _text(c):
    return F.col(c).cast("string")


def _lines(rows: DataFrame, path: str) -> str:
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path


def _documents(rows: DataFrame, path: str) -> str:
    """Each row's value is a file."""
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _grouped(rows: DataFrame, key: str):
    return rows.groupBy(F.floor(F.col(key) / PER_DOCUMENT))


def _bench(spark, sf_dir) -> dict[str, DataFrame]:
    """Orders as the results of eight suites, by key; each in its own layout."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_custkey") % 2 == 0).alias("even"), (F.col("o_custkey") % 3 == 0).alias("third"))
    own = lambda n: rows.where(F.col("k") % 8 == n)
    name = F.concat(F.lit("t"), _text("k"))
    base = new_folder(spark)
    own(0).select(name.alias("testCaseName"), _text("even").alias("realVulnerability"), F.when(F.col("third"), "yes").otherwise("no").alias("toolFound")).write.option("header", True).csv(f"{base}/0")
    test = "Pytest Test Name (PathToFile::TestClass::TestMethod or PathToFile::TestMethod)"
    own(1).select(F.lit("p").alias("Project URL"), F.when(F.col("third"), None).otherwise(_text("c")).alias("SHA Detected"), name.alias(test)).write.option("header", True).csv(f"{base}/1")
    _lines(own(2).select(name.alias("task_id"), F.col("even").alias("resolved"), F.when(F.col("third"), "maybe").alias("passed")), f"{base}/2")
    listed = lambda c: F.coalesce(F.collect_list(F.when(c, name)), F.array())
    _documents(_grouped(own(3), "k").agg(F.to_json(F.struct(listed(F.col("even")).alias("success_ids"), listed(~F.col("even") & F.col("third")).alias("failure_ids"), listed(~F.col("even") & ~F.col("third")).alias("error_ids"))).alias("value")), f"{base}/3")
    entry = F.concat(F.lit('"'), name, F.lit('":'), F.when(F.col("third"), F.concat(F.lit('{"report":{"resolved":'), _text("even"), F.lit("}}"))).otherwise(_text("even")))
    _documents(_grouped(own(4), "k").agg(F.concat(F.lit('{"results":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("value")), f"{base}/4")
    attacks = own(5).select(F.lit("s").alias("suite_name"), name.alias("user_task_id"), F.when(F.col("third"), "direct").alias("attack_type"), F.col("even").alias("utility"), (~F.col("even")).alias("security"))
    _lines(attacks, f"{base}/5")
    _lines(own(6).select(name.alias("id"), F.when(F.col("even"), "pass").otherwise("fail").alias("passed"), F.when(F.col("third"), "n/a").otherwise((F.col("c") / 4).cast("string")).alias("coverage_delta"), (F.col("c") / 8).alias("mutation_score")), f"{base}/6")
    rewards = F.struct(F.struct(F.when(F.col("even"), 1).otherwise(0).alias("reward")).alias("rewards"))
    trial = own(7).select(F.lit("task").alias("task_name"), name.alias("trial_name"), F.sha2(_text("k"), 256).alias("task_checksum"), _text("k").alias("id"), F.struct(F.lit(1).alias("n")).alias("config"),
                          F.struct(F.lit("a").alias("name"), F.lit("1").alias("version")).alias("agent_info"), rewards.alias("verifier_result"), F.when(~F.col("third"), "2024-01-01").alias("finished_at"))
    _lines(trial, f"{base}/7")
    kinds = ("csv", "csv", "jsonl", "json", "json", "jsonl", "jsonl", "jsonl")
    return {layout: B.read_results(spark, f"{base}/{n}", layout, kinds[n]) for n, layout in enumerate(B.LAYOUTS)}


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, 't' || CAST(o_orderkey AS VARCHAR) AS t, o_custkey % 2 = 0 AS even, o_custkey % 3 = 0 AS third, o_orderkey % 8 AS n FROM orders),
    x AS (SELECT CASE n WHEN 1 THEN 'p@' || CAST(c AS VARCHAR) || '::' || t WHEN 5 THEN 's/' || t || CASE WHEN third THEN '/direct/none' ELSE '/none/none' END WHEN 7 THEN 'task@' || sha256(CAST(k AS VARCHAR)) || '/' || t ELSE t END AS case_id,
      CASE n WHEN 0 THEN CASE WHEN even THEN 'positive' ELSE 'negative' END WHEN 1 THEN 'positive' END AS expected, CASE WHEN n = 0 THEN CASE WHEN third THEN 'positive' ELSE 'negative' END END AS predicted,
      CASE WHEN n IN (2, 4, 6) THEN even WHEN n = 5 THEN NOT even WHEN n = 3 THEN CASE WHEN even THEN true WHEN third THEN false END WHEN n = 7 AND NOT third THEN even END AS passed,
      CASE WHEN n IN (2, 4, 5) THEN even WHEN n = 3 THEN CASE WHEN even THEN true WHEN third THEN false END WHEN n = 7 AND NOT third THEN even END AS resolved,
      CASE WHEN n = 6 THEN c / 4 END AS coverage_delta, CASE WHEN n = 6 THEN c / 8 END AS mutation_score,
      CASE n WHEN 3 THEN CASE WHEN even THEN 'success' WHEN third THEN 'failure' ELSE 'error' END WHEN 7 THEN CASE WHEN third THEN 'incomplete' WHEN even THEN 'success' ELSE 'failure' END ELSE 'not_reported' END AS outcome,
      CASE WHEN n = 1 AND third THEN 'no identifier' WHEN n = 2 AND third THEN 'no truth value: passed' WHEN n = 6 AND third THEN 'no number: coverage_delta' END AS reject,
      ['detections', 'flaky_tests', 'instances', 'id_lists', 'keyed', 'attacks', 'generated_tests', 'trials'][n + 1] AS layout FROM r)
    SELECT layout, CASE WHEN reject IS NULL THEN case_id END AS case_id, CASE WHEN reject IS NULL THEN expected END AS expected, CASE WHEN reject IS NULL THEN predicted END AS predicted,
      CASE WHEN reject IS NULL THEN passed END AS passed, CASE WHEN reject IS NULL THEN resolved END AS resolved, CASE WHEN reject IS NULL THEN coverage_delta END AS coverage_delta,
      CASE WHEN reject IS NULL THEN mutation_score END AS mutation_score, CASE WHEN reject IS NULL THEN outcome END AS outcome, reject FROM x""")
def s08_bench_results(spark, sf_dir):
    out = None
    for layout, rows in _bench(spark, sf_dir).items():
        rows = rows.drop("file").withColumn("layout", F.lit(layout))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH l AS (SELECT * FROM lineitem), s AS (SELECT l_orderkey AS o, CAST(floor(l_orderkey / 1000) AS BIGINT) AS g, count(*) AS n, sum(l_partkey) AS input, sum(l_suppkey) AS output, max(l_linenumber) AS last, min(l_returnflag) AS flag FROM l GROUP BY l_orderkey)
    SELECT 'run' || CAST(g AS VARCHAR) AS run_id, 'unassigned' AS eval_id, 'orders' AS task, CAST(o AS VARCHAR) AS sample_id, CAST(1 AS BIGINT) AS epoch, 'lines=' || CAST(n AS VARCHAR) || ',ok=' || flag AS scores, n AS tool_events,
      CAST(input AS BIGINT) AS input_tokens, CAST(output AS BIGINT) AS output_tokens, CAST(CASE WHEN o % 3 = 0 THEN 7 * n ELSE input + output END AS BIGINT) AS total_tokens, o % 5 <> 0 AS completed,
      CASE WHEN o % 11 = 0 THEN 'sample and epoch occur again' END AS reject FROM s
    UNION ALL SELECT 'run' || CAST(g AS VARCHAR), 'unassigned', 'orders', CAST(o AS VARCHAR), 1, 'again=1', 0, 4, 0, 4, true, 'sample and epoch occur again' FROM s WHERE o % 11 = 0""")
def s09_eval_logs(spark, sf_dir):
    """An order is a sample: its lines are models that took tokens and events of tools; every eleventh is there twice."""
    run = F.floor(F.col("l_orderkey") / PER_DOCUMENT)
    # lines go to their document's task once; neither lists of lines nor samples are shuffled
    line = table(spark, sf_dir, "lineitem").withColumn("g", run).repartition("g")
    usage = F.struct(F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("completion_tokens"), F.when(F.col("l_orderkey") % 3 == 0, 7).alias("total_tokens"))
    per = line.groupBy("g", "l_orderkey").agg(F.map_from_entries(F.transform(F.collect_list(usage), lambda u, i: F.struct(F.concat(F.lit("m"), i.cast("string")), u))).alias("model_usage"),
                                         F.concat(F.array_repeat(F.struct(F.lit("Tool_Call").alias("event")), F.count("*").cast("int")), F.array(F.struct(F.lit("state").alias("event")))).alias("events"),
                                         F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
    score = lambda v: F.struct(v.alias("value"), F.lit("a").alias("answer"))
    sample = F.to_json(F.struct(_text("l_orderkey").alias("id"), F.struct(F.col("flag").alias("ok"), score(F.col("n")).alias("lines")).alias("scores"), "events", "model_usage", F.when(F.col("l_orderkey") % 5 == 0, "failed").alias("error")))
    again = F.to_json(F.struct(_text("l_orderkey").alias("uuid"), F.struct(F.lit(True).cast("int").alias("again")).alias("scores"), F.struct(F.lit(4).alias("input_tokens"), F.lit(True).alias("output_tokens")).alias("usage")))
    each = per.select("g", F.when(F.col("l_orderkey") % 11 == 0, F.concat(sample, F.lit(","), again)).otherwise(sample).alias("s"))
    body = F.concat(F.lit('{"eval":{"run_id":"run'), F.col("g").cast("string"), F.lit('","task_name":"orders"},"samples":['), F.array_join("s", ","), F.lit("]}"))
    logs = _documents(each.groupBy("g").agg(F.collect_list("s").alias("s")).select(body.alias("value")), new_folder(spark))
    rows = B.read_eval_logs(spark, logs)
    scores = F.array_join(F.transform("scores", lambda s: F.concat(s["name"], F.lit("="), s["value"])), ",")
    return rows.select("run_id", "eval_id", "task", "sample_id", "epoch", scores.alias("scores"), "tool_events", "input_tokens", "output_tokens", "total_tokens", "completed", "reject")


def _taxonomy(spark, sf_dir):
    """Parts as weaknesses, customers as attack patterns: each weakness is a child of that of a third of its number."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_size").alias("z"))
    link = lambda tag, attribute, target, nature: F.concat(F.lit(f'<{tag} {attribute}="'), target.cast("string"), F.lit(f'" Nature="{nature}" View_ID="1000"/>'))
    status = F.when(F.col("z") % 10 == 0, "Obsolete").otherwise("Draft")
    parent = F.when(F.col("k") > 0, link("Related_Weakness", "CWE_ID", F.floor(F.col("k") / 3), "ChildOf")).otherwise("")
    weakness = F.concat(F.lit('<Weakness ID="'), _text("k"), F.lit('" Name="'), F.col("n"), F.lit('" Status="'), status, F.lit('" Abstraction="Base"><Related_Weaknesses>'), parent, parent, F.lit("</Related_Weaknesses></Weakness>"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    pattern = F.concat(F.lit('<Attack_Pattern ID="'), _text("k"), F.lit('" Name="a" Status="Stable"><Related_Attack_Patterns>'), link("Related_Attack_Pattern", "CAPEC_ID", F.col("k") + 1, "CanPrecede"),
                       F.lit("</Related_Attack_Patterns><Related_Weaknesses>"), link("Related_Weakness", "CWE_ID", F.col("k") % 7, "x"), F.lit("</Related_Weaknesses></Attack_Pattern>"))
    base = new_folder(spark)
    whole = lambda rows, xml, catalog: _grouped(rows.withColumn("x", xml), "k").agg(F.concat(F.lit(f"<{catalog}>"), F.array_join(F.collect_list("x"), ""), F.lit(f"</{catalog}>")).alias("value"))
    _documents(whole(part, weakness, "Weakness_Catalog"), f"{base}/a")
    _documents(whole(customer, pattern, "Attack_Pattern_Catalog"), f"{base}/b")
    return B.read_taxonomy(spark, f"{base}/*")


@query("""SELECT 'cwe' AS kind, CAST(p_partkey AS VARCHAR) AS entry_id, p_name AS name, CASE WHEN p_size % 10 = 0 THEN 'Obsolete' ELSE 'Draft' END AS status, 'Base' AS abstraction, p_size % 10 = 0 AS deprecated, CAST(NULL AS VARCHAR) AS reject FROM part
    UNION ALL SELECT 'capec', CAST(c_custkey AS VARCHAR), 'a', 'Stable', '', false, NULL FROM customer""")
def s13_taxonomy_entries(spark, sf_dir):
    return _taxonomy(spark, sf_dir)[0]


@query("""SELECT 'cwe' AS kind, CAST(p_partkey AS VARCHAR) AS entry_id, 'cwe' AS target_kind, CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR) AS target_id, 'childof' AS nature, '1000' AS view_id FROM part WHERE p_partkey > 0
    UNION ALL SELECT 'capec', CAST(c_custkey AS VARCHAR), 'capec', CAST(c_custkey + 1 AS VARCHAR), 'canprecede', '1000' FROM customer UNION ALL SELECT 'capec', CAST(c_custkey AS VARCHAR), 'cwe', CAST(c_custkey % 7 AS VARCHAR), 'x', '1000' FROM customer""")
def s13_taxonomy_links(spark, sf_dir):
    return _taxonomy(spark, sf_dir)[1]


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS node, CAST(floor(p_partkey / 3) AS BIGINT) AS ancestor, CAST(1 AS BIGINT) AS depth FROM part WHERE p_partkey > 0
    UNION ALL SELECT node, CAST(floor(ancestor / 3) AS BIGINT), depth + 1 FROM a WHERE ancestor > 0) SELECT CAST(node AS VARCHAR) AS node, CAST(ancestor AS VARCHAR) AS ancestor, depth FROM a""")
def s13_taxonomy_ancestors(spark, sf_dir):
    links = _taxonomy(spark, sf_dir)[1].where("kind = 'cwe' and nature = 'childof'")
    return G.ancestors(links.select(F.col("entry_id").alias("node"), F.col("target_id").alias("parent")))


@query("""SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id - event_id % 2 AS VARCHAR) AS span_id, event_type AS name,
    count(*) OVER (PARTITION BY user_id, event_id - event_id % 2) > 1 AS reject FROM events WHERE event_type <> 'error' QUALIFY count(*) OVER (PARTITION BY user_id, event_id - event_id % 2) >= 1""")
def s03_genai_spans(spark, sf_dir):
    text = lambda c: F.struct(c.alias("stringValue"))
    key = F.when(F.col("event_type") == "error", "other.model").otherwise("gen_ai.request.model")
    span = F.struct(_text("user_id").alias("traceId"), (F.col("event_id") - F.col("event_id") % 2).cast("string").alias("spanId"), F.col("event_type").alias("name"), F.array(F.struct(key.alias("key"), text(F.lit("m")).alias("value"))).alias("attributes"))
    docs = _grouped(table(spark, sf_dir, "events").withColumn("s", span), "event_id").agg(F.to_json(F.struct(F.collect_list("s").alias("spans"))).alias("value"))
    return R.read_genai_spans(spark, _documents(docs, new_folder(spark))).select("trace_id", "span_id", "name", "reject")


@query("""SELECT 'A-' || CAST(p_partkey AS VARCHAR) AS advisory_id, p_size % 4 = 0 AS withdrawn, 'PyPI' AS ecosystem, 'lib-' || CAST(p_size AS VARCHAR) AS package, 'introduced=0,fixed=' || CAST(p_size AS VARCHAR) AS events FROM part""")
def s06_advisories(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    events = F.array(F.create_map(F.lit("introduced"), F.lit("0")), F.create_map(F.lit("fixed"), _text("p_size")))
    affected = F.array(F.struct(F.struct(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("Lib_"), _text("p_size")).alias("name")).alias("package"), F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events"))).alias("ranges")))
    path = new_folder(spark)
    # one advisory a file is the format; a folder of a few hundred thousand files is one that is packed by hash of its parts
    part.select(F.concat(F.lit("A-"), _text("p_partkey")).alias("id"), F.when(F.col("p_size") % 4 == 0, "2024-01-01").alias("withdrawn"), affected.alias("affected"), F.floor(F.col("p_partkey") / PER_DOCUMENT).alias("g")) \
        .groupBy("g").agg(F.to_json(F.collect_list(F.struct("id", "withdrawn", "affected"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = R.read_advisories(spark, path)
    return rows.select("advisory_id", "withdrawn", "ecosystem", "package", F.array_join(F.transform("events", lambda e: F.concat(e["kind"], F.lit("="), e["version"])), ",").alias("events"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target, l_returnflag AS relation, l_discount AS confidence_score FROM lineitem""")
def s11_node_link(spark, sf_dir):
    edge = F.struct(_text("l_orderkey").alias("source"), _text("l_partkey").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("confidence_score"))
    docs = _grouped(table(spark, sf_dir, "lineitem").withColumn("e", edge), "l_orderkey").agg(F.to_json(F.struct(F.collect_list("e").alias("edges"))).alias("value"))
    return R.read_node_link(spark, _documents(docs, new_folder(spark)))[1].select("source", "target", "relation", "confidence_score")


@query("""SELECT s_name AS repository, 'nation' AS name, CAST(s_nationkey % 12 - 1 AS DOUBLE) AS score, CASE WHEN s_nationkey % 12 = 0 THEN 'inconclusive' WHEN s_nationkey % 12 - 1 < 5 THEN 'low' WHEN s_nationkey % 12 - 1 < 8 THEN 'medium' ELSE 'high' END AS bucket FROM supplier""")
def s14_scorecards(spark, sf_dir):
    check = F.array(F.struct(F.lit("nation").alias("name"), (F.col("s_nationkey") % 12 - 1).cast("double").alias("score")))
    card = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.struct(F.col("s_name").alias("name")).alias("repo"), check.alias("checks")).alias("c"))
    docs = _grouped(card, "s_suppkey").agg(F.to_json(F.collect_list("c")).alias("value"))
    return R.read_scorecards(spark, _documents(docs, new_folder(spark)))


@query("SELECT CASE WHEN o_custkey % 7 = 0 THEN 'failed' WHEN o_custkey % 11 = 0 THEN 'error' WHEN o_custkey % 5 = 0 THEN 'skipped' ELSE 'passed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def s17_test_reports(spark, sf_dir):
    c = F.col("o_custkey")
    inside = F.when(c % 7 == 0, '<failure message="no">x</failure>').when(c % 11 == 0, '<error message="no">x</error>').when(c % 5 == 0, "<skipped>later</skipped>").otherwise("<properties></properties>")
    case = F.concat(F.lit('<testcase name="t'), _text("o_orderkey"), F.lit('" classname="c">'), inside, F.lit("</testcase>"))
    docs = _grouped(table(spark, sf_dir, "orders").withColumn("x", case), "o_orderkey").agg(F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list("x"), ""), F.lit("</testsuite>")).alias("value"))
    return R.read_test_reports(spark, _documents(docs, new_folder(spark)))


@query("""SELECT sha256('file ' || CAST(g AS VARCHAR) || chr(10)) AS sha256, CAST(strlen('file ' || CAST(g AS VARCHAR)) + 1 AS BIGINT) AS bytes FROM (SELECT DISTINCT CAST(floor(o_orderkey / 1000) AS BIGINT) AS g FROM orders)""")
def s16_scan_files(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / PER_DOCUMENT).alias("g")).distinct().select(F.concat(F.lit("file "), _text("g")).alias("value"))
    return R.scan_files(spark, _documents(docs, new_folder(spark))).where("path like '%.txt'").select("sha256", "bytes")


@query("SELECT 'c' || CAST(l_orderkey AS VARCHAR) AS case_id, count(*) AS evidence, true AS \"unique\" FROM lineitem GROUP BY l_orderkey")
def s21_case_manifest(spark, sf_dir):
    cases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_text("l_partkey")).alias("evidence"))
    case = F.struct(F.concat(F.lit("c"), _text("l_orderkey")).alias("case_id"), "evidence")
    docs = _grouped(cases.withColumn("c", case), "l_orderkey").agg(F.to_json(F.struct(F.collect_list("c").alias("cases"))).alias("value"))
    return R.read_case_manifest(spark, _documents(docs, new_folder(spark)))
