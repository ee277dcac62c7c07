"""Queries of scalar expressions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.plans.catalog import query
from evidentia.views import table, view


@query("SELECT finding_id, CASE WHEN severity BETWEEN 1 AND 10 AND occurrence BETWEEN 1 AND 10 AND detection BETWEEN 1 AND 10 THEN severity * occurrence * detection END AS rpn FROM v_findings")
def p01_rpn(spark, sf_dir):
    return view(spark, sf_dir, "v_findings").select("finding_id", C.rpn(F.col("severity"), F.col("occurrence"), F.col("detection")).alias("rpn"))


@query("SELECT c_custkey, 'CMP-' || upper(substr(sha256(c_name || chr(31) || c_mktsegment), 1, 12)) AS id FROM customer")
def p02_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.stable_id("CMP", F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[?#].*$', '') AS p FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(p, '\$?\{[^/}]*\}|:[A-Za-z_][A-Za-z0-9_]*', '{parameter}', 'g'), '/+', '/', 'g') AS p FROM a),
    c AS (SELECT page_id, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS p FROM b)
    SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '' END AS endpoint FROM c""")
def p04_normalize_endpoint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.normalize_endpoint(F.col("url")).alias("endpoint"))


@query("SELECT bom_ref, translate(lower(package), '_.', '--') AS name FROM v_sbom")
def p06_normalize_package(spark, sf_dir):
    return view(spark, sf_dir, "v_sbom").select("bom_ref", C.normalize_package(F.col("package")).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'unresolved' WHEN p_size >= 30 THEN 'not_affected' WHEN p_size >= 10 THEN 'affected' ELSE 'not_affected' END AS state FROM part""")
def p07_version_in_range(spark, sf_dir):
    v = F.when(F.col("p_size") % 7 == 0, F.concat("p_size", F.lit(".0rc1"))).otherwise(F.concat("p_size", F.lit(".0")))
    events = F.array(F.struct(F.lit("introduced").alias("kind"), F.lit("10").alias("version")), F.struct(F.lit("fixed").alias("kind"), F.lit("30.0.0").alias("version")))
    return table(spark, sf_dir, "part").select("p_partkey", C.version_in_range(v, events).alias("state"))


@query(r"""SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 1))) AS INTEGER) AS n FROM documents""")
def p09_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(C.tokens(F.col("text"))).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 1)) AS t FROM documents),
    p AS (SELECT a.doc_id, a.t AS a, b.t AS b FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 9) END AS similarity FROM p""")
def p10_jaccard(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", C.tokens(F.col("text")).alias("a"))
    following = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return t.join(following, "doc_id").select("doc_id", F.round(C.jaccard(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(ltrim(text), '^[=+\-@]') THEN '''' || text ELSE text END AS cell FROM documents""")
def p13_csv_safe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.csv_safe(F.col("text")).alias("cell"))


@query("SELECT p_partkey, p_name GLOB '*ring' OR p_name GLOB 's?all*' AS matches FROM part")
def p14_glob_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.glob_match(F.col("p_name"), ["*ring", "s?all*"]).alias("matches"))


@query("""SELECT finding_id, selector FROM v_findings JOIN (VALUES ('*'), ('rule.*'), ('rule.7'), ('class.*')) s(selector)
    ON selector = '*' OR rule_id = selector OR (selector LIKE '%.*' AND starts_with(rule_id, replace(selector, '*', '')))""")
def p15_selector_match(spark, sf_dir):
    selectors = F.array(*[F.lit(x) for x in ("*", "rule.*", "rule.7", "class.*")])
    rows = view(spark, sf_dir, "v_findings").select("finding_id", "rule_id", F.explode(selectors).alias("selector"))
    return rows.where(C.selector_match(F.col("rule_id"), F.col("selector"))).select("finding_id", "selector")


@query("""SELECT event_id, CASE WHEN value > 90 THEN 'unavailable' WHEN value < 10 THEN 'invalid' ELSE 'observed' END AS status,
    CASE WHEN value BETWEEN 10 AND 90 THEN CAST(floor(value) AS BIGINT) - 9 END AS duration FROM events""")
def p16_span_timing(spark, sf_dir):
    end = F.when(F.col("value") > 90, "n/a").otherwise(F.floor("value").cast("string"))
    end = F.when(F.col("value") < 10, F.lit("0")).otherwise(end)
    return table(spark, sf_dir, "events").select("event_id", C.span_timing(F.lit("9"), end).alias("t")).select("event_id", "t.status", "t.duration")


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 100 >= 90 THEN 'A' WHEN s_acctbal / 100 >= 80 THEN 'B' WHEN s_acctbal / 100 >= 70 THEN 'C' WHEN s_acctbal / 100 >= 60 THEN 'D' ELSE 'F' END AS grade FROM supplier")
def p18_grade(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.grade(F.col("s_acctbal") / 100).alias("grade"))


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN CASE WHEN value = 0 THEN 0.0 ELSE 100.0 END ELSE round((value - event_id % 50) / (event_id % 50) * 100, 3) END AS pct FROM events")
def p19_pct_change(spark, sf_dir):
    base = (F.col("event_id") % 50).cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.when(base == 0, F.when(F.col("value") == 0, 0.0).otherwise(100.0)).otherwise(C.pct_change(F.col("value"), F.nullif(base, F.lit(0.0)))).alias("pct"))


@query("SELECT page_id, array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') AS area FROM pages")
def p21_source_area(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.source_area(F.col("url")).alias("area"))


@query("SELECT finding_id, CASE screening_priority WHEN 'high' THEN 8 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 0 END AS score FROM v_findings")
def p22_priority_score(spark, sf_dir):
    return view(spark, sf_dir, "v_findings").select("finding_id", C.priority_score(F.col("screening_priority")).alias("score"))


@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(text, 'token = "[0-9a-f]+"', '[REDACTED]', 'g'), '[0-9]{16}', '[REDACTED]', 'g'), 1, 2000) AS shown FROM documents""")
def p23_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.redact(F.col("text"), ['token = "[0-9a-f]+"', "[0-9]{16}"]).alias("shown"))


@query("SELECT measure_id, value - uncertainty >= threshold AS passes FROM v_measures")
def p29_measure_pass(spark, sf_dir):
    return view(spark, sf_dir, "v_measures").select("measure_id", C.measure_pass(F.col("value"), F.col("uncertainty"), F.col("threshold"), F.lit("minimum")).alias("passes"))


@query("SELECT s_suppkey, CASE WHEN abs((s_acctbal - 5000) / 1500.0) > 3 THEN 'action' WHEN abs((s_acctbal - 5000) / 1500.0) > 2 THEN 'warning' ELSE 'acceptable' END AS status FROM supplier")
def p30_zscore_status(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.zscore_status(F.col("s_acctbal"), F.lit(5000.0), F.lit(1500.0)).alias("status"))


@query("SELECT event_id, event_id % 3 <> 0 AS accepted FROM events")
def p32_strict_instant(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "").otherwise("Z"))
    return table(spark, sf_dir, "events").select("event_id", C.strict_instant(text).isNotNull().alias("accepted"))


@query(r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS claim FROM conversations")
def p33_claim_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.claim_text(F.col("text")).alias("claim"))
