"""Queries that map spans, entities and call sites to components."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import mapping as M
from evidentia.plans.catalog import query
from evidentia.storage import marked
from evidentia.views import view

ALIASES = """n AS (SELECT component_id, name AS alias FROM v_named_components UNION SELECT component_id, qualname FROM v_named_components UNION SELECT component_id, path || ':' || qualname FROM v_named_components),
    u AS (SELECT alias, min(component_id) AS component_id FROM n GROUP BY alias HAVING count(DISTINCT component_id) = 1)"""


@query(f"""WITH {ALIASES} SELECT s.span_id, coalesce(a.component_id, b.component_id, c.component_id) AS component_id,
    CASE WHEN a.alias IS NOT NULL THEN 'component_attr' WHEN b.alias IS NOT NULL THEN 'function_attr' WHEN c.alias IS NOT NULL THEN 'span.name' ELSE 'unmapped' END AS method,
    coalesce(a.alias, b.alias, c.alias, s.name) AS reference
    FROM v_named_spans s LEFT JOIN u a ON a.alias = s.component_attr LEFT JOIN u b ON b.alias = s.function_attr LEFT JOIN u c ON c.alias = s.name""")
def j02_map_component(spark, sf_dir):
    return M.map_component(view(spark, sf_dir, "v_named_spans"), view(spark, sf_dir, "v_named_components"), ["component_attr", "function_attr"])


@query("""WITH n AS (SELECT component_id, path, name AS function FROM v_named_components UNION SELECT component_id, path, qualname FROM v_named_components)
    SELECT s.span_id, min(n.component_id) AS component_id, 'code.file.path+function' AS method FROM v_named_spans s JOIN n ON n.function = coalesce(s.function_attr, s.name) AND ends_with(s.file, n.path)
    GROUP BY s.span_id HAVING count(DISTINCT n.component_id) = 1""")
def j03_map_by_path_suffix(spark, sf_dir):
    spans = view(spark, sf_dir, "v_named_spans").withColumn("function", F.coalesce("function_attr", "name"))
    return M.map_by_path_suffix(spans, view(spark, sf_dir, "v_named_components"))


@query("""WITH e AS (SELECT DISTINCT source, target, line FROM v_observed_edges), s AS (SELECT component_id AS source, ord, reference, line AS site_line, split_part(reference, '.', 2) AS leaf FROM v_call_sites WHERE resolution <> 'unique_static_target'),
    m AS (SELECT DISTINCT e.source, e.target, e.line, s.ord, s.reference, s.site_line FROM e JOIN v_named_components c ON c.component_id = e.target JOIN s ON s.source = e.source AND (s.site_line = e.line OR s.leaf = c.name OR s.leaf = split_part(c.qualname, '.', 2))),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, target, line ORDER BY ord, reference, site_line) AS rank FROM m)
    SELECT source, target, line, ord, reference, CASE WHEN line = site_line THEN 'observed_callsite_line' ELSE 'target_name_heuristic' END AS correlation FROM r WHERE rank <= 20""")
def j05_dynamic_candidates(spark, sf_dir):
    edges = view(spark, sf_dir, "v_observed_edges").distinct()
    names = marked(view(spark, sf_dir, "v_named_components"))
    edges = edges.join(names.select(F.col("component_id").alias("target")), "target", "left_semi")
    return M.dynamic_candidates(edges, view(spark, sf_dir, "v_call_sites"), names).select("source", "target", "line", "ord", "reference", "correlation")


@query("""WITH p AS (SELECT DISTINCT r.path, r.line FROM v_scan_results r), m AS (SELECT p.path, p.line, c.component_id, c.end_line - c.line AS width FROM p JOIN v_components c ON (('src/' || p.path) = c.path OR ends_with('src/' || p.path, '/' || c.path)) AND p.line BETWEEN c.line AND c.end_line),
    k AS (SELECT *, rank() OVER (PARTITION BY path, line ORDER BY width) AS r FROM m), g AS (SELECT path, line, count(DISTINCT component_id) AS n, min(component_id) AS c FROM k WHERE r = 1 GROUP BY path, line)
    SELECT 'src/' || p.path AS path, p.line, CASE WHEN n IS NULL THEN 'unmapped' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS status, CASE WHEN n = 1 THEN c END AS component_id FROM p LEFT JOIN g USING (path, line)""")
def j06_suffix_range_map(spark, sf_dir):
    points = view(spark, sf_dir, "v_scan_results").select(F.concat(F.lit("src/"), "path").alias("path"), "line").distinct()
    return M.suffix_range_map(points, view(spark, sf_dir, "v_components"), ["path", "line"])


@query("""WITH c AS (SELECT page_id AS client_id, 'h' || CAST(page_id % 20 AS VARCHAR) AS file, 's' || CAST(page_id % 7 AS VARCHAR) AS symbol, 'v' || CAST(page_id AS VARCHAR) || '/:id' AS suffix FROM pages),
    b AS (SELECT DISTINCT 'file' AS scope, 'h' || CAST(page_id % 23 AS VARCHAR) AS key, '/api' || CAST(page_id % 3 AS VARCHAR) || '/' AS base FROM pages UNION SELECT DISTINCT 'symbol', 's' || CAST(page_id % 14 AS VARCHAR), 'http://x.y/sym' || CAST(page_id % 2 AS VARCHAR) FROM pages)
    SELECT DISTINCT client_id, CASE scope WHEN 'file' THEN rtrim(base, '/') ELSE substr(base, 11) END || '/v' || CAST(client_id AS VARCHAR) || '/{parameter}' AS path
    FROM c JOIN b ON (scope = 'file' AND key = file) OR (scope = 'symbol' AND key = symbol)""")
def j14_compose_base_paths(spark, sf_dir):
    from evidentia.views import table

    pages = table(spark, sf_dir, "pages")
    numbered = lambda p, m: F.concat(F.lit(p), (F.col("page_id") % m).cast("string"))
    clients = pages.select(F.col("page_id").alias("client_id"), numbered("h", 20).alias("file"), numbered("s", 7).alias("symbol"), F.lit(None).cast("string").alias("operation"), F.concat(F.lit("v"), F.col("page_id").cast("string"), F.lit("/:id")).alias("suffix"))
    bases = pages.select(F.lit("file").alias("scope"), numbered("h", 23).alias("key"), F.concat(numbered("/api", 3), F.lit("/")).alias("base")).unionByName(
        pages.select(F.lit("symbol").alias("scope"), numbered("s", 14).alias("key"), numbered("http://x.y/sym", 2).alias("base")))
    return M.compose_base_paths(clients, bases)


@query("""WITH k AS (SELECT component_id, CAST(component_id AS VARCHAR) AS identity FROM v_named_components UNION SELECT component_id, path || ':' || qualname FROM v_named_components),
    e AS (SELECT o_orderkey AS entity_id, CAST(o_custkey AS VARCHAR) AS identity FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, CAST(o_orderkey % 1500 AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 0),
    m AS (SELECT e.entity_id, count(DISTINCT component_id) AS n, min(component_id) AS c FROM e JOIN k USING (identity) GROUP BY e.entity_id)
    SELECT o_orderkey AS entity_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'linked' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN c END AS component_id FROM orders LEFT JOIN m ON entity_id = o_orderkey""")
def j29_code_links(spark, sf_dir):
    from evidentia.views import table

    text = lambda c: c.cast("string")
    ids = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 != 0, text(F.col("o_custkey"))), F.when(F.col("o_orderkey") % 2 == 0, text(F.col("o_orderkey") % 1500))))
    entities = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity_id"), ids.alias("identities"))
    return M.code_links(entities, view(spark, sf_dir, "v_named_components"))
