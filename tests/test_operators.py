"""Operators on hand-made rows."""

import os

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import graphs, joins, stats

SMALL = "/root/testdata/sf0.001"


def test_version_range_and_unresolved(spark):
    df = spark.createDataFrame([("1.0",), ("1.5",), ("2",), ("2.1rc1",)], "v string")
    events = F.array(F.struct(F.lit("introduced").alias("kind"), F.lit("1.2").alias("version")), F.struct(F.lit("fixed").alias("kind"), F.lit("2.0").alias("version")))
    assert [r[0] for r in df.select(C.version_in_range(F.col("v"), events)).collect()] == ["not_affected", "affected", "not_affected", "unresolved"]


def test_purl_and_endpoint(spark):
    row = spark.range(1).select(C.purl_parts(F.lit("pkg:PyPI/a%20b@1.0?x=1")).alias("p"), C.normalize_endpoint(F.lit("https://h/a//{id}/:x/?q=1")).alias("e"), C.normalize_endpoint(F.lit("mailto")).alias("n")).first()
    assert (row.p.ecosystem, row.p.name, row.p.version) == ("pypi", "a b", "1.0")
    assert (row.e, row.n) == ("/a/{parameter}/{parameter}", "")


def test_no_denominator_is_null(spark):
    df = spark.createDataFrame([(False, False), (None, True)], "expected boolean, predicted boolean")
    r = stats.confusion(df).first()
    assert (r.tn, r.precision, r.recall, r.accuracy) == (1, None, None, 1.0)


def test_range_map_ties_and_misses(spark):
    points = spark.createDataFrame([("f", 5), ("f", 12), ("f", 99), ("g", 1)], "path string, line long")
    ranges = spark.createDataFrame([(1, "f", 1, 20), (2, "f", 4, 8), (3, "f", 10, 14), (4, "f", 11, 15)], "component_id long, path string, line long, end_line long")
    got = {(r.path, r.line): (r.status, r.component_id) for r in joins.range_map(points, ranges, ["path", "line"]).collect()}
    assert got == {("f", 5): ("mapped", 2), ("f", 12): ("ambiguous", None), ("f", 99): ("unmapped", None), ("g", 1): ("unmapped", None)}


def test_closure_and_components_survive_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "source long, target long")
    seeds = spark.createDataFrame([(3,)], "node long")
    assert {(r.caller, r.depth) for r in graphs.upstream_closure(edges, seeds).collect()} == {(2, 1), (1, 2)}
    assert {(r.node, r.label) for r in graphs.components(edges.toDF("a", "b")).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_retries_reach_any_depth_and_cycles_end(spark):
    chain = [(i, i + 1, 2.0) for i in range(10)] + [(0, 3, 3.0), (0, 3, 20.0)]
    cycle = [(10, 20, 2.0), (20, 21, 2.0), (21, 20, 2.0), (21, 22, 1.0), (50, 51, 9.0)]
    edges = spark.createDataFrame(chain + cycle, "source long, target long, attempts double")
    got = {r.node: (r.product, r.cyclic) for r in graphs.retry_amplification(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {0: (1.0, False), 1: (2.0, False), 2: (4.0, False), **{i: (20.0 * 2 ** (i - 3), False) for i in range(3, 11)}, **{i: (None, True) for i in (20, 21, 22)}}


def test_closure_fails_beyond_a_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "source long, target long")
    seeds = spark.createDataFrame([(4,)], "node long")
    assert graphs.upstream_closure(edges, seeds, 4).count() == graphs.upstream_closure(edges, seeds).count() == 4
    with pytest.raises(ValueError, match="beyond depth 3"):
        graphs.upstream_closure(edges, seeds, 3)


def test_mcnemar_p(spark):
    rows = [(i, t, True, (t == "a") != (i == 9)) for i in range(10) for t in "ab"]
    r = stats.mcnemar(spark.createDataFrame(rows, "doc_id long, tool string, expected boolean, predicted boolean")).first()
    assert (r.left_only, r.right_only) == (9, 1) and abs(r.p - 2 * 11 / 1024) < 1e-12


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["classification", "n", "first_items", "omitted"]


def test_every_sql_runs():
    """DuckDB takes the SQL of every query, so that none breaks unseen."""
    duckdb = pytest.importorskip("duckdb")
    from evidentia.plans import catalog

    base = duckdb.connect()
    for name in os.listdir(SMALL):
        base.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    broken = {}
    for name, sql in catalog.ORACLES.items():
        try:
            base.execute(f"SELECT count(*) FROM ({sql})").fetchall()
        except duckdb.Error as e:
            broken[name] = str(e)[:200]
    assert not broken
