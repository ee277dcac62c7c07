"""Trees, diagrams, mapping, claims, paths and rules on tiny tables with answers worked by hand."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import claims, faults, graphs, joins, mapping, quality, stats, vulnerabilities, workflow
from evidentia.sources import readers


def tree(spark, gates):
    """Gates {node: (kind, k, children)} of one tree t."""
    g = spark.createDataFrame([("t", n, kind, k) for n, (kind, k, _) in gates.items()], "tree string, node string, kind string, k int")
    return g, spark.createDataFrame([("t", n, c) for n, (_, _, cs) in gates.items() for c in cs], "tree string, node string, child string")


SHARED = {"top": ("or", 0, ["x", "y"]), "x": ("and", 0, ["a", "b"]), "y": ("vote", 2, ["b", "c", "d"])}


def plain(gates, node, state):
    if node in state:
        return state[node]
    kind, k, children = gates[node]
    values = [plain(gates, c, state) for c in children]
    return any(values) if kind == "or" else sum(values) >= k if kind == "vote" else all(values)


def test_tree_probability_counts_shared_events_once(spark):
    p = {"a": 0.1, "b": 0.5, "c": 0.25, "d": 0.0}
    events = spark.createDataFrame([("t", n, x, x, min(1.0, 2 * x)) for n, x in p.items()], "tree string, node string, p double, low double, high double")
    rows, importance = faults.tree_probability(events, *tree(spark, SHARED))

    def top(probability, forced=()):
        total = 0.0
        for bits in itertools.product((False, True), repeat=4):
            state = dict(zip("abcd", bits))
            if all(state[n] == v for n, v in forced) and plain(SHARED, "top", state):
                w = 1.0
                for n, v in state.items():
                    w *= 1.0 if n in dict(forced) else probability[n] if v else 1 - probability[n]
                total += w
        return total

    row = rows.first()
    assert row.status == "computed" and abs(row.probability - top(p)) < 1e-12 and abs(row.high - top({n: min(1, 2 * x) for n, x in p.items()})) < 1e-12
    for r in importance.collect():
        assert abs(r.importance - (top(p, ((r.event, True),)) - top(p, ((r.event, False),)))) < 1e-12


def test_cut_sets_limits_and_cycles(spark):
    events = spark.createDataFrame([("t", n) for n in "abcd"], "tree string, node string")
    sets, status = faults.cut_sets(events, *tree(spark, SHARED))
    assert {tuple(r.cut_set) for r in sets.collect()} == {("a", "b"), ("b", "c"), ("b", "d"), ("c", "d")} and status.first().status == "computed"
    sets, status = faults.cut_sets(events, *tree(spark, SHARED), most_terms=2)
    assert sets.count() == 0 and status.first().status == "limit_exceeded"
    cyclic = {"top": ("or", 0, ["x"]), "x": ("and", 0, ["a", "top"])}
    assert faults.cut_sets(events, *tree(spark, cyclic))[1].first().status == "undefined_top"
    absorbed = {"top": ("or", 0, ["a", "x"]), "x": ("and", 0, ["a", "b", "c"])}
    assert [r.cut_set for r in faults.cut_sets(events, *tree(spark, absorbed))[0].collect()] == [["a"]]


def test_trees_with_cycles_have_no_value(spark):
    states = spark.createDataFrame([(1, "t", "a", True)], "s int, tree string, node string, value boolean")
    got = {r.node: r.value for r in faults.evaluate_trees(states, *tree(spark, {"g": ("or", 0, ["a"]), "top": ("or", 0, ["g", "top"])}), ["s"]).collect()}
    assert got == {"g": True, "top": None}


def test_nested_diagram_with_beta_and_importance(spark):
    blocks = spark.createDataFrame([("t", n, v, v - 0.1, v + 0.05) for n, v in (("a", 0.9), ("b", 0.8), ("c", 0.7))], "tree string, node string, value double, low double, high double")
    gates = spark.createDataFrame([("t", "top", "series", 0, 0.0), ("t", "pair", "parallel", 0, 0.2)], "tree string, node string, kind string, k int, beta double")
    inputs = spark.createDataFrame([("t", "top", "a"), ("t", "top", "pair"), ("t", "pair", "b"), ("t", "pair", "c")], "tree string, node string, child string")
    got = {r.node: r.value for r in faults.block_reliability(blocks, gates, inputs).collect()}
    pair = lambda b, c: 0.8 * (1 - (1 - b) * (1 - c)) + 0.2 * min(b, c)
    assert abs(got["pair"] - pair(0.8, 0.7)) < 1e-12 and abs(got["top"] - 0.9 * pair(0.8, 0.7)) < 1e-12
    importance = {r.block: r.importance for r in faults.block_importance(blocks, gates, inputs).collect()}
    assert abs(importance["a"] - pair(0.8, 0.7)) < 1e-12 and abs(importance["b"] - 0.9 * (pair(1, 0.7) - pair(0, 0.7))) < 1e-12


def test_vote_probability_and_exact_p(spark):
    from math import comb

    p = [0.2, 0.5, 0.9]
    row = spark.range(1).select(*[C.vote_probability(F.array(*[F.lit(x) for x in p]), F.lit(k)).alias(f"k{k}") for k in range(4)], C.binomial_p(F.lit(3), F.lit(20)).alias("p"),
                                C.binomial_p(F.lit(0), F.lit(5)).alias("q"), C.binomial_p(F.lit(499_000), F.lit(1_000_000)).alias("big"), C.binomial_p(F.lit(0), F.lit(0)).alias("none")).first()
    for k in range(4):
        exact = sum(1.0 * (x if a else 1 - x) * (y if b else 1 - y) * (z if c else 1 - z) for (a, b, c) in itertools.product((0, 1), repeat=3) for x, y, z in [p] if a + b + c >= k)
        assert abs(row[f"k{k}"] - exact) < 1e-12
    assert abs(row.p - 2 * sum(comb(20, i) for i in range(4)) / 2**20) < 1e-12 and abs(row.q - 2 / 32) < 1e-12 and row.none == 1.0
    assert abs(row.big - 0.0456) < 2e-4


def test_names_of_two_components_map_nothing(spark):
    parts = spark.createDataFrame([(1, "run", "a.run", "src/a.py"), (2, "run", "b.run", "src/b.py"), (3, "stop", "stop", "lib/src/b.py")], "component_id int, name string, qualname string, path string")
    spans = spark.createDataFrame([(1, "b.run", None, "run", "/x/src/b.py", "run"), (2, None, "src/a.py:a.run", "run", "", ""), (3, None, None, "run", "/x/src/b.py", "run"), (4, "", None, "stop", "/x/lib/src/b.py", "stop"), (5, None, None, None, "/y/src/c.py", "run")],
                                  "span_id int, attr string, other string, name string, file string, function string")
    got = {r.span_id: (r.component_id, r.method) for r in mapping.map_component(spans, parts, ["attr", "other"]).collect()}
    assert got == {1: (2, "attr"), 2: (1, "other"), 3: (None, "unmapped"), 4: (3, "span.name"), 5: (None, "unmapped")}
    assert {r.span_id: r.component_id for r in mapping.map_by_path_suffix(spans, parts).collect()} == {1: 2, 3: 2, 4: 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_of_all_widths_are_found(spark, seed):
    rng = random.Random(seed)
    ranges = [(i, f"p{i % 3}.py", a := rng.randint(0, 3000), a + rng.choice([0, 1, 7, 100, 5000, 10**9])) for i in range(80)]
    points = [(f"src/p{rng.randrange(4)}.py", rng.randint(0, 9000)) for _ in range(200)]
    frame = spark.createDataFrame(ranges, "component_id int, path string, line long, end_line long")
    got = {(r.path, r.line): (r.status, r.component_id) for r in mapping.suffix_range_map(spark.createDataFrame(points, "path string, line long"), frame, ["path", "line"]).collect()}
    for path, line in points:
        around = [(e - a, i) for i, p, a, e in ranges if path.endswith("/" + p) and a <= line <= e]
        best = [i for w, i in around if w == min(around)[0]] if around else []
        assert got[path, line] == (("unmapped", None) if not best else ("mapped", best[0]) if len(best) == 1 else ("ambiguous", None))


def test_similar_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, f"b{i % 2}", [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 12))]) for i in range(120)] + [(200 + i, "b0", ["w1", "w2", "w3", "w4", f"x{i}"]) for i in range(6)]
    frame = spark.createDataFrame(rows, "id int, b string, tokens array<string>")
    for least in (0.35, 0.6, 1.0):
        got = {(r.left_id, r.right_id): r.similarity for r in claims.similar_pairs(frame, None, least, ["b"]).collect()}
        want = {}
        for (i, b, x), (j, c, y) in itertools.combinations(rows, 2):
            u, v = set(x), set(y)
            if b == c and u and v and len(u & v) / len(u | v) >= least:
                want[min(i, j), max(i, j)] = len(u & v) / len(u | v)
        assert got == want


def test_claim_pairs(spark):
    rows = [(1, "c", False, "cache value is stale", "reads are accepted"), (2, "c", True, "cache value is stale now", "reads are rejected"), (3, "c", True, "cache value is stale", "disk fills quickly"), (4, "d", True, "cache value is stale", "x"), (5, "c", False, "cache value is stale", "y")]
    frame = spark.createDataFrame(rows, "claim_id int, component string, suggestion boolean, failure string, effect string")
    got = {(r.left_id, r.right_id, r.kind, r.field) for r in claims.claim_pairs(frame, ["failure", "effect"]).collect()}
    assert (1, 3, "duplicate", "failure") in got and (1, 2, "contradiction", "effect") in got and (1, 3, "divergence", "effect") in got
    assert not any(5 in x[:2] and 1 in x[:2] for x in got) and not any(4 in x[:2] for x in got)
    negated = spark.createDataFrame([("not the lock is held", "the lock is held"), ("not a", "b")], "a string, b string").select(claims.polarity_conflict(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in negated.collect()] == ["one claim explicitly negates the other", ""]


def test_identity_tokens_at_any_depth(spark):
    rows = spark.createDataFrame([("7", ("x", [("s1", "no"), (None, "no")]), ["r2", "r1"])], "id string, body struct<owner_id:string,parts:array<struct<part_sha256:string,note:string>>>, evidence_refs array<string>")
    got = rows.select(claims.identity_tokens(rows.schema).alias("t")).first().t
    assert got == sorted({"id=7", "owner_id=x", "id=x", "part_sha256=s1", "sha256=s1", "evidence_refs=r1", "evidence_refs=r2", "id=r1", "id=r2"})


def test_cascade_paths_count_what_they_leave_out(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "a"), ("x", "c"), ("d", "b"), ("e", "d"), ("f", "b")], "source string, target string")
    start = spark.createDataFrame([("x",)], "node string")
    paths, counts = graphs.cascade_paths(edges, start, 10, 3)
    assert {(tuple(r.path), r.truncated) for r in paths.collect()} == {(("x", "a", "c"), False), (("x", "b", "d", "e"), False), (("x", "b", "f"), False)}
    paths, counts = graphs.cascade_paths(edges, start, 2, 2)
    row = counts.first()
    assert row.kept == 2 and row.omitted == 1 and paths.count() == 2
    seq = graphs.reachable_sequence(edges, spark.createDataFrame([("e",)], "node string"), 9, 99).orderBy("step").collect()
    assert [(r.source, r.target) for r in seq] == [("e", "d"), ("d", "b"), ("b", "x"), ("x", "c"), ("c", "a"), ("a", "x")]


def test_cvss_vectors(spark):
    base = "AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N"
    rows = [f"CVSS:4.0/{base}", f"CVSS:4.0/{base}/E:A/U:Clear", f"CVSS:4.0/{base}/U:Clear/E:A", "CVSS:4.0", None, "CVSS:4.0/AV", f"CVSS:3.0/{base}"]
    got = spark.createDataFrame([(r,) for r in rows], "v string").select(vulnerabilities.cvss4_metrics(F.col("v")).alias("m")).collect()
    assert [r.m.valid for r in got] == [True, True, False, False, False, False, False] and got[1].m.metrics["U"] == "Clear" and got[2].m.metrics is None


def test_alpha_of_one_rating_each_is_null(spark):
    one = spark.createDataFrame([(1, True), (2, False)], "doc_id int, predicted boolean")
    assert stats.krippendorff_alpha(one, "doc_id", "predicted").first().alpha is None
    same = spark.createDataFrame([(1, True), (1, True), (2, True)], "doc_id int, predicted boolean")
    assert stats.krippendorff_alpha(same, "doc_id", "predicted").first().alpha == 1.0


def test_rescan_keeps_human_columns(spark):
    prev = spark.createDataFrame([(1, 10, "ok"), (2, 20, None), (3, 30, "ok")], "finding_id long, fingerprint long, review string")
    cur = spark.createDataFrame([(1, 11, "new1"), (2, 20, "new2"), (9, 30, "new9"), (5, 50, "new5")], "finding_id long, fingerprint long, rule string")
    got = {r.finding_id: (r.change, r.review, r.rule, r.revalidate) for r in joins.rescan_rows(prev, cur, ["review"], ["rule"]).collect()}
    assert got == {1: ("changed", "ok", "new1", True), 2: ("unchanged", None, "new2", False), 9: ("moved", "ok", "new9", True), 5: ("new", None, "new5", False)}


def test_rules_on_stored_results(spark):
    rows = spark.createDataFrame([(1, 10, 8, 4, 2, 6, 0.75, 0.6), (2, 0, 0, 0, 0, 0, None, None), (3, 10, 8, 4, 2, 6, 0.75, 0.5), (4, 5, 5, 1, 1, 3, 0.6, 0.6)], "id int, expected int, actual int, missing int, unexpected int, matched int, precision double, recall double")
    got = sorted((r.item_id, r.message) for r in quality.arithmetic(rows, "id").collect())
    assert got == [("3", "recall doesn't follow"), ("4", "matched is not actual less unexpected"), ("4", "matched is not expected less missing")]
    bounds = workflow.metric_bounds(spark.createDataFrame([("a", 9, 10), ("b", 8, 10)], "cluster string, k long, n long"), 20, 3, 0.5).first()
    assert bounds.k == 17 and bounds.conservative_low == min(bounds.wilson_low, bounds.bootstrap_low) and bounds.passed


def test_run_documents(spark, tmp_path):
    doc = {"schema_version": "0.6", "components": [{"id": "c1", "name": "f", "source": {"path": "a.py", "line": 3}, "call_sites": [{"order": 0, "line": 4, "reference": "g", "resolution": "unresolved"}], "called_by": ["b.py:h"]}],
           "items": [{"id": "f1", "component_id": "c1", "scanner": {"rule_id": "r"}, "review": {"disposition": "accepted", "severity": "high", "occurrence": "4"}}], "assurance": {"obligations": [{"id": "o1", "finding_id": "f1", "planning_gaps": ["x"]}], "executions": []}}
    (tmp_path / "run.json").write_text(json.dumps(doc, indent=1))
    got = readers.read_analysis(spark, str(tmp_path / "run.json"))
    f = got["findings"].first()
    assert (f.finding_id, f.severity, f.occurrence) == ("f1", None, 4) and got["call_sites"].first().reference == "g" and got["called_by"].first().caller_reference == "b.py:h"
    assert got["obligations"].first().gaps == 1 and got["executions"].count() == 0
    (tmp_path / "req.xml").write_text('<REQ-IF><SPEC-OBJECT IDENTIFIER="a" LONG-NAME="A"/><SPEC-OBJECT IDENTIFIER="b" LONG-NAME="B"/><SPEC-RELATION IDENTIFIER="r"><SOURCE><SPEC-OBJECT-REF>a</SPEC-OBJECT-REF></SOURCE><TARGET><SPEC-OBJECT-REF>b</SPEC-OBJECT-REF></TARGET></SPEC-RELATION></REQ-IF>')
    entities, relations = readers.read_requirements(spark, str(tmp_path / "req.xml"))
    assert {r.entity_id for r in entities.collect()} == {"a", "b"} and tuple(relations.first()) == ("a", "b", "relation")
    (tmp_path / "receipt.json").write_text(json.dumps({"generated_at": "2024-01-02T03:04:05Z", "environment": {"cpu": "x"}, "summary": {"median_seconds": 1.5}, "tool": {"version": "1"}}))
    assert readers.read_perf_receipts(spark, str(tmp_path / "receipt.json")).first().policy.repeats == 2
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "cve-1", "dueDate": "2024-05-01"}]}))
    assert readers.read_kev(spark, str(tmp_path / "kev.json")).first().cve == "CVE-1"
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"id": "n"}], "edges": [{"source": "n", "target": "m", "confidence_score": 0.5}]}))
    nodes, edges = readers.read_node_link(spark, str(tmp_path / "graph.json"))
    assert nodes.first().id == "n" and edges.first().confidence_score == 0.5
    (tmp_path / "score.json").write_text(json.dumps({"repo": {"name": "r"}, "checks": [{"name": "c", "score": -1}, {"name": "d", "score": 9}]}))
    assert [r.bucket for r in readers.read_scorecards(spark, str(tmp_path / "score.json")).collect()] == ["inconclusive", "high"]
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "test_a.py").write_text("x")
    assert readers.scan_files(spark, str(tmp_path / "tests")).first().kind == "python_test"


def test_no_query_is_registered_twice():
    from evidentia.plans import catalog

    with pytest.raises(ValueError):
        catalog.query()(catalog.QUERIES["j01_parent_child"])


def test_written_tables_of_many_rows_are_not_broadcast(spark):
    from evidentia import storage

    large, few = storage.saved(spark.range(storage.SMALL + 1)), storage.saved(spark.range(storage.SMALL))
    plan = lambda a: spark.range(5).join(a, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(large) and "Broadcast" in plan(few)


def test_importance_of_blocks_carries_them_up_instead_of_copying_trees(spark, monkeypatch):
    # 40 blocks of two gates that share one, a block that isn't below the top, and a tree whose top can't be computed
    names = [f"b{i}" for i in range(40)]
    blocks = spark.createDataFrame([("t", n, 0.5 + i / 100) for i, n in enumerate(names)] + [("t", "idle", 0.5), ("u", "a", 0.5)], "tree string, node string, value double").selectExpr("*", "value as low", "value as high")
    gates = spark.createDataFrame([("t", "top", "parallel", 0, 0.1), ("t", "x", "series", 0, 0.0), ("t", "y", "vote", 2, 0.0), ("u", "top", "series", 0, 0.0)], "tree string, node string, kind string, k int, beta double")
    inputs = spark.createDataFrame([("t", "x", n) for n in names[:21]] + [("t", "y", n) for n in names[20:]] + [("t", "top", "x"), ("t", "top", "y"), ("u", "top", "nowhere")], "tree string, node string, child string")
    written = []
    monkeypatch.setattr(faults, "saved", lambda df: written.append(kept := df.localCheckpoint()) or kept)
    got = {(r.diagram, r.block): r.importance for r in faults.block_importance(blocks, gates, inputs).collect()}
    assert max(df.count() for df in written) <= 44

    def top(chance):
        value = [chance.get(n, 0.5 + i / 100) for i, n in enumerate(names)]
        x = 1.0
        for v in value[:21]:
            x *= v
        dist = [1.0, 0.0]
        for v in value[20:]:
            dist = [dist[0] * (1 - v), dist[1] * (1 - v) + dist[0] * v]
        y = 1 - sum(dist)
        return 0.9 * (1 - (1 - x) * (1 - y)) + 0.1 * min(x, y)

    assert set(got) == {("t", n) for n in [*names, "idle"]} and got["t", "idle"] == 0
    assert all(abs(got["t", n] - (top({n: 1.0}) - top({n: 0.0}))) < 1e-9 for n in names)


def test_a_written_table_is_counted_while_it_is_written(spark):
    from evidentia import storage

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, "")
        try:
            return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (table, found), n = jobs("counted", lambda: storage.counted(spark.range(10), odd=F.count_if(F.col("id") % 2 == 1)))
    assert found == {"rows": 10, "odd": 5} and n == 1 and table.count() == 10
    assert jobs("saved", lambda: storage.saved(spark.range(10)))[1] == 1
    none, found = storage.counted(spark.range(10).where("id < 0"))
    assert found == {"rows": 0} and none.columns == ["id"] and not none.count()
