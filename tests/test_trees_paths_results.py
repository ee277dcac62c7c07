"""Fault trees and cascade paths against plain versions, and the layouts of results, logs and catalogues."""

import json
import random
import re
from collections import Counter

from evidentia.operators import faults as T
from evidentia.operators import graphs as G
from evidentia.sources import benchmarks as B


def some_tree(rng, most_events):
    events = [f"e{i}" for i in range(rng.randrange(1, most_events + 1))]
    gates, names = [], list(events)
    for i in range(rng.randrange(1, 6)):
        gates.append((f"g{i}", rng.choice(["and", "or", "vote", "inhibit"]), rng.randrange(0, 5), sorted(rng.sample(names, min(len(names), rng.randrange(1, 5))))))
        names.append(f"g{i}")
    return events, [*gates[:-1], ("top", *gates[-1][1:])]


def plain_value(gates, node, on):
    if node not in gates:
        return node in on
    kind, k, children = gates[node]
    v = [plain_value(gates, c, on) for c in children]
    return any(v) if kind == "or" else sum(v) >= k if kind == "vote" else all(v)


def test_trees_are_the_plain_ones(spark):
    rng = random.Random(6)
    events, gates, inputs, want, cuts = [], [], [], {}, {}
    for t in range(40):
        own, drawn = some_tree(rng, 8 if t else 12)
        by = {n: (kind, k, c) for n, kind, k, c in drawn}
        p = {e: rng.random() for e in own}
        events += [(t, e, p[e], p[e] / 2, 1.0) for e in own]
        gates += [(t, n, kind, k) for n, kind, k, _ in drawn]
        inputs += [(t, n, c) for n, _, _, children in drawn for c in children]
        states = [{e for i, e in enumerate(own) if s >> i & 1} for s in range(2 ** len(own))]
        on = [s for s in states if plain_value(by, "top", s)]
        chance = lambda s, q, skip=None: __import__("math").prod(q[e] if e in s else 1 - q[e] for e in own if e != skip)
        want[t] = (sum(chance(s, p) for s in on), {e: sum(chance(s, p, e) * (1 if e in s else -1) for s in on) for e in own})
        cuts[t] = sorted(sorted(s) for s in on if not any(o < s for o in on))
    ev, ga, inp = spark.createDataFrame(events, "tree long, node string, p double, low double, high double"), spark.createDataFrame(gates, "tree long, node string, kind string, k int"), spark.createDataFrame(inputs, "tree long, node string, child string")
    rows, parts = T.tree_probability(ev, ga, inp)
    assert all(r.status == "computed" and abs(r.probability - want[r.tree][0]) < 1e-9 for r in rows.collect())
    got = parts.collect()
    assert len(got) == len(events) and all(abs(r.importance - want[r.tree][1][r.event]) < 1e-9 for r in got)
    sets, states = T.cut_sets(ev, ga, inp)
    found = {t: [] for t in cuts}
    for r in sets.collect():
        found[r.tree].append(r.cut_set)
    assert {t: sorted(v) for t, v in found.items()} == cuts and {r.status for r in states.collect()} == {"computed"}


def test_large_gates_end_early(spark):
    names = [f"e{i:02}" for i in range(31)]
    ors = [(f"o{i}", "or", 0, names[2 * i : 2 * i + 2]) for i in range(14)]
    trees = {"vote": [("top", "vote", 15, names)], "few": [("top", "vote", 30, names)], "product": [*ors, ("top", "and", 0, [o[0] for o in ors])], "within": [*ors[:13], ("top", "and", 0, [o[0] for o in ors[:13]])],
             "cycle": [("top", "or", 0, ["other"]), ("other", "or", 0, ["top"])]}
    events = spark.createDataFrame([(t, e) for t in trees for e in names], "tree string, node string")
    gates = spark.createDataFrame([(t, n, kind, k) for t, own in trees.items() for n, kind, k, _ in own], "tree string, node string, kind string, k int")
    inputs = spark.createDataFrame([(t, n, c) for t, own in trees.items() for n, _, _, cs in own for c in cs], "tree string, node string, child string")
    sets, states = T.cut_sets(events, gates, inputs)
    assert {r.tree: r.status for r in states.collect()} == {"vote": "limit_exceeded", "few": "computed", "product": "limit_exceeded", "within": "computed", "cycle": "undefined_top"}
    assert Counter(r.tree for r in sets.collect()) == {"few": 31, "within": 2**13}
    chances = events.selectExpr("*", "0.5D as p", "0D as low", "1D as high")
    assert {(r.tree, r.status) for r in T.tree_probability(chances, gates, inputs)[0].collect()} == {(t, "too_many_events") for t in trees}


def test_diagrams_and_trees_without_gates(spark):
    blocks = spark.createDataFrame([("d", "a", 0.5, 0.4, 0.6)], "tree string, node string, value double, low double, high double")
    gates = spark.createDataFrame([], "tree string, node string, kind string, k int, beta double")
    inputs = spark.createDataFrame([], "tree string, node string, child string")
    assert T.block_reliability(blocks, gates, inputs).count() == 0
    events = spark.createDataFrame([("d", "a", 0.5, 0.4, 0.6)], "tree string, node string, p double, low double, high double")
    assert [r.status for r in T.tree_probability(events, gates.drop("beta"), inputs)[0].collect()] == ["undefined_top"]
    assert T.cut_sets(events, gates.drop("beta"), inputs)[1].count() == 0


def plain_paths(edges, start, depth):
    callers = {}
    for s, t in set(edges):
        callers.setdefault(t, set()).add(s)
    done = []

    def go(path):
        more = [c for c in callers.get(path[-1], ()) if c not in path]
        if not more or len(path) > depth:
            if len(path) > 1:
                done.append((path, bool(more)))
            return
        for c in more:
            go(path + [c])

    go([start])
    return sorted(done, key=lambda p: (len(p[0]), p[0]))


def test_cascade_paths_are_the_plain_ones(spark):
    rng = random.Random(3)
    graphs = [[("B", "A"), ("C", "A"), ("D", "B")], *[[(rng.choice("ABCDEFG"), rng.choice("ABCDEFG")) for _ in range(14)] for _ in range(4)]]
    for edges in graphs:
        nodes = sorted({n for e in edges for n in e})
        df, starts = spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([(n,) for n in nodes], "node string")
        for per_start, depth in ((1, 4), (3, 3)):
            paths, counts = G.cascade_paths(df, starts, per_start, depth)
            plain = {n: p for n in nodes if (p := plain_paths(edges, n, depth))}
            assert sorted((r.node, r.path, r.truncated) for r in paths.collect()) == sorted((n, *p) for n, own in plain.items() for p in own[:per_start])
            assert {r.node: (r.kept, r.omitted) for r in counts.collect()} == {n: (min(len(p), per_start), max(0, len(p) - per_start)) for n, p in plain.items()}
    fan = spark.createDataFrame([(f"n{i}", "A") for i in range(30)] + [(f"m{j}", f"n{i}") for i in range(1, 30) for j in range(30)], "source string, target string")
    paths, counts = G.cascade_paths(fan, spark.createDataFrame([("A",)], "node string"), 1, 5, most=100)
    assert [r.path for r in paths.collect()] == [["A", "n0"]] and counts.first().omitted is None


def put(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_result_layouts_and_rejects(spark, tmp_path):
    csv = "testCaseName,realVulnerability,toolFound\na,true,No\nb,FALSE,perhaps\n,true,true\n"
    got = B.read_results(spark, put(tmp_path / "d.csv", csv), "detections", "csv")
    assert rows_of(got, "case_id", "expected", "predicted", "reject") == sorted([("a", "positive", "negative", None), (None, None, None, "no truth value: predicted"), (None, None, None, "no identifier")], key=repr)
    lines = '{"instance_id":"x","resolved":true}\n\nbad{\n{"task_id":7,"resolved":0,"passed":"yes"}\n'
    assert rows_of(B.read_results(spark, put(tmp_path / "i.jsonl", lines), "instances", "jsonl"), "case_id", "passed", "resolved", "reject") == sorted([("x", True, True, None), ("7", True, False, None), (None, None, None, "unreadable")], key=repr)
    assert rows_of(B.read_results(spark, put(tmp_path / "i.json", {"cases": [{"id": "q", "resolved": "no"}]}), "instances", "json"), "case_id", "resolved") == [("q", False)]
    lists = {"success_ids": ["a"], "failure_ids": ["b"], "incomplete_ids": ["c"], "other": 1}
    assert rows_of(B.read_results(spark, put(tmp_path / "l.json", lists), "id_lists", "json"), "case_id", "resolved", "outcome") == sorted([("a", True, "success"), ("b", False, "failure"), ("c", None, "incomplete")], key=repr)
    for document in ({"results": {"k": {"resolved": True}, "m": False, "e": {}}}, {"k": {"report": {"resolved": True}}, "m": "fail", "e": {"x": 1}}):
        assert rows_of(B.read_results(spark, put(tmp_path / "k.json", document), "keyed", "json"), "case_id", "resolved") == sorted([("k", True), ("m", False), ("e", None)], key=repr)
    attacks = "\n".join(map(json.dumps, [{"suite_name": "s", "user_task_id": "u", "utility": True, "security": False}, {"id": "z", "utility": True}, {"case_id": "w", "utility": None, "security": True}]))
    assert rows_of(B.read_results(spark, put(tmp_path / "a.jsonl", attacks), "attacks", "jsonl"), "case_id", "passed", "resolved", "reject") == sorted([("s/u/none/none", False, True, None), (None, None, None, "no identifier"), ("w", True, None, None)], key=repr)
    tests = '{"task_id":"t","passed":1,"coverage_delta":"","mutation_score":0.5}\n{"task_id":"u","coverage_delta":"Infinity"}'
    assert rows_of(B.read_results(spark, put(tmp_path / "g.jsonl", tests), "generated_tests", "jsonl"), "case_id", "coverage_delta", "mutation_score", "reject") == sorted([("t", None, 0.5, None), (None, None, None, "no number: coverage_delta")], key=repr)


def test_trials(spark, tmp_path):
    good = {"task_name": "t", "trial_name": "n", "id": "i", "task_checksum": "a" * 64, "config": {"x": 1}, "agent_info": {"name": "a", "version": "1"}, "finished_at": "2024", "verifier_result": {"rewards": {"reward": 1}}}
    trials = [good, good | {"verifier_result": {"rewards": {"reward": 0.0}}}, good | {"exception_info": {"e": 1}}, good | {"finished_at": None, "verifier_result": None}, good | {"verifier_result": {"rewards": {"reward": 0.5}}},
              good | {"verifier_result": {"rewards": {"reward": True}}}, good | {"verifier_result": {"rewards": {"reward": 1, "b": 1}}}, good | {"step_results": [1]}, good | {"task_checksum": "x"}, good | {"config": {}}]
    got = B.read_results(spark, put(tmp_path / "t.jsonl", "\n".join(map(json.dumps, trials))), "trials", "jsonl").collect()
    assert Counter((r.outcome, r.passed) for r in got) == {("success", True): 1, ("failure", False): 1, ("error", None): 1, ("incomplete", None): 1, (None, None): 6}
    assert {r.case_id for r in got if r.reject is None} == {f"t@{'a' * 64}/n"}


def test_eval_logs(spark, tmp_path):
    samples = [{"id": 1, "scores": {"b": 1, "a": {"value": "C", "answer": "x"}}, "events": [{"event": "Tool"}, {"type": "tool_call"}, {"event": "model"}, 5], "model_usage": {"m": {"input_tokens": 3, "output_tokens": 4}, "n": {"prompt_tokens": 2, "total_tokens": 9}}},
               {"uuid": "u", "epoch": 2, "usage": {"input_tokens": 5, "output_tokens": True}, "error": "no"}, {"uuid": "u", "epoch": 2}, {"messages": [{"a": 1}]}]
    put(tmp_path / "one.json", {"eval": {"task": "t", "model": "m", "run_id": "r"}, "samples": samples})
    put(tmp_path / "two.json", {"eval": {}})
    put(tmp_path / "bad.json", "{")
    got = {(r.sample_id, r.epoch, r.completed): r for r in B.read_eval_logs(spark, str(tmp_path)).where("run_id = 'r'").collect()}
    first = got["1", 1, True]
    assert [(s.name, s.value, s.answer) for s in first.scores] == [("a", "C", "x"), ("b", "1", None)]
    assert (first.tool_events, first.input_tokens, first.output_tokens, first.total_tokens, first.reject) == (2, 5, 4, 9, None)
    failed = got["u", 2, False]
    assert (failed.input_tokens, failed.output_tokens, failed.total_tokens, failed.reject) == (5, 0, 5, "sample and epoch occur again")
    assert got["3", 1, True].messages_sha256 and len(got) == 4
    assert Counter(r.reject for r in B.read_eval_logs(spark, str(tmp_path)).where("run_id <> 'r'").collect()) == {"unreadable": 1, "no metadata or samples": 1}


def test_taxonomies(spark, tmp_path):
    weaknesses = "<Weakness_Catalog><Weakness ID='1' Name='n' Status='Draft' Abstraction='Base'><Related_Weaknesses><Related_Weakness CWE_ID='2' Nature='ChildOf' View_ID='9'/><Related_Weakness CWE_ID='2' Nature='childof' View_ID='9'/><Related_Weakness CWE_ID='x'/></Related_Weaknesses></Weakness><Weakness ID='2' Name='' Status='Deprecated'/></Weakness_Catalog>"
    patterns = "<Attack_Pattern_Catalog><Attack_Pattern ID='5' Name='p' Status='Stable'><Related_Attack_Patterns><Related_Attack_Pattern CAPEC_ID='6' Nature='CanPrecede'/></Related_Attack_Patterns><Related_Weaknesses><Related_Weakness CWE_ID='1'/></Related_Weaknesses></Attack_Pattern></Attack_Pattern_Catalog>"
    put(tmp_path / "a.xml", weaknesses)
    put(tmp_path / "b.xml", patterns)
    entries, links = B.read_taxonomy(spark, str(tmp_path))
    assert rows_of(entries, "kind", "entry_id", "deprecated", "reject") == [("capec", "5", False, None), ("cwe", "1", False, None), ("cwe", "2", True, "incomplete")]
    assert rows_of(links, "kind", "entry_id", "target_kind", "target_id", "nature", "view_id") == [("capec", "5", "capec", "6", "canprecede", ""), ("capec", "5", "cwe", "1", "related", ""), ("cwe", "1", "cwe", "2", "childof", "9")]


def plain_jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_pairs_are_all_pairs(spark):
    from evidentia.operators import claims as K

    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)] + ["common"] * 6
    rows = [(i, sorted({rng.choice(words) for _ in range(rng.randrange(0, 9))}), rng.choice(["a", "a", "b", None])) for i in range(160)]
    rows += [(200 + i, ["same", "set"], "a") for i in range(6)] + [(300, ["one"], "b"), (301, ["one"], "b")]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, component string").repartition(4)
    for least in (0.2, 0.5, 0.84, 1.0):
        want = {(a, b): plain_jaccard(set(x), set(y)) for a, x, c in rows for b, y, d in rows if a < b and c is not None and c == d and x and y}
        got = {(r.left_id, r.right_id): r.similarity for r in K.similar_pairs(df, None, least, ["component"]).collect()}
        assert got == {k: v for k, v in want.items() if v >= least}
        left, right = rows[:90], rows[70:]
        make = lambda some: spark.createDataFrame([r[:2] for r in some], "id long, tokens array<string>").repartition(3)
        got = K.similar_pairs(make(left), make(right), least, []).collect()
        want = {(a, b): plain_jaccard(set(x), set(y)) for a, x, _ in left for b, y, _ in right if x and y}
        assert len(got) == len({(r.left_id, r.right_id) for r in got}) and {(r.left_id, r.right_id): r.similarity for r in got} == {k: v for k, v in want.items() if v >= least}


def test_similar_pairs_of_many_chunks_write_no_pairs_that_are_not_alike(spark, monkeypatch):
    from evidentia.operators import claims as K

    rng, seen = random.Random(4), []
    rows = [(i, sorted({"the", "of"} | {f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))}), "a") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, component string")
    monkeypatch.setattr(K, "CHUNK", 300)
    keep = K.saved
    monkeypatch.setattr(K, "saved", lambda d: seen.append((d.columns, d)) or keep(d))
    got = {(r.left_id, r.right_id): r.similarity for r in K.similar_pairs(df, None, 0.5, ["component"]).collect()}
    want = {(a, b): plain_jaccard(set(x), set(y)) for a, x, _ in rows for b, y, _ in rows if a < b}
    assert got == {k: v for k, v in want.items() if v >= 0.5}
    pairs = next(d for c, d in seen if c == ["left_id", "right_id", "similarity"])
    # what is shuffled before pairs are written is sets: no pair is told apart or joined
    assert "FlatMapCoGroupsInArrow" in pairs._jdf.queryExecution().toString()


def test_sets_nobody_asks_about_meet_those_asked_for_only(spark, monkeypatch):
    from evidentia.operators import claims as K

    rng, shuffled = random.Random(5), []
    word = lambda: f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}"
    rows = [(i, " ".join(["the", *[word() for _ in range(rng.randrange(1, 14))]]), "a", i % 10 == 0) for i in range(400)]
    rows += [(500 + i, "same set here", "a", (None, False, True)[i % 3]) for i in range(7)] + [(600 + i, "no such block", None, True) for i in range(3)]
    df = spark.createDataFrame(rows, "claim_id long, failure string, component string, suggestion boolean")
    monkeypatch.setattr(K, "CHUNK", 300)
    plain = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda d, *a: shuffled.append(d.count()) or plain(d, *a))
    got = {(r.left_id, r.right_id): r.similarity for r in K.claim_pairs(df, ["failure"], duplicate=0.35).collect()}
    want = {(a, b): plain_jaccard(set(x.split()), set(y.split())) for a, x, c, m in rows for b, y, d, n in rows if a < b and c and d and (m or n)}
    assert got == {k: v for k, v in want.items() if v >= 0.35} and got
    assert sum(shuffled) < 2000  # each set with each of 11 chunks would be over 4,000


def test_pairs_of_claims_are_judged_without_their_texts(spark, monkeypatch):
    from evidentia.operators import claims as K

    rng, seen = random.Random(8), []
    words = ["alpha", "beta", "gamma", "Valid", "invalid", "open", "CLOSED", "a"]
    text = lambda: rng.choice([None, "", "  ", "not alpha beta", "Not valid.", "alpha beta"] + [" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(6)])
    rows = [(i, "c", i % 3 != 0, " ".join(rng.choices(words, k=3)) + rng.choice(["", "!"]), text(), text()) for i in range(70)]
    df = spark.createDataFrame(rows, "claim_id long, component string, suggestion boolean, failure string, cause string, effect string")
    keep = K.saved
    monkeypatch.setattr(K, "saved", lambda d: seen.append(d.columns) or keep(d))
    fields = ["failure", "cause", "effect"]
    got = sorted(map(tuple, K.claim_pairs(df, fields).collect()))
    assert not [c for c in seen if "left_id" in c and {"left_failure", "left_cause"} & set(c)]
    tokens = lambda t: {w for w in re.sub("[^a-z0-9]+", " ", (t or "").lower()).split(" ") if len(w) > 1}
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = []
    for x in rows:
        for y in rows:
            s = alike(tokens(x[3]), tokens(y[3]))
            if x[0] < y[0] and (x[2] or y[2]) and s >= 0.35:
                want += [(x[0], y[0], "duplicate", "failure", "", s)] if s >= 0.84 else []
                for k, f in enumerate(fields, 3):
                    a, b = x[k], y[k]
                    if a and b:
                        ta, tb = tokens(a), tokens(b)
                        why = next((f"opposed terms: {p}/{q}" for p, q in K.OPPOSITES if (p in ta and q in tb) or (q in ta and p in tb)), "")
                        bare = [tokens(re.sub("^not ", "", plain(t))) for t in (a, b)]
                        if not why and plain(a).startswith("not ") != plain(b).startswith("not ") and alike(*bare) >= 0.7:
                            why = K.NEGATED if hasattr(K, "NEGATED") else "one claim explicitly negates the other"
                        if why:
                            want.append((x[0], y[0], "contradiction", f, why, s))
                        elif f != "failure" and alike(ta, tb) < 0.2:
                            want.append((x[0], y[0], "divergence", f, "", s))
    assert got == sorted(want) and {w[2] for w in want} == {"duplicate", "contradiction", "divergence"} and any("negates" in w[4] for w in want)


def test_near_sets_of_common_and_rare_words(spark):
    import numpy as np
    import pyarrow as pa

    from evidentia.operators import claims as K

    rng = random.Random(6)
    zipf = lambda: int(1 / (rng.random() + 0.0005))
    sets = sorted(({zipf() + (rng.random() < 0.2) * rng.randrange(9000) for _ in range(rng.randrange(1, 90))} for _ in range(900)), key=len)
    sets = sorted(sets + [{t + (rng.random() < 0.3) * 70000 for t in s} for s in sets[::3]], key=len)
    make = lambda some: pa.table({"n": pa.array([len(s) for s in some], pa.int32()), "t": pa.array([sorted(s) for s in some], pa.list_(pa.int64()))})
    few = sets[::5]
    for least in (0.1, 0.35, 0.84):
        got = [np.concatenate(c).tolist() for c in zip(*K._near(make(sets), make(sets), least, True), strict=True)]
        want = {(i, j): plain_jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets))}
        assert len(got[0]) == len(want := {k: v for k, v in want.items() if v >= least}) and dict(zip(zip(got[0], got[1], strict=True), got[2], strict=True)) == want
        got = [np.concatenate(c).tolist() for c in zip(*K._near(make(few), make(sets), least, False), strict=True)]
        want = {(i, j): v for i, s in enumerate(few) for j, t in enumerate(sets) if (v := plain_jaccard(s, t)) >= least}
        assert len(got[0]) == len(want) and dict(zip(zip(got[0], got[1], strict=True), got[2], strict=True)) == want


def test_decision_rules_are_rows(spark):
    from evidentia.operators import joins as J

    rng = random.Random(2)
    values = {"a": ["x", "y", "*", "1:x"], "b": ["p", "q"], "c": ["r", "s", "t"]}
    rules = [(i, f"o{i}", {p: rng.sample(v, rng.randrange(1, len(v))) for p, v in values.items() if rng.random() < 0.6}) for i in range(60)] + [(i, f"late{i}", {"a": [f"v{i}"], "b": ["p"]}) for i in range(60, 4000)]
    obs = [(i, *[rng.choice([*v, None, "other"]) for v in values.values()]) for i in range(200)] + [(500, "v777", "p", "r")]

    def plain(row):
        seen = dict(zip(values, row[1:]))
        fits = [o for _, o, allowed in rules if all(seen[p] in own for p, own in allowed.items())]
        return "undecided" if None in seen.values() or not fits else fits[-1]

    table = spark.createDataFrame(rng.sample(rules, len(rules)), "rule_order int, outcome string, allowed map<string,array<string>>")
    got = J.decision_table(spark.createDataFrame(obs, "id long, a string, b string, c string"), table, list(values)).collect()
    assert {r.id: r.outcome for r in got} == {r[0]: plain(r) for r in obs} and len(got) == len(obs)
    none = J.decision_table(spark.createDataFrame(obs, "id long, a string, b string, c string"), table.limit(0), list(values)).collect()
    assert {r.outcome for r in none} == {"undecided"}


def test_tokens_at_unknown_depths(spark):
    from evidentia.operators import claims as K

    rows = [(1, json.dumps({"id": 7, "x": [[{"y": {"z": [{"file_sha256": "ab", "run_ids": ["p", 2, None, ""], "user_id": True}]}}]], "note": "n"})), (2, "not json"), (3, None), (4, json.dumps(["a", {"id": {"id": "q"}}])), (5, json.dumps("id"))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k int, body string, level int")
    got = {r.k: r.tokens for r in K.identity_tokens_of(df, "body").collect()}
    assert got == {1: ["file_sha256=ab", "id=2", "id=7", "id=p", "run_ids=2", "run_ids=p", "sha256=ab"], 2: [], 3: [], 4: ["id=q"], 5: []}
    assert K.identity_tokens_of(df, "body").columns == ["k", "body", "level", "tokens"]


def test_late_rows_and_two_sinks_over_two_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    from evidentia.streaming import jobs as S

    day = 86_400_000_000
    shape = "event_id long, ts timestamp, ended_at timestamp"

    def write(rows):
        df = spark.createDataFrame(rows, "event_id long, a long, b long").select("event_id", F.timestamp_micros("a").alias("ts"), F.timestamp_micros("b").alias("ended_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return S.two_sinks(stream, str(tmp_path / "yes"), str(tmp_path / "no"), str(tmp_path / "progress"))

    for first in (1, 10, 20):
        write([(first + i, first * day + i * 1000, first * day + i * 1000 + (2 * day if i % 3 == 0 else 0)) for i in range(9)])
    told = run()
    assert told == {"input": 27, "late": 0}
    write([(100 + i, 5 * day, 5 * day) for i in range(4)] + [(200, 21 * day, 21 * day)])
    told = run()
    assert told == {"input": 5, "late": 4}
    yes, no = spark.read.parquet(str(tmp_path / "yes")), spark.read.parquet(str(tmp_path / "no"))
    assert (yes.count(), no.count()) == (19, 9) and yes.select("event_id").distinct().count() == 19


def test_edges_go_on_after_a_restart(spark, tmp_path):
    from evidentia.streaming import jobs as S

    shape = "source string, target string, channel string"
    run = lambda: {(r.target, r.seen) for r in S.rolling_edges(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "base"), str(tmp_path / "progress")).collect()}
    write = lambda rows: spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([("a", "b", "x")])
    assert run() == {("b", 1)}
    write([("a", "b", "y"), ("a", "c", "x")])
    assert run() == {("b", 2), ("c", 1)}
    (tmp_path / "base" / "9").mkdir()  # a version that was begun and not finished
    assert run() == {("b", 2), ("c", 1)}


def test_bounds_of_strata_and_of_none(spark):
    from evidentia.operators import workflow as W

    rows = [(f"c{i}", i % 4, 4, s) for i in range(30) for s in ("a", "b", None)]
    metrics = spark.createDataFrame(rows, "cluster string, k long, n long, stratum string")
    by = {r.stratum: tuple(r)[1:] for r in W.metric_bounds(metrics, 40, 3, 0.1, "stratum").collect()}
    alone = {tuple(r)[1:] for r in W.metric_bounds(metrics.where("stratum = 'a'"), 40, 3, 0.1).collect()}
    assert set(by) == {"a", "b", None} and set(by.values()) == alone
    assert W.metric_bounds(metrics.limit(0), 40, 3, 0.1, "stratum").count() == 0 and W.metric_bounds(metrics.limit(0), 40, 3, 0.1).count() == 0


def test_only_like_cohorts_are_compared(spark):
    from evidentia.operators import joins as J

    d, e = "a" * 64, "b" * 64
    cohorts = spark.createDataFrame([("p", d, e), ("q", d, e), ("zero", "0" * 64, e), ("none", None, e), ("other", d, d), ("empty", d, e), ("more", d, e), ("twice", d, e), ("blank", d, e)], "cohort string, dataset_sha256 string, oracle_sha256 string")
    cases = [(c, i) for c in ("p", "q", "zero", "none", "other", "more", "twice", "blank") for i in ("1", "2")] + [("more", "3"), ("twice", "1"), ("blank", " "), ("blank", None)]
    pairs = [("p", c) for c in ("q", "zero", "none", "other", "empty", "more", "twice", "blank", "unheard")] + [("empty", "empty")]
    got = {(r.base, r.current): (r.comparable, r.reason) for r in J.like_for_like(cohorts, spark.createDataFrame(cases, "cohort string, id string"), spark.createDataFrame(pairs, "base string, current string")).collect()}
    why = ["", "unknown digest", "unknown digest", "other digest", "no shared case", "other cases", "repeated case", "no identifier", "unknown digest", "no shared case"]
    assert got == {p: (w == "", w) for p, w in zip(pairs, why)}


def test_rates_without_numbers(spark):
    from evidentia.operators import stats as S

    shape = "case_id long, attempt long, resolved boolean, flaky boolean, unsafe boolean, latency double, tokens long, cost double"
    row = S.attempt_rates(spark.createDataFrame([(1, 1, None, True, None, None, 4, 1.0), (1, 2, True, False, None, None, None, 3.0), (2, 5, False, None, None, None, 8, None)], shape)).first()
    assert (row.cases, row.attempts, row.resolved_rate, row.flaky_attempt_rate, row.unsafe_rate, row.mean_latency, row.mean_tokens, row.mean_cost) == (2, 3, 0.0, 0.5, None, None, 6.0, 2.0)
    assert S.attempt_rates(spark.createDataFrame([], shape)).first().resolved_rate is None
    up = T.availability(spark.createDataFrame([("t", "n", *[0.0] * 6), ("t", "m", 1.0, 0.5, 2.0, 3.0, 2.0, 6.0)], "tree string, node string, failure double, failure_low double, failure_high double, repair double, repair_low double, repair_high double"))
    assert {r.node: (r.value, r.low, r.high) for r in up.collect()} == {"n": (None, None, None), "m": (0.75, 0.5, 6 / 6.5)}
