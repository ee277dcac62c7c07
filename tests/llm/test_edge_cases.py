"""Odd input to the training-text operators, each against a plain version."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import fingerprints, language, lengths, mixing, packing, preferences, simhash, topk, toxicity
from tests.llm.test_llm_operators import DE, EN, SCHEMA, make

ODD = "doc_id long, text string, lang string, source string, toxic int, labelled long, __size int, row string, copies long, id long"


def odd_rows():
    return [(i, t, g, s, 1, 2, 3, "r", 4, 5) for i, t, g, s, *_ in make()] + [(None, "no identifier here", "en", None, 0, 0, 0, None, None, None)] * 3


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


def plain_top(rows, k=10):
    out = []
    whole = lambda v: [math.floor(1024 * x) if abs(x) < 2**43 else int(x) * 1024 for x in v]
    fine = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = defaultdict(list)
    for q, a in fine:
        if q % 100 == 0:
            best[q] += [(-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63)), i) for i, b in fine if i != q and len(a) == len(b)]
    for q, found in best.items():
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_top_k_of_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.1, 2.0]) for _ in range(3)]) for i in range(150)]
    rows += [(200, [5e12, 0.0, 1.0]), (201, [1e300, -1e300, 3.0]), (300, [1.0, 2.0]), (301, [3.0, 4.0]), (400, []), (402, []), (401, []), (None, [1.0, 1.0, 1.0]),
             (500, [float("inf"), 0.0, 0.0]), (501, [None, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (7, [0.3, 0.3, 0.3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, lists in ((65_536, 2048), (40, 16)):
        assert sorted(tuple(r) for r in topk.top_k(table, block=block, lists=lists).collect()) == plain_top(rows)


def plain_rates(sizes, target, most=2.0):
    mean = sum(sizes) / len(sizes)
    lo, hi = -1e6, 1e6
    if target >= most * sum(sizes):
        return [most if s else 0.0 for s in sizes]
    for _ in range(300):
        mid = (lo + hi) / 2
        total = sum(s * min(most, math.exp(min(mid * s / mean, 50))) for s in sizes if s)
        lo, hi = (mid, hi) if total < target else (lo, mid)
    return [min(most, math.exp(min(lo * s / mean, 50))) if s else 0.0 for s in sizes]


def test_mix_rates_are_the_plain_ones(odd):
    rows = mixing.mix(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
    for (target, size), mine in by.items():
        assert sum(r["size"] for r in mine) == size
        plain = plain_rates([r["size"] for r in mine], target)
        assert all(abs(r.rate - p) < 1e-3 for r, p in zip(mine, plain))
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())


def test_mix_of_one_long_and_many_short_documents(spark):
    rows = [(0, "w " * 50_000, "a")] + [(i, "one two three four five", "a") for i in range(1, 3001)] + [(i, "x y z", "b") for i in range(4000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = {r.target: r.taken for r in mixing.mix(docs.repartition(4)).groupBy("target").agg(F.sum("taken").alias("taken")).collect()}
    # at best the long one is taken once and every short one twice, or the long one twice alone
    assert sums == {90_000.0: 80_000, 30_000.0: 30_000} or sums == {90_000.0: 100_000, 30_000.0: 30_000}
    short = spark.createDataFrame([r for r in rows if r[2] == "a"] + [(5000 + i, "x y z w v", "b") for i in range(5894)], "doc_id long, text string, source string")
    target = {r.source_size: (r.target, r.taken) for r in mixing.mix(short).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    best = min((abs(a * 50_000 + 5 * b - target[65_000][0]) for a in range(3) for b in range(0, 6001)))
    assert abs(target[65_000][1] - target[65_000][0]) <= max(best, 0.1 * target[65_000][0])


def test_mix_moves_fit_the_gap():
    import pandas as pd

    cells = pd.DataFrame({"source": "a", "size": [50_000, 5, 3], "count": [1, 3000, 10], "gap": -17_950.0})
    got = dict(mixing.moves_by_size(cells)[["size", "n"]].itertuples(index=False))
    assert got == {5: 3000, 3: 10}
    got = dict(mixing.moves_by_size(cells.assign(gap=23.0))[["size", "n"]].itertuples(index=False))
    assert got == {5: 4, 3: 1}


def test_apply_mix_keeps_columns_and_rows(odd, spark):
    again = mixing.apply_mix(odd)
    assert again.columns == odd.columns
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in again.collect()) == +want
    copies = spark.createDataFrame([(7, "a b c d", "s")] * 5000 + [(i, "e f", "t") for i in range(100)], "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(copies).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 4 for r in got)


def test_toxicity_with_clashing_columns_nulls_and_opposite_labels(odd, spark):
    labels = spark.createDataFrame([(r[0], int(i % 3 == 0)) for i, r in enumerate(odd_rows()) if r[0] is not None] + [(None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    same = spark.createDataFrame([(1, "so so"), (2, "so, so!"), (3, "other words"), (4, "more words")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    scores = {toxicity.fit(same.repartition(n), marks, F.lit(True)).score("so so") for n in (1, 3)}
    assert len(scores) == 1


def test_toxicity_score_is_the_plain_sum():
    rng = random.Random(3)
    grams = sorted({int.from_bytes("".join(rng.choices("abcde ", k=5)).encode(), "big") for _ in range(400)})
    model = toxicity.ToxicityModel(np.array(grams, np.int64), np.array([rng.uniform(-1, 1) for _ in grams]), -0.3)
    for n in (0, 3, 40, 70_000):
        text = "".join(rng.choices("abcdeÉ .", k=n))
        spaced = b" " + b" ".join(toxicity.words_of(text)) + b" "
        runs = {int.from_bytes(spaced[i : i + 5], "big") for i in range(len(spaced) - 4)}
        z = model.bias + sum(w for g, w in zip(grams, model.weights) if g in runs)
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_identity_terms_are_swapped_by_sentence_in_four_languages():
    terms = toxicity.following(toxicity.IDENTITY)
    pairs = toxicity.swapped("He is muslim. Nothing here!\nLa mujer corre. Eine Frau. Une femme, un homme?", terms)
    assert [b for _, b in pairs] == [b"eine mann", b"he is christian", b"la hombre corre", b"une homme un femme"]
    assert toxicity.swapped(None, terms) == [] == toxicity.swapped("plain words only", terms)


def test_language_decoding_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    for count in (1, 2, 5, 9):
        classes = np.repeat(np.arange(count), 12)
        matrix = rng.random((len(classes), 40)).astype(np.float32) + np.eye(40, dtype=np.float32)[classes] * 3
        model = language.LanguageModel([f"l{i}" for i in range(count)], matrix, classes)
        best, score, gap = model.decode(matrix)
        for x, b, s, g in zip(matrix, best, score, gap):
            f = np.clip(x @ model.w[:-1] + model.w[-1], -2, 2)
            losses = [sum(model.weight[i][j] * math.exp(-model.code[i][j] * f[j]) for j in range(len(f))) for i in range(count)]
            order = sorted(range(count), key=lambda i: losses[i])
            assert abs(losses[b] - losses[order[0]]) < 1e-6 and abs(s - 1 / sum(math.exp(-4 * (v - losses[b])) for v in losses)) < 1e-5
            assert count == 1 or abs(g - (losses[order[1]] - losses[order[0]])) < 1e-5


def test_language_sample_is_bounded_and_holds_every_language(spark, monkeypatch):
    rows = [(7, f"hot row text {'abc' * (i % 5)}", "aa") for i in range(3000)] + [(i, "word " * 5 + chr(97 + i % 26) * 9, f"l{i % 40}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(language, "LanguageModel", lambda names, matrix, classes: seen.update(names=names, counts=Counter(classes.tolist())))
    language.fit(docs, F.lit(True), sample=410)
    assert len(seen["names"]) == 41 and max(seen["counts"].values()) <= 20 and min(seen["counts"].values()) >= 15


def test_edited_fingerprints_and_likenesses(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(EN + DE, k=2))
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(30)] + [None, "", "\U0001F600" * 50, "é" * 300]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for (i, text), (_, after) in zip(rows[::-1], rows[::-1][1:] + rows[-1:]):
        text, after = text or "", after or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        sets = [set(fingerprints.winnow(t)[0].tolist()) for t in (text, changed, after)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert got[i].edited_fingerprint == fingerprints.to_text(*fingerprints.winnow(changed))
        assert abs(got[i].near_edited - like[0]) < 1e-12 and abs(got[i].near_next - like[1]) < 1e-12


def plain_exchange(rows):
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, role or "", text or ""))
    whole = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    ids = sorted(whole)
    out = {}
    for c, after in zip(ids, ids[1:] + ids[:1]):
        a, keep = whole[c], c % len(whole[c])
        b = a[:keep] + whole[after][keep:]
        first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        shown = lambda part: "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in part)
        out[c] = (first, shown(a[:first]), shown(a[first:]), shown(b[first:]))
    return out


def test_exchanged_tails_are_the_plain_ones(spark):
    rng = random.Random(1)
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 3]), rng.choice([None, "user", "assistant"]), rng.choice(["hi", "", None, "ho"])) for c in [None, *range(0, 60, 2)] for _ in range(rng.randint(1, 5))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for r in preferences.format_arrays(preferences.exchange_tails(frame)).collect()}
    assert got == plain_exchange(rows)
    assert preferences.format_arrays(preferences.exchange_tails(frame.limit(0))).count() == 0


def test_packing_fills_and_tells_copies_apart(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices(EN, k=2)) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 40 + [(None, None)] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len({(r.row_id, r.start) for r in got}) == len(got) and len({r.row_id for r in got}) == len(rows)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    total = sum(used.values())
    assert max(used.values()) <= 2048 and total / (2048 * len(used)) > 0.97
    plain = []
    for r in sorted(got, key=lambda r: (r.row_id, r.start)):
        fits = next((i for i, left in enumerate(plain) if left >= r.length), None)
        plain.append(2048 - r.length) if fits is None else plain.__setitem__(fits, plain[fits] - r.length)
    assert len(used) <= len(plain)


def test_truncated_totals(spark):
    hist = spark.createDataFrame([(3, 2), (10, 1), (0, 5)], "length long, docs long")
    assert [(r.context_limit, r.tokens) for r in lengths.truncated_totals(hist, [0, 4, 100]).collect()] == [(0, 0), (4, 10), (100, 16)]
    assert [r.tokens for r in lengths.truncated_totals(hist.limit(0), [5, 9]).collect()] == [0, 0]


def test_simhash_with_null_identifiers(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (None, "something else entirely")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(rows).collect()) == [(0, 0), (0, 5), (0, 5), (5, 5)]


def test_stages_keep_columns_and_take_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(r[0], 1) for r in odd_rows() if r[0]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, str(tmp_path))
            assert name == "pack" or got.columns == docs.columns
            assert got.count() > 0 if docs is odd else got.count() == 0


def test_whole_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choices(EN if rng.random() < 2 else DE, k=rng.randint(1, 3))) for _ in range(120)).capitalize() + "."
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(300, "!!! 123", "en", "s1", 0), (301, None, None, "s1", 0), (302, "%%% $$$ ### @@@ " * 30 + "q", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 120, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {300, 301, 302, *range(200, 210)} and len(ids) > 60
    by = defaultdict(list)
    for r in got:
        by[r.row_id].append(r)
    assert all(sum(r.length for r in v) == v[0].doc_tokens for v in by.values())
    assert max(Counter(v[0].doc_id for v in by.values()).values()) <= 2
