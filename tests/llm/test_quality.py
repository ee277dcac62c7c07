"""The quality model against a plain modified Kneser-Ney model, and its thresholds against plain quantiles."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import kneser_ney
from tests.llm.test_llm_operators import make  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int, perplexity string, row string"


def plain_model(texts):
    """p(gram of 4 symbols) of texts, by dictionaries."""
    def cells(t):
        s = "\0\0\0" + "".join("0" if c in "0123456789" else c for c in t)
        return [s[i : i + 4] for i in range(len(s) - 3)]

    counts = [Counter(g for t in texts for g in cells(t))]
    for _ in range(3):
        counts.insert(0, Counter(g[1:] for g in counts[0]))

    def order(c):
        y = [sum(v == i for v in c.values()) for i in range(1, 5)]
        base = y[0] / (y[0] + 2 * y[1]) if y[0] + y[1] else 0.5
        d = [min(max(i - (i + 1) * base * y[i] / y[i - 1] if y[i - 1] else 0.5 * i, 0.05), i - 0.05) for i in range(1, 4)]
        total, left = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        return d, total, left

    made = [order(c) for c in counts]

    def p(g):
        low = 1 / 65536
        for n in range(1, 5):
            own, (d, total, left) = g[4 - n :], made[n - 1]
            if total[own[:-1]]:
                c = counts[n - 1][own]
                low = ((c - d[min(c, 3) - 1] if c else 0) + left[own[:-1]] * low) / total[own[:-1]]
        return low

    return lambda t: (sum(math.log(p(g)) for g in cells(t)), len(t))


def folds_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()
    return {r.text: r.f for r in rows}


@pytest.mark.parametrize("chunk", [1 << 24, 500])
def test_perplexity_is_the_plain_one(spark, chunk):
    rows = [r for r in make()] + [(910, "Привет, мир. Это проза.", "ru", "s1", 0, 1, 2, "x", "y"), (None, "no id 123", None, None, 0, 1, 2, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    good = {r[0] for i, r in enumerate(rows) if i % 5 and r[0]}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(3, 0), (None, 1)], "doc_id long, quality int")
    folds = folds_of(spark, {r[1] for r in rows})
    models = [plain_model([r[1] for r in rows if r[0] in good and r[1] and folds[r[1]] == f]) for f in (0, 1)]
    got = {(r.doc_id, r.lang, r.perplexity and round(r.perplexity, 3)) for r in kneser_ney.assess(docs, labels, chunk=chunk).collect()}
    for r in rows:
        if not r[1]:
            assert (r[0], r[2], None) in got
            continue
        sums = [m(r[1]) for m in models]
        use = [sums[1 - folds[r[1]]]] if r[0] in good else sums
        plain = math.exp(-sum(s for s, _ in use) / len(use) / len(r[1]))
        assert any(i == r[0] and x and abs(x - plain) <= 1e-3 * plain for i, _, x in got), (r, plain, r[0] in good, [x for x in got if x[0] == r[0]])


def test_probabilities_sum_to_one(spark):
    texts = ["abab ab", "aab bba", "ab", "bbbb a"]
    counts = Counter(int(g) for t in texts for part in kneser_ney._strides(t) for g in part)
    tables = kneser_ney.orders(spark.createDataFrame([(g, n, n) for g, n in counts.items()], "gram long, n0 long, n1 long"))
    context = next(g for g in counts) >> 16 << 16
    wanted = spark.range(65536).select((F.col("id") + F.lit(context)).alias("gram"))
    got = kneser_ney.probabilities(wanted, tables).agg(F.sum("p0").alias("a"), F.sum("p1").alias("b"), F.count("*").alias("n")).first()
    assert got.n == 65536 and abs(got.a - 1) < 1e-9 and abs(got.b - 1) < 1e-9


def test_rejects_what_good_text_is_not(spark):
    rng = random.Random(7)
    word = lambda parts: "".join(rng.choices(parts, k=3))
    latin, cyrillic = "the of and tion ing er on at".split(), "при вет про ска зать мир оно да".split()
    rows, marks = [], []
    for i in range(400):
        parts = (latin, cyrillic)[i % 2]
        rows.append((i, " ".join(word(parts) for _ in range(80)), "ab"[i % 2]))
        if i % 4 < 2:
            marks.append((i, 1))
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    rows.append((1000, " ".join("".join(rng.choices(letters, k=9)) for _ in range(80)), "b"))
    rows.append((1001, "## %% $$ the ## && **", "a"))
    got = {r.doc_id: r.keep for r in kneser_ney.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    assert not got[1000] and not got[1001] and sum(got[i] for i in range(400)) >= 392


def test_odd_tables(spark):
    docs = spark.createDataFrame([(*r[:4], "c", 1.5, "q", "t", "o") for r in make()], "doc_id long, text string, lang string, source string, chunk string, row double, id string, fold string, own string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 1), (3, 1), (6, 1)], "doc_id long, quality int")
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.row for r in kept.collect()} == {1.5}
    assert kneser_ney.keep_good(docs, labels.limit(0)).count() == sum(bool(r[1]) for r in make())
    one = kneser_ney.assess(docs, labels.where("doc_id = 3"))
    assert one.count() == len(make()) and one.where("perplexity is not null").count() == sum(bool(r[1]) for r in make())
    assert kneser_ney.assess(docs.limit(0), labels).count() == 0 and kneser_ney.keep_good(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(1, "\U0001F600 astral", "x"), (2, "é" * (kneser_ney._STRIDE + 5), "x"), (3, "plain text", "x")], "doc_id long, text string, lang string")
    rows = kneser_ney.assess(odd, labels.where("doc_id = 3")).collect()
    assert all(np.isfinite(r.perplexity) for r in rows)


def test_thresholds_are_the_counted_quantile(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2] if i % 7 else None, float(x), True) for i, x in enumerate(rng.lognormal(2, 0.5, 3000))] + [("c", 2.0, True), ("a", 1e9, False)]
    scored = spark.createDataFrame(rows, "lang string, perplexity double, trusted boolean")
    found, overall = kneser_ney.thresholds(scored, 0.9)
    by_lang = {r.lang: r.q for r in found.collect()}

    def plain(lang):
        xs = sorted(p for g, p, t in rows if t and (lang is None or g == lang))
        return xs[int(np.ceil(len(xs) * 0.9)) - 1]

    assert set(by_lang) == {"a", "b"} and all(plain(g) <= q < plain(g) * 1.0002 for g, q in by_lang.items())
    assert plain(None) <= overall < plain(None) * 1.0002
    again, same = kneser_ney.thresholds(scored.repartition(7), 0.9)
    assert {r.lang: r.q for r in again.collect()} == by_lang and same == overall
