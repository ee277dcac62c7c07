"""The training-text operators against plain versions, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from evidentia.llm import fingerprints, language, lengths, mixing, packing, preferences, simhash, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int, perplexity string, row string"
EN, DE = "the of and tion ing er on at".split(), "der die und ung ein sch keit zu".split()


def make(seed=0, count=60):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        words = EN if i % 3 else DE
        text = " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 120)))
        rows.append((i * 3, text, "en" if i % 3 else "de", f"s{i % 4}" if i % 7 else None))
    rows += [(901, None, "en", "s1"), (902, "", None, "s1"), (903, "12 34 !!", "en", None), (904, rows[5][1], "en", "s0"), (15, rows[5][1], "en", "s0"),
             (905, " ".join(rows[8][1].split() * 200), "en", "s2"), (906, "short", "en", "s3")]
    return [(*r, 0, 1, 2, "x", "y") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], int(i % 5 > 0), int(i % 6 == 0)) for i, r in enumerate(make()) if r[0] < 900], "doc_id long, quality int, toxic int").distinct()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_winnow(text, k, w):
    points = fingerprints.code_points(text)
    if not len(points):
        return []
    k = min(k, len(points))
    hashes = [int(fingerprints._rolling(points[i : i + k], k)[0]) for i in range(len(points) - k + 1)]
    w = min(w, len(hashes))
    return sorted({min(((h, -i) for i, h in enumerate(hashes[a : a + w], a)))[::-1] for a in range(len(hashes) - w + 1)}, key=lambda x: -x[0])


def test_winnow_is_the_plain_one():
    rng = random.Random(3)
    for n in (0, 1, 5, 40, 300):
        text = "".join(rng.choice("abé ") for _ in range(n)) + "aaaa" * (n // 50)
        got = list(zip(*(x.tolist() for x in fingerprints.winnow(text, 6, 5)), strict=True))
        assert got == [(h, -i) for i, h in plain_winnow(text, 6, 5)]


def test_fingerprint_edits(docs, empty):
    rows = sorted(((r[0], r[1] or "") for r in make()), key=lambda x: (-x[0], x[1]))
    got = {(r.doc_id, r.edited_sha256): r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(got) >= len(rows) - 1
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i, hashlib.sha256(changed.encode()).hexdigest()]
        assert r.n_chars == len(text) and r.fingerprint == fingerprints.to_text(*fingerprints.winnow(text)) and 0 <= r.near_next <= 1
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_mix_comes_near_its_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(make())
    size = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by.setdefault((r.target, r.source_size), []).append(r.taken)
    assert abs(sum(t for t, _ in by) - 1.5 * size) < 1e-6 * size
    for (target, own), taken in by.items():
        assert target <= 2 * own + 1e-9 and abs(sum(taken) - target) <= max(30, 0.05 * target)
    key = lambda rs: sorted((r.doc_id, r["size"], r.taken) for r in rs)
    assert key(rows) == key(mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0
    again = mixing.apply_mix(docs)
    assert again.columns == docs.columns and again.count() == sum(r.taken // r["size"] for r in rows if r["size"])


def test_toxicity_learns_inflected_words_and_ignores_groups(spark, empty):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        words = ["".join(rng.choices(EN, k=2)) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = "grumpf" + rng.choice(["", "er", "ly"])
        if rng.random() < (0.5 if bad else 0.1):
            words[rng.randrange(30)] = "muslim"
        rows.append((i, " ".join(words), int(bad)))
    rows.append((600, None, 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, marks).collect()
    held = [(r.predicted, rows[r.doc_id][2]) for r in got if r.held_out]
    assert held and sum(a == b for a, b in held) >= 0.97 * len(held)
    from pyspark.sql import functions as F

    shift = []
    for penalty in (0.0, 30.0):
        m = toxicity.fit(docs, marks, F.lit(True), penalty=penalty)
        assert m.pairs == sum("muslim" in t for _, t, _ in rows if t)
        shift.append(abs(m.score("the muslim of") - m.score("the christian of")))
    assert shift[1] < shift[0] / 2
    assert toxicity.classify(empty, marks).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(350, 6)).round(1)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(table, block=64, query_block=2, lists=32).collect()}
    x = np.floor(1024 * v).astype(int)
    for q in (0, 100, 200, 300):
        best = sorted(((-int(x[q] @ x[i]), i) for i in range(350) if i != q))[:10]
        assert [got[q, n + 1] for n in range(10)] == [(i, -s) for s, i in best]
    assert len(got) == 40 and topk.top_k(table.limit(0)).count() == 0



def test_language(docs, empty):
    rows = language.identify(docs).collect()
    truth = {r[0]: r[2] for r in make()}
    assert {r.lang_pred for r in rows if r.doc_id in (901, 902, 903)} == {"und"}
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and r.doc_id < 900]
    assert held and np.mean(held) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    assert language.identify(empty).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 9):
        code = language.codewords(n)
        assert min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)) >= (1 if n == 2 else 3)


def test_lengths(docs, empty):
    encoder = tokens.WordEncoder(tokens.default_path(), most_words=50)
    own = [len(encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in make()]
    for r in lengths.suffix_sums(lengths.histogram(docs), span=16).collect():
        n = r.context_limit
        assert (r.docs, r.docs_at_least) == (own.count(n), sum(x >= n for x in own)) and r.truncated_total == sum(min(x, n) for x in own)
    assert lengths.suffix_sums(lengths.histogram(empty)).count() == 0
    for text in ("it's <|endoftext|> x\xb2 İ ΣΑΣ 中文 a_b \x1c ...", "don't 123", ""):
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_preferences(spark):
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, None, None), (3, 0, "user", "x")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "no"), (1, 2, "user", "?"), (2, 0, None, None), (4, 0, "user", "z")]
    frames = [spark.createDataFrame(x, "pair_id long, turn long, role string, text string") for x in (a, b)]
    rows = {r.pair_id: r for r in preferences.format_pairs(*frames).collect()}
    assert rows[1].prompt == "<|user|>\nq\n<|end|>\n" and rows[1].n_prompt_turns == 1
    begin, end = map(int, rows[1].rejected_mask.split("-"))
    assert rows[1].rejected[begin:end] == "no\n<|end|>\n" and rows[1].chosen_mask.startswith("14-")
    assert (rows[2].chosen, rows[2].rejected, rows[3].prompt, rows[4].chosen) == ("", "", "", "")


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    import xxhash

    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_components(docs, hot):
    rows = simhash.near_duplicates(docs, hot=hot).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for i, text, *_ in make():
        assert i == 15 or prints[i] == plain_simhash(text)
    label = {i: i for i in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in rows if r.doc_id != 15} == {i: c for i, c in label.items() if i != 15}


def test_hot_keys_link_like_pairs(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    groups = []
    for hot in (1000, 4):
        found = simhash.components(frame, simhash.links(frame, hot)).collect()
        groups.append({(r.node, r.label) for r in found})
    assert groups[0] == groups[1] and groups[0]


def test_keep_first(docs, empty):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and 904 not in {r.doc_id for r in kept.collect()}
    assert simhash.keep_first(empty).count() == 0


def test_packing_keeps_every_id_once(docs, empty):
    rows = packing.pack(docs.where("doc_id <> 15"), group_pieces=20).collect()
    encoder = tokens.WordEncoder(tokens.default_path())
    for i, text in ((r[0], r[1]) for r in make() if r[0] != 15):
        ids = np.append(encoder.encode(text), 1).astype("<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [a for a, _, _ in mine] == np.cumsum([0] + [n for _, n, _ in mine[:-1]]).tolist() and sum(n for _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in mine)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_karmarkar_karp_uses_each_once_and_balances():
    rng = random.Random(2)
    for ways in (1, 2, 7):
        sizes = [rng.randint(1, 500) for _ in range(90)]
        windows = packing.karmarkar_karp(sizes, ways)
        assert sorted(i for w in windows for i in w) == list(range(90))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert len(sums) == ways and max(sums) - min(sums) <= 20



def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    fresh, encoder = Tokenizer.from_file(tokens.default_path()), tokens.WordEncoder(tokens.default_path())
    texts = ["end of page <|endoftext|> next", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "<|endoftext|><|endoftext|>\n", "中 <|endoftext|>", "plain"]
    own = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.encode(t).tolist() for t in texts] == own and 49407 in own[0]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) for i, ids in enumerate(own)}


def test_keep_first_keeps_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(11)
    one, two, three = (" ".join("".join(rng.choices(EN, k=3)) for _ in range(80)) for _ in range(3))
    rows = [(None, one, "a"), (None, one, "b"), (3, two, "c"), (5, two, "d"), (5, three, "e"), (None, three, "f")]
    for parts in (1, 4):
        kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(parts))
        assert kept.columns == ["doc_id", "text", "row"]
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, one), (3, two), (5, three)])


def shingles_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("rounds", [4, 0])
def test_near_copies_are_those_of_all_pairs(spark, rounds):
    from evidentia.llm import shingles

    rng = random.Random(4)
    word = lambda: "".join(rng.choices(EN, k=3))
    texts = ["", None, " \t", "Two words", "two  words"]
    for size, changes in ((200, 1), (200, 3), (500, 10), (500, 25), (2000, 20), (60, 2)):
        for _ in range(4):
            words = [word() for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(3):
                copy = list(words)
                for at in rng.sample(range(size), changes):
                    copy[at] = word()
                texts.append(" ".join(copy))
    sets = [shingles_of(t or "") for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    least = {x: min(i for i, y in enumerate(label) if y == x) for x in label}
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(3)
    assert {r.n: r.component_id for r in shingles.near_copies(frame, "n", rounds=rounds).collect()} == {i: least[x] for i, x in enumerate(label)}
    assert len(least) < 0.7 * len(texts)


def test_the_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["".join(rng.choices(EN, k=3)) for _ in range(500)]
    rows = [(0, " ".join(words))] + [(n, " ".join(w if i % 50 != n else "changed" for i, w in enumerate(words))) for n in range(1, 6)] + [(9, " ".join(words[::-1]))]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()} == {0, 9}


def test_the_stage_links_by_fingerprints_and_by_runs_of_words(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(3)
    words = ["".join(rng.choices(EN, k=3)) for _ in range(500)]
    near = [w if i % 50 != 7 else "changed" for i, w in enumerate(words)]
    # 4 and 8 have equal fingerprints (letters' case counts for neither), 8 and 6 are alike by runs of words, 5 stands alone
    rows = [(8, " ".join(words)), (4, " ".join(words).upper()), (6, " ".join(near)), (5, " ".join(words[::-1]))]
    asked = []
    whole = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: asked.append(1) or whole(*a, **k))
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {4, 5} and asked
    a = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)], "i long, component_id long")
    b = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 3), (4, 4)], "i long, component_id long")
    assert {(r.i, r.component_id) for r in simhash.united(a, b, "i").collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)}
