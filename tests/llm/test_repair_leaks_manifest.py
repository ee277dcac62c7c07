"""Conversation repair, benchmark decontamination and the dataset manifest, each against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontamination, merkle, repair

CONVERSATION = "conv_id long, turn long, role string, text string, __v int, part string, times int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair: every audit is written out, and the least is taken.


def plain_rows(rows):
    """By conversation the rows after damage, in order."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        own += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return by


def plain_faults(own):
    out, seen = [], set()
    for _, role, text in own:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(own, faults):
    """All edits with at most two insertions in a place, without a bound or table."""
    best = None

    def go(i, cost, audit, lines, initials, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(own) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(lines))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", lines + [role + ":"], initials + role[0], inserted + 1)
        if i < len(own):
            _, role, text = own[i]
            go(i + 1, cost + 2, audit + "D", lines, initials, 0)
            if faults[i] in ("", "truncated"):
                extra = 5 if faults[i] else 0
                go(i + 1, cost + extra, audit + "K", lines + [f"{role}:{text}"], initials + role[:1], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, audit + "R", lines + [f"{new}:{text}"], initials + new[0], 0)

    go(0, 0, "", [], "", 0)
    return best


def plain_report(rows):
    out = set()
    for conv, own in plain_rows(rows).items():
        faults = plain_faults(own)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = plain_repair(own, faults)
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text)))
    return out


def some_conversations(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "unknown", "", None, "ärger"])
            text = rng.choice(["Good.", "Why?", "cut off", "", " \t", "So.\n ", None, "Né!", "a.b", "Good."])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text, 1, "x", 7))
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("slice_rows", [512, 2])
def test_repair_is_the_plain_one(spark, monkeypatch, slice_rows):
    rows = some_conversations(slice_rows, 60, 5)
    table = spark.createDataFrame(rows, CONVERSATION).repartition(4)
    if slice_rows == 2:  # the workers read the module anew, so the slices are cut by an argument of the closure
        monkeypatch.setattr(repair, "SLICE", 2)
    assert {tuple(r) for r in repair.repair(table).collect()} == plain_report(rows)


def test_repair_in_slices_is_the_whole_one():
    """A conversation cut anywhere gives the same counts, edits and hash, whatever the length of the slices."""
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(40):
        rows = [{"conv": 7, "no_conv": False, "turn": i // 2, "role": (r := rng.choice(["system", "user", "assistant"])), "text": f"t{i}.", "times": rng.choice([1, 1, 3]),
                 "fault": rng.choice(["", "", "truncated", "blank", "duplicate"]), "initial": r[0], "part": 3} for i in range(rng.randrange(1, 12))]
        whole = repair._fragment(rows, 0, 0, True)
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(4))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        found = pa.RecordBatch.from_pylist([repair._fragment(p, 3, i, False) for i, p in enumerate(parts)], schema=repair._FRAGMENT)
        pieces = [r for b in repair._joined(iter([found])) for r in b.to_pylist()]
        for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit"):
            assert pieces[0][k] == whole[k], k
        assert pieces[0]["gaps"] == whole["gaps_high"] - whole["gaps_low"] + 1 - whole["turns"]
        joined = pa.RecordBatch.from_pylist([{"conv": 7, "no_conv": False, "rows": p, "piece": x["piece"], "enter": x["enter"]} for p, x in zip(parts, pieces)])
        assert next(repair._hashed(iter([joined]))).to_pylist()[0]["repaired_sha256"] == whole["repaired_sha256"]


def test_repair_of_a_long_conversation_and_of_none(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"turn {i}.", 1, "x", 7) for i in range(6000)] + [(6, 0, "user", "x", 1, "x", 7)]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, CONVERSATION).repartition(5)).collect()}
    own = plain_rows(rows)[5]
    faults = plain_faults(own)
    assert got[5].audit.count("D") >= faults.count("blank") + faults.count("duplicate") and len(got[5].audit.replace("I", "")) == len(own)
    flat = [{"role": r, "text": t, "times": 1, "fault": f, "initial": r[:1]} for (_, r, t), f in zip(own, faults)]
    assert (got[5].cost, got[5].audit) == repair.search(flat)
    assert got[5].repaired_sha256 == sha("\n".join(repair.render(flat, got[5].audit)))
    assert repair.repair(spark.createDataFrame([], CONVERSATION)).count() == 0
    gone = [(c, t, "user", "hm.", 1, "x", 7) for c in range(60) for t in [1] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert {tuple(r)[1:] for r in repair.repair(spark.createDataFrame(gone, CONVERSATION)).collect()} == {(0, 0, 0, 0, 0, 0, "", sha(""))}


# Decontamination


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    for i, text in docs:
        w, hit, its = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    its |= own
        out.append((i, len(w), len(hit), len(its), sha(",".join(sorted(its))), bool(hit)))
    return out


def leak_tables(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "B", "cc", "Éa", "7x", "ñ", "dd", "e"])
    prose = lambda n: rng.choice([" ", ", "]).join(word() for _ in range(n))
    items = [(i, prose(rng.choice([3, 9, 10, 14, 30]))) for i in range(12)] + [(3, prose(12)), (None, prose(11)), (50, None), (51, ""), (52, "..!"), (53, "unique"), (54, items_text := prose(40))]
    docs = [(i, prose(rng.randrange(60))) for i in range(150)] + [(None, "Unique!"), (7, None), (7, ""), (200, "x" * 5000 + " " + items_text.upper().replace("É", "É") + " " + prose(9000))]
    docs += [(300 + i, f"before {items[i][1]}\n-- after {items[i][1]}.") for i in range(12)] * 2
    return (docs, items, spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, spans int, row_id long").repartition(4),
            spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, digest string"))


@pytest.mark.parametrize("block", [1 << 19, 16])
def test_decontamination_is_the_plain_one(spark, block):
    docs, items, d, b = leak_tables(spark)
    got = sorted(map(tuple, decontamination.report(d, b, block=block).collect()), key=repr)
    assert got == sorted(plain_hits(docs, items), key=repr)
    assert sum(r[-1] for r in got) > 20


def test_decontamination_of_empty_tables(spark):
    docs, _, d, b = leak_tables(spark)
    assert decontamination.report(d.limit(0), b).count() == 0
    assert {tuple(r)[2:] for r in decontamination.report(d, b.limit(0)).collect()} == {(0, 0, sha(""), False)}


def test_decontaminated_texts(spark):
    docs, items, d, b = leak_tables(spark)
    plain = plain_hits(docs, items)
    kept = decontamination.clean(d, b)
    assert kept.columns == d.columns
    assert sorted((r.text or "" for r in kept.collect())) == sorted(t or "" for (_, t), p in zip(docs, plain) if not p[-1])
    for r in decontamination.clean(d, b, "spans").collect():
        assert r.spans == 1
    left = decontamination.clean(d, b, "spans").select("text").collect()
    whole = {t for (_, t), p in zip(docs, plain) if not p[-1]}
    assert sum(r.text in whole for r in left) >= sum(not p[-1] for p in plain)
    assert sum(len(plain_words(r.text)) for r in left) == sum(p[1] - p[2] for p in plain)
    one = spark.createDataFrame([(1, "So: one two three - four five six seven EIGHT nine, ten! then more.")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontamination.clean(one, item, "spans").first().text == "So! then more."


# Manifest


def plain_tree(digests):
    paths, place, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(place):
            first = p // 3 * 3
            run = level[first : first + 3]
            paths[i].append(("".join(run[: p - first]), "".join(run[p - first + 1 :])))
            place[i] = p // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, tops = plain_tree([subs[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, own, r), path in zip(sorted(by[s], key=lambda x: x[:3]), subs[s][1]):
            path, text = path + tops[k], r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((r[0], own, subs[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def manifest_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "é", "z", None]), rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["x\ny", "plain", "", None, "é\n" * 9000])) for i in range(230)]
    return rows + [(None, "a", "en", 1, "p"), (None, None, None, None, None), (5, "a", "en", 4, "q"), (5, "a", "en", 4, "other"), (900, "lone", "en", 2, "x\n")] + [(17, "copies", "en", 3, "s\n")] * 60


def test_manifest_is_the_plain_one(spark):
    rows = manifest_rows()
    shape = "doc_id long, source string, lang string, n_chars long, text string, rank int, tie string"
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], shape).repartition(4)
    assert sorted(map(tuple, merkle.verify(docs).collect()), key=repr) == sorted(plain_manifest(rows), key=repr)
    assert merkle.verify(docs.limit(0)).count() == 0
    for some in (rows[:1], [r for r in rows if r[1] == "a"], rows[:3]):
        docs = spark.createDataFrame([(*r, 1, "t") for r in some], shape)
        assert sorted(map(tuple, merkle.verify(docs).collect()), key=repr) == sorted(plain_manifest(some), key=repr)


def test_proofs_of_some_leaves_and_the_store(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    tree = merkle.manifest(merkle.leaves(docs))
    wanted = tree["places"].where("idx % 7 = 2").select("tree", "idx")
    got = merkle.prove(tree, wanted)
    assert {(r.tree, r.idx) for r in got.collect()} == {(r.tree, r.idx) for r in wanted.collect()}
    assert all(r.folded == tree["root"] for r in got.select(merkle.folded(F.col("digest"), F.col("path")).alias("folded")).collect())
    for record in itertools.chain(tree["store"].collect(), tree["crown"].collect()):
        assert record.digest == sha("".join(record.children))
    assert tree["store"].count() == tree["store"].select("height", "digest").distinct().count()
