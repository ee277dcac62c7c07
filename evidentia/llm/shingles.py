"""Near copies by shared runs of words.

A text's set holds the 32-bit hashes of its runs of ``width`` words (of all its words, where they are fewer).  Two texts are
near copies if their sets' Jaccard similarity is at least ``similarity``, counted on the sets themselves (two runs of one
hash, one pair of runs in four thousand million, count as one).  Pairs are counted only if they agree on one of BANDS groups
of ROWS minhashes: of pairs at 0.8 that misses (1 - 0.8**4)**16, one in 4,500, and fewer above.  Fingerprints of 64 bits
can't give these candidates: at 0.8 they differ by some ten bits, and no blocks of 64 bits are both wide enough to select
and sure to agree.

Equal sets are compared once.  What is wanted is components, so a key's rows aren't paired with each other.  In each of
ROUNDS rounds every key has a pivot, the row whose keys are shared most (of a group of near copies that is the one the others
were made from): the key's rows of other components are compared with it, and those alike join its component, about one
comparison a row.  What then still shares a key across components is compared in full, every row outside the key's
largest component with every row of another component, but for pairs that can't be alike: of a row's n hashes only
those c that other rows have too can be shared, so its similarity to a row of m hashes is at most c / (n + m - c).  Copies
too far from what they were made from fall to that bound.  The counts of a row's hashes in CELLS cells give another: two
rows share at most the sum of their lesser counts.  No pair that could join two components is left out.

Defined results: null and empty texts, and texts of spaces, are copies of each other; repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, per_text
from .simhash import components, digests

BANDS, ROWS, ROUNDS, CELLS = 16, 4, 1, 256
_RANDOM = np.random.RandomState(20)
_TIMES = _RANDOM.randint(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.randint(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes, in order."""
    return np.unique(np.array(digests(text, width), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (row, pivot) whose sets are as alike as wanted.  Pivots may be hot, so they are joined while rows are narrow."""
    both = pairs.join(sets.toDF("pivot", "other").hint("merge"), "pivot").join(sets.toDF("row", "own").hint("merge"), "row")
    shared = F.size(F.array_intersect("own", "other"))
    return both.where(shared / (F.size("own") + F.size("other") - shared) >= similarity).select("row", "pivot")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (row, label) after the components at the ends of the edges (row, pivot) are made one."""
    ends = edges.join(labels.hint("merge"), "row").select("pivot", F.col("label").alias("a")).join(labels.toDF("pivot", "b").hint("merge"), "pivot")
    ends, found = counted(ends.select("a", "b").where("a <> b").distinct())
    if not found["rows"]:
        return labels
    merged = components(labels, ends).toDF("label", "least")
    return cut(labels.join(merged.hint("merge"), "label", "left").select("row", F.coalesce("least", "label").alias("label")))


def cell_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall in each of CELLS cells (127 stands for as many or more, and bounds nothing)."""
    return np.minimum(np.bincount(hashes % CELLS, minlength=CELLS), 127).astype(np.int8)


def _most_shared(a: str, b: str) -> Column:
    """An upper bound of the number of hashes two rows share, from their cell counts; large where a cell is full."""
    least = F.zip_with(a, b, lambda x, y: F.when((x == 127) & (y == 127), F.lit(1 << 20)).otherwise(F.least(x, y).cast("int")))
    return F.aggregate(least, F.lit(0), lambda t, x: t + x)


def _shared_hashes(rows: DataFrame, among: DataFrame, sets: DataFrame) -> DataFrame:
    """(row, c): of each row's hashes, how many at least one other row ``among`` has too."""
    each = lambda df: sets.join(df.select("row").distinct().hint("merge"), "row", "left_semi").select("row", F.explode("hashes").alias("hash"))
    common = each(among).groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash")
    return each(rows).join(common.hint("merge"), "hash").groupBy("row").agg(F.count("*").alias("c"))


def link_keys(met: DataFrame, sets: DataFrame, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """(row, label): the least row of each component, for the rows (key, row, n) that share a key; sets are (row, hashes, cells)."""
    cells, sets = sets.select("row", "cells"), sets.select("row", "hashes")
    labels = cut(met.select("row", F.col("row").alias("label")).distinct())
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6
    sizes = met.groupBy("key").agg(F.count("*").alias("size"))
    scores = met.join(sizes.hint("merge"), "key").groupBy("row").agg(F.sum("size").alias("score"))
    scored = cut(met.join(scores.hint("merge"), "row"))
    for n in range(rounds + 1):
        tagged = cut(scored.join(labels.hint("merge"), "row"))
        groups = tagged.groupBy("key", "label").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        across = groups.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label"))["label"].alias("main"), F.min("n").alias("lo")).where("labels > 1").drop("labels")
        mixed, found = counted(tagged.join(across.hint("merge"), "key"))
        if not found["rows"]:
            break
        if n < rounds:
            pivots = mixed.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "row", "n", "label")).alias("p"))
            meets = mixed.join(pivots.hint("merge"), "key").where((F.col("label") != F.col("p.label")) & fits(F.col("n"), F.col("p.n")))
            pairs = meets.select("row", F.col("p.row").alias("pivot"))
        else:
            minor = mixed.where("label <> main")
            minor = minor.join(_shared_hashes(minor, mixed, sets).hint("merge"), "row")
            # one more, since two hashes of 64 bits may be one of 32
            reaches = lambda both, m: both * (1 + similarity) >= similarity * (F.col("n") + m)
            bound = lambda m: reaches(F.col("c") + 1, m)
            minor = minor.where(bound(F.greatest(F.col("lo"), similarity * F.col("n")))).select("key", "row", "n", "label", "c")
            minor = cut(minor.join(cells.hint("merge"), "row"))
            other = mixed.select("key", "row", F.col("n").alias("m"), F.col("label").alias("theirs")).join(minor.select("key").distinct().hint("merge"), "key", "left_semi")
            other = other.join(cells.toDF("row", "their_cells").hint("merge"), "row").withColumnRenamed("row", "pivot")
            apart = (F.col("label") != F.col("theirs")) & fits(F.col("n"), F.col("m")) & bound(F.col("m"))
            close = F.when(apart, reaches(_most_shared("cells", "their_cells") + 1, F.col("m"))).otherwise(False)
            meets = minor.join(other.hint("merge"), "key").where(close)
            pairs = meets.select(F.least("row", "pivot").alias("row"), F.greatest("row", "pivot").alias("pivot"))
        labels = _joined(labels, cut(_alike(cut(pairs.distinct()), sets, similarity)))
    return labels


def near_copies(rows: DataFrame, row: str, text_col: str = "text", width: int = 5, similarity: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """(row, component_id) for rows with distinct numbers: the least row that near copies lead to."""

    def sketch(text: str | None) -> dict:
        hashes = shingle_set(text, width)
        whole = xxhash.xxh64_intdigest(hashes.tobytes())
        return {"whole": whole - (1 << 64) if whole >> 63 else whole, "n": len(hashes), "keys": band_keys(hashes)}

    sketched = per_text(sketch, "whole long, n int, keys array<long>", pa.struct([("whole", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))]))

    def set_of(text: str | None) -> dict:
        hashes = np.unique(shingle_set(text, width).astype(np.uint32))
        return {"hashes": hashes.view(np.int32), "cells": cell_counts(hashes)}

    sets_of = per_text(set_of, "hashes array<int>, cells array<tinyint>", pa.struct([("hashes", pa.list_(pa.int32())), ("cells", pa.list_(pa.int8()))]))
    made = cut(rows.select(F.col(row).alias("row"), sketched(text_col).alias("s")).select("row", "s.*"))
    firsts = cut(made.groupBy("whole").agg(F.min("row").alias("first")))
    keys = cut(made.join(firsts.select(F.col("first").alias("row")).hint("merge"), "row", "left_semi").select("row", "n", F.explode("keys").alias("key")))
    counts = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    met = cut(keys.join(counts.hint("merge"), "key", "left_semi"))
    wanted = cut(met.select(F.col("row").alias(row)).distinct())
    sets = cut(rows.select(row, text_col).join(wanted.hint("merge"), row, "left_semi").select(F.col(row).alias("row"), sets_of(text_col).alias("s")).select("row", "s.*"))
    labels = link_keys(met, sets, similarity, rounds).toDF("first", "label")
    named = cut(firsts.join(labels.hint("merge"), "first", "left").select("whole", F.coalesce("label", "first").alias("component_id")))
    return made.select("row", "whole").join(named.hint("merge"), "whole").select(F.col("row").alias(row), "component_id")
