"""Exact top-k by integer inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks of at most about CANDIDATES rows and queries into blocks of about QUERIES rows; every
query block meets every candidate block once, and each such pair is one group.  A group takes its candidates LISTS rows
at a time, keeps one sorted list of them for every dimension and reads the lists from both ends in rounds.  The values
last read bound the score of whatever is still unread; a query stops when its kth score exceeds that bound.  The k best of
each block are then ranked for each query.  Vectors travel as they are stored, and are scaled where they meet.

Defined results: vectors that are null, or hold null or non-finite components, take no part; null identifiers neither; any
finite component counts, and a score beyond the 64 bits of its column is held at their end; a query meets vectors of its
own length only (two empty ones score 0) and never a row with its own identifier; ties go to the smaller identifier; rows
that repeat an identifier are candidates each, and as queries share one ranking; fewer candidates than k give as many
rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import cut

CANDIDATES, QUERIES, LISTS, K, SCALE = 65_536, 32_768, 2048, 10, 1024
_LONG = (1 << 63) - 1


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, width) for the vectors that are whole and finite."""
    kind = table.schema[vector_col].dataType
    v = F.col(vector_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("width"))


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The floors of the scaled components: doubles where these are exact, else Python's whole numbers."""
    x = vectors.astype(np.float64)
    if float(np.abs(x).max(initial=0)) * scale < 2.0**53:
        return np.floor(x * scale)
    big = np.array([int(np.floor(c * scale)) if abs(c) * scale < 2.0**53 else int(c) * scale for c in x.ravel().tolist()], object)
    return big.reshape(x.shape)


def _dot(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products held within a long: in doubles or longs while no sum can pass their bounds, else in whole numbers."""
    most = queries.shape[1] * int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0))
    if most < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most <= _LONG:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    return np.clip(queries.astype(object) @ rows.astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


def threshold_top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, first_depth: int = 16) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, row id); rows are in ascending order of row_ids."""
    n, width = rows.shape
    if not width:
        return [[(0, int(i)) for i in row_ids[row_ids != q][:k]] for q in query_ids]
    lists = np.argsort(rows, axis=0, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    seen = np.zeros(n, bool)
    active = np.arange(len(queries))
    depth, low = first_depth, 0
    positive, negative = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    while len(active) and low < n:
        depth = min(depth, n)
        heads = np.zeros(n, bool)
        heads[lists[low:depth].ravel()] = True
        heads[lists[n - depth : n - low].ravel()] = True
        fresh = np.flatnonzero(heads & ~seen)
        seen[fresh] = True
        if len(fresh):
            scores = _dot(queries[active], rows[fresh])
            for at, q in enumerate(active):
                others = np.flatnonzero(row_ids[fresh] != query_ids[q])
                s = scores[at][others]
                if len(best[q]) >= k:
                    floor = best[q][k - 1][0]
                elif len(s) > k:
                    floor = np.partition(s, len(s) - k)[len(s) - k]
                else:
                    floor = s.min(initial=_LONG)
                good = np.flatnonzero(s >= floor)
                # ~s falls as s rises, and can't pass the bounds of a long
                good = good[np.lexsort((row_ids[fresh[others[good]]], ~s[good]))][:k]
                mine = best[q] + [(int(s[i]), int(row_ids[fresh[others[i]]])) for i in good]
                best[q] = sorted(mine, key=lambda x: (-x[0], x[1]))[:k]
        if seen.all():
            break
        # no row that is still unread lies outside these ends of any list
        top, bottom = rows[lists[n - depth], np.arange(width)].astype(np.float64), rows[lists[depth - 1], np.arange(width)].astype(np.float64)
        bound = positive[active] @ top + negative[active] @ bottom
        active = np.array([q for q, b in zip(active, bound, strict=True) if len(best[q]) < k or not best[q][k - 1][0] > b * (1 + 1e-9 * np.sign(b)) + 1], np.int64)
        low, depth = depth, depth * 4
    return best


def top_k(table: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
          block: int = CANDIDATES, query_block: int = QUERIES, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    vectors = cut(usable(table, id_col, vector_col))
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if(F.expr(is_query)).alias("q")).first()
    # no fewer groups than there are shuffle partitions, while these hold some rows each
    least = min(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes["n"] // LISTS))
    across, down = max(1, least, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // query_block))
    # rows that repeat an identifier are dealt by their vector too
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(F.lit(False).alias("asks"), "vec_id", "v", "width", deal(across).alias("c"), every(down).alias("r"))
    asks = vectors.where(is_query).select(F.lit(True).alias("asks"), "vec_id", "v", "width", every(across).alias("c"), deal(down).alias("r"))

    def matrix(part: pa.Table) -> np.ndarray:
        flat = part.column("v").combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1 if len(part) and len(flat.flatten()) else 0)

    def meet(group: pa.Table) -> pa.Table:
        asked, held = group.filter(group.column("asks")), group.filter(pa.compute.invert(group.column("asks"))).sort_by("vec_id")
        found: dict[int, list[list[tuple[int, int]]]] = {}
        ids = asked.column("vec_id").to_numpy()
        if len(asked) and len(held):
            wanted = integers(matrix(asked), scale)
            for at in range(0, len(held), lists):
                part = held.slice(at, lists)
                for n, best in enumerate(threshold_top_k(wanted, ids, integers(matrix(part), scale), part.column("vec_id").to_numpy(), k)):
                    found[n] = sorted(found.get(n, []) + best, key=lambda x: (-x[0], x[1]))[:k]
        flat = [(int(ids[n]), i, s) for n, best in found.items() for s, i in best]
        return pa.table([pa.array(c, pa.int64()) for c in (list(zip(*flat, strict=True)) or [[], [], []])], names=["query_id", "vec_id", "score"])

    best = rows.unionByName(asks).groupBy("width", "c", "r").applyInArrow(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
