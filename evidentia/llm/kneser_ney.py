"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are the UTF-16 units of the text (every digit as 0) with three start marks before it, so an n-gram of ORDER = 4
symbols is one long.  Counts, continuation counts, context totals and probabilities are tables sharded by n-gram and
joined there; nothing of the model is gathered on the driver but four counts of counts an order.  What a document needs
comes to it by joins too: documents are written once in chunks of about CHUNK symbols, bucketed by chunk; each chunk's
distinct n-grams (a few of a hundred symbols) are joined with their probabilities and go back to the chunk, where
its documents' logarithms are summed.  So n-grams travel pre-aggregated, and the text isn't shuffled.

Trusted rows are counted in two folds, by a hash of the text, which give two models.  A trusted row is measured by the
model that did not count it, any other row by the geometric mean of both, so that thresholds aren't those of rows the
model knows.  A document is kept if its perplexity does not exceed a quantile of the trusted documents of its language
(of all languages where fewer than LEAST are trusted).

Defined results: null and empty texts have no perplexity and are not kept; without trusted rows, or a threshold, every
text that isn't empty is kept; a fold without text takes the other's counts; a null language takes the threshold of all;
a null doc_id is never trusted; a label counts if any row of it says 1; repeated rows get equal answers; an empty table
gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, new_folder, short_batches

ORDER, BITS = 4, 16
#: Symbols of a chunk, about: what one task holds of texts at once.
CHUNK = 1 << 24
#: Steps of a natural logarithm.  Sums of whole steps are exact in any order.
STEPS = 2048
QUANTILE, LEAST = 0.999, 50
_FOLDS = (0, 1)
_STRIDE = 1 << 18


def symbols(text: str) -> np.ndarray:
    """UTF-16 units, digits as 0."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    return np.where((units >= 48) & (units <= 57), np.uint16(48), units)


def grams(units: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol, as a signed number of 64 bits."""
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint64), units.astype(np.uint64)])
    key = padded[: len(units)]
    for i in range(1, ORDER):
        key = (key << np.uint64(BITS)) | padded[i : i + len(units)]
    return key.view(np.int64)


def _strides(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, some at a time."""
    units = symbols(text)
    for at in range(0, len(units), _STRIDE):
        own = grams(units[max(at - ORDER + 1, 0) : at + _STRIDE])
        yield own[ORDER - 1 :] if at else own


def in_chunks(docs: DataFrame, own: Column, id_col: str, text_col: str, lang_col: str, chunk: int = CHUNK) -> tuple[DataFrame, str]:
    """The documents as a table (chunk, row, id, lang, fold, own, text) bucketed by chunk, and the table's name."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.pmod(F.xxhash64(text_col), F.lit(2)).cast("int").alias("fold"), own.alias("own"), F.col(text_col).alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 31, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) + done
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays([pa.array(first + ends // chunk, pa.int64()), *batch.columns], names=["chunk", *batch.schema.names])

    short_batches()
    spark, name = docs.sparkSession, f"chunks_{uuid.uuid4().hex}"
    placed = rows.mapInArrow(place, "chunk long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.write.format("parquet").option("compression", "zstd").option("path", new_folder(spark)).bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name), name


def count_grams(chunks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(chunk, gram, n0, n1): every distinct n-gram of a chunk, and how often each fold's trusted rows (chunk, row) hold it."""

    def count(own: pa.Table, marked: pa.Table) -> pa.Table:
        marks = set(marked.column("row").to_pylist())
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}
        sizes = {0: 0, 1: 0, 2: 0}

        def settle(which: int) -> None:
            if waiting[which]:
                keys, n = np.unique(np.concatenate(waiting[which]), return_counts=True)
                counts = np.zeros((len(keys), 2), np.int64)
                if which < 2:
                    counts[:, which] = n
                found.append((keys, counts))
                waiting[which], sizes[which] = [], 0
            if found and sum(len(k) for k, _ in found[1:]) > 3 * _STRIDE:
                merge()

        def merge() -> None:
            keys, places = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.concatenate([c for _, c in found])
            sums = np.stack([np.bincount(places, counts[:, f], len(keys)) for f in _FOLDS], 1).astype(np.int64)
            found[:] = [(keys, sums)]

        for row, fold, text in zip(own.column("row").to_pylist(), own.column("fold").to_pylist(), own.column("text"), strict=True):
            which = fold if row in marks else 2
            for part in _strides(text.as_py() or ""):
                waiting[which].append(part)
                sizes[which] += len(part)
                if sizes[which] > _STRIDE:
                    settle(which)
        for which in waiting:
            settle(which)
        if not found:
            return pa.table({"chunk": pa.array([], pa.int64()), "gram": pa.array([], pa.int64()), "n0": pa.array([], pa.int64()), "n1": pa.array([], pa.int64())})
        merge()
        keys, sums = found[0]
        return pa.table({"chunk": pa.array(np.full(len(keys), own.column("chunk")[0].as_py())), "gram": pa.array(keys), "n0": pa.array(sums[:, 0]), "n1": pa.array(sums[:, 1])})

    left = chunks.select("chunk", "row", "fold", "text").groupBy("chunk")
    return left.cogroup(trusted.select("chunk", "row").groupBy("chunk")).applyInArrow(count, "chunk long, gram long, n0 long, n1 long")


def discounts(tables: list[DataFrame]) -> list[list[list[float]]]:
    """For each order and fold, Chen and Goodman's three discounts from the numbers of n-grams seen once to four times."""
    seen = [t.agg(F.lit(n).alias("n"), *[F.array(*[F.count_if(F.col(f"n{f}") == i) for i in range(1, 5)]).alias(f"c{f}") for f in _FOLDS]) for n, t in enumerate(tables)]
    both = seen[0]
    for one in seen[1:]:
        both = both.unionByName(one)

    def three(c: list[int]) -> list[float]:
        y = c[0] / (c[0] + 2 * c[1]) if c[0] + c[1] else 0.5
        found = [i - (i + 1) * y * c[i] / c[i - 1] if c[i - 1] else 0.5 * i for i in range(1, 4)]
        return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]

    return [[three(r[f"c{f}"]) for f in _FOLDS] for r in sorted(both.collect(), key=lambda r: r["n"])]


def orders(counts: DataFrame) -> list[DataFrame]:
    """From (gram, n0, n1) of the highest order, the tables of all orders, lowest first: below it, n is the number of
    different symbols seen before the n-gram."""
    tables = [cut(counts)]
    for n in range(ORDER - 1, 0, -1):
        lower = F.col("gram").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
        tables.insert(0, cut(tables[0].groupBy(lower.alias("gram")).agg(*[F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in _FOLDS])))
    return tables


def probabilities(wanted: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(gram, p0, p1) for each distinct n-gram of the highest order in ``wanted``, under each fold's model.

    The share of an n-gram, what its context leaves to the lower order, and the lower order's probability meet by joins
    on the n-gram, on its context (all but the last symbol) and on its suffix (all but the first)."""
    needed = [wanted]
    for n in range(ORDER - 1, 0, -1):
        needed.insert(0, needed[0].select(F.col("gram").bitwiseAND(F.lit((1 << (BITS * n)) - 1)).alias("gram")).distinct())
    below = None
    for n, (counts, own, taken) in enumerate(zip(tables, needed, discounts(tables), strict=True)):
        context = F.shiftrightunsigned("gram", BITS)
        off = {f: F.when(F.col(f"n{f}") == 1, taken[f][0]).when(F.col(f"n{f}") == 2, taken[f][1]).otherwise(taken[f][2]) for f in _FOLDS}
        left = {f: sum(F.count_if(F.col(f"n{f}") == i + 1 if i < 2 else F.col(f"n{f}") > 2) * taken[f][i] for i in range(3)) for f in _FOLDS}
        contexts = counts.groupBy(context.alias("context")).agg(
            *[F.sum(f"n{f}").alias(f"total{f}") for f in _FOLDS], *[left[f].alias(f"left{f}") for f in _FOLDS])
        rows = own.withColumn("context", context).join(counts, "gram", "left").join(contexts, "context", "left")
        if below is None:
            rows = rows.select("*", *[F.lit(0.5**BITS).alias(f"low{f}") for f in _FOLDS])
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
            rows = rows.withColumn("suffix", suffix).join(below.select(F.col("gram").alias("suffix"), *[F.col(f"p{f}").alias(f"low{f}") for f in _FOLDS]), "suffix")
        p = {f: F.when(F.col(f"total{f}") > 0, (F.when(F.col(f"n{f}") > 0, F.col(f"n{f}") - off[f]).otherwise(0.0) + F.col(f"left{f}") * F.col(f"low{f}")) / F.col(f"total{f}"))
             .otherwise(F.col(f"low{f}")) for f in _FOLDS}
        below = rows.select("gram", *[p[f].alias(f"p{f}") for f in _FOLDS])
    return below


def _measure(chunks: DataFrame, trusted: DataFrame, steps: DataFrame, carried: str) -> DataFrame:
    """(own, lang, filled, trusted, perplexity, and the text if carried) for each row, from the steps (chunk, gram, s0, s1)."""
    kept = ["own", "lang", "text"] if carried else ["own", "lang"]
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def measure(rows: pa.Table, known: pa.Table) -> pa.Table:
        key, s0, s1 = (known.column(c).to_numpy() for c in ("key", "s0", "s1"))
        marks = set(key[s0 < 0].tolist())
        mine = np.flatnonzero(s0 >= 0)
        # a hash table of the chunk's n-grams: several times as fast as a search in the sorted ones
        key, both = pd.Index(key[mine]), (s0[mine], s1[mine])
        out, trust, filled = [], [], []
        for row, fold, text in zip(rows.column("row").to_pylist(), rows.column("fold").to_pylist(), rows.column("text"), strict=True):
            text, trusts = text.as_py() or "", row in marks
            sums, length = [0, 0], 0
            for part in _strides(text) if len(key) else ():
                places = key.get_indexer(part)
                length += len(part)
                for f in _FOLDS:
                    # a trusted row of fold f is measured by the other model alone
                    if not trusts or f != fold:
                        sums[f] += int(both[f][places].sum(dtype=np.int64))
            out.append(float(np.exp(sum(sums) / (1 if trusts else 2) / STEPS / length)) if length else None)
            trust.append(trusts)
            filled.append(bool(text))
        return pa.table({**{c: rows.column(c) for c in kept}, "filled": pa.array(filled, pa.bool_()), "trusted": pa.array(trust, pa.bool_()), "perplexity": pa.array(out, pa.float64())})

    none = F.lit(-1)
    known = steps.select("chunk", F.col("gram").alias("key"), "s0", "s1").unionByName(trusted.select("chunk", F.col("row").alias("key"), none.alias("s0"), none.alias("s1")))
    left = chunks.select("chunk", "row", "fold", *kept, *([] if carried else ["text"])).groupBy("chunk")
    return left.cogroup(known.groupBy("chunk")).applyInArrow(measure, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", filled boolean, trusted boolean, perplexity double")


def measured(docs: DataFrame, labels: DataFrame, own: Column, carry_text: bool, id_col: str, text_col: str, lang_col: str, chunk: int = CHUNK) -> DataFrame:
    """A written table (own, lang, filled, trusted, perplexity, text if carried) of all rows."""
    chunks, name = in_chunks(docs, own, id_col, text_col, lang_col, chunk)
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    # the identifiers grow with the documents, so both sides are shuffled at every size; no text is
    trusted = cut(chunks.select("chunk", "row", "id").join(ids.hint("merge"), "id", "left_semi").select("chunk", "row"))
    counted = cut(count_grams(chunks, trusted))
    total = counted.agg(*[F.coalesce(F.sum(f"n{f}"), F.lit(0)).alias(f"n{f}") for f in _FOLDS]).first()
    if total["n0"] or total["n1"]:
        n = [F.col("n0"), F.col("n1")] if total["n0"] and total["n1"] else [F.col("n0") + F.col("n1")] * 2
        tables = orders(counted.where("n0 + n1 > 0").groupBy("gram").agg(*[F.sum(n[f]).alias(f"n{f}") for f in _FOLDS]))
        p = cut(probabilities(cut(counted.select("gram").distinct()), tables))
        step = [F.rint(F.log(f"p{f}") * -STEPS).cast("int").alias(f"s{f}") for f in _FOLDS]
        steps = counted.select("chunk", "gram").join(p.select("gram", *step), "gram")
    else:
        steps = counted.select("chunk", "gram", F.lit(0).alias("s0"), F.lit(0).alias("s1")).where("false")
    out = cut(_measure(chunks, trusted, steps, carry_text))
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return out


def thresholds(scored: DataFrame, quantile: float = QUANTILE, lang_col: str = "lang") -> tuple[DataFrame, float | None]:
    """(lang, q) by language, and a number over all: quantiles of the perplexity of rows marked trusted, equal in every run.

    Rows are counted in bins a ten-thousandth wide, and the quantile is the greatest perplexity of the bin it falls in.
    """
    rows = scored.where("trusted and perplexity is not null").select(F.col(lang_col).alias("lang"), "perplexity")
    every = rows.groupBy("lang", F.floor(F.log("perplexity") * 10_000).alias("bin")).agg(F.count("*").alias("c"), F.max("perplexity").alias("top"))
    every = cut(every)
    overall = every.groupBy("bin").agg(F.sum("c").alias("c"), F.max("top").alias("top")).withColumn("lang", F.lit(None).cast("string"))
    bins = every.where("lang is not null").unionByName(overall)
    per = Window.partitionBy("lang")
    ranked = bins.withColumn("n", F.sum("c").over(per)).withColumn("upto", F.sum("c").over(per.orderBy("bin")))
    found = ranked.where(F.col("upto") >= F.ceil(F.col("n") * F.lit(quantile))).groupBy("lang").agg(F.max("n").alias("n"), F.min("top").alias("q"))
    found = cut(found.where((F.col("n") >= LEAST) | F.col("lang").isNull()).select("lang", "q"))
    rest = found.where("lang is null").first()
    return found.where("lang is not null"), rest["q"] if rest else None


def judged(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows with their threshold and whether they stay."""
    by_lang, overall = thresholds(scored, quantile)
    limit = F.coalesce("q", F.lit(overall).cast("double"))
    keep = F.col("filled") & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return scored.join(by_lang, "lang", "left").withColumn("threshold", limit).withColumn("keep", keep).drop("q")


def assess(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           chunk: int = CHUNK) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every row."""
    scored = measured(docs, labels, F.col(id_col), False, id_col, text_col, lang_col, chunk)
    return judged(scored, quantile).select(F.col("own").alias("doc_id"), "lang", "perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              chunk: int = CHUNK) -> DataFrame:
    """The rows that stay, with their own columns."""
    others = [c for c in docs.columns if c != text_col]
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(True).alias("any"))
    scored = measured(docs, labels, own, True, id_col, text_col, lang_col, chunk)
    return judged(scored, quantile).where("keep").select(*[F.col("text").alias(c) if c == text_col else F.col(f"own.c{others.index(c)}").alias(c) for c in docs.columns])
