"""Mixing sources to target sizes by entropy balancing.

Each document i of source s gets a rate r_i, as near 1 in Kullback-Leibler distance as the token constraint
sum(r_i * size_i) = target_s allows, and at most MOST.  The solution is r_i = min(MOST, exp(lambda_s * x_i)) with x_i the
document's size over its source's mean, and lambda_s minimises a convex dual.  Newton steps, kept inside a bracket that
is sure to hold the solution, solve all duals at once: each step is one aggregation by source over (source, size) cells,
whose masses are summed beforehand, in whole numbers so that the order of the rows can't show.  Steps go on until every
source has settled or its bracket can't be halved any more.

Rates become copies by systematic rounding: in groups of about GROUP documents of a source, ordered by size, a document
gets the integers that the running sum of rates passes.  What a source's sum is then off its target is mended size by
size, largest first: of each size as many documents gain or lose one copy as fit in what is still missing.  One pass
over the small table of sizes decides how many, and the rows are rewritten once (again only where rows can take a second
step).

Defined results: a null text has size 0 and is not taken; a null source is a source of its own, after all others;
repeated rows are separate documents; null identifiers are identifiers like others; sizes of 0 throughout give targets
of 0; an empty table gives none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import counted, cut, free_name, share_of, words_in

WEIGHTS, TOTAL, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
GROUP, NEAR = 2000, 1e-7
#: Parts of a word in which sums over cells are counted.
PARTS = 1024.0


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with their rank from 0 over the whole table, by ranges, without one task for all."""
    part, at, n, start = (free_name(df, c) for c in ("part", "at", "n", "start"))
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias(n)).withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0)))
    return placed.join(starts, part).withColumn("rank", F.col(start) + F.col(at)).drop(part, at, n, start)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, least_size, target): shares by weight, in the order of code points, that stop at ``most`` times the size."""
    order = F.array(*[F.lit(float(w)) for w in weights])
    rows = cut(
        ranked(sources, F.col("source").asc_nulls_last())
        .withColumn("weight", F.element_at(order, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
    )
    size = rows.agg(F.sum("source_size").alias("x")).first()["x"] or 0
    level, stopped = 0.0, -1
    while True:
        # what stands at its cap when each unit of weight gets the present level, and what is left for the others
        at_cap = F.col("cap") < level * F.col("weight")
        got = rows.agg(F.count_if(at_cap).alias("n"), F.sum(F.when(at_cap, F.col("cap"))).alias("cap"), F.sum(F.when(~at_cap, F.col("weight"))).alias("open")).first()
        if got["n"] == stopped or not got["open"]:
            break
        stopped, level = got["n"], (total * size - (got["cap"] or 0.0)) / got["open"]
    return cut(rows.select("source", "source_size", "docs", "least_size", F.least(F.col("cap"), level * F.col("weight")).alias("target")))


def solve(cells: DataFrame, goals: DataFrame, most: float = MOST, near: float = NEAR) -> DataFrame:
    """(source, lam): multipliers under which the cells (source, x, mass) come to the goals (source, target, source_size, docs,
    least_size), of which each has a cell."""
    ratio = F.col("target") / F.col("source_size")
    x = F.col("least_size") * F.col("docs") / F.col("source_size")
    # at lo no rate exceeds target / size, and at hi every rate is at its most
    state = cut(goals.select("source", "target", (ratio >= most).alias("full"), F.lit(0.0).alias("lam"), F.least(F.lit(0.0), F.log(ratio) / x).alias("lo"),
                             (F.log(F.lit(most)) / x).alias("hi")))
    whole = lambda c: F.sum(F.rint(c * PARTS).cast("decimal(38,0)")).cast("double") / PARTS
    while True:
        # what a source has reached goes along with its cells, so a step is one join and one aggregation
        rate = F.exp(F.col("lam") * F.col("x"))
        sums = (
            cells.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source", "target", "full", "lam", "lo", "hi")
            .agg(whole(F.col("mass") * F.least(F.lit(most), rate)).alias("sum"),
                 whole(F.when(rate < most, F.col("mass") * F.col("x") * rate).otherwise(0.0)).alias("slope"))
        )
        over = F.col("sum") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, F.col("lam") - (F.col("sum") - F.col("target")) / F.col("slope"))
        middle = (lo + hi) / 2
        settled = F.col("full") | (F.abs(F.col("sum") - F.col("target")) <= F.greatest(near * F.col("target"), F.lit(0.5))) | (middle <= lo) | (middle >= hi)
        state, found = counted(
            sums.select("source", "target", "full", F.when(settled, F.col("lam")).when((step > lo) & (step < hi), step).otherwise(middle).alias("lam"),
                        lo.alias("lo"), hi.alias("hi"), settled.alias("settled")),
            open=F.count_if(~F.col("settled")),
        )
        if not found["open"]:
            return state.select("source", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("lam")).alias("lam"))
        state = state.drop("settled")


def moves_by_size(cells: pd.DataFrame) -> pd.DataFrame:
    """For one source's cells (size, count, gap): how many documents of each size move, largest first, while they fit in
    the gap; and one more of the size that then brings the sum nearest, if any does.  Sizes of which some move keep their count and gap."""
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    left, taken = abs(float(cells["gap"].iloc[0])), []
    for size, count in zip(cells["size"].tolist(), cells["count"].tolist(), strict=True):
        n = min(count, int(left // size))
        taken.append(n)
        left -= n * size
    cells["n"] = taken
    free = cells[cells["n"] < cells["count"]]
    if len(free):
        best = (free["size"] - left).abs().idxmin()
        if abs(free["size"][best] - left) < left:
            cells.loc[best, "n"] += 1
    return cells.loc[cells["n"] > 0, ["source", "size", "n", "count", "gap"]]


def _salt(groups: Column) -> Column:
    """Deals rows of equal standing by what they are; of identical rows, and only of these where they are many, by number."""
    return F.pmod(F.xxhash64("doc_id", "mark", F.when(F.col("many"), F.col("row"))), groups)


def round_copies(rows: DataFrame, goals: DataFrame, most: int = int(MOST), group: int = GROUP) -> DataFrame:
    """(row, copies) for the rows (row, doc_id, mark, many, source, size, rate, docs): whole copies that come near the goals."""
    salted = rows.withColumn("salt", _salt(F.greatest(F.lit(1), F.ceil(F.col("docs") / group))))
    w = Window.partitionBy("source", "salt").orderBy("size", "doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, 0)
    to = F.sum("rate").over(w) + share_of(F.concat_ws("/", "source", "salt"))
    whole = F.greatest(F.lit(0), F.least(F.lit(most), F.floor("to") - F.floor(F.col("to") - F.col("rate"))))
    state = cut(salted.withColumn("to", to).select("row", "doc_id", "mark", "many", "source", "size", F.when(F.col("size") == 0, 0).otherwise(whole).cast("long").alias("copies")))
    same = F.col("source").eqNullSafe(F.col("s"))
    while True:
        now = state.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("size") * F.col("copies")).alias("now"))
        gaps = cut(goals.join(now, same).select("s", (F.col("target") - F.col("now")).alias("gap")))
        can = (F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)) & (F.col("size") > 0) & (F.col("gap") != 0)
        cells = state.join(gaps, same).where(can).groupBy("source", "size").agg(F.count("*").alias("count"), F.first("gap").alias("gap"))
        chosen, found = counted(cells.groupBy("source").applyInPandas(moves_by_size, "source string, size long, n long, count long, gap double"))
        if not found["rows"]:
            return state.select("row", "copies")
        # the first n rows of a size: whole salted groups, then a part of one
        mine = state.join(chosen.toDF("s", "its_size", "n", "count", "gap"), same & (F.col("size") == F.col("its_size"))).where(can)
        mine = cut(mine.drop("s", "its_size").withColumn("salt", _salt(F.ceil(F.col("count") / group))))
        before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        starts = mine.groupBy("source", "size", "salt").agg(F.count("*").alias("c")).select(
            F.col("source").alias("s"), F.col("size").alias("its_size"), F.col("salt").alias("its_salt"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
        place = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id", "mark", "row"))
        moved = mine.withColumn("place", place).join(starts, same & (F.col("size") == F.col("its_size")) & (F.col("salt") == F.col("its_salt")))
        moved = moved.where(F.col("start") + F.col("place") <= F.col("n")).select("row", F.signum("gap").cast("long").alias("sign"))
        state = cut(state.join(moved, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, rate, copies, taken) for every row; ``row`` numbers the rows."""
    sized = cut(docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(id_col).alias("doc_id"),
                            F.xxhash64(text_col).alias("mark"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size")))
    many = sized.groupBy(F.col("doc_id").alias("i"), F.col("mark").alias("m")).agg(F.count("*").alias("c")).where(F.col("c") > GROUP).drop("c")
    sized = sized.join(many, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").withColumn("many", F.col("m").isNotNull()).drop("i", "m")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"))
    goals = targets(sources, weights, total, most)
    own = goals.withColumnRenamed("source", "s").drop("least_size")
    x = F.when(F.col("source_size") > 0, F.col("size") * F.col("docs") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("x", x)
    cells = cut(joined.where("size > 0").groupBy("source", "x").agg(F.sum("size").cast("double").alias("mass")))
    lam = solve(cells, goals.where("source_size > 0"), most).withColumnRenamed("source", "s")
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(most), F.exp(F.col("lam") * F.col("x"))))
    rated = cut(joined.join(lam, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "row", "doc_id", "mark", "many", "source", "size", "docs", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate")))
    copies = round_copies(rated, goals, int(most))
    return rated.join(copies, "row").select("row", "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix with their own columns, each as often as it is taken."""
    row = free_name(docs, "row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix(rows, id_col=id_col, text_col=text_col, source_col=source_col, row=F.col(row), **options).where("copies > 0").select(F.col("row").alias(row), "copies")
    copies = free_name(rows, "copies")
    # what is taken grows with the documents, so both sides are shuffled at every size
    both = rows.join(cut(taken).toDF(row, copies).hint("merge"), row)
    return both.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
