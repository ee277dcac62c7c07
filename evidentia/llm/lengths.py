"""Token counts for every context limit from one exact histogram of encoded lengths.

Documents are encoded once and counted by length.  Suffix sums over the histogram then give, for any limit, how many
documents reach it, how many tokens they hold, and what truncation to it leaves.  The sums run within blocks of SPAN
lengths and over the blocks' totals, so no task holds the whole histogram.

Defined results: null and empty texts have length 0; repeated rows each count; an empty table gives no rows, and
truncated totals of 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, per_text
from .tokens import default_path, word_encoder

SPAN = 64


def histogram(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(length, docs)."""
    path = path or default_path()

    length = per_text(lambda t: word_encoder(path).length(t), "long", pa.int64())
    return docs.select(length(F.col(text_col)).alias("length")).groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length L as a limit: documents and tokens of L or more, the total after truncation to L, and the share of
    documents of at most L (so a quantile q is the least L whose share reaches q)."""
    hist = cut(hist.withColumn("block", F.floor(F.col("length") / span)).withColumn("tokens", F.col("length") * F.col("docs")))
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    w = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.withColumn("d_own", F.sum("docs").over(w)).withColumn("t_own", F.sum("tokens").over(w)).join(blocks, "block")
    at_least = F.col("d_own") + F.col("d_after")
    tokens = F.col("t_own") + F.col("t_after")
    return sums.select(
        F.col("length").alias("context_limit"), "docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens + at_least * F.col("length")).alias("truncated_total"),
        ((F.col("all_docs") - at_least + F.col("docs")) / F.col("all_docs")).alias("share_up_to"), "all_docs", "all_tokens")


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, tokens) for limits that need not occur as lengths."""
    cols = [F.struct(F.lit(n).cast("long").alias("context_limit"), F.coalesce(F.sum(F.least("length", F.lit(n)) * F.col("docs")), F.lit(0)).alias("tokens")) for n in limits]
    return hist.agg(F.array(*cols).alias("x")).select(F.inline("x"))
