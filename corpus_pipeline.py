"""From raw documents to packed training sequences, in five stages; each stage's rows are written and read again.

Every stage takes the columns of documents, whatever others there are and whatever their names, and all but the last
return just these.  Rows are told apart by where they lie, not by doc_id, so a null or repeated doc_id costs no row.  An
empty table passes every stage and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import kneser_ney, language, mixing, packing, simhash
from evidentia.llm.common import cut, free_name, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and those between two languages; fills in a missing language.

    Without any row that has a language nothing can be learned, and every row goes."""
    model = language.fit(docs, F.lit(True))
    said = free_name(docs, "said")
    kept = docs.withColumn(said, language.predict(docs, model)).where((F.col(f"{said}.lang_pred") != "und") & ~F.col(f"{said}.ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", f"{said}.lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and empty texts, and those more perplexing than nearly all trusted texts of their language (of all
    languages, where few are trusted or it is null); without trusted rows every other text stays."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (by doc_id, nulls last) of each group of near copies: SimHash fingerprints that differ in two
    bits at most, as in op9, or Jaccard 0.8 or more on runs of five words.  Null and empty texts are copies of each other."""
    return simhash.keep_first(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops and repeats documents so that the sources (null is one) come to their targets; texts without words go."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; repeated documents are told apart by row_id."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The stages learn models and tokenise, which SQL can't express; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
