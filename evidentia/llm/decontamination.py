"""Benchmark decontamination: a broadcast set of the test items' word windows against every window of every document.

Texts are lower-cased in A-Z and cut into words of digits, letters a-z and whatever lies outside ASCII.  An item's windows
are its runs of ``width`` words; an item of fewer words, but not none, is one window.  Distinct windows travel as a 64-bit
hash and a SHA-256, so that a row of the set has a bounded size whatever the words' lengths, and the set is broadcast in
blocks of at most about BLOCK windows: a larger benchmark takes more passes over the documents, not a larger broadcast.

A document is scanned where it lies, in two looks.  Every window of n words holds exactly one run of g = ceil(n / 2) words that
starts at a multiple of n - g + 1, so the document's runs at these places are looked up in the broadcast set of all runs of
g words in windows.  Only around a run that is found are the windows over it hashed, looked up in the set of windows and
verified by SHA-256; each start has one such run, so nothing is found twice and nothing is lost.  Besides the hits each
document gives one row of its own, so one pass serves documents with and without hits, and only these rows are shuffled,
gathered by document beforehand.  Which items a set of windows belongs to is worked out once for each distinct set, not
for each document.

Everything here is DataFrame expressions; no Python runs on the executors.

Defined results: a null or empty text has no words and no hit, and as an item no window; items that share an identifier
are one item; items without an identifier are one item whose identifier is the empty text; repeated documents and null
identifiers are rows like others; overlapping windows count a word once; extra columns are ignored by ``report`` and kept
by ``clean``; an empty benchmark hits nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

WIDTH = 10
#: Windows in a broadcast, about: 70 to 120 bytes each.
BLOCK = 1 << 19
_OTHER = "".join(chr(i) for i in range(128) if chr(i) not in string.ascii_letters + string.digits)
#: A run of what separates words, and a word.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PIECE = rf"{_GAP}*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words in order; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _OTHER, string.ascii_lowercase + " " * len(_OTHER))
    return F.array_remove(F.split(plain, " "), "")


def run_hash(found: Column, start: Column, length: Column | int, of: Column) -> Column:
    """Hash of so many words from the given place (from 1) on, and of the length of the windows that it stands for."""
    return F.xxhash64(F.slice(found, start, length), of)


def seed_of(length: int) -> tuple[int, int]:
    """Words of a seed of windows of this length, and the distance of the places where documents are looked at."""
    words_in_seed = (length + 1) // 2
    return words_in_seed, length - words_in_seed + 1


def digest_of(found: Column, start: Column, length: Column) -> Column:
    """SHA-256 of so many words from the given place (from 1) on, as bytes."""
    return F.unhex(F.sha2(F.array_join(F.slice(found, start, length), " "), 256))


def item_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, hash, digest, seeds): every window of every item, once; written.  ``seeds`` are the hashes of the shorter
    runs in it."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    placed = items.select("item", "w", "length", starts.alias("starts")).select("item", "w", "length", F.explode_outer("starts").alias("start"))
    seed = F.ceil(F.col("length") / 2).cast("int")
    seeds = F.transform(F.sequence(F.lit(0), F.col("length") - seed), lambda i: run_hash(F.col("w"), F.col("start") + i, seed, F.col("length")))
    window = [run_hash(F.col("w"), F.col("start"), F.col("length"), F.col("length")).alias("hash"), digest_of(F.col("w"), F.col("start"), F.col("length")).alias("digest")]
    return cut(placed.select("item", "length", *window, seeds.alias("seeds")).distinct())


def _scan(texts: DataFrame, windows: DataFrame, lengths: list[int], own_row: bool) -> DataFrame:
    """(row_id, doc_id, n_words, start, end, digest) of the hits, and a row of each document without a place if asked for."""
    split = texts.select("row_id", "doc_id", words(F.col("text")).alias("w"))
    n = F.size("w")

    def looks(length: int) -> Column:
        seed, step = seed_of(length)
        look = lambda i: F.struct(F.lit(length).alias("length"), i.alias("at"), run_hash(F.col("w"), i, seed, F.lit(length)).alias("h"))
        places = F.when(n >= length, F.sequence(F.lit(1), F.greatest(n - seed + 1, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, look)

    no_look = F.lit(None).cast("struct<length:int,at:int,h:bigint>")
    found = split.select("row_id", "doc_id", "w", F.explode_outer(F.concat(F.array(no_look), *[looks(k) for k in lengths])).alias("look")).select("row_id", "doc_id", "w", "look.*")
    own = F.col("at").isNull() if own_row else F.lit(False)
    kind = "left" if own_row else "inner"
    seeds = F.broadcast(windows.select(F.explode_outer("seeds").alias("seed")).distinct())
    found = found.join(seeds, F.col("h") == F.col("seed"), kind).where(own | F.col("seed").isNotNull())
    behind = F.col("length") - F.ceil(F.col("length") / 2).cast("int")
    starts = F.when(own, F.array(F.lit(0))).otherwise(F.sequence(F.greatest(F.col("at") - behind, F.lit(1)), F.least(F.col("at"), n - F.col("length") + 1)))
    found = found.select("row_id", "doc_id", "w", "length", "at", F.explode_outer(starts).alias("start"))
    known = F.broadcast(windows.select("hash", F.col("digest").alias("known")))
    place, length = F.greatest(F.col("start"), F.lit(1)), F.coalesce("length", F.lit(0))
    found = found.join(known, run_hash(F.col("w"), place, length, length) == F.col("hash"), kind)
    # a hash that agrees by chance is found out by the SHA-256
    sure = F.col("known").isNotNull() & (F.col("known") == digest_of(F.col("w"), place, length))
    return found.where(own | sure).select("row_id", "doc_id", n.alias("n_words"), "at", "start", (F.col("start") + F.col("length")).alias("end"), F.col("known").alias("digest"))


def hits(docs: DataFrame, windows: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row_id, doc_id, n_words, spans, digests), one row a document, written.  Spans are (start, end) in words from 1, the end
    left out; digests name the windows.  ``row_col`` tells rows apart if the table has such a column."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = windows.select("hash", "length", "digest", "seeds").distinct()
    told = known.agg(F.count("*").alias("n"), F.collect_set("length").alias("lengths")).first()
    passes = max(1, -(-told["n"] // block))
    scans = [_scan(texts, known.where(F.pmod("hash", F.lit(passes)) == i), sorted(told["lengths"]), i == 0) for i in range(passes)]
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionByName(scan)
    span = F.when(F.col("at").isNotNull(), F.struct("start", "end"))
    return cut(every.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.collect_set("digest")).alias("digests")))


def words_hit(spans: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("till"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["till"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["till"], s["end"]).alias("till"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row a document."""
    windows = item_windows(benchmark, width)
    found = hits(docs, windows, block)
    kind = F.sha2(F.array_join(F.transform("digests", lambda d: F.hex(d)), ""), 256)
    found = found.withColumn("kind", F.when(F.size("digests") > 0, kind))
    kinds = found.where("kind is not null").groupBy("kind").agg(F.first("digests").alias("digests"))
    items = (
        kinds.select("kind", F.explode("digests").alias("digest")).join(windows.select("digest", "item"), "digest")
        .groupBy("kind").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select("kind", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    )
    # documents without hits are dealt by their row, not to one task
    clean = found.withColumn("kind", F.coalesce("kind", F.col("row_id").cast("string")))
    return clean.join(items, "kind", "left").select(
        "doc_id", "n_words", words_hit(F.col("spans")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, block: int = BLOCK,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that hold a window (``remove="documents"``), or with the words inside windows, and what
    stands before each of them, taken out of the texts (``"spans"``).  All columns stay."""
    row = free_name(docs, "row_id")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = hits(numbered, item_windows(benchmark, width), block, id_col, text_col, row).where(F.size("spans") > 0)
    if remove == "documents":
        return numbered.join(found.select(F.col("row_id").alias(row)), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    spans = free_name(numbered, "spans")
    joined = numbered.join(found.select(F.col("row_id").alias(row), F.col("spans").alias(spans)), row, "left")
    text = F.col(f"`{text_col}`")
    inside = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    numbers = F.array_except(F.sequence(F.lit(1), F.size(pieces)), inside)
    left = F.concat(F.array_join(F.transform(numbers, lambda i: F.element_at(pieces, i)), ""), F.regexp_extract(text, rf"{_GAP}*\z", 0))
    cleaned = joined.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(left))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])
