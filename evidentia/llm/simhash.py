"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is split into four blocks of 16 bits.  Fingerprints that differ in at most two bits agree on at
least two blocks, so the six pairs of blocks are the join keys; pairs that meet are verified by Hamming distance.
A key that many fingerprints share is not expanded into pairs: each of its fingerprints is sent to itself and to its
neighbours at one bit within the other 32 bits.  Two fingerprints that differ in at most two bits always meet at one of
these places, at most 33 distinct ones can meet there, and any two that meet differ in at most two bits.  So hot keys
are exact too, and each costs rows in proportion to its fingerprints.  Distinct fingerprints are linked, not documents.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows and equal texts fall
in one component; a null doc_id stays null and names no component, unless a component has no other; an empty table gives
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, free_name, per_text

#: Keys with more fingerprints than this are handled by neighbours instead of pairs.
HOT = 64
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def digests(text: str | None, width: int = 3, seed: int = 42) -> list[int]:
    """The hash of each run of ``width`` words, or of all words where they are fewer; none without words."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).translate(_SPACES).split(b" ") if w]
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number; zero without words."""
    hashes = np.array(digests(text, width, seed), ">u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long of the same 64 bits."""

    def print_of(text: str | None) -> int:
        found = simhash(text, width)
        return found - (1 << 64) if found >> 63 else found

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), per_text(print_of, "long", pa.int64())(text_col).alias("fp"))


def _keys() -> list[tuple[int, int]]:
    """(number, mask) of the six pairs of blocks."""
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    masks = [blocks[i] | blocks[j] for i in range(4) for j in range(i)]
    return [(n, m - (1 << 64) if m >> 63 else m) for n, m in enumerate(masks)]


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints whose transitive closure is that of all pairs that differ in one or two bits."""
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("mask")) for n, m in _keys()])
    blocks = fps.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.n").alias("n"), F.col("k.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("part"))
    counts = cut(blocks.groupBy("n", "part").agg(F.count("*").alias("size")).where("size > 1"))
    met = cut(blocks.join(counts, ["n", "part"]))
    cold = met.where(F.col("size") <= hot).select("n", "part", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = cold.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b"), ["n", "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    places = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    spread = (
        met.where(F.col("size") > hot)
        .select("fp", "n", F.explode(F.filter(places, lambda p: p.bitwiseAND(F.col("mask")) == 0)).alias("flip"))
        .select("n", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
        .groupBy("n", "place")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b"))
        .where("a <> b")
    )
    return pairs.unionByName(spread).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) for nodes that have edges (a, b): the least node of each component, by least labels and jumps.

    Each round takes the least label among neighbours, then the label of that label, so rounds grow with the logarithm
    of a component's width; every round's table is written, and both sides of each join are written tables."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("seen")).withColumnRenamed("a", "node")
        stepped = cut(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")))
        heads = stepped.select(F.col("node").alias("label"), F.col("label").alias("head"))
        labels, found = counted(stepped.join(heads, "label").select("node", "old", F.least("label", "head").alias("label")), moved=F.count_if(F.col("label") != F.col("old")))
        if not found["moved"]:
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): each document's component is named by its smallest doc_id."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges, found = counted(links(fps.select("fp"), hot))
    labels = components(fps, edges) if found["rows"] else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    classes = cut(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    named = cut(classes.groupBy("label").agg(F.min("first").alias("component_id")))
    classes = cut(classes.join(named, "label").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def united(found: DataFrame, near: DataFrame, row: str) -> DataFrame:
    """(row, component_id) of the components that the links of both tables (row, component_id) make together; a component is
    named by its least row.  Only rows that ``near`` puts under another row can unite components."""
    found = cut(found)
    own = lambda i, name: found.select(F.col(row).alias(i), F.col("component_id").alias(name)).hint("merge")
    moved = near.select(F.col(row).alias("i"), F.col("component_id").alias("j")).where("i <> j")
    edges, n = counted(moved.join(own("i", "a"), "i").join(own("j", "b"), "j").where("a <> b").select("a", "b").distinct())
    if not n["rows"]:
        return found
    labels = components(found, edges).withColumnRenamed("node", "component_id").hint("merge")
    return found.join(labels, "component_id", "left").select(row, F.coalesce("label", "component_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each component: that of the least doc_id (nulls last), then of the least hash of its text.

    Rows are linked by their fingerprints, as in op9; with a similarity, also by the Jaccard similarity of their runs of
    ``width`` words, since near copies of a few changed words differ in more than two bits.
    Rows are told apart by a written number, not by doc_id, so a null or repeated doc_id costs no row."""
    row = free_name(docs, "row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(rows, row, text_col).select(F.col("doc_id").alias(row), "component_id")
    if similarity is not None:
        from .shingles import near_copies

        found = united(found, near_copies(rows, row, text_col, width, similarity), row)
    ranks = rows.select(row, F.col(id_col).isNull().alias("last"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("hash"))
    order = F.struct("last", "own", "hash", row)
    kept = cut(found.join(ranks.hint("merge"), row).groupBy("component_id").agg(F.min(order)[row].alias(row)).select(row))
    # the identifiers grow with the documents, so both sides are shuffled at every size
    return rows.join(kept.hint("merge"), row, "left_semi").drop(row)
