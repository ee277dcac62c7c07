"""A manifest of a dataset as a content-addressed tree of digests, and proofs by descent from its root.

Each row is a leaf, the SHA-256 of its fields.  The leaves of a source, in the order of identifiers, are hashed in runs of
three, level by level, until one node is left; these subroots, in the order of the sources, are hashed likewise up to the
root.  What is stored is a record of each inner node: its digest, and the digests of its children.  A record is found by
its digest alone, so equal subtrees are stored once.

A proof is asked for by place: a source's number and the leaf's rank in it.  Requests start at the root together and go
down level by level; each level is one join of digests with records, in which the next ternary digit of the place says
which child goes on and the others are collected as a segment of the path.  Requests that share a path go down it as one,
so that a level has no more rows than its tree has nodes and no digest is asked for by many rows.  At the leaf the segments
are reversed: from the leaf up to the root, left to right.

Ranks come from a range partitioning of narrow rows (digests, not texts), so a source may hold any share of the rows.  A
level is one shuffle for three levels of digests, grouped by 27 neighbours.  Texts are read once and never shuffled.

Defined results: a null field counts as ``-``, whatever its type; leaves with a null identifier come first in their
source, equal identifiers are ordered by leaf; equal rows have places of their own, and which of them has which is
arbitrary (their results differ only by the place); the null source comes first; rows with a null identifier are not
tampered with; texts without line feeds stay as they are; a source of one row has its leaf as subroot, and a single source
its subroot as root; extra columns are ignored; an empty table has no root and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, cut
from .mixing import ranked

ARITY = 3
#: Levels of a tree that one shuffle makes.
LEVELS = 3
#: Levels of a descent between written tables.
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def height_of(size: int) -> int:
    """Levels above so many leaves."""
    height = 0
    while size > 1:
        size, height = -(-size // ARITY), height + 1
    return height


def without_line_feeds(docs: DataFrame) -> Column:
    """The tampered text: of rows whose identifier has an even CRC-32 the line feeds go."""
    return F.when(crc_of(F.col("doc_id")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def leaves(docs: DataFrame, tampered_text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source, doc_id, leaf, tampered), one row a document, written.  ``tampered`` is the leaf of the row with the other text."""
    other = F.col("text") if tampered_text is None else tampered_text
    rows = docs.select(*fields, other.alias("__other") if "__other" not in fields else other)
    leaf = digest(*[encoded(F.col(c)) for c in fields])
    changed = digest(*[encoded(F.col("__other") if c == "text" else F.col(c)) for c in fields])
    rows = rows.select("source", "doc_id", leaf.alias("leaf"), F.when(~F.col("__other").eqNullSafe(F.col("text")), changed).alias("changed"))
    return cut(rows.select("source", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("tampered")))


def _runs(digests: Column) -> Column:
    """The digests of the runs of an array."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(ARITY))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(digests, i, ARITY), ""), 256))


def build(nodes: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """From (tree, size, idx, digest), the lowest nodes of trees with at most ``most`` of them, the records (height, digest,
    children), each once, and the heads (tree, height, digest).  Written."""
    records, heads, below = [], [nodes.where("size = 1").select("tree", F.lit(0).alias("height"), "digest")], 0
    while most > 1:
        step = ARITY**LEVELS
        blocks = (
            nodes.where("size > 1").groupBy("tree", "size", F.floor(F.col("idx") / step).alias("idx"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "digest"))), lambda x: x["digest"]).alias("level0"))
        )
        # each level is a column of its own, so that it is hashed once
        for k in range(LEVELS):
            more = F.ceil(F.col("size") / ARITY**k) > 1
            blocks = blocks.withColumn(f"level{k + 1}", F.when(more, _runs(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
        blocks = cut(blocks)
        found = []
        for k in range(LEVELS):
            parents = F.transform(f"level{k + 1}", lambda d, i: F.struct(F.lit(below + k + 1).alias("height"), d.alias("digest"), F.slice(f"level{k}", i * ARITY + 1, ARITY).alias("children")))  # noqa: B023
            found.append(blocks.where(F.ceil(F.col("size") / ARITY**k) > 1).select(F.explode(parents).alias("record")))
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        records.append(cut(found[0].select("record.*").dropDuplicates(["height", "digest"])))
        nodes = blocks.select("tree", F.ceil(F.col("size") / step).alias("size"), "idx", F.element_at(f"level{LEVELS}", 1).alias("digest"), F.col("size").alias("was"))
        grown = F.lit(below) + sum(((F.ceil(F.col("was") / ARITY**k) > 1).cast("int") for k in range(LEVELS)), F.lit(0))
        heads.append(nodes.where("size = 1").select("tree", grown.alias("height"), "digest"))
        nodes, below, most = nodes.drop("was"), below + LEVELS, -(-most // step)
    store = records[0] if records else None
    for more in records[1:]:
        store = store.unionByName(more)
    every = heads[0]
    for more in heads[1:]:
        every = every.unionByName(more)
    return store, every


def descend(starts: DataFrame, store: DataFrame | None, top: int, wanted: DataFrame | None = None) -> DataFrame:
    """From (tree, idx, height, digest, path), the nodes where descents start, the leaves (tree, idx, digest, path) below them
    that are wanted, by (tree, idx); all of them if nothing is said.  A path runs downwards and is added to."""
    if wanted is not None:  # every place on the way to a wanted leaf, once
        upward = F.explode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda h: F.struct(h.alias("height"), F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), h)).alias("idx"))))
        wanted = cut(wanted.select("tree", upward.alias("place")).select("tree", "place.*").distinct())
    at: DataFrame | None = None
    for height in range(top, 0, -1):
        here = starts.where(F.col("height") == height).drop("height")
        at = here if at is None else at.unionByName(here)
        known = store.where(F.col("height") == height).select(F.col("digest").alias("node"), "children")
        child = at.join(known, F.col("digest") == F.col("node")).select("tree", "idx", "path", "children", F.posexplode_outer("children").alias("digit", "digest"))
        joined = lambda start, n: F.unhex(F.array_join(F.slice("children", start, n), ""))
        segment = F.struct(joined(F.lit(1), F.col("digit")).alias("before"), joined(F.col("digit") + 2, F.lit(ARITY)).alias("after"))
        at = child.select("tree", (F.col("idx") * ARITY + F.col("digit")).alias("idx"), "digest", F.concat("path", F.array(segment)).alias("path"))
        if wanted is not None:
            at = at.join(wanted.where(F.col("height") == height - 1).drop("height"), ["tree", "idx"], "left_semi")
        if height % STRIDE == 0:
            at = cut(at)
    last = starts.where("height = 0").drop("height")
    if wanted is not None:
        last = last.join(wanted.where("height = 0").drop("height"), ["tree", "idx"], "left_semi")
    return last if at is None else at.unionByName(last)


def manifest(rows: DataFrame) -> dict:
    """From ``leaves``: ``root`` (None for an empty table), ``places`` (tree, idx, source, doc_id, leaf, tampered), ``subroots`` (tree,
    height, subroot), ``sources`` (tree, source, size), the ``store`` of records below subroots, the ``crown`` of those above, and
    the heights of both."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    placed = cut(ranked(rows.withColumn("tie", F.monotonically_increasing_id()), *order).drop("tie"))
    counted = placed.groupBy("source").agg(F.count("*").alias("size"), F.min("rank").alias("first"))
    sources = cut(ranked(counted, F.col("first").asc()).withColumnRenamed("rank", "tree"))
    told = sources.agg(F.max("size").alias("most"), F.count("*").alias("n")).first()
    if not told["n"]:
        return {"root": None}
    its = sources.select(F.col("source").alias("its"), "tree", "size", "first")
    places = placed.join(its, F.col("source").eqNullSafe(F.col("its"))).select("tree", "size", (F.col("rank") - F.col("first")).alias("idx"), "source", "doc_id", "leaf", "tampered")
    places = cut(places)
    store, heads = build(places.select("tree", "size", "idx", F.col("leaf").alias("digest")), told["most"])
    subroots = cut(heads)
    crown, head = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(told["n"]).cast("long").alias("size"), F.col("tree").alias("idx"), "digest"), told["n"])
    root = head.first()["digest"]
    return {"root": root, "places": places.drop("size"), "subroots": subroots.withColumnRenamed("digest", "subroot"), "sources": sources.select("tree", "source", "size"),
            "store": store, "crown": crown, "height": height_of(told["most"]), "crown_height": height_of(told["n"])}


def prove(tree: dict, wanted: DataFrame | None = None) -> DataFrame:
    """(tree, idx, digest, subroot, path) of the leaves asked for by (tree, idx), all by default; the path's segments run from the
    leaf up, each with the siblings before and after it."""
    spark = tree["places"].sparkSession
    top = spark.createDataFrame([(0, 0, tree["crown_height"], tree["root"])], "tree long, idx long, height int, digest string").withColumn("path", F.array().cast(PATH))
    asked = None if wanted is None else wanted.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx")).distinct()
    above = descend(top, tree["crown"], tree["crown_height"], asked).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "path")
    starts = above.join(tree["subroots"].select("tree", "height"), "tree").select("tree", F.lit(0).cast("long").alias("idx"), "height", F.col("subroot").alias("digest"), "path")
    found = descend(cut(starts), tree["store"], tree["height"], wanted)
    return found.join(tree["subroots"].select("tree", "subroot"), "tree").withColumn("path", F.reverse("path"))


def siblings(path: Column) -> Column:
    """The proof's digests as one text, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.lower(F.hex(s["before"])), F.lower(F.hex(s["after"])))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(F.lower(F.hex(s["before"])), acc, F.lower(F.hex(s["after"]))), 256))


def verify(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a document: does the row with the other text
    (``without_line_feeds`` by default) still lead to the root?"""
    tree = manifest(leaves(docs, without_line_feeds(docs) if tampered_text is None else tampered_text))
    if tree["root"] is None:
        return docs.limit(0).select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
    proofs = prove(tree).select("tree", "idx", "subroot", "path")
    rows = proofs.join(tree["places"], ["tree", "idx"])
    rows = rows.select("doc_id", "leaf", "subroot", F.lit(tree["root"]).alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
