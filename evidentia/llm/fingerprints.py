"""Document fingerprints by winnowing.

The hash of every run of ``k`` code points (A-Z in lower case) is taken; of each ``window`` successive hashes the least is
kept with its position, the rightmost where several are least.  Two texts that share a passage of ``window + k - 1`` code
points share a kept hash; matches shorter than ``k`` leave no trace.

Defined results: null counts as empty; an empty text has an empty fingerprint; a text shorter than ``k`` has one hash, of
the whole; fewer hashes than ``window`` make one window.  Equal texts have equal fingerprints; repeated rows are
separate documents, ordered by their text within an identifier; null identifiers come last; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Runs shorter than K are noise; passages of K + WINDOW - 1 = 100 code points are certain to match.
K, WINDOW = 32, 69
_BASE = 0x9E3779B97F4A7C15
#: Windows handled at once, so that memory doesn't grow with a text.
_STRIDE = 1 << 18
_LEAST_LONG = -(1 << 63)


def code_points(text: str) -> np.ndarray:
    """Code points, A-Z as a-z."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 65) & (points <= 90), points + 32, points)


def _rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each run of k code points: a polynomial by doubling, then mixed."""
    power, base = points.astype(np.uint64) + np.uint64(1), _BASE
    done, total, left, length = None, 0, k, 1
    while left:
        if left & 1:
            if done is None:
                done, total = power, length
            else:
                n = len(points) - total - length + 1
                done = done[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + power[total : total + n]
                total += length
        left >>= 1
        if left:
            power = power[:-length] * np.uint64(base) + power[length:]
            base, length = base * base % (1 << 64), 2 * length
    done = (done ^ (done >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    done = (done ^ (done >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return done >> np.uint64(32)


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of each window, by doubling."""
    size = 1
    least = keys
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = window - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions (code points from the start), in order of position."""
    points = code_points(text or "")
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    k = min(k, len(points))
    grams = len(points) - k + 1
    window = min(window, grams)
    kept: list[np.ndarray] = []
    for start in range(0, grams - window + 1, _STRIDE):
        end = min(start + _STRIDE, grams - window + 1)
        hashes = _rolling(points[start : end + window + k - 2], k)
        back = np.uint64(0xFFFFFFFF) - np.arange(start, start + len(hashes), dtype=np.uint64)
        least = _least((hashes << np.uint64(32)) | back, window)
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        kept.append(least[1:] if kept and kept[-1][-1] == least[0] else least)
    keys = np.concatenate([x for x in kept if len(x)])
    return (keys >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def to_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """16 hexadecimal digits for each kept hash: the hash, then its position."""
    both = np.empty((len(hashes), 2), ">u4")
    both[:, 0], both[:, 1] = hashes, positions
    return both.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared among all distinct hashes; 1 if neither has any."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many code points, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks_per_partition: int = 8) -> DataFrame:
    """Rows (block, look, id, text), to be sorted within a block: a block is a range of identifiers, and a row with look
    true is the first document of the following block.  The text is shuffled once; the driver holds a few numbers a block."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("at", F.coalesce("id", F.lit(_LEAST_LONG)))
    count = blocks_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, count)]
    bounds = docs.agg(F.percentile_approx("at", shares, 10 * count).alias("x")).first()["x"] if count > 1 else None
    cuts = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def block(at: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, at.to_numpy(np.int64), "right")).astype(np.int32))

    first = {r["block"]: r["at"] for r in docs.select("at", block("at").alias("block")).groupBy("block").agg(F.max("at").alias("at")).collect()}
    order = sorted(first)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(at: pd.Series) -> pd.Series:
        own = (len(cuts) - np.searchsorted(cuts, at.to_numpy(np.int64), "right")).tolist()
        return pd.Series([[b, before[b]] if first[b] == a else [b] for a, b in zip(at.tolist(), own, strict=True)])

    return (
        docs.select("id", "text", "at", F.posexplode(places("at")).alias("look", "block"))
        .select("block", (F.col("look") == 1).alias("look"), "id", "at", "text")
        .repartition("block")
        .sortWithinPartitions("block", "look", F.desc("at"), F.desc_nulls_last("id"), "text")
    )


def fingerprint_edits(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and how alike they and the following document's are."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_hashes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, its_block = None, None
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for block, look, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "look", "id", "text")), strict=True):
                if block != its_block:
                    waiting, its_block = None, block
                if look and waiting is None:
                    continue
                now = (doc_id, text, *winnow(text, k, window))
                if waiting is not None:
                    own, own_text, hashes, positions = waiting
                    changed = edited(own_text, text)
                    its_hashes, its_positions = winnow(changed, k, window)
                    rows.append((own, len(own_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(hashes, positions),
                                 to_text(its_hashes, its_positions), likeness(hashes, its_hashes), likeness(hashes, now[2]), len(hashes)))
                    size += 16 * (len(hashes) + len(its_hashes))
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                waiting = None if look else now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    short_batches()
    return with_following(docs, id_col, text_col).drop("at").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long")
