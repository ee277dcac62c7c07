"""Packing token pieces into sequences by multiway Karmarkar-Karp differencing.

Documents are tokenised once, where they lie.  Each is cut at multiples of the capacity; what is left is cut into pieces
of at most ``cut_to`` tokens, so that a window takes several pieces and comes out near-equal.  Only the pieces' lengths
and checksums are shuffled, dealt by a hash of their row and place into groups of bounded size.  In a group of total length S the
windows number ceil(S / capacity) at first; the differencing repeatedly takes the two partial partitions with the
greatest imbalance and adds the larger windows of one to the smaller of the other; the number rises by one whenever a
window exceeds the capacity.

Defined results: a null or empty text has the end token alone; repeated rows are separate documents, told apart by
``row_id``, a number of each row of the table; null identifiers stay null; extra columns are ignored; an empty table gives
no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, slices
from .tokens import default_path, word_encoder

CAPACITY, CUT_TO, END_ID = 2048, 512, 1
#: Pieces in a group, about: enough for near-equal windows, few for one task.
GROUP_PIECES = 4096
_PIECE = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def karmarkar_karp(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of the sizes in each of the ways; a partial partition lists its nonempty windows as (sum, node), least first."""
    nodes: list[tuple[int, int] | None] = [None] * len(sizes)

    def joined(a: int, b: int) -> int:
        nodes.append((a, b))
        return len(nodes) - 1

    def spread(part: list[tuple[int, int]]) -> int:
        return part[-1][0] - (part[0][0] if len(part) == ways else 0)

    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)] if ways > 1 else [(0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        if len(b) == 1:
            size, node = b[0]
            if len(a) == ways:
                least, its = a.pop(0)
                size, node = least + size, joined(its, node)
            insort(a, (size, node))
            merged = a
        else:
            over = len(a) + len(b) - ways
            merged = a[max(over, 0) :] + b[max(over, 0) :] if over > 0 else a + b
            # the larger windows of a stand against the empty ones of b, and the other way round; the rest meet, large with small
            merged += [(x + y, joined(p, q)) for (x, p), (y, q) in zip(a[: max(over, 0)], reversed(b[: max(over, 0)]), strict=True)]
            merged.sort()
        heapq.heappush(heap, (-spread(merged), turn, merged))
        turn += 1
    ways_out: list[list[int]] = []
    for _, root in heap[0][2] if heap else []:
        leaves, stack = [], [root]
        while stack:
            node = nodes[top := stack.pop()]
            if node is None:
                leaves.append(top)
            else:
                stack.extend(node)
        ways_out.append(sorted(leaves))
    return ways_out


def pack_lengths(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most the capacity each."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = karmarkar_karp(sizes, ways)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        ways += 1


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cut_to: int = CUT_TO, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, start, length, ids_crc32, doc_tokens): how each document's ids are cut, with the checksum of each piece."""
    path = path or default_path()
    short_batches()
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            rows = []
            for row_id, doc_id, text in zip(batch.column("row_id").to_pylist(), batch.column("id").to_pylist(), (t for some in slices(batch.column("text")) for t in some), strict=True):
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                full = len(ids) // capacity * capacity
                starts = [*range(0, full, capacity), *range(full, len(ids), cut_to)]
                for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                    rows.append((row_id, doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECE)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cut_to: int = CUT_TO, end_id: int = END_ID,
         group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with the sequence they go to and their place in it."""
    found = cut(pieces(docs, path, capacity, cut_to, end_id, id_col, text_col))
    groups = max(1, -(-found.count() // group_pieces))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "row_id")])
        lengths = group.column("length").to_numpy()
        whole = np.flatnonzero(lengths == capacity)
        rest = np.flatnonzero(lengths < capacity)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        sequence[whole] = np.arange(len(whole))
        for n, window in enumerate(pack_lengths(lengths[rest].tolist(), capacity) if len(rest) else []):
            at = rest[window]
            sequence[at] = len(whole) + n
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        first = group.column("grp")[0].as_py() * (1 << 32)
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    dealt = found.withColumn("grp", F.pmod(F.xxhash64("row_id", "start"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInArrow(place, _PIECE + ", sequence_id long, offset long")
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id")
