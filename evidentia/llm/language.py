"""Language identification with error-correcting output codes.

Every language has a codeword; a binary classifier on letter n-grams predicts each bit.  The language whose codeword
loses least is chosen, each bit weighed by how well it does for that language; a second one nearly as close makes the
answer ambiguous.  Learning takes a bounded sample: at most SAMPLE rows in all, or LEAST a language where there are so
many languages, of every language there is; the driver holds 8 KB a sampled row.  Prediction covers every row.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no labelled row everything is
``und``; rows that repeat an identifier or a text take their places in the sample like others; repeated rows get equal
answers; a null doc_id is not held out; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_of, share_of, short_batches, slices

SAMPLE, LEAST = 3000, 20
BUCKETS = 2048
#: Of the losses of two codewords; nearer than this is ambiguous.
GAP = 0.02


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point below 65536: its lower case if it is a letter, else 0."""
    table = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters, each run of anything else as one 0; a 0 at either end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _letters()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        c = chr(points[i])
        found[i] = ord(c.lower()[0]) if c.isalpha() else 0
    found = np.concatenate([[0], found, [0]]).astype(np.uint32)
    return found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of hashed bigram and trigram counts, scaled to length 1; None without a letter."""
    x = letters_of(text or "")
    if len(x) < 3:
        return None
    two = x[:-1] * np.uint32(2654435761) + x[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(3266489917) + x[2:] * np.uint32(668265263)
    buckets = np.concatenate([two * np.uint32(374761393) >> np.uint32(23), (three * np.uint32(2654435769) >> np.uint32(21)) % np.uint32(BUCKETS - 512) + np.uint32(512)])
    counts = np.sqrt(np.bincount(buckets, minlength=BUCKETS).astype(np.float32))
    return counts / np.linalg.norm(counts)


def codewords(count: int) -> np.ndarray:
    """A row of +1 and -1 for each class: all distinct splits for up to 6 classes, else the best of 200 seeded random codes."""
    if count <= 6:
        columns = [[1 - 2 * (n >> i & 1) for i in range(count)] for n in range(1, 1 << max(count - 1, 1))]
        return np.array([c for c in columns if len(set(c)) > 1] or [[1] * count], np.float32).T
    bits = int(np.ceil(10 * np.log2(count)))
    best, most = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (count, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(count)
        if apart.min() > most and (np.abs(code.sum(0)) < count).all():
            best, most = code, apart.min()
    return best


class LanguageModel:
    """Linear bit classifiers, codewords and weights."""

    def __init__(self, names: list[str], matrix: np.ndarray, classes: np.ndarray, ridge: float = 0.01) -> None:
        self.names, self.code = names, codewords(len(names))
        weight = np.sqrt(1.0 / np.maximum(np.bincount(classes, minlength=len(names)), 1))[classes][:, None]
        size = matrix.shape[1] + 1
        left, right = ridge * np.eye(size), np.zeros((size, self.code.shape[1]))
        for at in range(0, len(matrix), 256):
            # a few rows at a time in doubles
            own = weight[at : at + 256]
            x = np.hstack([matrix[at : at + 256], np.ones((len(own), 1), np.float32)]) * own
            left += x.T @ x
            right += x.T @ (self.code[classes[at : at + 256]] * own)
        self.w = np.linalg.solve(left, right)
        self.w = self.w.astype(np.float32)
        right = np.sign(self.margins(matrix)) == self.code[classes]
        good = np.array([right[classes == i].mean(0) if (classes == i).any() else np.ones(right.shape[1]) for i in range(len(names))])
        self.weight = (good + 1e-3) / (good + 1e-3).sum(1, keepdims=True)

    def margins(self, matrix: np.ndarray) -> np.ndarray:
        return np.clip(matrix @ self.w[:-1] + self.w[-1], -2, 2)

    def decode(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score and gap to the second class for each row."""
        f = self.margins(matrix)
        loss = np.stack([(self.weight[i] * np.exp(-self.code[i] * f)).sum(1) for i in range(len(self.names))], 1)
        order = np.argsort(loss, 1, kind="stable")
        best = np.take_along_axis(loss, order[:, :1], 1)
        score = 1 / np.exp(-4 * (loss - best)).sum(1)
        gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - best[:, 0] if len(self.names) > 1 else np.full(len(loss), np.inf)
        return order[:, 0], score, gap


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Learn from the usable rows that have a language."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("place"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(LEAST, sample // len(counts))
    shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * each / n)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, features(t)) for k, t in zip(batch.column("lang").to_pylist(), (t for some in slices(batch.column("text")) for t in some), strict=True)]
            found = [(k, x.astype(np.float32).tobytes()) for k, x in found if x is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([x for _, x in found], pa.binary())], names=["lang", "x"])

    # a share of about half as many again as are wanted, of which the first of each language are taken exactly
    near = rows.where(share_of(F.col("place")) < F.element_at(shares, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("place", "text")
    chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)
    got = chosen.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    names = sorted({r["lang"] for r in got})
    classes, matrix = np.array([names.index(r["lang"]) for r in got]), np.empty((len(got), BUCKETS), np.float32)
    while got:
        matrix[len(got) - 1] = np.frombuffer(got.pop()["x"], np.float32)
    return LanguageModel(names, matrix, classes)


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", gap: float = GAP) -> Column:
    """A column of struct(lang_pred, score, ambiguous)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    short_batches()

    def answer(texts: pa.Array) -> pa.Array:
        m, at = shared.value, 0
        names, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for some in slices(texts) if m else ():
            found = [(at + i, x) for i, x in enumerate(map(features, some)) if x is not None]
            if found:
                best, score, gaps = m.decode(np.stack([x for _, x in found]))
                for (i, _), b, s, g in zip(found, best, score, gaps, strict=True):
                    names[i], scores[i], unsure[i] = m.names[b], s, g < gap
            at += len(some)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)], ["lang_pred", "score", "ambiguous"])

    return F.arrow_udf(answer, "lang_pred string, score double, ambiguous boolean")(F.col(text_col))


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn outside one fold of the identifiers' checksums, and answer for every row."""
    held = F.coalesce(crc_of(F.col(id_col)) % folds == fold, F.lit(False))
    model = fit(docs, ~held, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), predict(docs, model, text_col).alias("p")).select("doc_id", "held_out", "p.*")
