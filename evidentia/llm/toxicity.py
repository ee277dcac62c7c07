"""A toxicity classifier with a counterfactual penalty.

Runs of WIDTH bytes of lower-case words whose presence tells toxic from other rows are chosen over a bounded sample of
labelled rows (at most SAMPLE), then a logistic model on their presence is fitted.  In each sentence of a labelled text
that names a group of people, the identity terms (of four languages) are swapped for others of their kind; the squared
change of the linear score is added to the loss, so that naming a group moves no score.  The model tells how many such
``pairs`` it was fitted with.  Scoring covers every row, where it lies.

Defined results: null and empty texts get the score of no words; without labelled rows of both kinds every score is
about 1 if all are toxic, else about 0; repeated rows get equal scores, in the sample equal texts count once and are
toxic if any of them is; a null doc_id matches no label and is not held out; other columns of the documents, whatever
their names, play no part; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, cut, per_text

SAMPLE, FEATURES, LEAST_DOCS, LEAST_Z, WIDTH = 12_000, 3000, 4, 5.0, 5
RIDGE, PENALTY = 3e-4, 1.0
#: Groups of terms of which one may stand for another, in English, French, German and Spanish.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("old", "young"), ("disabled", "blind", "deaf"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("noir", "blanc", "asiatique", "arabe", "africain", "européen"), ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("homosexuel", "hétérosexuel", "bisexuel", "transgenre"), ("lesbienne", "gaie"),
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("filles", "garçons"),
    ("immigré", "réfugié", "citoyen"), ("immigrés", "réfugiés", "citoyens"), ("vieux", "jeune"), ("handicapé", "aveugle", "sourd"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch", "atheistisch"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"), ("schwul", "lesbisch", "heterosexuell", "bisexuell", "transgender"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("einwanderer", "flüchtling", "bürger"), ("alt", "jung"), ("behindert", "blind", "taub"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"), ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("homosexual", "heterosexual", "bisexual", "transgénero"), ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("niñas", "niños"),
    ("inmigrante", "refugiado", "ciudadano"), ("inmigrantes", "refugiados", "ciudadanos"), ("viejo", "joven"), ("discapacitado", "ciego", "sordo"),
)
_SENTENCE = re.compile(r"[.!?\n\r\u2028\u2029\u3002]+")
_OTHER = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
_ASCII = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; signs and digits part them."""
    text = (text or "").lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_ASCII).split()


def following(groups: tuple[tuple[str, ...], ...]) -> dict[bytes, bytes]:
    """For each term the next of its group; a term of several groups keeps its first."""
    found: dict[bytes, bytes] = {}
    for g in groups:
        for a, b in zip(g, g[1:] + g[:1], strict=True):
            found.setdefault(a.encode(), b.encode())
    return found


def swapped(text: str | None, terms: dict[bytes, bytes]) -> list[tuple[bytes, bytes]]:
    """The sentences (as words) that hold an identity term, each beside the one with its terms replaced; each once."""
    pairs = {}
    for sentence in _SENTENCE.split(text or ""):
        words = words_of(sentence)
        if not terms.keys().isdisjoint(words):
            pairs[b" ".join(words)] = b" ".join([terms.get(w, w) for w in words])
    return sorted(pairs.items())


def grams(words: list[bytes]) -> np.ndarray:
    """Distinct runs of WIDTH bytes of the words with single spaces between and around them, as numbers."""
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    if len(x) < WIDTH:
        return np.zeros(0, np.int64)
    key = x[: len(x) - WIDTH + 1]
    for i in range(1, WIDTH):
        key = key << 8 | x[i : len(x) - WIDTH + 1 + i]
    return np.unique(key)


class ToxicityModel:
    """Byte runs (sorted) with their weights, and the score of none."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float, pairs: int = 0) -> None:
        self.known, self.weights, self.bias, self.pairs = known, weights, bias, pairs
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._short(known)] = True

    @staticmethod
    def _short(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 20) & 0xFFFF

    def find(self, words: list[bytes]) -> np.ndarray:
        """Which of the known runs occur."""
        x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        found: list[np.ndarray] = []
        for at in range(0, len(x) - WIDTH + 1, 1 << 16):
            part = x[at : at + (1 << 16) + WIDTH - 1].astype(np.int64)
            key = part[: len(part) - WIDTH + 1]
            for i in range(1, WIDTH):
                key = key << 8 | part[i : len(part) - WIDTH + 1 + i]
            found.append(key[self.maybe[self._short(key)]])
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        places = np.searchsorted(self.known, keys)
        places, keys = places[places < len(self.known)], keys[places < len(self.known)]
        return places[self.known[places] == keys]

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.find(words_of(text))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _fit_logistic(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], size: int, ridge: float, penalty: float, steps: int = 300) -> np.ndarray:
    """Weights, the bias last, by Adam's steps over all rows on loss + ridge + penalty * mean squared change of score."""
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    sides = [x for pair in pairs for x in pair]
    what = np.concatenate([np.zeros(0, np.int64), *sides])
    who = np.repeat(np.arange(len(sides)) // 2, [len(x) for x in sides])
    sign = np.repeat(1.0 - 2.0 * (np.arange(len(sides)) % 2), [len(x) for x in sides])
    w, mean, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[flat], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(rows)
        gradient = np.append(np.bincount(flat, error[owner], size), error.sum()) + ridge * np.append(w[:-1], 0)
        if pairs:
            moved = np.bincount(who, sign * w[what], len(pairs))
            gradient[:size] += 2 * penalty / len(pairs) * np.bincount(what, sign * moved[who], size)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w - 0.1 * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, groups: tuple[tuple[str, ...], ...] = IDENTITY,
        ridge: float = RIDGE, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from at most ``sample`` usable labelled rows, chosen by a hash of the identifier."""
    marks = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = cut(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    terms = following(groups)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pairs = [swapped(t, terms) for t in texts]
            columns = [pa.array([b" ".join(words_of(t)) for t in texts], pa.binary()),
                       *(pa.array([[p[side] for p in found] for found in pairs], pa.list_(pa.binary())) for side in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], names=["toxic", "words", "own", "other"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [grams(w.split()) for w in batch.column("words").to_pylist()]
            keys, where = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_inverse=True)
            bad = np.repeat(batch.column("toxic").to_numpy().astype(float), [len(x) for x in own])
            numbers = [pa.array(x.astype(np.int64)) for x in (keys, np.bincount(where, minlength=len(keys)), np.bincount(where, bad, len(keys)))]
            yield pa.RecordBatch.from_arrays(numbers, names=["gram", "docs", "bad"])

    # the labels are at most SAMPLE rows, so they go to the documents
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("text", "toxic")
    cleaned = texts.mapInArrow(clean, "toxic int, words binary, own array<binary>, other array<binary>")
    distinct = cleaned.groupBy("words").agg(F.max("toxic").alias("toxic"), F.max(F.struct("own", "other")).alias("pairs")).select("words", "toxic", "pairs.*")
    # an identifier that many documents share could bring more texts than labels
    rows = cut(distinct.orderBy(F.xxhash64("words"), "words").limit(sample))
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, positive = total["n"], total["toxic"] or 0
    if not positive or positive == n:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 40.0 if positive else -40.0)
    p = positive / n
    seen = rows.select("toxic", "words").mapInArrow(count, "gram long, docs long, bad long").groupBy("gram").agg(F.sum("docs").alias("docs"), F.sum("bad").alias("bad"))
    z = (F.col("bad") - F.col("docs") * p) / F.sqrt(F.col("docs") * p * (1 - p))
    told = seen.where((F.col("docs") >= LEAST_DOCS) & (F.abs(z) >= LEAST_Z)).orderBy(F.desc(F.abs(z)), "gram").limit(FEATURES).collect()
    named = grams([t.encode() for g in groups for t in g])
    known = np.unique(np.concatenate([np.array([r["gram"] for r in told], np.int64), named]))
    finder = ToxicityModel(known, np.zeros(len(known)), 0.0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lambda w: finder.find(w.split()).astype(np.uint16).tobytes()
        for batch in batches:
            columns = [pa.array([found(w) for w in batch.column("words").to_pylist()], pa.binary()),
                       *(pa.array([[found(w) for w in ws] for ws in batch.column(c).to_pylist()], pa.list_(pa.binary())) for c in ("own", "other"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], names=["toxic", "words", "own", "other"])

    # two bytes a feature found, of at most SAMPLE rows
    numbered = rows.select("toxic", "words", "own", "other").mapInArrow(number, "toxic int, words binary, own array<binary>, other array<binary>")
    got = sorted((r["toxic"], bytes(r["words"]), [(bytes(a), bytes(b)) for a, b in zip(r["own"], r["other"], strict=True)]) for r in numbered.toLocalIterator())
    numbers = lambda x: np.frombuffer(x, np.uint16).astype(np.int64)
    pairs = [(numbers(a), numbers(b)) for _, _, found in got for a, b in found]
    w = _fit_logistic([numbers(x) for _, x, _ in got], np.array([y for y, _, _ in got], float), pairs, len(known), ridge, penalty)
    return ToxicityModel(known, w[:-1], float(w[-1]), len(pairs))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """A double column from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return per_text(lambda t: shared.value.score(t), "double", pa.float64())(text_col)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learn outside one fold of the identifiers' checksums, and score every row."""
    held = F.coalesce(crc_of(F.col(id_col)) % folds == fold, F.lit(False))
    model = fit(docs, labels, ~F.coalesce(crc_of(F.col("doc_id")) % folds == fold, F.lit(False)), id_col=id_col, text_col=text_col, **options)
    scored = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), score(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
