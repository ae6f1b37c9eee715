"""Quality classifier by co-training of two views of a document.

The text view has the presence of the words and beginnings of words that tell the labels apart and measures of style; the metadata view has
source, lang and n_chars. Both are logistic regressions. In each round a view labels documents of an unlabelled pool on
which it is confident, and the other view learns from them: confident means beyond the calibrated score from which the
view was right at least PRECISION of the time on documents set aside. In the end each view's score is calibrated on those,
the two are combined by a further logistic regression, and all documents are scored whole.

The same is done for two labels: quality (1: good) and toxic (1: toxic). A document is kept if it is likely good and not
likely toxic. Models are fitted on bounded samples, chosen by a hash of doc_id: about PER_KIND documents of each value of each
label, weighted by the inverse of their share, and POOL others; of rows with one doc_id, or with none, one is drawn. A hash parts the labelled ones in FOLDS: most teach, CONFIDENCE
sets the bounds of confidence, CALIBRATION the calibration and the combination. What leaves the executors are
counts of words and bounded vectors, not texts. Scoring needs no shuffle; labels are not an input of it.

Defined results: a null text counts as empty; null metadata are a value of their own; with labels of one kind only the
share of that kind is every document's score; a label row without document, or with a null label, is left out, and so are
the labels of a document that contradict each other; repeated rows score alike; very long texts are read whole; words that tell
as much as each other are taken in the order of their bytes; an empty table gives an empty result; only doc_id, text, lang, source,
n_chars, quality and toxic are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

PER_KIND, POOL, ROUNDS, PER_ROUND, PRECISION, SEED = 1500, 2000, 3, 300, 0.97, 5
FOLDS, CONFIDENCE, CALIBRATION = 10, (7,), (8, 9)
WORDS, LEAST_DOCS, META = 400, 4, 64
TARGETS = ("quality", "toxic")
SCHEMA = "doc_id long, score double, toxic_score double, text_score double, meta_score double, kept boolean"
_BLANK = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_CAPITALS, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?"
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"


def text_parts(text: str | None) -> tuple[set[bytes], list[float]]:
    """Lower-case words and their beginnings (4 and 5 bytes, marked by a star), and measures of style."""
    raw = (text or "").encode()
    words = raw.lower().translate(_BLANK).split()
    n, size, distinct = max(1, len(words)), max(1, len(raw)), set(words)
    rate = lambda which: (len(raw) - len(raw.translate(None, which))) / size
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)  # noqa: B905
    lines = raw.split(b"\n")
    stems = {w[:4] + b"*" for w in distinct if len(w) > 5} | {w[:5] + b"*" for w in distinct if len(w) > 6}
    return distinct | stems, [np.log1p(len(words)), len(distinct) / n, pairs, size / n / 10, 5 * rate(_CAPITALS), 20 * rate(_MARKS), 20 * rate(_SYMBOLS), 10 * rate(_DIGITS), len(set(lines)) / len(lines)]


def meta_parts(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Hashed values of lang and source, and the length."""
    out = [0.0] * (META + 3)
    for name, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{name}={value}".encode()) % META] += 1.0
    out[META] = 1.0 if n_chars is None else 0.0
    size = np.log1p(max(0, n_chars or 0))
    out[META + 1], out[META + 2] = size / 10, (size / 10) ** 2
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton steps with a ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty * w
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        w -= change / max(1.0, np.abs(change).max() / 5)
        if np.abs(change).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class View:
    """Weights, and intercept and slope of the calibration."""

    weights: np.ndarray
    platt: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.platt[0] * logit(x, self.weights) + self.platt[1]


@dataclass
class Classifier:
    """For one label: words whose presence counts, the two views and their combination; or a constant share."""

    words: list[bytes]
    text: View | None = None
    meta: View | None = None
    both: np.ndarray | None = None
    share: float = 0.5

    def inputs(self, parts: list[tuple[set[bytes], list[float]]]) -> np.ndarray:
        return np.array([[*(w in words for w in self.words), *style] for words, style in parts], float)

    def scores(self, parts: list, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities: combined, by text, by metadata."""
        if self.text is None or not parts:
            return (np.full(len(parts), self.share),) * 3
        t, m = self.text.score(self.inputs(parts)), self.meta.score(meta)
        return _probability(logit(np.stack([t, m], 1), self.both)), _probability(t), _probability(m)


@dataclass
class Sample:
    """Vectors of documents for one label: of both views, labels (-1: none), folds and weights."""

    views: list[np.ndarray]
    y: np.ndarray
    fold: np.ndarray
    weight: np.ndarray

    def of(self, folds: tuple | range) -> "Sample":
        some = (self.y >= 0) & np.isin(self.fold, list(folds))
        return Sample([x[some] for x in self.views], self.y[some], self.fold[some], self.weight[some])


def _calibrate(some: Sample, view: int, w: np.ndarray) -> View:
    return View(w, fit(logit(some.views[view], w)[:, None], some.y, some.weight, 0.01))


def _confident(z: np.ndarray, some: Sample, side: int) -> float:
    """The score (towards side) from which a view was right PRECISION of the time; infinite if never."""
    z = z * (1 if side else -1)
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(some.weight[order] * (some.y[order] == side)) / np.cumsum(some.weight[order])
    good = np.flatnonzero((right >= PRECISION) & (z[order] > 0))
    return float(z[order][good[-1]]) if len(good) else np.inf


def co_train(words: list[bytes], sample: Sample) -> Classifier:
    """A classifier from the labelled documents of a sample and those without a label."""
    teach, bounds, last = (sample.of(f) for f in (range(min(CONFIDENCE)), CONFIDENCE, CALIBRATION))
    if any(min(np.sum(part.y == 0), np.sum(part.y == 1)) < least for part, least in ((teach, 3), (bounds, 1), (last, 1))):
        known = sample.of(range(FOLDS))
        return Classifier([], share=float(np.average(known.y, weights=known.weight)) if len(known.y) else 0.5)
    pools = [x[sample.y < 0] for x in sample.views]
    learned = [(x, teach.y.astype(float), teach.weight) for x in teach.views]
    left = np.ones(len(pools[0]), bool)
    for turn in range(ROUNDS + 1):
        weights = [fit(*own) for own in learned]
        fitted = [_calibrate(last, view, w) for view, w in enumerate(weights)]
        if turn == ROUNDS or not left.any():
            break
        for mine in (0, 1):  # what one view is sure of, the other learns
            z, known = fitted[mine].score(pools[mine]), fitted[mine].score(bounds.views[mine])
            for side in (0, 1):
                sure = left & (z * (1 if side else -1) >= _confident(known, bounds, side))
                chosen = np.flatnonzero(sure)[np.argsort(-np.abs(z[sure]), kind="stable")[:PER_ROUND]]
                x, labels, weight = learned[1 - mine]
                learned[1 - mine] = np.vstack([x, pools[1 - mine][chosen]]), np.append(labels, np.full(len(chosen), float(side))), np.append(weight, np.ones(len(chosen)))
                left[chosen] = False
    both = fit(np.stack([v.score(x) for v, x in zip(fitted, last.views, strict=True)], 1), last.y, last.weight, 0.1)
    return Classifier(words, *fitted, both)


def _place(doc_id: str, salt: int) -> Column:
    """A number from 0 to 1 that a hash of doc_id gives."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 30)).cast("double") / (1 << 30)


def _drawn(own: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled documents with their labels (null: none), fold and weight."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(t).cast("int").alias(t) for t in TARGETS)).where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(*(F.when((F.min(t) == F.max(t)) & F.max(t).isin(0, 1), F.max(t)).alias(t) for t in TARGETS))
    kinds = [(t, value) for t in TARGETS for value in (0, 1)]
    counts = known.agg(*(F.count_if(F.col(t) == value) for t, value in kinds)).first()
    shares = [F.when(F.col(t) == value, F.lit(min(1.0, PER_KIND / max(1, n)))) for (t, value), n in zip(kinds, counts, strict=True)]
    # A bounded sample of label rows is drawn before the join, so the text of the others is never moved.
    picked = known.withColumn("share", F.coalesce(F.greatest(*shares), F.lit(0.0))).where(_place("doc_id", SEED) < F.col("share"))
    pool = _place("doc_id", SEED + 1) < POOL / max(1, own.count())
    joined = own.join(F.broadcast(picked), "doc_id", "left").where(F.col("share").isNotNull() | pool)
    # Rows of one id are in or out together, so one of them stands for all: that of the least hash.
    columns = F.struct(*joined.columns)
    joined = joined.groupBy("doc_id").agg(F.min_by(columns, F.xxhash64("text", "lang", "source", "n_chars")).alias("_row")).select("_row.*")
    fold = F.when(F.col("share").isNotNull(), F.floor(_place("doc_id", SEED + 2) * FOLDS).cast("int"))
    return materialise(joined.withColumns({"fold": F.coalesce(fold, F.lit(-1)), "weight": F.coalesce(1 / F.col("share"), F.lit(1.0))}).drop("share"), "labelled")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the documents of each label have a word (empty: documents)."""
    for b in batches:
        found: Counter = Counter()
        for value, *labels in zip(b.column("text"), *(b.column(t).to_pylist() for t in TARGETS), strict=True):
            words = [*text_parts(value.as_py())[0], b""]
            for t, label in enumerate(labels):
                if label is not None:
                    found.update((t, label, w) for w in words)
        keys = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.binary()), pa.array(found.values(), pa.int64())], names=["target", "label", "word", "n"])


def _telling_words(drawn: DataFrame) -> list[list[bytes]]:
    """For each label, the words whose presence differs most between its values in the documents that teach, by z-score of their log odds."""
    teach = drawn.where(F.col("fold").between(0, min(CONFIDENCE) - 1)).select("text", *TARGETS)
    counts = map_arrow(teach, _counter, "target int, label int, word binary, n long").groupBy("target", "word")
    counts = materialise(counts.agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1))), "words")
    totals = {r["target"]: (r["n0"], r["n1"]) for r in counts.where("word = X''").collect()}
    out = []
    for t in range(len(TARGETS)):
        sides = [(F.col(f"n{k}") + 0.5, F.lit(n) - F.col(f"n{k}") + 0.5) for k, n in enumerate(totals.get(t, (0, 0)))]
        odds = [F.log(met / other) for met, other in sides]
        z = F.abs((odds[1] - odds[0]) / F.sqrt(sum((1 / met + 1 / other for met, other in sides), F.lit(0.0))))
        top = counts.where((F.col("target") == t) & (F.octet_length("word") > 0) & (F.col("n0") + F.col("n1") >= LEAST_DOCS)).select("word", F.round(z, 9).alias("z"))
        out.append([bytes(r["word"]) for r in top.where("z > 2").orderBy(F.desc("z"), "word").limit(WORDS).collect()])
    return out


def _metadata(b: pa.RecordBatch) -> np.ndarray:
    return np.array([meta_parts(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]).reshape(-1, META + 3)


def _vectors(words: list[list[bytes]]) -> Callable:
    """The views of each document as bytes of float32."""
    plain = [Classifier(w) for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [text_parts(t.as_py()) for t in b.column("text")]
            views = [_metadata(b), *(c.inputs(parts).reshape(len(parts), -1) for c in plain)]
            packed = [pa.array([row.tobytes() for row in x.astype("<f4")], pa.binary()) for x in views]
            yield pa.RecordBatch.from_arrays([*map(b.column, ("doc_id", "fold", "weight", *TARGETS)), *packed], names=["doc_id", "fold", "weight", *TARGETS, "meta", *(f"x_{t}" for t in TARGETS)])

    return run


def train(docs: DataFrame, labels: DataFrame) -> dict[str, Classifier]:
    """A classifier for each label."""
    drawn = _drawn(_own(docs), labels)
    words = _telling_words(drawn)
    schema = "doc_id long, fold int, weight double, " + "".join(f"{t} int, " for t in TARGETS) + "meta binary, " + ", ".join(f"x_{t} binary" for t in TARGETS)
    rows = sorted(map_arrow(drawn, _vectors(words), schema).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, *(bytes(r[f"x_{t}"]) for t in TARGETS)))
    matrix = lambda name: np.stack([np.frombuffer(r[name], "<f4") for r in rows]).astype(float) if rows else np.zeros((0, 1))
    meta, fold, weight = matrix("meta"), np.array([r["fold"] for r in rows], int), np.array([r["weight"] for r in rows], float)
    out = {}
    for t, own in zip(TARGETS, words, strict=True):
        y = np.array([-1 if r[t] is None else r[t] for r in rows], int)
        out[t] = co_train(own, Sample([matrix(f"x_{t}"), meta], y, fold, weight))
    return out


def _own(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))


def _scorer(models: dict[str, Classifier]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [text_parts(t.as_py()) for t in b.column("text")]
            meta = _metadata(b)
            good, by_text, by_meta = models["quality"].scores(parts, meta)
            toxic = models["toxic"].scores(parts, meta)[0]
            cols = [pa.array(np.asarray(x, float)) for x in (good, toxic, by_text, by_meta)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array((good >= 0.5) & (toxic < 0.5))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its probabilities of being good and of being toxic, the views' own, and whether it is kept (see SCHEMA)."""
    return map_arrow(_own(docs), _scorer(train(docs, labels)), SCHEMA)
