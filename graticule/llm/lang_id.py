"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its subwords (byte n-grams within words, word borders marked), hashed into
BUCKETS rows; a linear layer with softmax gives the languages. The model is trained from segments of a bounded sample:
about PER_LANG different documents of each of the LANGS most frequent languages, chosen by a hash of the row, SEGMENTS segments of each, spread over the whole text.
A part of the sampled documents is set aside, texts that sort next to each other together, so that copies seldom lie
on both sides: their segments, one by one and joined, set the temperature of the softmax and the score below which a
prediction counts as rejected (accepted is false there; the best language is reported all the same).

Only text is an input of a prediction. Texts are scored whole, CHUNK bytes at a time, without a shuffle.

Defined results: of languages of equal probability the first by name is predicted; a null text or one without letters gives und and score 0; without any training row every text does;
a null doc_id is not held out; repeated rows are predicted alike; an empty table gives an empty result; only doc_id,
text and lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SIZES, BUCKETS, WIDTH = (2, 3, 4), 1 << 15, 16
PER_LANG, LANGS, SEGMENTS, SEGMENT_BYTES = 250, 200, 12, (30, 300)
EPOCHS, RATE, MINIBATCH, SEED = 4, 8.0, 64, 11
#: Bytes of a text whose subwords are looked up at a time.
CHUNK = 1 << 18
#: Share of the sampled documents set aside for calibration; accuracy that accepted predictions must have there.
ASIDE, ACCURACY = 0.2, 0.99

UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
_ROLL, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def _parts(text: str) -> Iterator[np.ndarray]:
    """Rows of the embedding table of all subwords of a text, CHUNK bytes at a time."""
    raw = b" " + text.lower().encode().translate(_BLANK) + b" "
    longest = max(SIZES)
    for base in range(0, len(raw), CHUNK):
        data = np.frombuffer(raw[base : base + CHUNK + longest - 1], np.uint8).astype(np.uint32)
        blank = data == 32
        rolled, out = data, []
        inner = np.zeros(len(data), bool)  # whether a byte between the first and the last of the n-gram is blank
        for n in range(2, longest + 1):
            rolled = rolled[:-1] * _ROLL + data[n - 1 :]
            inner = inner[:-1] | blank[n - 2 : len(data) - 1] if n > 2 else inner[:-1]
            if n in SIZES:
                good = (~inner & ~(blank[: len(rolled)] & blank[n - 1 :]))[:CHUNK]
                out.append((((rolled[:CHUNK][good] + np.uint32(n)) * _MIX) >> _SHIFT).astype(np.int32))
        yield np.concatenate(out)


def subwords(text: str) -> np.ndarray:
    """Rows of the embedding table of all subwords of a text."""
    return np.concatenate(list(_parts(text)))


@dataclass
class Model:
    """langs; scores, the sum of a row's part in each language's logit; temperature and least accepted score."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = 0.0, 0
        for rows in _parts(text):
            total, n = total + self.scores[rows].sum(0, dtype=np.float64), n + len(rows)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[list[str], str]]) -> Model:
    """A model of (segments of a text, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    draw = np.random.default_rng(SEED)
    parts: tuple[list, list] = ([], [])
    for k, (segments, lang) in enumerate(sorted(rows)):
        aside = k * 20 // len(rows) % round(1 / ASIDE) == 0
        found = [f for s in segments if _LETTER.search(s) and len(f := subwords(s[: int(draw.integers(*SEGMENT_BYTES))]))]
        whole = [subwords(" ".join(segments))] if aside and found else []
        parts[aside].extend((f, langs.index(lang)) for f in found + whole)
    learn, check = parts[0] or parts[1], parts[1] or parts[0]
    if not learn:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    table = draw.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = draw.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    total, step = EPOCHS * -(-len(learn) // MINIBATCH), 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(learn))
        for i in range(0, len(learn), MINIBATCH):
            batch = [learn[j] for j in order[i : i + MINIBATCH]]
            sizes = np.array([len(s) for s, _ in batch])
            met, place = np.unique(np.concatenate([s for s, _ in batch]), return_inverse=True)
            share = np.bincount(place + np.repeat(np.arange(len(batch)) * len(met), sizes), minlength=len(batch) * len(met)).reshape(len(batch), -1) / sizes[:, None]
            hidden = share @ table[met]
            p = _softmax(hidden @ weights + bias)
            p[np.arange(len(batch)), [y for _, y in batch]] -= 1
            p /= len(batch)
            rate = RATE * (1 - step / total)
            table[met] -= (rate * (share.T @ (p @ weights.T))).astype(np.float32)
            weights -= rate * (hidden.T @ p)
            bias -= rate * p.sum(0)
            step += 1
    model = Model(langs, (table @ weights).astype(np.float32), bias)
    return _calibrated(model, check)


def _calibrated(model: Model, check: list[tuple[np.ndarray, int]]) -> Model:
    z, y = np.array([model.scores[s].mean(0) + model.bias for s, _ in check]), np.array([k for _, k in check])
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = _softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-score)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= ACCURACY)
    model.least = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def sample(rows: DataFrame, per_lang: int = PER_LANG, langs: int = LANGS) -> list[tuple[list[str], str]]:
    """(segments of a text, lang) of about per_lang documents, at most twice as many in all, of each of the most frequent languages, chosen by a hash of the row; rows has doc_id, text, lang. Equal segments count once."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.try_element_at(F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"]))))), F.col("lang"))
    # Segments leave the executors, not texts: SEGMENTS of them, at equal distances.
    at = lambda i: (F.length("text") * i / SEGMENTS).cast("int") + 1
    segments = F.array(*(F.substring("text", at(i), F.lit(SEGMENT_BYTES[1])) for i in range(SEGMENTS)))
    drawn = known.where(place < share).groupBy("lang", segments.alias("segments")).agg(F.min(place).alias("place"))
    return [(r["segments"], r["lang"]) for r in drawn.orderBy("place", "lang", "segments").limit(2 * per_lang * len(counts)).collect()]


def _predictor(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out")] + [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document (see SCHEMA), by a model trained from the rows of docs that are not held out and have a lang."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(sample(own.where(~held_out(F.col("doc_id")))))
    return map_arrow(own.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), _predictor(model), SCHEMA)
