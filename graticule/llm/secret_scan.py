"""Secret scan: fixed patterns, and tokens that look random to character Markov models.

Two first-order Markov models over characters, one trained from random strings and one from ordinary
identifiers, score every long token of a text; a token whose mean log-likelihood ratio is above a
threshold is reported as kind markov unless it overlaps a pattern's span. Both models come from
labelled samples of bounded size: random strings drawn by a seeded rule over the alphabets of keys,
and identifiers made from TRAIN_WORDS words, chosen by a hash, of about TRAIN_DOCS documents chosen by a hash of the row.

Defined results: a null text counts as empty (no spans); repeated rows are scanned alike; a null doc_id
passes through; very long texts are scanned whole, in time that grows with their length and their spans; spans that
begin at one place are listed by kind, then end; an empty table gives an empty result; only doc_id and text are read.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Kinds, patterns and least lengths, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: A match of HEX that is long enough, found without stopping at each shorter one.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST_HEX)
#: What the models judge: tokens over the alphabets of keys, with digits or without.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents whose words make identifiers, and most such words; strings of each label; mean log-likelihood ratio (nats a character) from which a token is reported, between the two labels' held-out scores (sf0.1: random strings of 16 characters above 0.01 to 0.55 in 99 of 100, of 24 above 0.40; identifiers below -0.54 in 99 of 100, 0.15 at most; the documents' own long tokens -0.32 at most).
TRAIN_DOCS, TRAIN_WORDS, TRAIN_STRINGS, THRESHOLD, SEED = 200, 20_000, 4000, 0.2, 7

_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def random_strings(n: int, seed: int = SEED) -> list[str]:
    """Labelled sample of random strings: lower hex, upper case with digits, alphanumeric, base64, upper case, lower case."""
    draw = random.Random(seed)
    sets = ["0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[:62], ALPHABET[:64], ALPHABET[:26], ALPHABET[26:52]]
    return ["".join(draw.choices(sets[i % len(sets)], k=draw.randint(16, 48))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = SEED) -> list[str]:
    """Labelled sample of ordinary identifiers: snake, kebab, camel and path names of words, some numbered; compounds and names in capitals; rules of one character."""
    draw = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value", "index", "name", "count", "item", "file"]
    out = []
    for i in range(n):
        parts = draw.choices(words, k=draw.randint(2, 4))
        name = ("_", "-", "/")[i % 3].join(p.lower() for p in parts) if i % 4 else parts[0].lower() + "".join(p.capitalize() for p in parts[1:])
        out.append(name + (f"_{draw.randint(0, 2030)}" if i % 2 else ""))
        if i % 10 in (2, 5, 8):
            out[-1] = "_".join(parts).upper() if i % 10 == 2 else "".join(parts).upper() if i % 10 == 5 else "".join(parts).lower()
        elif i % 20 == 7:
            out[-1] = ALPHABET[i // 20 % len(ALPHABET)] * draw.randint(16, 48)
    return out


def fit(strings: list[str]) -> np.ndarray:
    """Log-probabilities of the next character given the one before, with add-one smoothing."""
    size = len(ALPHABET) + 1
    counts = np.ones((size, size))
    for s in strings:
        codes = _CODE[np.minimum(np.frombuffer(s.encode(), np.uint8), 127)]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def ratio(token: str, table: np.ndarray) -> float:
    """Mean log-likelihood ratio per character, random against ordinary."""
    codes = _CODE[np.frombuffer(token.encode(), np.uint8)]
    return float(table[codes[:-1], codes[1:]].mean())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return sorted(out + [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)])


def scan(text: str, table: np.ndarray, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pattern spans, and all spans with those that the models add."""
    base = base_spans(text)
    added, at, reach = [], 0, -1  # reach: the furthest end of base spans that begin before the token's end
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= start and ratio(m[0], table) > threshold:
            added.append((start, 3, end))
    return base, sorted(base + added)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def train(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> np.ndarray:
    """The table of log-likelihood ratios; ordinary words come from about n_docs documents."""
    # A hash decides row by row; words leave the executors, not texts.
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30))
    picked = own.where(place < int(min(1.0, n_docs / max(1, docs.count())) * (1 << 30)))
    found = picked.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)))).alias("word")).distinct()
    words = [r["word"] for r in found.orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS).collect()]
    return fit(random_strings(TRAIN_STRINGS)) - fit(identifiers(sorted(set(words)), TRAIN_STRINGS))


def _scanner(table: np.ndarray, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text in b.column("text"):
                base, spans = scan(text.as_py() or "", table, threshold)
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((n[0], n[1], n[2], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), n[3]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def secret_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its spans (see SCHEMA)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, _scanner(train(own), threshold), SCHEMA)


def redact(docs: DataFrame, threshold: float = THRESHOLD, mask: str = "[secret]") -> DataFrame:
    """docs with every span of their text replaced by mask (overlapping spans by one), n_chars brought up to date; null texts stay null."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table, at = train(own), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for value in b.column(at):
                text = value.as_py()
                if text is not None:
                    parts, done = [], 0
                    for start, _, end in scan(text, table, threshold)[1]:
                        if start >= done:
                            parts += [text[done:start], mask]
                        done = max(done, end)
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            b = b.set_column(at, "text", pa.array(texts, pa.string()))
            if "n_chars" in b.schema.names:
                k = b.schema.names.index("n_chars")
                b = b.set_column(k, "n_chars", pa.array([None if x is None else len(x) for x in texts], b.schema.field(k).type))
            yield b

    return map_arrow(docs, run, docs.schema)
