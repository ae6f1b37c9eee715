"""Repetition rules for documents: characters inside duplicated n-grams and lines.

Words are hashed once per document; the hashes of the longer n-grams roll from the shorter
ones in numpy. Documents are judged one by one, so there is no shuffle at all.

Defined results: a null or empty text has no words, counts of 0 and fails the base rule; repeated
rows are judged alike; a null doc_id passes through; very long texts are read whole, in memory that grows with their words; an empty table gives an empty result; only
doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Largest share of word characters, in percent, inside duplicated n-grams of each length and inside duplicated lines.
MAX_NGRAM_PERCENT = {5: 40, 6: 38, 8: 35, 10: 30}
MAX_LINE_PERCENT = 40

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, dup_line_chars long, dup_chars_5 long, dup_chars_6 long, dup_chars_8 long, dup_chars_10 long"
)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _lengths(raw: bytes, words: list[bytes], ascii_only: bool) -> np.ndarray:
    """Code points in each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if ascii_only:
        return sizes
    joined = np.frombuffer(b"".join(words), np.uint8)
    points = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
    ends = np.cumsum(sizes)
    return points[ends] - points[ends - sizes]


def repetition(text: str | None) -> dict[str, int]:
    """Counts for one text: words, characters, symbols, duplicated lines, words and characters in repeated n-grams."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    out = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": 0,
        "n_repeat_words": 0,
        "dup_line_chars": 0,
    } | {f"dup_chars_{k}": 0 for k in MAX_NGRAM_PERCENT}
    seen: set[str] = set()
    for line in text.split("\n"):
        if not line.strip(SPACES):
            continue
        if line in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += len(line) - sum(map(line.count, SPACES))
        seen.add(line)
    if n < 2 or len(set(words)) == n:
        return out
    first = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    rolled, lengths = first, None
    wanted = {*MAX_NGRAM_PERCENT, REPEAT_WINDOW}
    for k in range(2, min(n, max(wanted)) + 1):
        rolled = rolled[:-1] * _ROLL + first[k - 1 :]
        if k not in wanted:
            continue
        order = np.argsort(rolled)
        ordered = rolled[order]
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            break  # then no longer n-gram repeats either
        starts = order[np.append(same, False) | np.insert(same, 0, False)]
        covered = np.zeros(n, bool)
        for j in range(k):
            covered[starts + j] = True
        if lengths is None:
            lengths = _lengths(raw, words, len(raw) == len(text))
        if k == REPEAT_WINDOW:
            out["n_repeat_words"] = int(covered.sum())
        if k in MAX_NGRAM_PERCENT:
            out[f"dup_chars_{k}"] = int(lengths[covered].sum())
    return out


def verdict(x: dict[str, int]) -> tuple[bool, bool]:
    """(base_failed, kept)"""
    failed = x["n_words"] < MIN_WORDS or 100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"]
    repeats = any(100 * x[f"dup_chars_{k}"] > most * x["word_chars"] for k, most in MAX_NGRAM_PERCENT.items())
    return failed, not (failed or repeats or 100 * x["dup_line_chars"] > MAX_LINE_PERCENT * x["word_chars"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(",")]
    for b in batches:
        rows = []
        for text in b.column("text"):
            x = repetition(text.as_py())
            x["base_failed"], x["kept"] = verdict(x)
            rows.append(x)
        cols = [b.column("doc_id")] + [pa.array([r[c] for r in rows], pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in names[1:]]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and verdicts (see SCHEMA)."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _judge, SCHEMA)


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.schema.names.index("text"))
        yield b.filter(pa.array([verdict(repetition(t.as_py()))[1] for t in texts], pa.bool_()))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all columns."""
    return map_arrow(docs, _filter, docs.schema)
