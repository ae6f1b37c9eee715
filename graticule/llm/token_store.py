"""Token ids of documents in binary files, written and read back.

A file holds the ids of a range of doc_ids in ascending order, as blocks that stand alone. A block is
a header, a table of the documents in it, and the ids coded by range_coder with a model that starts
anew; a CRC-32 covers table and ids. A document may go on in the next block.

    header: b"GTK2", then five little-endian u32: ids, rows of the table, bytes of the table, bytes of the ids, CRC-32
    table (zlib): doc_ids (i64), ids in this block (i64), flags (u8; 1: doc_id is null, 2: goes on in the next block)

Every file is written under a name of its own and listed only by the task that succeeds, so a task can
be repeated at any time. Positions of files come from sums over the list of files, one row each.

Defined results: null and empty texts have the end id alone; rows of equal doc_id are ordered by text and
kept; null doc_ids come first; very long texts go on over many blocks; an empty table gives no files and an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import range_coder
from .common import dealt_evenly, file_system, map_arrow, materialise, shared_dir
from .pretokens import Splitter

MAGIC, BLOCK_IDS, END_ID = b"GTK2", 1 << 21, 0
#: Remembered pieces beyond which the memory starts anew (keeping what is met again), and their most characters. Results do not depend on them.
MAX_PIECES, MAX_PIECE_CHARS = 400_000, 40
#: Characters of the longest text that is split in numpy, and of texts that are split at once.
MAX_LATIN, LATIN_BYTES = 1 << 20, 2 << 20
FILES = "part int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


# Fixed value: the pattern by which the library's byte-level pre-tokenizer splits texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _kinds() -> np.ndarray:
    """Of code points below 256: 0 the space, 1 other white space, 2 letters, 3 numbers, 4 all others (5: between texts)."""
    return np.array([0 if c == " " else 1 if regex.match(r"\s", c) else 2 if regex.match(r"\p{L}", c) else 3 if regex.match(r"\p{N}", c) else 4 for c in map(chr, range(256))], np.uint8)


_KINDS = _kinds()


def latin_pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The matches of BYTE_LEVEL in texts of code points below 256 without apostrophes, and an x between two texts; which of them are such an x. A run of white space leaves its last character to what follows; only a space joins it."""
    data = b"x".join(texts)
    kinds = _KINDS.take(np.frombuffer(data, np.uint8))
    kinds[np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1] = 5
    blank = kinds < 2
    starts = np.ones(len(kinds), bool)
    starts[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != 0)
    last = np.zeros(len(kinds), bool)  # the last of a run that is not at its text's end
    last[:-1] = blank[:-1] & ~blank[1:] & (kinds[1:] != 5)
    starts[1:] = np.where(blank[1:], ~blank[:-1] | last[1:], starts[1:] | (kinds[1:] == 5))
    at = np.append(np.flatnonzero(starts), len(kinds)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), kinds.take(at[:-1]) == 5


class Encoder:
    """Ids of whole texts by the tokenizers library. Pieces that its byte-level pre-tokenizer would split off are remembered; with any other tokenizer, or another pattern, the library takes whole texts."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.split = Tokenizer.from_file(path), Splitter(pattern).split
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        known = json.loads(self.library.to_str())
        before = known["pre_tokenizer"] or {}
        self.alike = known["normalizer"] is None and pattern == BYTE_LEVEL and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was known before known was begun anew

    def look_up(self, fresh: list[str]) -> None:
        """Remember the ids of pieces. Those without white space but for one before them go to the library as the lines of one text: it splits them off again."""
        lines = [p for p in fresh if len(w := p.split()) == 1 and (p == w[0] or p == " " + w[0])]
        while lines:
            now, lines = lines[:4096], lines[4096:]
            e = self.library.encode("\n".join(now), add_special_tokens=False)
            words = np.array(e.word_ids, np.int64)
            if len(words) and words[-1] == 2 * len(now) - 2:
                ids, ends = np.array(e.ids, "<i4"), np.searchsorted(words, np.arange(2 * len(now) - 1), "right")
                starts = np.concatenate([[0], ends[:-1]])
                for p, i, j in zip(now, starts[::2].tolist(), ends[::2].tolist(), strict=True):
                    self.known[p] = ids[i:j].tobytes()
        rest = [p for p in fresh if p not in self.known]
        for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<i4").tobytes()

    def ready(self, every: set[str]) -> set[str]:
        """Have the ids of all these pieces at hand; returns those that are new."""
        if len(self.known) > MAX_PIECES:
            self.old, self.known = self.known, {}
        known = self.known
        fresh = every.difference(known)
        again = fresh.intersection(self.old)
        known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        fresh -= again
        self.look_up(list(fresh))
        return fresh

    def forget(self, fresh: set[str]) -> None:
        for p in fresh:
            if len(p) > MAX_PIECE_CHARS:
                self.known.pop(p, None)

    def encode_latin(self, texts: list[bytes]) -> list[np.ndarray]:
        pieces, between = latin_pieces(texts)
        coded = pieces.dictionary_encode()
        _, ends, data = coded.dictionary.buffers()
        ends, whole = np.frombuffer(ends, "<i4", len(coded.dictionary) + 1).tolist(), data.to_pybytes().decode("latin-1")
        names = [whole[i:j] for i, j in zip(ends, ends[1:])]
        own = list(map(self.known.get, names))
        missing = {p for p, ids in zip(names, own, strict=True) if ids is None}
        if missing:
            fresh = self.ready(missing.union(names) if len(self.known) > MAX_PIECES else missing)
            own = list(map(self.known.__getitem__, names))
            self.forget(fresh)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool, at = np.frombuffer(b"".join(own), "<i4"), coded.indices.to_numpy()
        counts = sizes.take(at)
        counts[between] = 0
        ends = np.cumsum(counts)
        # Place in pool of each piece's first id, less its place among all.
        shift = (np.cumsum(sizes) - sizes).take(at) - (ends - counts)
        ids = pool.take(np.repeat(shift, counts) + np.arange(len(pieces) and ends[-1]))
        return np.split(ids, ends[between])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.alike and not any(s in t for s in self.special) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        latin: dict[int, bytes] = {}
        held = 0

        def coded() -> None:
            for k, ids in zip(latin, self.encode_latin(list(latin.values())) if latin else [], strict=True):
                out[k] = ids
            latin.clear()

        for k, text in enumerate(texts):
            if plain[k] and "'" not in text and len(text) <= MAX_LATIN:
                try:
                    latin[k] = text.encode("latin-1")
                except UnicodeEncodeError:
                    continue
                held += len(text)
                if held >= LATIN_BYTES:
                    coded()
                    held = 0
        coded()
        pieces = {k: self.split(t) for k, t in enumerate(texts) if plain[k] and out[k] is None}
        fresh = self.ready(set().union(*pieces.values()))
        for k, text in enumerate(texts):
            if k in pieces:
                out[k] = np.frombuffer(b"".join(map(self.known.__getitem__, pieces[k])), "<i4")
            elif not plain[k]:  # such as a special token's text: the library takes the whole text at once
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4")
        self.forget(fresh)
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker, so that what it remembers serves all its tasks."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def release() -> None:
    """Forget the encoders of this worker."""
    _encoders.clear()


def _block(ids: np.ndarray, table: list[tuple[int | None, int, bool]], size: int) -> bytes:
    doc_ids = np.array([x[0] or 0 for x in table], "<i8")
    flags = np.array([(x[0] is None) + 2 * x[2] for x in table], np.uint8)
    head = zlib.compress(doc_ids.tobytes() + np.array([x[1] for x in table], "<i8").tobytes() + flags.tobytes(), 6)
    body = range_coder.encode(ids, size)
    return MAGIC + struct.pack("<5I", len(ids), len(table), len(head), len(body), zlib.crc32(body, zlib.crc32(head))) + head + body


def blocks(docs: Iterator[tuple[int | None, np.ndarray]], size: int, most: int = BLOCK_IDS) -> Iterator[bytes]:
    """Blocks of (doc_id, ids) in the order given."""
    held: list[np.ndarray] = []
    table: list[tuple[int | None, int, bool]] = []
    n = 0
    for doc_id, ids in docs:
        left = ids
        while True:
            now, left = left[: most - n], left[most - n :]
            held.append(now)
            table.append((doc_id, len(now), bool(len(left))))
            n += len(now)
            if n == most:
                yield _block(np.concatenate(held), table, size)
                held, table, n = [], [], 0
            if not len(left):
                break
    if n:
        yield _block(np.concatenate(held), table, size)


def read_blocks(stream, size: int) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, ids, whether more follow) from a file; raises ValueError if a block is damaged."""
    while head := stream.read(24):
        if len(head) < 24 or head[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n, rows, table_bytes, body_bytes, crc = struct.unpack("<5I", head[4:])
        data = bytes(stream.read(table_bytes + body_bytes))
        if len(data) < table_bytes + body_bytes or zlib.crc32(data) != crc:
            raise ValueError("a block of token ids is damaged")
        table = zlib.decompress(data[:table_bytes])
        doc_ids, counts, flags = np.frombuffer(table, "<i8", rows), np.frombuffer(table, "<i8", rows, 8 * rows), np.frombuffer(table, np.uint8, rows, 16 * rows)
        ids, ends = range_coder.decode(data[table_bytes:], n, size), np.cumsum(counts)
        for doc_id, count, flag, end in zip(doc_ids.tolist(), counts.tolist(), flags.tolist(), ends.tolist(), strict=True):
            yield None if flag & 1 else doc_id, ids[end - count : end], bool(flag & 2)


def write(docs: DataFrame, path: str, pattern: str, folder: str, size: int | None = None) -> DataFrame:
    """Write the ids of docs, an end id after each document, to files in folder; returns the list of files (see FILES), part in ascending doc_id order.

    path: a tokenizers file that every executor has at the same place, as its library has.
    """
    conf = docs.sparkSession.conf
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts are moved, not ids: the range partitioning reads its input twice. The hash deals out rows of one doc_id.
    ranged = own.repartitionByRange(int(conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, pattern)
        done = [0, 0]

        def coded() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in batches:
                doc_ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
                for at in range(0, len(texts), 512):
                    for doc_id, ids in zip(doc_ids[at : at + 512], coder.encode(texts[at : at + 512]), strict=True):
                        done[0] += 1
                        done[1] += len(ids) + 1
                        yield doc_id, np.append(ids, np.int32(END_ID))

        part, n_bytes, out = TaskContext.get().partitionId(), 0, None
        fs, base = file_system(folder)
        name = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids"
        for block in blocks(coded(), size or coder.size):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name.rpartition('/')[2]}")
            out.write(block)
            n_bytes += len(block)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_docs": done[0], "n_tokens": done[1], "n_bytes": n_bytes}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return map_arrow(ranged, run, FILES)


def _reader(fold: Callable, schema: pa.Schema, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, name = file_system(path)
                rows: list[dict] = []
                with fs.open_input_stream(name, buffer_size=1 << 20) as stream:
                    state = None
                    for doc_id, ids, more in read_blocks(stream, size):
                        state = fold(state, doc_id, start, ids)
                        start += len(ids)
                        if not more:
                            rows.append(state)
                            state = None
                            if len(rows) == 4096:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_summary(files: DataFrame, size: int, n_tasks: int) -> DataFrame:
    """Per document of the files that write() listed: its place among all ids, number of ids and their CRC-32 (see ROWS)."""
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def fold(state: dict | None, doc_id: int | None, start: int, ids: np.ndarray) -> dict:
        state = state or {"doc_id": doc_id, "start": start, "n_tokens": 0, "ids_crc32": 0}
        return state | {"n_tokens": state["n_tokens"] + len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes(), state["ids_crc32"])}

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return map_arrow(dealt_evenly(placed, n_tasks), _reader(fold, schema, size), ROWS)


def read_ids(files: DataFrame, size: int, n_tasks: int) -> DataFrame:
    """Per document of the files: doc_id, start and ids (array of int, the end id last)."""
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def fold(state: dict | None, doc_id: int | None, start: int, ids: np.ndarray) -> dict:
        state = state or {"doc_id": doc_id, "start": start, "ids": []}
        state["ids"].extend(ids.tolist())
        return state

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return map_arrow(dealt_evenly(placed, n_tasks), _reader(fold, schema, size), "doc_id long, start long, ids array<int>")


def store(docs: DataFrame, path: str, pattern: str) -> tuple[DataFrame, int]:
    """Write docs to a fresh shared folder: the list of files, and its length."""
    files = materialise(write(docs, path, pattern, shared_dir(docs.sparkSession, "tokens")), "token-files")
    return files, files.count()


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
