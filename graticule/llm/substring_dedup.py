"""Exact substring deduplication over the bytes of all texts, by a sparse suffix array that is dealt out by range.

A byte goes if it lies in a string of SPAN bytes that also starts earlier: in a smaller doc_id, or earlier in the same
document. Sorting every suffix would move each byte SPAN times, so only some suffixes are sorted. Of all
GRAM-byte grams in a string of SPAN bytes the one with the least hash (the leftmost of equal ones) is its anchor: equal
strings have their anchors at the same place. Strings that follow one another mostly share an anchor and make a run. A
record stands for a run: the suffix from the anchor on (as far as the run's last string), then, read backwards, what
stands before the anchor (as far as its first string). The hash chooses anchors only; order and equality are of bytes.

1. Every mapper lists the records of its documents and sorts them. Equal ones of a batch are settled on the spot: all but
   the earliest are repeats. The others go to the bucket that their bytes fall into; the splitters are quantiles of
   records of SAMPLE documents. Beyond SPLITTERS of them, a hash of the gram deals each range to more buckets.
2. A bucket is sorted by multikey quicksort, eight bytes at a time, each further word only where those before are equal.
   Common prefixes of neighbours, forwards from the anchor and backwards, tell for each string of a run which others
   have the same bytes on both sides; all but the earliest are repeats.
3. Compared across boundaries: a string whose part behind the anchor also begins a splitter can have equals in
   another bucket. The earliest of each kind in its bucket is dealt out by a hash, sorted by its bytes and compared.
4. The repeats are gathered by document, and its text is cut.

Records travel packed, a row for each batch and bucket, and equal ones are merged before they do and whenever
a bucket's pile has doubled; a bucket has about BUCKET records at any input size. So a passage in a third of all documents is a
record for each batch, and its ends, where contexts differ, are parted by the splitters. Texts travel packed by a dictionary of sampled segments.

Defined results: null and empty texts have no bytes and lose none; texts below SPAN bytes lose none; very long texts are
read CHUNK bytes at a time and cut whole; rows of equal doc_id count as one document's, so none of them is earlier at
equal starts, and each is cut by itself; a null doc_id comes before all others; an empty table gives an empty result;
only doc_id and text are read. kept holds the remaining bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

SPAN, GRAM = 100, 16
#: Most bytes before an anchor in its string, and bytes of a record: SPAN behind, LEFT before.
LEFT = SPAN - GRAM
WIDTH = SPAN + LEFT
#: Records of a bucket, documents from which splitters are drawn, most splitters, most records drawn from a batch, bytes of a text handled at a time.
BUCKET, SAMPLE, SPLITTERS, DRAWN, CHUNK = 250_000, 200, 4096, 512, 1 << 18
#: Bytes of a segment for the dictionary that packs texts.
SEGMENT, SEED = 4096, 3
_MIX, _ROLL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 21) - 1)
_NULL = -(1 << 63)

#: Where a record is from: document, its text's hash, place of the anchor, bytes behind it (to the end of the last string), bytes before it.
PLACE = np.dtype([("doc", "<i8"), ("th", "<i8"), ("at", "<i8"), ("right", "u1"), ("left", "u1")])
_FOUND = "doc long, th long, lo long, hi long, bucket int, blob binary"
_FOUND_SCHEMA = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, put together from halves."""
    parts, size, have = data.astype(np.uint64) + np.uint64(1), 1, None
    done, left = 0, GRAM
    while left:
        if left & 1:
            have = parts if have is None else have[: len(have) - size] * _mixed(np.array([size + 7], np.uint64))[0] + parts[done : done + len(have) - size]
            done += size
        left >>= 1
        if left:
            parts = parts[:-size] * np.uint64(int(_ROLL) * (2 * size + 1) % (1 << 64)) + parts[size:]
            size *= 2
    return _mixed(have)


def anchors(data: np.ndarray) -> np.ndarray:
    """The place of the anchor of the string at each place of data (below 2 MB)."""
    hashes = _gram_hashes(data)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    window, size = LEFT + 1, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    return (least & _PLACE).astype(np.int64)


def _windows(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The sizes bytes from each place at on, filled up with zeros to width."""
    padded = np.append(data, np.zeros(width, np.uint8))
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    out[np.arange(width) >= sizes[:, None]] = 0
    return out


def records(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, PLACE) of all runs of the documents (doc, text's hash, bytes), some CHUNK bytes at a time."""
    held, size = [], 0
    for doc, th, raw in rows:
        for base in range(0, len(raw) - SPAN + 1, CHUNK):
            held.append((doc, th, base, raw[base : base + CHUNK + SPAN - 1]))
            size += len(held[-1][3])
            if size >= CHUNK:
                yield _records(held)
                held, size = [], 0
    if held:
        yield _records(held)


def _records(held: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
    sizes = np.array([len(h[3]) for h in held])
    ends = np.cumsum(sizes)
    at = anchors(data)
    inside = np.ones(len(at), bool)  # strings that lie in one document
    for end in ends[:-1].tolist():
        inside[end - SPAN + 1 : end] = False
    whole = np.where(inside, at, -1)
    first = np.flatnonzero(inside & np.append(True, whole[1:] != whole[:-1]))
    last = np.flatnonzero(inside & np.append(whole[1:] != whole[:-1], True))
    at = at[first]
    piece = np.searchsorted(ends, first, "right")
    place = np.empty(len(first), PLACE)
    for i, name in enumerate(("doc", "th")):
        place[name] = np.array([h[i] for h in held], np.int64)[piece]
    place["at"] = at - (ends - sizes)[piece] + np.array([h[2] for h in held], np.int64)[piece]
    place["right"], place["left"] = last + SPAN - at, at - first
    text = np.empty((len(first), WIDTH), np.uint8)
    text[:, :SPAN] = _windows(data, at, place["right"], SPAN)
    text[:, SPAN:] = _windows(data[::-1], len(data) - at, place["left"], LEFT)
    return text, place


def _words(text: np.ndarray) -> list[np.ndarray]:
    """The columns of text as words of eight bytes whose order is that of the bytes."""
    short = -text.shape[1] % 8
    if short:
        text = np.hstack([text, np.zeros((len(text), short), np.uint8)])
    return list(np.ascontiguousarray(text).view(">u8").T)


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of records by their words, each further word sorted only where those before it are equal."""
    order = np.argsort(words[0].astype(words[0].dtype.newbyteorder("=")), kind="stable")
    tied = words[0][order][1:] == words[0][order][:-1] if len(order) > 1 else np.zeros(0, bool)
    for word in words[1:]:
        if not tied.any():
            break
        inside = np.append(tied, False) | np.insert(tied, 0, False)
        place = np.flatnonzero(inside)
        group = np.cumsum(np.insert(~tied, 0, True))[place]
        some = order[place]
        order[place] = some[np.lexsort((word[some], group))]
        tied &= word[order][1:] == word[order][:-1]
    return order


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the rows of a and b have in common from the first column on."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _settled(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted records that are the earliest of those with equal bytes (and their places), and the places of the others, which start later."""
    order = multikey_order([*_words(text), place["right"], place["left"], place["doc"], place["at"]])
    text, place = text[order], place[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]).any(1) | (place["right"][1:] != place["right"][:-1]) | (place["left"][1:] != place["left"][:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(text)), 0))
    same = (place["doc"] == place["doc"][head]) & (place["at"] == place["at"][head])
    return text[same], place[same], place[~same]


def _doc(doc_id: int | None) -> int:
    return _NULL if doc_id is None else doc_id


def text_hash(text: str | None) -> int:
    """Tells rows of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(text or "") - (1 << 63)


def _rows(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Rows of repeats; those that follow one another in a text are joined."""
    order = np.lexsort((lo, th, doc))
    doc, th, lo, hi = doc[order], th[order], lo[order], hi[order]
    if len(lo):
        new = np.insert((doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (lo[1:] > hi[:-1] + 1), 0, True)
        ends = np.append(np.flatnonzero(new)[1:], len(new)) - 1
        doc, th, lo, hi = doc[new], th[new], lo[new], hi[ends]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, th, lo, hi)] + [pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary())], schema=_FOUND_SCHEMA)


def _whole(place: np.ndarray) -> pa.RecordBatch:
    """Records of which every string is a repeat."""
    return _rows(place["doc"], place["th"], place["at"] - place["left"], place["at"] + place["right"] - SPAN)


def _within(place: np.ndarray, width: int) -> np.ndarray:
    """Where the bytes of records are that are not filled up."""
    column = np.arange(width)
    return np.where(column < SPAN, column < place["right"][:, None], column - SPAN < place["left"][:, None])


def _pack(text: np.ndarray, place: np.ndarray) -> bytes:
    """Records in the order of their bytes, texts and columns of places apart."""
    places = zlib.compress(b"".join(place[c].tobytes() for c in PLACE.names), 1)
    head = np.array([len(place), text.shape[1], len(places)], "<u4").tobytes()
    return head + places + zstandard.ZstdCompressor(level=6).compress(text[_within(place, text.shape[1])].tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, size = np.frombuffer(blob, "<u4", 3).tolist()
    columns, place, at = zlib.decompress(blob[12 : 12 + size]), np.empty(n, PLACE), 0
    for c in PLACE.names:
        place[c] = np.frombuffer(columns, PLACE[c], n, at)
        at += n * PLACE[c].itemsize
    text = np.zeros((n, width), np.uint8)
    text[_within(place, width)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[12 + size :]), np.uint8)
    return text, place


def _dealt(text: np.ndarray, place: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """A row with the packed records of each bucket."""
    order = np.argsort(buckets, kind="stable")
    which, first = np.unique(buckets[order], return_index=True)
    parts = np.split(order, first[1:]) if len(order) else []
    none = pa.nulls(len(parts), pa.int64())
    return pa.RecordBatch.from_arrays([none] * 4 + [pa.array(which, pa.int32()), pa.array([_pack(text[p], place[p]) for p in parts], pa.binary())], schema=_FOUND_SCHEMA)


class Splitters:
    """Bounds between ranges of records; within a range, records of one gram have one bucket."""

    def __init__(self, drawn: np.ndarray, n: int):
        """drawn: sampled records; n: buckets wanted."""
        self.ranges = min(n, SPLITTERS)
        self.deal = -(-n // self.ranges)
        drawn = drawn[multikey_order(_words(drawn))] if len(drawn) else drawn
        self.bounds = drawn[np.arange(1, self.ranges) * len(drawn) // self.ranges] if len(drawn) else drawn
        self.count = (len(self.bounds) + 1) * self.deal
        self.sorted = np.ascontiguousarray(self.bounds).view(f"V{WIDTH}").ravel().tolist()

    def buckets(self, text: np.ndarray) -> np.ndarray:
        """The bucket of each record; text is sorted."""
        which, whole = np.zeros(len(text), np.int64), text.view(f"V{WIDTH}").ravel()
        for bound in self.sorted:  # a bound belongs to the range that it begins
            low, high = 0, len(whole)
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if whole[middle].tobytes() < bound else (low, middle)
            if low < len(which):
                which[low] += 1
        which = np.cumsum(which)
        if self.deal > 1:
            grams = np.array([xxhash.xxh3_64_intdigest(g) for g in np.ascontiguousarray(text[:, :GRAM]).view(f"V{GRAM}").ravel().tolist()], np.uint64)
            which = which * self.deal + (grams % np.uint64(self.deal)).astype(np.int64)
        return which

    def shared(self, text: np.ndarray, bucket: int) -> np.ndarray:
        """Bytes behind the anchor that each record has in common with a bound of its bucket."""
        out, at = np.zeros(len(text), np.int64), bucket // self.deal
        for bound in self.bounds[max(0, at - 1) : at + 1]:
            out = np.maximum(out, _common(text[:, :SPAN], bound[:SPAN]))
        return out


def _listed(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for doc_id, value in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
        text = value.as_py()
        if text:
            yield _doc(doc_id), text_hash(text), text.encode()


def _lister(splitters: Splitters) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for part in records(_listed(b)):
                parts.append(part)
                size += len(part[0])
                if size >= BUCKET:
                    yield from _sent(parts, splitters)
                    parts, size = [], 0
            if parts:
                yield from _sent(parts, splitters)

    return run


def _sent(parts: list, splitters: Splitters) -> Iterator[pa.RecordBatch]:
    text, place, later = _settled(*_joint(parts))
    yield _dealt(text, place, splitters.buckets(text))
    if len(later):
        yield _whole(later)


def _joint(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _piles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by bucket: (bucket, places of later equals) as piles are merged, then bucket with its settled records."""
    now, parts, size, bound = None, [], 0, 2 * BUCKET
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True):
            if bucket != now and parts:
                yield (now, *_settled(*_joint(parts)))
                parts, size, bound = [], 0, 2 * BUCKET
            now = bucket
            parts.append(_unpack(blob.as_py()))
            size += len(parts[-1][1])
            if size > bound:
                text, place, later = _settled(*_joint(parts))
                yield now, text[:0], place[:0], later
                parts, size = [(text, place)], len(place)
                bound = max(bound, 2 * size)
    if parts:
        yield (now, *_settled(*_joint(parts)))


def _comparer(splitters: Splitters, m: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, text, place, later in _piles(batches):
            if len(later):
                yield _whole(later)
            if len(text):
                yield from _compared(text, place, splitters.shared(text, bucket), m)

    return run


def _either(common: np.ndarray, least: int) -> np.ndarray:
    """Records that have so much in common with a neighbour."""
    near = common >= least
    return np.append(near, False) | np.insert(near, 0, False)


def _backwards(text: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each record's gram, the order by gram and the bytes before the anchor read backwards, and what neighbours in it have in common (-1: not the gram)."""
    gram = np.cumsum(np.insert(ahead < GRAM, 0, True))
    back = multikey_order([gram, *_words(text[:, SPAN:])])
    before = _common(text[back[1:], SPAN:], text[back[:-1], SPAN:])
    before[gram[back[1:]] != gram[back[:-1]]] = -1
    return gram, back, before


def _compared(text: np.ndarray, place: np.ndarray, shared: np.ndarray, m: int) -> Iterator[pa.RecordBatch]:
    """Repeats among sorted records of different bytes, and strings that must be compared across boundaries, dealt to m buckets."""
    ahead = _common(text[1:, :SPAN], text[:-1, :SPAN])
    wanted = _either(ahead, GRAM) | (shared >= GRAM)
    if not wanted.any():
        return
    # Records of a gram that no other has are left out; then grams of which no record has SPAN bytes in common with its neighbours.
    text, place, shared = text[wanted], place[wanted], shared[wanted]
    ahead = _common(text[1:, :SPAN], text[:-1, :SPAN])
    gram, back, before = _backwards(text, ahead)
    reach = np.maximum(np.append(ahead, 0), np.insert(ahead, 0, 0))
    reach[back] += np.maximum(np.append(before, 0), np.insert(before, 0, 0))
    wanted = np.bincount(gram, (reach >= SPAN) | (shared >= GRAM))[gram] > 0
    if not wanted.any():
        return
    text, place, shared, reach = text[wanted], place[wanted], shared[wanted], reach[wanted]
    n = len(text)
    ahead = _common(text[1:, :SPAN], text[:-1, :SPAN])
    gram, back, before = _backwards(text, ahead)
    hopeful = (reach >= SPAN) | (shared >= GRAM)
    by_place = np.lexsort((place["at"], place["doc"]))
    by_place = by_place[hopeful[by_place]]
    doc, at = place["doc"], place["at"]
    least, most = SPAN - place["right"].astype(np.int64), place["left"].astype(np.int64)
    repeat, open_strings = np.zeros((n, LEFT + 3), bool), []
    kind_left = np.empty(n, np.int64)
    for o in range(LEFT + 1):  # strings with o bytes before their anchor
        some = by_place[(least[by_place] <= o) & (most[by_place] >= o)]
        if not len(some):
            continue
        kind_right = np.cumsum(np.insert(ahead < SPAN - o, 0, True))
        kind_left[back] = np.cumsum(np.insert(before < o, 0, True))
        kind = kind_right[some] * (n + 1) + kind_left[some]
        order = np.argsort(kind, kind="stable")
        kind, some = kind[order], some[order]
        fresh = np.insert(kind[1:] != kind[:-1], 0, True)
        head = some[np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))]
        first = (doc[some] == doc[head]) & (at[some] == at[head])
        repeat[some[~first], LEFT + 1 - o] = True  # column 1 + LEFT - o: by rising start
        across = some[first & (shared[some] >= SPAN - o)]
        if len(across):
            strings = np.hstack([text[across, SPAN : SPAN + o][:, ::-1], text[across, : SPAN - o]])
            own = place[across]
            own["at"], own["right"], own["left"] = own["at"] - o, SPAN, 0
            open_strings.append((strings, own))
    edge = np.diff(repeat.astype(np.int8), axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    if len(row):
        yield _rows(doc[row], place["th"][row], at[row] - LEFT + lo, at[row] - LEFT + hi)
    if open_strings:
        strings, own = _joint(open_strings)
        digest = np.array([xxhash.xxh3_64_intdigest(s) for s in np.ascontiguousarray(strings).view(f"V{SPAN}").ravel().tolist()], np.uint64)
        yield _dealt(strings, own, (digest % np.uint64(m)).astype(np.int64))


def _compare_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, later in _piles(batches):
        yield _whole(later)


def _drawer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DRAWN records at most of each batch, evenly spaced."""
    for b in batches:
        found = [text[:: max(1, len(text) // 64)] for text, _ in records(_listed(b))]
        text = np.concatenate([np.zeros((0, WIDTH), np.uint8), *found])
        text = text[:: max(1, -(-len(text) // DRAWN))]
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in text], pa.binary())], names=["record"])


def _sampled(own: DataFrame, share: float) -> DataFrame:
    """About SAMPLE documents, chosen by a hash of the row."""
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30))
    return own.where(place < int(min(1.0, share) * (1 << 30))).where("text IS NOT NULL")


def _dictionary(texts: list[str]) -> bytes:
    """What texts have in common, for their compression; empty if there are too few."""
    try:
        return zstandard.train_dictionary(1 << 16, [t.encode() for t in texts]).as_bytes() if len(texts) >= 50 else b""
    except zstandard.ZstdError:
        return b""


def _unpacker(words: bytes) -> Callable[[bytes | None], bytes]:
    machine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    return lambda packed: b"" if packed is None else machine.decompress(packed)


def _packer(words: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        for b in batches:
            texts = b.column("text").to_pylist()
            packed = [None if t is None else machine.compress(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary()), pa.array([text_hash(t) for t in texts], pa.int64())], names=["doc_id", "packed", "own_th"])

    return run


def _prepared(docs: DataFrame) -> tuple[DataFrame, Splitters, bytes]:
    """docs as they are compared, the splitters, and the dictionary that packs texts."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((size["bytes"] or 0) * 2 / (LEFT + 2) / BUCKET) + 1)
    sample = _sampled(own, SAMPLE / max(1, size["n"]))
    words = _dictionary(sorted(r[0] for r in sample.select(F.substring("text", 1, SEGMENT)).limit(4 * SAMPLE).collect()))
    drawn = map_arrow(sample, _drawer, "record binary").limit(SAMPLE * DRAWN).collect()
    return own, Splitters(np.frombuffer(b"".join(r[0] for r in drawn), np.uint8).reshape(-1, WIDTH), n), words


def _repeats(own: DataFrame, splitters: Splitters) -> DataFrame:
    """doc, th (see text_hash) and spans (lo, hi: first and last start of strings that also start earlier) of documents with any."""
    m = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = map_arrow(own, _lister(splitters), _FOUND, rows=4096)
    # Repeats that are settled already travel with the records, by their document.
    tasks = min(splitters.count, 1 << 16)
    dealt = listed.repartitionById(tasks, F.coalesce(F.pmod("bucket", F.lit(tasks)), F.pmod(F.xxhash64("doc", "lo"), F.lit(tasks))).cast("int"))
    found = materialise(map_arrow(dealt.sortWithinPartitions("bucket"), _passing(_comparer(splitters, m)), _FOUND), "runs")
    settled = found.where("blob IS NULL").select("doc", "th", "lo", "hi")
    across = found.where("blob IS NOT NULL")
    if not across.isEmpty():
        strings = across.repartitionById(m, F.col("bucket")).sortWithinPartitions("bucket")
        settled = settled.unionAll(map_arrow(strings, _compare_strings, _FOUND).select("doc", "th", "lo", "hi"))
    return settled.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _passing(compare: Callable) -> Callable:
    """compare for the packed rows; the others, sorted before them, go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        for b in batches:
            through = b.column("blob").null_count
            if through:
                yield b.slice(0, through)
            if through < b.num_rows:
                yield from compare(chain([b.slice(through)], batches))

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """doc (the least long for a null doc_id), th (see text_hash) and spans (lo, hi: first and last start of strings that also start earlier) of documents with any."""
    own, splitters, _ = _prepared(docs)
    return _repeats(own, splitters)


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """raw without the strings that start within spans (first and last start), the bytes removed and the removed runs."""
    kept, at, gone, pieces, reach = [], 0, 0, 0, -1
    for lo, hi in sorted(spans):
        end = hi + SPAN
        if lo > reach:
            kept.append(raw[at:lo])
            pieces += 1
            gone += end - lo
            at = reach = end
        elif end > reach:
            gone += end - reach
            at = reach = end
    kept.append(raw[at:])
    return b"".join(kept), gone, pieces


def _cutter(words: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(words)
        for b in batches:
            rows = []
            for value, spans in zip(b.column("packed"), b.column("spans"), strict=True):
                raw = unpack(value.as_py())
                kept, gone, pieces = cut(raw, [(s["lo"], s["hi"]) for s in spans.as_py() or []])
                rows.append((len(raw), gone, pieces, kept))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, the remaining bytes)."""
    own, splitters, words = _prepared(docs)
    spans = _repeats(own, splitters)
    packed = map_arrow(own, _packer(words), "doc_id long, packed binary, own_th long")
    by_text = (F.coalesce("doc_id", F.lit(_NULL)) == F.col("doc")) & (F.col("own_th") == F.col("th"))
    return map_arrow(packed.join(spans, by_text, "left").select("doc_id", "packed", "spans"), _cutter(words), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cut_docs: DataFrame) -> DataFrame:
    return cut_docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """The same for a few documents of different ids, by a table of all strings; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(docs):
        raw, spans = (text or "").encode(), []
        for p in range(len(raw) - SPAN + 1):
            s = raw[p : p + SPAN]
            if s in seen:
                spans.append((p, p))
            seen.add(s)
        kept, gone, pieces = cut(raw, spans)
        out[doc_id] = (len(raw), gone, pieces, hashlib.sha256(kept).hexdigest())
    return out
