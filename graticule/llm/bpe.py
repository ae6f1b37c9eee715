"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

A segmentation of a piece is its BPE encoding exactly if every two neighbouring tokens are the
encoding of their joint bytes. So one token sequence belongs to each prefix of a piece, and what
follows depends on the last tokens of "live" prefixes only: those behind which a longer token may
still begin. An automaton over the trie of tokens (Aho and Corasick's) knows from one of its nodes
which prefixes are live and which tokens end. A state of the transducer is such a node and the last
tokens of the live prefixes and of those that they grew from. A transition is worked out when it
is first asked for. A token is emitted as soon as all live prefixes agree on it, so no more bytes are
ever pending than the longest token has. Every piece that is not one token goes through the transducer.

Decoding joins the bytes of ids chunk by chunk; an incremental UTF-8 state machine holds back the
bytes of a character that is not complete yet.

Defined results: null and empty texts encode to no ids and decode to the empty text; repeated rows
give equal ids; very long texts are split a million characters at a time, and time grows in proportion
for them as for very long pieces; there are no ties: a piece has one encoding; an empty table gives an
empty result; a column named as one that the operator adds is replaced.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow
from .pretokens import Splitter

#: Most states of the transducer and remembered pairs of tokens, remembered pieces beyond which the memory starts anew (keeping what is met again), and their characters. Results do not depend on them.
MAX_STATES, MAX_PIECES, MAX_PIECE_CHARS = 250_000, 200_000, 40
#: Bytes of text in an Arrow batch: a worker holds a batch's texts, ids and decoded texts at once.
TEXT_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


_NEVER = 1 << 60


class Transducer:
    """BPE of one piece (see the module's text)."""

    def __init__(self, ranks: dict[bytes, int], memory: float = 1.0):
        """memory: the share of the bounds above that is used."""
        self.memory = memory
        self.ranks, self.tokens = ranks, {r: b for b, r in ranks.items()}
        self.sizes = {r: len(b) for b, r in ranks.items()}
        self.arcs: dict[int, int] = {}
        self.accepts: list[int] = [-1]
        self.depths: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                node = self.arcs.setdefault(node << 8 | byte, len(self.accepts))
                if node == len(self.accepts):
                    self.accepts.append(-1)
                    self.depths.append(depth)
            self.accepts[node] = rank
        #: Of each node: whether no token goes on from it, and the node of its longest proper suffix that begins a token.
        self.leaf, self.suffix = [True] * len(self.accepts), [0] * len(self.accepts)
        for arc, node in sorted(self.arcs.items(), key=lambda x: self.depths[x[1]]):
            self.leaf[arc >> 8] = False
            if arc >> 8:
                self.suffix[node] = self.follow(self.suffix[arc >> 8], arc & 255)
        self.ends: dict[int, tuple[tuple, tuple]] = {0: ((), (0,))}
        self.spines: dict[int, tuple[list, list]] = {}
        self.joint: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """The start state alone: (node, last token of each prefix from the one on which all live ones agree; -1: the start, -2: nothing depends on it)."""
        start = (0, (-1,))
        self.states, self.numbers = [start], {start: 0}
        self.finals: dict[int, tuple] = {}
        self.steps: dict[int, tuple[int, tuple]] = {}

    def follow(self, node: int, byte: int) -> int:
        """The node of the longest suffix of node's bytes and byte that begins a token (a byte is always a token)."""
        arcs = self.arcs.get
        while (to := arcs(node << 8 | byte)) is None:
            node = self.suffix[node]
        return to

    def ending(self, node: int) -> tuple[tuple, tuple]:
        """The tokens that end at node, longest first, with their sizes, and the sizes of its suffixes from which tokens go on."""
        known = self.ends.get(node)
        if known is None:
            tokens, live = self.ending(self.suffix[node])
            size, rank = self.depths[node], self.accepts[node]
            known = self.ends[node] = (tokens if rank < 0 else ((size, rank), *tokens), live if self.leaf[node] else (size, *live))
        return known

    def halves(self, data: bytes) -> list[bytes]:
        """The last two parts before merges of the lowest rank, leftmost first, make data whole; more parts if they never do."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, rank: int) -> tuple[list, list] | None:
        """The parts at a token's left and right edge as merges build it, from a byte to the whole: (bytes, rank of the merge that consumes the part). None if merges don't make the token."""
        known = self.spines.get(rank)
        if known is None:
            token = self.tokens[rank]
            if len(token) == 1:
                known = ([(token, _NEVER)], [(token, _NEVER)])
            else:
                parts = self.halves(token)
                known = ()
                if len(parts) == 2 and parts[0] in self.ranks and parts[1] in self.ranks:
                    left, right = self.spine(self.ranks[parts[0]]), self.spine(self.ranks[parts[1]])
                    if left and right:
                        grown = lambda edge: [*edge[:-1], (edge[-1][0], rank), (token, _NEVER)]
                        known = (grown(left[0]), grown(right[1]))
            self.spines[rank] = known
        return known or None

    def agree(self, left: int, right: int) -> bool:
        """Whether right can follow left (-1: the start) in an encoding: no merge across their border comes before those that build the two."""
        after = self.spine(right)
        before = self.spine(left) if left >= 0 else True
        if not after or not before or left < 0:
            return bool(after and before)
        ours, theirs, i, j = before[1], after[0], 0, 0
        while True:
            (a, a_ends), (b, b_ends) = ours[i], theirs[j]
            rank = self.ranks.get(a + b, _NEVER)
            if rank < a_ends and rank <= b_ends and rank != _NEVER:
                return False
            if a_ends == b_ends == _NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def joined(self, left: int, right: int) -> bool:
        """agree(), remembered."""
        key = left << 32 | right
        known = self.joint.get(key)
        if known is None:
            if len(self.joint) >= 4 * MAX_STATES * self.memory:
                self.joint.clear()
            known = self.joint[key] = self.agree(left, right)
        return known

    def advance(self, number: int, byte: int) -> tuple[int, tuple]:
        """Determinise one transition: the state after byte, and the ids that are certain by then."""
        node, tokens = self.states[number]
        node = self.follow(node, byte)
        ending, live = self.ending(node)
        rank = next(rank for size, rank in ending if self.joined(tokens[-size], rank))
        tokens = (*tokens, rank)
        n, sizes = len(tokens), self.sizes
        alive, kept, kids = [n - 1 - size for size in live], bytearray(n), bytearray(n)
        for at in alive:
            while not kept[at]:
                kept[at] = 1
                if at:
                    at -= sizes[tokens[at]]
                    kids[at] += 1
        for at in alive:
            kept[at] = 2
        # Ids between the root and the place where the live prefixes part are certain.
        emitted, root = [], 0
        while kept[root] == 1 and kids[root] == 1:
            root += 1
            while not kept[root]:
                root += 1
            emitted.append(tokens[root])
        rest = [tokens[at] if kept[at] else -2 for at in range(root, n)]
        if kept[root] == 1:
            rest[0] = -2
        key = (node, tuple(rest))
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.states)
            self.states.append(key)
        step = self.steps[number << 8 | byte] = (found, tuple(emitted))
        return step

    def final(self, number: int) -> tuple:
        """The ids still pending in a state if the piece ends there."""
        tokens = self.states[number][1]
        out, at = [], len(tokens) - 1
        while at:
            out.append(tokens[at])
            at -= self.sizes[tokens[at]]
        ids = self.finals[number] = tuple(reversed(out))
        return ids

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES * self.memory:
            self.reset()
        state, out, steps = 0, [], self.steps.get
        for byte in piece:
            state, emitted = steps(state << 8 | byte) or self.advance(state, byte)
            if emitted:
                out += emitted
        ids = self.finals.get(state)
        return out + list(self.final(state) if ids is None else ids)


class _Known(dict):
    """The ids (little-endian i32) of pieces, worked out when they are first met."""

    def __init__(self, machine: Transducer):
        self.machine, self.old = machine, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or np.array(self.machine.encode(piece.encode()), "<i4").tobytes()
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES * self.machine.memory:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts: every match of the pattern is encoded separately; pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: float = 1.0):
        self.machine, self.pieces = Transducer(ranks, memory), Splitter(pattern).pieces
        self.known = _Known(self.machine)

    def encode(self, text: str) -> np.ndarray:
        parts = [b"".join(map(self.known.__getitem__, some)) for some in self.pieces(text)]
        return np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), "<i4")


class Decoder:
    """Bytes and text of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        tokens = {rank: token for token, rank in ranks.items()}
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(sizes))), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: np.ndarray, chunk: int = 1 << 15) -> str:
        """Text of ids, chunk by chunk."""
        stream = Utf8Stream()
        parts = [stream.feed(self.join(ids[i : i + chunk])) for i in range(0, len(ids), chunk)]
        return "".join([*parts, stream.finish()])


#: UTF-8 state machine: state 0 accepts; 1, 2 and 3 await so many continuation bytes; 4 to 7 await a second byte within narrower bounds; -1 rejects.
_SECOND = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2), 1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2)}


def _utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return -1
    low, high, after = _SECOND[state]
    return after if low <= byte <= high else -1


class Utf8Stream:
    """Text from bytes that come in chunks; malformed bytes become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:  # the last byte that can start a character
                state = 0
                for byte in data[-back:]:
                    state = _utf8_step(state, byte) if state >= 0 else -1
                if state > 0:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


_encoders: dict[tuple[int, str, float], Encoder] = {}


def _encoder(data: bytes, pattern: str, memory: float) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = (hash(data), pattern, memory)
    if key not in _encoders:
        _encoders.clear()
        gc.disable()  # millions of small tuples live long in this worker, and none of them in circles
        _encoders[key] = Encoder(parse_ranks(data), pattern, memory)
    return _encoders[key]


def release() -> None:
    """Forget the encoders of this worker."""
    if _encoders:
        _encoders.clear()
        gc.enable()
        gc.collect()


def _put(b: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = b.schema.names
    return b.set_column(names.index(name), name, values) if name in names else b.append_column(name, values)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    new = T.StructField(name, kind)
    return T.StructType([new if f.name == name else f for f in schema] + ([] if name in schema.names else [new]))


def _ranks(df: DataFrame, path: str) -> Callable[[], bytes]:
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids (array of int) of the text column. path: the rank file, below 1 MB for the public vocabularies, sent to executors once."""
    return _coded(docs, path, pattern, text, into, "", "")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of the text column and the text that they decode to, in one pass."""
    return _coded(docs, path, pattern, text, into, decoded, "")


def verified(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", verdict: str = "decodes", memory: float = 1.0) -> DataFrame:
    """docs with the ids of the text column and whether they decode to the text, in one pass that gives out no second text. memory: the share of the remembered states and pieces that a worker keeps; it costs time, not results."""
    return _coded(docs, path, pattern, text, into, "", verdict, memory)


def _coded(docs: DataFrame, path: str, pattern: str, text: str, into: str, decoded: str, verdict: str, memory: float = 1.0) -> DataFrame:
    ranks = _ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(ranks.value, pattern, memory)
        decoder = Decoder(coder.machine.ranks) if decoded or verdict else None
        for b in batches:
            coded, texts, same = [], [], []
            for value in b.column(b.schema.names.index(text)):
                own = value.as_py() or ""
                ids = coder.encode(own)
                coded.append(ids)
                if decoder:
                    back = decoder.decode(ids)
                    texts.append(back if decoded else None)
                    same.append(back == own)
            b = _put(b, into, _lists(coded))
            if decoded:
                b = _put(b, decoded, pa.array(texts, pa.string()))
            yield _put(b, verdict, pa.array(same, pa.bool_())) if verdict else b

    schema = _with(docs.schema, into, T.ArrayType(T.IntegerType()))
    schema = _with(schema, decoded, T.StringType()) if decoded else schema
    return map_arrow(docs, run, _with(schema, verdict, T.BooleanType()) if verdict else schema, n_bytes=TEXT_BYTES)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text (string) of the ids column; a null array counts as empty."""
    ranks = _ranks(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(parse_ranks(ranks.value))
        for b in batches:
            lists = b.column(b.schema.names.index(ids))
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            known = [i.is_valid for i in lists] if lists.null_count else [True] * len(lists)
            texts = [decoder.decode(values[ends[i] : ends[i + 1]]) if known[i] else "" for i in range(len(lists))]
            yield _put(b, into, pa.array(texts, pa.string()))

    return map_arrow(encoded, run, _with(encoded.schema, into, T.StringType()), n_bytes=TEXT_BYTES)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of columns doc_id, ids and decoded."""
    return decoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
