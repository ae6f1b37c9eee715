"""Adaptive context-mixing range coder for token ids.

An id is coded as the binary decisions on its way down a tree whose shape (Huffman's, of the block's ids) stands at the head
of the block. At each inner node three predictions are at hand, each with the number of times it has been confirmed: that of the node (order 0), that
of the node after the last id (order 1) and after the last two (order 2). They are mixed in the logistic domain by weights that
adapt for each pair of confidences of orders 1 and 2, and the mixed probability drives a binary range coder. Predictions
and weights start anew in every block; encoder and decoder learn the same after each decision.

A block's ids are dealt to lanes that run side by side in numpy and share one model; each lane is at its own place in its own
id. Integer arithmetic only (sums in float64 are of integers below 2 ** 53), hence equal on every machine.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np

#: Lanes of a full block, ids of a lane below which fewer lanes are used, bits of the order-1 and order-2 tables.
LANES, LEAST_IDS, BITS1, BITS2 = 8192, 128, 20, 21
#: Weights are in 65536ths: where they start, their bound, the shift of their steps, and the decisions of a lane of which one moves them.
START_WEIGHTS, MOST, SLOW, EVERY = (20000, 26000, 26000), 1 << 18, 12, 3
_TOP, _WORD, _LOW = np.uint64(1 << 32), np.uint64(32), np.uint64(0xFFFFFFFF)
_HASH1, _HASH2, _HASH3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """stretch: ln(p / (1 - p)) in 256ths of a state, a 12-bit p and a 4-bit number; squash: its inverse in 65536ths, from -2047 on; update: the next state by bit << 16 | state."""
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.repeat(np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32), 16)
    squash = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 65536 - 32).astype(np.int64)
    state = np.arange(1 << 16)
    p, n = state >> 4, state & 15
    rate = np.where(n < 15, n + 1.6, 24)
    update = [np.clip(np.rint(p + ((4095 if bit else 0) - p) / rate), 1, 4094).astype(np.int64) << 4 | np.minimum(n + 1, 15) for bit in (0, 1)]
    return stretch, squash, np.concatenate(update).astype(np.uint16)


_STRETCH, _SQUASH, _UPDATE = _tables()


def _lengths(ids: np.ndarray, size: int) -> np.ndarray:
    """Code lengths by Huffman's rule; an id that is alone has length 1."""
    counts = np.bincount(ids, minlength=size)
    met = np.flatnonzero(counts)
    lengths = np.zeros(size, np.uint8)
    if len(met) < 2:
        lengths[met] = 1
        return lengths
    heap = list(zip(counts[met].tolist(), range(len(met))))
    heapq.heapify(heap)
    parent, n = [0] * (2 * len(met) - 1), len(met)
    while len(heap) > 1:
        a = heapq.heappop(heap)
        b = heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = n
        heapq.heappush(heap, (a[0] + b[0], n))
        n += 1
    depth = [0] * n
    for i in range(n - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    lengths[met] = depth[: len(met)]
    return lengths


def _tree(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical code of each id, and the children of inner nodes at 2 * node + bit: a node, or -1 - id."""
    met = np.flatnonzero(lengths)
    met = met[np.argsort(lengths[met], kind="stable")]
    codes, child, code, before = np.zeros(len(lengths), np.uint64), [0, 0], 0, 0
    for i, size in zip(met.tolist(), lengths[met].tolist(), strict=True):
        code <<= size - before
        before = size
        codes[i] = code
        node = 0
        for k in range(size - 1, 0, -1):
            at = 2 * node + (code >> k & 1)
            if not child[at]:
                child[at] = len(child) // 2
                child += (0, 0)
            node = child[at]
        child[2 * node + (code & 1)] = -1 - i
        code += 1
    return codes, np.array(child, np.int64)


class _Lanes:
    """What encoder and decoder know before each decision, and the lanes that are still at work."""

    def __init__(self, child: np.ndarray, left: np.ndarray):
        """left: ids of each lane."""
        nodes, lanes = len(child) // 2, len(left)
        self.child = child
        self.states0 = np.full(nodes, 2048 << 4, np.uint16)
        self.states1, self.states2 = np.full(1 << BITS1, 2048 << 4, np.uint16), np.full(1 << BITS2, 2048 << 4, np.uint16)
        self.weights = np.tile(np.array(START_WEIGHTS, np.int32)[:, None], (1, 256)).astype(np.int64)
        self.lane, self.left, self.turn = np.arange(lanes), left.copy(), 0
        self.low, self.high = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.node = np.zeros(lanes, np.int64)
        self.last, self.context1, self.context2 = (np.zeros(lanes, np.uint32) for _ in range(3))
        self.own = ["lane", "left", "low", "high", "node", "last", "context1", "context2"]

    def predict(self) -> np.ndarray:
        """The last number of each lane's interval that stands for a 1."""
        mark = self.node.astype(np.uint32) * _HASH3
        self.at1 = ((self.context1 ^ mark) * _HASH1 >> np.uint32(32 - BITS1)).astype(np.int64)
        self.at2 = ((self.context2 ^ mark) * _HASH2 >> np.uint32(32 - BITS2)).astype(np.int64)
        self.states = [table.take(at).astype(np.int64) for table, at in ((self.states0, self.node), (self.states1, self.at1), (self.states2, self.at2))]
        self.row = (self.states[1] & 15) << 4 | self.states[2] & 15
        self.inputs = [_STRETCH.take(state) for state in self.states]
        mixed = self.weights[0].take(self.row) * self.inputs[0]
        mixed += self.weights[1].take(self.row) * self.inputs[1]
        mixed += self.weights[2].take(self.row) * self.inputs[2]
        mixed >>= 16
        mixed += 2047
        self.p = _SQUASH.take(mixed, mode="clip")
        return self.low + (self.high - self.low >> np.uint64(16)) * self.p.view(np.uint64)

    def decide(self, bits: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Narrow the intervals, learn, and go down the tree; returns the lanes' places that came to an id."""
        np.copyto(self.high, middle, where=bits)
        middle += np.uint64(1)
        np.copyto(self.low, middle, where=~bits)
        bits = bits.view(np.uint8).astype(np.int64) << 16
        self.turn += 1
        if self.turn % EVERY == 0:
            wrong = ((bits - self.p) >> 6).astype(np.int32)
            for weights, x in zip(self.weights, self.inputs, strict=True):
                weights += np.bincount(self.row, x * wrong, 256).astype(np.int64) >> SLOW
            np.clip(self.weights, -MOST, MOST, out=self.weights)
        self.states0[self.node] = _UPDATE.take(self.states[0] + bits)
        self.states1[self.at1] = _UPDATE.take(self.states[1] + bits)
        self.states2[self.at2] = _UPDATE.take(self.states[2] + bits)
        self.node = self.child.take((self.node << 1) + (bits >> 16))
        return np.flatnonzero(self.node < 0)

    def met(self, at: np.ndarray) -> np.ndarray:
        """Lanes at have come to an id: the ids."""
        ids = -1 - self.node[at]
        self.node[at] = 0
        self.left[at] -= 1
        mark = ids.astype(np.uint32) + np.uint32(1)
        self.context2[at] = self.last[at] * _HASH2 + mark * _HASH1
        self.context1[at] = mark * _HASH2
        self.last[at] = mark
        return ids

    def settled(self, at: np.ndarray | None = None) -> np.ndarray:
        """Lanes (of those at) whose intervals have a high word that will not change."""
        if at is None:
            return np.flatnonzero((self.low ^ self.high) < _TOP)
        return at[(self.low[at] ^ self.high[at]) < _TOP]

    def go_on(self, which: np.ndarray) -> None:
        for name in self.own:
            setattr(self, name, getattr(self, name)[which])


def _shape(n: int) -> np.ndarray:
    """Ids of each lane."""
    lanes = max(1, min(LANES, n // LEAST_IDS))
    steps = -(-n // lanes)
    return np.clip(n - np.arange(lanes) * steps, 0, steps)


def encode(ids: np.ndarray, size: int) -> bytes:
    """The coded ids (each below size) of one block."""
    lengths = _lengths(ids, size)
    codes, child = _tree(lengths)
    left = _shape(len(ids))
    ids = np.append(ids, 0)  # what a lane that has ended would read next
    sizes = lengths.astype(np.uint64)
    work = _Lanes(child, left)
    work.at = np.cumsum(left) - left  # the place of each lane's present id, its code, and how many bits of it are to come
    work.code, work.ahead = codes[ids[work.at]], sizes[ids[work.at]]
    work.own = [*work.own, "at", "code", "ahead"]
    lanes, words = [], []
    work.go_on(left > 0)
    while len(work.lane):
        work.ahead -= np.uint64(1)
        found = work.decide((work.code >> work.ahead & np.uint64(1)).astype(bool), work.predict())
        done = work.settled()
        while len(done):
            lanes.append(work.lane[done])
            words.append((work.low[done] >> _WORD).astype(np.uint32))
            work.low[done] <<= _WORD
            work.high[done] = work.high[done] << _WORD | _LOW
            done = work.settled(done)
        if len(found):
            work.met(found)
            work.at[found] += 1
            now = ids[work.at[found]]
            work.code[found], work.ahead[found] = codes[now], sizes[now]
            if len(over := found[work.left[found] == 0]):
                for word in (work.low[over] >> _WORD, work.low[over] & _LOW):
                    lanes.append(work.lane[over])
                    words.append(word.astype(np.uint32))
                work.go_on(work.left > 0)
    lane = np.concatenate([np.zeros(0, np.int64), *lanes])
    out = np.concatenate([np.zeros(0, np.uint32), *words])[np.argsort(lane, kind="stable")]
    head = zlib.compress(lengths.tobytes() + np.bincount(lane, minlength=len(left)).astype("<u4").tobytes(), 6)
    return len(head).to_bytes(4, "little") + head + out.astype("<u4").tobytes()


def decode(data: bytes, n: int, size: int) -> np.ndarray:
    """The n ids of a block that encode() made."""
    start = 4 + int.from_bytes(data[:4], "little")
    head = zlib.decompress(data[4:start])
    _, child = _tree(np.frombuffer(head, np.uint8, size))
    left = _shape(n)
    used = np.frombuffer(head, "<u4", len(left), size).astype(np.int64)
    words = np.append(np.frombuffer(data, "<u4", offset=start), [0, 0]).astype(np.uint64)
    work = _Lanes(child, left)
    work.at = np.cumsum(used) - used
    work.code = words[work.at] << _WORD | words[np.minimum(work.at + 1, len(words) - 1)]
    work.at += 2
    work.into = np.cumsum(left) - left
    work.own += ["at", "code", "into"]
    out = np.zeros(n, np.int32)
    work.go_on(left > 0)
    while len(work.lane):
        middle = work.predict()
        found = work.decide(work.code <= middle, middle)
        done = work.settled()
        while len(done):
            work.low[done] <<= _WORD
            work.high[done] = work.high[done] << _WORD | _LOW
            work.code[done] = work.code[done] << _WORD | words[np.minimum(work.at[done], len(words) - 1)]
            work.at[done] += 1
            done = work.settled(done)
        if len(found):
            out[work.into[found]] = work.met(found)
            work.into[found] += 1
            if (work.left[found] == 0).any():
                work.go_on(work.left > 0)
    return out
