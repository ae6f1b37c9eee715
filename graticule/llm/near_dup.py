"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

1. Each document becomes the set of its distinct word shingles, a MinHash signature of BANDS x ROWS values and a
   128-bit digest of the set. Documents with equal sets are one class from then on, however many they are.
2. Classes that agree in a whole band share a bucket. Of a bucket only a star is listed: its smallest class against
   each other one. Buckets that a sample shows to be large are listed in parts, and then the parts' smallest.
3. Listed pairs are compared by batches of signature values. With a uniform prior, the similarity after m equal of n
   values is Beta(m + 1, n - m + 1); a pair is dropped once the probability that it reaches the threshold is below MISS.
   There are seven batches, so a pair is lost with a probability of 7 * MISS at most.
4. Survivors are compared on full sets. First each class with its smallest partner only; of the rest, those pairs whose
   classes are not connected yet.
5. Buckets of three or more classes that are still not connected have pairs outside their stars. Their classes are
   packed in blocks with signatures and full sets: a large component has blocks of its own, the others are dealt by the
   largest bucket that they are near. Two blocks meet if some bucket has classes of both, unless both are of one component, and are compared by
   step 3 and survivors at once on full sets. So no link between two components is lost to the star, no bucket or component is held
   by one task, and links are listed, not pairs.

Defined results: texts that are null or without words have the empty set, are linked with nothing and stay; with fewer
words than a shingle has, the whole sequence is the one shingle; repeated rows are one class; a null doc_id takes part
(it is never the smallest, and is kept only if no document with an id is in its component); very long texts are read whole;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise, sent
from .components import components

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 42, 6
#: Signature values compared at a time; probability below which a pair is given up; partners of a class compared by one reader; classes and bytes of full sets in a block.
BATCH, MISS, PARTNERS, BLOCK, BLOCK_BYTES = 36, 1e-6, 64, 512, 1 << 20
#: Classes of the sample that finds large buckets, classes in it and estimated of all from which a bucket is listed in parts, and large components' least classes; open keys (16 bytes each) and classes (40 bytes each) that are broadcast at most, partners of a block compared by one reader, and steps in which a class finds its home.
SAMPLE, LARGE, LARGE_BUCKET, SENT_KEYS, SENT_CLASSES, MEETINGS, STEPS = 20_000, 20, 1000, 1_000_000, 500_000, 32, 2
#: Words whose hashes are remembered; results do not depend on it.
MAX_WORDS = 400_000
_SPACES = b" \t\n\v\f\r"
_UPPER_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_draw = np.random.default_rng(20240101)
_MULTIPLY = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ROLL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hashes of words, worked out when they are first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def release() -> None:
    """Forget the words of this worker."""
    _words.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode().translate(_UPPER_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    first = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    rolled = first
    for k in range(1, min(size, n)):
        rolled = rolled[:-1] * _ROLL + first[k:]
    return np.unique(_mixed(rolled + np.uint64(min(size, n))))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values (u16) of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 256):
        part = found[i : i + 256, None] * _MULTIPLY
        part += _ADD
        np.minimum(least, part.min(0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def needed(n: int, percent: int, miss: float = MISS) -> int:
    """Least number of equal values of n at which a similarity of percent or more is not yet improbable."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):  # P(similarity >= t) = P(Binomial(n + 1, t) <= m)
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _survivors(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Rows at which the signatures a and b pass all batches."""
    left, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i in range(0, BANDS * ROWS, BATCH):
        same = same + (a[left, i : i + BATCH] == b[left, i : i + BATCH]).sum(1)
        stay = same >= needed(min(i + BATCH, BANDS * ROWS), percent)
        left, same = left[stay], same[stay]
        if not len(left):
            break
    return left


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _sketch(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, counts, signatures = [], [], []
            for text in b.column("text"):
                found = shingles(text.as_py(), size)
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            own = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(b.column, own), _column(digests, pa.binary()), _column(counts, pa.int64()), _column(signatures, pa.binary())], names=[*own, "node", "n", "sig"])

    return run


def _bander(large: np.ndarray, parts: int) -> Callable:
    """A row for each band of each class; part is 0, or from 1 on for buckets among large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = _band_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(n, -1)).ravel()
            nodes = b.column("node").to_pylist()
            own = np.repeat(np.array([xxhash.xxh32_intdigest(x) % parts + 1 for x in nodes], np.int32), BANDS)
            part = np.where(np.isin(keys, large), own, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part), b.column("node").take(pa.array(np.repeat(np.arange(n), BANDS)))], names=["key", "part", "node"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, part and node: (key, smallest node, other node), buckets of one left out; and of each part above 0 (key, smallest node, itself)."""
    last, pivot = (None, None), None
    for b in batches:
        keys, parts, nodes = b.column("key").to_numpy(zero_copy_only=False), b.column("part").to_numpy(zero_copy_only=False), b.column("node")
        if not len(keys):
            continue
        first = np.append(True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]))
        first[0] = (keys[0], parts[0]) != last
        listed = np.flatnonzero(~first | (parts > 0))
        starts = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
        if len(listed):
            pivots = [pivot if i < 0 else nodes[i].as_py() for i in starts[listed].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[listed]), pa.array(pivots, pa.binary()), nodes.take(pa.array(listed))], names=["key", "pivot", "node"])
        last = (keys[-1], parts[-1])
        if starts[-1] >= 0:
            pivot = nodes[int(starts[-1])].as_py()


def _pruned(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), "<u2").reshape(b.num_rows, -1) for x in ("sig_a", "sig_b"))
                left = pa.array(_survivors(a, c, percent))
                yield pa.RecordBatch.from_arrays([b.column("pivot").take(left), b.column("node").take(left)], names=["pivot", "node"])

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, found = [], []
            for node, text in zip(b.column("node").to_pylist(), b.column("text"), strict=True):
                own = shingles(text.as_py(), size).tobytes()
                if xxhash.xxh3_128_digest(own) == node:  # a row of the same doc_id and another text is not meant
                    nodes.append(node)
                    found.append(own)
            yield pa.RecordBatch.from_arrays([_column(nodes, pa.binary()), _column(found, pa.binary())], names=["node", "found"])

    return run


def _linked(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by pivot and block, the pivot's own first: the pairs that are similar. One set is held at a time."""
        own, whose = None, None
        for b in batches:
            pivots, nodes = [], []
            for pivot, node, found in zip(b.column("pivot").to_pylist(), b.column("node").to_pylist(), b.column("found"), strict=True):
                values = np.frombuffer(found.as_py(), np.uint64)
                if node is None:
                    own, whose = values, pivot
                elif pivot == whose:
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(values) - both):
                        pivots.append(pivot)
                        nodes.append(node)
            yield pa.RecordBatch.from_arrays([_column(pivots, pa.binary()), _column(nodes, pa.binary())], names=["a", "b"])

    return run


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """The bucket of each band (columns) of signatures (rows)."""
    values = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = values[:, :, 0]
    for k in range(1, ROWS):
        keys = keys * _ROLL + values[:, :, k]
    return _mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX).view(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block: the classes of each block. Near copies share most shingles and signature values: each shingle is listed once, sets are steps through that list, signatures go value by value."""
    now, held, shrink = None, [], zstandard.ZstdCompressor(level=3).compress
    names = ["nodes", "roots", "sigs", "words", "sets", "counts"]

    def packed() -> pa.RecordBatch:
        nodes, roots, sigs, sets = (b"".join(x[i] for x in held) for i in range(4))
        counts = np.array([len(x[3]) // 8 for x in held], "<i8")
        words, places = np.unique(np.frombuffer(sets, "<u8"), return_inverse=True)
        steps = np.diff(places, prepend=0)
        starts = (np.cumsum(counts) - counts)[counts > 0]
        steps[starts] = places[starts]
        columns = np.ascontiguousarray(np.frombuffer(sigs, "<u2").reshape(len(held), -1).T)
        parts = [nodes, roots, shrink(columns.tobytes()), words.astype("<u8").tobytes(), shrink(steps.astype("<u4").tobytes()), counts.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64())] + [_column([p], pa.binary()) for p in parts], names=["block", *names])

    for b in batches:
        for block, *row in zip(*(b.column(c).to_pylist() for c in ("block", "node", "root", "sig", "found")), strict=True):
            if held and block != now:
                yield packed()
                held = []
            now = block
            held.append(row)
    if held:
        yield packed()


class _Block:
    """A block of classes, unpacked."""

    def __init__(self, row: dict):
        self.nodes, self.roots = (np.frombuffer(row[c], "V16") for c in ("nodes", "roots"))
        grow = zstandard.ZstdDecompressor().decompress
        self.sigs = np.ascontiguousarray(np.frombuffer(grow(row["sigs"]), "<u2").reshape(BANDS * ROWS, -1).T)
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.ends = np.cumsum(self.counts)
        steps = np.frombuffer(grow(row["sets"]), "<u4").astype(np.int64)
        whole = np.cumsum(steps)
        before = np.concatenate([[0], whole])[self.ends - self.counts]  # what the steps of earlier classes add up to
        self.sets = np.frombuffer(row["words"], "<u8")[whole - np.repeat(before, self.counts)]

    def members(self, which: np.ndarray) -> np.ndarray:
        return np.concatenate([self.sets[self.ends[i] - self.counts[i] : self.ends[i]] for i in which])


def _across(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted so that a block (role 0) is followed by those that it meets: links between classes of different components, one for each class and component."""
        one: _Block | None = None
        for b in batches:
            a_side, b_side = [], []
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if row["role"] == 0:
                    one = _Block(row)
                    continue
                two = _Block(row)
                numbers = np.unique(np.concatenate([one.roots, two.roots]), return_inverse=True)[1]
                roots_a, roots_b = numbers[: len(one.roots)], numbers[len(one.roots) :]
                for x in range(len(one.nodes)):
                    other = np.flatnonzero(roots_b != roots_a[x])
                    if row["i"] == row["j"]:
                        other = other[other > x]
                    other = other[_survivors(np.broadcast_to(one.sigs[x], (len(other), BANDS * ROWS)), two.sigs[other], percent)]
                    if not len(other):
                        continue
                    own, theirs, sizes = one.members(np.array([x])), two.members(other), two.counts[other]
                    met = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                    both = np.add.reduceat(met, np.cumsum(sizes) - sizes, dtype=np.int64)
                    linked = other[100 * both >= percent * (len(own) + sizes - both)]
                    linked = linked[np.unique(roots_b[linked], return_index=True)[1]]
                    a_side += [one.nodes[x].tobytes()] * len(linked)
                    b_side += [two.nodes[y].tobytes() for y in linked]
            yield pa.RecordBatch.from_arrays([_column(a_side, pa.binary()), _column(b_side, pa.binary())], names=["a", "b"])

    return run


_PAIR = "pivot binary, node binary"
_PACK = "block long, nodes binary, roots binary, sigs binary, words binary, sets binary, counts binary"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (pivot, node) of which the full sets are similar, as (a, b)."""
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks"))
    dealt = pairs.join(blocks, "pivot").select("pivot", "node", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    partners = dealt.join(sets, "node").select("pivot", "block", "node", "found")
    own = dealt.select("pivot", "block").distinct().join(sets, F.col("pivot") == sets["node"]).select("pivot", "block", F.lit(None).cast("binary").alias("node"), "found")
    rows = own.unionByName(partners).repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.col("node").asc_nulls_first())
    return materialise(map_arrow(rows.select("pivot", "node", "found"), _linked(percent), "a binary, b binary"), "links")


def _roots(pairs: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """pairs with the root of the named column as <name>_root."""
    own = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return pairs.join(own, F.col(name) == F.col("_n"), "left").withColumn(f"{name}_root", F.coalesce("_r", name)).drop("_n", "_r")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept, node (digest of the set; null if empty)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(own, own, size, percent).select("doc_id", "n_shingles", "component_id", "kept", "node")


def _judged(rows: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """near_duplicates() of own (doc_id, text), with the root of each component and the columns that rows (doc_id, text, ...) has beside."""
    kept = "".join(f"{c} {t}, " for c, t in rows.dtypes if c not in ("doc_id", "text"))
    rows = rows.withColumn("_th", F.xxhash64("text"))
    sketched = materialise(map_arrow(rows, _sketch(size), f"doc_id long, {kept}_th long, node binary, n long, sig binary"), "sketches")
    # A class stands for itself by the text of the document that comes first, null ids last.
    one = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "_th"))
    classes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), one["_th"].alias("th"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes, whole = materialise(classes, "classes"), sketched
    sketched = materialise(whole.drop("sig", "_th"), "documents")
    discard(whole)
    stars = _listed(classes)
    sig = lambda name, to: classes.select(F.col("node").alias(name), F.col("sig").alias(to))
    paired = stars.select("pivot", "node").distinct().join(sig("node", "sig_b"), "node").join(sig("pivot", "sig_a"), "pivot")
    likely = materialise(map_arrow(paired.select("pivot", "node", "sig_a", "sig_b"), _pruned(percent), _PAIR), "likely")
    links = None
    roots = _none(classes)
    if not likely.isEmpty():
        wanted = likely.select("node").unionAll(likely.select(F.col("pivot").alias("node"))).distinct().join(classes.select("node", "first", "th"), "node")
        sets = _full_sets(own, wanted, size)
        links = _verified(likely.groupBy("node").agg(F.min("pivot").alias("pivot")).select("pivot", "node"), sets, percent)
        roots = materialise(components(links), "roots")
        apart = _roots(_roots(likely, roots, "pivot"), roots, "node").where("pivot_root <> node_root").select("pivot", "node")
        links, roots = _more(links, roots, materialise(apart, "apart"), sets, percent)
        discard(sets)
    discard(likely)
    # Pairs outside the stars, of buckets that hold more than one component.
    members = stars.select("key", "node").unionAll(stars.select("key", F.col("pivot").alias("node")).distinct())
    members = _roots(members, roots, "node").withColumnRenamed("node_root", "root")
    open_keys = members.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("size > 2 AND least <> most").select("key", "size")
    open_keys = materialise(open_keys, "open-keys")
    rest = materialise(members.join(sent(open_keys, SENT_KEYS), "key"), "open")
    discard(stars, open_keys)
    if not rest.isEmpty():
        found = _between(own, classes, rest, size, percent)
        if not found.isEmpty():
            roots = materialise(components(found if links is None else links.unionAll(found)), "roots")
    discard(rest)
    return _labelled(sketched, classes, roots)


def _listed(classes: DataFrame) -> DataFrame:
    """The stars of all buckets (key, pivot, node)."""
    share = min(1.0, SAMPLE / max(1, classes.count()))
    some = classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "sig")
    banded = "key long, part int, node binary"
    # At most BANDS * SAMPLE / LARGE buckets can be so large.
    large = map_arrow(some, _bander(np.zeros(0, np.int64), 1), banded).groupBy("key").count().where(F.col("count") >= max(LARGE, LARGE_BUCKET * share))
    large = np.sort(np.array([r["key"] for r in large.collect()], np.int64))
    rows = map_arrow(classes.select("node", "sig"), _bander(large, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), banded)
    star = lambda x: map_arrow(x.repartition("key", "part").sortWithinPartitions("key", "part", "node"), _stars, "key long, pivot binary, node binary")
    stars = materialise(star(rows), "stars")
    if not len(large):
        return stars
    parts = stars.where("pivot = node").select("key", F.lit(0).alias("part"), "node")
    out = materialise(stars.where("pivot <> node").unionAll(star(parts)), "stars")
    discard(stars)
    return out


def _between(own: DataFrame, classes: DataFrame, rest: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components (root) of the classes (node) in open buckets (key, size)."""
    # A class is at home in the largest bucket that it can reach in a few steps from bucket to bucket, so that near copies are packed together.
    homes = rest.select("key", "node", F.struct("size", "key").alias("home"))
    for _ in range(STEPS):
        homes = homes.groupBy("node").agg(F.max("home").alias("home")).join(rest.select("key", "node"), "node")
        homes = homes.groupBy("key").agg(F.max("home").alias("home")).join(rest.select("key", "node"), "key")
    homes = homes.groupBy("node").agg(F.max("home")["key"].alias("home"))
    nodes = rest.groupBy("node").agg(F.first("root").alias("root")).join(homes, "node").join(classes.select("node", "first", "th", "sig", "n"), "node")
    nodes = materialise(nodes, "open-classes")
    need = lambda count, words: F.ceil(F.greatest(count / BLOCK, 8 * words / BLOCK_BYTES))
    roots = nodes.groupBy("root").agg(F.count("*").alias("_k"), F.sum("n").alias("_w")).where(F.col("_k") >= BLOCK).select("root", need(F.col("_k"), F.col("_w")).alias("own_parts"))
    homes = nodes.groupBy("home").agg(F.count("*").alias("_k"), F.sum("n").alias("_w")).select("home", need(F.col("_k"), F.col("_w")).alias("home_parts"))
    total = nodes.agg(need(F.count("*"), F.sum("n"))).first()[0]
    placed = nodes.select("node", "root", "home").join(roots, "root", "left").join(homes, "home")
    alone = F.col("own_parts").isNotNull()
    block = F.when(alone, F.xxhash64("root", F.pmod(F.xxhash64("node"), "own_parts"))).otherwise(F.xxhash64(F.pmod(F.xxhash64("home"), F.lit(max(1, total))), F.pmod(F.xxhash64("node"), "home_parts")))
    placed = materialise(placed.select("node", block.alias("block"), F.when(alone, F.col("root")).alias("alone")), "placed")
    sets = _full_sets(own, nodes.select("node", "first", "th"), size)
    rows = nodes.select("node", "root", "sig").join(placed, "node").join(sets, "node").select("block", "node", "root", "sig", "found")
    packs = materialise(map_arrow(rows.repartition("block").sortWithinPartitions("block"), _pack, _PACK), "blocks")
    discard(sets)
    # The blocks of a bucket, each once, and those pairs that are not of one component.
    met = rest.select("key", "node").join(placed, "node").select("key", "block", "alone").distinct().groupBy("key").agg(F.collect_list(F.struct("block", "alone")).alias("all"))
    pairs = met.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.block <= b.block AND NOT (a.alone <=> b.alone AND a.alone IS NOT NULL)")
    pairs = pairs.select(F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    readers = pairs.groupBy("i").agg(F.ceil(F.count("*") / MEETINGS).alias("readers"))
    pairs = materialise(pairs.join(readers, "i").select("i", "j", F.pmod(F.xxhash64("j"), "readers").alias("reader")), "meetings")
    parts = ["nodes", "roots", "sigs", "words", "sets", "counts"]
    ones = pairs.select("i", "reader").distinct().join(packs, F.col("i") == F.col("block")).select("i", "reader", F.col("i").alias("j"), F.lit(0).alias("role"), *parts)
    twos = pairs.join(packs, F.col("j") == F.col("block")).select("i", "reader", "j", F.lit(1).alias("role"), *parts)
    dealt = ones.unionAll(twos).repartition("i", "reader").sortWithinPartitions("i", "reader", "role").drop("reader")
    found = materialise(map_arrow(dealt, _across(percent), "a binary, b binary", rows=8).distinct(), "links")
    discard(nodes, placed, packs, pairs)
    return found


def _none(classes: DataFrame) -> DataFrame:
    return classes.where("false").select("node", F.col("node").alias("root"))


def _full_sets(own: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets of the classes in wanted (node, first, th), from the text of each one's first document (a null doc_id matches itself)."""
    # Classes are counted: if they are few, texts are not moved to find theirs.
    found = own.join(sent(materialise(wanted, "wanted"), SENT_CLASSES), F.col("doc_id").eqNullSafe(F.col("first")) & (F.xxhash64("text") == F.col("th"))).select("node", "text")
    return materialise(map_arrow(found, _sets(size), "node binary, found binary").dropDuplicates(["node"]), "sets")


def _more(links: DataFrame | None, roots: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """Links and roots with those of pairs added."""
    if pairs.isEmpty():
        return links, roots
    found = _verified(pairs, sets, percent)
    links = found if links is None else links.unionAll(found)
    return links, roots if found.isEmpty() else materialise(components(links), "roots")


def _labelled(sketched: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents with the smallest doc_id of their component; components of one class need no join with the others."""
    rooted = _roots(classes.select("node", "first"), roots, "node")
    least = rooted.join(roots.select("root").distinct(), F.col("node_root") == F.col("root"), "left_semi").groupBy("node_root").agg(F.min("first").alias("least"))
    label = rooted.join(least, "node_root", "left").select(F.col("node").alias("_node"), F.coalesce("least", "first").alias("_label"), F.col("node_root").alias("root"))
    label = materialise(label, "labels")
    discard(classes)
    joined = sketched.withColumnRenamed("n", "n_shingles").join(label, F.col("node") == F.col("_node"), "left")
    component: Column = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_label"))
    return joined.withColumns({"component_id": component, "kept": F.col("doc_id").eqNullSafe(component)})


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates: that of the smallest doc_id; rows that repeat it stay. A verdict is of a doc_id and a text. Of a group without any doc_id one row stays."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    own = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    judged = _judged(own.withColumn("key", F.md5("text")), own, size, percent)
    nameless = "component_id IS NULL AND node IS NOT NULL"
    judged = materialise(judged.where(f"NOT kept OR {nameless}").select("doc_id", "key", "root", F.expr(nameless).alias("nameless")).distinct(), "gone")
    gone = materialise(judged.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).distinct(), "gone")
    left = docs.join(sent(gone), doc_id.eqNullSafe(F.col("_gone")) & (F.md5(text) == F.col("_key")), "left_anti")
    chosen = judged.where("nameless").groupBy("root").agg(F.min("key").alias("_key")).select("_key")
    if chosen.isEmpty():
        return left
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    rows = docs.where(doc_id.isNull()).select(F.md5(text).alias("_text"), row.alias("_row"))
    one = rows.join(chosen, F.col("_text") == F.col("_key"), "left_semi").groupBy("_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return left.unionByName(one.select("_row.*"))
