"""The prefix trie of conversations: one row for each distinct sequence of first turns, with counts of what lies below it.

A conversation is the sequence of its turns' digests (16 bytes of the SHA-256 of role and text), so no text travels or is compared twice. Sequences
are dealt out by range, in
the order of (sequence, conv_id): Spark samples the bounds, and a conversation of which there are very many copies is divided by conv_id.

Within a range a task sorts externally. Runs of RUN bytes are sorted, each sequence with its LCP, the turns that it shares with the
one before. Several runs go to the shared folder and come back by batches through a tree of losers, which compares LCPs first and turns from there on
only,
so shared turns are not compared again. The merged stream with its LCPs feeds a stack, the open path from the root: what is
longer than the LCP is finished, and its counts go to its parent.

Nodes on the path of a range's first or last conversation may go on in another range. They leave their range unfinished, and one task reads them in
order, some for each range and level, and finishes them with the same stack. A parent's smallest member is known once it is finished: children
look it up by a join.

Defined results: null role or text count as empty; turns stand in the order of turn (nulls first), equal ones in that of their digests, repeated ones
stay; an empty table gives no node, a conversation of no turns is a member of the root; conversations with a null conv_id are one conversation, a
member that is never the smallest unless alone and is not listed among those that end; only the four columns are read. The longest conversation is one
row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, map_arrow, materialise, sent, shared_dir

#: Bytes of a turn's digest; bytes of sequences that a run holds; sequences of a batch that is read back from a run; bytes of a row that lists who
#: ends at an unfinished node.
TURN, RUN, READ, LISTED = 16, 48 << 20, 512, 1 << 16

SEQUENCES = "conv_id long, path binary, chars array<int>"
_RUN = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("chars", pa.list_(pa.int32())), ("lcp", pa.int32())])
#: Finished nodes (part is null) and unfinished ones, which have counts of their finished parts only, and who ends there in rows of their own.
NODES = "part long, place long, node binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"
_NODES = pa.schema([
    ("part", pa.int64()), ("place", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
    *((c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars")), ("ends", pa.string()),
])


def sequences(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns in order (see SEQUENCES): digests, and how many code points their texts have."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.length(text).cast("int").alias("chars"),
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)).alias("digest"),
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", "digest", "chars")))
    rows = own.groupBy("conv_id").agg(turns.alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").alias("_hex"), F.transform("turns", lambda t: t["chars"]).alias("chars")).select("conv_id", F.unhex("_hex").alias("path"), "chars")


def rebuilt(own: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Sequences of which the first h turns are those of the group's first conversation, c - c % group; h = crc32(decimal c) % (most + 1)."""
    own = materialise(own, "sequences")
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.substring("path", 1, most * TURN).alias("_path"), F.slice("chars", 1, most).alias("_chars"))
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), F.lit(0)).cast("int")
    joined = own.withColumn("_h", h).join(sent(materialise(base, "bases")), F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left")
    head = F.when(F.col("conv_id").isNull(), F.lit(b"")).otherwise(F.coalesce(F.expr(f"substring(_path, 1, _h * {TURN})"), F.lit(b"")))
    first = F.coalesce(F.slice("_chars", F.lit(1), F.col("_h")), F.array().cast("array<int>"))
    return joined.select("conv_id", F.concat(head, F.expr(f"substring(path, _h * {TURN} + 1, octet_length(path))")).alias("path"), F.concat(first, F.expr("slice(chars, _h + 1, size(chars))")).alias("chars"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many first turns two sequences have in common, of which `known` are known to be."""
    most = min(len(a), len(b)) // TURN
    at, step = known, 4
    while at < most:  # long stretches at once, then the turn that differs
        end = min(most, at + step)
        if a[at * TURN : end * TURN] == b[at * TURN : end * TURN]:
            at, step = end, step * 4
        elif end == at + 1:
            return at
        else:
            step = max(1, (end - at) // 2)
    return at


def _key(row: tuple) -> tuple:
    return row[1], row[0] is not None, row[0] or 0


def sorted_run(rows: list[tuple]) -> Iterator[tuple]:
    """(conv_id, path, chars, lcp) in order, from unordered (conv_id, path, chars)."""
    before = b""
    for conv, path, chars in sorted(rows, key=_key):
        yield conv, path, chars, shared_turns(before, path)
        before = path


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """One sorted stream of several, each row with its LCP to the row before, by a tree of losers.

    Leaves hold each run's next row with its LCP to the row that went out last; an inner node holds who lost there, and its LCP to who won. Between
    two rows
    with different LCPs the larger one is first; only equal LCPs have turns compared, from there on.
    """
    k = len(runs)
    heads: list[tuple | None] = [None] * k
    lcp = [0] * k
    losers = [-1] * k  # losers[0]: the winner

    def advance(i: int) -> None:
        row = next(runs[i], None)
        heads[i] = row
        lcp[i] = row[3] if row else -1

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP is to the winner from now on."""
        if a < 0 or b < 0:
            return max(a, b), min(a, b)
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        same = shared_turns(x[1], y[1], lcp[a])
        at = same * TURN
        left, right = x[1][at : at + TURN], y[1][at : at + TURN]
        first = _key(x) < _key(y) if left == right else left < right
        winner, loser = (a, b) if first else (b, a)
        lcp[loser] = same
        return winner, loser

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    for i in range(k):
        advance(i)
        lcp[i] = 0 if heads[i] else -1
    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        conv, path, chars, _ = heads[winner]
        yield conv, path, chars, lcp[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class _Stack:
    """The open path. Nodes are lists: digest of the prefix, its parent's, smallest member, members, children, leaves, saved tokens, code points, who
    ends there, and whether it may have begun in another range."""

    def __init__(self) -> None:
        self.path: list[list] = []

    def push(self, turn: bytes, chars: int, began: bool) -> None:
        parent = self.path[-1][0] if self.path else None
        own = hashlib.blake2b((parent or b"") + turn, digest_size=TURN).digest()
        self.path.append([own, parent, None, 0, 0, 0, 0, chars, [], began])

    def pop(self) -> tuple[list, int]:
        """The last node with its depth; members go to its parent, and all else if it is finished."""
        node = self.path.pop()
        if self.path:
            up = self.path[-1]
            up[2] = _least(up[2], node[2])
            up[3] += node[3]
            if not node[9]:
                settle(node)
                up[4] += 1
                up[5] += node[5]
                up[6] += node[6]
        return node, len(self.path)


def settle(node: list) -> None:
    node[5] += node[4] == 0
    node[6] += (node[3] - 1) * node[7]


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def finished(node: list, depth: int) -> tuple:
    ends = hashlib.sha256(",".join(map(str, node[8])).encode()).hexdigest()
    return None, None, node[0], node[1], node[2], depth, node[3], node[4], node[5], node[6], node[7], ends


def unfinished(node: list, depth: int, part: int, places: Iterator[int]) -> Iterator[tuple]:
    """A row of counts, and rows of who ends there."""
    counts = (node[0], node[1], node[2], depth, node[3], node[4], node[5], node[6], node[7])
    yield part, next(places), *counts, None
    text, size = [], 0
    for k, conv in enumerate(node[8]):
        text.append(str(conv))
        size += len(text[-1]) + 1
        if size >= LISTED or k == len(node[8]) - 1:
            yield part, next(places), node[0], None, None, depth, 0, 0, 0, 0, 0, ",".join(text)
            text, size = [], 0


def nodes_of(stream: Iterator[tuple], part: int) -> Iterator[tuple]:
    """Rows of NODES from a range's sorted stream: those that are finished as they are, those on the first or last path at the end."""
    stack, first, began = _Stack(), True, []
    for conv, path, chars, lcp in stream:
        if first:
            stack.push(b"", 0, True)
        while len(stack.path) > lcp + 1:
            node, depth = stack.pop()
            if node[9]:
                began.append((node, depth))
            else:
                yield finished(node, depth)
        for i in range(lcp, len(path) // TURN):
            stack.push(path[i * TURN : (i + 1) * TURN], chars[i], first)
        end = stack.path[-1]
        if conv is not None:
            end[8].append(conv)
        end[2] = _least(end[2], conv)
        end[3] += 1
        first = False
    last = []
    while stack.path:
        stack.path[-1][9] = True
        last.append(stack.pop())
    # The common part of both paths, the rest of the first path, the rest of the last one: all in order from the root.
    both = [x for x in last if not began or x[1] < min(d for _, d in began)]
    places = iter(range(1 << 62))
    for node, depth in both[::-1] + began[::-1] + last[: len(last) - len(both)][::-1]:
        yield from unfinished(node, depth, part, places)


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _read(folder: str, name: str) -> Iterator[tuple]:
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/{name}") as source, pa.ipc.open_stream(source) as reader:
        for b in reader:
            yield from zip(*(c.to_pylist() for c in b.columns))


def _tries(folder: str, run_bytes: int):
    """A task's range: runs of at most run_bytes, merged if there are several, through the stack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        rows: list[tuple] = []
        size, names = 0, []

        def store() -> None:
            fs, base = file_system(folder)
            fs.create_dir(base, recursive=True)
            names.append(f"{part:06d}-{attempt}-{len(names)}.arrow")
            with fs.open_output_stream(f"{base}/{names[-1]}") as sink, pa.ipc.new_stream(sink, _RUN) as writer:
                for b in _batches(sorted_run(rows), _RUN, READ):
                    writer.write_batch(b)
            rows.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "path", "chars"))):
                rows.append(row)
                size += 200 + 2 * len(row[1])
                if size >= run_bytes:
                    store()
                    size = 0
        if names and rows:
            store()
        stream = merged([_read(folder, name) for name in names]) if names else sorted_run(rows)
        yield from _batches(nodes_of(stream, part), _NODES, 4096)
        if names:
            fs, base = file_system(folder)
            for name in names:
                fs.delete_file(f"{base}/{name}")

    return run


def resolved(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Finished rows of NODES from the unfinished ones of all ranges in their order."""
    path: list[list] = []  # as in _Stack, with a SHA-256 in place of who ends there

    def close() -> tuple:
        node = path.pop()
        settle(node)
        if path:
            up = path[-1]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]
        ends = (node[8] or hashlib.sha256()).hexdigest()
        return None, None, node[0], node[1], node[2], len(path), node[3], node[4], node[5], node[6], node[7], ends

    for _, _, own, parent, conv, depth, n, children, leaves, saved, chars, ends in rows:
        if len(path) <= depth or path[depth][0] != own:  # else it goes on, and with it perhaps what is below
            while len(path) > depth:
                yield close()
            path.append([own, parent, None, 0, 0, 0, 0, chars, None])
        node = path[depth]
        if ends is not None:
            if node[8] is None:
                node[8] = hashlib.sha256()
            else:
                node[8].update(b",")
            node[8].update(ends.encode())
            continue
        node[2] = _least(node[2], conv)
        for at, value in ((3, n), (4, children), (5, leaves), (6, saved)):
            node[at] += value
    while path:
        yield close()


def _resolver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(resolved(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), _NODES, 4096)


def trie(own: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of sequences (see SEQUENCES)."""
    spark = own.sparkSession
    own = materialise(own.select("conv_id", "path", "chars"), "rebuilt")
    ranged = own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "conv_id")
    found = materialise(map_arrow(ranged, _tries(shared_dir(spark, "runs"), run_bytes), NODES), "nodes")
    # A few rows for each range and each level of its first and last path.
    opened = found.where("part IS NOT NULL").repartition(1).sortWithinPartitions("part", "place")
    rest = materialise(map_arrow(opened, _resolver, NODES), "open-nodes")
    every = found.where("part IS NULL").unionByName(rest)
    parents = materialise(every.where("n_children > 0").select(F.col("node").alias("_node"), F.col("conv_id").alias("parent_conv_id")), "parents")
    joined = every.join(sent(parents), F.col("parent") == F.col("_node"), "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
