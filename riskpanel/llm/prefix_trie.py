r"""Conversation prefix trie, summed up by time-forward processing.

Each distinct sequence of the first d turns (role, text) of some conversation is a node of depth d below the
textless root; a node is named by (smallest member conversation, depth). Members, children, leaves below and the
text bytes that a shared prefix saves (its bytes times members but one, over the subtree) come from three passes:

1. ``paths``: one row a (conversation, depth) with a 128-bit hash chained over SHA-256 hashes of the turns. ``nodes`` groups them by
   hash (combined before the shuffle, so a node of a third of all conversations is a few rows a task).
2. Within shards. A node with more than ``conversations / width`` members is a top node; every largest subtree without top
   nodes is a shard. Its nodes are sorted by reverse level order (Spark's external sort) and processed
   forward in time: a node takes the totals that its children left in a priority queue, and leaves its own for its parent.
   The queue keeps at most ``held`` messages in memory and spills sorted runs; a parent's messages are added up as they are taken, one
   at a time, and its children leave their rows through it, so that they learn their parent's name.
3. Across shard roots. The roots' totals are added up by parent in Spark and injected into the top nodes, which are processed the same way.
   There are fewer than ``width`` top nodes a level, whatever the input, so this last pass and its broadcast are bounded.

Runs are spilled to unnamed files of the task's own scratch space, which vanish with the task: no other process reads them, a lost
executor repeats the task. ``ends`` hashes the ids of the conversations that end at a node: ids are range-sorted, joined
into pieces by many tasks, and one streaming digest goes over the pieces of a node, as SHA-256 has no parallel form.

Defined results: a null role or text counts as empty. Ids are whole numbers. Turns go by turn (nulls first), then role, then a hash of the text, so ties
and repeated rows have a fixed order; all of them stay. Rows without a conversation id belong to no conversation and are
left out, as no node could be named by them. A conversation without turns is a member of the root. An empty table gives no
node. A conversation's turns are streamed by one task, which holds one turn's hash.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only, partitions

ROOT = bytes(16)
PATH = "conv long, depth long, key binary, parent binary, bytes long, ends boolean"
NODE = "key binary, parent binary, depth long, conv long, parent_conv long, members long, children long, leaves long, saved long"
PIECE = 1 << 16


def turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, turn_hash, bytes): turns numbered from 1 within their conversation, without texts."""
    src = only(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = src.select(F.col("conv").cast("long").alias("conv"), "turn", role.alias("role"), F.unhex(F.sha2(whole, 256)).alias("turn_hash"),
                      F.octet_length(text).cast("long").alias("bytes"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_hash"))
    return rows.select("conv", place.cast("long").alias("place"), "turn_hash", "bytes")


def with_shared_openings(rows: DataFrame, group: int, opening: Callable[[Column], Column]) -> DataFrame:
    """Conversations rebuilt: the first ``opening(c)`` turns of conversation c - c % group, then c's own after as many.

    ``opening`` gives 8 at most. Rows are those of :func:`turn_rows`, each dealt at once to the conversations that get it, with a row of
    place 0 for every conversation that exists; :func:`paths` leaves out conversations without it.
    """
    conv, place, none = F.col("conv"), F.col("place"), F.lit(None)
    lender = conv % group == 0
    to = lambda c, at: F.struct(c.alias("conv"), at.alias("place"))
    dealt = [F.when(lender | (place > opening(conv)), to(conv, place)), F.when(place == 1, to(conv, F.lit(0).cast("long")))]
    for j in range(1 - group, group):
        c = conv + j
        if j:
            dealt.append(F.when(lender & (place <= 8) & (c - c % group == conv) & (place <= opening(c)), to(c, place)))
    return rows.select(F.explode(F.array(*dealt)).alias("t"), "turn_hash", "bytes").filter(F.col("t").isNotNull()).select(
        "t.conv", "t.place", F.when(F.col("t.place") > 0, F.col("turn_hash")).otherwise(none).alias("turn_hash"), "bytes")


def openers(rows: DataFrame) -> DataFrame:
    """A row of place 0 for each conversation of :func:`turn_rows`."""
    return rows.filter("place = 1").select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_hash"),
                                           F.lit(0).cast("long").alias("bytes"))


def paths(rows: DataFrame) -> DataFrame:
    """One row (:data:`PATH`) a conversation and depth, the root included; ``ends`` marks its last one."""
    def run(batches: Iterator):
        import pyarrow as pa
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in PATH.split(", ")]
        last, out = None, []
        for b in batches:
            for conv, place, turn, size in zip(*(b.column(c).to_pylist() for c in ("conv", "place", "turn_hash", "bytes"))):
                if place == 0:
                    row = (conv, 0, ROOT, None, 0)
                elif last and last[0] == conv:
                    key = hashlib.blake2b(last[2] + turn, digest_size=16).digest()
                    row = (conv, last[1] + 1, key, last[2], size)
                else:
                    continue  # lent to a conversation that isn't there
                if last:
                    out.append((*last, last[0] != conv))
                last = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                out = []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, True), types)], names=names)

    return rows.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, PATH)


def nodes(steps: DataFrame) -> DataFrame:
    """(key, parent, depth, conv, members, bytes) of each node, from :func:`paths`."""
    return steps.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"),
                                    F.count("*").alias("members"), F.max("bytes").alias("bytes"))


class Messages:
    """A priority queue of (level, key, payload), the deepest level first, then the smallest key.

    At most ``held`` messages are in memory; beyond them a sorted run is spilled to an unnamed file. Many runs are merged into one.
    """

    def __init__(self, held: int = 200_000, folder: str | None = None, fan: int = 32):
        self.heap: list = []
        self.runs: list = []  # (first message, its number, reader)
        self.held, self.fan, self.n = held, fan, 0
        self.folder = folder or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None

    def push(self, level: int, key: bytes, payload) -> None:
        self.n += 1
        heapq.heappush(self.heap, (-level, key, self.n, payload))
        if len(self.heap) >= self.held:
            self.spill(iter(sorted(self.heap)))
            self.heap = []
            if len(self.runs) >= self.fan:
                runs = [self.resume(first, reader) for first, reader in self.runs]
                self.runs = []
                self.spill(heapq.merge(*runs))

    @staticmethod
    def resume(first, reader) -> Iterator:
        yield first
        yield from reader

    def spill(self, messages: Iterator) -> None:
        file = tempfile.TemporaryFile(dir=self.folder)
        for m in messages:
            pickle.dump(m, file, protocol=pickle.HIGHEST_PROTOCOL)
        file.seek(0)

        def read():
            with file:
                while True:
                    try:
                        yield pickle.load(file)
                    except EOFError:
                        return

        reader = read()
        heapq.heappush(self.runs, (next(reader), reader))

    def take(self, level: int, key: bytes) -> Iterator:
        """The payloads for a node; it must not lie before any message that is still here."""
        while True:
            best = self.heap[0] if self.heap else None
            if self.runs and (best is None or self.runs[0][0] < best):
                best, from_run = self.runs[0][0], True
            else:
                from_run = False
            if best is None or best[:2] != (-level, key):
                return
            if from_run:
                _, reader = heapq.heappop(self.runs)
                after = next(reader, None)
                if after is not None:
                    heapq.heappush(self.runs, (after, reader))
            else:
                heapq.heappop(self.heap)
            yield best[3]


def time_forward(held: int):
    """For mapInArrow over nodes sorted by depth downwards, then key: rows of :data:`NODE`.

    A node's children, leaves and saved bytes are those given (``children``, ``leaves``, ``saved``, of other shards) plus its children's here.
    A row leaves once its parent is processed; at the end of the shard the rows whose parents lie elsewhere leave without ``parent_conv``.
    """
    def run(batches: Iterator):
        import pyarrow as pa
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in NODE.split(", ")]
        queue, out = Messages(held), []
        columns = ("key", "parent", "depth", "conv", "members", "bytes", "shard_root", "children", "leaves", "saved")

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        for b in batches:
            for key, parent, depth, conv, members, size, root, children, leaves, saved in zip(*(b.column(c).to_pylist() for c in columns)):
                for child in queue.take(depth, key):
                    children, leaves, saved = children + 1, leaves + child[4], saved + child[5]
                    out.append((child[0], key, depth + 1, child[1], conv, *child[2:]))
                    if len(out) >= 8192:
                        yield batch()
                        out = []
                saved += (members - 1) * size
                leaves += children == 0
                if root:
                    out.append((key, parent, depth, conv, None, members, children, leaves, saved))
                else:
                    queue.push(depth - 1, parent, (key, conv, members, children, leaves, saved))
            if out:
                yield batch()
                out = []
        if queue.heap or queue.runs:
            raise ValueError("a node's parent is missing from its shard")

    return run


def ends(steps: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the comma-joined decimal ids, ascending, of the conversations that end at a node."""
    def pieces(batches: Iterator):
        import pyarrow as pa
        key, first, ids, size = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])],
                                              names=["key", "first", "ids"])
        for b in batches:
            for k, conv in zip(b.column("key").to_pylist(), b.column("conv").to_pylist()):
                if k != key or size >= PIECE:
                    if ids:
                        yield row()
                    key, first, ids, size = k, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield row()

    def digests(batches: Iterator):
        import pyarrow as pa
        key, digest, out = None, None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out])],
                                              names=["key", "ends_sha256"])
        for b in batches:
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if k != key:
                    if digest:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield batch()
                out = []
        if digest:
            out.append((key, digest.hexdigest()))
            yield batch()

    n = partitions(steps.sparkSession)
    # sorted pieces of ids, made by many tasks however many conversations end at one node
    joined = steps.filter("ends").select("key", "conv").repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv") \
        .mapInArrow(pieces, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, width: int = 10_000, least: int = 64, held: int = 200_000) -> DataFrame:
    """(conv, depth, parent_conv, members, children, leaves, saved, ends_sha256) of each node.

    ``rows`` are those of :func:`turn_rows` with :func:`openers`, or of :func:`with_shared_openings`. Nodes of more than
    ``max(least, conversations / width)`` members are top nodes.
    """
    steps = materialize(paths(rows), "paths")
    found = materialize(nodes(steps), "nodes")
    n = found.filter("depth = 0").agg(F.max("members")).first()[0] or 0
    limit = max(least, n // width)
    # fewer than ``width`` a level
    top = found.filter(F.col("members") > limit)
    heavy = F.broadcast(top.select("key", F.lit(True).alias("heavy")))
    light = steps.join(heavy, "key", "left").filter("heavy is null")
    # the shard of a conversation's nodes: its first one below the top
    shards = light.groupBy("conv").agg(F.min_by("key", "depth").alias("shard"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    below = found.filter(F.col("members") <= limit).join(shards, "conv").withColumn("shard_root", F.col("shard") == F.col("key"))
    within = below.select("key", "parent", "depth", "conv", "members", "bytes", "shard_root", *zero, "shard") \
        .repartition("shard").sortWithinPartitions(F.col("depth").desc(), "key").drop("shard").mapInArrow(time_forward(held), NODE)
    within = materialize(within, "shards")
    roots = within.filter("parent_conv is null and depth > 0")
    # roots' totals for the top nodes; a lower node's parent_conv is never null
    given = roots.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    filled = top.join(given, "key", "left").fillna(0, ["children", "leaves", "saved"]).withColumn("shard_root", F.col("depth") == 0)
    across = materialize(filled.repartition(1).sortWithinPartitions(F.col("depth").desc(), "key").mapInArrow(time_forward(held), NODE), "top")
    names = F.broadcast(across.select(F.col("key").alias("parent"), F.col("conv").alias("top_conv")))
    every = within.join(names, "parent", "left").withColumn("parent_conv", F.coalesce("parent_conv", "top_conv")).drop("top_conv") \
        .select(across.columns).unionByName(across)
    return every.join(ends(steps), "key", "left").select(
        "conv", "depth", "parent_conv", "members", "children", "leaves", "saved",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
