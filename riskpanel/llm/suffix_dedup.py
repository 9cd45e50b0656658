r"""Exact-substring deduplication: suffix sorting by bucket-pointer refinement.

Every byte covered by a ``length``-byte string that also starts anywhere else goes. Sorting
all suffixes of a corpus in one place doesn't scale, so the strings are first dealt out such that
equal ones meet:

1. Each ``length``-byte window has an anchor, the ``ANCHOR``-byte string in it with the smallest
   hash (the leftmost of equals). Equal windows have equal anchors. A run of windows with the
   same anchor is a block; there is one for about 80 bytes (``blocks``).
2. Blocks are counted by anchor and by content. A block with an anchor of its own holds nothing
   repeated. A block whose content occurs again (copies share all their inner blocks) is
   repeated as a whole, whatever the size of the group; only counts decide that.
3. What is left are differing blocks with a common anchor, at the edges of copied passages. Of
   those, one instance of each content is fetched (``edges``) and windows are compared by suffix
   sorting inside groups of one anchor (``refine``): initial buckets by the first q bytes; then a
   suffix's bucket identifier is refined by that of the suffix q bytes on, which doubles
   the depth each round; identifiers of a round are used by all of its later rounds, buckets
   of one suffix drop out, and after reaching ``length`` bytes the buckets of two or more suffixes are
   the repeated windows.
4. A crowded anchor (more than ``crowded`` differing contents) isn't sent to one task: its blocks
   are cut into stretches of ``STRETCH`` windows by distance from the anchor, and stretches
   are grouped by the bytes that all their windows share. Equal windows have equal distances
   and equal shared bytes, so this loses none. Equal stretches are counted (those inside a passage
   are equal in all of its copies) and one instance of each is compared as above; where more than
   ``crowded`` differing ones are left in a group, single windows are counted by hash.

Texts are UTF-8 bytes (null: empty) and matches never cross rows. Defined results: empty
and short texts keep all bytes; rows that repeat an id are separate texts that count as
repeating each other; an empty table gives an empty result. Every task holds one batch of
texts, or whole anchor groups up to about ``GROUP_BYTES`` of edges. Rows are numbered and
their texts compressed once into a written table (``prepare``), as texts are shuffled twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import binary_values, held, materialize, only, ranges, tidy

ANCHOR, STRETCH, GROUP_BYTES = 40, 16, 1_000_000
BASE, MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    size = 1 << max(16, (n - 1).bit_length())
    return held(f"powers {size}", lambda: (_powers(size, BASE), _powers(size, pow(BASE, -1, 1 << 64))))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all ``size``-byte strings of a byte array."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _tables_for(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[size:] - total[:-size]) * down[:n - size + 1]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` entries."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Blocks of texts that lie one after the other in ``data``: (text, first window's offset in the
    text, number of windows, anchor's offset, anchor hash)."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    h = window_hashes(data, ANCHOR)
    if len(h) >> 32:
        raise ValueError("a text must be under 4 GB")
    # the hash's high 32 bits (as many in every batch), then the place: leftmost of the smallest
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = _sliding_min(key, length - ANCHOR + 1) & low
    start = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    if not count.sum():
        return none
    window = ranges(start, count)
    at = best[window].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    text = np.repeat(np.arange(len(sizes)), count)[first]
    n = np.diff(np.append(first, len(at)))
    return text, window[first] - start[text], n, at[first] - start[text], h[at[first]]


def _split(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def prepare(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a row number and its text as zstd bytes (null stays null), written once: columns row, z
    and c0, c1, ... for the others in their order, so that no name of theirs clashes with one in here."""
    others = [f"c{i}" for i in range(len(docs.columns) - 1)]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(others, [c for c in docs.columns if c != text_col])],
                      F.col(f"`{text_col}`").alias("z"))

    def run(batches: Iterator):
        import pyarrow as pa
        from zstandard import ZstdCompressor
        pack = ZstdCompressor(level=3).compress
        for b in batches:
            z = pa.array([None if t is None else pack(t) for t in binary_values(b, "z")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), z], names=[*others, "z"])

    schema = StructType([src.schema[c] for c in others]).add("z", "binary")
    return materialize(src.mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id()), "numbered")


def unpacked(batch, name: str = "z") -> list[bytes | None]:
    from zstandard import ZstdDecompressor
    unpack = ZstdDecompressor().decompress
    return [None if z is None else unpack(z) for z in batch.column(name).to_pylist()]


def blocks(prepared: DataFrame, length: int) -> DataFrame:
    """(row, start, n, lead, anchor, content): windows start .. start + n - 1 of text ``row``
    share the anchor, which lies ``lead`` bytes after the first of them."""
    def run(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as content_hash
        for b in batches:
            rows, texts = b.column("row").to_numpy(), [t or b"" for t in unpacked(b)]
            for lo, hi in _split(texts):
                own = texts[lo:hi]
                text, start, n, at, h = anchors(np.frombuffer(b"".join(own), np.uint8), np.array([*map(len, own)], np.int64), length)
                content = np.array([content_hash(own[i][s:e]) for i, s, e in
                                    zip(text.tolist(), start.tolist(), (start + n + length - 1).tolist())], np.uint64)
                for k in range(0, len(text), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[lo:hi][text[part]]), pa.array(start[part]), pa.array(n[part].astype(np.int32)),
                         pa.array((at - start)[part].astype(np.int32)), pa.array(h[part].view(np.int64)), pa.array(content[part].view(np.int64))],
                        names=["row", "start", "n", "lead", "anchor", "content"])

    return prepared.select("row", "z").mapInArrow(tidy(run), "row long, start long, n int, lead int, anchor long, content long")


def refine(data: np.ndarray, suffixes: np.ndarray, length: int, q: int = 8) -> np.ndarray:
    """Bucket identifiers of ``suffixes`` at depth ``length``: equal for suffixes whose next
    ``length`` bytes are equal (-1: no other suffix is equal). All those bytes must lie in ``data``."""
    def reached(at: np.ndarray, further: int) -> np.ndarray:
        """Places at .. at + further."""
        mark = np.zeros(len(data) + 1, np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + further + 1, -1)
        return np.flatnonzero(np.cumsum(mark[:-1]))

    pointer = np.full(len(data), -1, np.int64)
    out = np.full(len(suffixes), -1, np.int64)
    active = np.arange(len(suffixes))
    need = reached(suffixes, length - q)
    value = data[need].astype(np.uint64)
    for j in range(1, q):
        value = value << np.uint64(8) | data[need + j]
    pointer[need] = np.unique(value, return_inverse=True)[1]
    depth = q
    while depth < length and len(active):
        step = min(depth, length - depth)
        # refined now: the active suffixes and all places that their next rounds point to
        need = reached(suffixes[active], length - depth - step)
        _, ids = np.unique(pointer[need] * np.int64(len(data) + 1) + pointer[need + step], return_inverse=True)
        pointer[need] = ids
        depth += step
        own = pointer[suffixes[active]]
        shared = np.bincount(own)[own] > 1  # a suffix alone in its bucket is sorted
        active = active[shared]
    out[active] = pointer[suffixes[active]]
    return out


def _compare(length: int):
    """Rows (g1, g2, content, shift, n, bytes) ordered by group -> (anchor, content, first, last):
    runs of repeated windows of each content."""
    def run(batches: Iterator):
        import pyarrow as pa
        held: list[tuple] = []
        size = 0

        def found(rows: list[tuple]):
            """Repeated windows of whole groups."""
            data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            at = np.cumsum([0] + [len(r[5]) for r in rows[:-1]])
            g1, content, shift, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3, 4))
            suffixes = ranges(at, n)
            again = refine(data, suffixes, length) >= 0
            block = np.repeat(np.arange(len(rows)), n)[again]
            place = (suffixes - np.repeat(at, n))[again]
            if len(block):
                edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (place[1:] != place[:-1] + 1))))
                last, own = np.append(edge[1:], len(block)) - 1, block[edge]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    g1[own], content[own], place[edge] + shift[own], place[last] + shift[own])], names=["anchor", "content", "first", "last"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("g1", "g2", "content", "shift", "n", "bytes"))):
                if size >= GROUP_BYTES and held[-1][:2] != row[:2]:
                    yield from found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from found(held)
    return run


def _batches(out: list[tuple], **types) -> Iterator:
    import pyarrow as pa
    for k in range(0, len(out), 8192):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k:k + 8192]), types.values())], names=list(types))


def _cut_crowded(length: int):
    """Blocks of crowded anchors -> stretches of windows, grouped by the bytes their windows share;
    ``same`` is the hash of a stretch's bytes."""
    def run(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest
        for b in batches:
            out = []
            for g1, content, n, lead, crowded, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "n", "lead", "crowded", "bytes"))):
                if not crowded:
                    out.append((g1, 0, content, 0, n, False, 0, raw))
                    continue
                first = 0
                while first < n:  # windows whose distance to the anchor falls into one class
                    kind = (lead - first) // STRETCH
                    last = min(n - 1, lead - kind * STRETCH)
                    shared = raw[lead - kind * STRETCH:lead - kind * STRETCH - STRETCH + 1 + length]
                    key = xxh3_64_intdigest(shared, kind + 1) >> 1
                    own = raw[first:last + length]
                    # the distance too: windows cut off at either end may leave equal bytes at another place
                    out.append((g1, key, content, first, last - first + 1, True, xxh3_64_intdigest(own, lead - first) >> 1, own))
                    first = last + 1
            yield from _batches(out, g1=pa.int64(), g2=pa.int64(), content=pa.int64(), shift=pa.int32(), n=pa.int32(),
                                crowded=pa.bool_(), same=pa.int64(), bytes=pa.binary())
    return run


def _windows(length: int):
    """Stretches -> their single windows, as hashes."""
    def run(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest
        for b in batches:
            out = [(g1, g2, content, shift + k, xxh3_64_intdigest(raw[k:k + length]) >> 1)
                   for g1, g2, content, shift, n, raw in zip(*(b.column(c).to_pylist() for c in ("g1", "g2", "content", "shift", "n", "bytes")))
                   for k in range(n)]
            yield from _batches(out, g1=pa.int64(), g2=pa.int64(), content=pa.int64(), at=pa.int64(), window=pa.int64())
    return run


def _fetch(length: int):
    """Texts with their wanted blocks -> rows with the blocks' bytes."""
    def run(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            out = []
            for text, wanted in zip(unpacked(b), b.column("wanted").to_pylist()):
                for w in wanted:
                    out.append((w["anchor"], w["content"], w["n"], w["lead"], w["crowded"], text[w["start"]:w["start"] + w["n"] + length - 1]))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            for k in range(0, len(out), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k:k + 8192]), types)],
                                                 names=["anchor", "content", "n", "lead", "crowded", "bytes"])
    return run


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, content, first, last): runs of windows that rows of one (g1, g2) have in common."""
    return rows.select("g1", "g2", "content", "shift", "n", "bytes").repartition("g1", "g2").sortWithinPartitions("g1", "g2") \
        .mapInArrow(tidy(_compare(length)), "anchor long, content long, first long, last long")


def _crowded(stretches: DataFrame, length: int, crowded: int) -> DataFrame:
    """The same for stretches of crowded anchors, whose groups may have any size: equal stretches and, in
    groups with more than ``crowded`` differing ones, equal windows are found by counts."""
    group = ["g1", "g2"]
    picked = stretches.groupBy(*group, "same").agg(F.count("*").alias("times"), F.min("content").alias("content"))
    picked = materialize(picked, "stretches")
    differing = picked.groupBy(*group).agg(F.count("*").alias("differing")).filter("differing > 1")
    # a content has at most one stretch in a group, so this join is not skewed by equal ones
    one = stretches.join(picked.join(differing, group).select(*group, "content", "differing"), [*group, "content"])
    again = stretches.join(picked.filter("times > 1").select(*group, "same"), [*group, "same"], "left_semi")
    windows = one.filter(F.col("differing") > crowded).select(*group, "content", "shift", "n", "bytes").mapInArrow(
        tidy(_windows(length)), "g1 long, g2 long, content long, at long, window long")
    common = windows.groupBy(*group, "window").agg(F.count("*").alias("times")).filter("times > 1").select(*group, "window")
    single = windows.join(common, [*group, "window"], "left_semi")
    shift = F.col("shift").cast("long")
    return _compared(one.filter(F.col("differing") <= crowded), length) \
        .unionByName(again.select(F.col("g1").alias("anchor"), "content", shift.alias("first"), (shift + F.col("n") - 1).alias("last"))) \
        .unionByName(single.select(F.col("g1").alias("anchor"), "content", F.col("at").alias("first"), F.col("at").alias("last")))


def repeated_ranges(prepared: DataFrame, length: int = 200, crowded: int = 5000) -> DataFrame:
    """(row, spans): of each text with repeated windows, [first, end) byte ranges that they cover (unmerged)."""
    if length < ANCHOR + 8:
        raise ValueError(f"anchors need strings of at least {ANCHOR + 8} bytes")
    own = blocks(prepared, length)
    # tables that are joined to many rows of one anchor or content are written first: a join of two plain exchanges is one whose
    # hot keys AQE splits, which it can't where an aggregate of the same key ends in the join's stage
    often = materialize(own.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    own = materialize(own.join(often, "anchor"), "blocks")
    contents = own.groupBy("anchor", "content").agg(
        F.count("*").alias("times"), F.min("row").alias("row"), F.min_by("start", "row").alias("start"),
        F.first("n").alias("n"), F.first("lead").alias("lead"))
    contents = materialize(contents, "contents")
    kinds = materialize(contents.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    contents = contents.join(kinds, "anchor")
    wanted = contents.filter("kinds > 1").groupBy("row").agg(F.collect_list(F.struct(
        "anchor", "content", "start", "n", "lead", (F.col("kinds") > crowded).alias("crowded"))).alias("wanted"))
    fetch, cut = _fetch(length), _cut_crowded(length)
    # one step after the other in one Python worker: two operators of one task would have a worker each, and idle ones keep memory
    dealt = prepared.select("row", "z").join(wanted, "row").select("z", "wanted").mapInArrow(
        tidy(lambda batches: cut(fetch(batches))), "g1 long, g2 long, content long, shift int, n int, crowded boolean, same long, bytes binary")
    if kinds.filter(F.col("kinds") > crowded).isEmpty():
        partly = _compared(dealt, length)
    else:
        dealt = materialize(dealt, "edges")
        partly = _compared(dealt.filter("not crowded"), length).unionByName(_crowded(dealt.filter("crowded"), length, crowded))
    # of a content: all windows if it occurs again, and those that other contents hold too
    whole = contents.filter("times > 1").select("anchor", "content", F.lit(0).cast("long").alias("first"), (F.col("n") - 1).cast("long").alias("last"))
    hits = materialize(whole.unionByName(partly).groupBy("anchor", "content").agg(F.collect_list(F.struct("first", "last")).alias("hits")), "hits")
    spans = own.join(hits, ["anchor", "content"]).select("row", "start", F.explode("hits").alias("h")) \
        .select("row", F.struct((F.col("start") + F.col("h.first")).alias("first"), (F.col("start") + F.col("h.last") + length).alias("end")).alias("s"))
    return spans.groupBy("row").agg(F.collect_list("s").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by byte ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def keep(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    at, parts = 0, []
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def keep_text(text: bytes, runs: list[tuple[int, int]]) -> str:
    """The same as text: a character stays if any of its bytes does."""
    whole = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:  # a run that begins inside a character leaves that one
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            whole.append((a, b))
    return keep(text, whole).decode()


def with_ranges(docs: DataFrame, text_col: str, length: int, crowded: int) -> DataFrame:
    """The rows of ``prepare`` with their repeated ranges as spans (null: none)."""
    prepared = prepare(docs, text_col)
    return prepared.join(repeated_ranges(prepared, length, crowded), "row", "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, crowded: int = 5000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    src = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            out = []
            for text, spans in zip(unpacked(b), b.column("spans").to_pylist()):
                text, runs = text or b"", merged(spans)
                out.append((len(text), sum(e - a for a, e in runs), len(runs), sha256(keep(text, runs)).hexdigest()))
            cols = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("c0"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()]))],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_ranges(src, "text", length, crowded).mapInArrow(
        tidy(run), f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, crowded: int = 5000) -> DataFrame:
    """``docs`` with repeated strings cut from the text column (null stays null), all columns kept."""
    columns = docs.columns
    inner = iter(range(len(columns)))
    names = [None if c == text_col else f"c{next(inner)}" for c in columns]

    def run(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            out = [None if t is None else keep_text(t, merged(s)) for t, s in zip(unpacked(b), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n is None else b.column(n) for n in names], names=columns)

    return with_ranges(docs, text_col, length, crowded).mapInArrow(tidy(run), docs.schema)
