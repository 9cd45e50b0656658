"""SimHash near-duplicates with bit-sliced comparison.

``fingerprints`` gives each text a 64-bit SimHash over word shingles.
``link_components`` links fingerprints that differ in at most ``radius`` bits:

* Equal fingerprints are one row from the start, so copies never multiply.
* ``radius + 1`` masks cut the 64 bits into disjoint bands. Two fingerprints
  within the radius agree on one band at least (pigeonhole), so only rows that
  share a band value are compared. A band value shared by more than ``hot``
  fingerprints is cut again by ``radius + 1`` masks over its other bits, which
  is exact for the same reason and spreads the rows over many tasks.
* Inside a task, fingerprints are stored as 64 vertical bit planes (64
  fingerprints a machine word). Distances of many pairs grow together in
  carry-save counters; of a tile, a row in a block of 1,024 lanes is abandoned once
  all these lanes exceed the radius.
* Only a spanning forest of the links of each tile leaves the task, so a group
  of n near copies yields at most n - 1 rows a band instead of n * n pairs.

Defined results: null and empty texts have no words and fingerprint zero, which
links like any other; rows that repeat an id keep one row each and share a
component; an empty table gives an empty result. Rows with a null id keep their
fingerprint and get the component of their fingerprint's group, which is null
only if no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, held, materialize, only, tidy

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``size`` words; fewer words: of them all."""
    from xxhash import xxh64_intdigest as xx
    words = (text or b"").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xx(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    return [xx(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]


def simhash(hashes: list[int]) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # byte counters can't overflow within 255 rows
        counts += np.add.reduce(bits[at:at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each whole text."""
    src = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator):
        import pyarrow as pa
        held("simhash", dict)
        for b in batches:
            fps = np.array([simhash(shingle_hashes(t, shingle)) for t in binary_values(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(tidy(run), f"id {src.schema['id'].dataType.simpleString()}, fp long")


def _masks(bits: list[int], parts: int) -> list[list[int]]:
    return [a.tolist() for a in np.array_split(np.array(bits), parts)]


def _signed(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words: word w of plane b holds bit b of lanes 64 w .. 64 w + 63."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    pad = np.zeros((64, -(-n // 64) * 64), np.uint8)
    pad[:, :n] = bits
    return np.packbits(pad, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, lanes: np.ndarray, radius: int, skip: np.ndarray) -> np.ndarray:
    """Lane masks (queries x words) of the lanes within ``radius`` bits.

    ``lanes`` are bit planes; ``skip`` marks lanes that needn't be compared.
    Counters are carry-save words; ``over`` collects the lanes beyond the radius.
    """
    width = max(1, int(radius + 1).bit_length())
    rows = np.arange(len(queries))
    over, out = skip.copy(), np.zeros_like(skip)
    count = [np.zeros_like(skip) for _ in range(width)]
    for b in range(64):
        flip = np.where((queries[rows] >> np.uint64(b)) & np.uint64(1), ONES, np.uint64(0))[:, None]
        carry = lanes[b][None, :] ^ flip
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        at_limit = carry  # a carry out of the last counter is far beyond the radius
        beyond = np.full_like(over, ONES)  # lanes whose counter equals radius + 1
        for k in range(width):
            beyond &= count[k] if (radius + 1) >> k & 1 else ~count[k]
        over |= beyond | at_limit
        if b % 8 == 7:
            alive = (over != ONES).any(axis=1)
            if not alive.all():
                rows, over, count = rows[alive], over[alive], [c[alive] for c in count]
                if not len(rows):
                    return out
    out[rows] = ~over
    return out


def forest(fps: np.ndarray, radius: int, tile: int = 256, block: int = 16) -> list[tuple[int, int]]:
    """Index pairs (i, j) of a spanning forest of all links among ``fps``."""
    n = len(fps)
    parent, pairs = np.arange(n), []
    lanes = planes(fps)

    def roots(at: np.ndarray) -> np.ndarray:
        """Smallest members of the trees so far; the way there is shortened."""
        top = parent[at]
        while True:
            above = parent[top]
            if (above == top).all():
                parent[at] = top
                return top
            top = above

    for at in range(0, n, tile):
        q = fps[at:at + tile]
        words = -(-(at + len(q)) // 64)  # only earlier lanes: j < i
        earlier = np.arange(words * 64)[None, :] >= (at + np.arange(len(q)))[:, None]
        skip = np.packbits(earlier, axis=1, bitorder="little").view("<u8")
        # block by block of lanes: one is abandoned once all of it exceeds the radius
        hit = np.concatenate([within(q, lanes[:, w:min(w + block, words)], radius, skip[:, w:w + block]) for w in range(0, words, block)], axis=1)
        for r in np.flatnonzero(hit.any(axis=1)):
            i = at + int(r)
            js = np.flatnonzero(np.unpackbits(hit[r].view(np.uint8), bitorder="little"))
            for root, k in zip(*np.unique(roots(js), return_index=True)):
                mine = int(roots(np.array([i]))[0])
                if root != mine:
                    pairs.append((i, int(js[k])))
                    parent[max(root, mine)] = min(root, mine)
    return pairs


def _link_tiles(radius: int, tile: int):
    """Rows (t, k1, k2, fp, rep) ordered by key -> forest edges (a, b) of reps.

    Whole keys are put together until a tile is full: a link between rows of two
    keys is a true link as well, so no mask is needed between them.
    """
    def run(batches: Iterator):
        import pyarrow as pa
        keys, fps, reps = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def edges(f, r):
            found = np.array(forest(f.view(np.uint64), radius, tile), np.int64).reshape(-1, 2)
            a, b = r[found[:, 0]], r[found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        def full(last: bool):
            """Cut off whole keys of at least a tile of rows."""
            nonlocal keys, fps, reps
            while len(fps):
                ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(fps) if last else [])
                ends = ends.astype(np.int64)
                ends = ends[(ends >= tile)] if not last or len(fps) > tile else ends[-1:]
                if not len(ends):
                    return
                yield edges(fps[:ends[0]], reps[:ends[0]])
                keys, fps, reps = keys[ends[0]:], fps[ends[0]:], reps[ends[0]:]

        for b in batches:
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            keys = np.concatenate([keys, np.stack([col("t").astype(np.int64), col("k1"), col("k2")], axis=1)])
            fps, reps = np.concatenate([fps, col("fp")]), np.concatenate([reps, col("rep")])
            yield from full(False)
        yield from full(True)
    return run


def links(classes: DataFrame, radius: int = 4, hot: int = 4096, tile: int = 256) -> DataFrame:
    """Edges (a, b), a > b, that connect the reps of all fingerprints within ``radius`` bits."""
    bands = _masks(list(range(64)), radius + 1)
    keyed = classes.select("fp", "rep", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k1"))
        for t, m in enumerate(bands)])).alias("e")).select("fp", "rep", "e.t", "e.k1")
    crowded = keyed.groupBy("t", "k1").count().filter(F.col("count") > hot).select("t", "k1", F.lit(True).alias("crowded"))
    marked = keyed.join(crowded, ["t", "k1"], "left")
    # a crowded value: cut its other bits again, as exact as the first cut
    parts = F.array(*[F.array(*[F.struct(F.lit((t + 1) * 100 + i).alias("t"),
                                         F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("k2"))
                                for i, s in enumerate(_masks([b for b in range(64) if b not in set(m)], radius + 1))])
                      for t, m in enumerate(bands)])
    one = F.array(F.struct(F.col("t").alias("t"), F.lit(0).cast("long").alias("k2")))
    rows = marked.select("fp", "rep", "k1", F.explode(F.when(F.col("crowded"), parts[F.col("t")]).otherwise(one)).alias("e")) \
        .select("e.t", "k1", "e.k2", "fp", "rep")
    return rows.repartition("t", "k1", "k2").sortWithinPartitions("t", "k1", "k2") \
        .mapInArrow(tidy(_link_tiles(radius, tile)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable over ``edges`` (a > b), by alternating
    large-star and small-star steps; every step's table is written, so a lost
    executor costs no earlier step. Nodes without an edge have no row."""
    edges = materialize(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            near.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        after = materialize(small, "links")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def link_components(fps: DataFrame, radius: int = 4, hot: int = 4096) -> DataFrame:
    """(id, fp) -> (id, fp, component): component is the smallest id reachable."""
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash_classes")
    found = components(links(classes.filter("rep is not null"), radius, hot))
    of_class = classes.join(found, classes.rep == found.node, "left") \
        .select("fp", F.coalesce("root", "rep").alias("component"))
    return fps.join(of_class, "fp").select("id", "fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, hot: int = 4096) -> DataFrame:
    """(id, fp, component) of every row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    return link_components(fps, radius, hot)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
             hot: int = 4096) -> DataFrame:
    """One row of each group of ``docs``: that of the smallest id (null ids last). Rows are
    numbered and written once, so rows that share an id are told apart."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # its columns can't clash with those in here
    rows = materialize(docs.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    slim = rows.select("row", F.col(f"doc.`{id_col}`").alias("key"), F.col(f"doc.`{text_col}`").alias("text"))
    found = near_duplicates(slim, "row", "text", shingle, radius, hot)
    ids = slim.select("row", "key")
    rank = F.struct(F.col("key").isNull(), "key", "row")
    stay = found.join(ids, found.id == ids["row"]).groupBy("component").agg(F.min_by("row", rank).alias("row"))
    return rows.join(stay.select("row"), "row", "left_semi").select("doc.*")
