"""Stupid-backoff language-model scores, computed relationally.

Every text is exploded into its n-grams (n = 1 .. order), an n-gram being its 56-bit hash (among
10 ** 10 distinct n-grams, one in 7 million shares its hash with another). Three
tables are related by that hash:

* ``exploded`` (bucket, block, grams): the distinct n-grams of each block of texts with their
  counts, partitioned by the hash;
* the count table of a partition: its n-grams with their counts over the whole corpus, all of them
  unless a ``min_count`` over 1 is asked for;
* the join of both, (bucket, block, counts): each block's n-grams with their corpus counts.

Back in its block, each position scores log S(w | context) = log c(context w) - log c(context) for
the longest n-gram in the table, times ``backoff`` for each word of context given up; a word out
of the table scores 1 / (tokens + 1). Scores are summed per document.

Rows of all three tables hold sorted arrays of n-grams, not one n-gram each, which keeps the
shuffle at a few bytes a token. Blocks have at most ``block_tokens`` tokens plus one text, and
the corpus' tokens give the number of buckets: one for each ``BUCKET_GRAMS`` n-grams and at least
as many as shuffle partitions. A task holds one bucket at a time, so tasks stay bounded. A
frequent n-gram is one entry a block, however often it occurs.

Tokens are the lower-cased words ``[^\\x20\\x09-\\x0D]+``; n-grams don't cross texts. Defined results: null
and empty texts have no tokens, a log score of 0 and no perplexity (null); repeated rows and
ids are texts of their own and count each time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, materialize, only, partitions, tidy

BUCKET_GRAMS = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _pack(x: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    from zstandard import ZstdDecompressor
    return np.frombuffer(ZstdDecompressor().decompress(data), kind)


def _planes(x: np.ndarray) -> np.ndarray:
    """Byte planes of unsigned 32-bit values: small values leave the high planes empty."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T


def _unplanes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _columns(x: np.ndarray) -> np.ndarray:
    """Sorted 64-bit values as differences, byte planes apart (they compress well)."""
    d = np.diff(x, prepend=np.uint64(0))
    return d.astype("<u8").view(np.uint8).reshape(-1, 8).T


def _values(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def blocks(docs: DataFrame, block_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, sizes, words, rank, tokens): texts as ranks of their words by frequency, ``rank``
    giving each rank's place in the block's sorted word hashes."""
    src = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest
        ids, sizes, index, tokens, held = [], [], {}, [], 0

        def emit():
            words = list(index)
            h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(8)
            uniq, place = np.unique(h, return_inverse=True)
            at = place[np.concatenate(tokens).astype(np.int64)] if held else np.zeros(0, np.int64)
            often = np.argsort(-np.bincount(at, minlength=len(uniq)), kind="stable")
            rank = np.empty(len(uniq), np.int64)
            rank[often] = np.arange(len(uniq))
            at = rank[at]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([_pack(_columns(uniq))], pa.binary()),
                 pa.array([_pack(_planes(often))], pa.binary()), pa.array([_pack(_planes(at))], pa.binary())],
                names=["ids", "sizes", "words", "rank", "tokens"])

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            for key, text in zip(b.column("id").to_pylist(), binary_values(b, "text")):
                words = (text or b"").lower().split()
                for w in set(words):
                    index.setdefault(w, len(index))
                ids.append(key)
                sizes.append(len(words))
                tokens.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                held += len(words)
                if held >= block_tokens or len(ids) >= 1 << 16:
                    yield emit()
                    ids, sizes, index, tokens, held = [], [], {}, [], 0
        if ids:
            yield emit()

    kind = src.schema["id"].dataType.simpleString()
    rows = src.mapInArrow(tidy(run), f"ids array<{kind}>, sizes array<long>, words binary, rank binary, tokens binary")
    return materialize(rows.withColumn("block", F.monotonically_increasing_id()), "lm_blocks")


def ngrams(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Per n the hash of the n-gram that ends at each token (0 where the text has none)."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one = words[tokens.astype(np.int64)]
    out, full = [np.maximum(one, np.uint64(1))], one
    for n in range(2, order + 1):
        h = full[:-1] * MIX  # the n-gram one shorter that ends a token earlier, all 64 bits
        h = (h ^ h >> np.uint64(32)) * MIX + one[1:]
        h = (h ^ h >> np.uint64(29)) * MIX
        full = np.concatenate(([np.uint64(0)], h))
        whole = np.zeros(len(tokens), np.uint64)
        whole[1:] = np.where(place[1:] >= n - 1, np.maximum(h >> np.uint64(8), np.uint64(1)), np.uint64(0))
        out.append(whole)
    return out


def _block_grams(words: bytes, rank: bytes, tokens: bytes, sizes: list[int], order: int) -> list[np.ndarray]:
    by_rank = _values(_unpack(words, "u1"))[_unplanes(_unpack(rank, "u1")).astype(np.int64)]
    return ngrams(by_rank, _unplanes(_unpack(tokens, "u1")), np.array(sizes, np.int64), order)


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of all orders and their counts; sorted in place, to hold few copies."""
    every = np.concatenate(grams)
    every.sort()
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    uniq, count = every[first], np.diff(first, append=len(every))
    zero = int(len(uniq) > 0 and uniq[0] == 0)
    return uniq[zero:], count[zero:]


def _cuts(uniq: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted hashes: bucket k has those from k * 2 ** 56 / buckets on."""
    step = (1 << 56) // buckets + 1
    return np.searchsorted(uniq, np.array([k * step for k in range(1, buckets)], np.uint64)) if buckets > 1 else np.zeros(0, np.int64)


def exploded(blocked: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, block, grams, times): the distinct n-grams of each block by bucket."""
    def run(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for block, sizes, words, rank, tokens in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "words", "rank", "tokens"))):
                uniq, count = _distinct(_block_grams(words, rank, tokens, sizes, order))
                borders = [0, *_cuts(uniq, buckets).tolist(), len(uniq)]
                rows = [(k, block, _pack(_columns(uniq[i:j])), _pack(count[i:j].astype("<u4")))
                        for k, (i, j) in enumerate(zip(borders, borders[1:])) if j > i]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows[at:at + 256]), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "grams", "times"])

    return blocked.select("block", "sizes", "words", "rank", "tokens").mapInArrow(tidy(run), "bucket int, block long, grams binary, times binary")


def counted(grams: DataFrame, min_count: int, buckets: int) -> DataFrame:
    """(block, bucket, counts): the blocks' n-grams joined to the corpus count table of their
    bucket; 0 for those that the table leaves out. Order is that of the block's sorted n-grams."""
    def run(batches: Iterator):
        import pyarrow as pa

        def joined(bucket: int, rows: list[tuple]):
            own = [_values(_unpack(g, "u1")) for _, g, _ in rows]
            table, place = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(place, np.concatenate([_unpack(t, "<u4") for *_, t in rows]), len(table)).astype(np.int64)
            total[total < min_count] = 0
            ends = np.cumsum([len(o) for o in own])
            for (block, *_), o, e in zip(rows, own, ends.tolist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([_pack(total[place[e - len(o):e]].astype("<u8"))], pa.binary())],
                    names=["block", "bucket", "counts"])

        bucket, held = None, []
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "grams", "times"))):
                if k != bucket and held:
                    yield from joined(bucket, held)
                    held = []
                bucket = k
                held.append(tuple(row))
        if held:
            yield from joined(bucket, held)

    return grams.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "block long, bucket int, counts binary")


def backoff_scores(grams: list[np.ndarray], counts: list[np.ndarray], total: int, backoff: float) -> np.ndarray:
    """log S of each token, given the table's count of the n-gram that ends at it, per n."""
    context = np.full(len(grams[0]), total, np.int64)
    score = np.full(len(grams[0]), -np.log(total + 1.0))
    for n, (g, c) in enumerate(zip(grams, counts)):
        known = (g != 0) & (c > 0) & (context > 0)
        # a token that falls short of order n pays for it if its text has the context
        score = np.where(known, np.log(np.maximum(c, 1)) - np.log(np.maximum(context, 1)),
                         score + np.where((g != 0) & (n > 0), np.log(backoff), 0.0))
        context = np.concatenate(([0], c[:-1]))  # the context of the n-gram one longer ends a token earlier
    return score


def _counts_of(grams: np.ndarray, uniq: np.ndarray, table: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """``table``'s counts of n-grams found in ``uniq``, 0 for those that are 0. They are searched in order of their
    first bits (a radix sort), so that a search finds its part of ``uniq`` in the processor's cache."""
    out = np.empty(len(grams), np.int64)
    for first in range(0, len(grams), step):
        own = grams[first:first + step]
        order = np.argsort((own >> np.uint64(40)).astype(np.uint16), kind="stable")
        own = own[order]
        out[first + order] = np.where(own != 0, table[np.minimum(np.searchsorted(uniq, own), len(uniq) - 1)], 0)
    return out


def _looked_up(grams: list[np.ndarray], found: list[np.ndarray]) -> list[np.ndarray]:
    """The corpus count of the n-gram that ends at each token, per n; ``found`` has those of the
    block's sorted distinct n-grams, by bucket."""
    uniq = np.concatenate(grams)
    uniq.sort()
    uniq = uniq[np.concatenate(([True], uniq[1:] != uniq[:-1])) & (uniq != 0)] if len(uniq) else uniq
    table = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(table) != len(uniq):
        raise ValueError("a block's n-grams and their counts differ in number")
    return [_counts_of(g, uniq, table) for g in grams]


def score(docs: DataFrame, order: int = 3, min_count: int = 1, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text",
          block_tokens: int = 2_500_000) -> DataFrame:
    """(id, n_tokens, log_score, perplexity) of every row, with n-gram counts of all rows."""
    spark = docs.sparkSession
    blocked = blocks(docs, block_tokens, id_col, text_col)
    total = blocked.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    buckets = max(partitions(spark), -(-total * order // BUCKET_GRAMS))
    joined = counted(exploded(blocked, order, buckets), min_count, buckets)
    per_block = joined.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("counts"))

    def scored(words: bytes, rank: bytes, tokens: bytes, sizes: list[int], got: list) -> tuple[np.ndarray, ...]:
        # a function of its own: a block's arrays are gone before those of the next one
        grams = _block_grams(words, rank, tokens, sizes, order)
        counts = _looked_up(grams, [_unpack(r["counts"], "<u8").astype(np.int64) for r in sorted(got or (), key=lambda r: r["bucket"])])
        s = backoff_scores(grams, counts, total, backoff)
        n = np.array(sizes, np.int64)
        ends = np.cumsum(n)
        sums = np.concatenate(([0.0], np.cumsum(s)))
        logs = np.where(n > 0, sums[ends] - sums[ends - n], 0.0)
        return n, logs, np.exp(-logs / np.maximum(n, 1))

    def run(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                ids, sizes, *packed, got = (row.column(c)[0].as_py() for c in ("ids", "sizes", "words", "rank", "tokens", "counts"))
                n, logs, ppl = scored(*packed, sizes, got)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("ids").type.value_type), pa.array(n), pa.array(logs),
                                                  pa.array(ppl, mask=n == 0)], names=["id", "n_tokens", "log_score", "perplexity"])

    kind = blocked.schema["ids"].dataType.elementType.simpleString()
    return blocked.join(per_block, "block", "left").select("ids", "sizes", "words", "rank", "tokens", "counts") \
        .mapInArrow(tidy(run), f"id {kind}, n_tokens long, log_score double, perplexity double")
