"""Token-ID output as wavelet matrices: one compressed, searchable file per shard.

A shard holds the ids of consecutive documents. Its file is a wavelet matrix: one bit plane
for each bit of an id, most significant first; in each plane, positions whose bit is 0 come
(stably) before those whose bit is 1. With cumulative counts of ones per 64-bit word, rank and
select take constant time a plane, so a file answers ``access`` (ids of any range), ``count``
(occurrences of an id in a range) and ``find`` (position of the k-th occurrence) without
being decoded, and ids of a vocabulary of 2 ** b take b bits each.

File layout (little-endian): magic ``WVM1``, u32 bits, u64 n tokens, u64 n documents; i64 document
ids; u64 tokens per document; per plane u64 zeros and the plane's 64-bit words. Rank
directories are rebuilt on reading (one pass over the words).

Documents lie in ascending id order over all shards (rows of equal id in text order, null ids first). A
document's tokens end with ``end_id``; null and empty texts have that token alone. An
empty table writes no shard. A document is never split over shards, so a shard may be
longer than ``shard_tokens`` by one document. Writing is a plain Spark write of binary rows:
lost tasks are run again and leave nothing behind.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, tidy
from .tokens import encoder, slices

HEAD = struct.Struct("<4sIQQ")
NO_ID = -(1 << 63)  # stands for a null document id in a file


class WaveletMatrix:
    """Bit planes with rank and select over a sequence of unsigned ids."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = [np.concatenate(([0], np.cumsum(np.bitwise_count(p), dtype=np.int64))) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        n, planes, zeros = len(ids), [], []
        cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        bit = np.zeros(-(-n // 64) * 64, bool)
        for b in range(bits - 1, -1, -1):
            np.not_equal(cur & cur.dtype.type(1 << b), 0, out=bit[:n])
            planes.append(np.packbits(bit, bitorder="little").view("<u8"))
            ones = np.flatnonzero(bit)
            low = np.flatnonzero(~bit[:n])
            zeros.append(len(low))
            cur = np.concatenate([cur[low], cur[ones]])
        return cls(n, planes, zeros)

    def _rank1(self, plane: int, at):
        """Ones before positions ``at`` of a plane."""
        at = np.asarray(at, np.int64)
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        words = self.planes[plane]
        part = words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << rest) - np.uint64(1)) if len(words) else rest
        return self.ranks[plane][np.minimum(word, len(words))] + np.bitwise_count(part)

    def access(self, at) -> np.ndarray:
        """Ids at positions ``at`` (an array)."""
        at, out = np.asarray(at, np.int64), np.zeros(np.shape(at), np.uint32)
        for k, words in enumerate(self.planes):
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._rank1(k, at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            out = out << np.uint32(1) | bit
        return out

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` among the first ``at`` ids."""
        lo, hi = 0, at
        for k in range(len(self.planes)):
            one = token >> (len(self.planes) - 1 - k) & 1
            a, b = (int(x) for x in self._rank1(k, [lo, hi]))
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if one else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        return self.rank(token, self.n if last is None else last) - self.rank(token, first)

    def _select(self, plane: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit ``one`` of a plane."""
        before = self.ranks[plane] if one else np.arange(len(self.ranks[plane])) * 64 - self.ranks[plane]
        word = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits == one)[k - int(before[word])])

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        if k < 0 or k >= self.rank(token, self.n):
            return -1
        lo = 0
        for p in range(len(self.planes)):
            ones = int(self._rank1(p, lo))
            lo = self.zeros[p] + ones if token >> (len(self.planes) - 1 - p) & 1 else lo - ones
        at = lo + k
        for p in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - p) & 1
            at = self._select(p, one, at - self.zeros[p] if one else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: the partitions of the planes undone, last plane first."""
        bits = len(self.planes)
        cur = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[k].view(np.uint8), bitorder="little")[:self.n].view(bool)
            before = np.empty_like(cur)
            before[np.flatnonzero(~bit)] = cur[:self.zeros[k]]
            before[np.flatnonzero(bit)] = cur[self.zeros[k]:] | cur.dtype.type(1 << (bits - 1 - k))
            cur = before
        return cur.astype(np.uint32)


def dump(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard file."""
    m = WaveletMatrix.build(ids, bits)
    parts = [HEAD.pack(b"WVM1", bits, len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes()]
    for p, z in zip(m.planes, m.zeros):
        parts += [struct.pack("<Q", z), p.tobytes()]
    return b"".join(parts)


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(document ids, tokens per document, matrix) of a shard file."""
    magic, bits, n, docs = HEAD.unpack_from(data)
    if magic != b"WVM1":
        raise ValueError("not a wavelet matrix shard")
    at = HEAD.size
    doc_ids, lengths = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u8", docs, at + 8 * docs)
    at += 16 * docs
    words, planes, zeros = -(-n // 64), [], []
    for _ in range(bits):
        zeros.append(struct.unpack_from("<Q", data, at)[0])
        planes.append(np.frombuffer(data, "<u8", words, at + 8))
        at += 8 + 8 * words
    return doc_ids, lengths.astype(np.int64), WaveletMatrix(n, planes, zeros)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 bits: int = 16, blanks: bool = False, shard_tokens: int = 2_000_000) -> DataFrame:
    """Shards (part, shard, n_tokens, data), written as a table in the shared folder and read from it.

    ``data`` is the shard's file, (part, shard) its place in ascending document order.
    """
    src = only(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), "text")

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def emit():
            nonlocal shard, held
            d, n, ids = (np.concatenate(x) for x in zip(*held))
            held = []
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([len(ids)]),
                                              pa.array([dump(d, n, ids, bits)], pa.binary())],
                                             names=["part", "shard", "n_tokens", "data"])
            shard += 1

        enc = encoder(tokenizer, blanks)
        for b in batches:
            doc_ids, texts = b.column("id").to_numpy(), b.column("text")
            for first, last in slices(texts):
                got, n = enc.encode(texts.slice(first, last - first))
                if len(got) and (int(got.max()) >> bits or end_id >> bits):
                    raise ValueError(f"ids need more than {bits} bits")
                ends = np.cumsum(n + 1)
                ids = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep] = got
                held.append((doc_ids[first:last], n + 1, ids))
                if sum(len(h[2]) for h in held) >= shard_tokens:
                    yield from emit()
        if held:
            yield from emit()

    ordered = src.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(ordered.mapInArrow(tidy(run), "part long, shard long, n_tokens long, data binary"), "wavelet_shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, start): ids of all shards before, from one row per shard. Two small levels
    (parts, then shards of a part), so no window spans all shards."""
    spark: SparkSession = shards.sparkSession
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one number per write task
    ends = np.cumsum([r["n"] for r in parts]).tolist()
    base = spark.createDataFrame([(r["part"], e - r["n"]) for r, e in zip(parts, ends)], "part long, base long")
    before = F.expr("sum(n_tokens) over (partition by part order by shard) - n_tokens")
    return shards.select("part", "shard", before.alias("before")).join(F.broadcast(base), "part") \
        .select("part", "shard", (F.col("base") + F.col("before")).alias("start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shard files."""
    placed = shards.join(shard_starts(shards), ["part", "shard"]).select("start", "data")

    def run(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data").to_pylist()):
                doc_ids, n, matrix = load(data)
                raw = matrix.ids().astype("<u4").tobytes()
                ends = np.cumsum(n)
                crc = [crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
