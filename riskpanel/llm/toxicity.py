r"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (hashed into
``buckets`` rows), a passage's vector is the mean of its words', and a linear softmax over it
gives the class. Embeddings and softmax are trained jointly in numpy, so a misspelling that
was never seen shares n-gram vectors with words that were. In that mean a word that a passage
repeats counts once, and a passage of under ``window / 2`` distinct words is filled up to that
number with zero vectors, so neither a repeated odd word nor a text of three words gets an
extreme score.

A text is scored by passages of ``window`` consecutive words: its score is that of its
worst passage, so a few toxic words in a long text aren't averaged away. Training does the same: of
each text, the passage that scores highest at the moment is the one that is learned from.

Training rows are bounded by ``max_train`` (a documented bound; rows are chosen by a hash of the
id, a quarter of them of label 1); the model is a fixed-size table. They reach the driver a
partition at a time and stay there as word numbers; n-grams and their sums are worked out in
blocks. Scoring covers every row and whole texts.

Defined results: a null or empty text has no words and scores the model's bias alone; a
label that is null, or other than 0 and 1, isn't trained on; without both classes among
the labels the model gives every text the observed share of label 1 (0 if there are none).
Repeated rows get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, give_back, held, only, ranges, tidy

#: Bytes that end a word besides white space.
PUNCTUATION = b".,;:!?\"()[]{}|"
_CLEAN = bytes(32 if bytes([b]) in PUNCTUATION else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_CLEAN).split()


def grams(words: list[bytes], buckets: int, sizes: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of ``<word>``, number of n-grams of each word); a word shorter
    than all sizes counts as one n-gram."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(n) - n
    owners, hashes = [], []
    for k in sizes:
        own = np.maximum(n - k + 1, 0) if k != sizes[0] else np.maximum(n - k + 1, 1)
        at, word = ranges(start, own), np.repeat(np.arange(len(n)), own)
        h = np.full(len(at), k, np.uint64)
        end = np.repeat(start + n, own)
        for j in range(k):
            h = (h + np.where(at + j < end, flat[np.minimum(at + j, len(flat) - 1)] + np.uint64(1), np.uint64(0))) * MIX
            h ^= h >> np.uint64(29)
        owners.append(word)
        hashes.append((h % np.uint64(buckets)).astype(np.int64))
    word, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(word, kind="stable")
    return h[order], np.bincount(word, minlength=len(n))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values (0 for empty runs)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _table_sums(table: np.ndarray, rows: np.ndarray, counts: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """``_sums(table[rows], counts)``, by the same additions, with ``block`` rows gathered at a time."""
    ends = np.cumsum(counts)
    total = np.zeros((len(counts) + 1, *table.shape[1:]))
    last = total[:1]
    for first in range(0, len(rows), block):
        so_far = np.cumsum(np.concatenate([last, table[rows[first:first + block]]]), axis=0)
        lo, hi = np.searchsorted(ends, [first, first + len(so_far) - 1], side="right")
        total[lo + 1:hi + 1] = so_far[ends[lo:hi] - first]
        last = so_far[-1:]
    return total[1:] - total[:-1]


def _vocabulary(texts: Iterable[bytes | None], buckets: int, block: int = 1 << 12) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(word numbers of each text, ``grams`` of the distinct words); only one text at a time is held."""
    index: dict[bytes, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    words = list(index)
    del index
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for first in range(0, len(words), block):
        own, n = grams(words[first:first + block], buckets)
        parts.append((own.astype(np.min_scalar_type(buckets - 1)), n))
    return docs, np.concatenate([p[0] for p in parts[1:] or parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Model:
    """``gram_logit``: what each n-gram bucket adds to the logit, the product of its
    embedding and the softmax weights (all that scoring needs)."""
    gram_logit: np.ndarray
    bias: float
    window: int
    embeddings: np.ndarray | None = None
    weights: np.ndarray | None = None

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        h, n = grams(words, len(self.gram_logit))
        return _sums(self.gram_logit[h], n) / np.maximum(n, 1)

    def score(self, ids: np.ndarray, logits: np.ndarray) -> float:
        """Of a text of words ``ids``, ``logits`` being their words' logits."""
        z = passage_means(ids, logits, self.window).max() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def passage_means(ids: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """Of each passage: the mean of x over its distinct words, of which at least half a window
    count. Passages start half a window apart; the last one ends at the text's end."""
    n = len(ids)
    if n == 0:
        return np.zeros(1)
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    start = window_starts(n, window)
    at = start[:, None] + np.arange(min(n, window))
    once = before[at] < start[:, None]
    return np.where(once, x[at], 0.0).sum(axis=1) / np.maximum(once.sum(axis=1), window // 2)


def window_starts(n: int, window: int) -> np.ndarray:
    if n <= window:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - window + 1, window // 2), n - window))


def train(texts: Iterable[bytes | None], labels: list[int], buckets: int = 1 << 16, dim: int = 8, window: int = 16,
          epochs: int = 8, batch: int = 64, rate: float = 1.0, seed: int = 7, start: float = 1e-4, warm_up: int = 2) -> Model:
    """Joint training of embeddings and softmax by Adagrad on the worst passage of each text.

    ``texts`` is gone through once, before ``labels`` is looked at."""
    docs, gram, n_grams = _vocabulary(texts, buckets)
    y = np.asarray(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(buckets), float(np.clip(np.log(share / (1 - share)) if 0 < share < 1 else 60 * (2 * share - 1), -60, 60)), window)
    gram_at = np.cumsum(n_grams) - n_grams
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (buckets, dim)) / dim
    w, b = np.zeros((dim, 2)), np.zeros(2)
    emb_sq, w_sq, b_sq = np.full(buckets, start), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        # at first a text is one bag; then word logits under the present model choose its worst passage
        logit = _table_sums(emb @ (w[:, 1] - w[:, 0]), gram, n_grams) / np.maximum(n_grams, 1)
        chosen = []
        for d in docs:
            if epoch < warm_up:
                chosen.append(np.unique(d))
                continue
            at = window_starts(len(d), window)
            k = at[int(np.argmax(passage_means(d, logit[d], window)))]
            chosen.append(np.unique(d[k:k + window]))
        order = rng.permutation(len(docs))
        for first in range(0, len(order), batch):
            own = order[first:first + batch]
            counts = np.array([len(chosen[i]) for i in own])
            places = np.maximum(counts, window // 2)
            ids = np.concatenate([chosen[i] for i in own]).astype(np.int64)
            uniq, inv = np.unique(ids, return_inverse=True)
            n = n_grams[uniq]
            rows = gram[ranges(gram_at[uniq], n)]
            vec = _table_sums(emb, rows, n) / n[:, None] if len(uniq) else np.zeros((0, dim))
            hidden = _sums(vec[inv], counts) / places[:, None]
            z = hidden @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p - np.stack([1 - y[own], y[own]], axis=1)
            g *= weight[own][:, None]
            empty = np.exp(b) / np.exp(b).sum() - [1, 0]  # a passage of zero vectors counts as clean, half as often as others
            grad_w, grad_b, back = hidden.T @ g / len(own), g.mean(axis=0) + empty / 2, g @ w.T
            w_sq += grad_w ** 2
            b_sq += grad_b ** 2
            w -= rate * grad_w / np.sqrt(w_sq)
            b -= rate * grad_b / np.sqrt(b_sq)
            per_word = np.zeros((len(uniq), dim))
            doc_of = np.repeat(np.arange(len(own)), counts)
            np.add.at(per_word, inv, (back / places[:, None])[doc_of])
            per_gram = per_word / np.maximum(n, 1)[:, None]
            touched, gi = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(gi, np.repeat(per_gram[:, k], n), len(touched)) for k in range(dim)], axis=1)
            emb_sq[touched] += (grad ** 2).mean(axis=1)
            emb[touched] -= rate * grad / np.sqrt(emb_sq[touched])[:, None]
    return Model(emb @ (w[:, 1] - w[:, 0]), float(b[1] - b[0]), window, emb, w)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, id_col: str = "doc_id", text_col: str = "text",
                  label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(id, text, y) of at most ``max_train`` rows, a quarter of them of class 1, chosen by a hash of the id.

    An id that has both labels is of class 1; of rows with one id the smallest text trains.
    """
    lab = only(labels, id=label_id, y=label_col).filter("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for y, most in ((0, max_train - max_train // 4), (1, max_train // 4)):
        own = lab.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    return only(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").groupBy("id") \
        .agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 4000, **options) -> Model:
    """Model from at most ``max_train`` labelled rows of ``docs``; those are all that reaches the driver, a partition at a time."""
    y: list[int] = []

    def texts() -> Iterator[bytes | None]:
        for r in training_rows(docs, labels, max_train).orderBy("id").toLocalIterator():
            y.append(r["y"])
            yield r["text"].encode() if r["text"] is not None else None

    model = train(texts(), y, **options)
    give_back()
    return model


def _scorer(df: DataFrame, model: Model):
    """texts of a batch -> scores, with a bounded cache of word logits per task."""
    sent = df.sparkSession.sparkContext.broadcast((model.gram_logit.astype(np.float32), model.bias, model.window))

    def start():
        model = Model(*sent.value)
        held("toxicity", dict)
        known: dict[bytes, int] = {}
        values = np.zeros(0)

        def score(text: bytes | None) -> float:
            nonlocal known, values
            words = words_of(text)
            if len(known) > 200_000:
                known, values = {}, np.zeros(0)
            new = [x for x in dict.fromkeys(words) if x not in known]
            if new:
                first = len(known)
                known.update(zip(new, range(first, first + len(new))))
                if len(known) > len(values):
                    values = np.concatenate([values, np.zeros(max(len(known), 1 << 16))])
                values[first:len(known)] = model.word_logits(new)
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            return model.score(ids, values[ids])
        return score
    return start


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: 0 to 1, of its worst passage."""
    src = only(docs, id=id_col, text=text_col)
    start = _scorer(src, model)

    def run(batches: Iterator):
        import pyarrow as pa
        score = start()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([score(t) for t in binary_values(b, "text")], pa.float64())],
                                             names=["id", "score"])

    return src.mapInArrow(tidy(run), f"id {src.schema['id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns kept (no shuffle)."""
    start = _scorer(docs, model)

    def run(batches: Iterator):
        import pyarrow as pa
        score = start()
        for b in batches:
            yield b.filter(pa.array([score(t) < threshold for t in binary_values(b, text_col)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
