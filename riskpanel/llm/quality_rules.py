r"""Quality rules by weak supervision.

``text_stats`` measures each whole text; :data:`RULES` turn the measures into
votes (1 good, -1 bad, 0 abstain). ``fit`` counts the vote patterns (at most
3 ** rules of them, whatever the number of documents) and runs
expectation-maximisation on the counts: each rule has an accuracy on good and one on
bad texts, estimated without labels. ``posteriors`` then gives every
document its probability of being good. So rules are weighed against each other, and a
document isn't lost for failing a single weak one.

Words are ``[^\x20\x09-\x0D]+``. Defined results: a null or empty text has no words, all
measures are 0, and every rule abstains but the one on length. Repeated rows
and ids stay rows of their own. With no rows there is nothing to fit and the result
is empty. Texts of any length are measured whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, only

#: Frequent short words of the corpus languages (fixed values).
STOP_WORDS = frozenset("the be to of and that have with is in it for der die und das ist mit von zu le la les de des et est "
                       "en un que el los una por con las".split())
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_letters"]


def repeated_window_words(words: list[bytes], size: int = 8) -> int:
    """Words covered by windows of ``size`` words that occur at least twice in the text, first ones included."""
    n = len(words)
    if n <= size:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, span = np.fromiter(map(index.__getitem__, words), np.int64, n), 1
    while span < size:  # exact names of windows of 2, 4, 8 words from those of their halves
        step = min(span, size - span)
        pair = ids[:len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        span += step
        if len(counts) == len(ids):
            return 0
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(counts[ids] > 1)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + size, -1)
    return int((np.cumsum(mark)[:n] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The values of :data:`STATS`."""
    text = text or b""
    words = text.split()
    chars = sum(map(len, words))
    chars -= len(text.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))  # continuation bytes
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.split()] if b"\n" in text else [text] * bool(words)
    stops = sum(w.lower().strip(b".,;:!?") in _STOPS for w in words)
    letters = len(text.translate(None, _OTHER))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words), stops, len(lines), letters


_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_OTHER = bytes(b for b in range(0xC0) if not chr(b).isalpha() or b >= 0x80)  # keeps ASCII letters and lead bytes


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *STATS) of every row."""
    src = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            rows = np.array([measure(t) for t in binary_values(b, "text")], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, rows.T)], names=["id", *STATS])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in STATS))


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


#: name -> (good, bad): conditions of a vote; neither: the rule abstains. Ratios are
#: written as products, so no rule divides by zero.
RULES = {
    "length": ("n_words between 50 and 100000", "n_words < 30"),
    "word_length": ("n_words >= 20 and word_chars between 3 * n_words and 10 * n_words",
                    "n_words >= 20 and (word_chars < 2 * n_words or word_chars > 14 * n_words)"),
    "symbols": ("n_words >= 20 and 100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "duplicate_lines": ("n_lines >= 4 and n_dup_lines = 0", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    "repeated_windows": ("n_words >= 50 and 100 * n_repeat_words <= 5 * n_words", "n_words >= 20 and 100 * n_repeat_words > 20 * n_words"),
    "stop_words": ("n_words >= 20 and 100 * n_stop_words >= 5 * n_words", "n_words >= 20 and 100 * n_stop_words < n_words"),
    "letters": ("n_words >= 20 and 10 * n_letters >= 7 * word_chars", "n_words >= 20 and 10 * n_letters < 5 * word_chars"),
}


def votes(stats: DataFrame, rules: dict = RULES) -> DataFrame:
    """``stats`` with the votes as column ``votes``: one character a rule, ``+``, ``-`` or ``0``."""
    chars = [F.when(v == 1, "+").when(v == -1, "-").otherwise("0") for v in (_vote(*r) for r in rules.values())]
    return stats.withColumn("votes", F.concat(*chars))


def fit(patterns: dict[str, int], iterations: int = 200, tolerance: float = 1e-9) -> tuple[dict[str, float], np.ndarray, float]:
    """Pattern -> posterior, accuracies (rules x 2: on good, on bad texts), and the share of good texts.

    The start takes each rule as right four times of five. A Beta(8, 2) prior keeps
    accuracies off 0 and 1 and holds each rule's votes to their meaning.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((0, 2)), 0.5
    n = np.array([patterns[p] for p in names], float)
    v = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in p] for p in names])
    acc, prior = np.full((v.shape[1], 2), 0.8), 0.5
    for _ in range(iterations):
        log_good = np.log(prior) + (v == 1) @ np.log(acc[:, 0]) + (v == -1) @ np.log(1 - acc[:, 0])
        log_bad = np.log(1 - prior) + (v == -1) @ np.log(acc[:, 1]) + (v == 1) @ np.log(1 - acc[:, 1])
        post = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        right = np.stack([(n * post) @ (v == 1), (n * (1 - post)) @ (v == -1)], axis=1)
        cast = np.stack([(n * post) @ (v != 0), (n * (1 - post)) @ (v != 0)], axis=1)
        new = (right + 8) / (cast + 10)
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.01, 0.99))
        moved, acc = np.abs(new - acc).max(), np.clip(new, 0.55, 0.999)
        if moved < tolerance:
            break
    return dict(zip(names, post.tolist())), acc, prior


def posteriors(voted: DataFrame, rules: dict = RULES) -> DataFrame:
    """``voted`` with column ``p_good``. At most 3 ** rules pattern counts reach the driver."""
    spark = voted.sparkSession
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    table = spark.createDataFrame(list(fit(counts)[0].items()), "votes string, p_good double")
    return voted.join(F.broadcast(table), "votes", "left")


def base_failed() -> Column:
    return reduce(Column.__or__, [F.col("n_words") < 20, 100 * F.col("n_repeat_words") > 30 * F.col("n_words")])
