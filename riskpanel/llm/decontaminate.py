"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask looks at some of the tokens of a stretch and ignores the others, so a seed still
matches when a token under a gap was replaced. Seeds of the test items and of the
documents are joined on their hashes; around each hit, document and item are aligned and a
window of ``WINDOW`` tokens must agree in ``NEED`` of them. The two masks are lossless for that:
every pair of substituted places in 13 tokens leaves some placement of a mask untouched, so
no such overlap is missed. An item of 8 to 12 tokens must be there as a whole, with a fifth
of its tokens replaced at most: one in items of 8 or 9 tokens, whose two interleaved masks can't both be
hit by it, two in longer ones, which have three. An item under 8 tokens must be there verbatim; its one seed is the
hash of the whole item. Documents are searched for a mask only if the benchmark has items of its length.

The seeds of the test set are broadcast only if they are counted to be at most
``broadcast_rows``; else the same join runs as a shuffle join on the seed hash, where AQE splits skewed
seeds. A document's tokens travel along its rows by reference and only the stretch
around a hit is kept.

Defined results: null and empty texts have no tokens and are clean; rows that repeat an id share its
finding, null ids form one group; an empty benchmark leaves every document clean; extra
columns stay in :func:`decontaminate` and don't reach :func:`findings`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only

#: Token places that a mask looks at.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
SPAN, WINDOW, NEED = 8, 13, 11
#: Masks of items of 8 and 9, and of 10 to 12 tokens: every second, every third place, from each of the first 2 or 3.
SECONDS, THIRDS = (0, 2, 4, 6), (0, 3, 6)


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(size: int) -> list[tuple[tuple[int, ...], int | None]]:
    """(mask, number of first places it is laid at; None: all) for items of ``size`` tokens."""
    if size >= WINDOW:
        return [(m, None) for m in MASKS]
    if size >= SPAN:
        return [(SECONDS, 2)] if size < 10 else [(THIRDS, 3)]
    return [(tuple(range(size)), 1)]


def seeds(df: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """``keep`` + (pos, mask, key): the seed of each mask at each place of the token array ``h``; key is null where
    a mask doesn't fit.

    The outer explode keeps the optimizer from adding a size filter that tokenizes twice;
    its null rows join nothing.
    """
    used = sorted({o for m in masks for o in m})
    n = F.greatest(F.size("h") - min(map(max, masks), default=0), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("h", o + 1, n).alias(f"t{o}") for o in used])
    rows = df.select(*keep, F.posexplode_outer(shifted).alias("pos", "s"))
    keys = [F.struct(F.lit(i).alias("mask"), F.when(F.col(f"s.t{max(m)}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"s.t{o}") for o in m]))
                     .alias("key")) for i, m in enumerate(masks)]
    return rows.select(*keep, "pos", F.explode_outer(F.when(F.col("s").isNotNull(), F.array(*keys))).alias("k")) \
        .select(*keep, "pos", "k.mask", "k.key")


def verified(doc: Column, item: Column, width: Column) -> Column:
    """Whether some window of ``width`` aligned tokens of two stretches agrees in enough of them."""
    same = F.zip_with(doc, item, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    last = F.least(F.size(doc), F.size(item)) - width
    need = F.when(width == WINDOW, NEED).when(width < SPAN, width).otherwise(F.ceil(width * 0.8))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    return F.coalesce(F.exists(starts, lambda i: F.aggregate(F.slice(same, i + 1, width), F.lit(0), lambda a, x: a + x) >= need), F.lit(False))


def findings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, items): contaminated ids with the sorted test items that they hold."""
    items = only(benchmark, item=item_col, text=item_text_col).select("item", token_hashes(F.col("text")).alias("ih")) \
        .filter(F.size("ih") > 0)
    sizes = [r[0] for r in items.select(F.least(F.size("ih"), F.lit(WINDOW))).distinct().collect()]  # 13 at most
    laid = {size: masks_of(size) for size in sizes}
    masks = sorted({m for own in laid.values() for m, _ in own}) or list(MASKS)
    marks = seeds(items.withColumnRenamed("ih", "h"), ["item", "h"], masks).filter("key is not null")
    # a mask is laid over the items of its lengths, at its first places
    wanted = F.lit(False)
    for size, own in laid.items():
        for m, places in own:
            here = (F.least(F.size("h"), F.lit(WINDOW)) == size) & (F.col("mask") == masks.index(m))
            wanted = wanted | (here & (F.col("pos") < places) if places else here)
    marks = marks.filter(wanted).select("item", F.col("pos").alias("ipos"), "key").distinct()
    small = marks.limit(broadcast_rows + 1).count() <= broadcast_rows
    sent = F.broadcast if small else (lambda df: df)
    rows = seeds(only(docs, id=id_col, text=text_col).select("id", token_hashes(F.col("text")).alias("h")), ["id", "h"], masks).drop("mask")
    if small:
        hits = rows.join(F.broadcast(marks), "key")
    else:  # only the stretch that verification looks at is shuffled
        near = F.slice("h", F.greatest(F.col("pos") - (WINDOW - SPAN), F.lit(0)) + 1, 2 * WINDOW - SPAN)
        hits = rows.withColumn("h", near).withColumn("at", F.least("pos", F.lit(WINDOW - SPAN))).join(marks, "key")
    if small:
        hits = hits.withColumn("at", F.col("pos"))
    # stretches that begin ``lo`` tokens before the seed in both
    lo = F.least("at", "ipos", F.lit(WINDOW - SPAN))
    doc = F.slice("h", F.col("at") - lo + 1, lo + WINDOW)
    hits = hits.select("id", "item", "ipos", lo.alias("lo"), doc.alias("d"))
    item = F.slice("ih", F.col("ipos") - F.col("lo") + 1, F.col("lo") + WINDOW)
    found = hits.join(sent(items), "item").filter(verified(F.col("d"), item, F.least(F.size("ih"), F.lit(WINDOW))))
    return found.select("id", "item").distinct().groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` without the rows that hold test items, all columns kept. The ids found are written; if they are counted to
    be at most ``broadcast_rows``, the texts are not shuffled."""
    bad = findings(docs, benchmark, id_col, broadcast_rows=broadcast_rows, **options).select(F.col("id").alias("__bad_id"))
    bad = materialize(bad, "contaminated")
    small = bad.count() <= broadcast_rows
    return docs.join(F.broadcast(bad) if small else bad, docs[f"`{id_col}`"].eqNullSafe(bad["__bad_id"]), "left_anti")
