r"""Filter interaction audit: what each filter removes, alone and after the others, in every order.

Filters that look at one text are Spark conditions over it. The copy filter fails a row
whose text also stands under a smaller id anywhere in the table: an existential self-join,
left-semi on hash, exact text and smaller id. Its ids are united with the failures of the
other filters into one bit set a row; rows are then counted by (part, bit combination, labels), and
every order of the filters is read off these few counts.

How it scales. A first pass writes (id, part, hash, bits) a row, without texts. Only rows whose hash occurs under two ids
can be copies, so only their texts are shuffled: the left side of the self-join has the rows above
the smallest id of their hash, the right side one row a distinct text with its smallest id (combined
before the shuffle). A hash with many rows is dealt over ``n / spread`` salts, for which the one right row is repeated, so
no task gets more than about ``spread`` rows of a group of copies. The hashes that occur
twice are broadcast if they are counted to be under ``broadcast_rows``, else joined by a shuffle.

Defined results: a null text counts as empty, a null part as the empty string. Words are runs of characters other than
``[\x20\x09-\x0D]``. Every row counts, repeated rows too; rows of one id with equal texts are no copies of each other (no
smaller id). A row with a null id is no copy and makes none. An id with several labels is good (toxic) if any of its rows
says 1; ids without labels are neither. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def few_words(least: int) -> Column:
    return F.size("words") < least


def few_distinct(percent: int) -> Column:
    return 100 * F.size(F.array_distinct("words")) < percent * F.size("words")


def many_capitals(percent: int) -> Column:
    return 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > percent * F.length("text")


def holds_any(symbols: str) -> Column:
    return F.col("text").rlike(f"[{symbols}]")


def failures(docs: DataFrame, filters: dict[str, Column], copy_filter: str, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "lang", broadcast_rows: int = 1_000_000, spread: int = 4096) -> DataFrame:
    """(id, part, hash, n, bits): rows by id, part and text hash, with their number and the filters they fail.

    ``filters`` are conditions over the columns ``text`` and ``words``; bit i is the i-th of them, and the
    bit after them is ``copy_filter`` (its name must not be among theirs).
    """
    if copy_filter in filters:
        raise ValueError(f"two filters are named {copy_filter}")
    texts = only(docs, id=id_col, part=part_col, text=text_col) \
        .withColumns({"part": F.coalesce(F.col("part").cast("string"), F.lit("")), "text": F.coalesce("text", F.lit(""))}) \
        .withColumn("hash", F.xxhash64("text"))
    bits = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    marks = materialize(texts.withColumn("words", words(F.col("text"))).select("id", "part", "hash", bits.alias("bits")), "marks")
    copied = copies(texts, marks, broadcast_rows, spread)
    every = marks.withColumn("n", F.lit(1)).unionByName(
        copied.select("id", "part", "hash", F.lit(1 << len(filters)).alias("bits"), F.lit(0).alias("n")))
    return every.groupBy("id", "part", "hash").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))


def copies(texts: DataFrame, marks: DataFrame, broadcast_rows: int, spread: int) -> DataFrame:
    """(id, part, hash) of the rows of ``texts`` (id, part, text, hash) whose text has a smaller id too."""
    twice = materialize(
        marks.groupBy("hash").agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("first < last").select("hash", "first", F.floor(F.col("rows") / spread + 1).cast("int").alias("salts")), "twice")
    if twice.limit(broadcast_rows + 1).count() <= broadcast_rows:
        twice = F.broadcast(twice)
    shared = texts.join(twice, "hash")
    left = shared.filter("id > first").select("id", "part", "hash", "text", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"))
    right = shared.groupBy("hash", "text").agg(F.min("id").alias("smallest"), F.max("salts").alias("salts")) \
        .select("hash", "text", "smallest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.alias("l").join(right.alias("r"), (F.col("l.hash") == F.col("r.hash")) & (F.col("l.salt") == F.col("r.salt"))
                                & (F.col("l.text") == F.col("r.text")) & (F.col("r.smallest") < F.col("l.id")), "left_semi") \
        .select("id", "part", "hash")


def combinations(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality",
                 toxic_col: str = "toxic") -> DataFrame:
    """(part, bits, good, toxic, n): rows by the set of filters that they fail."""
    known = only(labels, id=id_col, good=good_col, toxic=toxic_col).groupBy("id") \
        .agg(F.max(F.col("good") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return failed.join(known, "id", "left").groupBy(
        "part", "bits", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``names`` are the filters by bit; one row for each part, order of all filters and step of it. ``shapley`` is what the
    step's filter removes, summed over all orders.
    """
    steps = [(order, i + 1, 1 << k, sum(1 << names.index(x) for x in order[:i]))
             for order in itertools.permutations(names) for i, x in enumerate(order) for k in [names.index(x)]]
    step = F.explode(F.array(*[F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i).alias("step"), F.lit(own).alias("own"),
                                        F.lit(before).alias("before")) for order, i, own, before in steps]))
    # what one filter removes depends on the set before it only: few states, counted before they meet the orders
    states = sorted({(own, before) for _, _, own, before in steps})
    state = F.explode(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in states]))
    passed, fails = F.col("bits").bitwiseAND(F.col("s.before")) == 0, F.col("bits").bitwiseAND(F.col("s.own")) != 0

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    by_state = counts.withColumn("s", state).groupBy("part", F.col("s.own").alias("own"), F.col("s.before").alias("before")).agg(
        total(passed & ~fails).alias("kept"), total(passed & fails).alias("removed"), total(~passed & fails).alias("redundant"),
        total(F.col("bits") == F.col("s.own")).alias("unique_fails"), total(passed & fails & F.col("good")).alias("good_lost"),
        total(passed & fails & F.col("toxic")).alias("toxic_lost"))
    # n filters: a set of k of them stands before another one in k! (n - k - 1)! orders
    size = F.bit_count("before")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(names) - k - 1)) for k in range(len(names))]), size + 1)
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    by_part = by_state.groupBy("part").agg(
        F.collect_list(F.struct("own", "before", *columns)).alias("states"),  # one entry a state: their number is fixed by ``names``
        *[F.sum(F.when(F.col("own") == 1 << i, F.col("removed") * orders).otherwise(0)).cast("long").alias(f"shapley{i}")
          for i in range(len(names))])
    found = by_part.select("part", "states", *[f"shapley{i}" for i in range(len(names))], step.alias("o")) \
        .withColumn("at", F.filter("states", lambda s: (s["own"] == F.col("o.own")) & (s["before"] == F.col("o.before")))[0])
    shapley = F.coalesce(*[F.when(F.col("o.own") == 1 << i, F.col(f"shapley{i}")) for i in range(len(names))])
    return found.select("part", "o.filter_order", "o.step", *[f"at.{c}" for c in columns], shapley.alias("shapley"))
