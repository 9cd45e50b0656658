"""URL filter: host/path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter has as many 256-bit blocks as the counted list asks for, 2 ** 20 rows of five longs at
most, which bounds what is broadcast. A longer list only makes it let through more urls; each possible hit
goes to an exact hash join with the list, which removes all false positives.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule, is on no list, and is allowed. Repeated rows stay. Extra columns of
the input don't reach the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't select content.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)=.*$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host without ``www.`` + path without a trailing slash + sorted query without tracking
    parameters; scheme and fragment are dropped. Empty for a url without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(host, path, query))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path), null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, hashes: int) -> list[tuple[int, Column]]:
    """(word, mask) of each bit that a key sets in its 256-bit block: one a word, from
    disjoint 6-bit slices of a second hash."""
    second = F.xxhash64(key, F.lit(1))
    at = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(hashes)]
    return [(i % 4, F.call_function("shiftleft", F.lit(1).cast("long"), a)) for i, a in enumerate(at)]


def _words(key: Column, hashes: int) -> list[Column]:
    words = [F.lit(0).cast("long")] * 4
    for w, mask in _bits(key, hashes):
        words[w] = words[w].bitwiseOR(mask)
    return words


def bloom(keys: DataFrame, key: str = "key", log2_blocks: int = 16, hashes: int = 8) -> DataFrame:
    """(block, w0..w3): the filter of all keys; at most ``2 ** log2_blocks`` rows."""
    block = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << log2_blocks) - 1))
    rows = keys.filter(F.col(key).isNotNull()).select(block.alias("block"), *[
        w.alias(f"w{i}") for i, w in enumerate(_words(F.col(key), hashes))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def maybe_listed(df: DataFrame, key: str, filt: DataFrame, log2_blocks: int = 16, hashes: int = 8) -> DataFrame:
    """Rows of ``df`` whose key passes the filter: all listed ones and few others."""
    if log2_blocks > 20:
        raise ValueError("the broadcast filter is bounded by 2 ** 20 blocks (32 MB of bits)")
    block = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << log2_blocks) - 1))
    hit = F.lit(True)
    for i, w in enumerate(_words(F.col(key), hashes)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(w) == w)
    return df.withColumn("block", block).join(F.broadcast(filt), "block").filter(hit).drop("block", "w0", "w1", "w2", "w3")


def blocks_for(n: int) -> int:
    """log2 of the number of blocks for ``n`` keys: 16 keys a block of 256 bits, 2 ** 20 blocks at most. A longer list
    lets more urls pass to the exact join, which still decides."""
    return min(max(math.ceil(math.log2(max(n, 1) / 16)), 4), 20)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
                url_col: str = "url", listed_col: str = "url", log2_blocks: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row: the longest fitting rule decides; else
    a url is blocked if its canonical form is among those of ``listed``. ``log2_blocks``: size of the filter, else
    that of :func:`blocks_for` the counted list."""
    keys = only(listed, url=listed_col).select(canonical(F.col("url")).alias("key")).filter("key <> ''").distinct()
    rows = only(pages, id=id_col, url=url_col).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        canonical(F.col("url")).alias("key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    if log2_blocks is None:
        log2_blocks = blocks_for(keys.count())
    # each distinct url is looked up once, however many rows have it
    hits = maybe_listed(rows.select("key").filter("key <> ''"), "key", bloom(keys, "key", log2_blocks), log2_blocks).distinct()
    on_list = hits.join(keys, "key").select(F.col("key").alias("k"), F.lit(True).alias("on_list"))
    # rows without a canonical url are no rows of the join: they would share one key
    out = rows.filter("key <> ''").join(on_list, F.col("key") == F.col("k"), "left") \
        .unionByName(rows.filter("key = ''").withColumns({"k": F.lit(None).cast("string"), "on_list": F.lit(None).cast("boolean")}))
    listed_flag = F.coalesce("on_list", F.lit(False))
    return out.select("id", "host", "path", "rule", F.coalesce("by_rule", F.when(listed_flag, "block").otherwise("allow"))
                      .alias("verdict"), listed_flag.alias("listed"))
