"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, filter_audit, lm_score, packing, prefix_trie, quality_rules, simhash, suffix_dedup, toxicity, url_filter, warc, wavelet
from .common import materialize, read

#: Threshold of op4's decision and of the pipeline's first stage.
TOXIC_AT = 0.3
END_ID = 2
#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality_rules.votes(quality_rules.text_stats(read(spark, sf_dir, "documents"))), "quality")
    failed = quality_rules.base_failed()
    return quality_rules.posteriors(stats).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"), "votes", "p_good")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    listed = pages.filter("page_id % 100 = 0")  # the stated list: every hundredth page's url
    return url_filter.filter_urls(pages, listed, URL_RULES).withColumnRenamed("id", "page_id")


OP2_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id,
        translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
        list_sort(list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'),
            lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[a-z]+|ref|fbclid|gclid)=.*'))) AS params FROM u),
c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') = '' THEN '' ELSE regexp_replace(host, '^www\.', '')
        || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key FROM p),
listed AS (SELECT DISTINCT key FROM c WHERE page_id % 100 = 0 AND key <> ''),
r AS (SELECT c.*, c.key IN (SELECT key FROM listed) AS listed, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_format.read_examples(
        chat_format.write_examples(chat_format.expand(turns.unionByName(extra)))).withColumnRenamed("conv", "conv_id")


OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length('### : </turn>' || chr(10)) + length(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'))
        + length(role) - length(replace(role, ':', ''))
        + length(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>')) AS chars FROM t),
o AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars,
    count(*) FILTER (role = 'assistant') AS n_examples,
    CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars
FROM o GROUP BY conv_id
"""


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Trained on labelled rows outside the held-out quarter."""
    labels = read(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.fit(docs, labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 4 == 2).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(read(spark, sf_dir, "documents"), order=3, min_count=1, backoff=0.4)
    return scored.select(F.col("id").alias("doc_id"), "n_tokens", F.round("log_score", 3).alias("log_score"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w3, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT r, p, w3, lag(w3) OVER (PARTITION BY r ORDER BY p) AS w2, lag(w3, 2) OVER (PARTITION BY r ORDER BY p) AS w1 FROM t),
n AS (SELECT count(*) AS n FROM g),
c1 AS (SELECT w3, count(*) AS c FROM g GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
j AS (SELECT g.*, n, c1.c AS k1, c2.c AS k2, c3.c AS k3, x1.c AS x2, x2.c AS x3 FROM g CROSS JOIN n
    LEFT JOIN c1 ON c1.w3 = g.w3 LEFT JOIN c2 ON c2.w2 = g.w2 AND c2.w3 = g.w3
    LEFT JOIN c3 ON c3.w1 = g.w1 AND c3.w2 = g.w2 AND c3.w3 = g.w3
    LEFT JOIN c1 AS x1 ON x1.w3 = g.w2 LEFT JOIN c2 AS x2 ON x2.w2 = g.w1 AND x2.w3 = g.w2),
s1 AS (SELECT *, CASE WHEN k1 IS NULL THEN -ln(n + 1.0) ELSE ln(k1) - ln(n) END AS a FROM j),
s2 AS (SELECT *, CASE WHEN w2 IS NULL THEN a WHEN k2 IS NULL THEN a + ln(0.4) ELSE ln(k2) - ln(x2) END AS b FROM s1),
s3 AS (SELECT *, CASE WHEN w1 IS NULL THEN b WHEN k3 IS NULL THEN b + ln(0.4) ELSE ln(k3) - ln(x3) END AS s FROM s2),
z AS (SELECT r, sum(s) AS s FROM s3 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(s, 0.0), 3) AS log_score FROM d LEFT JOIN z USING (r)
"""


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID)
    return wavelet.read_documents(shards)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"), length=200).withColumnRenamed("id", "doc_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = decontaminate.findings(docs, read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "found")
    flagged = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found")), "left")
    return flagged.select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                          F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                          F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
it AS (SELECT item_id, len(w) AS m, unnest(w) AS t, generate_subscripts(w, 1) AS q FROM i),
e AS (SELECT doc_id, item_id, m, p - q AS diag, q, least(n, m + p - q) - greatest(0, p - q) AS overlap FROM dt JOIN it USING (t)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS same FROM e WHERE m >= 13 AND overlap >= 13),
f AS (SELECT DISTINCT doc_id, item_id FROM c WHERE same >= 11 UNION SELECT doc_id, item_id FROM e WHERE m < 13 AND overlap = m
    GROUP BY doc_id, item_id, m, diag HAVING count(*) >= CASE WHEN m < 8 THEN m ELSE ceil(m * 0.8) END),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM f GROUP BY doc_id)
SELECT doc_id, g.items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
FROM documents LEFT JOIN g USING (doc_id)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END_ID, 1024)
    return packed.withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_trie.turn_rows(read(spark, sf_dir, "conversations"))
    rebuilt = prefix_trie.with_shared_openings(rows, 5, lambda conv: F.crc32(conv.cast("string")) % 9)
    found = prefix_trie.prefix_trie(rebuilt)
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


OP11_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h FROM t),
r AS (SELECT conv_id, place, role, text FROM t JOIN c USING (conv_id) WHERE conv_id % 5 = 0 OR place > h
    UNION ALL SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE c.conv_id % 5 <> 0 AND place <= h),
s AS (SELECT conv_id, coalesce(list({'r': role, 't': text} ORDER BY place) FILTER (place IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
u AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM s),
m AS (SELECT conv_id, depth, depth = len(turns) AS ends, turns[1:depth] AS prefix, CASE WHEN depth > 0 THEN strlen(turns[depth].t) ELSE 0 END AS bytes FROM u),
g AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS rep FROM m),
n AS (SELECT rep, depth, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM g GROUP BY rep, depth),
p AS (SELECT n.*, g.rep AS parent FROM n LEFT JOIN g ON g.conv_id = n.rep AND g.depth = n.depth - 1),
k AS (SELECT parent AS rep, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
f AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k USING (rep, depth)),
b AS (SELECT g.rep, g.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
    FROM f JOIN g ON g.conv_id = f.rep AND g.depth <= f.depth GROUP BY ALL)
SELECT rep AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM f JOIN b USING (rep, depth)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"A": filter_audit.few_words(100), "B": filter_audit.few_distinct(80), "C": filter_audit.many_capitals(10),
               "D": filter_audit.holds_any("#$%&*|")}
    failed = filter_audit.failures(read(spark, sf_dir, "documents"), filters, "E")
    return filter_audit.audit(filter_audit.combinations(failed, read(spark, sf_dir, "labels")), ["A", "B", "C", "D", "E"])


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY text) AS smallest FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
    regexp_matches(text, '[#$%&*|]'), smallest < doc_id] AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
p AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: chr(64 + i)), '') AS filter_order, x.k AS step, o[x.k] AS own, o[1:x.k - 1] AS before FROM p, x),
y AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail, len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
    len(list_filter(fails, lambda b: b)) AS n_fails FROM c, s),
z AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (NOT gone AND fail) AS removed,
    sum(n) FILTER (gone AND fail) AS redundant, sum(n) FILTER (fail AND n_fails = 1) AS unique_fails,
    sum(n) FILTER (NOT gone AND fail AND good) AS good_lost, sum(n) FILTER (NOT gone AND fail AND toxic) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(read(spark, sf_dir, "pages"), min_bytes=1000)
    found = warc.page_digests(warc.captures(materialize(warc.read_records(spark, archives), "records")))
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN holder <> page_id THEN holder END AS refers_to FROM q
"""


#: name -> (query, DuckDB SQL or None)
QUERIES = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_url_filter": (op2_url_filter, OP2_SQL),
    "op3_chat_format": (op3_chat_format, OP3_SQL),
    "op4_toxicity": (op4_toxicity, None),
    "op5_lm_score": (op5_lm_score, OP5_SQL),
    "op6_wavelet": (op6_wavelet, None),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_decontaminate": (op8_decontaminate, OP8_SQL),
    "op9_packing": (op9_packing, None),
    "op10_simhash": (op10_simhash, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_warc": (op13_warc, OP13_SQL),
}
