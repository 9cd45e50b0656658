"""The training-data operators against brute force, exact round trips and edge tables."""

import collections
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskpanel.llm import (chat_format, decontaminate, lm_score, packing, quality_rules, simhash, suffix_dedup, tokens,
                           toxicity, url_filter, wavelet)
from riskpanel.llm.queries import QUERIES, tokenizer


SF_SMALL = "/root/testdata/sf0.001"


def docs_of(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb
    con = duckdb.connect()
    for p in glob.glob(f"{SF_SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    query, sql = QUERIES[name]
    got = query(spark, SF_SMALL)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want, key=key)


# 1 quality rules

def test_quality_measures_match_plain_python(spark):
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"][0](spark, SF_SMALL).collect()}
    for key, text in docs_of(spark):
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        again = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        marked = {i + j for i in range(len(words) - 7) if again[tuple(words[i:i + 8])] > 1 for j in range(8)}
        r = got[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)), key
        assert r.base_failed == (len(words) < 20 or 100 * len(marked) > 30 * len(words))
        assert not (r.kept and r.base_failed)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.7
    acc, patterns = [0.95, 0.9, 0.8, 0.7], collections.Counter()
    for y in good:
        votes = ["0" if rng.random() < 0.2 else "+" if (rng.random() < a) == y else "-" for a in acc]
        patterns["".join(votes)] += 1
    post, found, share = quality_rules.fit(patterns)
    assert abs(share - 0.7) < 0.05 and np.abs(found - np.array(acc)[:, None]).max() < 0.06
    assert post["++++"] > 0.95 and post["----"] < 0.05
    assert quality_rules.fit({})[0] == {}


def test_quality_edges(spark, odd_docs, no_docs):
    rows = quality_rules.posteriors(quality_rules.votes(quality_rules.text_stats(odd_docs))).collect()
    assert len(rows) == 10 and all(0 <= r.p_good <= 1 for r in rows)
    assert {r.n_words for r in rows if r.id in (2, 3, 4)} == {0}
    assert quality_rules.posteriors(quality_rules.votes(quality_rules.text_stats(no_docs))).count() == 0


# 2 url filter

def test_bloom_lets_all_listed_pass_and_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    other = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key"))
    filt = url_filter.bloom(keys, log2_blocks=8)
    assert filt.count() <= 256
    assert url_filter.maybe_listed(keys, "key", filt, 8).count() == 2000
    assert url_filter.maybe_listed(other, "key", filt, 8).count() < 2000


def test_filter_size_follows_the_list():
    assert [url_filter.blocks_for(n) for n in (0, 1, 16 * 2 ** 10, 16 * 2 ** 10 + 1, 10 ** 12)] == [4, 4, 10, 11, 20]


def test_url_rules_edges(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/")]
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://notnet/", "http://x.net?q/",
            "http://x.org/p/?b=2&utm_source=t&a=1#f", "https://www.x.org/p?a=1&b=2", "http://xnet/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string")
    got = {r.id: r for r in url_filter.filter_urls(pages, pages.filter("page_id = 8"), rules).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 10)] == [("", "")] * 3 + [("b:", "//c/d")]
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4].rule is None and got[5].rule is None and got[6].rule is None and got[9].rule is None
    assert got[7].verdict == got[8].verdict == "block" and got[7].listed  # canonically the same
    assert got[0].verdict == "allow"
    empty = pages.limit(0)
    assert url_filter.filter_urls(empty, empty, rules).count() == 0
    assert url_filter.filter_urls(pages, empty, rules).filter("listed").count() == 0


# 3 chat formatting

def test_chat_round_trip_and_examples(spark):
    said = ["\\### Assistant: </turn> ok", "####\\", "", None, "</tur</turn>\n### user: x</turn>\n", "a:b\\:c", "é😀"]
    rows = [(c, t, ["user", "assistant", "sys:tem", None][(t + c) % 4], said[(t * c + t) % len(said)], "x", 1)
            for c in range(5) for t in range(6)] + [(9, 0, "user", "only", "x", 1), (None, 0, "assistant", "orphan", "x", 1), (9, 0, "user", "only", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, conv string, segment int")
    segments = chat_format.expand(df, segment_chars=40)
    got = {r.conv: r for r in chat_format.read_back(segments).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        want = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in chat_format.render(segments).collect():
        turns = [(m[1], m[2]) for m in chat_format.PARSE.finditer(r.text)]
        assert turns[-1][0] == "assistant" and r.text[r.loss_start:r.loss_end] == turns[-1][1]
        assert len(turns) == [i for i, t in enumerate(sorted(by[r.conv])) if t[1] == "assistant"][r.example] + 1
    assert chat_format.read_back(chat_format.expand(df.limit(0))).count() == 0
    written = chat_format.examples(segments, batch_chars=300)
    assert chat_format.read_examples(written).exceptAll(chat_format.read_back(segments)).count() == 0
    assert chat_format.read_examples(written).count() == len(by)
    for r in written.collect():
        parsed = [(chat_format.unescape(m[1]), chat_format.unescape(m[2])) for m in chat_format.PARSE.finditer(r.text)]
        assert parsed == [(role, text) for _, role, text in sorted(by[r.conv])][:len(parsed)]
        assert r.last == (len(parsed) == len(by[r.conv]))
    assert chat_format.read_examples(chat_format.examples(chat_format.expand(df.limit(0)))).count() == 0


# 4 toxicity

def toxic_fixture(n=600, seed=1):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abdefghijkmnoprstu"), int(rng.integers(2, 8)))) for _ in range(3000)]
    rows = []
    for i in range(n):
        words = [plain[int(k)] for k in rng.integers(0, len(plain), int(rng.integers(30, 200)))]
        if i % 4 == 0:
            for _ in range(3):
                stem = ["zwerg", "quatsch", "vlax"][int(rng.integers(3))]
                words.insert(int(rng.integers(len(words))), stem + "".join(rng.choice(list("aeiou"), 2)))
        rows.append((" ".join(words).encode(), int(i % 4 == 0)))
    return rows


def test_toxicity_generalises_to_unseen_misspellings():
    rows = toxic_fixture(1600)
    model = toxicity.train([t for t, _ in rows[:1200]], [y for _, y in rows[:1200]], buckets=1 << 14)

    def score(text):
        words = toxicity.words_of(text)
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([index[w] for w in words], np.int64)
        return model.score(ids, model.word_logits(list(index))[ids])

    right = [(score(t) >= 0.3) == bool(y) for t, y in rows[1200:]]
    assert np.mean(right) > 0.9
    assert score(rows[1][0] + b" zwergxu quatschiz vlaxei zwergoo") > score(rows[1][0])


def test_toxicity_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (8, 1), (2, None), (6, 5), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels, buckets=1 << 10)
    rows = toxicity.scores(odd_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.id == 1}) == 1
    assert toxicity.scores(no_docs, model).count() == 0
    assert toxicity.clean(odd_docs, model, 2.0).exceptAll(odd_docs).count() == 0
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert {r.score for r in toxicity.scores(odd_docs, none).collect()} == {1 / (1 + np.exp(60.0))}


def test_conflicting_labels_and_repeated_ids_have_one_result(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "z"), (3, "c")], "doc_id int, text string")
    labels = [(1, 0), (1, 1), (2, 0), (2, 0), (3, 1), (3, 0)]
    for order in (labels, labels[::-1]):
        got = toxicity.training_rows(docs, spark.createDataFrame(order, "doc_id int, toxic int").repartition(3), 100)
        assert sorted((r.id, r.text, r.y) for r in got.collect()) == [(1, "a", 1), (2, "z", 0), (3, "c", 1)]


def test_texts_leave_an_arrow_batch_a_few_rows_at_a_time():
    import tracemalloc

    import pyarrow as pa
    from riskpanel.llm.common import binary_values
    texts = ["é", None, "", "b" * 300, "c\x00"] * 103
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], names=["t"])
        want = [None if t is None else t.encode() for t in texts]
        assert list(binary_values(batch, "t")) == want and list(binary_values(batch.slice(3, 7), "t", 2)) == want[3:10]
        assert list(binary_values(batch.slice(0, 0), "t")) == []
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 4000] * 4000)], names=["t"])
    tracemalloc.start()
    try:
        assert sum(map(len, binary_values(batch, "t"))) == 16_000_000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4e6, peak  # 16 MB as one list


def test_table_sums_are_the_sums_in_blocks():
    rng = np.random.default_rng(3)
    for counts in ([], [0], [0, 0, 3, 0, 4, 4, 0, 1, 9, 0], rng.integers(0, 6, 400)):
        counts = np.array(counts, np.int64)
        for shape in ((50,), (50, 3)):
            table, rows = rng.normal(size=shape), rng.integers(0, 50, counts.sum()).astype(np.uint16)
            for block in (1, 4, 7, 1 << 15):
                assert np.array_equal(toxicity._table_sums(table, rows, counts, block), toxicity._sums(table[rows], counts))


def test_toxicity_vocabulary_has_all_grams_in_blocks():
    texts = [b"one two three", None, b"", b"two " + b"four" * 30 + b" a", b"three one"]
    docs, gram, n = toxicity._vocabulary(iter(texts), 1 << 16, block=2)
    assert [d.tolist() for d in docs] == [[0, 1, 2], [], [], [1, 3, 4], [2, 0]]
    want, want_n = toxicity.grams([b"one", b"two", b"three", b"four" * 30, b"a"], 1 << 16)
    assert np.array_equal(gram, want) and np.array_equal(n, want_n)
    assert [len(x) for x in toxicity._vocabulary([None, b" "], 8)] == [2, 0, 0]


def test_toxicity_training_holds_little_beside_its_words():
    import tracemalloc
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (60_000, 12), dtype=np.uint8)
    words = [x.tobytes() for x in letters]
    texts = [b" ".join(words[i:i + 300]) for i in range(0, len(words), 300)]
    del words, letters
    tracemalloc.start()
    try:
        toxicity.train(texts, [i % 4 == 0 for i in range(len(texts))], epochs=3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6, peak  # 60,000 words of 33 n-grams; gathered in one go they took 211 MB


def test_toxicity_query_is_shaped_by_the_contract(spark):
    rows = QUERIES["op4_toxicity"][0](spark, SF_SMALL).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


# 5 language model

def test_lm_edges(spark, odd_docs, no_docs):
    rows = {(r.id, r.n_tokens): r for r in lm_score.score(odd_docs, block_tokens=100).collect()}
    assert rows[2, 0].log_score == 0 and rows[2, 0].perplexity is None
    assert lm_score.score(odd_docs, block_tokens=100).count() == 10
    assert lm_score.score(no_docs).count() == 0


def test_lm_scores_do_not_depend_on_blocks(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a, b = ({r.id: r.log_score for r in lm_score.score(docs, block_tokens=n).collect()} for n in (500, 10**7))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_lm_query_is_plain_stupid_backoff(spark):
    docs = [(k, t.encode().lower().split()) for k, t in docs_of(spark)]
    seen = [collections.Counter(tuple(w[i:i + n]) for _, w in docs for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(seen[0].values())

    def log_s(gram):
        if len(gram) == 1:
            return np.log(seen[0][gram]) - np.log(total)
        c = seen[len(gram) - 1][gram]
        return np.log(c) - np.log(seen[len(gram) - 2][gram[:-1]]) if c else np.log(0.4) + log_s(gram[1:])

    got = sorted((r.doc_id, r.n_tokens, r.log_score) for r in QUERIES["op5_lm_score"][0](spark, SF_SMALL).collect())
    want = sorted((k, len(w), sum(log_s(tuple(w[max(0, i - 2):i + 1])) for i in range(len(w)))) for k, w in docs)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 2e-3


def test_lm_buckets_grow_with_the_corpus(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r.id: r.log_score for r in lm_score.score(docs).collect()}
    used, explode = [], lm_score.exploded
    monkeypatch.setattr(lm_score, "exploded", lambda blocked, order, buckets: used.append(buckets) or explode(blocked, order, buckets))
    monkeypatch.setattr(lm_score, "BUCKET_GRAMS", 2000, raising=False)
    got = {r.id: (r.n_tokens, r.log_score) for r in lm_score.score(docs).collect()}
    assert 3 * sum(n for n, _ in got.values()) <= 2000 * used[0]
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k]) < 1e-6 for k in want)


def test_lm_counts_are_looked_up_in_less_time_than_two_sorts():
    rng = np.random.default_rng(3)
    grams = [rng.integers(1, 1 << 56, 1_000_000, dtype=np.uint64) for _ in range(3)]
    grams[1][::7] = grams[0][::7]
    for g in grams[1:]:
        g[::5] = 0
    every = np.concatenate(grams)
    uniq, count = np.unique(every[every != 0], return_counts=True)
    known, some = dict(zip(uniq.tolist(), count.tolist())), slice(None, None, 97)

    def seconds(work):
        began = time.process_time()
        return work(), time.process_time() - began

    tries = [(seconds(lambda: lm_score._looked_up(grams, [count[:1000], count[1000:]])), seconds(lambda: np.argsort(every))) for _ in range(3)]
    for g, got in zip(grams, tries[0][0][0]):
        assert got[some].tolist() == [known.get(x, 0) for x in g[some].tolist()]
    assert min(found[1] for found, _ in tries) < 2 * min(sort[1] for _, sort in tries)
    assert [len(x) for x in lm_score._looked_up([np.zeros(0, np.uint64)] * 3, [])] == [0, 0, 0]


# 6 token ids

ODD_TEXTS = ["", "a", "  two  blanks ", " lead", "trail ", "a\n\nb", "tab\there", "it's we'll\nI'd x", "nb\xa0sp", "e\u0301 x", "A\x00B",
             "<|endoftext|> hi", "a <|EndOfText|> b<|endoftext|>", "<|startoftext|>x\ny", "日本語 テキスト\nabc", "😀 👩‍👩‍👧 x", "a \n b", "x\n", "\nx", "\x1cfoo bar", "foo\x85bar baz", "...,,, !!\n??", "'s 't a'S b"]


@pytest.mark.parametrize("name, blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_ids_equal_the_librarys(spark, name, blanks):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer(name))
    texts = ODD_TEXTS + [t for _, t in docs_of(spark)[:60]]
    for specials in (False, True):
        plain.encode_special_tokens = specials
        enc = tokens.ChunkEncoder(tokenizer(name), blanks, cache=50, plain_specials=specials)
        ids, n = enc.encode(texts)
        ends = np.cumsum(n)
        for t, e, k in zip(texts, ends, n):
            assert ids[e - k:e].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:40])


@pytest.mark.parametrize("name, blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_learns_a_word_once_and_keeps_what_recurs(name, blanks):
    from tokenizers import Tokenizer
    plain, enc = Tokenizer.from_file(tokenizer(name)), tokens.ChunkEncoder(tokenizer(name), blanks, cache=50)
    learned, learn = [], enc._learn
    enc._learn = lambda keys: (learned.extend(keys if isinstance(keys, list) else keys.to_pylist()), learn(keys))[1]

    def same(texts):
        ids, n = enc.encode(texts)
        for t, e, k in zip(texts, np.cumsum(n), n):
            assert ids[e - k:e].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)

    # one word after a blank, one with nothing before it, four sorts of marks, a line break
    same(["x stra\u00dfe stra\u00dfe### stra\u00dfe.%%% stra\u00dfe,\nstra\u00dfe###\nstra\u00dfe", "stra\u00dfe,"])
    assert sum("stra" in k for k in learned) == (2 if blanks else 1)
    same(["it's a's' ###a a#b <a>: \u00aa\u00b5. \u00c9t\u00e9~ a\u0301, a.\u0301 Na\u00efve\\^`", "\nodd ", "...\n...", "a\n'a\n\u00df", "", "E.ON|[x]"])
    rare = iter("".join(w) for w in itertools.product("abcdefghij", repeat=4))
    for _ in range(40):
        same(["x immer " + " ".join(itertools.islice(rare, 30)) + " immer!"])
    assert learned.count("immer") <= 2  # once more if it was new when the cache was full
    assert len(enc.index) < 150


def test_wavelet_matrix_against_lists():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 50, n).astype(np.uint32)
        m = wavelet.load(wavelet.dump(np.array([1]), np.array([n]), ids, 6))[2]
        assert (m.ids() == ids).all() and (m.access(np.arange(n)) == ids).all()
        for t in (0, 7, 49):
            at = np.flatnonzero(ids == t).tolist()
            assert m.count(t) == len(at) and m.find(t, len(at)) == -1 and m.find(t, -1) == -1
            assert [m.find(t, k) for k in range(len(at))] == at
            assert m.count(t, n // 3, n // 2) == sum(n // 3 <= x < n // 2 for x in at)


def test_wavelet_query_equals_the_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op6_wavelet"][0](spark, SF_SMALL).collect()}
    start = 0
    for key, text in sorted(docs_of(spark)):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = tokenizer("word_bpe_49k.json")
    rows = wavelet.read_documents(wavelet.write_shards(odd_docs, path, 2, shard_tokens=20)).collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 1 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert wavelet.read_documents(wavelet.write_shards(no_docs, path, 2)).count() == 0


# 7 suffix sorting

def brute_repeats(texts, size):
    seen = collections.Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                m[i:i + size] = b"\1" * size
        out.append(bytes(m))
    return out


@pytest.mark.parametrize("crowded", [5000, 1])
def test_suffix_dedup_equals_brute_force(spark, crowded):
    rng = np.random.default_rng(0)
    base = ["".join(rng.choice(list("abcd é"), int(n))) for n in rng.integers(0, 900, 30)]
    mixed = [base[int(rng.integers(30))][int(rng.integers(100)):] + f"#{i}" + base[int(rng.integers(30))][10:400] for i in range(20)]
    texts = base + mixed + ["a" * 700, "ab" * 300, "", None, "x" * 199, "x" * 200, "same id", "é" * 150, "é" * 150]
    df = spark.createDataFrame([(min(i, 55), t, "s") for i, t in enumerate(texts)], "doc_id int, text string, start string")
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, (t, m) in enumerate(zip(raw, brute_repeats(raw, 200))):
        runs = len([x for x in m.split(b"\0") if x])
        want.append((min(i, 55), len(t), sum(m), runs, hashlib.sha256(bytes(b for b, x in zip(t, m) if not x)).hexdigest()))
    got = suffix_dedup.digests(df.repartition(3), crowded=crowded).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_suffix_dedup_compares_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    long, short = noise(600), noise(205)
    texts = [noise(60) + long + noise(60) for _ in range(60)] + [noise(60) + short + noise(60) for _ in range(60)]
    texts += [noise(60) + "xyz"[i % 3] + long[150:500] + "xyz"[i // 3 % 3] + noise(60) for i in range(30)]
    compare, most = suffix_dedup._compare, 20

    def checked(length):
        run = compare(length)

        def watch(batches):
            import collections
            groups = collections.Counter()
            for b in batches:
                groups.update(zip(b.column("g1").to_pylist(), b.column("g2").to_pylist()))
                if max(groups.values(), default=0) > most:
                    raise ValueError("a crowded group goes to one task")
                yield b

        return lambda batches: run(watch(batches))

    monkeypatch.setattr(suffix_dedup, "_compare", checked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: r.n_removed for r in suffix_dedup.digests(df, crowded=most).collect()}
    assert got == {i: sum(m) for i, m in enumerate(brute_repeats([t.encode() for t in texts], 200))}


def test_suffix_dedup_edges(spark, odd_docs, no_docs):
    assert suffix_dedup.digests(no_docs).count() == 0
    cut = suffix_dedup.strip_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == 10
    assert cut.filter("doc_id = 2").first().text is None
    others = [c for c in odd_docs.columns if c not in ("doc_id", "text")]
    assert cut.select(others).distinct().collect() == odd_docs.select(others).distinct().collect()
    assert suffix_dedup.keep_text("aéb".encode(), [(2, 3)]) == "aéb" and suffix_dedup.keep_text("aéb".encode(), [(1, 3)]) == "ab"


def test_refine_depth():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 3 + b"abcdefghijklmnopqrstuvwxyX", np.uint8)
    ids = suffix_dedup.refine(data, np.array([0, 26, 52, 78]), 26)
    assert ids[0] == ids[1] == ids[2] >= 0 and ids[3] == -1


def test_a_suffix_task_needs_one_python_worker(spark, monkeypatch):
    """No stage has two Python operators: each would keep a worker of the executor, and its memory, in every task."""
    docs = spark.createDataFrame([(i, f"text {i} " + "repeated words " * (20 + i)) for i in range(6)], "doc_id long, text string")
    plans, write = [], suffix_dedup.materialize

    def recorded(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(suffix_dedup, "materialize", recorded)
    for crowded in (5000, 1):
        plans.append(suffix_dedup.strip_repeats(docs, crowded=crowded)._jdf.queryExecution().optimizedPlan().toString())
    stages = [s for plan in plans for s in re.split(r"Repartition|Join|Aggregate|Union|Relation", plan)]
    assert sum(s.count("MapInArrow") for s in stages) > 6 and all(s.count("MapInArrow") <= 1 for s in stages)


# 8 decontamination

def test_masks_are_lossless():
    from itertools import combinations
    for gone in combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.NEED):
        assert any(not {at + o for o in m} & set(gone) for m in decontaminate.MASKS
                   for at in range(decontaminate.WINDOW - decontaminate.SPAN + 1)), gone


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontamination_tolerates_substitutions(spark, odd_docs, broadcast_rows):
    words = [f"t{i}" for i in range(60)]
    item = " ".join(words[:30])
    short = "alpha beta gamma delta eps zeta eta theta iota"
    hit = words[:30]
    two = [*hit[:5], "X", *hit[6:9], "Y", *hit[10:13]]
    three = [*hit[:4], "X", *hit[5:7], "Y", *hit[8:10], "Z", *hit[11:13]]
    rows = [(1, "lead " + item.upper() + " tail"), (2, " ".join(two)), (3, " ".join(three)), (4, " ".join(words[30:])), (5, None), (6, ""),
            (7, "say: " + short + "!"), (8, short[:-12]), (9, " ".join(hit[:12])), (None, item), (1, "clean")]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id int, text string, item_id string, h int")
    bench = spark.createDataFrame([(10, item), (11, None), (12, short), (13, "too short"), (14, item)], "item_id int, text string")
    got = {r["id"]: r["items"] for r in decontaminate.findings(docs, bench, broadcast_rows=broadcast_rows).collect()}
    assert got == {1: [10, 14], 2: [10, 14], 7: [12], None: [10, 14]}
    clean = decontaminate.decontaminate(docs, bench, broadcast_rows=broadcast_rows)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 8, 9]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.findings(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_short_items_are_found_whole(spark, broadcast_rows):
    from itertools import combinations
    rows, bench, want = [], [], {}
    for size in range(1, 13):
        words = [f"s{size}w{i}" for i in range(size)]
        bench.append((size, " ".join(words)))
        most = 0 if size < 8 else 1 if size < 10 else 2
        for gone in range(most + 2):
            for places in list(combinations(range(size), gone))[:70]:
                own = [f"x{i}" if i in places else w for i, w in enumerate(words)]
                if any(i not in places for i in range(size)):
                    rows.append((len(rows), " ".join(["lead", *own, "tail"][len(rows) % 2:])))
                    if gone <= most:
                        want[rows[-1][0]] = [size]
        rows.append((len(rows), " ".join(words[:-1])))  # cut short
        rows.append((len(rows), " ".join(words[1:])))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    items = spark.createDataFrame(bench, "item_id int, text string")
    got = {r["id"]: r["items"] for r in decontaminate.findings(docs, items, broadcast_rows=broadcast_rows).collect()}
    assert got == want


def test_decontamination_is_native(spark):
    from riskpanel.llm.common import read
    plan = decontaminate.findings(read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "benchmark"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# 9 packing

def test_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 33, 400))[::-1]
    seq, off = packing.place(lengths, 32)
    used, gaps = {}, collections.Counter()
    for s, q, o in zip(lengths.tolist(), seq.tolist(), off.tolist()):
        options = {}
        for g in [g for g, n in gaps.items() if n and g >= s] or [32]:
            c = gaps.copy()
            if g < 32:
                c[g] -= 1
            if g > s:
                c[g - s] += 1
            options[g] = sum(n * n for n in c.values())
        gap = 32 - used.get(q, 0)
        assert o == used.get(q, 0) and options[gap] == min(options.values())
        if gap < 32:
            gaps[gap] -= 1
        if gap > s:
            gaps[gap - s] += 1
        used[q] = o + s
    assert len(used) <= 1.05 * -(-lengths.sum() // 32) + 1


def test_packing_query(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = QUERIES["op9_packing"][0](spark, SF_SMALL).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for key, text in docs_of(spark):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for i, r in enumerate(sorted(by[key], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[at:at + r.length].tobytes()))
            assert r.length == 1024 or i == 0
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(seqs) <= 1.1 * sum(r.length for r in rows) / 1024 + 1
    path = tokenizer("byte_bpe_50k.json")
    odd = packing.pack_documents(odd_docs, path, 2, capacity=64).collect()
    assert sum(r["id"] == 1 for r in odd) == 2 and sum(r["id"] is None for r in odd) == 1 and [r.length for r in odd if r["id"] == 2] == [1]
    assert packing.pack_documents(no_docs, path, 2).count() == 0


def test_sequences_hold_their_pieces(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(30)
    parts = packing.pieces(docs, tokenizer("byte_bpe_50k.json"), 2, 256).cache()
    placed = packing.pack(parts.drop("ids"), 256)
    want = collections.defaultdict(bytes)
    raw = {(r["row"], r["piece"]): r["ids"] for r in parts.collect()}
    for r in sorted(placed.collect(), key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] += bytes(raw[r["row"], r["piece"]])
    assert {r.sequence_id: bytes(r.ids) for r in packing.sequences(parts, placed).collect()} == dict(want)


# 10 simhash

def plain_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def test_simhash_query_equals_brute_force(spark):
    rows = sorted(docs_of(spark))
    fps = [plain_simhash(t) for _, t in rows]
    label = plain_components(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"][0](spark, SF_SMALL).collect()}
    for (key, _), f, c in zip(rows, fps, label):
        assert got[key] == (f"{f:016x}", rows[c][0])


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_of_clustered_fingerprints(spark, hot):
    rng = np.random.default_rng(5)
    fps = []
    for c in rng.integers(0, 1 << 63, 12):
        f = int(c)
        for _ in range(25):  # chains: neighbours are near, ends are not
            fps.append(f)
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                f ^= 1 << int(b)
    want = plain_components(fps, 4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    got = {r.id: r.component for r in simhash.link_components(df, 4, hot).collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_bit_sliced_distances():
    rng = np.random.default_rng(6)
    q, x = rng.integers(0, 1 << 63, 40).astype(np.uint64), rng.integers(0, 1 << 63, 130).astype(np.uint64)
    x[:40] = q ^ np.array([(1 << int(k % 9)) - 1 for k in range(40)], np.uint64)
    for radius in (0, 3, 4, 7):
        skip = np.zeros((40, 3), np.uint64)
        hit = np.unpackbits(simhash.within(q, simhash.planes(x), radius, skip).view(np.uint8), axis=1, bitorder="little")[:, :130]
        assert (hit == (np.bitwise_count(q[:, None] ^ x[None, :]) <= radius)).all()


def test_simhash_edges(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10 and {(r.fp, r.component) for r in rows if r.id in (2, 3, 4)} == {(0, 2)}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 8]
    assert {(r["__row"], r["__z"], r.c0, tuple(r.spans)) for r in kept.collect()} == {(7, "z", "c", (3,))}
    assert simhash.keep_one(no_docs).count() == 0
