"""Conversation prefix trie, filter audit and WARC against plain Python (their SQL is compared in test_operators)."""

import collections
import gzip
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import filter_audit, prefix_trie, warc


# 11 prefix trie

def plain_trie(convs):
    """{(conv, depth): (parent_conv, members, children, leaves, saved, ends)} of {conv: [(role, text)]}."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for path, cs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p and q for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ended = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(path)))
        out[min(cs), len(path)] = (min(members[path[:-1]]) if path else None, len(cs), len(kids), leaves, saved,
                                   hashlib.sha256(ended.encode()).hexdigest())
    return out


def trie_rows(df):
    rows = df.collect()
    found = {(r.conv, r.depth): (r.parent_conv, r.members, r.children, r.leaves, r.saved, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


TURNS = "conv_id long, turn int, role string, text string, conv string, depth int, key string"


def turn_table(spark, convs):
    return spark.createDataFrame([(c, i, r, t, "x", 1, "k") for c, turns in convs.items() for i, (r, t) in enumerate(turns)], TURNS)


@pytest.mark.parametrize("width,least,held", [(10_000, 1000, 200_000), (2, 1, 2), (4, 3, 3), (10_000, 1, 5)])
def test_trie_equals_plain_python(spark, width, least, held):
    rng = random.Random(5)
    convs = {c: [("u" if i % 2 == 0 else "a", rng.choice(["x", "yy", "é", ""])) for i in range(rng.choice([1, 2, 3, 5, 9]))]
             for c in range(-40, 80)}
    convs |= {c: [("u", "same"), ("a", "words"), ("u", "again")] for c in range(100, 160)}  # a hot path
    convs[200] = [("u", str(i)) for i in range(300)]  # a long one
    rows = prefix_trie.turn_rows(turn_table(spark, convs))
    got = trie_rows(prefix_trie.prefix_trie(rows.unionByName(prefix_trie.openers(rows)), width, least, held))
    assert got == plain_trie(convs)


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(8)
    convs = {c: [("u", rng.choice("ab")) for _ in range(rng.randrange(1, 12))] for c in range(-11, 40) if c % 7 != 3}
    rows = prefix_trie.turn_rows(turn_table(spark, convs))
    opening = lambda conv: F.pmod(conv * 7, F.lit(9))
    rebuilt = {}
    for c, turns in convs.items():
        first, h = c - (c % 5 if c >= 0 else -(-c % 5)), c * 7 % 9
        rebuilt[c] = convs.get(first, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.with_shared_openings(rows, 5, opening), least=3))
    assert got == plain_trie(rebuilt)


def test_trie_edges(spark):
    long_text = "word " * 50_000
    rows = [(1, None, None, None), (1, 0, "a", "x"), (1, 0, "a", "x"), (2, None, "", ""), (2, 0, "a", "x"), (2, 0, "a", "x"),
            (None, 0, "a", "lost"), (3, 1, "a:", long_text), (4, 1, "a", ":" + long_text)]
    df = spark.createDataFrame([(c, t, r, x, "z") for c, t, r, x in rows], "conv_id long, turn int, role string, text string, conv string")
    turns = prefix_trie.turn_rows(df)
    got = trie_rows(prefix_trie.prefix_trie(turns.unionByName(prefix_trie.openers(turns))))
    assert got == plain_trie({1: [("", ""), ("a", "x"), ("a", "x")], 2: [("", ""), ("a", "x"), ("a", "x")], 3: [("a:", long_text)],
                              4: [("a", ":" + long_text)]})
    none = prefix_trie.turn_rows(df.limit(0))
    assert prefix_trie.prefix_trie(none.unionByName(prefix_trie.openers(none))).count() == 0


def test_ends_of_a_hot_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    steps = spark.range(2000).selectExpr("id AS conv", "0L AS depth", "X'00' AS key", "X'' AS parent", "0L AS bytes", "true AS ends")
    rows = prefix_trie.ends(steps).collect()
    assert [r.ends_sha256 for r in rows] == [hashlib.sha256(",".join(map(str, range(2000))).encode()).hexdigest()]


def test_messages_spill_and_come_back_in_order(tmp_path):
    rng = random.Random(1)
    queue, waiting = prefix_trie.Messages(held=3, folder=str(tmp_path), fan=4), collections.defaultdict(list)
    for level in range(5, -1, -1):
        for i in range(200):
            key = bytes([rng.randrange(20)])
            queue.push(level, key, i)
            waiting[key].append(i)
        for key in sorted(waiting):
            assert sorted(queue.take(level, key)) == sorted(waiting[key])
        assert not queue.heap and not queue.runs
        waiting.clear()
    assert not list(tmp_path.iterdir())


# 12 filter audit

def plain_audit(rows, labels, names, tests):
    """Rows of the audit from [(id, part, text)] and {id: (good, toxic)}."""
    smallest = {}
    for k, _, t in rows:
        if k is not None:
            smallest[t or ""] = min(k, smallest.get(t or "", k))
    seen = collections.defaultdict(list)
    for k, part, t in rows:
        t = t or ""
        fails = {n for n in names[:-1] if tests[n](t)} | ({names[-1]} if k is not None and smallest[t] < k else set())
        seen[part or ""].append((fails, *labels.get(k, (False, False))))
    out = {}
    for part, docs in seen.items():
        total = collections.Counter()
        for order in itertools.permutations(names):
            for i, f in enumerate(order):
                before = set(order[:i])
                gone = [bool(d[0] & before) for d in docs]
                removed = [d for d, g in zip(docs, gone) if not g and f in d[0]]
                total[f] += len(removed)
                out[part, "".join(order), i + 1] = (
                    sum(not g for g in gone) - len(removed), len(removed), sum(g and f in d[0] for d, g in zip(docs, gone)),
                    sum(d[0] == {f} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed))
        for (p, order, i) in [k for k in out if k[0] == part]:
            out[p, order, i] += (total[order[i - 1]],)
    return out


@pytest.mark.parametrize("broadcast_rows,spread", [(1_000_000, 4096), (0, 3)])
def test_audit_equals_plain_python(spark, broadcast_rows, spread):
    rng = random.Random(3)
    texts = ["", "a b", "a a a", "A A A B", "# x", None, " \n", "a  b", "word " * 20_000, "hot text"]
    rows = [(rng.choice([None, *range(60)]) if i % 10 == 0 else i, rng.choice([None, "", "en", "de"]), rng.choice(texts)) for i in range(150)]
    rows += [(1000 + i, "en", "hot text") for i in range(80)] + [(1000, "en", "hot text")] * 3
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, lang string, text string, hash string, bits int, part int")
    marked = [(k, k % 2, k % 3 == 0) for k in range(0, 1100, 7)] + [(7, 0, True), (None, 1, True), (14, None, None)]
    labels = spark.createDataFrame([(k, q, None if t is None else int(t)) for k, q, t in marked], "doc_id long, quality int, toxic int")
    known = {}
    for k, q, t in marked:
        good, toxic = known.get(k, (False, False))
        known[k] = (good or q == 1, toxic or bool(t))
    known.pop(None)
    filters = {"A": filter_audit.few_words(2), "B": filter_audit.few_distinct(80), "D": filter_audit.holds_any("#$")}
    split = lambda t: [w for w in re.split("[\x20\x09-\x0D]+", t) if w]
    tests = {"A": lambda t: len(split(t)) < 2, "B": lambda t: 100 * len(set(split(t))) < 80 * len(split(t)), "D": lambda t: bool(re.search("[#$]", t))}
    failed = filter_audit.failures(docs, filters, "E", broadcast_rows=broadcast_rows, spread=spread)
    names = ["A", "B", "D", "E"]
    found = filter_audit.audit(filter_audit.combinations(failed, labels), names).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(found) == len(got) == 3 * 24 * 4 and got == plain_audit(rows, known, names, tests)


def test_audit_edges(spark, odd_docs, no_docs):
    docs, none = odd_docs.withColumn("lang", F.lit(None).cast("string")), no_docs.withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filters = {"C": filter_audit.many_capitals(10)}
    run = lambda d: filter_audit.audit(filter_audit.combinations(filter_audit.failures(d, filters, "E"), labels), ["C", "E"])
    rows = run(docs).collect()
    assert len(rows) == 4 and {r.part for r in rows} == {""}
    assert {r.kept for r in rows if r.step == 2} == {9}  # of ten rows the empty text of id 3 repeats the null one of id 2
    assert run(none).count() == 0
    with pytest.raises(ValueError):
        filter_audit.failures(docs, {"E": F.lit(True)}, "E")


# 13 WARC

PAGES = "page_id long, url string, html string, id string, digest string, body string"


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def hot_pages():
    same, tail = "s" * 40 + "\r\n\r\n", "é\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(i, f"http://h{i}.org/a b?q={i}#f", same) for i in range(30)]
    rows += [(100 + i, f"HTTP://x.org/{i}", tail * i) for i in range(20)] + [(300 + i, "no scheme", tail * 4) for i in range(5)]
    rows += [(400, None, None), (401, "", ""), (402, "http://x\r\nWARC-Type: response\r\n\r\n", "p\r\n"), (None, "http://n.org", same),
             (403, "http://x.org/long", "word \r\n" * 40_000)]
    return rows


def plain_digests(rows, least):
    def order(k, url):
        return (k is not None, k or 0, url is not None, url or "")
    by = collections.defaultdict(list)
    for k, url, html in rows:
        by[html or ""].append((k, url))
    out = []
    for html, same in by.items():
        raw = html.encode()
        holder = max(same, key=lambda x: order(*x))
        for k, url in same:
            first = len(raw) < least or (k, url) == holder
            out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first else holder[0]))
    return sorted(out, key=str)


def digest_rows(df):
    num = lambda x: None if x is None else int(x)
    return sorted(((num(r.id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_rows,per_file", [(1_000_000, 500_000), (0, 9)])
def test_warc_round_trip(spark, tmp_path, broadcast_rows, per_file):
    rows = hot_pages()
    path = warc.write_archives(page_table(spark, rows), str(tmp_path / "warc"), min_bytes=40, broadcast_rows=broadcast_rows, records_per_file=per_file)
    records = warc.read_records(spark, path).cache()
    assert records.groupBy("record_type").count().filter("record_type = 'request'").first()["count"] == len(rows) * 1
    found = warc.captures(records)
    assert digest_rows(warc.page_digests(found)) == plain_digests(rows, 40)
    nested = {r.metadata[0].fields.get("page_id"): r for r in found.collect()}
    assert len(nested) == len(rows) and all(len(r.requests) == len(r.metadata) == 1 and r.part == 0 for r in nested.values())
    assert nested["0"].requests[0].http_head == "GET /a b?q=0 HTTP/1.1\r\nHost: h0.org" and nested["400"].target_uri is None
    assert nested["402"].target_uri == "http://x%0D%0AWARC-Type: response%0D%0A%0D%0A"
    payloads = {r.record_id: r.payload for r in warc.read_records(spark, path, with_payload=True).filter("record_type = 'response'").collect()}
    for k, _, html in rows:
        r = nested.get(None if k is None else str(k))
        if r.record_type == "response":
            assert bytes(payloads[r.capture]).decode() == (html or "")
    # the files are plain WARC: parsed here by length alone
    seen = 0
    for file in (tmp_path / "warc").glob("part-*"):
        raw = gzip.decompress(file.read_bytes())
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            size = int(re.search(rb"Content-Length: (\d+)$", raw[at:end])[1])
            assert raw[at:at + 8] == b"WARC/1.1" and raw[end + 4 + size:end + 8 + size] == b"\r\n\r\n"
            at, seen = end + 8 + size, seen + 1
    assert seen == 3 * len(rows)


def test_warc_repeated_and_empty(spark):
    rows = [(1, "u", "x" * 50), (1, "u", "x" * 50), (1, "v", "x" * 50), (2, "u", "y"), (None, None, None)]
    records = warc.read_records(spark, warc.write_archives(page_table(spark, rows), min_bytes=50)).cache()
    got = digest_rows(warc.page_digests(warc.captures(records)))
    assert got == plain_digests([rows[0], *rows[2:]], 50)
    none = warc.read_records(spark, warc.write_archives(page_table(spark, rows).limit(0)))
    assert none.count() == 0 and warc.page_digests(warc.captures(none)).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Gzip members by record, base32 digests, unknown types, links of no response and more requests than a row takes."""
    def rec(kind, rid, block=b"", **more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()], f"Content-Length: {len(block)}"]
        return gzip.compress(b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    import base64
    body = b"\xff\xfe raw"
    http = {"Content_Type": "application/http; msgtype=response"}
    parts = [rec("warcinfo", "w", b"software: x\r\n", Content_Type="application/warc-fields"),
             rec("response", "r", b"HTTP/1.1 404 no\r\nA: b\r\n\r\n" + body, **http,
                 WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()),
             *[rec("request", f"q{i}", b"GET / HTTP/1.1\r\n\r\n", **http, WARC_Concurrent_To="<r>") for i in range(7)],
             rec("request", "alone", b"GET /x HTTP/1.1", **http), rec("metadata", "m", b"a: b\r\n", Content_Type="application/warc-fields", WARC_Concurrent_To="<gone>"),
             rec("resource", "s", b"plain\r\n\r\n\r\n"), rec("response", "t", b"no http", WARC_Payload_Digest="md5:00")]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.warc.gz").write_bytes(b"".join(parts))
    records = warc.read_records(spark, str(tmp_path / "other"), with_payload=True).cache()
    by = {r.record_id: r for r in records.collect()}
    assert len(by) == len(parts) and bytes(by["<r>"].payload) == body and by["<r>"].payload_digest == hashlib.sha1(body).hexdigest()
    assert by["<t>"].payload_bytes == 7 and by["<w>"].fields == {"software": "x"}
    rows = warc.captures(records, most=3).collect()
    of_r = [r for r in rows if r.capture == "<r>"]
    assert sorted(q.record_id for r in of_r for q in r.requests or []) == [f"<q{i}>" for i in range(7)] and len(of_r) > 1
    assert sum(r.record_type == "response" for r in of_r) == 1
    assert {r.capture for r in rows if r.record_type is None and r.capture != "<r>"} == {"<alone>", "<gone>"}
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_records(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc.gz").write_bytes(rec("response", "r", b"x", WARC_Payload_Digest="sha1:" + "0" * 40))
    with pytest.raises(Exception, match="digest"):
        warc.read_records(spark, str(tmp_path / "bad")).collect()
