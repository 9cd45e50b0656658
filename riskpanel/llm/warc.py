r"""WARC archives: written from pages, read back, and assembled into one nested row a capture.

``write_archives`` writes a request, a response (or revisit) and a metadata record for every page, as WARC/1.1 in
gzip files of the shared folder. The payload of a response is the page in UTF-8. Of captures with equal payloads of at least
``min_bytes`` bytes only the one with the largest id holds the payload; the others are revisit records (profile
identical-payload-digest) that refer to it and keep the HTTP head, so that length and digest of the full payload can be read.

``read_records`` parses such archives (also others, if each file is compressed as a whole or record by record with gzip)
by their Content-Length as a byte stream: lines of the text source only carry the bytes. A task holds one Arrow batch and one record.
A payload that does not have the digest of its header, or a record cut short, is an error.

``captures`` assembles transactions: request and metadata records are joined to the response or revisit that their
WARC-Concurrent-To names. A capture with more than ``most`` of them goes on in further rows (``part`` 1, 2, ...), so
no row or task collects an unbounded group. Records without a response give a row without one.

How it scales. The writer is one pass over the pages; which payloads repeat is found from digests alone (combined before the
shuffle), and those are joined by broadcast if counted to be under ``broadcast_rows``, else by a shuffle that AQE splits
where a digest is hot. Reading gives narrow rows, written once; the joins run on record ids. Files are not splittable, as is usual for
WARC, so ``records_per_file`` bounds them.

Defined results: a null payload counts as empty. Rows with equal id, url and payload are one capture (record ids derive
from these three) and give one row; rows that share only the id are captures of their own, the larger url counts as the larger. A null
id is smaller than any other and is read back as null. Line ends in urls are written as %0D and %0A; a null url
gives records without WARC-Target-URI. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.session import checkpoint_dir

from .common import materialize, only

END = "\r\n\r\n"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "http_head string, fields map<string,string>, payload_bytes long, payload_digest string")


def urn(kind: str, key: Column, url: Column, digest: Column) -> Column:
    """Record id of a kind of record of a capture: a UUID of version 8 from a hash of its key, url and payload digest."""
    known = F.concat_ws("\n", F.lit(kind), digest, key.isNull().cast("string"), F.coalesce(key.cast("string"), F.lit("")),
                        url.isNull().cast("string"), F.coalesce(url, F.lit("")))
    h = F.md5(known)
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-8"), h.substr(14, 3), F.lit("-a"),
                    h.substr(18, 3), F.lit("-"), h.substr(21, 12), F.lit(">"))


def record(kind: str, record_id: Column, date: str, content_type: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record without the two line ends after its block; headers with a null value are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"),
             *[F.concat(F.lit(f"{name}: "), value) for name, value in headers], F.lit(f"Content-Type: {content_type}"),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 500_000,
                   broadcast_rows: int = 1_000_000) -> str:
    """Write the archives to ``path`` (default: a new folder beside the checkpoints) and return it."""
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/warc-{uuid.uuid4().hex}"
    # the library writes one line of three records a page, so that they stand together
    caps = only(pages, id=id_col, url=url_col, body=payload_col).withColumn("body", F.coalesce("body", F.lit(""))) \
        .withColumns({"bytes": F.octet_length("body"), "digest": F.sha1("body")})
    first = materialize(
        caps.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("holder"))
        .filter("n > 1").select(F.col("digest").alias("shared"), "holder"), "holders")
    small = first.limit(broadcast_rows + 1).count() <= broadcast_rows
    caps = caps.join(F.broadcast(first) if small else first,
                     (F.col("digest") == F.col("shared")) & (F.col("bytes") >= min_bytes), "left")
    key, url, digest, holder = F.col("id"), F.col("url"), F.col("digest"), F.col("holder")
    is_response = holder.isNull() | (holder["id"].eqNullSafe(key) & holder["url"].eqNullSafe(url))
    capture = F.when(is_response, urn("response", key, url, digest)).otherwise(urn("revisit", key, url, digest))
    line_safe = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = ("WARC-Target-URI", line_safe(url))
    host, place = F.regexp_extract(target[1], r"^.*?://([^/?#]*)", 1), F.regexp_extract(target[1], r"^.*?://[^/?#]*([^#]*)", 1)
    asks = F.concat(F.lit("GET "), F.coalesce(F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)), F.lit("/")),
                    F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    head = F.concat(F.lit(HTTP_OK), F.col("bytes").cast("string"), F.lit(END))
    paid = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))
    about = F.coalesce(F.concat(F.lit("page_id: "), F.url_encode(key.cast("string")), F.lit("\r\n")), F.lit(""))
    concurrent = ("WARC-Concurrent-To", capture)
    answer = F.when(is_response, record("response", capture, date, "application/http; msgtype=response", F.concat(head, "body"), target, paid)) \
        .otherwise(record("revisit", capture, date, "application/http; msgtype=response", head, target, paid,
                          ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", urn("response", holder["id"], holder["url"], digest)),
                          ("WARC-Refers-To-Target-URI", line_safe(holder["url"])), ("WARC-Refers-To-Date", F.lit(date))))
    three = [record("request", urn("request", key, url, digest), date, "application/http; msgtype=request", asks, target, concurrent), answer,
             record("metadata", urn("metadata", key, url, digest), date, "application/warc-fields", about, target, concurrent)]
    caps.select(F.concat_ws(END, *three).alias("value")).write.option("lineSep", END).option("compression", "gzip") \
        .option("maxRecordsPerFile", max(records_per_file // 3, 1)).text(path)
    return path


def headers(raw: bytes) -> dict[bytes, bytes]:
    """Header lines by lower-cased name; the first of a name counts."""
    out: dict[bytes, bytes] = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def hex_digest(label: bytes | None) -> str | None:
    """The SHA-1 of a labelled digest as lower-case hex; None for none or other hashes."""
    if not label or not label.lower().startswith(b"sha1:"):
        return None
    value = label[5:]
    return value.decode().lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def parse(head: bytes, block: memoryview) -> tuple:
    """The columns of :data:`RECORD` and the payload."""
    h = headers(head)
    kind = h.get(b"warc-type", b"").decode()
    http, fields, payload = None, None, None
    text = lambda name: h[name].decode(errors="replace") if name in h else None
    digest = hex_digest(h.get(b"warc-payload-digest"))
    size = None
    if h.get(b"content-type", b"").startswith(b"application/http"):
        raw = bytes(block)
        end = raw.find(b"\r\n\r\n")
        http, payload = (raw, b"") if end < 0 else (raw[:end], raw[end + 4:])
    elif h.get(b"content-type", b"").startswith(b"application/warc-fields"):
        lines = [x.partition(b":") for x in bytes(block).split(b"\r\n") if x]
        fields = {k.strip().decode(errors="replace"): v.strip().decode(errors="replace") for k, _, v in lines}
    if kind == "response":
        payload = bytes(block) if payload is None else payload
        found, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if digest is not None and digest != found:
            raise ValueError(f"payload of {text(b'warc-record-id')} has digest {found}, its header says {digest}")
        digest = found
    elif kind == "revisit":
        sent = headers(http or b"").get(b"content-length", b"")
        size, payload = int(sent) if sent.isdigit() else None, None
    return (text(b"warc-record-id"), kind, text(b"warc-concurrent-to"), text(b"warc-refers-to"), text(b"warc-target-uri"), text(b"warc-date"),
            http.decode(errors="replace") if http is not None else None, list(fields.items()) if fields is not None else None, size, digest, payload)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record (:data:`RECORD`, and binary ``payload`` if asked for) of all archives in ``path``."""
    schema = RECORD + (", payload binary" if with_payload else "")

    def run(batches: Iterator):
        import pyarrow as pa
        types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in schema.split(", ")]
        data, at, need, file, out, held = bytearray(), 0, 0, None, [], 0

        def batch():
            columns = list(zip(*out))[:len(names)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names)

        def rest():
            if bytes(data[at:]).strip(b"\r\n"):
                raise ValueError(f"{file} ends within a record")

        for b in batches:
            for raw, name in zip(b.column("value").cast(pa.large_binary()).to_pylist(), b.column("file").to_pylist()):
                if name != file:
                    rest()
                    data, at, need, file = bytearray(), 0, 0, name
                data += raw
                data += b"\r\n\r\n"
                while len(data) - at >= need:
                    while data[at:at + 2] == b"\r\n":
                        at += 2
                    end = data.find(b"\r\n\r\n", at)
                    if end < 0:
                        need = len(data) - at + 1
                        break
                    head = bytes(data[at:end])
                    if not head.startswith(b"WARC/"):
                        raise ValueError(f"{file}: no record at {head[:40]!r}")
                    stop = end + 4 + int(headers(head)[b"content-length"])
                    if len(data) < stop + 4:  # the two line ends after a block are read with it
                        need = stop + 4 - at
                        break
                    with memoryview(data) as view:
                        out.append(parse(head, view[end + 4:stop]))
                    held += len(out[-1][-1] or b"") if with_payload else 0
                    at, need = stop + 4, 0
                if at > 1 << 20:
                    del data[:at]
                    at = 0
                if len(out) >= 4096 or held >= 1 << 25:
                    yield batch()
                    out, held = [], 0
        rest()
        if out:
            yield batch()

    lines = spark.read.option("lineSep", END).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(run, schema)


def captures(records: DataFrame, most: int = 1000) -> DataFrame:
    """(capture, part, record_type, target_uri, date, http_head, payload_bytes, payload_digest, refers_to, requests, metadata).

    ``records`` (see :func:`read_records`) is read several times: hand over a written table. A record id that occurs twice counts
    once. ``requests`` and ``metadata`` are arrays of structs by record id, null where a capture has none; ``payload`` is kept if it is there.
    """
    records = records.filter("record_id is not null").dropDuplicates(["record_id"])
    answers = records.filter("record_type in ('response', 'revisit')").withColumn("part", F.lit(0)).select(
        F.col("record_id").alias("capture"), "part", "record_type", "target_uri", "date", "http_head", "payload_bytes", "payload_digest",
        "refers_to", *[c for c in ("payload",) if c in records.columns])
    joined = records.filter("record_type in ('request', 'metadata')").withColumn("capture", F.coalesce("concurrent_to", "record_id")) \
        .select("capture", "record_id", "record_type", "target_uri", "date", "http_head", "fields")
    crowded = joined.groupBy("capture").count().filter(F.col("count") > most)
    if not crowded.isEmpty():
        parts = F.ceil(F.coalesce("count", F.lit(1)) / most)
        joined = joined.join(crowded, "capture", "left").withColumn("part", F.pmod(F.xxhash64("record_id"), parts).cast("int"))
    else:
        joined = joined.withColumn("part", F.lit(0))

    def side(kind: str, name: str, *columns: str) -> DataFrame:
        return joined.filter(F.col("record_type") == kind).groupBy("capture", "part") \
            .agg(F.array_sort(F.collect_list(F.struct("record_id", *columns))).alias(name))

    # fields travel as sorted entries: maps can't be compared
    joined = joined.withColumn("fields", F.array_sort(F.map_entries("fields")))
    requests = side("request", "requests", "target_uri", "date", "http_head")
    metadata = side("metadata", "metadata", "target_uri", "date", "fields") \
        .withColumn("metadata", F.transform("metadata", lambda m: m.withField("fields", F.map_from_entries(m["fields"]))))
    return answers.join(requests, ["capture", "part"], "full").join(metadata, ["capture", "part"], "full")


def page_digests(found: DataFrame) -> DataFrame:
    """(id, record_type, payload_bytes, payload_digest, refers_to) a capture, from :func:`captures`; ids as text."""
    pages = materialize(found.filter("record_type is not null and part = 0").select(
        "capture", F.url_decode(F.col("metadata")[0]["fields"]["page_id"]).alias("id"), "record_type", "payload_bytes", "payload_digest",
        F.col("refers_to").alias("holder")), "captures")
    held = pages.filter("record_type = 'response'").select(F.col("capture").alias("holder"), F.col("id").alias("refers_to"))
    columns = ["id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    again = pages.filter("record_type = 'revisit'").join(held, "holder", "left").select(columns)
    return pages.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string")).select(columns).unionByName(again)
