"""WARC archives: records written with an index, and read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, settle, table
from tessella.llm.files import make_folder, open_store

#: A new archive begins beyond this; a record isn't split.
ARCHIVE_BYTES = 128 << 20
#: Ranges are read together up to this length, across gaps of up to this many bytes.
READ_BYTES, READ_GAP = 4 << 20, 64 << 10
#: Payloads shorter than this are stored each time.
REVISIT_BYTES = 100
BROADCAST_KEYS = 500_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _page(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload (None) and names the record that has it."""
    kind = "response" if payload is not None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{_page(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head[6:6] = [f"WARC-Refers-To: <urn:page:{_page(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of RECORD from a record's bytes; the size and the digest of a response are those of the bytes read."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    size = int(fields["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {lines[0][:40]!r}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    page = lambda k: None if (x := re.fullmatch(r"<urn:page:(-?\d+|none)>", fields[k])[1]) == "none" else int(x)
    out = {"page_id": page("warc-record-id"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": None}
    if out["record_type"] == "revisit":
        said = re.search(rb"\r\nContent-Length: (\d+)", http)
        return out | {"refers_to": page("warc-refers-to"), "payload": None, "payload_bytes": int(said[1]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:")}
    digest = hashlib.sha256(payload).hexdigest()
    if fields["warc-payload-digest"] != f"sha256:{digest}":
        raise ValueError(f"the digest of page {out['page_id']} differs")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def plan_revisits(pages: DataFrame, least: int = REVISIT_BYTES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """pages(page_id, url, html) with digest, size and refers_to: null for responses, else the page with the same payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    each = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    each = each.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = each.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = settle(firsts.select("digest", "first"), "firsts")
    few = firsts.count() <= broadcast_keys
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return each.join(F.broadcast(firsts) if few else firsts, "digest", "left").withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records and returns the INDEX, itself a table in the shared folder.

    Each task attempt writes archives with names of its own and returns their index rows, so a lost or repeated
    attempt leaves files that no index row names.
    """
    make_folder(folder)

    def run(batches):
        out, at, name = None, 0, ""
        store, root = open_store(folder)
        for batch in batches:
            rows = []
            for x in zip(*(batch.column(k) for k in range(6))):
                page_id, url, payload, digest, size, refers = (v.as_py() for v in x)
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc", 0
                    out = store.open_output_stream(f"{root}/{name}")
                record = record_bytes(page_id, url, payload if refers is None else None, size, digest, refers)
                out.write(record)
                rows.append((f"{folder}/{name}", at, len(record), url, digest, page_id, "response" if refers is None else "revisit"))
                at += len(record)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], [c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    bare = planned.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")
    return settle(bare.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, keep_payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """RECORD rows of the index rows given: their byte ranges, sorted, coalesced and read together."""

    def ranges(found):
        """Runs of (file, start, end, records) of nearby records of a file."""
        run = None
        for file, offset, length in found:
            if run and run[0] == file and 0 <= offset - run[2] <= READ_GAP and offset + length - run[1] <= read_bytes:
                run[2] = offset + length
                run[3].append((offset, length))
            else:
                if run:
                    yield run
                run = [file, offset, offset + length, [(offset, length)]]
        if run:
            yield run

    def run(batches):
        opened, source = None, None
        columns = [c.split() for c in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            found = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for file, start, end, records in ranges(found):
                if file != opened:
                    store, path = open_store(file)
                    opened, source = file, store.open_input_file(path)
                source.seek(start)
                piece = source.read(end - start)
                rows = [parse_record(piece[o - start : o - start + n]) for o, n in records]
                if not keep_payload:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in columns], [n for n, _ in columns])

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = index.select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / (2 * read_bytes)))
    return slices.sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def op5(spark, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; rows of one page_id with one payload are alike; a null page_id comes last."""
    index = write_archives(plan_revisits(table(spark, sf_dir, "pages")), fresh_path(spark, "warc"))
    back = read_archives(index, keep_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to FROM d
"""
