"""WARC archives: writing with deduplication and segmentation, reading with reassembly.

The writer makes one gzip member per record. A response's block is an HTTP message in chunked transfer framing;
blocks above ``segment_bytes`` are split into a first record and continuation records
(WARC-Segment-Origin-ID, WARC-Segment-Number, and WARC-Segment-Total-Length on the last), and files roll over at
``file_bytes``, so continuations may lie in another file. A payload that another record
holds becomes a revisit record that names it.

The reader yields a row per record as it stands in the files; ``reassemble`` groups segments by origin,
orders them by number, verifies the total length (and that no number is missing) and decodes the framing.

Null html is an empty payload; null or repeated page_ids keep a row each (a null id's page is always a
response); of repeated largest ids all are responses; empty tables give empty archives; very long payloads are cut in segments and joined again whole; further columns are ignored. A damaged or incomplete
record comes back with valid = false and null payload columns rather than failing the job.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, table, tidy

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "file string, record_id string, page_id string, record_type string, origin string, number int, total long, refers_to string, digest string, block binary"


def chunked(payload: bytes, size: int = 16384) -> bytes:
    """Payload in chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of chunked transfer framing; ValueError if it is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + n])
        at += n + 2


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_records(page_id, row: int, url: str | None, payload: bytes, refers_to, refers_uri: str | None, segment_bytes: int) -> list[bytes]:
    """The records of one page. row tells repeated page_ids apart; a revisit names its response by target URI and date, and by page."""
    name = lambda what, n=0: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{what}/{n}')}>"
    uri = lambda x: (x or "").replace("\r", "").replace("\n", "")
    target = ("WARC-Target-URI", uri(url))
    fields = [("WARC-Record-ID", name(f"{page_id}/{row}")), target, ("WARC-Payload-Digest", "sha1:" + digest32(payload)), ("X-Page-ID", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        return [_record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", uri(refers_uri)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))], head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record("response", fields, block)]
    cuts = range(0, len(block), segment_bytes)
    out = [_record("response", [*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for n, k in enumerate(cuts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(cuts) else []
        out.append(_record("continuation", [("WARC-Record-ID", name(f"{page_id}/{row}", n)), target, ("WARC-Segment-Origin-ID", fields[0][1]), ("WARC-Segment-Number", str(n)), *last], block[k : k + segment_bytes]))
    return out


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, segment_bytes: int = 32768, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes the archives; returns their paths. Of equal payloads of min_bytes or more, the one with the largest page_id is stored."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("key", F.sha1("payload"))
    narrow = own.select("page_id", "url", "key", F.octet_length("payload").alias("n"))
    kept = narrow.where(F.col("n") >= min_bytes).groupBy("key", "n").agg(F.max("page_id").alias("refers_to"), F.max_by("url", F.struct("page_id", "url")).alias("refers_uri"), F.count("*").alias("copies")).where("copies > 1")
    # a digest may be hot, but rows are narrow and either side of the join can be split
    revisits = narrow.join(kept, ["key", "n"]).where("page_id < refers_to").select("page_id", "key", "refers_to", "refers_uri").distinct()
    rows = own.join(revisits, ["page_id", "key"], "left").select("page_id", "url", "payload", "refers_to", "refers_uri")

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, size, files, row = None, 0, [], 0
        for batch in batches:
            for page_id, url, payload, refers_to, refers_uri in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row += 1
                for record in page_records(page_id, (context.partitionId() << 40) + row, url, payload, refers_to, refers_uri, segment_bytes):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(files):04d}.warc.gz")
                        # the members are packed already: no second compression by file name
                        out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    out.write(record)
                    size += len(record)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{f}" for f in files], pa.string())], ["path"])

    paths = [r.path for r in rows.mapInArrow(tidy(write), "path string").collect()]
    return pages.sparkSession.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))


def _members(stream, step: int = 1 << 20):
    """The unpacked gzip members of a file, one at a time."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(step)
        rest = b""
        if not data:
            if parts:
                yield b"".join(parts)  # cut short
            return
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields.get("content-length", "0"))]


def read_records(paths: DataFrame) -> DataFrame:
    """A row per record of the archives, segments as they stand; a record that can't be read gives its file alone."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = filesystem(path)
                rows, size = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    try:
                        for raw in _members(stream):
                            f, block = parse_record(raw)
                            whole = len(block) == int(f.get("content-length", "-1"))
                            number = int(f["warc-segment-number"]) if "warc-segment-number" in f else 0
                            rows.append((path, f.get("warc-record-id"), f.get("x-page-id") or None, f.get("warc-type") if whole else None, f.get("warc-segment-origin-id", f.get("warc-record-id")), number, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("x-refers-to-page-id"), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, block))
                            size += len(block)
                            if size > 4 << 20:
                                yield _rows(rows)
                                rows, size = [], 0
                    except (ValueError, zlib.error):
                        rows.append((path, *[None] * 9))
                yield _rows(rows)

    return paths.mapInArrow(tidy(read), RECORD)


def _rows(rows):
    kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records, as the blocks of their segments in order: those of one segment as they are, others once numbers and total length hold."""
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    joined = (
        records.where("number > 0").groupBy("origin")
        .agg(*[first(c) for c in ("file", "record_id", "page_id", "record_type", "refers_to", "digest")], F.max("total").alias("total"), F.max("number").alias("last"), F.sort_array(F.collect_set(F.struct("number", "block"))).alias("parts"))
        .withColumn("size", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p.block)))
        .withColumn("complete", F.coalesce((F.size("parts") == F.col("last")) & (F.col("size") == F.col("total")), F.lit(False)))
        .withColumn("blocks", F.transform("parts", lambda p: p.block))
    )
    names = ["file", "record_id", "page_id", "record_type", "refers_to", "digest", "complete", "blocks"]
    return records.where("number = 0 or number is null").withColumn("complete", F.col("record_type").isNotNull()).withColumn("blocks", F.array("block")).select(names).unionByName(joined.select(names))


def payloads(whole: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload (null for revisits), its size and digest; valid: framing and digest hold."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload, n, digest, valid = None, None, r["digest"], bool(r["complete"])
                if valid:
                    head, _, body = b"".join(r["blocks"]).partition(b"\r\n\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    try:
                        if r["record_type"] == "response":
                            payload = dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                            n, valid = len(payload), digest is None or digest32(payload) == digest
                            digest = digest32(payload)
                        elif b"content-length" in fields:
                            n = int(fields[b"content-length"])
                    except ValueError:
                        valid = False
                rows.append((r["page_id"] and int(r["page_id"]), r["record_type"], r["refers_to"] and int(r["refers_to"]), payload, n, digest, valid))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "valid"])

    return whole.select("page_id", "record_type", "refers_to", "digest", "complete", "blocks").mapInArrow(tidy(run), "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, valid boolean")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    found = payloads(reassemble(read_records(paths)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
