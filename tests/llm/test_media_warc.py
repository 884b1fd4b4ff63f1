import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from rasterflow.llm import media, warc
from rasterflow.llm.common import fresh_dir


def plain_lzw(stream, size, limit):
    """One code at a time, for comparison."""
    clear, out, bits, n, at = 1 << size, b"", 0, 0, 0
    width, known, last = size + 1, {}, None
    while True:
        while n < width:
            if at >= len(stream):
                return out[:limit]
            bits |= stream[at] << n
            n, at = n + 8, at + 1
        code, bits, n = bits & ((1 << width) - 1), bits >> width, n - width
        if code == clear:
            known, width, last = {i: bytes([i]) for i in range(clear)}, size + 1, None
            continue
        if code == clear + 1:
            return out[:limit]
        text = known.get(code) or last + last[:1]
        if last is not None and len(known) + 2 < 4096:
            known[len(known) + 2] = last + text[:1]
            if len(known) + 2 == 1 << width and width < 12:
                width += 1
        out, last = out + text, text


@pytest.mark.parametrize("n", [0, 1, 2, 64, 5000, 60000])
def test_lzw_round_trip(n):
    random.seed(n)
    for data in (bytes(random.randrange(256) for _ in range(n)), b"a" * n, (b"abcab" * n)[:n]):
        stream = media.lzw_encode(data)
        assert plain_lzw(stream, 8, n) == data == media.lzw_decode(stream, 8, n).tobytes()


def gif(frames, wide, tall, colours):
    """A GIF with 2-bit samples from (left, top, w, h, samples, disposal, transparent, interlaced)."""
    out = [b"GIF89a", wide.to_bytes(2, "little"), tall.to_bytes(2, "little"), b"\x81\x00\x00", bytes(c for x in colours for c in x)]
    for left, top, w, h, samples, disposal, clear, inter in frames:
        codes = [4]
        for k in range(0, len(samples), 2):  # a clear code after every two samples keeps codes at three bits
            codes += [*samples[k : k + 2], 4]
        codes.append(5)
        value = sum(c << (3 * k) for k, c in enumerate(codes))
        stream = value.to_bytes((3 * len(codes) + 7) // 8, "little")
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (clear is not None)]), b"\x05\x00", bytes([clear or 0]), b"\x00\x2c", *[v.to_bytes(2, "little") for v in (left, top, w, h)], bytes([0x40 if inter else 0]), b"\x02", bytes([len(stream)]), stream, b"\x00"]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_interlace():
    colours = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    red, green, blue = 0xFF0000, 0x00FF00, 0x0000FF
    data = gif([(0, 0, 2, 1, [1, 1], 1, None, False), (0, 0, 2, 1, [2, 3], 2, 3, False), (1, 0, 1, 1, [3], 3, None, False), (0, 0, 1, 1, [1], 1, None, False)], 2, 1, colours)
    shown = [canvas.copy().reshape(-1).tolist() for _, _, canvas in media.decode_gif(data)]
    assert shown == [[red, red], [green, red], [0, blue], [red, 0]]
    rows = [0, 1, 2, 3, 1, 2, 3, 0]
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    data = gif([(0, 0, 1, 8, [rows[i] for i in order], 0, None, True)], 1, 8, colours)
    assert [s.tolist() for _, s, _ in media.decode_gif(data)] == [rows]


def test_media_of_odd_documents(odd_docs, odd_rows):
    found = media.payload_digests(media.store_texts(odd_docs)).collect()
    want = []
    for i, t, _ in odd_rows:
        raw = (t or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    same = {}
    for r in found:
        same.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())


def test_frames_and_faults(spark):
    good = media.encode_gif(bytes(range(256)) * 16, rows=32)
    rows = [(1, good), (2, None), (3, b"no gif"), (4, good[:900])]
    found = media.frames(spark.createDataFrame(rows, "doc_id long, media binary")).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.error is None) for r in found] == [(1, 0, True), (1, 1, True), (3, 0, False), (4, 0, False)]
    assert sum(found[0].histogram) == 64 * 32 and found[0].delay_ms == 100


PAGES = "page_id long, url string, html string, digest string, number int"


def test_declared_sizes_are_bounded(spark):
    head = lambda w, h: b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\x00\x00\x00"
    wide = head(8, 8) + b"\x2c\x00\x00\x00\x00\xff\xff\xff\xff\x00\x08\x00"
    df = spark.createDataFrame([(1, head(65535, 65535) + b"\x3b"), (2, wide)], "doc_id long, media binary")
    assert sorted((r.id, r.frame, r.error.split()[1]) for r in media.frames(df).collect()) == [(1, 0, "canvas"), (2, 0, "frame")]


def test_long_codes_end_at_the_limit():
    # a sample, then each code the string just made: 4,096 codes stand for some eight million samples
    run = media.lzw_encode(bytes(8_000_000))
    assert len(run) < 7000
    for limit in (0, 1, 2, 100, 70_000):
        tracemalloc.start()
        got = media.lzw_decode(run, 8, limit)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert bytes(got) == bytes(limit) and peak < 8_000_000
    texts = "".join(random.choice("abc") for _ in range(50_000)).encode()
    packed = media.lzw_encode(texts)
    for limit in (0, 1, 999, 49_999, 50_000, 60_000):
        assert bytes(media.lzw_decode(packed, 8, limit)) == texts[:limit]


def test_archives(spark):
    long = "<p>" + "long page é " * 9000
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nx", long), (6, "u", long), (7, "u", "alone"), (8, "u", "alone"), (8, "u", "alone"), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    paths = warc.write_archives(pages, fresh_dir(spark, "w"), segment_bytes=20_000, file_bytes=30_000)
    records = warc.read_records(paths)
    assert records.where("record_type = 'continuation'").count() >= 4
    assert records.where("origin is not null").groupBy("origin").agg({"file": "count"}).where("`count(file)` > 1").count() == 1
    found = warc.payloads(warc.reassemble(records)).collect()
    assert all(r.valid for r in found)
    top = {"same": 2, "": 4, long: 6, "alone": 8}
    want = []
    for i, _, h in rows:
        h = h or ""
        other = i is not None and i < top[h]
        want.append((i, "revisit" if other else "response", top[h] if other else None, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found), key=str) == sorted(want, key=str)
    small = warc.write_archives(pages, fresh_dir(spark, "w"), min_bytes=5)
    kinds = {r.page_id: r.record_type for r in warc.payloads(warc.reassemble(warc.read_records(small))).collect()}
    assert kinds[1] == "response" and kinds[5] == "revisit"


def test_lost_segment_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 50_000, None, None)], PAGES)
    records = warc.read_records(warc.write_archives(pages, fresh_dir(spark, "w"), segment_bytes=20_000))
    (r,) = warc.payloads(warc.reassemble(records.where("number <> 2"))).collect()
    assert not r.valid and r.payload is None
    none = spark.createDataFrame([], PAGES)
    assert warc.payloads(warc.reassemble(warc.read_records(warc.write_archives(none, fresh_dir(spark, "w"))))).count() == 0


def test_chunked_framing():
    for n in (0, 1, 16384, 40000):
        data = np.random.default_rng(n).bytes(n)
        assert warc.dechunk(warc.chunked(data)) == data
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
