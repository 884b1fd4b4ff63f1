"""GIF media columns: lossless storage of 8-bit samples, decoding, timed frames and colour histograms.

The writer lays samples out as frames of a fixed width over a 256-colour palette and packs them as LZW code
streams. The reader takes any GIF87a/89a: LZW code streams with clear codes and deferred clears,
interlacing, local palettes, transparency and the disposal methods. The reader's inner
loops are numpy steps over a whole code segment (what lies between two clear codes): code widths follow
from the codes' positions, lengths and bytes of the codes' strings from pointer doubling.

Null samples are stored as an empty payload (padded to one row); null media give no frames and null features;
a stream that is not a GIF, or is cut short, gives the frames before the fault and the fault as text. So does one whose canvas or
frame is declared larger than MOST_PIXELS: nothing is allocated before sizes are known to be bounded, and codes are
expanded no further than the frame they fill. Null and repeated ids keep a row each, an empty table gives none, further
columns are ignored. Very long texts are stored whole, as more frames of the same size.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Samples in a row of a stored frame, rows in a frame at most, and hundredths of a second a frame is shown.
WIDTH, ROWS, DELAY = 64, 2048, 10
MOST_CODES = 4096
#: Pixels of a canvas or frame that the reader takes on (256 MB as 24-bit colours).
MOST_PIXELS = 1 << 26


def palette() -> np.ndarray:
    """256 colours: the sample's top 3 bits are red, the next 3 green, the last 2 blue."""
    v = np.arange(256)
    return np.stack([(v >> 5) * 255 // 7, (v >> 2 & 7) * 255 // 7, (v & 3) * 85], 1).astype(np.uint8)


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the codes 0 .. n - 1 after a clear code; size: bits of a sample."""
    j = np.arange(n)
    entries = (1 << size) + 1 + np.maximum(j, 1)
    return np.clip(np.ceil(np.log2(entries + 1)), size + 1, 12).astype(np.int64)


_BITS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _layout(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(widths, bit positions) of n codes after a clear code."""
    if (size, n) not in _BITS:
        w = _widths(size, n)
        _BITS[size, n] = (w, np.cumsum(w) - w)
    return _BITS[size, n]


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples; the dictionary is cleared when full."""
    clear, end, full = 256, 257, 4096
    codes, cuts = [clear], []
    put = codes.append
    if samples:
        known: dict[int, int] = {}
        add, new, w = known.setdefault, 258, samples[0]
        for b in samples[1:]:
            c = add(w << 8 | b, new)
            if c != new:
                w = c
                continue
            put(w)
            w = b
            if new == full:  # this entry is one too many
                put(clear)
                cuts.append(len(codes) - 1)
                known.clear()
                new = 257
            new += 1
        put(w)
    put(end)
    # each code's width follows from its distance to the clear code before it
    every = np.array(codes, np.int64)
    width = np.empty(len(every), np.int64)
    width[0] = 9
    for a, b in zip([0, *cuts], [*cuts, len(every) - 1], strict=True):
        width[a + 1 : b + 1] = _layout(8, MOST_CODES)[0][: b - a]
    at = np.cumsum(width) - width
    out = np.zeros((int(at[-1] + width[-1]) >> 3) + 4, np.int64)
    shifted = every << (at & 7)
    byte = at >> 3
    for k in range(3):
        out += np.bincount(byte + k, shifted >> (8 * k) & 255, len(out)).astype(np.int64)
    return out[: (int(at[-1] + width[-1]) + 7) >> 3].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int, limit: int) -> np.ndarray:
    """The samples of a code stream, at most limit of them."""
    clear, end = 1 << size, (1 << size) + 1
    room = np.frombuffer(stream + bytes(8), np.uint8)
    four = np.ndarray((len(room) - 3,), "<u4", room.data, 0, (1,))
    bits, at, out, total = 8 * len(stream), 0, [], 0
    while at < bits and total < limit:
        n = MOST_CODES
        while True:
            width, place = _layout(size, n)
            fit = int(np.searchsorted(place + width, bits - at, "right"))
            p = at + place[:fit]
            codes = (four[p >> 3] >> (p & 7).astype(np.uint32)).astype(np.int64) & ((1 << width[:fit]) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or fit < n:
                break
            n *= 2  # the dictionary is full and stays: codes go on at 12 bits
        k = int(stop[0]) if len(stop) else fit
        if k:
            part = _expand(codes[:k], clear, limit - total)
            out.append(part)
            total += len(part)
        if not len(stop) or codes[k] == end:
            break
        at += int(place[k] + width[k])
    samples = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return samples[:limit]


def _expand(codes: np.ndarray, clear: int, limit: int) -> np.ndarray:
    """The samples of the codes of one segment, up to the code that reaches limit. Code clear + 2 + i is the string of code i and the sample after it."""
    refers = codes > clear + 1
    before = np.where(refers, codes - (clear + 2), np.arange(len(codes)))
    if (before > np.arange(len(codes))).any() or (refers & (before >= np.arange(len(codes)))).any():
        raise ValueError("a code stands before its entry")
    length = np.ones(len(codes), np.int64) * refers  # steps to the single sample that a string begins with
    jump = before.copy()
    while True:
        further = length[jump]
        if not further.any():
            break
        length += further
        jump = jump[jump]
    length += 1
    ends = np.cumsum(length)
    used = int(np.searchsorted(ends, limit)) + 1
    codes, refers, length, ends = codes[:used], refers[:used], length[:used], ends[:used]
    start, before = ends - length, before[:used]
    source = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(start - start[before], length)
    while True:
        nearer = source[source]
        if np.array_equal(nearer, source):
            break
        source = nearer
    single = np.zeros(int(ends[-1]), np.uint8)
    single[start[~refers]] = codes[~refers]
    return single[source]


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF89a whose frames hold payload row by row; payload: a positive multiple of width bytes."""
    lines = len(payload) // width
    tall = min(lines, rows)
    out = [b"GIF89a", width.to_bytes(2, "little"), tall.to_bytes(2, "little"), b"\xf7\x00\x00", palette().tobytes()]
    for a in range(0, lines, rows):
        part = payload[a * width : (a + rows) * width]
        stream = lzw_encode(part)
        out += [b"\x21\xf9\x04\x04", delay.to_bytes(2, "little"), b"\x00\x00", b"\x2c\x00\x00\x00\x00", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\x00\x08"]
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes):
    """Yields (delay in ms, samples of the frame row by row, canvas as 24-bit colours) for each frame, in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    word = lambda k: data[k] | data[k + 1] << 8
    wide, tall, flags, ground = word(6), word(8), data[10], data[11]
    at = 13

    def colours(bits: int) -> np.ndarray:
        raw = np.zeros(768, np.uint8)
        raw[: 3 << (bits + 1)] = np.frombuffer(data[at : at + (3 << (bits + 1))], np.uint8)
        rgb = raw.reshape(-1, 3).astype(np.uint32)
        return rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]

    shared = None
    if flags & 0x80:
        shared = colours(flags & 7)
        at += 3 << ((flags & 7) + 1)
    back = int(shared[ground]) if shared is not None else 0
    if wide * tall > MOST_PIXELS:
        raise ValueError(f"a canvas of {wide} x {tall} pixels is larger than the reader takes")
    canvas = np.full((tall, wide), back, np.uint32)
    delay, disposal, clear_index = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8)
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = word(at), word(at + 2), word(at + 4), word(at + 6), data[at + 8]
        at += 9
        own = shared
        if flags & 0x80:
            own = colours(flags & 7)
            at += 3 << ((flags & 7) + 1)
        size = data[at]
        stream, at = _blocks(data, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError(f"a frame of {w} x {h} pixels is larger than the reader takes")
        samples = lzw_decode(stream, size, w * h)
        if len(samples) < w * h:
            raise ValueError("a frame is cut short")
        picture = samples.reshape(h, w)
        if flags & 0x40:  # four passes over the rows
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(picture)
            straight[order] = picture
            picture = straight
        kept = canvas.copy() if disposal == 3 else None
        y, x = max(0, min(h, tall - top)), max(0, min(w, wide - left))
        area = canvas[top : top + y, left : left + x]
        painted = own[picture[:y, :x]] if own is not None else picture[:y, :x].astype(np.uint32) * 0x10101
        if clear_index is None:
            area[...] = painted
        else:
            np.copyto(area, painted, where=picture[:y, :x] != clear_index)
        yield delay, picture.reshape(-1), canvas
        if disposal == 2:
            area[...] = back
        elif disposal == 3:
            canvas = kept
        delay, disposal, clear_index = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour: 4 levels of red, green and blue each, 64 bins."""
    c = canvas.reshape(-1)
    return np.bincount((c >> 18 & 0x30) | (c >> 12 & 0x0C) | (c >> 6 & 0x03), minlength=64)


def _payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a GIF) of each document's text."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(ids), 256):
                part = [_payload(t) for t in texts.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 256), pa.array([p[0] for p in part], pa.int64()), pa.array([encode_gif(p[1]) for p in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """A row per frame: id, frame, delay_ms, pixels (24-bit canvas, 4 bytes each) and histogram; a fault gives a last row with error."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                rows, k = [], -1
                try:
                    for k, (delay, _, canvas) in enumerate(decode_gif(data)):
                        rows.append((name, k, delay, canvas.shape[1], canvas.shape[0], canvas.astype("<u4").tobytes(), histogram(canvas).tolist(), None))
                        if len(rows) == 16:
                            yield _frame_rows(rows)
                            rows = []
                except (ValueError, IndexError) as e:
                    rows.append((name, k + 1, None, None, None, None, None, str(e) or "cut short"))
                if rows:
                    yield _frame_rows(rows)

    return media.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{media_column}`").alias("media")).mapInArrow(tidy(run), "id long, frame int, delay_ms int, width int, height int, pixels binary, histogram array<long>, error string")


def _frame_rows(rows):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "frame", "delay_ms", "width", "height", "pixels", "histogram", "error"])


def payload_digests(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: digests of the samples, of the media, and a feature text."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                samples, colours, shown, count = [], np.zeros(64, np.int64), 0, 0
                for delay, picture, canvas in decode_gif(data):
                    samples.append(picture.tobytes())
                    colours += histogram(canvas)
                    shown, count = shown + delay, count + 1
                payload = b"".join(samples)
                feature = f"frames={count};ms={shown};colours=" + ",".join(f"{i}:{colours[i]}" for i in np.flatnonzero(colours).tolist())
                rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_digests(store_texts(table(spark, sf_dir, "documents")))
