"""Exact substring deduplication across documents by a distributed difference-cover suffix sort.

Every ``length``-byte window (50 bytes) that also starts in a document with a smaller doc_id is removed. A suffix sort
of all bytes would shuffle many times the input, so three passes narrow the text first, without loss:

1. Anchors. A window's anchor is the least hash among its ``gram``-byte strings, so equal windows have equal
   anchors. Consecutive windows with one anchor form a run; about 6 % as many runs as bytes are dealt by anchor. Each task
   first combines what it holds: a run whose whole text a smaller document of the task has is settled there,
   and an anchor with very many different runs in one task (a hot one) is sent once, so hot passages don't gather in one task.
2. By anchor, runs whose whole text a smaller document has are settled. What is left are anchors with several
   different runs: the edges of shared passages. Their contexts, a few hundredths of the text, are dealt by anchor again;
   those of a hot anchor, in one task or over all, window by window and by the window's hash, so that they spread over all tasks.
3. Difference cover. Each task sorts the suffixes of its contexts: it sorts and names the sampled triples (positions 1 and 2
   modulo 3), recurses on the string of names until names are unique or span the window, merges the remaining
   suffixes with the sampled ones, and compares the adjacent ones' prefixes byte by byte: equal windows are
   neighbours, and the least doc_id among them keeps its copy. A hot anchor's windows are grouped by their 64-bit hashes,
   within equal anchors, after each task has settled those that a smaller document of its own has.

The passes scan the documents in the same partitions; what a pass finds for a partition is a table in the shared
folder, read by that partition's task in the next pass, which also checks that it sees the same documents. So texts are
never shuffled. Input that isn't a plain file scan is checkpointed first.

Runs and hot anchors' windows are compared, within equal anchors, by polynomial hashes modulo the prime 2 ** 61 - 1 whose
base the driver draws for each job: two different texts of n bytes meet with a chance of n / 2 ** 61, whatever they are.

Null text is empty; documents under 50 bytes lose nothing; a null doc_id counts as the largest number there is; rows with
the same doc_id count as one document; an empty table gives no row; very long texts are looked at whole, as a
block of their own; further columns are ignored by ``removed_spans`` and returned unchanged by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, blocks, byte_blocks, draw_base, fresh_dir, mix64, ragged, table, tidy
from .partitions import fixed_scan, side, write_side

LENGTH, GRAM = 50, 20
#: Runs that a task combines at a time, and different runs of one anchor, in a task or over all, beyond which the anchor is hot.
HELD, HOT = 800_000, 128
#: Bytes of text that a pass looks at at a time, and of contexts that are sorted together.
BLOCK, SORTED, PARTS = 1 << 20, 1 << 20, 4096
#: Stands for a null doc_id, which counts as large as any.
NULL_ID = (1 << 63) - 1
SETTLED, OPEN, SEEN, LOOSE = 0, 1, 2, 4
SIDE = "pid int, kind int, blob binary"


def pack(**arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed blob, byte planes together."""
    out = []
    for name, v in arrays.items():
        v = np.ascontiguousarray(v)
        planes = v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T
        body = planes.tobytes() if name in ("anchor", "run") else zlib.compress(planes.tobytes(), 1)
        out.append(np.array([len(v), v.dtype.itemsize, len(body)], "<i8").tobytes() + body)
    return b"".join(out)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, width, size = np.frombuffer(blob, "<i8", 3, at).tolist()
        body = blob[at + 24 : at + 24 + size]
        raw = body if size == n * width and kind[0] == "!" else zlib.decompress(body)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind.lstrip("!"))[:, 0] if n else np.zeros(0, kind.lstrip("!")))
        at += 24 + size
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place on: eight bytes at a time, the last eight as they end."""
    n = len(data) - gram + 1
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", room.data, 0, (1,))
    out = np.zeros(n, np.uint64)
    for k in [*range(0, gram - 7, 8), gram - 8]:
        out ^= eight[k : k + n]
        out = mix64(out)
    return out


def runs(data: np.ndarray, at: np.ndarray, base: int, length: int = LENGTH, gram: int = GRAM):
    """(text, first window's byte within it, windows, anchor hash, hash of the run's text) for the runs of a block of texts."""
    n, wide = len(data), length - gram + 1
    if n < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    least = gram_hashes(data, gram)
    w = 1
    while 2 * w <= wide:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < wide:
        least = np.minimum(least[: len(least) - (wide - w)], least[wide - w :])
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    inside = text[: len(least)] == text[length - 1 :]
    head = np.ones(len(least), bool)
    head[1:] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(least))
    keep = inside[start]
    start, end = start[keep], end[keep]
    own = text[start].astype(np.int64)
    whole = mix64(RangeHash(data, base).of(start, end + length - 1) + (end - start).astype(np.uint64))
    return own, start - at[own], end - start, least[start], whole


def suffix_order(text: np.ndarray, span: int) -> np.ndarray:
    """Suffixes of text (positive integers) in order; suffixes that agree for span symbols may stand in any order."""
    return _difference_cover(text.astype(np.int64), span)


def _rank(values: np.ndarray) -> tuple[np.ndarray, int]:
    names, back = np.unique(values, return_inverse=True)
    return back.astype(np.int64) + 1, len(names)


def _difference_cover(t: np.ndarray, span: int) -> np.ndarray:
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate([t, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a last dummy triple keeps the two halves apart
    sample = np.concatenate([one, two])
    top = int(t.max()) + 1
    if top < 1 << 20:
        triple = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
    else:
        pair, _ = _rank(s[sample] * top + s[sample + 1]) if top < 1 << 31 else (None, 0)
        triple = pair * top + s[sample + 2]
    name, different = _rank(triple)
    if different < len(sample) and span > 3:
        order = _difference_cover(name, -(-span // 3))
        rank_of = np.empty(len(sample), np.int64)
        rank_of[order] = np.arange(1, len(sample) + 1)
        # suffixes that agree throughout the span may get any order among themselves
        name = rank_of
    else:
        order = np.argsort(name, kind="stable")
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    order = order[sample[order] < n]
    sorted_sample = sample[order]
    zero = np.arange(0, n, 3)
    big = int(rank.max()) + 1
    zero = zero[np.argsort(s[zero] * big + rank[zero + 1], kind="stable")]
    # merge: the place of a remaining suffix is how many sampled ones stand before it
    in_one = sorted_sample % 3 == 1
    first, second = sorted_sample[in_one], sorted_sample[~in_one]
    before = np.searchsorted(s[first] * big + rank[first + 1], s[zero] * big + rank[zero + 1])
    pairs, _ = _rank(np.concatenate([s[second] * top + s[second + 1], s[zero] * top + s[np.minimum(zero + 1, n + 2)]])) if top < 1 << 31 else (None, 0)
    before = before + np.searchsorted(pairs[: len(second)] * big + rank[second + 2], pairs[len(second) :] * big + rank[zero + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + np.maximum.accumulate(before) if len(zero) else np.zeros(0, np.int64)
    out[place] = zero
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sorted_sample
    return out


def repeated_windows(contexts: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Byte places in contexts (concatenated, offsets at, a doc each) of windows that a smaller doc also has."""
    n = len(contexts)
    sizes = np.diff(at)
    own = np.repeat(np.arange(len(doc)), sizes)
    # a zero-like mark after each context, so that no window runs over its end unseen
    marked = np.insert(contexts.astype(np.int64) + 2, at[1:], 1)
    place = np.arange(n) + own
    order = suffix_order(marked, length)
    back = np.full(len(marked), -1, np.int64)
    back[place] = np.arange(n)
    order = back[order]
    order = order[order >= 0]
    order = order[order - at[own[order]] <= sizes[own[order]] - length]  # places with a whole window
    if not len(order):
        return order
    eight = np.ndarray((n,), "<u8", np.concatenate([contexts, np.zeros(8, np.uint8)]).data, 0, (1,))
    same = np.ones(len(order) - 1, bool)
    steps = [*range(0, length - 7, 8)]
    for k in [*steps, length - 8]:
        v = eight[order + k]
        same &= v[1:] == v[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc[own[order]], head)
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    return order[least[group] < doc[own[order]]]


def _batches(batches):
    """(first row within the partition, doc_ids, block bytes, offsets)."""
    row = 0
    for batch in batches:
        ids = batch.column(0).fill_null(NULL_ID).to_numpy()
        for a, b, data, at in byte_blocks(batch.column(1), BLOCK):
            yield row + a, ids[a:b], data, at
        row += len(ids)


def _mark(ids_seen: int, total: int) -> bytes:
    return np.array([ids_seen, total], "<u8").tobytes()


def _anchor_rows(batches, n_buckets: int, base: int):
    """Pass 1 of a task: what to send by anchor, and what it has settled itself."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    held: list = []
    count, seen, total = 0, np.uint64(0), 0

    def flush():
        row, start, n, anchor, whole, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, whole, anchor))
        row, start, n, anchor, whole, doc = (x[order] for x in (row, start, n, anchor, whole, doc))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], whole[1:] != whole[:-1]])
        group = np.cumsum(new) - 1
        least = doc[np.flatnonzero(new)][group]
        settled = doc > least
        if settled.any():
            yield pid % n_buckets, pid, SETTLED, _spans(row[settled], start[settled], n[settled])
        # an anchor with very many different runs here: the windows of each are dealt one by one, one run stands for all
        which = np.cumsum(new_anchor) - 1
        many = np.bincount(which[new])[which] > HOT
        still = many & ~settled
        if still.any():
            yield pid % n_buckets, pid, LOOSE, pack(row=row[still].astype(np.int32), start=start[still].astype(np.int32), n=n[still].astype(np.int32), anchor=anchor[still])
        send = ~settled & (~many | new_anchor | np.concatenate([[False], new_anchor[:-1]]))
        row, start, n, anchor, whole, doc = (x[send] for x in (row, start, n, anchor, whole, doc))
        flag = many[send]
        bucket = (anchor % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((start, row, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            o = order[cuts[b] : cuts[b + 1]]
            if len(o):
                rows, first = np.unique(row[o], return_index=True)
                yield b, pid, SEEN, pack(anchor=anchor[o], run=whole[o], row=row[o].astype(np.int32), start=start[o].astype(np.int32), n=n[o].astype(np.int32), flag=flag[o].astype(np.uint8), rows=rows.astype(np.int32), docs=np.diff(doc[o][first], prepend=0))
        held.clear()

    for first, ids, data, at in _batches(batches):
        own, start, n, anchor, whole = runs(data, at, base)
        held.append(((own + first).astype(np.int32), start.astype(np.int32), n.astype(np.int32), anchor, whole, ids[own]))
        count += len(own)
        seen ^= np.bitwise_xor.reduce(mix64(ids.astype(np.uint64))) if len(ids) else np.uint64(0)
        total += len(ids)
        if count >= HELD:
            yield from flush()
            count = 0
    if count:
        yield from flush()
    yield pid % n_buckets, pid, 3, _mark(int(seen), total)


def _spans(row, start, n) -> bytes:
    """Runs as spans of windows per row, joined where they touch."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + n)[order]
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(head)
    return pack(row=row[at].astype(np.int32), start=start[at].astype(np.int32), end=np.maximum.reduceat(end, at).astype(np.int32))


def _rows(items, names, kinds):
    """Record batches of tuples, small ones together."""
    part, size = [], 0
    for x in items:
        part.append(x)
        size += len(x[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)


_NAMES, _KINDS = ["bucket", "pid", "kind", "blob"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _by_anchor(batches):
    """Pass 2: settles runs that a smaller document has whole; leaves open those whose anchor has different runs."""
    parts = []
    for batch in batches:
        for _, pid, kind, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind != SEEN:
                yield pid, kind, blob
                continue
            anchor, run, row, start, n, flag, rows, docs = unpack(blob, "!<u8", "!<u8", "<i4", "<i4", "<i4", "u1", "<i4", "<i8")
            parts.append((anchor, run, row, start, n, flag, np.cumsum(docs)[np.searchsorted(rows, row)], np.full(len(row), pid, np.int32)))
    if not parts:
        return
    anchor, run, row, start, n, flag, doc, pid = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((run, anchor))
    anchor, run, row, start, n, flag, doc, pid = (x[order] for x in (anchor, run, row, start, n, flag, doc, pid))
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new = new_anchor | np.concatenate([[True], run[1:] != run[:-1]])
    heads = np.flatnonzero(new)
    settled = np.minimum.reduceat(doc, heads)[np.cumsum(new) - 1] < doc
    which = np.cumsum(new_anchor) - 1
    # every task's runs of a hot anchor are dealt alike: a task that has many has sent a flag
    different = np.bincount(which[new])
    hot = (different > HOT) | (np.maximum.reduceat(flag, np.flatnonzero(new_anchor)) > 0)
    left, hot = ((different > 1) | hot)[which] & ~settled, hot[which]
    for p in np.unique(pid[settled | left]).tolist():
        s = settled & (pid == p)
        if s.any():
            yield p, SETTLED, _spans(row[s], start[s], n[s])
        for kind, own in ((OPEN, left & ~hot), (LOOSE, left & hot)):
            s = own & (pid == p)
            if s.any():
                yield p, kind, pack(row=row[s].astype(np.int32), start=start[s].astype(np.int32), n=n[s].astype(np.int32), anchor=anchor[s])


def _check(marks: list[bytes], seen, total) -> None:
    if marks and marks[0] != _mark(int(seen), total):
        raise RuntimeError("a partition's documents changed between scans")


def _contexts(batches, folder: str, n_buckets: int, base: int):
    """Texts of the open runs, dealt by anchor; windows of hot anchors' runs, dealt by their hashes."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    found: dict[int, list] = {OPEN: [], LOOSE: []}
    marks = []
    for kind, blob in side([folder], pid):
        if kind in found:
            found[kind].append(unpack(blob, "<i4", "<i4", "<i4", "!<u8"))
        elif kind == 3:
            marks.append(blob)

    def once(found):
        row, start, n, anchor = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        order = np.lexsort((start, row))
        row, start, n, anchor = row[order].astype(np.int64), start[order].astype(np.int64), n[order].astype(np.int64), anchor[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1])
        return row[new], start[new], n[new], anchor[new]

    row, start, n, anchor = once(found[OPEN])
    loose_row, loose_start, loose_n, loose_anchor = once(found[LOOSE])
    held, size = [], 0
    loose: list = []
    count = 0
    seen, total = np.uint64(0), 0

    def flush():
        hashed, row, start, doc, length, text = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
        part = (hashed // np.uint64(n_buckets) % np.uint64(PARTS)).astype(np.uint16)
        at = np.cumsum(length) - length
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            o = order[cuts[b] : cuts[b + 1]]
            if len(o):
                yield b, pid, OPEN, pack(part=part[o], row=row[o].astype(np.int32), start=start[o].astype(np.int32), doc=doc[o], n=length[o].astype(np.int32), text=text[ragged(at[o], length[o])])
        held.clear()

    def flush_loose():
        row, start, anchor, window, doc = (np.concatenate(x) for x in zip(*loose, strict=True))
        settled = _repeated(anchor, window, doc)
        if settled.any():
            yield pid % n_buckets, pid, SETTLED, _spans(row[settled], start[settled], np.ones(int(settled.sum()), np.int64))
        row, start, anchor, window, doc = (x[~settled] for x in (row, start, anchor, window, doc))
        bucket = (window % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((start, row, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            o = order[cuts[b] : cuts[b + 1]]
            if len(o):
                rows, first = np.unique(row[o], return_index=True)
                yield b, pid, LOOSE, pack(run=window[o], of=anchor[o], row=row[o], start=start[o], rows=rows, docs=np.diff(doc[o][first], prepend=0))
        loose.clear()

    for first, ids, data, at in _batches(batches):
        seen ^= np.bitwise_xor.reduce(mix64(ids.astype(np.uint64))) if len(ids) else np.uint64(0)
        total += len(ids)
        a, b = np.searchsorted(loose_row, [first, first + len(ids)])
        if a < b:
            rolled = RangeHash(data, base)
            # a few runs at a time, as each byte of them begins a window
            for c, d in blocks(loose_n[a:b], HELD):
                own = loose_row[a + c : a + d] - first
                of = np.repeat(np.arange(d - c), loose_n[a + c : a + d])
                place = ragged(at[own] + loose_start[a + c : a + d], loose_n[a + c : a + d])
                loose.append(((own[of] + first).astype(np.int32), (place - at[own][of]).astype(np.int32), loose_anchor[a + c : a + d][of], mix64(rolled.of(place, place + LENGTH)), ids[own][of]))
                count += len(place)
                if count >= HELD:
                    yield from flush_loose()
                    count = 0
        a, b = np.searchsorted(row, [first, first + len(ids)])
        if a < b:
            own = row[a:b] - first
            length = n[a:b] + LENGTH - 1
            held.append((anchor[a:b], row[a:b], start[a:b], ids[own], length, data[ragged(at[own] + start[a:b], length)]))
            size += int(length.sum())
            if size > 8 << 20:
                yield from flush()
                size = 0
    if held:
        yield from flush()
    if loose:
        yield from flush_loose()
    _check(marks, seen, total)


def _repeated(anchor, window, doc) -> np.ndarray:
    """Which windows (by anchor and hash) a smaller doc also has."""
    order = np.lexsort((window, anchor))
    a, w, d = anchor[order], window[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    out = np.zeros(len(a), bool)
    if len(a):
        out[order] = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1] < d
    return out


def _loose_windows(parts):
    """Settles the windows of hot anchors that a smaller document has."""
    row, start, anchor, window, doc, pid = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    settled = _repeated(anchor, window, doc)
    row, start, pid = row[settled], start[settled], pid[settled]
    order = np.argsort(pid, kind="stable")
    row, start, pid = row[order], start[order], pid[order]
    own, heads = np.unique(pid, return_index=True)
    for p, a, b in zip(own.tolist(), heads.tolist(), [*heads[1:].tolist(), len(pid)], strict=False):
        yield p, SETTLED, _spans(row[a:b], start[a:b], np.ones(b - a, np.int64))


def _by_suffix(batches):
    """Pass 3: sorts the contexts' suffixes and settles the windows that a smaller document has."""
    parts, loose = [], []
    for batch in batches:
        for _, pid, kind, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == SETTLED:
                yield pid, kind, blob
                continue
            if kind == LOOSE:
                window, anchor, row, start, rows, docs = unpack(blob, "!<u8", "<u8", "<i4", "<i4", "<i4", "<i8")
                loose.append((row, start, anchor, window, np.cumsum(docs)[np.searchsorted(rows, row)], np.full(len(row), pid, np.int32)))
                continue
            part, row, start, doc, n, text = unpack(blob, "<u2", "<i4", "<i4", "<i8", "<i4", "u1")
            parts.append((part, row, start, doc, n, np.full(len(row), pid, np.int32), text))
    if loose:
        yield from _loose_windows(loose)
    if not parts:
        return
    part, row, start, doc, n, pid, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    at = np.append(0, np.cumsum(n, dtype=np.int64))
    # contexts of one anchor are in one part; parts are sorted together up to a bounded size
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(PARTS), "right")
    sizes = np.diff(np.append(0, np.append(0, np.cumsum(n[order], dtype=np.int64))[ends]))
    ends = np.append(0, ends)
    for a, b in blocks(sizes, SORTED):
        o = order[ends[a] : ends[b]]
        if not len(o):
            continue
        own_at = np.append(0, np.cumsum(n[o], dtype=np.int64))
        places = np.sort(repeated_windows(text[ragged(at[o], n[o].astype(np.int64))], own_at, doc[o]))
        own = np.searchsorted(own_at, places, "right") - 1
        begin, own_pid = start[o][own] + places - own_at[own], pid[o][own]
        for p in np.unique(own_pid).tolist():
            s = own_pid == p
            yield p, SETTLED, _spans(row[o][own][s], begin[s], np.ones(int(s.sum()), np.int64))


def _settle(docs: DataFrame) -> list[str]:
    """Runs the passes; returns the folders with the spans of windows to remove, by scan partition."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "bucket int, pid int, kind int, blob binary"
    side_kinds = [pa.int32(), pa.int32(), pa.binary()]
    one, two = fresh_dir(spark, "repeats-1"), fresh_dir(spark, "repeats-2")
    base = draw_base()
    sent = docs.mapInArrow(tidy(lambda it: _rows(_anchor_rows(it, n, base), _NAMES, _KINDS)), kinds)
    write_side(sent.repartitionById(n, "bucket").mapInArrow(tidy(lambda it: _rows(_by_anchor(it), ["pid", "kind", "blob"], side_kinds)), SIDE), one)
    open_runs = docs.mapInArrow(tidy(lambda it: _rows(_contexts(it, one, n, base), _NAMES, _KINDS)), kinds)
    write_side(open_runs.repartitionById(n, "bucket").mapInArrow(tidy(lambda it: _rows(_by_suffix(it), ["pid", "kind", "blob"], side_kinds)), SIDE), two)
    return [one, two]


def _covered(batches, folders: list[str], length: int = LENGTH):
    """(doc_id, bytes, spans to remove as starts and ends) of each document of a task."""
    from pyspark import TaskContext

    found, marks = [], []
    for kind, blob in side(folders, TaskContext.get().partitionId()):
        if kind == SETTLED:
            found.append(unpack(blob, "<i4", "<i4", "<i4"))
        elif kind == 3:
            marks.append(blob)
    row, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    end = end + length - 1
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if len(row):
        # ends so far within a row, by adding more than any end for each further row
        far = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40)
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
        at = np.flatnonzero(head)
        row, start, end = row[at], start[at], np.maximum.reduceat(end, at)
    seen, total = np.uint64(0), 0
    for first, ids, data, at in _batches(batches):
        seen ^= np.bitwise_xor.reduce(mix64(ids.astype(np.uint64))) if len(ids) else np.uint64(0)
        total += len(ids)
        cuts = np.searchsorted(row, np.arange(first, first + len(ids) + 1))
        for k, name in enumerate(ids.tolist()):
            yield name, data[at[k] : at[k + 1]].tobytes(), start[cuts[k] : cuts[k + 1]].tolist(), end[cuts[k] : cuts[k + 1]].tolist()
    _check(marks, seen, total)


def _kept(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True)) if starts else data


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (from_byte, to_byte of each maximal removed run) and kept_sha256."""
    stable = fixed_scan(docs)
    folders = _settle(stable)
    span = pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())])

    def run(batches):
        part, known = [], []

        def noted():
            for batch in batches:
                known.extend(reversed(batch.column(0).to_pylist()))
                yield batch

        for _, data, starts, ends in _covered(noted(), folders):
            part.append((known.pop(), len(data), [{"from_byte": a, "to_byte": b} for a, b in zip(starts, ends, strict=True)], hashlib.sha256(_kept(data, starts, ends)).hexdigest()))
            if len(part) == 4096:
                yield rows(part)
                part = []
        if part:
            yield rows(part)

    def rows(part):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.list_(span), pa.string()), strict=True)], ["doc_id", "n_bytes", "spans", "kept_sha256"])

    return stable.mapInArrow(tidy(run), "doc_id long, n_bytes long, spans array<struct<from_byte:long,to_byte:long>>, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the repeated bytes cut out of text (and n_chars, if there, counted anew); what is left of a character cut in two goes too."""
    stable = fixed_scan(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    folders = _settle(stable.select("doc_id", "text"))

    def run(batches):
        left = []

        def noted():
            for batch in batches:
                left.append(batch.column(2))
                yield batch

        done: list[str] = []
        for _, data, starts, ends in _covered(noted(), folders):
            done.append(_kept(data, starts, ends).decode("utf-8", "ignore"))
            if len(done) == len(left[0]):
                yield pa.RecordBatch.from_arrays([left.pop(0), pa.array(done, pa.string())], ["row", "kept"])
                done = []

    kind = stable.schema["row"].dataType.simpleString()
    found = stable.mapInArrow(tidy(run), f"row {kind}, kept string")
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.length(F.when(F.col("row.text").isNotNull(), F.col("kept")))}
    return found.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_spans(table(spark, sf_dir, "documents"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.to_byte - x.from_byte)
    return found.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
