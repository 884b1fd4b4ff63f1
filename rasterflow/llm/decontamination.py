"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become streams of lower-cased words with one blank before each word and after the last. A
pattern is a window of consecutive item words in the same form, so a byte match is a match of whole words.
Patterns are grouped by length; a group's shortest length m bounds its window. The shift table, indexed by a hash
of the block of bytes that ends the window, tells how far the window can move without missing a pattern;
where it says zero, the block's hash selects the bucket of patterns whose first m bytes end in that
block, and these are compared byte by byte. Many places of a block of documents are advanced at once with
numpy: each lane owns the windows that end in its stretch of the stream.

The item table is a query set: it is taken in parts of a proven size (``part_bytes``), each broadcast and
searched in all documents; one part is the usual case. With more, each part's hits go to a table in the shared folder before
the next is read, so the driver holds one part at a time, and are combined by a shuffle of hits alone.

Null or word-less texts have no words and no hits; null and repeated doc_ids keep a row each; windows of an item
with null item_id hit like others, but the list of items can't name it; items with equal windows are all named; an empty
documents or items table gives no rows or no hits; very long texts are searched whole; further columns of the
inputs are ignored, except that ``clean_documents`` returns the documents' columns unchanged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_blocks, checkpoint, fresh_dir, mix64, ragged, table, tidy

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _WORD[_low : _high + 1] = False
#: Lengths in bytes at which a group of patterns starts.
GROUPS = (24, 8, 1)
TABLE_BITS = 20
LANE = 2048
#: Bytes of item texts that are searched at a time; their windows take some ten times as much.
PART_BYTES = 8 << 20


def word_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, places of the words' first bytes, words before each text): texts are set apart by a zero byte."""
    n = len(data)
    data = _LOWER[data]
    word = _WORD[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < n]
    start[heads] = word[heads]
    step = word.astype(np.int8) + start
    first = np.unique(heads)
    step[first] += 2
    place = np.cumsum(step, dtype=np.int64)
    out = np.full((int(place[-1]) if n else 0) + 2, 32, np.uint8)
    out[place[word] - 1] = data[word]
    out[place[first] - step[first] + 1] = 0
    starts = place[start] - 1
    before = np.append(0, np.cumsum(start))[at]
    return out, starts, before


class Patterns:
    """Shift tables and buckets of byte patterns; ids: the position of each in what was given."""

    def __init__(self, patterns: list[bytes]):
        self.groups = []
        lengths = np.array([len(p) for p in patterns], np.int64)
        upper = 1 << 62
        for lower in GROUPS:
            own = np.flatnonzero((lengths >= lower) & (lengths < upper))
            upper = lower
            if len(own):
                self.groups.append(self._group([patterns[i] for i in own], own))

    @staticmethod
    def _slots(blocks: np.ndarray) -> np.ndarray:
        return (mix64(blocks) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _group(self, patterns: list[bytes], ids: np.ndarray) -> dict:
        m = min(map(len, patterns))
        b = min(8, m)
        mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        padded = np.zeros((len(patterns), m + 8), np.uint8)
        padded[:, :m] = heads
        shift = np.full(1 << TABLE_BITS, m - b + 1, np.uint8 if m < 250 else np.int64)
        for j in range(m - b + 1):
            block = np.ascontiguousarray(padded[:, j : j + 8]).view("<u8")[:, 0] & mask
            np.minimum.at(shift, self._slots(block), m - b - j)
        suffix = np.ascontiguousarray(padded[:, m - b : m - b + 8]).view("<u8")[:, 0] & mask
        slots = self._slots(suffix)
        order = np.argsort(slots, kind="stable")
        bucket = np.searchsorted(slots[order], np.arange((1 << TABLE_BITS) + 1))
        lengths = np.array([len(patterns[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(patterns[i] for i in order), np.uint8)
        return {"m": m, "b": b, "mask": mask, "shift": shift, "bucket": bucket, "ids": ids[order], "length": lengths, "start": np.cumsum(lengths) - lengths, "flat": flat, "suffix": suffix[order]}

    def search(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id) of every occurrence."""
        found = [self._search(g, stream) for g in self.groups]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _search(self, g: dict, stream: np.ndarray):
        m, b, n = g["m"], g["b"], len(stream)
        last = n - m  # a window starts here at most
        if last < 0:
            return [np.zeros(0, np.int64)] * 3
        room = np.concatenate([stream, np.zeros(8, np.uint8)])
        eight = np.ndarray((n,), "<u8", room.data, 0, (1,))
        at = np.arange(0, last + 1, LANE, dtype=np.int64)
        end = np.minimum(at + LANE, last + 1)
        maybe = []
        while len(at):
            slots = self._slots(eight[at + (m - b)] & g["mask"])
            move = g["shift"][slots].astype(np.int64)
            zero = move == 0
            if zero.any():
                maybe.append((at[zero], slots[zero]))
                move[zero] = 1
            at = at + move
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
        if not maybe:
            return [np.zeros(0, np.int64)] * 3
        places, slots = np.concatenate([x[0] for x in maybe]), np.concatenate([x[1] for x in maybe])
        size = g["bucket"][slots + 1] - g["bucket"][slots]
        tests, places = ragged(g["bucket"][slots], size), np.repeat(places, size)
        keep = (eight[places + (m - b)] & g["mask"]) == g["suffix"][tests]
        keep &= places + g["length"][tests] <= n
        tests, places = tests[keep], places[keep]
        out = []
        for k in range(0, len(tests), 20_000):  # direct comparison, in bounded steps
            t, p = tests[k : k + 20_000], places[k : k + 20_000]
            length = g["length"][t]
            same = room[ragged(p, length)] == g["flat"][ragged(g["start"][t], length)]
            out.append(np.add.reduceat(~same, np.cumsum(length) - length) == 0)
        same = np.concatenate(out) if out else np.zeros(0, bool)
        return [places[same], g["length"][tests[same]], g["ids"][tests[same]]]


def item_windows(items: list[tuple[str | None, str | None]], width: int = 10) -> tuple[list[bytes], list[list[str]]]:
    """The distinct windows of the items and, for each, the ids of the items that have it."""
    owners: dict[bytes, dict[str, None]] = {}
    for name, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        stream, starts, _ = word_stream(data, np.array([0, len(data)]))
        words = stream[2:].tobytes().split() if len(starts) else []
        for i in range(max(1, len(words) - width + 1) if words else 0):
            own = owners.setdefault(b" " + b" ".join(words[i : i + width]) + b" ", {})
            if name is not None:
                own[name] = None
    return list(owners), [list(x) for x in owners.values()]


def _parts(benchmark: DataFrame, part_bytes: int):
    """The items, a bounded part at a time."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if not r[1]:
            continue
        if part and size + len(r[1]) > part_bytes:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    yield part


def _search_part(docs: DataFrame, part: list, keep: list[str], width: int, merge: bool) -> DataFrame:
    spark = docs.sparkSession
    windows, owners = item_windows(part, width)
    sent = spark.sparkContext.broadcast((windows, owners))
    made: list = []
    names = ["n_words", "n_hit", "items", "places"]

    def run(batches):
        if not made:
            made.append(Patterns(sent.value[0]))
        owned = sent.value[1]
        for batch in batches:
            for a, b, data, at in byte_blocks(batch.column(len(keep))):
                stream, starts, before = word_stream(data, at)
                place, length, which = made[0].search(stream)
                rows = b - a
                hit, items, spots = np.zeros(rows, np.int64), [[] for _ in range(rows)], [[] for _ in range(rows)]
                if len(place):
                    # a match covers the words that start after its first blank and before its last
                    from_word = np.searchsorted(starts, place)
                    to_word = np.searchsorted(starts, place + length - 1)
                    depth = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(depth, from_word, 1)
                    np.add.at(depth, to_word, -1)
                    covered = np.cumsum(depth[:-1]) > 0
                    hit = np.diff(np.append(0, np.cumsum(covered))[before])
                    text_of = np.searchsorted(before, from_word, "right") - 1
                    for doc in np.unique(text_of).tolist():
                        items[doc] = sorted({i for w in np.unique(which[text_of == doc]).tolist() for i in owned[w]})
                    if merge:
                        for doc in np.unique(text_of).tolist():
                            spots[doc] = np.flatnonzero(covered[before[doc] : before[doc + 1]]).tolist()
                own = [batch.column(i).slice(a, rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(before)), pa.array(hit), pa.array(items, pa.list_(pa.string())), pa.array(spots, pa.list_(pa.int64()))], [*keep, *names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(tidy(run), f"{kinds}, n_words long, n_hit long, items array<string>, places array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit and items (sorted ids of the items that occur) for each document."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = _parts(benchmark, part_bytes)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _search_part(chosen, first, ["doc_id"], width, False).drop("places")
    # more than one part: a row is known by its id and its text's SHA-256, equal rows have equal hits
    keyed = chosen.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("row"), "text")
    folder, k = fresh_dir(docs.sparkSession, "hits"), 0
    for part in itertools.chain([first, second], parts):
        found = _search_part(keyed, part, ["doc_id", "row"], width, True)
        (found if k == 0 else found.where("n_hit > 0")).write.parquet(f"{folder}/part={k}")
        k += 1
    hits = docs.sparkSession.read.parquet(folder)
    copies = F.count_if(F.col("part") == 0)
    return (
        hits.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), copies.alias("n"))
        .select("doc_id", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    columns = docs.columns
    for k, part in enumerate(_parts(benchmark, PART_BYTES)):
        if k:
            docs = checkpoint(docs)  # done with the part before
        docs = docs.where(~_hit_udf(docs.sparkSession, part, width)(F.col("text").cast("string")))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def _hit_udf(spark: SparkSession, part: list, width: int):
    sent = spark.sparkContext.broadcast(item_windows(part, width)[0])

    def search(batches):
        patterns = Patterns(sent.value)
        for texts in batches:
            out = np.zeros(len(texts), bool)
            for a, _, data, at in byte_blocks(texts):
                stream, starts, before = word_stream(data, at)
                place, _, _ = patterns.search(stream)
                out[a + np.searchsorted(before, np.searchsorted(starts, place), "right") - 1] = True
            yield pa.array(out)

    @F.arrow_udf("boolean")
    def hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(search)(texts)

    return hit


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
