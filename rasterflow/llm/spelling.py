"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is the set of its (letter, occurrence) pairs, a binary vector; one edit changes at most two of its places. The
places are dealt into parts, and a signature is the vector's projection on all parts of a first-level block but two (but
``k2``): vectors at a Hamming distance of two or less agree in one of them at least. Words that share a signature are
compared letter by letter. A group of many words isn't compared pair by pair: an edit leaves the first or the last half
of the shorter word as it is, so such a group is dealt again by halves of what is still open, until groups are small.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, mix64, ragged, range_sums, table, tidy, utf8

#: Groups of at most so many words are compared pair by pair.
SMALL = 16
#: Groups of more words than this are dealt to other tasks again.
LARGE = 100_000
#: Rows of whole groups that a task works on at a time.
ROWS = 200_000
_CELLS = 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, letters: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word and n: runs of letters, A-Z lower-cased; a run whose crc32 (of ``doc_id:run``) every divides loses one code point.

    Words have ``letters`` code points and ``least`` occurrences at least; shorter runs can't become words and aren't looked
    at. Null text has no runs; a null doc_id is written as nothing. Counts are partial sums before anything is shuffled."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{letters},}}"), 0)).alias("run"))
    marked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return marked.select(word.alias("word")).where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Words:
    """Words as bytes, one for each code point: letters up to U+00FF only."""

    def __init__(self, column):
        raw, at = utf8(column)
        lead = raw == 0xC3
        data = raw.copy()
        data[1:][lead[:-1]] += 0x40
        self.data = data[~lead]
        self.start = at[:-1] - np.append(0, np.cumsum(lead))[at[:-1]]
        self.length = np.diff(np.append(self.start, len(self.data)))

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        return self.data[self.start[rows][:, None] + np.arange(width)]

    def by_length(self, rows: np.ndarray):
        """(positions in rows, width) of rows of equal length, of about _CELLS letters each."""
        order = np.argsort(self.length[rows], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.length[rows][order])) + 1):
            width = int(self.length[rows[part[0]]]) if len(part) else 0
            step = max(1, _CELLS // max(1, width))
            for k in range(0, len(part), step):
                yield part[k : k + step], width


class PartEnum:
    """Signatures of letter multisets for Hamming distances of up to k: n1 blocks of n2 parts; in one block at most k2 parts differ."""

    def __init__(self, rank: np.ndarray, k: int = 2, n1: int = 1, n2: int = 5):
        k2 = -(-(k + 1) // n1) - 1
        self.rank, self.parts = rank, n1 * n2
        self.chosen = [[i * n2 + j for j in own] for i in range(n1) for own in itertools.combinations(range(n2), n2 - k2)]

    def of(self, words: Words, rows: np.ndarray) -> np.ndarray:
        """A row of 64-bit signatures for each word; equal projections have equal ones, and a chance meeting only adds a comparison."""
        out = np.empty((len(rows), len(self.chosen)), np.uint64)
        for mine, width in words.by_length(rows):
            letters = np.sort(words.matrix(rows[mine], width), axis=1)
            place = np.arange(width)
            new = np.ones(letters.shape, bool)
            new[:, 1:] = letters[:, 1:] != letters[:, :-1]
            nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
            part = (self.rank[letters] + 2 * nth) % self.parts
            value = mix64((letters + 256 * nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sums = [mix64(np.where(part == p, value, np.uint64(0)).sum(axis=1, dtype=np.uint64) + np.uint64(p)) for p in range(self.parts)]
            for j, own in enumerate(self.chosen):
                out[mine, j] = mix64(sum(sums[p] for p in own) + np.uint64(j))
        return out


def _edited(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of words a and b (b as long as a, or longer by one) if one edit parts them, else -1."""
    out = np.full(len(a), -1, np.int64)
    more = words.length[b] - words.length[a]
    for mine, width in words.by_length(a):
        one = words.matrix(a[mine], width)
        for extra in (0, 1):
            k = more[mine] == extra
            if k.any():
                two = words.matrix(b[mine[k]], width + extra)
                front = np.cumprod(one[k] == two[:, :width], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
                back = np.cumprod((one[k] == two[:, extra:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
                near = (front + back == width - 1) if extra == 0 else (front + back >= width)
                out[mine[k]] = np.where(near, front, -1)
    return out


#: A row of a group: key, which signature, least word length of a pair (-1: any), letters known to be equal in front and
#: at the end, the halvings so far (1, then a bit each: 0 for the front half), and the word's row.
_GROUP = ("key", "which", "shorter", "front", "back", "path", "row")


def _halves(words: Words, g: dict) -> dict:
    """The group rows dealt by halves of what is still open: by the shorter word's length first, then by either half."""
    any_length = g["shorter"] < 0
    twice = np.concatenate([np.arange(len(any_length)), np.flatnonzero(any_length & (words.length[g["row"]] > 1))])
    second = np.arange(len(twice)) >= len(any_length)
    g = {c: v[twice] for c, v in g.items()}
    g["shorter"] = np.where(g["shorter"] < 0, words.length[g["row"]] - second, g["shorter"])
    half = (g["shorter"] - g["front"] - g["back"]) // 2
    end = words.start[g["row"]] + words.length[g["row"]] - g["back"]
    parts = []
    for side, first in ((0, words.start[g["row"]] + g["front"]), (1, end - half)):
        # ranges are laid out one after the other; only their letters are hashed
        letters = words.data[ragged(first, half)]
        ends = np.cumsum(half)
        known = range_sums(mix64(letters.astype(np.uint64) + np.uint64(1)), ends - half, ends)
        key = mix64(g["key"] + known * np.uint64(2 * side + 3) + mix64((4 * g["shorter"] + side).astype(np.uint64)))
        parts.append(g | {"key": key, "front": g["front"] + half * (side == 0), "back": g["back"] + half * (side == 1), "path": 2 * g["path"] + side})
    return {c: np.concatenate([p[c] for p in parts]) for c in g}


def _pairs(words: Words, sigs: PartEnum, g: dict):
    """Pairs of rows (shorter or equal first) of words one edit apart, each once over all signatures and halvings."""
    while len(g["key"]):
        order = np.argsort(g["key"], kind="stable")
        g = {c: v[order] for c, v in g.items()}
        heads = np.flatnonzero(np.append(True, g["key"][1:] != g["key"][:-1]))
        size = np.diff(np.append(heads, len(order)))
        done = (g["shorter"][heads] >= 0) & (g["shorter"][heads] - g["front"][heads] - g["back"][heads] <= 1)
        ready = np.repeat((size <= SMALL) | done, size)
        group = np.repeat(np.arange(len(size)), size)
        after = (np.repeat(heads + size, size) - np.arange(len(order)) - 1) * ready
        step = np.cumsum(after) // _CELLS
        for part in np.split(np.flatnonzero(after), np.flatnonzero(np.diff(step[np.flatnonzero(after)])) + 1):
            i = np.repeat(part, after[part])
            j = ragged(part + 1, after[part])
            a, b = g["row"][i], g["row"][j]
            swap = words.length[a] > words.length[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            fits = (words.length[b] - words.length[a] <= 1) & (g["which"][i] == g["which"][j]) & (a != b) & ((g["shorter"][i] < 0) | (g["shorter"][i] == words.length[a]))
            i, a, b = i[fits], a[fits], b[fits]
            common = _edited(words, a, b)
            near = common >= 0
            i, a, b, common = i[near], a[near], b[near], common[near]
            front, back, path, left = np.zeros_like(common), np.zeros_like(common), np.ones_like(common), np.frexp(g["path"][i])[1] - 1
            while (left > 0).any():  # the one way of halvings that counts: to the front half wherever that is equal
                half = np.where(left > 0, (words.length[a] - front - back) // 2, 0)
                behind = (left > 0) & (common < front + half)
                front, back, path, left = front + half * ~behind, back + half * behind, np.where(left > 0, 2 * path + behind, path), left - 1
            right = path == g["path"][i]
            i, a, b = i[right], a[right], b[right]
            first = np.argmax(sigs.of(words, a) == sigs.of(words, b), axis=1)
            mine = first == g["which"][i]
            yield a[mine], b[mine]
        del group
        rest = ~ready
        g = _halves(words, {c: v[rest] for c, v in g.items()}) if rest.any() else {c: v[:0] for c, v in g.items()}


_DEALT = "key long, which int, shorter int, front int, back int, path int, word string, n long, near string, near_n long"
_TYPES = pa.schema([("key", pa.int64())] + [(c, pa.int32()) for c in _GROUP[1:-1]] + [("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _dealt(g: dict, words: pa.Array, n: pa.Array):
    """Rows for the next round of groups."""
    for k in range(0, len(g["key"]), 16384):
        at = pa.array(g["row"][k : k + 16384])
        numbers = [pa.array(g["key"][k : k + 16384].view(np.int64)), *[pa.array(g[c][k : k + 16384].astype(np.int32)) for c in _GROUP[1:-1]]]
        yield pa.RecordBatch.from_arrays([*numbers, words.take(at), n.take(at), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64())], schema=_TYPES)


def _signed(rank: np.ndarray):
    def run(batches):
        sigs = PartEnum(rank)
        for batch in batches:
            words, count = Words(batch.column("word")), len(sigs.chosen)
            rows = np.arange(batch.num_rows)
            zero = np.zeros(batch.num_rows * count, np.int64)
            g = {"key": sigs.of(words, rows).ravel(), "which": np.tile(np.arange(count), len(rows)), "shorter": zero - 1, "front": zero, "back": zero, "path": zero + 1, "row": np.repeat(rows, count)}
            yield from _dealt(g, batch.column("word"), batch.column("n"))

    return run


def _compared(rank: np.ndarray, large: int, rows_at_once: int):
    def settle(rows: pa.Table, sigs: PartEnum):
        words, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        g = {"key": rows.column("key").to_numpy().view(np.uint64)} | {c: rows.column(c).to_numpy().astype(np.int64) for c in _GROUP[1:-1]} | {"row": np.arange(rows.num_rows)}
        for a, b in _pairs(Words(words), sigs, g):
            for one, other in ((a, b), (b, a)):
                for k in range(0, len(a), 16384):
                    x, y = pa.array(one[k : k + 16384]), pa.array(other[k : k + 16384])
                    blank = [pa.nulls(len(x), t) for t in [pa.int64()] + [pa.int32()] * 5]
                    yield pa.RecordBatch.from_arrays([*blank, words.take(x), n.take(x), words.take(y), n.take(y)], schema=_TYPES)

    def again(rows: pa.Table):
        words, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        g = {"key": rows.column("key").to_numpy().view(np.uint64)} | {c: rows.column(c).to_numpy().astype(np.int64) for c in _GROUP[1:-1]} | {"row": np.arange(rows.num_rows)}
        yield from _dealt(_halves(Words(words), g), words, n)

    def run(batches):
        sigs, held, count, over = PartEnum(rank), [], 0, None
        for batch in batches:
            key = batch.column("key").to_numpy()
            if over is not None:  # the rest of a group that goes on to the next round
                cut = int(np.searchsorted(key, over, side="right"))
                yield from again(pa.Table.from_batches([batch.slice(0, cut)]))
                if cut == len(key):
                    continue
                batch, key, over = batch.slice(cut), key[cut:], None
            held.append(batch)
            count += len(key)
            if count < rows_at_once or not len(key):
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from settle(rows.slice(0, cut), sigs)
            held, count = rows.slice(cut).combine_chunks().to_batches(), rows.num_rows - cut
            if count > large:
                yield from again(pa.Table.from_batches(held))
                held, count, over = [], 0, int(keys[-1])
        if count:
            yield from settle(pa.Table.from_batches(held), sigs)

    return run


def near_words(words: DataFrame, large: int = LARGE, rows_at_once: int = ROWS) -> DataFrame:
    """word, near, near_n: every ordered pair of words (word, n; checkpointed) one inserted, deleted or replaced letter apart, once."""
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()  # no more than the alphabet
    rank = np.zeros(256, np.int64)
    for k, row in enumerate(counts):
        rank[ord(row["letter"])] = k
    dealt, found = words.mapInArrow(tidy(_signed(rank)), _DEALT), None
    while True:
        ordered = dealt.drop("near", "near_n").repartition("key").sortWithinPartitions("key")
        done = checkpoint(ordered.mapInArrow(tidy(_compared(rank, large, rows_at_once)), _DEALT))
        pairs = done.where(F.col("near").isNotNull()).select("word", "near", "near_n")
        found = pairs if found is None else found.unionByName(pairs)
        dealt = done.where(F.col("near").isNull())
        if dealt.isEmpty():
            return found


def variants(words: DataFrame, large: int = LARGE, rows_at_once: int = ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n) of letters up to U+00FF; no words give no rows.

    Equal frequencies are decided by code points. From word to form the frequency doubles at least, so ways are short, and
    each round of joins doubles the part of a way that is known."""
    words = checkpoint(words.select("word", "n"))
    best = near_words(words, large, rows_at_once).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.near"))
    rows = checkpoint(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")))
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    top = rows.agg(F.max("n")).first()[0] or 0
    for _ in range(top.bit_length().bit_length()):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = checkpoint(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with their near words' number, the form they are a variant of, and the root of that way."""
    return variants(word_counts(table(spark, sf_dir, "documents")))
