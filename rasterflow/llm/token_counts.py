"""Numbers of tokens per document without materialising ids.

Each task splits its documents into pre-tokens and turns them into rows (pre-token, its documents and
frequencies there), one row per distinct pre-token and block of documents. An exchange by pre-token brings all
rows of a pre-token to one task, sorted, so that its pieces are counted once and multiplied into the documents' sums; a
second, small exchange by block adds these up.

Frequent pre-tokens don't take that way, as one task would get all rows of each. A first scan counts entries (a
pre-token in a document); every task names those with more than a ``1 / HOT`` share of its own entries, and those whose
counts reach that share of all entries are hot: ``HOT`` at most, and no other pre-token holds more than 2 / HOT of the
entries. Their pieces are counted once, sent to all tasks and multiplied where the documents are. Only pre-tokens
of up to ``SHORT`` characters are made hot, so what is sent has a bound.

Null text counts as empty; null or repeated doc_ids keep a row each; an empty table gives no row;
further columns are ignored; very long texts are split in parts that no pre-token spans. Texts with special strings,
or whose normalisation isn't code point by code point, are counted by the library as a whole, within the same step.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import blocks, checkpoint, table, tidy, utf8
from .token_files import encoder

#: Documents and characters of a block whose frequencies travel together.
BLOCK_DOCS, BLOCK_SIZE = 32768, 8 << 20
#: At most so many hot pre-tokens, of so many characters.
HOT, SHORT = 100_000, 256


def _split(enc, texts: list[str]):
    """(parts of the plain texts, the text each belongs to, numbers of the others)."""
    slow = {i for i, t in enumerate(texts) if not enc.split.plain(t)}
    parts, owner = [], []
    for i, t in enumerate(texts):
        if i not in slow:
            for part in pretokens.cut(t) if len(t) > pretokens.BLOCK_CHARS else (t,):
                parts.append(part)
                owner.append(i)
    return parts, np.array(owner, np.int64), slow


def _entries(enc, parts, owner):
    """(different pre-tokens, which of them, text, frequency) of a stretch of parts, and the texts that need the library."""
    for x, y in pretokens.text_blocks(parts):
        s = enc.split.split(parts[x:y])
        first, back = s.classes()
        own = owner[x:y][s.text_of]
        order = np.lexsort((own, back))
        b, o = back[order], own[order]
        head = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (o[1:] != o[:-1])])) if len(b) else np.zeros(0, np.int64)
        yield s.pieces(first), b[head], o[head], np.diff(np.append(head, len(b))), owner[x:y][s.complex].tolist()


def frequent(docs: DataFrame, tokenizer_path: str, hot: int = HOT) -> dict[str, int]:
    """The hot pre-tokens and their numbers of pieces."""

    def count(batches):
        enc, total, sums = encoder(tokenizer_path), 0, Counter()

        def named():
            least = total // hot
            found = [(w, n) for w, n in sums.items() if n > least and len(w) <= SHORT]
            return pa.RecordBatch.from_arrays([pa.array([None, *[w for w, _ in found]], pa.string()), pa.array([total, *[n for _, n in found]], pa.int64())], ["pretoken", "n"])

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK_SIZE):
                parts, owner, _ = _split(enc, texts[a:b])
                for words, which, _, _, _ in _entries(enc, parts, owner):
                    for w, n in zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True):
                        sums[w] += n
                    total += len(which)
                if len(sums) > 1_000_000:  # a stretch of documents for itself
                    yield named()
                    total, sums = 0, Counter()
        yield named()

    def pieces(batches):
        encode = pretokens.library_encoder(encoder(tokenizer_path).whole)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, encode(batch.column(0).to_pylist()))), pa.int64())], ["pretoken", "pieces"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(tidy(count), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    found = checkpoint(found)
    total = found.where("pretoken is null").agg(F.max("n")).first()[0] or 0
    most = found.where(F.col("pretoken").isNotNull() & (F.col("n") * hot > total)).select("pretoken")
    return {r.pretoken: r.pieces for r in most.mapInArrow(tidy(pieces), "pretoken string, pieces long").collect()}  # hot words at most


def pretoken_rows(docs: DataFrame, tokenizer_path: str, hot) -> DataFrame:
    """(block, pretoken, of, freq): of and freq hold the documents' places in the block and the frequencies, unsigned 16 bits
    each (frequencies that don't fit come in further entries). Rows with null pretoken carry the block's doc_ids (64 bits, then
    a byte each that tells nulls), byte sizes and counts of hot pre-tokens and by the library, as 64-bit values. hot: a broadcast."""

    def split(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        task = TaskContext.get().partitionId() << 20
        for batch in batches:
            every = [t or "" for t in batch.column(1).to_pylist()]
            names = batch.column(0)
            for a, b in blocks(np.fromiter(map(len, every), np.int64, len(every)), BLOCK_SIZE):
                for c in range(a, b, BLOCK_DOCS):
                    yield from block(enc, task, names.slice(c, min(b, c + BLOCK_DOCS) - c), every[c : min(b, c + BLOCK_DOCS)])
                    task += 1

    def block(enc, task, names, texts):
        parts, owner, slow = _split(enc, texts)
        known: dict[str, int] = {}
        direct = np.zeros(len(texts), np.int64)
        keys, docs, freqs = [], [], []
        for words, which, text, freq, complex_ in _entries(enc, parts, owner):
            slow |= set(complex_)
            count = np.array([hot.value.get(w, -1) for w in words], np.int64)[which]
            here = count >= 0
            direct += np.bincount(text[here], (count * freq)[here], len(texts)).astype(np.int64)
            number = np.array([-1 if w in hot.value else known.setdefault(w, len(known)) for w in words], np.int64)[which]
            keys.append(number[~here])
            docs.append(text[~here])
            freqs.append(freq[~here])
        for i in slow:
            direct[i] = len(enc.whole.encode(texts[i], add_special_tokens=False).ids)
        if keys:
            keys, docs, freqs = np.concatenate(keys), np.concatenate(docs), np.concatenate(freqs)
            if slow:
                keep = ~np.isin(docs, list(slow))
                keys, docs, freqs = keys[keep], docs[keep], freqs[keep]
            while (over := freqs > 0xFFFF).any():
                keys, docs = np.concatenate([keys, keys[over]]), np.concatenate([docs, docs[over]])
                freqs = np.concatenate([np.where(over, 0xFFFF, freqs), freqs[over] - 0xFFFF])
            order = np.argsort(keys, kind="stable")
            keys, docs, freqs = keys[order], docs[order].astype("<u2"), freqs[order].astype("<u2")
        if len(keys):
            words = list(known)
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            at = pa.py_buffer((2 * np.append(head, len(keys))).astype(np.int32))
            binary = lambda v: pa.Array.from_buffers(pa.binary(), len(head), [None, at, pa.py_buffer(v)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), task)), pa.array([words[k] for k in keys[head].tolist()]), binary(docs), binary(freqs)], ["block", "pretoken", "of", "freq"])
        sizes = np.array([len(t.encode()) for t in texts], "<i8")
        ids = np.array(names.fill_null(0).to_numpy(), "<i8").tobytes() + pc.is_null(names).to_numpy(zero_copy_only=False).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([task]), pa.nulls(1, pa.string()), pa.array([ids]), pa.array([np.concatenate([sizes, direct.astype("<i8")]).tobytes()])], ["block", "pretoken", "of", "freq"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(split), "block long, pretoken string, of binary, freq binary")


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""

    def pieces(batches):
        encode = pretokens.library_encoder(encoder(tokenizer_path).whole)
        places, values, held, last = [], [], 0, (None, 0)
        for batch in batches:
            words = batch.column(1).to_pylist()
            for k in (k for k, w in enumerate(words) if w is None):
                yield one(batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_py())
            words = [w for w in words if w is not None]
            if not words:
                continue
            # sorted by pre-token: equal ones stand together, the last may go on in the next batch
            new = [w for k, w in enumerate(words) if w != (words[k - 1] if k else last[0])]
            counts = [last[1], *map(len, encode(new))]
            step = np.cumsum([w != (words[k - 1] if k else last[0]) for k, w in enumerate(words)])
            count = np.array(counts, np.int64)[step]
            last = (words[-1], int(count[-1]))
            some = batch.filter(pc.is_valid(batch.column(1)))
            (of, at), (freq, _) = utf8(some.column(2)), utf8(some.column(3))
            n = np.diff(at) // 2
            # a document's place: its block and its number there
            places.append(np.repeat(some.column(0).to_numpy() * BLOCK_DOCS, n) + np.frombuffer(of.tobytes(), "<u2"))
            values.append(np.repeat(count, n) * np.frombuffer(freq.tobytes(), "<u2"))
            held += len(values[-1])
            if held > 1_000_000:
                yield from sums(places, values)
                places, values, held = [], [], 0
        yield from sums(places, values)

    def sums(places, values):
        """Sums by document: places in a block, then values."""
        if places:
            place, back = np.unique(np.concatenate(places), return_inverse=True)
            total = np.bincount(back, np.concatenate(values), len(place)).astype("<i8")
            block, first = np.unique(place // BLOCK_DOCS, return_index=True)
            for k, a, b in zip(block.tolist(), first.tolist(), [*first[1:].tolist(), len(place)], strict=True):
                yield one(k, (place[a:b] % BLOCK_DOCS).astype("<u2").tobytes(), total[a:b].tobytes(), False)

    def one(block, of, freq, whole=True):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([whole]), pa.array([of], pa.binary()), pa.array([freq], pa.binary())], ["block", "whole", "of", "freq"])

    def add(batches):
        block, ids, total, sizes, null = None, None, None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(sizes), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for b, whole, of, freq in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != block:
                    if ids is not None:
                        yield done()
                    block = b
                if whole:  # comes first within its block
                    n = len(of) // 9
                    ids, null = np.frombuffer(of, "<i8", n), np.frombuffer(of, bool, n, 8 * n)
                    sizes, total = np.frombuffer(freq, "<i8", n), np.frombuffer(freq, "<i8", n, 8 * n).copy()
                else:
                    total[np.frombuffer(of, "<u2")] += np.frombuffer(freq, "<i8")
        if ids is not None:
            yield done()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pretoken_rows(docs, tokenizer_path, spark.sparkContext.broadcast(frequent(docs, tokenizer_path, hot)))
    # rows without a pre-token are few, one a block: dealt by block, so that they don't meet in one task
    dealt = rows.repartition(n, F.coalesce(F.col("pretoken"), F.col("block").cast("string"))).sortWithinPartitions("pretoken")
    partial = dealt.mapInArrow(tidy(pieces), "block long, whole boolean, of binary, freq binary")
    return partial.repartition(n, "block").sortWithinPartitions("block", F.desc("whole")).mapInArrow(tidy(add), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
