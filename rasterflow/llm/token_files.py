"""Token ids of documents as flat binary files with 64-bit document offsets.

``write_tokens`` sorts documents by id over range partitions; each task encodes its documents and
writes three files beside each other in a shared folder: ids (unsigned 16- or 32-bit, little-endian,
whatever holds the vocabulary), offsets (n + 1 signed 64-bit token positions within the part) and
document ids (signed 64-bit). A manifest row per part carries the part's base, the prefix sum of the
tokens before it, so any document's place in the whole stream is base + offset. Files get names of
their own per task attempt and only those of the successful attempt reach the manifest.

``read_tokens`` memory-maps the parts (or reads them through Arrow where the store isn't local).

Null text encodes as empty; a null doc_id sorts first and is read back as null; repeated ids keep all
their rows, in text order; an empty table gives no part; very long texts are encoded in parts that no pre-token
spans; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import filesystem, fresh_dir, ragged, table, tidy

MANIFEST = "part long, path string, base long, n_docs long, n_null long, n_tokens long, width int"
_ENCODERS: dict = {}


class Encoder:
    """Ids of whole texts as tokenizer gives them, computed once per distinct pre-token."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        words = spec["normalizer"] is not None
        self.size = self.whole.get_vocab_size()
        self.split = pretokens.Splitter(self.whole, words, [t["content"] for t in spec["added_tokens"]])
        self.lexicon = pretokens.Lexicon(pretokens.library_encoder(self.whole))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        slow = {i: None for i, t in enumerate(texts) if not self.split.plain(t)}
        parts, owner = [], []
        for i, t in enumerate(texts):
            if i not in slow:
                for part in pretokens.cut(t) if len(t) > pretokens.BLOCK_CHARS else (t,):
                    parts.append(part)
                    owner.append(i)
        owner = np.array(owner, np.int64)
        counts, flats, at = np.zeros(len(texts), np.int64), [], []
        for a, b in pretokens.text_blocks(parts):
            s = self.split.split(parts[a:b])
            where, n = self.lexicon.look_up(s)
            own = owner[a:b][s.text_of]
            counts += np.bincount(own, n, len(texts)).astype(np.int64)
            flats.append(self.lexicon.pool[ragged(where, n.astype(np.int64))])
            at.append(np.repeat(own, n))
            for i in np.unique(owner[a:b][s.complex]).tolist():
                slow[i] = None
        ids = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        if slow:
            own = np.concatenate(at) if at else np.zeros(0, np.int64)
            hard = np.zeros(len(texts), bool)
            hard[list(slow)] = True
            keep = ~hard[own]
            ids, own = ids[keep], own[keep]
            extra = {i: np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in slow}
            for i, x in extra.items():
                counts[i] = len(x)
            ids = np.concatenate([ids, *extra.values()])
            own = np.concatenate([own, *[np.full(len(x), i, np.int64) for i, x in extra.items()]])
            ids = ids[np.argsort(own, kind="stable")]
        return ids, counts


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the files; returns the manifest, one row per part in document order."""
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        enc = encoder(tokenizer_path)
        width = 2 if max(enc.size - 1, end_id) < 1 << 16 else 4
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        base = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        n_docs = n_null = n_tokens = 0
        with store.open_output_stream(f"{root}/{base}.ids") as ids_to, store.open_output_stream(f"{root}/{base}.offsets") as at_to, store.open_output_stream(f"{root}/{base}.docs") as docs_to:
            at_to.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                texts = batch.column(1).to_pylist()
                n_null += batch.column(0).null_count  # null ids come first
                names = batch.column(0).fill_null(0).to_numpy()
                texts = [t or "" for t in texts]
                for a, b in pretokens.text_blocks(texts):
                    ids, n = enc.encode(texts[a:b])
                    stops = np.cumsum(n)
                    ids = np.insert(ids, stops, end_id)
                    at_to.write((n_tokens + stops + np.arange(1, b - a + 1)).astype("<i8").tobytes())
                    ids_to.write(ids.astype(f"<u{width}").tobytes())
                    docs_to.write(names[a:b].astype("<i8").tobytes())
                    n_docs, n_tokens = n_docs + b - a, n_tokens + len(ids)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([base]), pa.array([n_docs]), pa.array([n_null]), pa.array([n_tokens]), pa.array([width], pa.int32())], ["part", "path", "n_docs", "n_null", "n_tokens", "width"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(write), "part long, path string, n_docs long, n_null long, n_tokens long, width int").collect()
    total, manifest = 0, []
    for r in sorted(rows):  # a row per part: their number follows the partitions, not the documents
        manifest.append((r.part, f"{folder}/{r.path}", total, r.n_docs, r.n_null, r.n_tokens, r.width))
        total += r.n_tokens
    return spark.createDataFrame(manifest, MANIFEST).repartition(max(1, len(manifest)))


def _mapped(store, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is local."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        import os

        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, path = filesystem(r["path"])
                ids = _mapped(store, path + ".ids", f"<u{r['width']}")
                at, names = _mapped(store, path + ".offsets", "<i8"), _mapped(store, path + ".docs", "<i8")
                for a in range(0, r["n_docs"], 4096):
                    b = min(a + 4096, r["n_docs"])
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)]
                    own = np.array(names[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=np.arange(a, b) < r["n_null"]), pa.array(r["base"] + at[a:b]), pa.array(np.diff(at[a : b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_dir(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")))
