"""Byte-level BPE, encoding by a priority queue of merge ranks and decoding by concatenation.

A pre-token's bytes form a doubly linked list of symbols. The queue holds (rank, place) of neighbour pairs;
the best is taken off, skipped when its pair is no longer there, else merged and the pairs with its
new neighbours are put in. Pre-tokens come from the vectorised splitter; each distinct one is merged
once per Python worker. Decoding joins the vocabulary's byte strings and reads them as UTF-8.

Null text is empty (no ids, the hash of nothing); null and repeated doc_ids keep a row each; an empty
table gives no row; further columns are ignored by ``encode_decode``. Very long texts are cut at
white space for splitting, which leaves the pre-tokens as they are. Pre-tokens are found by 64-bit hashes and
told apart by their strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import ragged, table, tidy

_CODECS: dict = {}


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in own}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return out


class Codec:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the leftmost special string first, the longest of those that start there
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for token, i in vocab.items():
            strings[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            strings[i] = token.encode()
        self.length = np.fromiter(map(len, strings), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.split = pretokens.Splitter(Tokenizer.from_file(path), False, [])
        self.lexicon = pretokens.Lexicon(lambda pieces: [self.merge(p.encode()) for p in pieces])

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.byte_id[b] for b in data]
        n = len(symbols)
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if m := merges.get((symbols[i], symbols[i + 1])):
                queue.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        if not queue:
            return symbols
        heapq.heapify(queue)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = following[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            after = following[i] = following[j]
            if after < n:
                before[after] = i
                if m := merges.get((new, symbols[after])):
                    heapq.heappush(queue, (m[0], i, new, symbols[after], m[1]))
            if (p := before[i]) >= 0 and (m := merges.get((symbols[p], new))):
                heapq.heappush(queue, (m[0], p, symbols[p], new, m[1]))
        return [s for s in symbols if s >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); special strings become their ids."""
        parts, owner, marks = [], [], []  # marks: the special id that follows a part, or -1
        for i, t in enumerate(texts):
            for piece, mark in self._cut_specials(t):
                small = pretokens.cut(piece) if len(piece) > pretokens.BLOCK_CHARS else [piece]
                parts += small
                owner += [i] * len(small)
                marks += [-1] * (len(small) - 1) + [mark]
        owner, marks = np.array(owner, np.int64), np.array(marks, np.int64)
        per_part, flats = np.zeros(len(parts), np.int64), []
        for a, b in pretokens.text_blocks(parts):
            s = self.split.split(parts[a:b])
            where, n = self.lexicon.look_up(s)
            per_part[a:b] = np.bincount(s.text_of, n, b - a)
            flats.append(self.lexicon.pool[ragged(where, n.astype(np.int64))])
        ids = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        if (marks >= 0).any():
            at = np.flatnonzero(marks >= 0)
            ids = np.insert(ids, np.cumsum(per_part)[at], marks[at].astype(np.uint32))
            per_part[at] += 1
        return ids, np.bincount(owner, per_part, len(texts)).astype(np.int64)

    def _cut_specials(self, text: str) -> list[tuple[str, int]]:
        if self.specials is None or not any(token in text for token in self.special):
            return [(text, -1)]
        pieces = self.specials.split(text)  # texts and special strings by turns
        return [(p, self.special[s]) for p, s in zip(pieces[:-1:2], pieces[1::2], strict=True)] + [(pieces[-1], -1)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens' strings, one after the other."""
        return self.bytes[ragged(self.start[ids], self.length[ids])]

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array), decoded (text) of each document; ``digest`` columns instead come from ``encode_digests``."""

    def run(batches):
        own = codec(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in pretokens.text_blocks(texts):
                ids, n = own.encode(texts[a:b])
                at = np.append(0, np.cumsum(n))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array([own.decode_text(ids[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded texts stay inside the task."""

    def run(batches):
        own = codec(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in pretokens.text_blocks(texts):
                ids, n = own.encode(texts[a:b])
                raw = memoryview(ids.astype("<u4").tobytes())
                data = own.decode(ids)
                per_text = np.append(0, np.cumsum(n))
                ends = np.append(0, np.cumsum(own.length[ids]))[per_text]
                out = memoryview(data.tobytes())
                hashes, back = [], []
                for s, e, x, y in zip((4 * per_text[:-1]).tolist(), (4 * per_text[1:]).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    hashes.append(hashlib.sha256(raw[s:e]).hexdigest())
                    text = bytes(out[x:y]).decode("utf-8", "replace")  # as the library reads bytes that aren't UTF-8
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(hashes, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
