"""Language identification by error-correcting output codes.

Each language gets a binary codeword. For every bit, a binary n-gram classifier separates the languages with a
one from those with a zero: the log ratio of the two sides' smoothed n-gram distributions, each language weighing
the same. A text's margin for a bit is the mean log ratio of its n-grams, in units of that bit's
spread over the languages' own distributions. Decoding sums, for each codeword, the logistic losses of the margins
with the bits' weights, and takes the smallest; a small lead over the second flags ambiguity.

N-grams are 1, 2 and 3 letters of lower-cased words with one blank around, hashed into 2 ** 14 buckets. Training
counts them over all labelled rows with Spark (sums per language and bucket; languages x buckets numbers reach
the driver, for at most MOST_LANGUAGES languages; more are an error). With up to 7 languages codes are exhaustive
(2 ** (k - 1) - 1 bits), beyond that words of 4 * ceil(log2 k) + 7 bits are drawn by a hash, and a draw is taken only if it
differs from all before in `least_distance` bits: 6 at 8 languages, 7 at 16, more beyond, so 2 wrong bits or more are corrected.

Languages whose losses are equal: the first by name is predicted. Null text, or text without a letter, is predicted as ``und`` with score 0; null langs aren't learned; null or
repeated ids keep a row each; with no labelled row everything is ``und``; an empty table gives no
row; further columns are ignored. Very long texts are scored whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_mod, mix64, table, tidy

BUCKETS = 1 << 14
#: Languages that a model holds: BUCKETS numbers each on the driver, and a table of BUCKETS x 43 bits to each worker.
MOST_LANGUAGES = 512
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, 32 for anything else."""
    if "letters" not in _TABLES:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _TABLES["letters"] = out
    return _TABLES["letters"]


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts per text and bucket as float32, whether each text has a letter)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=at[1:])
    codes = _letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)].astype(np.uint64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(at))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (text_of[1:] != text_of[:-1])
    codes, text_of = codes[keep], text_of[keep]
    has = np.bincount(text_of, codes != 32, len(texts)) > 0
    out = np.zeros(len(texts) * BUCKETS, np.float32)
    key = codes
    for n in (1, 2, 3):
        if n > 1:
            key = key[:-1] << np.uint64(21) | codes[n - 1 :]
        if not len(key):
            break
        inside = text_of[: len(key)] == text_of[n - 1 :]
        inside &= (key != 32) if n == 1 else True
        slot = (mix64(key[inside] * np.uint64(3) + np.uint64(n)) >> np.uint64(50)).astype(np.int64)
        out += np.bincount(text_of[: len(inside)][inside] * BUCKETS + slot, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), BUCKETS), has


def _parts(texts: list[str]):
    for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 20):
        for c in range(a, b, 256):
            yield c, min(b, c + 256)


def train_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n: summed n-gram counts, from columns lang and text."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _parts(texts):
                counts, _ = ngram_counts(texts[a:b])
                for lang in set(langs[a:b]):
                    own = counts[[k for k in range(b - a) if langs[a + k] == lang]].sum(0, dtype=np.float64)
                    if lang in sums:
                        sums[lang] += own
                    else:
                        sums[lang] = own
        for lang, own in sums.items():
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots)), pa.array(slots), pa.array(own[slots].astype(np.int64))], ["lang", "bucket", "n"])

    return labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(tidy(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1 as rows; every two differ in as many bits as the form allows."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        width = (1 << (k - 1)) - 1
        # column j: the binary digits of j, the first language on the side of ones throughout
        return np.array([[1 if row == 0 or j >> (k - 1 - row) & 1 else -1 for j in range(width)] for row in range(k)], float)
    width, gap, drawn, seed = 4 * math.ceil(math.log2(k)) + 7, least_distance(k), [], 0
    while len(drawn) < k:
        seed += 1
        word = int(mix64(np.array([seed], np.uint64))[0]) >> (64 - width)
        if all((word ^ other).bit_count() >= gap for other in drawn):
            drawn.append(word)
    code = np.array([[1 if word >> j & 1 else -1 for j in range(width)] for word in drawn], float)
    return code[:, np.abs(code.sum(0)) < k]


def least_distance(k: int) -> int:
    """Bits in which any two of k > 7 codewords differ at least: the largest number for which balls around all of them fill half of the words at most, so that drawing goes on to the end."""
    width, gap, ball = 4 * math.ceil(math.log2(k)) + 7, 0, 1
    while 2 * k * ball <= 1 << width:
        gap += 1
        ball += math.comb(width, gap)
    return gap


class Model:
    """langs, codewords, log ratios by bucket and bit, spreads and weights of the bits."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        if not self.langs:
            return
        p = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in self.langs])
        self.ratio = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.centre, self.spread, self.weight = (np.zeros(self.code.shape[1]) for _ in range(3))
        for j in range(self.code.shape[1]):
            one, zero = p[self.code[:, j] > 0], p[self.code[:, j] < 0]
            if not len(one) or not len(zero):
                self.spread[j] = 1
                continue
            r = np.log(one.mean(0)) - np.log(zero.mean(0))
            means = p @ r  # expected margin of each language's own text
            low, high = means[self.code[:, j] > 0].min(), means[self.code[:, j] < 0].max()
            self.ratio[:, j] = r
            self.centre[j] = (low + high) / 2
            self.spread[j] = max((low - high) / 2, 1e-3)
            self.weight[j] = max(low - high, 0) + 1e-6
        self.weight /= max(self.weight.sum(), 1e-12)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        counts, has = ngram_counts(texts)
        if not self.langs:
            return [("und", 0.0, False)] * len(texts)
        margin = (counts @ self.ratio) / np.maximum(counts.sum(1), 1)[:, None]
        margin = 3 * (margin - self.centre) / self.spread
        loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.weight).sum(2)
        best = loss.argmin(1)
        e = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
        score = (e / e.sum(1, keepdims=True))[np.arange(len(texts)), best]
        second = np.partition(loss, 1, 1)[:, 1] if len(self.langs) > 1 else loss[:, 0] + 9
        unsure = second - loss.min(1) < 0.25
        return [(self.langs[k], float(s), bool(u)) if h else ("und", 0.0, False) for k, s, u, h in zip(best.tolist(), score.tolist(), unsure.tolist(), has.tolist(), strict=True)]


def fit(labelled: DataFrame) -> Model:
    counts: dict[str, np.ndarray] = {}
    for r in train_counts(labelled.where(F.col("lang").isNotNull())).toLocalIterator():
        counts.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
        if len(counts) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _parts(texts):
                lang, score, unsure = zip(*sent.value.predict(texts[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, ambiguous boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out).select("lang", "text"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
