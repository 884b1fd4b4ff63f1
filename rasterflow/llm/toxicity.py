"""Toxic passages by maximum-scoring segment search.

Learning. Features of a word are the whole word and its prefixes of some byte lengths. A feature's score is
its log-odds between labelled toxic and other documents under an informative Dirichlet prior whose
weights are the feature's frequency in the whole corpus, kept where it stands out (z score). A word scores as
its longest kept feature, less a drift, so words without evidence count slightly against a passage.

Searching. One left-to-right scan finds all maximal scoring segments of a text. Their significance follows the
extreme-value law of segment scores: over n words of background, the best score exceeds s with probability
1 - exp(-K n exp(-lambda s)); lambda solves the background's moment equation and K fits the labelled documents
that aren't toxic. A document's evidence is the best sum of its r best segments so normalised, over every r, and
held within -20 (also that of no segment) and 60, so that far values don't tilt the fit; a logistic curve
fitted to the labelled rows turns evidence into the score, 0.5 and more being toxic.

Bounds: at most ``label_rows`` labelled rows are learned from (a hash of doc_id chooses); a kind and an evidence of each
reach the driver, and the features that stand out in them, which are what tasks are sent. Counts, z scores and
the extreme-value law's sums are aggregated by Spark; corpus frequencies count all documents. A bit table of fixed size, in
which candidates are looked up before their exact join, keeps other features from being shuffled.

Null or word-less text has no passage and scores as an empty one; very long texts are scanned whole; labels with null
doc_id or null toxic aren't learned, repeated labels count as toxic if one is; null or repeated doc_ids keep a row each;
features with equal counts are kept or left alike; without labels of both kinds, or without evidence in any of them,
every score is 0; an empty table gives no rows; further columns are ignored by ``score_documents`` and returned unchanged by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_blocks, checkpoint, crc_mod, mix64, range_sums, table, tidy

PREFIXES = (5, 6, 7, 8)
#: Weight of the Dirichlet prior in documents; least z score, log-odds and number of toxic documents of a kept feature; what a word without evidence costs.
PRIOR, LEAST_Z, LEAST_ODDS, LEAST_COUNT, DRIFT = 200.0, 4.0, 1.5, 6, 0.35
LABEL_ROWS = 200_000
#: Bits of the table in which candidate features are looked up.
TABLE_BITS = 23
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of a block of texts: starts, ends (bytes) and the text each lies in; hashes of features."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        low = _LOWER[data]
        # Latin-1 capitals: second byte 80..9E after C3, but for the multiplication sign
        upper = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[upper] += 32
        word = _WORD[low]
        start, stop = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        start[cut] = word[cut]
        stop[cut - 1] = word[cut - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.before = np.searchsorted(self.starts, at)
        self._symbols = _SYMBOL[low]

    def features(self):
        """(words that have it, hash) for each level, short prefixes first, whole words last."""
        length = self.ends - self.starts
        for level in PREFIXES:
            own = np.flatnonzero(length > level)
            yield own, self._hash(self.starts[own], self.starts[own] + level, level)
        yield np.arange(len(length)), self._hash(self.starts, self.ends, 0)

    def _hash(self, start, end, level):
        return (range_sums(self._symbols, start, end) + np.uint64(level)).view(np.int64)


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of keys are there, their places)."""
    slot = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    hit = sorted_keys[slot] == keys if len(sorted_keys) else np.zeros(len(keys), bool)
    return hit, slot


def segments(scores: np.ndarray, places: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, end word); scores at places are positive, words between count -drift each."""
    found: list[list] = []  # [sum before, sum after, first, end]
    total, at = 0.0, 0
    for s, p in zip(scores.tolist(), places.tolist(), strict=True):
        total -= drift * (p - at)
        new = [total, total + s, p, p + 1]
        total, at = total + s, p + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= new[1]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(r - left, a, b) for left, r, a, b, _ in found]


class Model:
    """Feature scores, extreme-value parameters and the logistic curve."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray, drift: float = DRIFT):
        order = np.argsort(keys)
        self.keys, self.scores, self.drift = keys[order], scores[order], drift
        self.rate, self.scale, self.slope, self.offset = 1.0, 1.0, 0.0, -40.0

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score, place of its feature or -1) of each word."""
        out, feature = np.full(len(words.starts), -self.drift), np.full(len(words.starts), -1)
        for own, keys in words.features():
            hit, slot = _found(self.keys, keys)
            out[own[hit]] = self.scores[slot[hit]] - self.drift
            feature[own[hit]] = slot[hit]
        return out, feature

    def passages(self, data: np.ndarray, at: np.ndarray):
        """(words, segments, features of words with positive scores) of each text of a block."""
        words = Words(data, at)
        scores, feature = self.word_scores(words)
        up = np.flatnonzero(scores > 0)
        cuts = np.searchsorted(up, words.before)
        for k in range(len(at) - 1):
            own = up[cuts[k] : cuts[k + 1]]
            n, first = int(words.before[k + 1] - words.before[k]), int(words.before[k])
            yield n, (segments(scores[own], own - first, self.drift) if len(own) else []), feature[own], words, first

    def evidence(self, n: int, sums: list[float]) -> float:
        """The best of the normalised sums of the r best segments."""
        if not sums:
            return -20.0
        # the sum isn't unimodal in r: many moderate segments may fall before they rise
        falling = -np.sort(-np.asarray(sums, float))
        steps = self.rate * falling - math.log(self.scale * max(n, 1)) + np.log(np.arange(1, len(sums) + 1))
        return max(-20.0, min(float(np.cumsum(steps).max()), 60.0))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))

    def find_rate(self, words: int, ups: np.ndarray, counts: np.ndarray) -> None:
        """lambda: among words of background, of which counts score ups (positive) and all others -drift, exp(lambda * score) means 1."""
        many = counts.sum()
        if not 0 < many < words:
            return
        value = lambda x: ((words - many) * math.exp(-x * self.drift) + (counts * np.exp(x * ups)).sum()) / words - 1
        low, high = 1e-3, 1.0
        while value(high) < 0 and high < 64:
            high *= 2
        if value(low) < 0:
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if value(mid) < 0 else (low, mid)
            self.rate = low

    def find_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """Two-parameter logistic regression of y on evidence x by Newton steps, on standardised evidence, with a slight ridge."""
        if not len(y) or y.min() == y.max() or x.min() == x.max():
            return
        mean, spread = x.mean(), max(x.std(), 1e-6)
        z, w = np.stack([(x - mean) / spread, np.ones(len(x))], 1), np.zeros(2)
        cost = lambda w: float(np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 5e-3 * w @ w)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * w)
            while cost(w + step) > cost(w) and np.abs(step).max() > 1e-9:  # full steps overshoot where the curve is flat
                step /= 2
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = w[0] / spread, w[1] - w[0] * mean / spread


def _slots(features: np.ndarray) -> np.ndarray:
    return (mix64(features.view(np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _count(labelled: DataFrame, table=None) -> DataFrame:
    """(kind, feature, n): documents of a kind (1 toxic, 0 other, -1 unlabelled) that have a feature; feature null counts documents.

    With table, a broadcast of bits, only features whose bit is set."""

    def run(batches):
        found: list[tuple[np.ndarray, ...]] = []
        totals: dict[int, int] = {}
        size = 0

        def added():
            kind, feature, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((feature, kind))
            kind, feature, n = kind[order], feature[order], n[order]
            head = np.flatnonzero(np.concatenate([[True], (feature[1:] != feature[:-1]) | (kind[1:] != kind[:-1])]))
            return kind[head], feature[head], np.add.reduceat(n, head)

        def sent(kind, feature, n):
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(feature, pa.int64()), pa.array(n, pa.int64())], ["kind", "feature", "n"])

        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, at in byte_blocks(batch.column(1)):
                words = Words(data, at)
                text_of = np.repeat(np.arange(b - a), np.diff(words.before))
                for k, n in zip(*[x.tolist() for x in np.unique(kinds[a:b], return_counts=True)], strict=True):
                    totals[k] = totals.get(k, 0) + n
                for own, feature in words.features():
                    text = text_of[own]
                    if table is not None:
                        hit = table.value[_slots(feature)]
                        text, feature = text[hit], feature[hit]
                    order = np.lexsort((feature, text))
                    text, feature = text[order], feature[order]
                    once = np.ones(len(text), bool)
                    once[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
                    if once.any():
                        found.append((kinds[a:b][text[once]], feature[once], np.ones(int(once.sum()), np.int64)))
                        size += len(found[-1][0])
            if size > 500_000:
                found = [added()]
                size = len(found[0][0])
                if size > 300_000:
                    yield sent(*found.pop())
                    size = 0
        if found:
            yield sent(*added())
        if totals:
            yield sent(list(totals), [None] * len(totals), list(totals.values()))

    return labelled.select("kind", "text").mapInArrow(tidy(run), "kind int, feature long, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n"))


def _bits(candidates: DataFrame):
    """A table of 2 ** TABLE_BITS bits with those of the candidate features set."""

    def run(batches):
        out = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            out[_slots(batch.column(0).to_numpy())] = True
        words = np.packbits(out, bitorder="little").view(np.int64)
        place = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(words[place])], ["place", "bits"])

    words = np.zeros((1 << TABLE_BITS) // 64, np.int64)
    for r in candidates.select("feature").mapInArrow(tidy(run), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).collect():  # of fixed size
        words[r.place] = r.bits
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _standing_out(toxic, other, corpus, totals):
    """Columns (log-odds, z) of features from the numbers of toxic, other and all documents that have them; totals: all documents of each."""
    alpha = PRIOR * F.greatest(corpus, F.lit(1)) / max(totals[2], 1)
    one = F.log((toxic + alpha) / F.greatest(totals[0] + PRIOR - toxic - alpha, F.lit(0.5)))
    two = F.log((other + alpha) / F.greatest(totals[1] + PRIOR - other - alpha, F.lit(0.5)))
    return one - two, (one - two) / F.sqrt(1 / (toxic + alpha) + 1 / (other + alpha))


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> Model:
    """Learns from the labelled rows (doc_id, toxic) and the documents' texts."""
    sc = docs.sparkSession.sparkContext
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("kind")).dropna().groupBy("doc_id").agg(F.max("kind").alias("kind"))
    total = clean.count()
    if total > label_rows:
        clean = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.98 * label_rows / total)).limit(label_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(clean), "doc_id").select("kind", "text")  # label_rows narrow rows at most
    candidates = checkpoint(_count(labelled.where("kind = 1")).where(F.col("feature").isNotNull() & (F.col("n") >= LEAST_COUNT)).select("feature"))
    everything = texts.join(F.broadcast(clean), "doc_id", "left").select(F.coalesce("kind", F.lit(-1)).cast("int").alias("kind"), "text")
    counted = checkpoint(_count(everything, sc.broadcast(_bits(candidates))))
    by_kind = {r.kind: r.n for r in counted.where("feature is null").collect()}  # three rows
    totals = (by_kind.get(1, 0), by_kind.get(0, 0), sum(by_kind.values()))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    sums = counted.join(candidates, "feature").groupBy("feature").agg(of(1).alias("toxic"), of(0).alias("other"), F.sum("n").alias("corpus"))
    delta, z = _standing_out(F.col("toxic"), F.col("other"), F.col("corpus"), totals)
    # with many documents even slight differences stand out, so both bounds count
    kept = sums.select("feature", delta.alias("delta"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_ODDS)).collect()
    model = Model(np.array([r.feature for r in kept], np.int64), np.array([r.delta for r in kept], float))
    sent = sc.broadcast(model)

    def rate(batches):
        for batch in batches:
            kinds = batch.column(0)
            for a, b, data, at in byte_blocks(batch.column(1)):
                rows = [(n, [s[0] for s in own], up.tolist()) for n, own, up, _, _ in sent.value.passages(data, at)]
                n, scores, ups = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([kinds.slice(a, b - a).cast(pa.int32()), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(ups, pa.list_(pa.int32()))], ["kind", "n", "sums", "ups"])

    rated = checkpoint(labelled.mapInArrow(tidy(rate), "kind int, n long, sums array<double>, ups array<int>"))
    ground = rated.where("kind = 0")
    hits = ground.select(F.explode("ups").alias("up")).groupBy("up").count().collect()  # a row per kept feature at most
    counts = np.zeros(len(model.keys))
    for r in hits:
        counts[r.up] = r["count"]
    size = ground.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    model.find_rate(size.words, model.scores - model.drift, counts)
    if 0 < counts.sum() < size.words:
        weight = ground.agg(F.sum(F.col("n") * F.exp(-model.rate * F.coalesce(F.array_max("sums"), F.lit(0.0))))).first()[0]
        model.scale = max(size.documents / max(weight, 1e-9), 1e-9)
    fitted = sc.broadcast(model)

    def weigh(batches):
        for batch in batches:
            found = [fitted.value.evidence(n, own) for n, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["kind", "x"])

    points = sorted(map(tuple, rated.select("kind", "n", "sums").mapInArrow(tidy(weigh), "kind int, x double").collect()))  # two numbers a labelled row
    model.find_curve(np.array([x for _, x in points]), np.array([float(k > 0) for k, _ in points]))
    return model


def score_documents(docs: DataFrame, model: Model, significant: float = 0.05) -> DataFrame:
    """doc_id, score, evidence and passages: from_byte, to_byte, score and e_value of each segment that chance gives fewer than significant times in such a text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches):
        own = sent.value
        for batch in batches:
            for a, b, data, at in byte_blocks(batch.column(1)):
                score, evidence, found = [], [], []
                for k, (n, segs, _, words, first) in enumerate(own.passages(data, at)):
                    x = own.evidence(n, [s[0] for s in segs])
                    evidence.append(x)
                    score.append(own.score(x))
                    rows = [{"from_byte": int(words.starts[first + p] - at[k]), "to_byte": int(words.ends[first + q - 1] - at[k]), "score": s, "e_value": own.scale * n * math.exp(-own.rate * s)} for s, p, q in segs]
                    found.append([r for r in rows if r["e_value"] < significant])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array(evidence), pa.array(found, pa.list_(passage))], ["doc_id", "score", "evidence", "passages"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double, evidence double, passages array<struct<from_byte:long,to_byte:long,score:double,e_value:double>>")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score below least, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for texts in batches:
            out = []
            for _, _, data, at in byte_blocks(texts):
                out += [sent.value.score(sent.value.evidence(n, [s[0] for s in segs])) < least for n, segs, *_ in sent.value.passages(data, at)]
            yield pa.array(out, pa.bool_())

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(judge)(texts)

    return docs.where(clean(F.col("text").cast("string")))


def held_out(id_column):
    return F.coalesce(crc_mod(id_column, 5) == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), "evidence")
