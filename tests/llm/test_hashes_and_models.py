import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rasterflow.llm import bpe, common, language, near_dedup, pretokens, suffix_dedup, token_counts, token_files, toxicity

from .conftest import make
from .test_text_ops import LOWER, digest, groups, removed

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def thue_morse(n, one, zero):
    return "".join(one if bin(k).count("1") % 2 else zero for k in range(n))


TWINS = [thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")]


def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark):
    for codec, path in ((bpe.Codec(BYTE), BYTE), (token_files.Encoder(WORD), WORD)):
        library = Tokenizer.from_file(path)
        ids, n = codec.encode(TWINS)
        want = [library.encode(t, add_special_tokens=False).ids for t in TWINS]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    docs = make(spark, [(k, t, None) for k, t in enumerate(TWINS)])
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {0, 1}
    long = [(k, t * 3, None) for k, t in enumerate(TWINS)]
    assert digest(suffix_dedup.removed_spans(make(spark, long))) == sorted(removed([r[:2] for r in long]), key=str)
    library = Tokenizer.from_file(WORD)
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORD).collect()}
    assert found == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(TWINS)}


def test_strings_decide_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(pretokens, "range_sums", lambda symbols, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts, library = ["one two six ten two", "four five nine a b two c one", "", "six a"], Tokenizer.from_file(BYTE)
    codec = bpe.Codec(BYTE)
    for _ in range(2):
        ids, n = codec.encode(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_range_hashes_are_the_polynomials(monkeypatch):
    base, data = common.draw_base(), np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    monkeypatch.setattr(common.RangeHash, "STEP", 700)
    hashed = common.RangeHash(data, base)
    for s, e in ((0, 10), (5, 1000), (77, 77), (699, 702), (0, 5000)):
        want = sum((v + 1) * pow(base, k, common.PRIME) for k, v in enumerate(data[s:e].tolist())) % common.PRIME
        assert int(hashed.of(np.array([s]), np.array([e]))[0]) == want


def test_components_of_paths_stars_and_chance(spark):
    random.seed(1)
    order = random.sample(range(300), 300)
    star = [(max(k, 150), min(k, 150)) for k in range(300) if k != 150]
    for edges in ([(k + 1, k) for k in range(120)], [(max(a, b), min(a, b)) for a, b in zip(order, order[1:])], star, [tuple(sorted(random.sample(range(300), 2), reverse=True)) for _ in range(140)]):
        parent = {x: x for e in edges for x in e}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        found = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
        assert found == {x: root(x) for x in parent if root(x) != x}
        u, v = near_dedup._contract(*map(np.array, zip(*edges)))
        assert dict(zip(u.tolist(), v.tolist())) == found


def test_large_region_over_several_arrow_batches(spark, monkeypatch):
    random.seed(31)
    shared = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(shared + [f"d{k}x{j}" for j in range(random.randint(0, 24))])) for k in range(420)]
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        found = sorted((tuple(r) for r in near_dedup.near_duplicates(make(spark, [(*r, None) for r in rows])).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == sorted(groups(rows), key=str)


def test_texts_that_moved_between_scans_are_fetched(spark):
    docs = near_dedup.fixed_scan(make(spark, [(k, f"text {k}", None) for k in range(40)] + [(None, "n", None)]).repartition(4))
    wanted = spark.createDataFrame([(k, 3 - k % 4) for k in range(0, 40, 3)], "node long, pid int")
    found = near_dedup._texts(docs, wanted, common.fresh_dir(spark, "moved"))
    assert {(r.node, r.text) for r in found.collect()} == {(k, f"text {k}") for k in range(0, 40, 3)}


@pytest.mark.parametrize("hot", [60, 1000])
def test_counts_with_hot_pretokens(spark, odd_docs, odd_rows, hot, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 4)
    frequent = token_counts.frequent(odd_docs, WORD, hot)
    assert len(frequent) <= hot and (frequent or hot < 1000)
    library = Tokenizer.from_file(WORD)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    found = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd_docs, WORD, hot=hot).collect()), key=str)
    assert found == sorted(((i, n(t)) for i, t, _ in odd_rows), key=str)


def test_texts_beyond_a_block(spark):
    """Texts that fill several blocks: word counts, tokens, shared windows and links as brute force has them."""
    random.seed(37)
    words = [f"long{k}" for k in range(9000)]
    big = " ".join(random.choice(words) for _ in range(170_000))
    assert len(big) > common.BLOCK_BYTES
    rows = [(1, big, None), (2, big + " tail", None), (3, "short " + big[5000:5200], None)]
    docs, library = make(spark, rows), Tokenizer.from_file(WORD)
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORD).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t, _ in rows}
    ids = {r.doc_id: r.ids_sha256 for r in bpe.encode_digests(docs, BYTE).collect()}
    library = Tokenizer.from_file(BYTE)
    assert ids == {i: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t, _ in rows}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    spans = {r.doc_id: [(s.from_byte, s.to_byte) for s in r.spans] for r in suffix_dedup.removed_spans(docs).collect()}
    assert spans[1] == [] and spans[2] == [(0, len(big))] and spans[3][0][0] in (5, 6) and spans[3][-1][1] == len(rows[2][1])


def brute_model(texts, labels):
    """Feature scores as the docstring of toxicity states them, with plain counters."""
    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")

    def features(t):
        out = set()
        for w in pattern.findall(t.translate(LOWER).encode()):
            out |= {(w[:k], k) for k in toxicity.PREFIXES if len(w) > k} | {(w, 0)}
        return out

    own = {i: features(t or "") for i, t in texts}
    toxic, other, corpus = Counter(), Counter(), Counter()
    for i, f in own.items():
        corpus.update(f)
        if labels.get(i) is not None:
            (toxic if labels[i] else other).update(f)
    many = [sum(labels.get(i) == k for i in own) for k in (1, 0)]
    kept = {}
    for f, n in toxic.items():
        a = toxicity.PRIOR * corpus[f] / len(own)
        one = math.log((n + a) / max(many[0] + toxicity.PRIOR - n - a, 0.5))
        two = math.log((other[f] + a) / max(many[1] + toxicity.PRIOR - other[f] - a, 0.5))
        z = (one - two) / math.sqrt(1 / (n + a) + 1 / (other[f] + a))
        if n >= toxicity.LEAST_COUNT and z >= toxicity.LEAST_Z and one - two >= toxicity.LEAST_ODDS:
            kept[f] = one - two
    return kept


def test_toxicity_model_against_plain_counters(spark):
    random.seed(41)
    calm, bad = [f"calm{k}" for k in range(80)], ["vileone", "vilewording", "snarlish", "snarl"]
    texts, labels = [], {}
    for k in range(500):
        words = [random.choice(calm) for _ in range(random.randint(5, 40))]
        if k % 4 == 0 or random.random() < 0.03:
            at = random.randrange(len(words))
            words[at:at] = random.choices(bad, k=3)
        texts.append((k, " ".join(words)))
        if k % 3:
            labels[k] = int(k % 4 == 0)
    model = toxicity.fit(make(spark, [(*t, None) for t in texts]), spark.createDataFrame([(k, v) for k, v in labels.items()], "doc_id long, toxic int"))
    want = brute_model(texts, labels)
    assert want and sorted(model.scores.tolist()) == pytest.approx(sorted(want.values()))
    # word scores by longest kept feature, lambda by its equation, K by its estimate, all from plain loops
    levels = [0, *reversed(toxicity.PREFIXES)]

    def scores(t):
        out = []
        for w in t.encode().split():
            keys = [(w if k == 0 else w[:k], k) for k in levels if k == 0 or len(w) > k]
            out.append(next((want[x] for x in keys if x in want), 0.0) - model.drift)
        return out

    ground = [scores(t) for i, t in texts if labels.get(i) == 0]
    every = [s for g in ground for s in g]
    assert sum(math.exp(model.rate * s) for s in every) / len(every) == pytest.approx(1, abs=1e-6)

    def best(s):
        top = now = 0.0
        for x in s:
            now = max(now + x, 0.0)
            top = max(top, now)
        return top

    assert model.scale == pytest.approx(len(ground) / sum(len(g) * math.exp(-model.rate * best(g)) for g in ground))
    found = {r.doc_id: r for r in toxicity.score_documents(make(spark, [(*t, None) for t in texts]), model).collect()}
    for i, t in texts:
        up = np.array([k for k, x in enumerate(scores(t)) if x > 0], np.int64)
        own = toxicity.segments(np.array([scores(t)[k] for k in up]), up, model.drift)
        x = model.evidence(len(t.split()), [s[0] for s in own])
        assert found[i].evidence == pytest.approx(x) and found[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.offset))))


def test_language_decoding_against_plain_loops(spark):
    random.seed(43)
    texts = {"aa": "the sun and the sea", "bb": "le soleil et la mer", "cc": "die sonne und das meer"}
    rows = [(k, " ".join(random.sample(texts[g].split(), 4)), g) for k in range(60) for g in [random.choice(list(texts))]]
    model = language.fit(make(spark, rows).select("lang", "text"))
    counts = {g: sum(language.ngram_counts([t for _, t, x in rows if x == g])[0].astype(float)) for g in texts}
    share = {g: (c + 0.5) / (c.sum() + 0.5 * language.BUCKETS) for g, c in counts.items()}
    code = language.codewords(3)
    got = model.predict([t for _, t, _ in rows])
    for (_, t, _), (lang, score, _) in zip(rows, got, strict=True):
        n = language.ngram_counts([t])[0][0].astype(float)
        losses = []
        for row in range(3):
            loss = 0.0
            for j in range(code.shape[1]):
                sides = [[share[g] for g, bit in zip(sorted(texts), code[:, j]) if bit == side] for side in (1, -1)]
                ratio = np.log(np.mean(sides[0], 0)) - np.log(np.mean(sides[1], 0)) if all(sides) else np.zeros(language.BUCKETS)
                margin = 3 * ((n @ ratio) / n.sum() - model.centre[j]) / model.spread[j]
                loss += model.weight[j] * math.log1p(math.exp(-margin * code[row, j]))
            losses.append(loss)
        assert lang == sorted(texts)[int(np.argmin(losses))]
        e = np.exp(-2 * (np.array(losses) - min(losses)))
        assert score == pytest.approx(1 / e.sum(), rel=1e-3)


def test_special_strings_of_several_kinds(tmp_path):
    import json

    spec = json.load(open(BYTE, encoding="utf-8"))
    more = {**spec["added_tokens"][0], "content": "<|mark|>", "id": 50257}
    spec["added_tokens"].append(more)
    path = str(tmp_path / "two.json")
    json.dump(spec, open(path, "w"))
    texts, library = ["a<|mark|>b<|endoftext|>", "<|endoftext|><|mark|> c", "none <|mark"], Tokenizer.from_file(path)
    ids, n = bpe.Codec(path).encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert pa.array(ids).null_count == 0
