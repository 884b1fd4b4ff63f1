import hashlib
import math
import random
import re



import numpy as np
import pyarrow as pa
import pytest

from rasterflow.llm import decontamination as deco
from rasterflow.llm import language, near_dedup, suffix_dedup, toxicity

from .conftest import make

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def hits(docs, items, width=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pattern.findall((t or "").translate(LOWER))
    windows = {}
    for n, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(n))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    found |= windows[tuple(w[k : k + size])]
                    hit |= set(range(k, k + size))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_windows_against_brute_force(spark, part_bytes):
    random.seed(3)
    vocabulary = ["a", "b", "Ab", "é9", "zz", "the"]
    text = lambda n: random.choice([" ", "-", "\n"]).join(random.choice(vocabulary) for _ in range(n)) + random.choice(["", "."])
    docs = [(1, None), (2, ""), (3, " !! "), (None, "a b"), *[(k, text(random.randint(0, 80))) for k in range(4, 60)], (60, "zz the zz"), (60, "zz the zz")]
    items = [(k, text(random.choice([0, 1, 3, 9, 10, 14]))) for k in range(9)] + [(None, "zz"), (77, None)]
    found = deco.contamination(make(spark, [(i, t, None) for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes).collect()
    want = [(i, n, k, [x for x in own if x != "None"]) for i, n, k, own in hits(docs, items)]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=str) == sorted(want, key=str)


def test_decontamination_of_nothing(spark, no_docs, odd_docs, odd_rows):
    items = spark.createDataFrame([], "item_id long, text string")
    assert deco.contamination(no_docs, items).count() == 0
    assert {r.n_hit for r in deco.contamination(odd_docs, items).collect()} == {0}
    some = spark.createDataFrame([(1, "own start")], "item_id long, text string")
    kept = deco.clean_documents(odd_docs, some)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows) - 1


def test_suffix_order():
    random.seed(5)
    for n in (0, 1, 2, 3, 4, 5, 8, 20, 50, 200):
        for letters in (1, 2, 4, 200):
            for _ in range(6):
                t = [random.randint(1, letters) for _ in range(n)]
                got = suffix_dedup.suffix_order(np.array(t, np.int64), 10**6).tolist() if n else []
                assert got == sorted(range(n), key=lambda i: t[i:])


def removed(rows):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        b, k = (t or "").encode(), math.inf if i is None else i
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], math.inf), k)
    for i, t in order:
        b, k = (t or "").encode(), math.inf if i is None else i
        mask = [0] * len(b)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < k:
                mask[s : s + 50] = [1] * 50
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), sum(mask), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), hashlib.sha256(kept).hexdigest()))
    return out


def digest(found):
    return sorted(((r.doc_id, r.n_bytes, sum(s.to_byte - s.from_byte for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect()), key=str)


def test_repeats_against_brute_force(spark, odd_docs, odd_rows, monkeypatch):
    assert digest(suffix_dedup.removed_spans(odd_docs)) == sorted(removed([r[:2] for r in odd_rows]), key=str)
    random.seed(7)
    base = "".join(random.choice("abcdé ") for _ in range(900))
    rows = []
    for k in range(80):
        parts = [base[a : a + random.randint(30, 160)] if random.random() < 0.7 else "".join(random.choice("xyz") for _ in range(60)) for a in (random.randint(0, 700) for _ in range(random.randint(1, 5)))]
        rows.append((random.randint(0, 60), "".join(parts)))
    rows += [(100, "ab" * 200), (101, "ab" * 150), (102, "ba" * 90)]
    want = sorted(removed(rows), key=str)
    docs = make(spark, [(*r, None) for r in rows]).repartition(3)
    assert digest(suffix_dedup.removed_spans(docs)) == want
    # runs combined a few at a time, and every repeated anchor taken for a hot one
    for name, value in (("HELD", 200), ("HOT", 1), ("SORTED", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert digest(suffix_dedup.removed_spans(docs)) == want


@pytest.mark.parametrize("tasks", [2, 8])  # the passage's edges are hot in each task, or only over all
def test_hot_passage_is_spread_over_buckets(spark, tasks):
    random.seed(23)
    letters = lambda n, of="abcdefghijklmnop ": "".join(random.choice(of) for _ in range(n))
    passage = letters(300)
    # ends of few letters, so that some windows over the passage's edges repeat and most don't
    rows = [(k, letters(60) + letters(3, "xy") + passage + letters(3, "xy") + letters(60)) for k in range(500)]
    docs = make(spark, [(*r, None) for r in rows]).repartition(tasks)
    n, base = 16, suffix_dedup.draw_base()
    stable = suffix_dedup.fixed_scan(docs)
    folder = suffix_dedup.fresh_dir(spark, "hot")
    kinds = "bucket int, pid int, kind int, blob binary"
    sent = stable.mapInArrow(lambda it: suffix_dedup._rows(suffix_dedup._anchor_rows(it, n, base), suffix_dedup._NAMES, suffix_dedup._KINDS), kinds)
    side_kinds = [pa.int32(), pa.int32(), pa.binary()]
    suffix_dedup.write_side(sent.repartitionById(n, "bucket").mapInArrow(lambda it: suffix_dedup._rows(suffix_dedup._by_anchor(it), ["pid", "kind", "blob"], side_kinds), suffix_dedup.SIDE), folder)
    dealt = stable.mapInArrow(lambda it: suffix_dedup._rows(suffix_dedup._contexts(it, folder, n, base), suffix_dedup._NAMES, suffix_dedup._KINDS), kinds)
    sizes = [r[0] for r in dealt.selectExpr("bucket", "length(blob) as size").groupBy("bucket").sum("size").select("sum(size)").collect()]
    assert len(sizes) == n and max(sizes) <= 2 * sum(sizes) / n
    assert digest(suffix_dedup.removed_spans(docs)) == sorted(removed(rows), key=str)


def test_drop_repeats_keeps_rows_and_columns(spark, odd_docs, odd_rows, no_docs):
    out = suffix_dedup.drop_repeats(odd_docs)
    assert out.dtypes == odd_docs.dtypes
    rows = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert len(rows) <= len(odd_rows) and (1, odd_rows[0][1], len(odd_rows[0][1])) in rows and (2, "", 0) in rows and (4, None, None) in rows
    assert suffix_dedup.removed_spans(no_docs).count() == 0 and suffix_dedup.drop_repeats(no_docs).count() == 0


def groups(rows):
    sets, parent = [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = rows[a][0] == rows[b][0]
            if None not in (rows[a][0], rows[b][0]) and (same or (both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both))):
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                parent[y] = x
    out = []
    for k, (i, _) in enumerate(rows):
        least = None if i is None else min(rows[m][0] for m in range(len(rows)) if rows[m][0] is not None and find(m) == find(k))
        out.append((i, len(sets[k]), least, i is None or i == least))
    return out


def test_near_duplicates_against_brute_force(spark, odd_docs, odd_rows):
    found = lambda d: sorted((tuple(r) for r in near_dedup.near_duplicates(d).collect()), key=str)
    assert found(odd_docs) == sorted(groups([r[:2] for r in odd_rows]), key=str)
    random.seed(11)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = random.sample(words, random.randint(5, 90))
        for _ in range(random.randint(1, 14)):
            w = list(base)
            for _ in range(random.randint(0, 5)):
                w[random.randrange(len(w))] = random.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    assert found(make(spark, [(*r, None) for r in rows])) == sorted(groups(rows), key=str)


def test_dense_region_is_searched_whole(spark, monkeypatch):
    random.seed(13)
    shared = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(shared + [f"d{k}x{j}" for j in range(random.randint(0, 24))])) for k in range(160)]
    monkeypatch.setattr(near_dedup, "BLOCK", 80)
    found = sorted((tuple(r) for r in near_dedup.near_duplicates(make(spark, [(*r, None) for r in rows])).collect()), key=str)
    assert found == sorted(groups(rows), key=str)


@pytest.mark.parametrize("rest", [1, 5, 100, 600])
def test_region_over_several_batches_stays_open(rest, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 128)
    regions = [3] * 4 + [5] * (600 + rest) + [7] * 700 + [9] * 20
    rng = np.random.default_rng(2)
    sketch = [x.tobytes() for x in rng.integers(0, 256, (len(regions), near_dedup.TREES * near_dedup.SLOTS), np.uint8)]
    nodes = np.arange(len(regions))
    every = pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), pa.array([b""] * len(regions)), pa.array(nodes), pa.array(np.full(len(regions), 9)), pa.array(sketch)], ["region", "slots", "node", "n", "sketch"])
    cuts = [0, 604, 604 + rest, 604 + rest + 650, len(regions)]
    open_rows = {(b.column(3)[k].as_py(), b.column(1)[k].as_py()) for b in near_dedup._neighbours(iter([every.slice(x, y - x) for x, y in zip(cuts, cuts[1:])])) for k in range(b.num_rows) if b.column(0)[k].as_py() == 1}
    for region in (5, 7):
        assert {n for r, n in open_rows if r == region} == {k for k, r in enumerate(regions) if r == region}


def test_one_document_of_each_group_stays(odd_docs, no_docs):
    out = near_dedup.keep_representatives(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 2
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_maximal_segments():
    def brute(s):
        found = []

        def cut(a, b):
            sums = [0]
            for x in s[a:b]:
                sums.append(sums[-1] + x)
            best = max(((sums[j] - sums[i], i - j, a + i, a + j) for i in range(len(sums)) for j in range(i + 1, len(sums))), default=(0, 0, 0, 0))
            if best[0] > 1e-12:
                _, _, i, j = best
                cut(a, i)
                found.append((round(best[0], 9), i, j))
                cut(j, b)

        cut(0, len(s))
        return found

    random.seed(17)
    for _ in range(200):
        s = [random.choice([-0.5, -0.5, 1.3, 0.7, 2.1]) for _ in range(random.randint(0, 14))]
        up = np.array([k for k, x in enumerate(s) if x > 0], np.int64)
        got = toxicity.segments(np.array([s[k] for k in up]), up, 0.5)
        assert [(round(x, 9), a, b) for x, a, b in got] == brute(s)


def test_evidence_is_the_best_sum_over_every_number_of_segments():
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0))
    model.rate, model.scale = 1.0, 0.1

    def brute(n, sums):
        base, best = math.log(model.scale * n), -20.0
        for r in range(1, len(sums) + 1):
            best = max(best, sum(model.rate * s - base for s in sorted(sums)[-r:]) + math.log(math.factorial(r)))
        return min(best, 60.0)

    random.seed(29)
    assert model.evidence(20_000, []) == -20
    assert 31 < model.evidence(20_000, [5.0] * 60) < 33
    for count in (1, 2, 7, 49, 60, 130):
        for _ in range(20):
            sums = [random.uniform(0, 6.5) for _ in range(count)]
            assert model.evidence(20_000, sums) == pytest.approx(brute(20_000, sums))


def test_toxicity_learns_and_names_passages(spark, no_docs):
    random.seed(19)
    calm, bad = [f"calm{k}" for k in range(60)], ["vileone", "vileword", "viletalk"]
    rows, labels = [], []
    for k in range(400):
        words = [random.choice(calm) for _ in range(random.randint(5, 60))]
        if k % 4 == 0:
            at = random.randrange(len(words))
            words[at:at] = random.choices(bad, k=4)
        rows.append((k, " ".join(words), "en"))
        labels.append((k, k % 5, int(k % 4 == 0)))
    rows += [(900, None, None), (901, "", None), (None, "vileone vileword viletalk vileone", None), (902, "Some VILEONE vilesort, viletalk here vileone", None)]
    docs = make(spark, rows)
    table = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table.where(~toxicity.held_out(table.doc_id)))
    found = {r.doc_id: r for r in toxicity.score_documents(docs, model, 0.5).collect()}
    assert all((found[k].score >= 0.5) == (k % 4 == 0) for k in range(400))
    assert found[900].score == found[901].score < 0.5 <= found[None].score
    (p,) = found[902].passages
    assert rows[-1][1][p.from_byte : p.to_byte] == "VILEONE vilesort, viletalk here vileone"
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 302
    assert toxicity.score_documents(no_docs, model).count() == 0
    blank = toxicity.fit(no_docs, table.where("toxic = 5"))
    assert max(r.score for r in toxicity.score_documents(docs, blank).collect()) < 1e-9


def test_language_codes():
    for k in (2, 3, 5, 7, 12, 40):
        code = language.codewords(k)
        gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(gaps) >= (1 if k == 2 else 2 if k <= 7 else language.least_distance(k)) and set(np.unique(code)) <= {-1, 1}
    assert [language.least_distance(k) for k in (8, 16, 40, 512)] == [6, 7, 9, 12]


def test_languages_held_out(spark, no_docs, odd_docs):
    random.seed(23)
    syllables = {"en": ["the", "ing", "and", "th"], "fr": ["eau", "oir", "ment", "que"], "de": ["sch", "ung", "ein", "lich"], "es": ["ción", "ado", "ñor", "los"]}
    text = lambda g: " ".join("".join(random.choices(syllables[g], k=random.randint(1, 3))) for _ in range(random.randint(8, 40)))
    rows = [(k, text(g), g) for k, g in enumerate(random.choices(list(syllables), k=240))] + [(500, None, "en"), (501, "12 !", "fr"), (502, "", None)]
    docs = make(spark, rows)
    model = language.fit(docs.where("doc_id % 3 <> 0 or doc_id >= 500").select("lang", "text"))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(found[i].lang_pred == g and 0 < found[i].score <= 1 for i, _, g in rows[:240])
    assert {found[i].lang_pred for i in (500, 501, 502)} == {"und"}
    assert language.identify(no_docs, model).count() == 0
    nothing = language.fit(no_docs.select("lang", "text"))
    assert {r.lang_pred for r in language.identify(odd_docs, nothing).collect()} == {"und"}


def test_blocks_cover_everything():
    from rasterflow.llm.common import byte_blocks

    texts = ["a" * n for n in (0, 5, 900, 0, 3, 2000, 1)]
    parts = list(byte_blocks(pa.array(texts), 1000))
    assert [i for a, b, *_ in parts for i in range(a, b)] == list(range(7))
    assert [bytes(d[x:y]).decode() for _, _, d, at in parts for x, y in zip(at[:-1], at[1:], strict=True)] == texts
