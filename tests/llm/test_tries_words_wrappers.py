"""The prefix trie, spelling variants and wrappers against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from rasterflow.llm import prefix_trie, spelling, wrappers
from rasterflow.llm.common import checkpoint, table

TURNS = "conv_id long, turn long, role string, text string, depth long, owner string, turns string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r.encode(), hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    turns = {c: [t[4:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    members, kids, leaves, saved = collections.defaultdict(list), collections.Counter(), collections.Counter(), collections.Counter()
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids.update(p[:-1] for p in members if p)
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * words
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def trie(spark, rows, shard_turns=10**6):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], TURNS)
    found = prefix_trie.prefix_nodes(prefix_trie.rebuilt(checkpoint(prefix_trie.turns_of(df))), shard_turns).collect()
    assert [len(r) for r in found] == [8] * len(found)
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in found)


@pytest.mark.parametrize("shard_turns", [3, 10**6])
def test_trie_equals_brute_force(spark, shard_turns):
    """Nulls, ties in turn, repeated rows, negative ids, turnless and equal conversations, over few and many shards."""
    rng, rows = random.Random(3), []
    for c in [*range(-5, 70), None]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a b", "c", "", None, "d e f"])))
    rows += rows[:5]
    assert trie(spark, rows, shard_turns) == brute_trie(rows)


def test_trie_of_hot_and_long_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 900, 3) for t in range(3)] + [(5001, t, "user", f"turn {t} " * 50) for t in range(2000)] + [(5002, 0, "user", "x" * 200_000)]
    assert trie(spark, rows, 300) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, [(None, 1, "user", "x")]) == [] == trie(spark, [])


def test_double_array_packs_and_steps():
    rng = np.random.default_rng(4)
    seqs = sorted({tuple(rng.integers(1, 9, rng.integers(0, 6)).tolist()) for _ in range(300)})
    lengths = np.array([len(s) for s in seqs])
    codes, starts = np.array([x for s in seqs for x in s], np.int64), np.cumsum(lengths) - lengths
    trie = prefix_trie.packed(codes, starts, lengths)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert (trie.check[: trie.end] >= 0).sum() == len(prefixes)
    reached = {}
    for p in sorted(prefixes, key=len):
        reached[p] = int(trie.step(np.array([reached[p[:-1]]]), np.array([p[-1]]))[0]) if p else 0
        assert reached[p] >= 0
        for c in range(1, 10):
            assert (trie.step(np.array([reached[p]]), np.array([c]))[0] >= 0) == ((*p, c) in prefixes)
    assert len(set(reached.values())) == len(prefixes)


def brute_variants(words):
    near, holes = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in holes.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.mark.parametrize(("letters", "count", "large", "rows"), [("abcé÷z", 2500, 10**5, 2 * 10**5), ("abcé÷z", 2500, 50, 60), ("ab", 500, 40, 50), ("abcdefghijklmnopqrstuvwxyzéà", 4000, 10**5, 1000)])
def test_variants_equal_brute_force(spark, letters, count, large, rows):
    """Ties in frequency, groups that are halved in a task and over tasks, one-letter alphabets, very long words."""
    rng, words = random.Random(5), {}
    for _ in range(count):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        words[w] = rng.choice([3, 4, 5, 7, 12, 30, 100])
        if rng.random() < 0.5:
            k = rng.randrange(len(w))
            words[w[:k] + rng.choice(letters) + w[k:]] = rng.choice([3, 9, 50])
    words |= {"q" * 300: 5, "q" * 299: 11, "q" * 150 + "a" + "q" * 149: 3}
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), large, rows).collect()
    assert len(found) == len(words)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == brute_variants(words)


def test_word_counts_equal_brute_force(spark, odd_rows, odd_docs):
    rows = odd_rows * 3
    counts = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    docs = odd_docs.union(odd_docs).union(odd_docs)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want
    assert want


def test_no_words(spark, no_docs):
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0


def test_signatures_meet_within_two_places():
    rng, words = random.Random(9), []
    for _ in range(400):
        w = [rng.choice("abcdeé") for _ in range(rng.randint(1, 8))]
        other = w.copy()
        rng.choice([lambda: other.pop(), lambda: other.append("z"), lambda: other.__setitem__(0, "y")])()
        rng.shuffle(other)
        words += ["".join(w), "".join(other) or "z"]
    import pyarrow as pa

    for n1, n2 in ((1, 5), (2, 4), (3, 1)):
        got = spelling.PartEnum(np.arange(256), 2, n1, n2).of(spelling.Words(pa.array(words)), np.arange(len(words)))
        assert (got[::2] == got[1::2]).any(axis=1).all()


class Article(HTMLParser):
    """What stands in article elements, by another parser."""

    BLOCKS = {"p", "h1", "article", "div", "li", "ul"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks, self.buffer = False, [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        block = " ".join("".join(self.buffer).split())
        self.buffer = []
        self.blocks += [block] if block else []

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag == "br":
            self.buffer.append(" ")
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.buffer.append(data)


def test_main_text_equals_another_parser(spark, sf_dir):
    got = {r.page_id: r for r in wrappers.op12_main_text(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = "\n".join(Article(r.html or "").blocks)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-banner">We use cookies</div><nav><a href=x>m</a></nav>
<div class="content"><h2>Head &amp; line</h2><p>First <b>bold</b> text&nbsp;here<br>next.<div class="advert">Buy</div><p>Second<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><pre> a
 b </pre><form>name <input></form><span class="share-buttons">Share</span></div><aside>side</aside><section id="comments"><article class="comment">nice</article></section><footer>foot</footer><script>if (a<b) {}</script><p style="display:none">hid</p></body></html>"""


def texts(spark, rows):
    found = wrappers.main_text(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")).collect()
    assert all(r.n_chars == len(r.text) for r in found)
    return sorted(((r.page_id, r.url, r.text) for r in found), key=str)


def test_boilerplate_by_names_and_odd_pages(spark):
    long = "<p>word " * 60_000
    rows = [(1, "http://a/x", PAGE), (2, None, None), (3, "", ""), (4, "http://b", "<"), (5, "http://b", "a < b"), (6, "http://b", '<p "'), (7, "http://b", "<script>x"), (8, "http://b", "<!-- x"), (9, "http://c", "<div>" * 3000 + "x")]
    rows += [(10, "http://d", '<div class="ad">q<article><p>real</article>'), (11, "http://e", "&#0;&eacute;&#x41"), (11, "http://e", "&#0;&eacute;&#x41"), (None, "http://f", "<p>no id"), (12, "http://g", long), (13, "http://b", "<a" * 50_000)]
    want = ["Head & line\nFirst bold text here next.\nSecond\none\ntwo\nc1\nc2\na b", "", "", "<", "a < b", "", "", "", "x", "real", "�éA", "�éA", "no id", "\n".join(["word"] * 60_000), ""]
    assert texts(spark, rows) == sorted(((r[0], r[1], t) for r, t in zip(rows, want, strict=True)), key=str)
    assert texts(spark, []) == []


def test_slots_that_never_change_and_menus_are_left_out(spark):
    page = "<div><p>Welcome to our site</p><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><h2>About {0}</h2><p>Story {0} goes on.</p><p>And ends {0}.</p></div><p>All rights reserved</p></div>"
    rows = [(k, "http://News.example/x", page.format(k)) for k in range(12)]
    assert texts(spark, rows) == sorted(((k, u, f"About {k}\nStory {k} goes on.\nAnd ends {k}.") for k, u, _ in rows), key=str)
    alone = rows[:1]  # on one page nothing is known to be fixed
    assert texts(spark, alone)[0][2].startswith("Welcome to our site\nAbout 0")


def test_wrapper_expression_and_merge():
    pages = ["<h1>a</h1><p>1</p><p>2</p>", "<h1>b</h1><div class=note5>same</div><p>1</p>", "<h1>c</h1><div class=note7>same</div><ul><li>x</ul><p>z</p><ul><li>y</ul>"]
    root = wrappers.Node()
    for page in pages:
        wrappers.align(root, page)
    assert wrappers.expression(root) == '<h1>"#"</h1>(<div note>"#"</div>)?((<ul><li>"#"</li></ul>)?<p>"#"</p>)+'

    def facts(node):
        return node.n, node.chars, node.links, None if node.const is None else sorted(node.const), sorted((k, node.seen[k], facts(v)) for k, v in node.kids.items())

    for order in itertools.permutations(pages):
        merged = wrappers.Node()
        for page in order:
            one = wrappers.Node()
            wrappers.align(one, page)
            merged = wrappers.merge(merged, wrappers.loads(wrappers.dumps(one)))
        assert facts(merged) == facts(root)
        assert '<p>"#"</p>' in wrappers.expression(merged)
