"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A wrapper is a tree. Each element's content is a sequence of groups, and each group holds elements or text slots: what some
instances lack is optional, what comes again is repeated. A page's token stream is aligned with the wrapper of the pages
before it: a tag or text that the wrapper doesn't have is added as an optional group, one that comes again makes its group
repeated, and one that comes in another order folds the groups between into a single repeated group of optional members.
So every name occurs once in a sequence, and a wrapper is as large as the host's templates, however many pages it has.

Wrappers are inferred where pages are read, merged over tasks by host, and sent back to the tasks that hold the host's pages.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, small_batches, table, tidy
from .partitions import fixed_scan, side, write_side

#: A slot that has no more than FIXED_TEXTS texts, each TEMPLATE_PAGES times on average, is part of the template.
TEMPLATE_PAGES, FIXED_TEXTS = 8, 4
#: Share of a slot group's letters within links from which it is a menu.
LINK_SHARE = 0.8
#: Partial wrappers of a host are merged in so many lots first.
LOTS = 64

_TOKEN = re.compile(r"""<!--(?P<comment>)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<junk>[!?/])|<(?P<cut>[A-Za-z])""")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_words = lambda text: frozenset(text.split())

_RAW = _words("script style xmp iframe noembed noframes noscript textarea title template")
_VOID = _words("area base br col embed hr img input link meta param source track wbr")
_INLINE = _words("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr")
_CLOSES_P = _words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul")
#: A start tag ends an open element of these names, looked for up to the given boundary.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Elements that never hold main text.
_TAGS_OUT = _words("nav aside footer form head button select dialog menu svg canvas audio video object datalist")
#: Words in class names, ids and roles of elements that don't hold main text.
_NAMES_OUT = _words(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip "
    "footer header masthead copyright contentinfo complementary sidebar aside widget widgets related recommended popular trending notice notices cookie cookies consent gdpr popup modal overlay alert dialog "
    "disclaimer paywall newsletter subscribe subscription signup login share sharing social follow comment comments disqus respond reply replies discussion feedback form search"
)
_COMMENTS = _words("comment comments disqus respond reply replies discussion")
_NOT_NAMED = _words("has with no without is not")


def host_of(url: str | None) -> str:
    """The host of a URL, lower-cased, without user and port; empty if there is none."""
    found = re.match(r"\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _key(name: str, attrs: str) -> str:
    """An element's name with its class, id and role, numbers in them left out; ``!`` marks hidden ones."""
    if not attrs or attrs.isspace():
        return name
    out = []
    for which, value in _ATTR.findall(attrs):
        which, value = which.lower(), value.strip("\"'")
        if which in ("class", "id", "role"):
            out += [re.sub(r"\d+", "", x) for x in value.split()]
        elif which == "hidden" or (which == "aria-hidden" and value.lower() == "true") or (which == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            out.append("!")
    return " ".join([name, *out])


def _named_out(key: str) -> frozenset:
    """Words by which an element's class names, id or role keep it out of main text."""
    hits = set()
    for name in key.split(" ")[1:]:
        parts = [x.lower() for x in _PIECE.findall(name)]
        if name == "!":
            hits.add("!")
        elif parts and parts[0] not in _NOT_NAMED:
            hits.update(_NAMES_OUT.intersection(parts))
    return frozenset(hits)


_OUT: dict[str, frozenset] = {}


def _out(key: str) -> frozenset:
    found = _OUT.get(key)
    if found is None:
        if len(_OUT) > 50_000:
            _OUT.clear()
        found = _OUT[key] = _named_out(key)
    return found


def tokens(page: str):
    """("<", key), (">", name), ("text", text, in a link) and ("break",) as a page has them, character references decoded.

    Comments, declarations, scripts, styles and other raw elements give nothing; what is never closed goes to the page's end."""
    at, link, n = 0, 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else n]
        if text:
            yield "text", html.unescape(text), link > 0
        if not found or found["cut"]:
            return
        at = found.end()
        if found["comment"] is not None:
            at = page.find("-->", found.start() + 2)
            at = n if at < 0 else at + 3
        elif found["junk"]:
            at = page.find(">", at)
            at = n if at < 0 else at + 1
        elif found["name"]:
            name = found["name"].lower()
            if found["close"]:
                link = max(0, link - 1) if name == "a" else link
                yield ">", name
            elif name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                at = at or n
            elif name in _VOID or name in ("br", "hr"):
                yield ("break", name != "br") if name in ("br", "hr") else ("text", " ", False)
            else:
                link += name == "a"
                key = _key(name, found["attrs"])
                if name not in _INLINE or _out(key):
                    yield "<", key
    return


class Node:
    """An element or text slot of a wrapper: n instances, their letters (also those in links), and a slot's texts (digests), None if they are many."""

    __slots__ = ("n", "chars", "links", "const", "groups", "where", "kids", "seen")

    def __init__(self):
        self.n, self.chars, self.links, self.const = 0, 0, 0, set()
        self.groups: list[list] = []  # [repeated, names], in order
        self.where: dict[str, int] = {}  # name to group
        self.kids: dict[str, Node] = {}
        self.seen: dict[str, int] = {}  # instances that have the name; fewer than n: optional

    def _index(self, start: int) -> None:
        for k in range(start, len(self.groups)):
            for name in self.groups[k][1]:
                self.where[name] = k

    def insert(self, k: int, repeated: bool, names: list[str]) -> None:
        self.groups.insert(k, [repeated, names])
        self._index(k)

    def fold(self, first: int, last: int, repeated: bool = True, more=()) -> None:
        """Groups first to last become one, with more names at its end."""
        if last > first or more or (repeated and not self.groups[first][0]):
            names = [name for group in self.groups[first : last + 1] for name in group[1]]
            self.groups[first : last + 1] = [[repeated or any(g[0] for g in self.groups[first : last + 1]), [*names, *more]]]
            self._index(first)

    def fixed(self, pages: int = 1) -> bool:
        return self.const is not None and self.n >= pages * len(self.const) > 0

    def text(self, value: str, linked: bool) -> None:
        if self.const is not None:
            self.const.add(hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32])
            self.const = self.const if len(self.const) <= FIXED_TEXTS else None
        self.n += 1
        self.chars += len(value)
        self.links += len(value) if linked else 0


class Frame:
    """An open element's place in the wrapper."""

    __slots__ = ("key", "tag", "node", "at", "there")

    def __init__(self, key: str, node: Node):
        self.key, self.tag, self.node, self.at, self.there = key, key.split(" ", 1)[0], node, -1, set()

    def child(self, key: str) -> Node:
        """The wrapper's node for a child that comes next; the wrapper is changed where it doesn't fit."""
        node = self.node
        group = node.where.get(key)
        if group is None:
            group = self.at + 1
            node.insert(group, False, [key])
            node.kids[key], node.seen[key] = Node(), 0
        elif group < self.at:
            node.fold(group, self.at)
        elif group == self.at and key in self.there:
            node.groups[group][0] = True
        self.at = group
        if key not in self.there:
            self.there.add(key)
            node.seen[key] += 1
        return node.kids[key]


def _events(page: str):
    """Tokens with end tags supplied: ("open", key, tag), ("close",), ("text", text, in a link), ("break",)."""
    stack, there = [], Counter()

    def position(names, bounds=()):
        if not any(there[x] for x in names):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                return k
            if stack[k] in bounds:
                return -1
        return -1

    for token in tokens(page):
        kind = token[0]
        if kind == "<":
            tag = token[1].split(" ", 1)[0]
            at = position(*_SIBLINGS[tag]) if tag in _SIBLINGS else position(("p",), ("td", "th", "li", "article", "section", "div")) if tag in _CLOSES_P else -1
            while 0 <= at < len(stack):
                there[stack.pop()] -= 1
                yield ("close",)
            stack.append(tag)
            there[tag] += 1
            yield "open", token[1], tag
        elif kind == ">":
            at = position((token[1],)) if token[1] not in ("html", "body") else -1
            while 0 <= at < len(stack):
                there[stack.pop()] -= 1
                yield ("close",)
        else:
            yield token


def align(root: Node, page: str) -> None:
    """Aligns a page with a wrapper, in place."""
    root.n += 1
    frames = [Frame("", root)]
    for event in _events(page):
        if event[0] == "open":
            node = frames[-1].child(event[1])
            node.n += 1
            frames.append(Frame(event[1], node))
        elif event[0] == "close":
            frames.pop()
        elif event[0] == "text":
            value = " ".join(event[1].split())
            if value:
                frames[-1].child("#").text(value, event[2])


def merge(one: Node, other: Node) -> Node:
    """Aligns two wrappers; the second is used up."""
    pairs = [(one, other)]
    while pairs:
        a, b = pairs.pop()
        a.n, a.chars, a.links = a.n + b.n, a.chars + b.chars, a.links + b.links
        both = None if a.const is None or b.const is None else a.const | b.const
        a.const = None if both is None or len(both) > FIXED_TEXTS else both
        at = -1
        for repeated, names in b.groups:
            mine = [a.where[x] for x in names if x in a.where]
            new = [x for x in names if x not in a.where]
            if not mine:
                at += 1
                a.insert(at, repeated, new)
            else:
                first, last = min(mine), max(mine)
                if first < at:
                    a.fold(first, max(last, at), True, new)
                else:
                    a.fold(first, last, repeated or last > first or len(names) > 1, new)
                at = first
            for name in names:
                a.seen[name] = a.seen.get(name, 0) + b.seen[name]
                if name in a.kids:
                    pairs.append((a.kids[name], b.kids[name]))
                else:
                    a.kids[name] = b.kids[name]
    return one


def dumps(root: Node) -> bytes:
    rows, todo = [], [(root, -1, "", 0)]
    while todo:
        node, up, name, seen = todo.pop()
        rows.append([up, name, seen, node.n, node.chars, node.links, None if node.const is None else sorted(node.const), node.groups])
        todo += [(kid, len(rows) - 1, key, node.seen[key]) for key, kid in node.kids.items()]
    return zlib.compress(json.dumps(rows, ensure_ascii=True).encode(), 1)


def loads(blob: bytes) -> Node:
    nodes = []
    for up, name, seen, n, chars, links, const, groups in json.loads(zlib.decompress(blob)):
        node = Node()
        node.n, node.chars, node.links, node.const, node.groups = n, chars, links, None if const is None else set(const), groups
        node._index(0)
        if up >= 0:
            nodes[up].kids[name], nodes[up].seen[name] = node, seen
        nodes.append(node)
    return nodes[0]


def expression(root: Node) -> str:
    """The wrapper as a regular expression over tags; ``#`` is a text slot, ``"#"`` a text that never changes."""
    out, todo = [], [root]
    while todo:
        step = todo.pop()
        if isinstance(step, str):
            out.append(step)
            continue
        parts = []
        for repeated, names in step.groups:
            inner = []
            for name in names:
                kid, mark = step.kids[name], "?" if step.seen[name] < step.n else ""
                inner += ['"#"' + mark if kid.fixed() else "#" + mark] if name == "#" else [("(" if mark else "") + f"<{name}>", kid, f"</{name.split(' ')[0]}>" + (")?" if mark else "")]
            parts += ["(", *inner, ")+"] if repeated else inner
        todo += parts[::-1]
    return "".join(out)


class Judge:
    """What of a wrapper is main text: by the names of elements, by text that never changes, by menus of links."""

    MAIN, OUT, BODY = 2, 0, 1

    def __init__(self, root: Node):
        self.root = root
        self.holds = set()  # nodes with an article or main element below
        order, todo = [], [(root, None, "")]
        while todo:
            node, up, key = todo.pop()
            order.append((node, up, key))
            todo += [(kid, node, name) for name, kid in node.kids.items() if name != "#"]
        for node, up, key in reversed(order):
            is_main = key.split(" ", 1)[0] in ("article", "main") and not _COMMENTS & _out(key)
            if up is not None and (is_main or id(node) in self.holds):
                self.holds.add(id(up))
        self.state = {}
        for node, up, key in order:
            self.state[id(node)] = self._state(node, self.state[id(up)] if up is not None else self.BODY, key)

    def _state(self, node: Node, above: int, key: str) -> int:
        tag = key.split(" ", 1)[0]
        if above == self.OUT or tag in _TAGS_OUT:
            return self.OUT
        if tag in ("article", "main"):
            return self.OUT if _COMMENTS & _out(key) else self.MAIN
        if tag in ("", "html", "body"):
            return above
        held = id(node) in self.holds
        if tag == "header" and above == self.BODY and not held:
            return self.OUT
        words = _out(key) - ({"header"} if above == self.MAIN else set())
        if words and not held:
            return self.OUT
        return above

    def menu(self, node: Node) -> bool:
        """Lists of links."""
        slots = [kid for kid in node.kids.values()]
        chars = sum(k.chars for k in slots)
        return chars > 0 and sum(k.links for k in slots) >= LINK_SHARE * chars

    def text(self, page: str) -> str:
        """A page's main text: that of article and main elements, or else what isn't kept out of the body."""
        blocks: dict[int, list[str]] = {self.MAIN: [], self.BODY: []}
        fixed: list[str] = []
        buffers: dict[int, list[str]] = {self.MAIN: [], self.BODY: []}
        constant: list[bool] = []

        def flush():
            for state, buffer in buffers.items():
                block = " ".join("".join(buffer).split())
                if block and state == self.BODY:
                    fixed.append(block)  # in page order, template or not
                    if not all(constant):
                        blocks[state].append(block)
                elif block:
                    blocks[state].append(block)
                buffer.clear()
            constant.clear()

        stack, state = [(self.root, "")], [self.state[id(self.root)]]
        for event in _events(page):
            if event[0] == "open":
                tag = event[2]
                if tag not in _INLINE:
                    flush()
                node = stack[-1][0].kids[event[1]]
                stack.append((node, tag))
                state.append(self.state[id(node)])
            elif event[0] == "close":
                if stack[-1][1] not in _INLINE:
                    flush()
                stack.pop()
                state.pop()
            elif event[0] == "break":
                if event[1]:
                    flush()
                elif state[-1] != self.OUT:
                    buffers[state[-1]].append(" ")
            elif state[-1] != self.OUT:
                buffers[state[-1]].append(event[1])
                if state[-1] == self.BODY and event[1].strip():
                    node = stack[-1][0]
                    constant.append(node.kids["#"].fixed(TEMPLATE_PAGES) or (stack[-1][1] in ("li", "ul", "ol", "td", "div") and self.menu(node)))
        flush()
        return "\n".join(blocks[self.MAIN] or blocks[self.BODY] or fixed)


_PART_DDL = "pid int, host string, blob binary"
_PART = pa.schema([("pid", pa.int32()), ("host", pa.string()), ("blob", pa.binary())])


def _inferred(batches):
    """The wrappers of a task's hosts."""
    pid, roots = TaskContext.get().partitionId(), {}
    for batch in batches:
        for url, page in zip(batch.column("url").to_pylist(), batch.column("text").to_pylist(), strict=True):
            align(roots.setdefault(host_of(url), Node()), page or "")
    out = [{"pid": pid, "host": host, "blob": dumps(root)} for host, root in roots.items()]
    for k in range(0, len(out), 256):
        yield pa.RecordBatch.from_pylist(out[k : k + 256], _PART)


def _merged(batches):
    """One wrapper of each host from those that come one after the other."""
    host, root, out = None, None, []
    for batch in batches:
        for name, blob in zip(batch.column("host").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if root is not None and name == host:
                root = merge(root, loads(blob))
                continue
            if root is not None:
                out.append({"pid": 0, "host": host, "blob": dumps(root)})
            host, root = name, loads(blob)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, _PART)
                out = []
    if root is not None:
        out.append({"pid": 0, "host": host, "blob": dumps(root)})
    yield pa.RecordBatch.from_pylist(out, _PART)


def wrappers(parts: DataFrame) -> DataFrame:
    """host and blob from partial wrappers (pid, host, blob): merged in lots by task number, then by host, in the order of tasks.

    A host with a third of all pages has a part for each task that reads some, never more."""
    lots = parts.withColumn("lot", F.col("pid") % LOTS).repartition("host", "lot").sortWithinPartitions("host", "lot", "pid")
    return lots.mapInArrow(tidy(_merged), _PART_DDL).repartition("host").sortWithinPartitions("host", "blob").mapInArrow(tidy(_merged), _PART_DDL).select("host", "blob")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html), by the wrapper of the page's host.

    Null html is an empty page; pages without a host share a wrapper; rows that repeat keep a row each; texts of any length are
    handled whole, and depth of nesting is no bound. A page without main text has an empty one. Other columns are left out.
    The order in which pages are aligned doesn't change which names a wrapper has, nor their counts, so results don't depend on it."""
    spark = pages.sparkSession
    scan = fixed_scan(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url"), F.col("url").cast("string").alias("url"))
    folder = fresh_dir(spark, "wrappers")
    with small_batches(spark):
        scan.mapInArrow(tidy(_inferred), _PART_DDL).write.parquet(f"{folder}/parts")
    parts = spark.read.schema(_PART_DDL).parquet(f"{folder}/parts")
    write_side(parts.select("pid", "host").join(wrappers(parts), "host").select("pid", "host", "blob"), f"{folder}/by_task")

    def run(batches):
        judges = {}
        for batch in batches:
            if batch.num_rows and not judges:
                judges = dict(side([f"{folder}/by_task"], TaskContext.get().partitionId(), ("host", "blob")))
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                out = []
                for url, page in zip(rows.column("url").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    judge = judges[host_of(url)]
                    if isinstance(judge, bytes):
                        judge = judges[host_of(url)] = Judge(loads(judge))
                    out.append(judge.text(page or "").encode("utf-8", "replace").decode())
                text = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("url"), text, pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return scan.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
