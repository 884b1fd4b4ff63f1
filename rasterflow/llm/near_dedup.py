"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal sets of 5-word shingles are one node from the start. A node's signature is cut into trees; each
tree orders all nodes by its slots, so nodes with long common prefixes are neighbours. Regions, the runs that share at
least ``DEPTH`` slots, supply candidates: all pairs of small regions, and of larger ones the sorted
order in blocks, where neighbours share ever more slots, so the depth adapts to how dense a region is. A pair
must pass a check of the whole signatures with wide margin, then the exact test on the texts' full sets.

Where a region has more promising pairs than a few per node, a spanning part of them is tested first.
Such regions, and those cut into blocks, stay open: once components are known, all promising pairs between
different components of an open region are tested as well, in cells of bounded size, so nothing is given up. Nodes of
the region's largest component stand in one row of cells each; only the others are copied.

Components come from star contractions; tasks contract the links that they confirm before any exchange. Null or word-less texts have
no shingle and link with nothing; rows with null doc_id link with nothing and are kept (component null); rows with the
same doc_id are one document (linked if any of them is); an empty table gives no row; very long texts are hashed whole;
further columns are ignored by ``near_duplicates`` and returned unchanged by ``keep_representatives``. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_blocks, checkpoint, fresh_dir, mix64, ragged, range_sums, small_batches, table, tidy
from .partitions import fixed_scan, side, write_side

WORDS, PERCENT = 5, 75
TREES, SLOTS, DEPTH = 12, 8, 2
#: Nodes of a block or cell, and of a region whose pairs are all tested at once.
BLOCK, SMALL = 1024, 8
#: Edges that a task contracts at a time.
STARS = 500_000
#: Equal signature slots (of TREES * SLOTS, compared in 8 bits) that a pair needs: 4.5 deviations below similarity 0.75.
LEAST_EQUAL = 53
#: Slots of the finer sketch that decides which pairs of open regions are tested, and equal ones needed: 4.5 deviations as well.
FINE, LEAST_FINE = 512, 340
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after the other, offsets)."""
    data = _LOWER[data]
    word = _WORD[data]
    start, stop = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    start[cut] = word[cut]
    stop[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    before = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    tokens = range_sums(_SYMBOL[data], starts, ends)
    n = np.diff(before)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = ragged(before[:-1], count)
    text = np.repeat(np.arange(len(n)), count)
    last = np.minimum(first + words, before[1:][text])
    hashes = np.zeros(len(first), np.uint64)
    for k in range(words):  # as a chain, so that order counts; places beyond a short text add nothing
        there = first + k < last
        hashes = np.where(there, mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + tokens[np.minimum(first + k, len(tokens) - 1)]), hashes)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[once], text[once]
    return hashes, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, at: np.ndarray, n: int = TREES * SLOTS) -> np.ndarray:
    """MinHash signatures (texts x n, unsigned 32 bits); zeros for empty sets."""
    out = np.zeros((len(at) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        odd = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        add = mix64(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32))  # a slot is the same in signatures of any length
        for k in range(n):
            value = hashes * odd[k] + add[k]
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            out[full, k] = np.minimum.reduceat(value, at[full]) >> np.uint64(32)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id (from a fixed scan), n_shingles, two 64-bit keys of the set, signature, scan partition."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for batch in batches:
            for a, b, data, at in byte_blocks(batch.column(1)):
                hashes, cuts = shingles(data, at)
                sums = np.append(np.uint64(0), np.cumsum(mix64(hashes)))[cuts]
                more = np.append(np.uint64(0), np.cumsum(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))))[cuts]
                one, two = (np.diff(x).view(np.int64) for x in (sums, more))
                sig = signatures(hashes, cuts)
                wide = 4 * sig.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, (b - a + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(sig.astype(">u4").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(cuts)), pa.array(one), pa.array(two), packed, pa.array(np.full(b - a, pid, np.int32))], ["doc_id", "n_shingles", "key", "more", "sig", "pid"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, key long, more long, sig binary, pid int")


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), width)


def forest_rows(nodes: DataFrame) -> DataFrame:
    """A row per node and tree: region (hash of tree and first slots), the slots in order, the whole signature in 8 bits."""

    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column(2), TREES * SLOTS, ">u4")
            low = np.ascontiguousarray((sig & 0xFF).astype(np.uint8))
            sketch = pa.array([x.tobytes() for x in low])
            for t in range(TREES):
                own = np.ascontiguousarray(sig[:, t * SLOTS : (t + 1) * SLOTS])
                yield pa.RecordBatch.from_arrays([pa.array(_region(t, own)), pa.array([x.tobytes() for x in own[:, DEPTH:]]), batch.column(0), batch.column(1), sketch], ["region", "slots", "node", "n", "sketch"])

    return nodes.select("node", "n", "sig").mapInArrow(tidy(run), "region long, slots binary, node long, n long, sketch binary")


def _promising(a, b, n, sketch):
    """Which of the pairs (a, b) may reach the similarity."""
    ok = PERCENT * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b])
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(ok)
    for k in range(0, len(at), 50_000):
        o = at[k : k + 50_000]
        out[o] = (sketch[a[o]] == sketch[b[o]]).sum(1) >= LEAST_EQUAL
    return out


def _equal(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal slots of every left and right node."""
    out = np.zeros((len(left), len(right)), np.uint8)
    for k in range(left.shape[1]):
        out += left[:, k, None] == right[None, :, k]
    return out


def _block_pairs(n: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a block to test first, and whether these are all promising ones."""
    same = _equal(sketch, sketch)
    good = (same >= LEAST_EQUAL) & (PERCENT * np.maximum.outer(n, n) <= 100 * np.minimum.outer(n, n))
    np.fill_diagonal(good, False)
    a, b = np.nonzero(np.triu(good))
    if len(a) <= 3 * len(n):
        return a, b, True
    # each node's best partner, and a forest that spans what hangs together, from the best-connected nodes on
    best = np.where(good, same, 0).argmax(1)
    has = np.flatnonzero(good.any(1))
    first, second = [has], [best[has]]
    new = good.any(1)
    for root in np.argsort(-good.sum(1), kind="stable"):
        queue = [root] if new[root] else []
        new[root] = False
        while queue:
            x = queue.pop()
            found = np.flatnonzero(good[x] & new)
            new[found] = False
            queue += found.tolist()
            first.append(np.full(len(found), x))
            second.append(found)
    return np.concatenate(first), np.concatenate(second), False


_PAIRS = "kind int, a long, b long, region long, n long, sketch binary"


def _pair_batch(a, b):
    low, high = np.minimum(a, b), np.maximum(a, b)
    keep = low != high
    low, high = low[keep], high[keep]
    k = len(low)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(low), pa.array(high), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], ["kind", "a", "b", "region", "n", "sketch"])


def _open_batch(region, node, n, sketch):
    k = len(node)
    return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(node), pa.nulls(k, pa.int64()), pa.array(region), pa.array(n), pa.array([x.tobytes() for x in sketch], pa.binary())], ["kind", "a", "b", "region", "n", "sketch"])


def _neighbours(batches):
    """Candidate pairs of sorted forest rows (kind 0) and the rows of open regions (kind 1)."""
    carry = None
    first_region = None
    parted: set = set()  # the region whose earlier rows were judged before
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4), TREES * SLOTS, np.uint8)]
        if carry is not None:
            rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
        region = rows[0]
        if first_region is None:
            first_region = region[0]
        cut = int(np.searchsorted(region, region[-1]))  # the last region may go on
        large = len(region) - cut > 4 * BLOCK
        if large:
            cut = len(region)  # a large one goes on in blocks of its own and stays open, however little of it is left
        carry = [x[cut:] for x in rows] if cut < len(region) else None
        if cut:
            yield from _regions(*[x[:cut] for x in rows], {first_region, region[-1], *parted})
        if large:
            parted = {region[-1]}
    if carry is not None:
        yield from _regions(*carry, {first_region, carry[0][0], *parted})


def _regions(region, node, n, sketch, edges):
    head = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    size = np.diff(np.append(head, len(region)))
    few = (size > 1) & (size <= SMALL)
    if few.any():
        starts, sizes = head[few], size[few]
        first = ragged(starts, sizes)
        ends = np.repeat(starts + sizes, sizes)
        a = np.repeat(first, ends - first - 1)
        b = ragged(first + 1, ends - first - 1)
        good = _promising(a, b, n, sketch)
        if good.any():
            yield _pair_batch(node[a[good]], node[b[good]])
    for s, m in zip(head[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        whole = m <= BLOCK
        # blocks overlap, so that neighbours in the order meet
        for x in range(s, s + m, BLOCK - 64):
            y = min(s + m, x + BLOCK)
            a, b, all_pairs = _block_pairs(n[x:y], sketch[x:y])
            whole &= all_pairs
            if len(a):
                yield _pair_batch(node[x:y][a], node[x:y][b])
            if y == s + m:
                break
        if not whole and region[s] not in edges:
            yield _open_batch(region[s : s + m], node[s : s + m], n[s : s + m], sketch[s : s + m])
    # regions at a task's ends may go on in another task
    for e in edges:
        x, y = np.searchsorted(region, [e, e + 1] if e < (1 << 63) - 1 else [e, e])
        if y > x:
            yield _open_batch(region[x:y], node[x:y], n[x:y], sketch[x:y])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough, contracted to stars (u, v) by task; texts: node, text."""

    def run(batches):
        held = []
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            step = 128
            for k in range(0, batch.num_rows, step):
                sets = []
                for column in (left, right):
                    part = column.slice(k, step)
                    hashes, cuts = [], [np.zeros(1, np.int64)]
                    for _, _, data, at in byte_blocks(part):
                        h, c = shingles(data, at)
                        cuts.append(cuts[-1][-1] + c[1:])
                        hashes.append(h)
                    sets.append((np.concatenate(hashes), np.concatenate(cuts)))
                (h, c), (g, d) = sets
                rows = len(c) - 1
                n, m = np.diff(c), np.diff(d)
                # a hash that both sets of a row have stands twice in the sorted union
                row = np.concatenate([np.repeat(np.arange(rows), n), np.repeat(np.arange(rows), m)])
                every = np.concatenate([h, g])
                order = np.lexsort((every, row))
                every, row = every[order], row[order]
                both = np.bincount(row[1:][(every[1:] == every[:-1]) & (row[1:] == row[:-1])], minlength=rows)
                keep[k : k + step] = (100 * both >= PERCENT * (n + m - both)) & (both > 0)
            held.append((a.to_numpy()[keep], b.to_numpy()[keep]))
            if sum(len(x) for x, _ in held) > STARS:
                held = [_contract(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > STARS // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _contract(*map(np.concatenate, zip(*held, strict=True))))), ["u", "v"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(tidy(run), "u long, v long")


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node it hangs together with) for edges (a, b); least nodes have none."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            own = np.flatnonzero(parent != np.arange(len(nodes)))
            return nodes[own], nodes[parent[own]]
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def components(stars: DataFrame) -> DataFrame:
    """node, component (its least member) for the nodes of edges (u, v), u > v.

    Rounds of two steps: a node's lower neighbours, and itself, hang on the least of them; then every node hangs on what its
    lower neighbour hangs on. A component's centre is only ever looked up, so its rows are those of a join that adaptive execution can split."""
    now = stars
    while True:
        low = now.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        one = low.select("u", F.col("m").alias("v")).unionByName(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        one = checkpoint(one)
        least = checkpoint(one.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("high")))
        moved = checkpoint(one.join(least.select(F.col("u").alias("v"), F.col("v").alias("to")), "v", "left"))
        if moved.where("to is not null").isEmpty() and least.where("v < high").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = moved.select("u", F.coalesce("to", "v").alias("v"))


def _fine_sketches(texts: DataFrame) -> DataFrame:
    """node, fine (a longer signature in 8 bits) and regions (the node's region in each tree)."""

    def run(batches):
        for batch in batches:
            for a, b, data, at in byte_blocks(batch.column(1)):
                sig = signatures(*shingles(data, at), FINE)
                low = (sig & 0xFF).astype(np.uint8)
                regions = np.stack([_region(t, sig[:, t * SLOTS :]) for t in range(TREES)], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() for x in regions], pa.binary())], ["node", "fine", "regions"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, fine binary, regions binary").dropDuplicates(["node"])


def _region(tree: int, slots: np.ndarray) -> np.ndarray:
    """The region of nodes in a tree: a hash of the tree and the first slots there."""
    region = np.full(len(slots), tree + 1, np.uint64)
    for k in range(DEPTH):
        region = mix64(region * np.uint64(0x9E3779B97F4A7C15) + slots[:, k].astype(np.uint64))
    return region.view(np.int64)


def _cross_pairs(rows: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """All promising pairs of open regions' rows whose components differ, found in cells of bounded size.

    One end of such a pair lies outside the region's largest component. So nodes are dealt to parts and, again,
    those outside to groups; the cell of a part and a group holds some BLOCK nodes of either."""
    own = rows.select("region", F.col("a").alias("node"), "n", "sketch").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = own.groupBy("region", "component").agg(F.count("*").alias("k"))
    mixed = checkpoint(sizes.groupBy("region").agg(F.sum("k").alias("size"), F.max(F.struct("k", "component")).alias("top")).where("size > top.k"))
    cells = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    left = checkpoint(own.join(mixed.select("region", cells(F.col("size")).alias("parts"), cells(F.col("size") - F.col("top.k")).alias("groups"), F.col("top.component").alias("top")), "region"))
    dealt = left.join(_fine_sketches(texts.join(left.select("node").distinct(), "node", "left_semi")), "node")
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    outside = F.col("component") != F.col("top")
    kept = ["node", "component", "n", "sketch", "fine", "regions"]
    every = dealt.select("region", place("parts", 1).alias("x"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("y"), F.lit(0).alias("side"), outside.alias("outside"), *kept)
    others = dealt.where(outside).select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"), place("groups", 2).alias("y"), F.lit(1).alias("side"), F.lit(True).alias("outside"), *kept)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [*[batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)], _matrix(batch.column(8), TREES * SLOTS, np.uint8), _matrix(batch.column(9), FINE, np.uint8), _matrix(batch.column(10), TREES, np.int64)]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            change = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            heads = np.concatenate([[0], np.flatnonzero(change) + 1])
            for s, e in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                yield from cell(*[x[s:e] for x in rows])
            carry = [x[heads[-1] :] for x in rows]
        if carry is not None:
            yield from cell(*carry)

    def cell(region, _x, _y, side, outside, node, component, count, sketch, fine, regions):
        # a repeated doc_id may stand here by another of its texts: it shares no earlier region then
        own = regions == region[0]
        known = own.any(1)
        tree = int(own[known].argmax(1)[0]) if known.any() else 0
        earlier = np.where(known[:, None], regions, np.arange(len(regions))[:, None])[:, :tree]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for k in range(0, len(one), BLOCK):
            r = one[k : k + BLOCK]
            for j in range(0, len(two), BLOCK):
                c = two[j : j + BLOCK]
                good = _equal(sketch[r], sketch[c]) >= LEAST_EQUAL
                good &= (component[r][:, None] != component[c][None]) & (PERCENT * np.maximum.outer(count[r], count[c]) <= 100 * np.minimum.outer(count[r], count[c]))
                good &= ~outside[r][:, None] | (node[r][:, None] < node[c][None])  # two outside meet in two cells
                a, b = np.nonzero(good)
                near = np.zeros(len(a), bool)
                for q in range(0, len(a), 20_000):
                    p, o = r[a[q : q + 20_000]], c[b[q : q + 20_000]]
                    # a pair that shares a region in an earlier tree is looked at there
                    near[q : q + 20_000] = ((fine[p] == fine[o]).sum(1) >= LEAST_FINE) & ~(earlier[p] == earlier[o]).any(1)
                a, b = node[r[a[near]]], node[c[b[near]]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    # a cell's rows at a hash of its own, not its region's: large regions spread
    return every.unionByName(others).repartition(n, "region", "x", "y").sortWithinPartitions("region", "x", "y").select("region", "x", "y", "side", "outside", *kept).mapInArrow(tidy(run), "a long, b long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """node, text of the wanted nodes (node, pid): each partition of the scan looks for its own, so other texts don't move.

    What isn't found where the earlier scan saw it, because files were dealt differently since, is fetched by a join."""
    spark = docs.sparkSession
    write_side(wanted, f"{folder}/wanted")

    def run(batches):
        from pyspark import TaskContext

        nodes = np.array([x[0] for x in side([f"{folder}/wanted"], TaskContext.get().partitionId(), ("node",), 65536)], np.int64)
        for batch in batches:
            keep = np.isin(batch.column(0).fill_null(0).to_numpy(), nodes) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if keep.any():
                some = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(some.columns, ["node", "text"])

    docs.mapInArrow(tidy(run), "node long, text string").write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    missing = checkpoint(spark.read.schema("node long, pid int").parquet(f"{folder}/wanted").select("node").distinct().join(texts.select("node").distinct(), "node", "left_anti"))
    if missing.isEmpty():
        return texts
    return texts.unionByName(docs.select(F.col("doc_id").alias("node"), "text").join(missing, "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "near")
    fixed = fixed_scan(docs)
    sketches(fixed).write.parquet(f"{folder}/sketches")
    every = spark.read.parquet(f"{folder}/sketches")
    own_key = ["key", "more", "n_shingles"]
    first = F.min(F.struct("doc_id", "pid"))
    every.where("n_shingles > 0 and doc_id is not null").groupBy(*own_key).agg(first.alias("first"), F.first("sig").alias("sig")).select("key", "more", F.col("n_shingles").alias("n"), F.col("first.doc_id").alias("node"), F.col("first.pid").alias("pid"), "sig").write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    forest_rows(nodes).repartitionByRange("region", "slots", "node").sortWithinPartitions("region", "slots", "node").mapInArrow(tidy(_neighbours), _PAIRS).write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    ids = found.select(F.explode(F.array("a", "b")).alias("node")).dropna().distinct()
    texts = _texts(fixed, nodes.select("node", "pid").join(ids, "node", "left_semi"), folder)

    with small_batches(spark):  # rows of two texts
        comps = components(checkpoint(_links(found.where("kind = 0").select("a", "b").distinct(), texts)))
        more = checkpoint(_cross_pairs(found.where("kind = 1").distinct(), comps, texts))
        if not more.isEmpty():
            links = checkpoint(_links(more, texts))
            if not links.isEmpty():
                comps = components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
    # equal sets first: their node, then the node's component
    final = nodes.select("key", "more", F.col("n").alias("n_shingles"), "node").join(comps, "node", "left").select(*own_key, F.coalesce("component", "node").alias("component"))
    return (
        every.select("doc_id", *own_key).join(final, own_key, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
