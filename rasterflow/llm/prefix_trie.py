"""Prefix tries of conversations: which openings are shared, by how many conversations, and what sharing them saves.

A turn is known by the SHA-256 digest of its role and text, so texts never leave the scan. Equal conversations become one
sequence of digests; sequences are sorted over range partitions, so each partition holds one stretch of the sorted order:
a shard of prefixes. In a shard, turns get dense ids, the trie is packed into a double array (``BASE`` and ``CHECK``) and
walked for its nodes. A node whose subtree runs over a shard's edge lies on the shard's first or last path; such nodes
get partial aggregates that are summed up over all shards, all others are complete where they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, ragged, table, tidy, utf8

#: Turns that a shard holds, about: what a task keeps at a time, some 200 bytes each.
SHARD_TURNS = 250_000
#: Places that packing tries for a node of several children before it takes the array's end.
TRIES = 32
#: Conversations are joined in blocks of so many neighbouring ids, so a hot sequence's list is made in parts.
BLOCK_BITS = 12
_EMPTY = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (digest, words) in the order of turn (null first), equal turns by role, then by digest.

    Null role or text is empty; rows without conv_id belong to no conversation and are left out. A conversation's digests
    (some 40 bytes a turn) are held together, its texts aren't."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).alias("words")).alias("row")
    )
    ordered = F.transform(F.sort_array(F.collect_list("row")), lambda r: F.struct(r["digest"].alias("digest"), r["words"].alias("words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % block, then its own turns after its first h; h is crc32(c) % most.

    A donor has at most block takers, so no key is hot; an absent donor gives nothing."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("head"))
    taken = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    both = turns.withColumn("donor", F.col("conv_id") - F.col("conv_id") % block).join(heads, "donor", "left")
    return both.select("conv_id", F.concat(taken, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _listed(batches):
    """One row per sequence from its blocks, which come in order: ids are hashed as they pass, never gathered."""
    key, state = None, None

    def closed():
        return {"digests": state[0], "words": state[1], "n": state[2], "conv_id": state[3], "ends_sha256": state[4].hexdigest()}

    out = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if state is not None:
                    out.append(closed())
                key, state = row["key"], [row["digests"], row["words"], 0, row["conv_id"], hashlib.sha256()]
            else:
                state[4].update(b",")
            state[2] += row["n"]
            state[4].update(row["ids"].encode())
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, _LISTED)
            out = []
    if state is not None:
        out.append(closed())
    yield pa.RecordBatch.from_pylist(out, _LISTED)


_LISTED = pa.schema([("digests", pa.list_(pa.binary())), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences: digests, words, n conversations, the smallest conv_id, and the digest of all their ids in order."""
    key = F.aggregate("turns", F.lit(""), lambda known, t: F.sha2(F.concat(known.cast("binary"), t["digest"]), 256))
    rows = convs.select("conv_id", key.alias("key"), F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = rows.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.first("digests").alias("digests"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids")
    )
    ordered = blocks.repartition("key").sortWithinPartitions("key", "block")
    return ordered.mapInArrow(_listed, "digests array<binary>, words array<int>, n long, conv_id long, ends_sha256 string")


class DoubleArray:
    """A trie over sequences of dense ids 1, 2, ...: the child of state s by id c is t = base[s] + c, if check[t] is s. The root is 0."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0
        self.end = 1  # places from here on are free
        self.gap = 1  # places before this one are taken

    def _room(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states of new children, given by parent, then id; all children of a parent come at once."""
        states = np.zeros(len(parents), np.int64)
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1])) if len(parents) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(parents)))
        for k in np.flatnonzero(size > 1).tolist():
            mine = slice(first[k], first[k] + size[k])
            states[mine] = self._place(int(parents[first[k]]), codes[mine])
        alone = first[size == 1]
        free = np.flatnonzero(self.check[self.gap : self.end] < 0)[: len(alone)] + self.gap
        self._room(self.end + len(alone))
        at = np.append(free, np.arange(self.end, self.end + len(alone) - len(free)))
        self.end, self.gap = max(self.end, int(at[-1]) + 1 if len(at) else 0), int(at[-1]) + 1 if len(at) else self.gap
        self.base[parents[alone]], self.check[at], states[alone] = at - codes[alone], parents[alone], at
        return states

    def _place(self, parent: int, codes: np.ndarray) -> np.ndarray:
        span = int(codes[-1] - codes[0]) + 1
        self._room(self.end + span)
        free = np.flatnonzero(self.check[self.gap : min(self.end, self.gap + 4096)] < 0)[:TRIES] + self.gap
        for start in [*free.tolist(), self.end]:
            self._room(start + span)
            at = codes + (start - int(codes[0]))
            if (self.check[at] < 0).all():
                break
        self.base[parent], self.check[at] = start - int(codes[0]), parent
        self.end = max(self.end, int(at[-1]) + 1)
        return at

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children by these ids, -1 where there is none."""
        at = self.base[states] + codes
        inside = (at > 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def packed(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The double array of distinct sequences that stand in order, so those with a common prefix stand together."""
    trie = DoubleArray(2 * len(codes) + 2)
    rows, states = np.flatnonzero(lengths > 0), np.zeros(len(lengths), np.int64)
    depth = 0
    while len(rows):
        code, at = codes[starts[rows] + depth], states[rows]
        new = np.append(True, (at[1:] != at[:-1]) | (code[1:] != code[:-1]))
        parents, own = at[new], code[new]
        order = np.lexsort((own, parents))
        made = np.empty(len(own), np.int64)
        made[order] = trie.add(parents[order], own[order])
        states[rows] = made[np.cumsum(new) - 1]
        depth += 1
        rows = rows[lengths[rows] > depth]
    return trie


_NODES = pa.schema(
    [("shared", pa.bool_()), ("owner", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("up_owner", pa.int32()), ("n_convs", pa.int64())]
    + [(c, pa.int64()) for c in ("n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())]
)
_NODES_DDL = "shared boolean, owner int, depth long, conv_id long, parent_conv_id long, up_owner int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _dense(digests: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Ids 1, 2, ... of digests; those of small depths come first, so that siblings lie close together."""
    found, back = np.unique(digests, return_inverse=True)
    least = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(least, back, depths)
    rank = np.empty(len(found), np.int64)
    rank[np.argsort(least, kind="stable")] = np.arange(1, len(found) + 1)
    return rank[back]


def _shard_nodes(rows: pa.Table, into: int, through: int, out: int, owners: list[int], shard: int):
    """Nodes of a shard. into, out: depth of the path shared with the shard before and after (-1: there is none); through: depth
    common to all of this shard and the one before; owners: by depth, the shards where the nodes of the path into it begin."""
    lists = rows.column("digests").combine_chunks()
    at = np.asarray(lists.offsets.to_numpy(), np.int64)
    data, _ = utf8(lists.flatten())
    starts, lengths = at[:-1] - at[0], np.diff(at)
    depths = ragged(np.zeros(len(lengths), np.int64), lengths)
    codes = _dense(np.ascontiguousarray(data).view("S32"), depths) if len(data) else np.zeros(0, np.int64)
    words = rows.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    trie = packed(codes, starts, lengths)

    n, least = np.zeros(trie.end, np.int64), np.full(trie.end, np.iinfo(np.int64).max)
    depth_of, last_words, ends = np.zeros(trie.end, np.int64), np.zeros(trie.end, np.int64), np.full(trie.end, -1)
    count, smallest = rows.column("n").to_numpy(), rows.column("conv_id").to_numpy()
    states, left, depth = np.zeros(len(lengths), np.int64), np.arange(len(lengths)), 0
    firsts, lasts, levels = [0], [0], [np.zeros(1, np.int64)]
    while True:
        np.add.at(n, states[left], count[left])
        np.minimum.at(least, states[left], smallest[left])
        done = left[lengths[left] == depth]
        ends[states[done]] = done
        left = left[lengths[left] > depth]
        if not len(left):
            break
        code = starts[left] + depth
        states[left] = reached = trie.step(states[left], codes[code])
        if (reached < 0).any():
            raise AssertionError("a sequence left the double array")
        depth += 1
        depth_of[reached], last_words[reached] = depth, words[code]
        levels.append(reached[np.append(True, reached[1:] != reached[:-1])])
        firsts += [int(reached[0])] if left[0] == 0 else []
        lasts += [int(reached[-1])] if left[-1] == len(lengths) - 1 else []

    own = np.ones(trie.end, np.int64)
    own[firsts[: into + 1]] = 0
    children, below = np.zeros(trie.end, np.int64), np.zeros(trie.end, bool)
    for level in levels[1:]:
        np.add.at(children, trie.check[level], own[level])
        below[trie.check[level]] = True
    if out == len(lasts) - 1:
        below[lasts[-1]] = True  # the next shard goes on from here
    leaves, saved = (own > 0) & ~below, n * last_words - own * last_words
    leaves = leaves.astype(np.int64)
    for level in levels[:0:-1]:
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])

    owner = np.full(trie.end, -1, np.int64)
    for d, s in enumerate(lasts[: out + 1]):
        owner[s] = owners[d] if d <= through else shard
    for d, s in enumerate(firsts[: into + 1]):
        owner[s] = owners[d]
    nodes = np.concatenate(levels)
    digests = rows.column("ends_sha256").combine_chunks()
    for k in range(0, len(nodes), 8192):
        s = nodes[k : k + 8192]
        up, top = trie.check[s], depth_of[s] == 0
        split, split_up = owner[s] >= 0, (owner[up] >= 0) & ~top
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(split), pa.array(owner[s], pa.int32(), mask=~split), pa.array(depth_of[s]), pa.array(least[s]), pa.array(least[up], mask=split_up | top),
                pa.array(owner[up], pa.int32(), mask=~split_up), pa.array(n[s]), pa.array(children[s]), pa.array(leaves[s]), pa.array(saved[s]),
                digests.take(pa.array(np.maximum(ends[s], 0), mask=ends[s] < 0)),
            ],
            schema=_NODES,
        )


def _common(a, b):
    """Length of two arrays' common prefix, -1 if one is null."""
    n = F.least(F.size(a), F.size(b))
    other = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(a.isNull() | b.isNull(), -1).when(other > 0, other - 1).otherwise(n).cast("int")


def _edges(sorted_rows: DataFrame) -> dict[int, tuple[int, int, int, list[int]]]:
    """By shard, what its neighbours share with it: a few numbers for each shard and depth, however many conversations there are."""
    ends = sorted_rows.groupBy("shard").agg(F.min("digests").alias("lo"), F.max("digests").alias("hi"))
    order = Window.orderBy("shard")
    near = ends.withColumns({"before": F.lag("hi").over(order), "after": F.lead("lo").over(order)})
    lcp = lambda a, b: _common(F.col(a), F.col(b))
    found, owners = {}, []
    for shard, into, inside, out in near.select("shard", lcp("before", "lo"), lcp("lo", "hi"), lcp("hi", "after")).orderBy("shard").collect():
        through = min(into, inside)
        found[shard] = (into, through, out, owners[: into + 1])
        owners = [*owners[: through + 1], *[shard] * (out - through)]
    return found


def prefix_nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each distinct opening of conversations (conv_id, turns): see ``op11_prefix_trie`` for the columns.

    No conversations give no rows. Ties and equal conversations meet in one node."""
    spark = convs.sparkSession
    seqs = checkpoint(sequences(convs))
    total = seqs.agg(F.sum(F.size("digests"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))
    ordered = checkpoint(seqs.repartitionByRange(n, "digests").sortWithinPartitions("digests").withColumn("shard", F.spark_partition_id()))
    edges = spark.sparkContext.broadcast(_edges(ordered))

    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if kept:
            rows = pa.Table.from_batches(kept)
            shard = rows.column("shard")[0].as_py()
            into, through, out, owners = edges.value[shard]
            yield from _shard_nodes(rows, into, through, out, owners, shard)

    parts = checkpoint(ordered.mapInArrow(tidy(run), _NODES_DDL))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("shared").groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("up_owner").alias("up_owner"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    ups = merged.select(F.col("owner").alias("up_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_conv_id"))
    nodes = parts.where(~F.col("shared")).unionByName(merged, allowMissingColumns=True)
    return nodes.join(ups, ["up_owner", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of the ids of conversations that end at the node)."""
    return prefix_nodes(rebuilt(checkpoint(turns_of(table(spark, sf_dir, "conversations")))))
