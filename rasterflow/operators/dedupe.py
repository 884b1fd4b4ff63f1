"""Duplicates: content hashes, signatures, near pairs by bands, groups by leaders, the best of each group."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P
from rasterflow.functions import resample
from rasterflow.functions.sharing import checkpoint, numbered, stored
from rasterflow.sources import rasters

#: Differing bits up to which two signatures count as near duplicates.
NEAR = 7


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def first_occurrence(files: DataFrame, order: str = "ord") -> DataFrame:
    """Adds sha and the order key of the first file with the same content; only hashes and keys are shuffled."""
    hashed = files.withColumn("sha", content_hash(F.col("content"))).drop("content")
    first = hashed.groupBy("sha").agg(F.min(order).alias("first_ord"), F.count("*").alias("copies"))
    return hashed.join(first, "sha")


def signature(coefficients: Column) -> Column:
    """64 bits of an 8 x 8 block of coefficients: each against the median of rows 1 to 7, the first coefficient highest."""
    middle = P.once(F.array_sort(F.slice(coefficients, 9, 56)), lambda o: (F.get(o, F.lit(27)) + F.get(o, F.lit(28))) / 2)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return P.once(middle, lambda median: F.aggregate(coefficients, zero, lambda s, c: F.shiftleft(s, 1).bitwiseOR(F.when(c > median, one).otherwise(zero))))


def signature_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def perceptual_hash(px: Column, height, width) -> Column:
    """The signature of a raster (levels row by row): brought to 16 x 16 by area, then its cosine transform's low corner."""
    return P.once(resample.cosines(resample.area(px, height, width, resample.SIDE, resample.SIDE)), signature)


#: Parts of a signature that pairs are looked up by, and bits of each.
PARTS, WIDE = 4, 16
#: Keys that one task looks up.
KEYS = 1 << 20


def _part(bits: Column, k: int) -> Column:
    return F.shiftrightunsigned(bits, WIDE * k).bitwiseAND((1 << WIDE) - 1)


def near_pairs(left: DataFrame, right: DataFrame, near: int = NEAR, left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """Pairs (left_id, right_id, distance) of rows (id, sig) within near bits, 7 at most.

    Of 4 parts of 16 bits one differs in a single bit at most if the whole differs in 7, so each left signature is looked
    up by its parts and their one-bit neighbours: 68 keys, each of which a random signature meets with 1 / 65536. A pair
    counts in its first such part only. Equal signatures are looked up once, and ids join the pairs that were found.

    Few bytes of signatures become many keys, which Spark's estimates don't foresee: it would make them in one task and broadcast
    them. So keys are dealt to tasks by their number, where Spark's own number of partitions is too small for them; tasks hash
    the side of few keys, and let the other and the pairs pass."""
    if near > 2 * PARTS - 1:
        raise ValueError("more than 7 bits need more parts")
    mine = stored(left.select(left_id, F.col("sig").alias("left_sig")))
    theirs = stored(right.select(right_id, F.col("sig").alias("right_sig")))
    keys = PARTS * ((1 + WIDE) * mine.count() + theirs.count())
    spark = left.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-keys // KEYS))
    more = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda bits: F.explode(F.array(*[_part(F.col(bits), k) + (k << WIDE) for k in range(PARTS)])).alias("key")
    flips = F.explode(F.array(*[F.lit(f).cast("long") for f in (0, *(1 << b for b in range(WIDE)))])).alias("flip")

    def looked_up(rows, bits):
        return rows.select(bits).repartition(tasks, bits).distinct().select(bits, parts(bits))

    def dealt(rows):
        return rows.repartition(tasks, "key") if more else rows

    a = dealt(looked_up(mine, "left_sig").select("left_sig", "key", flips).select("left_sig", F.col("key").bitwiseXOR(F.col("flip")).alias("key")))
    b = dealt(looked_up(theirs, "right_sig"))
    gap = F.col("left_sig").bitwiseXOR(F.col("right_sig"))
    first = F.lit(PARTS)
    for k in reversed(range(PARTS)):
        first = F.when(F.bit_count(_part(gap, k)) <= 1, k).otherwise(first)
    met = a.join(b.hint("shuffle_hash"), "key").withColumn("distance", P.hamming(F.col("left_sig"), F.col("right_sig"))).where((F.col("distance") <= near) & (F.shiftright("key", WIDE) == first))
    found = met.select("left_sig", "right_sig", "distance").join(mine.hint("shuffle_hash"), "left_sig").join(theirs.hint("shuffle_hash"), "right_sig")
    return found.select(left_id, right_id, "distance")


#: What a round needs of an edge from node a to node b: the group that repeated content near a opens, and what is known of b.
EDGE = "a, b, copied, copied_first, leads"
DECIDED = "node long, created long, leader long"


def _walk(batches):
    """Decides what can be decided of the edges of a range of nodes, in order of a; a row per decided node.

    Only the decisions of the range's own nodes are kept, not its edges."""
    led: dict[int, bool] = {}

    def settle(node, group, wait):
        if group is None and wait is None:
            led[node] = True
            return node, node, node
        if group is not None and (wait is None or group[0] < wait):
            led[node] = False
            return node, *group
        return None

    node, group, wait = None, None, None
    for batch in batches:
        out = []
        for a, b, copied, first, leads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if a != node:
                if node is not None:
                    out.append(settle(node, group, wait))
                node, group, wait = a, None, None
            if b < a:
                leads = led.get(b) if leads is None else leads
                if leads is None:
                    wait = b if wait is None else min(wait, b)
                elif leads:
                    group = (b, b) if group is None else min(group, (b, b))
            if copied is not None and copied < a:
                group = (copied, first) if group is None else min(group, (copied, first))
        yield _settled(out)
    if node is not None:
        yield _settled([settle(node, group, wait)])


def _settled(rows) -> pa.RecordBatch:
    rows = [r for r in rows if r]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "created", "leader"])


def _decided(nodes: DataFrame, near: int, ranges: int | None = None) -> DataFrame:
    """(node, created, leader) for nodes (node, sig, copied, copied_first): the group that a walk in order puts each in.

    A node is the first file of its signature, copied the first repeated content there, which opens a group under copied_first. A
    node joins the earliest group near it, unless an undecided node before it might lead an earlier one; it leads a group of
    its own once all before it are decided and none is near. Each round walks every range of nodes in order; a node that waits for
    one of another range is left for the next round. The first range that has undecided nodes is decided whole, so there are at most as
    many rounds as ranges, and a chain takes one for each range that it runs through in order."""
    sides = near_pairs(nodes.select(F.col("node").alias("a"), "sig"), nodes.select(F.col("node").alias("b"), "sig"), near, "a", "b").where("a <> b")
    other = nodes.select(F.col("node").alias("b"), "copied", "copied_first")
    edges = stored(sides.join(other, "b").where("b < a or copied < a").select("a", "b", "copied", "copied_first"))
    alone = nodes.select("node").join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    done = [stored(alone.select("node", F.col("node").alias("created"), F.col("node").alias("leader")))]
    left = edges
    while not left.isEmpty():
        known = reduce(DataFrame.unionByName, done).select(F.col("node").alias("b"), (F.col("created") == F.col("node")).alias("leads"))
        told = left.join(known, "b", "left").selectExpr(EDGE.split(", "))
        ordered = (told.repartitionByRange(ranges, "a") if ranges else told.repartitionByRange("a")).sortWithinPartitions("a", "b")
        step = stored(ordered.mapInArrow(_walk, DECIDED))
        done.append(step)
        left = stored(left.join(step.select(F.col("node").alias("a")), "a", "left_anti"))
    return reduce(DataFrame.unionByName, done)


def groups(files: DataFrame, near: int = NEAR) -> DataFrame:
    """Members (group, position, ord, leader) of the duplicate groups of files (ord, sha, sig), numbered in order of creation.

    The groups are those of a walk in order, which opens a group [first, this] for each repeated content, else joins the
    first group whose leader is near, else opens a group of one; groups of one are left out. Files of equal signature
    follow the first of them, and these are decided in rounds over ranges of the order."""
    first = files.groupBy("sha").agg(F.min(F.struct("ord", "sig")).alias("f")).select("sha", F.col("f.ord").alias("first"), F.col("f.sig").alias("sig"))
    copies = files.select("ord", "sha").join(first.select("sha", "first", "sig"), "sha").where("ord > first")
    second = copies.groupBy("sig").agg(F.min(F.struct(F.col("ord").alias("copied"), F.col("first").alias("copied_first"))).alias("c")).select("sig", "c.copied", "c.copied_first")
    nodes = checkpoint(first.groupBy("sig").agg(F.min("first").alias("node")).join(second, "sig", "left").select("node", "sig", "copied", "copied_first"))
    placed = first.join(nodes.select("sig", "node"), "sig").join(_decided(nodes, near), "node")
    walked = placed.select("created", "leader", F.lit(1).alias("late"), F.col("first").alias("ord"))
    pair = F.explode(F.array("first", "ord"))
    repeated = copies.select(F.col("ord").alias("created"), F.col("first").alias("leader"), F.lit(0).alias("late"), pair.alias("ord"))
    members = checkpoint(walked.unionByName(repeated))
    several = members.groupBy("created").agg(F.count("*").alias("members")).where("members > 1")
    place = F.row_number().over(Window.partitionBy("created").orderBy("late", "ord")) - 1
    return members.join(several.select("created"), "created").withColumn("position", place).join(numbered(several.select("created"), "created", "group"), "created").select("group", "position", "ord", "leader")


def best_of_group(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds score (0 where unknown) and is_best: the highest score of a group, the first member winning ties."""
    scored = members.join(scores.groupBy("ord").agg(F.max("score").alias("score")), "ord", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.col("score").desc(), "position"))
    return scored.withColumn("is_best", place == 1)


def group_outputs(members: DataFrame) -> DataFrame:
    """Adds copy, where a member (group, path, is_best) goes for review, and best_copy, where the best one's enhanced file goes (null for others)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ending = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    folder = F.concat(F.lit("Duplicate Review/Group "), F.when(F.col("group") < 1000, F.lpad(F.col("group").cast("string"), 3, "0")).otherwise(F.col("group").cast("string")), F.lit("/"))
    copy = F.concat(folder, rasters.stem(F.col("path")), F.when(F.col("is_best"), "_BEST").otherwise(""), ending)
    enhanced = F.regexp_extract(rasters.output_path(F.col("path")), r"([^/]*)$", 1)
    return members.withColumns({"copy": copy, "best_copy": F.when(F.col("is_best"), F.concat(F.lit("Best Photos/"), enhanced))})
