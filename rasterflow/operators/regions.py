"""Regions of pixels that touch, from runs: what lies side by side in a row is one node, runs of neighbouring rows that touch are joined."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.functions.sharing import stored

#: Columns that runs are looked up by, as a power of two: a row has few runs in each.
_WIDE = 6
#: Lines of a photo that one task joins by itself, as a power of two.
_BLOCK = 6


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least member) of the nodes of edges (a, b), of any type that has an order.

    Least labels spread along edges and are followed at the same time, so rounds grow with the logarithm of a component's
    length; each round is a join by node, and no component is held by one task."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        least = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(least, labels["node"] == least["a"]).select("node", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        jump = step.select(F.col("node").alias("via"), F.col("component").alias("far"))
        labels = stored(step.join(jump, step["component"] == jump["via"]).select("node", "before", F.least("component", "far").alias("component")))
        changed = labels.where("component <> before").limit(1).count()
        labels = labels.select("node", "component")
        if not changed:
            return labels


def runs(pixels: DataFrame) -> DataFrame:
    """photo_id, y, first, last: stretches of pixels (photo_id, y, x) side by side; most, the largest value, where pixels have one."""
    order = Window.partitionBy("photo_id", "y").orderBy("x")
    most = [F.max("value").alias("most")] if "value" in pixels.columns else []
    return pixels.withColumn("k", F.col("x") - F.row_number().over(order)).groupBy("photo_id", "y", "k").agg(F.min("x").alias("first"), F.max("x").alias("last"), *most).drop("k")


def touching(found: DataFrame, corners: bool = True) -> DataFrame:
    """a, b: runs (photo_id, y, first) of neighbouring rows that touch, by corners too or by sides only."""
    reach = int(corners)
    dealt = found.withColumn("cell", F.explode(F.sequence(F.shiftright(F.col("first") - reach, _WIDE), F.shiftright(F.col("last") + reach, _WIDE))))
    upper = dealt.select("photo_id", (F.col("y") + 1).alias("y"), "cell", F.col("first").alias("f"), F.col("last").alias("l"))
    cells = F.greatest(F.shiftright(F.col("first") - reach, _WIDE), F.shiftright(F.col("f") - reach, _WIDE))
    met = dealt.join(upper, ["photo_id", "y", "cell"]).where((F.col("first") <= F.col("l") + reach) & (F.col("f") <= F.col("last") + reach) & (F.col("cell") == cells))
    return met.select(F.struct("photo_id", (F.col("y") - 1).alias("y"), F.col("f").alias("first")).alias("a"), F.struct("photo_id", "y", "first").alias("b"))


def _tops(reach: int):
    """A task's walk over runs in order of photo, block, line and column: each run of a block of lines with the first run that it is joined to."""

    def settled(block):
        top = list(range(len(block)))

        def find(k):
            while top[k] != k:
                top[k] = k = top[top[k]]
            return k

        begin, end = 0, 0  # the line above: runs from begin to end
        k = 0
        while k < len(block):
            y, stop = block[k][0], k
            while stop < len(block) and block[stop][0] == y:
                stop += 1
            if begin < end and block[begin][0] == y - 1:
                up = begin
                for low in range(k, stop):
                    _, first, last = block[low]
                    while up < end and block[up][2] + reach < first:
                        up += 1
                    at = up
                    while at < end and block[at][1] <= last + reach:
                        a, b = find(at), find(low)
                        top[max(a, b)] = min(a, b)
                        at += 1
            begin, end, k = k, stop, stop
        return [block[find(k)] for k in range(len(block))]

    def run(batches):
        now, block = None, []
        kinds = None

        def made(now, block):
            found = settled(block)
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(([now[0]] * len(block), *zip(*block, strict=True), [t[0] for t in found], [t[1] for t in found]), kinds, strict=True)], ["photo_id", "y", "first", "last", "top_y", "top_first"]
            )

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, *[pa.int32()] * 5]
            done = []
            for photo, part, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (photo, part) != now:
                    if block:
                        done.append(made(now, block))
                    now, block = (photo, part), []
                block.append(tuple(place))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if block:
            yield made(now, block)

    return run


def named(found: DataFrame, corners: bool = True) -> DataFrame:
    """Adds region to runs (photo_id, y, first, last and more): the place (y, first) of the first run of what they touch.

    Blocks of lines of a photo are settled by a task each; only what runs on over blocks takes rounds of joins."""
    found = stored(found)
    lines = found.select("photo_id", F.shiftright(F.col("y"), _BLOCK).alias("block"), F.col("y").cast("int").alias("y"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    kind = found.schema["photo_id"].dataType.simpleString()
    ordered = lines.repartition("photo_id", "block").sortWithinPartitions("photo_id", "block", "y", "first")
    tops = stored(ordered.mapInArrow(_tops(int(corners)), f"photo_id {kind}, y int, first int, last int, top_y int, top_first int"))
    ends = F.col("y").bitwiseAND((1 << _BLOCK) - 1)
    met = touching(tops.where((ends == 0) | (ends == (1 << _BLOCK) - 1)).select("photo_id", "y", "first", "last"), corners).where(F.shiftright("a.y", _BLOCK) < F.shiftright("b.y", _BLOCK))
    top = F.struct("photo_id", F.col("top_y").alias("y"), F.col("top_first").alias("first"))
    for side in "ab":
        own = tops.select(F.struct("photo_id", "y", "first").alias(side), top.alias("top"))
        met = met.join(own, side).drop(side).withColumnRenamed("top", side)
    over = stored(met.select("a", "b").distinct())
    far = tops.withColumn("node", top)
    if not over.isEmpty():
        far = far.join(components(over), "node", "left").withColumn("node", F.coalesce("component", "node"))
    regions = far.select("photo_id", F.col("y"), F.col("first"), F.struct("node.y", "node.first").alias("region"))
    return found.join(regions, ["photo_id", "y", "first"])


def labelled(pixels: DataFrame, corners: bool = True) -> DataFrame:
    """Adds region to pixels (photo_id, y, x and more): the place (y, first) of the first run of what they touch."""
    pixels = stored(pixels)
    spread = named(runs(pixels.select("photo_id", "y", "x")), corners).select("photo_id", "y", "region", F.explode(F.sequence("first", "last")).alias("x"))
    return pixels.join(spread, ["photo_id", "y", "x"])


def bounded(pixels: DataFrame, least, most) -> DataFrame:
    """photo_id, region and its bounds (area, top, left, bottom, right) for regions of least to most pixels (columns of pixels, or numbers)."""
    areas = labelled(pixels).groupBy("photo_id", "region").agg(
        F.count("*").alias("area"), F.min("y").alias("top"), F.min("x").alias("left"), F.max("y").alias("bottom"), F.max("x").alias("right"), F.max(least if not isinstance(least, int) else F.lit(least)).alias("least"), F.max(most if not isinstance(most, int) else F.lit(most)).alias("most")
    )
    return areas.where("area >= least AND area <= most").drop("least", "most")
