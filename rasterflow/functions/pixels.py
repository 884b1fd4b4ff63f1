"""Column expressions over small rasters: ``px`` is an array of integers, row by row, of a known height and width.

Sums stay in integers until the last division, so results don't depend on the order of the pixels' summation.
Neighbours beyond the border mirror the row or column next to it (the edge itself isn't repeated).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(px: Column, finish) -> Column:
    """One pass over px for its number, sum and sum of squares; finish(n, s, q) makes the result."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("s"), zero.alias("q"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q"))
    return F.aggregate(px, start, step, lambda a: finish(a["n"], a["s"], a["q"]))


def once(value: Column, use) -> Column:
    """use(value), with value worked out a single time however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(px: Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("long"), lambda s, x: s + x)


def squares(px: Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)


def mean(px: Column) -> Column:
    return _fold(px, lambda n, s, q: s / n)


def variance(px: Column) -> Column:
    """Population variance."""
    return _fold(px, lambda n, s, q: (n * q - s * s) / (n * n))


def deviation(px: Column) -> Column:
    return F.sqrt(variance(px))


def share(px: Column, test) -> Column:
    """Share of the pixels that pass a test."""
    return F.size(F.filter(px, test)) / F.size(px)


def percentile(px: Column, p: float) -> Column:
    """Linear interpolation between the two nearest ranks."""

    def between(ordered):
        at = (F.size(ordered) - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
        return a + (b - a) * (at - low)

    return once(F.array_sort(px), between)


def _mirror(k: Column, n: int) -> Column:
    return F.when(k < 0, -k).when(k > n - 1, 2 * (n - 1) - k).otherwise(k)


def neighbour(px: Column, i: Column, dy: int, dx: int, height: int, width: int) -> Column:
    """The pixel dy rows and dx columns from place i."""
    row, column = (i / width).cast("int"), i % width
    return F.get(px, _mirror(row + dy, height) * width + _mirror(column + dx, width))


def _stencil(px: Column, height: int, width: int, weights: dict[tuple[int, int], int], finish=lambda v: v) -> Column:
    """Weighted sums of each pixel's surroundings. Places are known beforehand, so each result is plain arithmetic on elements."""
    mirror = lambda k, n: -k if k < 0 else (2 * (n - 1) - k if k > n - 1 else k)

    def value(row, column):
        return finish(sum(w * F.get(px, F.lit(mirror(row + dy, height) * width + mirror(column + dx, width))) for (dy, dx), w in weights.items()))

    return F.array(*[value(row, column) for row in range(height) for column in range(width)])


def _unrolled(height, width) -> bool:
    """Whether a raster's size is known beforehand and small."""
    return isinstance(height, int) and isinstance(width, int) and height * width <= 256


def _beside(i: Column, width) -> tuple[Column, Column]:
    """The places left and right of place i, mirrored at the borders."""
    column = i % width
    return F.when(column == 0, i + 1).otherwise(i - 1), F.when(column == width - 1, i - 1).otherwise(i + 1)


def _upright(i: Column, height, width) -> tuple[Column, Column]:
    """The places above and below place i, mirrored at the borders."""
    return F.when(i < width, i + width).otherwise(i - width), F.when(i >= (height - 1) * width, i - width).otherwise(i + width)


def laplacian(px: Column, height, width) -> Column:
    """Four-neighbour second differences. Sizes are numbers or columns."""
    if _unrolled(height, width):
        return _stencil(px, height, width, {(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1, (0, 0): -4})
    return F.transform(px, lambda v, i: sum((F.get(px, k) for k in (*_upright(i, height, width), *_beside(i, width))), -4 * v))


def smooth(px: Column, height: int, width: int) -> Column:
    """Binomial 3 x 3 average, rounded half up to whole levels."""
    weights = {(dy, dx): (1 + (dy == 0)) * (1 + (dx == 0)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    level = lambda v: F.shiftright(v + 8, 4)
    if _unrolled(height, width):
        return _stencil(px, height, width, weights, level)
    down = F.transform(px, lambda v, i: sum((F.get(px, k) for k in _upright(i, height, width)), 2 * v))
    return once(down, lambda sums: F.transform(sums, lambda v, i: level(sum((F.get(sums, k) for k in _beside(i, width)), 2 * v))))


def sharpness(px: Column, height: int, width: int) -> Column:
    return variance(laplacian(px, height, width))


def noise(px: Column, height: int, width: int) -> Column:
    return deviation(F.zip_with(px, smooth(px, height, width), lambda a, b: a - b))


def steps(px: Column, height: int, width: int, down: bool) -> Column:
    """Absolute differences between neighbours in a row (or down a column), row by row."""
    n = (height - 1) * width if down else height * (width - 1)
    here = (lambda k: k) if down else (lambda k: k + (k / (width - 1)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.abs(F.get(px, here(k) + (width if down else 1)) - F.get(px, here(k))))


def _block_steps(every: Column, width: int, down: bool) -> Column:
    """Those of all differences that cross an 8-pixel block edge."""
    across = (lambda _, k: (k / width).cast("int") % 8 == 7) if down else (lambda _, k: k % (width - 1) % 8 == 7)
    return F.filter(every, across)


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def axes_score(edge_x, edge_y, all_x, all_y) -> Column:
    """Mean of the two axes' ratios of block-edge to all differences, above 0.88, scaled to 0 .. 100."""
    return clip(((edge_x / (all_x + 1e-6) + edge_y / (all_y + 1e-6)) / 2 - 0.88) * 120.0, 0.0, 100.0)


def pooled_score(edge_x, edge_y, all_x, all_y) -> Column:
    """Ratio of the axes' mean block-edge differences to their mean differences, above 0.9, scaled to 0 .. 100."""
    return clip((((edge_x + edge_y) / 2) / ((all_x + all_y) / 2 + 1e-6) - 0.9) * 115.0, 0.0, 100.0)


def _blockiness(px: Column, height, width, score) -> Column:
    """score of the mean differences; each axis's differences are worked out once."""

    def axis(down):
        return once(steps(px, height, width, down), lambda every: F.struct(mean(_block_steps(every, width, down)).alias("edge"), mean(every).alias("all")))

    return once(F.struct(axis(False).alias("x"), axis(True).alias("y")), lambda a: score(a["x"]["edge"], a["y"]["edge"], a["x"]["all"], a["y"]["all"]))


def blockiness_axes(px: Column, height, width) -> Column:
    """``axes_score`` of a raster; 0 for rasters under 24."""
    if isinstance(height, int) and isinstance(width, int) and min(height, width) < 24:
        return F.lit(0.0)
    return F.when(F.least(F.lit(height), F.lit(width)) < 24, F.lit(0.0)).otherwise(_blockiness(px, height, width, axes_score))


def blockiness_pooled(px: Column, height: int, width: int) -> Column:
    """``pooled_score`` of a raster; 0 for rasters under 24."""
    if min(height, width) < 24:
        return F.lit(0.0)
    return _blockiness(px, height, width, pooled_score)


def luma(b: Column, g: Column, r: Column) -> Column:
    """BT.601 luma of three planes, rounded half up."""
    triples = F.arrays_zip(b.alias("b"), g.alias("g"), r.alias("r"))
    return F.transform(triples, lambda t: F.floor((t["b"] * 114 + t["g"] * 587 + t["r"] * 299 + 500) / 1000).cast("int"))


def saturation(b: Column, g: Column, r: Column) -> Column:
    """255 (max - min) / max of each pixel, rounded half up; 0 for black."""
    triples = F.arrays_zip(b.alias("b"), g.alias("g"), r.alias("r"))
    high = lambda t: F.greatest(t["b"], t["g"], t["r"])
    low = lambda t: F.least(t["b"], t["g"], t["r"])
    return F.transform(triples, lambda t: F.when(high(t) == 0, F.lit(0)).otherwise(F.floor((510 * (high(t) - low(t)) + high(t)) / (2 * F.greatest(high(t), F.lit(1)))).cast("int")))


def spread(b: Column, g: Column, r: Column) -> Column:
    """Largest less smallest channel of each pixel."""
    triples = F.arrays_zip(b.alias("b"), g.alias("g"), r.alias("r"))
    return F.transform(triples, lambda t: F.greatest(t["b"], t["g"], t["r"]) - F.least(t["b"], t["g"], t["r"]))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _moments(a: Column, b: Column):
    n = F.size(a).cast("long")
    cross = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)
    va = n * squares(a) - total(a) * total(a)
    vb = n * squares(b) - total(b) * total(b)
    return n, va, vb, n * cross - total(a) * total(b)


def correlation_strict(a: Column, b: Column) -> Column:
    """Normalised correlation; two flat patches compare by their means, one flat patch gives 0, empty ones 1."""
    n, va, vb, cab = _moments(a, b)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0))
        .when((va == 0) & (vb == 0), clip(1.0 - F.abs(mean(a) - mean(b)) / 255.0, 0.0, 1.0))
        .when((va == 0) | (vb == 0), F.lit(0.0))
        .otherwise(clip(cab / F.greatest(F.sqrt(va.cast("double")) * F.sqrt(vb.cast("double")), F.lit(1e-300)), -1.0, 1.0))
    )


def correlation_lenient(a: Column, b: Column) -> Column:
    """Normalised correlation; a flat patch on either side gives 1, different or empty shapes 0."""
    n, va, vb, cab = _moments(a, b)
    return (
        F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0))
        .when((va == 0) | (vb == 0), F.lit(1.0))
        .otherwise(clip(cab / F.greatest(F.sqrt(va.cast("double")) * F.sqrt(vb.cast("double")), F.lit(1e-300)), -1.0, 1.0))
    )
