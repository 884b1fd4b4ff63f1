"""Resampling by area and the cosine transform, as expressions in whole numbers: results don't depend on an order of summation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterflow.functions.pixels import once

#: Side of the patches that faces and photos are compared at, and the longer side of previews.
PATCH, PREVIEW = 96, 1400
#: Side of the raster and of the corner of coefficients that signatures are made of; bits of the basis's fixed point.
SIDE, CORNER, POINT = 16, 8, 20


def _count(n) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(n)


def _mixed(i: Column, size: Column, out: Column, value) -> Column:
    """Sum of value(j) over the source places j that place i of out covers, weighted by the overlap; an overlap of whole places is out."""
    first, last = F.floor(i * size / out).cast("int"), F.floor(((i + 1) * size - 1) / out).cast("int")
    overlap = lambda j: F.least((j + 1) * out, (i + 1) * size) - F.greatest(j * out, i * size)
    return F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda s, j: s + overlap(j) * value(j))


def area(px: Column, height, width, rows, columns) -> Column:
    """A raster of height x width levels as one of rows x columns: each is the mean of what it covers, rounded half up.

    Places that are covered in part count by their share. An empty raster stays empty. Sizes are columns or numbers."""
    h, w, m, n = (_count(k) for k in (height, width, rows, columns))
    places = lambda k: F.sequence(F.lit(0), k - 1)
    tall = once(px, lambda levels: F.transform(places(m), lambda i: F.transform(places(w), lambda x: _mixed(i, h, m, lambda j: F.get(levels, j * w + x)))))
    whole = h.cast("long") * w
    level = lambda v: F.floor((2 * v + whole) / (2 * whole)).cast("int")
    done = F.flatten(F.transform(tall, lambda line: F.transform(places(n), lambda k: level(_mixed(k, w, n, lambda x: F.get(line, x))))))
    return F.when((h > 0) & (w > 0), done).otherwise(F.array().cast("array<int>"))


def patch(px: Column, height, width) -> Column:
    return area(px, height, width, PATCH, PATCH)


def preview_side(side, height, width, longest: int = PREVIEW) -> Column:
    """A side of the preview: no side is over longest; smaller photos keep theirs."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(_count(height), _count(width)))
    return F.greatest(F.lit(1), F.bround(_count(side) * scale).cast("int"))


def basis(k: int, x: int) -> int:
    """The orthonormal cosine of frequency k at place x, in fixed point."""
    return round((1 << POINT) * math.sqrt((1 if k == 0 else 2) / SIDE) * math.cos(math.pi * (2 * x + 1) * k / (2 * SIDE)))


def cosines(px: Column) -> Column:
    """The 8 x 8 low coefficients of a 16 x 16 raster's two-dimensional cosine transform, row by row: two products with the basis."""
    waves = F.array(*[F.array(*[F.lit(basis(k, x)).cast("long") for x in range(SIDE)]) for k in range(CORNER)])
    places = F.sequence(F.lit(0), F.lit(SIDE - 1))
    product = lambda wave, value: F.aggregate(places, F.lit(0).cast("long"), lambda s, j: s + F.get(wave, j) * value(j))
    tall = once(px, lambda levels: F.transform(waves, lambda wave: F.transform(places, lambda x: product(wave, lambda y: F.get(levels, y * SIDE + x)))))
    return F.flatten(F.transform(tall, lambda line: F.transform(waves, lambda wave: product(wave, lambda x: F.get(line, x)))))
