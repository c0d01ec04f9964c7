"""Axis-aligned box arithmetic as Column expressions, for two and three dimensions.

A :class:`Box` is a pair of tuples of columns. Everything here stays inside whole-stage codegen:
no function touches rows, so a projection of any of these costs no shuffle and no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, mul
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = ("x1", "y1", "z1")
HIGH = ("x2", "y2", "z2")
BOX_COLUMNS = ("x1", "y1", "x2", "y2", "z1", "z2")


class Box(NamedTuple):
    lo: tuple[Column, ...]
    hi: tuple[Column, ...]

    @property
    def dim(self) -> int:
        return len(self.lo)

    def axes(self):
        return list(zip(self.lo, self.hi))


def box(prefix: str = "", dim: int = 3) -> Box:
    """The box stored in columns ``{prefix}x1 .. {prefix}z2``."""
    return Box(
        tuple(F.col(prefix + c) for c in LOW[:dim]),
        tuple(F.col(prefix + c) for c in HIGH[:dim]),
    )


def box_columns(b: Box, prefix: str = "") -> list[Column]:
    """Project a box back into named columns."""
    lows = [c.alias(prefix + n) for c, n in zip(b.lo, LOW)]
    highs = [c.alias(prefix + n) for c, n in zip(b.hi, HIGH)]
    return lows + highs


def _product(values) -> Column:
    return reduce(mul, values)


def _total(values) -> Column:
    return reduce(add, values)


def box_size(b: Box) -> list[Column]:
    return [hi - lo for lo, hi in b.axes()]


def box_center(b: Box) -> list[Column]:
    return [(lo + hi) / F.lit(2.0) for lo, hi in b.axes()]


def box_area(b: Box) -> Column:
    """Area in 2-D, volume in 3-D."""
    return _product(box_size(b))


def overlap_volume(a: Box, b: Box) -> Column:
    return _product(
        F.greatest(F.least(ah, bh) - F.greatest(al, bl), F.lit(0.0))
        for (al, ah), (bl, bh) in zip(a.axes(), b.axes())
    )


def ranges_intersect(a: Box, b: Box, gap: float = 0.0, closed: bool = False) -> Column:
    """True when the boxes overlap on every axis; ``closed`` also accepts mere contact."""
    tests = []
    for (al, ah), (bl, bh) in zip(a.axes(), b.axes()):
        room = F.least(ah, bh) - F.greatest(al, bl)
        tests.append(room >= gap if closed else room > gap)
    return reduce(lambda p, q: p & q, tests)


def box_iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = overlap_volume(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, (inter + F.lit(float(eps))) / union).otherwise(F.lit(0.0))


def box_giou(a: Box, b: Box, eps: float = 0.0) -> Column:
    inter = overlap_volume(a, b)
    union = box_area(a) + box_area(b) - inter
    hull = _product(
        F.greatest(ah, bh) - F.least(al, bl) for (al, ah), (bl, bh) in zip(a.axes(), b.axes())
    )
    return F.when(hull > 0, box_iou(a, b, eps) - (hull - union) / hull).otherwise(F.lit(0.0))


def center_distance(a: Box, b: Box, euclidean: bool = True) -> Column:
    """Distance of the centres; the non-euclidean form is the signed sum of differences."""
    delta = [p - q for p, q in zip(box_center(a), box_center(b))]
    return F.sqrt(_total(d * d for d in delta)) if euclidean else _total(delta)


def centroid_similarity(a: Box, b: Box, spacing: Sequence[Column], scale_mm: float = 10.0) -> Column:
    """``exp(-d / scale)`` with the centre distance ``d`` in millimetres."""
    delta = [(p - q) * s for p, q, s in zip(box_center(a), box_center(b), spacing)]
    return F.exp(-F.sqrt(_total(d * d for d in delta)) / F.lit(scale_mm))


def center_margin(inner: Box, outer: Box) -> Column:
    """Smallest distance from the centre of ``inner`` to a face of ``outer`` (negative outside)."""
    margins = []
    for c, (lo, hi) in zip(box_center(inner), outer.axes()):
        margins += [c - lo, hi - c]
    return F.least(*margins)


def center_in_box(inner: Box, outer: Box, eps: float = 0.01) -> Column:
    return center_margin(inner, outer) > F.lit(eps)


def sides_at_least(b: Box, min_size: float | Sequence[float]) -> Column:
    """Every side at least ``min_size``, one number or one per axis."""
    limits = [min_size] * b.dim if isinstance(min_size, (int, float)) else min_size
    return reduce(lambda p, q: p & q, [s >= F.lit(float(m)) for s, m in zip(box_size(b), limits)])


def clip_box(b: Box, shape: Sequence[Column]) -> Box:
    """Clamp every coordinate to ``[0, shape]`` of its axis."""
    def clamp(v: Column, s: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, s))

    return Box(
        tuple(clamp(v, s) for v, s in zip(b.lo, shape)),
        tuple(clamp(v, s) for v, s in zip(b.hi, shape)),
    )


def permute_axes(b: Box, order: Sequence[int]) -> Box:
    return Box(tuple(b.lo[i] for i in order), tuple(b.hi[i] for i in order))


def expand_to_box(values: Sequence[Column]) -> Box:
    """Broadcast one value per axis to both faces of that axis."""
    return Box(tuple(values), tuple(values))


def shift_box(b: Box, offset: Sequence[Column]) -> Box:
    return Box(
        tuple(v + o for v, o in zip(b.lo, offset)), tuple(v + o for v, o in zip(b.hi, offset))
    )


def scale_box(b: Box, factor: Sequence[Column]) -> Box:
    return Box(
        tuple(v * f for v, f in zip(b.lo, factor)), tuple(v * f for v, f in zip(b.hi, factor))
    )


def rescale_box(b: Box, spacing: Sequence[Column], target: Sequence[Column], order: Sequence[int]) -> Box:
    """Permute, then move from voxel units at ``spacing`` to voxel units at ``target``."""
    return scale_box(permute_axes(b, order), [s / t for s, t in zip(spacing, target)])


def restore_box(
    b: Box,
    order: Sequence[int],
    resampled: Sequence[Column],
    original: Sequence[Column],
    crop_offset: Sequence[Column],
) -> Box:
    """Undo preprocessing: transpose back, scale to the original spacing, add the crop offset."""
    scaled = scale_box(permute_axes(b, order), [r / o for r, o in zip(resampled, original)])
    return shift_box(scaled, crop_offset)


def mirror_box(b: Box, shape: Sequence[Column], dims: Column) -> Box:
    """Flip along the axes listed in the array column ``dims``; applying it twice is the identity."""
    lo, hi = [], []
    for i, ((low, high), s) in enumerate(zip(b.axes(), shape)):
        flip = F.array_contains(dims, i)
        lo.append(F.when(flip, s - high).otherwise(low))
        hi.append(F.when(flip, s - low).otherwise(high))
    return Box(tuple(lo), tuple(hi))


def gaussian_tile_weight(b: Box, tile: Sequence[Column], spread: float = 0.8) -> Column:
    """Mean over axes of a bell centred in the tile with width ``spread`` times the half tile."""
    terms = []
    for c, t in zip(box_center(b), tile):
        half = t / F.lit(2.0)
        z = (c - half) / (half * F.lit(spread))
        terms.append(F.exp(F.lit(-0.5) * z * z))
    return _total(terms) / F.lit(float(b.dim))


def plateau_tile_weight(b: Box, tile: Sequence[Column]) -> Column:
    """1 near the tile centre, falling linearly beyond half of the largest possible distance."""
    half = [t / F.lit(2.0) for t in tile]
    d = F.sqrt(_total((c - h) * (c - h) for c, h in zip(box_center(b), half)))
    dmax = F.sqrt(_total(h * h for h in half))
    return F.lit(1.0) - F.greatest(F.lit(0.0), d / dmax - F.lit(0.5))


def encode_offsets(target: Box, source: Box, weights: Sequence[float] | None = None) -> tuple[list[Column], list[Column]]:
    """Centre shifts relative to the source size, and log size ratios, each times its weight."""
    weights = weights or [1.0] * (2 * target.dim)
    shifts = [
        F.try_divide(F.lit(weights[i]) * (ct - cs), ss)
        for i, (ct, cs, ss) in enumerate(zip(box_center(target), box_center(source), box_size(source)))
    ]
    scales = [
        F.lit(weights[target.dim + i]) * F.log(F.try_divide(st, ss))
        for i, (st, ss) in enumerate(zip(box_size(target), box_size(source)))
    ]
    return shifts, scales


def decode_offsets(
    shifts: Sequence[Column],
    scales: Sequence[Column],
    source: Box,
    weights: Sequence[float] | None = None,
    max_log_scale: float = math.log(1000.0 / 16),
) -> Box:
    """Inverse of :func:`encode_offsets`; the log ratio is capped before ``exp``."""
    weights = weights or [1.0] * (2 * source.dim)
    lo, hi = [], []
    for i, (cs, ss) in enumerate(zip(box_center(source), box_size(source))):
        c = shifts[i] / F.lit(weights[i]) * ss + cs
        s = F.exp(F.least(scales[i] / F.lit(weights[source.dim + i]), F.lit(max_log_scale))) * ss
        lo.append(c - s * F.lit(0.5))
        hi.append(c + s * F.lit(0.5))
    return Box(tuple(lo), tuple(hi))
