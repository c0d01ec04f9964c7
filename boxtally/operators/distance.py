"""Exact distance of voxels to the nearest voxel of a mask, one axis after the other.

The squared distance is a sum over the axes, so the least one is found per axis: in a slice the nearest mask voxel of
every row along x, then over the rows along y, then over the slices along z. The last two steps take the lower
envelope of one parabola per row or slice, found by a single walk over them, and read it where voxels ask. So the
work grows with the rows, slices and asking voxels and not with pairs of points, however far the mask is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from boxtally.session import cut_lineage

#: Columns of voxels (x by y) that are answered together.
TILE_X, TILE_Y = 16, 64
#: Rows that a task works on at a time.
ROWS = 128
#: Numbers in the table of distances that tiles are answered from at a time.
CELLS = 1 << 19


def envelope_min(position: np.ndarray, value: np.ndarray, count: np.ndarray, lane: np.ndarray, query: np.ndarray) -> np.ndarray:
    """min over k of value[lane, k] + (query − position[lane, k])² for each query.

    Each lane has ``count`` (at least one) parabolas in ascending order of position. All lanes walk at once.
    """
    lanes, most = position.shape
    every = np.arange(lanes)
    height = value + position**2
    held = np.zeros((lanes, most), dtype=np.int64)
    start = np.full((lanes, most + 1), np.inf)
    start[:, 0] = -np.inf
    top = np.zeros(lanes, dtype=np.int64)
    for k in range(1, most):
        going = every[count > k]
        cross = np.empty(lanes)
        waiting = going
        while len(waiting):
            last = held[waiting, top[waiting]]
            at = (height[waiting, k] - height[waiting, last]) / (2 * (position[waiting, k] - position[waiting, last]))
            cross[waiting] = at
            # a parabola that the new one undercuts before it begins is nowhere lowest
            waiting = waiting[at <= start[waiting, top[waiting]]]
            top[waiting] -= 1
        top[going] += 1
        held[going, top[going]] = k
        start[going, top[going]] = cross[going]
    low, high = np.zeros(len(lane), dtype=np.int64), top[lane]
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        right = open_ & (start[lane, middle] <= query)
        low = np.where(right, middle, low)
        high = np.where(open_ & ~right, middle - 1, high)
    best = held[lane, low]
    return value[lane, best] + (query - position[lane, best]) ** 2


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """What the lists of a column hold, one after the other, and their lengths."""
    offsets = column.offsets.to_numpy() if len(column) else np.zeros(1, dtype=np.int32)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), np.diff(offsets)


def _numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    values, count = _flat(column)
    return values.to_numpy(zero_copy_only=False), count


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each list of these lengths, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(case_id, tx, ty, z, d): squared distances within a slice from the columns of a tile, in their order."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            (gy, held), (gx, _), (cx, asked), (cy, _) = (_numbers(batch.column(n)) for n in ("gy", "gx", "cx", "cy"))
            sx, sy = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("sx", "sy"))
            every = np.arange(batch.num_rows)
            # the rows of the mask's slices, each with its voxels in order
            owner = np.repeat(every, held)
            order = np.lexsort((gx, gy, owner))
            owner, gy, gx = owner[order], gy[order], gx[order]
            new = _changes(owner, gy)
            first = np.flatnonzero(new)
            end = np.append(first[1:], len(gx))
            code = (np.cumsum(new) - 1) << 32 | (gx + (1 << 31))
            rows = np.bincount(owner[first], minlength=batch.num_rows)
            # a lane for each x that is asked for, which meets all rows of its slice
            by = np.repeat(every, asked)
            order = np.lexsort((cx, by))
            new = _changes(by[order], cx[order])
            lane = np.empty(len(cx), dtype=np.int64)
            lane[order] = np.cumsum(new) - 1
            lane_of, x = by[order][new], cx[order][new]
            count = rows[lane_of]
            at_lane, k = np.repeat(np.arange(len(x)), count), _within(count)
            row = (np.cumsum(rows) - rows)[lane_of][at_lane] + k
            ask = x[at_lane]
            at = np.searchsorted(code, row << 32 | (ask + (1 << 31)))
            below, above = np.maximum(at - 1, first[row]), np.minimum(at, end[row] - 1)
            near = np.minimum(np.abs(gx[below] - ask), np.abs(gx[above] - ask))
            position, value = (np.zeros((len(x), count.max(initial=1))) for _ in range(2))
            position[at_lane, k] = gy[first][row] * sy[lane_of][at_lane]
            value[at_lane, k] = (near * sx[lane_of][at_lane]) ** 2
            d = envelope_min(position, value, count, lane, cy * sy[by])
            ends = np.cumsum([0, *asked]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("case_id", "tx", "ty", "z")), pa.ListArray.from_arrays(ends, d)], ["case_id", "tx", "ty", "z", "d"])


def _together(lanes: np.ndarray, depth: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of tiles whose lanes, padded to the deepest, make at most ``CELLS`` numbers; a larger tile stands alone."""
    start = held = most = 0
    for i, (n, deep) in enumerate(zip(lanes.tolist(), depth.tolist())):
        if i > start and (held + n) * max(most, deep) > CELLS:
            yield start, i
            start, held, most = i, 0, 0
        held, most = held + n, max(most, deep)
    if start < len(lanes):
        yield start, len(lanes)


def _across_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(case_id, v, dist) of the asking voxels ``v`` of each tile, from the distances in all slices; null without any."""
    for whole in batches:
        lengths = [np.diff(whole.column(n).offsets.to_numpy()) for n in ("columns", "slices")]
        for i, j in _together(*lengths):
            batch = whole.slice(i, j - i)
            every = np.arange(batch.num_rows)
            sz = batch.column("sz").to_numpy(zero_copy_only=False)
            slices, depth = _flat(batch.column("slices"))
            columns, lanes = _flat(batch.column("columns"))
            voxels, asking = _flat(batch.column("voxels"))
            z = slices.field("z").to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(every, depth)
            k = np.empty(len(z), dtype=np.int64)
            k[np.lexsort((z, of))] = _within(depth)
            height = np.zeros((batch.num_rows, depth.max(initial=1)))
            height[of, k] = z * sz[of]
            # a lane for each column of a tile, with a distance in each slice
            lane_of = np.repeat(every, lanes)
            d, size = _numbers(slices.field("d"))
            at = np.repeat(np.arange(len(z)), size)
            value = np.zeros((len(lane_of), height.shape[1]))
            value[(np.cumsum(lanes) - lanes)[of][at] + _within(size), k[at]] = d
            # columns are in order of x and y, and so of where they stand in their tile
            place = lambda v, owner: (owner * TILE_X + v.field("x").to_numpy(zero_copy_only=False) % TILE_X) * TILE_Y + v.field("y").to_numpy(zero_copy_only=False) % TILE_Y
            by = np.repeat(every, asking)
            lane = np.searchsorted(place(columns, lane_of), place(voxels, by))
            query = voxels.field("z").to_numpy(zero_copy_only=False) * sz[by]
            dist = np.sqrt(envelope_min(height[lane_of], value, depth[lane_of], lane, query))
            yield pa.RecordBatch.from_arrays([batch.column("case_id").take(pa.array(by)), voxels, pa.array(dist, mask=depth[by] == 0)], ["case_id", "v", "dist"])


def with_distance(rows: DataFrame, mask: DataFrame, cases: DataFrame, spacing: Sequence[str]) -> DataFrame:
    """All ``rows`` with their distance ``dist`` to the mask of their case, null without one; ``spacing`` names mm along x, y and z.

    Voxels are answered in tiles of ``TILE_X`` by ``TILE_Y`` columns; a tile meets every slice of its case's mask
    once. A slice and a tile with all its slices are the most that a task holds. A row goes along with its voxel, so
    that no join has to bring the two together again.
    """
    sp = cases.select("case_id", *[F.col(c).cast("double").alias(n) for c, n in zip(spacing, ("sx", "sy", "sz"))])
    whole = [F.col(a).cast("long").alias(a) for a in ("z", "y", "x")]
    rest = [c for c in rows.columns if c not in ("case_id", "z", "y", "x")]
    tile = ["case_id", "tx", "ty"]
    asked = rows.select("case_id", *whole, *rest).withColumn("tx", F.floor(F.col("x") / TILE_X)).withColumn("ty", F.floor(F.col("y") / TILE_Y))
    column = F.sort_array(F.collect_set(F.struct("x", "y"))).alias("columns")
    tiles = asked.groupBy(*tile).agg(column, F.collect_list(F.struct("x", "y", "z", *rest)).alias("voxels")).join(sp, "case_id", "left")
    # compressed, a table of tiles looks small enough to be broadcast and is not
    tiles = cut_lineage(tiles).hint("merge")
    slices = mask.select("case_id", *whole).groupBy("case_id", "z").agg(F.collect_list(F.struct("y", "x")).alias("g"))
    met = tiles.filter("sx IS NOT NULL AND sy IS NOT NULL AND sz IS NOT NULL").select(*tile, "columns", "sx", "sy").join(slices, "case_id").select(
        *tile, "z", "sx", "sy", F.col("g.y").alias("gy"), F.col("g.x").alias("gx"), F.col("columns.x").alias("cx"), F.col("columns.y").alias("cy")
    )
    # work per byte is high here, so partitions are set by number and not merged by size; tiles of a large case are dealt out
    kind = dict(rows.dtypes)["case_id"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = met.repartition(parts, *tile, "z").mapInArrow(_in_slices, f"case_id {kind}, tx bigint, ty bigint, z bigint, d array<double>")
    gathered = inside.repartition(parts, *tile).groupBy(*tile).agg(F.collect_list(F.struct("z", "d")).alias("slices"))
    answered = tiles.select(*tile, "columns", "voxels", "sz").join(gathered.hint("merge"), tile, "left").select("case_id", "sz", "slices", "columns", "voxels")
    voxel = answered.schema["voxels"].dataType.elementType
    out = answered.mapInArrow(_across_slices, StructType([answered.schema["case_id"], StructField("v", voxel), StructField("dist", DoubleType())]))
    typed = [F.col(f"v.{a}").cast(rows.schema[a].dataType).alias(a) for a in ("z", "y", "x")]
    return out.select("case_id", *typed, *[F.col("v")[c].alias(c) for c in rest], "dist")


def distance_to_mask(voxels: DataFrame, mask: DataFrame, cases: DataFrame, spacing: Sequence[str]) -> DataFrame:
    """(case_id, z, y, x, dist) of the distinct ``voxels`` of cases with a mask, as ``with_distance`` finds them."""
    whole = [F.col(a).cast("long").alias(a) for a in ("z", "y", "x")]
    return with_distance(voxels.select("case_id", *whole).distinct(), mask, cases, spacing).filter("dist IS NOT NULL")
