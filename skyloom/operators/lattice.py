"""Lattice tiles that a shell crosses, their split into layers, the cells of a box, and plans of what to read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.geometry import buffer_radius, cell_index, dot, in_cone_shell, in_sphere_shell, norm, unit, vector

TILE = ("nx", "ny", "nz")


def _near_far(box: float) -> tuple[Column, Column]:
    """Distances of a tile's nearest and farthest points."""
    squares = lambda f: F.sqrt(sum((F.pow(f(F.abs(F.col(t)) * box), F.lit(2.0)) for t in TILE), F.lit(0.0)))
    return squares(lambda c: F.greatest(c - box / 2, F.lit(0.0))), squares(lambda c: c + box / 2)


def _lattice(shells: DataFrame, low: list[Column], high: list[Column]) -> DataFrame:
    for t, lo, hi in zip(TILE, low, high, strict=True):
        shells = shells.withColumn(t, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    return shells


def sphere_tiles(shells: DataFrame, box: float) -> DataFrame:
    """shells (with r_lo, r_hi) and nx, ny, nz of each tile that touches the shell: a row for each of about
    4 pi/3 (r_hi/box)^3 tiles, made where the shells are and never on the driver."""
    reach = F.floor(F.col("r_hi") / box + 0.5)
    near, far = _near_far(box)
    return _lattice(shells, [-reach] * 3, [reach] * 3).where((near <= F.col("r_hi")) & (far >= F.col("r_lo")))


def cone_tiles(shells: DataFrame, box: float, axis, half_angle: float) -> DataFrame:
    """The same for a cone: tiles in the cone's bounding box, in reach by distance, whose bounding sphere reaches into it."""
    axis = unit(axis)
    low, high = [], []
    for a in axis:
        ends = [F.col("r_lo") * (math.cos(half_angle) * a), F.col("r_hi") * a]
        spread = F.col("r_hi") * (math.sin(half_angle) * math.sqrt(max(0.0, 1 - a * a)))
        low.append(F.floor((F.least(*ends) - spread) / box + 0.5))
        high.append(F.floor((F.greatest(*ends) + spread) / box + 0.5))
    near, far = _near_far(box)
    centre = tuple(F.col(t) * box for t in TILE)
    d, ball = norm(centre), math.sqrt(3) / 2 * box
    cosine = F.least(F.greatest(dot(centre, axis) / F.when(d > 0, d), F.lit(-1.0)), F.lit(1.0))
    reaches = (d <= ball) | (F.acos(cosine) <= half_angle + F.asin(F.least(F.lit(ball) / F.when(d > 0, d), F.lit(1.0))))
    return _lattice(shells, low, high).where((near <= F.col("r_hi")) & (far >= F.col("r_lo")) & reaches)


def split_layers(pieces: DataFrame, box: float) -> DataFrame:
    """Each tile once for each spherical layer ((k-1/2) box, (k+1/2) box] that it crosses within its shell, r_lo and r_hi held to it."""
    near, far = _near_far(box)
    first = F.ceil(F.greatest(near, F.col("r_lo")) / box - 0.5)
    last = F.ceil(F.least(far, F.col("r_hi")) / box - 0.5)
    out = pieces.withColumn("layer", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.greatest(last, first, F.lit(0)).cast("int"))))
    lo, hi = (F.col("layer") - 0.5) * box, (F.col("layer") + 0.5) * box
    held = out.withColumns({"r_lo": F.greatest("r_lo", lo), "r_hi": F.least("r_hi", hi)})
    return held.where("r_lo < r_hi").where((near <= F.col("r_hi")) & (far >= F.col("r_lo")))


def framed(pieces: DataFrame, frame: list[list[int]]) -> DataFrame:
    """pieces with the beam's labels (lx, ly, l_los) of their tiles."""
    labels = [sum((F.col(t) * k for t, k in zip(TILE, row, strict=True)), F.lit(0)) for row in frame]
    return pieces.select("*", *[x.cast("int").alias(n) for x, n in zip(labels, ("lx", "ly", "l_los"), strict=True)])


def lattice_tile(labels: DataFrame, frame: list[list[int]]) -> DataFrame:
    """The tiles of beam labels: the frame's transpose."""
    back = [sum((F.col(n) * frame[i][j] for i, n in enumerate(("lx", "ly", "l_los"))), F.lit(0)) for j in range(3)]
    return labels.withColumns({t: x.cast("int") for t, x in zip(TILE, back, strict=True)})


# Cells.


def cell_grid(spark: SparkSession, box: float, cells: int) -> DataFrame:
    """cell, cx, cy, cz: the cells' centres."""
    size = box / cells
    df = spark.range(cells**3).select(F.col("id").cast("int").alias("cell"))
    at = [F.floor(F.col("cell") / (cells * cells)), F.floor(F.col("cell") / cells) % cells, F.col("cell") % cells]
    return df.select("cell", *[((a + 0.5) * size).alias(f"c{x}") for a, x in zip(at, "xyz", strict=True)])


def with_cells(points: DataFrame, box: float, cells: int) -> DataFrame:
    return points.withColumn("cell", cell_index(vector(), box, cells))


def cell_table(points: DataFrame, box: float, cells: int, files: int = 1) -> DataFrame:
    """snap, cell, cx, cy, cz, cnt, file, first: the zone map of points laid out by cell; first counts within the cell's file."""
    counts = with_cells(points, box, cells).groupBy("snap", "cell").agg(F.count("*").alias("cnt"))
    placed = counts.join(cell_grid(points.sparkSession, box, cells), "cell").withColumn("file", F.col("cell") % files)
    before = Window.partitionBy("snap", "file").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("snap", "cell", "cx", "cy", "cz", "cnt", "file", F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("first"))


def near_shell(v, axis, half_angle: float | None, r_lo, r_hi, buffer: float) -> Column:
    return in_sphere_shell(norm(v), r_lo, r_hi, buffer) if axis is None else in_cone_shell(v, axis, half_angle, r_lo, r_hi, buffer)


def cell_buffer(box: float, cells: int) -> float:
    return buffer_radius(box / cells, "cube")


def merged_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, cnt: adjoining row ranges joined into runs; empty ranges are dropped."""
    w = Window.partitionBy(*keys).orderBy("first")
    marked = ranges.where("cnt > 0").withColumn("__new", (F.coalesce(F.lag(F.col("first") + F.col("cnt")).over(w), F.lit(-1)) != F.col("first")).cast("int"))
    runs = marked.withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run").agg(F.min("first").alias("first"), F.sum("cnt").alias("cnt")).drop("__run")
