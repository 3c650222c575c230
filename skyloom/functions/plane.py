"""Two-dimensional versions of the geometry, for diagrams of tiles and beams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geometry import floor_mod, unit

Point = tuple[Column, Column]


def in_slice(x: Column, z: Column, r_max: float, axis=None, degrees: float | None = None) -> Column:
    """Whether a point of the x-z plane is within r_max of the observer, and within an angle of an axis if one is given (the observer
    itself is)."""
    r = F.sqrt(x * x + z * z)
    if axis is None:
        return r <= r_max
    axis = unit(axis)
    return (r <= r_max) & ((r == 0) | ((x * axis[0] + z * axis[2]) / r >= math.cos(math.radians(degrees))))


def transformed(p: Point, signs: tuple[int, int], degrees: float, centre: float) -> Point:
    """Reflected, then turned, about (centre, centre)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y = ((v - centre) * k for v, k in zip(p, signs, strict=True))
    return x * c - y * s + centre, x * s + y * c + centre


def shifted(p: Point, shift: tuple[float, float], box: float) -> Point:
    return tuple(floor_mod(v + d, box) for v, d in zip(p, shift, strict=True))  # type: ignore[return-value]


def reoriented(p: Point, shift: tuple[float, float], signs: tuple[int, int], degrees: float, cells: int = 4) -> Point:
    """Positions in cells, shifted within the box, then reflected and turned about its centre; not wrapped again."""
    return transformed(shifted(p, shift, cells), signs, degrees, cells / 2)


def tiled(objects: DataFrame, reorientations: list[tuple] | None, n_tiles: int, box: float = 1.0, cells: int = 4) -> DataFrame:
    """objects (x, z, radius in cells, and the rest) once in each of n tiles along x, with tile: in box units, the observer in the
    centre of tile 0; each tile's own (shift, signs, degrees), or none."""
    size = box / cells
    parts = []
    for n in range(n_tiles):
        at = (F.col("x"), F.col("z")) if reorientations is None else reoriented((F.col("x"), F.col("z")), *reorientations[n], cells=cells)
        placed = {"x": at[0] * size + (n - 0.5) * box, "z": at[1] * size - 0.5 * box, "radius": F.col("radius") * size}
        parts.append(F.struct(F.lit(n).alias("tile"), *[v.alias(f"m_{k}") for k, v in placed.items()]))
    kept = [c for c in objects.columns if c not in ("x", "z", "radius")]
    moved = objects.select(*kept, F.explode(F.array(*parts)).alias("m"))
    return moved.select("m.tile", *kept, *[F.col(f"m.m_{k}").alias(k) for k in ("x", "z", "radius")])


def on_sight_line(copies: DataFrame) -> DataFrame:
    """Copies ahead of the observer whose disc covers the line of sight along x, nearest first."""
    return copies.where((F.abs("z") <= F.col("radius")) & (F.col("x") > 0)).orderBy("x")


def wrong_positions(placed: DataFrame, box_positions: DataFrame, box: float, tolerance: float = 1e-6) -> DataFrame:
    """wrong: how many rows (id, x, y, z) of a view that turns no tile are not where their id is in the box, wrapped."""
    both = placed.join(box_positions.select("id", *[F.col(a).alias(f"b{a}") for a in "xyz"]), "id")
    off = [F.abs(floor_mod(F.col(a) + box / 2, box) - F.col(f"b{a}")) > tolerance for a in "xyz"]
    return both.agg(F.count_if(off[0] | off[1] | off[2]).alias("wrong"))
