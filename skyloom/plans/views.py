"""Views of a periodic box: which pieces a shell is made of, and the rows that they place.

A piece is (snap, tile, layer, r_lo, r_hi, orientation). The points of a snapshot are joined to its pieces, moved, and filtered;
with a cell column the join is on (snap, cell), after cells have been held against every piece with a buffer of half a cell's
diagonal. Pieces, and the cells near them, are made once (stage.fixed): a few for each tile that the shell crosses, broadcast if
they are counted to be few and joined by shuffle beyond.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.functions.cosmology import Cosmology, expansion_factor, redshift_column
from skyloom.operators import lattice, snapshots
from skyloom.operators.orientation import MATRIX, Table
from skyloom.plans.stage import fixed

MAX_CONE_DEGREES = 60.01
SETTINGS = ("box", "geometry", "axis", "half_angle_deg", "lock", "seed", "table", "rows", "h", "omega_m", "z_min", "z_max")


@dataclass(frozen=True)
class View:
    """A view of the whole sky, or of a cone if axis and half_angle_deg are given."""

    spark: SparkSession
    outputs: DataFrame
    cosmology: Cosmology
    table: Table
    box: float
    lock: str | None = None
    seed: int = 0
    axis: tuple[float, float, float] | None = None
    half_angle_deg: float | None = None
    available: DataFrame | None = None

    def __post_init__(self):
        if self.lock not in g.LOCKS:
            raise ValueError(f"unknown lock {self.lock!r}")
        if (self.axis is None) != (self.half_angle_deg is None):
            raise ValueError("a cone has an axis and an angle")
        if self.axis is not None:
            object.__setattr__(self, "axis", g.unit(self.axis))
            if not 0 < self.half_angle_deg <= MAX_CONE_DEGREES:
                raise ValueError(f"half angles lie between 0 and {MAX_CONE_DEGREES} degrees")

    @property
    def half_angle(self) -> float | None:
        return None if self.half_angle_deg is None else math.radians(self.half_angle_deg)

    @property
    def frame(self) -> list[list[int]] | None:
        return None if self.axis is None else g.tile_frame(self.axis)

    def metadata(self, z_range: tuple[float, float] | None = None) -> dict[str, str]:
        """The settings, by name; absent ones are "none"."""
        values = (self.box, "sky" if self.axis is None else "cone", self.axis, self.half_angle_deg, self.lock, self.seed, self.table.fingerprint(), len(self.table), self.cosmology.h, self.cosmology.omega_m, *(z_range or (None, None)))
        return {k: "none" if v is None else ",".join(map(repr, v)) if isinstance(v, tuple) else str(v) for k, v in zip(SETTINGS, values, strict=True)}

    def snapshots(self, z_min: float, z_max: float, tolerance: float = 1e-5, use: list[int] | None = None) -> DataFrame:
        """snap, z_lo, z_hi, r_lo, r_hi: what each available snapshot serves of a shell; a few hundred rows at most."""
        outputs = self.outputs
        have = outputs.select("snap") if self.available is None else self.available.select("snap")
        if use is not None:
            lacking = self.spark.createDataFrame([(s,) for s in use], "snap int").join(have, "snap", "left_anti").collect()
            if lacking:
                raise FileNotFoundError(f"snapshots {sorted(r['snap'] for r in lacking)} are not there")
            have = have.where(F.col("snap").isin(list(use)))
        if use is None:
            used, _, _ = snapshots.coverage(outputs, have, z_min, z_max, snapshots.max_spacing(self.spark), tolerance)
        else:
            used = snapshots.edges(outputs).join(have, "snap", "left_semi")
        rows = snapshots.clipped(used, z_min, z_max).orderBy(F.desc("snap")).collect()
        d = self.cosmology.distance
        return self.spark.createDataFrame([(r["snap"], r["z_lo"], r["z_hi"], d(r["z_lo"]), d(r["z_hi"])) for r in rows], "snap int, z_lo double, z_hi double, r_lo double, r_hi double")

    def tiles(self, shells: DataFrame) -> DataFrame:
        return lattice.sphere_tiles(shells, self.box) if self.axis is None else lattice.cone_tiles(shells, self.box, self.axis, self.half_angle)

    def oriented(self, tiles: DataFrame) -> DataFrame:
        """Pieces of tiles: layer (null unless locked to spheres), row, and the orientation's columns."""
        if self.lock == "sphere":
            tiles = lattice.split_layers(tiles, self.box)
            layer = F.col("layer")
        else:
            tiles, layer = tiles.withColumn("layer", F.lit(None).cast("int")), None
        row = g.orientation_row(tuple(F.col(t) for t in lattice.TILE), len(self.table), self.seed, self.lock, layer)
        return tiles.withColumn("row", row).join(F.broadcast(self.table.frame(self.spark)), "row")

    def pieces(self, z_min: float, z_max: float, use: list[int] | None = None) -> DataFrame:
        """snap, tile, layer, r_lo, r_hi, row and the orientation's columns of each piece of a shell, made once."""
        return fixed(self.oriented(self.tiles(self.snapshots(z_min, z_max, use=use))), "pieces")

    def moved(self, v: g.Vector) -> g.Vector:
        """Box coordinates to lattice positions of the row's piece."""
        m = [F.col(c) for c in MATRIX]
        shift = tuple(g.cell_shift(F.col(f"s{a}"), self.box) for a in g.AXES)
        return g.placed(g.reoriented(v, m, shift, self.box), tuple(F.col(t) for t in lattice.TILE), self.box)

    def _kept(self, df: DataFrame, position: tuple[str, str, str], buffer: float = 0.0, method: str = "exact") -> DataFrame:
        """The rows of df (box coordinates in the columns named, and their piece's columns) that are in their piece, with at_x, at_y,
        at_z: their lattice positions. Positions, distances and the test are steps of their own."""
        if method not in ("exact", "approx", "all"):
            raise ValueError(f"unknown method {method!r}")
        at = g.vector("at_")
        df = g.step(df, **dict(zip(("at_x", "at_y", "at_z"), self.moved(tuple(F.col(c) for c in position)), strict=True)))  # type: ignore[arg-type]
        buffer = 2.0 if method == "approx" else buffer
        if method == "all":
            return df
        if self.axis is None:
            df = g.staged(df, at_r=g.norm(at))
            test = g.in_sphere_shell(F.col("at_r"), F.col("r_lo"), F.col("r_hi"), buffer)
        else:
            df = g.staged(df, at_r=g.norm(at), at_along=g.dot(at, self.axis))
            test = g.in_cone_at(F.col("at_r"), F.col("at_along"), at, self.axis, self.half_angle, F.col("r_lo"), F.col("r_hi"), buffer)
        return df.where(g.done(test)).drop(g.STEP, "at_r", "at_along")

    def cells_in_pieces(self, pieces: DataFrame, cells: DataFrame, n: int) -> DataFrame:
        """pieces and the cells (snap, cell, cx, cy, cz, ...) whose moved centre (at_x, at_y, at_z) is within half a diagonal of the piece."""
        return self._kept(cells.join(pieces, "snap"), ("cx", "cy", "cz"), lattice.cell_buffer(self.box, n))

    def grid(self, pieces: DataFrame, n: int) -> DataFrame:
        """snap, cell, cx, cy, cz: every cell for each snapshot of the pieces (a few hundred at most)."""
        snaps = sorted(r["snap"] for r in pieces.select("snap").distinct().collect())
        grid = lattice.cell_grid(self.spark, self.box, n)
        return grid.select(F.explode(F.array(*map(F.lit, snaps)).cast("array<int>")).alias("snap"), "*")

    def file_plan(self, pieces: DataFrame, cells: DataFrame, n: int) -> DataFrame:
        """snap, tile, layer, file, ranges, n_rows: adjoining row ranges to read for each piece; files without rows are left out."""
        keys = ["snap", *lattice.TILE, "layer", "file"]
        runs = lattice.merged_ranges(self.cells_in_pieces(pieces, cells, n).select(*keys, "first", "cnt"), keys)
        return runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "cnt"))).alias("ranges"), F.sum("cnt").alias("n_rows"))

    def place(self, points: DataFrame, pieces: DataFrame, position: tuple[str, str, str] = g.AXES, velocity: tuple[str, str, str] | None = None, cells: int | None = None, method: str = "exact") -> DataFrame:
        """points at their lattice positions in each piece of their snapshot, with the piece's tile and layer.

        cells: points have a cell column of a grid of so many cells an axis; only cells near a piece are joined to it.
        """
        columns = [c for c in points.columns if c not in (*position, *(velocity or ()))]
        keys, plan = ["snap"], pieces
        if cells:
            near = self.cells_in_pieces(pieces, self.grid(pieces, cells), cells).drop("cx", "cy", "cz", "at_x", "at_y", "at_z")
            plan, keys = fixed(near, "cells"), ["snap", "cell"]
        kept = self._kept(points.join(plan, keys), position, method=method)
        turned = g.turned(tuple(F.col(c) for c in velocity), [F.col(m) for m in MATRIX]) if velocity else ()  # type: ignore[arg-type]
        moved = [F.col(f"at_{a}").alias(c) for a, c in zip(g.AXES, position, strict=True)]
        return kept.select(*columns, *moved, *[x.cast(points.schema[c].dataType).alias(c) for x, c in zip(turned, velocity or (), strict=True)], *lattice.TILE, "layer")

    def with_expansion(self, placed: DataFrame, position: tuple[str, str, str] = g.AXES) -> DataFrame:
        """placed with redshift and expansion_factor at each row's distance."""
        r = g.norm(tuple(F.col(c) for c in position))  # type: ignore[arg-type]
        return placed.withColumn("redshift", redshift_column(self.cosmology, r)).withColumn("expansion_factor", expansion_factor(F.col("redshift")))

    def points(self, points: DataFrame, z_min: float, z_max: float, columns: list[str] | None = None, use: list[int] | None = None, cells: int | None = None) -> DataFrame:
        """The rows of a shell: requested columns, id and position, snap, expansion factor. velocities come along if asked for."""
        wanted = list(dict.fromkeys(["snap", "id", *(columns or [c for c in points.columns if c not in ("snap", "id")]), *g.AXES, *(["cell"] if cells else [])]))
        lacking = [c for c in wanted if c not in points.columns]
        if lacking:
            raise ValueError(f"{', '.join(lacking)} not found")
        velocity = ("vx", "vy", "vz") if {"vx", "vy", "vz"} <= set(wanted) else None
        return self.with_expansion(self.place(points.select(*wanted), self.pieces(z_min, z_max, use), velocity=velocity, cells=cells))

    def halos(self, halos: DataFrame, z_min: float, z_max: float, use: list[int] | None = None) -> DataFrame:
        """snap, halo_index, hx, hy, hz, redshift, expansion_factor of the haloes of a shell."""
        position = ("hx", "hy", "hz")
        placed = self.place(halos.select("snap", "halo_index", *position), self.pieces(z_min, z_max, use), position=position)
        return self.with_expansion(placed, position).select("snap", "halo_index", *position, "redshift", "expansion_factor")

    def whole_sky(self) -> View:
        return replace(self, axis=None, half_angle_deg=None)


def look_back(placed: DataFrame, catalogue: DataFrame, columns: list[str], keys: tuple[str, ...] = ("snap", "halo_index")) -> DataFrame:
    """placed with columns of the catalogue by snapshot and row; ValueError if a row is not there. Duplicates are fine."""
    out = placed.join(catalogue.select(*keys, *columns, F.lit(True).alias("__found")), list(keys), "left")
    if not out.where("__found is null").isEmpty():
        raise ValueError("some haloes are not in the catalogue")
    return out.drop("__found")
