"""Copies of the same cell that lie close together in a view.

Copies pair up by an equi-join on the cell and on a coarse 3-D bucket as wide as the search radius (a copy looks into the 27
buckets around it), so that the work grows with close pairs and not with the square of a cell's copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.plans.stage import written

TOUCHING, SAME_PLACE, PERIODIC = 1e-6, 1e-6, 1e-6
LABEL = ("nx", "ny", "nz")


def cell_copies(view, pieces: DataFrame, cells: int) -> DataFrame:
    """snap, cell, tile, layer (-1: none), row, x, y, z: each cell of each piece that overlaps its shell.

    Under the sphere lock a tile's pieces of several layers may hold one copy twice; the first layer's stays.
    """
    held = view.cells_in_pieces(pieces, view.grid(pieces, cells), cells)
    out = held.select("snap", "cell", *LABEL, F.coalesce("layer", F.lit(-1)).alias("layer"), "row", *[F.col(f"at_{a}").alias(a) for a in g.AXES])
    if view.lock != "sphere":
        return out
    place = [F.round(F.col(a) / (view.box / cells) * 1000).cast("long") for a in g.AXES]
    first = F.row_number().over(Window.partitionBy("snap", "cell", "row", *place).orderBy("layer", *LABEL))
    return out.withColumn("__n", first).where("__n = 1").drop("__n")


def pair_counts(copies: DataFrame, window: int | None = 1) -> DataFrame:
    """cell, copies, pairs: pairs of copies whose snapshots differ by `window` at most (None: any)."""
    n = copies.groupBy("cell", "snap").agg(F.count("*").alias("n"))
    a, b = n.select("cell", F.col("snap").alias("s"), F.col("n").alias("a")), n.select("cell", F.col("snap").alias("t"), F.col("n").alias("b"))
    near = F.lit(True) if window is None else F.abs(F.col("s") - F.col("t")) <= window
    both = a.join(b, "cell").where((F.col("s") <= F.col("t")) & near)
    ways = F.when(F.col("s") == F.col("t"), F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b"))
    return both.groupBy("cell").agg(F.sum(F.when(F.col("s") == F.col("t"), F.col("a")).otherwise(0)).alias("copies"), F.sum(ways).cast("long").alias("pairs"))


def _uid(df: DataFrame) -> DataFrame:
    return df.withColumn("uid", F.struct("snap", *LABEL, "layer"))


def search_radius(cell_size: float, box: float, los: float | None = None, max_separation: float | None = None) -> float:
    """How far apart reported copies may be: `los` (None: the box) plus a cell's diagonal, a cell's side, or max_separation."""
    return max((box if los is None else los) + 3**0.5 * cell_size, (1 + TOUCHING) * cell_size, max_separation or 0.0)


def close_pairs(copies: DataFrame, cell_size: float, box: float, window: int | None = 1, angle: float | None = None, los: float | None = None, max_separation: float | None = None, radius: float | None = None) -> DataFrame:
    """Pairs of copies of a cell within a radius, each once: separation, los_separation, angle, touching, line_of_sight.

    window: the largest difference of their snapshots (None: any). Pairs at the same place are left out. touching: their
    separation is a cell's side. line_of_sight: within `angle` radians as seen by the observer and `los` along the sight,
    and not a periodic replica (same row and an offset of whole boxes). radius: search_radius if None; a smaller one loses
    pairs along a line of sight.
    """
    radius = search_radius(cell_size, box, los, max_separation) if radius is None else radius
    side = [F.floor(F.col(a) / radius).cast("long") for a in g.AXES]
    keyed = _uid(copies).select("cell", "snap", *LABEL, "layer", "row", *g.AXES, "uid", *[s.alias(f"b{a}") for s, a in zip(side, g.AXES, strict=True)])
    looks = keyed
    for a in g.AXES:
        looks = looks.withColumn(f"b{a}", F.explode(F.sequence(F.col(f"b{a}") - 1, F.col(f"b{a}") + 1)))
    keys = ["cell", "bx", "by", "bz"]
    named = lambda df, p: df.select(*keys, *[F.col(c).alias(p + c) for c in ("snap", *LABEL, "layer", "row", *g.AXES, "uid")])
    near = F.lit(True) if window is None else F.abs(F.col("a_snap") - F.col("b_snap")) <= window
    pairs = named(looks, "a_").join(named(keyed, "b_"), keys).where((F.col("a_uid") < F.col("b_uid")) & near)
    d = tuple(F.col(f"a_{a}") - F.col(f"b_{a}") for a in g.AXES)
    pairs = pairs.withColumn("separation", g.norm(d)).where((F.col("separation") <= radius) & (F.col("separation") > SAME_PLACE * cell_size))
    ra, rb = g.norm(g.vector("a_")), g.norm(g.vector("b_"))
    cosine = g.dot(g.vector("a_"), g.vector("b_")) / (ra * rb)
    pairs = pairs.withColumns({"los_separation": F.abs(ra - rb), "angle": F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))), "touching": F.abs(F.col("separation") - cell_size) <= TOUCHING * cell_size})
    whole = lambda x: F.abs(x / box - F.rint(x / box)) < PERIODIC
    periodic = (F.col("a_row") == F.col("b_row")) & whole(d[0]) & whole(d[1]) & whole(d[2])
    seen = F.lit(False) if angle is None else (F.col("angle") <= angle) & (F.col("los_separation") <= (box if los is None else los)) & ~periodic
    return pairs.withColumn("line_of_sight", seen).drop("bx", "by", "bz", "a_uid", "b_uid")


def closest_copy(copies: DataFrame, cell_size: float, box: float, window: int | None = 1, radius: float | None = None) -> DataFrame:
    """cell, snap, tile, layer, closest: the distance to the nearest other copy, null if there is none within the radius (None: search_radius)."""
    pairs = close_pairs(copies, cell_size, box, window, radius=radius)
    ends = [pairs.select("cell", *[F.col(p + c).alias(c) for c in ("snap", *LABEL, "layer")], "separation") for p in ("a_", "b_")]
    best = ends[0].union(ends[1]).groupBy("cell", "snap", *LABEL, "layer").agg(F.min("separation").alias("closest"))
    return copies.select("cell", "snap", *LABEL, "layer").join(best, ["cell", "snap", *LABEL, "layer"], "left")


def touching_faces(pairs: DataFrame) -> DataFrame:
    """cell, tiles: distinct touching cells of unordered pairs of tiles."""
    tiles = F.array_sort(F.array(*[F.array(*[F.col(p + c) for c in (*LABEL, "layer")]) for p in ("a_", "b_")]))
    return pairs.where("touching").select("cell", tiles.alias("tiles")).distinct()


@dataclass(frozen=True)
class Report:
    """A replica check: copies, pairs, and one row of totals."""

    copies: DataFrame
    pairs: DataFrame
    settings: dict

    def totals(self) -> dict[str, int]:
        p = self.pairs.agg(F.count("*").alias("pairs"), F.count_if("touching").alias("touching"), F.count_if("line_of_sight").alias("line_of_sight")).first()
        return {"copies": self.copies.count(), **p.asDict(), "touching_faces": touching_faces(self.pairs).count()}

    def summary(self) -> str:
        t = self.totals()
        return f"{t['copies']} cell copies, {t['pairs']} close pairs, {t['touching_faces']} touching faces ({t['touching']} pairs), {t['line_of_sight']} along a line of sight"

    def write(self, path: str) -> None:
        """pairs, cells and report folders of Parquet."""
        spark = self.pairs.sparkSession
        self.pairs.write.parquet(f"{path}/pairs")
        self.copies.groupBy("snap", "cell").agg(F.count("*").alias("copies")).write.parquet(f"{path}/cells")
        row = {**{k: str(v) for k, v in self.settings.items()}, **{k: str(v) for k, v in self.totals().items()}}
        spark.createDataFrame(list(row.items()), "name string, value string").write.parquet(f"{path}/report")


def check(view, z_min: float, z_max: float, cells: int, angle: float | None = None, los: float | None = None, window: int | None = 1, max_separation: float | None = None) -> Report:
    copies = written(cell_copies(view, view.pieces(z_min, z_max), cells), "copies")
    radius = search_radius(view.box / cells, view.box, los, max_separation)
    pairs = close_pairs(copies, view.box / cells, view.box, window, angle, los, radius=radius)
    return Report(copies, pairs, {**view.metadata((z_min, z_max)), "cells": cells, "radius": radius, "window": window})


def best_case(reports: DataFrame) -> DataFrame:
    """Of rows (case, touching, line_of_sight) the one with the fewest touching, then line-of-sight, pairs; ties by case."""
    return reports.agg(F.min(F.struct("touching", "line_of_sight", "case")).alias("b")).select("b.*")


def missing_and_odd(found: DataFrame, expected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Expected rows that are not found; found rows that are not expected or repeated (with n)."""
    repeated = found.groupBy(*keys).agg(F.count("*").alias("n"))
    odd = repeated.join(expected.select(*keys).withColumn("__e", F.lit(1)), keys, "left").where("n > 1 or __e is null").select(*keys, "n")
    return expected.join(found, keys, "left_anti"), odd


def lattice_points(spark, box: float, spacing: float) -> DataFrame:
    """id, x, y, z: points at (i + 1/2) spacing."""
    n = round(box / spacing)
    at = lambda e: (e + 0.5) * spacing
    i = F.col("id")
    return spark.range(n**3).select("id", at(F.floor(i / (n * n))).alias("x"), at(F.floor(i / n) % n).alias("y"), at(i % n).alias("z"))


