"""Haloes of views: candidates by mass, haloes of a shell around a direction, and one snapshot's rows of a catalogue."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.operators import snapshots
from skyloom.plans.views import View, look_back

POSITION = ("hx", "hy", "hz")


def place_haloes(view: View, halos: DataFrame, z_min: float, z_max: float, columns: tuple[str, ...] = (), use: list[int] | None = None) -> DataFrame:
    """snap, halo_index, hx, hy, hz, redshift, expansion_factor and what else of the catalogue is asked for, of the haloes of a shell.
    Only positions are moved; the other columns are looked up for the haloes that are kept."""
    lacking = [c for c in (*POSITION, "halo_index", *columns) if c not in halos.columns]
    if lacking:
        raise ValueError(f"{', '.join(lacking)} not found")
    placed = view.halos(halos, z_min, z_max, use)
    return look_back(placed, halos, list(columns)) if columns else placed


def candidates(halos: DataFrame, outputs: DataFrame, z_max: float, log_mass: tuple[float, float], mass: str = "mass", z_min: float = 0.0) -> DataFrame:
    """The haloes, of the snapshots that overlap redshifts 0 to z_max (not only touch them) and begin at z_min or later, whose mass is
    within a closed range of log10."""
    served = snapshots.edges(outputs).where((F.col("z_lo") < z_max) & (F.col("z_hi") > 0) & (F.col("z_lo") >= z_min))
    # One row for each output.
    own = halos.join(F.broadcast(served.select("snap")), "snap", "left_semi")
    return own.where(F.col(mass).between(10 ** log_mass[0], 10 ** log_mass[1]))


def snapshot_haloes(halos: DataFrame, columns: list[str], snap: int) -> DataFrame:
    """The columns of one snapshot's haloes."""
    return halos.where(F.col("snap") == snap).select(*columns)


def around(halos: DataFrame, outputs: DataFrame, z_range: tuple[float, float], centre: tuple[float, float, float], radius: float, min_mass: float, mass: str = "mass", size: str = "radius", extra: tuple[str, ...] = ()) -> DataFrame:
    """Haloes of a light cone (snap, halo_index, hx, hy, hz, redshift, ...) within z_min < redshift <= z_max, `radius` radians of a
    direction and min_mass or more, of the snapshots that overlap the redshifts and one on either side: with vx, vy, vz (their
    directions), angular_radius and offset (from the centre, radians), and those extra columns that are there."""
    z_min, z_max = z_range
    edges = snapshots.edges(outputs)
    own = edges.where((F.col("z_lo") < z_max) & (F.col("z_hi") > z_min)).agg(F.min("snap").alias("lo"), F.max("snap").alias("hi")).first()
    if own["lo"] is None:
        raise ValueError(f"no snapshot overlaps redshifts {z_min} to {z_max}")
    axis, at = g.unit(centre), tuple(F.col(c) for c in POSITION)
    near = halos.where(F.col("snap").between(own["lo"] - 1, own["hi"] + 1) & (F.col("redshift") > z_min) & (F.col("redshift") <= z_max) & (F.col(mass) >= min_mass))
    near = g.staged(near, distance=g.norm(at), cosine=g.dot(at, axis) / g.norm(at))  # type: ignore[arg-type]
    near = near.where(g.done(F.col("cosine") >= math.cos(radius)))
    ways = [(F.col(c) / F.col("distance")).alias(f"v{a}") for c, a in zip(POSITION, g.AXES, strict=True)]
    offset = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))
    return near.select("snap", "halo_index", *POSITION, "redshift", mass, size, *ways, (F.col(size) / F.col("distance")).alias("angular_radius"), offset.alias("offset"), *[c for c in extra if c in halos.columns])


def drawn_order(halos: DataFrame, mass: str = "mass") -> DataFrame:
    """Haloes of positive mass with log_mass, ascending, so that the largest is drawn last."""
    return halos.where(F.col(mass) > 0).withColumn("log_mass", F.log10(mass)).orderBy("log_mass")
