"""Numbers for axes and outlines of plots: rounding, tick series, arcs and the edge of a beam on the sky."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.geometry import cross, sky_coordinates, unit

#: Sizes that a small tick's leading digits may have. Fixed values.
NICE = (1.0, 2.0, 2.5, 5.0, 10.0, 30.0)


def tens_below(x: Column) -> Column:
    """The multiple of ten at or below x."""
    return (F.floor(x / 10) * 10).cast("long")


def two_digits_above(x: Column) -> Column:
    """x rounded up at its second digit; 0 stays."""
    unit_of = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 1)
    return F.when(x == 0, 0.0).otherwise(F.ceil(x / unit_of) * unit_of)


def magnitude(x: Column) -> Column:
    return F.floor(F.log10(x))


def upright(degrees: Column) -> Column:
    """A text's angle turned by half a turn if it is upside down."""
    return F.when(degrees > 90, degrees - 180).when(degrees < -90, degrees + 180).otherwise(degrees)


def small_spacing(spacing: float, most: int = 5, least: int = 2) -> float:
    """The spacing of small ticks between two ticks: as many of them, from `most` down to `least`, as make it a nice number; a third
    of the spacing if none does."""
    for ticks in range(most, least - 1, -1):
        part = spacing / (ticks + 1)
        lead = part / 10 ** math.floor(math.log10(abs(part)))
        if any(math.isclose(lead, nice, rel_tol=1e-5, abs_tol=1e-8) for nice in NICE):
            return part
    return spacing / 3


def distance_ticks(low: float, high: float) -> tuple[list[float] | None, list[float]]:
    """Ticks and small ticks of an axis from low to high; no ticks (None) if their spacing is under ten."""
    reach = 2 * 10 ** (math.floor(math.log10(high)) + 1)
    spacing = math.floor(small_spacing(high - low, 10, 2) / 10) * 10
    inside = lambda step: [t for t in np.arange(0, reach, step).tolist() if low <= t <= high]
    small = small_spacing(spacing if spacing > 0 else high - low, 5, 1)
    return (inside(spacing) if spacing > 0 else None), inside(small)


def angle_ticks(radius: float, spacing: float | None, small: float | str | None = "auto", offset: float = 0.0) -> tuple[list[float] | None, list[float] | None]:
    """Ticks and small ticks from -radius to radius degrees. Spacings of five degrees or less grow beyond 45 degrees of radius: to 30
    where that divides the whole beam (over 90), else to a nice multiple of ten."""
    if small == "auto":
        small = None if spacing is None else small_spacing(spacing)
    if spacing is not None and spacing <= 5 and radius > 45:
        wide = radius > 90 and (2 * radius) % 30 == 0
        spacing = 30 if wide else max(10, math.floor(small_spacing(2 * radius, 10, 5) / 10) * 10)
        small = small_spacing(spacing)
    if small is not None and spacing is not None and small >= spacing:
        small = None

    def up_to(step: float, first: float) -> list[float]:
        return [t for t in np.arange(first, radius + offset / 2 + step, step).tolist() if t <= radius]

    mirrored = lambda t, zero: [*(-x for x in reversed(t)), *(t[1:] if zero else t)]
    return (None if spacing is None else mirrored(up_to(spacing, 0.0), True)), (None if small is None else mirrored(up_to(small, small), False))


def arc(spark: SparkSession, distance: float, degrees: float | None, n: int = 360) -> DataFrame:
    """i, x, y: n points of an arc from -degrees to degrees, or of a whole circle."""
    low, high = (0.0, 2 * math.pi) if degrees is None else (-math.radians(degrees), math.radians(degrees))
    at = low + F.col("i") * F.lit((high - low) / (n - 1))
    return spark.range(n).toDF("i").select("i", (distance * F.cos(at)).alias("x"), (distance * F.sin(at)).alias("y"))


def beam_outline(spark: SparkSession, axis, degrees: float, n: int = 721) -> DataFrame:
    """i, lon, lat (radians): n points of the edge of a beam, the last as the first. Longitudes go on beyond -pi or pi rather than jump:
    each is the one, of those that differ by whole turns, that is nearest to the one before."""
    if not 0 < degrees < 180:
        raise ValueError(f"a beam is between 0 and 180 degrees wide to a side, not {degrees}")
    from pyspark.sql import Window

    axis = unit(axis)
    first = unit(cross(axis, (0.0, 0.0, 1.0) if abs(axis[2]) < 0.9 else (1.0, 0.0, 0.0)))
    second = cross(axis, first)
    c, s, phi = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), F.col("i") * F.lit(2 * math.pi / (n - 1))
    edge = tuple(c * axis[k] + s * (F.cos(phi) * first[k] + F.sin(phi) * second[k]) for k in range(3))
    lon, lat = sky_coordinates(edge)  # type: ignore[arg-type]
    # n points, one task.
    order = Window.orderBy("i")
    jump = F.col("raw") - F.lag("raw").over(order)
    turns = F.when(jump > math.pi, -1).when(jump < -math.pi, 1).otherwise(0)
    points = spark.range(n).toDF("i").select("i", lon.alias("raw"), lat.alias("lat")).withColumn("turn", turns)
    return points.select("i", (F.col("raw") + 2 * math.pi * F.sum("turn").over(order)).alias("lon"), "lat")


def beam_label(axis) -> str:
    """The components of a direction, as short as they can be written, for titles and file names."""
    return "_".join(f"{v:g}" for v in axis)


def one_line(latex: Column) -> Column:
    r"""A LaTeX unit with \frac{a}{b} as a/b."""
    return F.regexp_replace(latex, r"\\frac\{(.+?)\}\{(.+?)\}", "$1/$2")


def sorted_rows(df: DataFrame) -> DataFrame:
    """Rows by all columns in order, for comparisons without regard to order."""
    return df.orderBy(*df.columns)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
