"""Counts by distance, densities against the mean, percentiles, choices of haloes, and shells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.geometry import dot, norm, step, unit, vector


def bins_of(spark: SparkSession, edges: list[float]) -> DataFrame:
    """bin, lo, hi."""
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, lo double, hi double")


def bin_of(value: Column, edges: list[float]) -> Column:
    """The bin of a value (lo <= value < hi; the last also holds its upper edge), null outside: a tree of comparisons, no join."""

    def within(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(value < edges[middle], within(lo, middle)).otherwise(within(middle, hi))

    return F.when((value >= edges[0]) & (value <= edges[-1]), within(0, len(edges) - 1))


def counted(values: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """bin, lo, hi, n: lo <= value < hi; the last bin also holds its upper edge. Bins without values have n = 0."""
    bins = bins_of(values.sparkSession, edges)
    v = step(values.select(value.alias("__v")), __bin=F.lit(None).cast("int") if len(edges) < 2 else bin_of(F.col("__v"), edges))
    n = v.where("__bin is not null").groupBy(F.col("__bin").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def counted_in_view(placed: DataFrame, edges: list[float], half_angle: float | None = None, axis: tuple[float, float, float] | None = None) -> DataFrame:
    """counted by distance, of the rows (x, y, z) of a view, or of those within half_angle (radians) of an axis."""
    if axis is not None:
        along = dot(vector(), unit(axis))
        angle = F.atan2(norm(tuple(c - along * a for c, a in zip(vector(), unit(axis), strict=True))), along)  # type: ignore[arg-type]
        placed = placed.where(angle <= half_angle)
    return counted(placed, norm(vector()), edges)


def densities(counts: DataFrame, mean: float, half_angle: float | None = None) -> DataFrame:
    """counts with volume, expected, density and ratio to the mean density."""
    solid = 4 * math.pi if half_angle is None else 2 * math.pi * (1 - math.cos(half_angle))
    volume = F.lit(solid / 3) * (F.pow("hi", F.lit(3.0)) - F.pow("lo", F.lit(3.0)))
    return counts.withColumn("volume", volume).withColumns({"expected": F.col("volume") * mean, "density": F.col("n") / F.col("volume")}).withColumn("ratio", F.col("density") / mean)


def mean_density(points: DataFrame, box: float) -> DataFrame:
    """snap, mean: points to a unit of volume."""
    return points.groupBy("snap").agg((F.count("*") / box**3).alias("mean"))


def count_of_words(low: Column, high: Column) -> Column:
    """A 64-bit count from its low and high 32-bit words."""
    return low.cast("long") + F.shiftleft(high.cast("long"), 32)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.1587, 0.5, 0.8413)) -> DataFrame:
    """by..., p0, p1, ...: linear between the two nearest values."""
    p = F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("__p")
    return rows.groupBy(*by).agg(p).select(*by, *[F.col("__p")[i].alias(f"p{i}") for i in range(len(shares))])


def chosen_haloes(candidates: DataFrame, target: float, n: int, log_mass: str = "log_mass", index: str = "halo_index") -> DataFrame:
    """The n nearest to a target mass, first one of each snapshot, then the others; ties by snapshot and row. A snapshot's
    candidates are ranked within it, and only its first n go on."""
    d = F.abs(F.col(log_mass) - target)
    own = Window.partitionBy("snap").orderBy("__d", index)
    ranked = candidates.withColumn("__d", d).withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= n)
    return ranked.orderBy(F.col("__r") > 1, "__d", "snap", index).limit(n).drop("__d", "__r")


def nearest_mass(candidates: DataFrame, target: float, log_mass: str = "log_mass", index: str = "halo_index") -> DataFrame:
    best = F.min_by(F.struct("snap", index, log_mass), F.struct(F.abs(F.col(log_mass) - target), F.col("snap"), F.col(index)))
    return candidates.agg(best.alias("b")).select("b.*")


def shell_number(z: Column, shells: list[tuple[float, float]], none: int = 999) -> Column:
    """The shell (lo, hi] of each redshift, or `none`."""
    out = F.lit(none)
    for i, (lo, hi) in reversed(list(enumerate(shells))):
        out = F.when((z > lo) & (z <= hi), i).otherwise(out)
    return out


def shared_pieces(rows: list[int], workers: int) -> list[list[int]]:
    """Pieces dealt to workers, the longest first, each to the one with the least so far."""
    load, out = [0] * workers, [[] for _ in range(workers)]
    for i in sorted(range(len(rows)), key=lambda i: -rows[i]):
        w = min(range(workers), key=lambda k: load[k])
        load[w] += rows[i]
        out[w].append(i)
    return out
