"""Which snapshot serves which redshifts: edges, overlaps, gaps and their filling.

outputs: snap int, z double, strictly decreasing in snap order. A simulation has tens to a few hundred outputs, so the windows
over all of them (one partition) are over a table of known small size.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONF, MAX_SPACING, LOUD_SPACING = "skyloom.maxSnapshotSpacing", 0.1, 0.25


def _order():
    return Window.orderBy("snap")


def check_outputs(outputs: DataFrame) -> DataFrame:
    """outputs as they are; ValueError unless there are two at least and redshifts strictly decrease."""
    n, bad = outputs.withColumn("d", F.col("z") - F.lag("z").over(_order())).agg(F.count("*"), F.count_if(F.col("d") >= 0)).first()
    if n < 2 or bad:
        raise ValueError("output redshifts must be two at least and strictly decrease")
    return outputs


def max_spacing(spark) -> float:
    """The widest allowed gap between outputs, from the session; warns beyond 0.1, and more beyond 0.25."""
    text = spark.conf.get(CONF, str(MAX_SPACING))
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not value > 0:
        raise ValueError(f"{CONF} must be a positive number, not {text!r}")
    if value > LOUD_SPACING:
        warnings.warn(f"{CONF} is {value}: structure evolves visibly over such gaps", stacklevel=2)
    elif value > MAX_SPACING:
        warnings.warn(f"{CONF} is above {MAX_SPACING}", stacklevel=2)
    return value


def edges(outputs: DataFrame, first: float | None = None, last: float | None = None) -> DataFrame:
    """snap, z, z_lo, z_hi: each output serves up to the mid-points to its neighbours; the ends serve up to themselves, or to
    the given redshifts of the first (highest) and last output of a fuller table."""
    high = F.coalesce((F.lag("z").over(_order()) + F.col("z")) / 2, F.lit(first), F.col("z"))
    low = F.coalesce((F.lead("z").over(_order()) + F.col("z")) / 2, F.lit(last), F.col("z"))
    return outputs.select("snap", "z", low.alias("z_lo"), high.alias("z_hi"))


def available_edges(outputs: DataFrame, available: DataFrame) -> DataFrame:
    """edges of the available outputs, reaching as far as all outputs do."""
    ends = outputs.agg(F.max("z").alias("a"), F.min("z").alias("b")).first()
    return edges(outputs.join(available.select("snap"), "snap", "left_semi"), ends["a"], ends["b"])


def range_of(outputs: DataFrame, snap: int) -> tuple[float, float]:
    """(z_lo, z_hi) of an output; a negative number counts from the end."""
    rows = edges(outputs).orderBy("snap").collect()
    if not -len(rows) <= snap < len(rows) and not any(r["snap"] == snap for r in rows):
        raise IndexError(f"no output {snap}")
    row = rows[snap] if snap < 0 else next((r for r in rows if r["snap"] == snap), None)
    if row is None:
        raise IndexError(f"no output {snap}")
    return row["z_lo"], row["z_hi"]


def overlaps(low: Column, high: Column, z_min: float, z_max: float, tolerance: float = 1e-9, strict: bool = False) -> Column:
    if z_min < 0 or z_max < z_min:
        raise ValueError("a redshift range is not negative, and ascends")
    if strict:
        return (low < z_max) & (high > z_min)
    return (low <= z_max + tolerance) & (high >= z_min - tolerance)


def in_range(outputs: DataFrame, z_min: float, z_max: float, tolerance: float = 1e-9, strict: bool = False) -> DataFrame:
    """The outputs whose closed range overlaps a closed range; strict leaves out those that only touch."""
    return edges(outputs).where(overlaps(F.col("z_lo"), F.col("z_hi"), z_min, z_max, tolerance, strict))


def clipped(ranges: DataFrame, z_min: float, z_max: float) -> DataFrame:
    """ranges held within a shell, those left empty dropped."""
    held = ranges.withColumns({"z_lo": F.greatest("z_lo", F.lit(z_min)), "z_hi": F.least("z_hi", F.lit(z_max))})
    return held.where("z_lo < z_hi")


def nearest(outputs: DataFrame, z: float, tolerance: float = 1e-6) -> DataFrame:
    """The output at a redshift, if there is one within the tolerance."""
    best = outputs.agg(F.min_by(F.struct("snap", "z"), F.abs(F.col("z") - z)).alias("b")).select("b.*")
    return best.where(F.abs(F.col("z") - z) <= tolerance)


def missing(outputs: DataFrame, available: DataFrame, z_min: float, z_max: float, tolerance: float = 0.0) -> DataFrame:
    """The outputs that a range needs and that are not there."""
    return in_range(outputs, z_min, z_max, tolerance).join(available.select("snap"), "snap", "left_anti")


def spacing(outputs: DataFrame, available: DataFrame, z_min: float, z_max: float) -> DataFrame:
    """z_from, z_to, dz: gaps between neighbouring available outputs that a range reaches, ends included."""
    ends = outputs.agg(F.max("z").alias("a"), F.min("z").alias("b")).first()
    got = outputs.join(available.select("snap"), "snap", "left_semi").select("z")
    spark = outputs.sparkSession
    stops = got.union(spark.createDataFrame([(ends["a"],), (ends["b"],)], "z double")).distinct()
    gaps = stops.select(F.col("z").alias("z_from"), F.lead("z").over(Window.orderBy("z")).alias("z_to")).where("z_to is not null")
    return gaps.where(overlaps(F.col("z_from"), F.col("z_to"), z_min, z_max, 0.0, strict=True)).withColumn("dz", F.col("z_to") - F.col("z_from"))


def coverage(outputs: DataFrame, available: DataFrame, z_min: float, z_max: float, limit: float | None = None, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(used, lost, filled): available outputs and their ranges in the shell; missing ones; which available ones fill each.

    ValueError if outputs are missing and a gap is as wide as the limit (to 1e-9).
    """
    lost = missing(outputs, available, z_min, z_max, tolerance)
    used = available_edges(outputs, available).where(overlaps(F.col("z_lo"), F.col("z_hi"), z_min, z_max, tolerance))
    if limit is not None and not lost.isEmpty():
        widest = spacing(outputs, available, z_min, z_max).agg(F.max("dz")).first()[0]
        if widest is not None and widest >= limit - 1e-9:
            raise ValueError(f"available outputs are {widest:.4g} apart; the limit is {limit:.4g}")
    u = used.select(F.col("snap").alias("by"), F.col("z_lo").alias("u_lo"), F.col("z_hi").alias("u_hi"))
    filled = lost.join(u, (F.col("u_lo") < F.col("z_hi")) & (F.col("u_hi") > F.col("z_lo"))).groupBy("snap").agg(F.sort_array(F.collect_list("by")).alias("filled_by"))
    return used, lost, filled


def uncovered(shell: tuple[float, float], used: DataFrame) -> DataFrame:
    """z_from, z_to: parts of a shell that no used range covers."""
    spark = used.sparkSession
    runs = used.where(overlaps(F.col("z_lo"), F.col("z_hi"), *shell, 0.0, strict=True)).select("z_lo", "z_hi").union(spark.createDataFrame([(shell[0], shell[0]), (shell[1], shell[1])], "z_lo double, z_hi double"))
    before = F.max("z_hi").over(Window.orderBy("z_lo", "z_hi").rowsBetween(Window.unboundedPreceding, -1))
    gaps = runs.withColumn("z_from", before).where("z_from < z_lo").select("z_from", F.col("z_lo").alias("z_to"))
    return gaps
