"""Pixel maps as rows (map, pix, value): sums, common maps, resolution, rotation, selections, halo indexes and masks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import healpix as h
from skyloom.functions.geometry import Vector, cross, done, dot, norm, staged, step, unit, vector
from skyloom.plans.stage import written


def summed(maps: list[DataFrame] | DataFrame) -> DataFrame:
    """map, pix, value: the same maps of several files added up, pixel by pixel."""
    whole = maps if isinstance(maps, DataFrame) else reduce(DataFrame.unionByName, maps)
    return whole.groupBy("map", "pix").agg(F.sum("value").alias("value"))


def common(listing: DataFrame) -> DataFrame:
    """map: names with an nside in every file of a listing (file, map, nside)."""
    files = listing.agg(F.count_distinct("file").alias("files"))
    have = listing.where("nside is not null").groupBy("map").agg(F.count_distinct("file").alias("n"))
    return have.crossJoin(files).where("n = files").select("map")


def attributes_agree(attributes: DataFrame, ignored: tuple[str, ...] = ("Started",)) -> None:
    """ValueError if files differ in an attribute (file, name, value) that is not ignored."""
    bad = attributes.where(~F.col("name").isin(*ignored)).groupBy("name").agg(F.count_distinct("value").alias("n")).where("n > 1").collect()
    if bad:
        raise ValueError(f"files differ in {sorted(r['name'] for r in bad)}")


def degraded(maps: DataFrame, levels: int, mean: bool = False) -> DataFrame:
    """Nested maps at a coarser resolution: sums of the pixels within, or their mean over all 4**levels of them."""
    value = F.sum("value") / 4.0**levels if mean else F.sum("value")
    return maps.withColumn("pix", h.parent(F.col("pix"), levels)).groupBy("map", "pix").agg(value.alias("value"))


def full_map(values: DataFrame, nside: int, fill: float = 0.0) -> DataFrame:
    """pix, value for every pixel."""
    pix = values.sparkSession.range(h.n_pixels(nside)).toDF("pix")
    return pix.join(values.select("pix", "value"), "pix", "left").select("pix", F.coalesce("value", F.lit(fill)).alias("value"))


def selected(values: DataFrame, pixels: DataFrame) -> DataFrame:
    return values.join(pixels.select("pix").distinct(), "pix", "left_semi")


def in_disc(spark: SparkSession, nside: int, centre: tuple[float, float, float], radius: float, nested: bool = True) -> DataFrame:
    """pix whose centre lies within a radius (radians) of a direction."""
    size = math.sqrt(sum(c * c for c in centre))
    df = h.with_vectors(spark.range(h.n_pixels(nside)).toDF("pix"), "pix", nside, nested)
    return df.where(dot(vector(), [c / size for c in centre]) >= math.cos(radius)).select("pix")


def deposited(points: DataFrame, v: Vector, value: Column, nside: int, nested: bool = True) -> DataFrame:
    """pix, value: the sum of a value over the points of each pixel."""
    own = h.with_pixel(points.withColumn("__value", value), v, "pix", nside, nested)
    return own.groupBy("pix").agg(F.sum("__value").alias("value"))


def _patches(theta: Column, phi: Column, width: float) -> tuple[Column, Column]:
    """band and patch: a band of co-latitude `width` wide, and a patch of it about as wide."""
    band = F.least(F.floor(theta / width), F.lit(math.ceil(math.pi / width) - 1))
    return band, F.least(F.floor(phi / (2 * math.pi) * _in_band(band, width)), _in_band(band, width) - 1)


def _in_band(band: Column, width: float) -> Column:
    """How many patches a band has: as many as fit around its wider edge."""
    edge = F.when((band * width < math.pi / 2) & ((band + 1) * width > math.pi / 2), 1.0).otherwise(F.greatest(F.sin(band * width), F.sin(F.least((band + 1) * width, F.lit(math.pi)))))
    return F.greatest(F.floor(2 * math.pi * edge / width), F.lit(1))


def _angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """theta and phi (from 0 to 2 pi) of a unit vector."""
    phi = F.atan2(y, x)
    return F.acos(F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0))), F.when(phi < 0, phi + 2 * math.pi).otherwise(phi)


def covered(points: DataFrame, nside: int) -> DataFrame:
    """points (unit vectors ux, uy, uz; radius __a in radians) with each nested pixel whose centre is within their circle, and cosine
    (of the angle between).

    A point is a row for each patch of the sky (as wide as four pixels) that its circle can overlap, a pixel stands in its own, and
    both are joined by patch: a circle of radius a around co-latitude t reaches asin(sin a / sin t) to each side in longitude, all
    around if it holds a pole.
    """
    width = 4 * math.sqrt(h.pixel_area(nside))
    theta, phi = _angles(F.col("ux"), F.col("uy"), F.col("uz"))
    own = step(points, __t=theta, __f=phi)
    t, f, a = F.col("__t"), F.col("__f"), F.col("__a")
    last = math.ceil(math.pi / width) - 1
    first = F.floor(F.greatest(t - a, F.lit(0.0)) / width)
    own = own.withColumn("band", F.explode(F.sequence(F.least(first, F.lit(last)), F.least(F.floor((t + a) / width), F.lit(last)))))
    reach = F.when((t - a <= 0) | (t + a >= math.pi), math.pi).otherwise(F.asin(F.least(F.sin(a) / F.sin(t), F.lit(1.0))) + 1e-9)
    own = step(own, __n=_in_band(F.col("band"), width), __reach=reach)
    n = F.col("__n")
    lo, hi = F.floor((f - F.col("__reach")) / (2 * math.pi) * n), F.floor((f + F.col("__reach")) / (2 * math.pi) * n)
    around = F.explode(F.sequence(lo, F.least(hi, lo + n - 1)))
    own = own.withColumn("__p", around).withColumn("patch", F.pmod("__p", n)).drop("__t", "__f", "__n", "__reach", "__p")
    pixels = h.with_vectors(points.sparkSession.range(h.n_pixels(nside)).toDF("pix"), "pix", nside)
    theta, phi = _angles(*vector())
    pixels = step(pixels, __t=theta, __f=phi)
    band, patch = _patches(F.col("__t"), F.col("__f"), width)
    pixels = pixels.select("pix", *[F.col(c).alias(f"p{c}") for c in "xyz"], band.alias("band"), patch.alias("patch"))
    # Both are written: a join's inferred conditions would be spelled out through every step that made its keys.
    own, pixels = written(own, "circles"), written(pixels, "pixels")
    both = staged(own.join(pixels, ["band", "patch"]), cosine=dot(vector("u"), [F.col("px"), F.col("py"), F.col("pz")]))
    return both.where(done(F.col("cosine") >= F.cos("__a"))).drop("band", "patch", "px", "py", "pz", "__step")


def smoothed(points: DataFrame, v: Vector, angle: Column, value: Column, nside: int, weight: Column | None = None) -> DataFrame:
    """pix, value (and weight): values spread over the nested pixels within each point's smoothing angle.

    A pixel's share is (1 - (d/angle)^2)^2 of all the point's shares, so totals are conserved; a point whose circle holds no
    pixel centre gives all to its own pixel. A point is a row for each pixel under it, written once; sums are combined before
    the shuffle.
    """
    base = points.withColumns({"__id": F.monotonically_increasing_id(), "__v": value.cast("double"), "__w": (weight if weight is not None else F.lit(1.0)).cast("double"), "__a": angle, **{f"u{c}": x / norm(v) for c, x in zip("xyz", v, strict=True)}})
    base = written(h.with_pixel(base.select("__id", "__v", "__w", "__a", "ux", "uy", "uz"), vector("u"), "__own", nside), "points")
    d = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))) / F.col("__a")
    wide = covered(base.where(F.col("__a") > 0), nside)
    share = wide.select("__id", "pix", "__v", "__w", F.pow(F.greatest(1 - d * d, F.lit(0.0)), F.lit(2.0)).alias("__k")).where("__k > 0")
    share = written(share, "shares")
    total = share.groupBy("__id").agg(F.sum("__k").alias("__t"))
    spread = share.join(total, "__id").select("pix", (F.col("__k") / F.col("__t")).alias("__s"), "__v", "__w")
    alone = base.join(total.select("__id"), "__id", "left_anti").select(F.col("__own").alias("pix"), F.lit(1.0).alias("__s"), "__v", "__w")
    s = F.col("__s")
    return spread.unionByName(alone).groupBy("pix").agg(F.sum(s * F.col("__v") * F.col("__w")).alias("value"), F.sum(s * F.col("__w")).alias("weight"))


def weighted_mean(values: DataFrame, empty: float | None = None) -> DataFrame:
    """pix, value: value over weight; where there is no weight, `empty` (null by default)."""
    return values.select("pix", F.when(F.col("weight") > 0, F.col("value") / F.col("weight")).otherwise(F.lit(empty)).alias("value"))


def rotated(values: DataFrame, nside: int, theta: float, phi: float) -> DataFrame:
    """pix, value of a nested map turned by theta about y and then by phi about z: each pixel takes the value at the place it
    came from. It is exact for maps that are constant within pixels; nothing is done if both angles are 0."""
    if not theta and not phi:
        return values.select("pix", "value")
    grid = h.with_vectors(values.sparkSession.range(h.n_pixels(nside)).toDF("pix"), "pix", nside)
    x, y, z = vector()
    ux, uy = x * math.cos(phi) + y * math.sin(phi), y * math.cos(phi) - x * math.sin(phi)
    grid = h.with_pixel(grid, (ux * math.cos(theta) - z * math.sin(theta), uy, ux * math.sin(theta) + z * math.cos(theta)), "source", nside)
    return written(grid.select("pix", "source"), "turned").join(values.select(F.col("pix").alias("source"), "value"), "source").select("pix", "value")


def angle_runs(angles: DataFrame) -> DataFrame:
    """shell, theta, phi, chunk: shells in order, numbered anew whenever either angle changes. One row for each shell."""
    w = Window.orderBy("shell")
    change = (F.lag("theta").over(w).eqNullSafe(F.col("theta")) & F.lag("phi").over(w).eqNullSafe(F.col("phi"))).cast("int")
    return angles.withColumn("__c", 1 - change).withColumn("chunk", (F.sum("__c").over(w) - 1).cast("int")).drop("__c")


def integrated(shells: DataFrame, angles: DataFrame, nside: int, levels: int = 0) -> DataFrame:
    """map, pix, value: shells (shell, map, pix, value) summed by runs of equal angles, turned, made coarser and summed."""
    runs = angle_runs(angles)
    sums = shells.join(F.broadcast(runs.select("shell", "chunk")), "shell").groupBy("chunk", "map", "pix").agg(F.sum("value").alias("value"))
    parts = []
    for r in runs.groupBy("chunk").agg(F.first("theta").alias("theta"), F.first("phi").alias("phi")).orderBy("chunk").collect():
        own = sums.where(F.col("chunk") == r["chunk"])
        if r["theta"] or r["phi"]:
            names = own.select("map").distinct()
            grid = rotated(own.sparkSession.range(h.n_pixels(nside)).select(F.col("id").alias("pix"), F.col("id").alias("value")), nside, r["theta"], r["phi"]).withColumnRenamed("value", "source")
            own = grid.crossJoin(F.broadcast(names)).join(own.select("map", F.col("pix").alias("source"), "value"), ["map", "source"])
        parts.append(own.select("map", "pix", "value"))
    whole = reduce(DataFrame.unionByName, parts)
    return degraded(whole, levels) if levels else summed(whole)


#: Pixels are numbered on by ranges of them: sums of the ranges first, then within each.
RANGES = 4096


def halo_pixel_index(halos: DataFrame, v: Vector, nside: int = 16, nested: bool = True) -> DataFrame:
    """pix, n_halos, first_halo for every pixel: where each pixel's haloes stand in an order by pixel."""
    counts = h.with_pixel(halos, v, "pix", nside, nested).groupBy("pix").agg(F.count("*").alias("value"))
    width = -(-h.n_pixels(nside) // RANGES)
    part = F.floor(F.col("pix") / width)
    full = full_map(counts, nside, 0.0).select("pix", F.col("value").cast("long").alias("n_halos"), part.alias("part"))
    # One row for each of at most RANGES ranges.
    sums = counts.groupBy(part.alias("part")).agg(F.sum("value").alias("s"))
    ranges = halos.sparkSession.range(RANGES).toDF("part").join(sums, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("pix").rowsBetween(Window.unboundedPreceding, -1)
    return full.join(F.broadcast(starts), "part").select("pix", "n_halos", (F.col("start") + F.coalesce(F.sum("n_halos").over(within), F.lit(0))).alias("first_halo"))


def write_halos(halos: DataFrame, v: Vector, path: str, metadata: dict[str, str], nside: int = 16) -> None:
    """haloes ordered by pixel, their index, and the settings, as three Parquet folders."""
    pix = h.with_pixel(halos, v, "pix", nside)
    pix.repartitionByRange("pix").sortWithinPartitions("pix", "halo_index").write.parquet(f"{path}/halos")
    halo_pixel_index(halos, v, nside).write.parquet(f"{path}/index")
    halos.sparkSession.createDataFrame(sorted(metadata.items()), "name string, value string").write.parquet(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> dict[str, str | None]:
    """Settings as written; "none" is read as None but for the lock."""
    return {r["name"]: None if r["value"] == "none" and r["name"] != "lock" else r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}


def mask_bins(low: float = 12.0, high: float = 16.0, width: float = 0.5, cumulative: bool = False) -> list[tuple[float, float]]:
    """Mass bins in log10: [lo, lo + width), or [lo, high)."""
    n = round((high - low) / width)
    return [(low + i * width, high if cumulative else low + (i + 1) * width) for i in range(n)]


def aperture_masks(halos: DataFrame, nside: int, scales: list[float], bins: list[tuple[float, float]], position: Vector, mass: Column, radius: Column) -> DataFrame:
    """scale, log_mass_lo, log_mass_hi, pix: pixels that an aperture of a halo covers (mask 0); all others are 1.

    A pixel is covered if its centre is within atan(scale * radius / distance) of a halo's direction; haloes at the observer
    are left out, and mass bins are lo < m <= hi.
    """
    spark = halos.sparkSession
    # As many rows as there are scales and mass bins.
    sizes = F.explode(F.array(*[F.lit(float(s)) for s in scales]))
    ranges = spark.createDataFrame([(float(a), float(b)) for a, b in bins], "log_mass_lo double, log_mass_hi double")
    d = norm(position)
    own = step(halos, __m=mass, __r=radius, __d=d).where("__d > 0")
    own = own.select(*[(p / F.col("__d")).alias(f"u{c}") for p, c in zip(position, "xyz", strict=True)], "__m", "__r", "__d")
    own = own.join(F.broadcast(ranges), (F.col("__m") > F.pow(F.lit(10.0), "log_mass_lo")) & (F.col("__m") <= F.pow(F.lit(10.0), "log_mass_hi"))).withColumn("scale", sizes)
    own = own.withColumn("__a", F.atan(F.col("scale") * F.col("__r") / F.col("__d")))
    return covered(own, nside).select("scale", "log_mass_lo", "log_mass_hi", "pix").distinct()


def binary_masks(covered_pixels: DataFrame, nside: int) -> DataFrame:
    """scale, log_mass_lo, log_mass_hi, pix, mask (0 or 1) of every pixel, for each scale and mass bin in which any is covered."""
    keys = ["scale", "log_mass_lo", "log_mass_hi"]
    pixels = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h.n_pixels(nside) - 1).cast("long")))
    every = covered_pixels.select(*keys).distinct().select(*keys, pixels.alias("pix"))
    return every.join(covered_pixels.withColumn("mask", F.lit(0)), [*keys, "pix"], "left").select(*keys, "pix", F.coalesce("mask", F.lit(1)).cast("int").alias("mask"))


def write_masks(covered_pixels: DataFrame, nside: int, path: str) -> None:
    """binary_masks as Parquet, a folder for each scale and mass bin, pixels in order within a file."""
    masks = binary_masks(covered_pixels, nside)
    masks.repartitionByRange("scale", "log_mass_lo", "pix").sortWithinPartitions("scale", "log_mass_lo", "pix").write.partitionBy("scale", "log_mass_lo", "log_mass_hi").parquet(path)


def write_map(values: DataFrame, name: str, nside: int, path: str, metadata: dict[str, str] | None = None, redshifts: tuple[float, float] | None = None) -> None:
    """A map (pix, value) as Parquet in pixel order, and its attributes (nside, ordering, redshifts and what else is given) as rows."""
    values.select("pix", "value").repartitionByRange("pix").sortWithinPartitions("pix").write.parquet(f"{path}/{name}")
    rows = {"nside": str(nside), "ordering": "nested", **({} if redshifts is None else {"z_min": repr(redshifts[0]), "z_max": repr(redshifts[1])}), **(metadata or {})}
    values.sparkSession.createDataFrame(sorted(rows.items()), "name string, value string").write.parquet(f"{path}/{name}_attributes")


def turned_positions(points: DataFrame, position: tuple[str, str, str], theta: float, phi: float) -> DataFrame:
    """points turned by theta about y and then by phi about z (as `rotated` turns a map); distances stay, the origin too."""
    x, y, z = (F.col(c) for c in position)
    ux, uz = x * math.cos(theta) + z * math.sin(theta), z * math.cos(theta) - x * math.sin(theta)
    turned = (ux * math.cos(phi) - y * math.sin(phi), ux * math.sin(phi) + y * math.cos(phi), uz)
    kept = [c for c in points.columns if c not in position]
    return points.select(*kept, *[t.alias(c) for t, c in zip(turned, position, strict=True)])


def pixel_shares(spark: SparkSession, nside: int, parts: int) -> DataFrame:
    """part, first, last: contiguous ranges of ring pixels of equal size (the last takes what is left), and theta_lo, theta_hi, the
    co-latitudes that their centres lie between."""
    total = h.n_pixels(nside)
    each = total // parts
    rows = spark.range(parts).select(F.col("id").cast("int").alias("part"), (F.col("id") * each).alias("first"), F.when(F.col("id") == parts - 1, total - 1).otherwise((F.col("id") + 1) * each - 1).alias("last"))
    for c in ("first", "last"):
        rows = step(rows, **{f"z_{c}": h.ring_to_z_phi(F.col(c), nside)[0]})
    return rows.select("part", "first", "last", F.acos("z_first").alias("theta_lo"), F.acos("z_last").alias("theta_hi"))


def zoomed(values: DataFrame, nside: int, centre: tuple[float, float, float], half_side: float, n: int) -> DataFrame:
    """ix, iy, value: a gnomonic image, n by n over tangents from -half_side to half_side across the centre's direction: the value of
    the nested pixel that each image cell's centre falls into; null where the map has none."""
    axis = unit(centre)
    # East and north of the centre; at a pole east is y.
    flat = math.hypot(axis[0], axis[1])
    east = (-axis[1] / flat, axis[0] / flat, 0.0) if flat else (0.0, 1.0, 0.0)
    north = cross(axis, east)
    at = lambda c: (F.col(c) + 0.5) * (2 * half_side / n) - half_side
    grid = values.sparkSession.range(n * n).select((F.col("id") % n).cast("int").alias("ix"), F.floor(F.col("id") / n).cast("int").alias("iy"))
    way = tuple(axis[i] + at("ix") * east[i] + at("iy") * north[i] for i in range(3))
    return written(h.with_pixel(grid, way, "pix", nside), "image").join(values.select("pix", "value"), "pix", "left").select("ix", "iy", "value")
