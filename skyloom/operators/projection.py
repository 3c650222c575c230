"""Slices of a beam and their projection on a 2-D grid."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geometry import AXES, rotation_onto, step, turned, vector
from skyloom.plans.stage import written

GAMMA, NEIGHBOURS = 1.8, 32
#: Points of a group (searched in one task) and of a leaf, and the most boxes that are held in every task.
GROUP, LEAF, BOXES = 1 << 15, 128, 50_000
#: Leaves that are searched at once.
_AT_ONCE = 8
KINDS = ("Gas", "DM")


def check_kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return kind


def along_x(points: DataFrame, axis) -> DataFrame:
    """points turned so that the axis becomes +x."""
    m = [F.lit(float(e)) for row in rotation_onto(axis) for e in row]
    return points.withColumns(dict(zip(AXES, turned(vector(), m), strict=True)))


def slice_of(points: DataFrame, z_range: tuple[float, float], thickness: float) -> DataFrame:
    """Points within half a thickness of the mid-point of all points' z, and inside a closed range of redshift."""
    middle = points.agg(((F.min("z") + F.max("z")) / 2).alias("__m"))
    held = points.crossJoin(F.broadcast(middle)).where(F.abs(F.col("z") - F.col("__m")) <= thickness / 2)
    return held.where(F.col("redshift").between(*z_range)).drop("__m")


def bounds(points: DataFrame, margin: float = 10.0) -> DataFrame:
    """One row x_lo, x_hi, ..., z_hi: the bounding box and a margin."""
    return points.agg(*[e for a in AXES for e in ((F.min(a) - margin).alias(f"{a}_lo"), (F.max(a) + margin).alias(f"{a}_hi"))])


def grid_index(points: DataFrame, region: tuple[float, float, float, float], n: int) -> DataFrame:
    """points with ix, iy of an n by n grid over (x_lo, x_hi, y_lo, y_hi), those outside dropped; the far edges belong."""
    x0, x1, y0, y1 = region
    at = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).withColumns({"ix": at("x", x0, x1), "iy": at("y", y0, y1)})


def projected(points: DataFrame, value: str, region: tuple[float, float, float, float], n: int, weight: str | None = None, empty: float | None = 0.0) -> DataFrame:
    """ix, iy, value: surface density of a column (sum over pixel area), or its weighted mean (`empty` where nothing weighs)."""
    x0, x1, y0, y1 = region
    if weight is None:
        area = (x1 - x0) * (y1 - y0) / n / n
        return grid_index(points, region, n).groupBy("ix", "iy").agg((F.sum(value) / area).alias("value"))
    sums = grid_index(points, region, n).groupBy("ix", "iy").agg(F.sum(F.col(value) * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    return sums.select("ix", "iy", F.when(F.col("w") != 0, F.col("s") / F.col("w")).otherwise(F.lit(empty)).alias("value"))


def kernel_2d(q: Column) -> Column:
    """A smooth 2-D kernel of support 1, up to its norm."""
    return F.pow(F.greatest(1 - q * q, F.lit(0.0)), F.lit(3.0))


def projected_sph(points: DataFrame, value: str, region: tuple[float, float, float, float], n: int, smoothing: str = "h", weight: str | None = None, empty: float | None = 0.0, periodic: bool = False) -> DataFrame:
    """projected, with each point spread over the pixels within its smoothing length. Shares of a point add up to one over
    the plane's pixels, so totals are conserved; a point narrower than a pixel goes to its own. A point is a row for each
    pixel under it; sums are combined before the shuffle."""
    x0, x1, y0, y1 = region
    dx, dy = (x1 - x0) / n, (y1 - y0) / n
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = points.select(F.monotonically_increasing_id().alias("__id"), "x", "y", F.col(value).cast("double").alias("__v"), w.alias("__w"), F.col(smoothing).cast("double").alias("__h"))
    lo = lambda c, o, d: F.floor((F.col(c) - F.col("__h") - o) / d).cast("int")
    hi = lambda c, o, d: F.floor((F.col(c) + F.col("__h") - o) / d).cast("int")
    p = p.withColumn("jx", F.explode(F.sequence(lo("x", x0, dx), hi("x", x0, dx)))).withColumn("jy", F.explode(F.sequence(lo("y", y0, dy), hi("y", y0, dy))))
    q = F.sqrt(F.pow(x0 + (F.col("jx") + 0.5) * dx - F.col("x"), F.lit(2.0)) + F.pow(y0 + (F.col("jy") + 0.5) * dy - F.col("y"), F.lit(2.0))) / F.col("__h")
    own = (F.col("jx") == F.floor((F.col("x") - x0) / dx)) & (F.col("jy") == F.floor((F.col("y") - y0) / dy))
    k = F.when(F.col("__h") > max(dx, dy), kernel_2d(q)).otherwise(F.when(own, 1.0).otherwise(0.0))
    p = p.withColumn("__k", k).where("__k > 0")
    total = p.groupBy("__id").agg(F.sum("__k").alias("__t"))
    s = p.join(total, "__id").withColumn("__s", F.col("__k") / F.col("__t"))
    ix, iy = (F.pmod("jx", F.lit(n)), F.pmod("jy", F.lit(n))) if periodic else (F.col("jx"), F.col("jy"))
    s = s.withColumns({"ix": ix, "iy": iy}).where(F.col("ix").between(0, n - 1) & F.col("iy").between(0, n - 1))
    sums = s.groupBy("ix", "iy").agg(F.sum(F.col("__s") * F.col("__v") * F.col("__w")).alias("a"), F.sum(F.col("__s") * F.col("__w")).alias("b"))
    if weight is None:
        return sums.select("ix", "iy", (F.col("a") / (dx * dy)).alias("value"))
    return sums.select("ix", "iy", F.when(F.col("b") != 0, F.col("a") / F.col("b")).otherwise(F.lit(empty)).alias("value"))


def _on_curve(points: DataFrame, box, held: Column) -> DataFrame:
    """points with __code, null if not held: the place on a curve through the bounding box that keeps neighbours close (20 bits
    of each axis, interleaved)."""
    width, most = max(box[f"{a}_hi"] - box[f"{a}_lo"] for a in AXES) or 1.0, (1 << 20) - 1
    cell = {f"__c{a}": F.when(held, F.least(F.floor((F.col(a).cast("double") - box[f"{a}_lo"]) / width * (most + 1)), F.lit(most)).cast("long")) for a in AXES}
    bits = [F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), 3 * i + j) for j, c in enumerate(cell) for i in range(20)]
    return step(points, **cell).withColumn("__code", functools.reduce(Column.bitwiseOR, bits)).drop(*cell)


def _leaves(p: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points in which each leaf is a run, where leaves begin (and the end), and their boxes' corners. Points
    are halved across their widest axis until a leaf holds at most `most`."""
    leaves, left = [], [np.arange(len(p))]
    while left:
        at = left.pop()
        if len(at) <= most:
            leaves.append(at)
            continue
        own = p[at]
        half = len(at) // 2
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)
        left += [at[order[half:]], at[order[:half]]]
    order, begins = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])
    return order, begins, np.minimum.reduceat(p[order], begins[:-1]), np.maximum.reduceat(p[order], begins[:-1])


def _gaps(lo: np.ndarray, hi: np.ndarray, box_lo: np.ndarray, box_hi: np.ndarray) -> np.ndarray:
    """Squared distances between boxes of which one is an array along the last axis but one. Rounded as those of points are, so
    no point of a box is nearer."""
    g = np.maximum(np.maximum(box_lo - hi, lo - box_hi), 0.0)
    g *= g
    return g[..., 0] + g[..., 1] + g[..., 2]


def _nearest(q: np.ndarray, limit: np.ndarray, p: np.ndarray, begins: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """For each of some close points q the n smallest squared distances to points p (in leaves), in any order but for the
    largest, which is last; infinite where there are fewer below the point's limit."""
    best = np.repeat(limit[:, None], n, axis=1)
    gaps = _gaps(q.min(axis=0), q.max(axis=0), lo, hi)
    left = np.argsort(gaps, kind="stable")
    left = left[gaps[left] < limit.max()]
    while len(left):
        now, left = left[:_AT_ONCE], left[_AT_ONCE:]
        x = np.concatenate([p[a:b] for a, b in zip(begins[now].tolist(), begins[now + 1].tolist(), strict=True)])
        d = np.square(q[:, None, 0] - x[:, 0])
        d += np.square(q[:, None, 1] - x[:, 1])
        d += np.square(q[:, None, 2] - x[:, 2])
        d = np.concatenate([best, d], axis=1)
        best = np.partition(d, n - 1, axis=1)[:, :n]
        left = left[gaps[left] < best[:, -1].max()]
        if len(left):
            left = left[(_gaps(q[:, None], q[:, None], lo[left], hi[left]) < best[:, -1:]).any(axis=0)]
    return np.where(best < limit[:, None], best, np.inf)


def smoothing_lengths(points: DataFrame, side: float, k: int = NEIGHBOURS, gamma: float = GAMMA) -> DataFrame:
    """points (x, y, z and any others) with h: the distance to the k-th neighbour over gamma, null without a finite position.

    Points are dealt by range of a space-filling curve into groups of about GROUP, however dense they lie, and a group is
    halved into leaves with boxes. A point's k-th distance within its group bounds its own; only points nearer than that to
    a box of another group are asked there too, and what all groups find is merged. Distances at the bound change nothing, so
    copies of one place never ask each other's groups. `side` sets nothing any more: groups follow the density.
    """
    finite = F.lit(True)
    for a in AXES:
        finite &= F.coalesce(F.abs(F.col(a).cast("double")) < F.lit(float("inf")), F.lit(False))
    corners = [e for a in AXES for e in (F.min(F.col(a).cast("double")).alias(f"{a}_lo"), F.max(F.col(a).cast("double")).alias(f"{a}_hi"))]
    box = points.where(finite).agg(F.count(F.lit(1)).alias("n"), *corners).first()
    total, n, most = box["n"], k + 1, max(LEAF, 2 * k + 4)
    if total <= k:
        raise ValueError(f"{k} neighbours need more than {total} points")
    groups = max(1, min(-(-total // GROUP), BOXES))
    parts = min(16, BOXES // groups)
    order = ["__code", *AXES, "__n"]
    placed = _on_curve(points, box, finite).withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(groups, *order)
    placed = written(placed.withColumns({"__row": F.monotonically_increasing_id(), "__group": F.when(F.col("__code").isNotNull(), F.spark_partition_id())}).drop("__code", "__n"), "placed")
    held = placed.where("__group IS NOT NULL").select("__group", "__row", *[F.col(a).cast("double").alias(a) for a in AXES])
    places = lambda t: np.stack([t.column(a).to_numpy() for a in AXES], axis=1)

    def own(t: pa.Table) -> pa.Table:
        p = places(t)
        at, begins, lo, hi = _leaves(p, most)
        p, bound = p[at], np.empty(len(at))
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            bound[a:b] = _nearest(p[a:b], np.full(b - a, np.inf), p, begins, lo, hi, n)[:, -1]
        part = np.repeat((np.arange(len(lo)) * parts // len(lo)).astype(np.int32), np.diff(begins))
        return t.take(pa.array(at)).append_column("__part", pa.array(part)).append_column("__bound", pa.array(bound))

    near = written(held.groupBy("__group").applyInArrow(own, "__group int, __row long, x double, y double, z double, __part int, __bound double"), "smoothing")
    boxes = near.groupBy("__group", "__part").agg(*corners).toArrow()
    box_group = boxes.column("__group").to_numpy()
    box_lo, box_hi = (np.stack([boxes.column(f"{a}_{end}").to_numpy() for a in AXES], axis=1) for end in ("lo", "hi"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that a point has to be asked in, its own among them, if there are others."""
        for batch in batches:
            p, own_group, bound = places(batch), batch.column("__group").to_numpy(), batch.column("__bound").to_numpy()
            rows, targets = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for a in range(0, len(p), LEAF):
                q, r, home = p[a : a + LEAF], bound[a : a + LEAF], own_group[a : a + LEAF]
                close = np.flatnonzero(_gaps(q.min(axis=0), q.max(axis=0), box_lo, box_hi) < r.max())
                close = close[~np.isin(box_group[close], home) | (home != home[0]).any()]
                i, j = np.nonzero((_gaps(q[:, None], q[:, None], box_lo[close], box_hi[close]) < r[:, None]) & (box_group[close] != home[:, None]))
                out = np.unique(np.stack([np.append(i, i), np.append(box_group[close[j]], home[i])], axis=1), axis=0)
                rows.append(a + out[:, 0])
                targets.append(out[:, 1].astype(np.int32))
            found = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(targets)), *(found.column(c) for c in ("__row", *AXES, "__bound"))], names=["__group", "__row", *AXES, "__bound"])

    def answer(asks: pa.Table, t: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return pa.table({"__row": pa.array([], pa.int64()), "__near": pa.array([], pa.list_(pa.float64()))})
        p, q = places(t), places(asks)
        at, begins, lo, hi = _leaves(p, most)
        p, (order, cuts, _, _) = p[at], _leaves(q, LEAF)
        q, limit, got = q[order], asks.column("__bound").to_numpy()[order], []
        # The bound itself is taken in: what lies at it completes the k + 1 nearest.
        limit = np.nextafter(limit, np.inf)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            got.append(_nearest(q[a:b], limit[a:b], p, begins, lo, hi, n))
        d = np.concatenate(got)
        found = np.isfinite(d)
        offsets = pa.array(np.append(0, np.cumsum(found.sum(axis=1))).astype(np.int32))
        return pa.table({"__row": asks.column("__row").take(pa.array(order)), "__near": pa.ListArray.from_arrays(offsets, pa.array(d[found]))})

    queries = near.mapInArrow(asked, "__group int, __row long, x double, y double, z double, __bound double")
    answers = queries.groupBy("__group").cogroup(held.groupBy("__group")).applyInArrow(answer, "__row long, __near array<double>")
    merged = answers.groupBy("__row").agg(F.sort_array(F.flatten(F.collect_list("__near")))[k].alias("__merged"))
    found = near.select("__row", "__bound").join(merged, "__row", "left").select("__row", (F.sqrt(F.coalesce("__merged", "__bound")) / gamma).alias("h"))
    return placed.join(found, "__row", "left").drop("__row", "__group")
