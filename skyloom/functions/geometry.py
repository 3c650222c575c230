"""The geometry kernel as Column expressions of built-in functions.

Expressions that use one another's values many times over are made in steps (`staged`), so that generated code stays short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
AXES = ("x", "y", "z")
#: Multipliers of a tile's position and of the seed in the choice of an orientation row. Fixed values.
TILE_PRIMES, SEED_PRIME = (374761393, 2147483647, 668265263), 2246822519
LOCKS = (None, "none", "cube", "sphere")


def vector(prefix: str = "", suffix: str = "") -> Vector:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in AXES)  # type: ignore[return-value]


def floor_mod(a: Column, n: Column | float) -> Column:
    """a modulo n with the sign of n > 0 (pmod of doubles differs next to 0)."""
    n = n if isinstance(n, Column) else F.lit(n)
    rest = a % n
    return F.when(rest < 0, rest + n).otherwise(rest)


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(v: Vector, w) -> Column:
    return v[0] * w[0] + v[1] * w[1] + v[2] * w[2]


def turned(v: Vector, m: list[Column], transpose: bool = False) -> Vector:
    """The 3x3 matrix m (nine columns by rows), or its transpose, times v."""
    at = (lambda i, j: m[3 * j + i]) if transpose else (lambda i, j: m[3 * i + j])
    return tuple(at(i, 0) * v[0] + at(i, 1) * v[1] + at(i, 2) * v[2] for i in range(3))  # type: ignore[return-value]


STEP = "__step"


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns made in a step of their own: where(done()) after it is not pushed below, so what it and later steps use is
    not written out again in their place. (A filter does not pass a projection that holds a nondeterministic field.)"""
    return df.select(*[c for c in df.columns if c != STEP], *[c.alias(n) for n, c in columns.items()], F.spark_partition_id().alias(STEP))


def done(condition: Column | None = None) -> Column:
    """What a filter after `staged` holds, with the condition that it is there for."""
    step = F.col(STEP) >= 0
    return step if condition is None else condition & step


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns, made once and in a step of their own."""
    return staged(df, **columns).where(done()).drop(STEP)


def wrapped(v: Column, box: float) -> Column:
    """Back into the box; a value of exactly the box side stays."""
    return F.when((v < 0) | (v > box), floor_mod(v, box)).otherwise(v)


def reoriented(v: Vector, m: list[Column], shift: Vector, box: float) -> Vector:
    """Shift (a distance), wrap, reflect and turn about the box centre. m holds turn and reflection.

    m is a signed permutation, so a turned component is one centred component or its negative, half a box from the centre at
    most: it needs no second wrapping (see rotated_periodic for other turns).
    """
    centred = tuple(floor_mod(c + s, box) - box / 2 for c, s in zip(v, shift, strict=True))
    return tuple(c + box / 2 for c in turned(centred, m))  # type: ignore[arg-type, return-value]


def rotated_periodic(v: Vector, m: list[Column], shift: Vector, box: float) -> Vector:
    """reoriented for any turn m: what a corner leaves the box by comes in on the other side."""
    return tuple(wrapped(c, box) for c in reoriented(v, m, shift, box))  # type: ignore[return-value]


def restored(v: Vector, m: list[Column], shift: Vector, box: float) -> Vector:
    """The inverse of reoriented."""
    back = turned(tuple(c - box / 2 for c in v), m, transpose=True)  # type: ignore[arg-type]
    return tuple(floor_mod(c + box / 2 - s, box) for c, s in zip(back, shift, strict=True))  # type: ignore[return-value]


def placed(v: Vector, tile: Vector, box: float) -> Vector:
    """Box coordinates to the lattice position of a tile, the observer at the centre of tile (0, 0, 0)."""
    return tuple(c + (t * box - box / 2) for c, t in zip(v, tile, strict=True))  # type: ignore[return-value]


def cell_shift(eighths: Column, box: float) -> Column:
    return eighths * (box / 8)


def shift_in_cells(eighths: int, cells: int) -> int:
    """A shift in whole cells; cells of an axis come in multiples of eight."""
    if cells < 8 or cells % 8:
        raise ValueError(f"cells per axis must be a positive multiple of 8, not {cells}")
    return eighths * (cells // 8)


def orientation_row(tile: Vector, rows: int, seed: int = 0, lock: str | None = None, layer: Column | None = None) -> Column:
    """The row that a tile takes. Terms are reduced before they are summed, so that no seed overflows."""
    if lock not in LOCKS:
        raise ValueError(f"unknown lock {lock!r}")
    tile = tile if lock in (None, "none") else (F.lit(0), F.lit(0), tile_layer(tile) if layer is None else layer)
    terms = sum((F.pmod(t.cast("long") * F.lit(p % rows), F.lit(rows)) for t, p in zip(tile, TILE_PRIMES, strict=True)), F.lit(seed * SEED_PRIME % rows))
    return F.pmod(terms, F.lit(rows)).cast("int")


def tile_layer(tile: Vector) -> Column:
    return F.greatest(*[F.abs(t) for t in tile])


def in_sphere_shell(r: Column, r_min, r_max, buffer: float = 0.0) -> Column:
    """Both edges belong to the shell."""
    return (r >= r_min - buffer) & (r <= r_max + buffer)


def in_cone_shell(v: Vector, axis: tuple[float, float, float], half_angle: float, r_min, r_max, buffer: float = 0.0) -> Column:
    """The inner edge does not belong to the shell, the outer does. half_angle in radians; buffer widens all sides."""
    r, along = norm(v), dot(v, axis)
    return in_cone_at(r, along, v, axis, half_angle, r_min, r_max, buffer)


def in_cone_at(r: Column, along: Column, v: Vector, axis: tuple[float, float, float], half_angle: float, r_min, r_max, buffer: float = 0.0) -> Column:
    """in_cone_shell of a distance and a part along the axis that are known."""
    across = norm(tuple(c - along * a for c, a in zip(v, axis, strict=True)))  # type: ignore[arg-type]
    angle = F.atan2(across, along)
    limit = F.lit(half_angle)
    if buffer:
        limit = limit + F.when(r > buffer, F.asin(F.least(F.lit(buffer) / r, F.lit(1.0)))).otherwise(math.pi)
    return (r > r_min - buffer) & (r <= r_max + buffer) & (along > -buffer) & (angle <= limit)


def buffer_radius(length: float, shape: str = "cube") -> float:
    if shape not in ("cube", "sphere"):
        raise ValueError(f"buffer shape {shape!r} not recognised")
    return 0.0 if length <= 0 else length * math.sqrt(3) / 2 if shape == "cube" else length


def cell_index(v: Vector, box: float, cells: int) -> Column:
    """(ix*n + iy)*n + iz of the cell that holds a box position."""
    ix, iy, iz = (F.least(F.floor(c / (box / cells)), F.lit(cells - 1)) for c in v)
    return ((ix * cells + iy) * cells + iz).cast("int")


def sky_coordinates(v: Vector) -> tuple[Column, Column]:
    """Longitude and latitude in radians; the origin is at (0, 0)."""
    r = norm(v)
    share = F.when(r > 0, v[2] / r).otherwise(0.0)
    return F.atan2(v[1], v[0]), F.asin(F.least(F.greatest(share, F.lit(-1.0)), F.lit(1.0)))


def classified(r: Column, angle: Column, r_min: float, r_max: float, half_angle: float, tolerance: float = 1e-6) -> Column:
    """inside, outside or edge, for checks that leave room for rounding."""
    inside = (r > r_min + tolerance) & (r < r_max - tolerance) & (angle < half_angle - tolerance)
    outside = (r < r_min - tolerance) | (r > r_max + tolerance) | (angle > half_angle + tolerance)
    return F.when(inside, "inside").when(outside, "outside").otherwise("edge")


# Driver-side vectors.


def unit(axis) -> tuple[float, float, float]:
    axis = tuple(float(a) for a in axis)
    if len(axis) != 3:
        raise ValueError("a direction has three components")
    size = math.sqrt(sum(a * a for a in axis))
    if not size:
        raise ValueError("a direction must not be zero")
    return tuple(a / size for a in axis)  # type: ignore[return-value]


def cross(a, b) -> tuple[float, float, float]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def transverse(axis) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """Two unit vectors across a direction, from the x axis, or the y axis if the direction is near x."""
    axis = unit(axis)
    first = unit(cross(axis, (1.0, 0.0, 0.0) if abs(axis[0]) < 0.9 else (0.0, 1.0, 0.0)))
    return first, cross(axis, first)


def tile_frame(axis) -> list[list[int]]:
    """The signed permutation that takes lattice positions to (across, across, along) labels of a beam.

    Along takes the lattice axis that it is nearest to, the two across take theirs of what is left; signs as they point.
    """
    axis = unit(axis)
    rows: dict[int, list[int]] = {}
    free = [0, 1, 2]
    for label, v in ((2, axis), (0, transverse(axis)[0]), (1, transverse(axis)[1])):
        best = max(free, key=lambda a: abs(v[a]))
        free.remove(best)
        rows[label] = [(1 if v[best] >= 0 else -1) if a == best else 0 for a in range(3)]
    return [rows[i] for i in range(3)]


def rotation_onto(v_from, v_to=(1.0, 0.0, 0.0)) -> list[list[float]]:
    """The rotation that turns one direction onto another (half a turn about an axis across if they are opposite)."""
    a, b = unit(v_from), unit(v_to)
    c = sum(x * y for x, y in zip(a, b, strict=True))
    eye = [[1.0 * (i == j) for j in range(3)] for i in range(3)]
    if c > 1 - 1e-15:
        return eye
    if c < -1 + 1e-12:
        k = transverse(a)[0]
        return [[2 * k[i] * k[j] - eye[i][j] for j in range(3)] for i in range(3)]
    k = cross(a, b)
    x = [[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]]
    return [[eye[i][j] + x[i][j] + sum(x[i][m] * x[m][j] for m in range(3)) / (1 + c) for j in range(3)] for i in range(3)]
