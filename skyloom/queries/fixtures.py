"""The domain's relations over the driver's tables, for Spark and as SQL text.

Positions are multiples of 1/8 in a box of 1000, so shifts, turns and offsets are exact in doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from skyloom.functions.cosmology import Cosmology
from skyloom.functions.geometry import SEED_PRIME, TILE_PRIMES
from skyloom.operators.orientation import MATRIX, Table, generate, quarter_matrix
from skyloom.plans.views import View

BOX, CELLS, SNAPS, FILES = 1000.0, 8, 9, 2
COSMOLOGY = Cosmology(h=0.68, omega_m=0.3)
OUTPUTS = [(69 + i, round(0.4 - 0.05 * i, 10)) for i in range(SNAPS)]
ORIENTATIONS: Table = generate(seed=0, rows=50)
SHELL, CONE_SHELL, AXIS, ANGLE = (0.1, 0.2), (0.05, 0.25), (1.0, 2.0, 3.0), 15.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _at(key: str, factor: int, size: int, add: int = 0) -> str:
    return f"CAST(({key} * {factor} + {add}) % {size} AS DOUBLE) / 8"


POINTS = [f"CAST(69 + o_orderkey % {SNAPS} AS INT) AS snap", "o_orderkey AS id", f"{_at('o_orderkey', 7919, 8000)} AS x", f"{_at('o_orderkey', 104729, 7993)} AS y", f"{_at('o_orderkey', 1299709, 7963)} AS z", "CAST(o_orderkey % 17 - 8 AS DOUBLE) AS vx", "CAST(o_orderkey % 23 - 11 AS DOUBLE) AS vy", "CAST(o_orderkey % 29 - 14 AS DOUBLE) AS vz", "o_totalprice AS m"]
HALOS = [f"CAST(69 + p_partkey % {SNAPS} AS INT) AS snap", "p_partkey AS halo_index", f"{_at('p_partkey', 7919, 8000, 13)} AS hx", f"{_at('p_partkey', 104729, 7993, 5)} AS hy", f"{_at('p_partkey', 1299709, 7963, 7)} AS hz", "p_retailprice AS mass", "CAST(p_size AS DOUBLE) / 10 AS radius"]


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*POINTS)


def halos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*HALOS)


def outputs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OUTPUTS, "snap int, z double")


def view(spark: SparkSession, lock: str | None = None, cone: bool = False, axis=AXIS, seed: int = 3) -> View:
    return View(spark, outputs(spark), COSMOLOGY, ORIENTATIONS, BOX, lock, seed, axis if cone else None, ANGLE if cone else None)


# SQL text.


def number(v: float) -> str:
    return f"{v!r}e0" if "e" not in repr(v) else repr(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    cells = ", ".join("(" + ", ".join("NULL" if v is None else number(v) if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {cells})"


def shells(z_min: float, z_max: float) -> list[tuple]:
    """(snap, r_lo, r_hi) of a shell, from the outputs' mid-points."""
    z = [v for _, v in OUTPUTS]
    edges = [z[0], *((a + b) / 2 for a, b in zip(z[:-1], z[1:], strict=True)), z[-1]]
    out = []
    for i, (snap, _) in enumerate(OUTPUTS):
        lo, hi = max(edges[i + 1], z_min), min(edges[i], z_max)
        if lo < hi:
            out.append((snap, COSMOLOGY.distance(lo), COSMOLOGY.distance(hi)))
    return out


POINTS_SQL = f"points AS (SELECT {', '.join(POINTS)} FROM orders)"
HALOS_SQL = f"halos AS (SELECT {', '.join(HALOS)} FROM part)"
OUTPUTS_SQL = values("outputs", "snap, z", OUTPUTS)
ORIENT_SQL = values("orient", "row, sx, sy, sz, " + ", ".join(MATRIX), [(i, *map(int, s), *quarter_matrix(t, r).ravel().tolist()) for i, (t, r, s) in enumerate(zip(*ORIENTATIONS.parts, strict=True))])
NEAR = "sqrt(" + " + ".join(f"power(greatest(abs({t}) * {BOX} - {BOX / 2}, 0), 2)" for t in ("nx", "ny", "nz")) + ")"
FAR = "sqrt(" + " + ".join(f"power(abs({t}) * {BOX} + {BOX / 2}, 2)" for t in ("nx", "ny", "nz")) + ")"
LATTICE = "n AS (SELECT CAST(unnest(range(-5, 6)) AS INT) AS n), lattice AS (SELECT a.n AS nx, b.n AS ny, c.n AS nz FROM n a, n b, n c)"


def row_sql(lock: str | None, seed: int = 3, tile: tuple[str, str, str] = ("nx", "ny", "nz")) -> str:
    layer = "layer" if lock == "sphere" else f"greatest({', '.join(f'abs({t})' for t in tile)})"
    terms = zip(tile, TILE_PRIMES, strict=True) if lock is None else [(layer, TILE_PRIMES[2])]
    total = " + ".join(f"CAST({t} AS BIGINT) * {p}" for t, p in terms) + f" + {seed * SEED_PRIME}"
    n = len(ORIENTATIONS)
    return f"CAST((({total}) % {n} + {n}) % {n} AS INT)"


def cone_tile_sql(axis=AXIS, angle: float = ANGLE) -> str:
    size = math.sqrt(sum(a * a for a in axis))
    along = " + ".join(f"{t} * {BOX} * {number(a / size)}" for t, a in zip(("nx", "ny", "nz"), axis, strict=True))
    d, ball = f"(sqrt(CAST(nx*nx + ny*ny + nz*nz AS DOUBLE)) * {BOX})", math.sqrt(3) / 2 * BOX
    c, w = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    boxed = []
    for t, a in zip(("nx", "ny", "nz"), axis, strict=True):
        a /= size
        ends, spread = f"r_lo * {number(c * a)}, r_hi * {number(a)}", f"r_hi * {number(w * math.sqrt(1 - a * a))}"
        boxed.append(f"{t} BETWEEN floor((least({ends}) - {spread}) / {BOX} + 0.5e0) AND floor((greatest({ends}) + {spread}) / {BOX} + 0.5e0)")
    return " AND ".join(boxed) + f" AND ({d} <= {ball} OR acos(greatest(-1, least(1, ({along}) / {d}))) <= {math.radians(angle)} + asin(least(1, {ball} / {d})))"


def pieces_sql(z_range: tuple[float, float], lock: str | None = None, cone: bool = False) -> str:
    """CTEs up to pieces(snap, nx, ny, nz, layer, r_lo, r_hi, row, ...)."""
    bounded = f" AND {cone_tile_sql()}" if cone else ""
    tiles = f"{values('shells', 'snap, r_lo, r_hi', shells(*z_range))}, {LATTICE}, tiles AS (SELECT * FROM shells, lattice WHERE {NEAR} <= r_hi AND {FAR} >= r_lo{bounded})"
    if lock == "sphere":
        tiles += f", layered AS (SELECT snap, nx, ny, nz, k.n AS layer, greatest(r_lo, (k.n - 0.5e0) * {BOX}) AS r_lo, least(r_hi, (k.n + 0.5e0) * {BOX}) AS r_hi FROM tiles, n k WHERE k.n >= 0), split AS (SELECT * FROM layered WHERE r_lo < r_hi AND {NEAR} <= r_hi AND {FAR} >= r_lo)"
    else:
        tiles += ", split AS (SELECT snap, nx, ny, nz, CAST(NULL AS INT) AS layer, r_lo, r_hi FROM tiles)"
    return f"{tiles}, {ORIENT_SQL}, pieces AS (SELECT s.*, o.* FROM split s JOIN orient o ON o.row = {row_sql(lock)})"


def moved_sql(p: tuple[str, str, str], out: tuple[str, str, str] = ("x", "y", "z"), tile: bool = True) -> str:
    """Three expressions: p shifted, wrapped, turned, wrapped and set on the lattice."""
    c = [f"(({v} + {s} * 125e0) - {BOX} * floor(({v} + {s} * 125e0) / {BOX}) - {BOX / 2})" for v, s in zip(p, ("sx", "sy", "sz"), strict=True)]
    parts = []
    for i, (o, t) in enumerate(zip(out, ("nx", "ny", "nz"), strict=True)):
        q = "(" + " + ".join(f"m{i}{j} * {c[j]}" for j in range(3)) + f" + {BOX / 2})"
        w = f"CASE WHEN {q} < 0 OR {q} > {BOX} THEN {q} - {BOX} * floor({q} / {BOX}) ELSE {q} END"
        parts.append(f"({w}) + ({t} * {BOX} - {BOX / 2}) AS {o}" if tile else f"({w}) AS {o}")
    return ", ".join(parts)


def in_piece_sql(cone: bool, p: tuple[str, str, str] = ("x", "y", "z"), axis=AXIS, angle: float = ANGLE, buffer: float = 0.0) -> str:
    x, y, z = p
    r = f"sqrt({x}*{x} + {y}*{y} + {z}*{z})"
    if not cone:
        return f"{r} >= r_lo - {buffer} AND {r} <= r_hi + {buffer}"
    size = math.sqrt(sum(a * a for a in axis))
    u = [number(a / size) for a in axis]
    along = f"({x}*{u[0]} + {y}*{u[1]} + {z}*{u[2]})"
    across = "sqrt(" + " + ".join(f"power({v} - {along}*{a}, 2)" for v, a in zip(p, u, strict=True)) + ")"
    wide = f" + CASE WHEN {r} > {buffer} THEN asin(least(1, {buffer} / {r})) ELSE {math.pi} END" if buffer else ""
    return f"{r} > r_lo - {buffer} AND {r} <= r_hi + {buffer} AND {along} > -{buffer} AND atan2({across}, {along}) <= {math.radians(angle)}{wide}"
