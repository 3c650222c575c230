"""The engine's registered queries, each with the same in SQL where SQL can express it."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import cosmology as cos
from skyloom.functions import geometry as g
from skyloom.functions import healpix as hp
from skyloom.operators import density, lattice, maps, orientation, projection, repeats, snapshots
from skyloom.plans.stage import written
from skyloom.plans.views import look_back
from skyloom.queries import fixtures as fx
from skyloom.queries import more
from skyloom.queries.fixtures import BOX, CELLS, HALOS_SQL, OUTPUTS_SQL, POINTS_SQL, SHELL
from skyloom.sources import catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TILE = ["nx", "ny", "nz"]


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# Snapshot selection.

EDGES = f"WITH {OUTPUTS_SQL}, edges AS (SELECT CAST(snap AS INT) AS snap, z, coalesce((lead(z) OVER w + z) / 2, z) AS z_lo, coalesce((lag(z) OVER w + z) / 2, z) AS z_hi FROM outputs WINDOW w AS (ORDER BY snap))"
GONE = (71, 74)


def _available(spark):
    return fx.outputs(spark).where(~F.col("snap").isin(*GONE))


@query(f"{EDGES} SELECT * FROM edges")
def snap_edges(spark, sf):
    return snapshots.edges(fx.outputs(spark))


@query(f"{EDGES} SELECT * FROM edges WHERE z_lo <= 0.225e0 + 1e-9 AND z_hi >= 0.125e0 - 1e-9")
def snap_range_overlap_closed(spark, sf):
    return snapshots.in_range(fx.outputs(spark), 0.125, 0.225)


@query(f"{EDGES} SELECT * FROM edges WHERE z_lo < 0.22e0 AND z_hi > 0.13e0")
def snap_range_overlap_strict(spark, sf):
    return snapshots.in_range(fx.outputs(spark), 0.13, 0.22, strict=True)


@query(f"{EDGES} SELECT * FROM edges WHERE z_lo <= 0.2249e0 + 1e-3 AND z_hi >= 0.1251e0 - 1e-3")
def snap_range_overlap_tol(spark, sf):
    return snapshots.in_range(fx.outputs(spark), 0.1251, 0.2249, 1e-3)


@query(f"WITH {OUTPUTS_SQL} SELECT CAST(snap AS INT) AS snap, z FROM outputs ORDER BY abs(z - 0.2500001e0) LIMIT 1")
def snap_nearest(spark, sf):
    return snapshots.nearest(fx.outputs(spark), 0.2500001)


@query(f"{EDGES} SELECT * FROM edges WHERE z_lo <= 0.3e0 AND z_hi >= 0.1e0 AND snap IN {GONE}")
def snap_coverage_missing(spark, sf):
    return snapshots.missing(fx.outputs(spark), _available(spark), 0.1, 0.3)


_AVAILABLE = f"{EDGES}, have AS (SELECT CAST(snap AS INT) AS snap, z, coalesce((lead(z) OVER w + z) / 2, (SELECT min(z) FROM outputs)) AS z_lo, coalesce((lag(z) OVER w + z) / 2, (SELECT max(z) FROM outputs)) AS z_hi FROM outputs WHERE snap NOT IN {GONE} WINDOW w AS (ORDER BY snap))"


@query(f"{_AVAILABLE} SELECT * FROM have")
def snap_available_edges(spark, sf):
    return snapshots.available_edges(fx.outputs(spark), _available(spark))


@query(f"{_AVAILABLE} SELECT e.snap, list(h.snap ORDER BY h.snap) AS filled_by FROM edges e JOIN have h ON h.z_lo < e.z_hi AND h.z_hi > e.z_lo WHERE e.snap IN {GONE} AND e.z_lo <= 0.3e0 AND e.z_hi >= 0.1e0 GROUP BY e.snap")
def snap_filled_by(spark, sf):
    return snapshots.coverage(fx.outputs(spark), _available(spark), 0.1, 0.3)[2]


@query(f"WITH {OUTPUTS_SQL}, g AS (SELECT z AS z_from, lead(z) OVER (ORDER BY z) AS z_to FROM outputs WHERE snap NOT IN {GONE}) SELECT *, z_to - z_from AS dz FROM g WHERE z_from < 0.3e0 AND z_to > 0.1e0")
def snap_spacing(spark, sf):
    return snapshots.spacing(fx.outputs(spark), _available(spark), 0.1, 0.3)


@query(fx.values("WITH s", "snap, r_lo, r_hi", fx.shells(*SHELL)) + " SELECT CAST(snap AS INT) AS snap, round(r_lo, 6) AS r_lo, round(r_hi, 6) AS r_hi FROM s")
def snap_shell_radii(spark, sf):
    return fx.view(spark).snapshots(*SHELL).select("snap", F.round("r_lo", 6).alias("r_lo"), F.round("r_hi", 6).alias("r_hi"))


# Lattice.


def _tiles(spark, cone):
    v = fx.view(spark, cone=cone)
    return v.tiles(v.snapshots(*(fx.CONE_SHELL if cone else SHELL))).select("snap", *TILE)


query(f"WITH {fx.pieces_sql(SHELL)} SELECT CAST(snap AS INT) AS snap, nx, ny, nz FROM pieces", "tiles_all_sky")(lambda spark, sf: _tiles(spark, False))
query(f"WITH {fx.pieces_sql(fx.CONE_SHELL, cone=True)} SELECT CAST(snap AS INT) AS snap, nx, ny, nz FROM pieces", "tiles_cone")(lambda spark, sf: _tiles(spark, True))


@query(f"WITH {fx.pieces_sql(SHELL, 'sphere')} SELECT CAST(snap AS INT) AS snap, nx, ny, nz, layer, round(r_lo, 6) AS r_lo, round(r_hi, 6) AS r_hi FROM pieces")
def tiles_sphere_layers(spark, sf):
    return fx.view(spark, "sphere").pieces(*SHELL).select("snap", *TILE, "layer", F.round("r_lo", 6).alias("r_lo"), F.round("r_hi", 6).alias("r_hi"))


_FRAME = g.tile_frame(fx.AXIS)


@query(f"WITH {fx.pieces_sql(fx.CONE_SHELL, cone=True)} SELECT DISTINCT nx, ny, nz, " + ", ".join(f"CAST({' + '.join(f'{k} * {t}' for k, t in zip(row, TILE, strict=True))} AS INT) AS {n}" for row, n in zip(_FRAME, ("lx", "ly", "l_los"), strict=True)) + " FROM pieces")
def tile_labels(spark, sf):
    return lattice.framed(_tiles(spark, True).select(*TILE).distinct(), _FRAME)


for _lock in (None, "cube", "sphere"):
    _name = _lock or "none"

    def _rows(spark, sf, lock=_lock):
        return fx.view(spark, lock).pieces(*SHELL).select("snap", *TILE, "layer", "row")

    query(f"WITH {fx.pieces_sql(SHELL, _lock)} SELECT CAST(snap AS INT) AS snap, nx, ny, nz, layer, CAST(row AS INT) AS row FROM pieces", f"orientation_rows_{_name}")(_rows)

    for _cone in (False, True):

        def _points(spark, sf, lock=_lock, cone=_cone):
            v = fx.view(spark, lock, cone)
            return v.place(fx.points(spark, sf).select("snap", "id", "x", "y", "z"), v.pieces(*(fx.CONE_SHELL if cone else SHELL))).drop("layer")

        query(f"WITH {fx.pieces_sql(fx.CONE_SHELL if _cone else SHELL, _lock, _cone)}, {POINTS_SQL}, moved AS (SELECT p.snap, id, nx, ny, nz, r_lo, r_hi, {fx.moved_sql(('x', 'y', 'z'))} FROM points p JOIN pieces c ON p.snap = c.snap) SELECT CAST(snap AS INT) AS snap, id, nx, ny, nz, x, y, z FROM moved WHERE {fx.in_piece_sql(_cone)}", f"points_{'cone' if _cone else 'all_sky'}_{_name}")(_points)


# The geometry kernel.

_TURN = f"WITH {fx.ORIENT_SQL}, {POINTS_SQL}, placed AS (SELECT p.*, o.* FROM points p JOIN orient o ON o.row = id % 50)"


def _turned(spark, sf):
    p = fx.points(spark, sf).withColumn("row", (F.col("id") % 50).cast("int"))
    return p.join(F.broadcast(fx.ORIENTATIONS.frame(spark)), "row")


def _kernel():
    return [F.col(c) for c in orientation.MATRIX], tuple(g.cell_shift(F.col(f"s{a}"), BOX) for a in g.AXES)


@query(f"{_TURN} SELECT id, {fx.moved_sql(('x', 'y', 'z'), tile=False)} FROM placed")
def reorient_points(spark, sf):
    m, s = _kernel()
    return _turned(spark, sf).select("id", *[c.alias(a) for c, a in zip(g.reoriented(g.vector(), m, s, BOX), g.AXES, strict=True)])


@query(f"WITH {POINTS_SQL} SELECT id, x, y, z FROM points")
def reorient_inverse(spark, sf):
    m, s = _kernel()
    there = _turned(spark, sf)
    there = there.withColumns(dict(zip(("a", "b", "c"), g.reoriented(g.vector(), m, s, BOX), strict=True)))
    return there.select("id", *[c.alias(a) for c, a in zip(g.restored((F.col("a"), F.col("b"), F.col("c")), m, s, BOX), g.AXES, strict=True)])


@query(f"{_TURN} SELECT id, " + ", ".join(f"m{i}0*vx + m{i}1*vy + m{i}2*vz AS v{a}" for i, a in enumerate("xyz")) + " FROM placed")
def reorient_velocity(spark, sf):
    return _turned(spark, sf).select("id", *[c.alias(f"v{a}") for c, a in zip(g.turned(g.vector("v"), _kernel()[0]), g.AXES, strict=True)])


@query(f"WITH {POINTS_SQL} SELECT id, round(atan2(y - 500, x - 500), 6) AS lon, round(asin((z - 500) / sqrt(power(x - 500, 2) + power(y - 500, 2) + power(z - 500, 2))), 6) AS lat FROM points WHERE x <> 500 OR y <> 500 OR z <> 500")
def sky_lonlat(spark, sf):
    p = fx.points(spark, sf).where("x <> 500 or y <> 500 or z <> 500")
    lon, lat = g.sky_coordinates((F.col("x") - 500, F.col("y") - 500, F.col("z") - 500))
    return p.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


# Cells and plans.

_CELL = "(least(floor(x / 125), 7) * 8 + least(floor(y / 125), 7)) * 8 + least(floor(z / 125), 7)"
_GRID = "grid AS (SELECT CAST(c AS INT) AS cell, (c // 64 + 0.5e0) * 125 AS cx, (c // 8 % 8 + 0.5e0) * 125 AS cy, (c % 8 + 0.5e0) * 125 AS cz FROM range(512) t(c))"
_CELLS = f"{POINTS_SQL}, {_GRID}, counts AS (SELECT snap, CAST({_CELL} AS INT) AS cell, count(*) AS cnt FROM points GROUP BY ALL), cells AS (SELECT CAST(snap AS INT) AS snap, cell, cx, cy, cz, cnt, cell % {fx.FILES} AS file, coalesce(sum(cnt) OVER (PARTITION BY snap, cell % {fx.FILES} ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM counts JOIN grid USING (cell))"


@query(f"WITH {POINTS_SQL} SELECT id, CAST({_CELL} AS INT) AS cell FROM points")
def cells_of_points(spark, sf):
    return lattice.with_cells(fx.points(spark, sf), BOX, CELLS).select("id", "cell")


@query(f"WITH {_CELLS} SELECT snap, cell, cx, cy, cz, cnt, CAST(file AS INT) AS file, CAST(first AS BIGINT) AS first FROM cells")
def cell_zone_map(spark, sf):
    return lattice.cell_table(fx.points(spark, sf), BOX, CELLS, fx.FILES)


_NEAR_CELLS = f"WITH {fx.pieces_sql(fx.CONE_SHELL, 'cube', True)}, {_CELLS}, placed AS (SELECT c.snap, cell, cnt, file, first, nx, ny, nz, r_lo, r_hi, {fx.moved_sql(('cx', 'cy', 'cz'))} FROM cells c JOIN pieces p ON c.snap = p.snap), held AS (SELECT * FROM placed WHERE {fx.in_piece_sql(True, buffer=lattice.cell_buffer(BOX, CELLS))})"


@query(f"{_NEAR_CELLS} SELECT snap, cell, nx, ny, nz FROM held")
def cells_in_shell(spark, sf):
    v = fx.view(spark, "cube", True)
    return v.cells_in_pieces(v.pieces(*fx.CONE_SHELL), lattice.cell_table(fx.points(spark, sf), BOX, CELLS, fx.FILES), CELLS).select("snap", "cell", *TILE)


@query(f"{_NEAR_CELLS} SELECT snap, nx, ny, nz, CAST(file AS INT) AS file, count(*) AS n_cells, CAST(sum(cnt) AS BIGINT) AS n_rows FROM held GROUP BY ALL")
def file_plan(spark, sf):
    v = fx.view(spark, "cube", True)
    plan = v.file_plan(v.pieces(*fx.CONE_SHELL), lattice.cell_table(fx.points(spark, sf), BOX, CELLS, fx.FILES), CELLS)
    cells = lattice.cell_table(fx.points(spark, sf), BOX, CELLS, fx.FILES)
    # Cells are counted through the ranges that the plan made of them.
    ranges = plan.select("snap", *TILE, "file", "n_rows", F.explode("ranges").alias("r"))
    held = ranges.join(cells.select("snap", "file", F.col("first").alias("at")), ["snap", "file"]).where((F.col("at") >= F.col("r.first")) & (F.col("at") < F.col("r.first") + F.col("r.cnt")))
    return held.groupBy("snap", *TILE, "file").agg(F.count("*").alias("n_cells"), F.max("n_rows").alias("n_rows"))


@query(f"{_NEAR_CELLS}, marked AS (SELECT *, CASE WHEN lag(first + cnt) OVER w = first THEN 0 ELSE 1 END AS new FROM held WINDOW w AS (PARTITION BY snap, nx, ny, nz, file ORDER BY first)), runs AS (SELECT *, sum(new) OVER (PARTITION BY snap, nx, ny, nz, file ORDER BY first) AS run FROM marked) SELECT snap, nx, ny, nz, CAST(file AS INT) AS file, CAST(min(first) AS BIGINT) AS first, CAST(sum(cnt) AS BIGINT) AS cnt FROM runs GROUP BY snap, nx, ny, nz, file, run")
def merge_ranges(spark, sf):
    v = fx.view(spark, "cube", True)
    plan = v.file_plan(v.pieces(*fx.CONE_SHELL), lattice.cell_table(fx.points(spark, sf), BOX, CELLS, fx.FILES), CELLS)
    return plan.select("snap", *TILE, "file", F.explode("ranges").alias("r")).select("snap", *TILE, "file", "r.first", "r.cnt")


@query(SQL["points_cone_cube"])
def points_cone_pruned(spark, sf):
    v = fx.view(spark, "cube", True)
    p = lattice.with_cells(fx.points(spark, sf).select("snap", "id", "x", "y", "z"), BOX, CELLS)
    return v.place(p, v.pieces(*fx.CONE_SHELL), cells=CELLS).drop("layer", "cell")


@query("SELECT CAST(0 AS BIGINT) AS differing")
def beam_is_part_of_sky(spark, sf):
    cone, sky = fx.view(spark, "cube", True), fx.view(spark, "cube")
    p = fx.points(spark, sf).select("snap", "id", "x", "y", "z")
    a = cone.place(p, cone.pieces(*fx.CONE_SHELL)).drop("layer")
    b = sky.place(p, sky.pieces(*fx.CONE_SHELL)).drop("layer")
    radii = cone.snapshots(*fx.CONE_SHELL).agg(F.min("r_lo"), F.max("r_hi")).first()
    b = b.where(g.in_cone_shell(g.vector(), cone.axis, cone.half_angle, *radii))
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("differing"))


@query("SELECT CAST(0 AS BIGINT) AS differing")
def consecutive_shells(spark, sf):
    v = fx.view(spark)
    p = fx.points(spark, sf).select("snap", "id", "x", "y", "z")
    place = lambda a, b: v.place(p, v.pieces(a, b)).drop("layer")
    one, two = place(0.1, 0.2), place(0.1, 0.14).union(place(0.14, 0.2))
    return one.exceptAll(two).union(two.exceptAll(one)).agg(F.count("*").alias("differing"))


@query(f"WITH {fx.pieces_sql(SHELL, 'cube')}, {POINTS_SQL}, moved AS (SELECT p.snap, id, nx, ny, nz, r_lo, r_hi, {fx.moved_sql(('x', 'y', 'z'))}, " + ", ".join(f"m{i}0*vx + m{i}1*vy + m{i}2*vz AS v{a}" for i, a in enumerate("xyz")) + f" FROM points p JOIN pieces c ON p.snap = c.snap) SELECT CAST(snap AS INT) AS snap, id, nx, ny, nz, vx, vy, vz FROM moved WHERE {fx.in_piece_sql(False)}")
def points_velocity(spark, sf):
    v = fx.view(spark, "cube")
    return v.place(fx.points(spark, sf).drop("m"), v.pieces(*SHELL), velocity=("vx", "vy", "vz")).select("snap", "id", *TILE, "vx", "vy", "vz")


_KNOTS = 64
_Z = [i * 0.5 / (_KNOTS - 1) for i in range(_KNOTS)]
_RZ = fx.values("rz", "z0, r0, z1, r1", [(float(a), float(ra), float(b), float(rb)) for a, b, ra, rb in zip(_Z[:-1], _Z[1:], fx.COSMOLOGY.distance(_Z[:-1]), fx.COSMOLOGY.distance(_Z[1:]), strict=True)])


@query(f"WITH {_RZ}, {POINTS_SQL}, d AS (SELECT id, sqrt(x*x + y*y + z*z) AS r FROM points) SELECT id, round(z0 + (r - r0) * (z1 - z0) / (r1 - r0), 6) AS z_at_r, round(1 / (1 + z0 + (r - r0) * (z1 - z0) / (r1 - r0)), 6) AS expansion_factor FROM d JOIN rz ON r >= r0 AND r < r1")
def points_expansion_factor(spark, sf):
    p = fx.points(spark, sf).select("id", g.norm(g.vector()).alias("r"))
    out = cos.linear_redshift(p, cos.linear_table(spark, fx.COSMOLOGY, 0.5, _KNOTS)).where("z_at_r is not null")
    return out.select("id", F.round("z_at_r", 6).alias("z_at_r"), F.round(cos.expansion_factor(F.col("z_at_r")), 6).alias("expansion_factor"))


@query()
def points_spline_redshift(spark, sf):
    v = fx.view(spark, "cube")
    return v.with_expansion(v.place(fx.points(spark, sf).select("snap", "id", "x", "y", "z"), v.pieces(*SHELL)))


# Haloes.

for _cone in (False, True):

    def _halos(spark, sf, cone=_cone):
        v = fx.view(spark, "cube", cone)
        return v.place(fx.halos(spark, sf).select("snap", "halo_index", "hx", "hy", "hz"), v.pieces(*(fx.CONE_SHELL if cone else SHELL)), ("hx", "hy", "hz")).drop("layer")

    query(f"WITH {fx.pieces_sql(fx.CONE_SHELL if _cone else SHELL, 'cube', _cone)}, {HALOS_SQL}, moved AS (SELECT p.snap, halo_index, nx, ny, nz, r_lo, r_hi, {fx.moved_sql(('hx', 'hy', 'hz'), ('hx', 'hy', 'hz'))} FROM halos p JOIN pieces c ON p.snap = c.snap) SELECT CAST(snap AS INT) AS snap, halo_index, nx, ny, nz, hx, hy, hz FROM moved WHERE {fx.in_piece_sql(_cone, ('hx', 'hy', 'hz'))}", f"halos_{'cone' if _cone else 'all_sky'}")(_halos)

_HALO_SKY = SQL["halos_all_sky"]


@query(f"SELECT s.snap, s.halo_index, nx, ny, nz, h.mass, h.radius FROM ({_HALO_SKY}) s JOIN (WITH {HALOS_SQL} SELECT * FROM halos) h ON s.snap = h.snap AND s.halo_index = h.halo_index")
def halo_lookback(spark, sf):
    return look_back(QUERIES["halos_all_sky"](spark, sf), fx.halos(spark, sf), ["mass", "radius"]).select("snap", "halo_index", *TILE, "mass", "radius")


@query(f"WITH {HALOS_SQL} SELECT halo_index, mass FROM halos WHERE mass > 980 AND mass <= 1020")
def select_rows_by_mass(spark, sf):
    return catalogue.where(fx.halos(spark, sf), (F.col("mass") > 980) & (F.col("mass") <= 1020)).select("halo_index", "mass")


@query(f"WITH {HALOS_SQL} SELECT halo_index, mass FROM halos WHERE mass > 980 AND mass <= 1020")
def select_rows_by_function(spark, sf):
    return catalogue.where(fx.halos(spark, sf), lambda m: (m > 980) & (m <= 1020), "mass").select("halo_index", "mass")


@query(f"WITH {HALOS_SQL} SELECT halo_index, mass, radius FROM halos WHERE halo_index >= 100 AND halo_index < 250")
def select_rows_range(spark, sf):
    return catalogue.rows(fx.halos(spark, sf), 100, 250).select("halo_index", "mass", "radius")


@query(f"WITH {HALOS_SQL} SELECT halo_index, mass FROM halos WHERE halo_index IN (SELECT o_custkey FROM orders)")
def select_rows_semi(spark, sf):
    wanted = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("halo_index"))
    return catalogue.selected_rows(fx.halos(spark, sf), wanted).select("halo_index", "mass")


@query(f"WITH {HALOS_SQL}, d AS (SELECT *, abs(log10(mass) - 3.1) AS d FROM halos), r AS (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY d, halo_index) AS r FROM d) SELECT CAST(snap AS INT) AS snap, halo_index FROM r ORDER BY r > 1, d, snap, halo_index LIMIT 14")
def chosen_haloes(spark, sf):
    h = fx.halos(spark, sf).select("snap", "halo_index", F.log10("mass").alias("log_mass"))
    return density.chosen_haloes(h, 3.1, 14).select("snap", "halo_index")


@query(f"WITH {HALOS_SQL} SELECT halo_index, CASE WHEN hx > 100 AND hx <= 300 THEN 0 WHEN hx > 300 AND hx <= 500 THEN 1 WHEN hx > 500 AND hx <= 900 THEN 2 ELSE 999 END AS shell FROM halos")
def shell_number(spark, sf):
    return fx.halos(spark, sf).select("halo_index", density.shell_number(F.col("hx"), [(100, 300), (300, 500), (500, 900)]).alias("shell"))


# Densities.

_BINS = [100.0, 400.0, 700.0, 1000.0, 1300.0]
_BIN_SQL = fx.values("bins", "bin, lo, hi", [(i, a, b) for i, (a, b) in enumerate(zip(_BINS[:-1], _BINS[1:], strict=True))])
_COUNTS = f"WITH {_BIN_SQL}, {POINTS_SQL}, d AS (SELECT snap, sqrt(x*x + y*y + z*z) AS r FROM points), counts AS (SELECT CAST(bin AS INT) AS bin, lo, hi, count(r) AS n FROM bins LEFT JOIN d ON r >= lo AND (r < hi OR bin = 3 AND r = hi) GROUP BY ALL)"


@query(f"{_COUNTS} SELECT * FROM counts")
def count_in_bins(spark, sf):
    return density.counted(fx.points(spark, sf), g.norm(g.vector()), _BINS)


@query(f"{_COUNTS}, v AS (SELECT *, {4 * math.pi / 3} * (power(hi, 3) - power(lo, 3)) AS volume FROM counts) SELECT bin, n, round(volume, 3) AS volume, round(n / volume / 1e-5, 6) AS ratio FROM v")
def density_ratio(spark, sf):
    counts = density.counted(fx.points(spark, sf), g.norm(g.vector()), _BINS)
    return density.densities(counts, 1e-5).select("bin", "n", F.round("volume", 3).alias("volume"), F.round("ratio", 6).alias("ratio"))


@query(f"WITH {POINTS_SQL} SELECT CAST(snap AS INT) AS snap, round(quantile_cont(m, 0.1587), 4) AS p0, round(quantile_cont(m, 0.5), 4) AS p1, round(quantile_cont(m, 0.8413), 4) AS p2 FROM points GROUP BY snap")
def ratio_percentiles(spark, sf):
    return density.percentiles(fx.points(spark, sf), ["snap"], "m").select("snap", *[F.round(p, 4).alias(p) for p in ("p0", "p1", "p2")])


@query(f"WITH {POINTS_SQL} SELECT CAST(snap AS INT) AS snap, count(*) / 1e9 AS mean FROM points GROUP BY snap")
def mean_density(spark, sf):
    return density.mean_density(fx.points(spark, sf), BOX)


# Replica checks.

_COPIES = f"WITH {fx.pieces_sql((0.12, 0.2))}, {_GRID}, placed AS (SELECT c.snap, cell, nx, ny, nz, p.row, r_lo, r_hi, {fx.moved_sql(('cx', 'cy', 'cz'))} FROM grid g, (SELECT DISTINCT snap FROM pieces) c JOIN pieces p ON c.snap = p.snap), copies AS (SELECT CAST(snap AS INT) AS snap, cell, nx, ny, nz, CAST(row AS INT) AS row, x, y, z FROM placed WHERE {fx.in_piece_sql(False, buffer=lattice.cell_buffer(BOX, CELLS))})"


def _copies(spark):
    v = fx.view(spark)
    return written(repeats.cell_copies(v, v.pieces(0.12, 0.2), CELLS), "copies")


@query(f"{_COPIES} SELECT snap, cell, nx, ny, nz, row, x, y, z FROM copies")
def cell_copies(spark, sf):
    return _copies(spark).drop("layer")


@query(f"{_COPIES}, n AS (SELECT cell, snap, count(*) AS n FROM copies GROUP BY ALL) SELECT a.cell, CAST(sum(CASE WHEN a.snap = b.snap THEN a.n ELSE 0 END) AS BIGINT) AS copies, CAST(sum(CASE WHEN a.snap = b.snap THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) AS BIGINT) AS pairs FROM n a JOIN n b ON a.cell = b.cell AND b.snap BETWEEN a.snap AND a.snap + 1 GROUP BY a.cell".replace("), n AS (SELECT cell", "), m AS (SELECT cell").replace("FROM n a JOIN n b", "FROM m a JOIN m b"))
def cell_pairs_window(spark, sf):
    return repeats.pair_counts(_copies(spark), 1)


# Copies pair up to a box along the sight plus a cell's diagonal, and between neighbouring snapshots.
_PAIRS = f"{_COPIES}, p AS (SELECT a.cell, a.snap AS a_snap, a.nx AS a_nx, a.ny AS a_ny, a.nz AS a_nz, b.snap AS b_snap, b.nx AS b_nx, b.ny AS b_ny, b.nz AS b_nz, a.row AS ra, b.row AS rb, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS separation, sqrt(a.x*a.x + a.y*a.y + a.z*a.z) AS da, sqrt(b.x*b.x + b.y*b.y + b.z*b.z) AS db, a.x*b.x + a.y*b.y + a.z*b.z AS ab FROM copies a JOIN copies b ON a.cell = b.cell AND b.snap <= a.snap + 1 AND (a.snap, a.nx, a.ny, a.nz) < (b.snap, b.nx, b.ny, b.nz)), pairs AS (SELECT *, abs(separation - 125) <= 125e-6 AS touching, acos(greatest(-1, least(1, ab / (da * db)))) <= 0.1 AND abs(da - db) <= 1000 AND NOT (ra = rb AND dx % 1000 = 0 AND dy % 1000 = 0 AND dz % 1000 = 0) AS line_of_sight FROM p WHERE separation <= 1000 + 125 * sqrt(3e0) AND separation > 125e-6)"


def _pairs(spark):
    return repeats.close_pairs(_copies(spark), BOX / CELLS, BOX, angle=0.1)


@query(f"{_PAIRS} SELECT cell, a_snap, a_nx, a_ny, a_nz, b_snap, b_nx, b_ny, b_nz, round(separation, 6) AS separation, touching, line_of_sight FROM pairs")
def close_pairs(spark, sf):
    return _pairs(spark).select("cell", *[f"{p}_{t}" for p in "ab" for t in ("snap", *TILE)], F.round("separation", 6).alias("separation"), "touching", "line_of_sight")


@query(f"{_PAIRS} SELECT count(*) AS pairs, count(*) FILTER (touching) AS touching, count(*) FILTER (line_of_sight) AS line_of_sight, (SELECT count(*) FROM (SELECT DISTINCT cell, list_sort([[a_nx, a_ny, a_nz], [b_nx, b_ny, b_nz]]) FROM pairs WHERE touching)) AS faces FROM pairs")
def touching_pairs(spark, sf):
    p = written(_pairs(spark), "pairs")
    return p.agg(F.count("*").alias("pairs"), F.count_if("touching").alias("touching"), F.count_if("line_of_sight").alias("line_of_sight")).crossJoin(repeats.touching_faces(p).agg(F.count("*").alias("faces")))


@query(f"{_PAIRS}, ends AS (SELECT cell, a_snap AS snap, a_nx AS nx, a_ny AS ny, a_nz AS nz, separation FROM pairs UNION ALL SELECT cell, b_snap, b_nx, b_ny, b_nz, separation FROM pairs), best AS (SELECT cell, snap, nx, ny, nz, min(separation) AS closest FROM ends GROUP BY ALL) SELECT c.cell, c.snap, c.nx, c.ny, c.nz, round(closest, 6) AS closest FROM copies c LEFT JOIN best USING (cell, snap, nx, ny, nz)")
def closest_copy(spark, sf):
    return repeats.closest_copy(_copies(spark), BOX / CELLS, BOX).select("cell", "snap", *TILE, F.round("closest", 6).alias("closest"))


_FACES = f"WITH {fx.ORIENT_SQL}, {_GRID}, moved AS (SELECT row, cell, {fx.moved_sql(('cx', 'cy', 'cz'), tile=False)} FROM grid, orient), placed AS (SELECT CAST(row AS INT) AS row, CAST(cell AS BIGINT) AS cell, CAST(floor(x / 125) AS INT) AS i, CAST(floor(y / 125) AS INT) AS j, CAST(floor(z / 125) AS INT) AS k FROM moved), keys AS (" + " UNION ALL ".join(f"SELECT row, {a} AS axis, CASE WHEN {c} = 7 THEN 1 ELSE -1 END AS side, (cell * 8 + {u}) * 8 + {v} AS key FROM placed WHERE {c} IN (0, 7)" for a, c, u, v in ((0, "i", "j", "k"), (1, "j", "i", "k"), (2, "k", "i", "j"))) + ")"


def _orientations(spark):
    return fx.ORIENTATIONS.frame(spark)


@query(f"{_FACES} SELECT row, axis, side, key FROM keys")
def face_keys(spark, sf):
    return orientation.face_keys(_orientations(spark), CELLS)


_CLASHES = f"{_FACES}, p AS (SELECT DISTINCT a.row AS a, b.row AS b FROM keys a JOIN keys b ON a.axis = b.axis AND a.key = b.key AND a.side = 1 AND b.side = -1), c AS (SELECT a, b FROM p UNION SELECT b, a FROM p)"


@query(f"{_CLASHES} SELECT a, b FROM c")
def clashing_rows(spark, sf):
    return orientation.clashing_pairs(_orientations(spark), CELLS)


@query(f"{_CLASHES} SELECT count(*) AS n FROM c")
def clash_free_count(spark, sf):
    return orientation.clashing_pairs(_orientations(spark), CELLS).agg(F.count("*").alias("n"))


_EXTENT = 3


def _tile_row(p: str) -> str:
    return fx.row_sql(None, 3, (f"{p}x", f"{p}y", f"{p}z"))


@query(f"{_FACES}, t AS (SELECT CAST(unnest(range(-{_EXTENT}, {_EXTENT + 1})) AS INT) AS n), tiles AS (SELECT a.n AS ax, b.n AS ay, c.n AS az, CAST(d.axis AS INT) AS axis FROM t a, t b, t c, range(3) d(axis)), nxt AS (SELECT *, ax + (axis = 0)::INT AS bx, ay + (axis = 1)::INT AS by_, az + (axis = 2)::INT AS bz FROM tiles), rows AS (SELECT ax, ay, az, axis, {_tile_row('a')} AS ra, {_tile_row('b').replace('by', 'by_')} AS rb FROM nxt WHERE greatest(bx, by_, bz) <= {_EXTENT}) SELECT ax, ay, az, r.axis, CAST(p.key // 64 AS INT) AS cell FROM rows r JOIN keys p ON p.row = ra AND p.axis = r.axis AND p.side = 1 JOIN keys m ON m.row = rb AND m.axis = r.axis AND m.side = -1 AND m.key = p.key WHERE ra <> rb")
def neighbour_tiles_clash(spark, sf):
    return orientation.neighbouring_tiles(_orientations(spark), CELLS, len(fx.ORIENTATIONS), seed=3, extent=_EXTENT)


# Projection.

_REGION = (100.0, 900.0, 100.0, 900.0)
_SLICE = f"WITH {POINTS_SQL}, p AS (SELECT id, x, y, z, m, vx, 0.2e0 + x / 5000 AS redshift FROM points), mid AS (SELECT (min(z) + max(z)) / 2 AS c FROM p), slice AS (SELECT p.* FROM p, mid WHERE abs(z - c) <= 100 AND redshift BETWEEN 0.25 AND 0.35)"
_PIX = "CAST(least(floor((x - 100) / 50), 15) AS INT) AS ix, CAST(least(floor((y - 100) / 50), 15) AS INT) AS iy"
_IN = "x BETWEEN 100 AND 900 AND y BETWEEN 100 AND 900"


def _slice(spark, sf):
    p = fx.points(spark, sf).select("id", "x", "y", "z", "m", "vx", (0.2 + F.col("x") / 5000).alias("redshift"))
    return projection.slice_of(p, (0.25, 0.35), 200.0)


@query(f"{_SLICE} SELECT id, x, y, z FROM slice")
def slice_points(spark, sf):
    return _slice(spark, sf).select("id", "x", "y", "z")


@query(f"{_SLICE} SELECT " + ", ".join(f"min({a}) - 10 AS {a}_lo, max({a}) + 10 AS {a}_hi" for a in "xyz") + " FROM slice")
def slice_bounds(spark, sf):
    return projection.bounds(_slice(spark, sf))


@query(f"{_SLICE} SELECT {_PIX}, round(sum(m) / 2500, 6) AS value FROM slice WHERE {_IN} GROUP BY 1, 2")
def project_surface(spark, sf):
    return projection.projected(_slice(spark, sf), "m", _REGION, 16).withColumn("value", F.round("value", 6))


@query(f"{_SLICE} SELECT {_PIX}, round(sum(vx * m) / sum(m), 6) AS value FROM slice WHERE {_IN} GROUP BY 1, 2")
def project_weighted(spark, sf):
    return projection.projected(_slice(spark, sf), "vx", _REGION, 16, "m").withColumn("value", F.round("value", 6))


_SPH = f"{_SLICE}, j AS (SELECT CAST(unnest(range(-2, 18)) AS INT) AS j), k AS (SELECT id, m, a.j AS jx, b.j AS jy, power(greatest(1 - (power(100 + (a.j + 0.5e0) * 50 - x, 2) + power(100 + (b.j + 0.5e0) * 50 - y, 2)) / 6400, 0), 3) AS k FROM slice, j a, j b WHERE a.j BETWEEN floor((x - 180) / 50) AND floor((x - 20) / 50) AND b.j BETWEEN floor((y - 180) / 50) AND floor((y - 20) / 50)), t AS (SELECT *, k / sum(k) OVER (PARTITION BY id) AS s FROM k)"


@query(f"{_SPH} SELECT jx AS ix, jy AS iy, round(sum(s * m) / 2500, 6) AS value FROM t WHERE k > 0 AND jx BETWEEN 0 AND 15 AND jy BETWEEN 0 AND 15 GROUP BY ALL")
def project_sph(spark, sf):
    p = _slice(spark, sf).where(_IN).withColumn("h", F.lit(80.0))
    return projection.projected_sph(p, "m", _REGION, 16).withColumn("value", F.round("value", 6))


SQL["project_sph"] = SQL["project_sph"].replace("FROM slice, j a, j b WHERE", f"FROM slice, j a, j b WHERE {_IN} AND")


@query(f"WITH {HALOS_SQL}, d AS (SELECT a.halo_index AS id, sqrt(power(a.hx - b.hx, 2) + power(a.hy - b.hy, 2) + power(a.hz - b.hz, 2)) AS d, row_number() OVER (PARTITION BY a.halo_index ORDER BY power(a.hx - b.hx, 2) + power(a.hy - b.hy, 2) + power(a.hz - b.hz, 2)) AS r FROM halos a, halos b) SELECT id, round(d / 1.8, 6) AS h FROM d WHERE r = 33")
def smoothing_lengths(spark, sf):
    h = fx.halos(spark, sf).select(F.col("halo_index").alias("id"), F.col("hx").alias("x"), F.col("hy").alias("y"), F.col("hz").alias("z"))
    return projection.smoothing_lengths(h, 250.0).select("id", F.round("h", 6).alias("h"))


# Pixel maps.

NSIDE = 16


def _centred():
    return tuple(F.col(f"h{a}") - 500.0625 for a in g.AXES)


def _pixel_sql() -> str:
    """Nested pixel of haloes in DuckDB's SQL, by the published formulas."""
    bits = lambda v: " + ".join(f"((({v}) >> {i}) & 1) << {2 * i}" for i in range(5))
    bits = lambda v: "(" + " + ".join(f"(((({v}) >> {i}) & 1) << {2 * i})" for i in range(5)) + ")"
    n = NSIDE
    return f"""{HALOS_SQL}, v AS (SELECT *, hx - 500.0625e0 AS vx, hy - 500.0625e0 AS vy, hz - 500.0625e0 AS vz FROM halos),
u AS (SELECT *, vz / sqrt(vx*vx + vy*vy + vz*vz) AS cz, atan2(vy, vx) * {2 / math.pi} AS t FROM v),
w AS (SELECT *, abs(cz) AS za, CASE WHEN t < 0 THEN t + 4 ELSE t END AS tt FROM u),
e AS (SELECT *, CAST(floor({n} * (0.5e0 + tt) - {n} * cz * 0.75e0) AS BIGINT) AS jp, CAST(floor({n} * (0.5e0 + tt) + {n} * cz * 0.75e0) AS BIGINT) AS jm, CAST(least(floor(tt), 3) AS BIGINT) AS ntt, {n} * sqrt(3 * (1 - za)) AS q FROM w),
c AS (SELECT *, CAST(least(floor((tt - ntt) * q), {n - 1}) AS BIGINT) AS kp, CAST(least(floor((1 - tt + ntt) * q), {n - 1}) AS BIGINT) AS km FROM e),
f AS (SELECT *, CASE WHEN za <= {2 / 3} THEN CASE WHEN jp // {n} = jm // {n} THEN jp // {n} % 4 + 4 WHEN jp // {n} < jm // {n} THEN jp // {n} % 4 ELSE jm // {n} % 4 + 8 END WHEN cz >= 0 THEN ntt ELSE ntt + 8 END AS face,
CASE WHEN za <= {2 / 3} THEN jm % {n} WHEN cz >= 0 THEN {n} - km - 1 ELSE kp END AS px, CASE WHEN za <= {2 / 3} THEN {n} - jp % {n} - 1 WHEN cz >= 0 THEN {n} - kp - 1 ELSE km END AS py FROM c),
pixels AS (SELECT *, face * {n * n} + {bits('px')} + ({bits('py')} << 1) AS pix FROM f)"""


@query(f"WITH {_pixel_sql()}, counts AS (SELECT pix, count(*) AS n FROM pixels GROUP BY pix) SELECT p AS pix, CAST(coalesce(n, 0) AS BIGINT) AS n_halos, CAST(coalesce(sum(coalesce(n, 0)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_halo FROM range({hp.n_pixels(NSIDE)}) t(p) LEFT JOIN counts ON pix = p")
def halo_pixel_index(spark, sf):
    return maps.halo_pixel_index(fx.halos(spark, sf), _centred(), NSIDE)


@query(f"WITH {_pixel_sql()} SELECT pix, round(sum(mass), 4) AS value FROM pixels GROUP BY pix")
def map_deposit(spark, sf):
    return maps.deposited(fx.halos(spark, sf), _centred(), F.col("mass"), NSIDE).withColumn("value", F.round("value", 4))


_MAPS = "maps AS (SELECT 'map' || CAST(l_linenumber % 3 AS VARCHAR) AS map, l_partkey % 3072 AS pix, l_quantity AS value FROM lineitem)"


def _maps(spark, sf):
    return fx.table(spark, sf, "lineitem").select(F.concat(F.lit("map"), (F.col("l_linenumber") % 3).cast("string")).alias("map"), (F.col("l_partkey") % 3072).alias("pix"), F.col("l_quantity").alias("value"))


@query(f"WITH {_MAPS} SELECT map, pix, sum(value) AS value FROM maps GROUP BY ALL")
def map_sum(spark, sf):
    return maps.summed(_maps(spark, sf))


@query(f"WITH {_MAPS} SELECT map, pix >> 4 AS pix, sum(value) AS value FROM maps GROUP BY ALL")
def map_degrade(spark, sf):
    return maps.degraded(_maps(spark, sf), 2)


@query("WITH l AS (SELECT l_suppkey % 4 AS file, 'm' || CAST(l_partkey % 7 AS VARCHAR) AS map, CASE WHEN l_partkey % 7 = l_suppkey % 4 THEN NULL ELSE 16 END AS nside FROM lineitem) SELECT map FROM l WHERE nside IS NOT NULL GROUP BY map HAVING count(DISTINCT file) = (SELECT count(DISTINCT file) FROM l)")
def map_common(spark, sf):
    line = fx.table(spark, sf, "lineitem")
    kind, file = F.col("l_partkey") % 7, F.col("l_suppkey") % 4
    return maps.common(line.select(file.alias("file"), F.concat(F.lit("m"), kind.cast("string")).alias("map"), F.when(kind != file, 16).alias("nside")))


@query("SELECT p AS pix, p // 4 AS parent, list_transform(range(4), lambda k: p * 4 + k) AS children FROM range(768) t(p)")
def pix_family(spark, sf):
    return spark.range(768).select(F.col("id").alias("pix"), hp.parent(F.col("id")).alias("parent"), hp.children(F.col("id")).alias("children"))


@query(f"SELECT count(*) AS n, count(DISTINCT p) AS distinct_n, CAST(0 AS BIGINT) AS wrong FROM range({hp.n_pixels(NSIDE)}) t(p)")
def pix_round_trip(spark, sf):
    df = hp.with_vectors(spark.range(hp.n_pixels(NSIDE)).select(F.col("id").alias("pix")), "pix", NSIDE)
    df = hp.with_ring(hp.with_pixel(df, g.vector(), "back", NSIDE), "pix", "ring", NSIDE)
    df = hp.with_pixel(hp.with_vectors(df, "ring", NSIDE, nested=False, prefix="r"), g.vector("r"), "again", NSIDE, nested=False)
    return df.agg(F.count("*").alias("n"), F.count_distinct("ring").alias("distinct_n"), F.count_if((F.col("back") != F.col("pix")) | (F.col("again") != F.col("ring"))).alias("wrong"))


@query("WITH b(lo, hi) AS (VALUES (12e0, 12.5e0), (12.5e0, 13e0)), h AS (SELECT p_partkey AS halo_index, 12 + p_size / 50.0e0 AS lm FROM part) SELECT lo, hi, count(*) AS n FROM h JOIN b ON lm > lo AND lm <= hi GROUP BY ALL")
def mask_mass_bins(spark, sf):
    bins = spark.createDataFrame(maps.mask_bins(12.0, 13.0), "lo double, hi double")
    h = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("halo_index"), (12 + F.col("p_size") / 50.0).alias("lm"))
    return h.join(F.broadcast(bins), (F.col("lm") > F.col("lo")) & (F.col("lm") <= F.col("hi"))).groupBy("lo", "hi").agg(F.count("*").alias("n"))


# The flagship at volume: counts of a whole view over the large table.


@query(f"WITH {fx.pieces_sql(fx.CONE_SHELL, 'cube')}, p AS (SELECT CAST(69 + l_partkey % 9 AS INT) AS snap, CAST((l_orderkey * 7919) % 8000 AS DOUBLE) / 8 AS x, CAST((l_orderkey * 104729) % 7993 AS DOUBLE) / 8 AS y, CAST((l_partkey * 1299709) % 7963 AS DOUBLE) / 8 AS z, l_quantity AS m FROM lineitem), moved AS (SELECT p.snap, m, r_lo, r_hi, {fx.moved_sql(('x', 'y', 'z'))} FROM p JOIN pieces c ON p.snap = c.snap) SELECT CAST(snap AS INT) AS snap, count(*) AS n, sum(m) AS mass FROM moved WHERE {fx.in_piece_sql(False)} GROUP BY snap")
def flagship_view(spark, sf):
    at = lambda c, f, n: (F.pmod(F.col(c) * f, F.lit(n)).cast("double") / 8)
    p = fx.table(spark, sf, "lineitem").select((69 + F.col("l_partkey") % 9).cast("int").alias("snap"), at("l_orderkey", 7919, 8000).alias("x"), at("l_orderkey", 104729, 7993).alias("y"), at("l_partkey", 1299709, 7963).alias("z"), F.col("l_quantity").alias("m"))
    v = fx.view(spark, "cube")
    return v.place(p, v.pieces(*fx.CONE_SHELL)).groupBy("snap").agg(F.count("*").alias("n"), F.sum("m").alias("mass"))


more.register(query, sys.modules[__name__])
