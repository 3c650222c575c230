"""Registered queries of the entry points, halo searches and pixel maps, with their SQL (catalog.py takes them in)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window

from skyloom.functions import geometry as g
from skyloom.functions import healpix as hp
from skyloom.operators import density, lattice, maps, repeats
from skyloom.plans import haloes, particles
from skyloom.queries import fixtures as fx
from skyloom.queries.fixtures import BOX, CELLS, HALOS_SQL, POINTS_SQL, SHELL

TILE = ["nx", "ny", "nz"]
NSIDE = 16


def register(query, catalog) -> None:
    """query: catalog.query; catalog: the module, for the SQL that these build on."""
    sky, cone = catalog.SQL["points_all_sky_cube"], catalog.SQL["points_cone_cube"]

    def kinds(spark, sf):
        halos = fx.halos(spark, sf).select("snap", F.col("halo_index").alias("id"), F.col("hx").alias("x"), F.col("hy").alias("y"), F.col("hz").alias("z"), "radius")
        return {"points": fx.points(spark, sf), "haloes": halos}

    halos_sql = catalog.SQL["halos_all_sky"]

    @query(f"SELECT 'points' AS ptype, s.snap, s.id, s.nx, s.ny, s.nz, s.x, s.y, s.z, p.m, CAST(NULL AS DOUBLE) AS radius FROM ({sky}) s JOIN (WITH {POINTS_SQL} SELECT * FROM points) p ON s.id = p.id AND s.snap = p.snap UNION ALL SELECT 'haloes', s.snap, s.halo_index, nx, ny, nz, s.hx, s.hy, s.hz, NULL, h.radius FROM ({halos_sql}) s JOIN (WITH {HALOS_SQL} SELECT * FROM halos) h ON s.halo_index = h.halo_index AND s.snap = h.snap")
    def kinds_placed(spark, sf):
        return particles.place_kinds(fx.view(spark, "cube"), kinds(spark, sf), *SHELL, ["m", "radius"]).drop("redshift", "expansion_factor")

    snaps_sql = fx.values("WITH s", "snap, r_lo, r_hi", fx.shells(*SHELL))

    @query(f"{snaps_sql}, {POINTS_SQL}, {HALOS_SQL}, every AS (SELECT 'points' AS ptype, snap FROM points UNION ALL SELECT 'haloes', snap FROM halos) SELECT ptype, list_sort(list(DISTINCT CAST(e.snap AS INT))) AS snaps, count(*) AS n_rows FROM every e JOIN s ON s.snap = e.snap GROUP BY ptype")
    def kinds_to_read(spark, sf):
        return particles.read_summary(kinds(spark, sf), fx.view(spark, "cube").pieces(*SHELL))

    near = catalog._NEAR_CELLS

    @query(f"SELECT r.snap, CAST(n_read AS BIGINT) AS n_read, coalesce(n_kept, 0) AS n_kept, round(100 * coalesce(n_kept, 0) / n_read, 6) AS percent FROM ({near} SELECT snap, sum(cnt) AS n_read FROM held GROUP BY snap) r LEFT JOIN (SELECT snap, count(*) AS n_kept FROM ({cone}) GROUP BY snap) k ON r.snap = k.snap")
    def read_and_kept(spark, sf):
        v, p = fx.view(spark, "cube", True), fx.points(spark, sf).select("snap", "id", "x", "y", "z")
        cells = lattice.cell_table(p, BOX, CELLS, fx.FILES)
        return particles.read_and_kept(v, p, v.pieces(*fx.CONE_SHELL), cells, CELLS).withColumn("percent", F.round("percent", 6))

    @query(f"{near} SELECT snap, CAST(file AS INT) AS file, CAST(sum(cnt) AS BIGINT) AS n_rows FROM held GROUP BY ALL")
    def distinct_files(spark, sf):
        v, p = fx.view(spark, "cube", True), fx.points(spark, sf)
        return particles.distinct_files(v.file_plan(v.pieces(*fx.CONE_SHELL), lattice.cell_table(p, BOX, CELLS, fx.FILES), CELLS))

    cell_of = catalog._CELL

    @query(f"SELECT c.* FROM ({cone}) c JOIN (WITH {POINTS_SQL} SELECT id, {cell_of} AS cell FROM points) p ON c.id = p.id WHERE c.snap = 73 AND p.cell % {fx.FILES} = 1")
    def file_placed(spark, sf):
        v, p = fx.view(spark, "cube", True), lattice.with_cells(fx.points(spark, sf).select("snap", "id", "x", "y", "z"), BOX, CELLS)
        rows = p.withColumn("file", F.col("cell") % fx.FILES).withColumn("file_row", F.row_number().over(Window.partitionBy("snap", "file").orderBy("cell", "id")) - 1)
        pieces = v.pieces(*fx.CONE_SHELL)
        plan = v.file_plan(pieces, lattice.cell_table(p, BOX, CELLS, fx.FILES), CELLS)
        return particles.place_file(v, rows, pieces, plan, 73, 1).select("snap", "id", *TILE, "x", "y", "z")

    @query(f"{catalog._COPIES}, own AS (SELECT cell, count(*) AS copies FROM copies GROUP BY cell) SELECT cell, copies, CAST(coalesce(sum(copies) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS INT) AS block FROM own")
    def copy_blocks(spark, sf):
        return particles.blocks_of_copies(catalog._copies(spark), 500)

    # The views' own entry points; redshifts come from a spline, which SQL has not.
    @query(f"SELECT s.snap, s.id, s.x, s.y, s.z, s.nx, s.ny, s.nz, p.m FROM ({sky}) s JOIN (WITH {POINTS_SQL} SELECT * FROM points) p ON s.id = p.id AND s.snap = p.snap")
    def view_points(spark, sf):
        return fx.view(spark, "cube").points(fx.points(spark, sf), *SHELL, columns=["m"]).select("snap", "id", "x", "y", "z", *TILE, "m")

    @query(f"SELECT s.snap, s.halo_index, s.hx, s.hy, s.hz, h.mass, h.radius FROM ({halos_sql}) s JOIN (WITH {HALOS_SQL} SELECT * FROM halos) h ON s.snap = h.snap AND s.halo_index = h.halo_index")
    def view_halos(spark, sf):
        return haloes.place_haloes(fx.view(spark, "cube"), fx.halos(spark, sf), *SHELL, columns=("mass", "radius")).drop("redshift", "expansion_factor")

    edges = catalog.EDGES

    @query(f"{edges}, {HALOS_SQL} SELECT CAST(h.snap AS INT) AS snap, halo_index, mass FROM halos h JOIN edges e ON e.snap = h.snap WHERE z_lo < 0.22e0 AND z_hi > 0 AND z_lo >= 0.05e0 AND mass BETWEEN power(10, 2.99e0) AND power(10, 3.02e0)")
    def candidate_haloes(spark, sf):
        return haloes.candidates(fx.halos(spark, sf), fx.outputs(spark), 0.22, (2.99, 3.02), z_min=0.05).select("snap", "halo_index", "mass")

    seen = "halo_index % 200 / 1000.0e0 + 0.1e0"
    toward = [number / math.sqrt(3) for number in (1.0, 1.0, -1.0)]
    cosine = "(" + " + ".join(f"(h{a} - 500.0625e0) * {fx.number(u)}" for a, u in zip("xyz", toward, strict=True)) + ") / d"

    @query(f"{edges}, {HALOS_SQL}, h AS (SELECT CAST(snap AS INT) AS snap, halo_index, hx - 500.0625e0 AS x, hy - 500.0625e0 AS y, hz - 500.0625e0 AS z, {seen} AS redshift, mass, radius, {cosine} AS c, d FROM (SELECT *, sqrt(power(hx - 500.0625e0, 2) + power(hy - 500.0625e0, 2) + power(hz - 500.0625e0, 2)) AS d FROM halos)), s AS (SELECT min(snap) - 1 AS lo, max(snap) + 1 AS hi FROM edges WHERE z_lo < 0.2e0 AND z_hi > 0.15e0) SELECT snap, halo_index, redshift, mass, round(x / d, 9) AS vx, round(radius / d, 9) AS angular_radius, round(acos(greatest(-1, least(1, c))), 9) AS off FROM h, s WHERE snap BETWEEN lo AND hi AND redshift > 0.15e0 AND redshift <= 0.2e0 AND mass >= 950 AND c >= {fx.number(math.cos(0.6))}")
    def haloes_around(spark, sf):
        h = fx.halos(spark, sf).withColumns({f"h{a}": F.col(f"h{a}") - 500.0625 for a in "xyz"}).withColumn("redshift", F.col("halo_index") % 200 / 1000.0 + 0.1)
        got = haloes.around(h, fx.outputs(spark), (0.15, 0.2), tuple(toward), 0.6, 950.0, extra=("nothing",))
        return got.select("snap", "halo_index", "redshift", "mass", F.round("vx", 9).alias("vx"), F.round("angular_radius", 9).alias("angular_radius"), F.round("offset", 9).alias("off"))

    angle = "atan2(sqrt(" + " + ".join(f"power({a} - al * {fx.number(u)}, 2)" for a, u in zip("xyz", g.unit(fx.AXIS), strict=True)) + "), al)"
    along = " + ".join(f"{a} * {fx.number(u)}" for a, u in zip("xyz", g.unit(fx.AXIS), strict=True))
    bins = [450.0, 600.0, 700.0, 850.0]

    @query(fx.values("WITH b", "bin, lo, hi", [(i, a, c) for i, (a, c) in enumerate(zip(bins[:-1], bins[1:], strict=True))]) + f", p AS (SELECT *, {along} AS al, sqrt(x*x + y*y + z*z) AS r FROM ({sky}) q), k AS (SELECT r FROM p WHERE {angle} <= 0.7e0) SELECT CAST(bin AS INT) AS bin, lo, hi, count(r) AS n FROM b LEFT JOIN k ON r >= lo AND (r < hi OR bin = 2 AND r = hi) GROUP BY ALL")
    def counts_in_cone(spark, sf):
        v = fx.view(spark, "cube")
        return density.counted_in_view(v.place(fx.points(spark, sf).select("snap", "id", "x", "y", "z"), v.pieces(*SHELL)), bins, 0.7, fx.AXIS)

    # Pixels, by ring numbers: their centres by the published formulas.
    n, total = NSIDE, hp.n_pixels(NSIDE)
    cap = 2 * n * (n - 1)
    ring = "CAST(floor((1 + floor(sqrt({0}))) / 2) AS BIGINT)"
    pixels = f"""k AS (SELECT p AS pix, {ring.format("1 + 2 * p")} AS i_n, {ring.format(f"2 * ({total} - p) - 1")} AS i_s, (p - {cap}) // {4 * n} + {n} AS i_e FROM range({total}) t(p)),
m AS (SELECT pix, CASE WHEN pix < {cap} THEN 1 - i_n * i_n / {3.0 * n * n}e0 WHEN pix < {total - cap} THEN ({2 * n} - i_e) * 2 / {3.0 * n}e0 ELSE -1 + i_s * i_s / {3.0 * n * n}e0 END AS cz,
CASE WHEN pix < {cap} THEN (pix + 1 - 2 * i_n * (i_n - 1) - 0.5e0) * pi() / (2 * i_n) WHEN pix < {total - cap} THEN ((pix - {cap}) % {4 * n} + 1 - CASE WHEN (i_e + {n}) % 2 = 1 THEN 1 ELSE 0.5e0 END) * pi() / {2 * n} ELSE (4 * i_s + 1 - ({total} - pix - 2 * i_s * (i_s - 1)) - 0.5e0) * pi() / (2 * i_s) END AS phi FROM k),
sky AS (SELECT pix, sqrt(1 - cz * cz) * cos(phi) AS px, sqrt(1 - cz * cz) * sin(phi) AS py, cz AS pz FROM m)"""
    centred = f"{HALOS_SQL}, h AS (SELECT *, hx - 500.0625e0 AS x, hy - 500.0625e0 AS y, hz - 500.0625e0 AS z FROM halos), u AS (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM h)"

    def ringed(df, *columns):
        return hp.with_ring(df, "pix", "ring", NSIDE).select("ring", *columns)

    @query(f"WITH {centred}, {pixels}, b(lo, hi) AS (VALUES (2.9e0, 3.0e0), (3.0e0, 3.1e0)), s(scale) AS (VALUES (0.5e0), (2e0)) SELECT DISTINCT scale, lo AS log_mass_lo, hi AS log_mass_hi, pix AS ring FROM u JOIN b ON mass > power(10, lo) AND mass <= power(10, hi), s, sky WHERE (x*px + y*py + z*pz) / d >= cos(atan(scale * radius * 10 / d))")
    def aperture_pixels(spark, sf):
        p = tuple(F.col(f"h{a}") - 500.0625 for a in "xyz")
        got = maps.aperture_masks(fx.halos(spark, sf), NSIDE, [0.5, 2.0], [(2.9, 3.0), (3.0, 3.1)], p, F.col("mass"), F.col("radius") * 10)
        return ringed(got, "scale", "log_mass_lo", "log_mass_hi")

    @query(f"WITH {centred}, {pixels}, s AS (SELECT halo_index, mass, pix, power(1 - power(acos(least(1, (x*px + y*py + z*pz) / d)) / 0.12e0, 2), 2) AS k FROM u, sky WHERE (x*px + y*py + z*pz) / d > {fx.number(math.cos(0.12))}), t AS (SELECT *, k / sum(k) OVER (PARTITION BY halo_index) AS share FROM s) SELECT pix AS ring, round(sum(share * mass), 5) AS value FROM t GROUP BY pix")
    def map_smoothed(spark, sf):
        p = tuple(F.col(f"h{a}") - 500.0625 for a in "xyz")
        return ringed(maps.smoothed(fx.halos(spark, sf), p, F.lit(0.12), F.col("mass"), NSIDE), F.round("value", 5).alias("value"))

    # The haloes' pixels in both schemes: nested as in halo_pixel_index, ring by the published formulas.
    v = f"v2 AS (SELECT *, {n} * (0.5e0 + tt) - {n} * cz * 0.75e0 AS a, {n} * (0.5e0 + tt) + {n} * cz * 0.75e0 AS b, tt - floor(tt) AS tp FROM pixels), r AS (SELECT *, {n} + 1 + CAST(floor(a) AS BIGINT) - CAST(floor(b) AS BIGINT) AS ir, CAST(floor(tp * q) AS BIGINT) AS pp, CAST(floor((1 - tp) * q) AS BIGINT) AS pm FROM v2), e2 AS (SELECT *, pp + pm + 1 AS pr, 1 - (ir & 1) AS odd FROM r)"
    ring_of = f"CASE WHEN za <= {2 / 3} THEN {cap} + (ir - 1) * {4 * n} + ((CAST(floor(a) AS BIGINT) + CAST(floor(b) AS BIGINT) - {n} + odd + 1) // 2 + {4 * n}) % {4 * n} WHEN cz > 0 THEN 2 * pr * (pr - 1) + CAST(floor(tt * pr) AS BIGINT) % (4 * pr) ELSE {total} - 2 * pr * (pr + 1) + CAST(floor(tt * pr) AS BIGINT) % (4 * pr) END"

    @query(f"WITH {catalog._pixel_sql()}, {v} SELECT halo_index, pix AS nest, {ring_of} AS ring FROM e2", "halo_pixels")
    def halo_pixels(spark, sf):
        p = tuple(F.col(f"h{a}") - 500.0625 for a in "xyz")
        both = hp.with_pixel(hp.with_pixel(fx.halos(spark, sf), p, "nest", NSIDE), p, "ring", NSIDE, nested=False)
        return both.select("halo_index", "nest", "ring")
