"""Entry points: kinds of points, haloes, a stream, maps and plots' numbers, on small made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.functions import axes, plane
from skyloom.functions import geometry as g
from skyloom.functions import healpix as hp
from skyloom.operators import lattice, maps, projection, repeats
from skyloom.plans import haloes, particles
from skyloom.queries import fixtures as fx
from skyloom.streaming import points as streaming


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    rows = [(69 + i % 9, i, *(float(x) for x in rng.integers(0, 8000, 3) / 8), 1.0 * i) for i in range(600)]
    return spark.createDataFrame(rows, "snap int, id long, x double, y double, z double, m double")


def test_kinds_of_points(spark, made):
    v = fx.view(spark, "cube")
    kinds = {"gas": made, "stars": made.where("id % 3 = 0").drop("m").withColumn("age", F.lit(2.0))}
    got = particles.place_kinds(v, kinds, *fx.SHELL, ["m", "age"])
    assert got.columns == ["ptype", "snap", "id", "m", "age", "x", "y", "z", "nx", "ny", "nz", "redshift", "expansion_factor"]
    n = {r["ptype"]: r["count"] for r in got.groupBy("ptype").count().collect()}
    assert n["gas"] == v.points(made, *fx.SHELL).count() and 0 < n["stars"] < n["gas"]
    assert got.where("ptype = 'stars' and m is not null").isEmpty() and got.where("abs(expansion_factor * (1 + redshift) - 1) > 1e-12").isEmpty()
    z = got.agg(F.min("redshift"), F.max("redshift")).first()
    assert 0.1 - 1e-6 <= z[0] and z[1] <= 0.2 + 1e-6
    for bad, error in ((["gas", "dust"], ValueError), ([], ValueError)):
        with pytest.raises(error):
            particles.place_kinds(v, kinds, *fx.SHELL, ["m"], bad)
    with pytest.raises(ValueError, match="size"):
        particles.place_kinds(v, kinds, *fx.SHELL, ["size"], "gas")
    with pytest.raises(TypeError):
        particles.place_kinds(v, kinds, *fx.SHELL, None)
    assert particles.place_kinds(v, {"gas": made.where("false")}, *fx.SHELL, ["m"]).count() == 0


def test_files_make_up_the_whole(spark, made):
    from pyspark.sql import Window

    v = fx.view(spark, "sphere", True)
    p = lattice.with_cells(made.select("snap", "id", "x", "y", "z"), fx.BOX, fx.CELLS)
    rows = p.withColumn("file", F.col("cell") % 2).withColumn("file_row", F.row_number().over(Window.partitionBy("snap", "file").orderBy("cell", "id")) - 1).cache()
    pieces = v.pieces(*fx.CONE_SHELL)
    plan = v.file_plan(pieces, lattice.cell_table(p, fx.BOX, fx.CELLS, 2), fx.CELLS)
    columns = ["id", "nx", "ny", "nz", "layer"]
    whole = sorted(map(tuple, v.place(p, pieces).select(*columns).collect()))
    parts = [tuple(r) for f in particles.distinct_files(plan).collect() for r in particles.place_file(v, rows, pieces, plan, f["snap"], f["file"]).select(*columns).collect()]
    assert sorted(parts) == whole and whole
    assert particles.place_file(v, rows, pieces, plan, 1, 7).count() == 0
    assert sorted(map(tuple, v.place(p, pieces, cells=fx.CELLS).select(*columns).collect())) == whole


def test_pieces_beyond_the_broadcast_are_written(spark, made, monkeypatch):
    from skyloom.plans import stage

    v = fx.view(spark, "cube")
    whole = v.place(made, v.pieces(*fx.SHELL)).count()
    monkeypatch.setattr(stage.fixed, "__defaults__", (3,))
    pieces = v.pieces(*fx.SHELL)
    assert "Relation" in pieces._jdf.queryExecution().optimizedPlan().toString() and v.place(made, pieces).count() == whole


def test_stream_places_what_a_batch_does(spark, made, tmp_path):
    for k in range(3):
        made.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    v = fx.view(spark, "cube")
    pieces = v.pieces(*fx.SHELL)
    stream = streaming.read_points(spark, str(tmp_path / "in"), StructType.fromDDL("snap int, id long, x double, y double, z double, m double"))
    for _ in range(2):  # A second run finds nothing new.
        streaming.run(streaming.placed_stream(v, stream, pieces), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("id", "x", "nx").collect())) == sorted(map(tuple, v.place(made, pieces).select("id", "x", "nx").collect()))


def test_spline_redshifts(spark, made):
    v = fx.view(spark)
    got = v.points(made, *fx.SHELL).select("x", "y", "z", "redshift").collect()
    for r in got[:50]:
        assert v.cosmology.distance(r["redshift"]) == pytest.approx(math.sqrt(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2), rel=1e-9)


def test_haloes(spark, made):
    v = fx.view(spark, "cube")
    halos = made.select("snap", F.col("id").alias("halo_index"), *[F.col(a).alias(f"h{a}") for a in "xyz"], (F.col("m") - 5).alias("mass"))
    got = haloes.place_haloes(v, halos, *fx.SHELL, columns=("mass",))
    assert got.columns == ["snap", "halo_index", "hx", "hy", "hz", "redshift", "expansion_factor", "mass"] and got.where("mass <> halo_index - 5").isEmpty()
    with pytest.raises(ValueError, match="radius"):
        haloes.place_haloes(v, halos, *fx.SHELL, columns=("radius",))
    assert haloes.snapshot_haloes(halos, ["halo_index"], 70).count() == halos.where("snap = 70").count()
    drawn = [r["mass"] for r in haloes.drawn_order(halos).collect()]
    assert drawn == sorted(drawn) and min(drawn) > 0
    with pytest.raises(ValueError):
        haloes.around(halos.withColumns({"redshift": F.lit(0.1), "radius": F.lit(1.0)}), fx.outputs(spark), (5.0, 6.0), (1, 0, 0), 0.1, 0.0)


def test_masks_and_map_files(spark, tmp_path):
    halos = spark.createDataFrame([(10.0, 0.0, 0.0, 1e13, 2.0), (0.0, 0.0, 5.0, 1e13, 3.0), (0.0, 0.0, 0.0, 1e13, 9.0), (-7.0, 1e-9, 0.0, 2e12, 2.5)], "x double, y double, z double, m double, r double")
    p = tuple(F.col(a) for a in "xyz")
    covered = maps.aperture_masks(halos, 8, [1.0], [(12.0, 12.5), (12.5, 13.5)], p, F.col("m"), F.col("r"))
    pixels = hp.with_vectors(spark.range(hp.n_pixels(8)).toDF("pix"), "pix", 8).collect()
    inside = lambda hs: {q["pix"] for q in pixels for x, y, z, r in hs if (x * q["x"] + y * q["y"] + z * q["z"]) / (d := math.sqrt(x * x + y * y + z * z)) >= math.cos(math.atan(r / d))}
    got = covered.collect()
    assert {r["pix"] for r in got if r["log_mass_lo"] == 12.5} == inside([(10, 0, 0, 2), (0, 0, 5, 3)])
    assert {r["pix"] for r in got if r["log_mass_lo"] == 12.0} == inside([(-7, 1e-9, 0, 2.5)])
    maps.write_masks(covered, 8, str(tmp_path / "masks"))
    masks = spark.read.parquet(str(tmp_path / "masks"))
    assert masks.count() == 2 * hp.n_pixels(8) and masks.where("mask = 0").count() == len(got)
    values = spark.range(hp.n_pixels(8)).selectExpr("id pix", "id * 1.0D value")
    maps.write_map(values, "density", 8, str(tmp_path / "map"), {"seed": "3"}, (0.1, 0.2))
    assert spark.read.parquet(str(tmp_path / "map" / "density")).count() == 768
    assert {r["name"]: r["value"] for r in spark.read.parquet(str(tmp_path / "map" / "density_attributes")).collect()} == {"nside": "8", "ordering": "nested", "seed": "3", "z_min": "0.1", "z_max": "0.2"}
    maps.write_halos(halos.withColumn("halo_index", F.monotonically_increasing_id()).where("m > 0 and (x <> 0 or z <> 0)"), p, str(tmp_path / "halos"), {"lock": "none", "seed": "none"}, 8)
    assert maps.read_metadata(spark, str(tmp_path / "halos")) == {"lock": "none", "seed": None}


def test_maps_turn_and_sum(spark):
    nside = 8
    values = hp.with_vectors(spark.range(hp.n_pixels(nside)).toDF("pix"), "pix", nside).select("pix", (F.col("x") + 2 * F.col("z")).alias("value"))
    same = {r["pix"]: r["value"] for r in maps.rotated(values, nside, 0.0, math.pi / 2).collect()}
    turned = hp.with_vectors(values.select("pix"), "pix", nside).collect()
    # A quarter turn about z takes pixel centres to pixel centres: the value of x is then y's.
    assert all(same[r["pix"]] == pytest.approx(r["y"] + 2 * r["z"], abs=1e-9) for r in turned)
    assert maps.rotated(values, nside, 0.0, 0.0).count() == hp.n_pixels(nside)
    moved = maps.turned_positions(spark.createDataFrame([(1.0, 0.0, 0.0, 7), (0.0, 0.0, 0.0, 8)], "x double, y double, z double, id int"), ("x", "y", "z"), math.pi / 2, math.pi / 2).collect()
    assert [moved[0][a] for a in "xyz"] == pytest.approx([0, 0, -1]) and [moved[1][a] for a in "xyz"] == [0, 0, 0]
    shells = values.selectExpr("explode(array(0, 1, 2)) shell", "'a' map", "pix", "value")
    angles = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, math.pi / 2)], "shell int, theta double, phi double")
    assert [r["chunk"] for r in maps.angle_runs(angles).orderBy("shell").collect()] == [0, 0, 1]
    whole = {r["pix"]: r["value"] for r in maps.integrated(shells, angles, nside).collect()}
    plain = {r["pix"]: r["value"] for r in values.collect()}
    assert all(whole[p] == pytest.approx(2 * plain[p] + same[p], abs=1e-9) for p in plain)
    assert maps.integrated(shells, angles, nside, 1).count() == hp.n_pixels(nside) // 4


def test_smoothing_conserves_and_small_circles_stay(spark):
    rows = [(math.cos(t) * 3, math.sin(t) * 3, 3 * math.cos(3 * t), 0.4 if i % 2 else 1e-6, float(i)) for i, t in enumerate(np.linspace(0, 6, 40))] + [(0.0, 0.0, 1.0, 0.5, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, a double, v double")
    got = maps.smoothed(df, g.vector(), F.col("a"), F.col("v"), 8)
    total = got.agg(F.sum("value").alias("v"), F.sum("weight").alias("w")).first()
    assert total["v"] == pytest.approx(sum(r[4] for r in rows)) and total["w"] == pytest.approx(len(rows))
    assert maps.weighted_mean(got).where("value is null").isEmpty()
    assert maps.in_disc(spark, 8, (0, 0, 2), 0.3).count() == sum(1 for r in hp.with_vectors(spark.range(768).toDF("pix"), "pix", 8).collect() if r["z"] >= math.cos(0.3))


def test_zoom_and_shares(spark):
    values = spark.range(hp.n_pixels(16)).selectExpr("id pix", "id value")
    image = {(r["ix"], r["iy"]): r["value"] for r in maps.zoomed(values, 16, (0.3, -0.5, 0.2), 0.05, 5).collect()}
    middle = hp.with_pixel(spark.createDataFrame([(0.3, -0.5, 0.2)], "x double, y double, z double"), g.vector(), "p", 16).first()["p"]
    assert len(image) == 25 and image[2, 2] == middle
    assert maps.zoomed(values.where("false"), 16, (0, 0, 1), 0.1, 2).where("value is not null").isEmpty()
    parts = maps.pixel_shares(spark, 4, 5).orderBy("part").collect()
    assert [(r["first"], r["last"]) for r in parts] == [(0, 37), (38, 75), (76, 113), (114, 151), (152, 191)]
    assert all(a["theta_hi"] <= b["theta_lo"] + 1e-12 for a, b in zip(parts, parts[1:], strict=False))


def test_repeat_reports(spark, tmp_path):
    v = fx.view(spark, "sphere")
    report = repeats.check(v, 0.12, 0.16, 8, angle=0.1)
    totals = report.totals()
    assert totals["copies"] == report.copies.count() > 0 and str(totals["pairs"]) in report.summary()
    report.write(str(tmp_path / "r"))
    rows = {r["name"]: r["value"] for r in spark.read.parquet(str(tmp_path / "r" / "report")).collect()}
    assert rows["cells"] == "8" and rows["copies"] == str(totals["copies"]) and rows["lock"] == "sphere"
    cases = spark.createDataFrame([("b", 3, 1), ("a", 3, 1), ("c", 2, 9)], "case string, touching long, line_of_sight long")
    assert repeats.best_case(cases).first()["case"] == "c"
    missing, odd = repeats.missing_and_odd(spark.createDataFrame([(1,), (2,), (2,), (5,)], "id long"), spark.createDataFrame([(1,), (2,), (3,)], "id long"), ["id"])
    assert [r["id"] for r in missing.collect()] == [3] and sorted(map(tuple, odd.collect())) == [(2, 2), (5, 1)]
    blocks = particles.blocks_of_copies(report.copies, 100).orderBy("cell").collect()
    so_far = 0
    for r in blocks:
        assert r["block"] == so_far // 100
        so_far += r["copies"]


def test_diagrams(spark):
    points = spark.createDataFrame([(0.0, 0.0), (3.0, 0.5), (3.0, 3.0), (-1.0, 0.0)], "x double, z double")
    inside = [r[0] for r in points.select(plane.in_slice(F.col("x"), F.col("z"), 4.0, (1, 0, 0), 20.0)).collect()]
    assert inside == [True, True, False, False]
    one = spark.createDataFrame([(0.5, 1.5)], "x double, z double")
    at = lambda p: [pytest.approx(v, abs=1e-12) for v in one.select(*[c.alias(f"c{i}") for i, c in enumerate(p)]).first()]
    p = (F.col("x"), F.col("z"))
    assert at(plane.shifted(p, (3.75, -2.0), 4.0)) == [0.25, 3.5] and at(plane.transformed(p, (1, -1), 90.0, 2.0)) == [1.5, 0.5]
    assert at(plane.reoriented(p, (1, 0), (-1, 1), 180.0)) == [1.5, 2.5]
    objects = spark.createDataFrame([("a", 2.0, 2.0, 0.4), ("b", 0.5, 3.5, 0.4)], "label string, x double, z double, radius double")
    copies = plane.tiled(objects, None, 3)
    assert sorted((r["tile"], r["label"], r["x"], r["z"]) for r in copies.collect())[:2] == [(0, "a", 0.0, 0.0), (0, "b", -0.375, 0.375)]
    assert [(r["tile"], r["label"]) for r in plane.on_sight_line(copies).collect()] == [(1, "a"), (2, "a")]
    turned = plane.tiled(objects, [((0, 0), (1, 1), 0), ((2, 0), (1, -1), 90)], 2).where("tile = 1 and label = 'a'").first()
    assert (turned["x"], turned["z"]) == pytest.approx((0.5 + 0.5, -0.5))
    box = repeats.lattice_points(spark, 100.0, 25.0)
    placed = box.select("id", *[(F.col(a) - 50 + s).alias(a) for a, s in zip("xyz", (100, 0, -200), strict=True)])
    assert plane.wrong_positions(placed, box, 100.0).first()["wrong"] == 0
    assert plane.wrong_positions(placed.withColumn("x", F.when(F.col("id") < 3, F.col("x") + 1).otherwise(F.col("x"))), box, 100.0).first()["wrong"] == 3


def test_axes(spark):
    df = spark.createDataFrame([(1234.0,), (0.0,), (9.5,), (-123.0,)], "v double")
    v = F.col("v")
    assert [r[0] for r in df.select(axes.tens_below(v)).collect()] == [1230, 0, 0, -130]
    assert [r[0] for r in df.select(axes.two_digits_above(v)).collect()] == pytest.approx([1300.0, 0.0, 9.5, -120.0])
    assert df.where("v > 0").select(axes.magnitude(v)).first()[0] == 3 and [r[0] for r in df.select(axes.upright(v)).collect()] == [1054.0, 0.0, 9.5, 57.0]
    assert axes.small_spacing(100.0) == 20.0 and axes.small_spacing(30.0) == 5.0 and axes.small_spacing(7.0) == pytest.approx(7 / 3)
    assert axes.distance_ticks(0.0, 400.0) == ([0.0, 50.0, 100.0, 150.0, 200.0, 250.0, 300.0, 350.0, 400.0], [float(x) for x in range(0, 401, 10)])
    ticks, small = axes.angle_ticks(5.0, 2.0)
    assert ticks == [-4.0, -2.0, -0.0, 2.0, 4.0] and small[0] == pytest.approx(-small[-1])
    assert axes.angle_ticks(90.0, 5.0)[0][-1] % 10 == 0 and axes.angle_ticks(5.0, None) == (None, None)
    arc = axes.arc(spark, 2.0, 30.0, 3).orderBy("i").collect()
    assert [r["y"] for r in arc] == pytest.approx([-1.0, 0.0, 1.0]) and axes.arc(spark, 2.0, None, 5).count() == 5
    edge = axes.beam_outline(spark, (-1.0, 0.01, 0.2), 20.0, 91).orderBy("i").collect()
    u = g.unit((-1.0, 0.01, 0.2))
    for r in edge:
        d = (math.cos(r["lat"]) * math.cos(r["lon"]), math.cos(r["lat"]) * math.sin(r["lon"]), math.sin(r["lat"]))
        assert math.degrees(math.acos(sum(a * b for a, b in zip(u, d, strict=True)))) == pytest.approx(20.0)
    assert all(abs(a["lon"] - b["lon"]) < 1 for a, b in zip(edge, edge[1:], strict=False)) and edge[0]["lon"] == pytest.approx(edge[-1]["lon"])
    with pytest.raises(ValueError):
        axes.beam_outline(spark, (1, 0, 0), 180.0)
    assert axes.beam_label((1.0, 2.5, 3)) == "1_2.5_3"
    assert spark.createDataFrame([(r"\frac{M}{Mpc}",)], "u string").select(axes.one_line(F.col("u"))).first()[0] == "M/Mpc"
    assert [r[0] for r in axes.sorted_rows(spark.createDataFrame([(2,), (1,)], "v int")).collect()] == [1, 2]


def _lengths(p: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(np.square(p[:, None] - p[None]).sum(axis=2))
    return np.sort(d, axis=1)[:, k] / projection.GAMMA


def test_smoothing_lengths_in_groups_of_any_density(spark, monkeypatch):
    monkeypatch.setattr(projection, "GROUP", 150)
    monkeypatch.setattr(projection, "LEAF", 16)
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((700, 3)) * 1000, 500 + rng.normal(size=(500, 3)) * 1e-3, np.full((200, 3), 123.25), [[1e6, -1e6, 5.0]]])
    df = spark.createDataFrame([(i % 900, *map(float, q)) for i, q in enumerate(p)] + [(-1, None, 1.0, 2.0), (-2, float("nan"), 1.0, 2.0)], "id long, x double, y double, z double")
    rows = projection.smoothing_lengths(df, 250.0, k=7).collect()
    got = sorted((r["x"], r["y"], r["z"], r["h"]) for r in rows if r["id"] >= 0)
    assert len(rows) == len(p) + 2 and got == sorted((*map(float, q), float(h)) for q, h in zip(p, _lengths(p, 7), strict=True))
    assert all(r["h"] is None for r in rows if r["id"] < 0)
    with pytest.raises(ValueError):
        projection.smoothing_lengths(df.where("id < 0"), 250.0, k=1)


def test_smoothing_lengths_compare_few_pairs(monkeypatch):
    p = np.random.default_rng(6).random((20_000, 3)) * 250
    order, begins, lo, hi = projection._leaves(p, 128)
    q, pairs, partition = p[order], [], np.partition
    monkeypatch.setattr(np, "partition", lambda d, i, axis: (pairs.append(d.size), partition(d, i, axis=axis))[1])
    got = np.concatenate([projection._nearest(q[a:b], np.full(b - a, np.inf), q, begins, lo, hi, 33)[:, -1] for a, b in zip(begins[:-1], begins[1:], strict=True)])
    assert sum(pairs) < 20_000 * 20_000 / 8
    assert got[:50].tolist() == [np.sort(((q - x) ** 2).sum(axis=1))[32] for x in q[:50]]
