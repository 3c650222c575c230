"""Readers, writers and lookups, each against what was written or a plain version."""

import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import cores, units
from skyloom.functions.cosmology import Cosmology, equal_volume_edges, neutrino_masses
from skyloom.operators import orientation
from skyloom.sources import catalogue, tables
from skyloom.sources.simulation import Simulation, suite_or_none


def test_output_lists(spark, tmp_path):
    z = [3.0, 1.5, 0.25, 0.0]
    (tmp_path / "out.txt").write_text(tables.outputs_text(z, "Snapshot"))
    assert [tuple(r) for r in tables.read_outputs(spark, str(tmp_path / "out.txt")).orderBy("snap").collect()] == list(enumerate(z))
    assert tables.parse_outputs("# Scale Factor\n0.25\n0.5 # half\n1.0\n") == [3.0, 1.0, 0.0]
    for bad in ("# Time\n1\n2\n", "# Redshift\n1\n", "# Redshift\n1\n1\n"):
        with pytest.raises(ValueError):
            tables.parse_outputs(bad)


def test_tables_and_orientations():
    text = tables.table_text({"kind": "x", "n": 3}, ["a", "b"], [[1, 2.5], [-3, 4]], "two\nlines")
    assert tables.parse_table(text, ["a", "b"]) == ({"kind": "x", "n": 3}, [[1, 2.5], [-3, 4]])
    for bad in (lambda: tables.table_text({"1x": 1}, ["a"], []), lambda: tables.table_text({}, ["a"], [[math.inf]]), lambda: tables.parse_table(text, ["a"]), lambda: tables.parse_table("columns: [a]\nrows: [[x]]", ["a"])):
        with pytest.raises(ValueError):
            bad()
    table = orientation.generate(seed=4, rows=60)
    again = tables.parse_orientations(tables.orientation_text(table))
    assert again.fingerprint() == table.fingerprint() and len(again) == 60
    with pytest.raises(ValueError, match="fingerprint"):
        tables.parse_orientations(tables.orientation_text(table).replace(table.fingerprint(), "0" * 16))


def test_orientations_are_distinct_and_seeded():
    turns, signs = orientation.kinds()
    matrices = {orientation.quarter_matrix(t, s).tobytes() for t, s in zip(turns, signs, strict=True)}
    assert len(turns) == len(matrices) == 48 and turns[0].tolist() == [0, 0, 0] and signs[0].tolist() == [1, 1, 1]
    table = orientation.generate(seed=2, shifts=(0, 2, -2))
    rows = {(orientation.quarter_matrix(t, r).tobytes(), s.tobytes()) for t, r, s in zip(*table.parts, strict=True)}
    assert len(table) == len(rows) == 48 * 27
    assert [p[0].tolist() for p in table.parts] == [[0, 0, 0], [1, 1, 1], [0, 0, 0]]
    assert orientation.generate(2, 10, (0, 2, -2)).fingerprint() == table[slice(10)].fingerprint() != orientation.generate(3, 10, (0, 2, -2)).fingerprint()
    for bad in (dict(shifts=(1, 2)), dict(shifts=(0, 0)), dict(rows=0), dict(rows=48 * 512 + 1)):
        with pytest.raises(ValueError):
            orientation.generate(**bad)


def test_suites_and_simulations(spark, tmp_path):
    text = "name: Sim\nlabel_pattern: L\\d+N\\d+\nsnapshots: 'snaps/{snap:04d}.parquet'\nhalos: '/halos/{label}/{name}_{snap}'\nattributes: {h: 0.7}\n"
    (tmp_path / "a.yaml").write_text(text)
    (tmp_path / "b.yaml").write_text(text.replace("Sim", "Other").replace("L\\d+N\\d+", "L9\\d+N\\d+"))
    known = tables.Catalog.load([str(tmp_path)])
    assert tables.parse_suite(tables.suite_text(known.get("SIM"))) == known.get("sim")
    assert suite_or_none(known, "L1N2").name == "Sim" and suite_or_none(known, "L91N2") is None is suite_or_none(known, "x")
    s = Simulation.at("/data/other/L91N2/RUN/", known, [3.0, 1.0, 0.0])
    assert (s.suite.name, s.label, s.name) == ("Other", "L91N2", "RUN")
    assert s.snapshot_path(7) == "/data/other/L91N2/RUN/snaps/0007.parquet" and s.halo_path(7) == "/halos/L91N2/RUN_7"
    assert s.snapshot_redshift(1) == 1.0 and s.snapshot_redshift([0, 2]) == [3.0, 0.0] and s.snapshot_number(1.0 + 1e-8) == 1
    assert [tuple(r) for r in s.outputs(spark).collect()] == [(0, 3.0), (1, 1.0), (2, 0.0)]
    for bad, error in ((lambda: s.snapshot_redshift(-1), IndexError), (lambda: s.snapshot_number(0.5), ValueError), (lambda: Simulation.at("/data/L91N2/RUN", known, [1.0]), ValueError), (lambda: known.get("none"), ValueError), (lambda: tables.parse_suite("name: x"), ValueError), (lambda: tables.box_label("/a/b"), ValueError)):
        with pytest.raises(error):
            bad()
    assert tables.simulation_directory("/x/L1N2/RUN/snaps/1") == "/x/L1N2/RUN"


def test_catalogues(spark, tmp_path):
    df = spark.range(25).selectExpr("cast(id % 2 as int) snap", "id halo_index", "cast(id as double) mass")
    df.write.parquet(path := str(tmp_path / "h"))
    assert catalogue.length(spark, path) == 25 and catalogue.scan(spark, path, ["mass"], 1).count() == 12
    with pytest.raises(ValueError, match="size"):
        catalogue.scan(spark, path, ["mass", "size"])
    parts = [(start, part.count()) for start, part in catalogue.chunks(spark.read.parquet(path), 10)]
    assert parts == [(0, 10), (10, 10), (20, 5)] and list(catalogue.chunks(df.where("false"), 10)) == []
    assert catalogue.check_ascending([1, 2, 9]) == [1, 2, 9]
    for bad in (lambda: catalogue.check_ascending([1, 1]), lambda: list(catalogue.chunks(df, 0))):
        with pytest.raises(ValueError):
            bad()
    told = catalogue.with_unit(df, "mass", "Msun", 2.0)
    assert catalogue.unit_of(told.schema, "mass") == "Msun" and told.agg(F.max("mass")).first()[0] == 48.0
    assert catalogue.unit_of(df.schema, "mass") is None
    assert catalogue.renamed(df, {"mass": "m", "none": "n"}).columns == ["snap", "halo_index", "m"]
    both = catalogue.all_columns([df, df.drop("mass").withColumn("extra", F.lit(1))])
    assert both.columns == ["snap", "halo_index", "mass", "extra"] and both.where("mass is null").count() == 25
    names = [r["name"] for r in catalogue.find_files(spark, path, r"part-(\d+)-.*\.parquet").collect()]
    assert names and all(n.endswith(".parquet") for n in names)


def test_small_files(spark, tmp_path):
    (tmp_path / "shells.txt").write_text("0.0, 0.05\n\n0.05,0.1\n")
    assert sorted(map(tuple, catalogue.shell_edges(spark, str(tmp_path / "shells.txt")).collect())) == [(0, 0.0, 0.05), (1, 0.05, 0.1)]
    spark.createDataFrame([(0, math.pi, math.pi / 2)], "shell int, theta double, phi double").write.parquet(str(tmp_path / "angles"))
    assert [tuple(r) for r in catalogue.rotation_angles(spark, str(tmp_path / "angles")).collect()] == [(0, 180.0, 90.0)]
    (tmp_path / "w" / "full_weights").mkdir(parents=True)
    (tmp_path / "w" / "full_weights" / "healpix_full_weights_nside_0032.fits").write_text("")
    places = [None, str(tmp_path / "none"), str(tmp_path / "w")]
    assert catalogue.pixel_weights(32, places) == str((tmp_path / "w").resolve())
    assert catalogue.has_pixel_weights(places) and catalogue.has_pixel_weights(places, 32) and not catalogue.has_pixel_weights(places, 64) and not catalogue.has_pixel_weights([None])
    with pytest.raises(FileNotFoundError):
        catalogue.pixel_weights(64, places)
    assert catalogue.first_file("shells.txt", [None, str(tmp_path)]) == str((tmp_path / "shells.txt").resolve())


def test_units():
    speed = units.named("Mpc/s") * units.named("km**-1")
    assert speed.factor_to(units.named("s**-1")) == pytest.approx(3.0856775814913673e19)
    with pytest.raises(ValueError):
        units.named("Mpc").factor_to(units.named("s"))
    with pytest.raises(ValueError):
        units.named("furlong")
    cgs = {"L": 3.0e24, "M": 2.0e43, "t": 3.0e19}
    density = units.from_attributes({"U_M": 1, "U_L": -3, "a-scale": -3}, cgs)
    assert density.cgs == pytest.approx(2.0e43 / 2.7e73) and density.a == -3 and density.comoving().a == 0
    assert units.to_attributes(density) == {"U_I": 0.0, "U_L": -3.0, "U_M": 1.0, "U_T": 0.0, "U_t": 0.0, "a-scale": -3.0, "h-scale": 0.0}
    groups = {"PhysicalConstants/CGS": {"c": [3e10]}, "Cosmology": {"h": [0.7]}, "Units": {"Unit length in cgs (U_L)": [3e24]}, "InternalCodeUnits": {"Unit length in cgs (U_L)": [1.0]}}
    held = units.snapshot_metadata(groups)
    assert held["cosmology"] == {"h": 0.7} and units.base_factors(held) == {"L": 3e24} and units.base_factors(held, "InternalCodeUnits") == {"L": 1.0}
    with pytest.raises(KeyError):
        units.snapshot_metadata({})
    assert units.plain_attributes({"a": b"x", "b": [2], "c": [1, 2]}) == {"a": "x", "b": 2, "c": [1, 2]}
    told = {units.PHYSICAL_CGS: [8.0], units.EXPONENT: [3.0]}
    assert units.with_comoving_factor(told, 0.5)[units.COMOVING_CGS] == 64.0
    assert units.with_comoving_factor({units.COMOVING_CGS: [5.0]}, 0.5) == {units.COMOVING_CGS: [5.0]}


def test_neutrinos_and_volumes():
    assert neutrino_masses() == [0.0] * 3 and neutrino_masses(3.044, 2.0308, [0.06], [1]) == [0.06, 0.0, 0.0]
    for bad in (dict(n_eff=3.04, n_ur=3.04, masses=[0.06], degeneracies=[1]), dict(n_eff=3.04, n_ur=1.0, masses=[0.06], degeneracies=[1.5]), dict(masses=[1.0, 2.0], degeneracies=[1.0])):
        with pytest.raises(ValueError):
            neutrino_masses(**bad)
    c = Cosmology(h=0.68, omega_m=0.3)
    edges = equal_volume_edges(100.0, 400.0, 5)
    shells = [b**3 - a**3 for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert edges[0] == 100.0 and edges[-1] == pytest.approx(400.0) and shells == pytest.approx([shells[0]] * 5)
    assert c.volume(0.0, 10.0) == pytest.approx(4 / 3 * math.pi * 1000) and c.volume(0.0, 10.0, half_angle=math.pi / 2) == pytest.approx(2 / 3 * math.pi * 1000)
    parts = c.subshells((0.1, 0.3), 4)
    assert parts[0][0] == pytest.approx(0.1) and parts[-1][1] == pytest.approx(0.3) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_cores(spark):
    assert cores.limit(spark) == cores.DEFAULT and cores.usable(spark) == min(30, cores.available(spark))
    cores.set_limit(spark, 2)
    assert cores.usable(spark) == min(2, cores.available(spark))
    cores.set_limit(spark, "all")
    assert cores.limit(spark) is None and cores.usable(spark) == cores.available(spark)
    for bad in (0, "x", -1, True):
        with pytest.raises(ValueError):
            cores.set_limit(spark, bad)
    spark.conf.unset(cores.LIMIT)
