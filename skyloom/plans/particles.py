"""Views of several kinds of points: one frame with a kind column, what was read and kept, and placement file by file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import lattice
from skyloom.plans.views import View

KIND = "ptype"


def _listed(kinds: dict[str, DataFrame], wanted: str | list[str] | None) -> list[str]:
    names = list(kinds) if wanted is None else [wanted] if isinstance(wanted, str) else list(dict.fromkeys(wanted))
    lacking = [k for k in names if k not in kinds]
    if lacking or not names:
        raise ValueError(f"no points of the kinds {', '.join(lacking)}" if lacking else "name a kind of points at least")
    return names


def place_kinds(view: View, kinds: dict[str, DataFrame], z_min: float, z_max: float, columns: list[str], wanted: str | list[str] | None = None, use: list[int] | None = None, cells: int | None = None) -> DataFrame:
    """Points of each kind wanted (all, if None) in a shell, in one frame: ptype, snap, id, the columns asked for (null where a kind
    lacks one that another has), x, y, z, tile, redshift and expansion_factor. ValueError names a kind that is not there, and
    columns that no kind has. The pieces are made once for all kinds."""
    if columns is None:
        raise TypeError("name the columns to place; x, y and z come along")
    names = _listed(kinds, wanted)
    asked = [c for c in dict.fromkeys(columns) if c not in ("x", "y", "z", "snap", "id")]
    lacking = [c for c in asked if not any(c in kinds[k].columns for k in names)]
    if lacking:
        raise ValueError(f"{', '.join(lacking)} not found")
    pieces = view.pieces(z_min, z_max, use)

    def one(kind: str) -> DataFrame:
        own = kinds[kind]
        held = [c for c in asked if c in own.columns]
        velocity = ("vx", "vy", "vz") if {"vx", "vy", "vz"} <= set(held) else None
        placed = view.place(own.select("snap", "id", *held, "x", "y", "z", *(["cell"] if cells else [])), pieces, velocity=velocity, cells=cells)
        return view.with_expansion(placed).withColumn(KIND, F.lit(kind))

    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(k) for k in names])
    return whole.select(KIND, "snap", "id", *asked, "x", "y", "z", *lattice.TILE, "redshift", "expansion_factor")


def read_summary(kinds: dict[str, DataFrame], pieces: DataFrame, wanted: str | list[str] | None = None) -> DataFrame:
    """ptype, snaps (ascending), n_rows: the snapshots that a shell's pieces name and the rows that they hold of each kind."""
    snaps = pieces.select("snap").distinct()
    parts = [kinds[k].join(snaps, "snap", "left_semi").groupBy("snap").agg(F.count("*").alias("n")).withColumn(KIND, F.lit(k)) for k in _listed(kinds, wanted)]
    return reduce(DataFrame.unionByName, parts).groupBy(KIND).agg(F.sort_array(F.collect_set("snap")).alias("snaps"), F.sum("n").alias("n_rows"))


def read_and_kept(view: View, points: DataFrame, pieces: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """snap, n_read (rows of cells near a piece, once for each piece), n_kept (rows placed) and percent, of each snapshot read."""
    read = view.cells_in_pieces(pieces, cells, n).groupBy("snap").agg(F.sum("cnt").alias("n_read"))
    kept = view.place(points, pieces).groupBy("snap").agg(F.count("*").alias("n_kept"))
    both = read.join(kept, "snap", "left").select("snap", "n_read", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
    return both.withColumn("percent", F.when(F.col("n_read") > 0, 100.0 * F.col("n_kept") / F.col("n_read")).otherwise(0.0))


def distinct_files(plan: DataFrame) -> DataFrame:
    """snap, file, n_rows: each file that a plan (View.file_plan) reads, once."""
    return plan.groupBy("snap", "file").agg(F.sum("n_rows").alias("n_rows"))


def place_file(view: View, points: DataFrame, pieces: DataFrame, plan: DataFrame, snap: int, file: int) -> DataFrame:
    """The rows of one file (points: snap, file, file_row in it, and the rest) placed as the plan says: its row ranges of each piece only.
    Over all files of a plan, this is place(). A file that the plan does not hold gives no rows."""
    ranges = plan.where((F.col("snap") == snap) & (F.col("file") == file)).select("snap", *lattice.TILE, F.coalesce("layer", F.lit(-1)).alias("at_layer"), F.explode("ranges").alias("r"))
    own = points.where((F.col("snap") == snap) & (F.col("file") == file))
    rows = ranges.select(*[F.col(t).alias(f"of_{t}") for t in lattice.TILE], "at_layer", "r.first", "r.cnt")
    # A file's ranges are at most its cells for each piece: a short list beside its rows.
    read = own.join(F.broadcast(rows), (F.col("file_row") >= F.col("first")) & (F.col("file_row") < F.col("first") + F.col("cnt")))
    tiles = [F.col(t) == F.col(f"of_{t}") for t in lattice.TILE]
    placed = view.place(read, pieces)
    same = reduce(lambda a, b: a & b, [*tiles, F.coalesce("layer", F.lit(-1)) == F.col("at_layer")])
    return placed.where(same).drop(*[f"of_{t}" for t in lattice.TILE], "at_layer", "first", "cnt")


def blocks_of_copies(copies: DataFrame, each: int) -> DataFrame:
    """cell, copies, block: cells in order, cut where the copies so far pass a multiple of `each`. A row for each cell of the grid."""
    from pyspark.sql import Window

    counts = copies.groupBy("cell").agg(F.count("*").alias("copies"))
    so_far = F.sum("copies").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("block", F.floor(F.coalesce(so_far, F.lit(0)) / each).cast("int"))
