"""Readers of snapshots and halo catalogues in Parquet: scans by columns, row ranges, rows and predicates; units in metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INDEX, CHUNK = "halo_index", 1 << 22


def scan(spark: SparkSession, path: str, columns: list[str], snap: int | None = None) -> DataFrame:
    """Columns of a table partitioned by snap or not; ValueError names those that are not there."""
    df = spark.read.parquet(path)
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{', '.join(lacking)} not found")
    return (df if snap is None else df.where(F.col("snap") == snap)).select(*columns)


def available_snapshots(df: DataFrame) -> DataFrame:
    return df.select("snap").distinct()


def find_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """snap, name, path of files below a folder whose name matches a pattern with one group, the snapshot's number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.substring_index("path", "/", -1)
    snap = F.regexp_extract(name, pattern, 1)
    return files.select(snap.alias("s"), name.alias("name"), "path").where("s <> ''").select(F.col("s").cast("int").alias("snap"), "name", "path").orderBy("snap", "name", "path")


def rows(df: DataFrame, start: int = 0, stop: int | None = None, index: str = INDEX) -> DataFrame:
    """Rows start <= index < stop; the range reaches the scan as a pushed filter."""
    out = df.where(F.col(index) >= start)
    return out if stop is None else out.where(F.col(index) < stop)


def chunks(df: DataFrame, size: int = CHUNK, index: str = INDEX) -> Iterator[tuple[int, DataFrame]]:
    if size < 1:
        raise ValueError("a chunk has one row at least")
    top = df.agg(F.max(index)).first()[0]
    for start in range(0, -1 if top is None else top + 1, size):
        yield start, rows(df, start, start + size, index)


def selected_rows(df: DataFrame, wanted: DataFrame, index: str = INDEX) -> DataFrame:
    return df.join(wanted.select(index), index, "left_semi")


def check_ascending(wanted: list[int]) -> list[int]:
    if any(b <= a for a, b in zip(wanted[:-1], wanted[1:], strict=True)):
        raise ValueError("rows must ascend without repeats")
    return wanted


def where(df: DataFrame, predicate: Column | Callable[[pd.Series], pd.Series], on: str | None = None) -> DataFrame:
    """Rows that a Column predicate, or a function of a column's Arrow batches, holds for."""
    if isinstance(predicate, Column):
        return df.where(predicate)
    test = F.pandas_udf(predicate, "boolean")
    return df.where(test(F.col(on)))


def with_unit(df: DataFrame, column: str, unit: str, factor: float = 1.0) -> DataFrame:
    """The column times a factor, its unit kept in its metadata."""
    value = F.col(column) * factor if factor != 1.0 else F.col(column)
    return df.withColumn(column, value.alias(column, metadata={**df.schema[column].metadata, "unit": unit}))


def unit_of(schema: StructType, column: str) -> str | None:
    return schema[column].metadata.get("unit")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def all_columns(frames: list[DataFrame]) -> DataFrame:
    """Tables of several snapshots, whose columns may differ, as one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shell_edges(spark: SparkSession, path: str) -> DataFrame:
    """shell, z_in, z_out of a comma-separated file without a header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("shell", "line"))
    part = F.split("line", ",")
    return lines.select("shell", F.trim(part[0]).cast("double").alias("z_in"), F.trim(part[1]).cast("double").alias("z_out"))


def density_file(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(settings, rows) of a CSV whose first line is `# k=v; k=v`."""
    first = spark.read.text(path).first()["value"]
    settings = dict(p.strip().split("=", 1) for p in first.lstrip("# ").split(";") if "=" in p) if first.startswith("#") else {}
    return settings, spark.read.csv(path, header=True, inferSchema=True, comment="#")


def length(spark: SparkSession, path: str) -> int:
    """Rows of a catalogue, from the footers of its files: no column is read."""
    return spark.read.parquet(path).count()


def rotation_angles(spark: SparkSession, path: str) -> DataFrame:
    """shell, theta, phi in degrees, of a table that holds radians."""
    rows = scan(spark, path, ["shell", "theta", "phi"])
    return rows.select("shell", F.degrees("theta").alias("theta"), F.degrees("phi").alias("phi"))


def first_file(name: str, places: list[str | None]) -> str:
    """The first of the places (a file, or a folder that holds one of that name) that is there; FileNotFoundError names all."""
    tried = [str(p) for p in places if p]
    for p in tried:
        for found in (Path(p), Path(p) / name):
            if found.is_file():
                return str(found.resolve())
    raise FileNotFoundError(f"{name} is in none of {tried}")


def pixel_weights(nside: int, places: list[str | None]) -> str:
    """The folder, of those given, that holds full pixel weights of an nside."""
    name = f"healpix_full_weights_nside_{nside:04d}.fits"
    return str(Path(first_file(name, [f"{p}/full_weights" if p else None for p in places])).parent.parent)


def has_pixel_weights(places: list[str | None], nside: int | None = None) -> bool:
    folders = [Path(p) / "full_weights" for p in places if p]
    wanted = "*.fits" if nside is None else f"healpix_full_weights_nside_{nside:04d}.fits"
    return any(f.is_dir() and (nside is None or any(f.glob(wanted))) for f in folders)
