"""How many tasks a session may run at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

LIMIT, DEFAULT, ALL = "spark.skyloom.maxCores", 30, "all"


def _checked(value: str | int | None) -> int | None:
    """A whole number of one at least, or None for all."""
    if value is None or str(value).strip().lower() == ALL:
        return None
    text = str(value).strip()
    if isinstance(value, bool) or not text.isdigit() or int(text) < 1:
        raise ValueError(f"cores are a whole number of one at least, or {ALL!r}, not {value!r}")
    return int(text)


def set_limit(spark: SparkSession, cores: str | int | None) -> None:
    spark.conf.set(LIMIT, str(_checked(cores) or ALL))


def limit(spark: SparkSession) -> int | None:
    """The limit that is set, DEFAULT if none is, None for all."""
    return _checked(spark.conf.get(LIMIT, str(DEFAULT)))


def available(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def usable(spark: SparkSession) -> int:
    """What is available, up to the limit."""
    most = limit(spark)
    return available(spark) if most is None else max(1, min(most, available(spark)))
