"""Text tables on the driver (a few thousand rows at most): output lists, YAML tables, orientation tables, suites."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from skyloom.operators.orientation import NAMES, Table

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_FIELD = re.compile(r"\{([a-z_]*)(?::[^}]*)?\}")
ORIENTATION_COLUMNS = tuple(f"{n}_{a}" for n in NAMES for a in "xyz")
UNIT = "eighths"


def parse_outputs(text: str) -> list[float]:
    """Redshifts of an output list: a header that names its first column, then rows of it; later columns and comments are left out."""
    lines = [x.strip() for x in text.splitlines()]
    head = next((x for x in lines if x.startswith("#")), "")
    first = head.lstrip("# ").split(",")[0].strip().lower()
    if first not in ("redshift", "scale factor"):
        raise ValueError("an output list's header names Redshift or Scale Factor first")
    values = [float(re.split(r"[,\s]+", x)[0]) for x in lines if x and not x.startswith("#")]
    z = [1 / v - 1 for v in values] if first == "scale factor" else values
    if len(z) < 2 or any(b >= a for a, b in zip(z[:-1], z[1:], strict=True)):
        raise ValueError("output redshifts must be two at least and strictly decrease")
    return z


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """snap, z of an output list file; it is read by Spark, so any store will do."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(list(enumerate(parse_outputs(text))), "snap int, z double")


def outputs_text(redshifts: Iterable[float], select: str | None = None) -> str:
    """An output list, with a second column if asked for."""
    head = "# Redshift" + (", Select Output" if select else "")
    return "\n".join([head, *(f"{z!r}" + (f", {select}" if select else "") for z in redshifts)]) + "\n"


def table_text(header: dict, columns: list[str], rows: list[list[float]], comment: str | None = None) -> str:
    """A YAML table, a row to a line; header names are identifiers and values finite."""
    if any(not _NAME.fullmatch(k) for k in header):
        raise ValueError("header names must be identifiers")
    if any(not math.isfinite(v) for r in rows for v in r):
        raise ValueError("values must be finite")
    cells = [[repr(v) for v in r] for r in rows]
    wide = [max((len(r[i]) for r in cells), default=0) for i in range(len(columns))]
    lines = [f"# {x}" for x in (comment or "").splitlines()]
    lines += [yaml.safe_dump({k: v}).strip() for k, v in header.items()]
    lines += [f"columns: [{', '.join(columns)}]", "rows:"]
    return "\n".join([*lines, *("- [" + ", ".join(v.rjust(w) for v, w in zip(r, wide, strict=True)) + "]" for r in cells)]) + "\n"


def parse_table(text: str, columns: list[str], kind: str = "a table") -> tuple[dict, list[list[float]]]:
    """(header, rows) of a YAML table with the given columns."""
    found = yaml.safe_load(text)
    if not isinstance(found, dict) or list(found.get("columns", [])) != list(columns):
        raise ValueError(f"{kind} needs the columns {', '.join(columns)}")
    rows = found.get("rows") or []
    if any(not isinstance(r, list) or len(r) != len(columns) or not all(isinstance(v, (int, float)) for v in r) for r in rows):
        raise ValueError(f"rows of {kind} are {len(columns)} numbers each")
    return {k: v for k, v in found.items() if k not in ("columns", "rows")}, rows


def orientation_text(table: Table, attributes: dict | None = None) -> str:
    rows = [[int(v) for p in table.parts for v in p[i]] for i in range(len(table))]
    return table_text({"cell_shift_unit": UNIT, "fingerprint": table.fingerprint(), **(attributes or {})}, list(ORIENTATION_COLUMNS), rows)


def parse_orientations(text: str) -> Table:
    """A table whose unit and fingerprint are as its file says."""
    header, rows = parse_table(text, list(ORIENTATION_COLUMNS), "an orientation table")
    if header.get("cell_shift_unit") != UNIT:
        raise ValueError(f"shifts must be in {UNIT}")
    table = Table.of([(r[0:3], r[3:6], r[6:9]) for r in rows])
    if header.get("fingerprint", table.fingerprint()) != table.fingerprint():
        raise ValueError("the table is not the one of its fingerprint")
    return table


@dataclass(frozen=True)
class Suite:
    """Where a family of simulations keeps its files. Path formats hold {label}, {name} and {snap}."""

    name: str
    label_pattern: str
    snapshots: str
    halos: str = ""
    outputs: str = ""
    attributes: dict = field(default_factory=dict)

    def __post_init__(self):
        for part, needed in (("snapshots", {"snap"}), ("halos", {"snap"}), ("outputs", set())):
            got = set(_FIELD.findall(getattr(self, part)))
            if got - {"label", "name", "snap"}:
                raise ValueError(f"{part} of {self.name} has unknown fields {sorted(got)}")
            if getattr(self, part) and needed - got:
                raise ValueError(f"{part} of {self.name} lacks {sorted(needed - got)}")

    def recognises(self, label: str) -> bool:
        return re.fullmatch(self.label_pattern, label) is not None


class Catalog:
    """Suites by name, those of later directories replacing earlier ones."""

    def __init__(self, suites: Iterable[Suite] = ()):
        self.suites: dict[str, Suite] = {}
        for s in suites:
            self.add(s)

    @classmethod
    def load(cls, directories: list[str]) -> Catalog:
        out = cls()
        for d in directories:
            seen: set[str] = set()
            for path in sorted(Path(d).glob("*.yaml")):
                suite = parse_suite(path.read_text())
                if suite.name.lower() in seen:
                    raise ValueError(f"{d} has two suites named {suite.name}")
                seen.add(suite.name.lower())
                out.add(suite)
        return out

    def add(self, suite: Suite) -> None:
        self.suites[suite.name.lower()] = suite

    def get(self, name: str) -> Suite:
        if name.lower() not in self.suites:
            raise ValueError(f"no suite {name!r}; there are {sorted(self.suites)}")
        return self.suites[name.lower()]

    def for_label(self, label: str | None = None, name: str | None = None) -> Suite:
        """The one suite of a label, a name or both."""
        found = [s for s in self.suites.values() if label is None or s.recognises(label)]
        if name is not None:
            if self.get(name) not in found:
                raise ValueError(f"suite {name!r} does not know the label {label!r}")
            return self.get(name)
        if label is None or len(found) != 1:
            raise ValueError(f"{len(found)} suites know the label {label!r}")
        return found[0]


def parse_suite(text: str) -> Suite:
    found = yaml.safe_load(text)
    allowed = {"name", "label_pattern", "snapshots", "halos", "outputs", "attributes"}
    if not isinstance(found, dict) or set(found) - allowed or {"name", "label_pattern", "snapshots"} - set(found):
        raise ValueError("a suite has name, label_pattern and snapshots, and may have halos, outputs and attributes")
    return Suite(**found)


def suite_text(suite: Suite) -> str:
    keys = ("name", "label_pattern", "snapshots", "halos", "outputs", "attributes")
    return yaml.safe_dump({k: getattr(suite, k) for k in keys if getattr(suite, k)}, sort_keys=False)


def box_label(path: str) -> str:
    """The one distinct label L<digits>N<digits> of a path."""
    found = set(re.findall(r"L\d+N\d+", path))
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} box labels")
    return found.pop()


def simulation_directory(path: str) -> str:
    """The path up to the element after the label."""
    parts, label = path.split("/"), box_label(path)
    at = next(i for i, p in enumerate(parts) if label in p)
    if at + 1 >= len(parts):
        raise ValueError(f"{path} ends at its label")
    return "/".join(parts[: at + 2])
