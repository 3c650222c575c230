"""One simulation of a suite: where its files are, and its snapshots by number and redshift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skyloom.sources.tables import Catalog, Suite, box_label

#: How near a redshift must be to an output's to be taken for it.
SAME = 1e-6


@dataclass(frozen=True)
class Simulation:
    """redshifts: of each output, by snapshot number."""

    suite: Suite
    label: str
    name: str
    directory: str
    redshifts: tuple[float, ...]

    @classmethod
    def at(cls, path: str, catalog: Catalog, redshifts: list[float], suite: str | None = None) -> Simulation:
        """The simulation in a directory .../<label>/<name>; its suite by the label, or by a suite's name that the path holds."""
        parts = path.rstrip("/").split("/")
        label = box_label(path)
        if suite is None:
            named = [n for n in catalog.suites if n in [p.lower() for p in parts]]
            suite = named[0] if len(named) == 1 else None
        return cls(catalog.for_label(label, suite), label, parts[-1], "/".join(parts), tuple(redshifts))

    def _path(self, form: str, snap: int | None = None) -> str:
        found = form.format(label=self.label, name=self.name, **({} if snap is None else {"snap": snap}))
        return found if found.startswith("/") else f"{self.directory}/{found}"

    def snapshot_path(self, snap: int) -> str:
        return self._path(self.suite.snapshots, snap)

    def halo_path(self, snap: int) -> str:
        return self._path(self.suite.halos, snap)

    def outputs(self, spark: SparkSession) -> DataFrame:
        """snap, z of every output."""
        return spark.createDataFrame([(i, float(z)) for i, z in enumerate(self.redshifts)], "snap int, z double")

    def snapshot_redshift(self, snap: int | list[int]) -> float | list[float]:
        """IndexError for a snapshot that there is not (numbers do not count from the end)."""
        if not isinstance(snap, int):
            return [self.snapshot_redshift(s) for s in snap]  # type: ignore[misc]
        if not 0 <= snap < len(self.redshifts):
            raise IndexError(f"{self.name} has snapshots 0 to {len(self.redshifts) - 1}, not {snap}")
        return self.redshifts[snap]

    def snapshot_number(self, redshift: float) -> int:
        """The snapshot of an output redshift; ValueError if there is none within SAME."""
        best = min(range(len(self.redshifts)), key=lambda i: abs(self.redshifts[i] - redshift))
        if abs(self.redshifts[best] - redshift) > SAME:
            raise ValueError(f"{self.name} has no output at redshift {redshift}; the nearest is at {self.redshifts[best]}")
        return best


def suite_or_none(catalog: Catalog, label: str) -> Suite | None:
    """The one suite that knows a label, None if none does or several do."""
    known = [s for s in catalog.suites.values() if s.recognises(label)]
    return known[0] if len(known) == 1 else None
