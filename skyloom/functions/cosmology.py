"""Distances, redshifts and volumes of a w0-wa cosmology, on the driver, and their use on columns.

The line-of-sight comoving distance is c/H0 times the integral of 1/E, by Gauss-Legendre quadrature over short steps. Massive
neutrinos follow the published fit of Komatsu et al. (2011), equation 26. Redshift at a distance is a not-a-knot cubic
spline through a table; on columns it is evaluated in Arrow batches by binary search, or as a linear table join in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIGHT_KM_S, MPC_KM, GYR_S = 299792.458, 3.0856775814913673e19, 3.15576e16
#: Photon density times h^2 for a temperature of 1 K, to the fourth power; neutrino temperature to photon temperature;
#: exponent and factor of the fit. Fixed values.
PHOTONS, NEUTRINO_T, FIT_P, FIT_K, KB_EV = 4.48149e-7, 0.7137658555036082, 1.83, 0.3173, 8.617333262e-5
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def neutrino_masses(n_eff: float = 3.04, n_ur: float | None = None, masses: float | list[float] = 0.0, degeneracies: float | list[float] = 0.0) -> list[float]:
    """One mass (eV) for each species: each massive one as often as its degeneracy, then floor(n_ur) massless ones (n_eff, if None).
    ValueError if a degeneracy is not whole, or if species do not add up to floor(n_eff)."""
    many = lambda x: list(x) if isinstance(x, (list, tuple)) else [x]
    masses, degeneracies = many(masses), many(degeneracies)
    if len(masses) != len(degeneracies):
        raise ValueError("a degeneracy is needed for each mass")
    if any(d != round(d) for d in degeneracies):
        raise ValueError(f"degeneracies must be whole numbers, not {degeneracies}")
    massless, massive = int(n_eff if n_ur is None else n_ur), int(sum(degeneracies))
    if massive + massless != int(n_eff):
        raise ValueError(f"{massive} massive and {massless} massless species do not add up to N_eff = {n_eff}")
    return [float(m) for m, d in zip(masses, degeneracies, strict=True) for _ in range(int(d))] + [0.0] * massless


@dataclass(frozen=True)
class Cosmology:
    h: float = 0.681
    omega_m: float = 0.306
    omega_lambda: float | None = None
    w0: float = -1.0
    wa: float = 0.0
    t_cmb: float = 0.0
    n_eff: float = 0.0
    masses: tuple[float, ...] = ()
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    def radiation(self, z: np.ndarray) -> np.ndarray:
        """Photons and neutrinos today's density times their growth beyond (1+z)^4."""
        photons = PHOTONS * self.t_cmb**4 / self.h**2
        if not photons:
            return np.zeros_like(z)
        per = self.n_eff / max(1, len(self.masses)) if self.masses else self.n_eff
        kinds = self.masses or (0.0,)
        grown = np.zeros_like(z)
        for m in kinds:
            y = m / (KB_EV * NEUTRINO_T * self.t_cmb * (1 + z))
            grown += (1 + (FIT_K * y) ** FIT_P) ** (1 / FIT_P)
        return photons * (1 + 7 / 8 * (4 / 11) ** (4 / 3) * per * grown)

    def e2(self, z: np.ndarray) -> np.ndarray:
        z = np.asarray(z, float)
        r0 = float(self.radiation(np.zeros(1))[0])
        dark = 1 - self.omega_m - r0 if self.omega_lambda is None else self.omega_lambda
        curved = 1 - self.omega_m - r0 - dark
        a = 1 + z
        return self.omega_m * a**3 + curved * a**2 + self.radiation(z) * a**4 + dark * a ** (3 * (1 + self.w0 + self.wa)) * np.exp(-3 * self.wa * z / a)

    def _integral(self, z, f) -> np.ndarray:
        z = np.atleast_1d(np.asarray(z, float))
        steps = max(8, math.ceil(float(np.max(np.abs(z), initial=0.0)) * 32))
        edges = z[:, None] * np.linspace(0, 1, steps + 1)
        half = (edges[:, 1:] - edges[:, :-1]) / 2
        at = (edges[:, 1:] + edges[:, :-1])[..., None] / 2 + half[..., None] * _NODES
        return (f(at) * _WEIGHTS * half[..., None]).sum(axis=(1, 2))

    def distance(self, z):
        """Comoving distance in Mpc."""
        out = LIGHT_KM_S / (100 * self.h) * self._integral(z, lambda x: 1 / np.sqrt(self.e2(x)))
        return float(out[0]) if np.ndim(z) == 0 else out

    def lookback_gyr(self, z):
        out = MPC_KM / (100 * self.h) / GYR_S * self._integral(z, lambda x: 1 / ((1 + x) * np.sqrt(self.e2(x))))
        return float(out[0]) if np.ndim(z) == 0 else out

    def redshift_earlier(self, z: float, gyr: float) -> float:
        """The redshift a time before z."""
        goal, lo, hi = self.lookback_gyr(z) + gyr, -0.5, max(2.0 * z + 1, 1.0)
        while self.lookback_gyr(hi) < goal:
            hi = 2 * hi + 1
            if hi > 1e6:
                raise ValueError("no such time")
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.lookback_gyr(mid) < goal else (lo, mid)
        return (lo + hi) / 2

    def table(self, z_min: float = 0.0005, z_max: float = 5.01, points: int = 3000, method: str = "fast") -> Spline:
        """Redshift as a function of distance, on a grid even in redshift ("fast") or in distance ("precise")."""
        if method not in ("fast", "precise"):
            raise ValueError(f"unknown method {method!r}")
        key = (z_min, z_max, points, method)
        if key not in self.cache:
            z = np.linspace(z_min, z_max, points)
            r = self.distance(z)
            if method == "precise":
                even = np.linspace(r[0], r[-1], points)
                near = Spline.through(r, z)(even)
                for _ in range(4):
                    near = near - (self.distance(near) - even) * np.sqrt(self.e2(near)) * 100 * self.h / LIGHT_KM_S
                r, z = even, near
            self.cache[key] = Spline.through(r, z)
        return self.cache[key]

    def redshift(self, r):
        out = self.table()(np.asarray(r, float))
        return float(out) if np.ndim(r) == 0 else out

    def volume(self, inner: float, outer: float, redshifts: bool = False, half_angle: float | None = None) -> float:
        """Of a shell, or of its part inside a cone; edges in Mpc, or in redshift."""
        if redshifts:
            inner, outer = self.distance(inner), self.distance(outer)
        solid = 4 * math.pi if half_angle is None else 2 * math.pi * (1 - math.cos(half_angle))
        return solid / 3 * (outer**3 - inner**3)

    def subshells(self, z_range: tuple[float, float], n: int, grid: int = 20001) -> list[tuple[float, float]]:
        """Redshift ranges of n shells of equal volume."""
        z = np.linspace(*z_range, grid)
        r = self.distance(z)
        edges = np.interp(equal_volume_edges(r[0], r[-1], n), r, z)
        edges[0], edges[-1] = z_range
        return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def equal_volume_edges(r_min: float, r_max: float, n: int) -> np.ndarray:
    edges = np.cbrt(np.linspace(r_min**3, r_max**3, n + 1))
    edges[0], edges[-1] = r_min, r_max
    return edges


@dataclass(frozen=True)
class Spline:
    """A not-a-knot cubic spline; beyond its ends the end pieces go on."""

    x: np.ndarray
    c: np.ndarray

    @classmethod
    def through(cls, x: np.ndarray, y: np.ndarray) -> Spline:
        n, h = len(x), np.diff(x)
        slope = np.diff(y) / h
        lower, main, upper, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        main[1:-1], lower[1:-1], upper[1:-1] = 2 * (h[:-1] + h[1:]), h[:-1], h[1:]
        right[1:-1] = 6 * np.diff(slope)
        # Third derivatives agree across the second and the last but one knot: the end values are eliminated.
        m1 = (main[1] + h[0] + h[0] ** 2 / h[1], upper[1] - h[0] ** 2 / h[1])
        m2 = (main[-2] + h[-1] + h[-1] ** 2 / h[-2], lower[-2] - h[-1] ** 2 / h[-2])
        d, u, lo, b = main[1:-1].copy(), upper[1:-1].copy(), lower[1:-1].copy(), right[1:-1].copy()
        d[0], u[0], d[-1], lo[-1] = m1[0], m1[1], m2[0], m2[1]
        for i in range(1, n - 2):
            f = lo[i] / d[i - 1]
            d[i] -= f * u[i - 1]
            b[i] -= f * b[i - 1]
        m = np.zeros(n)
        m[n - 2] = b[-1] / d[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (b[i] - u[i] * m[i + 2]) / d[i]
        m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
        m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
        c = np.stack([y[:-1], slope - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)])
        return cls(np.asarray(x, float), c)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(self.x, at, "right") - 1, 0, self.c.shape[1] - 1)
        t = at - self.x[k]
        c = self.c
        return c[0, k] + t * (c[1, k] + t * (c[2, k] + t * c[3, k]))


def redshift_column(cosmology: Cosmology, r: Column) -> Column:
    """Redshift at each distance, in Arrow batches; the table is built once and sent with the function (3000 knots)."""
    spline = cosmology.table()

    @F.pandas_udf("double")
    def at(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(spline(s.to_numpy(float)))

    return at(r)


def expansion_factor(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + z)


def linear_table(spark: SparkSession, cosmology: Cosmology, z_max: float, knots: int = 64) -> DataFrame:
    """k, z, r, z_next, r_next: pieces of a linear table of distances."""
    z = np.linspace(0.0, z_max, knots)
    r = cosmology.distance(z)
    rows = [(k, float(z[k]), float(r[k]), float(z[k + 1]), float(r[k + 1])) for k in range(knots - 1)]
    return spark.createDataFrame(rows, "k int, z double, r double, z_next double, r_next double")


def linear_redshift(points: DataFrame, table: DataFrame, r: str = "r") -> DataFrame:
    """points with z, by a range join to a linear table: an as-of lookup that SQL can express."""
    t = table.select("k", F.col("z").alias("__z"), F.col("r").alias("__r"), F.col("z_next").alias("__zn"), F.col("r_next").alias("__rn"))
    joined = points.join(F.broadcast(t), (F.col(r) >= F.col("__r")) & (F.col(r) < F.col("__rn")), "left")
    z = F.col("__z") + (F.col(r) - F.col("__r")) * (F.col("__zn") - F.col("__z")) / (F.col("__rn") - F.col("__r"))
    return joined.withColumn("z_at_r", z).drop("k", "__z", "__r", "__zn", "__rn")


def temperature_at(t: Column, z_snapshot: Column, z_lightcone: Column) -> Column:
    return t * F.pow((1 + z_lightcone) / (1 + z_snapshot), F.lit(2.0))


def diameter(r: float, half_angle: float | None = None) -> float:
    """Across a beam at a distance, or of the whole sphere."""
    return 2 * r if half_angle is None else 2 * r * math.tan(half_angle)
