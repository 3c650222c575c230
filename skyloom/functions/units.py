"""Units as exponents of the five base quantities, and their conversion by factors on the driver."""

from __future__ import annotations

from dataclasses import dataclass

BASE = ("I", "L", "M", "T", "t")
#: CGS values of named units. Fixed values.
CGS = {"cm": 1.0, "m": 100.0, "km": 1e5, "pc": 3.0856775814913673e18, "kpc": 3.0856775814913673e21, "Mpc": 3.0856775814913673e24, "g": 1.0, "kg": 1e3, "Msun": 1.98841e33, "s": 1.0, "yr": 3.15576e7, "Gyr": 3.15576e16, "K": 1.0}
KIND = {**dict.fromkeys(("cm", "m", "km", "pc", "kpc", "Mpc"), "L"), **dict.fromkeys(("g", "kg", "Msun"), "M"), **dict.fromkeys(("s", "yr", "Gyr"), "t"), "K": "T"}


@dataclass(frozen=True)
class Unit:
    """cgs: the unit in CGS; powers of (current, length, mass, temperature, time); powers of the scale factor and of h."""

    cgs: float
    powers: tuple[float, ...] = (0.0,) * 5
    a: float = 0.0
    h: float = 0.0

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.cgs * other.cgs, tuple(x + y for x, y in zip(self.powers, other.powers, strict=True)), self.a + other.a, self.h + other.h)

    def __pow__(self, n: float) -> Unit:
        return Unit(self.cgs**n, tuple(x * n for x in self.powers), self.a * n, self.h * n)

    def comoving(self) -> Unit:
        """Without the scale factor; numbers stay."""
        return Unit(self.cgs, self.powers, 0.0, self.h)

    def factor_to(self, other: Unit) -> float:
        """What numbers in this unit are multiplied by; ValueError if dimensions differ."""
        if (self.powers, self.a, self.h) != (other.powers, other.a, other.h):
            raise ValueError("units of different dimensions")
        return self.cgs / other.cgs


def named(name: str) -> Unit:
    """A unit by name, or a product of powers such as `Mpc/s`, `Msun*Mpc**-3`."""
    out = Unit(1.0)
    sign = 1.0
    for part in name.replace("/", " / ").replace("**", "^").replace("*", " ").split():
        if part == "/":
            sign = -1.0
            continue
        base, _, power = part.partition("^")
        if base not in CGS:
            raise ValueError(f"unknown unit {base!r}")
        one = Unit(CGS[base], tuple(1.0 if KIND[base] == b else 0.0 for b in BASE))
        out, sign = out * one ** (sign * float(power or 1)), 1.0
    return out


def from_attributes(attributes: dict[str, float], cgs: dict[str, float]) -> Unit:
    """The unit of a dataset with exponents U_I, U_L, U_M, U_T, U_t, a-scale and h-scale, in a system of CGS factors by base."""
    powers = tuple(float(attributes.get(f"U_{b}", 0.0)) for b in BASE)
    size = 1.0
    for b, p in zip(BASE, powers, strict=True):
        size *= cgs.get(b, 1.0) ** p
    physical = bool(attributes.get("stored-as-physical", 0))
    return Unit(size, powers, 0.0 if physical else float(attributes.get("a-scale", 0.0)), float(attributes.get("h-scale", 0.0)))


def to_attributes(unit: Unit) -> dict[str, float]:
    if unit.h:
        raise ValueError("powers of h are not written")
    return {**{f"U_{b}": p for b, p in zip(BASE, unit.powers, strict=True)}, "a-scale": unit.a, "h-scale": 0.0}


#: Names of the dataset attributes that hold CGS factors. Fixed values of the file format.
COMOVING_CGS, PHYSICAL_CGS, EXPONENT = "Conversion factor to CGS (not including cosmological corrections)", "Conversion factor to physical CGS (including cosmological corrections)", "a-scale exponent"
GROUPS = {"physical_constants_cgs": "PhysicalConstants/CGS", "cosmology": "Cosmology", "units_cgs": ("Units", "InternalCodeUnits")}
#: Which factor of a system of units is that of which base quantity. Fixed values of the file format.
FACTORS = {"Unit current in cgs (U_I)": "I", "Unit length in cgs (U_L)": "L", "Unit mass in cgs (U_M)": "M", "Unit temperature in cgs (U_T)": "T", "Unit time in cgs (U_t)": "t"}


def plain_attributes(attributes: dict) -> dict:
    """Attributes as read from a file: bytes as text, what holds one value as that value."""
    out = {}
    for name, value in attributes.items():
        one = value[0] if isinstance(value, (list, tuple)) and len(value) == 1 else value.item() if getattr(value, "size", 0) == 1 else value
        out[name] = one.decode() if isinstance(one, bytes) else one
    return out


def snapshot_metadata(groups: dict[str, dict]) -> dict[str, dict]:
    """The constants, cosmology and systems of units of a snapshot (its attributes by group), as numbers. KeyError names a group that is not there."""
    numbers = lambda name: {k: float(v) for k, v in plain_attributes(groups[name]).items()}
    return {k: numbers(v) if isinstance(v, str) else {one: numbers(one) for one in v} for k, v in GROUPS.items()}


def base_factors(metadata: dict[str, dict], system: str = "Units") -> dict[str, float]:
    """The CGS factor of each base quantity in a snapshot's system of units."""
    held = metadata["units_cgs"][system]
    return {base: held[name] for name, base in FACTORS.items() if name in held}


def with_comoving_factor(attributes: dict, scale_factor: float) -> dict:
    """A dataset's attributes with its CGS factor without cosmological corrections: as stored, else the physical one without its power of
    the scale factor."""
    plain = plain_attributes(attributes)
    return {COMOVING_CGS: plain[PHYSICAL_CGS] / scale_factor ** plain[EXPONENT], **attributes} if COMOVING_CGS not in attributes else dict(attributes)
