"""HEALPix index mathematics as integer and double Columns, after the published formulas (Gorski et al. 2005)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geometry import Vector, floor_mod, norm, step

#: Ring and longitude offsets of the twelve base pixels. Fixed values.
RING_OF_FACE, LONGITUDE_OF_FACE = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4), (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def n_pixels(nside: int) -> int:
    return 12 * nside * nside


def pixel_area(nside: int) -> float:
    return 4 * math.pi / n_pixels(nside)


def check_nside(nside: int, nested: bool = False) -> int:
    if nside < 1 or nested and nside & (nside - 1):
        raise ValueError(f"nside must be positive, and a power of two if nested, not {nside}")
    return nside


def _long(c: Column) -> Column:
    return F.floor(c).cast("long")


def spread_bits(v: Column, bits: int = 29) -> Column:
    """Bit i of v to bit 2i."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 2 * i))
    return out


def squeeze_bits(v: Column, bits: int = 29) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, 2 * i).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def _bits(nside: int) -> int:
    return max(1, nside.bit_length())


def _ring_geometry(jr: Column, nside: int) -> tuple[Column, Column]:
    """Pixels in a quarter of ring jr, and whether it is shifted."""
    n = nside
    north, south = jr < n, jr > 3 * n
    nr = F.when(north, jr).when(south, 4 * n - jr).otherwise(F.lit(n))
    return nr, F.when(north | south, 0).otherwise((jr - n).bitwiseAND(F.lit(1).cast("long")))


def _pick(face: Column, values: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (face + 1).cast("int"))


def nest_of(face: Column, x: Column, y: Column, nside: int) -> Column:
    b = _bits(nside)
    return face * (nside * nside) + spread_bits(x, b) + F.shiftleft(spread_bits(y, b), 1)


def _ring(df: DataFrame, face: str, x: str, y: str, nside: int, name: str) -> DataFrame:
    """df with the ring pixel of base pixel and position, step by step."""
    col, n = F.col, nside
    df = step(df, __jr=_pick(col(face), RING_OF_FACE) * n - col(x) - col(y) - 1)
    nr, shift = _ring_geometry(col("__jr"), n)
    df = step(df, __nr=nr, __sh=shift)
    north, south = col("__jr") < n, col("__jr") > 3 * n
    before = F.when(north, 2 * col("__jr") * (col("__jr") - 1)).when(south, n_pixels(n) - 2 * (col("__nr") + 1) * col("__nr")).otherwise(2 * n * (n - 1) + (col("__jr") - n) * 4 * n)
    df = step(df, **{"__be": before, "__jp": _long((_pick(col(face), LONGITUDE_OF_FACE) * col("__nr") + col(x) - col(y) + 1 + col("__sh")) / 2)})
    around = F.when(col("__jp") > 4 * n, col("__jp") - 4 * n).when(col("__jp") < 1, col("__jp") + 4 * n).otherwise(col("__jp"))
    return df.withColumn(name, col("__be") + around - 1).drop("__jr", "__nr", "__sh", "__be", "__jp")


def nest_parts(pixel: Column, nside: int) -> tuple[Column, Column, Column]:
    b, inner = _bits(nside), pixel % (nside * nside)
    return _long(pixel / (nside * nside)), squeeze_bits(inner, b), squeeze_bits(F.shiftright(inner, 1), b)


def with_pixel(df: DataFrame, v: Vector, name: str, nside: int, nested: bool = True) -> DataFrame:
    """df with the pixel of a direction (of any length but 0), step by step: one expression would repeat its parts many times."""
    check_nside(nside, nested)
    n, col = nside, F.col
    df = step(df, **{"__x": v[0], "__y": v[1], "__z": v[2]})
    df = step(df, **{"__cz": col("__z") / norm((col("__x"), col("__y"), col("__z"))), "__tt": floor_mod(F.atan2("__y", "__x") * (2 / math.pi), 4.0)})
    df = step(df, **{"__jp": _long(n * (0.5 + col("__tt")) - n * col("__cz") * 0.75), "__jm": _long(n * (0.5 + col("__tt")) + n * col("__cz") * 0.75), "__nt": F.least(_long(col("__tt")), F.lit(3).cast("long")), "__q": n * F.sqrt(3 * (1 - F.abs("__cz")))})
    held = lambda c: F.least(_long(c), F.lit(n - 1).cast("long"))
    df = step(df, **{"__ip": _long(col("__jp") / n), "__im": _long(col("__jm") / n), "__kp": held((col("__tt") - col("__nt")) * col("__q")), "__km": held((1 - col("__tt") + col("__nt")) * col("__q"))})
    middle, north = F.abs("__cz") <= 2 / 3, col("__cz") >= 0
    around = F.when(col("__ip") == col("__im"), col("__ip") % 4 + 4).when(col("__ip") < col("__im"), col("__ip") % 4).otherwise(col("__im") % 4 + 8)
    df = step(df, **{"__face": F.when(middle, around).when(north, col("__nt")).otherwise(col("__nt") + 8).cast("long"), "__px": F.when(middle, col("__jm") % n).when(north, n - col("__km") - 1).otherwise(col("__kp")).cast("long"), "__py": F.when(middle, n - col("__jp") % n - 1).when(north, n - col("__kp") - 1).otherwise(col("__km")).cast("long")})
    if nested:
        df = df.withColumn(name, nest_of(col("__face"), col("__px"), col("__py"), nside))
    else:
        df = _ring(df.drop("__jp"), "__face", "__px", "__py", nside, name)
    return df.drop("__x", "__y", "__z", "__cz", "__tt", "__jp", "__jm", "__nt", "__q", "__ip", "__im", "__kp", "__km", "__face", "__px", "__py")


def with_vectors(df: DataFrame, pixel: str, nside: int, nested: bool = True, prefix: str = "") -> DataFrame:
    """df with the unit vector (prefix + x, y, z) to a pixel's centre, step by step."""
    df = with_ring(df, pixel, "__ring", nside) if nested else df.withColumn("__ring", F.col(pixel))
    df = step(df, **dict(zip(("__cz", "__phi"), ring_to_z_phi(F.col("__ring"), nside), strict=True)))
    s = F.sqrt(F.greatest(1 - F.col("__cz") * F.col("__cz"), F.lit(0.0)))
    return df.withColumns({f"{prefix}x": s * F.cos("__phi"), f"{prefix}y": s * F.sin("__phi"), f"{prefix}z": F.col("__cz")}).drop("__ring", "__cz", "__phi")


def with_ring(df: DataFrame, pixel: str, name: str, nside: int) -> DataFrame:
    """df with the ring pixel of a nested pixel."""
    df = step(df, **dict(zip(("__f", "__rx", "__ry"), nest_parts(F.col(pixel), check_nside(nside, True)), strict=True)))
    return _ring(df, "__f", "__rx", "__ry", nside, name).drop("__f", "__rx", "__ry")


def ring_to_z_phi(pixel: Column, nside: int) -> tuple[Column, Column]:
    n, npix, cap = nside, n_pixels(nside), 2 * nside * (nside - 1)
    rest = npix - pixel
    i_n = _long((1 + F.sqrt(1 + 2 * pixel.cast("double"))) / 2)
    i_s = _long((1 + F.sqrt(2 * rest.cast("double") - 1)) / 2)
    # Square roots may be off by one next to whole numbers.
    i_n = F.when(2 * i_n * (i_n - 1) > pixel, i_n - 1).when(2 * (i_n + 1) * i_n <= pixel, i_n + 1).otherwise(i_n)
    i_s = F.when(2 * i_s * (i_s - 1) >= rest, i_s - 1).when(2 * (i_s + 1) * i_s < rest, i_s + 1).otherwise(i_s)
    k_n, k_s = pixel + 1 - 2 * i_n * (i_n - 1), 4 * i_s + 1 - (rest - 2 * i_s * (i_s - 1))
    ip = pixel - cap
    i_e, k_e = _long(ip / (4 * n)) + n, ip % (4 * n) + 1
    half = F.when((i_e + n) % 2 == 1, 1.0).otherwise(0.5)
    z = F.when(pixel < cap, 1 - i_n * i_n / (3.0 * n * n)).when(pixel < npix - cap, (2 * n - i_e) * 2 / (3.0 * n)).otherwise(-1 + i_s * i_s / (3.0 * n * n))
    phi = F.when(pixel < cap, (k_n - 0.5) * math.pi / (2 * i_n)).when(pixel < npix - cap, (k_e - half) * math.pi / (2 * n)).otherwise((k_s - 0.5) * math.pi / (2 * i_s))
    return z, phi


def parent(pixel: Column, levels: int = 1) -> Column:
    """The nested pixel that holds a nested pixel, so many levels up."""
    return F.shiftright(pixel, 2 * levels)


def children(pixel: Column, levels: int = 1) -> Column:
    """The nested pixels within a nested pixel, so many levels down (an array)."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4**levels - 1).cast("long")), lambda k: F.shiftleft(pixel, 2 * levels) + k)
