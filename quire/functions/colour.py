"""Colour spaces, blend modes and matrices as Column arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rgb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return clamp(r), clamp(g), clamp(b)


def gray(g: Column) -> tuple[Column, Column, Column]:
    return (clamp(g),) * 3


def cmyk(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return tuple((1 - clamp(x)) * (1 - clamp(k)) for x in (c, m, y))


def icc(parts: list[Column], alternate: Callable | None = None, alternate_size: int | None = None) -> tuple[Column, Column, Column]:
    """A profile's alternate space if its size agrees, else the device space with as many components."""
    if alternate is not None and alternate_size == len(parts):
        return alternate(*parts)
    return {1: gray, 3: rgb, 4: cmyk}[len(parts)](*parts)


def tint(program: str, parts: list[Column], alternate: Callable, size: int) -> tuple[Column, Column, Column]:
    """Separation and DeviceN: a calculator function into the alternate space; failure previews black."""
    from quire.functions.stack import calculator

    out, error = calculator(program, parts, domain=[(0, 1)] * len(parts), ranges=[(0, 1)] * size)
    return tuple(F.when(error.isNull(), x).otherwise(F.lit(0.0)) for x in alternate(*out))


def indexed(pixels: DataFrame, palette: DataFrame, index: str = "index") -> DataFrame:
    """Palette lookup; ``palette`` has one row an index and at most 256, so it is broadcast."""
    return pixels.join(F.broadcast(palette.limit(256)), index, "left")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b)


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """Black first; bytes in, reals 0 to 1 out."""
    r, g, b = r / 255, g / 255, b / 255
    k = 1 - F.greatest(r, g, b)
    part = lambda x: F.when(k < 1, (1 - x - k) / F.when(k < 1, 1 - k)).otherwise(F.lit(0.0))
    return part(r), part(g), part(b), k


def to_byte(v: Column) -> Column:
    return F.floor(clamp(v) * 255 + 0.5).cast("int")


def _soft(d: Column, s: Column) -> Column:
    lift = F.when(d <= 0.25, ((16 * d - 12) * d + 4) * d).otherwise(F.sqrt(d))
    return F.when(s <= 0.5, d - (1 - 2 * s) * d * (1 - d)).otherwise(d + (2 * s - 1) * (lift - d))


def _hard(d: Column, s: Column) -> Column:
    return F.when(s <= 0.5, 2 * d * s).otherwise(1 - 2 * (1 - d) * (1 - s))


#: Separable blend modes: d is the backdrop, s the source. The four others that a document may name are refused.
BLEND: dict[str, Callable[[Column, Column], Column]] = {
    "Normal": lambda d, s: s,
    "Multiply": lambda d, s: d * s,
    "Screen": lambda d, s: d + s - d * s,
    "Overlay": lambda d, s: _hard(s, d),
    "Darken": F.least,
    "Lighten": F.greatest,
    "ColorDodge": lambda d, s: F.when(d <= 0, F.lit(0.0)).when(s >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(d, 1 - s))),
    "ColorBurn": lambda d, s: F.when(d >= 1, F.lit(1.0)).when(s <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), F.try_divide(1 - d, s))),
    "HardLight": _hard,
    "SoftLight": _soft,
    "Difference": lambda d, s: F.abs(d - s),
    "Exclusion": lambda d, s: d + s - 2 * d * s,
}
REFUSED = ("Hue", "Saturation", "Color", "Luminosity")


def blend_mode(name: str) -> Callable[[Column, Column], Column]:
    name = "Normal" if name == "Compatible" else name
    if name not in BLEND:
        raise ValueError(f"undefined blend mode {name}")
    return BLEND[name]


def composite(dst: Column, src: Column, alpha: Column, mode: str = "Normal") -> Column:
    """Bytes onto bytes: blended, weighted by alpha, and rounded after each mark."""
    d, s = dst / 255, src / 255
    return F.floor((blend_mode(mode)(d, s) * alpha + d * (1 - alpha)) * 255 + 0.5).cast("int")


# -- matrices: (a, b, c, d, e, f), x' = a x + c y + e, y' = b x + d y + f -------------------------

Matrix = tuple[Column, Column, Column, Column, Column, Column]


def matrix_concat(m: Matrix, n: Matrix) -> Matrix:
    """First ``m``, then ``n``."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def matrix_apply(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def matrix_invert(m: Matrix) -> Matrix:
    """NULLs for a singular matrix."""
    a, b, c, d, e, f = m
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det


def translation(x: Column, y: Column) -> Matrix:
    return F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), x, y


def scaling(x: Column, y: Column) -> Matrix:
    return x, F.lit(0.0), F.lit(0.0), y, F.lit(0.0), F.lit(0.0)


def rotation(degrees: Column) -> Matrix:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c, s, -s, c, F.lit(0.0), F.lit(0.0)
