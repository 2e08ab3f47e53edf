"""Measures of painted pages: bounding box, ink, page geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marked(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return (F.col(r) != 255) | (F.col(g) != 255) | (F.col(b) != 255)


def bounding_box(pixels: DataFrame, height: int, dpi: float = 72.0, page: str = "page", row: str = "r_", col: str = "c_") -> DataFrame:
    """(page, found, llx, lly, urx, ury) in points, y upwards; an unmarked page has no box."""
    k, on = 72.0 / dpi, marked()
    at = lambda f, c: f(F.when(on, F.col(c)))
    return pixels.groupBy(page).agg(F.max(on).alias("found"), (at(F.min, col) * k).alias("llx"), ((height - 1 - at(F.max, row)) * k).alias("lly"), ((at(F.max, col) + 1) * k).alias("urx"), ((height - at(F.min, row)) * k).alias("ury"))


def ink(pixels: DataFrame, total: int | None = None, page: str = "page") -> DataFrame:
    """Share of pixels that are not white, by channel; ``total``: pixels of a page of which unmarked ones are not listed."""
    n = F.lit(float(total)) if total else F.count(F.lit(1)).cast("double")
    return pixels.groupBy(page).agg(*[F.coalesce(F.try_divide(F.count_if(F.col(c) != 255).cast("double"), n), F.lit(0.0)).alias(f"ink_{c}") for c in "rgb"])


def ink_amount(pixels: DataFrame, total: int | None = None, page: str = "page") -> DataFrame:
    """Mean darkness by channel, 0 to 1."""
    n = (F.lit(float(total)) if total else F.count(F.lit(1)).cast("double")) * 255.0
    return pixels.groupBy(page).agg(*[F.coalesce(F.try_divide(F.sum(255 - F.col(c)).cast("double"), n), F.lit(0.0)).alias(f"amount_{c}") for c in "rgb"])


def page_geometry(width: Column, height: Column, dpi: Column) -> tuple[Column, Column, Column]:
    """(pixels across, pixels down, error): defaults 612 by 792 at 72, sides up to 20000, 40 million pixels in all."""
    d = F.when(dpi > 0, dpi).otherwise(F.lit(72.0))
    w = F.ceil(F.when(width > 0, width).otherwise(F.lit(612.0)) * d / 72)
    h = F.ceil(F.when(height > 0, height).otherwise(F.lit(792.0)) * d / 72)
    return w, h, F.when((w > 20000) | (h > 20000) | (w * h > 40_000_000), F.lit("limitcheck"))


def resample_size(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Sides scaled so that the longest is at most ``longest``."""
    k = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.floor(x * k + 0.5).cast("int")) for x in (width, height))
