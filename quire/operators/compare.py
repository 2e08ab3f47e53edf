"""Comparisons of bytes, pages and page lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_bytes(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(equal, first differing offset, reason): -1 if equal; where one is a prefix of the other, the shorter length."""
    a, b = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(a), F.octet_length(b))
    part = lambda x, i, k: F.substring(x, (i * k + 1).cast("int"), F.lit(k))
    first = lambda ids, k: F.get(F.filter(ids, lambda i: part(a, i, k) != part(b, i, k)), F.lit(0))
    # the first block of 256 bytes that differs, then the first byte in it: bytes are reached in constant time
    block = first(F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int")), 256)
    byte = F.when(n > 0, F.get(F.transform(F.array(block), lambda k: first(F.sequence(k * 256, F.least(k * 256 + 255, n - 1)), 1)), F.lit(0)))
    same = a == b
    found = F.when(~same & (n > 0), byte)
    offset = F.when(same, F.lit(-1)).otherwise(F.coalesce(found, n)).cast("long")
    reason = F.when(same, F.lit("equal")).when(found.isNotNull(), F.lit("byte")).otherwise(F.lit("length"))
    return same, offset, reason


def compare_rasters(left: DataFrame, right: DataFrame, width: Column, page: str = "page", row: str = "r_", col: str = "c_") -> DataFrame:
    """(page, offset): the first differing byte of two pages given as the same set of pixels, rows of 3 * width bytes; -1: equal."""
    at = (F.col(row) * width + F.col(col)) * 3
    a = left.select(page, row, col, *[F.col(c).alias(f"{c}1") for c in "rgb"])
    b = right.select(page, row, col, *[F.col(c).alias(f"{c}2") for c in "rgb"])
    missing = lambda c: F.coalesce(F.col(c), F.lit(255))
    step = F.when(missing("r1") != missing("r2"), 0).when(missing("g1") != missing("g2"), 1).when(missing("b1") != missing("b2"), 2)
    return a.join(b, [page, row, col], "full").groupBy(page).agg(F.coalesce(F.min(at + step), F.lit(-1)).cast("long").alias("offset"))


def first_failing_page(pages: DataFrame, others: DataFrame, doc: str = "doc_id", page: str = "page", digest: str = "digest") -> DataFrame:
    """(doc, reason, page): page lists of two versions of documents; a different count is 'length', else the first pair that differs."""
    none, keys = F.lit(None).cast(pages.schema[digest].dataType), [doc, page]
    each = pages.select(*keys, F.col(digest).alias("d1"), none.alias("d2")).unionByName(others.select(*keys, none.alias("d1"), F.col(digest).alias("d2")))
    # both lists meet in one aggregate, so pages dealt by document before are neither dealt again nor sorted apart
    met = each.groupBy(*keys).agg(*[f(d).alias(f"{f.__name__}_{d}") for d in ("d1", "d2") for f in (F.min, F.max, F.count)])
    same = F.col("min_d1").eqNullSafe(F.col("max_d2")) & F.col("max_d1").eqNullSafe(F.col("min_d2")) & F.col(doc).isNotNull()
    both = met.groupBy(doc).agg(F.sum("count_d1").alias("n1"), F.sum("count_d2").alias("n2"), F.min(F.when(~same, F.col(page))).alias("p"))
    reason = F.when(F.col("n1") != F.col("n2"), F.lit("length")).when(F.col("p").isNotNull(), F.lit("page")).otherwise(F.lit("equal"))
    return both.select(doc, reason.alias("reason"), F.when(reason == "page", F.col("p")).alias("page"))


def page_selection(spec: str | None, count: int) -> range:
    """'N', 'N-M', 'N-' or '-M'. A start beyond the pages is an error, an end beyond them is cut."""
    if not spec:
        return range(1, count + 1)
    m = re.fullmatch(r"(\d*)(-?)(\d*)", spec)
    if not m or not (m[1] or m[3]):
        raise ValueError(f"rangecheck: page list {spec}")
    first = int(m[1]) if m[1] else 1
    last = int(m[3]) if m[3] else (count if m[2] else first)
    if not 1 <= first <= count or last < first:
        raise ValueError(f"rangecheck: page {first}")
    return range(first, min(last, count) + 1)


def contiguous_page_list(spec: str) -> tuple[int, int]:
    """A comma list of 'N' and 'N-M' that must run upward without a gap: its first and last page."""
    last = None
    first = 0
    for part in spec.split(","):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m:
            raise ValueError(f"rangecheck: page list {spec}")
        a, b = int(m[1]), int(m[2] or m[1])
        if a < 1 or b < a or (last is not None and a != last + 1):
            raise ValueError(f"rangecheck: page list {spec}")
        first, last = first or a, b
    return first, last
