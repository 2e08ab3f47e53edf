"""Named jobs over a table of files (doc_id, content), and the arguments that select them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import compare, measure, raster, rules
from quire.sources import content, pdf, postscript, rewrite, sinks, structure

VERSION = "0.1"
#: Device names and the job each stands for; there is no JPEG encoder here, so that device is refused.
DEVICES = {"png16m": ("raster", "png"), "ppmraw": ("raster", "ppm"), "tiff24nc": ("raster", "tiff"), "bbox": ("bbox", None), "inkcov": ("inkcov", None), "pdfimage24": ("pdfimage", None), "pdfwrite": ("rewrite", None)}
SWITCHES = ("BATCH", "NOPAUSE", "SAFER", "FIXEDMEDIA")


def marks(files: DataFrame) -> DataFrame:
    """Painted shapes of PDF and PostScript files alike."""
    is_pdf = F.expr("substring(cast(content as binary), 1, 5) = cast('%PDF-' as binary)")
    return content.pdf_marks(files.where(is_pdf)).unionByName(postscript.run_postscript(files.where(~F.coalesce(is_pdf, F.lit(False)))))


def page_pixels(files: DataFrame, width: int = 612, height: int = 792, dpi: int = 72, pages: tuple[int, int] | None = None) -> DataFrame:
    """Marked pixels of pages of ``width`` by ``height`` points at ``dpi``, of the pages from ``pages[0]`` to ``pages[1]``."""
    m = marks(files).where("error is null")
    if pages:
        m = m.where(F.col("page").between(*pages))
    k = dpi / 72
    if dpi != 72:
        path = lambda c: F.transform(c, lambda p: F.struct((p["x"] * k).alias("x"), (p["y"] * k).alias("y"), p["move"].alias("move")))
        m = m.withColumns({
            "points": path(F.col("points")), "half": F.col("half") * k, "clip_paths": F.transform("clip_paths", lambda c: F.struct(c["even"].alias("even"), path(c["points"]).alias("points"))),
            "image": F.when(F.col("image").isNotNull(), F.struct("image.w", "image.h", "image.rgba", F.transform("image.m", lambda v: v * k).alias("m"))),
        })
    return raster.render(m, device_size(width, dpi), device_size(height, dpi))


def device_size(points: float, dpi: int) -> int:
    """Pixels of a side: rounded, at least one, at most 20000."""
    size = max(1, int(points * dpi / 72 + 0.5))
    if size > 20_000:
        raise ValueError("limitcheck")
    return size


def _page_key(px: DataFrame) -> DataFrame:
    return px.select(F.struct("doc_id", "page").alias("page"), F.col("row").alias("r_"), F.col("col").alias("c_"), "r", "g", "b")


def render(files: DataFrame, kind: str = "png", width: int = 612, height: int = 792, dpi: int = 72, pages: tuple[int, int] | None = None) -> DataFrame:
    return sinks.encode_pages(page_pixels(files, width, height, dpi, pages), device_size(width, dpi), device_size(height, dpi), kind)


def pdfimage(files: DataFrame, colour: str = "rgb", width: int = 612, height: int = 792, dpi: int = 72, pages: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, bytes): one document for each, its pages as full-page images. The pages of one document meet in a task."""
    w, h = device_size(width, dpi), device_size(height, dpi)

    def one(px: pd.DataFrame) -> pd.DataFrame:
        made = []
        for _, page in px.groupby("page", sort=True):
            rgb = np.full((h, w, 3), 255, dtype=np.uint8)
            rgb[page["row"], page["col"]] = page[["r", "g", "b"]].to_numpy()
            made.append(rgb)
        return pd.DataFrame({"doc_id": [px["doc_id"].iloc[0]], "bytes": [sinks.image_pdf(made, dpi, colour)]})

    px = page_pixels(files, width, height, dpi, pages)
    return px.groupBy("doc_id").applyInPandas(one, f"doc_id {px.schema['doc_id'].dataType.simpleString()}, bytes binary")


def to_postscript(files: DataFrame, width: int = 612, height: int = 792, pages: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, bytes): painted paths of PDF files as PostScript; a file with images or an error gives none."""
    m = marks(files)
    bad = m.where("error is not null or op = 'image'").select("doc_id").distinct()
    m = m.where("op is not null").join(bad, "doc_id", "left_anti")
    if pages:
        m = m.where(F.col("page").between(*pages))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for _, page in rows.sort_values(["page", "seq"]).groupby("page", sort=True):
            made.append([(r.op, [(p["x"], p["y"], p["move"]) for p in r.points], (r.r, r.g, r.b), r.half) for r in page.itertuples()])
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "bytes": [sinks.marks_to_postscript(made, width, height)]})

    cols = m.select("doc_id", "page", "seq", "op", "points", "r", "g", "b", "half")
    return cols.groupBy("doc_id").applyInPandas(one, f"doc_id {m.schema['doc_id'].dataType.simpleString()}, bytes binary")


def bbox(files: DataFrame, width: int = 612, height: int = 792, dpi: int = 72, pages: tuple[int, int] | None = None) -> DataFrame:
    """Boxes in points, whatever the resolution."""
    found = measure.bounding_box(_page_key(page_pixels(files, width, height, dpi, pages)), device_size(height, dpi))
    return found.select("page.*", "found", *[(F.col(c) * 72 / dpi).alias(c) for c in ("llx", "lly", "urx", "ury")])


def inkcov(files: DataFrame, width: int = 612, height: int = 792, dpi: int = 72, pages: tuple[int, int] | None = None) -> DataFrame:
    return measure.ink(_page_key(page_pixels(files, width, height, dpi, pages)), device_size(width, dpi) * device_size(height, dpi)).select("page.*", "ink_r", "ink_g", "ink_b")


def ink_cov(files: DataFrame, width: int = 612, height: int = 792, dpi: int = 72, pages: tuple[int, int] | None = None) -> DataFrame:
    return measure.ink_amount(_page_key(page_pixels(files, width, height, dpi, pages)), device_size(width, dpi) * device_size(height, dpi)).select("page.*", "amount_r", "amount_g", "amount_b")


def compare_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, equal, offset, reason) of files of the same id in both tables."""
    both = left.select("doc_id", F.col("content").alias("a")).join(right.select("doc_id", F.col("content").alias("b")), "doc_id")
    same, offset, reason = compare.compare_bytes(F.col("a"), F.col("b"))
    return both.select("doc_id", same.alias("equal"), offset.alias("offset"), reason.alias("reason"))


def compare_pages(left: DataFrame, right: DataFrame, width: int = 612, height: int = 792, dpi: int = 72) -> DataFrame:
    """(doc_id, page, offset): the first byte in which painted pages differ, -1 if in none."""
    a, b = (_page_key(page_pixels(f, width, height, dpi)) for f in (left, right))
    return compare.compare_rasters(a, b, F.lit(device_size(width, dpi))).select("page.*", "offset")


def version(files: DataFrame) -> DataFrame:
    return files.sparkSession.createDataFrame([(VERSION,)], "version string")


def text(files: DataFrame) -> DataFrame:
    """(doc_id, page, txt)."""
    return content.pdf_text(files)


def validate(files: DataFrame) -> DataFrame:
    """(doc_id, error): the first error of painting, then of accessibility where the file is tagged."""
    painted = marks(files).groupBy("doc_id").agg(F.min_by("error", F.struct(F.col("error").isNull(), "page")).alias("paint"))
    tagged = pdf.info(files).where("tagged").select("doc_id")
    rule = structure.accessibility_violations(structure.facts(files)).join(tagged, "doc_id", "left_semi")
    return painted.join(rule, "doc_id", "left").select("doc_id", F.coalesce("paint", "rule").alias("error"))


def archive_check(files: DataFrame, mode: str = "4") -> DataFrame:
    return rules.first_violation(rules.archive_violations(pdf.objects(files), mode))


JOBS: dict[str, Callable[..., DataFrame]] = {"run": marks, "raster": render, "bbox": bbox, "inkcov": inkcov, "ink_cov": ink_cov, "text": text, "info": pdf.info, "validate": validate, "archive": archive_check, "pdfimage": pdfimage, "ps": to_postscript, "rewrite": rewrite.rewrite, "version": version}
#: Jobs of two tables of files.
COMPARE_JOBS = {"bytes": compare_files, "raster": compare_pages}


def from_arguments(argv: list[str]) -> tuple[str, dict]:
    """A job and its options from device-style arguments; anything not on the list is refused."""
    device, options, inputs, output = None, {}, [], None
    args = iter(argv)
    number = lambda t: float(t) if "." in t else int(t)
    for a in args:
        name, _, value = a[2:].partition("=")
        if a == "-q" or a[:2] == "-d" and name in SWITCHES and value in ("", "true", "1"):
            continue
        if a == "-f":
            inputs.append(next(args, None))
        elif a[:2] == "-s" and name == "DEVICE":
            device = value
            if device not in DEVICES:
                raise ValueError(f"undefined device {device}")
        elif a[:2] == "-s" and name == "PageList":
            options["pages"] = compare.contiguous_page_list(value)
        elif a[:2] == "-d" and name in ("FirstPage", "LastPage") and value.isdigit() and int(value) > 0:
            first, last = options.get("pages", (1, 100_000))
            options["pages"] = (int(value), last) if name == "FirstPage" else (first, int(value))
        elif a[:2] == "-d" and name in ("DEVICEWIDTHPOINTS", "DEVICEHEIGHTPOINTS") and re.fullmatch(r"\d+(\.\d+)?", value) and float(value) > 0:
            options["width" if "WIDTH" in name else "height"] = number(value)
        elif a[:2] == "-s" and name == "OutputFile" and value:
            output = value
        elif a[:2] == "-r" and a[2:].isdigit() and int(a[2:]) > 0:
            options["dpi"] = int(a[2:])
        elif not a.startswith(("-", "@")):
            inputs.append(a)
        else:
            raise ValueError(f"undefined argument {a}")
    if device is None:
        raise ValueError("undefined device")
    if len(inputs) > 1 or None in inputs:
        raise ValueError("rangecheck: one input file")
    job, kind = DEVICES[device]
    if job == "rewrite" and options:
        raise ValueError(f"undefined for pdfwrite: {', '.join(options)}")
    return job, options | ({"kind": kind} if kind else {}) | ({"inputs": inputs} if inputs else {}) | ({"output": output} if output else {})


def run_arguments(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The job of device-style arguments on its input, a path or pattern that Spark reads; ids are the paths of the files."""
    job, options = from_arguments(argv)
    where = options.pop("inputs", None)
    options.pop("output", None)  # where the rows go is the caller's: sinks.page_path names files
    if not where:
        raise ValueError("rangecheck: no input")
    files = spark.read.format("binaryFile").load(where[0]).select(F.col("path").alias("doc_id"), "content")
    return JOBS[job](files, **options)
