"""Writers: pages of pixels and documents as bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ppm(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    return b"P6\n%d %d\n255\n" % (w, h) + rgb.tobytes()


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    body = np.zeros((h, 1 + 3 * w), dtype=np.uint8)
    body[:, 1:] = rgb.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body.tobytes())) + chunk(b"IEND", b"")


def tiff(rgb: np.ndarray, dpi: int = 72, deflate: bool = True) -> bytes:
    h, w, _ = rgb.shape
    data = zlib.compress(rgb.tobytes()) if deflate else rgb.tobytes()
    entries = 12
    extra = 8 + 2 + entries * 12 + 4
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, extra), (259, 3, 1, 8 if deflate else 1), (262, 3, 1, 2), (273, 4, 1, extra + 22), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(data)), (282, 5, 1, extra + 6), (283, 5, 1, extra + 14), (296, 3, 1, 2)]
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", entries)
    for tag, kind, n, value in tags:
        out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 and n == 1 else struct.pack("<I", value))
    return out + struct.pack("<I", 0) + struct.pack("<HHH", 8, 8, 8) + struct.pack("<IIII", dpi, 1, dpi, 1) + data


def pdf_bytes(objects: list[bytes], root: int = 1) -> bytes:
    """Numbered objects with a classic cross-reference table; the same input gives the same bytes."""
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    at = []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out + b"trailer\n<< /Root %d 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (root, len(objects) + 1, start))


def stream(data: bytes, entries: bytes = b"", compress: bool = True) -> bytes:
    if compress:
        data, entries = zlib.compress(data), entries + b" /Filter /FlateDecode"
    return b"<< /Length %d%s >>\nstream\n" % (len(data), entries and b" " + entries.strip()) + data + b"\nendstream"


def image_pdf(pages: list[np.ndarray], dpi: float = 72.0, colour: str = "rgb") -> bytes:
    """One full-page image a page, in RGB, gray or CMYK."""
    objects = [b"<< /Pages 2 0 R /Type /Catalog >>", b""]
    kids = []
    for rgb in pages:
        h, w, _ = rgb.shape
        x = rgb.astype(np.float64)
        if colour == "gray":
            body, space = np.floor(x @ [0.299, 0.587, 0.114] + 0.5).astype(np.uint8), b"/DeviceGray"
        elif colour == "cmyk":
            k = 255 - x.max(axis=2)
            d = np.maximum(255 - k, 1)[..., None]
            body, space = np.floor(np.concatenate([(255 - x - k[..., None]) / d * 255, k[..., None]], axis=2) + 0.5).astype(np.uint8), b"/DeviceCMYK"
        else:
            body, space = rgb, b"/DeviceRGB"
        n = len(objects)
        pw, ph = w * 72 / dpi, h * 72 / dpi
        objects.append(stream(body.tobytes(), b"/BitsPerComponent 8 /ColorSpace %s /Height %d /Subtype /Image /Type /XObject /Width %d" % (space, h, w)))
        objects.append(stream(b"q %.5g 0 0 %.5g 0 0 cm /Im Do Q" % (pw, ph), compress=False))
        objects.append(b"<< /Contents %d 0 R /MediaBox [0 0 %.5g %.5g] /Parent 2 0 R /Resources << /XObject << /Im %d 0 R >> >> /Type /Page >>" % (n + 2, pw, ph, n + 1))
        kids.append(n + 3)
    objects[1] = b"<< /Count %d /Kids [%s] /Type /Pages >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return pdf_bytes(objects)


def _path(points: list) -> str:
    return "\n".join(f"{x:.6g} {y:.6g} {'m' if mv else 'l'}" for x, y, mv in points)


def marks_to_content(marks: list[tuple]) -> bytes:
    """Painted paths as page content: (op, points, (r, g, b), half width)."""
    verbs = {"fill": "f", "eofill": "f*", "stroke": "S"}
    return "\n".join(f"{r / 255:.6g} {g / 255:.6g} {b / 255:.6g} rg\n{2 * half:.6g} w\n{_path(points)}\n{verbs[op]}" for op, points, (r, g, b), half in marks).encode()


def marks_to_postscript(pages: list[list[tuple]], width: int, height: int) -> bytes:
    """Painted paths as a PostScript program, one showpage a page."""
    verbs = {"fill": "fill", "eofill": "eofill", "stroke": "stroke"}
    out = ["%!PS-Adobe-3.0", f"%%BoundingBox: 0 0 {width} {height}", f"%%Pages: {len(pages)}", "%%EndComments"]
    for i, marks in enumerate(pages, 1):
        out.append(f"%%Page: {i} {i}")
        for op, points, (r, g, b), half in marks:
            out.append(f"{r / 255:.6g} {g / 255:.6g} {b / 255:.6g} setrgbcolor {2 * half:.6g} setlinewidth newpath")
            out += [f"{x:.6g} {y:.6g} {'moveto' if mv else 'lineto'}" for x, y, mv in points]
            out.append(verbs[op])
        out.append("showpage")
    return ("\n".join([*out, "%%EOF"]) + "\n").encode()


WRITERS = {"ppm": ppm, "png": png, "tiff": tiff}


def encode_pages(pixels: DataFrame, width: int, height: int, kind: str = "png", key: str = "doc_id") -> DataFrame:
    """(key, page, bytes) from marked pixels (key, page, row, col, r, g, b); what is not listed is white."""
    write = WRITERS[kind]

    def one(page: pd.DataFrame) -> pd.DataFrame:
        rgb = np.full((height, width, 3), 255, dtype=np.uint8)
        rgb[page["row"], page["col"]] = page[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({key: [page[key].iloc[0]], "page": [page["page"].iloc[0]], "bytes": [write(rgb)]})

    return pixels.groupBy(key, "page").applyInPandas(one, f"{key} {pixels.schema[key].dataType.simpleString()}, page long, bytes binary")


def page_path(pattern: str, page: int, pages: int) -> str:
    """The file of a page: a pattern without a number serves one page only."""
    if "%d" in pattern:
        return pattern.replace("%d", str(page))
    if pages > 1:
        raise ValueError("rangecheck: several pages need %d in the path")
    return pattern
