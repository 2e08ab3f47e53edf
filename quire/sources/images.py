"""Image objects to pixels: samples through their colour space, and every kind of mask as one plane of alpha."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from quire.sources.codecs import SHORT, FilterError
from quire.sources.graphics import Fault
from quire.sources.pdf import Document, Stream

#: Nested colour spaces, and pixels of one image, at most.
DEPTH, MOST_PIXELS = 8, 40_000_000


@dataclass
class Space:
    """Components a pixel, and values (n, components) of 0 to 1 (indexed: the index) to red, green, blue (n, 3)."""

    size: int
    rgb: Callable[[np.ndarray], np.ndarray]
    indexed: bool = False


def _gray(v: np.ndarray) -> np.ndarray:
    return np.repeat(v, 3, axis=1)


def _cmyk(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 0, 1)
    return (1 - v[:, :3]) * (1 - v[:, 3:])


DEVICE = {"DeviceGray": Space(1, _gray), "DeviceRGB": Space(3, lambda v: v), "DeviceCMYK": Space(4, _cmyk), "G": Space(1, _gray), "RGB": Space(3, lambda v: v), "CMYK": Space(4, _cmyk)}


def _tint(doc: Document, function, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """An exponential tint transform; any other one gives black."""
    f = doc.get(function)
    d = f.dict if isinstance(f, Stream) else f or {}
    if d.get("FunctionType") != 2:
        return lambda v: np.full((len(v), size), np.nan)
    c0, c1 = (np.array([float(doc.get(x)) for x in doc.get(d.get(k)) or default]) for k, default in (("C0", [0.0]), ("C1", [1.0])))
    power = float(doc.get(d.get("N", 1)))
    return lambda v: c0 + np.clip(v[:, :1], 0, 1) ** power * (c1 - c0)


def space_of(doc: Document, value, named: dict | None = None, depth: int = 0) -> Space:
    """A colour space by name or array; ``named``: those of the page's resources. What is none of the known ones is ``undefined``."""
    value = doc.get(value)
    if depth > DEPTH:
        raise Fault("undefined")
    if isinstance(value, str):
        if value in DEVICE:
            return DEVICE[value]
        if named and value in named:
            return space_of(doc, named[value], None, depth + 1)
        raise Fault("undefined")
    if not isinstance(value, list) or not value:
        raise Fault("undefined")
    head = doc.get(value[0])
    if head in DEVICE and len(value) == 1:
        return DEVICE[head]
    if head in ("CalRGB", "CalGray"):  # white point, gamma and matrix don't matter to the preview
        return DEVICE["DeviceRGB" if head == "CalRGB" else "DeviceGray"]
    if head == "ICCBased" and len(value) == 2:
        profile = doc.get(value[1])
        if not isinstance(profile, Stream):
            raise Fault("undefined")
        n = doc.get(profile.dict.get("N"))
        if "Alternate" in profile.dict:
            other = space_of(doc, profile.dict["Alternate"], None, depth + 1)
            if other.size == n or n is None:
                return other
        if n not in (1, 3, 4):
            raise Fault("undefined")
        return DEVICE[{1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n]]
    if head in ("Indexed", "I") and len(value) == 4:
        base, top, table = space_of(doc, value[1], named, depth + 1), doc.get(value[2]), doc.get(value[3])
        raw = doc.decode(table) if isinstance(table, Stream) else table
        if not isinstance(raw, bytes) or not isinstance(top, int) or not 0 <= top <= 255 or len(raw) < (top + 1) * base.size or base.indexed:
            raise Fault("undefined")
        colours = base.rgb(np.frombuffer(raw, dtype=np.uint8)[: (top + 1) * base.size].reshape(-1, base.size) / 255)
        return Space(1, lambda v: colours[np.clip(v[:, 0].astype(int), 0, top)], True)
    if head in ("Separation", "DeviceN") and len(value) >= 4:
        names = doc.get(value[1])
        other = space_of(doc, value[2], named, depth + 1)
        tint = _tint(doc, value[3], other.size)
        return Space(len(names) if head == "DeviceN" else 1, lambda v: np.nan_to_num(other.rgb(tint(v)), nan=0.0))
    raise Fault("undefined")


def _entry(doc: Document, image: Stream, long: str, short: str):
    return doc.get(image.dict.get(long, image.dict.get(short)))


def _size(doc: Document, image: Stream) -> tuple[int, int]:
    w, h = _entry(doc, image, "Width", "W"), _entry(doc, image, "Height", "H")
    if not (isinstance(w, int) and isinstance(h, int) and w > 0 and h > 0):
        raise Fault("undefined")
    if w * h > MOST_PIXELS:
        raise Fault("limitcheck")
    return w, h


def _bytes(doc: Document, image: Stream) -> bytes:
    try:
        return doc.decode(image)
    except FilterError as e:
        raise Fault("undefined" if str(e) == "unsupported" else str(e)) from None


def _ranges(doc: Document, image: Stream, n: int) -> np.ndarray | None:
    d = _entry(doc, image, "Decode", "D")
    if d is None:
        return None
    if not isinstance(d, list) or len(d) != 2 * n:
        raise Fault("undefined")
    return np.array([float(doc.get(x)) for x in d]).reshape(n, 2)


def to_byte(v: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)


def stencil(doc: Document, image: Stream) -> np.ndarray:
    """One bit a sample to alpha (height, width): a decoded value of a half or more paints."""
    w, h = _size(doc, image)
    bits = _entry(doc, image, "BitsPerComponent", "BPC")
    raw = _bytes(doc, image)
    if bits not in (None, 1) or len(raw) != (w + 7) // 8 * h:
        raise Fault("undefined")
    r = _ranges(doc, image, 1)
    low, high = (0.0, 1.0) if r is None else r[0]
    bit = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(h, -1), axis=1)[:, :w]
    return np.where(low + bit * (high - low) >= 0.5, 255, 0).astype(np.uint8)


def is_stencil(doc: Document, image: Stream) -> bool:
    return _entry(doc, image, "ImageMask", "IM") is True


def _samples(doc: Document, image: Stream, named: dict | None) -> tuple[np.ndarray, Space]:
    w, h = _size(doc, image)
    if _entry(doc, image, "BitsPerComponent", "BPC") != 8:
        raise Fault("undefined")
    space = space_of(doc, image.dict.get("ColorSpace", image.dict.get("CS")), named)
    raw = np.frombuffer(_bytes(doc, image), dtype=np.uint8)
    if len(raw) != w * h * space.size:
        raise Fault("undefined")
    v = raw.reshape(-1, space.size).astype(np.float64)
    r = _ranges(doc, image, space.size)
    if space.indexed:
        if r is not None:
            raise Fault("undefined")
        return v, space
    v /= 255
    return (v if r is None else r[:, 0] + v * (r[:, 1] - r[:, 0])), space


def combine(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    """The product of two planes; None is opaque."""
    if a is None or b is None:
        return b if a is None else a
    return (a.astype(np.uint16) * b // 255).astype(np.uint8)


def _plane(doc: Document, mask: Stream, w: int, h: int) -> np.ndarray:
    if is_stencil(doc, mask):
        out = stencil(doc, mask)
    else:
        v, space = _samples(doc, mask, None)
        if space.size != 1:
            raise Fault("undefined")
        out = to_byte(v[:, 0]).reshape(_size(doc, mask)[::-1])
    if out.shape != (h, w):
        raise Fault("undefined")
    return out


def pixels(doc: Document, image: Stream, colour: tuple[float, float, float] = (0.0, 0.0, 0.0), named: dict | None = None) -> np.ndarray:
    """(height, width, 4) bytes: the image in preview RGB with its masks as alpha; a stencil in ``colour``."""
    filters = _entry(doc, image, "Filter", "F")
    last = filters[-1] if isinstance(filters, list) and filters else filters
    if SHORT.get(last, last) in ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"):
        raise Fault("undefined")
    w, h = _size(doc, image)
    out = np.empty((h, w, 4), dtype=np.uint8)
    if is_stencil(doc, image):
        out[..., :3], out[..., 3] = to_byte(np.array(colour)), stencil(doc, image)
        return out
    v, space = _samples(doc, image, named)
    out[..., :3] = to_byte(space.rgb(v)).reshape(h, w, 3)
    alpha, mask, soft = None, doc.get(image.dict.get("Mask")), doc.get(image.dict.get("SMask"))
    if isinstance(mask, list):
        if len(mask) != 2 * space.size:
            raise Fault("undefined")
        r = np.sort(np.array([float(doc.get(x)) for x in mask]).reshape(-1, 2), axis=1)
        alpha = np.where(((v >= r[:, 0]) & (v <= r[:, 1])).all(axis=1), 0, 255).astype(np.uint8).reshape(h, w)
    elif isinstance(mask, Stream):
        alpha = _plane(doc, mask, w, h)
    elif mask is not None:
        raise Fault("undefined")
    alpha = combine(alpha, _plane(doc, soft, w, h) if isinstance(soft, Stream) else None)
    out[..., 3] = 255 if alpha is None else alpha
    return out
