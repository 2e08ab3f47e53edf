"""PDF page content: operators to marks, and text to glyph rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators.layout import text_of
from quire.sources import images
from quire.sources.codecs import FilterError
from quire.sources.graphics import Canvas, Fault, multiply, width_of
from quire.sources.pdf import Document, Keyword, Lexer, Made, PdfError, Stream, each_file
from quire.sources.postscript import _curve, mark_table

BLENDS = ("Normal", "Compatible", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion")


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Codes to text from bfchar and bfrange sections."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h + "0" * (len(h) % 2)).decode("utf-16-be", "replace")
    body = cmap.decode("latin-1")
    for part in re.findall(r"beginbfchar(.*?)endbfchar", body, re.S):
        for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", part):
            out[int(a, 16)] = text(b)
    for part in re.findall(r"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            lo, hi = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
            listed = re.findall(r"<([0-9A-Fa-f]*)>", many)
            for i in range(lo, hi + 1):
                if many and i - lo < len(listed):
                    out[i] = text(listed[i - lo])
                elif c:
                    t = text(c)
                    out[i] = t[:-1] + chr(ord(t[-1]) + i - lo) if t else ""
    return out


class Font:
    """Codes, widths and text of one font resource."""

    def __init__(self, doc: Document, d: dict):
        self.name = str(d.get("BaseFont", ""))
        self.wide = d.get("Subtype") == "Type0"
        self.first, self.widths, self.default = int(doc.get(d.get("FirstChar")) or 0), [doc.get(w) for w in doc.get(d.get("Widths")) or []], None
        desc = doc.get(d.get("FontDescriptor")) or {}
        self.missing = desc.get("MissingWidth")
        self.cids: dict[int, float] = {}
        if self.wide:
            cid = doc.get((doc.get(d.get("DescendantFonts")) or [None])[0]) or {}
            self.default = float(doc.get(cid.get("DW")) or 1000)
            w = [doc.get(x) for x in doc.get(cid.get("W")) or []]
            i = 0
            while i + 1 < len(w):
                if isinstance(w[i + 1], list):
                    self.cids |= {w[i] + k: float(doc.get(x)) for k, x in enumerate(w[i + 1])}
                    i += 2
                else:
                    self.cids |= {c: float(w[i + 2]) for c in range(w[i], min(w[i + 1], w[i] + 65535) + 1)}
                    i += 3
        cmap = doc.get(d.get("ToUnicode"))
        self.text = to_unicode(doc.decode(cmap)) if isinstance(cmap, Stream) else {}

    def codes(self, s: bytes) -> np.ndarray:
        if not self.wide:
            return np.frombuffer(s, dtype=np.uint8).astype(np.int64)
        whole = np.frombuffer(s[: len(s) // 2 * 2], dtype=">u2").astype(np.int64)
        return np.append(whole, s[-1]) if len(s) % 2 else whole

    def advances(self, codes: np.ndarray) -> np.ndarray:
        if self.wide and not self.cids:
            return np.full(len(codes), self.default)
        kinds, which = np.unique(codes, return_inverse=True)
        return np.array([self.width(c) for c in kinds.tolist()], dtype=float)[which]

    def texts(self, codes: np.ndarray) -> list[str]:
        if self.text or codes.min() < 32 or codes.max() >= 0xD800:
            return [self.unicode(c) for c in codes.tolist()]
        return list(codes.astype("<u2").tobytes().decode("utf-16-le"))

    def width(self, code: int) -> float:
        if self.wide:
            return self.cids.get(code, self.default)
        if 0 <= code - self.first < len(self.widths) and isinstance(self.widths[code - self.first], (int, float)):
            return float(self.widths[code - self.first])
        if isinstance(self.missing, (int, float)):
            return float(self.missing)
        return width_of(self.name, code) or 0.0

    def unicode(self, code: int) -> str:
        if code in self.text:
            return self.text[code]
        return chr(code) if 32 <= code < 0xD800 else ""


class Page:
    def __init__(self, doc: Document, page: dict, number: int):
        self.doc, self.canvas, self.number = doc, Canvas(page=number), number
        self.resources = doc.get(page.get("Resources")) or {}
        self.fonts: dict[str, Font] = {}
        self.shown: list[tuple] = []  # a string each: codes, text, x, y, widths, height, font, size
        self.events: list[tuple] = []
        self.tm = self.tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        self.depth = self.hidden = 0
        self.space: images.Space | None = None
        self.open: list[bool] = []
        root = doc.get(doc.trailer["Root"]) or {}
        config = (doc.get((doc.get(root.get("OCProperties")) or {}).get("D"))) or {}
        self.off = {r.num for r in doc.get(config.get("OFF")) or [] if hasattr(r, "num")}

    def resource(self, kind: str, name: str):
        return self.doc.get((self.doc.get(self.resources.get(kind)) or {}).get(name))

    def run(self, data: bytes) -> None:
        lex, args, skip = Lexer(data), [], 0
        while (v := lex.value()) is not None:
            if not isinstance(v, Keyword):
                args.append(v)
                continue
            if v == "BX":
                skip += 1
            elif v == "EX":
                skip -= 1
            elif not skip:
                self.take(str(v), args)
            args = []
        if skip > 0:
            raise Fault("syntaxerror")

    def numbers(self, args: list, n: int) -> list[float]:
        if len(args) < n:
            raise Fault("stackunderflow")
        args = args[len(args) - n :]
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in args):
            raise Fault("typecheck")
        return [float(x) for x in args]

    def take(self, op: str, args: list) -> None:
        c = self.canvas
        if self.hidden and op not in ("BMC", "BDC", "EMC"):
            return
        if op in ("BMC", "BDC"):
            props = args[-1] if op == "BDC" and args else None
            target = (self.doc.get(self.resources.get("Properties")) or {}).get(props) if isinstance(props, str) else None
            d = props if isinstance(props, dict) else self.doc.get(target) or {}
            off = self.is_hidden(target) or isinstance(d, dict) and (self.is_hidden(d["OC"]) if "OC" in d else self.is_hidden(d))
            self.open.append(off)
            self.hidden += off
            self.events.append((len(self.events), "begin", str(args[0]) if args else "", d.get("MCID") if isinstance(d, dict) else None))
            return
        if op == "EMC":
            if not self.open:
                raise Fault("syntaxerror")
            self.hidden -= self.open.pop()
            self.events.append((len(self.events), "end", "", None))
            return
        plain = {
            "m": (2, c.move), "l": (2, c.line), "c": (6, lambda *p: _curve(c, *p)), "h": (0, c.close), "re": (4, lambda *r: c.path.extend(c.rect(*r))), "n": (0, c.path.clear), "q": (0, c.save), "Q": (0, c.restore),
            "cm": (6, lambda *m: c.set(ctm=multiply(m, c.state.ctm))), "w": (1, lambda w: c.set(width=w)), "J": (1, lambda x: None), "j": (1, lambda x: None), "M": (1, lambda x: None), "i": (1, lambda x: None),
            "RG": (3, lambda *v: c.set(color=v)), "rg": (3, lambda *v: c.set(color=v)), "G": (1, lambda g: c.set(color=(g, g, g))), "g": (1, lambda g: c.set(color=(g, g, g))),
            "Td": (2, self.next_line), "TD": (2, lambda x, y: (self.spacing(3, -y), self.next_line(x, y))), "T*": (0, lambda: self.next_line(0.0, -c.state.spacing[3])), "Tc": (1, lambda v: self.spacing(0, v)), "Tw": (1, lambda v: self.spacing(1, v)),
            "Tz": (1, lambda v: self.spacing(2, v / 100)), "TL": (1, lambda v: self.spacing(3, v)), "Ts": (1, lambda v: self.spacing(4, v)), "Tr": (1, lambda v: None), "ET": (0, lambda: None),
        }
        if op in plain:
            n, f = plain[op]
            f(*self.numbers(args, n))
        elif op in ("K", "k"):
            k = [max(0.0, min(1.0, x)) for x in self.numbers(args, 4)]
            c.set(color=tuple((1 - x) * (1 - k[3]) for x in k[:3]))
        elif op in ("CS", "cs"):
            self.space = images.space_of(self.doc, str(args[-1]) if args else "", self.doc.get(self.resources.get("ColorSpace")) or {})
            c.set(space=str(args[-1]), color=(0.0, 0.0, 0.0))
        elif op in ("SC", "sc", "SCN", "scn"):
            if not args or isinstance(args[-1], str):
                raise Fault("undefined")
            v = self.numbers(args, len(args))
            space = self.space or images.DEVICE.get({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(len(v), ""))
            if space is None or len(v) != space.size:
                raise Fault("undefined")
            c.set(color=tuple(float(x) for x in space.rgb(np.array([v]))[0]))
        elif op in ("S", "s", "f", "f*", "B", "B*", "b", "b*"):
            if op in ("s", "b", "b*") and c.path:
                c.close()
            if op[0] in "fBb":
                c.paint("eofill" if op.endswith("*") else "fill", keep=op[0] in "Bb")
            if op[0] in "SsBb":
                c.paint("stroke")
            self.events.append((len(self.events), "fill" if op[0] == "f" else "stroke", "", None))
        elif op in ("W", "W*"):
            c.clip(op == "W*")
        elif op == "d":
            if len(args) < 2 or not isinstance(args[-2], list):
                raise Fault("typecheck")
        elif op in ("ri", "MP", "DP"):
            pass
        elif op == "gs":
            d = self.resource("ExtGState", str(args[-1]) if args else "")
            if not isinstance(d, dict):
                raise Fault("undefined")
            mode = str(d.get("BM", c.state.mode))
            if mode not in BLENDS or any(d.get(k) is True for k in ("OP", "op", "AIS")) or self.doc.get(d.get("SMask")) not in (None, "None"):
                raise Fault("undefined")  # painting without a mask that is asked for would be wrong
            c.set(mode=mode, alpha=float(d.get("ca", c.state.alpha)), width=float(d.get("LW", c.state.width)))
        elif op == "Do":
            self.xobject(str(args[-1]) if args else "")
        elif op == "BT":
            self.tm = self.tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif op == "Tf":
            name = str(args[0]) if args else ""
            if name not in self.fonts:
                d = self.resource("Font", name)
                if not isinstance(d, dict):
                    raise Fault("undefined")
                self.fonts[name] = Font(self.doc, d)
            c.set(font=(name, self.numbers(args, 1)[0]))
        elif op == "Tm":
            self.tm = self.tlm = tuple(self.numbers(args, 6))
        elif op == "Tj":
            self.show(args[-1] if args else None)
        elif op == "TJ":
            for x in args[-1] if args and isinstance(args[-1], list) else []:
                if isinstance(x, bytes):
                    self.show(x)
                else:
                    self.shift(-self.numbers([x], 1)[0] / 1000 * c.state.font[1] * c.state.spacing[2])
        elif op == "'":
            self.take("T*", [])
            self.show(args[-1] if args else None)
        elif op == '"':
            aw, ac = self.numbers(args[:2], 2)
            self.spacing(1, aw)
            self.spacing(0, ac)
            self.take("'", args[2:])
        else:
            raise Fault("undefined")

    def spacing(self, i: int, v: float) -> None:
        s = list(self.canvas.state.spacing)
        s[i] = v
        self.canvas.set(spacing=tuple(s))

    def next_line(self, x: float, y: float) -> None:
        self.tm = self.tlm = multiply((1.0, 0.0, 0.0, 1.0, x, y), self.tlm)

    def shift(self, x: float) -> None:
        self.tm = multiply((1.0, 0.0, 0.0, 1.0, x, 0.0), self.tm)

    def show(self, s) -> None:
        if not isinstance(s, bytes):
            raise Fault("typecheck")
        name, size = self.canvas.state.font
        font = self.fonts.get(name)
        if font is None:
            raise Fault("invalidfont")
        tc, tw, tz, _, rise = self.canvas.state.spacing
        self.events.append((len(self.events), "text", "", None))
        codes = font.codes(s)
        if not len(codes):
            return
        adv = (font.advances(codes) / 1000 * size + tc) * tz + np.where(codes == 32, tw * tz, 0.0)
        a, b, c, d, e, f = self.tm
        p, q, r, t, u, v = self.canvas.state.ctm
        # places before each glyph and behind the last: added up one by one, as they would be glyph by glyph
        x, y = (np.add.accumulate(np.concatenate(([at], adv * k))) for at, k in ((e, a), (f, b)))
        m = multiply((1.0, 0.0, 0.0, 1.0, 0.0, rise), multiply((a, b, c, d, 0.0, 0.0), (p, q, r, t, 0.0, 0.0)))
        left, base = x[:-1] * p + y[:-1] * r + u, x[:-1] * q + y[:-1] * t + v
        self.shown.append((codes, font.texts(codes), rise * m[2] + left if rise else left, rise * m[3] + base if rise else base, np.abs(m[0] * adv), abs(m[3] * size), font.name, size))
        self.tm = (a, b, c, d, float(x[-1]), float(y[-1]))

    @property
    def glyphs(self) -> list[tuple]:
        """(page, pos, code, text, x, y, width, height, font, size) of each glyph."""
        rows = [(*g, high, name, size) for codes, texts, x, y, wide, high, name, size in self.shown for g in zip(codes.tolist(), texts, x.tolist(), y.tolist(), wide.tolist())]
        return [(self.number, i, *row) for i, row in enumerate(rows)]

    def text(self) -> str:
        """The text of the page in lines, as of ``layout.page_text``."""
        if not self.shown:
            return ""
        _, texts, x, y, wide, high, _, _ = zip(*self.shown)
        sizes = [len(v) for v in x]
        return text_of(np.concatenate(x), np.concatenate(y), np.concatenate(wide), np.repeat(np.array(high, dtype=float), sizes), np.arange(sum(sizes)), [t for part in texts for t in part])

    def is_hidden(self, group) -> bool:
        """Whether an optional content group is off, or the policy of a membership dictionary hides what it marks."""
        if hasattr(group, "num") and group.num in self.off:
            return True
        d = self.doc.get(group)
        members = self.doc.get(d.get("OCGs")) if self.off and isinstance(d, dict) else None
        if not isinstance(members, list) or not members:
            return False
        off = [hasattr(m, "num") and m.num in self.off for m in members]
        return {"AllOn": any(off), "AnyOff": not any(off), "AllOff": not all(off)}.get(str(d.get("P", "AnyOn")), all(off))

    def image(self, x: Stream) -> None:
        """A mark that carries its pixels and the matrix of its unit square."""
        rgba = images.pixels(self.doc, x, self.canvas.state.color, self.doc.get(self.resources.get("ColorSpace")) or {})
        self.canvas.paint("image", self.canvas.rect(0, 0, 1, 1))
        shown = {"w": rgba.shape[1], "h": rgba.shape[0], "rgba": rgba.tobytes(), "m": [float(v) for v in self.canvas.state.ctm]}
        self.canvas.marks[-1] = (*self.canvas.marks[-1], shown)

    def xobject(self, name: str) -> None:
        x = self.resource("XObject", name)
        if not isinstance(x, Stream):
            raise Fault("undefined")
        if "OC" in x.dict and self.is_hidden(x.dict["OC"]):
            return
        if x.dict.get("Subtype") == "Image":
            self.image(x)
            self.events.append((len(self.events), "image", name, None))
            return
        if self.depth >= 16:
            raise Fault("limitcheck")
        outer, marked = self.resources, len(self.open)
        self.depth += 1
        self.canvas.save()
        self.resources = self.doc.get(x.dict.get("Resources")) or outer
        m = self.doc.get(x.dict.get("Matrix"))
        if isinstance(m, list) and len(m) == 6:
            self.canvas.set(ctm=multiply(tuple(float(self.doc.get(v)) for v in m), self.canvas.state.ctm))
        self.run(self.doc.decode(x))
        if len(self.open) != marked:
            raise Fault("syntaxerror")
        self.canvas.restore()
        self.resources = outer
        self.depth -= 1


def interpret(content: bytes) -> tuple[list[Page], str | None]:
    """All pages up to the first error."""
    done: list[Page] = []
    try:
        doc = Document.open(content)
        for i, p in enumerate(doc.pages(), 1):
            page = Page(doc, p, i)
            done.append(page)
            page.run(doc.contents(p))
    except (Fault, PdfError, FilterError) as e:
        return done, str(e)
    except (RecursionError, KeyError, TypeError, IndexError, ValueError):
        return done, "syntaxerror"
    return done, None


def pdf_marks(files: DataFrame | Made) -> DataFrame:
    """Painted shapes of PDF files (doc_id, content), as of ``run_postscript``."""
    def one(content: bytes):
        pages, error = interpret(content)
        whole = Canvas()
        whole.marks = [m for p in pages for m in p.canvas.marks]
        return whole, len(pages), error

    return mark_table(files, one)


_GLYPH = "page long, pos long, code long, tok string, x double, y double, w double, h double, font string, size double, error string"


def pdf_glyphs(files: DataFrame | Made) -> DataFrame:
    """Glyph rows for text layout, one row an error."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.string()]

    def rows_of(content: bytes) -> Iterator[tuple]:
        pages, error = interpret(content)
        for p in pages:
            yield from ((*g, None) for g in p.glyphs)
        if error:
            yield (*[None] * 10, error)

    return each_file(files, _GLYPH, dict(zip((c.split()[0] for c in _GLYPH.split(", ")), kinds)), rows_of)


def pdf_text(files: DataFrame | Made) -> DataFrame:
    """(doc_id, page, txt): the text of each page that has any, up to the first error of a file. A page is laid out where
    it is read: glyphs, many times the size of the text, go nowhere."""
    def rows_of(content: bytes) -> Iterator[tuple]:
        return ((p.number, t) for p in interpret(content)[0] if (t := p.text()))

    return each_file(files, "page long, txt string", {"page": pa.int64(), "txt": pa.string()}, rows_of)
