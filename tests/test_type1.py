import struct

import pytest

from quire.sources import type1 as T
from quire.sources.codecs import eexec_encrypt


def num(n):
    return bytes([n + 139]) if -107 <= n <= 107 else b"\xff" + struct.pack(">i", n)


def code(*parts):
    return b"".join(num(p) if isinstance(p, int) else p for p in parts)


HSBW, RMOVE, RLINE, HLINE, VLINE, CURVE, CLOSE, END, CALL, RET = (bytes([b]) for b in (13, 21, 5, 6, 7, 8, 9, 14, 10, 11))
DIV, OTHER, POP, SEAC = (bytes([12, b]) for b in (12, 16, 17, 6))


def make(glyphs, subrs=()):
    enc = lambda raw: eexec_encrypt(raw, 4330)
    body = b"dup /Private /lenIV 4 def /Subrs %d array\n" % len(subrs)
    for i, s in enumerate(subrs):
        body += b"dup %d %d RD " % (i, len(enc(s))) + enc(s) + b" NP\n"
    body += b"/CharStrings %d dict dup begin\n" % len(glyphs)
    for n, g in glyphs.items():
        body += b"/%s %d RD " % (n.encode(), len(enc(g))) + enc(g) + b" ND\n"
    return b"%!PS-AdobeFont-1.0\n/FontName /Made def /FontMatrix [0.001 0 0 0.001 0 0] def\n/Encoding 256 array dup 65 /A put dup 193 /acute put def currentfile eexec\n" + eexec_encrypt(body + b"end mark currentfile closefile")


def test_outlines():
    square = code(50, 600, HSBW, 0, 0, RMOVE, 100, HLINE, 200, VLINE, -100, HLINE, CLOSE, END)
    font = T.Type1Font.load(make({"A": square, "B": code(0, 500, HSBW, 10, 3, DIV, 7, RMOVE, 0, CALL, END), "acute": code(20, 300, HSBW, 5, 5, RMOVE, 1, 2, RLINE, CLOSE, END), "Aacute": code(50, 600, HSBW, 20, 30, 40, 65, 193, SEAC)}, [code(1, 2, 3, 4, 5, 6, CURVE, RET)]))
    assert font.name == "Made" and set(font.charstrings) == {"A", "B", "acute", "Aacute"}
    a = T.glyph_outline(font, "A")
    assert a.width == 600 and a.points == [("m", (50.0, 0.0)), ("l", (150.0, 0.0)), ("l", (150.0, 200.0)), ("l", (50.0, 200.0)), ("h", ())]
    b = T.glyph_outline(font, "B")
    assert b.points[0] == ("m", (10 / 3, 7.0)) and b.points[1][0] == "c"
    accented = T.glyph_outline(font, "Aacute")
    assert accented.width == 600 and accented.points[5] == ("m", (20 + 5 + 50 + 30 - 20, 45.0))
    with pytest.raises(T.FontError):
        T.glyph_outline(font, "none")
    with pytest.raises(T.FontError):
        T.Type1Font.load(b"no font")


def test_flex_blend_and_hints():
    flex = code(0, 500, HSBW, 0, 1, OTHER)
    for dx, dy in ((5, 0), (1, 1), (1, 1), (1, 1), (1, -1), (1, -1), (1, -1)):
        flex += code(dx, dy, RMOVE, 0, 2, OTHER)
    flex += code(50, 11, 0, 3, 0, OTHER, POP, POP, bytes([12, 33]), END)
    blend = code(0, 500, HSBW, 100, 20, 2, 14, OTHER, POP, HLINE, END)
    font = T.Type1Font.load(make({"F": flex, "M": blend, "H": code(0, 500, HSBW, 1, 1, 3, OTHER, POP, CALL, END)}, [b"", b"", b"", code(7, HLINE, RET)]))
    assert [p[0] for p in T.glyph_outline(font, "F").points] == ["c", "c"] and T.glyph_outline(font, "F").points[1][1][4:] == (11.0, 0.0)
    assert T.glyph_outline(font, "M", (0.5, 0.5)).points == [("l", (110.0, 0.0))]
    assert T.glyph_outline(font, "H").points == [("l", (7.0, 0.0))]


def test_truetype_subset_keeps_parts():
    simple = struct.pack(">hhhhh", 1, 0, 0, 10, 10) + b"\0\0" * 3
    composite = struct.pack(">hhhhh", -1, 0, 0, 10, 10) + struct.pack(">HHbb", 2, 3, 0, 0)
    glyphs = [simple, simple, composite, simple]
    at = [0]
    for g in glyphs:
        at.append(at[-1] + len(g))
    tables = {"head": bytes(50) + struct.pack(">h", 1) + bytes(2), "maxp": struct.pack(">IH", 0x10000, 4), "loca": struct.pack(">5I", *at), "glyf": b"".join(glyphs)}
    out = T.subset_truetype(T.write_sfnt(tables), {2})
    dirs = T.sfnt_tables(out)
    loca = struct.unpack_from(">5I", out, dirs["loca"][1])
    assert [loca[i + 1] > loca[i] for i in range(4)] == [True, False, True, True]
    assert all(T.sfnt_checksum(out[o : o + n]) == c for c, o, n in dirs.values())
