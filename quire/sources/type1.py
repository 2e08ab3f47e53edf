"""Type 1 font programs: decryption, outlines by charstring, and TrueType tables."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from quire.sources.codecs import eexec


class FontError(ValueError):
    pass


def pfb_parts(data: bytes) -> bytes:
    """Segments of a PFB joined; other data as it is."""
    out, i = b"", 0
    while data[i : i + 1] == b"\x80" and data[i + 1 : i + 2] in b"\x01\x02":
        n = struct.unpack_from("<I", data, i + 2)[0]
        out += data[i + 6 : i + 6 + n]
        i += 6 + n
    return out or data


@dataclass
class Type1Font:
    name: str
    charstrings: dict[str, bytes]
    subrs: dict[int, bytes]
    encoding: dict[int, str]
    matrix: tuple[float, ...] = (0.001, 0.0, 0.0, 0.001, 0.0, 0.0)

    @classmethod
    def load(cls, data: bytes) -> Type1Font:
        data = pfb_parts(data)
        at = data.find(b"eexec")
        if not data.startswith(b"%!") or at < 0:
            raise FontError("invalidfont")
        clear, body = data[:at], data[at + 5 :].lstrip(b" \t\r\n")
        if re.fullmatch(rb"[0-9A-Fa-f\s]{8}", body[:8]):
            hexed = re.match(rb"[0-9A-Fa-f\s]*", body)[0]
            body = bytes.fromhex(re.sub(rb"\s", b"", hexed).decode()[: len(re.sub(rb"\s", b"", hexed)) // 2 * 2])
        private = eexec(body)
        skip = re.search(rb"/lenIV\s+(-?\d+)", private)
        skip = int(skip[1]) if skip else 4
        plain = lambda raw: raw if skip < 0 else eexec(raw, 4330, skip)
        subrs, glyphs = {}, {}
        for m in re.finditer(rb"dup\s+(\d+)\s+(\d+)\s+(?:RD|-\|)\s", private):
            subrs[int(m[1])] = plain(private[m.end() : m.end() + int(m[2])])
        start = private.find(b"/CharStrings")
        if start < 0:
            raise FontError("invalidfont")
        pos, pattern = start + 12, re.compile(rb"/([^\s/]+)\s+(\d+)\s+(?:RD|-\|)\s")
        while m := pattern.search(private, pos):
            pos = m.end() + int(m[2])
            glyphs[m[1].decode("latin-1")] = plain(private[m.end() : pos])
        name = re.search(rb"/FontName\s*/(\S+)", clear)
        matrix = re.search(rb"/FontMatrix\s*\[([^\]]*)\]", clear)
        encoding = {int(c): n.decode("latin-1") for c, n in re.findall(rb"dup\s+(\d+)\s*/(\S+)\s+put", clear)}
        return cls(name[1].decode("latin-1") if name else "", glyphs, subrs, encoding, tuple(map(float, matrix[1].split())) if matrix else cls.matrix)


@dataclass
class Outline:
    width: float = 0.0
    points: list[tuple[str, tuple[float, ...]]] = field(default_factory=list)  # m, l, c and h with absolute coordinates


class Machine:
    """One charstring: moves, lines, curves, subroutines, flex, hint replacement, blends and accents."""

    def __init__(self, font: Type1Font, weights: tuple[float, ...] = ()):
        self.font, self.weights = font, weights
        self.out, self.x, self.y = Outline(), 0.0, 0.0
        self.stack: list[float] = []
        self.post: list[float] = []
        self.flex: list[tuple[float, float]] | None = None
        self.done, self.depth, self.sidebearing = False, 0, 0.0

    def take(self, n: int) -> list[float]:
        if len(self.stack) < n:
            raise FontError("stackunderflow")
        out = self.stack[-n:] if n else []
        del self.stack[len(self.stack) - n :]
        return out

    def to(self, dx: float, dy: float, op: str) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        if op == "m" and self.flex is not None:
            self.flex.append((self.x, self.y))
        else:
            self.out.points.append((op, (self.x, self.y)))

    def curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        p = [self.x + a, self.y + b]
        p += [p[0] + c, p[1] + d]
        p += [p[2] + e, p[3] + f]
        self.x, self.y = p[4], p[5]
        self.out.points.append(("c", tuple(p)))

    def run(self, code: bytes) -> None:
        self.depth += 1
        if self.depth > 10:
            raise FontError("limitcheck")
        i = 0
        while i < len(code) and not self.done:
            b = code[i]
            i += 1
            if b >= 32:
                if b <= 246:
                    self.stack.append(b - 139)
                elif b <= 250:
                    self.stack.append((b - 247) * 256 + code[i] + 108)
                    i += 1
                elif b <= 254:
                    self.stack.append(-(b - 251) * 256 - code[i] - 108)
                    i += 1
                else:
                    self.stack.append(struct.unpack_from(">i", code, i)[0])
                    i += 4
                if len(self.stack) > 48:
                    raise FontError("stackoverflow")
            elif b == 11:
                break
            elif b == 12:
                self.escape(code[i])
                i += 1
            else:
                self.operate(b)
        self.depth -= 1

    def operate(self, b: int) -> None:
        if b == 10:
            n = int(self.take(1)[0])
            if n not in self.font.subrs:
                raise FontError("rangecheck")
            self.run(self.font.subrs[n])
            return
        if b == 13:
            sb, self.out.width = self.take(2)
            self.x, self.sidebearing = sb, sb
        elif b in (1, 3):
            pass
        elif b == 4:
            self.to(0.0, self.take(1)[0], "m")
        elif b == 5:
            self.to(*self.take(2), "l")
        elif b == 6:
            self.to(self.take(1)[0], 0.0, "l")
        elif b == 7:
            self.to(0.0, self.take(1)[0], "l")
        elif b == 8:
            self.curve(*self.take(6))
        elif b == 9:
            self.out.points.append(("h", ()))
        elif b == 14:
            self.done = True
        elif b == 21:
            self.to(*self.take(2), "m")
        elif b == 22:
            self.to(self.take(1)[0], 0.0, "m")
        elif b == 30:
            a, c, d, e = self.take(4)
            self.curve(0.0, a, c, d, e, 0.0)
        elif b == 31:
            a, c, d, e = self.take(4)
            self.curve(a, 0.0, c, d, 0.0, e)
        else:
            raise FontError("undefined")
        self.stack.clear()

    def escape(self, b: int) -> None:
        if b == 12:
            x, y = self.take(2)
            if not y:
                raise FontError("undefinedresult")
            self.stack.append(x / y)
        elif b == 16:
            n = int(self.take(1)[0])
            args = self.take(int(self.take(1)[0]))
            self.other(n, args)
        elif b == 17:
            if not self.post:
                raise FontError("stackunderflow")
            self.stack.append(self.post.pop())
        elif b == 7:
            sx, sy, self.out.width, _ = self.take(4)
            self.x, self.y, self.sidebearing = sx, sy, sx
            self.stack.clear()
        elif b == 33:
            self.x, self.y = self.take(2)
            self.stack.clear()
        elif b == 6:
            asb, adx, ady, base, accent = self.take(5)
            self.seac(asb, adx, ady, int(base), int(accent))
        elif b in (0, 1, 2):
            self.stack.clear()
        else:
            raise FontError("undefined")

    def other(self, n: int, args: list[float]) -> None:
        if n == 1:
            self.flex = []
        elif n == 2:
            pass
        elif n == 0:
            p, self.flex = self.flex or [], None
            if len(p) != 7:
                raise FontError("rangecheck")
            self.out.points += [("c", (*p[1], *p[2], *p[3])), ("c", (*p[4], *p[5], *p[6]))]
            self.post = list(args[1:][::-1])
        elif n == 3:
            self.post = [3.0]
        elif 14 <= n <= 18:
            k = {14: 1, 15: 2, 16: 3, 17: 4, 18: 6}[n]
            m = len(self.weights)
            if not m or len(args) != k * m:
                raise FontError("rangecheck")
            base, deltas = args[:k], args[k:]
            self.post = [base[i] + sum(w * d for w, d in zip(self.weights[1:], deltas[i * (m - 1) : (i + 1) * (m - 1)])) for i in range(k)][::-1]
        else:
            self.post = list(args[::-1])

    def seac(self, asb: float, adx: float, ady: float, base: int, accent: int) -> None:
        names = self.font.encoding
        width, sb, parts = self.out.width, self.sidebearing, []
        for code, dx, dy in ((base, 0.0, 0.0), (accent, sb + adx - asb, ady)):
            m = Machine(self.font, self.weights)
            if names.get(code) not in self.font.charstrings or self.depth > 4:
                raise FontError("invalidfont")
            m.depth = self.depth
            m.run(self.font.charstrings[names[code]])
            parts += [(op, tuple(v + (dx, dy)[i % 2] for i, v in enumerate(p))) for op, p in m.out.points]
        self.out = Outline(width, parts)
        self.done = True


def glyph_outline(font: Type1Font, name: str, weights: tuple[float, ...] = ()) -> Outline:
    if name not in font.charstrings:
        raise FontError("undefined")
    m = Machine(font, weights)
    m.run(font.charstrings[name])
    return m.out


# -- TrueType -------------------------------------------------------------------------------------


def sfnt_tables(data: bytes) -> dict[str, tuple[int, int, int]]:
    """Tag to (checksum, offset, length)."""
    n = struct.unpack_from(">H", data, 4)[0]
    return {data[12 + 16 * i : 16 + 16 * i].decode("latin-1"): struct.unpack_from(">III", data, 16 + 16 * i) for i in range(n)}


def sfnt_checksum(data: bytes) -> int:
    data += b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def write_sfnt(tables: dict[str, bytes], version: int = 0x00010000) -> bytes:
    n = len(tables)
    power = 1 << (n.bit_length() - 1)
    out = struct.pack(">IHHHH", version, n, power * 16, power.bit_length() - 1, n * 16 - power * 16)
    at, body = 12 + 16 * n, b""
    for tag, data in sorted(tables.items()):
        out += tag.encode("latin-1") + struct.pack(">III", sfnt_checksum(data), at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return out + body


def subset_truetype(data: bytes, keep: set[int]) -> bytes:
    """The font with the outlines of unused glyphs emptied; glyph numbers stay, parts of composites are kept."""
    dirs = sfnt_tables(data)
    table = {t: data[o : o + n] for t, (_, o, n) in dirs.items()}
    long_ = struct.unpack_from(">h", table["head"], 50)[0]
    count = struct.unpack_from(">H", table["maxp"], 4)[0]
    loca = list(struct.unpack_from(f">{count + 1}I", table["loca"])) if long_ else [2 * x for x in struct.unpack_from(f">{count + 1}H", table["loca"])]
    glyf = table["glyf"]
    todo, used = list(keep | {0}), set()
    while todo:
        g = todo.pop()
        if g in used or not 0 <= g < count:
            continue
        used.add(g)
        body = glyf[loca[g] : loca[g + 1]]
        if len(body) > 10 and struct.unpack_from(">h", body)[0] < 0:
            i = 10
            while True:
                flags, part = struct.unpack_from(">HH", body, i)
                todo.append(part)
                i += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
                if not flags & 0x20:
                    break
    out, offsets = b"", [0]
    for g in range(count):
        if g in used:
            body = glyf[loca[g] : loca[g + 1]]
            out += body + b"\0" * (-len(body) % 4)
        offsets.append(len(out))
    table["glyf"] = out
    table["loca"] = struct.pack(f">{count + 1}I", *offsets)
    table["head"] = table["head"][:50] + struct.pack(">h", 1) + table["head"][52:]
    return write_sfnt(table)
