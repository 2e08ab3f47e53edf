"""Graphics state shared by the two page languages. Painting emits marks: rows that the raster joins take."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667,
    611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
STANDARD_FONTS = ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Helvetica", "Helvetica-Oblique")


class Fault(ValueError):
    """A named error of a page program."""


def width_of(font: str, code: int) -> float | None:
    """Thousandths of an em, where the metrics of the font are known here."""
    if font.startswith("Courier"):
        return 600.0
    if font.startswith("Helvetica") and 32 <= code < 127:
        return float(HELVETICA[code - 32])
    return None


def multiply(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def invert(m: tuple) -> tuple:
    a, b, c, d, e, f = m
    det = a * d - b * c
    if not det:
        raise Fault("undefinedresult")
    return (d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)


@dataclass(frozen=True)
class State:
    ctm: tuple = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    color: tuple = (0.0, 0.0, 0.0)
    width: float = 1.0
    cap: int = 0
    alpha: float = 1.0
    mode: str = "Normal"
    clips: tuple = ()
    font: tuple = ("", 0.0)
    spacing: tuple = (0.0, 0.0, 1.0, 0.0, 0.0)  # Tc Tw Tz TL Ts
    space: str = "DeviceGray"


def byte(v: float) -> int:
    return math.floor(max(0.0, min(1.0, v)) * 255 + 0.5)


@dataclass
class Canvas:
    """The current path and state; ``marks``: (page, seq, op, points, r, g, b, half width, alpha, mode, clips)."""

    state: State = field(default_factory=State)
    stack: list[State] = field(default_factory=list)
    path: list[tuple[float, float, bool]] = field(default_factory=list)
    marks: list[tuple] = field(default_factory=list)
    page: int = 1

    def set(self, **changes: object) -> None:
        self.state = replace(self.state, **changes)

    def save(self) -> None:
        if len(self.stack) >= 32:
            raise Fault("limitcheck")
        self.stack.append(self.state)

    def restore(self) -> None:
        if not self.stack:
            raise Fault("limitcheck")
        self.state = self.stack.pop()

    def point(self) -> tuple[float, float]:
        if not self.path:
            raise Fault("nocurrentpoint")
        return self.path[-1][:2]

    def move(self, x: float, y: float) -> None:
        self.path.append((*apply(self.state.ctm, x, y), True))

    def line(self, x: float, y: float) -> None:
        self.point()
        self.path.append((*apply(self.state.ctm, x, y), False))

    def relative(self, dx: float, dy: float, move: bool = False) -> None:
        x, y = self.point()
        a, b, c, d, _, _ = self.state.ctm
        self.path.append((x + a * dx + c * dy, y + b * dx + d * dy, move))

    def close(self) -> None:
        start = next((p for p in reversed(self.path) if p[2]), None)
        if start is None:
            raise Fault("nocurrentpoint")
        self.path.append((start[0], start[1], False))

    def rect(self, x: float, y: float, w: float, h: float) -> list[tuple[float, float, bool]]:
        pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        return [(*apply(self.state.ctm, *p), i == 0) for i, p in enumerate(pts)]

    def arc(self, x: float, y: float, r: float, a: float, b: float, down: bool = False) -> None:
        if r < 0:
            raise Fault("rangecheck")
        sweep = b - a
        if not down:
            sweep = sweep % 360 if sweep < 0 or sweep > 360 else sweep
        else:
            sweep = -((-sweep) % 360) if sweep > 0 or sweep < -360 else sweep
        steps = max(1, math.ceil(abs(sweep) / 6))
        for i in range(steps + 1):
            t = math.radians(a + sweep * i / steps)
            px, py = x + r * math.cos(t), y + r * math.sin(t)
            (self.line if i or self.path else self.move)(px, py)

    def paint(self, op: str, points: list | None = None, keep: bool = False) -> None:
        s, pts = self.state, self.path if points is None else points
        if pts:
            half = s.width * math.hypot(s.ctm[0], s.ctm[1]) / 2
            self.marks.append((self.page, len(self.marks), op, list(pts), *map(byte, s.color), half if op == "stroke" else 0.0, s.alpha, s.mode, s.clips))
        if points is None and not keep:
            self.path = []

    def clip(self, even_odd: bool = False) -> None:
        if self.path:
            self.set(clips=(*self.state.clips, (even_odd, tuple(self.path))))
