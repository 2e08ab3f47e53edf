"""A PostScript interpreter for whole programs: mutation, loops without bound, graphics. One row a mark, errors as rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.stack import BANNED, ProgramError, parse
from quire.sources.graphics import STANDARD_FONTS, Canvas, Fault, apply, invert, multiply, width_of
from quire.sources.pdf import Made, each_file

STEPS = 1 << 26
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Exit(Exception):
    pass


class Mark:
    pass


class Name(str):
    """A name; ``exec``: it runs when met."""

    __slots__ = ("exec",)

    def __new__(cls, text: str, exec: bool = False) -> Name:
        self = super().__new__(cls, text)
        self.exec = exec
        return self


class Array(list):
    """Shared by reference; ``exec``: a procedure."""

    def __init__(self, items=(), exec: bool = False):
        super().__init__(items)
        self.exec = exec


def _objects(tokens: list) -> list:
    out = []
    for t in tokens:
        if isinstance(t, list):
            out.append(Array(_objects(t), True))
        elif isinstance(t, tuple):
            out.append(bytearray(t[1].encode("latin-1", "replace")) if t[0] == "str" else Name(t[1], t[0] == "name"))
        else:
            out.append(t)
    return out


def show_real(x: float) -> str:
    text = repr(float(x))
    return text if any(c in text for c in ".ein") else text + ".0"


class Interpreter:
    def __init__(self, steps: int = STEPS):
        self.stack: list = []
        self.dicts: list[dict] = [{}]
        self.canvas, self.steps, self.left = Canvas(), 0, steps
        self.shown = 0

    def run(self, text: str) -> None:
        try:
            self.execute(_objects(parse(text)))
        except Exit:
            raise Fault("invalidexit") from None
        except ProgramError as e:
            raise Fault(e.name) from None
        except RecursionError:
            raise Fault("limitcheck") from None

    def execute(self, body: list) -> None:
        for t in body:
            self.left -= 1
            if self.left < 0:
                raise Fault("limitcheck")
            if isinstance(t, Name) and t.exec:
                self.name(str(t))
            else:
                self.stack.append(t)

    def name(self, n: str) -> None:
        for d in reversed(self.dicts):
            if n in d:
                v = d[n]
                self.call(v) if isinstance(v, Array) and v.exec else self.stack.append(v)
                return
        if n in BANNED:
            raise Fault("invalidaccess")
        op = OPS.get(n)
        if op is None:
            raise Fault("undefined")
        op(self)

    def call(self, v) -> None:
        if isinstance(v, Array) and v.exec:
            self.execute(v)
        elif isinstance(v, Name) and v.exec:
            self.name(str(v))
        else:
            self.stack.append(v)

    def pop(self, *kinds: type):
        if not self.stack:
            raise Fault("stackunderflow")
        v = self.stack.pop()
        if kinds and (not isinstance(v, kinds) or isinstance(v, bool) and bool not in kinds):
            raise Fault("typecheck")
        return v

    def num(self) -> float:
        return self.pop(int, float)

    def nums(self, n: int) -> list[float]:
        if len(self.stack) < n:
            raise Fault("stackunderflow")
        return [self.num() for _ in range(n)][::-1]

    def push(self, *v) -> None:
        self.stack += v

    def whole(self, v: int) -> None:
        if not -(1 << 31) <= v < 1 << 31:
            raise Fault("rangecheck")
        self.stack.append(v)

    def to_mark(self) -> list:
        for i in range(len(self.stack) - 1, -1, -1):
            if isinstance(self.stack[i], Mark):
                out = self.stack[i + 1 :]
                del self.stack[i:]
                return out
        raise Fault("unmatchedmark")

    def loop(self, proc: Array, feed) -> None:
        for items in feed:
            self.push(*items)
            try:
                self.call(proc)
            except Exit:
                return


OPS: dict = {}


def op(*names: str):
    def add(f):
        for n in names:
            OPS[n] = f
        return f

    return add


def _simple(name: str, n: int, f) -> None:
    """An operator that pops ``n`` numbers and pushes what ``f`` gives."""
    def run(m: Interpreter) -> None:
        v = f(*m.nums(n))
        m.whole(v) if isinstance(v, int) and not isinstance(v, bool) else m.push(v)

    OPS[name] = run


def _div(a, b):
    if b == 0:
        raise Fault("undefinedresult")
    return float(a) / b


def _whole(f):
    def g(a, b):
        if not isinstance(a, int) or not isinstance(b, int):
            raise Fault("typecheck")
        if b == 0:
            raise Fault("undefinedresult")
        return f(a, b)

    return g


def _sqrt(a):
    if a < 0:
        raise Fault("undefinedresult")
    return math.sqrt(a)


def _keep(f):
    return lambda a: a if isinstance(a, int) else float(f(a))


for _n, _k, _f in (
    ("add", 2, lambda a, b: a + b), ("sub", 2, lambda a, b: a - b), ("mul", 2, lambda a, b: a * b), ("div", 2, _div), ("idiv", 2, _whole(lambda a, b: int(math.copysign(1, a) * math.copysign(1, b)) * (abs(a) // abs(b)))),
    ("mod", 2, _whole(lambda a, b: int(math.fmod(a, b)))), ("neg", 1, lambda a: -a), ("abs", 1, abs), ("ceiling", 1, _keep(math.ceil)), ("floor", 1, _keep(math.floor)), ("round", 1, _keep(lambda a: math.floor(a + 0.5))), ("sqrt", 1, _sqrt),
    ("cos", 1, lambda a: math.cos(math.radians(a))), ("sin", 1, lambda a: math.sin(math.radians(a))), ("gt", 2, lambda a, b: a > b), ("ge", 2, lambda a, b: a >= b), ("lt", 2, lambda a, b: a < b), ("le", 2, lambda a, b: a <= b),
):
    _simple(_n, _k, _f)

for _n, _v in (("true", True), ("false", False), ("null", None), ("languagelevel", 2), ("revision", 1), ("serialnumber", 0)):
    OPS[_n] = lambda m, v=_v: m.push(v)
OPS["version"] = lambda m: m.push(bytearray(b"1.0"))
OPS["product"] = lambda m: m.push(bytearray(b"quire"))


def _logic(on_bool, on_int):
    def run(m: Interpreter) -> None:
        b, a = m.pop(int, bool), m.pop(int, bool)
        if isinstance(a, bool) != isinstance(b, bool):
            raise Fault("typecheck")
        m.push(on_bool(a, b) if isinstance(a, bool) else on_int(a, b))

    return run


OPS |= {"and": _logic(lambda a, b: a and b, lambda a, b: a & b), "or": _logic(lambda a, b: a or b, lambda a, b: a | b), "xor": _logic(lambda a, b: a != b, lambda a, b: a ^ b)}


def same(a, b) -> bool:
    plain = lambda v: v.decode("latin-1") if isinstance(v, bytearray) else v
    if isinstance(a, (Array, dict)) or isinstance(b, (Array, dict)):
        return a is b
    return type(plain(a)) in (bool,) and plain(a) is plain(b) or not isinstance(a, bool) and not isinstance(b, bool) and plain(a) == plain(b)


@op("eq")
def _(m):
    b, a = m.pop(), m.pop()
    m.push(same(a, b))


@op("ne")
def _(m):
    b, a = m.pop(), m.pop()
    m.push(not same(a, b))


@op("not")
def _(m):
    v = m.pop(int, bool)
    m.push(not v if isinstance(v, bool) else ~v)


@op("pop")
def _(m):
    m.pop()


@op("dup")
def _(m):
    v = m.pop()
    m.push(v, v)


@op("exch")
def _(m):
    b, a = m.pop(), m.pop()
    m.push(b, a)


def _count(m: Interpreter) -> int:
    n = m.pop(int)
    if n < 0:
        raise Fault("rangecheck")
    return n


@op("index")
def _(m):
    n = _count(m)
    if n >= len(m.stack):
        raise Fault("stackunderflow")
    m.push(m.stack[-1 - n])


@op("copy")
def _(m):
    n = _count(m)
    if n > len(m.stack):
        raise Fault("stackunderflow")
    m.push(*m.stack[len(m.stack) - n :])


@op("roll")
def _(m):
    j = m.pop(int)
    n = _count(m)
    if n > len(m.stack):
        raise Fault("stackunderflow")
    if n:
        k, top = j % n, m.stack[len(m.stack) - n :]
        m.stack[len(m.stack) - n :] = top[n - k :] + top[: n - k]


OPS |= {"clear": lambda m: m.stack.clear(), "count": lambda m: m.push(len(m.stack)), "cleartomark": lambda m: m.to_mark() and None, "exit": lambda m: (_ for _ in ()).throw(Exit())}
for _n in ("mark", "[", "<<"):
    OPS[_n] = lambda m: m.push(Mark())


@op("counttomark")
def _(m):
    top = m.to_mark()
    m.push(Mark(), *top, len(top))


@op("]")
def _(m):
    m.push(Array(m.to_mark()))


@op(">>")
def _(m):
    top = m.to_mark()
    if len(top) % 2:
        raise Fault("rangecheck")
    m.push({_key(k): v for k, v in zip(top[::2], top[1::2])})


def _key(k):
    return k.decode("latin-1") if isinstance(k, bytearray) else str(k) if isinstance(k, Name) else k


TYPES = ((bool, "booleantype"), (int, "integertype"), (float, "realtype"), (Name, "nametype"), (bytearray, "stringtype"), (Array, "arraytype"), (dict, "dicttype"), (Mark, "marktype"))


@op("type")
def _(m):
    v = m.pop()
    m.push(Name(next((n for t, n in TYPES if isinstance(v, t)), "nulltype"), True))


OPS["xcheck"] = lambda m: m.push(bool(getattr(m.pop(), "exec", False)))


def _marked(on: bool):
    def run(m: Interpreter) -> None:
        v = m.pop()
        m.push(Name(v, on) if isinstance(v, Name) else v)
        if isinstance(v, Array):
            v.exec = on

    return run


OPS |= {"cvx": _marked(True), "cvlit": _marked(False), "bind": lambda m: m.push(m.pop(Array))}


@op("cvn")
def _(m):
    m.push(Name(m.pop(bytearray).decode("latin-1")))


def _number(v):
    if isinstance(v, bytearray):
        body = parse(v.decode("latin-1"))
        if len(body) != 1 or not isinstance(body[0], (int, float)):
            raise Fault("typecheck")
        return body[0]
    return v


OPS["cvi"] = lambda m: m.whole(int(_number(m.pop(int, float, bytearray))))
OPS["cvr"] = lambda m: m.push(float(_number(m.pop(int, float, bytearray))))


@op("cvs")
def _(m):
    room = m.pop()
    v = m.pop() if isinstance(room, bytearray) and m.stack else room
    text = ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, Name)) else show_real(v) if isinstance(v, float) else v.decode("latin-1") if isinstance(v, bytearray) else "--nostringval--"
    if v is not room:
        if len(text) > len(room):
            raise Fault("rangecheck")
        room[:] = text.encode("latin-1", "replace").ljust(len(room))
        m.push(room)
    else:
        m.push(bytearray(text.encode("latin-1", "replace")))


OPS["length"] = lambda m: m.push(len(m.pop(bytearray, Array, dict, Name)))


@op("get")
def _(m):
    k, v = m.pop(), m.pop(bytearray, Array, dict)
    if isinstance(v, dict):
        if _key(k) not in v:
            raise Fault("undefined")
        m.push(v[_key(k)])
    elif not isinstance(k, int):
        raise Fault("typecheck")
    elif not 0 <= k < len(v):
        raise Fault("rangecheck")
    else:
        m.push(v[k])


@op("put")
def _(m):
    x, k, v = m.pop(), m.pop(), m.pop(bytearray, Array, dict)
    if isinstance(v, dict):
        v[_key(k)] = x
    elif not isinstance(k, int) or isinstance(v, bytearray) and not isinstance(x, int):
        raise Fault("typecheck")
    elif not 0 <= k < len(v) or isinstance(v, bytearray) and not 0 <= x < 256:
        raise Fault("rangecheck")
    else:
        v[k] = x


def _sized(limit: int, make):
    def run(m: Interpreter) -> None:
        n = _count(m)
        if n > limit:
            raise Fault("rangecheck")
        m.push(make(n))

    return run


OPS |= {"array": _sized(1 << 20, lambda n: Array([None] * n)), "string": _sized(1 << 25, bytearray), "dict": _sized(1 << 30, lambda n: {})}


@op("def")
def _(m):
    v, k = m.pop(), m.pop()
    m.dicts[-1][_key(k)] = v


@op("store")
def _(m):
    v, k = m.pop(), _key(m.pop())
    next((d for d in reversed(m.dicts) if k in d), m.dicts[-1])[k] = v


@op("load")
def _(m):
    k = _key(m.pop())
    for d in reversed(m.dicts):
        if k in d:
            m.push(d[k])
            return
    raise Fault("undefined")


@op("where")
def _(m):
    k = _key(m.pop())
    found = next((d for d in reversed(m.dicts) if k in d), None)
    m.push(*([found, True] if found is not None else [False]))


@op("known")
def _(m):
    k, d = m.pop(), m.pop(dict)
    m.push(_key(k) in d)


@op("begin")
def _(m):
    if len(m.dicts) >= 20:
        raise Fault("limitcheck")
    m.dicts.append(m.pop(dict))


@op("end")
def _(m):
    if len(m.dicts) == 1:
        raise Fault("dictstackunderflow")
    m.dicts.pop()


OPS["exec"] = lambda m: m.call(m.pop())


@op("if")
def _(m):
    p, c = m.pop(Array), m.pop(bool)
    if c:
        m.call(p)


@op("ifelse")
def _(m):
    no, yes, c = m.pop(Array), m.pop(Array), m.pop(bool)
    m.call(yes if c else no)


@op("repeat")
def _(m):
    p = m.pop(Array)
    m.loop(p, ((),) * 0 if (n := _count(m)) == 0 else (() for _ in range(n)))


@op("for")
def _(m):
    p = m.pop(Array)
    start, step, limit = m.nums(3)
    if step == 0:
        raise Fault("rangecheck")

    def feed():
        x = start
        while x <= limit if step > 0 else x >= limit:
            yield (x,)
            x += step

    m.loop(p, feed())


@op("loop")
def _(m):
    p = m.pop(Array)

    def feed():
        while True:
            m.left -= 1
            if m.left < 0:
                raise Fault("limitcheck")
            yield ()

    m.loop(p, feed())


@op("forall")
def _(m):
    p, v = m.pop(Array), m.pop(Array, bytearray, dict)
    m.loop(p, [(Name(k) if isinstance(k, str) else k, x) for k, x in v.items()] if isinstance(v, dict) else [(x,) for x in list(v)])


# -- graphics -------------------------------------------------------------------------------------


def _draw(name: str, n: int, f) -> None:
    OPS[name] = lambda m: f(m.canvas, *m.nums(n)) and None


def _matrix(m: Interpreter) -> tuple:
    a = m.pop(Array)
    if len(a) != 6:
        raise Fault("rangecheck")
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in a):
        raise Fault("typecheck")
    return tuple(map(float, a))


def _curve(c: Canvas, *p: float) -> None:
    for i in (0, 2, 4):
        c.line(p[i], p[i + 1])


def _rcurve(c: Canvas, *p: float) -> None:
    x, y = c.point()
    for i in (0, 2, 4):
        a, b, cc, d, _, _ = c.state.ctm
        c.path.append((x + a * p[i] + cc * p[i + 1], y + b * p[i] + d * p[i + 1], False))


def _rotate(c: Canvas, a: float) -> None:
    s, k = math.sin(math.radians(a)), math.cos(math.radians(a))
    c.set(ctm=multiply((k, s, -s, k, 0.0, 0.0), c.state.ctm))


for _n, _k, _f in (
    ("moveto", 2, Canvas.move), ("lineto", 2, Canvas.line), ("rmoveto", 2, lambda c, x, y: c.relative(x, y, True)), ("rlineto", 2, Canvas.relative), ("curveto", 6, _curve), ("rcurveto", 6, _rcurve), ("closepath", 0, lambda c: c.close() if c.path else None),
    ("newpath", 0, lambda c: c.path.clear()), ("stroke", 0, lambda c: c.paint("stroke")), ("fill", 0, lambda c: c.paint("fill")), ("eofill", 0, lambda c: c.paint("eofill")), ("setlinewidth", 1, lambda c, w: c.set(width=float(w))),
    ("setrgbcolor", 3, lambda c, r, g, b: c.set(color=(r, g, b))), ("setgray", 1, lambda c, g: c.set(color=(g, g, g))), ("rectfill", 4, lambda c, *r: c.paint("fill", c.rect(*r))), ("rectstroke", 4, lambda c, *r: c.paint("stroke", c.rect(*r))),
    ("gsave", 0, Canvas.save), ("grestore", 0, Canvas.restore), ("translate", 2, lambda c, x, y: c.set(ctm=multiply((1.0, 0.0, 0.0, 1.0, x, y), c.state.ctm))), ("scale", 2, lambda c, x, y: c.set(ctm=multiply((x, 0.0, 0.0, y, 0.0, 0.0), c.state.ctm))),
    ("rotate", 1, _rotate), ("arc", 5, Canvas.arc), ("arcn", 5, lambda c, *a: c.arc(*a, down=True)), ("clip", 0, Canvas.clip), ("initclip", 0, lambda c: c.set(clips=())),
):
    _draw(_n, _k, _f)


@op("setlinecap")
def _(m):
    n = m.pop(int)
    if not 0 <= n <= 2:
        raise Fault("rangecheck")
    m.canvas.set(cap=n)


OPS["concat"] = lambda m: m.canvas.set(ctm=multiply(_matrix(m), m.canvas.state.ctm))
OPS["setmatrix"] = lambda m: m.canvas.set(ctm=_matrix(m))


@op("currentmatrix")
def _(m):
    a = m.pop(Array)
    if len(a) != 6:
        raise Fault("rangecheck")
    a[:] = m.canvas.state.ctm
    m.push(a)


@op("dtransform")
def _(m):
    t = _matrix(m) if m.stack and isinstance(m.stack[-1], Array) else m.canvas.state.ctm
    x, y = m.nums(2)
    m.push(t[0] * x + t[2] * y, t[1] * x + t[3] * y)


@op("currentpoint")
def _(m):
    m.push(*apply(invert(m.canvas.state.ctm), *m.canvas.point()))


@op("clippath")
def _(m):
    clips = m.canvas.state.clips
    m.canvas.path = list(clips[-1][1]) if clips else [(0.0, 0.0, True), (612.0, 0.0, False), (612.0, 792.0, False), (0.0, 792.0, False), (0.0, 0.0, False)]


@op("pathbbox")
def _(m):
    back = invert(m.canvas.state.ctm)
    pts = [apply(back, x, y) for x, y, _ in m.canvas.path] or [(0.0, 0.0)]
    m.push(min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))


@op("showpage")
def _(m):
    m.shown += 1
    m.canvas.page += 1
    m.canvas.path = []


@op("findfont")
def _(m):
    n = _key(m.pop(Name, bytearray))
    if n not in STANDARD_FONTS:
        raise Fault("invalidfont")
    m.push({"FontName": n, "size": 1.0})


@op("scalefont")
def _(m):
    k, f = m.num(), m.pop(dict)
    m.push({**f, "size": f.get("size", 1.0) * k})


@op("setfont")
def _(m):
    f = m.pop(dict)
    if "FontName" not in f:
        raise Fault("invalidfont")
    m.canvas.set(font=(f["FontName"], f.get("size", 1.0)))


def _advance(m: Interpreter, s: bytearray) -> float:
    name, size = m.canvas.state.font
    if not name:
        raise Fault("invalidfont")
    return sum((width_of(name, c) or 0.0) for c in s) / 1000 * size


@op("show")
def _(m):
    s = m.pop(bytearray)
    m.canvas.point()
    m.canvas.relative(_advance(m, s), 0.0, True)


@op("stringwidth")
def _(m):
    m.push(_advance(m, m.pop(bytearray)), 0.0)


MARK = "page long, seq long, op string, points array<struct<x:double,y:double,move:boolean>>, r int, g int, b int, half double, alpha double, mode string, clips int, clip_paths array<struct<even:boolean,points:array<struct<x:double,y:double,move:boolean>>>>, image struct<w:int,h:int,rgba:binary,m:array<double>>, error string"
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("move", pa.bool_())]))
_TYPES = [pa.int64(), pa.int64(), pa.string(), _POINTS, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.list_(pa.struct([("even", pa.bool_()), ("points", _POINTS)])),
          pa.struct([("w", pa.int32()), ("h", pa.int32()), ("rgba", pa.binary()), ("m", pa.list_(pa.float64()))]), pa.string()]
_NAMES = ["page", "seq", "op", "points", "r", "g", "b", "half", "alpha", "mode", "clips", "clip_paths", "image", "error"]


def _points(path) -> list[dict]:
    return [{"x": x, "y": y, "move": mv} for x, y, mv in path]


def mark_table(files: DataFrame | Made, interpret) -> DataFrame:
    """``interpret(bytes)`` gives (canvas, pages that count, error); one row a mark on those pages, one row an error."""
    def rows_of(content: bytes) -> Iterator[tuple]:
        canvas, last, error = interpret(content)
        for k in canvas.marks:
            if k[0] <= last:
                clips = [{"even": even, "points": _points(path)} for even, path in k[10]]
                yield (k[0], k[1], k[2], _points(k[3]), *k[4:10], len(clips), clips, k[11] if len(k) > 11 else None, None)
        if error or not canvas.marks:
            yield (last or 1, *[None] * (len(_NAMES) - 2), error)

    return each_file(files, MARK, dict(zip(_NAMES, _TYPES)), rows_of)


def _interpret(content: bytes):
    m = Interpreter()
    error = None
    try:
        m.run(content.decode("latin-1"))
    except Fault as e:
        error = str(e)
    return m.canvas, m.shown or 1, error  # without showpage there is one page; marks after the last showpage are lost


def run_postscript(files: DataFrame | Made) -> DataFrame:
    """(doc_id, page, seq, op, points, colour, ..., error) of PostScript programs (doc_id, content)."""
    return mark_table(files, _interpret)
