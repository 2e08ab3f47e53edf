"""Stack programs compiled to Catalyst expressions.

A program in postfix notation runs over columns: the operand stack exists only while
compiling, each slot holds a typed expression. Branches merge slot by slot with
``when``; counted loops unroll. Every partial operator adds a condition under which the
row's error has a name; the first error of a row wins and its results are NULL.
Two dialects share the machine: page programs (32-bit integers and reals) and
calculator functions (reals, with half-away rounding).
"""

from __future__ import annotations

import re
from functools import lru_cache
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|%[^\n\r]*|(?P<str>\((?:[^()\\]|\\.)*\))|(?P<brace>[{}\[\]]|<<|>>)|(?P<name>/?[^\s{}\[\]()<>/%]+)")
NUMBER, RADIX = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), re.compile(r"(\d{1,2})#([0-9A-Za-z]+)$")
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
UNROLL = 4096
BANNED = ("file", "run", "deletefile", "renamefile", "filenameforall")
IDENTITY = {"languagelevel": 2, "revision": 1, "serialnumber": 0}


class ProgramError(ValueError):
    """A fault that no row can avoid; ``name`` is the error's name."""

    def __init__(self, name: str, at: str):
        super().__init__(f"{name} in {at}")
        self.name = name


@dataclass(frozen=True)
class Value:
    """kind: int, real, bool, string, name, array, dict, mark, null, proc. ``const``: the value where it is known."""

    kind: str
    col: Column | None = None
    const: object = None
    items: tuple = ()
    exec: bool = False


@lru_cache(maxsize=1 << 14)
def _atom(t: str) -> int | float | tuple[str, str]:
    """A number or a name; programs repeat them."""
    if NUMBER.match(t):
        n = float(t) if re.search(r"[.eE]", t) else int(t)
        return float(n) if isinstance(n, int) and not INT_MIN <= n <= INT_MAX else n
    if (r := RADIX.match(t)) and 2 <= int(r[1]) <= 36:
        n = int(r[2], int(r[1]))
        if n > INT_MAX:
            raise ProgramError("rangecheck", t)
        return n
    return ("lit", t[1:]) if t[0] == "/" else ("name", t)


def parse(text: str) -> list:
    """Tokens to a nested list: numbers, ('name', x), ('lit', x), ('str', x), lists for procedures."""
    out: list = [[]]
    pos = 0
    while pos < len(text):
        m = TOKEN.match(text, pos)
        if not m:
            raise ProgramError("syntaxerror", text[pos : pos + 10])
        pos = m.end()
        if m["str"] is not None:
            out[-1].append(("str", re.sub(r"\\(.)", lambda e: {"n": "\n", "r": "\r", "t": "\t"}.get(e[1], e[1]), m["str"][1:-1])))
        elif m["brace"] == "{":
            out.append([])
        elif m["brace"] == "}":
            if len(out) < 2:
                raise ProgramError("syntaxerror", "}")
            done = out.pop()
            out[-1].append(done)
        elif m["brace"]:
            out[-1].append(("name", m["brace"]))
        elif m["name"]:
            out[-1].append(_atom(m["name"]))
    if len(out) > 1:
        raise ProgramError("syntaxerror", "{")
    return out[0]


def real(x: Column) -> Column:
    return x.cast("double")


@dataclass
class Machine:
    calculator: bool = False
    stack: list[Value] = field(default_factory=list)
    scopes: list[dict] = field(default_factory=lambda: [{}])
    error: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    steps: int = 0
    exits: bool = False

    # -- stack ----------------------------------------------------------------------------------

    def pop(self, at: str, *kinds: str) -> Value:
        if not self.stack:
            raise ProgramError("stackunderflow", at)
        v = self.stack.pop()
        if kinds and v.kind not in kinds:
            raise ProgramError("typecheck", at)
        return v

    def push(self, kind: str, col: Column | None = None, const: object = None, **more: object) -> None:
        self.stack.append(Value(kind, F.lit(const) if col is None and const is not None else col, const, **more))

    def fail(self, name: str, when: Column) -> None:
        self.error = F.coalesce(self.error, F.when(when, F.lit(name)))

    def number(self, at: str) -> Value:
        return self.pop(at, "int", "real")

    def count(self, at: str) -> int:
        v = self.number(at)
        if v.const is None or v.const != int(v.const):
            raise ProgramError("typecheck", at)
        if v.const < 0:
            raise ProgramError("rangecheck", at)
        return int(v.const)

    def integer(self, at: str) -> Value:
        """An operand that must be whole: in the calculator any real that is."""
        v = self.number(at)
        if v.kind == "int":
            return v
        if not self.calculator:
            raise ProgramError("typecheck", at)
        self.fail("typecheck", (v.col != F.floor(v.col)) | (F.abs(v.col) > INT_MAX))
        return replace(v, kind="int", col=v.col.try_cast("long"))

    def result(self, col: Column, whole: bool, size: Column | None = None, const: object = None) -> None:
        """``col`` is a LONG when whole; ``size``, the same as a real, tells whether it leaves 32 bits: there a page program
        stops, while the calculator goes on with reals. Each value stands once in what is built on it, errors aside."""
        if self.calculator or not whole:
            self.push("real", real(col), None if const is None else float(const))
        elif const is not None and INT_MIN <= const <= INT_MAX:
            self.push("int", F.lit(const).cast("long"), const)
        else:
            if size is not None:
                self.fail("rangecheck", ~size.between(INT_MIN, INT_MAX))
            self.push("int", col)

    # -- operators ------------------------------------------------------------------------------

    def run(self, body: list) -> None:
        for token in body:
            self.steps += 1
            if self.steps > 200_000:
                raise ProgramError("limitcheck", "run")
            if isinstance(token, list):
                self.stack.append(Value("proc", items=tuple(token), exec=True))
            elif isinstance(token, (int, float)):
                if self.calculator or isinstance(token, float):
                    self.push("real", F.lit(float(token)), float(token))
                else:
                    self.push("int", F.lit(token).cast("long"), token)
            elif token[0] == "str":
                self.push("string", F.lit(token[1]), token[1])
            elif token[0] == "lit":
                self.push("name", F.lit(token[1]), token[1])
            else:
                self.name(token[1])
            if self.exits:
                return

    def name(self, n: str) -> None:
        for scope in reversed(self.scopes):
            if n in scope:
                v = scope[n]
                if v.kind == "proc":
                    self.run(list(v.items))
                else:
                    self.stack.append(v)
                return
        if n in BANNED:
            raise ProgramError("invalidaccess", n)
        op = getattr(self, "op_" + {"[": "mark", "<<": "mark", "]": "array_end", ">>": "dict_end", "if": "if_", "for": "for_", "and": "and_", "or": "or_", "not": "not_", "exec": "exec_"}.get(n, n), None)
        if op is None or (self.calculator and n not in CALCULATOR) or (not self.calculator and n in CALCULATOR_ONLY):
            raise ProgramError("undefined", n)
        op()

    def op_pop(self) -> None:
        self.pop("pop")

    def op_dup(self) -> None:
        v = self.pop("dup")
        self.stack += [v, v]

    def op_exch(self) -> None:
        b, a = self.pop("exch"), self.pop("exch")
        self.stack += [b, a]

    def op_index(self) -> None:
        n = self.count("index")
        if n >= len(self.stack):
            raise ProgramError("stackunderflow", "index")
        self.stack.append(self.stack[-1 - n])

    def op_copy(self) -> None:
        n = self.count("copy")
        if n > len(self.stack):
            raise ProgramError("stackunderflow", "copy")
        self.stack += self.stack[len(self.stack) - n :]

    def op_roll(self) -> None:
        j = self.number("roll")
        if j.const is None or j.const != int(j.const):
            raise ProgramError("typecheck", "roll")
        n = self.count("roll")
        if n > len(self.stack):
            raise ProgramError("stackunderflow", "roll")
        if n:
            k = int(j.const) % n
            top = self.stack[len(self.stack) - n :]
            self.stack[len(self.stack) - n :] = top[n - k :] + top[: n - k]

    def op_clear(self) -> None:
        self.stack.clear()

    def op_count(self) -> None:
        self.push("int", F.lit(len(self.stack)).cast("long"), len(self.stack))

    def op_mark(self) -> None:
        self.stack.append(Value("mark"))

    def _to_mark(self, at: str) -> list[Value]:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].kind == "mark":
                top = self.stack[i + 1 :]
                del self.stack[i:]
                return top
        raise ProgramError("unmatchedmark", at)

    def op_cleartomark(self) -> None:
        self._to_mark("cleartomark")

    def op_counttomark(self) -> None:
        top = self._to_mark("counttomark")
        self.stack += [Value("mark"), *top]
        self.push("int", F.lit(len(top)).cast("long"), len(top))

    def _arith(self, at: str, safe, plain) -> None:
        b, a = self.number(at), self.number(at)
        known = plain(a.const, b.const) if isinstance(a.const, (int, float)) and isinstance(b.const, (int, float)) else None
        if a.kind == b.kind == "int":
            self.result(safe(a.col, b.col), True, plain(real(a.col), real(b.col)), known)
        else:
            self.push("real", plain(real(a.col), real(b.col)), known)

    def op_add(self) -> None:
        self._arith("add", F.try_add, lambda a, b: a + b)

    def op_sub(self) -> None:
        self._arith("sub", F.try_subtract, lambda a, b: a - b)

    def op_mul(self) -> None:
        self._arith("mul", F.try_multiply, lambda a, b: a * b)

    def op_div(self) -> None:
        b, a = self.number("div"), self.number("div")
        self.fail("undefinedresult", b.col == 0)
        self.push("real", F.try_divide(real(a.col), real(b.col)))

    def op_idiv(self) -> None:
        b, a = self.integer("idiv"), self.integer("idiv")
        self.fail("undefinedresult", b.col == 0)
        q = F.try_divide(real(a.col), real(b.col))  # exact enough for 32 bits; the cast cuts toward zero
        self.result(q.try_cast("long"), True, q)

    def op_mod(self) -> None:
        b, a = self.integer("mod"), self.integer("mod")
        self.fail("undefinedresult", b.col == 0)
        self.result(F.try_mod(a.col, b.col), True)

    def _unary(self, at: str, f, keep_int: bool = True) -> None:
        a = self.number(at)
        if a.kind == "int" and keep_int:
            self.stack.append(a)
        else:
            self.push("real", real(f(real(a.col))))

    def op_neg(self) -> None:
        a = self.number("neg")
        self.result(-a.col, True, -real(a.col), -a.const if a.const is not None else None) if a.kind == "int" else self.push("real", -a.col, -a.const if a.const is not None else None)

    def op_abs(self) -> None:
        a = self.number("abs")
        self.result(F.abs(a.col), True, F.abs(real(a.col))) if a.kind == "int" else self.push("real", F.abs(a.col))

    def op_ceiling(self) -> None:
        self._unary("ceiling", F.ceil)

    def op_floor(self) -> None:
        self._unary("floor", F.floor)

    def op_round(self) -> None:
        # page programs: halves go up; calculator: halves go away from zero
        self._unary("round", (lambda x: F.round(x)) if self.calculator else (lambda x: F.floor(x + 0.5)))

    def op_truncate(self) -> None:
        self._unary("truncate", lambda x: F.signum(x) * F.floor(F.abs(x)))

    def op_sqrt(self) -> None:
        a = self.number("sqrt")
        self.fail("undefinedresult", a.col < 0)
        self.push("real", F.sqrt(real(a.col)))

    def op_cos(self) -> None:
        self._unary("cos", lambda x: F.cos(F.radians(x)), False)

    def op_sin(self) -> None:
        self._unary("sin", lambda x: F.sin(F.radians(x)), False)

    def op_atan(self) -> None:
        b, a = self.number("atan"), self.number("atan")
        self.push("real", F.degrees(F.atan2(real(a.col), real(b.col))))

    def op_exp(self) -> None:
        b, a = self.number("exp"), self.number("exp")
        p = F.pow(real(a.col), real(b.col))
        self.fail("undefinedresult", F.isnan(p) | (F.abs(p) == float("inf")))
        self.push("real", p)

    def _log(self, at: str, f) -> None:
        a = self.number(at)
        self.fail("undefinedresult", a.col <= 0)
        self.push("real", f(real(a.col)))

    def op_ln(self) -> None:
        self._log("ln", F.log)

    def op_log(self) -> None:
        self._log("log", F.log10)

    def op_bitshift(self) -> None:
        b, a = self.integer("bitshift"), self.integer("bitshift")
        self.fail("rangecheck", F.abs(b.col) > 31)
        n = b.col.try_cast("int")
        if b.const is not None:
            x = F.call_function("shiftleft" if b.const >= 0 else "shiftright", a.col, F.lit(int(abs(b.const))))
        else:
            x = F.when(n >= 0, F.call_function("shiftleft", a.col, F.abs(n))).otherwise(F.call_function("shiftright", a.col, F.abs(n)))
        self.result(F.call_function("shiftright", F.call_function("shiftleft", x, F.lit(32)), F.lit(32)), True)

    def _equal(self, at: str) -> tuple[Column, bool | None]:
        b, a = self.pop(at), self.pop(at)
        known = a.const == b.const if a.const is not None and b.const is not None else None
        num = {"int", "real"}
        if {a.kind, b.kind} <= num:
            return real(a.col) == real(b.col), known
        text = {"string", "name"}
        if a.kind == b.kind and a.kind in ("bool",) or {a.kind, b.kind} <= text:
            return a.col == b.col, known
        if self.calculator:
            raise ProgramError("typecheck", at)
        same = a is b or a.kind == b.kind and a.kind in ("null", "mark")
        return F.lit(same), same

    def op_eq(self) -> None:
        self.push("bool", *self._equal("eq"))

    def op_ne(self) -> None:
        same, known = self._equal("ne")
        self.push("bool", ~same, None if known is None else not known)

    def _order(self, at: str, f) -> None:
        b, a = self.number(at), self.number(at)
        self.push("bool", f(real(a.col), real(b.col)), f(a.const, b.const) if a.const is not None and b.const is not None else None)

    def op_gt(self) -> None:
        self._order("gt", lambda a, b: a > b)

    def op_ge(self) -> None:
        self._order("ge", lambda a, b: a >= b)

    def op_lt(self) -> None:
        self._order("lt", lambda a, b: a < b)

    def op_le(self) -> None:
        self._order("le", lambda a, b: a <= b)

    def _logic(self, at: str, on_bool, on_int) -> None:
        if len(self.stack) < 2:
            raise ProgramError("stackunderflow", at)
        if self.stack[-1].kind == self.stack[-2].kind == "bool":
            b, a = self.pop(at), self.pop(at)
            self.push("bool", on_bool(a.col, b.col))
        else:
            b, a = self.integer(at), self.integer(at)
            self.result(on_int(a.col, b.col), True)

    def op_and_(self) -> None:
        self._logic("and", lambda a, b: a & b, lambda a, b: a.bitwiseAND(b))

    def op_or_(self) -> None:
        self._logic("or", lambda a, b: a | b, lambda a, b: a.bitwiseOR(b))

    def op_xor(self) -> None:
        self._logic("xor", lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b))

    def op_not_(self) -> None:
        if self.stack and self.stack[-1].kind == "bool":
            v = self.pop("not")
            self.push("bool", ~v.col, None if v.const is None else not v.const)
        else:
            self.result(F.bitwise_not(self.integer("not").col), True)

    def op_true(self) -> None:
        self.push("bool", F.lit(True), True)

    def op_false(self) -> None:
        self.push("bool", F.lit(False), False)

    def op_null(self) -> None:
        self.stack.append(Value("null"))

    # -- types, strings, containers -------------------------------------------------------------

    def op_type(self) -> None:
        kinds = {"int": "integertype", "real": "realtype", "bool": "booleantype", "string": "stringtype", "name": "nametype", "array": "arraytype", "proc": "arraytype", "dict": "dicttype", "mark": "marktype", "null": "nulltype"}
        t = kinds[self.pop("type").kind]
        self.push("name", F.lit(t), t)

    def op_xcheck(self) -> None:
        x = self.pop("xcheck").exec
        self.push("bool", F.lit(x), x)

    def op_cvx(self) -> None:
        self.stack.append(replace(self.pop("cvx"), exec=True))

    def op_cvlit(self) -> None:
        self.stack.append(replace(self.pop("cvlit"), exec=False))

    def op_cvn(self) -> None:
        self.stack.append(replace(self.pop("cvn", "string"), kind="name"))

    def _parsed(self, v: Value, at: str) -> Column:
        ok = v.col.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
        self.fail("typecheck", ~ok)
        return F.when(ok, F.trim(v.col)).try_cast("double")

    def op_cvi(self) -> None:
        v = self.pop("cvi", "int", "real", "string")
        x = self._parsed(v, "cvi") if v.kind == "string" else v.col
        if v.kind == "int":
            self.stack.append(v)
            return
        t = F.signum(x) * F.floor(F.abs(x))
        self.fail("rangecheck", (t > INT_MAX) | (t < INT_MIN))
        self.push("int", x.try_cast("long"))

    def op_cvr(self) -> None:
        v = self.pop("cvr", "int", "real", "string")
        self.push("real", self._parsed(v, "cvr") if v.kind == "string" else real(v.col))

    def op_cvs(self) -> None:
        v = self.pop("cvs")
        if v.kind == "string" and self.stack:  # the destination of the value below
            size, v = F.octet_length(v.col), self.pop("cvs")
        else:
            size = None
        text = v.col if v.kind in ("string", "name") else v.col.cast("string") if v.kind in ("int", "bool", "real") else F.lit("--nostringval--")
        if size is not None:
            self.fail("rangecheck", F.octet_length(text) > size)
        self.push("string", text)

    def op_length(self) -> None:
        v = self.pop("length", "string", "name", "array", "proc", "dict")
        if v.kind in ("string", "name"):
            self.push("int", F.octet_length(v.col).cast("long"), len(v.const.encode()) if isinstance(v.const, str) else None)
        else:
            self.push("int", F.lit(len(v.items)).cast("long"), len(v.items))

    def op_get(self) -> None:
        k, v = self.pop("get"), self.pop("get", "string", "array", "proc", "dict")
        if v.kind == "dict":
            if k.const not in dict(v.items):
                raise ProgramError("undefined", "get")
            self.stack.append(dict(v.items)[k.const])
        elif v.kind == "string":
            bad = (k.col < 0) | (k.col >= F.octet_length(v.col))
            self.fail("rangecheck", bad)
            self.push("int", F.when(~bad, F.conv(F.hex(F.substring(v.col.cast("binary"), k.col.cast("int") + 1, F.lit(1))), 16, 10)).cast("long"))
        elif k.const is not None:
            if not 0 <= k.const < len(v.items):
                raise ProgramError("rangecheck", "get")
            self.stack.append(v.items[int(k.const)])
        else:
            if len({x.kind for x in v.items}) != 1:
                raise ProgramError("typecheck", "get")
            bad = (k.col < 0) | (k.col >= len(v.items))
            self.fail("rangecheck", bad)
            self.push(v.items[0].kind, F.get(F.array(*[x.col for x in v.items]), F.when(~bad, k.col).cast("int")))

    def op_put(self) -> None:
        """Values never alias here: the changed composite takes the place of those equal to it on the stack and in scopes."""
        x, k, v = self.pop("put"), self.pop("put"), self.pop("put", "array", "proc", "dict")
        if v.kind == "dict":
            new = replace(v, items=tuple((dict(v.items) | {k.const: x}).items()))
        else:
            if k.const is None or not 0 <= k.const < len(v.items):
                raise ProgramError("rangecheck", "put")
            items = list(v.items)
            items[int(k.const)] = x
            new = replace(v, items=tuple(items))
        self.stack[:] = [new if s is v else s for s in self.stack]
        for scope in self.scopes:
            scope.update({n: new for n, s in scope.items() if s is v})

    def op_array(self) -> None:
        n = self.count("array")
        if n > 1 << 20:
            raise ProgramError("rangecheck", "array")
        self.stack.append(Value("array", items=(Value("null"),) * n))

    def op_string(self) -> None:
        n = self.count("string")
        if n > 1 << 25:
            raise ProgramError("rangecheck", "string")
        self.push("string", F.repeat(F.lit("\0"), F.lit(n)))

    def op_dict(self) -> None:
        self.count("dict")
        self.stack.append(Value("dict"))

    def op_array_end(self) -> None:
        self.stack.append(Value("array", items=tuple(self._to_mark("]"))))

    def op_dict_end(self) -> None:
        top = self._to_mark(">>")
        if len(top) % 2:
            raise ProgramError("rangecheck", ">>")
        self.stack.append(Value("dict", items=tuple((k.const, v) for k, v in zip(top[::2], top[1::2]))))

    def op_def(self) -> None:
        v, k = self.pop("def"), self.pop("def")
        self.scopes[-1][k.const] = v

    def op_store(self) -> None:
        v, k = self.pop("store"), self.pop("store")
        next((s for s in reversed(self.scopes) if k.const in s), self.scopes[-1])[k.const] = v

    def op_load(self) -> None:
        k = self.pop("load")
        found = next((s[k.const] for s in reversed(self.scopes) if k.const in s), None)
        if found is None:
            raise ProgramError("undefined", "load")
        self.stack.append(found)

    def op_where(self) -> None:
        k = self.pop("where")
        found = next((s for s in reversed(self.scopes) if k.const in s), None)
        if found is not None:
            self.stack.append(Value("dict", items=tuple(found.items())))
        self.push("bool", F.lit(found is not None), found is not None)

    def op_known(self) -> None:
        k, d = self.pop("known"), self.pop("known", "dict")
        self.push("bool", F.lit(k.const in dict(d.items)), k.const in dict(d.items))

    def op_begin(self) -> None:
        if len(self.scopes) >= 20:
            raise ProgramError("limitcheck", "begin")
        self.scopes.append(dict(self.pop("begin", "dict").items))

    def op_end(self) -> None:
        if len(self.scopes) == 1:
            raise ProgramError("dictstackunderflow", "end")
        self.scopes.pop()

    def op_bind(self) -> None:
        self.stack.append(self.pop("bind", "proc", "array"))

    # -- control --------------------------------------------------------------------------------

    def op_exec_(self) -> None:
        v = self.pop("exec")
        self.run(list(v.items)) if v.kind == "proc" else self.stack.append(v)

    def _branch(self, cond: Value, yes: list, no: list) -> None:
        if cond.const is not None:
            self.run(yes if cond.const else no)
            return
        stack, error, scopes = list(self.stack), self.error, [dict(s) for s in self.scopes]
        self.run(yes)
        if self.exits:
            raise ProgramError("limitcheck", "exit")
        a, ea, sa = self.stack, self.error, self.scopes
        self.stack, self.error, self.scopes = stack, error, scopes
        self.run(no)
        if self.exits:  # a loop that some rows leave earlier than others has no stack of one shape
            raise ProgramError("limitcheck", "exit")
        if len(a) != len(self.stack) or [v.kind for v in a] != [v.kind for v in self.stack] and not all({x.kind, y.kind} <= {"int", "real"} or x.kind == y.kind for x, y in zip(a, self.stack)):
            raise ProgramError("stackunderflow", "ifelse")
        merged = []
        for x, y in zip(a, self.stack):
            if x is y or x.col is None:
                merged.append(x)
            elif x.kind == y.kind:
                merged.append(Value(x.kind, F.when(cond.col, x.col).otherwise(y.col)))
            else:
                merged.append(Value("real", F.when(cond.col, real(x.col)).otherwise(real(y.col))))
        self.stack = merged
        self.error = F.when(cond.col, ea).otherwise(self.error)
        for mine, theirs in zip(self.scopes, sa):
            for n in set(mine) | set(theirs):
                x, y = theirs.get(n), mine.get(n)
                if x is not None and y is not None and x is not y and x.kind == y.kind and x.col is not None:
                    mine[n] = Value(x.kind, F.when(cond.col, x.col).otherwise(y.col))

    def op_if_(self) -> None:
        proc, cond = self.pop("if", "proc"), self.pop("if", "bool")
        self._branch(cond, list(proc.items), [])

    def op_ifelse(self) -> None:
        no, yes, cond = self.pop("ifelse", "proc"), self.pop("ifelse", "proc"), self.pop("ifelse", "bool")
        self._branch(cond, list(yes.items), list(no.items))

    def _loop(self, body: list, feed) -> None:
        for v in feed:
            if v is not None:
                self.stack.append(v)
            self.run(body)
            if self.exits:
                self.exits = False
                return

    def op_repeat(self) -> None:
        proc, n = self.pop("repeat", "proc"), self.count("repeat")
        if n > UNROLL:
            raise ProgramError("limitcheck", "repeat")
        self._loop(list(proc.items), [None] * n)

    def op_for_(self) -> None:
        proc = self.pop("for", "proc")
        limit, step, start = self.number("for"), self.number("for"), self.number("for")
        if None in (limit.const, step.const, start.const):
            raise ProgramError("typecheck", "for")
        if step.const == 0:
            raise ProgramError("rangecheck", "for")
        whole = {start.kind, step.kind} == {"int"}
        feed, x = [], start.const
        while (x <= limit.const if step.const > 0 else x >= limit.const) and len(feed) <= UNROLL:
            feed.append(Value("int", F.lit(int(x)).cast("long"), int(x)) if whole else Value("real", F.lit(float(x)), float(x)))
            x += step.const
        if len(feed) > UNROLL:
            raise ProgramError("limitcheck", "for")
        self._loop(list(proc.items), feed)

    def op_forall(self) -> None:
        proc, v = self.pop("forall", "proc"), self.pop("forall", "array", "dict", "string")
        if v.kind == "dict":
            for k, x in v.items:
                self.stack += [Value("name", F.lit(k), k), x]
                self.run(list(proc.items))
            return
        if v.kind == "string":
            if not isinstance(v.const, str):
                raise ProgramError("typecheck", "forall")
            self._loop(list(proc.items), [Value("int", F.lit(b).cast("long"), b) for b in v.const.encode()])
        else:
            self._loop(list(proc.items), list(v.items))

    def op_loop(self) -> None:
        proc = self.pop("loop", "proc")
        for _ in range(UNROLL):
            self.run(list(proc.items))
            if self.exits:
                self.exits = False
                return
        raise ProgramError("limitcheck", "loop")

    def op_exit(self) -> None:
        self.exits = True

    def op_languagelevel(self) -> None:
        self.push("int", F.lit(2).cast("long"), 2)

    def op_revision(self) -> None:
        self.push("int", F.lit(IDENTITY["revision"]).cast("long"), IDENTITY["revision"])

    def op_serialnumber(self) -> None:
        self.push("int", F.lit(0).cast("long"), 0)

    def op_version(self) -> None:
        self.push("string", F.lit("1.0"), "1.0")

    def op_product(self) -> None:
        self.push("string", F.lit("quire"), "quire")

    # -- matrices -------------------------------------------------------------------------------

    def op_dtransform(self) -> None:
        m = self.pop("dtransform", "array") if self.stack and self.stack[-1].kind == "array" else Value("array", items=tuple(Value("real", F.lit(float(x)), float(x)) for x in (1, 0, 0, 1, 0, 0)))
        y, x = self.number("dtransform"), self.number("dtransform")
        a, b, c, d = (real(v.col) for v in m.items[:4])
        self.push("real", a * real(x.col) + c * real(y.col))
        self.push("real", b * real(x.col) + d * real(y.col))


CALCULATOR = set("abs add atan ceiling cos div exp floor idiv ln log mod mul neg round sin sqrt sub truncate and bitshift eq ge gt le lt ne not or xor copy dup exch index pop roll if ifelse true false".split())
CALCULATOR_ONLY = {"atan", "exp", "ln", "log", "truncate", "bitshift"}


def run_program(text: str, *inputs: Column, kinds: tuple[str, ...] | None = None) -> tuple[list[Value], Column]:
    """Run a page program on columns: the final stack, and the name of each row's first error (NULL: none)."""
    m = Machine()
    for i, col in enumerate(inputs):
        kind = kinds[i] if kinds else "real"
        m.stack.append(Value(kind, col.cast({"int": "long", "real": "double", "bool": "boolean"}.get(kind, "string"))))
    m.run(parse(text))
    if m.exits:
        raise ProgramError("invalidexit", "exit")
    return [replace(v, col=F.when(m.error.isNull(), v.col)) if v.col is not None else v for v in m.stack], m.error


def calculator(text: str, inputs: list[Column], domain: list[tuple[float, float]] | None = None, ranges: list[tuple[float, float]] | None = None, outputs: int | None = None) -> tuple[list[Column], Column]:
    """A calculator function: inputs clipped to ``domain``, outputs to ``ranges``; (outputs, error name)."""
    def clip(x: Column, bound: tuple[float, float]) -> Column:
        return F.greatest(F.lit(float(bound[0])), F.least(F.lit(float(bound[1])), x))

    body = parse(text)
    if len(body) != 1 or not isinstance(body[0], list):
        raise ProgramError("syntaxerror", "function")
    m = Machine(calculator=True)
    for i, x in enumerate(inputs):
        m.stack.append(Value("real", clip(real(x), domain[i]) if domain else real(x)))
    m.run(body[0])
    want = len(ranges) if ranges else outputs
    if any(v.kind != "real" for v in m.stack) or want is not None and len(m.stack) != want:
        raise ProgramError("rangecheck", "function")
    out = [F.when(m.error.isNull(), clip(v.col, ranges[i]) if ranges else v.col) for i, v in enumerate(m.stack)]
    return out, m.error


def exponential(x: Column, c0: list[float], c1: list[float], n: float, domain: tuple[float, float] = (0.0, 1.0), ranges: list[tuple[float, float]] | None = None) -> list[Column]:
    """Exponential interpolation between two tuples."""
    t = F.pow(F.greatest(F.lit(float(domain[0])), F.least(F.lit(float(domain[1])), real(x))), F.lit(float(n)))
    out = [F.lit(float(a)) + t * F.lit(float(b - a)) for a, b in zip(c0, c1)]
    return [F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)) for v, (lo, hi) in zip(out, ranges)] if ranges else out


def function(kind: int, *args: object, **kw: object):
    """Only exponential (2) and calculator (4) functions are evaluated."""
    if kind not in (2, 4):
        raise ProgramError("undefined", f"function type {kind}")
    return (exponential if kind == 2 else calculator)(*args, **kw)
