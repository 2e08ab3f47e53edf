import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.stack import ProgramError, calculator, parse, run_program
from quire.sources.graphics import Fault
from quire.sources.postscript import Interpreter


def interpret(text, *inputs):
    m = Interpreter(100_000)
    m.push(*inputs)
    try:
        m.run(text)
    except Fault as e:
        return None, str(e)
    return m.stack[-1], None


PROGRAMS = ("add", "sub", "mul", "exch idiv", "mod", "dup mul add", "2 copy gt {exch} if pop", "neg exch abs add", "and", "or not", "5 3 1 roll add mul", "eq {1} {2} ifelse", "0 1 1 3 {add} for add add", "div 100 mul cvi", "pop 7 idiv 2 mul")


def test_compiler_agrees_with_interpreter(spark):
    """Two implementations of the language, one value at a time and column-wise."""
    values = [(0, 0), (1, 2), (-7, 2), (7, -2), (2147483647, 1), (-2147483648, -1), (65536, 65536), (12, 10), (5, 0)]
    rows = spark.createDataFrame(values, "a long, b long")
    for text in PROGRAMS:
        stack, error = run_program(text, F.col("a"), F.col("b"), kinds=("int", "int"))
        for r, (a, b) in zip(rows.select("a", "b", stack[-1].col.alias("v"), error.alias("e")).collect(), values):
            want, fault = interpret(text, a, b)
            assert (r.e, r.v) == (fault, want) if not isinstance(want, float) else r.v == pytest.approx(want), (text, a, b)


def test_calculator_rounds_away_and_fails_to_null(spark):
    row = spark.range(1).select(*[calculator(t, [F.lit(x)], outputs=1)[0][0].alias(n) for n, t, x in (("a", "{round}", -2.5), ("b", "{round}", 2.5), ("c", "{0 div}", 1.0), ("d", "{truncate}", -1.7), ("e", "{ln}", math.e))]).first()
    assert (row.a, row.b, row.c, row.d) == (-3.0, 3.0, None, -1.0) and abs(row.e - 1) < 1e-12
    for text in ("{1 2}", "{pop}", "{true}", "{nosuch}", "{moveto}", "1 add"):
        with pytest.raises(ProgramError):
            calculator(text, [F.lit(1.0)], outputs=1)


@given(st.lists(st.one_of(st.integers(-100, 100), st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3))), min_size=1, max_size=8))
@settings(max_examples=50, deadline=None)
def test_numbers_survive_parsing(numbers):
    assert parse(" ".join(map(str, numbers))) == [n if isinstance(n, int) else pytest.approx(n) for n in numbers]


@pytest.mark.parametrize("text,name", [
    ("pop", "stackunderflow"), ("1 true add", "typecheck"), ("1 0 div", "undefinedresult"), ("-1 sqrt", "undefinedresult"), ("2147483647 1 add", "rangecheck"), ("]", "unmatchedmark"), ("{", "syntaxerror"), ("/f (x) file", "invalidaccess"),
    ("0 0 lineto", "nocurrentpoint"), ("/Nope findfont", "invalidfont"), ("exit", "invalidexit"), ("end", "dictstackunderflow"), ("33 {gsave} repeat", "limitcheck"), ("foo", "undefined"), ("3 setlinecap", "rangecheck"), ("0 0 -1 0 90 arc", "rangecheck"), ("{} loop", "limitcheck"),
])
def test_named_errors(text, name):
    assert interpret(text)[1] == name


def test_shared_composites_and_order():
    assert interpret("/a [1 2] def /b a def b 0 9 put a 0 get")[0] == 9
    assert interpret("[<< /z 1 /a 2 >> {pop} forall] length")[0] == 2
    m = Interpreter()
    m.run("<< /z 1 /a 2 >> {pop} forall")
    assert m.stack == ["z", "a"]
    m.run("clear -2.5 round 1.0 type 5 string 12 exch cvs")
    assert m.stack[0] == -2.0 and m.stack[1] == "realtype" and bytes(m.stack[2]) == b"12   "
