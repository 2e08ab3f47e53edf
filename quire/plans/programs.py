"""Queries that compile stack programs over line items, with the SQL they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.stack import ProgramError, calculator, exponential, run_program
from quire.plans.common import table

KEYS = ("l_orderkey", "l_linenumber")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def cf_discounted_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the calculator {1 exch sub mul} over price and discount, summed by return flag."""
    (value,), _ = calculator("{1 exch sub mul}", [F.col("l_extendedprice"), F.col("l_discount")], outputs=1)
    return _items(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.sum(value), 2).alias("v"))


def _compiled(programs: dict[str, str], inputs: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = []
        for name, text in programs.items():
            out, error = calculator(text, [F.col(c) for c in inputs], outputs=1)
            cols += [F.round(out[0], 6).alias(name), error.alias(f"{name}_err")] if name.startswith("e_") else [F.round(out[0], 6).alias(name)]
        return _items(spark, sf_dir).select(*KEYS, *cols)

    return query


cf_arithmetic = _compiled({
    "v_abs": "{pop 1 sub abs}", "v_add": "{add}", "v_atan": "{atan}", "v_ceiling": "{mul ceiling}", "v_cos": "{pop cos}", "v_exp": "{exp}", "v_floor": "{mul floor}",
    "v_mul": "{mul}", "v_neg": "{pop neg}", "v_round": "{100 mul exch pop 2 div round}", "v_neground": "{100 mul exch pop 2 div neg round}", "v_sin": "{pop sin}", "v_sub": "{sub}", "v_truncate": "{mul neg truncate}",
}, ["l_quantity", "l_discount"])
CF_ARITHMETIC_SQL = """select l_orderkey, l_linenumber, round(abs(q - 1), 6) as v_abs, round(q + d, 6) as v_add, round(degrees(atan2(q, d)), 6) as v_atan, round(ceil(q * d), 6) as v_ceiling, round(cos(radians(q)), 6) as v_cos,
  round(pow(q, d), 6) as v_exp, round(floor(q * d), 6) as v_floor, round(q * d, 6) as v_mul, -q as v_neg, floor(d * 100 / 2 + 0.5) as v_round, -floor(d * 100 / 2 + 0.5) as v_neground, round(sin(radians(q)), 6) as v_sin,
  round(q - d, 6) as v_sub, -floor(q * d) as v_truncate from (select *, l_quantity as q, l_discount as d from lineitem)"""

cf_partial = _compiled({"e_div": "{div}", "e_idiv": "{100 mul round 3 idiv exch pop}", "e_mod": "{100 mul round neg 7 mod exch pop}", "e_ln": "{exch pop ln}", "e_log": "{exch pop log}", "e_sqrt": "{0.05 sub sqrt exch pop}", "e_idiv0": "{100 mul round idiv}"}, ["l_quantity", "l_discount"])
CF_PARTIAL_SQL = """select l_orderkey, l_linenumber, round(q / nullif(d, 0), 6) as e_div, case when d = 0 then 'undefinedresult' end as e_div_err,
  cast(trunc(k / 3) as double) as e_idiv, null::varchar as e_idiv_err, cast(-(k % 7) as double) as e_mod, null::varchar as e_mod_err,
  case when d > 0 then round(ln(case when d > 0 then d end), 6) end as e_ln, case when d <= 0 then 'undefinedresult' end as e_ln_err,
  case when d > 0 then round(log10(case when d > 0 then d end), 6) end as e_log, case when d <= 0 then 'undefinedresult' end as e_log_err,
  case when d - 0.05::double >= 0 then round(sqrt(case when d - 0.05::double >= 0 then d - 0.05::double end), 6) end as e_sqrt, case when d - 0.05::double < 0 then 'undefinedresult' end as e_sqrt_err,
  case when k <> 0 then trunc(q / k) end as e_idiv0, case when k = 0 then 'undefinedresult' end as e_idiv0_err
  from (select *, l_quantity as q, l_discount as d, floor(l_discount * 100 + 0.5)::bigint as k from lineitem)"""

cf_logic = _compiled({
    "v_and": "{pop 12 and}", "v_or": "{pop 12 or}", "v_xor": "{pop 12 xor}", "v_not": "{pop not}", "v_left": "{pop 3 bitshift}", "v_right": "{pop -2 bitshift}",
    "v_eq": "{eq {1} {0} ifelse}", "v_ne": "{ne {1} {0} ifelse}", "v_gt": "{gt {1} {0} ifelse}", "v_ge": "{ge {1} {0} ifelse}", "v_lt": "{lt {1} {0} ifelse}", "v_le": "{le {1} {0} ifelse}",
    "v_bool": "{2 copy gt 3 1 roll lt or not {7} {8} ifelse}", "v_if": "{exch dup 25 gt {2 mul} if exch pop}", "v_true": "{pop pop true false and {1} {2} ifelse}",
}, ["l_quantity", "l_linenumber"])
CF_LOGIC_SQL = """select l_orderkey, l_linenumber, (q & 12)::double as v_and, (q | 12)::double as v_or, xor(q, 12)::double as v_xor, (-q - 1)::double as v_not, (q * 8)::double as v_left, (q // 4)::double as v_right,
  (q = n)::int::double as v_eq, (q <> n)::int::double as v_ne, (q > n)::int::double as v_gt, (q >= n)::int::double as v_ge, (q < n)::int::double as v_lt, (q <= n)::int::double as v_le,
  case when q = n then 7.0 else 8.0 end::double as v_bool, case when q > 25 then 2 * q else q end::double as v_if, 2.0::double as v_true
  from (select *, l_quantity::bigint as q, l_linenumber as n from lineitem)"""

cf_stack = _compiled({"v_copy": "{2 copy add mul add}", "v_dup": "{dup mul sub}", "v_exch": "{exch sub}", "v_index": "{1 index sub exch pop}", "v_pop": "{pop}", "v_roll": "{5 3 1 roll 100 mul add add}", "v_rollback": "{5 3 -1 roll 100 mul add sub}"}, ["l_quantity", "l_tax"])
CF_STACK_SQL = """select l_orderkey, l_linenumber, round(q + t * (q + t), 6) as v_copy, round(q - t * t, 6) as v_dup, round(t - q, 6) as v_exch, round(t - q, 6) as v_index, q as v_pop,
  round(5 + (q + 100 * t), 6) as v_roll, round(t - (5 + 100 * q), 6) as v_rollback from (select *, l_quantity as q, l_tax as t from lineitem)"""


def cf_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential functions and the calculator's clipping; a failing function gives black."""
    x = F.col("l_discount") * 12
    out = exponential(x, [0.0, 1.0], [1.0, 0.25], 2.0)
    clipped, error = calculator("{dup 0.5 exch div}", [x], domain=[(0, 1)], ranges=[(0, 1), (0, 0.9)])
    return _items(spark, sf_dir).select(*KEYS, F.round(out[0], 6).alias("c0"), F.round(out[1], 6).alias("c1"), F.round(F.coalesce(clipped[0], F.lit(0.0)), 6).alias("d0"), F.round(F.coalesce(clipped[1], F.lit(0.0)), 6).alias("d1"), error.alias("err"))


CF_FUNCTIONS_SQL = """select l_orderkey, l_linenumber, round(t * t, 6) as c0, round(1.0::double + t * t * (-0.75::double), 6) as c1, round(case when t = 0 then 0 else t end, 6)::double as d0,
  round(case when t = 0 then 0 else least(0.9::double, 0.5::double / nullif(t, 0)) end, 6)::double as d1, case when t = 0 then 'undefinedresult' end as err
  from (select *, greatest(0.0::double, least(1.0::double, l_discount * 12)) as t from lineitem)"""


def ps_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit integers: overflow, division and sign rules; the first error names the row."""
    programs = {
        "v_add": "2147483600 add exch pop", "v_sub": "exch pop -2147483600 exch sub", "v_mul": "mul 3000 mul", "v_idiv": "exch neg exch idiv", "v_mod": "exch neg exch mod", "v_neg": "neg exch pop", "v_abs": "exch pop neg abs",
        "v_and": "and", "v_or": "or", "v_xor": "xor", "v_not": "pop not", "v_div": "div", "v_cvi": "div neg cvi", "v_bool": "gt not {1} {2} ifelse",
    }
    cols = []
    for name, text in programs.items():
        stack, error = run_program(text, F.col("l_partkey"), F.floor("l_quantity") - 1, kinds=("int", "int"))
        cols += [(F.round(stack[-1].col, 6) if stack[-1].kind == "real" else stack[-1].col).alias(name), error.alias(f"{name}_err")]
    return _items(spark, sf_dir).select(*KEYS, *cols)


PS_INTEGERS_SQL = """with t as (select *, l_partkey as a, floor(l_quantity)::bigint - 1 as b from lineitem)
select l_orderkey, l_linenumber, case when b + 2147483600 <= 2147483647 then b + 2147483600 end as v_add, case when b + 2147483600 > 2147483647 then 'rangecheck' end as v_add_err,
  case when -2147483600 - b >= -2147483648 then -2147483600 - b end as v_sub, case when -2147483600 - b < -2147483648 then 'rangecheck' end as v_sub_err,
  case when a * b * 3000 <= 2147483647 then a * b * 3000 end as v_mul, case when a * b * 3000 > 2147483647 then 'rangecheck' end as v_mul_err,
  case when b <> 0 then -(a // nullif(b, 0)) end as v_idiv, case when b = 0 then 'undefinedresult' end as v_idiv_err, case when b <> 0 then -(a % nullif(b, 0)) end as v_mod, case when b = 0 then 'undefinedresult' end as v_mod_err,
  -b as v_neg, null::varchar as v_neg_err, b as v_abs, null::varchar as v_abs_err, a & b as v_and, null::varchar as v_and_err, a | b as v_or, null::varchar as v_or_err, xor(a, b) as v_xor, null::varchar as v_xor_err, -a - 1 as v_not, null::varchar as v_not_err,
  case when b <> 0 then round(a / nullif(b, 0)::double, 6) end as v_div, case when b = 0 then 'undefinedresult' end as v_div_err, case when b <> 0 then -(a // nullif(b, 0)) end as v_cvi, case when b = 0 then 'undefinedresult' end as v_cvi_err,
  case when a > b then 2 else 1 end as v_bool, null::varchar as v_bool_err from t"""


def ps_reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reals: rounding half up, degrees, comparison and type names."""
    programs = {"v_round": "pop 2 div neg round", "v_ceil": "mul ceiling", "v_floor": "mul neg floor", "v_sqrt": "exch pop 0.05 sub sqrt", "v_cos": "pop cos", "v_sin": "pop sin", "v_index": "1 index add mul", "v_roll": "7 3 1 roll sub mul", "v_ge": "ge {10} {20} ifelse"}
    cols = []
    for name, text in programs.items():
        stack, error = run_program(text, F.col("l_quantity"), F.col("l_discount"))
        cols += [F.round(stack[-1].col, 6).alias(name)] + ([error.alias(f"{name}_err")] if name == "v_sqrt" else [])
    kinds, _ = run_program("type exch type", F.col("l_quantity"), F.col("l_linenumber"), kinds=("real", "int"))
    return _items(spark, sf_dir).select(*KEYS, *cols, kinds[0].col.alias("t_top"), kinds[1].col.alias("t_below"))


PS_REALS_SQL = """select l_orderkey, l_linenumber, floor(-(q / 2) + 0.5) as v_round, ceil(q * d) as v_ceil, floor(-(q * d)) as v_floor, case when d - 0.05::double >= 0 then round(sqrt(case when d - 0.05::double >= 0 then d - 0.05::double end), 6) end as v_sqrt,
  case when d - 0.05::double < 0 then 'undefinedresult' end as v_sqrt_err, round(cos(radians(q)), 6) as v_cos, round(sin(radians(q)), 6) as v_sin, round(q * (d + q), 6) as v_index, round(7 * (q - d), 6) as v_roll,
  case when q >= d then 10.0 else 20.0 end::double as v_ge, 'integertype' as t_top, 'realtype' as t_below from (select *, l_quantity as q, l_discount as d from lineitem)"""


def ps_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, dictionaries, marks, scopes and strings, resolved while compiling or per row."""
    programs = {
        "v_array": "/n exch def [10 20 30 40] n get", "v_sum": "pop 0 [1 2 3 4] {add} forall", "v_dict": "/x exch def << /a x /b 5 >> begin a b add end", "v_count": "pop mark 1 2 3 counttomark exch pop exch pop exch pop exch pop",
        "v_put": "/x exch def /v 3 array def v 0 x put v 0 get", "v_known": "pop << /k 1 >> /k known {1} {0} ifelse", "v_where": "pop /zz where {pop 1} {0} ifelse", "v_len": "pop (four) length", "v_load": "/q exch def /q load 2 mul",
        "v_proc": "/sq {dup mul} bind def sq", "v_store": "/y 1 def /y exch store y", "v_byte": "(ABCD) exch get",
    }
    cols = []
    for name, text in programs.items():
        stack, error = run_program(text, F.col("l_linenumber") - 1, kinds=("int",))
        cols += [stack[-1].col.alias(name)] + ([error.alias(f"{name}_err")] if name in ("v_array", "v_byte") else [])
    return _items(spark, sf_dir).select(*KEYS, *cols)


PS_CONTAINERS_SQL = """with t as (select *, (l_linenumber - 1)::bigint as n from lineitem) select l_orderkey, l_linenumber, case when n < 4 then (n + 1) * 10 end as v_array, case when n >= 4 then 'rangecheck' end as v_array_err, 10::bigint as v_sum, n + 5 as v_dict, 3::bigint as v_count,
  n as v_put, 1::bigint as v_known, 0::bigint as v_where, 4::bigint as v_len, n * 2 as v_load, n * n as v_proc, n as v_store, case when n < 4 then 65 + n end as v_byte, case when n >= 4 then 'rangecheck' end as v_byte_err from t"""


def ps_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops unrolled at compile time, nested branches per row."""
    programs = {
        "v_repeat": "3 {2 mul} repeat", "v_for": "0 exch 1 1 5 {1 index mul 3 -1 roll add exch} for pop", "v_down": "pop 0 10 -3 1 {add} for", "v_exit": "pop 0 1 1 9 {dup 5 eq {exit} if add} for exch pop",
        "v_if": "dup 3 gt {dup 5 gt {100 add} {10 add} ifelse} if", "v_exec": "{1 add} exec", "v_string": "pop 0 (AZ) {add} forall",
    }
    cols = [run_program(text, F.col("l_linenumber"), kinds=("int",))[0][-1].col.alias(name) for name, text in programs.items()]
    return _items(spark, sf_dir).select(*KEYS, *cols)


PS_CONTROL_SQL = """with t as (select *, l_linenumber::bigint as n from lineitem) select l_orderkey, l_linenumber, n * 8 as v_repeat, n * 15 as v_for, (10 + 7 + 4 + 1)::bigint as v_down, 5::bigint as v_exit,
  case when n > 5 then n + 100 when n > 3 then n + 10 else n end as v_if, n + 1 as v_exec, 155::bigint as v_string from t"""


def ps_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults that no row can avoid, named while compiling."""
    programs = ("pop pop", "1 (a) add", "{", "file", "run", "deletefile", "renamefile", "filenameforall", "nosuchname", "cleartomark", "]", "1 0 5 {} for", "-1 array", "end", "exit", "21 {1 dict begin} repeat", "[1 2] 5 get", "<< /a 1 >> /b get", "true 1 and", "-1 {} repeat", "{} loop")
    rows = []
    for text in programs:
        try:
            run_program(text, F.lit(1), kinds=("int",))
            rows.append((text, None))
        except ProgramError as e:
            rows.append((text, e.name))
    return spark.createDataFrame(rows, "program string, error string")


PS_REFUSALS_SQL = """select * from (values ('pop pop', 'stackunderflow'), ('1 (a) add', 'typecheck'), ('{', 'syntaxerror'), ('file', 'invalidaccess'), ('run', 'invalidaccess'), ('deletefile', 'invalidaccess'), ('renamefile', 'invalidaccess'),
  ('filenameforall', 'invalidaccess'), ('nosuchname', 'undefined'), ('cleartomark', 'unmatchedmark'), (']', 'unmatchedmark'), ('1 0 5 {} for', 'rangecheck'), ('-1 array', 'rangecheck'), ('end', 'dictstackunderflow'), ('exit', 'invalidexit'),
  ('21 {1 dict begin} repeat', 'limitcheck'), ('[1 2] 5 get', 'rangecheck'), ('<< /a 1 >> /b get', 'undefined'), ('true 1 and', 'typecheck'), ('-1 {} repeat', 'rangecheck'), ('{} loop', 'limitcheck')) t(program, error)"""

QUERIES = {
    "cf_discounted_price": cf_discounted_price, "cf_arithmetic": cf_arithmetic, "cf_partial": cf_partial, "cf_logic": cf_logic, "cf_stack": cf_stack, "cf_functions": cf_functions,
    "ps_integers": ps_integers, "ps_reals": ps_reals, "ps_containers": ps_containers, "ps_control": ps_control, "ps_refusals": ps_refusals,
}
SQL = {
    "cf_discounted_price": "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as v from lineitem group by 1", "cf_arithmetic": CF_ARITHMETIC_SQL, "cf_partial": CF_PARTIAL_SQL, "cf_logic": CF_LOGIC_SQL,
    "cf_stack": CF_STACK_SQL, "cf_functions": CF_FUNCTIONS_SQL, "ps_integers": PS_INTEGERS_SQL, "ps_reals": PS_REALS_SQL, "ps_containers": PS_CONTAINERS_SQL, "ps_control": PS_CONTROL_SQL, "ps_refusals": PS_REFUSALS_SQL,
}
