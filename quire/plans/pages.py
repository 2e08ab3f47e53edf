"""Queries over pixels, colours, shapes and comparisons, with the SQL they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import colour as C
from quire.operators import compare, measure, raster
from quire.plans.common import PIXELS_SQL, dealt_by, pixels, table


def measure_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.bounding_box(pixels(spark, sf_dir).where("r_ between 5 and 40 and c_ > 7 or r <> 255"), 64, dpi=144.0)


MEASURE_BOX_SQL = f"""with {PIXELS_SQL}, m as (select *, r <> 255 or g <> 255 or b <> 255 as k from px where r_ between 5 and 40 and c_ > 7 or r <> 255)
select page, bool_or(k) as found, min(c_) filter (where k) * 0.5 as llx, (63 - max(r_) filter (where k)) * 0.5 as lly, (max(c_) filter (where k) + 1) * 0.5 as urx, (64 - min(r_) filter (where k)) * 0.5 as ury from m group by page"""


def measure_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return measure.ink(px, 4096).join(measure.ink_amount(px, 4096), "page")


MEASURE_INK_SQL = f"""with {PIXELS_SQL} select page, {', '.join(f"count(*) filter (where {c} <> 255) / 4096.0::double as ink_{c}, sum(255 - {c}) / (4096.0::double * 255) as amount_{c}" for c in 'rgb')} from px group by page"""


def colour_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device spaces, profiles, tints and conversions over line items."""
    t = table(spark, sf_dir, "lineitem")
    q, d, x = F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12
    cols: dict = {}
    for name, out in {
        "rgb": C.rgb(q * 1.2, d - 0.2, x), "gray": C.gray(x * 1.3), "cmyk": C.cmyk(q, d, x, d * x), "icc": C.icc([q, d, x, F.lit(0.25)]), "alt": C.icc([q], C.gray, 1),
        "sep": C.tint("{dup 0.5 mul exch dup 0.25 mul exch}", [q], C.rgb, 3), "devn": C.tint("{1 index 1 index mul 3 1 roll}", [q, d], C.rgb, 3),
    }.items():
        cols |= {f"{name}_{c}": F.round(v, 6) for c, v in zip("rgb", out)}
    r, g, b = (C.to_byte(v) for v in (q, d, x))
    cols |= {"byte_r": r, "byte_g": g, "byte_b": b, "luma": C.luma(r, g, b)} | {f"k_{c}": F.round(v, 6) for c, v in zip("cmyk", C.rgb_to_cmyk(r, g, b))}
    return t.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in cols.items()])


_CL = "greatest(0.0::double, least(1.0::double, {}))".format
COLOUR_SPACES_SQL = f"""with t as (select l_orderkey, l_linenumber, l_quantity / 50 as q, l_discount * 10 as d, l_tax * 12 as x from lineitem),
b as (select *, cast(floor({_CL('q')} * 255 + 0.5) as int) as br, cast(floor({_CL('d')} * 255 + 0.5) as int) as bg, cast(floor({_CL('x')} * 255 + 0.5) as int) as bb from t),
k as (select *, 1 - greatest(br, bg, bb) / 255.0::double as kk from b)
select l_orderkey, l_linenumber, round({_CL('q * 1.2::double')}, 6) as rgb_r, round({_CL('d - 0.2::double')}, 6) as rgb_g, round({_CL('x')}, 6) as rgb_b, {', '.join(f"round({_CL('x * 1.3::double')}, 6) as gray_{c}" for c in 'rgb')},
{', '.join(f"round((1 - {_CL(v)}) * (1 - {_CL('d * x')}), 6) as cmyk_{c}" for c, v in zip('rgb', 'qdx'))}, {', '.join(f"round((1 - {_CL(v)}) * 0.75::double, 6) as icc_{c}" for c, v in zip('rgb', 'qdx'))}, {', '.join(f"round({_CL('q')}, 6) as alt_{c}" for c in 'rgb')},
round({_CL('q')} * 0.5, 6) as sep_r, round({_CL('q')} * 0.25, 6) as sep_g, round({_CL('q')}, 6) as sep_b, round({_CL('q')} * {_CL('d')}, 6) as devn_r, round({_CL('q')}, 6) as devn_g, round({_CL('d')}, 6) as devn_b,
br as byte_r, bg as byte_g, bb as byte_b, floor(0.299::double * br + 0.587::double * bg + 0.114::double * bb + 0.5) as luma,
{', '.join(f"round(case when kk < 1 then (1 - {v} / 255.0::double - kk) / (1 - kk) else 0 end, 6) as k_{c}" for c, v in zip('cmy', ('br', 'bg', 'bb')))}, round(kk, 6) as k_k from k"""


def blend_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All separable modes, and one composite of bytes."""
    d, s = F.col("l_quantity") / 50, F.col("l_discount") * 10
    modes = [F.round(f(d, s), 6).alias(f"v_{m.lower()}") for m, f in C.BLEND.items()]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *modes, C.composite(C.to_byte(d), C.to_byte(s), F.lit(0.25), "Screen").alias("mixed"))


BLEND_MODES_SQL = """with t as (select l_orderkey, l_linenumber, l_quantity / 50 as d, l_discount * 10 as s from lineitem), b as (select *, floor(d * 255 + 0.5) / 255 as db, floor(least(1.0::double, s) * 255 + 0.5) / 255 as sb from t)
select l_orderkey, l_linenumber, round(s, 6) as v_normal, round(d * s, 6) as v_multiply, round(d + s - d * s, 6) as v_screen, round(case when d <= 0.5 then 2 * d * s else 1 - 2 * (1 - d) * (1 - s) end, 6) as v_overlay, round(least(d, s), 6) as v_darken,
round(greatest(d, s), 6) as v_lighten, round(case when d <= 0 then 0.0 when s >= 1 then 1.0 else least(1.0::double, d / nullif(1 - s, 0)) end, 6)::double as v_colordodge, round(case when d >= 1 then 1.0 when s <= 0 then 0.0 else 1 - least(1.0::double, (1 - d) / nullif(s, 0)) end, 6)::double as v_colorburn,
round(case when s <= 0.5 then 2 * d * s else 1 - 2 * (1 - d) * (1 - s) end, 6) as v_hardlight, round(case when s <= 0.5 then d - (1 - 2 * s) * d * (1 - d) else d + (2 * s - 1) * ((case when d <= 0.25 then ((16 * d - 12) * d + 4) * d else sqrt(d) end) - d) end, 6) as v_softlight,
round(abs(d - s), 6) as v_difference, round(d + s - 2 * d * s, 6) as v_exclusion, cast(floor(((db + sb - db * sb) * 0.25::double + db * 0.75::double) * 255 + 0.5) as int) as mixed from b"""


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.matrix_concat(C.matrix_concat(C.translation(F.col("l_quantity"), F.lit(3.0)), C.rotation(F.col("l_linenumber") * 15)), C.scaling(F.lit(2.0), F.col("l_discount") * 100))
    x, y = C.matrix_apply(m, F.lit(5.0), F.lit(7.0))
    back = C.matrix_apply(C.matrix_invert(m), x, y)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 5).alias(n) for n, v in zip(("x", "y", "bx", "by_"), (x, y, *back))])


MATRICES_SQL = """with t as (select l_orderkey, l_linenumber, 5 + l_quantity as px, cos(radians(l_linenumber * 15)) as c, sin(radians(l_linenumber * 15)) as s, l_discount * 100 as k from lineitem)
select l_orderkey, l_linenumber, round(2 * (px * c - 10 * s), 5) as x, round(k * (px * s + 10 * c), 5) as y, case when k <> 0 then 5.0 end::double as bx, case when k <> 0 then 7.0 end::double as by_ from t"""


def polygon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles from orders filled on a page of 64 by 64: pixels by shape, and the area's measure."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pts = [(k % 50 + 0.25, c % 40 + 0.25), (k % 50 + 12.5, c % 40 + 3.25), (k % 31 + 4.75, c % 40 + 20.5)]
    points = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(i == 0).alias("move")) for i, (x, y) in enumerate(pts)])
    return raster.fill_paths(o.select(k.alias("path_id"), "o_orderkey", "o_custkey"), points, 64, 64, totals=True)


POLYGON_FILL_SQL = """with p as (select o_orderkey as k, o_orderkey % 50 + 0.25::double as xa, o_custkey % 40 + 0.25::double as ya, o_orderkey % 50 + 12.5::double as xb, o_custkey % 40 + 3.25::double as yb, o_orderkey % 31 + 4.75::double as xc, o_custkey % 40 + 20.5::double as yc from orders),
e as (select k, xa as x0, ya as y0, xb as x1, yb as y1 from p union all select k, xb, yb, xc, yc from p union all select k, xc, yc, xa, ya from p),
r as (select k, r, 64 - r - 0.5::double as cy, x0 + (64 - r - 0.5::double - y0) / (y1 - y0) * (x1 - x0) as x, case when y1 > y0 then 1 else -1 end as dir from e, range(64) t(r) where y0 <> y1 and 64 - r - 0.5::double >= least(y0, y1) and 64 - r - 0.5::double < greatest(y0, y1)),
i as (select k, r, c, sum(dir) as w from r, range(64) u(c) where x > c + 0.5::double group by k, r, c)
select k as path_id, count(*) as n, sum(r)::bigint as rows, sum(c)::bigint as cols from i where w <> 0 group by k"""


def stroke_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    seg = o.select(k.alias("path_id"), (k % 60).cast("double").alias("x0"), (c % 60).cast("double").alias("y0"), (c % 55 + 3).cast("double").alias("x1"), (k % 47 + 9).cast("double").alias("y1"))
    return raster.stroke(seg, 1.25, 64, 64, totals=True)


STROKE_SEGMENTS_SQL = """with s as (select o_orderkey as k, (o_orderkey % 60)::double as x0, (o_custkey % 60)::double as y0, (o_custkey % 55 + 3)::double as x1, (o_orderkey % 47 + 9)::double as y1 from orders),
d as (select k, r, c, x0, y0, x1 - x0 as dx, y1 - y0 as dy, c + 0.5::double as px, 64 - r - 0.5::double as py from s, range(64) a(r), range(64) b(c)),
t as (select *, greatest(0.0::double, least(1.0::double, coalesce(((px - x0) * dx + (py - y0) * dy) / nullif(dx * dx + dy * dy, 0), 0))) as u from d)
select k as path_id, count(*) as n, sum(r)::bigint as rows, sum(c)::bigint as cols from t where sqrt(pow(px - x0 - u * dx, 2) + pow(py - y0 - u * dy, 2)) <= 1.25::double group by k"""


def paint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks with alpha and blend modes folded in paint order; bytes round after each mark."""
    t = table(spark, sf_dir, "lineitem")
    mode = F.element_at(F.array(*map(F.lit, ("Normal", "Multiply", "Screen", "Difference"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    marks = t.select((F.col("l_suppkey") % 4).alias("page"), (F.col("l_partkey") % 32).alias("row"), (F.col("l_orderkey") % 32).alias("col"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
                     (F.col("l_quantity") * 5).cast("int").alias("r"), F.floor(F.col("l_discount") * 2000 + 0.5).cast("int").alias("g"), F.lit(128).alias("b"), F.when(F.col("l_linenumber") < 4, 0.5).otherwise(1.0).alias("alpha"), mode.alias("mode"))
    marks = marks.groupBy("page", "row", "col", "seq").agg(*[F.max(c).alias(c) for c in ("r", "g", "b", "alpha", "mode")])
    last = raster.paint(marks).withColumnsRenamed({c: f"last_{c}" for c in "rgb"})
    return raster.fold_marks(marks).join(last, ["page", "row", "col"])


def _byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 9
    other = F.when(k < 3, t).when(k < 6, F.substring(t, 1, (F.char_length(t) / 2).cast("int"))).otherwise(F.concat(F.substring(t, 1, 10), F.lit("#"), F.substring(t, 12, 1 << 30)))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("a"), other.alias("b"))


def compare_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte pairs made from documents: equal copies, prefixes and single changes."""
    same, offset, reason = compare.compare_bytes(F.col("a"), F.col("b"))
    return _byte_pairs(spark, sf_dir).select("doc_id", same.alias("equal"), offset.alias("offset"), reason.alias("reason"))


COMPARE_BYTES_SQL = """with p as (select doc_id, text as a, doc_id % 9 as k from documents),
q as (select doc_id, hex(encode(a)) as ha, hex(encode(case when k < 3 then a when k < 6 then substring(a, 1, length(a) // 2) else substring(a, 1, 10) || '#' || substring(a, 12) end)) as hb from p),
f as (select *, least(length(ha), length(hb)) // 2 as n from q),
z as (select *, case when n > 0 then list_position(list_transform(range(1, n + 1), lambda i: substring(ha, 2 * i - 1, 2) <> substring(hb, 2 * i - 1, 2)), true) end as p from f)
select doc_id, ha = hb as equal, case when ha = hb then -1 else coalesce(nullif(p, 0) - 1, n) end::bigint as offset, case when ha = hb then 'equal' when coalesce(p, 0) > 0 then 'byte' else 'length' end as reason from z"""


def compare_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    other = px.withColumn("g", F.when((F.col("page") == 1) & (F.col("r_") == 30) & (F.col("c_") > 9), 255 - F.col("g")).otherwise(F.col("g"))).where("not (page = 2 and r_ = 40)")
    return compare.compare_rasters(px, other, F.lit(64))


COMPARE_RASTERS_SQL = f"""with {PIXELS_SQL}, o as (select page, r_, c_, r, case when page = 1 and r_ = 30 and c_ > 9 then 255 - g else g end as g, b from px where not (page = 2 and r_ = 40)),
j as (select page, (r_ * 64 + c_) * 3 + case when coalesce(px.r, 255) <> coalesce(o.r, 255) then 0 when coalesce(px.g, 255) <> coalesce(o.g, 255) then 1 when coalesce(px.b, 255) <> coalesce(o.b, 255) then 2 end as p from px full join o using (page, r_, c_))
select page, coalesce(min(p), -1)::bigint as offset from j group by page"""


def compare_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and their lines as pages: the first page that differs after a change."""
    lines = dealt_by(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_quantity"), "doc_id")
    t = lines.groupBy("doc_id", "page").agg(F.md5(F.max("l_quantity").cast("int").cast("string")).alias("digest"))
    other = t.where("not (doc_id % 5 = 0 and page = 3)").withColumn("digest", F.when((F.col("doc_id") % 7 == 0) & (F.col("page") > 1), F.lit("x")).otherwise(F.col("digest")))
    return compare.first_failing_page(t, other)


COMPARE_PAGE_LISTS_SQL = """with t as (select l_orderkey as doc_id, l_linenumber as page, md5(cast(cast(max(l_quantity) as int) as varchar)) as digest from lineitem group by 1, 2),
o as (select doc_id, page, case when doc_id % 7 = 0 and page > 1 then 'x' else digest end as digest from t where not (doc_id % 5 = 0 and page = 3)),
j as (select doc_id, count(t.digest) as n1, count(o.digest) as n2, min(page) filter (where t.digest is distinct from o.digest) as p from t full join o using (doc_id, page) group by doc_id)
select doc_id, case when n1 <> n2 then 'length' when p is not null then 'page' else 'equal' end as reason, case when n1 = n2 then p end as page from j"""


def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, error = measure.page_geometry(F.col("p_size") * 20 - 40, F.col("p_retailprice"), F.col("p_partkey") % 700)
    a, b = measure.resample_size(F.col("p_size") * 37, F.col("p_partkey") % 1900 + 1, 842)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), error.alias("err"), a.alias("rw"), b.alias("rh"))


PAGE_GEOMETRY_SQL = """with t as (select p_partkey, p_size, case when p_partkey % 700 > 0 then p_partkey % 700 else 72 end::double as d, p_size * 20 - 40 as w0, p_retailprice as h0 from part),
u as (select *, ceil(case when w0 > 0 then w0 else 612.0 end::double * d / 72)::bigint as w, ceil(case when h0 > 0 then h0 else 792.0 end::double * d / 72)::bigint as h, least(1.0::double, 842.0::double / greatest(p_size * 37, p_partkey % 1900 + 1)) as k from t)
select p_partkey, w, h, case when w > 20000 or h > 20000 or w * h > 40000000 then 'limitcheck' end as err, greatest(1, cast(floor(p_size * 37 * k + 0.5) as int)) as rw, greatest(1, cast(floor((p_partkey % 1900 + 1) * k + 0.5) as int)) as rh from u"""

QUERIES = {f.__name__: f for f in (measure_box, measure_ink, colour_spaces, blend_modes, matrices, polygon_fill, stroke_segments, paint_marks, compare_bytes, compare_rasters, compare_page_lists, page_geometry)}
SQL = {"measure_box": MEASURE_BOX_SQL, "measure_ink": MEASURE_INK_SQL, "colour_spaces": COLOUR_SPACES_SQL, "blend_modes": BLEND_MODES_SQL, "matrices": MATRICES_SQL, "polygon_fill": POLYGON_FILL_SQL, "stroke_segments": STROKE_SEGMENTS_SQL,
       "compare_bytes": COMPARE_BYTES_SQL, "compare_rasters": COMPARE_RASTERS_SQL, "compare_page_lists": COMPARE_PAGE_LISTS_SQL, "page_geometry": PAGE_GEOMETRY_SQL}
