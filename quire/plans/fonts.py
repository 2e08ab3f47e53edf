"""Queries over fonts, codes, masks and trees, with the SQL they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import fonts, trees
from quire.operators.rules import language_tag
from quire.plans.common import PIXELS_SQL, dealt, pixels, table
from quire.sources.graphics import HELVETICA

_WIDTHS = "w as (select unnest(range(32, 127)) as code, unnest([" + ", ".join(map(str, HELVETICA)) + "])::double as width)"


def string_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each document set in 12-point Helvetica with word and character spacing; other characters have none."""
    chars = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).groupBy("doc_id", F.ascii("c").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    w = chars.join(F.broadcast(fonts.helvetica(spark)), "code")
    return w.groupBy("doc_id").agg(F.round(F.sum(fonts.advance(F.col("width"), F.lit(12.0), F.col("code"), 0.25, 1.5, 0.9) * F.col("n")), 3).alias("advance"), F.sum("n").alias("chars"))


STRING_WIDTHS_SQL = f"""with {_WIDTHS}, c as (select doc_id, ascii(c) as code, count(*) as n from (select doc_id, unnest(string_split(text, '')) as c from documents) where c <> '' group by 1, 2)
select doc_id, round(sum(((width / 1000 * 12 + 0.25) * 0.9 + case when code = 32 then 1.35 else 0 end) * n), 3)::double as advance, sum(n)::bigint as chars from c join w using (code) group by doc_id"""


def width_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("font"), F.col("p_size").alias("first"), (F.col("p_size") + F.col("p_partkey") % 20).cast("int").alias("last"), F.round(F.col("p_retailprice"), 2).alias("width"))
    return fonts.cid_widths(r)


WIDTH_RANGES_SQL = "select p_partkey as font, unnest(range(p_size, (p_size + p_partkey % 20 + 1)::int))::int as cid, round(p_retailprice, 2) as width from part"


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by code: a base encoding, differences over it, and a later map where it has text."""
    base = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("font"), (F.col("c_custkey") % 256).alias("code")).distinct().withColumn("name", F.concat(F.lit("g"), F.col("code").cast("string")))
    diff = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("font"), (F.col("o_orderkey") % 256).alias("code"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("seq")).where("code % 3 = 0")
    laid = fonts.overlay(base, diff, ["font", "code"], "name")
    text = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 256).alias("code"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("text")).groupBy("code").agg(F.max("text").alias("text"))
    return laid.join(text, "code", "left").select("font", "code", F.coalesce("text", "name").alias("name"))


ENCODINGS_SQL = """with b as (select distinct c_custkey % 40 as font, c_custkey % 256 as code, 'g' || (c_custkey % 256) as name from customer),
d as (select o_custkey % 40 as font, o_orderkey % 256 as code, arg_max('d' || o_orderkey, o_orderkey) as name from orders where o_orderkey % 256 % 3 = 0 group by 1, 2),
u as (select s_suppkey % 256 as code, max('u' || s_suppkey) as text from supplier group by 1)
select font, code, coalesce(u.text, d.name, b.name) as name from b full join d using (font, code) left join u using (code)"""


def used_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").withColumn("code", F.ascii("c"))
    each = fonts.used_codes(g, ["lang", "source"])
    union = each.groupBy("lang").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("all_codes"))
    return each.join(union, "lang").select("lang", "source", F.size("codes").alias("n"), F.md5(F.array_join(F.transform("codes", lambda x: x.cast("string")), ",")).alias("codes_md5"), F.size("all_codes").alias("n_lang"))


USED_CODES_SQL = """with g as (select distinct lang, source, ascii(c) as code from (select lang, source, unnest(list_distinct(string_split(text, ''))) as c from documents) where c <> ''),
e as (select lang, source, count(*) as n, md5(string_agg(code::varchar, ',' order by code)) as codes_md5 from g group by 1, 2), u as (select lang, count(distinct code) as n_lang from g group by 1)
select lang, source, n::int as n, codes_md5, n_lang::int as n_lang from e join u using (lang)"""


def font_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset tags, table checksums, UTF-16 text and ordered digests of documents."""
    utf = F.decode(F.encode("text", "UTF-16BE"), "UTF-16BE")
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return docs.select("doc_id", fonts.subset_tag(F.col("text")).alias("tag"), fonts.checksum(F.col("text")).alias("checksum"), F.md5(utf).alias("utf16_md5"), F.sha2(F.concat("source", F.lit("\n"), "lang", F.lit("\n"), "text"), 256).alias("digest"))


FONT_DIGESTS_SQL = """with h as (select doc_id, text, source, lang, sha256(text) as s, hex(encode(text)) as x from documents),
p as (select *, rpad(x, ((length(x) + 7) // 8 * 8)::int, '0') as y from h)
select doc_id, array_to_string(list_transform(range(0, 6), lambda i: chr((65 + ('0x' || substring(s, 2 * i + 1, 2))::int % 26)::int)), '') as tag,
(coalesce(list_sum(list_transform(range(0, length(y) // 8), lambda i: ('0x' || substring(y, 8 * i + 1, 8))::bigint)), 0) % 4294967296)::bigint as checksum, md5(text) as utf16_md5, sha256(source || chr(10) || lang || chr(10) || text) as digest from p"""


def order_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over the ordered parts of each order."""
    part = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("p")))).alias("ps"))
    return parts.select("l_orderkey", F.sha2(F.array_join(F.transform("ps", lambda s: s["p"]), "\n"), 256).alias("digest"))


ORDER_DIGESTS_SQL = "select l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey, chr(10) order by l_linenumber, l_partkey)) as digest from lineitem group by 1"


def image_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour-key masks, a stencil bit, a product of two alpha planes, and luminosity coverage."""
    px = pixels(spark, sf_dir)
    key = F.forall(F.zip_with(F.array("r", "g", "b"), F.array(F.lit(100), F.lit(0), F.lit(30)), lambda v, lo: (v >= lo) & (v <= lo + 150)), lambda x: x)
    stencil = F.getbit(F.col("r").cast("long"), (F.col("c_") % 8).cast("int"))
    alpha = F.floor(F.col("g") * F.col("b") / 255 + 0.5).cast("int")
    luma = (F.col("r") * 0.3 + F.col("g") * 0.59 + F.col("b") * 0.11) * F.when(key, 0.0).otherwise(1.0)
    return px.select("page", "r_", "c_", F.when(key, 0).otherwise(255).alias("key_alpha"), (stencil * 255).cast("int").alias("stencil"), alpha.alias("alpha"), F.round(luma, 4).alias("luminosity"))


IMAGE_MASKS_SQL = f"""with {PIXELS_SQL}, k as (select *, r between 100 and 250 and g between 0 and 150 and b between 30 and 180 as key from px)
select page, r_, c_, case when key then 0 else 255 end as key_alpha, ((r >> (c_ % 8)::int) & 1) * 255 as stencil, cast(floor(g * b / 255::double + 0.5) as int) as alpha, round((r * 0.3::double + g * 0.59::double + b * 0.11::double) * case when key then 0 else 1 end, 4) as luminosity from k"""


def row_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row predictors as prefix sums modulo 256, and their inverse."""
    from pyspark.sql import Window

    px = pixels(spark, sf_dir)
    w = Window.partitionBy("page", "r_").orderBy("c_")
    delta = F.pmod(F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0)), F.lit(256))
    d = px.withColumn("d", delta)
    return d.select("page", "r_", "c_", "d", F.pmod(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(256)).cast("int").alias("back"))


ROW_DELTAS_SQL = f"""with {PIXELS_SQL} select page, r_, c_, ((r - coalesce(lag(r) over w, 0)) % 256 + 256) % 256 as d, (r % 256)::int as back from px window w as (partition by page, r_ order by c_)"""


def actual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as a tree of parts: the nearest ancestor's replacement text and page, and leaves whose claim disagrees."""
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(k.alias("k"), F.floor((k - 1) / 4).cast("long").alias("parent"), F.when(k % 9 == 0, F.col("p_name")).alias("covered_by"), F.when(k % 5 == 0, k % 50).alias("page"))
    return trees.descend(n, "k", "parent", F.col("parent") == 0, ["covered_by", "page"]).select("k", "covered_by", "page", "depth")


ACTUAL_TEXT_SQL = """with recursive n as (select p_partkey as k, cast(floor((p_partkey - 1) / 4) as bigint) as parent, case when p_partkey % 9 = 0 then p_name end as txt, case when p_partkey % 5 = 0 then p_partkey % 50 end as pg from part),
t as (select k, txt, pg, cast(0 as bigint) as depth from n where parent = 0 union all select n.k, coalesce(n.txt, t.txt), coalesce(n.pg, t.pg), t.depth + 1 from n join t on n.parent = t.k)
select k, txt as covered_by, pg as page, depth from t"""


def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat("lang", F.element_at(F.array(*map(F.lit, ("", "-US", "-x", "_DE", "-verylongsubtag", "1", "-Latn-DE"))), (F.col("doc_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag"), language_tag(tag).alias("ok"))


LANGUAGE_TAGS_SQL = """with t as (select doc_id, lang || ['', '-US', '-x', '_DE', '-verylongsubtag', '1', '-Latn-DE'][doc_id % 7 + 1] as tag from documents) select doc_id, tag, regexp_matches(tag, '^([A-Za-z]{2,3}|[ix])(-[A-Za-z0-9]{1,8})*$') as ok from t"""

QUERIES = {f.__name__: f for f in (string_widths, width_ranges, encodings, used_codes, font_digests, order_digests, image_masks, row_deltas, actual_text, language_tags)}
SQL = {"string_widths": STRING_WIDTHS_SQL, "width_ranges": WIDTH_RANGES_SQL, "encodings": ENCODINGS_SQL, "used_codes": USED_CODES_SQL, "font_digests": FONT_DIGESTS_SQL, "order_digests": ORDER_DIGESTS_SQL,
       "image_masks": IMAGE_MASKS_SQL, "row_deltas": ROW_DELTAS_SQL, "actual_text": ACTUAL_TEXT_SQL, "language_tags": LANGUAGE_TAGS_SQL}
