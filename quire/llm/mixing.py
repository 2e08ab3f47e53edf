"""Mixing sources to target weights.

Every document gets a hash-random key (MD5 of its id). Keys are range-sorted
inside their source: the first three hex digits name one of 4096 ranges, so a
source that holds a third of all rows still spreads over 4096 tasks. Sums of
sizes per (source, range) give each range its offset, a running sum inside the
range gives each document its prefix, and the prefix is cut at the source's
exact budget after whole epochs have been taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE_WORD, fresh, save

SHARE, MAX_EPOCHS, WEIGHTS = 1.5, 2, (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: (s_null, s_name, source_size), a row for each source. Adds ``target``.

    Resharing the excess over a cap until nobody is above it has a closed form:
    with sources sorted by cap / weight, all up to some point stop at their caps and
    the others share what is left in proportion to their weights. The windows run
    over one row per source, not over documents.
    """
    order = Window.orderBy("s_null", "s_name")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    t = ranked.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    t = t.withColumn("caps_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("weights_left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("all_sizes", F.sum("source_size").over(Window.partitionBy()))
    t = t.withColumn("level", (share * F.col("all_sizes") - F.col("caps_before")) / F.col("weights_left"))
    # the first source, in that order, whose cap is not reached fixes the level of all that follow
    fixed = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(Window.partitionBy())
    t = t.withColumn("final", fixed["level"])
    return t.select("s_null", "s_name", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("final")), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, *keep): how many of its words the mix takes from each row.

    Size counts words separated by ASCII white space. Null and empty texts have
    size 0 and are never taken; a null source is a source of its own, the last; null
    and repeated ids are keyed like others, rows that tie in everything are
    interchangeable. A source without words has target 0. An empty table gives an
    empty result. Other columns are ignored unless named in ``keep``.
    """
    slim = docs.select(
        "doc_id", word_count(F.col("text")).alias("size"), F.col("source").isNull().alias("s_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s_name"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    slim = save(slim.withColumn("range", F.substring("key", 1, 3)), "mix-sizes")
    by_range = slim.groupBy("s_null", "s_name", "range").agg(F.sum("size").alias("words"))
    by_range = save(by_range, "mix-ranges")  # at most 4096 rows a source
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("s_null", "s_name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(by_range.groupBy("s_null", "s_name").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    offsets = by_range.select("s_null", "s_name", "range", ahead.alias("ahead")).join(F.broadcast(targets) if _few(targets) else targets, ["s_null", "s_name"])
    within = Window.partitionBy("s_null", "s_name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["s_null", "s_name", "range"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("inner")))
    return placed.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + cut).cast("long").alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    return len(targets.limit(most + 1).select("target").collect()) <= most


def materialize(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a document comes once for each whole epoch, and
    where the budget cuts through a document its first words come once more, single-spaced. Documents that get no word go,
    those without any word stay once (they cost nothing)."""
    cols, row = docs.columns, fresh("row", docs)
    taken = mix(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in cols]).alias(row)), weights, share, max_epochs, keep=(row,))
    size, left = F.col("size"), F.col("taken") - F.floor(F.col("taken") / F.greatest("size", F.lit(1))) * F.col("size")
    whole = F.when(size == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    parts = F.concat(F.array_repeat(F.lit(None).cast("long"), whole), F.when((size > 0) & (left > 0), F.array(left)).otherwise(F.array().cast("array<bigint>")))
    rows = taken.select(row, F.explode(parts).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"{row}.text"), F.lit(SPACE_WORD), F.lit(0)), 1, F.coalesce("words", F.lit(0)).cast("int")), " ")
    text = F.when(F.col("words").isNull(), F.col(f"{row}.text")).otherwise(first)
    out = {"text": text} | ({"n_chars": F.when(F.col("words").isNull(), F.col(f"{row}.n_chars")).otherwise(F.char_length(first)).cast("long")} if "n_chars" in cols else {})
    return rows.select(*[out.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in cols])


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rk from s),
w as (select *, case rk % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as wt, 2 * source_size as cap from r),
o as (select *, coalesce(sum(cap) over (order by cap / wt, rk rows between unbounded preceding and 1 preceding), 0)::bigint as before,
  sum(wt) over (order by cap / wt, rk rows between current row and unbounded following) as wleft, (sum(source_size) over ())::bigint as total from w),
l as (select *, (1.5::double * total - before) / wleft as lv from o),
f as (select arg_min(lv, (cap / wt, rk)) as lv from l where lv * wt < cap),
t as (select l.source, l.source_size, coalesce(least(l.cap::double, l.wt * f.lv), l.cap::double) as target from l left join f on true),
p as (select d.*, t.source_size, t.target, floor(t.target)::bigint as budget,
  coalesce(sum(d.size) over (partition by d.source order by k, doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
  from d join t on d.source is not distinct from t.source),
q as (select *, case when source_size > 0 then budget // source_size else 0 end as whole from p)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - whole * source_size - ahead)))::bigint as taken from q
"""
