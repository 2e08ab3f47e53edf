"""Benchmark decontamination by winnowing, in DataFrame functions only.

Winnowing keeps the minimum hash of all K-word grams inside a sliding window of
``window`` words. A span of ``window`` words that occurs in a document and in a
benchmark item keeps the same minimum on both sides, so joining the kept
fingerprints finds every such span; each hit is extended from its gram to the full window, which is
compared word by word, and hits that overlap are one span. Items that have fewer words are one window of their
own length.

Plan: one pass over the documents computes words, grams and minima inside each
row (no shuffle, no row per word). A bitmap over the benchmark's
fingerprints, sized by their number, drops nearly every window before a row is generated; what is left
carries its fingerprint and its window and is joined on both: the fingerprint finds, the words decide. The bitmap can only let too
much through, never too little.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, fresh, let, save

#: Every separator on its own: Java then tests a bit set, not a chain of ranges.
SEPARATORS = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum() or "A" <= chr(c) <= "Z") + "]+"
SEPARATORS_ANY_CASE = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"
WINDOW, GRAM = 10, 4
#: Bits of the bitmap for each fingerprint of the benchmark, and their least and greatest number: 128 KB and 4 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 25
#: Benchmarks of at most so many distinct windows are broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def folded_words(text: Column) -> Column:
    """Words in the lower case of Unicode: at the same places as the words proper, and equal wherever those are."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def words_of(text: Column) -> Column:
    """The words proper, A-Z not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), "")


def _grams(h: Column, n: int) -> Column:
    """Hashes of all runs of n values: runs of twice the length are made of two runs."""
    if n == 1:
        return h
    half = n // 2
    return let(_grams(h, half), lambda g: F.transform(g, lambda x, i: F.xxhash64(x, F.get(g, i + half)) if n % 2 == 0 else F.xxhash64(x, F.get(g, i + half), F.get(h, i + 2 * half))))


def _fingerprints(words: Column, n: int, window: int, gram: int) -> Column:
    """The fingerprint of every window of n words, by its start: the least of its grams' hashes (short windows: one gram)."""
    gram = n if n < window else gram
    none = F.array().cast("array<bigint>")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(0), F.size(words) - n)
    least = lambda g: F.transform(starts, lambda s: F.array_min(F.slice(g, s + 1, n - gram + 1)))
    return F.when(F.size(words) >= n, let(let(hashes, lambda h: _grams(h, gram)), least)).otherwise(none)


def _window_text(words: Column, start: Column, n: int) -> Column:
    return F.translate(F.array_join(F.slice(words, start + 1, n), " "), UPPER, LOWER)


def benchmark_windows(benchmark: DataFrame, window: int, gram: int, lengths: list[int]) -> DataFrame:
    """Rows (n, fp, win, item_id): every window of every item; shorter items are one window."""
    items = benchmark.select("item_id", folded_words(F.col("text")).alias("w"), words_of(F.col("text")).alias("x"))
    parts = None
    for n in lengths:
        fit = F.size("w") >= n if n == window else F.size("w") == n
        part = items.where(fit).select("item_id", "x", F.posexplode(_fingerprints(F.col("w"), n, window, gram)).alias("s", "fp"))
        part = part.select(F.lit(n).alias("n"), "fp", _window_text(F.col("x"), F.col("s"), n).alias("win"), "item_id")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _cell(fp: Column, bits: int) -> tuple[Column, Column]:
    """The long and the bit in it that stand for a fingerprint: its top bits."""
    shift = 64 - bits.bit_length() + 1
    return F.shiftrightunsigned(fp, shift + 6).cast("int"), F.shiftrightunsigned(fp, shift).bitwiseAND(63).cast("int")


def _bitmap(fps: DataFrame, bits: int) -> Column:
    """A literal array of longs, one bit for each class of fingerprints: at most ``MOST_BITS``, so free to ship with the plan."""
    word, bit = _cell(F.col("fp"), bits)
    rows = fps.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("v")).collect()  # at most bits / 64 rows
    longs = [0] * (bits // 64)
    for r in rows:
        longs[r["word"]] = r["v"]
    return F.from_json(F.lit(json.dumps(longs)), "array<bigint>")


def _candidates(documents: DataFrame, benchmark: DataFrame, window: int, gram: int, carry: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three saved tables: (uid, *carry, n_words, cands) of the documents, (n, fp, win, cls) and (n, fp, win, item_id) of the benchmark."""
    benchmark = benchmark.select("item_id", "text")
    short = [r["n"] for r in benchmark.select(F.size(words_of(F.col("text"))).alias("n")).where(f"n between 1 and {window - 1}").distinct().collect()]  # at most window - 1 rows
    lengths = [window, *sorted(short)]
    wins = save(benchmark_windows(benchmark, window, gram, lengths), "bench-windows")
    fps = wins.select("fp").distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * fps.count()).bit_length()))
    bitmap = _bitmap(fps, bits)

    def suspect(fp: Column) -> Column:
        word, bit = _cell(fp, bits)
        return F.getbit(F.get(bitmap, word), bit) == 1

    def starts(w: Column, n: int) -> Column:
        spots = lambda m: F.filter(F.transform(m, lambda fp, s: F.struct(s.alias("s"), fp.alias("fp"))), lambda x: suspect(x["fp"]))
        return let(_fingerprints(w, n, window, gram), spots)

    def texts(found: Column, text: Column) -> Column:
        # the words proper are made only for documents with a suspected window
        some = let(words_of(text), lambda w: F.concat(*[F.transform(found[f"n{n}"], lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["fp"].alias("fp"), _window_text(w, x["s"], n).alias("win"))) for n in lengths]))
        return F.when(sum((F.size(found[f"n{n}"]) for n in lengths), F.lit(0)) > 0, some)

    def judge(w: Column) -> Column:
        found = F.struct(*[starts(w, n).alias(f"n{n}") for n in lengths])
        return F.struct(F.size(w).cast("long").alias("n_words"), let(found, lambda f: texts(f, F.col("text"))).alias("cands"))

    docs = documents.select(*carry, let(folded_words(F.col("text")), judge).alias("x"))
    judged = save(docs.select(F.monotonically_increasing_id().alias("uid"), *carry, "x.n_words", "x.cands"), "doc-windows")

    # Windows that the same items have form a class, named by its smallest window: documents meet classes, not items.
    each = wins.select("n", "fp", "win", "item_id").distinct()
    sets = each.groupBy("n", "fp", "win").agg(F.count("item_id").alias("k"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), F.col("item_id"))).alias("b"))
    names = sets.groupBy("k", "a", "b").agg(F.min(F.struct("n", "win")).alias("cls"))
    classed = sets.join(names, (sets.k == names.k) & sets.a.eqNullSafe(names.a) & sets.b.eqNullSafe(names.b)).select("n", "fp", "win", F.xxhash64("cls.n", "cls.win").alias("cls"))
    classed = save(classed, "window-classes")
    return judged, classed, each


def _hits(judged: DataFrame, classed: DataFrame) -> DataFrame:
    """(uid, s, e, cls): occurrences of benchmark windows, words s to e."""
    small = F.broadcast(classed) if classed.count() <= BROADCAST_WINDOWS else classed
    found = judged.select("uid", F.explode("cands").alias("c")).select("uid", "c.*").join(small, ["n", "fp", "win"])
    return save(found.select("uid", "s", (F.col("s") + F.col("n")).alias("e"), "cls"), "window-hits")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``documents``.

    Null text has no words; a null ``doc_id`` is kept; repeated rows are judged one by one. Items without words match nothing;
    repeated items count once; an item whose id is null marks words as hit but is
    not counted or listed. An empty benchmark leaves every document clean. Other
    columns are ignored. Documents of any length are processed whole.
    """
    judged, classed, each = _candidates(documents, benchmark, window, gram, ["doc_id"])
    members = each.withColumn("cls", F.xxhash64("n", "win")).join(classed.select("cls").distinct(), "cls", "left_semi").where("item_id is not null").select("cls", "item_id").distinct()
    hits = _hits(judged, classed)
    before = F.max("e").over(Window.partitionBy("uid").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.select("uid", "s", "e").distinct().select("uid", (F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(before, F.lit(0))))).alias("new")).groupBy("uid").agg(F.sum("new").alias("n_hit"))
    items = hits.select("uid", "cls").distinct().join(members, "cls").select("uid", "item_id").distinct()
    items = items.groupBy("uid").agg(F.count("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    return (
        judged.select("uid", "doc_id", "n_words").join(covered, "uid", "left").join(items, "uid", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``documents`` without those that hold a window of ``benchmark``. All columns pass through; the cases are those of ``decontaminate``."""
    row = fresh("row", documents)
    packed = documents.select("text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(row))
    judged, classed, _ = _candidates(packed, benchmark, window, gram, [row])
    bad = _hits(judged, classed).select("uid").distinct()
    return judged.join(bad, "uid", "left_anti").select(*[F.col(f"{row}.`{c}`").alias(c) for c in documents.columns])


SQL = r"""
with dw as (
  select row_number() over () as uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s from bw where len(w) > 0)),
dwin as (
  select uid, n, s, array_to_string(w[s:s + n - 1], ' ') as t
  from (select uid, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) as s from dw, (select distinct n from win))),
hit as (select uid, dwin.n, s, item_id from dwin join win on dwin.n = win.n and dwin.t = win.t),
pos as (select uid, count(distinct p) as n_hit from (select distinct uid, unnest(range(s, s + n)) as p from hit) group by uid),
its as (select uid, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct uid, cast(item_id as varchar) as i from hit where item_id is not null) group by uid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (uid) left join its using (uid)
"""
