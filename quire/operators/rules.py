"""Archival rules as filters over parsed objects; violations carry an order, so the first of a document is reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.lineage import save

ALLOWED = ("ASCIIHexDecode", "ASCII85Decode", "FlateDecode", "RunLengthDecode", "CCITTFaxDecode", "JBIG2Decode", "DCTDecode", "JPXDecode", "LZWDecode")
ARCHIVE_RULES = ("font-not-embedded", "lzwdecode", "filter-not-allowed", "cmyk-without-profile", "alternates-not-allowed", "opi-not-allowed", "blend-mode-not-allowed", "embedded-files-need-4f", "4f-needs-embedded-files")


def archive_violations(objects: DataFrame, mode: str = "4") -> DataFrame:
    """(doc_id, num, ord, rule) over the objects table (doc_id, num, kind, value as JSON)."""
    v = F.coalesce(F.get_json_object("value", "$.stream"), F.col("value"))
    at = lambda k: F.get_json_object("v", f"$.{k}")
    has = lambda k: at(k).isNotNull()
    names = F.when(F.startswith("filter", F.lit("[")), F.from_json("filter", "array<string>")).when(F.col("filter").isNotNull(), F.array("filter"))
    names = F.transform(names, lambda x: F.regexp_replace(x, "^/", ""))
    checks = [
        (1, F.array_contains(names, "LZWDecode")), (2, F.exists(names, lambda f: ~f.isin(*ALLOWED))), (4, has("Alternates")), (5, has("OPI")), (6, F.col("bm").isNotNull() & (F.col("bm") != "/Normal")),
        (7, has("EmbeddedFiles") & F.lit(mode == "4")),
    ]
    body = F.when(F.col("kind") == "stream", F.coalesce(F.get_json_object("value", "$.stream.Alternate"), F.lit(""))).otherwise(F.col("value"))
    listed = F.regexp_extract_all(at("DescendantFonts"), F.lit(r"(\d+) \d+ R"), F.lit(1)).cast("array<bigint>")
    each = objects.where("error is null").withColumns({"dict": F.col("kind").isin("dict", "stream"), "body": body, "v": F.when(F.col("kind").isin("dict", "stream"), v)})
    each = each.withColumns({"filter": at("Filter"), "bm": at("BM")}).select(
        "doc_id", "num", "dict", "body", at("Type").alias("type"), at("Subtype").alias("subtype"), at("FontDescriptor").alias("descriptor"), at("ColorSpace").alias("space"), listed.alias("kids"),
        (has("FontFile") | has("FontFile2") | has("FontFile3")).alias("embedded"), has("EmbeddedFiles").alias("files"), F.filter(F.array(*[F.when(bad, n) for n, bad in checks]), lambda n: n.isNotNull()).alias("ords"),
    )
    # every rule reads the objects again: what rules ask of them is a table, so files are parsed once
    bodies = save(each, "archive-objects")
    o = bodies.where("dict")
    files = o.select("doc_id", F.concat("num", F.lit(" 0 R")).alias("descriptor"), "embedded")
    simple = F.coalesce(F.col("subtype"), F.lit("")).isin("/Type0", "/Type3")
    lone = o.where((F.col("type") == "/Font") & ~simple).drop("embedded").join(files, ["doc_id", "descriptor"], "left")
    # a composite font is embedded if all of its descendants are; it names them by reference, in a list or through one more reference
    kids = o.where("type = '/Font' and subtype = '/Type0'").select("doc_id", "num", F.explode_outer("kids").alias("kid"))
    held = o.drop("embedded").join(files, ["doc_id", "descriptor"], "left").select("doc_id", F.col("num").alias("kid"), F.coalesce("embedded", F.lit(False)).alias("embedded"))
    whole = kids.join(held, ["doc_id", "kid"], "left").groupBy("doc_id", "num").agg(F.bool_and(F.coalesce("embedded", F.lit(False))).alias("embedded"))
    fonts = lone.where("not coalesce(embedded, false)").select("doc_id", "num").unionByName(whole.where("not embedded").select("doc_id", "num")).withColumn("ord", F.lit(0))
    rows = fonts.unionByName(o.select("doc_id", "num", F.explode("ords").alias("ord"))).unionByName(_device_cmyk(bodies))
    if mode == "4f":
        rows = rows.unionByName(o.groupBy("doc_id").agg(F.bool_or("files").alias("e")).where("not e").select("doc_id", F.lit(None).cast("long").alias("num"), F.lit(8).alias("ord")))
    return rows.withColumn("rule", F.element_at(F.array(*map(F.lit, ARCHIVE_RULES)), F.col("ord") + 1))


def _device_cmyk(objects: DataFrame, hops: int = 8) -> DataFrame:
    """(doc_id, num, ord): objects whose colour space names DeviceCMYK, in itself or through references: arrays, dictionaries and the
    alternates of profiles are walked, ``hops`` references deep. Each round is a join with what was reached anew, and ends where nothing was."""
    named = lambda c: F.regexp_like(c, F.lit(r'"?/DeviceCMYK"?($|[,\]}])'))
    refs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+) \d+ R"), F.lit(1)))
    bodies = objects.select("doc_id", F.col("num").alias("at"), "body")
    now = objects.where("dict and space is not null").select("doc_id", "num", F.col("space").alias("body"))
    found = now.where(named(F.col("body"))).select("doc_id", "num")
    for _ in range(hops):
        ahead = now.select("doc_id", "num", F.explode(refs(F.col("body")).cast("array<bigint>")).alias("at"))
        if ahead.isEmpty():
            break
        now = save(ahead.join(bodies, ["doc_id", "at"]).select("doc_id", "num", "body").distinct(), "archive-spaces")
        found = found.unionByName(now.where(named(F.col("body"))).select("doc_id", "num"))
    return found.distinct().withColumn("ord", F.lit(3))


def first_violation(rows: DataFrame) -> DataFrame:
    """(doc_id, rule): the first of each document in object order."""
    return rows.groupBy("doc_id").agg(F.min_by("rule", F.struct(F.coalesce("num", F.lit(1 << 40)), "ord")).alias("rule"))


def language_tag(tag):
    return F.regexp_like(tag, F.lit("^([A-Za-z]{2,3}|[ix])(-[A-Za-z0-9]{1,8})*$"))
