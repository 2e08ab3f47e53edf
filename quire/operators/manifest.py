"""Corpus manifests: rules for rows, agreement with files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = "path string, sha256 string, bytes long, source string, license string, feature string, expect string, area string, probe string, basis string, pages int"
AREAS = ("paint", "text", "font", "image", "colour", "filter", "xref", "crypt", "tags", "forms", "layers", "postscript", "rewrite", "damage", "other")
PROBES, BASES = ("raster", "info", "rewrite", "text", "ps", "gs"), ("spec", "gs", "baseline")
LICENSES = {"committed": ("CC0-1.0", "MIT", "Apache-2.0"), "fetched": ("CC0-1.0", "MIT", "Apache-2.0", "GPL-3.0", "CC-BY-4.0")}


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=COLUMNS, mode="PERMISSIVE")


def row_errors(tier: str = "fetched", excluded: tuple[str, ...] = ()) -> Column:
    """Names of the rules that a manifest row breaks, in a fixed order."""
    c = F.col
    rules = {
        "path": ~(c("path").rlike(r"^[^/\\][^\\]*$") & ~c("path").rlike(r"(^|/)(\.|\.\.)?(/|$)")),
        "sha256": ~c("sha256").rlike("^[0-9a-f]{64}$"),
        "bytes": ~(c("bytes") > 0),
        "source": c("source") == "",
        "license": ~c("license").isin(*LICENSES[tier]),
        "feature": c("feature") == "",
        "expect": ~c("expect").rlike("^(paint|struct|survive|refuse:.+)$"),
        "area": ~c("area").isin(*AREAS),
        "probe": ~c("probe").isin(*PROBES),
        "basis": ~c("basis").isin(*BASES),
        "pages": ~c("pages").between(0, 100_000),
    }
    if tier == "committed" and excluded:
        rules["excluded"] = F.exists(F.array(*map(F.lit, excluded)), lambda t: F.contains(F.lower(F.concat("path", "source")), t))
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in rules.items()]), lambda x: x.isNotNull())


def duplicate_paths(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): rows against files (path, content): missing, size, sha256 or ok."""
    have = files.select("path", F.octet_length("content").alias("_n"), F.sha2(F.col("content").cast("binary"), 256).alias("_s"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_s") != F.col("sha256"), "sha256").otherwise("ok")
    return manifest.join(have, "path", "left").select("path", status.alias("status"))


def unlisted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest, "path", "left_anti").select("path")


def report(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(group, key, rows, pass, fail, skip, pass_rate): per area and per basis; of several verdicts of a row the best counts."""
    code = F.when(F.col("verdict") == "pass", 0).when(F.col("verdict") == "fail", 1).otherwise(2)
    best = verdicts.groupBy("path").agg(F.min(code).alias("code"))
    joined = rows.join(best, "path", "left").withColumn("code", F.coalesce("code", F.lit(2)))
    n = lambda k: F.count_if(F.col("code") == k)
    sets = joined.groupingSets([[F.col("area")], [F.col("basis")]], "area", "basis").agg(F.count(F.lit(1)).alias("rows"), n(0).alias("pass"), n(1).alias("fail"), n(2).alias("skip"))
    return sets.select(F.when(F.col("area").isNotNull(), "area").otherwise("basis").alias("group"), F.coalesce("area", "basis").alias("key"), "rows", "pass", "fail", "skip", F.try_divide(F.col("pass").cast("double"), F.col("pass") + F.col("fail")).alias("pass_rate"))


def untraced(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Live rows of a traceability table whose test does not exist."""
    return rows.where("status = 'live'").join(tests, "test", "left_anti")


def selected(rows: DataFrame, external: bool = False, area: str | None = None, own: str = "repo-authored") -> DataFrame:
    """Rows of this run: never those of the repository itself, those of the external tier (``basis`` 'external') only if asked for, one area or all."""
    keep = F.col("source") != own
    if not external:
        keep &= F.col("basis") != "external"
    return rows.where(keep & (F.col("area") == area) if area else keep)


def tree_faults(members: DataFrame, files: DataFrame) -> DataFrame:
    """(archive, faults, first): members of an archive whose file is absent or differs, and the first of them by path; archives without any are whole."""
    status = verify_files(members.select("path", "bytes", "sha256"), files)
    bad = members.select("archive", "path").join(status.where("status <> 'ok'"), "path")
    return bad.groupBy("archive").agg(F.count(F.lit(1)).alias("faults"), F.min("path").alias("first"))


def bulk_totals(members: DataFrame, archives: DataFrame) -> DataFrame:
    """(files, bytes): members of all archives, and what the archives themselves weigh."""
    return archives.agg(F.sum("bytes").alias("bytes")).crossJoin(members.agg(F.count(F.lit(1)).alias("files")))  # two single rows


def same_page(claims: DataFrame, key: str = "elem", page: str = "page") -> DataFrame:
    """(key, same_page): whether all claims of an element are on one page."""
    return claims.groupBy(key).agg((F.count_distinct(page) <= 1).alias("same_page"))
