"""Queries over manifests and trees, with the SQL they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import manifest as M
from quire.operators import trees
from quire.plans.common import table


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest in which some rows break rules."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    return d.select(
        F.concat(F.when(k % 41 == 0, F.lit("/")).when(k % 43 == 0, F.lit("../")).otherwise(F.lit("")), "source", F.lit("/"), F.when(k % 37 == 0, F.lit(0)).otherwise(k).cast("string")).alias("path"),
        F.when(k % 31 == 0, F.lit("ABC")).otherwise(F.sha2("text", 256)).alias("sha256"), F.when(k % 29 == 0, F.lit(0)).otherwise(F.octet_length("text")).cast("long").alias("bytes"), "source",
        pick(5, "MIT", "CC0-1.0", "GPL-3.0", "Proprietary", "Apache-2.0").alias("license"), F.col("lang").alias("feature"), pick(4, "paint", "survive", "refuse:limitcheck", "refuse:").alias("expect"),
        pick(6, "paint", "text", "font", "image", "nowhere", "tags").alias("area"), pick(7, *M.PROBES, "other").alias("probe"), pick(3, *M.BASES).alias("basis"), (k % 50 - 1).cast("int").alias("pages"),
    )


MANIFEST_SQL = """m as (select case when doc_id % 41 = 0 then '/' when doc_id % 43 = 0 then '../' else '' end || source || '/' || cast(case when doc_id % 37 = 0 then 0 else doc_id end as varchar) as path,
  case when doc_id % 31 = 0 then 'ABC' else sha256(text) end as sha256, case when doc_id % 29 = 0 then 0 else strlen(text) end as bytes, source, ['MIT', 'CC0-1.0', 'GPL-3.0', 'Proprietary', 'Apache-2.0'][doc_id % 5 + 1] as license,
  lang as feature, ['paint', 'survive', 'refuse:limitcheck', 'refuse:'][doc_id % 4 + 1] as expect, ['paint', 'text', 'font', 'image', 'nowhere', 'tags'][doc_id % 6 + 1] as area,
  ['raster', 'info', 'rewrite', 'text', 'ps', 'gs', 'other'][doc_id % 7 + 1] as probe, ['spec', 'gs', 'baseline'][doc_id % 3 + 1] as basis, cast(doc_id % 50 - 1 as int) as pages, doc_id, text from documents)"""


def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    return m.select("path", "bytes", F.array_join(M.row_errors("committed", ("src1/", "src9")), ",").alias("errors"))


MANIFEST_RULES_SQL = f"""with {MANIFEST_SQL} select path, bytes, array_to_string(list_filter([case when not (regexp_matches(path, '^[^/\\\\][^\\\\]*$') and not regexp_matches(path, '(^|/)(\\.|\\.\\.)?(/|$)')) then 'path' end,
case when not regexp_matches(sha256, '^[0-9a-f]{{64}}$') then 'sha256' end, case when not bytes > 0 then 'bytes' end, case when license not in ('CC0-1.0', 'MIT', 'Apache-2.0') then 'license' end,
case when not regexp_matches(expect, '^(paint|struct|survive|refuse:.+)$') then 'expect' end, case when area = 'nowhere' then 'area' end, case when probe = 'other' then 'probe' end, case when pages < 0 then 'pages' end,
case when contains(lower(path || source), 'src1/') or contains(lower(path || source), 'src9') then 'excluded' end], lambda x: x is not null), ',') as errors from m"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("doc_id % 13 <> 0").select(F.concat("source", F.lit("/"), k.cast("string")).alias("path"), F.when(k % 17 == 0, F.concat("text", F.lit("!"))).when(k % 19 == 0, F.reverse("text")).otherwise(F.col("text")).alias("content"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against files: missing, changed, unlisted, and paths listed twice."""
    m, f = _manifest(spark, sf_dir), _files(spark, sf_dir)
    a = M.verify_files(m, f)
    b = M.unlisted(f, m).withColumn("status", F.lit("unlisted"))
    c = M.duplicate_paths(m).select("path", F.lit("duplicate").alias("status"))
    return a.unionByName(b).unionByName(c).groupBy("path", "status").agg(F.count(F.lit(1)).alias("n"))


MANIFEST_FILES_SQL = f"""with {MANIFEST_SQL}, f as (select source || '/' || cast(doc_id as varchar) as path, case when doc_id % 17 = 0 then text || '!' when doc_id % 19 = 0 then reverse(text) else text end as content from documents where doc_id % 13 <> 0),
a as (select m.path, case when f.path is null then 'missing' when strlen(content) <> m.bytes then 'size' when sha256(content) <> m.sha256 then 'sha256' else 'ok' end as status from m left join f using (path)
union all select path, 'unlisted' from f where path not in (select path from m) union all select path, 'duplicate' from m group by path having count(*) > 1)
select path, status, count(*) as n from a group by 1, 2"""


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by area and by basis from labels of documents; the best of several verdicts counts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.concat(F.lit("area"), (F.col("doc_id") % 6).cast("string")).alias("area"), F.concat(F.lit("basis"), (F.col("doc_id") % 3).cast("string")).alias("basis"))
    v = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "skip").otherwise("fail").alias("verdict"))
    again = v.where("path % 2 = 0").withColumn("verdict", F.lit("fail"))
    out = M.report(d, v.unionByName(again))
    totals = d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("all").alias("group"), F.lit("files").alias("key"), "rows", *[F.lit(0).cast("long").alias(c) for c in ("pass", "fail", "skip")], F.lit(None).cast("double").alias("pass_rate"))
    return out.unionByName(totals).withColumn("pass_rate", F.round("pass_rate", 6))


VALIDATION_REPORT_SQL = """with d as (select doc_id as path, 'area' || (doc_id % 6) as area, 'basis' || (doc_id % 3) as basis from documents),
v as (select doc_id as path, case when quality = 1 then 0 when toxic = 1 then 2 else 1 end as code from labels union all select doc_id, 1 from labels where doc_id % 2 = 0),
j as (select d.*, coalesce(code, 2) as code from d left join (select path, min(code) as code from v group by path) using (path)),
g as (select area, basis, count(*) as rows, count(*) filter (where code = 0) as pass, count(*) filter (where code = 1) as fail, count(*) filter (where code = 2) as skip from j group by grouping sets ((area), (basis)))
select case when area is not null then 'area' else 'basis' end as "group", coalesce(area, basis) as key, rows, pass, fail, skip, round(pass / nullif(pass + fail, 0)::double, 6) as pass_rate from g
union all select 'all', 'files', (select count(*) from d), 0, 0, 0, null"""


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree of fan-out five: leaves in order, with the nearest inherited size."""
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(k.alias("k"), F.floor((k - 1) / 5).cast("long").alias("parent"), F.when(k % 7 == 0, k).alias("box"))
    t = trees.descend(n, "k", "parent", F.col("parent") == 0, ["box"])
    # as of NOT IN: a parent that is NULL leaves no row
    t = t.join(n.select(F.col("parent").alias("k")), "k", "left_anti").join(n.where("parent is null").select(F.lit(True).alias("_")).limit(1), how="left_anti")
    return t.select("k", "depth", F.coalesce("box", F.lit(612)).alias("box"))


PAGE_TREE_SQL = """with recursive n as (select p_partkey as k, cast(floor((p_partkey - 1) / 5) as bigint) as parent, case when p_partkey % 7 = 0 then p_partkey else null end as own from part),
t as (select k, cast(0 as bigint) as depth, own as box from n where parent = 0 union all select n.k, t.depth + 1, coalesce(n.own, t.box) from n join t on n.parent = t.k)
select k, depth, coalesce(box, 612) as box from t where k not in (select parent from n)"""


def role_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of roles followed to a standard type; a cycle or too many hops is an error."""
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("role"), F.when(k % 10 == 0, k + 1).when(k % 10 == 1, k - 1).otherwise(F.floor(k / 3).cast("long")).alias("target"))
    far = F.col("hops") >= 16
    return trees.follow(r, "role", "target", 16).select("role", F.when(~far, F.col("target")).alias("standard"), "hops", F.when(far, F.lit("limitcheck")).alias("err"))


ROLE_MAPS_SQL = """with recursive r as (select s_suppkey as role, case when s_suppkey % 10 = 0 then s_suppkey + 1 when s_suppkey % 10 = 1 then s_suppkey - 1 else cast(floor(s_suppkey / 3) as bigint) end as target from supplier),
c as (select role, target, cast(1 as int) as hops from r union all select c.role, r.target, c.hops + 1 from c join r on c.target = r.role where c.hops < 16),
l as (select role, max(hops) as hops from c group by role)
select l.role, case when l.hops >= 16 then null else c.target end as standard, l.hops, case when l.hops >= 16 then 'limitcheck' end as err from l join c on c.role = l.role and c.hops = l.hops"""


def structure_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in content against claims in the tree, both ways."""
    content = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page"), (F.col("o_orderkey") % 400).alias("mcid")).distinct()
    tree = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("page"), (F.col("c_custkey") % 397).alias("mcid"), F.col("c_custkey").alias("elem")).groupBy("page", "mcid").agg(F.min("elem").alias("elem"))
    both = content.withColumn("c", F.lit(1)).join(tree, ["page", "mcid"], "full")
    return both.groupBy("page").agg(F.count_if(F.col("c").isNull()).alias("only_tree"), F.count_if(F.col("elem").isNull()).alias("only_content"), F.count_if(F.col("c").isNotNull() & F.col("elem").isNotNull()).alias("both_"))


STRUCTURE_AGREEMENT_SQL = """with c as (select distinct o_custkey % 50 as page, o_orderkey % 400 as mcid, 1 as c from orders), t as (select c_custkey % 50 as page, c_custkey % 397 as mcid, min(c_custkey) as elem from customer group by 1, 2)
select page, count(*) filter (where c is null) as only_tree, count(*) filter (where elem is null) as only_content, count(*) filter (where c is not null and elem is not null) as both_ from c full join t using (page, mcid) group by page"""


def xref_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of cross-reference rows: the newest definition wins, older sections only fill gaps."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("num"), F.col("l_linenumber").alias("section")).agg(F.max("l_orderkey").alias("offset"))
    new, old = t.where("section <= 2"), t.where("section > 2")
    merge = lambda x: x.groupBy("num").agg(F.min_by("offset", "section").alias("offset"), F.min("section").alias("section"))
    top = merge(new)
    return top.unionByName(merge(old).join(top, "num", "left_anti"))


XREF_SECTIONS_SQL = """with t as (select l_partkey % 500 as num, l_linenumber as section, max(l_orderkey) as "offset" from lineitem group by 1, 2) select num, arg_min("offset", section) as "offset", min(section) as section from t group by num"""


def optional_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership policies over groups that are off."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ocmd"), (F.col("l_suppkey") % 3 == 0).alias("off"))
    policy = F.element_at(F.array(*map(F.lit, ("AllOn", "AnyOff", "AllOff", "AnyOn"))), (F.col("ocmd") % 4 + 1).cast("int"))
    return t.groupBy("ocmd").agg(F.first(policy).alias("policy"), F.bool_or("off").alias("a"), F.bool_and("off").alias("b")).select("ocmd", "policy", F.when(F.col("policy") == "AllOn", F.col("a")).when(F.col("policy") == "AnyOff", ~F.col("a")).when(F.col("policy") == "AllOff", ~F.col("b")).otherwise(F.col("b")).alias("hidden"))


OPTIONAL_CONTENT_SQL = """with t as (select l_orderkey as ocmd, ['AllOn', 'AnyOff', 'AllOff', 'AnyOn'][l_orderkey % 4 + 1] as policy, bool_or(l_suppkey % 3 = 0) as a, bool_and(l_suppkey % 3 = 0) as b from lineitem group by 1, 2)
select ocmd, policy, case policy when 'AllOn' then a when 'AnyOff' then not a when 'AllOff' then not b else b end as hidden from t"""


def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows without a test, and pages that three audits share."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case"), F.concat(F.lit("Test"), (F.col("p_partkey") % 900).cast("string")).alias("test"), F.when(F.col("p_size") % 3 == 0, "live").otherwise("pending").alias("status"))
    tests = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Test"), (F.col("s_suppkey") * 7).cast("string")).alias("test"))
    missing = M.untraced(rows, tests).select("case", F.lit("no test").alias("what"))
    keys = [rows.where(f"case % {n} = 0").select("case") for n in (2, 3, 5)]
    return missing.unionByName(keys[0].intersect(keys[1]).intersect(keys[2]).withColumn("what", F.lit("in all audits")))


TRACEABILITY_SQL = """select p_partkey as "case", 'no test' as what from part where p_size % 3 = 0 and 'Test' || (p_partkey % 900) not in (select 'Test' || (s_suppkey * 7) from supplier)
union all select * from (select p_partkey, 'in all audits' from part where p_partkey % 2 = 0 intersect select p_partkey, 'in all audits' from part where p_partkey % 3 = 0 intersect select p_partkey, 'in all audits' from part where p_partkey % 5 = 0)"""


def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a run of one area acts on, with and without the external tier."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "repo-authored").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 4 == 0, "external").otherwise("spec").alias("basis"), F.concat(F.lit("area"), (F.col("doc_id") % 6).cast("string")).alias("area"))
    both = M.selected(d, True, "area3").withColumn("tier", F.lit("all")).unionByName(M.selected(d).withColumn("tier", F.lit("inner")))
    return both.select("doc_id", "area", "tier")


SELECTED_ROWS_SQL = """with d as (select doc_id, case when doc_id % 9 = 0 then 'repo-authored' else source end as source, doc_id % 4 = 0 as external, 'area' || (doc_id % 6) as area from documents)
select doc_id, area, 'all' as tier from d where source <> 'repo-authored' and area = 'area3' union all select doc_id, area, 'inner' from d where source <> 'repo-authored' and not external"""


def bulk_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives against the tree: whole archives, the first fault of the others, and totals."""
    d = table(spark, sf_dir, "documents")
    members = d.select((F.col("doc_id") % 40).cast("string").alias("archive"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    files = d.where("doc_id % 97 <> 5").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 89 == 7, F.reverse("text")).otherwise(F.col("text")).alias("content"))
    faults = M.tree_faults(members, files)
    archives = members.groupBy("archive").agg(F.sum("bytes").alias("bytes"))
    totals = M.bulk_totals(members, archives).select(F.lit("all").alias("archive"), "bytes", F.col("files").alias("faults"), F.lit(None).cast("string").alias("first"))
    return archives.join(faults, "archive", "left").na.fill(0, ["faults"]).select("archive", "bytes", "faults", "first").unionByName(totals)


BULK_MEMBERS_SQL = """with m as (select cast(doc_id % 40 as varchar) as archive, source || '/' || doc_id as path, strlen(text) as bytes, text, doc_id from documents),
b as (select archive, count(*) as faults, min(path) as first from m where doc_id % 97 = 5 or (doc_id % 89 = 7 and reverse(text) <> text) group by archive)
select archive, sum(bytes)::bigint as bytes, coalesce(any_value(faults), 0)::bigint as faults, any_value(first) as first from m left join b using (archive) group by archive
union all select 'all', sum(bytes)::bigint, count(*), null from m"""


def same_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), (F.col("l_suppkey") % 3).alias("page"))
    return M.same_page(claims)


SAME_PAGE_SQL = "select l_orderkey as elem, count(distinct l_suppkey % 3) <= 1 as same_page from lineitem group by 1"

QUERIES = {f.__name__: f for f in (selected_rows, bulk_members, same_page, manifest_rules, manifest_files, validation_report, page_tree, role_maps, structure_agreement, xref_sections, optional_content, traceability)}
SQL = {"selected_rows": SELECTED_ROWS_SQL, "bulk_members": BULK_MEMBERS_SQL, "same_page": SAME_PAGE_SQL, "manifest_rules": MANIFEST_RULES_SQL, "manifest_files": MANIFEST_FILES_SQL, "validation_report": VALIDATION_REPORT_SQL, "page_tree": PAGE_TREE_SQL, "role_maps": ROLE_MAPS_SQL, "structure_agreement": STRUCTURE_AGREEMENT_SQL,
       "xref_sections": XREF_SECTIONS_SQL, "optional_content": OPTIONAL_CONTENT_SQL, "traceability": TRACEABILITY_SQL}
