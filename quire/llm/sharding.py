"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame functions only.

A store is a folder: ``runs/<run>/...`` holds Parquet shards that never change
once written, ``manifest/v<N>.json`` lists the runs of version N. Arrivals are
appended as runs of small shards. When ``fan_in`` runs share a size tier they are
merged into one run of target-sized shards. Each version is published by a rename
that fails when the name exists, so a reader sees a whole version or none, and of
two writers of one version exactly one wins and the other tries again on top. (That rename is atomic on HDFS and local disks; an
object store needs a file system whose rename is, or a commit service.)

Rows find their shard without a global sort: their key (MD5 of the id) names one
of 65536 ranges; the bytes ahead of a range plus the key's share of the range's
own bytes, over the target size, is the shard. A range larger than a shard is
split by the next digits of the key. Sums by range are at most 65536 rows,
whatever the input.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, shared_dir, written

TARGET_BYTES, FAN_IN, TIER_BASE, ARRIVALS = 64 << 20, 4, 1 << 20, 4


@dataclass(frozen=True)
class Run:
    name: str
    size: int
    rows: int
    files: list[str] = field(default_factory=list)

    def tier(self, fan_in: int) -> int:
        """Runs of a tier differ by less than a factor of ``fan_in``; a run up to TIER_BASE bytes is in tier 0."""
        return max(0, math.ceil(math.log(max(self.size, 1) / TIER_BASE, fan_in)))


class ShardStore:
    """Appends, merges and reads shards. All file access goes through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifest ---------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._p(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/v{version}.json").first()[0]
        return json.loads(text)

    def _publish(self, old: dict, runs: list[Run | dict], schema: dict | None) -> bool:
        new = {"version": old["version"] + 1, "schema": schema or old["schema"], "runs": [r if isinstance(r, dict) else vars(r) for r in runs]}
        jvm, name = self.spark._jvm, f"v{new['version']}.json"
        part, whole = self._p(f"{self.path}/manifest/_{uuid.uuid4().hex}"), self._p(f"{self.path}/manifest/{name}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, whole, none)
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _commit(self, add: list[Run], gone: set[str], schema: dict | None) -> int:
        while True:
            old = self.manifest()
            kept = [r for r in old["runs"] if r["name"] not in gone]
            if len(old["runs"]) - len(kept) != len(gone):
                raise RuntimeError("another writer has merged these runs already")
            if self._publish(old, kept + add, schema):
                return old["version"] + 1

    # -- writing ----------------------------------------------------------------------------------

    def _key(self, df: DataFrame, key: str) -> Column:
        return F.md5(F.coalesce(df[key].cast("string"), F.lit("")))

    def append(self, df: DataFrame, key: str, text: str, arrival: Column | None = None, arrivals: int = 1) -> list[int]:
        """Write ``df`` once as small shards; each arrival becomes a run and a version of its own."""
        names = {k: fresh(k, df) for k in ("shard_bytes", "shard_key", "arrival")}
        root = f"runs/{uuid.uuid4().hex}"
        rows = df.withColumns({names["shard_key"]: self._key(df, key), names["shard_bytes"]: F.coalesce(F.octet_length(df[text].cast("string")), F.lit(0)).cast("long")})
        rows = rows.withColumn(names["arrival"], arrival if arrival is not None else F.lit(0))
        rows.write.partitionBy(names["arrival"]).option("compression", "zstd").parquet(f"{self.path}/{root}")
        schema = {"fields": json.loads(rows.drop(names["arrival"]).schema.json()), "names": names, "key": key}
        found = self._files(root)
        by = {i: [f for f in found if f"/{names['arrival']}={i}/" in f] for i in range(arrivals)}
        totals: dict = {}
        if found:
            sums = self.spark.read.parquet(f"{self.path}/{root}").groupBy(names["arrival"]).agg(F.sum(names["shard_bytes"]).alias("b"), F.count(F.lit(1)).alias("n"))
            totals = {r[0]: (r["b"], r["n"]) for r in sums.collect()}  # one row an arrival
        out = [self._commit([Run(f"{root}/{i}", *totals.get(i, (0, 0)), by[i])] if by[i] else [], set(), schema) for i in range(arrivals)]
        return out

    def _files(self, root: str) -> list[str]:
        """Data files below ``root``, relative to the store."""
        it = self._fs.listFiles(self._p(f"{self.path}/{root}"), True)
        found = []
        while it.hasNext():
            at = it.next().getPath().toString()
            if at.endswith(".parquet"):
                found.append(at[at.index(root):])
        return sorted(found)

    def compact(self, final: bool = False) -> int | None:
        """Merge until no tier holds ``fan_in`` runs; ``final``: then merge what is left of several runs, or of arrivals
        never merged. The last version, None if nothing was merged."""
        version = None
        while True:
            tiers: dict[int, list[Run]] = {}
            for r in (Run(**x) for x in self.manifest()["runs"]):
                tiers.setdefault(r.tier(self.fan_in), []).append(r)
            full = next((runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fan_in), None)
            if full is None and final:
                rest = [r for runs in tiers.values() for r in runs]
                full = rest if len(rest) > 1 or any("shard=" not in f for r in rest for f in r.files) else None
            if full is None:
                return version
            version = self._merge(full)

    def _merge(self, runs: list[Run]) -> int:
        schema = self.manifest()["schema"]
        names = schema["names"]
        rows = self._rows([f for r in runs for f in r.files], schema)
        key, size = rows[names["shard_key"]], rows[names["shard_bytes"]]
        hex4 = lambda at: F.conv(F.substring(key, at, 4), 16, 10).cast("long")
        sums = rows.select(hex4(1).alias("range"), size.alias("b")).groupBy("range").agg(F.sum("b").alias("own"))  # at most 65536 rows
        ahead = F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = sums.select("range", "own", ahead.alias("ahead"))
        at, own, range_, shard = (fresh(x, rows) for x in ("ahead", "own", "range", "shard"))
        ranges = ranges.toDF(range_, own, at)
        placed = rows.withColumn(range_, hex4(1)).join(F.broadcast(ranges), range_)
        exact = F.col(at) + F.floor(F.col(own) * hex4(5) / F.lit(65536))
        placed = placed.withColumn(shard, F.floor(exact / F.lit(self.target)).cast("long")).drop(at, own, range_)
        count = max(1, math.ceil(sum(r.size for r in runs) / self.target))
        root = f"runs/{uuid.uuid4().hex}"
        # each shard is one task's: shard i goes to partition i
        placed.repartitionById(count, F.col(shard).cast("int")).write.partitionBy(shard).option("compression", "zstd").parquet(f"{self.path}/{root}")
        merged = Run(f"{root}/0", sum(r.size for r in runs), sum(r.rows for r in runs), self._files(root))
        return self._commit([merged], {r.name for r in runs}, None)

    def vacuum(self) -> None:
        """Delete files that older versions list and the newest doesn't; older versions can't be read any more. Files that no
        version lists are left: they may belong to a writer that has not committed yet."""
        live = {f for r in self.manifest()["runs"] for f in r["files"]}
        if not self.versions():
            return
        old = self.spark.read.option("wholetext", True).option("pathGlobFilter", "v*.json").text(f"{self.path}/manifest").collect()  # a row a version
        for f in {f for v in old for r in json.loads(v[0])["runs"] for f in r["files"]} - live:
            self._fs.delete(self._p(f"{self.path}/{f}"), False)

    # -- reading ----------------------------------------------------------------------------------

    def _rows(self, files: list[str], schema: dict) -> DataFrame:
        kind = T.StructType.fromJson(schema["fields"])
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None, shard_name: str = "shard_id") -> DataFrame:
        """The rows of a version with the number of the shard that holds each, from its file's folder; -1: not merged yet."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("the store is empty")
        rows = self._rows([f for r in now["runs"] for f in r["files"]], now["schema"])
        names = now["schema"]["names"]
        stored = any(r["files"] for r in now["runs"])
        path = F.col("_metadata.file_path") if stored else F.lit("")
        number = F.nullif(F.regexp_extract(path, r"shard=(\d+)/[^/]*$", 1), F.lit("")).cast("long")
        ahead, first = F.lit(0), 0  # the shards of a merged run are numbered after those of the runs before it
        for r in now["runs"]:
            mine = [int(m[1]) for f in r["files"] if (m := re.search(r"shard=(\d+)/[^/]*$", f))]
            if mine:
                ahead = F.when(F.contains(path, F.lit(f"/{r['name'].rpartition('/')[0]}/")), first).otherwise(ahead) if first else ahead
                first += max(mine) + 1
        rows = rows.withColumn(shard_name, F.coalesce(number + ahead, F.lit(-1)).cast("long"))
        own = [c for c in rows.columns if c not in (names["shard_key"], names["shard_bytes"], shard_name)]
        return rows.select(*[F.col(f"`{c}`") for c in own], shard_name, F.col(names["shard_bytes"]).alias("shard_row_bytes"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, arrivals: int = ARRIVALS) -> DataFrame:
    """Send ``docs`` through a fresh store in ``arrivals`` arrivals, merge, and read the last version:
    the columns of ``docs`` with ``shard_id`` and ``shard_row_bytes`` (bytes of text, null: 0).

    Null and repeated ids are keyed like others, repeated rows all stay; an empty
    table gives an empty version. Columns that clash with the store's own are kept.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/quire/store-{uuid.uuid4().hex}"
    written().append(path)
    store = ShardStore(spark, path, target_bytes, fan_in)
    digit = F.conv(F.substring(F.md5(F.coalesce(docs[key].cast("string"), F.lit(""))), 1, 1), 16, 10).cast("int")
    store.append(docs, key, text, (digit * arrivals / 16).cast("int"), arrivals)
    store.compact(final=True)
    store.vacuum()
    return store.read()


SQL = r"""
with d as (
  select doc_id, text, coalesce(strlen(text), 0)::bigint as n_bytes, md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
r as (select *, ('0x' || substr(k, 1, 4))::bigint as r1, ('0x' || substr(k, 5, 4))::bigint as r2 from d),
s as (select r1, sum(n_bytes)::bigint as own from r group by r1),
a as (select r1, own, coalesce(sum(own) over (order by r1 rows between unbounded preceding and 1 preceding), 0)::bigint as ahead from s)
select doc_id, n_bytes, (ahead + own * r2 // 65536) // 67108864 as shard_id, md5(text) as text_md5 from r join a using (r1)
"""
