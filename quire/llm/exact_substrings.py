"""Exact repeats of 100 bytes, found by merging the Burrows-Wheeler transforms of shards.

Texts that are equal as a whole are settled first. In every other text a sampled
anchor stands for each window of 100 bytes: the 32-byte gram of least hash inside it.
Equal windows have equal anchors at the same place, so a window whose anchor's gram is
nowhere else in the corpus is unique, and most are. What is left are segments: an
anchor with all windows that it stands for. Segments that are equal as a whole
(128 bits of hash) are again settled by a join, whatever their number. Segments that share
an anchor but differ are looked at more closely: the windows of a segment fall into
``CLASSES`` by the place of the anchor in them, and the windows of a class have 83 bytes or more
in common. A class whose common bytes no other segment has holds no repeated window and goes.

What then is left goes to the suffix machinery: a task cuts it into shards,
sorts the suffixes of each shard alone, takes its transform, and merges all
transforms by refining an interleave. Round h orders all suffixes by h bytes with one
stable counting pass over the transforms' symbols; suffixes of one block after round h have a
common prefix of h bytes, and the blocks that still hold several after round 100 are the repeated
intervals. Suffixes of different shards are never compared or sorted again.

A gram with very many different contexts does not gather in a task: its windows are dealt
out one by one, by their own bytes, and equal ones are summed before they are dealt.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import release, save
from quire.llm.kernels import Powers, RangeHash, mix, slices, text_bytes

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of one shard whose suffixes are sorted alone, and of the shards that one merge takes.
SHARD, MERGE = 1 << 15, 1 << 18
#: First and last place of the anchor in the windows of a class.
CLASSES = ((0, 17), (18, 34), (35, 51), (52, SPAN - 1))
#: Grams with more different segments than this are dealt out window by window.
HEAVY = 4000
_POWERS = Powers()
_PLACE = np.uint64((1 << 28) - 1)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# -- anchors --------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """For each anchor: ``doc``, ``at`` (its place in the document), ``gram`` and ``segment`` hashes, and ``first`` and
    ``last`` start of the windows it stands for. Documents are laid end to end in ``data``."""
    none = np.zeros(0, dtype=np.int64)
    n = len(data)
    if n < LENGTH:
        return {k: none for k in ("doc", "at", "first", "last")} | {k: none.view(np.uint64) for k in ("gram", "segment")}
    h = RangeHash(_BYTES[data], _POWERS)
    with np.errstate(over="ignore"):
        gram = mix((h.sums[GRAM:] - h.sums[:-GRAM]) * _POWERS.down[: n - GRAM + 1])
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPAN > width:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    spot = (least & _PLACE).astype(np.int64)  # of the window that starts here
    ok = np.ones(n + 1, dtype=bool)
    ends = offsets[1:]
    edge = np.zeros(n + 2, dtype=np.int64)  # windows that would cross the end of a document
    np.add.at(edge, np.maximum(offsets[:-1], ends - LENGTH + 1), 1)
    np.add.at(edge, ends, -1)
    ok = np.cumsum(edge)[: len(spot)] == 0
    start = np.flatnonzero(ok)
    if not len(start):
        return anchors(data[:0], offsets[:1])
    a = spot[start]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)))
    head = np.flatnonzero(new)
    first, last, at = start[head], start[np.append(head[1:], len(start)) - 1], a[head]
    doc = np.searchsorted(offsets, first, side="right") - 1
    base = offsets[doc]
    with np.errstate(over="ignore"):
        segment = mix(h(first, last + LENGTH) + (at - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return {"doc": doc, "at": at - base, "first": first - base, "last": last - base, "gram": gram[at], "segment": segment}


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 20):
        found = anchors(*text_bytes(b.column("text")))
        uid = b.column("uid").to_numpy(zero_copy_only=False)[found["doc"]]
        cols = [found["gram"].view(np.int64), found["segment"].view(np.int64), uid, found["at"].astype(np.int32), (found["at"] - found["first"]).astype(np.int8), (found["at"] - found["last"]).astype(np.int8)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "segment", "uid", "at", "l", "r"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 20):
        keys, n = np.unique(anchors(*text_bytes(b.column("text")))["gram"].view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["gram", "n"])


# -- suffixes -------------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence in which every text ends in a symbol of its own."""
    rank, step, n = codes.astype(np.int64), 1, int(codes.max()) + 2
    while step < 4 and n < 1 << 31:  # two symbols, then four, as one number
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-step] = rank[step:] + 1 if step < len(rank) else after[:-step]
        rank, step, n = rank * n + after, 2 * step, n * n
    order = np.argsort(rank, kind="stable")
    k = rank[order]
    rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
    if int(rank[order[-1]]) == len(rank) - 1:
        return order
    while True:
        second = np.full(len(rank), -1, dtype=np.int64)
        second[:-step] = rank[step:] if step < len(rank) else second[:-step]
        key = rank * (int(rank.max()) + 2) + second + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        dense = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        rank[order] = dense
        if dense[-1] == len(rank) - 1:
            return order
        step *= 2


class Shard:
    """Texts with their sorted suffixes, transform and last-to-first mapping."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes + 1) - 1  # place of each text's end symbol
        raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        codes = raw.astype(np.int64) + len(texts)
        codes[self.ends] = np.arange(len(texts))
        self.order = suffix_order(codes)
        before = self.order - 1
        self.closing = np.isin(before, self.ends) | (before < 0)  # a text's first suffix: an end symbol stands before it
        self.symbols = raw[before]
        inverse = np.empty(len(raw), dtype=np.int64)
        inverse[self.order] = np.arange(len(raw))
        self.to_first = inverse[before]


def merge(shards: list[Shard], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(flat rank, block) of the suffixes that agree in ``depth`` bytes with another, in merged order.

    A suffix that no other agrees with needs no more rounds, nor does any suffix that it ends: each round goes on with the
    blocks that still hold several. End symbols are all different, so no suffix agrees with another beyond its text."""
    base = np.cumsum([0] + [len(s.order) for s in shards])
    symbols, closing = np.concatenate([s.symbols for s in shards]), np.concatenate([s.closing for s in shards])
    to_first = np.concatenate([s.to_first + b for s, b in zip(shards, base)]).astype(np.int32)
    # one look-up a row and round: the row that its symbol leads to, whether a text begins there, the symbol
    packed = to_first.astype(np.int64) << 9 | closing.astype(np.int64) << 8 | symbols
    rows = np.arange(len(packed))
    block = np.zeros(len(rows), dtype=np.int32)  # no byte seen yet: all agree
    for _ in range(depth):
        p = packed[rows]
        inner = p & 256 == 0
        p, block = p[inner], block[inner]
        order = np.argsort(p.astype(np.uint8), kind="stable")
        p, b = p[order], block[order]
        s = p.astype(np.uint8)
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        keep = ~new
        keep[:-1] |= ~new[1:]
        block = np.cumsum(new, dtype=np.int32)[keep]
        rows = p[keep] >> 9
        if not len(rows):
            break
    return rows, block


def repeats(texts: list[bytes], rank: np.ndarray, shard_bytes: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(text number, offset) of every window that occurs earlier: in a text of smaller ``rank``, or before in its own."""
    shards, firsts, at = [], [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= shard_bytes):
            size += len(texts[to]) + 1
            to += 1
        shards.append(Shard(texts[at:to]))
        firsts.append(at)
        at = to
    none = np.zeros(0, dtype=np.int64)
    if not shards:
        return none, none
    rows, block = merge(shards)
    same = np.flatnonzero(np.concatenate(([False], block[1:] == block[:-1])) | np.concatenate((block[1:] == block[:-1], [False])))
    if not len(same):
        return none, none
    rows, block = rows[same], block[same]
    base = np.cumsum([0] + [len(s.order) for s in shards])
    which = np.searchsorted(base, rows, side="right") - 1
    place = np.concatenate([s.order for s in shards])[rows]
    text, offset = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    for j, s in enumerate(shards):
        mine = which == j
        t = np.searchsorted(s.ends, place[mine])
        text[mine] = t + firsts[j]
        offset[mine] = place[mine] - np.where(t > 0, s.ends[t - 1] + 1, 0)
    order = np.lexsort((offset, rank[text], block))
    later = np.concatenate(([False], block[order][1:] == block[order][:-1]))
    return text[order][later], offset[order][later]


# -- the operator ---------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted segments of the documents with their bytes."""
    names = ["gram", "at", "l", "r"]
    for b in slices(batches, "text", 2 << 20):
        wanted = b.column("wanted")
        many = np.diff(wanted.offsets.to_numpy())
        flat = wanted.flatten()
        at, l, r = (flat.field(k).to_numpy() for k in names[1:])
        texts = b.column("text").cast(pa.binary()).to_pylist()
        own = np.repeat(np.arange(b.num_rows), many)
        parts = [texts[i][s:e] for i, s, e in zip(own.tolist(), (at - l).tolist(), (at - r + LENGTH).tolist())]
        cols = [flat.field(k) for k in names] + [b.column(k).take(pa.array(own)) for k in ("uid", "ord")] + [pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=[*names, "uid", "ord", "part"])


def _runs(uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows to maximal runs (uid, start, end)."""
    order = np.lexsort((start, uid))
    uid, start = uid[order], start[order]
    new = np.concatenate(([True], (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + LENGTH)))
    head = np.flatnonzero(new)
    return uid[head], start[head], start[np.append(head[1:], len(start)) - 1] + LENGTH


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions arrive sorted by key; equal windows share a key, so a merge takes whole keys until it is full."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(rows: pa.Table) -> pa.RecordBatch:
        uid, order, start = (rows.column(c).to_numpy() for c in ("uid", "ord", "start"))
        rank = np.empty(len(uid), dtype=np.int64)
        rank[np.lexsort((start, uid, order))] = np.arange(len(uid))
        text, offset = repeats(rows.column("part").to_pylist(), rank)
        out = _runs(uid[text], start[text] + offset) if len(text) else (np.zeros(0, dtype=np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["uid", "s", "e"])

    for b in batches:
        for at in range(0, b.num_rows, 1000):
            piece = b.slice(at, 1000)
            held.append(piece)
            size += piece.nbytes
            if size > MERGE:
                rows = pa.Table.from_batches(held).combine_chunks()
                key = rows.column("key").to_numpy()
                other = np.flatnonzero(key != key[-1])
                if len(other):
                    cut = int(other[-1]) + 1
                    yield settle(rows.slice(0, cut).combine_chunks())
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
    if held:
        yield settle(pa.Table.from_batches(held))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remaining bytes of texts with removed runs: their hash, and counts."""
    import hashlib

    for b in slices(batches, "text", 2 << 20):
        removed, spans, shas = [], [], []
        for text, runs in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist()):
            merged: list[list[int]] = []
            for s, e in sorted((r["s"], r["e"]) for r in runs):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            digest, at = hashlib.sha256(), 0
            for s, e in merged:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            removed.append(sum(e - s for s, e in merged)), spans.append(len(merged)), shas.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["uid", "n_removed", "n_spans", "kept_sha256"])


def removed_runs(texts: DataFrame, buckets: str) -> DataFrame:
    """(uid, s, e): runs of bytes to remove from ``texts`` (uid, ord, text: different texts), stored as table ``buckets``."""
    spark = texts.sparkSession
    often = save(texts.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    rows = texts.select("uid", "text").mapInArrow(_anchor_rows, "gram long, segment long, uid long, at int, l byte, r byte")
    rows = save(rows.join(often, "gram", "left_semi"), "repeated-anchors")
    release(spark)
    # the smallest (ord, uid, at) of each kind of segment is its first; all others go as a whole
    ords = spark.table(buckets).select("uid", "ord")
    rows = save(rows.join(ords, "uid"), "ordered-anchors")
    first = F.min(F.struct("ord", "uid", "at", "l", "r")).alias("first")
    kinds = save(rows.groupBy("gram", "segment").agg(first, F.count(F.lit(1)).alias("n")), "segments")
    again = rows.join(kinds.where("n > 1").select("gram", "segment", F.col("first.uid").alias("fu"), F.col("first.at").alias("fa")), ["gram", "segment"]).where("uid <> fu or at <> fa")
    whole = again.select("uid", (F.col("at") - F.col("l")).cast("long").alias("s"), (F.col("at") - F.col("r") + LENGTH).cast("long").alias("e"))
    whole = save(whole, "repeated-segments")
    groups = save(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram"), "mixed-grams")
    mixed = kinds.join(groups, "gram").select(F.col("first.uid").alias("uid"), F.struct("gram", "first.at", "first.l", "first.r").alias("w"))
    wanted = mixed.groupBy("uid").agg(F.collect_list("w").alias("wanted"))  # no more than a text has anchors
    parts = spark.table(buckets).join(wanted, "uid").select("uid", "ord", "text", "wanted").mapInArrow(_cut, "gram long, at int, l byte, r byte, uid long, ord long, part binary")
    parts = save(parts, "segment-bytes")
    out = whole.unionByName(_equal_windows(_common(parts)))
    release(spark)
    return out


def _common(parts: DataFrame) -> DataFrame:
    """(gram, uid, ord, start, part): of each segment what spans the classes of windows whose common bytes another segment has too."""
    classes = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in CLASSES]), lambda c: (F.col("r") <= c["e"]) & (F.col("l") >= c["s"]))
    each = parts.select("gram", "uid", "at", "l", "part", F.explode(classes).alias("c"))
    same = F.substring("part", F.col("l") - F.col("c.s") + 1, F.lit(LENGTH) - F.col("c.e") + F.col("c.s"))
    keys = save(each.select("uid", "at", "c.s", "c.e", F.xxhash64("gram", "c.s", same).alias("key"), F.col("gram")), "class-keys")
    often = keys.groupBy("gram", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "key")
    kept = keys.join(often, ["gram", "key"]).groupBy("uid", "at").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    cut = parts.join(kept, ["uid", "at"]).withColumns({"hi": F.least("l", "e").cast("int"), "lo": F.greatest("r", "s").cast("int")})
    return save(cut.select("gram", "uid", "ord", (F.col("at") - F.col("hi")).cast("long").alias("start"), F.substring("part", F.col("l") - F.col("hi") + 1, F.col("hi") - F.col("lo") + LENGTH).alias("part")), "common-parts")


def _equal_windows(parts: DataFrame) -> DataFrame:
    """(uid, s, e): windows of the parts that a part of the same gram holds earlier, in runs."""
    heavy = save(parts.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HEAVY).select("gram"), "heavy-grams")
    light = parts.join(heavy, "gram", "left_anti").withColumnRenamed("gram", "key")
    found = save(light.repartition("key").sortWithinPartitions("key").mapInArrow(_find, "uid long, s long, e long"), "repeated-windows")
    windows = parts.join(heavy, "gram").select("uid", "ord", "start", "part", F.explode(F.sequence(F.lit(0), F.octet_length("part") - LENGTH)).alias("i"))
    windows = windows.select("ord", "uid", (F.col("start") + F.col("i")).alias("s"), F.substring("part", F.col("i") + 1, F.lit(LENGTH)).alias("window"))
    firsts = windows.groupBy("window").agg(F.min(F.struct("ord", "uid", "s")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "f")
    again = windows.join(firsts, "window").where("uid <> f.uid or s <> f.s").select("uid", "s", (F.col("s") + LENGTH).alias("e"))
    return found.unionByName(save(again, "windows-of-heavy-grams"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``.

    Each byte goes that is covered by a string of 100 bytes which also starts earlier: in a row of
    smaller ``doc_id`` (null is largest; rows of equal id count as different documents, in the table's order) or
    earlier in its own. Null text is empty. Shorter texts stay as they are. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), text.alias("text"))
    slim = rows.select("uid", "doc_id", "ord", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    slim = save(slim, "documents")
    long_ = slim.where(F.col("n_bytes") >= LENGTH)
    firsts = save(long_.groupBy("sha").agg(F.min(F.struct("ord", "uid")).alias("f")).select(F.col("f.uid").alias("uid")), "first-copies")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    kept = rows.where(F.octet_length("text") >= LENGTH).select("uid", "ord", "text").repartition(n, "uid").join(firsts.repartition(n, "uid"), "uid", "left_semi")
    # buckets by uid: the joins on uid below leave the texts where they are
    kept.write.format("parquet").option("compression", "zstd").bucketBy(n, "uid").sortBy("uid").saveAsTable(name)
    release(spark)
    texts = spark.table(name)
    runs = removed_runs(texts, name).groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("runs"))  # of one text
    cut = save(texts.join(runs, "uid").select("uid", "text", "runs").mapInArrow(_keep, "uid long, n_removed long, n_spans long, kept_sha256 string"), "cut-texts")
    spark.sql(f"DROP TABLE {name}")
    empty = F.sha2(F.lit(""), 256)
    copy = (F.col("n_bytes") >= LENGTH) & F.col("is_first").isNull()
    out = slim.join(firsts.withColumn("is_first", F.lit(True)), "uid", "left").join(cut, "uid", "left")
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
