"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of
one half. Each half is covered by a code: the perfect Golay code on 23 of its bits
(every word lies within 3 bits of exactly one code word) times all words of the
other 9 bits. Code words are the anchors. A fingerprint belongs to the anchor that
covers it and is replicated to every anchor within the covering radius plus the
threshold that a fingerprint one bit away could belong to: 10 or 15 anchors a half.
Linked fingerprints therefore meet at an anchor, and only there are they compared.
Exact copies share a fingerprint and are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import save
from quire.llm.components import connected_components
from quire.llm.kernels import slices

SEED, SHINGLE, THRESHOLD = 42, 3, 3
#: Anchors with more rows than this are compared in blocks of this many, each pair of blocks a task of its own.
BLOCK = 8192
_PIECE = 200_000


# -- fingerprints ---------------------------------------------------------------------------------


def _hashes(words: list[bytes]) -> Iterator[int]:
    h = xxhash.xxh64_intdigest
    if not words:
        return iter(())
    if len(words) < SHINGLE:
        return iter((h(b" ".join(words), SEED),))
    return (h(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:], strict=False)))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of UTF-8 texts as unsigned 64-bit values."""
    counts, sizes = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    pool: list[int] = []
    owners: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if pool:
            sums = np.add.reduceat(_bits(np.array(pool, dtype=np.uint64)), starts, axis=0, dtype=np.int32)
            np.add.at(counts, owners, sums)
        pool.clear(), owners.clear(), starts.clear()

    for i, text in enumerate(texts):
        hashes = _hashes(text.lower().split())
        while part := list(islice(hashes, _PIECE)):  # a very long text comes in pieces
            starts.append(len(pool))
            owners.append(i)
            pool.extend(part)
            sizes[i] += len(part)
            if len(pool) >= _PIECE:
                flush()
    flush()
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp`` (long: the 64 bits) in front; null text counts as empty."""
    cols = [c for c in docs.columns if c != "fp"]
    schema = T.StructType([T.StructField("fp", T.LongType()), *[docs.schema[c] for c in cols]])
    source = docs.select(*[F.col(f"`{c}`") for c in cols])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            fp = pa.array(fingerprints_of(texts).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([fp, *[b.column(c) for c in cols]], names=["fp", *cols])

    return source.mapInArrow(kernel, schema)


# -- anchors --------------------------------------------------------------------------------------


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; the error of weight up to 3 of each syndrome; its five of weight 4, or zeros."""
    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= 0xC75 << (i - 11)
        return x

    unit = [remainder(1 << i) for i in range(23)]
    low, high = np.zeros(4096, dtype=np.uint32), np.zeros(2048, dtype=np.uint32)
    for i in range(12):
        low[np.arange(4096) >> i & 1 == 1] ^= unit[i]
    for i in range(11):
        high[np.arange(2048) >> i & 1 == 1] ^= unit[12 + i]
    near, far, fill = np.zeros(2048, dtype=np.uint32), np.zeros((2048, 5), dtype=np.uint32), np.zeros(2048, dtype=int)
    from itertools import combinations
    for w in range(5):
        for at in combinations(range(23), w):
            s, e = 0, 0
            for i in at:
                s ^= unit[i]
                e |= 1 << i
            if w < 4:
                near[s] = e
            else:
                far[s, fill[s]] = e
                fill[s] += 1
    return low, high, near, far


_TABLES: list = []


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of fingerprint) of every anchor to which a fingerprint is replicated."""
    if not _TABLES:
        _TABLES.extend(_golay())
    low, high, near, far = _TABLES
    keys, owners = [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)).astype(np.uint32)
        g, rest = x & np.uint32((1 << 23) - 1), x & ~np.uint32((1 << 23) - 1)
        syndrome = low[g & 4095] ^ high[g >> 12]
        home = (g ^ near[syndrome]) | rest
        found = [home] + [home ^ np.uint32(1 << (23 + i)) for i in range(9)]
        index = [np.arange(len(fps))] * 10
        with5 = np.flatnonzero(far[syndrome, 0])
        for k in range(5):
            found.append((g[with5] ^ far[syndrome[with5], k]) | rest[with5])
            index.append(with5)
        keys.append(np.concatenate(found).astype(np.int64) | np.int64(half << 32))
        owners.append(np.concatenate(index))
    return np.concatenate(keys), np.concatenate(owners)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 50_000):
            fps = b.column("fp").slice(at, 50_000).to_numpy(zero_copy_only=False)
            keys, index = anchors_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[index])], names=["key", "fp"])


def links_within(key: np.ndarray, fp: np.ndarray, threshold: int = THRESHOLD, wide: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal key (sorted by key); of a wide group, enough links to connect all that are linked."""
    fp = fp.view(np.uint64)
    a, b = [], []
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(cuts, len(key)))
    small = np.repeat(sizes <= wide, sizes)
    k, f = key[small], fp[small]
    for d in range(1, wide):
        at = np.flatnonzero(k[:-d] == k[d:])
        if not len(at):
            break
        at = at[np.bitwise_count(f[at] ^ f[at + d]) <= threshold]
        a.append(f[at])
        b.append(f[at + d])
    for i in np.flatnonzero(sizes > wide):
        left = fp[cuts[i] : cuts[i] + sizes[i]]
        while len(left):  # breadth first: each step compares one fingerprint with all not reached yet
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                hit = np.bitwise_count(left ^ x) <= threshold
                if hit.any():
                    new = left[hit]
                    a.append(np.full(len(new), x))
                    b.append(new)
                    todo.extend(new)
                    left = left[~hit]
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions arrive sorted by (key, part); a group is held until its last row has come."""
    held = None

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([0], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))) if rows.shape[1] else rows[0]
        a, b = links_within(group, np.ascontiguousarray(rows[2]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp")])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield emit(rows[:, :cut])
        held = rows[:, cut:]
    if held is not None:
        yield emit(held)


def fingerprint_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``nodes`` (fp, distinct) to links (a, b): enough to connect all fingerprints within the threshold of each other."""
    spots = save(nodes.select("fp").mapInArrow(_replicate, "key long, fp long"), "anchors")
    heavy = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    heavy = save(heavy, "heavy-anchors")
    # the rows of a heavy anchor go to blocks; a task sees two blocks, so that any two rows meet somewhere
    plain = spots.join(heavy, "key", "left_anti").select("key", F.lit(0).cast("long").alias("part"), "fp")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = spots.join(heavy, "key").select("key", "fp", "parts", mine.alias("i"), other.alias("j"))
    split = split.select("key", (F.greatest("i", "j").cast("long") * F.col("parts") + F.least("i", "j") + 1).alias("part"), "fp")
    rows = plain.unionByName(split)
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_compare, "a long, b long")


def components(fps: DataFrame) -> DataFrame:
    """(fp, first, root, component_id): each fingerprint's smallest ``doc_id``, the fingerprint that names its
    component, and the smallest ``doc_id`` it reaches through links."""
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = connected_components(fingerprint_links(nodes))
    roots = save(roots.withColumnRenamed("node", "fp").join(nodes, "fp"), "linked")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    found = save(roots.join(least, "root").select("fp", "root", "component_id"), "fp-components")
    return save(nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")), "nodes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. A null
    ``doc_id`` takes part in links but never names a component, unless all of its ids are
    null. Repeated rows come out repeated. An empty table gives an empty result. Other
    columns are ignored.
    """
    fps = save(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "doc-fingerprints")
    named = fps.join(components(fps), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-copies: of each component one row stays, that of the smallest ``doc_id`` (null
    last; of repeated ids, one row). The columns are those of ``docs``."""
    from quire.llm.common import fresh

    row, uid = fresh("row", docs), fresh("uid", docs)
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    made = fingerprints(packed).select("fp", "doc_id", row).withColumn(uid, F.monotonically_increasing_id())
    made = save(made, "rows-with-fingerprints")
    nodes = components(made.select("fp", "doc_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(uid).alias("u"))
    per_fp = made.groupBy("fp").agg(F.min(rank).alias("best"))
    roots = per_fp.join(nodes, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = save(roots.select(F.col("best.u").alias(uid)), "kept-rows")
    # one plan at every size: the rows are dealt by uid, the kept uids of a partition are a hash table
    return made.join(kept.hint("shuffle_hash"), uid, "left_semi").select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
