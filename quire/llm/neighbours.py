"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A rotation is learned so that the signs of the rotated coordinates lose little
(iterative quantization). Each vector's 64 signs are its code, cut into 8 substrings,
and in each block of vectors every substring is indexed by its value. If two codes
differ in at most R bits, some substring differs in at most R / 8: all values that
near to the query's are probed, which retrieves every code within R; those are
ranked by cosine in double precision on the original vectors.

The rotation and R are fitted on a sample of at most ``SAMPLE`` vectors, R so that the
true neighbours of held queries lie within it ``RECALL`` of the time. Every row is indexed.
Where a block holds too few codes within R, R grows until there are enough or the
block is exhausted. Equal vectors form one class, so one very common vector costs no
more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import save

NEAREST, EVERY = 5, 50
#: Bound on the vectors from which the rotation and the radius are learned.
SAMPLE, RECALL, ROUNDS = 10_000, 0.97, 30
BITS, PARTS = 64, 8
#: Rows of a block of vectors and of a block of queries, at most on average.
BLOCK, QUERIES = 50_000, 4096
LEAST_BLOCKS = 12


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray  # (dimensions, BITS)
    radius: int

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors as rows of 8 bytes."""
        if unit.shape[1] != len(self.mean):  # vectors of another length than those learned from
            rng = np.random.default_rng(unit.shape[1])
            return np.packbits(unit @ rng.normal(size=(unit.shape[1], BITS)) > 0, axis=1)
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over the power of two at their greatest component: cosines stay exactly what they are, and no square overflows or vanishes."""
    top = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1]
    return np.ldexp(x, -top)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn(vectors: np.ndarray, recall: float = RECALL, nearest: int = NEAREST, seed: int = 3) -> Codes:
    """Iterative quantization of a sample, and the radius that holds its true neighbours."""
    rng = np.random.default_rng(seed)
    if len(vectors) < 2:
        d = vectors.shape[1] if vectors.ndim == 2 else 0
        return Codes(np.zeros(d), rng.normal(size=(d, BITS)), BITS)
    x = unit(vectors.astype(np.float64))
    mean = x.mean(axis=0)
    d = x.shape[1]
    _, _, axes = np.linalg.svd(np.cov((x - mean).T).reshape(d, d))
    rotations = []
    while sum(r.shape[1] for r in rotations) < BITS:  # fewer dimensions than bits: several rotations side by side
        base = axes[:BITS].T
        v = (x - mean) @ base
        r = np.linalg.qr(rng.normal(size=(base.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
            r = u @ w
        rotations.append(base @ r)
    codes = Codes(mean, np.concatenate(rotations, axis=1)[:, :BITS], BITS)
    bits = codes.encode(x).view(np.uint64).reshape(-1)
    far = []
    for q in range(0, len(x), max(1, len(x) // 300)):
        score = x @ x[q]
        score[q] = -2
        top = np.argpartition(-score, min(nearest, len(x) - 1) - 1)[:nearest]
        far.append(np.bitwise_count(bits[top] ^ bits[q]))
    codes.radius = int(np.quantile(np.concatenate(far), recall, method="higher"))
    return codes


_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8))
_BALLS = [np.flatnonzero(_NEAR <= r) for r in range(PARTS + 1)]


class Index:
    """One block: for each substring the rows by value."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64).reshape(-1)
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(PARTS)]
        self.bounds = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits."""
        seen = np.zeros(len(self.words), dtype=bool)
        each, more = divmod(radius, PARTS)
        for s in range(PARTS):
            # if every one of the first more + 1 substrings differed by over `each` and the others by `each` or more, the sum would pass the radius
            r = each if s <= more else each - 1
            if r < 0:
                continue
            b, o = self.bounds[s], self.order[s]
            for v in _BALLS[min(r, PARTS)] ^ code[s]:
                seen[o[b[v] : b[v + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.words[rows] ^ code.view(np.uint64)[0]) <= radius]


def search_block(codes: Codes, ids: np.ndarray, x: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the ``most`` best classes found for each query; equal scores: smaller id first."""
    x, queries = scaled(x), scaled(queries)
    norm, qnorm = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    index, qcodes = Index(codes.encode(unit(x))), codes.encode(unit(queries))
    found: tuple[list, list, list] = ([], [], [])
    for q in range(len(queries)):
        radius = codes.radius
        rows = index.within(qcodes[q], radius)
        while len(rows) < most and radius < BITS:
            radius = min(BITS, radius + 4)
            rows = index.within(qcodes[q], radius)
        score = (x[rows] * queries[q]).sum(axis=1) / (norm[rows] * qnorm[q])
        if len(rows) > 4 * most:
            edge = np.partition(score, len(score) - most)[len(score) - most]
            rows, score = rows[score >= edge], score[score >= edge]
        best = np.lexsort((ids[rows], -score))[:most]
        found[0].append(np.full(len(best), q))
        found[1].append(ids[rows[best]])
        found[2].append(score[best])
    return tuple(np.concatenate(f) if f else np.zeros(0) for f in found)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows that can take part, each once."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists(v, lambda c: c != 0)
    # zeros of either sign are one value
    plain = F.transform(v, lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & some).select(F.col(id_col).cast("long").alias("id"), plain.alias("v")).distinct()


def search(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its nearest other rows by cosine.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    null ids; equal rows count once. Vectors are compared with those of their own length. Fewer candidates
    than ``nearest`` are all returned; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = save(valid(vectors, id_col, vector_col), "vectors")
    keep = nearest + 1  # a query's own row may be among the best
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= keep)
    classes = save(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), F.size("v").alias("dim"), "v", "ids"), "vector-classes")
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v")
    asked = save(asked.join(asked.groupBy("v").agg(F.min("query_id").alias("q")), "v"), "queries")
    points = asked.where("q = query_id").select("q", F.size("v").alias("dim"), "v")

    picked = classes.select("v", "dim", F.xxhash64("cls").alias("h")).orderBy("h").limit(SAMPLE).select("v", "dim").toArrow()
    dims = picked.column("dim").to_numpy() if picked.num_rows else np.zeros(0, dtype=int)
    dim = int(np.bincount(dims).argmax()) if len(dims) else 0
    codes = learn(_matrix(picked.filter(pa.array(dims == dim)).column("v")) if len(dims) else np.zeros((0, 0)), nearest=nearest)
    shared = spark.sparkContext.broadcast(codes)

    blocks, groups = max(LEAST_BLOCKS, -(-classes.count() // block)), max(1, -(-points.count() // QUERIES))
    left = classes.select(F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "dim", "cls", "v")
    right = points.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("g"), "dim", "q", "v")

    def kernel(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q = theirs.column("q").to_numpy()
        number, ids, score = search_block(shared.value, mine.column("cls").to_numpy(), _matrix(mine.column("v")), _matrix(theirs.column("v")), keep)
        return pa.table({"q": q[number.astype(int)], "cls": ids.astype(np.int64), "score": score})

    found = left.groupBy("b", "g", "dim").cogroup(right.groupBy("b", "g", "dim")).applyInArrow(kernel, "q long, cls long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))).where(F.col("r") <= keep)
    best = save(best.select("q", "cls", "score"), "best-classes")
    near = best.join(classes.select("cls", "ids"), "cls").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("near"))  # at most `keep` classes of `keep` ids
    pairs = asked.select("query_id", "q").join(near, "q").select("query_id", F.explode("near").alias("n")).select("query_id", "n.score", F.explode("n.ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
