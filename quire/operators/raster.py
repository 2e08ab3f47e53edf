"""Painting as joins: shapes are cut into rows first, so pixels meet only edges of their own row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def subpaths(points: DataFrame, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """Adds ``sub``: a new group begins at each move."""
    return points.withColumn("sub", F.sum(F.col("move").cast("int")).over(Window.partitionBy(path).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def edges_of(points: DataFrame, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """(path, x0, y0, x1, y1): segments of all subpaths, each closed to its first point."""
    p = subpaths(points, path, seq)
    w = Window.partitionBy(path, "sub").orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = p.select(path, F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x1"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y1"))
    return end.where("x0 <> x1 or y0 <> y1")


def bounds(points: DataFrame, path: str = "path_id") -> DataFrame:
    return points.groupBy(path).agg(F.min("x").alias("llx"), F.min("y").alias("lly"), F.max("x").alias("urx"), F.max("y").alias("ury"))


#: Scan lines, or pixels tried, that a kernel holds at once.
PIECE = 1 << 19


def _starts(keys: pa.Array) -> np.ndarray:
    """Places where a value differs from the one ahead of it, 0 first."""
    if pa.types.is_struct(keys.type):
        return np.unique(np.concatenate([_starts(f) for f in keys.flatten()]))
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    differ = pc.and_not(pc.fill_null(pc.not_equal(a, b), True), pc.and_(a.is_null(), b.is_null()))
    return np.concatenate(([0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1))


def _each_shape(rows: DataFrame, path: str, shapes: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], weigh: Callable, cut: Callable, height: int, totals: bool) -> DataFrame:
    """Spans (path, row, lo, hi), or totals (path, n, rows, cols), of rows of which those of one path lie together.

    ``shapes(batch)`` gives the row that each edge is of, and columns of edges; ``weigh(edges)`` bounds what they cost, and
    ``cut(path of each edge, edges, r0, r1)`` gives path, row, lo and hi of spans, disjoint in each row. A path is held whole, and done in bands of rows if it is large."""
    def banded(gid: np.ndarray, edges: list[np.ndarray], cost: np.ndarray, r0: int, r1: int) -> Iterator[tuple[np.ndarray, ...]]:
        if cost.sum() > 4 * PIECE and r1 - r0 > 1:
            mid = (r0 + r1) // 2
            for lo, hi in ((r0, mid), (mid, r1)):
                yield from banded(gid, edges, weigh(edges, lo, hi), lo, hi)
        else:
            yield cut(gid, edges, r0, r1)

    def done(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = _starts(b.column(path))
        names = b.column(path).take(pa.array(first))
        of, *edges = shapes(b)
        gid = np.searchsorted(first, of, side="right") - 1
        cost = weigh(edges, 0, height)
        ahead = np.cumsum(np.bincount(gid, cost, len(first))) // PIECE
        bounds = np.concatenate((np.searchsorted(gid, np.flatnonzero(np.diff(ahead, prepend=-1))), [len(gid)]))
        sums = np.zeros((3, len(first)))
        for i, j in zip(bounds, bounds[1:]):
            for g, row, lo, hi in banded(gid[i:j], [e[i:j] for e in edges], cost[i:j], 0, height):
                if totals:
                    n = hi - lo + 1
                    for k, v in enumerate((n, row * n, (lo + hi) * n // 2)):
                        sums[k] += np.bincount(g, v, len(first))
                elif len(g):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(g)), *[pa.array(v.astype(np.int32)) for v in (row, lo, hi)]], names=[path, "row", "lo", "hi"])
        if totals:
            some = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), *[pa.array(v[some].astype(np.int64)) for v in sums]], names=[path, "n", "rows", "cols"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            seam = _starts(pa.concat_arrays([held[-1].column(path).slice(len(held[-1]) - 1), b.column(path)])) if held else np.concatenate(([0], _starts(b.column(path))))
            if held and len(seam) == 1:  # more of the same path
                held.append(b)
                continue
            last = int(seam[-1]) - bool(held)
            whole = [*held, b.slice(0, last)]
            if sum(map(len, whole)):
                yield from done(pa.concat_batches(whole))
            held = [b.slice(last)]
        if held:
            yield from done(pa.concat_batches(held))

    kinds = {"n": T.LongType(), "rows": T.LongType(), "cols": T.LongType()} if totals else dict.fromkeys(("row", "lo", "hi"), T.IntegerType())
    return rows.mapInArrow(kernel, T.StructType([rows.schema[path], *[T.StructField(c, k) for c, k in kinds.items()]]))


def _lines(y0: np.ndarray, y1: np.ndarray, height: int, r0: int, r1: int, half: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """First and last row from r0 to r1 that each edge, ``half`` wider on both sides, may touch."""
    first = np.clip(np.floor(height - np.maximum(y0, y1) - half - 0.5), r0, r1).astype(np.int64)
    return first, np.clip(np.ceil(height - np.minimum(y0, y1) + half - 0.5), r0 - 1, r1 - 1).astype(np.int64)


def _repeated(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): every integer from ``first`` to ``last`` of each."""
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - first, n)


def _fill(rows: DataFrame, shapes: Callable, width: int, height: int, even_odd: bool, path: str, totals: bool) -> DataFrame:
    def weigh(edges: list[np.ndarray], r0: int, r1: int) -> np.ndarray:
        first, last = _lines(edges[1], edges[3], height, r0, r1)
        return np.maximum(last - first + 1, 0)

    def cut(gid: np.ndarray, edges: list[np.ndarray], r0: int, r1: int) -> tuple[np.ndarray, ...]:
        which, row = _repeated(*_lines(edges[1], edges[3], height, r0, r1))
        x0, y0, x1, y1 = (e[which] for e in edges)
        cy = height - row - 0.5
        hit = (y0 != y1) & (cy >= np.minimum(y0, y1)) & (cy < np.maximum(y0, y1))
        x0, y0, x1, y1, cy, row, g = (v[hit] for v in (x0, y0, x1, y1, cy, row, gid[which]))
        x, way = x0 + (cy - y0) / (y1 - y0) * (x1 - x0), np.where(y1 > y0, 1, -1)
        line = (g - (g[0] if len(g) else 0)) * height + row
        order = np.lexsort((way, x, line))
        line, x, way = line[order], x[order], way[order]
        new = np.diff(line, prepend=-1) != 0
        wind = np.cumsum(way)
        wind -= np.repeat((wind - way)[new], np.diff(np.append(np.flatnonzero(new), len(line))))
        inside = (wind % 2 != 0 if even_odd else wind != 0)[:-1] & ~new[1:]
        lo = np.clip(np.ceil(x[:-1] - 0.5), 0, width).astype(np.int64)
        hi = np.clip(np.ceil(x[1:] - 0.5) - 1, -1, width - 1).astype(np.int64)
        keep = np.flatnonzero(inside & (lo <= hi))
        at = order[keep]
        return g[at], row[at], lo[keep], hi[keep]

    return _each_shape(rows, path, shapes, weigh, cut, height, totals)


def _listed(column: str) -> Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]:
    """Edges of lists of points, each subpath closed to its first point."""
    def shapes(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        lists = b.column(column)
        points = lists.flatten()
        x, y, move = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "move"))
        n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(b)), n)
        begins = move.astype(bool) | (np.diff(of, prepend=-1) != 0)
        at = np.maximum.accumulate(np.where(begins, np.arange(len(of)), 0))  # the first point of each point's subpath
        ahead = np.append(~begins[1:], False)[: len(of)]
        to = np.where(ahead, np.arange(1, len(of) + 1), at)
        x1, y1 = x[to], y[to]
        keep = ((x != x1) | (y != y1)) & np.isfinite(x) & np.isfinite(y) & np.isfinite(x1) & np.isfinite(y1)
        return tuple(v[keep] for v in (of, x, y, x1, y1))

    return shapes


def _columns(*names: str) -> Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]:
    def shapes(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        cols = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]
        keep = np.logical_and.reduce([np.isfinite(c) for c in cols])
        return tuple(v[keep] for v in (np.arange(len(b)), *cols))

    return shapes


def _together(rows: DataFrame, path: str) -> DataFrame:
    """Rows of one path behind each other in one task: narrow rows are dealt and sorted, pixels never are."""
    return rows.repartition(path).sortWithinPartitions(path)


def _pixels(spans: DataFrame, path: str) -> DataFrame:
    return spans.select(path, "row", F.explode(F.sequence("lo", "hi")).alias("col"))


def fill(edges: DataFrame, width: int, height: int, even_odd: bool = False, path: str = "path_id") -> DataFrame:
    """(path, row, col): pixels whose centre is inside. Rows count from the top, y grows upward.

    Edges are cut at the scan lines of the rows they touch; between consecutive crossings of a row the winding
    number is constant, so spans of pixels are generated and no pixel meets an edge at all. Spans of a row are disjoint."""
    rows = _together(edges.select(path, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]), path)
    return _pixels(_fill(rows, _columns("x0", "y0", "x1", "y1"), width, height, even_odd, path, False), path)


def fill_paths(paths: DataFrame, points: Column, width: int, height: int, even_odd: bool = False, path: str = "path_id", totals: bool = False) -> DataFrame:
    """As ``fill``, of paths whose ``points`` are lists of (x, y, move); rows of one path count as one. ``totals``: (path, n, rows, cols),
    how many pixels a path has and the sums of their rows and columns, of paths that have any. Points are built where rows lie by then."""
    rows = _together(paths, path).select(path, points.alias("points"))
    found = _fill(rows, _listed("points"), width, height, even_odd, path, totals)
    return found if totals else _pixels(found, path)


def _stroke(segments: DataFrame, width: int, height: int, path: str, totals: bool) -> DataFrame:
    def weigh(edges: list[np.ndarray], r0: int, r1: int) -> np.ndarray:
        x0, y0, x1, y1, half = edges
        first, last = _lines(y0, y1, height, r0, r1, half)
        rows = np.maximum(last - first + 1, 0)
        return (rows + (rows > 0) * np.minimum(np.abs(x1 - x0), width)) * (2 * np.minimum(half, width) + 4)

    def cut(gid: np.ndarray, edges: list[np.ndarray], r0: int, r1: int) -> tuple[np.ndarray, ...]:
        which, row = _repeated(*_lines(edges[1], edges[3], height, r0, r1, edges[4]))
        x0, y0, x1, y1, half = (e[which] for e in edges)
        py, dx, dy = height - row - 0.5, x1 - x0, y1 - y0
        with np.errstate(divide="ignore", invalid="ignore"):  # only the part of a segment that is near the row is tried
            a, b = (np.where(dy == 0, end, np.clip((py + side - y0) / dy, 0, 1)) for side, end in ((-half, 0.0), (half, 1.0)))
        lo, hi = x0 + a * dx, x0 + b * dx
        first = np.clip(np.floor(np.minimum(lo, hi) - half - 0.5) - 1, 0, width).astype(np.int64)
        last = np.clip(np.ceil(np.maximum(lo, hi) + half - 0.5) + 1, -1, width - 1).astype(np.int64)
        each, col = _repeated(first, last)
        px, py, x0, y0, dx, dy, half = col + 0.5, *(v[each] for v in (py, x0, y0, dx, dy, half))
        length = dx * dx + dy * dy
        t = np.clip(np.divide((px - x0) * dx + (py - y0) * dy, length, out=np.zeros_like(px), where=length != 0), 0.0, 1.0)
        u, v = px - x0 - t * dx, py - y0 - t * dy
        near = np.sqrt(u * u + v * v) <= half
        g = gid[which]
        base = g[0] if len(g) else 0
        key = np.unique((((g - base) * height + row)[each] * width + col)[near])
        # runs of pixels; one never goes on into the next row
        new = np.flatnonzero((np.diff(key, prepend=-2) != 1) | (key % width == 0))
        end = key[np.append(new[1:], len(key)) - 1] if len(key) else key
        line, lo = np.divmod(key[new], width)
        return line // height + base, line % height, lo, end % width

    rows = _together(segments.select(path, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "half")]), path)
    return _each_shape(rows, path, _columns("x0", "y0", "x1", "y1", "half"), weigh, cut, height, totals)


def stroke(segments: DataFrame, half: float, width: int, height: int, path: str = "path_id", totals: bool = False) -> DataFrame:
    """(path, row, col): pixels whose centre lies within ``half`` of a segment, or totals as of ``fill_paths``. Of each row that a
    segment touches only the pixels along its part near the row are tried."""
    found = _stroke(segments.withColumn("half", F.lit(float(half))), width, height, path, totals)
    return found if totals else _pixels(found, path)


def clip(pixels: DataFrame, regions: DataFrame, clips: DataFrame, mark: str = "mark_id") -> DataFrame:
    """Pixels of a mark that lie in every clip of the mark. ``regions``: (clip_id, row, col), ``clips``: (mark, clip_id)."""
    need = clips.groupBy(mark).agg(F.countDistinct("clip_id").alias("need"))
    met = pixels.join(clips, mark).join(regions, ["clip_id", "row", "col"]).groupBy(mark, "row", "col").agg(F.countDistinct("clip_id").alias("met"))
    return pixels.join(need, mark, "left").join(met, [mark, "row", "col"], "left").where("need is null or met = need").drop("need", "met")


def paint(marks: DataFrame, page: str = "page") -> DataFrame:
    """Opaque marks (page, seq, row, col, r, g, b): the last one shows."""
    return marks.groupBy(page, "row", "col").agg(F.max_by(F.struct("r", "g", "b"), "seq").alias("c")).select(page, "row", "col", "c.r", "c.g", "c.b")


def fold_marks(marks: DataFrame, page: str = "page") -> DataFrame:
    """Marks with ``alpha`` and ``mode`` composited in order of ``seq`` on white, rounded to bytes after each."""
    from quire.functions.colour import BLEND, composite

    def step(dst: Column, m: Column) -> Column:
        def channel(c: str) -> Column:
            out = None
            for mode in BLEND:
                out = F.when(m["mode"] == mode, composite(dst[c], m[c], m["alpha"], mode)) if out is None else out.when(m["mode"] == mode, composite(dst[c], m[c], m["alpha"], mode))
            return out.otherwise(dst[c])
        return F.struct(*[channel(c).cast("int").alias(c) for c in "rgb"])

    ordered = marks.groupBy(page, "row", "col").agg(F.sort_array(F.collect_list(F.struct("seq", "r", "g", "b", "alpha", "mode"))).alias("m"))  # the marks on one pixel
    white = F.struct(*[F.lit(255).alias(c) for c in "rgb"])
    return ordered.select(page, "row", "col", F.aggregate("m", white, step).alias("c")).select(page, "row", "col", "c.r", "c.g", "c.b")


def draw_image(target: DataFrame, image: DataFrame, inverse: tuple[Column, ...], width: int, height: int) -> DataFrame:
    """Nearest-neighbour sampling: pixels (row, col) of the target take the image pixel (v, u) their centre maps to."""
    from quire.functions.colour import matrix_apply

    x, y = matrix_apply(inverse, F.col("col") + 0.5, F.col("row") + 0.5)
    u, v = F.floor(x * width).cast("int"), F.floor(y * height).cast("int")
    at = target.withColumn("u", u).withColumn("v", v).where((x >= 0) & (x < 1) & (y >= 0) & (y < 1))
    return at.join(image.select(F.col("row").alias("v"), F.col("col").alias("u"), "r", "g", "b"), ["u", "v"])


def sample_images(marks: DataFrame, width: int, height: int) -> DataFrame:
    """(path_id, row, col, r, g, b, cover): pixels whose centre the matrix of an image takes into its unit square, and the
    image pixel there; row 0 of an image is the top of its square."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("image").to_pylist()):
                (a, b, c, d, e, f), w, h = x["m"], x["w"], x["h"]
                det = a * d - b * c
                if not det:
                    continue
                xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
                cols = np.arange(max(0, int(np.floor(min(xs)))), min(width, int(np.ceil(max(xs)))))
                rows = np.arange(max(0, int(np.floor(height - max(ys)))), min(height, int(np.ceil(height - min(ys)))))
                px, py = np.meshgrid(cols + 0.5 - e, height - rows - 0.5 - f)
                u, v = (d * px - c * py) / det, (a * py - b * px) / det
                r, k = np.nonzero((u >= 0) & (u < 1) & (v >= 0) & (v < 1))
                rgba = np.frombuffer(x["rgba"], dtype=np.uint8).reshape(h, w, 4)[h - 1 - (v[r, k] * h).astype(int), (u[r, k] * w).astype(int)]
                own = batch.column("path_id").take(pa.array(np.full(len(r), i)))
                ints = [pa.array(z.astype(np.int32)) for z in (rows[r], cols[k], *rgba.T)]
                yield pa.RecordBatch.from_arrays([own, *ints], names=["path_id", "row", "col", "r", "g", "b", "cover"])

    kinds = [T.StructField(c, T.IntegerType()) for c in ("row", "col", "r", "g", "b", "cover")]
    return marks.select("path_id", "image").mapInArrow(kernel, T.StructType([marks.schema["path_id"], *kinds]))


def render(marks: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, page, row, col, r, g, b): painted pixels of a marks table, in paint order; what is not listed is white.

    A mark paints only where all of its clips have pixels; images bring a colour and a cover for each pixel."""
    m = marks.where("op in ('fill', 'eofill', 'stroke', 'image')").withColumn("path_id", F.struct("doc_id", "page", "seq"))
    points = m.select("path_id", "op", "half", F.posexplode("points").alias("seq", "p")).select("path_id", "op", "half", "seq", "p.x", "p.y", "p.move")
    parts = [fill_paths(m.where(F.col("op") == op), F.col("points"), width, height, op == "eofill") for op in ("fill", "eofill")]
    lines = points.where("op = 'stroke'").withColumn("sub", F.sum(F.col("move").cast("int")).over(Window.partitionBy("path_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("path_id", "sub").orderBy("seq")
    seg = lines.select("path_id", "half", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")).where("x0 is not null")
    parts.append(stroke_wide(seg, width, height))
    colour = m.select("path_id", "r", "g", "b", "alpha", "mode")
    hit = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(colour, "path_id")
    shown = sample_images(m.where("op = 'image'"), width, height).join(colour.select("path_id", "alpha", "mode"), "path_id")
    hit = hit.unionByName(shown.where("cover > 0").withColumn("alpha", F.col("alpha") * F.col("cover") / 255).drop("cover"))
    clips = m.where("clips > 0").select("path_id", F.posexplode("clip_paths").alias("n", "c"))
    # clips that many marks share are filled once
    keyed = clips.select("path_id", F.xxhash64(F.to_json("c")).alias("clip_id"), "c")
    shapes = keyed.groupBy("clip_id").agg(F.any_value("c").alias("c")).select(F.col("clip_id").alias("path_id"), "c.even", "c.points")
    whole, odd = (fill_paths(shapes.where(F.col("even") == F.lit(even)), F.col("points"), width, height, even) for even in (False, True))
    regions = whole.unionByName(odd).withColumnRenamed("path_id", "clip_id")
    hit = clip(hit, regions, keyed.select("path_id", "clip_id").distinct(), "path_id")
    painted = hit.select(F.struct("path_id.doc_id", "path_id.page").alias("page"), "path_id.seq", "row", "col", "r", "g", "b", "alpha", "mode")
    return fold_marks(painted).select("page.doc_id", "page.page", "row", "col", "r", "g", "b")


def stroke_wide(segments: DataFrame, width: int, height: int, path: str = "path_id") -> DataFrame:
    """As ``stroke``, with the half width of each segment in ``half``."""
    return _pixels(_stroke(segments, width, height, path, False), path)
