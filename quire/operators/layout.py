"""Text layout and reading order as windows; greedy steps run per page."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}
#: Bullets that stand alone, and those that need a space behind them.
BULLETS, SPACED = "•◦▪‣·", "-*–o"


def lines(glyphs: DataFrame, page: str = "doc_id", seq: str = "pos") -> DataFrame:
    """Adds ``ln``: a glyph opens a line when its baseline leaves the previous glyph's by over half that glyph's height."""
    w = Window.partitionBy(page).orderBy(F.desc("y"), "x", seq)
    jump = F.when(F.abs(F.col("y") - F.lag("y").over(w)) <= 0.5 * F.lag("h").over(w), 0).otherwise(1)
    return glyphs.withColumn("_new", jump).withColumn("ln", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def page_text(glyphs: DataFrame, page: str = "doc_id", seq: str = "pos") -> DataFrame:
    """(page, txt): lines from left to right, a space in each gap of over a quarter of the previous height, CRLF behind each line."""
    w = Window.partitionBy(page, "ln").orderBy("x", F.desc("y"), seq)
    gap = (F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > 0.25 * F.lag("h").over(w)) & ~F.lag(F.endswith("tok", F.lit(" "))).over(w)
    spaced = lines(glyphs, page, seq).withColumn("_part", F.concat(F.when(gap, F.lit(" ")).otherwise(F.lit("")), "tok"))
    order = F.struct("x", (-F.col("y")).alias("ny"), seq, "_part")
    each = spaced.groupBy(page, "ln").agg(F.rtrim(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["_part"]), "")).alias("t")).where("t <> ''")
    whole = F.sort_array(F.collect_list(F.struct("ln", "t")))
    return each.groupBy(page).agg(F.concat(F.array_join(F.transform(whole, lambda s: s["t"]), "\r\n"), F.lit("\r\n")).alias("txt"))


def text_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, seq: np.ndarray, tok: list[str]) -> str:
    """The text of one page in memory, as of ``page_text``; empty if no line has any."""
    n = len(tok)
    if not n:
        return ""
    order = np.lexsort((seq, x, -y))
    jump = np.ones(n, dtype=bool)
    jump[1:] = ~(np.abs(y[order][1:] - y[order][:-1]) <= 0.5 * h[order][:-1])
    ln = np.empty(n, dtype=np.int64)
    ln[order] = np.cumsum(jump)
    order = np.lexsort((seq, -y, x, ln))
    xs, ends, hs, lines_ = x[order], (x + w)[order], h[order], ln[order]
    parts = [tok[i] for i in order.tolist()]
    same = lines_[1:] == lines_[:-1]
    for i in (np.flatnonzero(same & (xs[1:] - ends[:-1] > 0.25 * hs[:-1])) + 1).tolist()[::-1]:
        if not parts[i - 1].endswith(" "):  # from the end on, so that the part ahead is still bare
            parts[i] = " " + parts[i]
    cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), n]
    whole = (t for a, b in zip(cuts, cuts[1:]) if (t := "".join(parts[a:b]).rstrip(" ")))
    return "".join(t + "\r\n" for t in whole)


def body_size(runs: DataFrame, doc: str = "doc_id", size: str = "h", text: str = "tok") -> DataFrame:
    """(doc, body): the font size with most characters, the larger of equals."""
    n = runs.groupBy(doc, size).agg(F.sum(F.char_length(text)).alias("n"))
    return n.groupBy(doc).agg(F.max_by(size, F.struct("n", size)).alias("body"))


def heading_levels(runs: DataFrame, doc: str = "doc_id", size: str = "h", text: str = "tok") -> DataFrame:
    """(doc, size, level): sizes of at least 1.2 times the body's, the largest is level 1, none is beyond 6."""
    big = runs.select(doc, size).distinct().join(body_size(runs, doc, size, text), doc).where(F.col(size) >= 1.2 * F.col("body"))
    return big.select(doc, size, F.least(F.lit(6), F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc(size)))).alias("level"))


def furniture(blocks: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", top: str = "top") -> DataFrame:
    """(doc, text, band): short texts that stand at the same height on two pages or more."""
    trimmed = F.trim(F.col(text))
    band = F.floor(F.col(top) / 2 + 0.5).alias("band")
    return blocks.where(F.char_length(trimmed).between(1, 64)).groupBy(doc, trimmed.alias(text), band).agg(F.countDistinct(page).alias("pages")).where("pages >= 2").drop("pages")


def flow(blocks: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", top: str = "top") -> DataFrame:
    """Blocks that are not page furniture."""
    keyed = blocks.withColumns({"_t": F.trim(F.col(text)), "_b": F.floor(F.col(top) / 2 + 0.5)})
    gone = furniture(blocks, doc, page, text, top).withColumnsRenamed({text: "_t", "band": "_b"})
    return keyed.join(gone, [doc, "_t", "_b"], "left_anti").drop("_t", "_b")


def bullet(line: Column) -> Column:
    return line.rlike(f"^\\s*([{BULLETS}]|[{re.escape(SPACED)}] )")


def numbered(line: Column) -> Column:
    return line.rlike(r"^\s*[0-9]{1,3}[.)]( |$)")


def is_list(rows: DataFrame, block: list[str], line: str = "line") -> DataFrame:
    """(block, is_list): every line of the block begins with a bullet or a number."""
    return rows.groupBy(*block).agg(F.bool_and(bullet(F.col(line)) | numbered(F.col(line))).alias("is_list"))


def expand_ligatures(text: Column) -> Column:
    for one, many in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(many))
    return text


def runs(events: DataFrame, keep: Column, key: list[str], seq: str = "seq") -> DataFrame:
    """(key, first, last, n): maximal runs of consecutive events of which ``keep`` holds."""
    w = Window.partitionBy(*key).orderBy(seq)
    numbered_ = events.withColumn("_k", keep).withColumn("_n", F.row_number().over(w))
    island = numbered_.where("_k").withColumn("_g", F.col("_n") - F.row_number().over(w))
    return island.groupBy(*key, "_g").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def nesting(events: DataFrame, opens: Column, closes: Column, key: list[str], seq: str = "seq") -> DataFrame:
    """Adds ``depth`` after each event."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return events.withColumn("depth", F.sum(step).over(Window.partitionBy(*key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def mcid_numbers(spans: DataFrame, page: str = "page", first: str = "first", last: str = "last", seq: str = "seq") -> DataFrame:
    """Adds ``mcid``, counted on each page by first event, and ``overlap``: the span begins before the one ahead of it ended."""
    w = Window.partitionBy(page).orderBy(first, seq)
    return spans.withColumn("mcid", F.row_number().over(w) - 1).withColumn("overlap", F.coalesce(F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col(first), F.lit(False)))


# -- greedy steps, one page at a time -------------------------------------------------------------


#: In line heights: how far a baseline may leave a line's first one, the widest gap in a line, and between lines of a block.
BASELINE, COLUMN_GAP, BLOCK_GAP = 0.5, 3.0, 1.35


#: Blocks beyond which a line, or the next block to read, is compared with all of them at once.
MANY = 48


def order_runs(x: list[float], y: list[float], w: list[float], h: list[float]) -> tuple[list[int], list[int], list[int]]:
    """(line of each run, block of each line, place of each block) of one page of runs, which come sorted from top to bottom and left to right.

    Runs within half the height of a cluster's members from its first baseline form a cluster, which is cut from left to
    right where a gap is too wide. A line joins the nearest block that it overlaps and that is close enough to it, by the smaller
    of both heights. Of blocks side by side the left one reads first, else the upper one."""
    clusters: list[list[int]] = []
    base = tall = 0.0
    for i, at in enumerate(y):
        if clusters and abs(at - base) <= BASELINE * tall:
            clusters[-1].append(i)
            tall = max(tall, h[i])
        else:
            clusters.append([i])
            base, tall = at, h[i]
    lines: list[list[float]] = []  # left, right, top, bottom, height
    line_of = [0] * len(y)
    for members in clusters:
        now = None
        for i in sorted(members, key=x.__getitem__):
            if now is None or x[i] - now[1] > COLUMN_GAP * now[4]:
                now = [x[i], x[i] + w[i], y[i] + h[i], y[i], h[i]]
                lines.append(now)
            else:
                now[1], now[2], now[3], now[4] = max(now[1], x[i] + w[i]), max(now[2], y[i] + h[i]), min(now[3], y[i]), max(now[4], h[i])
            line_of[i] = len(lines) - 1
    blocks: list[list[float]] = []
    bounds = np.empty((5, 2 * MANY))
    block_of = [0] * len(lines)
    for n in sorted(range(len(lines)), key=lambda k: (-lines[k][2], lines[k][0])):
        left, right, top, bottom, high = lines[n]
        best, nearest = -1, 0.0
        if len(blocks) <= MANY:
            for k, (l_, r_, t_, b_, h_) in enumerate(blocks):
                if right <= l_ or left >= r_:
                    continue
                gap = b_ - top
                if gap < 0:
                    gap = bottom - t_
                if gap <= BLOCK_GAP * min(h_, high) and (best < 0 or gap < nearest):
                    best, nearest = k, gap
        else:
            l_, r_, t_, b_, h_ = bounds[:, : len(blocks)]
            gap = np.where(b_ - top < 0, bottom - t_, b_ - top)
            near = np.flatnonzero(~((right <= l_) | (left >= r_)) & (gap <= BLOCK_GAP * np.minimum(h_, high)))
            best = int(near[gap[near].argmin()]) if len(near) else -1
        if best < 0:
            best = len(blocks)
            blocks.append(list(lines[n]))
            if best == bounds.shape[1]:
                bounds = np.concatenate((bounds, np.empty_like(bounds)), axis=1)
        else:
            b = blocks[best]
            b[0], b[1], b[2], b[3], b[4] = min(b[0], left), max(b[1], right), max(b[2], top), min(b[3], bottom), max(b[4], high)
        bounds[:, best] = blocks[best]
        block_of[n] = best
    return line_of, block_of, _places(blocks) if len(blocks) <= MANY else _places_of_many(bounds[:, : len(blocks)])


def _before(a: list[float], b: list[float]) -> bool:
    if min(a[2], b[2]) > max(a[3], b[3]) and a[0] != b[0]:
        return a[0] < b[0]
    return (-a[2], a[0]) < (-b[2], b[0])


def _places(blocks: list[list[float]]) -> list[int]:
    left, order = list(range(len(blocks))), [0] * len(blocks)
    for n in range(len(blocks)):  # selection, as the comparison is not transitive
        best = left[0]
        for c in left[1:]:
            if _before(blocks[c], blocks[best]):
                best = c
        order[best] = n
        left.remove(best)
    return order


def _places_of_many(bounds: np.ndarray) -> list[int]:
    """As ``_places``: the next block that comes before the best one so far is found among all that are left at once."""
    ids, rest, order = np.arange(bounds.shape[1]), bounds[:4], [0] * bounds.shape[1]
    for n in range(len(order)):
        at = 0
        while True:
            left, _, top, bottom = rest[:, at + 1 :]
            l_, _, t_, b_ = rest[:, at]
            side = (np.minimum(top, t_) > np.maximum(bottom, b_)) & (left != l_)
            ahead = np.where(side, left < l_, (top > t_) | (top == t_) & (left < l_))
            step = int(ahead.argmax()) if len(ahead) else 0
            if not len(ahead) or not ahead[step]:
                break
            at += 1 + step
        order[int(ids[at])] = n
        ids, rest = np.delete(ids, at), np.delete(rest, at, axis=1)
    return order


def cluster_page(page: pd.DataFrame) -> pd.DataFrame:
    """Lines, blocks and their reading order of one page of runs, as of ``order_runs``.

    ``page``: doc_id, page, seq, x, y, w, h. Adds ``line``, ``block``, ``order``."""
    rows = page.sort_values(["y", "x", "seq"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    line_of, block_of, order = (np.array(v, dtype=np.int64) for v in order_runs(*(rows[c].to_numpy(dtype=float).tolist() for c in "xywh")))
    rows["line"] = line_of
    rows["block"] = block_of[line_of] if len(block_of) else line_of
    rows["order"] = order[rows["block"]] if len(order) else line_of
    return rows


def reading_order(runs_: DataFrame) -> DataFrame:
    schema = "doc_id long, page long, seq long, x double, y double, w double, h double, line long, block long, order long"
    return runs_.select("doc_id", "page", "seq", "x", "y", "w", "h").groupBy("doc_id", "page").applyInPandas(cluster_page, schema)


def table_rows(cells: DataFrame, key: list[str], tolerance: float = 4.0) -> DataFrame:
    """(key, is_table): two rows or more, all of two cells or more, whose columns start at the same places within ``tolerance``."""
    starts = cells.groupBy(*key, "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    prev = F.lag("xs").over(Window.partitionBy(*key).orderBy("row"))
    close = F.forall(F.arrays_zip(F.col("xs").alias("a"), prev.alias("b")), lambda z: F.abs(z["a"] - z["b"]) <= tolerance)
    ok = (F.size("xs") >= 2) & (prev.isNull() | (F.size("xs") == F.size(prev)) & close)
    return starts.withColumn("_ok", ok).groupBy(*key).agg(((F.count(F.lit(1)) >= 2) & F.bool_and("_ok")).alias("is_table"))
