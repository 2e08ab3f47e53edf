"""Near-duplicate passages by compact windows.

The elements of a text are its 5-word shingles. Under a hash function, the
Cartesian tree over the elements' hashes groups all passages of ``PASSAGE`` words or more
by their minimum: each node is a compact window (l, c, r), and every passage inside
it that holds place c has the same min-hash. A text has few such windows, and two
passages agree in a min-hash exactly if their windows carry the same value. Only values
of two texts or more go on, with the shingles of their windows next to c.

All windows of a value under any function meet, and two of them that hold stretches of passage length
with Jaccard similarity ``SIMILAR`` or more link their texts. Of the windows that such pairs connect the first is tied to
each other one, so results are the same whichever way a group is compared: groups of ``BLOCK`` windows or fewer
at once, larger ones by their different stretches, which meet where they share a shingle that is rare in the
group (``large_groups``). Texts that are equal as a whole are one class from the start.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import drop_saved, release, save
from quire.llm.components import connected_components
from quire.llm.kernels import LOWER_TABLE, WHITE, Powers, RangeHash, mix, slices, spans, text_bytes

SHINGLE, PASSAGE, SIMILAR = 5, 50, 0.8
LEAST = PASSAGE - SHINGLE + 1
HASHES = 5
#: Shared shingles of two stretches of that similarity, and most parts that are compared with one another at once.
NEED, BLOCK = int(np.ceil(2 * LEAST * SIMILAR / (1 + SIMILAR) - 1e-9)), 1024
#: All pairs of groups of at most so many windows are judged together.
FEW = 8
_POWERS = Powers()
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * f + 1) & (2**64 - 1)) for f in range(HASHES)]


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, end to end, and the offsets of the texts. A shingle's place is that of its first word."""
    data, offsets = text_bytes(column)
    data = LOWER_TABLE[data]
    starts, ends, doc = spans(~WHITE[data], offsets)
    words = RangeHash(data, _POWERS)(starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    counts = np.bincount(doc, minlength=len(column))
    if len(words) < SHINGLE:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(column) + 1, dtype=np.int64)
    n = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for j in range(SHINGLE):
            total = total * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
    whole = doc[:n] == doc[SHINGLE - 1 :]
    return mix(total[whole]), np.concatenate(([0], np.cumsum(np.maximum(counts - SHINGLE + 1, 0))))


def _slide(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` over each ``width`` adjacent values, by doubling."""
    done = 1
    while 2 * done <= width:
        values, done = least(values[:-done], values[done:]), 2 * done
    return least(values[: len(values) - width + done], values[width - done :]) if done < width else values


def minima(values: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Places whose unsigned value is the minimum of some ``least`` adjacent places of their text."""
    n, sizes = len(values), np.diff(offsets)
    if n < least:
        return np.zeros(0, dtype=np.int64)
    low = _slide(values, least, np.minimum)
    across = np.zeros(n + 1, dtype=np.int64)  # starts of stretches that a text's end cuts
    np.add.at(across, np.maximum(offsets[:-1], offsets[1:] - least + 1), 1)
    np.add.at(across, offsets[1:], -1)
    low[np.cumsum(across)[: len(low)] > 0] = 0
    edge = np.zeros(least - 1, dtype=low.dtype)
    return np.flatnonzero((values == _slide(np.concatenate([edge, low, edge]), least, np.maximum)) & np.repeat(sizes >= least, sizes))


def compact_windows(values: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every node of the Cartesian trees that spans ``least`` places or more; places count over all texts.

    The minima of such nodes alone are split level by level: those of all open stretches split them. Of equal minima in a stretch the first stands for all."""
    found: list[list[np.ndarray]] = [[], [], []]
    place = minima(values, offsets, least)
    doc = np.searchsorted(offsets, place, side="right") - 1
    new = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    ahead, behind = np.concatenate(([0], place[:-1] + 1)), np.concatenate((place[1:] - 1, [0]))
    heads = np.concatenate(([0], new)) if len(place) else new
    lasts = np.concatenate((new, [len(place)])) - 1 if len(place) else new
    ahead[heads], behind[lasts] = offsets[doc[heads]], offsets[doc[lasts] + 1] - 1
    low, sizes, own = values[place], lasts - heads + 1, np.arange(len(place))
    while len(heads):
        v = low[own]
        cut = v == np.repeat(np.minimum.reduceat(v, heads), sizes)
        at = np.flatnonzero(cut)
        first = at[np.searchsorted(at, heads)]
        found[0].append(ahead[own[heads]]), found[1].append(place[own[first]]), found[2].append(behind[own[heads + sizes - 1]])
        group = np.cumsum(cut) + np.repeat(np.arange(len(heads)), sizes) * (len(v) + 1)
        own, group = own[~cut], group[~cut]
        if not len(own):
            break
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(heads, len(own)))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *f]) for f in found)


def repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their values, their ranks in it times the number of places plus the place, and the next place of the same value."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    rank, after = np.empty(n, dtype=np.int64), np.full(n, n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ~same)))[:n]
    after[order[:-1][same]] = order[1:][same]
    return order, rank * n + np.arange(n), after


def tied(order: np.ndarray, keys: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows again, one for each place that holds the window's minimum: a passage has its value at its own place.

    Of a run of adjacent such places both ends stay and every place a passage length on, so no passage is left without one."""
    low = np.searchsorted(keys[order], keys[c])
    many = np.searchsorted(keys[order], keys[c] - c + r, side="right") - low
    own = np.repeat(np.arange(len(c)), many)
    at = order[np.arange(len(own)) - np.repeat(np.cumsum(many) - many - low, many)]
    joins = np.zeros(len(own) + 1, dtype=bool)  # whether a place follows the one before it
    joins[1:-1] = (own[1:] == own[:-1]) & (at[1:] == at[:-1] + 1)
    head = np.maximum.accumulate(np.where(joins[:-1], 0, np.arange(len(own))))
    keep = ~joins[:-1] | ~joins[1:] | ((np.arange(len(own)) - head) % (LEAST - 1) == 0)
    return l[own[keep]], at[keep], r[own[keep]]


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Value (its last bits name the function) and spot of each window: c, and how many places before and after it are within a passage."""
    for b in slices(batches, "text", 2 << 20):
        values, offsets = shingles(b.column("text"))
        uid = b.column("uid").to_numpy(zero_copy_only=False)
        order, keys, after = repeats(values)
        within = RangeHash(values, _POWERS)
        for f, seed in enumerate(_SEEDS):
            h = mix(values ^ seed)
            l, c, r = compact_windows(h, offsets)
            more = after[c] <= r
            if more.any():
                x, y, z = tied(order, keys, l[more], c[more], r[more])
                x, z = np.maximum(x, y - LEAST + 1), np.minimum(z, y + LEAST - 1)
                doc = np.searchsorted(offsets, y, side="right") - 1
                once = np.unique(mix(within(x, z + 1) ^ mix((doc * LEAST + y - x).view(np.uint64))), return_index=True)[1]
                l, c, r = (np.concatenate([u[~more], v[once]]) for u, v in ((l, x), (c, y), (r, z)))
            doc = np.searchsorted(offsets, c, side="right") - 1
            spot = (c - offsets[doc]) << 16 | np.minimum(c - l, LEAST - 1) << 8 | np.minimum(r - c, LEAST - 1)
            cols = [(h[c] & ~np.uint64(7) | np.uint64(f)).view(np.int64), uid[doc], spot]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["value", "uid", "spot"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each wanted window: all passages that its place stands for lie in it."""
    for b in slices(batches, "text", 1 << 20):
        values, offsets = shingles(b.column("text"))
        wanted = b.column("wanted")
        many = np.diff(wanted.offsets.to_numpy())
        flat = wanted.flatten()
        spot = flat.field("spot").to_numpy()
        c, before, after = spot >> 16, spot >> 8 & 255, spot & 255
        size = before + after + 1
        ends = np.cumsum(size)
        place = np.repeat(np.repeat(offsets[:-1], many) + c - before - ends + size, size) + np.arange(int(size.sum()))
        packed = np.ascontiguousarray(values[place].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
        parts = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], 3 * ends)).astype(np.int32)), pa.py_buffer(packed)])
        uid = np.repeat(b.column("uid").to_numpy(zero_copy_only=False), many)
        yield pa.RecordBatch.from_arrays([flat.field("value"), pa.array(uid), pa.array(c), pa.array(before), parts], names=["value", "uid", "c", "before", "part"])


def unpacked(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets) of parts, which travel as three bytes a shingle."""
    raw, offsets = text_bytes(parts)
    wide = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
    wide[:, :3] = raw.reshape(-1, 3)
    return wide.view("<i4").reshape(-1), offsets // 3


def _shingle_keys(value: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One number for a value and a shingle of its windows."""
    return mix(value.view(np.uint64) ^ mix(data.astype(np.uint64))).view(np.int64)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each part, and how many of them it has to share at least: four fifths of any stretch's."""
    for b in batches:
        data, at = unpacked(b.column("part"))
        own = np.repeat(np.arange(b.num_rows), np.diff(at))
        once = np.unique(own << 24 | data, return_index=True)[1]
        key = _shingle_keys(b.column("value").to_numpy()[own[once]], data[once])
        again = np.diff(at) - np.bincount(own[once], minlength=b.num_rows)
        need = -(-4 * np.maximum(LEAST - again, 1) // 5)
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column("w").take(pa.array(own[once])), pa.array(need[own[once]].astype(np.int32))], names=["key", "w", "need"])


def undominated(alone: np.ndarray, first: np.ndarray, many: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which stretches can be the most similar of their part to one of another part.

    ``alone``: whether a place has a shingle that stands nowhere else. A stretch that begins or ends with one shares no less with
    any other after a step away from it, and has no more kinds; of stretches that would yield to each other the later one stays."""
    stays = ~(alone[start] & (first + 1 < many))
    back = np.zeros(len(start), dtype=bool)
    back[1:] = stays[1:] & stays[:-1] & (first[1:] > 0) & alone[start[1:] + LEAST - 1]
    upto = np.concatenate(([0], np.cumsum(alone)))
    return stays & ~back & (upto[start + LEAST] - upto[start] <= LEAST - -(-4 * LEAST // 5))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Undominated stretches of passage length of each part, with the rarest of their shingles that other parts have too.

    Of d and e <= d kinds of shingles, similar stretches share 8/9 of e and 4/5 of d or more. So in any one order of shingles they share
    one that is among the first e - ceil(8e/9) + 1 of the one (``low`` of them are listed) and the first d - ceil(4d/5) + 1 of the other.
    Stretches of the same shingles have the same key, whatever the shingles' order; a part has each key once."""
    for batch in batches:
        for b in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
            data, at = unpacked(b.column("part"))
            size, value = np.diff(at), b.column("value").to_numpy()
            own = np.repeat(np.arange(b.num_rows), size)
            key = _shingle_keys(value[own], data)
            flat = b.column("known").flatten()
            names, order = np.unique(flat.field("key").to_numpy(), return_index=True)
            spot = np.minimum(np.searchsorted(names, key), len(names) - 1)
            held = np.where(names[spot] == key, flat.field("n").to_numpy()[order][spot], 1)
            _, cell, times = np.unique(own << 24 | data, return_inverse=True, return_counts=True)
            many = np.maximum(size - LEAST + 1, 0)
            part = np.repeat(np.arange(b.num_rows), many)
            first = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
            start = at[part] + first
            keep = undominated((held == 1) & (times[cell] == 1), first, many[part], start)
            part, start = part[keep], start[keep]
            order = np.lexsort((key, held))
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            rank = np.empty(len(key), dtype=np.int64)
            rank[order] = np.cumsum(new) - 1
            grid = np.sort(rank[start[:, None] + np.arange(LEAST)], axis=1)
            kind = np.ones(grid.shape, dtype=bool)
            kind[:, 1:] = grid[:, 1:] != grid[:, :-1]
            d, place = kind.sum(axis=1), np.cumsum(kind, axis=1) - 1
            listed = kind & (place < (d - -(-4 * d // 5) + 1)[:, None]) & (held[order][new][grid] > 1)
            low = (listed & (place < (d - -(-8 * d // 9) + 1)[:, None])).sum(axis=1)
            counts = listed.sum(axis=1)
            text = mix((mix(key[order][new].view(np.uint64))[grid] * kind).sum(axis=1, dtype=np.uint64))
            some = np.flatnonzero(counts)
            some = np.sort(some[np.unique(mix(text[some] ^ mix(part[some].view(np.uint64))), return_index=True)[1]])
            listed = listed[some]
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts[some]))).astype(np.int32)), pa.array(key[order][new][grid[some][listed]]))
            w = b.column("w").take(pa.array(part[some]))
            yield pa.RecordBatch.from_arrays([pa.array(text[some].view(np.int64)), w, pa.array(d[some]), pa.array(low[some]), rare], names=["key", "w", "d", "low", "rare"])


def similar(a: np.ndarray, b: np.ndarray, least: int = LEAST, bound: float = SIMILAR) -> bool:
    """Whether some stretch of ``least`` shingles of ``a`` and one of ``b`` have that Jaccard similarity: every stretch
    of one is held against every one of the other."""
    if len(a) < least or len(b) < least:
        return False
    kinds, column = np.unique(np.concatenate([a, b]), return_inverse=True)
    held = []
    for part in (column[: len(a)], column[len(a) :]):
        upto = np.zeros((len(part) + 1, len(kinds)), dtype=np.float32)
        upto[np.arange(1, len(part) + 1), part] = 1
        upto = np.cumsum(upto, axis=0)
        held.append((upto[least:] > upto[:-least]).astype(np.float32))
    both = held[0] @ held[1].T
    return bool((both >= bound * (held[0].sum(axis=1)[:, None] + held[1].sum(axis=1)[None, :] - both) - 1e-6).any())


def equal_around(a: np.ndarray, at_a: int, b: np.ndarray, at_b: int) -> bool:
    """Whether the parts hold an equal stretch of passage length with their places at the same place of it."""
    k, m = min(at_a, at_b), min(len(a) - at_a, len(b) - at_b)
    differ = np.flatnonzero(a[at_a - k : at_a + m] != b[at_b - k : at_b + m])
    j = int(np.searchsorted(differ, k))
    return (differ[j] if j < len(differ) else k + m) - (differ[j - 1] + 1 if j else 0) >= LEAST


def boxed(a: np.ndarray, b: np.ndarray, least: int = LEAST, need: int = NEED) -> bool:
    """``similar`` for parts without repeated shingles: some stretch of one and some of the other have ``need`` shingles in common."""
    order = np.argsort(b)
    spot = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    at = np.where(b[order[spot]] == a, order[spot], -1)  # the place in b of each shingle of a
    upto = np.concatenate(([0], np.cumsum(at >= 0)))
    for s in np.flatnonzero(upto[least:] - upto[:-least] >= need):
        held = np.sort(at[s : s + least])
        held = held[held >= 0]
        if (held[need - 1 :] - held[: len(held) - need + 1] < least).any():
            return True
    return False


def group_links(parts: list[np.ndarray], at: list[int], side: np.ndarray, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified pairs that connect all parts of a group that verified pairs connect; each against all of another block if ``side`` has two.
    ``group``: the same number for parts that are known to be connected."""
    n = len(parts)
    group = np.arange(n) if group is None else group.copy()
    sizes = np.array([len(x) for x in parts])
    column = np.unique(np.concatenate(parts), return_inverse=True)[1]
    wide = int(column.max()) + 1
    cell = np.unique(np.repeat(np.arange(n), sizes) * wide + column)
    kinds = np.bincount(cell // wide, minlength=n)
    shared = np.bincount(cell % wide, minlength=wide) > 1
    many = int(shared.sum())
    new = np.where(shared, np.cumsum(shared) - 1, many)  # shingles of one part only are all the last column, which nobody holds
    held = np.zeros((n, many + 1), dtype=bool)
    held[cell // wide, new[cell % wide]] = True
    held[:, many] = False
    both = np.zeros((n, n), dtype=np.float32)
    for k in range(0, many, 4096):
        grid = held[:, k : min(many, k + 4096)].astype(np.float32)
        both += grid @ grid.T
    plain = kinds == sizes
    first = [_first_places(x, once) for x, once in zip(parts, plain)]
    # stretches with d and e kinds of shingles have i >= SIMILAR * (d + e - i) of them in common; e is at least the other part's least
    each = [np.full(f.shape[1], LEAST, dtype=np.float32) if once else f.sum(axis=0) for f, once in zip(first, plain)]
    least = np.array([d.min() if len(d) else 2 * LEAST for d in each])
    bound = SIMILAR / (1 + SIMILAR)
    fits = both >= bound * (least[:, None] + least[None, :]) - 1e-3
    fits &= group[:, None] != group[None, :]
    if side.any() and not side.all():
        fits &= side[:, None] != side[None, :]
    # of two parts, some stretch of each has to hold as many kinds that the other has anywhere
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(fits.any(axis=1)):
        others = np.flatnonzero(fits[i])
        within = held[others][:, new[column[ends[i] - sizes[i] : ends[i]]]].astype(np.float32)
        fits[i, others] = (within @ first[i] >= np.maximum(SIMILAR * each[i], bound * (each[i] + least[others, None])) - 1e-3).any(axis=1)
    fits &= fits.T
    found = []
    for i, j in zip(*np.nonzero(np.triu(fits, 1))):
        if group[i] == group[j]:
            continue
        if equal_around(parts[i], at[i], parts[j], at[j]) or (boxed if plain[i] and plain[j] else similar)(parts[i], parts[j]):
            found.append((int(i), int(j)))
            group[group == group[j]] = group[i]
    return found


@lru_cache(4 * LEAST)
def _places(n: int) -> np.ndarray:
    """(places, stretches): whether a place lies in the stretch of passage length."""
    place, start = np.arange(n)[:, None], np.arange(max(0, n - LEAST + 1))[None, :]
    return ((place >= start) & (place < start + LEAST)).astype(np.float32)


def _first_places(part: np.ndarray, plain: bool) -> np.ndarray:
    """(places, stretches): whether a place has the first of its shingle in the stretch of passage length."""
    n = len(part)
    if plain:
        return _places(n)
    order = np.argsort(part, kind="stable")
    before = np.full(n, -1)
    same = part[order][1:] == part[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    return _places(n) * (before[:, None] < np.arange(max(0, n - LEAST + 1))[None, :])


def equal_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``equal_around`` of parts p and q, pair by pair; the parts lie in ``data``, their places at ``at`` in them."""
    if not len(p):
        return np.zeros(0, dtype=bool)
    k = np.minimum(at[p], at[q])
    size = k + np.minimum(ends[p] - starts[p] - at[p], ends[q] - starts[q] - at[q])
    head = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(head, size)
    differ = data[np.repeat(starts[p] + at[p] - k, size) + place] != data[np.repeat(starts[q] + at[q] - k, size) + place]
    left = place < np.repeat(k, size)
    before = np.maximum.reduceat(np.where(differ & left, place + 1, 0), head)
    behind = np.minimum.reduceat(np.where(differ & ~left, place, np.repeat(size, size)), head)
    return behind - before >= LEAST


def near_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``boxed`` of parts p and q, pair by pair, as 0 or 1; 2 where that has to be asked: the parts repeat shingles, or share them in another order.

    Where shared shingles have one order in both, those in a stretch of each follow one another."""
    n = len(p)
    out = np.zeros(n, dtype=np.int8)
    if not n:
        return out
    rows = np.concatenate([p, q])
    size = (ends - starts)[rows]
    own = np.repeat(np.arange(2 * n), size)
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    key = (own % n).astype(np.uint64) << np.uint64(33) | data[place + starts[rows][own]].view(np.uint32).astype(np.uint64) << np.uint64(1) | (own >= n).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] >> np.uint64(1) == key[:-1] >> np.uint64(1))
    pair = (key[same] >> np.uint64(33)).astype(np.int64)
    x, y = place[order[same]], place[order[same + 1]]
    o = np.argsort(pair << 8 | x, kind="stable")  # a part has fewer than 256 places
    pair, x, y = pair[o], x[o], y[o]
    k = NEED - 1
    if len(pair) > k:
        fits = (pair[k:] == pair[:-k]) & (x[k:] - x[:-k] < LEAST) & (y[k:] - y[:-k] < LEAST)
        out[pair[:-k][fits]] = 1
    enough = np.bincount(pair, minlength=n) >= NEED
    turns = np.zeros(n, dtype=bool)
    turns[pair[1:][(pair[1:] == pair[:-1]) & (y[1:] < y[:-1])]] = True
    out[enough & turns] = 2
    out[(key[1:][key[1:] == key[:-1]] >> np.uint64(33)).astype(np.int64)] = 2  # a part has a shingle twice
    return out


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` reaches through links."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compare(batches: Iterator[pa.RecordBatch], rooted: bool = False) -> Iterator[pa.RecordBatch]:
    """Of the parts of a group that verified pairs connect the first, with each other one; the rows of a group follow one another, those of its last group wait for the next batch.

    ``rooted``: rows of the same c are known to be connected; the pairs that connect others are given.
    Nearly all groups are settled for a whole batch at once: neighbours hold an equal passage, and pairs of small groups are judged by
    the order of what they share."""
    names = ["value", "i", "j", "uid", "c", "side", "before"]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        value, i, j, uid, c, side, at = (rows.column(k).to_numpy() for k in names)
        part = rows.column("part").combine_chunks()
        data, bounds = unpacked(part.chunk(0) if isinstance(part, pa.ChunkedArray) else part)
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        order = np.lexsort((c, uid, np.cumsum(new)))
        uid, c, side, at, starts, ends = uid[order], c[order], side[order], at[order], bounds[:-1][order], bounds[1:][order]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(uid)))
        two = np.add.reduceat(side, head) % np.maximum(size, 1) != 0  # parts of two blocks meet
        group = np.repeat(np.arange(len(head)), size)
        # neighbours by text, and by the half passage behind and ahead of the place: an equal passage holds one of them
        hashes, half = RangeHash(data.view(np.uint32), _POWERS), LEAST // 2
        p, q = [np.arange(len(uid) - 1)], [np.arange(1, len(uid))]
        for lo, hi in ((starts + at, starts + at + half), (starts + at - half + 1, starts + at + 1)):
            fits = np.flatnonzero((lo >= starts) & (hi <= ends))
            key = hashes(lo[fits], hi[fits])
            fits = fits[o := np.lexsort((key, group[fits]))]
            same = key[o][1:] == key[o][:-1]
            p.append(fits[:-1][same]), q.append(fits[1:][same])
        p, q = np.concatenate(p), np.concatenate(q)
        p, q = (x[(group[p] == group[q]) & ~two[group[p]]] for x in (p, q))
        once = np.unique(np.minimum(p, q) * len(uid) + np.maximum(p, q))
        p, q = once // len(uid), once % len(uid)
        equal = equal_pairs(data, starts, ends, at, p, q)
        links = [np.stack([p[equal], q[equal]])]
        if rooted:
            o = np.lexsort((c, group))
            same = (group[o][1:] == group[o][:-1]) & (c[o][1:] == c[o][:-1])
            known = connected(len(uid), np.concatenate([p[equal], o[:-1][same]]), np.concatenate([q[equal], o[1:][same]]))
        else:
            known = connected(len(uid), p[equal], q[equal])
        open_ = np.flatnonzero((size > 1) & (two | (np.maximum.reduceat(known, head) > head)))
        few = open_[(size[open_] <= FEW) & ~two[open_]]
        # all pairs of small groups that are not known to be connected, some thousands at once
        x, y = np.triu_indices(FEW, 1)
        x, y, g = (v.ravel() for v in np.broadcast_arrays(head[few][:, None] + x, head[few][:, None] + y, few[:, None]))
        inside = y < head[g] + size[g]
        x, y, g = x[inside], y[inside], g[inside]
        x, y, g = (v[known[x] != known[y]] for v in (x, y, g))
        verdict = np.concatenate([np.zeros(0, dtype=np.int8), *(near_pairs(data, starts, ends, x[k : k + 4000], y[k : k + 4000]) for k in range(0, len(x), 4000))])
        links.append(np.stack([x[verdict == 1], y[verdict == 1]]))
        for g in np.concatenate([np.setdiff1d(open_, few), np.unique(g[verdict == 2])]):
            r = np.arange(head[g], head[g] + size[g])
            found = group_links([data[starts[k] : ends[k]] for k in r], at[r].tolist(), side[r], known[r] - head[g])
            links.append(np.array(found, dtype=np.int64).reshape(-1, 2).T + head[g])
        a, b = np.concatenate(links, axis=1)
        if not rooted:  # rows are in the order of uid and c
            a, b = connected(len(uid), a, b), np.arange(len(uid))
        a, b = (x[uid[a] != uid[b]] for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (uid[a], uid[b], c[a], c[b])], names=["a", "b", "ca", "cb"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        key = [rows.column(k).to_numpy() for k in names[:3]]
        other = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield settle(rows.slice(0, cut).combine_chunks())
        held = rows.slice(cut).combine_chunks()
    if held is not None:
        yield settle(held)


def large_groups(large: DataFrame, n: int) -> DataFrame:
    """(node, root): parts of a value that similar stretches connect, for values of any number of parts; w names a part.

    Equal parts and stretches connect their holders to the first of them, which then stands for all with that stretch. Different ones meet where
    they share a shingle that is rare in both; groups of the same parts meet once, those that are connected already don't."""
    # equal parts: the first stands for all
    marks = large.select("w", "value", F.xxhash64("part").alias("h"))
    firsts = marks.groupBy("value", "h").agg(F.min("w").alias("a"), F.max("w").alias("z")).where("a <> z").select("value", "h", "a")
    twins = save(marks.join(firsts, ["value", "h"]).where("w <> a").select("a", F.col("w").alias("b")), "equal-parts")
    large = save(large.join(twins.select(F.col("b").alias("w")), "w", "left_anti"), "different-parts")
    # counts beside the rows: a row is dealt and sorted once, and never leaves the JVM
    kinds = large.select("value", "w", "part").mapInArrow(_kinds, "key long, w long, need int")
    shared = kinds.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").groupBy("w")
    # parts that share fewer shingles than any stretch of theirs needs go no further
    known = shared.agg(F.collect_list(F.struct("key", "n")).alias("known"), F.max("need").alias("need")).where(F.size("known") >= F.col("need")).select("w", "known")
    stretches = save(large.join(known, "w").select("w", "value", "part", "known").mapInArrow(_stretches, "key long, w long, d long, low long, rare array<long>"), "stretches")
    release(large.sparkSession)
    held = save(stretches.groupBy("key").agg(F.min("w").alias("first"), F.max("w").alias("top"), F.any_value(F.struct("d", "low", "rare")).alias("x")), "different-stretches")
    edges = save(stretches.select("key", "w").join(held.where("first <> top").select("key", "first"), "key").where("w <> first").select(F.col("first").alias("a"), F.col("w").alias("b")).distinct().unionByName(twins), "equal-stretches")
    drop_saved(stretches)
    # e: the least number of kinds for which the shingle is among the fewer, d: the largest
    listed = held.select(F.col("first").alias("w"), "x.d", "x.low", F.posexplode("x.rare").alias("k", "key")).groupBy("key", "w").agg(F.min(F.when(F.col("k") < F.col("low"), F.col("d"))).alias("e"), F.max("d").alias("d"))
    least = listed.groupBy("key").agg(F.min("e").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1 and least is not null").select("key", "least")
    meets = save(listed.join(least, "key").where("e is not null or d > least").select("key", "w"), "rare-shingles")

    def open_(rows: DataFrame, roots: DataFrame) -> DataFrame:
        tagged = rows.select("key", "w").join(roots.withColumnRenamed("node", "w"), "w", "left").withColumn("root", F.coalesce("root", "w"))
        marks = [F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("w").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "w")).alias("t"), F.min("root").alias("x"), F.max("root").alias("y")]
        once = tagged.groupBy("key").agg(*marks).where("x <> y").groupBy("m", "s", "t").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
        return save(tagged.join(once, "key").withColumn("k", F.pmod(F.xxhash64("w"), F.col("nb")).cast("int")), "open-groups")

    def compared(rows: DataFrame) -> DataFrame:
        groups = rows.join(large.select("w", "before", "part"), "w").select(F.col("key").alias("value"), "i", "j", F.col("w").alias("uid"), F.col("root").alias("c"), "side", "before", "part")
        dealt = groups.repartition(n, "value", "i", "j").sortWithinPartitions("value", "i", "j")
        return save(dealt.mapInArrow(partial(_compare, rooted=True), "a long, b long, ca long, cb long").select("a", "b").distinct(), "near-stretches")

    zero = F.lit(0)
    roots = save(connected_components(edges), "roots")
    left = open_(meets, roots)
    edges = edges.unionByName(compared(left.select("key", "w", "root", F.col("k").alias("i"), F.col("k").alias("j"), zero.alias("side"))))
    roots = save(connected_components(edges), "roots")
    # groups of several blocks that are not connected by now: each block meets each other
    left = open_(left.where("nb > 1"), roots)
    if left.isEmpty():
        return roots
    pairs = left.withColumn("o", F.explode(F.sequence(zero, F.col("nb") - 1))).where("k <> o")
    edges = edges.unionByName(compared(pairs.select("key", "w", "root", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).cast("int").alias("side"))))
    return connected_components(edges)


def passage_links(texts: DataFrame, table: str) -> DataFrame:
    """(a, b, n): pairs of different texts that share ``n`` verified places of an equal or near-duplicate passage.

    Of the places of a value that similar stretches connect, the first (by uid and place) is paired with each other one, whatever the group's size."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    windows = texts.select("uid", "text").mapInArrow(_window_rows, "value long, uid long, spot long")
    alike = Window.partitionBy("value")
    counted = windows.withColumns({"x": F.min("uid").over(alike), "y": F.max("uid").over(alike), "m": F.count(F.lit(1)).over(alike)})
    met = save(counted.where("x <> y").select("value", "uid", "spot", (F.col("m") > BLOCK).alias("hot")), "meetings")
    release(spark)

    def parts(spots: DataFrame) -> DataFrame:
        asked = spots.groupBy("uid").agg(F.collect_list(F.struct("value", "spot")).alias("wanted"))
        return spark.table(table).join(asked, "uid").select("uid", "text", "wanted").mapInArrow(_parts, "value long, uid long, c long, before long, part binary")

    zero = F.lit(0)
    groups = parts(met.where("not hot")).select("value", zero.alias("i"), zero.alias("j"), "uid", "c", zero.alias("side"), "before", "part")
    links = save(groups.repartition(n, "value").sortWithinPartitions("value").mapInArrow(_compare, "a long, b long, ca long, cb long"), "pairs")
    release(spark)
    if not met.where("hot").isEmpty():
        large = save(parts(met.where("hot")).withColumn("w", F.monotonically_increasing_id()), "large-parts")
        placed = large.select(F.col("w").alias("node"), "uid", "c").join(large_groups(large, n), "node")
        firsts = placed.groupBy("root").agg(F.min(F.struct("uid", "c")).alias("x"))
        links = links.unionByName(placed.join(firsts, "root").where("x.uid <> uid").select(F.col("x.uid").alias("a"), F.col("uid").alias("b"), F.col("x.c").alias("ca"), F.col("c").alias("cb")))
    # one place for each shift between the two texts and each passage length of the first
    both = links.groupBy("a", "b", (F.col("ca") - F.col("cb")).alias("shift"), F.floor(F.col("ca") / (2 * LEAST)).alias("place")).agg(F.lit(1))
    return save(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "passage-links")


def near_duplicate_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id, n_links, n_passages, is_copy) for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that the row reaches through equal texts and through
    near-duplicate passages; ``n_links`` counts ties between its text and other texts (in each group of connected places the first is tied to the others), ``n_passages`` their places. Texts without ``PASSAGE`` words link only to equal texts; null and empty
    texts to none. A null ``doc_id`` never names a component unless all are null. Repeated rows are copies. Empty tables
    give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text.alias("text"))
    long_ = F.octet_length("text") >= 2 * PASSAGE - 1
    slim = save(rows.select("uid", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), (F.octet_length("text") > 0).alias("filled")), "documents")
    classes = save(slim.where("filled").groupBy("h1", "h2").agg(F.min("uid").alias("first"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "text-classes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"passages_{uuid.uuid4().hex}"
    kept = rows.where(long_).select("uid", "text").repartition(n, "uid").join(classes.select(F.col("first").alias("uid")).repartition(n, "uid"), "uid", "left_semi")
    kept.write.format("parquet").option("compression", "zstd").bucketBy(n, "uid").sortBy("uid").saveAsTable(name)
    release(spark)
    links = passage_links(spark.table(name), name)
    spark.sql(f"DROP TABLE {name}")
    roots = connected_components(links.select("a", "b")).withColumnRenamed("node", "first")
    degree = links.select(F.col("a").alias("first"), "n").unionByName(links.select(F.col("b").alias("first"), "n")).groupBy("first").agg(F.count(F.lit(1)).alias("n_links"), F.sum("n").alias("n_passages"))
    named = save(classes.join(roots, "first", "left").withColumn("root", F.coalesce("root", "first")), "rooted-classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = save(named.join(least, "root").join(degree, "first", "left").select("h1", "h2", "first", "component_id", "n_links", "n_passages"), "passage-classes")
    found = slim.where("filled").join(known, ["h1", "h2"]).select("doc_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"), (F.col("uid") != F.col("first")).alias("is_copy"))
    alone = slim.where("not filled").select("doc_id", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_passages"), F.lit(False).alias("is_copy"))
    return found.unionByName(alone)
