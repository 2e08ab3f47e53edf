"""Secret scanning: patterns first, then a character network over everything else that could be a secret.

The base patterns (assignments, access ids, long hex) are found in whole texts and
always stay. Every other run of token characters that has eight or more of them and mixes
character classes is a candidate, also one that goes beyond a base finding. A one-dimensional
convolutional network reads the candidate and the characters around it and gives its probability of
being a secret.

Labelled findings for training come from two places: a generator of credentials in
public formats and of harmless look-alikes (dates, versions, paths, digests named as
such, counters, words), and all documents: base findings are secrets, candidates in texts without any
are harmless, each different window once. The network starts from the generated findings and goes on by gradients
over all findings of both places, summed where the windows lie. The threshold is calibrated on held-out labelled
findings: scores are Platt-scaled and the largest threshold that keeps recall at ``RECALL`` in
each of the two places is used, whatever false alarms it costs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_saved, save
from quire.llm.kernels import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_CAMEL = re.compile(r"[a-z][A-Z]")
_DIGITS, _SMALL, _LARGE, _SYMBOLS = (frozenset(x) for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_=-"))
KINDS = ("assign", "access", "hex", "net")

#: Characters of context on each side, and of the candidate itself (from both of its ends) that the network reads.
CONTEXT, BODY = 24, 40
WIDTH = 2 * CONTEXT + BODY
CHANNELS, EMBED, KERNEL = 24, 8, 5
#: Generated findings, steps over all findings and their rate, shards whose gradients are summed, and steps of a held-out score by which it is counted.
GENERATED, ROUNDS, RATE, SHARDS, GRID = 3000, 12, 0.005, 64, 256
RECALL = 0.95

#: What a network learns.
NAMES = ("embed", "conv", "bias", "out")

_CLASSES = 96  # 0: outside the text, 1-95: printable ASCII by code, others and controls as class 1


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) sorted by start, then kind. Each kind's matches are leftmost and do not overlap."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _mixes(token: str) -> bool:
    chars = frozenset(token)
    digit, small, large, symbol = (not chars.isdisjoint(x) for x in (_DIGITS, _SMALL, _LARGE, _SYMBOLS))
    return digit and (small or large) or small and large and (symbol or _CAMEL.search(token) is not None)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters that are not within a base finding and hold a digit and a letter, a capital
    right after a small letter, or both cases and a symbol."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        t = m[0]
        if t.islower() and t.isalpha() or not _mixes(t):
            continue
        while i < len(base) and base[i][0] <= m.start():  # the furthest end of what begins here or before
            reach, i = max(reach, base[i][1]), i + 1
        if reach < m.end():
            out.append((m.start(), m.end()))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """The window around a finding as classes: context, then the candidate's two ends, then context."""
    body = text[start:end]
    if len(body) > BODY:
        body = body[: BODY // 2] + body[-(BODY // 2) :]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    codes = np.zeros(WIDTH, dtype=np.uint8)
    for at, part in ((CONTEXT - len(left), left), (CONTEXT, body), (CONTEXT + BODY, right)):
        raw = np.frombuffer(part.encode("ascii", "replace"), dtype=np.uint8)
        codes[at : at + len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 31, 1)
    return codes


@dataclass
class Network:
    """Embedding, one convolution, the maximum and mean over places, a linear layer."""

    embed: np.ndarray
    conv: np.ndarray  # (KERNEL * EMBED, CHANNELS)
    bias: np.ndarray
    out: np.ndarray  # (2 * CHANNELS + 1,)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(_CLASSES, EMBED)) * 0.3, rng.normal(size=(KERNEL * EMBED, CHANNELS)) * (2 / (KERNEL * EMBED)) ** 0.5, np.zeros(CHANNELS), rng.normal(size=2 * CHANNELS + 1) * 0.1)

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]  # (n, WIDTH, EMBED)
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, KERNEL * EMBED)
        z = np.maximum(cols @ self.conv + self.bias, 0)
        body = slice(CONTEXT - 2, CONTEXT + BODY - 2)
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None, :], 1)[:, 0], z[:, body].mean(axis=1), np.ones((len(x), 1))], axis=1)
        return cols, z, top, pooled, pooled @ self.out

    def logits(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + step])[-1] for i in range(0, len(x), step)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(x))

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of weighted logistic losses."""
        cols, z, top, pooled, logit = self._forward(x)
        err = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weight
        g = {"out": pooled.T @ err}
        up = np.outer(err, self.out[: 2 * CHANNELS])
        dz = np.zeros_like(z)
        np.put_along_axis(dz, top[:, None, :], up[:, None, :CHANNELS], 1)
        dz[:, CONTEXT - 2 : CONTEXT + BODY - 2] += up[:, None, CHANNELS:] / BODY
        dz *= z > 0
        g["conv"] = np.tensordot(cols, dz, axes=([0, 1], [0, 1]))
        g["bias"] = dz.sum(axis=(0, 1))
        dcols = (dz @ self.conv.T).reshape(len(x), WIDTH - KERNEL + 1, KERNEL, EMBED)
        de = np.zeros((len(x), WIDTH, EMBED))
        for k in range(KERNEL):
            de[:, k : k + WIDTH - KERNEL + 1] += dcols[:, :, k]
        g["embed"] = np.zeros_like(self.embed)
        np.add.at(g["embed"], x, de)
        return g

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, step: int = 512) -> np.ndarray:
        """``gradient`` of any number of findings, as one row of numbers."""
        total = np.zeros(sum(getattr(self, k).size for k in NAMES))
        for i in range(0, len(x), step):
            g = self.gradient(x[i : i + step], y[i : i + step], weight[i : i + step])
            total += np.concatenate([g[k].ravel() for k in NAMES])
        return total

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        adam = Adam(self, rate)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                b = order[i : i + 128]
                adam.step(self.gradient(x[b], y[b], np.full(len(b), 1 / len(b))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling, then the largest threshold that keeps ``recall`` of the secrets."""
        z = self.logits(x)
        self.settle([(z, z, y, np.ones(len(z)))], recall)

    def settle(self, places: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], recall: float = RECALL) -> None:
        """``calibrate`` on places of findings, each with lowest and highest logits, labels and counts of its findings; ``recall`` is kept in each."""
        low, high, y, n = (np.concatenate(c) for c in zip(*places))
        share = np.concatenate([n * _share(np.bincount(y.astype(int), n, 2))[y.astype(int)] for _, _, y, n in places])
        share *= len(n) / max(share.sum(), 1e-300)
        w = np.array([1.0, 0.0])
        a = np.stack([(low + high) / 2, np.ones_like(low)], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            h = (a * (share * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            w -= np.clip(np.linalg.solve(h, a.T @ (share * (p - y)) + 1e-3 * w), -2, 2)
        self.scale = (float(w[0]), float(w[1]))
        least = []
        for low, high, y, n in places:
            p, n = np.minimum(self.scaled(low), self.scaled(high))[y == 1], n[y == 1]
            order = np.argsort(p)
            upto = np.cumsum(n[order])
            if len(p):
                least.append(p[order][np.searchsorted(upto, np.floor((upto[-1] - 1) * (1 - recall)), side="right")])
        self.threshold = float(min(least, default=1.0))


class Adam:
    """Steps of a network along gradients."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = ({k: np.zeros_like(getattr(net, k)) for k in NAMES} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k in NAMES:
            d = g[k] + 1e-4 * self.net.out if k == "out" else g[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d**2
            setattr(self.net, k, getattr(self.net, k) - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8))


def _share(counts: np.ndarray) -> np.ndarray:
    """Weight of a finding by its label: the findings of a label weigh as much together as those of the other."""
    return 1 / np.maximum(counts, 1)


# -- labelled findings ----------------------------------------------------------------------------

_B64, _HEXES, _UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def generate(n: int, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """``n`` labelled findings (text, start, end, label), half of them harmless look-alikes; always the same for a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    word = lambda: "".join(("st", "re", "on", "the", "an", "li", "que", "ver", "do", "ma", "ti", "en")[i] for i in rng.integers(0, 12, int(rng.integers(1, 4))))
    number = lambda a, b: int(rng.integers(a, b))
    good = (
        lambda: "ghp_" + pick(_B64[:62], 36), lambda: "xoxb-" + pick(_B64[52:62], 11) + "-" + pick(_B64[:62], 24), lambda: "sk_live_" + pick(_B64[:62], 24),
        lambda: "AIza" + pick(_B64[:62] + "-_", 35), lambda: "eyJ" + pick(_B64[:62], number(30, 60)), lambda: "AKIA" + pick(_UP, 16), lambda: pick(_B64, number(28, 64)) + "=" * number(0, 2),
        lambda: pick(_B64[:62], number(20, 48)), lambda: pick(_HEXES, number(32, 65)), lambda: "glpat-" + pick(_B64[:62], 20), lambda: "SG_" + pick(_B64[:62], 22) + "-" + pick(_B64[:62], 40),
    )
    bad = (
        lambda: f"{number(1990, 2030)}-{number(1, 13):02d}-{number(1, 29):02d}T{number(0, 24):02d}-{number(0, 60):02d}Z", lambda: f"{word()}-{word()}-{word()}-v{number(0, 20)}-{number(0, 30)}",
        lambda: f"{word()}/{word()}/{word()}{number(0, 900)}/{word()}", lambda: f"page{number(1, 99)}_{word()}_{word()}_{word()}", lambda: f"ISBN-{number(10**8, 10**9)}{number(1000, 9999)}",
        lambda: f"{word()}{word()}{word()}{word()}{number(0, 99)}", lambda: f"section-{number(1, 20)}-{word()}-{word()}", lambda: f"{word().upper()}_{word().upper()}_{number(1, 9)}_{word().upper()}",
        lambda: "a1" * number(8, 20), lambda: f"{word()}{number(1, 9)}" * number(4, 7), lambda: f"https-www-{word()}-{word()}-{number(1, 999)}", lambda: f"{number(10**15, 10**16)}x{number(1, 99)}",
    )
    leads = ("key ", "bearer ", "auth=", "export X=", "the ", "", "credential: ", 'value="', "with ")
    calm = ("see ", "file ", "on ", "in ", "the ", "", "chapter ", "and ", 'href="')
    out = []
    for i in range(n):
        label = i % 2
        makers, heads = (good, leads) if label else (bad, calm)
        left = " ".join(word() for _ in range(number(0, 6))) + " " + heads[number(0, len(heads))]
        body = makers[number(0, len(makers))]()
        out.append((left + body + " " + " ".join(word() for _ in range(number(0, 6))), len(left), len(left) + len(body), label))
    return out


def labels_of(text: str) -> list[tuple[np.ndarray, int]]:
    """Windows of all labelled findings of a text: base findings are secrets, candidates harmless where there is none."""
    base = base_findings(text)
    items = []
    for s, e, kind in base:
        items.append((encode(text, s, e), 1))
        if kind == 0:  # the value alone, as it looks without its name
            m = ASSIGN.match(text, s)
            items.append((encode(m[2], 0, len(m[2])), 1)) if m and len(m[2]) >= 16 else None
    return items if base else [(encode(text, s, e), 0) for s, e in candidates(text, base)]


def held_out(code: bytes) -> bool:
    return int(hashlib.md5(code).hexdigest(), 16) % 5 == 0


def _table(items: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels, and which of them are held out."""
    x = np.stack([c for c, _ in items]) if items else np.zeros((0, WIDTH), dtype=np.uint8)
    return x, np.array([label for _, label in items], dtype=float), np.array([held_out(c.tobytes()) for c, _ in items], dtype=bool)


def binned(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -40, 40) * GRID).astype(np.int64)


class Texts:
    """The labelled findings of some texts, in memory."""

    def __init__(self, texts: list[str]):
        once = {(c.tobytes(), label) for t in texts for c, label in labels_of(t)}
        self.x, self.y, self.held = _table([(np.frombuffer(c, dtype=np.uint8), label) for c, label in sorted(once)])

    def counts(self) -> np.ndarray:
        """Of findings to learn from, by label."""
        return np.bincount(self.y[~self.held].astype(int), minlength=2)

    def gradient(self, net: Network, share: np.ndarray) -> np.ndarray:
        x, y = self.x[~self.held], self.y[~self.held]
        return net.gradients(x, y, share[y.astype(int)])

    def scores(self, net: Network) -> list[tuple[int, int, int]]:
        """(label, step of the grid, number of findings) of those held out."""
        cell, n = np.unique(np.stack([self.y[self.held].astype(np.int64), binned(net.logits(self.x[self.held]))]), axis=1, return_counts=True)
        return list(zip(*cell.tolist(), n.tolist()))


class Findings:
    """The labelled findings of a table of texts, all of them, where Spark keeps them; each different window once."""

    def __init__(self, docs: DataFrame):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 4 << 20):
                items = [(c.tobytes(), label) for t in b.column("text").to_pylist() for c, label in labels_of(t or "")]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in items], pa.binary()), pa.array([label for _, label in items], pa.int32()), pa.array([held_out(c) for c, _ in items], pa.bool_())], names=["code", "label", "held"])

        found = docs.select("text").mapInArrow(kernel, "code binary, label int, held boolean").distinct()
        # of a shard the rows keep one order, so that sums come out the same again
        dealt = found.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(SHARDS)).cast("int")).repartition(SHARDS, "shard").sortWithinPartitions("shard", "code", "label")
        self.rows = save(dealt, "findings")

    def counts(self) -> np.ndarray:
        found = {r["label"]: r["count"] for r in self.rows.where("not held").groupBy("label").count().collect()}
        return np.array([found.get(0, 0), found.get(1, 0)])

    def gradient(self, net: Network, share: np.ndarray) -> np.ndarray:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b for b in batches if b.num_rows):
                x = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
                y, shard = (b.column(k).to_numpy() for k in ("label", "shard"))
                of = np.unique(shard)
                sums = [net.gradients(x[shard == k], y[shard == k], share[y[shard == k]]) for k in of]
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(sums, pa.list_(pa.float64()))], names=["shard", "total"])

        # a row of 1,800 numbers for each shard in a batch of rows; summed in one order
        sums = self.rows.where("not held").mapInArrow(kernel, "shard int, total array<double>").collect()
        return np.sum([r["total"] for r in sorted(sums)], axis=0)

    def scores(self, net: Network) -> list[tuple[int, int, int]]:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b for b in batches if b.num_rows):
                x = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(binned(net.logits(x)))], names=["label", "bin"])

        return [tuple(r) for r in self.rows.where("held").mapInArrow(kernel, "label int, bin long").groupBy("label", "bin").count().collect()]

    def drop(self) -> None:
        drop_saved(self.rows)


def train(texts: list[str] | Findings, generated: int = GENERATED) -> Network:
    """``texts``: all documents or their findings. Generated findings and those of the documents weigh the same, and so do the two labels in each."""
    source = texts if isinstance(texts, Findings) else Texts(texts)
    x, y, held = _table([(encode(t, s, e), label) for t, s, e, label in generate(generated)])
    net = Network.fresh()
    net.fit(x[~held], y[~held])
    counts = source.counts()
    own, other = _share(np.bincount(y[~held].astype(int), minlength=2)), _share(counts)
    weight = 2 + (counts > 0).sum()
    adam = Adam(net, RATE)
    for _ in range(ROUNDS if counts.any() else 0):  # without findings in documents nothing is left to learn
        total = (net.gradients(x[~held], y[~held], own[y[~held].astype(int)]) + source.gradient(net, other)) / weight
        ends = np.cumsum([getattr(net, k).size for k in NAMES])
        adam.step({k: g.reshape(getattr(net, k).shape) for k, g in zip(NAMES, np.split(total, ends[:-1]))})
    z = net.logits(x[held])
    places = [(z, z, y[held], np.ones(len(z)))]
    if scores := source.scores(net):
        label, at, n = np.array(sorted(scores)).T
        places.append((at / GRID, (at + 1) / GRID, label.astype(float), n.astype(float)))
    net.settle(places)
    return net


# -- scanning -------------------------------------------------------------------------------------


def scan_texts(net: Network, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """All findings of each text, (start, end, kind) by start, then kind."""
    found, codes, spots = [], [], []
    for i, text in enumerate(texts):
        base = base_findings(text)
        found.append(base)
        for s, e in candidates(text, base):
            codes.append(encode(text, s, e))
            spots.append((i, s, e))
    if codes:
        p = net.probability(np.stack(codes))
        for k in np.flatnonzero(p >= net.threshold):
            i, s, e = spots[k]
            found[i].append((s, e, 3))
        for i in {spots[k][0] for k in np.flatnonzero(p >= net.threshold)}:
            found[i].sort(key=lambda x: (x[0], x[2]))
    return found


def spans_text(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net) for each row of ``docs``.

    Null text is empty; null and repeated ids are rows like others; an empty table gives an
    empty result; other columns are ignored. Offsets count code points. Texts are read whole.
    """
    if net is None:
        found = Findings(docs.where(F.col("text").isNotNull()))
        net = train(found)
        found.drop()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            found = scan_texts(shared.value, [t or "" for t in b.column("text").to_pylist()])
            counts = [pa.array([sum(k == kind for _, _, k in f) for f in found], pa.int64()) for kind in range(4)]
            shas = [hashlib.sha256(spans_text([x for x in f if x[2] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts[:3], pa.array(shas, pa.string()), pa.array([spans_text(f) for f in found], pa.string()), counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_net"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")
