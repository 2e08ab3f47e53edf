"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not. So token labels come first: over all
labelled documents, counts of each word and of each word's beginning by label of
the document give its share among toxic documents; in a toxic document the tokens
that are far likelier there than elsewhere can be toxic; of those, the fewest that explain the
toxic documents (greedy cover) are, and everything else is clean. A chain with two states is fitted to the tagged tokens of a sample; each
token's features are hashed: the word, its beginnings and endings, its neighbours
and its length. Forward-backward marginals of all tokens give the offending
offsets, and their greatest and their sum give, through a logistic fit, the
document's score.

Training uses at most ``SAMPLE`` documents of each label and ``SAMPLE_BYTES`` of
their text (different whole texts, chosen by hash); the counts cover all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, sample_texts, save
from quire.llm.kernels import Powers, RangeHash, mix, slices, spans, text_bytes
from quire.llm.language import fold, held_out, letters

#: Bounds on the training sample: documents of each label, bytes of text of each label.
SAMPLE, SAMPLE_BYTES = 2000, 4_000_000
#: Bound on the words and beginnings that can mark a token as toxic, strongest evidence first.
MARKERS = 20_000
BITS, THRESHOLD = 20, 0.3
#: A unit needs this many toxic documents, and this share of them, to be a marker; so there are never very many.
LEAST_DOCS, LEAST_SHARE = 5, 5e-4
#: A unit marks tokens if this share of the documents that hold it is toxic, or, as clean texts may hold it once where toxic
#: ones repeat it, this share of its occurrences (at most MOST_HITS a document) and MANY_DOCS toxic documents hold it.
SHARE, HIT_SHARE, MANY_DOCS, MOST_HITS = 0.85, 0.75, 10, 8
#: Bits of the map of such units that filters the words of clean documents: 512 KB, whatever the input.
MAP_BITS = 22
#: Label tables of at most so many rows are broadcast to the texts; for larger ones the texts are shuffled.
BROADCAST_LABELS = 1_000_000
_POWERS = Powers()
_HEADS = (4, 5, 6, 7, 8)
_KINDS = 4 + len(_HEADS)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, text number) of all words of all texts."""
    data, offsets = text_bytes(column)
    starts, ends, doc = spans(letters(data), offsets)
    return fold(data), starts, ends, doc


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(tokens, kinds) hashed features."""
    n = len(starts)
    if not n:
        return np.zeros((0, _KINDS), dtype=np.int32)
    h = RangeHash(data, _POWERS)
    size = ends - starts
    word = h(starts, ends)
    parts = [word] + [h(starts, starts + np.minimum(size, k)) for k in _HEADS] + [h(ends - np.minimum(size, 4), ends)]
    edge = np.uint64(0x5851F42D4C957F2D)
    before, after = np.full(n, edge), np.full(n, edge)
    same = doc[1:] == doc[:-1]
    before[1:][same] = word[:-1][same]
    after[:-1][same] = word[1:][same]
    parts += [before, after]
    out = np.empty((n, _KINDS), dtype=np.int32)
    for k, p in enumerate(parts):
        out[:, k] = (mix(p + np.uint64(k * 0x1234567)) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


@dataclass
class Model:
    weights: np.ndarray  # (2**BITS): evidence for label 1 over label 0 of each feature
    bias: float
    trans: np.ndarray  # (2, 2) log-potentials
    readout: np.ndarray  # logistic weights of the document features, the last one constant


def _forward_backward(unary: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals of label 1 for sequences laid end to end. ``unary``: log-odds of label 1 from the token alone.

    Only log-odds travel along the chain: a message m becomes log((e^t01 + e^(t11+m)) / (e^t00 + e^(t10+m)))."""
    n = len(unary)
    if not n:
        return np.zeros(0)
    order = np.argsort(-sizes, kind="stable")
    begin, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longest = int(left[0])
    live = np.searchsorted(-left, -np.arange(longest + 1), side="left")  # sequences longer than t
    fwd, bwd = np.zeros(n), np.zeros(n)

    def step(m: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.logaddexp(t[0, 1], t[1, 1] + m) - np.logaddexp(t[0, 0], t[1, 0] + m)

    for t in range(1, longest):
        at = begin[: live[t]] + t
        fwd[at] = step(fwd[at - 1] + unary[at - 1], trans)
    for t in range(longest - 1, 0, -1):
        at = begin[: live[t]] + t
        bwd[at - 1] = step(bwd[at] + unary[at], trans.T)
    return 1 / (1 + np.exp(-np.clip(fwd + unary + bwd, -60, 60)))


def _document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the greatest marginal; logs of the sum of marginals, of that sum without the greatest, and of the sum a token; constant."""
    out = np.zeros((n, 5))
    out[:] = -14.0, np.log(1e-6), np.log(1e-3), np.log(1e-6), 1.0
    if len(p):
        top = np.zeros(n)
        np.maximum.at(top, doc, p)
        total, size = np.bincount(doc, weights=p, minlength=n), np.bincount(doc, minlength=n)
        has = size > 0
        rest = np.log(1e-3 + np.maximum(total - top, 0))
        top = np.clip(top, 1e-6, 1 - 1e-6)
        out[has, 0] = np.log(top[has] / (1 - top[has]))
        out[has, 1] = np.log(np.maximum(total[has], 1e-6))
        out[has, 2] = rest[has]
        out[has, 3] = np.log(np.maximum(total[has] / size[has], 1e-6))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic fit."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[str, int]], markers: np.ndarray, epochs: int = 25, rate: float = 0.6, odds: float | None = None) -> Model:
    """``rows``: (text, label); ``markers``: hashes of words and beginnings that mark a token of a toxic document; ``odds``: toxic
    documents for each clean one where the rows are drawn from, if not those of the rows."""
    weights, bias, trans = np.zeros(1 << BITS), -4.0, np.log(np.array([[0.97, 0.03], [0.6, 0.4]]))
    plain = Model(weights, bias, trans, np.array([0.0, 0.0, 0.0, 0.0, -20.0]))
    labels = np.array([label for _, label in rows], dtype=int)
    if len(set(labels.tolist())) < 2 or not len(markers):
        return plain
    feats, doc, gold = _tagged(rows, labels, markers)
    if not gold.any():
        return plain
    sizes = np.bincount(doc, minlength=len(rows))
    # transitions by counts of the tagged chains; evidence by gradient steps on the chain's likelihood
    joined = doc[1:] == doc[:-1]
    pairs = np.bincount(2 * gold[:-1][joined] + gold[1:][joined], minlength=4).reshape(2, 2) + 0.5
    trans = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    square = np.full(1 << BITS, 1e-6)
    # a feature needs to be seen on two toxic tokens; steps are scaled per feature (AdaGrad)
    use = np.zeros(1 << BITS, dtype=bool)
    for k in range(_KINDS):
        use |= np.bincount(feats[gold, k], minlength=1 << BITS) >= 2
    for _ in range(epochs):
        unary = _unary(weights, bias, feats)
        error = _forward_backward(unary, sizes, trans) - gold
        grad = np.zeros(1 << BITS)
        for k in range(_KINDS):
            grad += np.bincount(feats[:, k], weights=error, minlength=1 << BITS)
        grad = np.where(use, grad + 0.05 * weights, 0.0)
        square += grad * grad
        weights -= rate * grad / np.sqrt(square)
        bias -= rate * 0.1 * np.sign(error.sum()) * min(1.0, abs(error.sum()) / max(1, gold.sum()))
    unary = _unary(weights, bias, feats)
    docs = _document_features(_forward_backward(unary, sizes, trans), doc, len(rows))
    readout = _logistic(docs, labels)
    if odds is not None:  # the rows hold the labels in another proportion: the constant moves by as much
        readout[-1] += np.log(odds) - np.log(labels.sum() / (len(labels) - labels.sum()))
    return Model(weights, bias, trans, readout)


def _tagged(rows: list[tuple[str, int]], labels: np.ndarray, markers: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text number, toxic or not) of all tokens. Texts are taken a piece at a time: only the features are kept of all."""
    feats, docs, hits, at, tokens_before = [], [], [], 0, 0
    while at < len(rows):
        to, size = at, 0
        while to < len(rows) and (to == at or size < piece):
            size += len(rows[to][0])
            to += 1
        data, starts, ends, doc = tokens(pa.array([t for t, _ in rows[at:to]], pa.large_string()))
        feats.append(features(data, starts, ends, doc))
        docs.append(doc + at)
        if len(starts):
            u = units(data, starts, ends)
            r, c = np.nonzero(np.isin(u, markers) & (labels[docs[-1]] == 1)[:, None])
            hits.append(np.stack([r + tokens_before, docs[-1][r], u[r, c]]))
        tokens_before += len(starts)
        at = to
    gold = np.zeros(tokens_before, dtype=bool)
    token, doc, unit = np.concatenate(hits, axis=1) if hits else np.zeros((3, 0), dtype=np.int64)
    gold[token[np.isin(unit, _cover(unit, doc))]] = True
    return np.concatenate(feats), np.concatenate(docs), gold


def _cover(unit: np.ndarray, doc: np.ndarray, least: int = 3) -> np.ndarray:
    """Of the units found, greedily those that explain most documents not yet explained."""
    chosen: list[int] = []
    while len(unit):
        order = np.lexsort((doc, unit))
        u, d = unit[order], doc[order]
        once = np.concatenate(([True], (u[1:] != u[:-1]) | (d[1:] != d[:-1])))
        keys, gain = np.unique(u[once], return_counts=True)
        if gain.max() < least:
            break
        chosen.append(keys[gain.argmax()])
        left = ~np.isin(doc, np.unique(doc[unit == chosen[-1]]))
        unit, doc = unit[left], doc[left]
    return np.array(chosen, dtype=np.int64)


def _unary(model_weights: np.ndarray, bias: float, feats: np.ndarray) -> np.ndarray:
    out = np.full(len(feats), bias)
    for k in range(_KINDS):
        out += model_weights[feats[:, k]]
    return out


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(tokens, units): hashes of the word and of its first bytes; a beginning that is a word by itself is the same unit."""
    h, size = RangeHash(data, _POWERS), ends - starts
    cols = [h(starts, ends)] + [h(starts, starts + np.minimum(size, k)) for k in _HEADS]
    return np.stack(cols, axis=1).view(np.int64)


def _cells(unit: np.ndarray) -> np.ndarray:
    return (mix(unit.view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _count_units(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Documents that hold a unit (of those ``wanted`` may want) and its occurrences in them: summed for each batch before they are shuffled."""
    for b in slices(batches, "text", 1 << 20):
        data, starts, ends, doc = tokens(b.column("text"))
        if not len(starts):
            continue
        u = units(data, starts, ends)
        own = np.ones(u.shape, dtype=bool)  # the units of a word that is no longer than its beginnings are one unit
        for k in range(1, u.shape[1]):
            own[:, k] = (u[:, :k] != u[:, k : k + 1]).all(axis=1)
        flat, owner = u[own], np.repeat(doc, own.sum(axis=1))
        if wanted is not None:
            use = wanted[_cells(flat)]
            flat, owner = flat[use], owner[use]
        if not len(flat):
            continue
        order = np.argsort(flat, kind="stable")  # the documents of a unit stay in order
        flat, owner = flat[order], owner[order]
        once = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))))
        hits = np.minimum(np.diff(np.append(once, len(flat))), MOST_HITS)
        flat = flat[once]
        head = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(flat[head]), pa.array(np.diff(np.append(head, len(flat)))), pa.array(np.add.reduceat(hits, head))], names=["unit", "docs", "hits"])


def find_markers(labelled: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Units that stand nearly only in toxic documents, by counts over all of ``labelled`` (text, toxic)."""
    least = max(LEAST_DOCS, int(LEAST_SHARE * toxic))
    spark, kinds = labelled.sparkSession, "unit long, docs long, hits long"
    counted = labelled.where("toxic = 1").select("text").mapInArrow(_count_units, kinds).groupBy("unit").agg(F.sum("docs").alias("t"), F.sum("hits").alias("th")).where(F.col("t") >= least)
    counted = save(counted, "units-of-toxic-texts")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_cells(b.column("unit").to_numpy(zero_copy_only=False))))], names=["cell"])

    wanted = np.zeros(1 << MAP_BITS, dtype=bool)
    wanted[counted.select("unit").mapInArrow(mark, "cell long").distinct().toArrow().column("cell").to_numpy()] = True  # at most 2**MAP_BITS rows
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_units(batches, np.unpackbits(shared.value).view(bool))

    others = labelled.where("toxic = 0").select("text").mapInArrow(count, kinds).groupBy("unit").agg(F.sum("docs").alias("c"), F.sum("hits").alias("ch"))
    both = counted.join(others, "unit", "left").na.fill(0, ["c", "ch"])
    even = 2 * toxic / (toxic + clean)
    share = (F.col("t") + even) / (F.col("t") + F.col("c") + 2.0)
    hit_share = (F.col("th") + even) / (F.col("th") + F.col("ch") + 2.0)
    best = both.where((share >= SHARE) | (F.col("t") >= max(least, MANY_DOCS)) & (hit_share >= HIT_SHARE))
    # as many as MARKERS by evidence: the log-likelihood that their documents gain over the share of all
    gain = F.col("t") * F.log(F.greatest(share, hit_share) / (toxic / (toxic + clean)))
    return best.orderBy(F.desc(gain), "unit").limit(MARKERS).select("unit").toArrow().column("unit").to_numpy()


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    mine = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    known = save(known, "labels")
    few = known.count() <= BROADCAST_LABELS
    labelled = save(mine.join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic"), "labelled-texts")
    total = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not total.get(0) or not total.get(1):
        return train([], np.zeros(0, dtype=np.int64))
    markers = find_markers(labelled, total[1], total[0])
    rows = sample_texts(labelled, "toxic", SAMPLE, SAMPLE_BYTES).collect()
    return train([(r["text"], r["toxic"]) for r in rows], markers, odds=total[1] / total[0])


def marginals(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginal, start, end, text number) of each token; offsets in bytes of the joined texts."""
    data, starts, ends, doc = tokens(column)
    feats = features(data, starts, ends, doc)
    unary = _unary(model.weights, model.bias, feats)
    return _forward_backward(unary, np.bincount(doc, minlength=len(column)), model.trans), starts, ends, doc


def judge(model: Model, column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Score of each text, and its offending spans as start:end in characters, comma-joined."""
    p, starts, ends, doc = marginals(model, column)
    x = _document_features(p, doc, len(column)) @ model.readout
    scores = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    found = [""] * len(column)
    hits = np.flatnonzero(p >= 0.5)
    if len(hits):
        data, offsets = text_bytes(column)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        for i in hits:
            at = chars[offsets[doc[i]]]
            found[doc[i]] += f",{chars[starts[i]] - at}:{chars[ends[i]] - at}"
    return scores, [f[1:] for f in found]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxic_score`` (double) and ``toxic_spans`` (start:end of each toxic word, in characters).

    Null and empty texts get the score of a text without words. Columns of ``docs`` that
    have these names are replaced; others pass through.
    """
    cols = [c for c in docs.columns if c not in ("toxic_score", "toxic_spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 3 << 20):
            scores, found = judge(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(scores), pa.array(found, pa.string())], names=[*cols, "toxic_score", "toxic_spans"])

    schema = T.StructType([*[docs.schema[c] for c in cols], T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", T.StringType())])
    return docs.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(kernel, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of ``docs``.

    Learns from rows of ``docs`` that are not held out and have a label (of repeated labels
    the larger; null or other labels are ignored). Without labels of both kinds every score is near 0.
    Null and repeated ids are rows like others; other columns are ignored.
    """
    model = learn(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = score(rows, model)
    return found.select("doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, under a model learned from ``docs`` and ``labels``.
    All columns pass through; the cases are those of ``classify``."""
    row = fresh("row", docs)
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    clean = score(packed, learn(docs, labels)).where(F.col("toxic_score") < threshold)
    return clean.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
