"""Language identification of mixed-language text.

Every word gets a log-probability under each learned language from its character
n-grams (1 to 4 bytes with word edges). The scripts of a word, found from code
point ranges, narrow the languages that are considered for it. Viterbi decoding
over the words of a document, with a penalty for each switch of language, labels
spans; the language with most bytes in the labels is the document's.

Training: counts of n-grams over whole texts of a sample of at most
``SAMPLE`` different texts and ``SAMPLE_BYTES`` a language and ``ALL_BYTES`` together, chosen by a hash of the text (texts of over a
fortieth of a language's bytes are not learned from). The model is a table of fixed size. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import sample_texts
from quire.llm.kernels import LOWER_TABLE, slices, spans, text_bytes

#: Bound on the training sample: documents a language, and bytes of text a language.
SAMPLE, SAMPLE_BYTES = 1500, 4_000_000
#: Bound on the text of all languages together; with many languages each has less.
ALL_BYTES = 64_000_000
TABLE_BITS, ORDERS, SWITCH = 16, (1, 2, 3, 4), 6.0
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "thai", "hangul", "kana", "han", "other")
_RANGES = ((0x41, 0x24F, 0), (0x1E00, 0x1EFF, 0), (0x370, 0x3FF, 1), (0x1F00, 0x1FFF, 1), (0x400, 0x52F, 2), (0x590, 0x5FF, 3), (0x600, 0x77F, 4), (0x900, 0xDFF, 5), (0xE00, 0xE7F, 6), (0x1100, 0x11FF, 7), (0xAC00, 0xD7AF, 7), (0x3040, 0x30FF, 8), (0x3400, 0x9FFF, 9), (0x20000, 0x2FFFF, 9))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes that make up words: ASCII letters and all bytes of other characters."""
    return ((data | 32) - 97 < 26) & (data < 128) | (data >= 128)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (second byte after 0xC3)."""
    out = LOWER_TABLE[data]
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)) + 1
        out[wide] += 0x20
    return out


def scripts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bit set of scripts for each word, by the code points of its characters."""
    found = np.zeros(len(starts), dtype=np.uint16)
    at = np.flatnonzero(data >= 0xC2)
    if not len(at) or not len(starts):
        return np.ones(len(starts), dtype=np.uint16)
    d = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    lead, tail = d[at], [d[at + i] & 63 for i in (1, 2, 3)]
    point = np.where(lead < 0xE0, (lead & 31) << 6 | tail[0], np.where(lead < 0xF0, (lead & 15) << 12 | tail[0] << 6 | tail[1], (lead & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
    bits = np.zeros(len(at), dtype=np.uint16)
    for lo, hi, script in _RANGES:
        bits[(point >= lo) & (point <= hi)] = 1 << script
    bits[(bits == 0) & (point > 0x2BF) & ((point < 0x2000) | (point > 0x2BFF))] = 1 << 10
    word = np.searchsorted(starts, at, side="right") - 1
    inside = (word >= 0) & (at < ends[np.maximum(word, 0)])
    np.bitwise_or.at(found, word[inside], bits[inside])
    plain = np.concatenate(([0], np.cumsum(data < 128)))
    found[plain[ends] > plain[starts]] |= 1
    found[found == 0] = 1
    return found


CELLS = 1 << TABLE_BITS


def gram_cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Words laid out with one mark around each: for each order the cell of the n-gram at every place (``CELLS``
    where a mark lies inside it, so that it is none), and the place where each word's n-grams begin."""
    sizes = ends - starts
    head = np.cumsum(sizes + 1) - sizes - 1
    n = int(head[-1] + sizes[-1] + 2)
    word = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(word)) - (head[word] - word)
    text = np.zeros(n, dtype=np.uint32)
    text[head[word] + 1 + within] = data[starts[word] + within] + np.uint32(1)
    letter = text > 0
    cells, code, whole = [], np.zeros(n, dtype=np.uint32), None
    for k in ORDERS:
        m = n - k + 1
        if m < 1:
            break
        code = code[:m] * np.uint32(0x01000193) ^ text[k - 1 :]
        whole = letter if k == 1 else (np.ones(m, dtype=bool) if k == 2 else whole[:m] & letter[k - 2 : n - 1])
        h = code * np.uint32(0x85EBCA6B)
        h = (((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(16)) + np.uint32(k * 977) & np.uint32(CELLS - 1)
        cells.append(np.where(whole, h, np.uint32(CELLS)).astype(np.int32))
    return cells, head


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (cells, languages): log-probabilities less their mean
    scripts: np.ndarray  # bit set of each language


def train(rows: list[tuple[str, str]]) -> Model:
    """``rows``: (language, text)."""
    names = sorted({lang for lang, _ in rows})
    counts, seen = np.zeros((CELLS, len(names))), np.zeros((len(names), 16))
    for k, name in enumerate(names):
        joined = [t.encode("utf-8", "replace") for lang, t in rows if lang == name]
        for i in range(0, len(joined), 50):
            data = np.frombuffer(b" ".join(joined[i : i + 50]), dtype=np.uint8)
            starts, ends, _ = spans(letters(data), np.array([0, len(data)]))
            if not len(starts):
                continue
            for cells in gram_cells(fold(data), starts, ends)[0]:
                counts[:, k] += np.bincount(cells, minlength=CELLS + 1)[:CELLS]
            bits = scripts_of(data, starts, ends)
            seen[k] += [(bits >> s & 1).sum() for s in range(16)]
    smooth = np.log(counts + 0.3) - np.log(counts.sum(axis=0) + 0.3 * CELLS) if names else counts
    scores = (smooth - smooth.mean(axis=1, keepdims=True)) if names else smooth
    scripts = np.array([sum(1 << s for s in range(16) if row[s] > 0.01 * max(row.sum(), 1)) for row in seen], dtype=np.uint16)
    return Model(names, np.concatenate([scores, np.zeros((1, len(names)))]).astype(np.float32), scripts)


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, len(model.languages)), dtype=np.float32)
    cells, head = gram_cells(fold(data), starts, ends)
    total = model.scores[cells[0]]
    for c in cells[1:]:
        total[: len(c)] += model.scores[c]
    out = np.add.reduceat(total, head, axis=0)
    out /= np.sqrt(np.maximum(ends - starts, 1))[:, None]  # overlapping grams are not independent
    bits = scripts_of(data, starts, ends)
    if (bits != 1).any() or (model.scripts & 1 == 0).any():
        fits = (bits[:, None] & model.scripts[None, :]) != 0
        out[~fits & fits.any(axis=1)[:, None]] = -1e4
    return out


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best labels of consecutive sequences of the given sizes; all sequences advance together."""
    n, k = scores.shape
    labels = np.zeros(n, dtype=np.int16)
    if not n or k < 2:
        return labels
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    back = np.zeros((n, k), dtype=np.int16)
    alive = int((left > 0).sum())
    state = scores[begin[:alive]].astype(np.float64)
    own = np.arange(k, dtype=np.int16)
    for t in range(1, int(left[0]) if alive else 0):
        alive = int(np.searchsorted(-left, -t, side="left"))
        state = state[:alive] if len(state) == alive else _finish(state, alive, labels, begin, left, t)
        best = state.argmax(axis=1)
        jump = state[np.arange(alive), best] - penalty
        stay = state >= jump[:, None]
        at = begin[:alive] + t
        back[at] = np.where(stay, own, best[:, None])
        state = np.where(stay, state, jump[:, None]) + scores[at]
    _finish(state, 0, labels, begin, left, 0)
    for t in range(int(left[0]) - 1, 0, -1) if alive or left[0] else ():
        live = int(np.searchsorted(-left, -t, side="left"))
        at = begin[:live] + t
        labels[at - 1] = back[at, labels[at]]
    return labels


def _finish(state: np.ndarray, alive: int, labels: np.ndarray, begin: np.ndarray, left: np.ndarray, t: int) -> np.ndarray:
    """Sequences beyond ``alive`` have ended: their last label is the best state."""
    done = np.arange(alive, len(state))
    labels[begin[done] + left[done] - 1] = state[done].argmax(axis=1)
    return state[:alive]


def tag(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as (start, end in bytes of the joined texts, text number, label)."""
    data, offsets = text_bytes(texts)
    starts, ends, doc = spans(letters(data), offsets)
    labels = viterbi(word_scores(model, data, starts, ends), np.bincount(doc, minlength=len(texts)))
    return starts, ends, doc, labels


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the share of its letters' bytes inside spans of that language."""
    starts, ends, doc, labels = tag(model, texts)
    k, n = max(1, len(model.languages)), len(texts)
    share = np.bincount(doc * k + labels, weights=ends - starts, minlength=n * k).reshape(n, k)
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    names, scores = [], np.zeros(n)
    for i, text in enumerate(texts.to_pylist()):
        if total[i] and model.languages and any(map(str.isalpha, text)):
            names.append(model.languages[best[i]])
            scores[i] = share[i, best[i]] / total[i]
        else:
            names.append("und")
    return names, scores


def sample(docs: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, all_bytes: int = ALL_BYTES) -> list[tuple[str, str]]:
    """Labelled texts to learn from: of each language different whole texts with the smallest hashes, up to all bounds."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = labelled.agg(F.countDistinct("lang")).first()[0]
    each = min(most_bytes, all_bytes // max(1, languages))
    return [(r["lang"], r["text"]) for r in sample_texts(labelled, "lang", most, each).collect()]


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``.

    Learns from rows that are not held out and have a ``lang``. Text that is null or has no
    letter is ``und`` with score 0, and so is everything if there is nothing to learn from. Null
    and repeated ids are rows like others; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or train(sample(docs)))  # a table of fixed size

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 3 << 20):
            names, scores = predict(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
