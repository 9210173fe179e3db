"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings is the sum, over all four-letter subsequences spanning at most
SPAN characters, of the product of their occurrences, each worth DECAY ** span: an insult with
gaps or inserted characters keeps most of its subsequences. Landmarks are short strings that
tell labelled toxic texts from others. A linear machine is trained on the landmarks' Nystroem
features of short windows; the landmarks then fold into one weight per subsequence, so that a
text is scored in one pass over its bytes. A text scores as its worst window does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from twinlake.llm import _hashing as H
from twinlake.llm._stage import fields, renamed, whole_row

ORDER, SPAN, DECAY, WINDOW = 4, 6, 0.7, 7
LETTERS = 27
_FOLD = np.zeros(256, np.int32)
_FOLD[65:91] = _FOLD[97:123] = np.arange(1, LETTERS)


@dataclass
class Model:
    """Letter subsequences that weigh something and their weights, and the logistic curve from the worst window to a score."""

    known: np.ndarray
    value: np.ndarray
    slope: float
    offset: float

    def weights(self) -> np.ndarray:
        full = np.zeros(LETTERS**ORDER, np.float32)
        full[self.known] = self.value
        return full


def subsequences(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(number of the subsequence that starts at each place, its span), for every choice of later letters within SPAN."""
    n = symbols.shape[-1] - SPAN + 1
    scaled = [symbols * LETTERS**i for i in range(ORDER - 1)]
    sums, before = [symbols[..., :n] * LETTERS ** (ORDER - 1)], ()
    for steps in combinations(range(1, SPAN), ORDER - 1):
        same = next((i for i, (x, y) in enumerate(zip(steps, before, strict=False)) if x != y), 0)
        del sums[same + 1 :]
        for i in range(same, ORDER - 1):
            sums.append(sums[-1] + scaled[ORDER - 2 - i][..., steps[i] : steps[i] + n])
        yield sums[-1], steps[-1] + 1
        before = steps


def feature_map(text: str) -> dict[int, float]:
    """All weighted subsequences of letters of a short string, unit length."""
    s = np.concatenate([_FOLD[np.frombuffer(text.encode(), np.uint8)], np.zeros(SPAN, np.int32)])
    v: Counter = Counter()
    for index, span in subsequences(s):
        for i in index.tolist():
            if all(i // LETTERS**k % LETTERS for k in range(ORDER)):
                v[i] += DECAY**span
    norm = sum(x * x for x in v.values()) ** 0.5
    return {i: x / norm for i, x in v.items()}


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters with blanks around each, so that no window of one reaches into the next; where each part starts."""
    gap = SPAN + WINDOW
    n = len(at) - 1
    shift = gap * np.arange(n + 1)
    out = np.zeros(len(data) + gap * n, np.int32)
    out[np.arange(len(data)) + np.repeat(shift[:-1] + WINDOW, np.diff(at))] = _FOLD[data]
    return out, at + shift


def window_scores(symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The machine's value of the window that starts at each place."""
    g = np.zeros(max(0, len(symbols) - SPAN + 1), np.float32)
    for index, span in subsequences(symbols):
        part = weights.take(index)
        part *= np.float32(DECAY**span)
        g += part
    c = np.concatenate([[0], np.cumsum(g, dtype=np.float64)])
    return c[WINDOW:] - c[:-WINDOW]


def worst_windows(raw: list[bytes], weights: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its highest window value, the letters of that window, and those of a random one; a quarter megabyte at a time."""
    width = SPAN + WINDOW - 1
    # Filled in place: small arrays kept between large temporary ones would keep the heap from shrinking.
    top, worst, other = np.empty(len(raw)), np.empty((len(raw), width), np.int32), np.empty((len(raw), width), np.int32)
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) <= 1 << 18):
            size += len(raw[j])
            j += 1
        part = raw[i:j]
        symbols, start = padded(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in part])]))
        v = window_scores(symbols, weights)
        np.maximum.reduceat(v, start[:-1], out=top[i:j])
        for k, (a, b) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True), i):
            place = a + int(np.argmax(v[a : b - width + 1]))
            chance = a + int(rng.integers(0, max(1, b - a - width)))
            worst[k], other[k] = symbols[place : place + width], symbols[chance : chance + width]
        i = j
    return top, worst, other


def _document_counts(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every string of n letters in the texts, as a number, and how many texts hold it."""
    found = []
    for t in texts:
        letters = _FOLD[np.frombuffer(t, np.uint8)]
        if len(letters) < n:
            continue
        code, whole = np.zeros(len(letters) - n + 1, np.int32), np.ones(len(letters) - n + 1, bool)
        for i in range(n):
            part = letters[i : i + len(code)]
            code = code * LETTERS + part
            whole &= part > 0
        found.append(np.unique(code[whole]))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, np.int64))


def choose_landmarks(texts: list[bytes], toxic: np.ndarray, each: int, sizes: tuple[int, ...] = (4, 5, 6)) -> tuple[list[str], int]:
    """Letter strings inside words: the ``each`` most telling of toxic texts, and as many of the commonest of others; how many are telling."""
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    telling, common = [], []
    for n in sizes:
        decode = lambda code, n=n: "".join(chr(96 + int(code) // LETTERS**i % LETTERS) for i in range(n - 1, -1, -1))
        bad, in_bad = _document_counts([t for t, b in zip(texts, toxic, strict=True) if b], n)
        good, in_good = _document_counts([t for t, b in zip(texts, toxic, strict=True) if not b], n)
        bad, in_bad = bad[in_bad >= 3], in_bad[in_bad >= 3]
        at = np.minimum(np.searchsorted(good, bad), max(0, len(good) - 1))
        also = np.where(good[at] == bad, in_good[at], 0) if len(good) else np.zeros(len(bad))
        value = np.log((in_bad + 0.5) / n_bad / ((also + 2) / n_good)) * np.sqrt(in_bad)
        telling += [(-float(value[i]), decode(bad[i])) for i in np.lexsort((bad, -value))[:each]]
        common += [(-int(in_good[i]), decode(good[i])) for i in np.lexsort((good, -in_good))[: 2 * each]]
    first = [x for _, x in sorted(telling)[:each]]
    return first + [x for _, x in sorted(common) if x not in set(first)][:each], len(first)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, penalty: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """A linear machine by averaged stochastic subgradients of the hinge loss; the last feature is constant."""
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            k = order[i : i + 64]
            rate = 1 / (penalty * (t + 1000))
            miss = y[k] * (x[k] @ w) < 1
            w = (1 - rate * penalty) * w + rate * ((y[k] * weight[k])[miss] @ x[k][miss]) / len(k)
            mean += w
            t += 1
    return mean / t


def gapped(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows with a blank or a letter put in at a random place, as evasive spellings have it."""
    n, width = windows.shape
    at = rng.integers(2, WINDOW + 2, n)[:, None]
    place = np.arange(width)[None, :]
    moved = np.take_along_axis(windows, np.maximum(place - (place > at), 0), 1)
    return np.where(place == at, np.where(rng.random((n, 1)) < 0.5, 0, rng.integers(1, LETTERS, (n, 1))), moved).astype(windows.dtype)


def train(texts: list[str], toxic: np.ndarray, landmarks: int = 256, rounds: int = 4, seed: int = 5) -> Model:
    """Landmarks, Nystroem features, machine and curve from labelled texts.

    Labels are of texts, insults are of windows: each round takes the worst window of every
    toxic text as toxic, with and without a gap put in, and the worst and some random windows of
    the others as clean.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(np.empty(0, np.int64), np.empty(0), 0.0, min(0.0, float(np.log((toxic.sum() + 1) / ((~toxic).sum() + 1)))))
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    marks, n_telling = choose_landmarks(raw, toxic, landmarks // 2)
    maps = [feature_map(m) for m in marks]
    known = np.array(sorted({i for m in maps for i in m}))
    column = np.full(LETTERS**ORDER, len(known), np.int32)
    column[known] = np.arange(len(known))
    z = np.zeros((len(marks), len(known) + 1))
    for j, m in enumerate(maps):
        z[j, column[list(m)]] = list(m.values())
    values, vectors = np.linalg.eigh(z @ z.T)
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def fold(v: np.ndarray) -> np.ndarray:
        full = np.zeros(LETTERS**ORDER, np.float32)
        full[known] = (v @ z)[:-1]
        return full

    weights = fold(np.arange(len(marks)) < n_telling)
    hard = np.empty((0, SPAN + WINDOW - 1), np.int32)
    for _ in range(rounds):
        _, worst, chance = worst_windows(raw, weights, rng)
        hard = np.unique(np.vstack([hard, worst[~toxic]]), axis=0)
        windows = np.vstack([worst[toxic], gapped(worst[toxic], rng), hard, chance])
        y = np.where(np.arange(len(windows)) < 2 * toxic.sum(), 1.0, -1.0)
        x = np.ones((len(windows), len(marks) + 1))
        for at in range(0, len(windows), 1000):
            part = windows[at : at + 1000]
            counts = np.zeros((len(part), len(known) + 1))
            for index, span in subsequences(part):
                for i in range(index.shape[1]):
                    np.add.at(counts, (np.arange(len(part)), column[index[:, i]]), DECAY**span)
            x[at : at + 1000, :-1] = counts @ z.T @ root
        balance = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0)
        weights = fold(root @ _svm(x, y, balance, rng)[:-1])
    top, worst, _ = worst_windows(raw, weights, rng)
    with_gaps = sum(weights[index].sum(1) * DECAY**span for index, span in subsequences(gapped(worst[toxic], rng)))
    slope, offset = _logistic(np.concatenate([top, with_gaps]), np.concatenate([toxic, np.ones(len(with_gaps), bool)]))
    return Model(known, weights[known], slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-(slope x + offset))), slightly damped."""
    scale = max(float(x.std()), 1e-9)
    u = np.column_stack([x / scale, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ b, -30, 30)))
        step = np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + 1e-3 * np.eye(2), u.T @ (y - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 1 modulo 3, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most_rows: int = 3000, most_chars: int = 20_000) -> Model:
    """Train on a bounded sample of labelled rows: at most ``most_rows``, of texts of at most
    ``most_chars`` characters, in the order of a hash of the id, none of them held out.

    Labels that are null or of a null id don't count; of several labels of an id the highest does.
    Without labelled rows, or with rows of one class only, every text scores the same: one half at most.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    own = docs.where(~held_out(F.col("doc_id")) & (F.char_length("text") <= most_chars)).select("doc_id", "text")
    rows = own.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(most_rows).select("text", "toxic")  # most_rows ids, a bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            toxic += [x == 1 for x in b.column("toxic").to_pylist()]
        m = train(texts, np.array(toxic, bool))
        yield pa.RecordBatch.from_arrays([pa.array([m.known.tolist()], pa.list_(pa.int64())), pa.array([m.value.astype(float).tolist()], pa.list_(pa.float64())), pa.array([m.slope]), pa.array([m.offset])], names=["known", "value", "slope", "offset"])

    # One task: the sample is bounded, and the executors have the memory.
    m = rows.repartition(1).mapInArrow(run, "known array<long>, value array<double>, slope double, offset double").first()
    if m is None:
        return train([], np.empty(0, bool))
    return Model(np.array(m.known, np.int64), np.array(m.value), m.slope, m.offset)


def score_toxicity(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; other columns as they are.

    Scores depend on the text alone: whole texts, of any length; null and empty texts score as
    a text without a suspect window. Repeated rows get equal scores; an empty table stays so.
    Input columns may have any name and type; ones called score or predicted come back as
    ``score_input`` and ``predicted_input``.
    """
    out = scored_rows(docs, model, threshold=threshold, text_col=text_col)
    return out.select(*fields("row", renamed(docs.columns, {"score", "predicted"})), "score", "predicted")


def scored_rows(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """(row, score, predicted): each row of ``docs`` as a struct, and its score."""
    slope, offset = model.slope, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights()
        for b in batches:
            for chunk in H.chunks(b, "text", 1 << 20):
                data, at = H.buffer(chunk.column("text"))
                symbols, start = padded(data, at)
                top = np.maximum.reduceat(window_scores(symbols, weights), start[:-1])
                score = 1 / (1 + np.exp(-np.clip(slope * top + offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    rows = docs.select(whole_row(docs.columns).alias("row"), F.col(text_col).alias("text"))
    kinds = StructType([rows.schema["row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, kinds)
