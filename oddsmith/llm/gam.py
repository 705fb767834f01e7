"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned; cyclic boosting visits one feature after the other and adds a shallow tree over its bins, fitted
to the gradient, to the feature's lookup table. Pairs that explain most of what is left get tables of
two dimensions in the same way. A score is a sum of looked-up values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, hasher, slices, text_buffer

MAX_LABELLED = 20_000  # labelled rows used for fitting at most: those of least hash
BATCH = 1 << 20  # bytes of text taken together, or one longer text
BINS = 32  # of a feature at most
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1  # passes over all features, over all pairs; what a tree adds of its fit
LEAVES, PAIRS = 3, 6  # leaves of a tree on one feature (two cuts); pairs with a table
RIDGE, MIN_LEAF = 1.0, 5.0  # of a leaf: weight added to its curvature; rows at least

FEATURES = [
    "log_words", "word_length", "long_words", "symbols", "capitals", "digits", "bangs", "pipes", "stops", "commas", "other_marks", "not_ascii",
    "distinct_words", "repeated_neighbours", "log_lines", "words_per_line", "repeated_lines", "most_frequent_word", "byte_entropy", "worst_symbols", "worst_capitals", "worst_repeats",
]
_PART = 64  # words of a part, for the worst part of a text


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "symbols": _table(b"#*$%&|<>"), "capitals": _table(bytes(range(65, 91))), "digits": _table(bytes(range(48, 58))), "bangs": _table(b"!"), "pipes": _table(b"|"),
    "stops": _table(b".?"), "commas": _table(b",;:"), "other_marks": _table(b"()[]{}\"'=+/\\_~^`@-"), "not_ascii": _table(bytes(range(192, 256))),
}


def _runs(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each of the equal (owner, value) pairs; values by their upper 44 bits."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    return (key[at] >> np.uint64(44)).astype(np.int64), np.diff(np.append(at, len(key)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a batch, from its bytes; every text is read whole. A text without words has zeros."""
    n = len(offsets) - 1
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count = lambda o, w=None: np.bincount(o, w, minlength=n).astype(float)
    bytes_ = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256)
    chars = np.maximum(1, bytes_[:, ~SPACE].sum(1))
    hashes, words = hasher().words(data, offsets)
    n_words = count(words)
    per_word = np.maximum(1, n_words)
    begin = np.zeros(len(data), bool)  # of texts
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    full = ~SPACE[data]
    start = full.copy()
    start[1:] &= ~full[:-1] | begin[1:]
    ends = np.flatnonzero(np.append(full[:-1] & (~full[1:] | begin[1:]), full[-1:])) + 1
    at = np.flatnonzero(start)
    length = ends - at
    out = {"log_words": np.log1p(n_words), "word_length": count(words, length) / per_word, "long_words": count(words[length > 20]) / per_word}
    for k, table in _CLASSES.items():
        out[k] = bytes_[:, table].sum(1) / (per_word if k in ("symbols", "bangs", "pipes", "stops", "commas") else chars)
    o, times = _runs(words, hashes)
    out["distinct_words"] = count(o) / per_word
    top = np.zeros(n)
    np.maximum.at(top, o, times)
    out["most_frequent_word"] = top / per_word
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words[1:] == words[:-1])
    out["repeated_neighbours"] = count(words[same]) / per_word
    # Lines: words between newlines; a line's value is the sum of its words by place.
    line = np.cumsum((data == 10) | begin)[at]
    first = np.ones(len(line), bool)
    first[1:] = line[1:] != line[:-1]
    head = np.flatnonzero(first)
    lines = words[head]
    out["log_lines"] = np.log1p(count(lines))
    out["words_per_line"] = n_words / np.maximum(1, count(lines))
    with np.errstate(over="ignore"):
        place = np.arange(len(words)) - np.repeat(head, np.diff(np.append(head, len(words))))
        value = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), head) if len(head) else hashes[:0]
    out["repeated_lines"] = (count(lines) - count(_runs(lines, value)[0])) / np.maximum(1, count(lines))
    folded = bytes_.copy()
    folded[:, 97:123] += folded[:, 65:91]
    folded[:, 65:91] = 0
    share = folded[:, ~SPACE] / chars[:, None]
    out["byte_entropy"] = np.abs((share * np.log2(np.where(share > 0, share, 1))).sum(1))
    # The worst part of a text: junk may fill the end of a good one.
    place = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words.astype(int)).astype(int)
    parts = np.flatnonzero(place % _PART == 0)
    size = np.diff(np.append(parts, len(words)))
    for name, kind in (("worst_symbols", "symbols"), ("worst_capitals", "capitals")):
        of = np.add.reduceat(_CLASSES[kind][data], at, dtype=np.int64) if len(at) else at
        out[name] = _worst(of, parts, size, words, n)
    out["worst_repeats"] = _worst(same.astype(np.int64), parts, size, words, n)
    return np.stack([out[k] for k in FEATURES], 1)


def _worst(of_word: np.ndarray, parts: np.ndarray, size: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The highest mean of a count by words, among a text's parts of at least half the size."""
    best = np.zeros(n)
    if len(parts):
        rate, long = np.add.reduceat(of_word, parts) / size, size >= _PART // 2
        np.maximum.at(best, words[parts[long]], rate[long])
    return best


@dataclass(frozen=True)
class Model:
    """edges: of each feature's bins; tables: a value for each bin; pairs: two features and a table of two dimensions."""

    intercept: float
    edges: list
    tables: list
    pairs: list

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _edges(v: np.ndarray) -> np.ndarray:
    """Places between values, so that bins hold like numbers of rows; values that many rows share get a bin of their own."""
    values = np.unique(v)
    if len(values) > BINS:
        values = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[int]:
    """Where up to LEAVES - 1 cuts split the bins with most gain."""
    cuts: list[int] = []
    while len(cuts) < LEAVES - 1:
        ends = [0, *sorted(cuts), len(g)]
        best, at = 1e-9, None
        for lo, hi in zip(ends, ends[1:]):
            if hi - lo < 2:
                continue
            a, b, c = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(n[lo:hi])
            gain = a[:-1] ** 2 / (b[:-1] + RIDGE) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + RIDGE) - a[-1] ** 2 / (b[-1] + RIDGE)
            gain[(c[:-1] < MIN_LEAF) | (c[-1] - c[:-1] < MIN_LEAF)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, at = gain[k], lo + k + 1
        if at is None:
            break
        cuts.append(at)
    return sorted(cuts)


def _leaves(g, h, n) -> np.ndarray:
    """A tree's value for each bin."""
    out = np.zeros(len(g))
    ends = [0, *_cuts(g, h, n), len(g)]
    if len(ends) > 2:
        for lo, hi in zip(ends, ends[1:]):
            out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _pair_leaves(g, h, n) -> tuple[np.ndarray, float]:
    """(value for each cell, gain) of the best cut of one feature whose halves are each cut on the other; both orders are tried."""
    best, out = 1e-9, np.zeros_like(g)
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, n))
        up = [np.cumsum(x, 0)[:-1] for x in (a, b, c)]
        for k in range(len(a) - 1):
            gain, value = 0.0, np.zeros_like(a)
            for rows, (gs, hs, ns) in ((slice(0, k + 1), [x[k] for x in up]), (slice(k + 1, None), [x.sum(0) - y[k] for x, y in zip((a, b, c), up)])):
                p, q, r = np.cumsum(gs), np.cumsum(hs), np.cumsum(ns)
                each = p[:-1] ** 2 / (q[:-1] + RIDGE) + (p[-1] - p[:-1]) ** 2 / (q[-1] - q[:-1] + RIDGE)
                each[(r[:-1] < MIN_LEAF) | (r[-1] - r[:-1] < MIN_LEAF)] = -1
                m = int(np.argmax(each)) if len(each) else -1
                if m < 0 or each[m] < 0:
                    gain += p[-1] ** 2 / (q[-1] + RIDGE)
                    value[rows] = p[-1] / (q[-1] + RIDGE)
                else:
                    gain += each[m]
                    value[rows, : m + 1] = p[m] / (q[m] + RIDGE)
                    value[rows, m + 1 :] = (p[-1] - p[m]) / (q[-1] - q[m] + RIDGE)
            if gain > best:
                best, out = gain, value.T if turn else value
    return out, best - g.sum() ** 2 / (h.sum() + RIDGE)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x with labels y, 0 or 1. The same rows give the same model. Without rows, or with one label only, scores are constant."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = [_edges(x[:, j]) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(float(np.log(rate / (1 - rate))), edges, tables, [])
    if y.min(initial=1) == y.max(initial=0):
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            g, h = slopes()
            step = RATE * _leaves(*(np.bincount(b[:, j], w, minlength=len(table)) for w in (g, h, None)))
            table += step
            total += step[b[:, j]]

    def cells(i, j):
        g, h = slopes()
        shape = (len(tables[i]), len(tables[j]))
        at = b[:, i] * shape[1] + b[:, j]
        return [np.bincount(at, w, minlength=shape[0] * shape[1]).reshape(shape).astype(float) for w in (g, h, None)]

    gains = sorted(((_pair_leaves(*cells(i, j))[1], i, j) for i in range(len(tables)) for j in range(i)), key=lambda r: (-r[0], r[1:]))
    pairs = [(i, j, np.zeros((len(tables[i]), len(tables[j])))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS if pairs else 0):
        for i, j, table in pairs:
            step = RATE * _pair_leaves(*cells(i, j))[0]
            table += step
            total += step[b[:, i], b[:, j]]
    return Model(model.intercept, edges, tables, pairs)


def _featured(df: DataFrame, keep: str, kind: str) -> DataFrame:
    """(keep, f) from (keep, text): the features of each row as an array."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=BATCH):
                x = features(*text_buffer(part.column(1)))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], [keep, "f"])

    return df.mapInArrow(run, f"{keep} {kind}, f array<double>")


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """A model of labels (doc_id, quality 0 or 1). At most MAX_LABELLED labelled ids are used, those of least hash; of an id with
    several labels or texts the least counts. Other labels, and ids without a text row, are left out. Features are computed on the executors; the
    driver sees MAX_LABELLED rows of numbers at most."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    known = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by MAX_LABELLED
    known = cut(known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")))
    rows = _featured(known.select(F.struct("doc_id", "quality").alias("label"), "text"), "label", "struct<doc_id: long, quality: int>").collect()
    rows.sort(key=lambda r: r["label"]["doc_id"])
    x = np.array([r["f"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"]["quality"] for r in rows], float))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row (doc_id, text); higher: label 1 is likelier. Null texts count as empty, whose features are zeros;
    null ids and repeated rows are scored like others; other columns are ignored. A row is scored from its whole text alone, without any shuffle; of the
    model, only its tables travel (BINS values a feature, PAIRS tables of BINS by BINS)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=BATCH):
                s = model.scores(features(*text_buffer(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
