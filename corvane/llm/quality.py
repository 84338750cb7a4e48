"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in numpy over whole texts. Trees are complete binary trees
of fixed depth, stored as flat arrays (feature and border of every inner node, value
of every leaf), so a block of rows descends all trees a level at a time.
The model is fitted on the driver, on at most SAMPLE labelled rows of smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.textbuf import blocks, runs, span_hashes, text_array, word_bounds

SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, L2 = 64, 4, 80, 0.2, 1.0
_CLASSES = 12


def _byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 space, 4 line break, 5 other blank, 6 stop, 7 comma and the like, 8 bracket or quote, 9 symbol, 10 first byte of other characters, 11 further bytes."""
    kind = np.full(256, 9, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[32], kind[10] = 0, 1, 2, 3, 4
    kind[[9, 11, 12, 13]] = 5
    for chars, n in ((b".!?", 6), (b",;:-", 7), (b"()[]{}'\"", 8)):
        kind[list(chars)] = n
    kind[128:192], kind[192:] = 11, 10
    return kind


_KIND = _byte_classes()
_ENDER = np.zeros(256, bool)
_ENDER[list(b".!?")] = True
N_FEATURES = _CLASSES + 16


def _per_row(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return upto[before[1:]] - upto[before[:-1]]


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES statistics for each text; an empty text has zeros."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    x = np.zeros((n, N_FEATURES))
    row = np.repeat(np.arange(n), np.diff(offs))
    x[:, :_CLASSES] = np.bincount(row * _CLASSES + _KIND[data], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, before = word_bounds(data, offs)
    words = np.diff(before).astype(float)
    some = np.maximum(words, 1)
    h = span_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    kind_first, kind_last = (_KIND[data[starts]], _KIND[data[ends - 1]]) if len(starts) else (np.zeros(0, int), np.zeros(0, int))
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = h[1:] == h[:-1]
        same[before[:-1][before[:-1] < len(h)]] = 0
    mean = _per_row(length, before) / some
    c = _CLASSES
    x[:, c] = np.log1p(size)
    x[:, c + 1] = np.log1p(words)
    x[:, c + 2] = mean
    x[:, c + 3] = np.sqrt(np.maximum(_per_row(length**2, before) / some - mean**2, 0))
    x[:, c + 4] = _per_row(same, before) / some
    x[:, c + 5] = _per_row(kind_first == 1, before) / some
    x[:, c + 6] = _per_row(kind_last == 9, before) / some
    x[:, c + 7] = _per_row(kind_last == 6, before) / some
    x[:, c + 8] = _per_row(kind_last == 7, before) / some
    x[:, c + 9] = _per_row(length == 1, before) / some
    line_s, line_e, lines = runs(data != 10, offs)
    x[:, c + 10] = np.diff(lines) / some
    line_h = span_hashes(data, line_s, line_e)
    for i in range(n):
        a, b = before[i], before[i + 1]
        if b > a:
            _, times = np.unique(h[a:b], return_counts=True)
            x[i, c + 11] = len(times) / (b - a)
            x[i, c + 12] = times.max() / (b - a)
            x[i, c + 13] = len(times) / np.sqrt(b - a)
            x[i, c + 14] = length[a:b].max()
        a, b = lines[i], lines[i + 1]
        if b > a:
            x[i, c + 15] = len(np.unique(line_h[a:b])) / (b - a)
    return x


@dataclass
class Trees:
    """Boosted trees as flat arrays: inner nodes in level order, then leaves."""

    feature: np.ndarray  # trees x (2 ** depth - 1)
    border: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, b, v in zip(self.feature, self.border, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees of depth DEPTH on binned features under logistic loss; with one class or no rows, a constant."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    inner, features = 2**DEPTH - 1, x.shape[1]
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    borders = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(features)]
    binned = np.stack([np.searchsorted(borders[j], x[:, j], side="left") for j in range(features)])
    total = np.full(len(y), base)
    feature, border, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        f, b, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best, choice = np.full(width, 1e-6), [(0, -1)] * width
            for j in range(features):
                slot = (node - first) * BINS + binned[j]
                g = np.bincount(slot, grad, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(slot, hess, width * BINS).reshape(width, BINS).cumsum(1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + L2) + rest_g**2 / (rest_h + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(h < 1) | (rest_h < 1)] = 0
                gain[:, len(borders[j]) :] = 0
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[k], choice[k] = gain[k, at[k]], (j, int(at[k]))
            for k, (j, at) in enumerate(choice):
                if at >= 0:
                    f[first + k], b[first + k] = j, borders[j][at]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > b[node])
        slot = node - inner
        value = RATE * np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + L2)
        total += value[slot]
        feature.append(f)
        border.append(b)
        leaf.append(value)
    return Trees(np.array(feature), np.array(border), np.array(leaf), base)


def _mapped(docs: DataFrame, keep: list[str], text_col: str, make, shape: str) -> DataFrame:
    place = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [make(statistics(data, offs)) for _, _, data, offs in blocks(text_array(batch.column(place)))]
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.concat_arrays([p[i] for p in parts]) for i in range(len(parts[0])))], names=[*keep, *(f"_{i}" for i in range(len(parts[0])))])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, f"{kinds}, {shape}")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on the labelled documents of smallest id hash, at most `sample`; of several labels of an id the least counts, null ones none."""
    known = labels.select(id_col, F.col(label_col).cast("double").alias("_y")).filter(F.col(id_col).isNotNull() & F.col("_y").isNotNull())
    chosen = known.groupBy(id_col).agg(F.min("_y").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most `sample` rows
    got = _mapped(rows, [id_col, "_y"], text_col, lambda x: [pa.array(list(x), pa.list_(pa.float64()))], "_0 array<double>").drop(id_col).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    x = np.array(got["_0"].to_pylist())
    y = (got["_y"].to_numpy() > 0.5).astype(float)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Trees, keep: list[str] | None = None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns to keep, score (0 to 1) and predicted (1 if score >= threshold) of every row.

    Null text is empty text, which has the score of zero statistics. Only the text
    makes the score; ids may repeat or be null; an empty table gives none.
    """
    keep = ["doc_id"] if keep is None else keep

    def make(x: np.ndarray) -> list[pa.Array]:
        score = model.score(x)
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return _mapped(docs, keep, text_col, make, "_0 double, _1 int").withColumnsRenamed({"_0": "score", "_1": "predicted"})
