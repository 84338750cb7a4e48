"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length one, so a cosine of s is a distance of r = sqrt(2 - 2 s).
Equal vectors of a label become one class first, so groups of copies cost one row.

1. For each length of vectors, coarse centroids and, on the residuals, a codebook for each
   subspace are fitted by k-means on the driver, on at most SAMPLE classes of smallest
   hash, or SAMPLE_A_LIST for each list wanted, up to MOST_SAMPLE. They are small and are
   sent to the tasks; every class is indexed, whatever the sample.
2. Each class is stored in the inverted list of its nearest centroid as a code and the
   length of its residual's remainder. It probes each list whose cell a linked vector
   can be in: where its distance to the plane between the two centroids is at most
   r * min(1, SPREAD / sqrt(dimensions)). Up to SPREAD ** 2 dimensions no link can be
   missed; above, the part of a pair's distance along one given direction exceeds that
   with the chance of SPREAD standard deviations. Tests measure the recall.
3. A list meets its probes in blocks of bounded size. A table of distances from the
   probe's residual to every codeword gives the asymmetric distance to each stored
   code; pairs whose distance is over r plus the stored remainder can't link.
4. The rest are compared by exact cosine in double precision.

Each block's task returns how many vectors each class links with, and a spanning forest
of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.shared import Table

SAMPLE, SAMPLE_A_LIST, MOST_SAMPLE = 20_000, 8, 200_000
SUBSPACES, WORDS, ROUNDS = 8, 64, 6
LIST_ROWS, BLOCK_ROWS = 512, 1024
SLACK, SPREAD = 1e-6, 5.0


@dataclass
class Index:
    coarse: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x words x (dim / subspaces)
    reach: float = 0.0  # how far behind a plane between two lists a linked vector can be

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between the centroids, made where they are needed."""
        square = (self.coarse**2).sum(1)
        return np.sqrt(np.maximum(square[:, None] + square - 2 * self.coarse @ self.coarse.T, 0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "apart"}


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 4096):
            near[lo : lo + 4096] = (-2 * x[lo : lo + 4096] @ centre.T + (centre**2).sum(1)).argmin(1)
        for j in np.unique(near):
            centre[j] = x[near == j].mean(0)
    return centre


def fit_index(x: np.ndarray, lists: int, seed: int = 3) -> Index:
    """Coarse centroids and residual codebooks from a sample of unit vectors, padded to whole subspaces."""
    rng = np.random.default_rng(seed)
    coarse = _k_means(x, lists, rng)
    near = (-2 * x @ coarse.T + (coarse**2).sum(1)).argmin(1)
    rest = (x - coarse[near]).reshape(len(x), SUBSPACES, -1)
    books = [_k_means(rest[:, m], WORDS, rng) for m in range(SUBSPACES)]
    words = max(len(b) for b in books)
    return Index(coarse, np.stack([np.concatenate([b, np.repeat(b[:1], words - len(b), 0)]) for b in books]))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, with zeros up to whole subspaces."""
    x = np.zeros((len(vectors), -(-vectors.shape[1] // SUBSPACES) * SUBSPACES))
    x[:, : vectors.shape[1]] = vectors
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(index: Index, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, length of what the codes leave) of residuals."""
    parts = residual.reshape(len(residual), SUBSPACES, -1)
    codes = np.empty((len(residual), SUBSPACES), np.uint8)
    for m in range(SUBSPACES):
        codes[:, m] = (-2 * parts[:, m] @ index.books[m].T + (index.books[m] ** 2).sum(1)).argmin(1)
    left = parts - index.books[np.arange(SUBSPACES), codes]
    return codes, np.sqrt((left**2).sum((1, 2)))


def probes(index: Index, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest list of each row; row and list of every probe: lists with a plane within the radius)."""
    distance = (x**2).sum(1)[:, None] - 2 * x @ index.coarse.T + (index.coarse**2).sum(1)
    near = distance.argmin(1)
    apart = index.apart[near]
    plane = (distance - distance[np.arange(len(x)), near][:, None]) / np.maximum(2 * apart, 1e-12)
    plane[np.arange(len(x)), near] = 0
    return near, *np.nonzero(plane <= radius + SLACK)


def linked_pairs(index: Index, centre: np.ndarray, probe: np.ndarray, stored: np.ndarray, codes: np.ndarray, left: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(probe row, stored row) of a list's pairs with cosine >= least: table look-ups first, then exact cosine."""
    radius = np.sqrt(max(0.0, 2 - 2 * least))
    out_a, out_b = [], []
    for lo in range(0, len(probe), 128):
        x = probe[lo : lo + 128]
        parts = (x - centre).reshape(len(x), SUBSPACES, 1, -1)
        table = ((parts - index.books[None]) ** 2).sum(3)
        square = sum(table[:, m][:, codes[:, m]] for m in range(SUBSPACES))
        a, b = np.nonzero(np.sqrt(square) <= radius + left[None] + SLACK)
        for s in range(0, len(a), 1 << 16):
            p, q = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            near = (x[p] * stored[q]).sum(1) >= least
            out_a.append(p[near] + lo)
            out_b.append(q[near])
    join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return join(out_a), join(out_b)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (node, least node reachable) of the components of the links a - b, without the roots."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(names))
    return np.stack([names[keep], names[label[keep]]], 1).reshape(-1, 2)


def _meet(indexes: dict[int, Index], least: float):
    """A block's task. Returns kind 0 (class, vectors of other classes linked) and kind 1 (class, class): a spanning forest."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["v"].to_list())
        stored, node, times = pdf["stored"].to_numpy(), pdf["node"].to_numpy(), pdf["times"].to_numpy()
        index = indexes[key[1]]
        centre = index.coarse[key[2]]
        own, probing = vectors[stored], vectors[~stored]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(own) and len(probing):
            codes, left = encode(index, own - centre)
            a, b = linked_pairs(index, centre, probing, own, codes, left, least)
        a, weight, b = node[~stored][a], times[stored][b], node[stored][b]
        keep = a != b
        a, b, weight = a[keep], b[keep], weight[keep]
        who, at = np.unique(a, return_inverse=True)
        count = np.bincount(at, weight, len(who)).astype(np.int64)
        forest = spanning(a, b)
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int8), [len(who), len(forest)]), "x": np.concatenate([who, forest[:, 0]]), "y": np.concatenate([count, forest[:, 1]])})

    return run


def _fitted(classes: DataFrame, largest: int, sample: int, least: float) -> Index:
    """The index for classes of one length, of whose labels the largest has `largest`."""
    lists = max(1, largest // LIST_ROWS)
    picked = classes.orderBy("key").limit(min(max(sample, SAMPLE_A_LIST * lists), MOST_SAMPLE)).select("v").toArrow()["v"].combine_chunks()
    x = unit_rows(picked.flatten().to_numpy(zero_copy_only=False).reshape(len(picked), -1))
    index = fit_index(x, min(lists, max(1, len(x) // SAMPLE_A_LIST)))
    index.reach = float(np.sqrt(max(0.0, 2 - 2 * least))) * min(1.0, SPREAD / len(picked[0]) ** 0.5)
    return index


def link_embeddings(vectors: DataFrame, least: float = 0.98, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (least id reachable, itself included), kept (id = component_id).

    Rows of equal, not null labels and equal length link at a cosine of `least` or
    more, in double precision. Null, empty and zero vectors and those with null or
    non-finite components link with nothing. Rows of equal ids count as rows of their
    own; a null id is never the least while another is there; other columns are
    ignored; an empty table gives none.
    """
    wide = F.transform(vector_col, lambda e: e.cast("double"))
    fine = F.col(label_col).isNotNull() & F.coalesce(F.forall(wide, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(wide, lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(id_col), F.col(label_col).alias("label"), F.when(fine, F.transform(wide, lambda e: e + F.lit(0.0))).alias("v"))
    # a class: the rows of one label and one vector; negative zero became zero
    named = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    classes = named.filter("key is not null").groupBy("key").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("times"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = Table(classes.withColumns({"node": F.monotonically_increasing_id(), "length": F.size("v")}), "classes")
    kinds = classes.df.groupBy("label", "length").count().groupBy("length").agg(F.max("count").alias("largest")).collect()  # links stay inside labels
    linked = None
    if kinds:
        indexes = {k.length: _fitted(classes.df.filter(F.col("length") == k.length), k.largest, sample, least) for k in kinds}

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.array(batch.column(3).value_lengths())
                flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                begin = np.cumsum(lengths) - lengths
                for length in np.unique(lengths).tolist():
                    every, index = np.flatnonzero(lengths == length), indexes[length]
                    for at in np.array_split(every, -(-len(every) // 512)):
                        unit = unit_rows(flat[begin[at][:, None] + np.arange(length)])
                        near, who, where = probes(index, unit, index.reach)
                        row = np.concatenate([np.arange(len(at)), who])
                        stored = np.repeat([True, False], [len(at), len(who)])
                        line = np.concatenate([near, where]).astype(np.int32)
                        take = pa.array(at[row])
                        columns = [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(np.full(len(row), length, np.int32)), pa.array(line), pa.array(stored), pa.array(list(unit[row]), pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["label", "node", "times", "length", "list", "stored", "v"])

        kind = vectors.schema[label_col].dataType.simpleString()
        assigned = Table(classes.df.select("label", "node", "times", "v").mapInArrow(assign, f"label {kind}, node long, times long, length int, list int, stored boolean, v array<double>"), "assigned")
        counts = assigned.df.groupBy("label", "length", "list").agg(F.ceil(F.count_if("stored") / BLOCK_ROWS).cast("int").alias("own"), F.ceil(F.count_if(~F.col("stored")) / BLOCK_ROWS).cast("int").alias("others"))
        dealt = assigned.df.join(counts, ["label", "length", "list"]).filter("own > 0")
        mine = F.pmod(F.xxhash64("node"), F.when(F.col("stored"), F.col("own")).otherwise(F.col("others"))).cast("int")
        # a block of stored rows meets every block of probing rows of its list
        spread = F.sequence(F.lit(0), F.when(F.col("stored"), F.col("others")).otherwise(F.col("own")) - 1)
        dealt = dealt.filter("others > 0").select("label", "length", "list", "node", "times", "stored", "v", mine.alias("mine"), F.explode(spread).alias("other"))
        dealt = dealt.withColumn("block", F.when(F.col("stored"), F.struct(F.col("mine").alias("s"), F.col("other").alias("p"))).otherwise(F.struct(F.col("other").alias("s"), F.col("mine").alias("p")))).drop("mine", "other")
        linked = Table(dealt.groupBy("label", "length", "list", "block").applyInPandas(_meet(indexes, least), "kind byte, x long, y long"), "linked")
        assigned.drop()

    by_key = classes.df.select("key", "node", "first", "times")
    if linked is not None:
        degree = linked.df.filter("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("others"))
        tree = components(linked.df.filter("kind = 1").select(F.col("x").alias("u"), F.col("y").alias("v")))
        by_key = by_key.join(degree, "node", "left").join(tree.df, "node", "left")
        by_key = Table(by_key.select("key", "first", F.coalesce("component", "node").alias("component"), (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "by_key").df
    else:
        by_key = by_key.select("key", "first", F.col("node").alias("component"), (F.col("times") - 1).alias("n_links"))
    best = by_key.groupBy("component").agg(F.min("first").alias("component_id"))
    found = by_key.join(best, "component").select("key", "component_id", "n_links")
    if linked is not None:
        linked.drop()
    out = named.select(id_col, "key").join(found, "key", "left")
    component = F.coalesce("component_id", id_col)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept"))
