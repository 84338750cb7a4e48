"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to). On the driver, which holds one row a pattern, a flow routes each pattern's
words to the quotas of its sources; a further repetition of the same words costs more
than the one before it, so nothing repeats while unseen words can fill a quota. As only
repetitions cost, the cheapest path to a quota is one that starts with the lowest
repetition still open: a maximal flow for each repetition in turn, on top of the last,
costs least. What a pattern has to give is then met by documents in seeded order: buckets
of the seed's hash below the border are taken whole, and single documents decide only
inside the border bucket, so no task ever sorts a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import Table
from corvane.llm.textbuf import blocks, text_array, word_bounds

#: Most patterns whose plan is broadcast; beyond, it is joined as a table.
BROADCAST_PATTERNS = 20_000
DOCS_PER_BUCKET = 1024
#: Patterns whose border buckets one task settles, one after the other.
BORDERS = 512


def word_counts(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns named and size: the number of words (runs of anything but 0x20, 0x09-0x0D) of the whole text; null is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.diff(word_bounds(data, offs)[2]) for _, _, data, offs in blocks(text_array(batch.column(len(columns))))]
            size = pa.array(np.concatenate(found).astype(np.int64) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], size], names=[*columns, "size"])

    shape = T.StructType([docs.schema[c] for c in columns] + [T.StructField("size", T.LongType())])
    return docs.select(*columns, text_col).mapInArrow(run, shape)


def water_fill(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """Share total by weight; shares stop at their caps, and the excess is shared again until none is above."""
    share, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > caps[i]]
        for i in over or open_:
            share[i] = caps[i] if over else unit * weights[i]
        if not over:
            break
        left -= sum(caps[i] for i in over)
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return share


class _Flow:
    """A maximal flow that grows with its capacities, by blocking flows along shortest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def edge(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def _levels(self, start: int, end: int) -> list[int] | None:
        level = [-1] * len(self.out)
        level[start], now = 0, [start]
        while now and level[end] < 0:
            after = []
            for a in now:
                for e in self.out[a]:
                    if self.cap[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        after.append(self.to[e])
            now = after
        return level if level[end] >= 0 else None

    def run(self, start: int, end: int) -> None:
        to, cap, out = self.to, self.cap, self.out
        while (level := self._levels(start, end)) is not None:
            at, path, node = [0] * len(out), [], start
            while True:
                if node == end:
                    amount = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= amount
                        cap[e ^ 1] += amount
                    cut = next(i for i, e in enumerate(path) if not cap[e])
                    node = to[path[cut] ^ 1]
                    del path[cut:]
                elif at[node] < len(out[node]):
                    e = out[node][at[node]]
                    if cap[e] and level[to[e]] == level[node] + 1:
                        path.append(e)
                        node = to[e]
                    else:
                        at[node] += 1
                elif node == start:
                    break
                else:
                    node = to[path.pop() ^ 1]
                    at[node] += 1


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], max_copies: int) -> list[int]:
    """Words each pattern gives: a maximal flow of least cost, the k-th repetition of a word costing k - 1."""
    n_p, n_s = len(supply), len(quota)
    end = n_p + n_s + 1
    flow = _Flow(end + 1)
    gives = [flow.edge(0, 1 + p, 0) for p in range(n_p)]
    for p, sources in enumerate(members):
        for s in sources:
            flow.edge(1 + p, 1 + n_p + s, max_copies * supply[p])
    for s in range(n_s):
        flow.edge(1 + n_p + s, end, quota[s])
    for _ in range(max_copies):
        for e, n in zip(gives, supply, strict=True):
            flow.cap[e] += n
        flow.run(0, end)
    return [flow.cap[e ^ 1] for e in gives]


def words_given(supply: list[int], members: list[list[int]], quota: list[int], max_copies: int) -> list[int]:
    """As min_cost_flow(); a pattern that alone has its only source needs no flow, so that is solved for the others only."""
    users = [0] * len(quota)
    for sources in members:
        for s in sources:
            users[s] += 1
    given = [min(quota[m[0]], max_copies * n) if len(m) == 1 and users[m[0]] == 1 else 0 for n, m in zip(supply, members, strict=True)]
    rest = [p for p, m in enumerate(members) if not (len(m) == 1 and users[m[0]] == 1)]
    number = {s: i for i, s in enumerate(sorted({s for p in rest for s in members[p]}))}
    flow = min_cost_flow([supply[p] for p in rest], [[number[s] for s in members[p]] for p in rest], [quota[s] for s in number], max_copies)
    for p, n in zip(rest, flow, strict=True):
        given[p] = n
    return given


def _fill_borders(columns: list[str], id_col: str):
    """Documents of some patterns' border buckets: in seeded order those that still fit, then one more if that comes nearer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_pattern", "_hash", id_col, "size"], kind="stable").reset_index(drop=True)
        size, pattern = pdf["size"].to_numpy(), pdf["_pattern"].to_numpy()
        left_of, take = (pdf["_rest"] - pdf["_before"]).to_numpy(), np.zeros(len(pdf), np.int32)
        edges = np.flatnonzero(pattern[1:] != pattern[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pdf)], strict=True):
            left = int(left_of[a])
            for i, n in enumerate(size[a:b].tolist(), a):
                if 0 < n <= left:
                    take[i] = 1
                    left -= n
            open_ = np.flatnonzero((take[a:b] == 0) & (size[a:b] > 0)) + a
            if len(open_) and size[open_].min() < 2 * left:
                take[open_[size[open_].argmin()]] = 1
        return pdf[columns].assign(_take=take)

    return run


def mix_sources(docs: DataFrame, weights: list[float], share: float, max_copies: int = 2, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Decide how many words of each document a mix takes.

    The source column is a string, or an array of strings for documents of several
    sources. Sources in code point order, null last, get the weights in turn and
    share `share` times all words; a target stops at max_copies times the words of
    its source. Returns per row: id, the source column, size, source_size (largest
    of its sources), target (of that source), taken (a multiple of size, at most
    max_copies times). Null text has size 0 and takes 0; null is a source of its
    own; repeated rows are documents of their own; an empty table gives none. The
    driver holds one row a pattern, of any number of them.
    """
    is_array = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    sources = F.coalesce(F.array_distinct(F.sort_array(source_col)), F.array(F.lit(None).cast("string"))) if is_array else F.array(F.col(source_col).cast("string"))
    hashed = docs.select(id_col, source_col, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_hash"), text_col)
    sized = word_counts(hashed, [id_col, source_col, "_hash"], text_col)
    table = Table(sized.select(id_col, source_col, "size", sources.alias("_members"), F.to_json(sources).alias("_pattern"), "_hash"), "sized")
    found = table.df.groupBy("_pattern").agg(F.first("_members").alias("m"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    names = sorted({s for r in found for s in r.m}, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    number = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for r in found:
        for s in r.m:
            size[number[s]] += r.words
    total = sum(r.words for r in found)
    target = water_fill(share * total, [float(weights[i % len(weights)]) for i in range(len(names))], [float(max_copies * x) for x in size])
    given = words_given([r.words for r in found], [[number[s] for s in r.m] for r in found], [round(t) for t in target], max_copies)
    rows = []
    for r, words in zip(found, given, strict=True):
        best = max((number[s] for s in r.m), key=lambda i: size[i], default=None)
        whole, rest = divmod(words, r.words) if r.words else (0, 0)
        rows.append((r._pattern, None if best is None else size[best], None if best is None else target[best], int(whole), int(rest)))
    spark = docs.sparkSession
    small = F.broadcast if len(found) <= BROADCAST_PATTERNS else lambda df: df
    plan = small(spark.createDataFrame(rows, "_pattern string, source_size long, target double, _whole long, _rest long"))

    n_buckets = 1 << (sum(r.docs for r in found) // DOCS_PER_BUCKET).bit_length()
    rows_in = table.df.withColumn("_bucket", F.pmod("_hash", F.lit(n_buckets)))
    in_order = Window.partitionBy("_pattern").orderBy("_bucket")
    upto = rows_in.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("_words")).withColumn("_before", F.sum("_words").over(in_order) - F.col("_words"))
    border = upto.join(plan, "_pattern").filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words")))
    border = small(border.select("_pattern", F.col("_bucket").alias("_border"), "_before"))  # one row a pattern
    placed = rows_in.join(plan, "_pattern").join(border, "_pattern", "left")
    above = F.col("_bucket") > F.col("_border")
    columns = [id_col, source_col, "size", "source_size", "target"]
    plain = placed.filter(F.col("_border").isNull() | (F.col("_bucket") != F.col("_border"))).withColumn("_take", F.when(F.col("_border").isNull() | above, 0).otherwise(1))
    shape = T.StructType([placed.schema[c] for c in [*columns, "_whole"]] + [T.StructField("_take", T.IntegerType())])
    deal = F.pmod(F.xxhash64("_pattern"), F.lit(1 + len(found) // BORDERS)).alias("_deal")
    inside = placed.filter(F.col("_bucket") == F.col("_border")).groupBy(deal).applyInPandas(_fill_borders([*columns, "_whole"], id_col), shape)
    return plain.select(*columns, "_whole", "_take").unionByName(inside).select(*columns, (F.col("size") * (F.col("_whole") + F.col("_take"))).alias("taken"))
