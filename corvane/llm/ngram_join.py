"""N-gram Jaccard join: a size-aware heavy-light join over shingle sets.

Two sets of n <= m shingles reach the threshold t only if they share at least
c(n, m) = ceil(t (n + m) / (1 + t)) of them. Light sets (up to a size that a cost model
chooses) list all their subsets of c(n, m) elements, for each c that a partner can
ask for: two light sets link exactly where they list the same subset. Heavy sets meet
in inverted lists of shingles: in any order of all shingles, linked sets share one of
their first n - ceil(t n) + 1. The order here puts a share of the shingles, picked by
hash, first, the rarer before the more common ones; an exchange of four bytes a shingle
of that share tells in how many parts of the table each occurs. A set whose first
shingles occur nowhere else can't link, and enters no list.

Sets that meet are gathered by group (connected keys) in bounded chunks. A chunk's
task builds the inverted lists of its shingles and scans those of one set after the
other: one scan counts a set's overlap with every set of the chunk, and settles all
its links. Only sets outside the chunk's largest component are scanned. A group of
several chunks is split first, by inverted lists of parts of sets: two linked sets
differ in at most d shingles, so of more than d parts into which a hash deals the
shingles, one part or more is equal in both. Several hashes in turn connect ever fewer
sets that don't link. What still has several chunks carries one pivot set to every
chunk, and afterwards the sets that aren't linked to the pivot, so no pair across
chunks is left out. A task holds a chunk; visiting sets pass by in runs of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import ceil, comb, exp, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.exchange import bucket_bits, many_owners, pack_parts, read_found, shared_keys, unpack
from corvane.llm.shared import Table, arrow_batches, release
from corvane.llm.textbuf import U64, blocks, mix, ragged, shingle_sets

CHUNK_BYTES = 6 << 20
#: Cost of one list entry of a heavy set against one listed subset: its scan touches the list, its set travels.
HEAVY_ENTRY = 2.0
#: Hashes by whose parts a group of several chunks is split, one after the other.
SPLITS = 3
SALT = U64(0x2545F4914F6CDD1D)
EPS = 1e-9


def least_common(n: int, m: int, t: float) -> int:
    """The smallest overlap with which sets of n and m elements have a Jaccard similarity of t."""
    return ceil(t * (n + m) / (1 + t) - EPS)


def partner_sizes(n: int, t: float) -> range:
    """Sizes m that a set of n elements can link with."""
    return range(max(1, ceil(t * n - EPS)), floor(n / t + EPS) + 1)


@cache
def subset_sizes(n: int, light: int, t: float) -> tuple[tuple[int, int, int], ...]:
    """(c, smaller size, larger size) for the partners of a set of n with which the smaller size is light; equal sets aside."""
    return tuple((least_common(n, m, t), min(n, m), max(n, m)) for m in partner_sizes(n, t) if min(n, m) <= light and least_common(n, m, t) <= min(n, m) and not (n == m and least_common(n, m, t) >= n))


def prefix_size(n: int, t: float) -> int:
    """How many first shingles of a heavy set enter lists."""
    return n - ceil(t * n - EPS) + 1


def first_share(t: float) -> float:
    """The share of shingles that come first: enough that a set with some shingles of its own has all it needs among them."""
    return min(1.0, max(0.5, 2 * (1 - t) + 0.05))


@cache
def light_limit(t: float) -> int:
    """The largest size whose subsets cost no more than its block entries; sizes below are light too."""
    light = 0
    for n in range(1, 200):
        if sum(comb(n, c) for c, *_ in {(c, a, b) for c, a, b in subset_sizes(n, n, t)}) > HEAVY_ENTRY * (prefix_size(n, t) + n / 2):
            break
        light = n
    return light


def _subset_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """A hash of every subset of the given size: the sum over its elements, by leaving out the others."""
    left = np.array([items.sum(dtype=U64)])
    last = np.array([-1])
    for _ in range(len(items) - size):
        times = len(items) - 1 - last
        who, drop = np.repeat(np.arange(len(left)), times), ragged(last + 1, times)
        left, last = left[who] - items[drop], drop
    return left


def subset_keys(items: np.ndarray, light: int, t: float) -> np.ndarray:
    """The keys of the subsets that a set lists: if it or a partner is light, and of itself."""
    n = len(items)
    scrambled = mix(items)
    tag = lambda h, *about: mix(h + U64(hash(about) & (1 << 64) - 1))
    keys = [tag(scrambled.sum(dtype=U64, keepdims=True), 1, n)] if n <= light else []
    keys += [np.unique(tag(_subset_hashes(scrambled, c), 2, c, small, large)) for c, small, large in subset_sizes(n, light, t)]
    return np.concatenate(keys) if keys else np.zeros(0, U64)


@cache
def band_edges(t: float) -> np.ndarray:
    """Least sizes of bands such that linked sets are of one band or of two that are neighbours."""
    edges = [1]
    while edges[-1] < 1 << 32:
        edges.append(floor(edges[-1] / t + EPS) + 1)
    return np.array(edges)


def piece_keys(items: np.ndarray, t: float, seed: int) -> np.ndarray:
    """The keys of a set's pieces; linked sets have one in common.

    For the sets of two neighbouring bands a hash deals shingles into more pieces than
    linked ones can differ in, with `spare` pieces more: a set with no more empty pieces
    than that shares another one, so only sets with more of them list those.
    """
    edges = band_edges(t)
    scrambled = mix(items ^ mix(np.array([seed + 1], U64)))
    band = int(np.searchsorted(edges, len(items), "right")) - 1
    keys = []
    for low in range(max(0, band - 1), band + 1):
        least, most = int(edges[low]), int(edges[low + 2]) - 1
        needed = floor(2 * most * (1 - t) / (1 + t) + EPS) + 1
        spare = 1 + int(2 * needed * exp(-least / needed))
        piece = (scrambled % U64(needed + spare)).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        head = np.flatnonzero(np.diff(piece[order], prepend=-1))
        content = np.zeros(needed + spare, U64)
        content[piece[order][head]] = np.add.reduceat(mix(scrambled ^ SALT)[order], head)
        listed = np.arange(needed + spare) if needed + spare - len(head) > spare else piece[order][head]
        keys.append(mix(content[listed] + mix(listed.astype(U64) + U64(low << 40))))
    return np.concatenate(keys)


def meetings(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and row, which come first of their key in it, pairs of a row and the least of one of its keys)."""
    order = np.lexsort([row, key])
    key, row = key[order], row[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    pivot = row[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))] if len(key) else row
    return order, head, np.unique(np.stack([row, pivot], 1)[row != pivot], axis=0).reshape(-1, 2)


class PartSets:
    """The sets of a part's texts, equal ones once: `rep` of each row is the first row with its set (-1 without words)."""

    def __init__(self, ids: pa.Array, text: pa.Array, words: int):
        self.sets = [s for _, _, data, offs in blocks(text, 1 << 18) for s in shingle_sets(data, offs, words)]
        seen: dict[bytes, int] = {}
        self.rep = np.array([seen.setdefault(s.tobytes(), i) if len(s) else -1 for i, s in enumerate(self.sets)], np.int64)
        self.first = np.flatnonzero(self.rep == np.arange(len(self.sets)))

    def light(self, light: int, t: float) -> tuple[np.ndarray, np.ndarray]:
        """(keys, row) of the subsets that the distinct sets list."""
        rows = [i for i in self.first if t * len(self.sets[i]) <= light + 1]
        lists = [subset_keys(self.sets[i], light, t) for i in rows]
        return np.concatenate([np.zeros(0, U64), *lists]), np.repeat(np.array(rows, np.int64), [len(k) for k in lists])

    def heavy(self, light: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, row, comes first) of the shingles of the distinct heavy sets."""
        rows = [i for i in self.first if len(self.sets[i]) > light]
        keys = mix(np.concatenate([np.zeros(0, U64), *(self.sets[i] for i in rows)]) ^ SALT)
        first = keys < U64(min((1 << 64) - 1, int(first_share(t) * 2.0**64)))
        return keys, np.repeat(np.array(rows, np.int64), [len(self.sets[i]) for i in rows]), first

    def exchanged(self, light: int, t: float) -> np.ndarray:
        keys, _, first = self.heavy(light, t)
        return np.concatenate([self.light(light, t)[0], keys[first]])

    def lists(self, light: int, t: float, found: list | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, row, may be in other parts) of the lists that the distinct sets enter."""
        small, small_row = self.light(light, t)
        keys, row, first = self.heavy(light, t)
        known = read_found(found, np.concatenate([small, keys[first]]), bits, levels=True)
        level = np.zeros(len(keys), np.int64)
        level[first] = known[len(small) :]
        lone = first & (level == 0)
        level[lone] += many_owners(keys[lone], row[lone])  # in this part alone: before those of two parts
        level[first & (level > 0) & ~lone] += 1
        size = np.array([len(s) for s in self.sets], np.int64)
        need = np.array([prefix_size(n, t) for n in size.tolist()], np.int64)
        nowhere = np.bincount(row[first & (level == 0)], minlength=len(size))
        need -= nowhere  # the rarest come first, and enter no list
        use = np.flatnonzero((need[row] > 0) & (~first | (level > 0)))
        order = use[np.lexsort([keys[use], level[use], ~first[use], row[use]])]
        head = np.ones(len(order), bool)
        head[1:] = row[order][1:] != row[order][:-1]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        taken = order[place < need[row[order]]]
        outside = np.concatenate([known[: len(small)] > 0, ~first[taken] | (level[taken] > 1)])
        return np.concatenate([small, keys[taken]]), np.concatenate([small_row, row[taken]]), outside


def settle(sets: list[np.ndarray], t: float, scan: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of the connected components of sets that link at Jaccard t.

    Scans the inverted lists of one set after the other, leaving out those that the
    first set's component already holds, or only of the sets in `scan`; `label` is what
    is known already.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(n) if label is None else label
    _, first, known = np.unique(label, return_index=True, return_inverse=True)
    parent, left = first[known], len(first)  # a forest: of each set a set of its component, nearer to the component's root

    def roots(at: np.ndarray) -> np.ndarray:
        above = parent[at]
        while (parent[above] != above).any():
            above = parent[above]
        parent[at] = above
        return above

    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(element, kind="stable")
    start = np.searchsorted(element[order], np.arange(int(element.max()) + 2 if len(element) else 1))
    owner_of = owner[order]
    begin = np.cumsum(size) - size
    for i in range(n) if scan is None else scan:
        if left == 1:
            break
        if scan is None and i and np.ptp(roots(np.array([0, i]))) == 0:
            continue
        mine = element[begin[i] : begin[i] + size[i]]
        meets = owner_of[ragged(start[mine], start[mine + 1] - start[mine])]
        if len(meets) < n // 4:  # work as large as the lists, not as the chunk
            who, common = np.unique(meets, return_counts=True)
        else:
            common = np.bincount(meets, minlength=n)
            who = np.flatnonzero(common)
            common = common[who]
        linked = who[common >= t * (size[i] + size[who] - common) - EPS * size[who]]
        together = np.unique(roots(linked))
        parent[together] = together[0]
        left -= len(together) - 1
    return label[roots(np.arange(n))]


def _settled_groups(t: float):
    """Round one: (node, label) of each set, groups of a task one by one; visiting pivots keep their own label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grp", "node"], kind="stable")
        groups, nodes = pdf["grp"].to_numpy(), pdf["node"].to_numpy()
        sets = [np.frombuffer(b, U64) for b in pdf["items"]]
        edge = np.flatnonzero(np.diff(groups)) + 1
        out = np.empty(len(pdf), np.int64)
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(pdf)], strict=True):
            label = settle(sets[a:b], t)
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, label, nodes[a:b])  # the pivot is the group's least node
            out[a:b] = least[label]
        return pd.DataFrame({"grp": groups, "node": nodes, "label": out, "chunks": pdf["chunks"].to_numpy(), "visitor": pdf["visitor"].to_numpy()})[lambda d: ~d["visitor"]].drop(columns="visitor")

    return run


def _visits(t: float, most: int):
    """Round two: links (u, v) of labels between a chunk's sets and the visiting ones.

    Rows (grp, chunk, visitor, label, items) come by group and chunk, a chunk's own sets
    first; those are held, and visitors pass by in runs of `most` bytes.
    """

    def links(label: list[int], items: list[bytes], own: int) -> pa.RecordBatch:
        names, known = np.unique(np.array(label), return_inverse=True)
        after = settle([np.frombuffer(b, U64) for b in items], t, np.arange(own, len(items)), known)
        joined = np.unique(np.stack([names[known], names[after]], 1), axis=0)
        joined = joined[joined[:, 0] != joined[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(joined[:, 0]), pa.array(joined[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held = None, 0, 0
        label: list[int] = []
        items: list[bytes] = []
        for batch in batches:
            for grp, chunk, visitor, of, one in zip(*(batch.column(i) for i in range(5)), strict=True):
                if (here := (grp.as_py(), chunk.as_py())) != at or held >= most:
                    if len(items) > own:
                        yield links(label, items, own)
                    at, own, held = here, own if here == at else 0, 0
                    del label[own:], items[own:]
                label.append(of.as_py())
                items.append(one.as_py())
                if visitor.as_py():
                    held += len(items[-1])
                else:
                    own += 1
        if len(items) > own:
            yield links(label, items, own)

    return run


def _connected(met: DataFrame) -> Table:
    """(node, component) of the nodes of (kind, x, y): kind 1 are two nodes that meet, kind 2 a key and a node that lists it."""
    lists = met.filter("kind = 2").select(F.col("x").alias("key"), F.col("y").alias("node"))
    pivots = lists.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    across = lists.join(pivots, "key").filter("node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    return components(met.filter("kind = 1").select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(across))


def _with_chunks(members: DataFrame, group: str, size: Column) -> DataFrame:
    """Adds the number of chunks that the sets of each group fill."""
    return members.join(members.groupBy(group).agg(F.ceil(F.sum(size) / CHUNK_BYTES).cast("int").alias("chunks")), group)


def _split(sets: Table, t: float) -> list[Table]:
    """Tables of sets (grp, node, chunks, items): the sets themselves, and groups of several chunks in a table split by equal pieces in the next one; a set that meets none goes."""

    def lists(seed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, node = (batch.column(i).to_numpy() for i in range(2))
                made = [piece_keys(np.frombuffer(b.as_py(), U64), t, seed) for b in batch.column(2)]
                row = np.repeat(np.arange(len(made)), [len(k) for k in made])
                key = mix(np.concatenate([np.zeros(0, U64), *made]) ^ mix(group.view(U64))[row])
                order, head, local = meetings(key, row)
                kind = np.repeat(np.array([1, 2], np.int8), [len(local), int(head.sum())])
                x = np.concatenate([node[local[:, 0]], key[order][head].view(np.int64)])
                y = np.concatenate([node[local[:, 1]], node[row[order][head]]])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], names=["kind", "x", "y"])

        return run

    tables = [sets]
    for seed in range(SPLITS):
        large = tables[-1].df.filter("chunks > 1")
        with arrow_batches(large.sparkSession, CHUNK_BYTES):
            met = Table(large.select("grp", "node", "items").mapInArrow(lists(seed), "kind byte, x long, y long"), "met")
        groups = _connected(met.df)
        parted = large.select("node", "items").join(groups.df.select("node", F.col("component").alias("grp")), "node")
        tables.append(Table(_with_chunks(parted, "grp", F.length("items")).select(*sets.schema.names), "sets"))
        met.drop()
        groups.drop()
        if tables[-1].df.filter("chunks > 1").isEmpty():
            break
    return tables


def jaccard_components(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles (distinct shingles) and component_id, the smallest id reachable by links, itself included.

    Words are the runs of bytes other than 0x20 and 0x09-0x0D after A-Z became lower
    case; a text of fewer words is one shingle; null or empty text has none and links
    with nothing. Rows link at a Jaccard similarity of the threshold or more, equal
    sets too. Rows of equal ids are documents of their own that share an id; a null id
    is never the smallest while another is there. Ids are integers, other columns are
    ignored, an empty table gives none.
    """
    t, light = threshold, light_limit(threshold)
    parts = pack_parts(docs, id_col, text_col)
    bits = bucket_bits(parts, 0.18 * first_share(t))
    found = Table(shared_keys(parts, bits, lambda ids, text: PartSets(ids, text, words).exchanged(light, t), levels=True), "found")
    release(docs.sparkSession)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # kind 0: row, representative, n, id; 1: two nodes of one part that meet; 2: key and its least node in the part
        for batch in batches:
            for part, blob, got in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, text = unpack(blob.as_py())
                made, base = PartSets(ids, text, words), part.as_py() << 20
                size = np.array([len(s) for s in made.sets], np.int64)
                rows = np.arange(len(size))
                key, row, beyond = made.lists(light, t, got.as_py(), bits)
                order, head, local = meetings(key, row)
                key, row, beyond = key[order], row[order], beyond[order]
                outside = head & beyond
                kind = np.repeat(np.array([0, 1, 2], np.int8), [len(rows), len(local), int(outside.sum())])
                x = np.concatenate([base + rows, base + local[:, 0], key[outside].view(np.int64)])
                y = np.concatenate([np.where(made.rep < 0, -1, base + made.rep), base + local[:, 1], base + row[outside]])
                n = np.concatenate([size, np.zeros(len(kind) - len(rows), np.int64)])
                named = pa.concat_arrays([ids, pa.nulls(len(kind) - len(rows), pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y), pa.array(n), named], names=["kind", "x", "y", "n", "id"])

    seen = Table(parts.df.join(found.df, "part", "left").select("part", "blob", "found").mapInArrow(meet, "kind byte, x long, y long, n long, id long"), "meet")
    groups = _connected(seen.df)
    release(docs.sparkSession)

    size_of = seen.df.filter("kind = 0 and x = y").select(F.col("x").alias("node"), "n")
    wanted = Table(_with_chunks(groups.df.join(size_of, "node"), "component", F.col("n") * 8), "wanted")
    shingles, most_chunks = wanted.df.agg(F.sum("n"), F.max("chunks")).first()
    tasks = max(1, -(-(shingles or 0) * 8 // CHUNK_BYTES))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob, rows in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, text = unpack(blob.as_py())
                sets, base, rows = PartSets(ids, text, words).sets, part.as_py() << 20, rows.as_py()
                node = [base + r["row"] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["grp"] for r in rows], pa.int64()), pa.array(node, pa.int64()), pa.array([r["chunks"] for r in rows], pa.int32()), pa.array([sets[r["row"]].tobytes() for r in rows], pa.binary())], names=["grp", "node", "chunks", "items"])

    picked = wanted.df.groupBy(F.shiftright("node", 20).alias("part")).agg(F.collect_list(F.struct(F.col("component").alias("grp"), F.col("node").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("row"), "chunks")).alias("rows"))
    sets = Table(parts.df.select("part", "blob").join(picked, "part").select("part", "blob", "rows").mapInArrow(fetch, "grp long, node long, chunks int, items binary"), "sets")
    split = _split(sets, t) if (most_chunks or 0) > 1 else [sets]
    large = split[-1].df.filter("chunks > 1")
    sets = reduce(DataFrame.unionByName, [table.df.filter("chunks <= 1") for table in split[:-1]], split[-1].df)

    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(F.lit(0))
    own = sets.withColumn("visitor", F.lit(False)).withColumn("chunk", chunk.cast("int"))
    to_all = lambda df: df.withColumn("visitor", F.lit(True)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    if len(split) > 1:
        pivot = to_all(large.filter("node = grp"))
        own = own.unionByName(pivot.filter(pivot["chunk"] != F.pmod(F.xxhash64("node"), F.col("chunks"))))  # in its own chunk it is no visitor
    task = F.when(F.col("chunks") > 1, F.struct(F.col("grp").alias("a"), F.col("chunk").alias("b"))).otherwise(F.struct(F.pmod(F.xxhash64("grp"), F.lit(tasks)).alias("a"), F.lit(-1).alias("b")))
    settled = Table(own.withColumn("task", task).groupBy("task").applyInPandas(_settled_groups(t), "grp long, node long, label long, chunks int"), "settled")

    outside = settled.df.filter("chunks > 1 and label != grp")
    if len(split) == 1 or outside.isEmpty():
        label_of = settled.df.select("node", "label")
    else:
        labelled = large.join(settled.df.select("node", "label"), "node")
        own = labelled.withColumn("visitor", F.lit(False)).withColumn("chunk", chunk.cast("int"))
        guests = to_all(labelled.filter("label != grp"))
        guests = guests.filter(guests["chunk"] != F.pmod(F.xxhash64("node"), F.col("chunks")))  # round one settled those of its own chunk
        rows = own.unionByName(guests).select("grp", "chunk", "visitor", "label", "items")
        with arrow_batches(docs.sparkSession, CHUNK_BYTES):
            joined = components(rows.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "visitor").mapInArrow(_visits(t, CHUNK_BYTES), "u long, v long"))
        label_of = settled.df.join(joined.df.select(F.col("node").alias("label"), "component"), "label", "left").select("node", F.coalesce("component", "label").alias("label"))

    rows = seen.df.filter("kind = 0").select("id", "n", "x", F.when(F.col("y") >= 0, F.col("y")).alias("rep"))
    by_rep = rows.filter("rep is not null").groupBy("rep").agg(F.min("id").alias("least")).join(label_of.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    by_rep = Table(by_rep, "representatives")
    best = by_rep.df.groupBy("label").agg(F.min("least").alias("component_id"))
    named = by_rep.df.select("rep", "label").join(best, "label").select("rep", "component_id")
    kind = docs.schema[id_col].dataType
    out = rows.join(named, "rep", "left").select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").cast(kind).alias("component_id"))
    parts.drop()
    for table in split:
        table.drop()
    return out
