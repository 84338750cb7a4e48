"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix is a position of a text; only its first `depth` bytes (its window) count.
Positions whose windows cannot repeat are never sorted: of every window its gram of
least hash (depth / 2 bytes) is its anchor, equal windows have equal anchors at equal
places, and an exchange of four bytes an anchor tells which occur in several texts.

The sort is most significant digit first. The first digit is the anchor, by which
windows are dealt to tasks; the windows of one occurrence travel as one context.
Then passes of eight bytes each split the groups, and groups of one drop out. After
`depth` bytes equal groups are exactly the repeated windows; each has a least document
id, and every occurrence in a document with a larger id is marked for removal.
Anchors common to very many parts are dealt by whole windows instead, so that no
task gathers a string that a large share of all documents contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.exchange import COMMON_PARTS, bucket_bits, many_owners, pack_parts, read_found, shared_keys, short_keys, unpack
from corvane.llm.shared import Table
from corvane.llm.textbuf import _BYTE, _MULT, _MULT_INV, U64, blocks, mix, powers, ragged, runs

NONE = np.iinfo(np.int64).max
CHUNK = 256 << 10
DIGIT = 8


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of `width` neighbours."""
    have, n = 1, x
    while have * 2 <= width:
        n = op(n[:-have], n[have:])
        have *= 2
    return op(n[: len(n) - (width - have)], n[width - have :]) if have < width else n


def _crossing(borders: np.ndarray, length: int, n: int) -> np.ndarray:
    """For positions 0 .. n - 1, whether the next `length` bytes cross a border."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(borders - length + 1, 0, n), 1)
    np.add.at(step, np.clip(borders, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


class Anchors:
    """The anchors of a part's texts: key (hash of the gram), pos (in the part's bytes), row, and on request their runs of windows."""

    def __init__(self, ids: pa.Array, text: pa.Array, depth: int):
        self.depth, self.gram = depth, depth // 2
        self.width = depth - self.gram + 1
        self.ids = ids
        self.doc = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        usable = ids.is_valid().to_numpy(zero_copy_only=False)
        keys, pos, row, first, last, base = [], [], [], [], [], 0
        self.data, self.offs = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        parts, offs = [], [np.zeros(1, np.int64)]
        for lo, hi, data, o in blocks(text, CHUNK):
            k, p, a, b = self._block(data, o, usable[lo:hi])
            keys.append(k)
            pos.append(p + base)
            row.append(lo + np.searchsorted(o, p, side="right") - 1)
            first.append(a)
            last.append(b)
            parts.append(data)
            offs.append(o[1:] + base)
            base += len(data)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.data, self.offs = join(parts, np.uint8), np.concatenate(offs)
        self.key, self.pos, self.row = join(keys, U64), join(pos, np.int64), join(row, np.int64)
        self.first, self.last = join(first, np.int64), join(last, np.int64)

    def _block(self, data: np.ndarray, offs: np.ndarray, usable: np.ndarray):
        n, depth, gram, width = len(data), self.depth, self.gram, self.width
        none = np.zeros(0, np.int64)
        if n < depth:
            return none.astype(U64), none, none, none
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * powers(_MULT, n), out=total[1:])
        h = (total[gram:] - total[:-gram]) * powers(_MULT_INV, n + 1)[: n - gram + 1]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(29)
        h |= U64(1)
        borders = offs[1:-1]
        h[_crossing(borders, gram, len(h))] = ~U64(0)
        least = _slide(h, width, np.minimum)
        off = _crossing(borders, depth, len(least))
        if not usable.all():
            off |= np.repeat(~usable, np.diff(offs))[: len(least)]
        least[off] = 0
        pad = np.zeros(width - 1, U64)
        padded = np.concatenate([pad, least, pad])
        pos = np.flatnonzero(_slide(padded, width, np.maximum) == h)
        key = h[pos]
        first, last = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        for lo in range(0, len(pos), 1 << 14):
            p = pos[lo : lo + (1 << 14)]
            mine = padded[p[:, None] + np.arange(width)] == key[lo : lo + (1 << 14), None]
            first[lo : lo + len(p)] = mine.argmax(1)
            last[lo : lo + len(p)] = width - 1 - mine[:, ::-1].argmax(1)
        return key, pos, first, last


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit digits."""
    return np.ascontiguousarray(rows).view(">u8").astype(U64)


def _row_hash(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), U64)
    for k in range(words.shape[1]):
        h = mix(h * U64(0xD6E8FEB86659FD93) + words[:, k])
    return h


def _group(columns: list[np.ndarray]) -> np.ndarray:
    """Dense group numbers of equal rows of the columns, numbered in sorted order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Contexts:
    """The distinct contexts of a part's candidates, in the order in which they are sent.

    A context is the bytes of one run of windows around an anchor, zero outside the
    run, then the run's first and last place, padded to whole digits.
    """

    def __init__(self, anchors: Anchors, found: list | None, bits: int):
        level = np.maximum(read_found(found, anchors.key, bits), many_owners(anchors.key, anchors.row).astype(np.int8))
        at = np.flatnonzero(level)
        key, pos, row, first, last = (x[at] for x in (anchors.key, anchors.pos, anchors.row, anchors.first, anchors.last))
        common = level[at] == 2
        times = np.where(common, last - first + 1, 1)
        each = np.repeat(np.arange(len(at)), times)
        place = ragged(np.zeros(len(at), np.int64), times)
        key, pos, row, common = key[each], pos[each], row[each], common[each]
        last = np.where(common, first[each] + place, last[each])
        first = first[each] + np.where(common, place, 0)
        span = anchors.width - 1 + anchors.depth
        wide = -(-(span + 2) // DIGIT) * DIGIT
        rows = np.zeros((len(key), wide), np.uint8)
        places = np.arange(span)
        for lo in range(0, len(key), 1 << 14):
            s = slice(lo, lo + (1 << 14))
            index = pos[s, None] - (anchors.width - 1) + places
            inside = (places >= first[s, None]) & (places < last[s, None] + anchors.depth)
            rows[s, :span] = np.where(inside, anchors.data[np.clip(index, 0, len(anchors.data) - 1)], 0)
        rows[:, span], rows[:, span + 1] = first, last
        words = _words(rows)
        digest = _row_hash(words)
        short = short_keys(np.where(common, digest, key), bits)
        number = _group([short, digest])
        head = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
        head[number[::-1]] = np.arange(len(number))[::-1]
        if len(number) and not (rows == rows[head[number]]).all():  # two contexts of one digest
            number = _group([short, *words.T])
            head = np.zeros(int(number.max()) + 1, np.int64)
            head[number[::-1]] = np.arange(len(number))[::-1]
        self.number, self.pos, self.row = number, pos, row
        self.rows, self.bucket = rows[head], (short[head] >> U64(32)).astype(np.int64)
        doc = anchors.doc[row]
        self.least, self.most = np.full(len(head), NONE), np.full(len(head), -NONE)
        np.minimum.at(self.least, number, doc)
        np.maximum.at(self.most, number, doc)

    def lists(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, end) of each bucket's contexts."""
        names, start = np.unique(self.bucket, return_index=True)
        yield from zip(names.tolist(), start.tolist(), [*start[1:].tolist(), len(self.bucket)], strict=False)


def radix_groups(window: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, group numbers) of those that repeat: most significant digit first, from given groups, through `depth` bytes."""
    alive = np.arange(len(window))
    for at in range(0, depth, DIGIT):
        if not len(alive):
            break
        digit = np.zeros((len(alive), DIGIT), np.uint8)
        part = window[alive, at : min(at + DIGIT, depth)]
        digit[:, : part.shape[1]] = part
        group = _group([group, _words(digit)[:, 0]])
        keep = np.bincount(group)[group] > 1
        alive, group = alive[keep], group[keep]
    return alive, group


def window_minima(rows: np.ndarray, least: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, first place, last place, least id) of runs of windows, over distinct contexts with their least ids."""
    gram = depth // 2
    width = depth - gram + 1
    span = width - 1 + depth
    first, last = rows[:, span].astype(np.int64), rows[:, span + 1].astype(np.int64)
    pad = -gram % DIGIT
    anchor = np.concatenate([rows[:, width - 1 : width - 1 + gram], np.zeros((len(rows), pad), np.uint8)], 1)
    group = _group(list(_words(anchor).T))
    alone = np.bincount(group)[group] == 1
    many = np.flatnonzero(~alone)
    size = last[many] - first[many] + 1
    owner, place = np.repeat(many, size), ragged(first[many], size)
    value = least[owner].copy()
    order = np.argsort(group[owner] * width + place, kind="stable")
    tag, step, lo = group[owner[order]], 1 << 17, 0
    while lo < len(order):  # slices that end between groups
        hi = int(np.searchsorted(tag, tag[min(lo + step, len(order)) - 1], side="right"))
        at = order[lo:hi]
        window = rows[owner[at][:, None], place[at][:, None] + np.arange(depth)]
        alive, found = radix_groups(window, _group([group[owner[at]], place[at]]), depth)
        if len(alive):
            best = np.full(int(found.max()) + 1, NONE)
            np.minimum.at(best, found, value[at[alive]])
            value[at[alive]] = best[found]
        lo = hi
    head = np.ones(len(owner), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(owner)) - 1
    one = np.flatnonzero(alone)
    if not len(owner):
        start = end = np.zeros(0, np.int64)
    return np.concatenate([one, owner[start]]), np.concatenate([first[one], place[start]]), np.concatenate([last[one], place[end]]), np.concatenate([least[one], value[start]])


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _expand(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), kind)


def _resolve(depth: int):
    """A bucket's task: for each part's contexts the runs of windows that a document with a smaller id has too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([_expand(b, np.uint8).reshape(n, -1) for b, n in zip(pdf["rows"], pdf["n"], strict=True)])
        least = np.concatenate([_expand(b, np.int64) for b in pdf["least"]])
        most = np.concatenate([_expand(b, np.int64) for b in pdf["most"]])
        words = _words(rows)
        number = _group([_row_hash(words), *words.T])
        head = np.zeros(int(number.max()) + 1, np.int64)
        head[number] = np.arange(len(number))
        lowest = np.full(len(head), NONE)
        np.minimum.at(lowest, number, least)
        context, first, last, value = window_minima(rows[head], lowest, depth)
        order = np.argsort(context, kind="stable")
        first, last, value = first[order], last[order], value[order]
        start = np.searchsorted(context[order], np.arange(len(head) + 1))
        out, at = [], 0
        for bucket, part, n in zip(pdf["bucket"], pdf["part"], pdf["n"], strict=True):
            mine = number[at : at + n]
            size = start[mine + 1] - start[mine]
            record, line = np.repeat(np.arange(n), size), ragged(start[mine], size)
            keep = value[line] < most[at : at + n][record]
            if keep.any():
                out.append((bucket, part, _squeeze(record[keep].astype(np.int32)), _squeeze(np.stack([first[line[keep]], last[line[keep]]], 1).astype(np.uint8)), _squeeze(value[line[keep]])))
            at += n
        return pd.DataFrame(out, columns=["bucket", "part", "record", "places", "value"])

    return run


def dedup_spans(docs: DataFrame, depth: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, common_parts: int = COMMON_PARTS) -> DataFrame:
    """Remove each byte covered by a `depth`-byte string that also starts in a document with a smaller id.

    Texts are their UTF-8 bytes (null: none) and strings are judged on the input.
    Returns per row: id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the remaining bytes end to end), and with keep_text `kept` (binary:
    a cut can fall inside a character). Rows of equal ids are one document to each
    other: neither is smaller. A row without an id neither loses bytes nor makes
    others lose any. Ids are integers; other columns are ignored; an empty table gives
    none. depth is from 4 to 128.
    """
    if not 4 <= depth <= 128:
        raise ValueError("depth is from 4 to 128")
    parts = pack_parts(docs, id_col, text_col)
    bits = bucket_bits(parts, 4.0 / depth)
    answers = shared_keys(parts, bits, lambda ids, text: Anchors(ids, text, depth).key, common_parts)
    found = Table(answers, "found")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob, got in zip(*(batch.column(i) for i in range(3)), strict=True):
                made = Contexts(Anchors(*unpack(blob.as_py()), depth), got.as_py(), bits)
                rows = [(b, z - a, _squeeze(made.rows[a:z]), _squeeze(made.least[a:z]), _squeeze(made.most[a:z])) for b, a, z in made.lists()]
                if rows:
                    bucket, n, *blobs = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([part.as_py()] * len(rows), pa.int64()), pa.array(n, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "part", "n", "rows", "least", "most"])

    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, got, runs_found in zip(*(batch.column(i) for i in range(3)), strict=True):
                anchors = Anchors(*unpack(blob.as_py()), depth)
                yield _cut(anchors, Contexts(anchors, got.as_py(), bits), runs_found.as_py() or [], depth, id_col, keep_text)

    both = parts.df.join(found.df, "part", "left")
    sent = both.select("part", "blob", "found").mapInArrow(send, "bucket int, part long, n int, rows binary, least binary, most binary")
    resolved = sent.groupBy("bucket").applyInPandas(_resolve(depth), "bucket int, part long, record binary, places binary, value binary")
    marks = resolved.groupBy("part").agg(F.collect_list(F.struct("bucket", "record", "places", "value")).alias("marks"))
    shape = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    out = Table(both.join(marks, "part", "left").select("blob", "found", "marks").mapInArrow(cut, shape), "cut")
    parts.drop()
    found.drop()
    return out.df


def _cut(anchors: Anchors, contexts: Contexts, marks: list, depth: int, id_col: str, keep_text: bool) -> pa.RecordBatch:
    step = np.zeros(len(anchors.data) + 1, np.int32)
    start = {b: a for b, a, _ in contexts.lists()}
    order = np.argsort(contexts.number, kind="stable")
    upto = np.searchsorted(contexts.number[order], np.arange(len(contexts.bucket) + 1))
    for mark in marks:
        record = _expand(mark["record"], np.int32).astype(np.int64) + start[mark["bucket"]]
        places, value = _expand(mark["places"], np.uint8).reshape(-1, 2).astype(np.int64), _expand(mark["value"], np.int64)
        size = upto[record + 1] - upto[record]
        line = np.repeat(np.arange(len(record)), size)
        where = order[ragged(upto[record], size)]
        later = anchors.doc[contexts.row[where]] > value[line]
        line, where = line[later], where[later]
        begin = contexts.pos[where] - (anchors.width - 1)
        np.add.at(step, begin + places[line, 0], 1)
        np.add.at(step, begin + places[line, 1] + depth, -1)
    gone = np.cumsum(step[:-1]) > 0
    offs = anchors.offs
    upto = np.concatenate([[0], np.cumsum(gone)])
    n_spans = np.diff(runs(gone, offs)[2])
    kept = [anchors.data[a:b][~gone[a:b]].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    columns = [anchors.ids, pa.array(np.diff(offs)), pa.array(np.diff(upto[offs])), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if keep_text:
        columns.append(pa.array(kept, pa.binary()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names=names)
