"""Which 64-bit keys occur in more than one part of a table, without shuffling rows.

A table is packed once into parts: rows of about PART_BYTES of text, compressed.
Each part lists its distinct keys by bucket as sorted 32-bit remainders; a bucket's
task sees every part's list and answers with one bit for each key: does it also
occur in another part? Four bytes a key go out and one bit comes back, a hot key
counts once for each part, and equal remainders of unequal keys only yield a
candidate too many (the remainder and the bucket together grow with the data).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import Table
from corvane.llm.textbuf import blocks, mix, text_array

PART_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
#: A key in more parts than this is common; operators that gather a key's records deal those of common keys more finely.
COMMON_PARTS = 256
U64 = np.uint64


def pack_parts(docs: DataFrame, id_col: str, text_col: str) -> Table:
    """(part, n_rows, n_bytes, blob): parts of whole rows, their ids and texts compressed; part * 2 ** 20 + row number names a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            text = text_array(batch.column(1))
            for lo, hi, data, _ in blocks(text, PART_BYTES):
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), text.slice(lo, hi - lo)], names=["id", "text"])
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([task << 20 | number]), pa.array([hi - lo]), pa.array([len(data)]), pa.array([blob], pa.binary())], names=["part", "n_rows", "n_bytes", "blob"])
                number += 1

    return Table(docs.select(id_col, text_col).mapInArrow(run, "part long, n_rows long, n_bytes long, blob binary"), "parts", bucket="part")


def unpack(blob: bytes) -> tuple[pa.Array, pa.Array]:
    """(ids, texts as large_binary) of a part."""
    batch = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)).read_next_batch()
    return batch.column(0), batch.column(1)


def bucket_bits(parts: Table, keys_per_byte: float) -> int:
    """Two to this power buckets hold about BUCKET_KEYS keys each; a few buckets at least, for parallel work."""
    total = parts.df.agg(F.sum("n_bytes")).first()[0] or 0
    return min(31, max(4, int(total * keys_per_byte / BUCKET_KEYS).bit_length()))


def short_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits that the exchange compares: bucket and 32-bit remainder, scrambled."""
    return mix(keys ^ U64(0x5851F42D4C957F2D)) >> U64(32 - bits)


def shared_keys(parts: Table, bits: int, keys_of: Callable[[pa.Array, pa.Array], np.ndarray], common_parts: int = COMMON_PARTS, levels: bool = False) -> DataFrame:
    """(part, found): for each part with shared keys, the buckets and bit lists of its distinct short keys.

    keys_of(ids, texts) gives a part's 64-bit keys, repeats allowed. With levels, the
    number of parts that have a key is answered too, as a power of two.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                short = np.unique(short_keys(keys_of(*unpack(blob.as_py())), bits))
                if not len(short):
                    continue
                bucket = (short >> U64(32)).astype(np.int32)
                names, at = np.unique(bucket, return_index=True)
                ends = [*at[1:].tolist(), len(short)]
                low = short.astype(np.uint32)
                lists = [low[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([part] * len(names), pa.int64()), pa.array(lists, pa.binary())], names=["bucket", "part", "keys"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
        value, times = np.unique(np.concatenate(lists), return_counts=True)
        value, times = value[times > 1], times[times > 1]
        often, level = times > common_parts, np.log2(times).astype(np.uint8)
        rows = []
        for bucket, part, keys in zip(pdf["bucket"], pdf["part"], lists, strict=True):
            if len(value):
                at = np.minimum(np.searchsorted(value, keys), len(value) - 1)
                hit = value[at] == keys
                if hit.any():
                    common = hit & often[at]
                    more = level[at[hit]].tobytes() if levels else np.packbits(common).tobytes() if common.any() else None
                    rows.append((bucket, part, np.packbits(hit).tobytes(), more))
        return pd.DataFrame(rows, columns=["bucket", "part", "bits", "common"])

    sent = parts.df.select("part", "blob").mapInArrow(send, "bucket int, part long, keys binary")
    answers = sent.groupBy("bucket").applyInPandas(answer, "bucket int, part long, bits binary, common binary")
    return answers.groupBy("part").agg(F.collect_list(F.struct("bucket", "bits", "common")).alias("found"))


def read_found(found: list | None, keys: np.ndarray, bits: int, levels: bool = False) -> np.ndarray:
    """What shared_keys() answered for each of a part's keys: 0 no other part has it, 1 some have, 2 it is common.

    With levels: 0, or 1 + the power of two of the number of parts.
    """
    out = np.zeros(len(keys), np.int8)
    if not found or not len(keys):
        return out
    short, inverse = np.unique(short_keys(keys, bits), return_inverse=True)
    bucket = short >> U64(32)
    hit = np.zeros(len(short), np.int8)
    for entry in found:
        a, b = np.searchsorted(bucket, entry["bucket"], "left"), np.searchsorted(bucket, entry["bucket"], "right")
        some = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=b - a).astype(np.int8)
        if levels:
            some[some > 0] += np.frombuffer(entry["common"], np.uint8).astype(np.int8)
        elif entry["common"] is not None:
            some += np.unpackbits(np.frombuffer(entry["common"], np.uint8), count=b - a).astype(np.int8)
        hit[a:b] = some
    return hit[inverse]


def many_owners(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs with at least two owners in these arrays."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owner[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(head)
    several = np.minimum.reduceat(o, start) != np.maximum.reduceat(o, start)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(several, np.diff(np.append(start, len(k))))
    return out
