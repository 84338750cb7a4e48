"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

1. Each text becomes token ids plus an end id, in Arrow batches. Distinct words are
   tokenized once: the tokenizer drops white space, so a text's ids are its words'
   ids end to end. Only documents longer than a sequence are cut.
2. Pieces are dealt by hash into blocks of about BLOCK pieces, and each block is evolved
   on ISLANDS islands. An island is a row of its own, with a population of packings: the
   best fit of the longest first, and best fits of shaken orders. A crossover injects whole
   well-filled bins of one parent into another, removes the bins that hold duplicates of
   the injected pieces, and best-fits the displaced pieces, longest first.
3. Islands are tasks apart. After each of ROUNDS rounds they are written to the shared
   folder, and each goes on with the elite of the island before it in place of its worst.
   The best packing of all islands is the block's: fewest bins, then fullest ones.
4. Pieces of bins that are still open are pooled over all blocks and evolved again,
   until that frees no more bins or one block holds them all.

Every choice is seeded by the block's contents, so a lost task recomputes the same.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import Table
from corvane.llm.textbuf import blocks, ragged, text_array

BLOCK = 4096
#: Rounds of generations; between rounds islands exchange their elites.
ISLANDS, POPULATION, ROUNDS, GENERATIONS = 3, 4, 3, 5
#: The share of the fullest bins that a crossover chooses from, and the share of those that it injects.
WELL_FILLED, INJECTED = 0.7, 0.6
OPEN_BELOW = 0.97
CACHE = 1 << 18


class WordIds(dict):
    """Token ids of words, each word tokenized once while it stays in use.

    Of words beyond CACHE those not asked for since the last such moment are forgotten.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, int] = {}
        self.new: list[bytes] = []
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, word: bytes) -> int:
        at = self.old.get(word)
        if at is None:
            at = len(self.starts) + len(self.new)
            self.new.append(word)
        self[word] = at
        return at

    def forget(self) -> None:
        """Keep only the words asked for since the last call, as the older generation."""
        at = np.fromiter(self.values(), np.int64, len(self))
        lengths = self.lengths[at]
        self.flat = self.flat[ragged(self.starts[at], lengths)]
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.old = dict(zip(self, range(len(self)), strict=True))
        self.clear()

    def learn(self) -> None:
        """Tokenize the words first seen since the last call.

        Many words go into one text, a null character between blanks after each: that is
        a token of its own, so it tells where a word's ids end. Words that hold one, or
        a part of a special string, are tokenized alone. ASCII case doesn't matter to
        the tokenizer.
        """
        if not self.new:
            return
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        (end,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        starts, lengths, flat, at = [self.starts], [self.lengths], [self.flat], len(self.flat)
        for i in range(0, len(self.new), 16384):
            words = self.new[i : i + 16384]
            alone = [k for k, w in enumerate(words) if b"\0" in w or b"<|" in w]
            whole = [*words]
            for k in alone:
                whole[k] = b""
            texts = [(b" \0 ".join(whole[k : k + 512]) + b" \0").decode("utf-8") for k in range(0, len(whole), 512)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in encode(texts, add_special_tokens=False)])
            stop = np.flatnonzero(ids == end)
            n = np.diff(stop, prepend=-1) - 1
            begin = stop - n
            if alone:
                found = [np.array(x.ids, np.uint32) for x in encode([words[k].decode("utf-8") for k in alone], add_special_tokens=False)]
                n[alone] = [len(x) for x in found]
                begin[alone] = len(ids) + np.cumsum(n[alone]) - n[alone]
                ids = np.concatenate([ids, *found])
            starts.append(at + begin)
            lengths.append(n)
            flat.append(ids)
            at += len(ids)
        self.new = []
        self.starts, self.lengths, self.flat = np.concatenate(starts), np.concatenate(lengths), np.concatenate(flat)

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, each row's closed by end_id; row borders)."""
        if len(self) > CACHE:
            self.forget()
        data, offs = part_signs(data, offs)
        raw, n_words, at = data.tobytes(), np.zeros(len(offs) - 1, np.int64), []
        for i in range(len(offs) - 1):
            whole = raw[offs[i] : offs[i + 1]]
            words = (whole if b"<|" in whole else whole.lower()).split()  # special strings are told by case
            n_words[i] = len(words)
            at.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self.learn()
        at = np.concatenate(at)
        lengths = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(n_words)])
        row = np.diff(upto[borders]) + 1
        ends = np.cumsum(row)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        body = np.ones(len(ids), bool)
        body[ends - 1] = False
        ids[~body] = end_id
        ids[body] = self.flat[ragged(self.starts[at], lengths)]
        return ids, np.concatenate([[0], ends])


def part_signs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block with a blank before each full stop or comma between a lower-case ASCII letter and white space.

    The tokenizer parts the sign from the letter anyway, so no id changes; but words that
    differ in the sign alone become one.
    """
    at = np.flatnonzero(_SIGN[data])
    at = at[at > 0]
    after = np.append(data, 32)[at + 1]
    border = np.isin(at + 1, offs)
    at = at[_LETTER[data[at - 1]] & (_BLANK[after] | border)]
    return np.insert(data, at, 32), offs + np.searchsorted(at, offs)


_SIGN, _LETTER, _BLANK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b".,")], _LETTER[97:123], _BLANK[[32, *range(9, 14)]] = True, True, True
_words: dict[str, WordIds] = {}


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and with keep_ids the ids as little-endian uint32 bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _words:
            _words[tokenizer_path] = WordIds(tokenizer_path)
        words = _words[tokenizer_path]
        for batch in batches:
            for lo, hi, data, offs in blocks(text_array(batch.column(1))):
                ids, borders = words.encode(data, offs, end_id)
                size = np.diff(borders)
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                at = borders[:-1][row] + start
                little = ids.astype("<u4")
                crc = [zlib.crc32(little[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([little[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


@dataclass
class Packing:
    """The bin of each piece; bins are numbered from 0, without gaps. `born` is the generation that made it, 0 for a best fit."""

    bins: np.ndarray
    born: int = 0

    def fills(self, size: np.ndarray) -> np.ndarray:
        return np.bincount(self.bins, size).astype(np.int64)

    def fitness(self, size: np.ndarray, capacity: int) -> tuple[int, float]:
        """Fewer bins first; then fuller ones, by the sum of squared fills."""
        fills = self.fills(size) / capacity
        return len(fills), -float((fills * fills).sum())


def best_fit(items: np.ndarray, size: np.ndarray, capacity: int, bins: np.ndarray, used: int) -> np.ndarray:
    """Put items, in the order given, each into the bin with least room that still holds it.

    `bins` has the bin of each piece that is placed already, -1 for the others; `used` bins are in use.
    """
    bins = bins.copy()
    placed = bins >= 0
    room = sorted((capacity - int(fill), n) for n, fill in enumerate(np.bincount(bins[placed], size[placed], used)))
    for i, n in zip(items.tolist(), size[items].tolist(), strict=True):
        at = bisect_left(room, (n, -1))
        if at == len(room):
            left, b = capacity, used
            used += 1
        else:
            left, b = room.pop(at)
        bins[i] = b
        insort(room, (left - n, b))
    return bins


def crossover(one: Packing, other: Packing, size: np.ndarray, capacity: int, rng: np.random.Generator, born: int = 0) -> Packing:
    """Inject some of the other's well-filled bins into one, remove its bins with duplicates, best-fit the displaced."""
    fills = other.fills(size)
    full = np.argsort(-fills, kind="stable")[: max(1, int(WELL_FILLED * len(fills)))]
    chosen = rng.choice(full, max(1, int(INJECTED * len(full))), replace=False)
    injected = np.isin(other.bins, chosen)
    doubled = np.isin(one.bins, one.bins[injected])  # pieces of one's bins that hold an injected piece
    bins = np.full(len(size), -1, np.int64)
    bins[injected] = np.searchsorted(np.sort(chosen), other.bins[injected])
    kept = np.unique(one.bins[~doubled])
    bins[~doubled] = len(chosen) + np.searchsorted(kept, one.bins[~doubled])
    displaced = np.flatnonzero(doubled & ~injected)
    displaced = displaced[np.argsort(-size[displaced], kind="stable")]
    return Packing(best_fit(displaced, size, capacity, bins, len(chosen) + len(kept)), born)


def settlers(size: np.ndarray, capacity: int, seed: int) -> list[Packing]:
    """A first population: the best fit of the longest first, and of shaken orders."""
    rng = np.random.default_rng(seed)
    none = np.full(len(size), -1, np.int64)
    shaken = [size, *(size * rng.uniform(0.8, 1.0, len(size)) for _ in range(POPULATION - 1))]
    return [Packing(best_fit(np.argsort(-s, kind="stable"), size, capacity, none, 0)) for s in shaken]


def evolve(people: list[Packing], size: np.ndarray, capacity: int, seed: int, first: int = 0, generations: int = GENERATIONS) -> list[Packing]:
    """The population, best first, after some generations; `first` is the number of those before."""
    rng = np.random.default_rng(seed)
    score = lambda p: p.fitness(size, capacity)
    people = sorted(people, key=score)
    for generation in range(first + 1, first + generations + 1):
        mates = [(0, 1 + k % (len(people) - 1)) for k in range(POPULATION // 2)] + [(1, 0), (len(people) - 1, 0)]
        children = [crossover(people[a], people[b], size, capacity, rng, generation) for a, b in mates]
        found = {score(p): p for p in reversed(people + children)}  # of equally fit ones the elder
        people = sorted(found.values(), key=score)[:POPULATION]
        while len(people) < 2:
            people.append(people[0])
    return people


ISLAND = "block long, island int, size binary, people array<binary>, born array<int>"


def _islands(capacity: int, done: int, work):
    """Batches of island rows with `work(people, size, seed, island)` done on each row's population."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = np.frombuffer(row["size"], np.int32).astype(np.int64)
                seed = zlib.crc32(row["size"]) + (row["island"] << 32) + (done << 40)
                people = [Packing(np.frombuffer(p, np.int32).astype(np.int64), b) for p, b in zip(row["people"] or [], row["born"] or [], strict=True)]
                if row.get("elite") is not None and people:
                    people = [*people[:-1], Packing(np.frombuffer(row["elite"], np.int32).astype(np.int64), row["elite_born"])]
                people = work(people, size, seed)
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("block", "island", "size")} | {"people": [p.bins.astype(np.int32).tobytes() for p in people], "born": [p.born for p in people]}], schema=ISLAND_ARROW)

    return run


ISLAND_ARROW = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("size", pa.binary()), ("people", pa.list_(pa.binary())), ("born", pa.list_(pa.int32()))])


def evolved(sizes: DataFrame, capacity: int) -> Table:
    """Island rows (block, island, size, people, born), best packing first, of blocks (block, size: int32 lengths, longest first)."""
    start = sizes.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "size", F.expr("cast(null AS array<binary>) AS people"), F.expr("cast(null AS array<int>) AS born"))
    start = start.repartition(max(1, min(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4, ISLANDS * sizes.count())), "block", "island")
    now = Table(start.mapInArrow(_islands(capacity, 0, lambda _, size, seed: evolve(settlers(size, capacity, seed), size, capacity, seed)), ISLAND), "islands")
    for done in range(GENERATIONS, ROUNDS * GENERATIONS, GENERATIONS):
        elites = now.df.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("people")[0].alias("elite"), F.col("born")[0].alias("elite_born"))
        rows = now.df.join(elites, ["block", "island"])
        after = Table(rows.mapInArrow(_islands(capacity, done, lambda people, size, seed, done=done: evolve(people, size, capacity, seed, done)), ISLAND), "islands")
        now.drop()
        now = after
    return now


def _placed(capacity: int, names: list[str]):
    """Batches of blocks (block, pieces, size, the islands' best packings) as rows of pieces with the best packing's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, elites = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                size = np.frombuffer(batch.column(2)[i].as_py(), np.int32).astype(np.int64)
                best = min((Packing(np.frombuffer(e["bins"], np.int32).astype(np.int64), e["born"]) for e in elites), key=lambda p: (*p.fitness(size, capacity), p.born, p.bins.tobytes()))
                order = np.argsort(best.bins, kind="stable")
                ends = np.cumsum(size[order])
                fills = best.fills(size)
                offset = np.empty(len(size), np.int64)
                offset[order] = ends - size[order] - np.repeat(np.cumsum(fills) - fills, np.bincount(best.bins))
                pieces = batch.column(1).slice(i, 1).flatten()
                columns = [pieces.field(k) for k in range(len(names))]
                columns += [pa.array(best.bins + (block << 32)), pa.array(offset), pa.array(fills[best.bins]), pa.array(np.full(len(size), best.born, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset", "fill", "generation"])

    return run


def _pack(pieces: DataFrame, n: int, base: int, capacity: int, names: list[str], shape: str) -> Table:
    """The pieces (names, serial, length) packed in n blocks numbered from base: with sequence_id, offset, fill and generation."""
    block = F.pmod(F.xxhash64("serial"), F.lit(n)) + F.lit(base)
    # longest first; ties by what the piece is, so that its order doesn't hang on the deal
    order = F.struct((-F.col("length")).alias("_longest"), F.col("ids_crc32").alias("_crc"), F.col("serial").alias("_serial"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("p"))
    dealt = pieces.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(order)).alias("s"))
    little = lambda x: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4))))
    dealt = dealt.select("block", F.transform("s", lambda x: x["p"]).alias("pieces"), F.array_join(F.transform("s", lambda x: F.hex(little(x["p"]["length"].cast("int")))), "").alias("hex"))
    blocks_ = Table(dealt.select("block", "pieces", F.unhex("hex").alias("size")), "blocks")
    islands = evolved(blocks_.df.select("block", "size"), capacity)
    elites = islands.df.groupBy("block").agg(F.collect_list(F.struct(F.col("people")[0].alias("bins"), F.col("born")[0].alias("born"))).alias("elites"))
    out = Table(blocks_.df.join(elites, "block").select("block", "pieces", "size", "elites").mapInArrow(_placed(capacity, names), shape), "packed")
    islands.drop()
    blocks_.drop()
    return out


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows into as few sequences of at most `capacity` tokens as it can.

    Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the
    generation of the genetic algorithm that made its block's packing (0: best fit
    alone). Null or empty text has the end id alone (length 1). Rows with equal or null
    ids are packed as documents of their own; other columns are ignored; an empty table
    gives none.
    """
    made = tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    pieces = Table(made.withColumn("serial", F.monotonically_increasing_id()), "pieces")  # deals equal rows too
    names = [*made.columns, "serial"]
    shape = f"{pieces.schema.simpleString()[7:-1]}, sequence_id long, offset long, fill long, generation int".replace(f"{id_col}:", f"`{id_col}`:", 1)
    left, n_left, base, open_bins = pieces.df, pieces.df.count(), 0, None
    done: list[DataFrame] = []
    is_open = F.col("fill") < int(OPEN_BELOW * capacity)
    while n_left:
        n = -(-n_left // BLOCK)
        packed = _pack(left, n, base, capacity, names, shape)
        base += n
        still = packed.df.filter(is_open)
        now = still.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
        if n == 1 or now.n == 0 or (open_bins is not None and now.bins >= open_bins):
            done.append(packed.df)
            break
        done.append(packed.df.filter(~is_open))
        left, n_left, open_bins = still.select(*(f"`{c}`" for c in names)), now.n, now.bins
    if not done:
        return pieces.df.selectExpr("*", "0L AS sequence_id", "0L AS offset", "0 AS generation").drop("serial")
    pieces.drop()
    return reduce(DataFrame.unionByName, done).drop("serial", "fill")
