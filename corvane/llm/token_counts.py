"""Token counts by rank-synchronous array merging.

A byte-level BPE vocabulary is read from its file into arrays: an id for each
byte, and the merges as sorted (left, right) keys with rank and result. Distinct
pre-tokens of a batch are held as one ragged array. In every round each sequence
finds its pair of lowest rank, all sequences apply theirs at once, and a sequence
without a known pair leaves with its number of surviving symbols. A merge's result
has a later rank in every pair it enters, so applying all occurrences together
gives what one-by-one merging gives.

Counts of pre-tokens are remembered in each Python worker up to CACHE entries;
beyond that the memory starts anew, so results don't depend on it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corvane.llm.textbuf import blocks, text_array

#: The split that byte-level BPE files of this kind declare (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the tokenizer's engine knows it: the Unicode property, without the information separators.
SPACE = r"\t-\r \x85\xA0  -     　"
CACHE = 1 << 19
FAR = np.int64(1) << 60


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class RankMerger:
    """A byte-level BPE vocabulary as arrays; count() gives the number of tokens of each byte string."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = [x["content"] for x in spec.get("added_tokens", []) if x["content"]]
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        self.keys, self.rank, self.result = keys[order][first], order[first].astype(np.int64), result[order][first]
        parts = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special = regex.compile(f"({parts})") if parts else None
        self.split = regex.compile(SPLIT.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.known: dict[str, int] = {}

    def count(self, strings: list[bytes]) -> np.ndarray:
        """Tokens of each byte string, each taken as one pre-token."""
        out = np.zeros(len(strings), np.int64)
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        ids = self.byte_id[np.frombuffer(b"".join(strings), np.uint8)]
        which = np.flatnonzero(length > 0)
        length = length[which]
        while len(which):
            start = np.cumsum(length) - length
            key = np.full(len(ids), -1, np.int64)
            key[:-1] = ids[:-1] * self.width + ids[1:]
            key[start + length - 1] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], FAR)
            least = np.minimum.reduceat(rank, start)
            going = least < FAR
            out[which[~going]] = length[~going]
            if not going.any():
                break
            hit = np.flatnonzero((rank == np.repeat(least, length)) & (rank < FAR))
            # of overlapping occurrences (a a a) every second one counts, from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            ids[hit] = self.result[at[hit]]
            keep = np.repeat(going, length)
            keep[hit + 1] = False
            gone = np.zeros(len(ids), np.int64)
            gone[hit + 1] = 1
            length = (length - np.add.reduceat(gone, start))[going]
            ids, which = ids[keep], which[going]
        return out

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings inside counting one each."""
        words, extra = [], []
        for text in texts:
            n = 0
            if self.special is not None and any(s in text for s in self.specials):
                found = []
                for i, piece in enumerate(self.special.split(text)):
                    if i % 2:
                        n += 1
                    else:
                        found += self.split.findall(piece)
            else:
                found = self.split.findall(text)
            words.append(found)
            extra.append(n)
        new = {w for found in words for w in found if w not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = {w for found in words for w in found}
        if new:
            todo = list(new)
            self.known.update(zip(todo, self.count([w.encode("utf-8") for w in todo]).tolist(), strict=True))
        get = self.known.__getitem__
        return [n + sum(map(get, found)) for n, found in zip(extra, words, strict=True)]


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """The vocabulary of a file, read once by each worker."""
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text is empty text: 0 bytes, 0 tokens. Rows are independent: ids that repeat
    or are null pass through, columns other than the two named are ignored, and an
    empty table gives an empty result. A text is never cut, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = merger(tokenizer_path)
        for batch in batches:
            text = text_array(batch.column(1))
            sizes, tokens = [], []
            for lo, hi, _, offs in blocks(text):
                sizes.append(np.diff(offs))
                tokens += vocabulary.texts(text[lo:hi].cast(pa.large_string()).to_pylist())
            n = np.array(tokens, np.int64)
            nbytes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nbytes), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


__all__ = ["RankMerger", "count_tokens"]
