"""Secret scans: fixed patterns, and a character convolutional network over all other candidates.

The base patterns always report. Every run of 16 or more credential characters is a
candidate, whether or not a base pattern touches it: the network reads all of it in
overlapping windows, with 16 characters before its start and after its end, and the
window likest a secret decides. It is trained in numpy on the windows of labelled
findings:

* of the corpus: candidates that base patterns touch, with their surroundings (at most
  SAMPLE distinct ones, of least hash);
* generated from a seed: keys of many issuers and random tokens, against words, numbers,
  paths, addresses and identifiers, and runs that join several of them. Every second one
  is planted in surroundings taken from the corpus (at most SAMPLE, of least hash).

The logits of whole candidates are calibrated on a fifth of the findings, held out from
training, and the threshold is the highest that keeps RECALL of the held-out secrets of
either kind.

Where a corpus has more findings or surroundings than that, or longer ones, this network
is only where learning starts: all distinct candidates that base patterns touch, of any
length, and a generated finding planted in the surroundings of each text are then learned
from in ROUNDS rounds. In each round every shard of them trains the network by itself, and
the weights are averaged; logits, calibration and threshold come from all that are held
out. Shards are of equal hash, so the network is the same for any partitioning.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import string
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import Table
from corvane.llm.textbuf import blocks, runs, text_array

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
KINDS = ("assign", "access", "hex", "learned")
LEAST = 16
BEFORE, AFTER = 16, 48
#: A window starts as far behind the one before it, so each shares this many characters with the next.
STEP = (BEFORE + AFTER) // 2
#: Windows that are scored at a time.
WINDOWS = 4096
RECALL = 0.98
FINDINGS, JOINED = 6000, 1500
#: Seed of the generated findings that are planted in every text.
PLANTED = 12
#: Most findings, and most surroundings, of the corpus that the driver learns from, and their longest candidate; a corpus with more is learned from in rounds.
SAMPLE, LONGEST, AROUND = 2000, 1024, 64
WIDTH, FILTERS, HIDDEN, EPOCHS, BATCH = 5, 24, 16, 6, 128
#: Rounds over all findings, windows of a shard, Adam's rate in it, and the share of a shard's windows that the corpus's own findings make up, repeated if need be.
ROUNDS, SHARD, RATE, OWN_SHARE = 2, 1 << 15, 0.001, 0.2
#: Windows in a row of findings (more than a candidate of LONGEST has), bins of a unit of logit, and least held-out findings that constrain the threshold.
ROW_WINDOWS, BINS, LEAST_HELD = 32, 1024, 50

#: (text, candidate's start and end, place of the secret in it or None)
Finding = tuple[str, int, int, tuple[int, int] | None]

_TOKEN = np.zeros(256, bool)
_TOKEN[list((string.ascii_letters + string.digits + "+/_.=-").encode())] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _alphabet() -> np.ndarray:
    """Character classes: single digits and most signs alone, letters by case and by vowel or consonant group."""
    code = np.full(256, 1, np.int64)  # 0 is padding, 1 any other character
    groups = ["aeiou", "bcdfg", "hjklm", "npqrs", "tvwxyz"]
    symbols = [*string.digits, *groups, *(g.upper() for g in groups), *"+/_.=-:@ \n\"'()<>#,"]
    for n, chars in enumerate(symbols, 2):
        code[list(chars.encode())] = n
    return code


_CODE = _alphabet()
SYMBOLS = int(_CODE.max()) + 1
INSIDE = SYMBOLS  # a candidate's own characters use a second set of codes


def windows(start: int, end: int) -> list[int]:
    """Where the windows over a candidate are placed: from its start on, the last one BEFORE characters past its end."""
    last = max(start, end + BEFORE - AFTER)
    return [*range(start, last, STEP), last]


def encode(text: str, start: int, end: int, place: int | None = None) -> np.ndarray:
    """Codes of the characters of the window at place (the candidate's start if not given), those of the candidate text[start:end] marked."""
    place = start if place is None else place
    lo, hi = max(0, place - BEFORE), min(len(text), place + AFTER)
    raw = np.frombuffer(text[lo:hi].encode("latin-1", "replace"), np.uint8)
    out = np.zeros(BEFORE + AFTER, np.int64)
    at = BEFORE - (place - lo)
    codes = _CODE[raw]
    codes[max(start, lo) - lo : min(end, hi) - lo] += INSIDE
    out[at : at + len(raw)] = codes
    return out


def _finding(rng: random.Random) -> tuple[str, int, int, int]:
    """(text, start, end, label): a generated candidate in a generated surrounding."""
    some = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    alnum, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    syllable = lambda: rng.choice("b c d f g h l m n p r s t th sh wh ch st".split()) + rng.choice("a e i o u ea ou io".split()) + rng.choice(["", "n", "r", "t", "s", "nd"])
    word = lambda a=1, b=3: "".join(syllable() for _ in range(rng.randint(a, b)))
    long = lambda: "".join(iter(lambda w=[]: w.append(syllable()) or (w[-1] if len("".join(w)) < 24 else ""), ""))
    label = int(rng.random() < 0.5)
    if label:
        body = rng.choice([
            lambda: some(alnum, 20, 64), lambda: some(alnum + "+/", 24, 86) + rng.choice(["", "=", "=="]), lambda: some(alnum + "_-", 20, 64),
            lambda: rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "AIza", "npm_", "hf_", "SG."]) + some(alnum + "_-", 20, 40),
            lambda: "eyJ" + some(alnum, 20, 40) + "." + some(alnum + "_-", 20, 60) + "." + some(alnum + "_-", 20, 40), lambda: some("0123456789ABCDEF", 32, 64), lambda: some(upper, 20, 40),
        ])()
    else:
        body = rng.choice([
            long, lambda: some("etaoinshrdlcumwfgypbvkztch", 16, 40), lambda: some("etaoinshrdlcumwfgypbvkztch", 16, 30).upper(), lambda: some("etaoinshrdlcumwfgypbvkztch", 16, 30).capitalize() + rng.choice(["", "."]), lambda: long().upper(), lambda: long().capitalize() + ".", lambda: some(string.digits, 16, 22), lambda: "/".join(word() for _ in range(6)), lambda: ".".join(word() for _ in range(6)),
            lambda: "_".join(word() for _ in range(6)), lambda: "-".join(word() for _ in range(6)) + some(string.digits, 0, 4), lambda: "".join(word().capitalize() for _ in range(6)), lambda: rng.choice("=-_.+ax0") * rng.randint(16, 60),
            lambda: f"{some(string.digits, 4, 4)}-{some('01', 2, 2)}-{some('012', 2, 2)}-{some(string.digits, 8, 8)}", lambda: f"{word()}.{some(string.digits, 2, 4)}.{word()}{some(string.digits, 1, 2)}.example.com",
            lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{word()}.{rng.randint(0, 9999)}.{word()}", lambda: "-".join(some(string.digits, 3, 4) for _ in range(5)), lambda: "_".join(word().upper() for _ in range(5)),
        ])()
        body = body if len(body) >= LEAST else body + long()
    before = " ".join(word() for _ in range(rng.randint(0, 8))) + rng.choice(["\n", " ", " ", " (", ": ", "key: ", "auth=", 'value="', "Bearer ", "id ", ". ", "@"])
    after = rng.choice(["\n", " ", '"', ")", ", ", ""]) + " ".join(word() for _ in range(rng.randint(0, 8)))
    return before + body + after, len(before), len(before) + len(body), label


def _joined(rng: random.Random) -> tuple[str, int, int, tuple[int, int] | None]:
    """(text, start, end, the secret's place or None): one run of several generated candidates, at most one of them a secret."""
    parts, secret = [], None
    wanted = [0] * rng.randint(1, 4) + [1] * (rng.random() < 0.5)
    rng.shuffle(wanted)
    for want in wanted if sum(wanted) else [*wanted, 0]:
        made = _finding(rng)
        while made[3] != want:
            made = _finding(rng)
        at = sum(map(len, parts))
        secret = (at, at + made[2] - made[1]) if want else secret
        parts += [made[0][made[1] : made[2]], rng.choice("/._-=")]
    body = "".join(parts[:-1])
    around = _finding(rng)
    n = around[1]
    return around[0][:n] + body + around[0][around[2] :], n, n + len(body), secret and (n + secret[0], n + secret[1])


class Network:
    """Embedding-free convolution (a table look-up for each filter tap), max and mean pooling, one hidden layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.15, (WIDTH, 2 * SYMBOLS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.p[0][:, 0] = 0
        self.p = [p.astype(np.float32) for p in self.p]
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, codes: np.ndarray):
        taps, bias, w1, b1, w2, b2 = self.p
        n = codes.shape[1] - WIDTH + 1
        conv = bias + sum(taps[k][codes[:, k : k + n]] for k in range(WIDTH))
        on = np.maximum(conv, 0)
        top = on.argmax(1)
        pooled = np.concatenate([np.take_along_axis(on, top[:, None], 1)[:, 0], on.mean(1)], 1)
        hidden = np.maximum(pooled @ w1 + b1, 0)
        return hidden @ w2 + b2[0], (codes, n, conv, top, pooled, hidden)

    def gradients(self, error: np.ndarray, seen) -> list[np.ndarray]:
        taps, _, w1, _, w2, _ = self.p
        codes, n, conv, top, pooled, hidden = seen
        d_hidden = error[:, None] * w2 * (hidden > 0)
        d_pooled = d_hidden @ w1.T
        d_conv = np.repeat(d_pooled[:, None, FILTERS:] / n, n, 1)
        np.put_along_axis(d_conv, top[:, None], np.take_along_axis(d_conv, top[:, None], 1) + d_pooled[:, None, :FILTERS], 1)
        d_conv *= conv > 0
        shifted = np.zeros((*codes.shape, WIDTH, FILTERS), np.float32)
        for k in range(WIDTH):
            shifted[:, k : k + n, k] = d_conv
        d_taps = (np.eye(2 * SYMBOLS, dtype=np.float32)[codes.ravel()].T @ shifted.reshape(codes.size, -1)).reshape(-1, WIDTH, FILTERS).swapaxes(0, 1).copy()
        d_taps[:, 0] = 0
        return [d_taps, d_conv.sum((0, 1)), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ error, error.sum(keepdims=True)]

    def train(self, codes: np.ndarray, labels: np.ndarray, seed: int = 6, epochs: int = EPOCHS, rate: float = 0.004) -> None:
        """Adam on logistic loss."""
        rng = np.random.default_rng(seed)
        one, two, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for lo in range(0, len(order), BATCH):
                at = order[lo : lo + BATCH]
                logit, seen = self.forward(codes[at])
                step += 1
                for p, g, a, b in zip(self.p, self.gradients((1 / (1 + np.exp(-logit)) - labels[at]) / len(at), seen), one, two, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.p = [p.astype(float) for p in self.p]  # scores that don't hang on which windows are scored together

    def calibrate(self, logit: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> None:
        """Platt scaling on the logits of held-out findings, each as many times as given."""
        for _ in range(500):
            error = 1 / (1 + np.exp(-(self.slope * logit + self.shift))) - labels
            self.slope -= 0.05 * float(np.average(error * logit, weights=times))
            self.shift -= 0.05 * float(np.average(error, weights=times))

    def constrain(self, *secrets: np.ndarray) -> None:
        """The highest threshold (to nine digits) that keeps RECALL of each group of secrets, given by their logits."""
        held = [np.sort(self.scaled(logit)) for logit in secrets if len(logit)]
        self.threshold = float(min(x[int((1 - RECALL) * len(x))] for x in held)) - 1e-9

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def scaled(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logit + self.shift)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(codes))

    def highest(self, candidates: Iterator[tuple[str, int, int]]) -> np.ndarray:
        """The highest logit of each candidate's windows; as many windows as WINDOWS are held at a time."""
        best: list[float] = []
        codes: list[np.ndarray] = []
        owner: list[int] = []

        def settle() -> None:
            for i, x in zip(owner, self.logits(np.array(codes)).tolist(), strict=True):
                best[i] = max(best[i], x)
            codes.clear()
            owner.clear()

        for text, start, end in candidates:
            best.append(-np.inf)
            for place in windows(start, end):
                codes.append(encode(text, start, end, place))
                owner.append(len(best) - 1)
                if len(codes) == WINDOWS:
                    settle()
        settle()
        return np.array(best)


@cache
def _generated(seed: int) -> tuple[Finding, ...]:
    rng = random.Random(seed)
    alone = [(t, a, b, (a, b) if y else None) for t, a, b, y in (_finding(rng) for _ in range(FINDINGS))]
    return tuple(alone + [_joined(rng) for _ in range(JOINED)])


def _planted(finding: Finding, context: tuple[str, str]) -> Finding:
    """A finding with its outer surroundings (beyond a character on either side) taken from the corpus."""
    text, start, end, secret = finding
    before, after = context[0] + text[max(0, start - 1) : start], text[end : end + 1] + context[1]
    by = len(before) - start
    return before + text[start:end] + after, start + by, end + by, secret and (secret[0] + by, secret[1] + by)


@lru_cache(maxsize=8)
def trained(found: tuple[Finding, ...] = (), contexts: tuple[tuple[str, str], ...] = (), seed: int = 11) -> Network:
    """The network, trained on the windows of generated findings and of those `found` in a corpus; a fifth of both is held out for calibration.

    A window that sees LEAST characters of a secret is one to report, one that sees none isn't; others teach nothing.
    """
    made = list(_generated(seed))
    rng = random.Random(seed)
    if contexts:
        made = [_planted(f, rng.choice(contexts)) if i % 2 else f for i, f in enumerate(made)]
    rng.shuffle(made)
    seen = list(found)
    rng.shuffle(seen)
    network = Network()
    held, taught = made[: len(made) // 5] + seen[: len(seen) // 5], made[len(made) // 5 :] + seen[len(seen) // 5 :]
    codes, labels = [], []
    for text, start, end, secret in taught:
        for place in windows(start, end):
            visible = min(secret[1], place + AFTER) - max(secret[0], place - BEFORE) if secret else 0
            if visible <= 0 or visible >= LEAST:
                codes.append(encode(text, start, end, place))
                labels.append(float(visible > 0))
    network.train(np.array(codes), np.array(labels, np.float32))
    logit = network.highest((t, a, b) for t, a, b, _ in held)
    secret = np.array([s is not None for *_, s in held])
    generated = np.arange(len(held)) < len(made) // 5
    network.calibrate(logit, secret.astype(float))
    network.constrain(logit[secret & generated], logit[secret & ~generated])
    return network


def corpus_findings(docs: DataFrame, text_col: str = "text") -> tuple[tuple[Finding, ...], tuple[tuple[str, str], ...]]:
    """(findings, surroundings) of all texts, at most SAMPLE distinct ones of least hash each, the same for any partitioning.

    A finding is a candidate that a base pattern touches, the secret what of it the pattern holds;
    each text gives the surroundings of one of its blanks. Each task hands on its SAMPLE least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: tuple[list, list] = ([], [])  # heaps of (-rank, row)
        held: tuple[set, set] = (set(), set())

        def offer(kind: int, text: str, *about: int) -> None:
            row = (-zlib.crc32(text.encode("utf-8", "surrogatepass")), kind, text, *about)
            if row in held[kind] or (len(least[kind]) == SAMPLE and row < least[kind][0]):
                return
            held[kind].add(row)
            if len(least[kind]) < SAMPLE:
                heapq.heappush(least[kind], row)
            else:
                held[kind].discard(heapq.heapreplace(least[kind], row))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                blank = text.find(" ", zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(text))
                if blank > 0:
                    lo = max(0, blank - AROUND)
                    offer(1, text[lo : blank + 1 + AROUND], blank + 1 - lo, 0, 0, 0)
                for a, b, kind in base_spans(text):
                    for m in _CANDIDATE.finditer(text, max(0, a - LONGEST), b + LONGEST):
                        if m.start() < b and m.end() > a and m.end() - m.start() <= LONGEST:
                            lo = max(0, m.start() - AROUND)
                            start = max(a, m.start()) if kind else max(m.start(), ASSIGN.match(text, a).start(2))
                            if min(b, m.end()) - start >= 8:
                                offer(0, text[lo : m.end() + AROUND], m.start() - lo, m.end() - lo, start - lo, min(b, m.end()) - lo)
        rows = [(-r[0], *r[1:]) for heap in least for r in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*rows, strict=True))], names=["rank", "kind", "text", "a", "b", "c", "d"])

    taken = Table(docs.select(text_col).mapInArrow(run, "rank long, kind long, text string, a long, b long, c long, d long"), "findings")
    order = ["rank", "text", "a", "b", "c", "d"]
    found, contexts = (taken.df.filter(F.col("kind") == kind).distinct().orderBy(*order).limit(SAMPLE).collect() for kind in (0, 1))
    taken.drop()
    return tuple((r.text, r.a, r.b, (r.c, r.d)) for r in found), tuple((r.text[: r.a], r.text[r.a :]) for r in contexts)


def touched(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, places of secrets) of every candidate of which a base pattern holds 8 characters or more."""
    if not (base := base_spans(text)):
        return
    runs_ = [m.span() for m in _CANDIDATE.finditer(text)]
    ends, places = [b for _, b in runs_], {}
    for a, b, kind in base:
        i = bisect_right(ends, a)
        while i < len(runs_) and runs_[i][0] < b:
            start = max(runs_[i][0], a if kind else ASSIGN.match(text, a).start(2))
            if min(b, runs_[i][1]) - start >= 8:
                places.setdefault(i, []).append((start, min(b, runs_[i][1])))
            i += 1
    yield from ((*runs_[i], places[i]) for i in sorted(places))


def taught(text: str, start: int, end: int, places: list[tuple[int, int]]) -> Iterator[tuple[bytes, bytes]]:
    """(codes, labels) of a candidate's windows, ROW_WINDOWS at a time; label 1 sees LEAST characters of secrets, 0 none, and 2 teaches nothing."""
    secret = np.zeros(end - start + 1, np.int64)
    for a, b in places:
        secret[a - start + 1 : b - start + 1] = 1
    seen = np.cumsum(secret)
    at = windows(start, end)
    for lo in range(0, len(at), ROW_WINDOWS):
        some = at[lo : lo + ROW_WINDOWS]
        visible = np.array([seen[min(end, p + AFTER) - start] - seen[max(start, p - BEFORE) - start] for p in some])
        label = np.where(visible >= LEAST, 1, np.where(visible == 0, 0, 2)).astype(np.uint8)
        yield np.array([encode(text, start, end, p) for p in some]).astype(np.uint8).tobytes(), label.tobytes()


def all_findings(docs: DataFrame, text_col: str = "text") -> Table:
    """(kind, key, part, held, secret, codes, labels): the windows of every distinct finding of all texts.

    Kind 0 are the candidates that base patterns touch, kind 1 generated findings, one
    planted in the surroundings of a blank of each text. A fifth is held out: of kind 0
    by key, of kind 1 by the generated finding, so that none is also learned from elsewhere.
    """
    names = ["kind", "key", "part", "held", "secret", "codes", "labels"]
    types = [pa.int8(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]

    def hashed(*content: object) -> int:
        return int.from_bytes(hashlib.blake2b(repr(content).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def findings(text: str) -> Iterator[tuple]:
        for start, end, places in touched(text):
            lo = max(0, start - AROUND)
            around, start, end, places = text[lo : end + AROUND], start - lo, end - lo, [(a - lo, b - lo) for a, b in places]
            key = hashed(around, start, end, places)
            yield from ((0, key, i, key % 5 == 0, True, *row) for i, row in enumerate(taught(around, start, end, places)))
        blank = text.find(" ", zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(text)))
        if blank > 0:
            context = text[max(0, blank - AROUND) : blank + 1], text[blank + 1 : blank + 1 + AROUND]
            key, made = hashed(context), _generated(PLANTED)
            around, start, end, secret = _planted(made[key % len(made)], context)
            yield from ((1, key, i, key % len(made) % 5 == 0, secret is not None, *row) for i, row in enumerate(taught(around, start, end, [secret] if secret else [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for text in batch.column(0):
                for row in findings(text.as_py() or ""):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = docs.select(text_col).mapInArrow(run, "kind byte, key long, part int, held boolean, secret boolean, codes binary, labels binary")
    return Table(found.dropDuplicates(["kind", "key", "part"]), "findings")


def _learn(network: Network) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard's findings, in the order of their keys, train a copy of the network."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "key", "part"])
        codes = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(-1, BEFORE + AFTER)
        labels = np.frombuffer(b"".join(pdf["labels"]), np.uint8)
        own = np.repeat(pdf["kind"].to_numpy() == 0, pdf["labels"].map(len))
        own, planted = np.flatnonzero(own & (labels < 2)), np.flatnonzero(~own & (labels < 2))
        times = max(1, round(OWN_SHARE / (1 - OWN_SHARE) * len(planted) / max(1, len(own))))
        use = np.concatenate([planted, np.tile(own, times)])
        one = Network()
        one.p = [p.astype(np.float32) for p in network.p]
        if len(use):
            one.train(codes[use], labels[use].astype(np.float32), epochs=1, rate=RATE)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "windows": len(use), "weights": [np.concatenate([p.ravel() for p in one.p]).astype(np.float32).tobytes()]})

    return run


def learned(findings: Table, start: Network) -> Network:
    """The network after ROUNDS rounds over all findings from `start`, calibrated and constrained on all that are held out."""
    network = Network()
    network.p = [p.astype(float) for p in start.p]
    total = findings.df.agg(F.sum(F.length("labels"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // SHARD)))).alias("shard")
    for _ in range(ROUNDS):
        shards = Table(findings.df.filter("not held").select("*", shard).groupBy("shard").applyInPandas(_learn(network), "shard long, windows long, weights binary"), "weights")
        weight, sums = 0, 0.0
        for row in shards.df.orderBy("shard").toLocalIterator():
            weight, sums = weight + row.windows, sums + row.windows * np.frombuffer(row.weights, np.float32).astype(float)
        shards.drop()
        if weight:
            cuts = np.cumsum([p.size for p in network.p])[:-1]
            network.p = [x.reshape(p.shape) for x, p in zip(np.split(sums / weight, cuts), network.p, strict=True)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [np.frombuffer(c.as_py(), np.uint8).reshape(-1, BEFORE + AFTER) for c in batch.column(3)]
            if many:
                logit = network.logits(np.concatenate(many))
                best = np.maximum.reduceat(logit, np.cumsum([0, *map(len, many[:-1])]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best)], names=["kind", "key", "secret", "logit"])

    held = findings.df.filter("held").select("kind", "key", "secret", "codes").mapInArrow(score, "kind byte, key long, secret boolean, logit double")
    bins = held.groupBy("kind", "key", "secret").agg(F.max("logit").alias("logit")).groupBy("kind", "secret", F.floor(F.col("logit") * BINS).alias("bin")).count().orderBy("kind", "secret", "bin").collect()
    kind, secret, logit, times = (np.array(c) for c in zip(*[(r.kind, r.secret, r.bin / BINS, r["count"]) for r in bins], strict=True)) if bins else [np.zeros(0)] * 4
    made = [f for i, f in enumerate(_generated(PLANTED)) if i % 5 == 0]  # unplanted, so that some are held out in any corpus
    alone = np.floor(network.highest((t, a, b) for t, a, b, _ in made) * BINS) / BINS
    kind, secret = np.append(kind, np.ones(len(made))), np.append(secret, [s is not None for *_, s in made]).astype(bool)
    logit, times = np.append(logit, alone), np.append(times, np.ones(len(made))).astype(np.int64)
    network.calibrate(logit, secret.astype(float), times)
    least = []
    for at in (np.flatnonzero(secret & (kind == k)) for k in (0, 1)):
        if times[at].sum() >= LEAST_HELD:
            at = at[np.argsort(logit[at], kind="stable")]
            least.append(logit[at][np.searchsorted(np.cumsum(times[at]), int((1 - RECALL) * times[at].sum()), "right")])
    network.constrain(np.array([min(least)]))  # a bin's lower edge keeps all of it
    return network


def fitted(docs: DataFrame, text_col: str = "text") -> Network:
    """The network for these texts: trained by the driver if it can hold all that they teach, and else learned on in rounds over all of it."""
    found, contexts = corpus_findings(docs, text_col)
    start = trained(found, contexts)
    findings = all_findings(docs, text_col)
    whole = max(len(found), len(contexts)) < SAMPLE and findings.df.filter("part > 0").isEmpty()
    network = start if whole else learned(findings, start)
    findings.drop()
    return network


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, ordered by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]{32,}", text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def scan_block(text: pa.Array, data: np.ndarray, offs: np.ndarray, network: Network) -> list[list[tuple[int, int, int]]]:
    """All spans of each row: (start, end, kind number) in code points, base ones and the candidates that the network takes for secrets."""
    token_s, token_e, border = runs(_TOKEN[data], offs)
    long = np.flatnonzero(token_e - token_s >= LEAST)
    has = np.zeros(len(offs) - 1, bool)
    has[np.searchsorted(border, long, side="right") - 1] = True
    signs = np.flatnonzero((data == 58) | (data == 61))
    has[np.searchsorted(offs, signs, side="right") - 1] = True
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    texts, where = {}, []
    for i in np.flatnonzero(has).tolist():
        whole = text[i].as_py().decode("utf-8")
        spans[i] = base_spans(whole)
        at = long[(long >= border[i]) & (long < border[i + 1])]
        head = np.concatenate([[0], np.cumsum((data[offs[i] : offs[i + 1]] & 0xC0) != 0x80)])
        for a, b in zip(head[token_s[at] - offs[i]].tolist(), head[token_e[at] - offs[i]].tolist(), strict=True):
            texts[i] = whole
            where.append((i, a, b))
    found = network.scaled(network.highest((texts[i], a, b) for i, a, b in where))
    for (i, a, b), p in zip(where, found, strict=True):
        if p >= network.threshold:
            spans[i].append((a, b, 3))
    return [sorted(s, key=lambda x: (x[0], x[2])) for s in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones together) replaced by a mark of its kind."""
    out, at = [], 0
    for a, b, k in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", redacted: bool = False, network: Network | None = None) -> DataFrame:
    """Per row: the columns to keep, n_assign, n_access, n_hex, n_learned, base_sha256, spans, and the redacted text if asked for.

    Spans are `kind:start:end` in code points, end exclusive, by start and then kind,
    joined by commas; base_sha256 is the SHA-256 of those of the base patterns alone.
    Null text is empty text without spans (a redacted null stays null). Rows are
    independent, so repeated and null ids pass through; an empty table gives none.
    The network is trained for these texts unless one is given.
    """
    keep = ["doc_id"] if keep is None else keep
    network = network or fitted(docs, text_col)
    place = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            whole = text_array(column)
            for lo, hi, data, offs in blocks(whole):
                text = whole.slice(lo, hi - lo)
                spans = scan_block(text, data, offs, network)
                kinds = np.array([[sum(k == n for *_, k in s) for n in range(4)] for s in spans], np.int64).reshape(-1, 4)
                columns = [pa.array(kinds[:, n]) for n in range(4)]
                columns += [pa.array([hashlib.sha256(written([x for x in s if x[2] < 3]).encode()).hexdigest() for s in spans]), pa.array([written(s) for s in spans], pa.string())]
                names = ["n_assign", "n_access", "n_hex", "n_learned", "base_sha256", "spans"]
                if redacted:
                    kept = column.slice(lo, hi - lo)
                    columns.append(pa.array([redact(t.as_py(), s) if s else t.as_py() for t, s in zip(kept, spans, strict=True)], pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]), *columns], names=[*keep, *names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, f"{kinds}, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string" + ", redacted string" * redacted)
