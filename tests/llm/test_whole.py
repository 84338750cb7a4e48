"""Operators read the whole of what they judge."""

import random
import re

from brute import flow_by_single_paths, shares
from corvane.llm.fingerprint import fingerprint_documents
from corvane.llm.mixing import min_cost_flow, mix_sources, words_given
from corvane.llm.secret_scan import AFTER, BEFORE, SAMPLE, _joined, all_findings, base_spans, corpus_findings, learned, scan_secrets, trained, windows

KEY = "a8Kd93kLm2Zq81nB7xYp05RtVwQe4TgHj2Lc6Nf9"
PATH = "the/north/station/garden/window/morning/river/paper/letter/summer"


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return sorted(scan_secrets(docs, redacted=True).collect())


def test_secrets_behind_a_harmless_head(spark):
    head, key, both, long = scanned(spark, [f"see {PATH} now", f"see {KEY} now", f"see {PATH}/{KEY} now", f"see {'/'.join([PATH] * 9)}/{KEY} now"])
    assert len(PATH) > 48 and head.n_learned == 0
    assert key.n_learned == both.n_learned == long.n_learned == 1
    assert both.spans == f"learned:4:{len(PATH) + len(KEY) + 5}" and KEY not in both.redacted + long.redacted


def test_secrets_that_base_patterns_touch(spark):
    hex_ = "0123456789abcdef" * 2
    texts = [f"key sk_live_{hex_}-Zq81nB7xYp05RtVwQe4TgHj2 end", f"x {KEY}.token=abcdefgh1 end", "password=short secret: x-y_z.12345", f"see {PATH}.token=abcdefgh1"]
    issued, random_, plain, path = scanned(spark, texts)
    assert issued.spans == f"learned:4:{len(texts[0]) - 4},hex:12:44"
    assert issued.redacted == "key [LEARNED] end" and issued.n_hex == 1
    assert random_.redacted == "x [LEARNED] end" and random_.n_assign == 1
    assert plain.n_learned == 0 and plain.n_assign == 1 and path.n_assign == 1 and path.n_learned == 0


def test_windows_cover_candidates_and_their_surroundings():
    for n in range(16, 400):
        places = windows(100, 100 + n)
        seen = {i for p in places for i in range(p - BEFORE, p + AFTER)}
        assert seen >= set(range(100 - BEFORE, 100 + n + BEFORE)) and len(places) == len(set(places))


def test_secret_network_keeps_recall_on_joined_runs():
    rng = random.Random(77)
    found = [_joined(rng) for _ in range(600)]
    network = trained()
    caught = network.scaled(network.highest((t, a, b) for t, a, b, _ in found)) >= network.threshold
    secret = [s is not None for *_, s in found]
    assert sum(c for c, s in zip(caught, secret, strict=True) if s) >= 0.94 * sum(secret)
    assert sum(c for c, s in zip(caught, secret, strict=True) if not s) <= 0.03 * secret.count(False)


def test_network_carries_the_learned_spans(spark, monkeypatch):
    """Every candidate of the whole table is scored: tokens are found, words aren't, and without the network nothing is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, contexts = corpus_findings(docs)
    assert found and contexts and all(t[c:d] in t[a:b] for t, a, b, (c, d) in found)
    assert (found, contexts) == corpus_findings(docs.repartition(5))
    network = trained(found, contexts)
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = {(r.doc_id, *map(int, s.split(":")[1:])) for r in scan_secrets(docs, network=network).collect() for s in r.spans.split(",") if s.startswith("learned")}
    runs = [(i, m.start(), m.end()) for i, t in texts.items() if t for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", t)]
    best = network.scaled(network.highest((texts[i], a, b) for i, a, b in runs))
    assert spans == {r for r, p in zip(runs, best, strict=True) if p >= network.threshold}
    touched = {(i, a, b) for i, a, b in runs if any(x < b and y > a for x, y, _ in base_spans(texts[i]))}
    assert len(spans & touched) >= 0.95 * len(touched) > 0 and len(spans - touched) <= 0.01 * len(runs)
    monkeypatch.setattr(network, "p", [p * 0 for p in network.p])
    assert all(r.n_learned == 0 for r in scan_secrets(docs, network=network).collect())


def test_secrets_are_learned_from_every_finding(spark):
    rng = random.Random(8)
    texts = [f"door {i} has token={''.join(rng.choices('0123456789abcdefghjkXYZ', k=32))} in it" for i in range(SAMPLE + 300)] + ["old token=" + "a1B" * 700 + " end"]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], None, ""])), "doc_id long, text string")
    one, two = all_findings(docs), all_findings(docs.repartition(7))
    own = one.df.filter("kind = 0")
    assert own.select("key").distinct().count() == len(texts) > SAMPLE and own.filter("part > 0").count() > 0
    assert one.df.filter("kind = 1").select("key").distinct().count() > SAMPLE
    assert 0.1 < own.filter("held").count() / own.count() < 0.3
    start = trained()
    network, again = learned(one, start), learned(two, start)
    assert network.threshold == again.threshold and all((a == b).all() for a, b in zip(network.p, again.p, strict=True))
    assert any((a != b).any() for a, b in zip(network.p, start.p, strict=True))
    assert scan_secrets(docs, network=network).filter("n_learned > 0").count() >= 0.96 * len(texts)


def test_edits_are_located_in_paragraphs_and_pieces(spark):
    line = "".join(f"Sentence number {n} of it. " for n in range(4)) + "\n"
    one = "".join(f"{k} {line}" for k in range(7))
    blank = one + "\n" + one
    texts = [one, "x" * 30 + "\n", one + "tail", blank, "y" * 40, "z", "z", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    for i, text in enumerate(texts):
        n = len(text) // 2
        edited = text[: len(text) - n] + (texts[(i + 1) % len(texts)])[:n]
        assert (got[i].first_edited_section, got[i].first_edited_paragraph, got[i].first_edited_piece) == place(text, edited), i
    assert "\n\n" not in one and got[0].first_edited_section == 1 and got[0].first_edited_paragraph == 4 and got[0].first_edited_piece > 1
    assert got[3].first_edited_section == 2


def place(one, other):
    """Section, paragraph and piece of the first difference, by plain cutting."""
    cut = [lambda t: re.split(r"(?<=\n\n)(?!\n)", t), lambda t: re.split(r"(?<=\n)(?!\n)", t), lambda t: re.findall(r"(?s:.{1,31}?[.!?]\s|.{1,32})", t)]
    if one == other:
        return 0, 0, 0
    found = []
    for split in cut:
        a, b = [x for x in split(one) if x], [x for x in split(other) if x]
        at = next(k for k in range(max(len(a), len(b))) if a[k : k + 1] != b[k : k + 1])
        found.append(at + 1)
        one, other = "".join(a[at : at + 1]), "".join(b[at : at + 1])
    return tuple(found)


def test_plans_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 60}", "w " * (i % 7 + 1)) for i in range(600)], "doc_id long, source string, text string").repartition(3)
    want = sorted(mix_sources(docs, [5, 2, 1], 1.5).collect())
    monkeypatch.setattr("corvane.llm.mixing.BROADCAST_PATTERNS", 20)
    monkeypatch.setattr("corvane.llm.mixing.BORDERS", 7)
    got = sorted(mix_sources(docs, [5, 2, 1], 1.5).collect())
    assert got == want and len({r.source for r in got}) == 60


def test_flow_against_single_paths():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        members = [sorted(rng.sample(range(n), rng.randint(1, n))) for _ in range(rng.randint(1, 12))]
        supply, quota, copies = [rng.randint(0, 30) for _ in members], [rng.randint(0, 80) for _ in range(n)], rng.randint(1, 3)
        plain, got = flow_by_single_paths(supply, members, quota, copies), min_cost_flow(supply, members, quota, copies)
        cost = lambda given: sum(max(0, g - k * s) for g, s in zip(given, supply, strict=True) for k in range(1, copies))
        assert sum(got) == sum(plain) and cost(got) == cost(plain) and all(0 <= g <= copies * s for g, s in zip(got, supply, strict=True))


def test_flow_only_where_patterns_overlap():
    rng = random.Random(3)
    for _ in range(50):
        members = [[s] for s in range(6)] + [sorted(rng.sample(range(6, 10), rng.randint(1, 3))) for _ in range(4)]
        supply, quota = [rng.randint(0, 30) for _ in members], [rng.randint(0, 50) for _ in range(10)]
        plain, got = flow_by_single_paths(supply, members, quota, 2), words_given(supply, members, quota, 2)
        again = lambda given: sum(max(0, g - n) for g, n in zip(given, supply, strict=True))
        assert got[:6] == plain[:6] and sum(got) == sum(plain) and again(got) == again(plain)


def test_many_overlapping_patterns():
    members = [[s, s + 1] for s in range(24_999)] + [[s] for s in range(25_000)]
    supply, quota = [10] * len(members), [25 if s % 2 else 15 for s in range(25_000)]
    given = words_given(supply, members, quota, 2)
    assert sum(given) == sum(quota) and sum(max(0, g - 10) for g in given) <= sum(quota) - sum(supply) + 10 * 5


def test_mixing_of_documents_in_several_sources(spark):
    """End to end on overlapping sources: what patterns give is a least-cost flow, and what documents give adds up to it."""
    rng = random.Random(9)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], ["a", "b", "c"], ["d"], ["c", "d"], [None], ["a", None], []]
    rows = [(i, rng.choice(kinds), " ".join("w" * rng.randint(1, 9))) for i in range(900)] + [(900 + i, ["a", "b"], "w w") for i in range(50)] + [(None, ["c"], "w"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source array<string>, text string").repartition(4)
    got = mix_sources(docs, [5, 2, 1], 1.5).collect()
    words = lambda t: len((t or "").split())
    pattern = lambda s: tuple(sorted(set(s) if s is not None else {None}, key=lambda x: (x is not None, x or "")))
    names = ["a", "b", "c", "d", None]
    size = {n: sum(words(t) for _, s, t in rows if n in pattern(s)) for n in names}
    target = dict(zip(names, shares(1.5 * sum(words(t) for *_, t in rows), [5, 2, 1, 5, 2], [2 * size[n] for n in names]), strict=True))
    patterns = sorted({pattern(s) for _, s, _ in rows}, key=str)
    supply = [sum(words(t) for _, s, t in rows if pattern(s) == p) for p in patterns]
    plain = flow_by_single_paths(supply, [[names.index(x) for x in p] for p in patterns], [round(target[n]) for n in names], 2)
    again = lambda given: sum(max(0, g - n) for g, n in zip(given, supply, strict=True))
    taken = [sum(r.taken for r in got if pattern(r.source) == p) for p in patterns]
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert abs(sum(taken) - sum(plain)) <= 5 * len(patterns) and abs(again(taken) - again(plain)) <= 5 * len(patterns)
    assert any(0 < t < 2 * n for t, n in zip(taken, supply, strict=True)) and sum(taken) > 0
    for r in got:
        best = max(pattern(r.source), key=lambda n: size[n], default=None) if pattern(r.source) else None
        assert r.source_size == (size[best] if pattern(r.source) else None) and (not pattern(r.source) or abs(r.target - target[best]) < 1e-6)
    assert sorted(mix_sources(docs.repartition(7), [5, 2, 1], 1.5).collect(), key=str) == sorted(got, key=str)
