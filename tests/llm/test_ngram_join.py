import random

import pytest
from brute import jaccard
from corvane.llm import ngram_join
from corvane.llm.ngram_join import jaccard_components, light_limit, settle


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def sample(seed, groups=25, longest=160):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(1, longest))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                words = words[rng.randint(0, 2) :]
            rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.2 else "\n".join(words)))
    return rows + [(len(rows), None), (len(rows) + 1, "  \t\n"), (len(rows) + 2, "one"), (len(rows) + 3, "ONE"), (len(rows) + 4, "one two")]


@pytest.mark.parametrize(("words", "t"), [(3, 0.9), (5, 0.8), (2, 0.8)])
def test_against_brute_force(spark, words, t):
    for seed, longest in ((1, 160), (2, 30)):
        rows = sample(seed, longest=longest)
        docs = spark.createDataFrame([(i, x, "n") for i, x in rows], "doc_id long, text string, node string").repartition(4)
        assert got(jaccard_components(docs, words, t)) == jaccard(rows, words, round(100 * t))


def test_groups_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 4000)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):  # a chain in which neighbours link and ends don't, and a dense group
        words = [f"c{max(i, j)}" if j < 40 else w for j, w in enumerate(base)] if i < 40 else list(base)
        if i >= 40:
            words[rng.randrange(60)] = "x"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(jaccard_components(docs, 3, 0.9)) == jaccard(rows, 3, 90)


def test_large_groups_of_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 8000)
    rng = random.Random(11)
    passages = [[f"p{k}_{i}" for i in range(40)] for k in range(3)]
    rows = []
    for _ in range(30):  # clusters that share passages, and so their rarest shingles, but don't link
        base = [*rng.choice(passages), *(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120)))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 5)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard_components(docs, 3, 0.9)) == jaccard(rows, 3, 90)


def test_visiting_sets_pass_by_in_bounded_runs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    some = lambda: rng.integers(1, 1 << 62, 50, dtype=np.uint64)
    rows = []
    for grp, chunk in ((1, 0), (1, 1), (2, 0)):
        own = [np.unique(some()) for _ in range(4)]
        guests = [np.unique(own[i % 4]) if i % 5 == 0 else np.unique(some()) for i in range(40)]
        rows += [(grp, chunk, False, grp * 1000 + chunk * 100 + i, s.tobytes()) for i, s in enumerate(own)]
        rows += [(grp, chunk, True, 10_000 + len(rows) + i, s.tobytes()) for i, s in enumerate(guests)]
    held = []
    whole = ngram_join.settle
    monkeypatch.setattr(ngram_join, "settle", lambda sets, *a: held.append(sum(len(s) * 8 for s in sets)) or whole(sets, *a))
    names = ["grp", "chunk", "visitor", "label", "items"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7], strict=True)], names=names) for i in range(0, len(rows), 7)]
    found = {tuple(sorted(p)) for b in ngram_join._visits(0.9, 1500)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    by_set = {}
    for grp, chunk, _, label, items in rows:
        by_set.setdefault((grp, chunk, items), set()).add(label)
    together = {label: min(s) for s in by_set.values() for label in s}
    assert found and all(together[u] == together[v] for u, v in found)
    linked = {x for p in found for x in p}
    assert linked == {label for s in by_set.values() if len(s) > 1 for label in s}
    assert max(held) <= 4 * 400 + 1500 + 400 and len(held) == 30


@pytest.mark.parametrize("t", [0.9, 0.8, 0.6, 0.95])
def test_linked_sets_share_a_piece(t):
    import numpy as np
    from corvane.llm.ngram_join import piece_keys

    rng = np.random.default_rng(7)
    for n in [*range(1, 60), 100, 400, 3000]:
        for _ in range(8):
            a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
            drop = rng.integers(0, int(n * (1 - t)) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 62, rng.integers(0, drop + 2), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and common >= t * (len(a) + len(b) - common) - 1e-9:
                for seed in range(3):
                    assert np.intersect1d(piece_keys(a, t, seed), piece_keys(b, t, seed)).size, (n, drop)


@pytest.mark.parametrize("t", [0.9, 0.8, 0.6])
def test_linked_sets_share_a_list(t):
    import numpy as np
    from corvane.llm.ngram_join import PartSets

    rng = np.random.default_rng(3)
    light = light_limit(t)
    assert light >= 2
    for n in [*range(1, 45), 100, 400]:
        for _ in range(6):
            a = rng.integers(1, 1 << 62, n, dtype=np.uint64)
            drop = rng.integers(0, int(n * (1 - t)) + 1)
            b = np.concatenate([a[drop:], rng.integers(1, 1 << 62, rng.integers(0, drop + 2), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if common >= t * (len(a) + len(b) - common) - 1e-9:
                both = PartSets.__new__(PartSets)
                both.sets = [np.unique(a), np.unique(b)]
                both.rep = np.array([0, 1 if drop else 0])
                both.first = np.unique(both.rep)
                keys, row, _ = both.lists(light, t, None, 4)
                assert not drop or np.intersect1d(keys[row == 0], keys[row == 1]).size, (n, drop)
                assert len(set(settle([np.unique(a), np.unique(b)], t))) == 1


def test_empty_table_null_and_equal_ids(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (5, "A B C D")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard_components(docs, 3, 0.9).collect()) == [(-1, 3), (3, 3), (3, 3), (5, 3)]
    assert jaccard_components(docs.filter("doc_id > 99"), 3, 0.9).count() == 0
