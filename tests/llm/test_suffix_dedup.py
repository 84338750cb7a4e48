import random

import pytest
from brute import repeats
from corvane.llm.suffix_dedup import dedup_spans

SHAPE = "doc_id long, text string, fill int, n_bytes string"


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def sample(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst é") for _ in range(rng.randint(1, 7)))
    line = " ".join(word() for _ in range(18))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 120)))
        if i % 3 == 0:
            text = text[: len(text) // 2] + line + text[len(text) // 2 :]
        if i % 7 == 0 and rows:
            text = rows[-3 % len(rows)][1] or ""
        if i % 11 == 0 and rows:
            text = (rows[-1][1] or "") + text
        rows.append((i, text))
    return rows + [(60, None), (61, ""), (62, "a" * 300), (63, "b" + "a" * 200 + "c"), (64, line), (65, "x" * 49), (66, "x" * 49), (67, "ab" * 90), (68, "ba" * 60)]


@pytest.mark.parametrize(("depth", "common"), [(50, 256), (50, 1), (20, 2), (7, 256)])
def test_against_brute_force(spark, depth, common):
    rows = sample()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SHAPE).repartition(5)
    assert got(dedup_spans(docs, depth, common_parts=common)) == repeats(rows, depth)


def test_small_table_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(dedup_spans(docs.repartition(3))) == repeats(rows, 50)


def test_equal_and_null_ids_and_empty_table(spark):
    text = "the same words over and over, more than fifty bytes of them at least"
    docs = spark.createDataFrame([(1, text, 0, ""), (1, text, 0, ""), (None, text, 0, ""), (2, text, 0, "")], SHAPE)
    removed = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in dedup_spans(docs).collect())
    assert removed == [(False, 1, 0), (False, 1, 0), (False, 2, len(text)), (True, 0, 0)]
    assert dedup_spans(docs.filter("doc_id > 9")).count() == 0
    assert [bytes(r.kept).decode() for r in dedup_spans(docs.filter("doc_id = 1").limit(1), keep_text=True).collect()] == [text]
