"""Very long texts, repeated rows and empty tables through every text operator."""

import hashlib
import random

import public_tokenizers
import pytest
from corvane.llm.fingerprint import fingerprint_documents
from corvane.llm.mixing import mix_sources
from corvane.llm.ngram_join import jaccard_components
from corvane.llm.packing import pack_sequences
from corvane.llm.quality import fit, score_documents
from corvane.llm.secret_scan import scan_secrets
from corvane.llm.suffix_dedup import dedup_spans
from corvane.llm.token_counts import count_tokens
from tokenizers import Tokenizer

SHAPE = "doc_id long, text string, source string, part long, node long, _0 string, size string, block int"


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(8)
    words = [f"w{i:x}é" for i in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(300_000))  # about 2 MB
    solid = "a" * 200_000 + "b" * 200_000
    rows = [(0, text), (1, text + " token = 'abcdefgh12345678'"), (2, text[: len(text) // 2]), (3, solid), (3, solid), (4, None), (5, "")]
    return rows, spark.createDataFrame([(i, t, None if i % 2 else "s", 0, 0, "x", "x", 0) for i, t in rows], SHAPE).repartition(3)


def test_long_texts(spark, long_docs):
    rows, docs = long_docs
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(docs, 3, 0.9).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5)]
    cut = {r.doc_id: r for r in dedup_spans(docs).collect()}
    assert cut[0].n_removed == 0 and cut[2].n_removed == cut[2].n_bytes and cut[1].n_bytes - cut[1].n_removed <= 28 and cut[3].n_removed == 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: r.n_tokens for r in count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert tokens[3] == len(library.encode(rows[3][1], add_special_tokens=False).ids) and tokens[4] == 0
    pieces = pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == [0, 1, 2, 3, 3, 4, 5]
    marks = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert marks[0].n_chars == len(rows[0][1]) and marks[0].near_next > 0.9 and marks[4].fingerprint == marks[5].fingerprint
    found = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert found[1].n_assign == 1 and found[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(mix_sources(docs, [5, 2, 1], 1.5).collect()) == len(rows)
    import numpy as np

    from corvane.llm.quality import N_FEATURES

    assert len(score_documents(docs, fit(np.zeros((0, N_FEATURES)), np.zeros(0))).collect()) == len(rows)


def test_empty_tables(spark, long_docs):
    empty = long_docs[1].filter("doc_id < 0")
    path = public_tokenizers.path("word_bpe_49k.json")
    for made in (jaccard_components(empty), dedup_spans(empty), fingerprint_documents(empty), scan_secrets(empty), mix_sources(empty, [1], 1.0), pack_sequences(empty, path)):
        assert made.count() == 0 and made.columns
