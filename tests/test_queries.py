"""Registered queries run over whole tables, whole texts and whole vectors."""

from corvane.plans.queries import QUERIES, SQL


def test_queries_over_all_words_and_components(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    unique = {r.doc_id: r.ok for r in QUERIES["kw_unique_items"](spark, sf_dir).collect()}
    assert unique == {i: int(len(set(t.split(" "))) == len(t.split(" "))) for i, t in docs.items()}
    joined = {r.doc_id: (r.lf, r.crlf, r.closed) for r in QUERIES["str_join_lines"](spark, sf_dir).collect()}
    assert joined == {i: (t.replace(" ", "\n"), t.replace(" ", "\r\n"), t.replace(" ", "\n") + "\n") for i, t in docs.items()}
    rest = {r.vec_id: r.ok for r in QUERIES["kw_unevaluated_items"](spark, sf_dir).collect()}
    assert rest == {i: int(any(x >= 0 for x in e) and all(x >= -1 for x in e[1:])) for i, e in vectors.items()}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
