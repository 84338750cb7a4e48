"""Components, embeddings, fingerprints, chat and the pipeline."""

import hashlib
import json
import random

import numpy as np
import pytest
from brute import components as plain_components
from brute import jaccard
from corvane.llm import embed_dedup
from corvane.llm.chat import format_chat, valid_against
from corvane.llm.components import components
from corvane.llm.embed_dedup import link_embeddings
from corvane.llm.fingerprint import fingerprint_documents, with_next
from corvane.plans.model import SchemaError
from pyspark.sql import functions as F


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).df.collect()}
    want = plain_components({x for a, b in links if a != b for x in (a, b)}, [x for x in links if x[0] != x[1]])
    assert got == want
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).df.count() == 0


@pytest.mark.parametrize(("rows", "lists"), [(1024, 512), (7, 20)])
def test_embeddings_against_all_pairs(spark, monkeypatch, rows, lists):
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(embed_dedup, "LIST_ROWS", lists)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    data = []
    for i in range(300):
        v = base[rng.integers(60)] + rng.normal(size=24) * rng.choice([0, 0.05, 0.1, 0.2])
        data.append((i, [float(x) for x in np.float32(v)], int(rng.integers(2))))
    data += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] + [1.0] * 23, 1), (303, data[0][1], None), (304, [None] + [1.0] * 23, 0), (305, [2.0, 2.0], 0), (310, [2.0, 2.1], 0), (311, [2.0, -2.1], 0), (306, [1.0, 1.0], 0), (307, [1.0, 1.0], 1), (308, [], 0), (309, [float("inf")] * 24, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    usable = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, l in data if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: l for i, _, l in data}
    links = [(a, b) for a in usable for b in usable if a < b and label[a] == label[b] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.98]
    least = plain_components({i for i, *_ in data}, links)
    assert {i: sum(i in x for x in links) for i in least} == {i: n for i, (n, *_) in got.items()}
    assert least == {i: c for i, (_, c, _) in got.items()}
    assert all(k == (c == i) for i, (_, c, k) in got.items())
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert link_embeddings(empty).count() == 0


def test_embedding_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(5)
    data = [(r.vec_id, np.array(r.embedding, float), r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    for i, v, label in data[:500]:  # three neighbours each, at cosines around the threshold
        for k in range(3):
            data.append((10_000 * (k + 1) + i, v + rng.normal(size=len(v)) * np.linalg.norm(v) * rng.uniform(0.05, 0.24) / len(v) ** 0.5, label))
    rows = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in data], "vec_id long, embedding array<double>, label int").repartition(8)
    found = sum(r.n_links for r in link_embeddings(rows).collect())
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in data])
    label = np.array([l for *_, l in data])
    want = int(((unit @ unit.T >= 0.98) & (label[:, None] == label)).sum()) - len(data)
    assert want > 0 and 0.99 * want <= found <= want


def test_fingerprints(spark):
    texts = {5: "One. Two.\n\nThree é four.\n", 9: None, 11: "", 20: "One. Two.\n\nThree é four.\n", -3: "x", 40: "long words " * 300, 41: "p\n" * 50, 70: "😀" * 99}
    rows = list(texts.items())
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars int").repartition(4)
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    order = sorted(texts)
    for n, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == text)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1 and (edited != text or got[i].near_edited == 1)
    assert got[5].fingerprint == got[20].fingerprint != got[40].fingerprint and got[9].fingerprint == got[11].fingerprint
    assert got[9].near_next == 1 and got[11].near_next == 0 and got[40].first_edited_section == 1
    assert fingerprint_documents(docs.filter("doc_id = 99")).count() == 0
    one = fingerprint_documents(docs.filter("doc_id = 40")).first()
    assert one.near_next == 1


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("corvane.llm.fingerprint.ROWS_PER_RANGE", 10)
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-(10**12), 10**12), 290)) + [10**15] * 3
    rows = [(i, f"t{i}-{n}") for n, i in enumerate(ids)] + [(None, "null a"), (None, "null b")]
    got = {r.text: r.next_text for r in with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    order = [t for _, t in rows]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


TOOLS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 0}, "s": {"enum": ["x", "y"]}, "l": {"type": "array", "items": {"type": "number", "maximum": 3}}}}}


def test_chat(spark):
    call = lambda turn, cid, args, name="add": ("c", turn, "assistant", "call", cid, name, args, None)
    back = lambda turn, cid: ("c", turn, "tool", "result", cid, None, None, "ok\n\"é\"")
    rows = [
        call(5, "k1", '{"s":"x","a":1.0}'), back(2, "k1"), call(6, "k2", '{"a":{"$result":"k1"}}'), call(7, "k3", '{"a":2,"b":{"$result": "k2"}}'), back(9, "none"), call(8, "k4", "no json"),
        call(9, "z1", '{"a":{"$result":"z2"}}'), call(10, "z2", '{"a":{"$result":"z1"}}'), call(11, None, '{"a":null,"l":[1,2.5]}'), call(12, "k9", '{"a":1,"l":[4]}', "other"), back(13, "k1"), back(13, "k1"),
        ("c", 1, "user", "message", None, None, None, None), (None, 1, "user", "call", "k1", "add", '{"a":-1}', None), ("d", 1, None, None, "k1", None, "x", "text"),
    ]
    shape = "conv_id string, turn long, role string, kind string, call_id string, name string, arguments string, content string"
    events = spark.createDataFrame(rows, shape).withColumn("level", F.lit("clash"))
    got = format_chat(events, TOOLS).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn, r.kind): r for r in got}
    assert [(by["c", t, "call"].status, by["c", t, "call"].level, by["c", t, "call"].valid) for t in (5, 6, 7, 8, 9, 10, 11, 12)] == [
        ("linked", 0, 1), ("open", 1, 0), ("open", 2, 0), ("open", 0, 0), ("cyclic", 0, 0), ("cyclic", 0, 0), ("open", 0, 1), ("open", 0, 0),
    ]
    assert by["c", 5, "call"].linked_turn == 2 and by["c", 2, "result"].linked_turn == 5 and by["c", 9, "result"].status == "orphan"
    assert by[None, 1, "call"].linked_turn is None and by[None, 1, "call"].status == "open" and by["c", 1, "message"].status == "plain"
    assert by["c", 5, "call"].message == '{"arguments":{"a":1,"s":"x"},"id":"k1","name":"add","role":"assistant","type":"call"}'
    assert json.loads(by["c", 2, "result"].message) == {"call_id": "k1", "content": 'ok\n"é"', "role": "tool", "type": "result"}
    assert format_chat(events.filter("turn > 99"), TOOLS).count() == 0


def test_escaped_ids_any_enum_and_one_text_for_a_number(spark):
    tools = {"t": {"properties": {"n": {"enum": [3, 4.50, None, [1.0], {"a": "x"}]}, "c": {"const": 1e20}, "s": {"pattern": "^a", "not": {"const": "ab"}}, "l": {"contains": {"type": "integer", "exclusiveMinimum": 2}, "uniqueItems": True}}}}
    shape = "conv_id string, turn long, role string, kind string, call_id string, name string, arguments string, content string"
    ids = ['a"b', "a\\", "é", "x y", '"$result":"a']
    rows = [("c", i, "assistant", "call", x, "t", "{}", None) for i, x in enumerate(ids)]
    rows += [("c", 10 + i, "assistant", "call", f"n{i}", "t", json.dumps({"deep": [{"$result": x, "more": 1}]}), None) for i, x in enumerate(ids)]
    # what only looks like a reference: inside a string, as a name's end, with a value that is no string
    rows += [("c", 20 + i, "assistant", "call", f"p{i}", "t", a, None) for i, a in enumerate([json.dumps({"q": '{"$result":"é"}'}), json.dumps({'x"$result': "é"}), '{"$result":5,"y":"é"}', '{"$result":["é"]}', '{"$result":""}', "[]"])]
    checks = {'{"n":3}': 1, '{"n":3.0}': 1, '{"n":4.5}': 1, '{"n":null}': 1, '{"n":[1]}': 1, '{"n":{"a":"x"}}': 1, '{"n":"3"}': 0, '{"n":5}': 0, '{"c":100000000000000000000}': 1, '{"c":1e20}': 1, '{"s":"ac"}': 1, '{"s":"ab"}': 0, '{"s":"b"}': 0, '{"l":[1,3]}': 1, '{"l":[3,3.0]}': 0, '{"l":[2]}': 0}
    rows += [("d", i, "assistant", "call", f"k{i}", "t", a, None) for i, a in enumerate(checks)]
    got = {(r.conv_id, r.turn): r for r in format_chat(spark.createDataFrame(rows, shape), tools).collect()}
    assert [got["c", 10 + i].level for i in range(len(ids))] == [1] * len(ids)
    assert [got["c", 20 + i].level for i in range(6)] == [0] * 6 and all(got["c", i].status == "open" for i in [0, 10, 20, 25])
    assert {a: got["d", i].valid for i, a in enumerate(checks)} == checks
    texts = {json.loads(r.message)["id"]: r.message for (c, _), r in got.items() if c == "d"}
    assert texts["k8"].partition(',"id"')[0] == texts["k9"].partition(',"id"')[0] == '{"arguments":{"c":100000000000000000000}'
    with pytest.raises(SchemaError):
        valid_against(F.col("v"), {"properties": {"x": {"$ref": "#"}}})


def test_calls_and_results_are_hash_joined(spark):
    shape = "conv_id string, turn long, role string, kind string, call_id string, name string, arguments string, content string"
    events = spark.createDataFrame([("c", 1, "a", "call", "k", "add", "{}", None), ("c", 2, "t", "result", "k", None, None, "x")], shape)
    plan = format_chat(events, TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 3 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "Python" not in plan and "Pandas" not in plan


def test_levels_of_long_chains_and_diamonds(spark):
    from corvane.llm.chat import call_levels

    rows = [("c", str(i), [str(i - 1)] if i else []) for i in range(70)] + [("d", "a", []), ("d", "b", ["a", "x"]), ("d", "e", ["a", "b"]), ("d", "f", ["e", "a", "b"]), ("d", "g", ["g"]), ("d", "h", ["g", "a"])]
    got = {(r.conv_id, r.call_id): r.level for r in call_levels(spark.createDataFrame(rows, "conv_id string, call_id string, needs array<string>")).collect()}
    assert got == {("c", str(i)): i for i in range(70)} | {("d", "a"): 0, ("d", "b"): 1, ("d", "e"): 2, ("d", "f"): 3}


def test_validation_of_missing_values(spark):
    df = spark.createDataFrame([("{}",), ("null",), ("[1]",), ("x",), (None,)], "j string")
    kinds = df.select(valid_against(F.try_parse_json("j"), {"type": "object", "required": []}).alias("o"), valid_against(F.try_parse_json("j"), {"items": {"type": "integer"}}).alias("a")).collect()
    assert [(r.o, r.a) for r in kinds] == [(True, True), (False, True), (False, True), (False, False), (False, False)]


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as pipeline
    from corvane.llm.shared import Table

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10_000, None, "en", "src0", 0), (10_001, "", None, None, None)]
    docs = Table(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "start").df
    steps = [docs]
    for name, stage in pipeline.STAGES:
        steps.append(Table(stage(spark, steps[-1], sf), name.replace(" ", "-")).df)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(i for i, (_, c) in jaccard(rows, 5, 80).items() if i == c)
    before, after = {r.doc_id: r for r in steps[2].collect()}, {r.doc_id: r for r in steps[3].collect()}
    assert before.keys() == after.keys()
    assert all(after[i].text == before[i].text or ("[" in after[i].text and after[i].n_chars == len(after[i].text)) for i in before)
    taken = [r.doc_id for r in steps[4].collect()]
    assert set(taken) <= set(after) and max(map(taken.count, taken)) <= 2
    pieces = steps[5].collect()
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == sorted(taken)
    assert all(s.columns == docs.columns for s in steps[:5])


def test_pipeline_takes_columns_of_any_name_and_leaves_no_tables(spark):
    import corpus_pipeline as pipeline
    from corvane.llm.shared import Table, drop_tables, live_tables

    drop_tables()
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["score", "predicted", "spans", "redacted", "n_assign", "_id", "_copies", "_copy", "size", "taken", "target", "node", "part", "component_id", "extra_column_0"]
    wide = Table(docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names)), "wide")
    plain = Table(docs, "plain")
    for _, stage in pipeline.STAGES[:-1]:
        one, other = Table(stage(spark, wide.df, sf), "wide"), Table(stage(spark, plain.df, sf), "plain")
        drop_tables(one, other)
        wide, plain = one, other
        assert wide.df.columns == [*docs.columns, *names]
        assert sorted(wide.df.select(*docs.columns).collect()) == sorted(plain.df.collect())
        assert all(r[n] == f"{n}{r.doc_id}" for r in wide.df.collect() for n in names)
    assert pipeline.STAGES[-1][1](spark, wide.df, sf).count() >= wide.df.count()
    drop_tables()
    before = len(live_tables())
    pipeline.run(spark, sf)
    assert before == 0 and len(live_tables()) <= 6  # the stages' tables and those that the result reads
