"""Merges are the same in any order and on any partitioning, and graft nothing."""

import itertools
import random

import pytest
from corvane.functions.numbers import canonical_json
from corvane.operators.annotate import Note, merge_notes, yaml_schema
from corvane.operators.generate import apply_rules
from corvane.operators.infer import merge, merge_all, merge_by
from corvane.plans.evaluator import Evaluator
from corvane.plans.model import SchemaError, parse_json
from corvane.plans.refs import schema_map

OBJECT = {"type": "object", "properties": {"a": {"type": "integer"}}}


def test_nothing_is_grafted_onto_a_side_that_takes_anything():
    assert merge(OBJECT, {})["properties"] == {"a": {"type": "integer"}} and merge(OBJECT, {})["type"] == ["object", "null"]
    assert "properties" not in merge(OBJECT, {"pattern": "x"}) and "type" not in merge(OBJECT, {"pattern": "x"})
    assert merge(OBJECT, {"type": "object"})["properties"] == {"a": {"type": "integer"}}
    assert "items" not in merge({"type": "array", "items": {"minimum": 1}}, {"type": "array"})
    assert merge({"type": "array", "items": {"minimum": 1}}, {"type": "null"})["items"] == {"minimum": 1}
    assert merge({"type": "integer", "minimum": 1}, {"type": "string", "minimum": 1}) == {}
    assert merge_all([{"pattern": "x"}, {"type": "string"}, {"type": "string"}]) == {}


SCHEMAS = [
    {"type": "integer", "minimum": 3, "maximum": 9}, {"type": "integer", "minimum": 1}, {"type": "number", "maximum": 20}, {"type": "null"}, {}, {"type": "string", "pattern": "a"}, {"type": "string", "pattern": "a", "enum": ["a", "ab"]}, {"enum": ["b"]},
    {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}, {"type": "object", "properties": {"a": {"type": "string"}, "b": {}}, "required": ["a", "b"], "additionalProperties": False}, {"type": "array", "items": {"type": "integer"}}, {"type": "array"}, {"minimum": 2}, {"const": 4},
]
VALUES = [1, 4, 5.5, 100, None, "a", "b", "zab", {}, {"a": 1}, {"a": "x", "b": 2}, {"c": 1}, [], [1], ["x"], True]


def test_merge_order_decides_nothing_but_words():
    rng = random.Random(4)
    for size in (2, 3, 4):
        for _ in range(150):
            chosen = rng.sample(SCHEMAS, size)
            found = {canonical_json(merge_all(list(order))) for order in itertools.permutations(chosen)}
            assert len(found) == 1, chosen
            merged = Evaluator(parse_json(found.pop()))
            for value in VALUES:  # whatever one of them accepts the merged one does
                if any(Evaluator(s or {"type": "null"}).is_valid(value) for s in chosen):  # an empty one stands for null
                    assert merged.is_valid(value), (chosen, value)


def test_merge_by_key_equals_the_fold(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "x", None]), i, canonical_json(rng.choice(SCHEMAS[:5] + SCHEMAS[8:10]) | {"default": i % 7})) for i in range(400)] + [("x", 500, None), ("x", 501, "no json"), ("gone", 502, None)]
    df = spark.createDataFrame(rows, "k string, at long, schema string")
    want = {}
    for k, _, text in sorted(rows, key=lambda r: r[1]):
        if text and text != "no json":
            want.setdefault(k, []).append(parse_json(text))
    want = {k: canonical_json(merge_all(v)) for k, v in want.items()}
    for parts in (1, 5):
        assert {r.k: r.merged for r in merge_by(df.repartition(parts), ["k"], "schema", "at").collect()} == want
    assert merge_by(df.filter("at < 0"), ["k"], "schema", "at").count() == 0


def test_values_that_contradict_a_type_dont_join_it():
    assert merge_notes([Note({"type": "integer"}), Note({"enum": ["x"], "title": "t"})]).schema == {"type": "integer", "title": "t"}
    assert merge_notes([Note({"enum": [1]}), Note({"type": "string"})]).schema == {"enum": [1]}
    assert merge_notes([Note({"type": ["integer", "null"]}), Note({"enum": [1.0, None]})]).schema == {"type": ["integer", "null"], "enum": [1.0, None]}


def test_fenced_comments_are_no_prose():
    text = "# @schema\n# enum: [1]\n# @schema\n# Said outside\nx: 1\n"
    assert yaml_schema(text, use=["inline"])["properties"]["x"] == {"type": "integer", "description": "Said outside"}


@pytest.mark.parametrize("rules", ["datetime", "hexadecimal", "lowercase", "unique=Name", "nonsense"])
def test_unknown_rules_are_refused(rules):
    with pytest.raises(SchemaError):
        apply_rules({"type": "string"}, rules)


def test_fetched_schemas_are_vetted():
    with pytest.raises(SchemaError):
        Evaluator({"$ref": "http://x/y"}, __import__("corvane.plans.evaluator", fromlist=["Options"]).Options(resolver=schema_map({"http://x/y": {"multipleOf": 0}}))).is_valid(1)
    with pytest.raises(SchemaError):
        Evaluator({"$ref": "#/unknown/z", "unknown": {"z": {"minLength": -1}}}).is_valid("x")
