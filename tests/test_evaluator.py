"""The plain evaluator, references, drafts and vetting."""

import json
from decimal import Decimal

import pytest
from corvane.functions.numbers import canonical_json, equal, is_integral, is_multiple
from corvane.functions.patterns import BadPattern, search, translate
from corvane.plans.evaluator import Evaluator, Options
from corvane.plans.model import DRAFT7, DRAFT2020, PRUNE, ReferenceCycle, SchemaError, UnsupportedDialect, assertion_keywords, detect_draft, is_false, is_true, nodes, parse_schema, vet, walk
from corvane.plans.refs import chain, file_resolver, inline, resolve_uri, schema_map, strip_prefix


def valid(schema, instance, **options):
    return Evaluator(schema, Options(**options)).is_valid(instance)


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer"}, [1, Decimal("1.0"), Decimal("1e2")], [Decimal("1.5"), "1", True, None]),
        ({"type": ["string", "null"]}, ["", None], [0, []]),
        ({"enum": [1, {"a": [1, 2]}]}, [Decimal("1.0"), {"a": [1, Decimal("2.0")]}], [True, {"a": [2, 1]}]),
        ({"const": None}, [None], [0, False]),
        ({"enum": []}, [], [1, None]),
        ({"multipleOf": Decimal("0.01")}, [Decimal("0.07"), 3, "x"], [Decimal("0.075")]),
        ({"minimum": 2, "exclusiveMaximum": 5}, [2, Decimal("4.9"), "x"], [1, 5, float("nan"), float("inf")]),
        ({"minLength": 2, "maxLength": 3}, ["ab", "😀b", 1], ["a", "abcd"]),
        ({"pattern": "^a\\d+$"}, ["a1", 5], ["a", "a1\n"]),
        ({"pattern": "(?=a)"}, [1], ["a"]),
        ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [[], [1], [1, "a"], "x"], [["a"], [1, 2]]),
        ({"contains": {"minimum": 5}, "minContains": 2, "maxContains": 3}, [[5, 6], [1, 5, 6, 7]], [[5], [5, 6, 7, 8]]),
        ({"contains": {"minimum": 5}, "minContains": 0}, [[], [1]], []),
        ({"uniqueItems": True}, [[1, True, "1"], []], [[1, Decimal("1.0")], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
        ({"properties": {"a": {"type": "string"}}, "patternProperties": {"^x": {"minimum": 1}}, "additionalProperties": False}, [{}, {"a": "", "x1": 2}], [{"a": 1}, {"x": 0}, {"y": 1}]),
        ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}], [{"abc": 1}]),
        ({"required": ["a", "b"], "minProperties": 2, "maxProperties": 3}, [{"a": 1, "b": None}], [{"a": 1}, {"a": 1, "b": 1, "c": 1, "d": 1}]),
        ({"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"c": {"required": ["d"]}}}, [{}, {"a": 1, "b": 1}, {"c": 1, "d": 1}], [{"a": 1}, {"c": 1}]),
        ({"dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, [{"b": 1}], [{"a": 1}, {"c": 1}]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["", 3], [1]),
        ({"oneOf": [{"multipleOf": 3}, {"multipleOf": 5}]}, [3, 5], [15, 1]),
        ({"not": {"type": "string"}}, [1], [""]),
        ({"if": {"minimum": 10}, "then": {"multipleOf": 10}, "else": {"multipleOf": 2}}, [20, 4], [11, 3]),
        ({"$defs": {"t": {"type": "object", "properties": {"c": {"items": {"$ref": "#/$defs/t"}}}}}, "$ref": "#/$defs/t"}, [{"c": [{"c": []}]}], [{"c": [1]}]),
        ({"allOf": [{"properties": {"a": {}}}], "unevaluatedProperties": False}, [{"a": 1}], [{"b": 1}]),
        ({"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": {"properties": {"b": {}}}, "unevaluatedProperties": False}, [{"a": 1, "b": 2}], [{"b": 2}]),
        ({"prefixItems": [True], "contains": {"const": 7}, "unevaluatedItems": False}, [[1, 7], [7]], [[1, 2, 7], []][:1]),
        (False, [], [1, None]),
        (True, [1, None], []),
    ],
)
def test_keywords(schema, good, bad):
    for x in good:
        assert valid(schema, x), (schema, x)
    for x in bad:
        assert not valid(schema, x), (schema, x)


def test_order_paths_and_causes():
    e = Evaluator({"required": ["z"], "properties": {"b": {"anyOf": [{"type": "string"}, {"minimum": 5}]}, "a/b": {"items": {"maximum": 1}}}})
    got = e.violations({"b": 1, "a/b": [0, 2]})
    assert [(v.instance_path, v.schema_path, v.keyword) for v in got] == [("/a~1b/1", "/properties/a~1b/items/maximum", "maximum"), ("/b", "/properties/b/anyOf", "anyOf"), ("", "/required", "required")]
    assert [v.schema_path for v in got[1].leaves()] == ["/properties/b/anyOf/0/type", "/properties/b/anyOf/1/minimum"]
    assert got[2].targets_key() and not got[1].targets_key()
    assert got[1].text().count("\n") == 2


def test_drafts():
    assert detect_draft({"$schema": "http://json-schema.org/draft-07/schema#"}) is DRAFT7 and detect_draft({}) is DRAFT2020
    with pytest.raises(UnsupportedDialect):
        detect_draft({"$schema": "http://json-schema.org/draft-04/schema#"})
    seven = {"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "integer"}], "additionalItems": False}
    assert valid(seven, [1]) and not valid(seven, [1, 2])
    hidden = {"definitions": {"s": {"type": "string"}}, "properties": {"a": {"$ref": "#/definitions/s", "maxLength": 1}}}
    assert valid(hidden, {"a": "long"}, draft=DRAFT7) and not valid({**hidden}, {"a": "long"})
    assert valid({"contentEncoding": "base64"}, "YQ=\n=", content=True, draft=DRAFT7) and not valid({"contentEncoding": "base64"}, "YQ=\n=", content=True)
    assert not valid({"contentMediaType": "application/json; charset=x"}, "{", content=True) and valid({"contentMediaType": "application/json"}, "{")
    assert valid({"format": "ipv4"}, "x") and not valid({"format": "ipv4"}, "x", formats=True) and valid({"format": "other"}, "x", formats=True) and not valid({"format": "other"}, "x", assert_formats=True)
    assert valid({"minimum": 5}, 1, without=frozenset({"validation"})) and valid({"format": "even"}, "ab", formats=True, custom_formats={"even": lambda s: len(s) % 2 == 0})


def test_references():
    remote = schema_map({"http://x/a.json": {"$defs": {"n": {"$anchor": "num", "minimum": 3}}}, "http://x/b.json": {"$ref": "a.json#num"}})
    root = {"$id": "http://x/root.json", "$ref": "b.json"}
    assert valid(root, 3, resolver=remote) and not valid(root, 2, resolver=remote)
    tree = {"$id": "http://x/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"kids": {"items": {"$dynamicRef": "#node"}}}}
    strict = {"$id": "http://x/strict", "$dynamicAnchor": "node", "$ref": "tree", "unevaluatedProperties": False}
    find = schema_map({"http://x/tree": tree})
    assert valid(strict, {"kids": [{"kids": []}]}, resolver=find) and not valid(strict, {"kids": [{"other": 1}]}, resolver=find)
    assert valid({"extra": {"here": {"type": "string"}}, "$ref": "#/extra/here"}, "s")
    assert chain(schema_map({}), strip_prefix("p:", schema_map({"a": True})))("p:a") is True
    assert resolve_uri("http://a/b/c?x", "../d#f") == "http://a/d#f" and resolve_uri("urn:x:y", "#a") == "urn:x:y#a" and resolve_uri("urn:x:y", "z") == "z"


def test_file_resolver_stays_below_its_folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type": "string"}')
    (tmp_path / "secret.json").write_text("{}")
    find = file_resolver(str(tmp_path / "in"))
    assert find("a.json") == {"type": "string"} and find("../secret.json") is None and find("http://x/a.json") is None


def test_inline():
    schema = {"$defs": {"a": {"minimum": 1}, "b": {"$ref": "#/$defs/a"}}, "properties": {"x": {"$ref": "#/$defs/b", "maximum": 5}, "y": {"items": {"$ref": "#/$defs/a"}}}}
    assert inline(schema, DRAFT2020) == {"properties": {"x": {"allOf": [{"minimum": 1}, {"maximum": 5}]}, "y": {"items": {"minimum": 1}}}}
    assert inline({"definitions": schema["$defs"], "properties": {"x": {"$ref": "#/definitions/a", "maximum": 5}}}, DRAFT7) == {"properties": {"x": {"minimum": 1}}}
    with pytest.raises(ReferenceCycle):
        inline({"properties": {"c": {"$ref": "#"}}}, DRAFT2020)
    assert inline({"properties": {"c": {"$ref": "missing"}}}, DRAFT2020, on_failure=lambda ref, e: {"title": ref}) == {"properties": {"c": {"title": "missing"}}}
    assert inline({"properties": {"c": {"$ref": "missing"}}}, DRAFT2020, on_failure=lambda ref, e: None) == {"properties": {"c": {}}}


def test_parse_vet_and_walk():
    assert parse_schema('{"const": 12345678901234567890.50}')["const"] == Decimal("12345678901234567890.50")
    for text in ("[]", "{", '{"a": NaN}', "{} {}"):
        with pytest.raises(SchemaError):
            parse_schema(text)
    for bad in ({"type": "int"}, {"items": [{}]}, {"minLength": -1}, {"multipleOf": 0}, {"allOf": {}}, {"required": "a"}, {"properties": {"a": 5}}):
        with pytest.raises(SchemaError):
            Evaluator(bad)
    vet({"items": [{}]}, DRAFT7)
    assert is_true({}) and is_true(True) and is_false({"not": {}}) and not is_false({"not": {}, "title": "x"})
    schema = {"properties": {"b": {}, "a": {"items": False}}, "allOf": [{}]}
    assert [p for p, _ in nodes(schema)] == ["", "/properties/a", "/properties/a/items", "/properties/b", "/allOf/0"]
    seen = []
    walk(schema, lambda p, n: seen.append(p) or (PRUNE if p.endswith("/a") else None))
    assert "/properties/a/items" not in seen
    assert {"type", "unevaluatedItems", "$ref"} <= set(assertion_keywords()) and "title" not in assertion_keywords()


def test_numbers_and_equality():
    assert is_integral(Decimal("1e400")) and not is_integral(Decimal("1e-400")) and is_integral(Decimal("100e-2")) and not is_integral(Decimal("0.5")) and is_integral(0.0)
    assert is_multiple(Decimal("1e5000"), 7) is False and is_multiple(int("9" * 30), 9) and is_multiple(Decimal("0.3"), Decimal("0.1"))
    assert equal({"a": 1, "b": [Decimal("1e0")]}, {"b": [1], "a": Decimal("1.00")}) and not equal(True, 1) and not equal(float("nan"), float("nan"))
    assert canonical_json({"b": Decimal("1e2"), "a": ["é", Decimal("0.10"), Decimal("-0")]}) == '{"a":["é",0.1,0],"b":100}'


def test_patterns():
    assert search("a.c", "xabcx") and not search("a.c", "a\nc") and search(r"\pL+", "é") and search(r"[[:alpha:]]", "b") and not search(r"\s", "\x0b") and search(r"\Qa.b\E", "a.b")
    for bad in ("(?!a)", r"(a)\1", "[", "a**", "(", "a{2,1}", "(?<=x)", r"\y"):
        with pytest.raises(BadPattern):
            translate(bad)
            raise BadPattern if not search(bad, "a" * 5) else AssertionError(bad)
    assert not search("(?!a)", "b")


def test_vendored_style_cases():
    cases = json.loads('[{"schema": {"properties": {"foo\\"bar": {"type": "number"}}}, "tests": [{"data": {"foo\\"bar": "1"}, "valid": false}, {"data": {}, "valid": true}]}]')
    for group in cases:
        for t in group["tests"]:
            assert valid(group["schema"], t["data"]) == t["valid"]
