"""Lowered contracts agree with the plain evaluator, on VARIANT and on typed columns; reports, streaming, plans."""

import json

import pytest
from corvane.functions.formats import CHECKS, COLUMNS, format_column
from corvane.operators.contract import Contract, instance_segments, leaves, violations_text
from corvane.plans.evaluator import Evaluator, Options
from pyspark.sql import functions as F

INSTANCES = [
    "null", "true", "0", "1", "1.0", "2.5", "1e2", "-7", '""', '"ab"', '"abc"', '"a1"', '"2024-02-30"', '"x@y.de"', "[]", "[1]", "[1,1.0]", '["a",1,null]', "[[1],[1.0]]", '[{"a":1},{"a":1}]', "[5,6,7,8]", "[null]", "{}",
    '{"a":1}', '{"a":"x"}', '{"a":null}', '{"a":1,"b":2}', '{"b":[1,2,3]}', '{"a":{"a":{"a":5}}}', '{"x1":1,"x2":0,"y":3}', '{"a":[{"a":1},{"b":2}]}', '{"c":1,"d":{"e":[1,"2",3.5]}}', '{"a/b":1,"t~":2}', '{"b":1,"d":7}', '{"c":[7,8]}',
]

SCHEMAS = [
    {"type": "integer"}, {"type": ["number", "null"]}, {"type": "object"}, {"enum": [1, "ab", None, [1], {"a": 1}]}, {"const": 100}, {"const": {"a": 1}}, {"multipleOf": 0.5}, {"multipleOf": 3}, {"minimum": 1, "maximum": 5}, {"exclusiveMinimum": 1, "exclusiveMaximum": 100},
    {"minLength": 1, "maxLength": 2}, {"pattern": "^a\\d?"}, {"format": "date"}, {"format": "email"}, {"prefixItems": [{"type": "integer"}, {"type": "integer"}], "items": {"maximum": 7}}, {"items": {"format": "email"}}, {"items": False}, {"contains": {"minimum": 6}},
    {"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}, {"minItems": 1, "maxItems": 2}, {"uniqueItems": True}, {"properties": {"a": {"type": "integer"}, "b": {"items": {"maximum": 2}}}}, {"patternProperties": {"^x": {"minimum": 1}, "a": {"type": ["integer", "null"]}}},
    {"properties": {"a": True}, "patternProperties": {"^x": True}, "additionalProperties": {"type": "integer"}}, {"additionalProperties": False}, {"propertyNames": {"pattern": "^[a-c]$"}}, {"required": ["a", "b"]}, {"minProperties": 1, "maxProperties": 1},
    {"dependentRequired": {"a": ["b", "c"]}}, {"dependentSchemas": {"a": {"required": ["b"], "properties": {"b": {"minimum": 3}}}}}, {"dependencies": {"a": ["b"], "b": {"maxProperties": 1}}}, {"allOf": [{"minimum": 1}, {"type": "integer"}]}, {"anyOf": [{"type": "string"}, {"minimum": 2}]},
    {"oneOf": [{"minimum": 1}, {"maximum": 2}, {"type": "string"}]}, {"not": {"type": ["integer", "object"]}}, {"if": {"type": "integer"}, "then": {"minimum": 1}, "else": {"type": "object", "required": ["a"]}}, {"$defs": {"n": {"minimum": 1}}, "properties": {"a": {"$ref": "#/$defs/n"}}, "$ref": "#/$defs/n"},
    {"$defs": {"t": {"properties": {"a": {"$ref": "#/$defs/t"}}, "maximum": 4}}, "$ref": "#/$defs/t"}, {"properties": {"a": {}}, "unevaluatedProperties": False}, {"anyOf": [{"properties": {"a": {"type": "integer"}}, "required": ["a"]}, {"properties": {"b": {}}}], "unevaluatedProperties": {"type": "string"}},
    {"prefixItems": [True], "contains": {"const": 7}, "unevaluatedItems": {"type": "string"}}, {"allOf": [{"prefixItems": [True]}], "unevaluatedItems": False}, False, {"properties": {"a": False}}, {"properties": {"a/b": {"minimum": 5}, "t~": {"type": "string"}}},
]


def flat(schema, text, **options):
    found = Evaluator(schema, Options(**options)).validate_json(text)
    return [(v.instance_path, v.schema_path, v.keyword, d) for top in found for d, v in top.flat()]


def test_variant_agrees_with_the_evaluator(spark):
    df = spark.createDataFrame([(x,) for x in INSTANCES], "j string")
    for lo in range(0, len(SCHEMAS), 9):
        some = SCHEMAS[lo : lo + 9]
        made = [Contract(s, formats=True) for s in some]
        rows = df.select("j", *(c.failures(df, "j", parse=True).alias(f"v{i}") for i, c in enumerate(made)), *(c.is_valid(df, "j", parse=True).alias(f"p{i}") for i, c in enumerate(made))).collect()
        for r in rows:
            for i, s in enumerate(some):
                want = flat(s, r.j, formats=True)
                assert [(v.instance_path, v.schema_path, v.keyword, v.depth) for v in r[f"v{i}"]] == want, (s, r.j)
                assert r[f"p{i}"] == (not want), (s, r.j)


ROWS = [(1, 1.5, "ab", True, [1, 2, None], {"x1": 1.0, "y": None}, (1, "a", [(1,), (9,)])), (None, float("nan"), "a1", None, [], {}, None), (5, float("inf"), "", False, None, None, (None, None, [])), (100, 2.0, None, True, [7, 7], {"a": 3.0}, (7, "2024-01-01", None))]
TYPED = "i int, d double, s string, b boolean, l array<int>, m map<string,double>, o struct<p:int,q:string,r:array<struct<z:int>>>"
TYPED_SCHEMAS = [
    {"properties": {"i": {"minimum": 2, "multipleOf": 5}, "d": {"maximum": 2}, "s": {"minLength": 1}, "b": {"const": True}}}, {"properties": {"d": {"type": "integer"}, "i": {"type": "string"}}}, {"required": ["i", "s", "missing"], "minProperties": 6},
    {"properties": {"l": {"items": {"type": "integer", "maximum": 6}, "uniqueItems": True, "contains": {"const": 7}}}}, {"properties": {"m": {"additionalProperties": {"type": "number", "minimum": 2}, "propertyNames": {"maxLength": 1}}}},
    {"properties": {"o": {"properties": {"p": {"minimum": 2}, "q": {"format": "date"}, "r": {"items": {"properties": {"z": {"maximum": 5}}}}}, "required": ["q"], "additionalProperties": False}}}, {"patternProperties": {"^[ds]$": {"type": "string"}}, "additionalProperties": True},
    {"oneOf": [{"required": ["l"]}, {"required": ["o"]}], "not": {"properties": {"i": {"const": 100}}, "required": ["i"]}}, {"properties": {"i": {}, "d": {}}, "unevaluatedProperties": {"type": ["string", "boolean"]}}, {"propertyNames": {"pattern": "^[a-m]$"}},
    {"properties": {"l": {"prefixItems": [{"minimum": 2}], "unevaluatedItems": {"type": "null"}}}}, {"properties": {"s": {"enum": ["ab", 1]}, "l": {"const": [7, 7]}}}, {"dependentRequired": {"i": ["l"]}, "dependentSchemas": {"s": {"properties": {"i": {"maximum": 1}}}}},
    {"$defs": {"r": {"properties": {"o": {"$ref": "#/$defs/r"}, "p": {"minimum": 5}}}}, "$ref": "#/$defs/r"}, {"if": {"properties": {"i": {"minimum": 5}}, "required": ["i"]}, "then": {"required": ["m"]}, "else": {"properties": {"s": {"maxLength": 1}}}},
]


@pytest.mark.parametrize("null_as", ["absent", "null"])
def test_typed_agrees_with_the_evaluator(spark, null_as):
    df = spark.createDataFrame(ROWS, TYPED)

    def instance(x, kind="row"):
        if isinstance(x, dict):
            return {k: instance(v) for k, v in x.items()}
        if hasattr(x, "asDict"):
            return {k: instance(v) for k, v in x.asDict().items() if v is not None or null_as == "null"}
        return [instance(v) for v in x] if isinstance(x, list) else x

    made = [Contract(s, null_as, formats=True) for s in TYPED_SCHEMAS]
    rows = df.select("*", *(c.failures(df).alias(f"v{i}") for i, c in enumerate(made)), *(c.is_valid(df).alias(f"p{i}") for i, c in enumerate(made))).collect()
    for r in rows:
        x = {k: instance(r[k]) for k in df.columns if r[k] is not None or null_as == "null"}
        for i, s in enumerate(TYPED_SCHEMAS):
            want = [(v.instance_path, v.schema_path, v.keyword, d) for top in Evaluator(s, Options(formats=True)).violations(x) for d, v in top.flat()]
            assert [(v.instance_path, v.schema_path, v.keyword, v.depth) for v in r[f"v{i}"]] == want, (s, x)
            assert r[f"p{i}"] == (not want), (s, x)


def test_long_numbers_are_exact(spark):
    nines = "9" * 45
    docs = [f'{{"a":{nines}}}', f'{{"a":{nines[:-1]}8}}', '{"a":1e400}', '{"a":[1e400,1e400]}', '{"a":' + "1" * 5000 + "}", f'{{"a":{nines}', '{"a":3}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    for s in ({"properties": {"a": {"multipleOf": 9}}}, {"properties": {"a": {"maximum": 1e200, "type": "integer"}}}, {"properties": {"a": {"uniqueItems": True}}}):
        c = Contract(s, exact_numbers=True)
        for r in df.select("j", c.is_valid(df, "j", parse=True).alias("ok"), c.failures(df, "j", parse=True).alias("v")).collect():
            want = Evaluator(s).validate_json(r.j)
            assert r.ok == (not want) and [v.keyword for v in r.v] == [v.keyword for v in want], (s, r.j[:60])


def test_messages_agree(spark):
    s = {"properties": {"a": {"type": "string"}, "b": {"items": {"minimum": 2}}}, "required": ["c"]}
    df = spark.createDataFrame([('{"a":1.5,"b":[1,3]}',)], "j string")
    got = Contract(s).validate(df, "j", parse=True).select(violations_text(F.col("violations")).alias("t"), F.size(leaves(F.col("violations"))).alias("n")).first()
    assert got.t == "\n".join(v.text() for v in Evaluator(s).validate_json('{"a":1.5,"b":[1,3]}')) and got.n == 3


FORMAT_VALUES = [
    "", "x", "2024-02-29", "2023-02-29", "0000-01-01", "12:59:60Z", "23:59:60Z", "00:29:60+00:30", "1:00:00Z", "12:00:00", "2024-01-01T00:00:00Z", "2024-01-01t23:59:60.5z", "2024-01-01 00:00:00Z", "P1D", "P", "P1Y1D", "PT", "P1W", "P1WT1H", "PT1H1S", "PT1M2S",
    "a@b.de", '"q q"@b.de', "a@[1.2.3.4]", "a@[IPv6:::1]", "a@b.", "é@b.de", "host", "a.b.", "a..b", "-a", "a-", "xn--bcher-kva", "xn--a", "1.2.3.4", "a.123", "01.2.3.4", "::1", "1::2::3", "::ffff:1.2.3.4", "fe80::1%a", "urn:x:y", "http://a b", "http://[::1]/", "http://[::g]/", "http://[v1.a]/",
    "//a/b", "a:b", "1:b", "%zz", "%20", "http://é", "/a/~0", "/~2", "0", "0#", "1/a", "01", "{x}", "{+x*,y:3}", "{x", "a}", "550e8400-e29b-41d4-a716-446655440000", "550e8400e29b41d4a716446655440000", "^a+$", "a**", "(", "\\d{2,1}", "büro.de", "b·o", "l·l", "a\n",
]


def test_format_columns_agree_with_the_checks(spark):
    df = spark.createDataFrame([(x,) for x in FORMAT_VALUES], "s string")
    rows = df.select("s", *(format_column(n, F.col("s")).alias(n) for n in COLUMNS)).collect()
    assert set(COLUMNS) == set(CHECKS) and len(COLUMNS) == 19
    for r in rows:
        for n in COLUMNS:
            assert r[n] == CHECKS[n](r.s), (n, r.s)


def test_containment_of_formats():
    for x in FORMAT_VALUES:
        for narrow, wide in (("uri", "uri-reference"), ("uri", "iri"), ("uri-reference", "iri-reference"), ("iri", "iri-reference"), ("email", "idn-email"), ("hostname", "idn-hostname")):
            assert not CHECKS[narrow](x) or CHECKS[wide](x), (narrow, wide, x)


def test_plans(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id % 7 AS b", "cast(id AS string) AS c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = Contract({"properties": {"a": {"minimum": 5}}}).valid(df).select("a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(a),GreaterThanOrEqual(a,5))]" in plan and "ReadSchema: struct<a:bigint>" in plan and "Exchange" not in plan and "Python" not in plan
    with pytest.raises(ValueError):
        Contract({}, null_as="other")


def test_report_and_segments(spark):
    df = spark.createDataFrame([(1, "x"), (9, "y"), (None, "x")], "a int, g string")
    c = Contract({"required": ["a"], "properties": {"a": {"maximum": 5}}})
    assert {(r.g, r.keyword, r.instance_path, r.n) for r in c.report(df, by=["g"]).collect()} == {("y", "maximum", "/a", 1), ("x", "required", "", 1)}
    assert c.report(df, by=["g"], rollup=True).filter("g is null").first().n == 2
    assert c.valid(df).count() == 1 and c.invalid(df).count() == 2
    seg = spark.createDataFrame([("/a~1b/3",)], "p string").select(instance_segments(F.col("p")).alias("s")).first().s
    assert [(x.key, x.idx) for x in seg] == [("a/b", None), ("3", 3)]


def test_streaming_contract(spark, tmp_path):
    spark.createDataFrame([(i, json.dumps({"k": i})) for i in range(20)], "id long, j string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, j string").json(str(tmp_path / "in"))
    bad = Contract({"properties": {"k": {"maximum": 15}}}).violations(stream, "j", parse=True, keep=["id"])
    q = bad.writeStream.format("memory").queryName("bad").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.table("bad").collect()) == [16, 17, 18, 19]
