"""Inference, merge, generation, constraint dialects, comment dialects, sources and streams."""

import itertools
import json
import random

import numpy as np
import pytest
from corvane.functions import strings
from corvane.operators.annotate import Note, annotate_files, dialects, yaml_schema
from corvane.operators.contract import Contract
from corvane.operators.generate import Generator, allow, apply_keywords, apply_rules, forbid, number, schema_of, schema_with_defaults, tighten
from corvane.operators.infer import infer, merge, merge_all, observations, types_of
from corvane.plans.evaluator import Evaluator
from corvane.plans.model import DRAFT7, SchemaError
from corvane.sources.documents import FrameSource, load_yaml, read_yaml, rows_as_json, split_documents, write_log, write_schema
from corvane.streaming.frames import complete_frames, fit, hold_last, newest_generation, publish, render_half_blocks, resample, resize, ring_last, schedule
from pyspark.sql import functions as F
from pyspark.sql import types as T


# -- inference ----------------------------------------------------------------------


def documents(seed, n=40):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randint(0, 9 if depth else 7)
        if kind < 6:
            return rng.choice([None, True, 1, 2.5, "s", 0])
        if kind < 8:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return {k: value(depth - 1) for k in rng.sample("abcd", rng.randint(0, 3))}

    return [{k: value(3) for k in rng.sample("abcd", rng.randint(1, 4))} for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_inferred_schemas_accept_their_documents(spark, seed):
    docs = documents(seed)
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i long, j string").repartition(4)
    schema = infer(df, "j", order="i", defaults=True, required=True)
    e = Evaluator(schema)
    for d in docs:
        assert e.is_valid(d), (schema, d)
    again = infer(df.repartition(7), "j", order="i", defaults=True, required=True)
    assert again == schema


def test_types_widen():
    assert types_of(4) == "integer" and types_of(4 | 8) == "number" and types_of(16 | 1) == ["string", "null"] and types_of(16 | 4) is None and types_of(1) == "null" and types_of(4 | 8 | 1) == ["number", "null"]
    assert [(p, b, t) for p, b, _, t in observations({"a": [1, "x"], "b/c": [{"d": 1}]})] == [("", 32, False), ("/a", 64, True), ("/b~1c", 64, False), ("/b~1c/*", 32, False), ("/b~1c/*/d", 4, False)]
    deep = []
    for _ in range(1500):
        deep = [deep]
    assert len(list(observations(deep))) <= 1002


def test_infer_of_one_document(spark):
    df = spark.createDataFrame([('{"name":"x","n":[1,2],"o":{"p":1.5},"e":null}',), ("no json",), (None,)], "j string")
    s = infer(df, "j", strict=True, title="T", defaults=True)
    assert s["title"] == "T" and s["additionalProperties"] is False
    assert s["properties"] == {"name": {"type": "string", "default": "x"}, "n": {"type": "array", "items": {"type": "integer"}, "default": [1, 2]}, "o": {"type": "object", "properties": {"p": {"type": "number", "default": s["properties"]["o"]["properties"]["p"]["default"]}}, "additionalProperties": False}, "e": {"type": "null", "default": None}}
    assert infer(df.limit(0), "j") == {"$schema": "http://json-schema.org/draft-07/schema#"}


# -- merge --------------------------------------------------------------------------


def test_merge_rules():
    a = {"type": "integer", "minimum": 1, "maximum": 5, "title": "A", "required": ["x", "y"], "x-a": 1, "deprecated": True, "readOnly": True, "pattern": "p"}
    b = {"type": "number", "minimum": 0, "description": "B", "required": ["y", "z"], "x-a": 2, "readOnly": True, "pattern": "q"}
    assert merge(a, b) == {"type": "number", "title": "A", "description": "B", "minimum": 0, "readOnly": True, "deprecated": True, "required": ["y"], "x-a": 1}
    assert merge({"enum": [2, 1]}, {"const": 3})["enum"] == [1, 2, 3] and merge({"const": 1}, {"const": 1.0}) == {"const": 1} and "enum" not in merge({"enum": [1]}, {})
    assert merge({"type": "string"}, {"type": "array"}) == {} and merge(True, {"type": "string"}) is True and merge(False, {"type": "string"}) == {"type": "string"}
    assert merge({"properties": {"a": {"type": "string"}}, "additionalProperties": False}, {"properties": {"b": {}}, "additionalProperties": {"type": "null"}})["additionalProperties"] == {"type": "null"}
    assert merge({"type": "array", "items": {"type": "string"}}, {"type": "array"}) == {"type": "array"} and merge({"type": "array", "items": {"type": "string"}}, {"type": "null"})["items"] == {"type": "string"}
    assert merge({"$ref": "#/$defs/a"}, {"$ref": "#/$defs/b"}) == {} and merge({"if": {}, "then": {"minimum": 1}}, {"if": {}, "then": {"minimum": 1}}) == {"if": {}, "then": {"minimum": 1}}


def test_merge_is_associative_and_its_order_only_decides_notes():
    some = [{"type": "integer"}, {"type": "string"}, {"type": "null"}, {"type": "number", "minimum": 1}, {"type": "integer", "minimum": 0}, {"type": "object", "properties": {"a": {"type": "integer"}}}, {"type": "object", "properties": {"a": {"type": "string"}, "b": {}}, "required": ["a"]}]
    for group in itertools.combinations(some, 3):
        assert len({json.dumps(merge_all(list(p)), sort_keys=True) for p in itertools.permutations(group)}) == 1
    assert merge_all([{"type": "integer"}, {"type": "string"}, {"type": "integer"}]) == {} and merge_all([]) == {}


# -- generation ---------------------------------------------------------------------

SHAPE = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("n", T.IntegerType(), True, {"comment": "a count"}), T.StructField("when", T.TimestampType()), T.StructField("day", T.DateType(), False), T.StructField("raw", T.BinaryType()),
    T.StructField("tags", T.ArrayType(T.StringType(), False)), T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("in", T.StructType([T.StructField("x", T.ShortType(), False)])), T.StructField("price", T.DecimalType(6, 2), False), T.StructField("ok", T.BooleanType()),
])


def test_generated_schema_accepts_its_own_rows(spark):
    import datetime as dt
    from decimal import Decimal

    rows = [(1, 2, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 2, 29), b"ab", ["x"], {"k": 1.5}, (3,), Decimal("12.34"), True), (2, None, None, dt.date(2000, 1, 1), None, [], {}, None, Decimal("-0.01"), None)]
    df = spark.createDataFrame(rows, SHAPE)
    schema = schema_of(df, title="Row")
    assert schema["properties"]["n"] == {"description": "a count", "anyOf": [{"type": "integer", "minimum": -(2**31), "maximum": 2**31 - 1}, {"type": "null"}]}
    assert schema["properties"]["id"] == {"type": "integer", "minimum": -(2**63), "exclusiveMaximum": 2**63} and schema["properties"]["tags"] == {"type": ["null", "array"], "items": {"type": "string"}}
    assert schema["required"] == ["id", "day", "price"] and schema["additionalProperties"] is False and schema["title"] == "Row"
    for null_as in ("absent", "null"):
        assert Contract(schema, null_as, formats=True, content=True).valid(df).count() == 2
    e = Evaluator(schema)
    for r in rows_as_json(df.drop("when")).collect():
        assert not e.validate_json(r.value)
    assert schema_with_defaults(df.select("id", "n"))["properties"]["id"]["default"] == 1
    assert schema_of(df.select("id"), draft=DRAFT7)["$schema"].endswith("draft-07/schema#")


def test_generation_options():
    inner = T.StructType([T.StructField("x", T.IntegerType(), False)])
    kind = T.StructType([T.StructField("a", inner, False), T.StructField("b", inner, False), T.StructField("c", T.StructType([T.StructField("y", T.StringType())]), False)])
    s = Generator(definitions=True, namer=str.upper).schema(kind)
    assert s["properties"]["a"] == s["properties"]["b"] == {"$ref": "#/$defs/A"} and set(s["$defs"]) == {"A", "C"}
    assert Generator(providers=[lambda k: {"type": "string", "format": "x"} if isinstance(k, T.DateType) else None]).of(T.DateType(), "d") == {"type": "string", "format": "x"}
    marked = T.StructType([T.StructField("x", T.StringType(), False, {"upper": "yes", "rules": "max=3"})])
    assert Generator(interpreters={"upper": lambda s, text: s | {"pattern": "^[A-Z]*$"}}).schema(marked)["properties"]["x"] == {"type": "string", "maxLength": 3, "pattern": "^[A-Z]*$"}
    with pytest.raises(SchemaError):
        Generator().of(T.MapType(T.DateType(), T.StringType()), "m")
    with pytest.raises(SchemaError):
        Generator().schema(T.StructType([T.StructField("a", T.LongType()), T.StructField("a", T.LongType())]))


def test_constraints():
    assert tighten({"minimum": 3}, "exclusiveMinimum", 3) == {"exclusiveMinimum": 3} and tighten({"exclusiveMinimum": 3}, "minimum", 3) == {"exclusiveMinimum": 3} and tighten({"maximum": 5}, "maximum", 9) == {"maximum": 5} and tighten({"minLength": 2}, "minLength", 1) == {"minLength": 2}
    assert allow({"type": "integer", "minimum": 1}, [5]) == {"type": "integer", "const": 5} and allow({"type": "integer", "minimum": -128, "maximum": 127}, [1, 2]) == {"type": "integer", "enum": [1, 2]} and allow({"minimum": 1}, [1, 2]) == {"minimum": 1, "enum": [1, 2]}
    assert forbid(forbid(forbid({}, 1), 2), 3) == {"not": {"enum": [1, 2, 3]}} and forbid({"not": {"type": "string"}}, 1) == {"not": {"type": "string"}, "allOf": [{"not": {"const": 1}}]}
    assert apply_keywords({"type": "integer"}, "min=1,max=9,enum=2|3,a count\\, really") == {"type": "integer", "minimum": 1, "maximum": 9, "enum": [2, 3], "description": "a count, really"}
    assert apply_keywords({"type": "string"}, "minLength=2,pattern=^a\\,b$,deprecated") == {"type": "string", "minLength": 2, "pattern": "^a,b$", "deprecated": True}
    assert apply_rules({"type": "array"}, "required,max=3,dive,oneof=a b") == {"type": "array", "minItems": 1, "maxItems": 3, "items": {"enum": ["a", "b"]}}
    assert apply_rules({"type": "object"}, "dive,keys,alpha,endkeys,email") == {"type": "object", "propertyNames": {"type": "string", "pattern": "^[a-zA-Z]+$"}, "additionalProperties": {"format": "email"}}
    assert apply_rules({"type": "integer"}, "gt=1,lte=5,ne=3,required_if=X 1") == {"type": "integer", "exclusiveMinimum": 1, "maximum": 5, "not": {"const": 3}} and apply_rules({"type": "string"}, "len=3,uuid|ipv4") == {"type": "string", "minLength": 3, "maxLength": 3, "anyOf": [{"format": "uuid"}, {"format": "ipv4"}]}
    for bad in (lambda: apply_keywords({"type": "string"}, "min=1"), lambda: apply_keywords({}, "nope=1"), lambda: apply_rules({}, "nope"), lambda: number("1e400x"), lambda: number("9007199254740993.0")):
        with pytest.raises(SchemaError):
            bad()


# -- YAML and comments ----------------------------------------------------------------

CHART = """# top note
# replicas to run
replicas: 2
image:
  # -- (string) where it is
  # from
  # @default -- none
  repository: a/b
  tag: "1.0" # @schema pattern:^[0-9.]+$;minLength:1
# @schema
# type: [string, "null"]
# required: true
# enum: [a, null]
# @schema
# the mode
mode: null
ports:
  - name: x
    port: 80
  - name: y
# @schema skipProperties:true
free:
  a: 1
## @param replicas [integer, nullable] how many
## @skip hidden
hidden: 1
yes: no
base: &b {p: 1, q: s}
more:
  <<: *b
  q: 2.5
"""


def test_comment_dialects():
    s = yaml_schema(CHART, defaults=True)
    p = s["properties"]
    assert p["replicas"] == {"type": ["integer", "null"], "default": 2, "description": "how many"}
    assert p["image"]["properties"]["repository"] == {"type": "string", "default": "a/b", "description": "where it is from"}
    assert p["image"]["properties"]["tag"] == {"type": "string", "default": "1.0", "pattern": "^[0-9.]+$", "minLength": 1}
    assert p["mode"] == {"type": ["string", "null"], "default": None, "enum": ["a", None], "description": "the mode"} and s["required"] == ["mode"]
    assert p["ports"]["items"]["properties"]["name"] == {"type": "string"} and "hidden" not in p and p["free"] == {"type": "object"} and p["yes"]["type"] == "string"
    assert {k: v["type"] for k, v in p["more"]["properties"].items()} == {"q": "number", "p": "integer"}
    assert s["additionalProperties"] is True and yaml_schema(CHART, strict=True)["additionalProperties"] is True and yaml_schema("a: 1\n", strict=True)["additionalProperties"] is False
    rooted = yaml_schema("# @schema.root\n# title: T\n# additionalProperties: false\n# @schema.root\na: 1\n", use=["doc", lambda node, lines: Note({"title": node.path})])
    assert (rooted["title"], rooted["additionalProperties"], rooted["properties"]["a"]["title"]) == ("T", False, "a")
    assert yaml_schema("# only comments\n") == {} and yaml_schema(CHART, use=["block"])["properties"]["replicas"]["description"] == "top note replicas to run"
    with pytest.raises(KeyError):
        dialects(["nope"])


def test_yaml_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_bytes(b"\xef\xbb\xbfa: 1\r\nb: [x]\r\n---\r\n# c\r\n---\r\nb: [y]\r\nt: |\r\n  ---\r\n  z\r\n")
    (tmp_path / "b.yaml").write_text("a: 1.5\nc: {d: true}\n")
    (tmp_path / "bad.yaml").write_text("a: [1\n")
    assert len(split_documents((tmp_path / "a.yaml").read_bytes().decode())) == 2
    assert load_yaml("c: 1e3\nd: on\n") == [{"c": 1000.0, "d": "on"}]
    rows = read_yaml(spark, str(tmp_path / "*.yaml")).collect()
    assert sorted(r.document for r in rows) == [0, 0, 1]
    s = annotate_files(spark, str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), str(tmp_path / "bad.yaml"))
    assert s["properties"]["a"] == {"type": "number"} and s["properties"]["b"] == {"type": "array", "items": {"type": "string"}, "description": "c"} and s["properties"]["c"]["properties"] == {"d": {"type": "boolean"}}
    write_schema(s, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == s


# -- streams, sinks, strings -----------------------------------------------------------


def test_rings_pacing_and_generations(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(10)], "k string, seq long")
    assert sorted((r.k, r.seq) for r in ring_last(df, ["k"], ["seq"], 2).collect()) == [("a", 8), ("a", 9), ("b", 8), ("b", 9)]
    assert ring_last(df, ["k"], ["seq"], 0).count() == 2
    t = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:03", 2.0), ("a", None, 9.0)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.v for r in hold_last(t, "t", "v", ["k"]).orderBy("tick").collect()] == [1.0, 1.0, 1.0, 2.0]
    assert newest_generation(spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "generation int, tick int")).count() == 2
    frames = spark.createDataFrame([(i, i // 2) for i in range(8)], "seq long, arrived long")
    assert [r.shown for r in schedule(frames, fps=4).orderBy("seq").collect()] == [0, 1, 2, 3, 4, 5, 6, 7]
    late = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 9), (4, 9)], "seq long, arrived long")
    assert [r.shown for r in schedule(late, fps=2).orderBy("seq").collect()] == [0, 1, 2, 9, 10]


def test_frames(spark, tmp_path):
    rng = np.random.default_rng(1)
    pix = rng.integers(0, 256, 3 * 2 * 4, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([(0, 2, 3, bytearray(pix)), (1, 2, 3, bytearray(pix[:5])), (2, 2, 3, bytearray(pix))], "seq long, width int, height int, pix binary")
    assert [r.seq for r in complete_frames(df).collect()] == [0]
    text = df.limit(1).select(render_half_blocks(F.col("pix"), F.col("width"), F.col("height")).alias("t")).first().t
    image = np.frombuffer(pix, np.uint8).reshape(3, 2, 4)
    rgb = lambda y, x: ";".join(map(str, image[y, x, :3])) if y < 3 else "0;0;0"
    assert text == "".join("".join(f"\x1b[38;2;{rgb(y, x)}m\x1b[48;2;{rgb(y + 1, x)}m▀" for x in range(2)) + "\x1b[0m\n" for y in (0, 2))
    g = spark.range(1).select(fit(F.lit(320), F.lit(200), 80, 24).alias("g")).first().g
    assert (g.w, g.h, g.x, g.y) == (76, 48, 2, 0)
    r = resize(df.limit(1), 4, 2).first()
    assert (r.width, r.height, len(r.pix)) == (4, 4, 64)
    assert (resample(bytes([9] * 16), 2, 2, 5, 3) == 9).all()
    spark.dataSource.register(FrameSource)
    raw = tmp_path / "raw"
    raw.write_bytes(pix * 2 + b"abc")
    got = spark.read.format("frames").option("command", f"cat {raw}").option("width", "2").option("height", "3").load()
    assert [(r.seq, bytes(r.pix) == pix) for r in got.orderBy("seq").collect()] == [(0, True), (1, True)]


def test_publisher_and_log_sink(spark, tmp_path):
    spark.range(10).selectExpr("id AS seq", "concat('p', id) AS payload").write.json(str(tmp_path / "in"))
    got: list[list[int]] = []
    stream = spark.readStream.schema("seq long, payload string").json(str(tmp_path / "in"))
    publish(stream, [lambda df, e: got.append([r.seq for r in df.collect()])] * 2, str(tmp_path / "cp"), size=3).awaitTermination(60)
    assert got[0] == [7, 8, 9] == got[1]
    logs = spark.createDataFrame([("debug", "a", 1), ("WARNING", 'b "c"', 2), ("error", "", None)], "level string, msg string, n int")
    write_log(logs, str(tmp_path / "log"), "logfmt", "warn")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ['level=WARNING msg="b \\"c\\"" n=2', 'level=error msg=""']


def test_profiles(spark, tmp_path):
    from corvane.sources.profile import profiled

    with profiled(spark, str(tmp_path / "p")):
        spark.range(5).select(F.udf(lambda x: x + 1, "long")("id")).collect()
    assert list((tmp_path / "p").iterdir()) and spark.conf.get("spark.sql.pyspark.udf.profiler", None) is None


def test_strings(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(strings.dedent(F.lit("\n    a\n\n      b\n   \t\n"))) == "a\n\n  b\n\n"
    assert value(strings.trim_line_ends(F.lit("a \t\r\nb\t\nc "))) == "a\r\nb\nc" and value(strings.strip_margin(F.lit("x\n  |a\n |  b"))) == "a\n  b"
    assert value(strings.lines_crlf(F.array(F.lit("a"), F.lit("b")))) == "a\r\nb\r\n" and value(strings.join_crlf(F.array(F.lit("a"), F.lit("b")))) == "a\r\nb"
    assert value(strings.first_known(F.lit(""), F.lit(None).cast("string"))) == "unknown" and value(strings.parse_level(F.lit("Warning "))) == "warn" and value(strings.level_rank(F.lit("x"))) is None
    assert value(strings.pointer_segments(F.lit("/a~1b//0"))) == ["a/b", "", "0"] and value(strings.pointer_segments(F.lit("a"))) is None and value(strings.pointer_index(F.lit("01"))) is None
    assert value(strings.parse_log_format(F.lit("JSON"))) == "json" and value(strings.log_line("text", ["id"])) == "0" and value(strings.log_line("json", ["id"])) == '{"id":0}'
