"""Registered queries of the operators on schemas themselves: dialects, comments, merges, references, exact numbers."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.numbers import canonical_json, number_text_column
from corvane.operators.annotate import yaml_schema
from corvane.operators.contract import Contract, instance_segments, violations_text
from corvane.operators.generate import apply_keywords, apply_rules
from corvane.operators.infer import merge_by
from corvane.plans.model import DRAFT7, DRAFT2020, nodes, parse_json
from corvane.plans.queries import _pick, checked, formatted, query, table
from corvane.plans.refs import chain, inline, resolve_uri, schema_map, strip_prefix
from corvane.sources.documents import load_yaml, rows_as_json


def mapped(name: str, source: str, key: str, text: Callable[[], Column], function: Callable[[str], str], sql: str, spread: bool = False) -> None:
    """A query of each row's key and what a function of one text makes of the row's text, on the executors.

    `spread` deals the texts to all tasks first, for functions that cost far more than
    that: a file of few row groups is read by few tasks.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.pandas_udf("string")
        def out(texts: pd.Series) -> pd.Series:
            return texts.map(function)

        texts = table(spark, sf_dir, source).select(key, text().alias("text"))
        if spread:
            texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return texts.select(key, out("text").alias("out"))

    query(f"SELECT {key}, {sql} AS out FROM {source}", name)(run)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _choice(key: str, texts: list[str]) -> str:
    """The SQL of _pick()."""
    return f"CASE {key} % {len(texts)} " + " ".join("WHEN {} THEN '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(texts)) + " END"


# -- rules and keywords of field metadata -----------------------------------------------

_P, _SIZE, _BRAND = lambda: F.col("p_partkey"), lambda: F.col("p_size"), lambda: F.col("p_brand")


def _ruled(start: dict) -> Callable[[str], str]:
    return lambda text: canonical_json(apply_rules(start, text))


def _keyed(start: dict) -> Callable[[str], str]:
    return lambda text: canonical_json(apply_keywords(start, text))


mapped("rule_bounds", "part", "p_partkey", lambda: _text("gte=", _SIZE(), ",lt=", _SIZE() + 10, ",gte=5,lte=45"), _ruled({"type": "integer"}),
       """'{' || CASE WHEN p_size + 10 <= 45 THEN '"exclusiveMaximum":' || (p_size + 10) ELSE '"maximum":45' END || ',"minimum":' || greatest(p_size, 5) || ',"type":"integer"}'""")  # fmt: skip
_FORMATS = [("email", "email"), ("url", "uri"), ("uri", "uri-reference"), ("uuid", "uuid"), ("ipv4", "ipv4"), ("ipv6", "ipv6"), ("hostname", "hostname")]
mapped("rule_formats", "part", "p_partkey", lambda: _text(_pick("p_partkey", *(r for r, _ in _FORMATS)), ",min=", _SIZE(), ",omitempty,gt=3"), _ruled({"type": "string"}),
       f"""'{{"format":"' || {_choice("p_partkey", [f for _, f in _FORMATS])} || '","minLength":' || greatest(p_size, 4) || ',"type":"string"}}'""")
_PATTERNS = [("alpha", "^[a-zA-Z]+$"), ("alphanum", "^[a-zA-Z0-9]+$"), ("numeric", "^[-+]?[0-9]+(?:\\\\.[0-9]+)?$"), ("number", "^[0-9]+$"), ("ascii", "^[\\\\x00-\\\\x7F]*$")]
mapped("rule_patterns", "part", "p_partkey", lambda: _text("len=", _SIZE(), ",", _pick("p_partkey", *(r for r, _ in _PATTERNS))), _ruled({"type": "string"}),
       f"""'{{"maxLength":' || p_size || ',"minLength":' || p_size || ',"pattern":"' || {_choice("p_partkey", [p for _, p in _PATTERNS])} || '","type":"string"}}'""")
_SKIPPED = ["omitempty", "omitnil", "omitzero", "isdefault", "structonly", "required_if=A 1", "required_with_all=A B", "excluded_without=A", "eqcsfield=A.B", "ltecsfield=A.B", "fieldcontains=A", "skip_unless=A 1"]
mapped("rule_control_and_cross_field", "part", "p_partkey", lambda: _text(_pick("p_partkey", *_SKIPPED), ",ne=", _SIZE(), ",ne=0,required"), _ruled({"type": "integer"}), """'{"not":{"enum":[' || p_size || ',0,0]},"type":"integer"}'""")
mapped("rule_dive_keys", "part", "p_partkey", lambda: _text("min=1,dive,keys,max=", _SIZE(), ",endkeys,gt=", _P()), _ruled({"type": "object"}),
       """'{"additionalProperties":{"exclusiveMinimum":' || p_partkey || '},"minProperties":1,"propertyNames":{"maxLength":' || p_size || ',"type":"string"},"type":"object"}'""")  # fmt: skip
mapped("rule_items", "part", "p_partkey", lambda: _text("unique,max=", _SIZE(), ",dive,oneof=", _BRAND(), " 'two words'"), _ruled({"type": "array", "items": {"type": "string"}}),
       """'{"items":{"enum":["' || p_brand || '","two words"],"type":"string"},"maxItems":' || p_size || ',"type":"array","uniqueItems":true}'""")  # fmt: skip
mapped("rule_alternatives", "part", "p_partkey", lambda: _text("number|len=", _SIZE(), ",json"), _ruled({"type": "string"}), """'{"anyOf":[{"pattern":"^[0-9]+$"},{"maxLength":' || p_size || ',"minLength":' || p_size || '}],"contentMediaType":"application/json","type":"string"}'""")
mapped("rule_one_value_drops_bounds", "part", "p_partkey", lambda: F.when(_P() % 2 == 0, _text("gte=2,eq=", _SIZE())).otherwise(_text("gte=2,oneof=", _SIZE(), " ", _SIZE() + 1)), _ruled({"type": "integer"}),
       """CASE WHEN p_partkey % 2 = 0 THEN '{"const":' || p_size || ',"type":"integer"}' ELSE '{"enum":[' || p_size || ',' || (p_size + 1) || '],"minimum":2,"type":"integer"}' END""")  # fmt: skip
mapped("keyword_dialect", "part", "p_partkey", lambda: _text("min=", _SIZE(), ",max=", _SIZE() + 7, ",multipleOf=0.5,about ", _BRAND()), _keyed({"type": "number"}),
       """'{"description":"about ' || p_brand || '","maximum":' || (p_size + 7) || ',"minimum":' || p_size || ',"multipleOf":0.5,"type":"number"}'""")  # fmt: skip
mapped("keyword_values", "part", "p_partkey", lambda: _text("enum=", _BRAND(), "|a\\|b,default=x\\,y,examples=1|2,readOnly"), _keyed({"type": "string"}),
       """'{"default":"x,y","enum":["' || p_brand || '","a|b"],"examples":["1","2"],"readOnly":true,"type":"string"}'""")  # fmt: skip
mapped("keyword_type_override", "part", "p_partkey", lambda: _text("type=string|null,description=", _BRAND(), ",maxLength=", _SIZE()), _keyed({"type": "integer", "minimum": 1, "default": 3}),
       """'{"default":3,"description":"' || p_brand || '","maxLength":' || p_size || ',"type":["string","null"]}'""")  # fmt: skip


# -- YAML values and comments -------------------------------------------------------------

_C, _NAME, _SEGMENT = lambda: F.col("c_custkey"), lambda: F.col("c_name"), lambda: F.col("c_mktsegment")


def _yaml(**options) -> Callable[[str], str]:
    return lambda text: canonical_json(yaml_schema(text, **options))


def commented(name: str, text: Callable[[], Column], members: str, extra: str = "", **options) -> None:
    """A query of the schemas of YAML texts; the SQL of their members, in order of their names."""
    closed = "false" if options.get("strict") else "true"
    mapped(name, "customer", "c_custkey", text, _yaml(**options), f"""'{{"additionalProperties":{closed},"properties":{{' || {members} || '}}{extra},"type":"object"}}'""", spread=True)


commented("yaml_types_and_defaults", lambda: _text("size: ", _C(), "\nratio: ", _C(), ".5\nname: ", _NAME(), "\nflag: true\nnothing:\n"),
          """'"flag":{"default":true,"type":"boolean"},"name":{"default":"' || c_name || '","type":"string"},"nothing":{"default":null},"ratio":{"default":' || c_custkey || '.5,"type":"number"},"size":{"default":' || c_custkey || ',"type":"integer"}'""", defaults=True)  # fmt: skip
commented("yaml_comment_prose", lambda: _text("# About ", _SEGMENT(), "\n# in two lines\n# ====\nname: x\n"), """'"name":{"description":"About ' || c_mktsegment || ' in two lines","type":"string"}'""")
commented("yaml_block_comments", lambda: _text("# @schema\n# type: [string, 'null']\n# maxLength: ", _C(), "\n# required: true\n# @schema\n# About ", _SEGMENT(), "\nname: x\n"),
          """'"name":{"description":"About ' || c_mktsegment || '","maxLength":' || c_custkey || ',"type":["string","null"]}'""", ',"required":["name"]', use=["block"])  # fmt: skip
commented("yaml_inline_comments", lambda: _text("name: x # @schema type:string;nullable;pattern:^\\d+#", _C(), ";unknown:1\nlist: [] # @schema itemRef:#/$defs/", _SEGMENT(), ";maxItems:", _C(), "\n"),
          """'"list":{"items":{"$ref":"#/$defs/' || c_mktsegment || '"},"maxItems":' || c_custkey || ',"type":"array"},"name":{"pattern":"^\\\\d+#' || c_custkey || '","type":["string","null"]}'""", use=["inline"])  # fmt: skip
commented("yaml_file_comments", lambda: _text("## @param name [nullable] About ", _SEGMENT(), "\n## @param low.deep [integer, default: ", _C(), "] Deep\n## @skip gone\nname: x\ngone: 1\nlow:\n  deep: 1.5\n"),
          """'"low":{"additionalProperties":true,"properties":{"deep":{"default":' || c_custkey || ',"description":"Deep","type":"integer"}},"type":"object"},"name":{"description":"About ' || c_mktsegment || '","type":["string","null"]}'""", use=["file"])  # fmt: skip
commented("yaml_doc_comments", lambda: _text("# -- (int) About ", _SEGMENT(), "\n# and ", _C(), "\n# @default -- 5\nname: x\n"), """'"name":{"description":"About ' || c_mktsegment || ' and ' || c_custkey || '","type":"integer"}'""", use=["doc"])
commented("yaml_priority_of_comments", lambda: _text("# @schema\n# enum: [", _C(), "]\n# @schema\nname: x # @schema type:string;title:", _SEGMENT(), "\n"), """'"name":{"enum":[' || c_custkey || '],"title":"' || c_mktsegment || '"}'""", use=["block", "inline"])
commented("yaml_merge_keys_and_aliases", lambda: _text("base: &b\n  x: ", _C(), "\n  y: ", _NAME(), "\nuse:\n  <<: *b\n  x: true\n"),
          """'"base":{"additionalProperties":false,"properties":{"x":{"default":' || c_custkey || ',"type":"integer"},"y":{"default":"' || c_name || '","type":"string"}},"type":"object"},"use":{"additionalProperties":false,"properties":{"x":{"default":true,"type":"boolean"},"y":{"default":"' || c_name || '","type":"string"}},"type":"object"}'""", defaults=True, strict=True)  # fmt: skip
commented("yaml_items", lambda: _text("a: [", _C(), ", null]\nb:\n- k: 1\n  m: ", _SEGMENT(), "\n- k: 2.5\nc: [1, x]\n"),
          """'"a":{"items":{"type":["integer","null"]},"type":"array"},"b":{"items":{"additionalProperties":true,"properties":{"k":{"type":"number"},"m":{"type":"string"}},"type":"object"},"type":"array"},"c":{"type":"array"}'""")  # fmt: skip
commented("yaml_merged_properties", lambda: _text("# @schema\n# mergeProperties: true\n# @schema\nm:\n  ", _NAME(), ": 1\n  other: 2.5\n"), """'"m":{"additionalProperties":{"type":"number"},"type":"object"}'""", use=["block"])
commented("yaml_root_comments", lambda: _text("# @schema.root\n# title: ", _SEGMENT(), "\n# @schema.root\nx: ", _C(), "\n"), """'"x":{"type":"integer"}'""", ""","title":"' || c_mktsegment || '\"""")
commented("yaml_documents_merged", lambda: _text("a: 1\nb: ", _C(), "\n---\na: x\nb: 1.5\n---\nb: 2\nc: ", _NAME(), "\n"), """'"a":{},"b":{"type":"number"},"c":{"type":"string"}'""")
mapped("yaml_values", "customer", "c_custkey", lambda: _text("{n: ", _C(), ", f: 1e2, s: 'a: b', l: [yes, 0x10, ~]}\n---\n- ", _NAME(), "\n"), lambda t: canonical_json(load_yaml(t)), """'[{"f":100,"l":["yes",16,null],"n":' || c_custkey || ',"s":"a: b"},["' || c_name || '"]]'""", spread=True)


# -- merges ---------------------------------------------------------------------------------


def merged(df: DataFrame, key: str, schema: Column, order: str) -> DataFrame:
    return merge_by(df.select(key, schema.alias("schema"), order), [key], "schema", order)


def _object(**members: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in members.items())))


def _names(path: str) -> Column:
    return F.from_json(F.get_json_object("merged", path), "array<string>")


@query("SELECT source, min(n_chars) AS minimum, max(n_chars) AS maximum, CAST(bool_or(n_chars > 3000) AS INTEGER) AS deprecated, CAST(bool_and(n_chars > 20) AS INTEGER) AS read_only FROM documents GROUP BY source")
def merge_bounds_by_source(spark, sf_dir):
    n = F.col("n_chars")
    schema = _object(type="integer", minimum=n, maximum=n, deprecated=n > 3000, readOnly=n > 20)
    flag = lambda k: F.coalesce(F.get_json_object("merged", f"$.{k}").cast("boolean").cast("int"), F.lit(0))
    bound = lambda k: F.get_json_object("merged", f"$.{k}").cast("long")
    return merged(table(spark, sf_dir, "documents"), "source", schema, "doc_id").select("source", bound("minimum").alias("minimum"), bound("maximum").alias("maximum"), flag("deprecated").alias("deprecated"), flag("readOnly").alias("read_only"))


@query("SELECT p_brand, concat_ws(',', CASE WHEN bool_and(p_size > 3) THEN 'a' END, CASE WHEN bool_and(p_retailprice < 1000) THEN 'b' END, 'c') AS required FROM part GROUP BY p_brand")
def merge_required_intersection(spark, sf_dir):
    names = F.array_compact(F.array(F.when(F.col("p_size") > 3, "a"), F.when(F.col("p_retailprice") < 1000, "b"), F.lit("c")))
    return merged(table(spark, sf_dir, "part"), "p_brand", _object(type="object", required=names), "p_partkey").select("p_brand", F.array_join(_names("$.required"), ",").alias("required"))


@query("SELECT p_type, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS enum FROM part GROUP BY p_type")
def merge_enum_union(spark, sf_dir):
    values = F.coalesce(_names("$.enum"), F.array(F.get_json_object("merged", "$.const")))
    return merged(table(spark, sf_dir, "part"), "p_type", _object(type="string", const=F.col("p_brand")), "p_partkey").select("p_type", F.array_join(F.array_sort(values), "|").alias("enum"))


@query("SELECT source, arg_min(lang, doc_id) AS first_lang FROM documents GROUP BY source")
def merge_first_wins_default(spark, sf_dir):
    return merged(table(spark, sf_dir, "documents"), "source", _object(type="string", default=F.col("lang")), "doc_id").select("source", F.get_json_object("merged", "$.default").alias("first_lang"))


@query("SELECT p_size, CASE WHEN count(DISTINCT p_brand) = 1 THEN any_value(p_brand) END AS pattern, CASE WHEN count(DISTINCT p_size % 5) = 1 THEN 'f' || (p_size % 5) END AS format FROM part GROUP BY p_size")
def merge_keep_equal(spark, sf_dir):
    schema = _object(type="string", pattern=F.col("p_brand"), format=_text("f", F.col("p_size") % 5))
    return merged(table(spark, sf_dir, "part"), "p_size", schema, "p_partkey").select("p_size", F.get_json_object("merged", "$.pattern").alias("pattern"), F.get_json_object("merged", "$.format").alias("format"))


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS members FROM events GROUP BY user_id")
def merge_properties_union(spark, sf_dir):
    schema = _text('{"type":"object","properties":{"', F.col("event_type"), '":{"type":"number"}}}')
    members = F.json_object_keys(F.get_json_object("merged", "$.properties"))
    return merged(table(spark, sf_dir, "events"), "user_id", schema, "event_id").select("user_id", F.array_join(F.array_sort(members), "|").alias("members"))


_TYPES_SQL = "bool_or(event_type = 'click') AS i, bool_or(event_type = 'view') AS f, bool_or(event_type = 'error') AS z, bool_or(event_type NOT IN ('click', 'view', 'error')) AS s"


@query(f"SELECT user_id, CASE WHEN s AND (i OR f) THEN NULL WHEN s THEN CASE WHEN z THEN '[\"string\",\"null\"]' ELSE 'string' END WHEN f THEN CASE WHEN z THEN '[\"number\",\"null\"]' ELSE 'number' END WHEN i THEN CASE WHEN z THEN '[\"integer\",\"null\"]' ELSE 'integer' END ELSE 'null' END AS type FROM (SELECT user_id, {_TYPES_SQL} FROM events GROUP BY user_id)")
def merge_types_widen(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "integer").when(F.col("event_type") == "view", "number").when(F.col("event_type") == "error", "null").otherwise("string")
    return merged(table(spark, sf_dir, "events"), "user_id", _object(type=kind), "event_id").select("user_id", F.get_json_object("merged", "$.type").alias("type"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 7 = 0) THEN 'true' WHEN bool_or(o_orderkey % 7 > 3) THEN '{\"minimum\":' || min(CASE WHEN o_orderkey % 7 > 3 THEN o_orderkey END) || '}' ELSE 'false' END AS rest FROM orders GROUP BY o_custkey")
def merge_additional_properties(spark, sf_dir):
    k = F.col("o_orderkey")
    rest = F.when(k % 7 == 0, F.lit("true")).when(k % 7 > 3, _text('{"minimum":', k, "}")).otherwise("false")
    return merged(table(spark, sf_dir, "orders"), "o_custkey", _text('{"type":"object","additionalProperties":', rest, "}"), "o_orderkey").select("o_custkey", F.get_json_object("merged", "$.additionalProperties").alias("rest"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 5 = 0) THEN NULL ELSE min(CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey END) END AS least FROM orders GROUP BY o_custkey")
def merge_items(spark, sf_dir):
    """An array without items takes any; a null says nothing of items."""
    k = F.col("o_orderkey")
    schema = F.when(k % 5 == 0, F.lit('{"type":"array"}')).when(k % 5 == 4, F.lit('{"type":"null"}')).otherwise(_text('{"type":"array","items":{"type":"integer","minimum":', k, "}}"))
    return merged(table(spark, sf_dir, "orders"), "o_custkey", schema, "o_orderkey").select("o_custkey", F.get_json_object("merged", "$.items.minimum").cast("long").alias("least"))


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderkey % 6 < 4) = 0 THEN NULL WHEN bool_or(o_orderkey % 6 = 4) THEN NULL ELSE CAST(count(DISTINCT o_orderstatus) FILTER (o_orderkey % 6 < 4) AS INTEGER) END AS members FROM orders GROUP BY o_custkey")
def merge_grafts_nothing(spark, sf_dir):
    """An empty schema stands for null and keeps the other side's members; one that limits values without a type takes any object."""
    k = F.col("o_orderkey")
    schema = F.when(k % 6 == 4, F.lit('{"pattern":"x"}')).when(k % 6 == 5, F.lit("{}")).otherwise(_text('{"type":"object","properties":{"', F.col("o_orderstatus"), '":{}}}'))
    out = merged(table(spark, sf_dir, "orders"), "o_custkey", schema, "o_orderkey")
    return out.select("o_custkey", F.size(F.json_object_keys(F.get_json_object("merged", "$.properties"))).alias("members")).withColumn("members", F.when(F.col("members") >= 0, F.col("members")))


@query("SELECT p_brand, CASE WHEN count(DISTINCT p_size % 2) = 1 THEN '#/$defs/d' || any_value(p_size % 2) END AS ref, 'x' AS condition FROM part GROUP BY p_brand")
def merge_references_and_conditions(spark, sf_dir):
    schema = _text('{"type":"object","$ref":"#/$defs/d', F.col("p_size") % 2, '","if":{"title":"x"},"then":{"minProperties":1}}')
    out = merged(table(spark, sf_dir, "part"), "p_brand", schema, "p_partkey")
    return out.select("p_brand", F.get_json_object("merged", "$['$ref']").alias("ref"), F.get_json_object("merged", "$.if.title").alias("condition"))


# -- references and walks ----------------------------------------------------------------------

_CATALOG = {"http://s.example/limits": {"$defs": {"size": {"maximum": 30}, "price": {"$anchor": "price", "minimum": 950}}}, "local/brand": {"pattern": "#[1-3]"}}
checked(
    "kw_remote_references", "part", {"$id": "http://s.example/root/schema", "properties": {"p_size": {"$ref": "../limits#/$defs/size"}, "p_retailprice": {"$ref": "/limits#price"}, "p_brand": {"$ref": "urn:here:local/brand"}}}, "p_partkey",
    "p_size <= 30 AND p_retailprice >= 950 AND regexp_matches(p_brand, '#[1-3]')", resolver=chain(schema_map(_CATALOG), strip_prefix("urn:here:", schema_map(_CATALOG))),
)
checked(
    "kw_dynamic_reference", "embeddings", {"$id": "http://s.example/outer", "$ref": "list", "$defs": {"own": {"$dynamicAnchor": "item", "minimum": -2}, "list": {"$id": "list", "properties": {"embedding": {"items": {"$dynamicRef": "#item"}}}, "$defs": {"any": {"$dynamicAnchor": "item"}}}}},
    "vec_id", "list_min(embedding) >= -2",
)
checked("kw_additional_items_draft7", "embeddings", {"$schema": "http://json-schema.org/draft-07/schema#", "properties": {"embedding": {"items": [{"minimum": 0}], "additionalItems": {"minimum": -2}}}}, "vec_id", "embedding[1] >= 0 AND list_min(embedding[2:]) >= -2")
checked("kw_reference_hides_siblings_draft7", "part", {"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"s": {"maximum": 20}}, "properties": {"p_size": {"$ref": "#/definitions/s", "minimum": 10}}}, "p_partkey", "p_size <= 20")
checked("kw_custom_format", "part", {"properties": {"p_brand": {"format": "odd"}}}, "p_partkey", "p_brand SIMILAR TO '.*[13579]'", formats=True, custom_formats={"odd": lambda s: s[-1:] in "13579"})
checked("kw_without_validation", "part", {"properties": {"p_size": {"maximum": 10}, "p_brand": False}, "minProperties": 99}, "p_partkey", "p_brand IS NULL", without=frozenset({"validation"}))


def _inlined(draft) -> Callable[[str], str]:
    return lambda text: canonical_json(inline(parse_json(text), draft))


_REFS = lambda: _text('{"$defs":{"a":{"maximum":', _SIZE(), '},"b":{"$ref":"#/$defs/a"}},"properties":{"x":{"$ref":"#/$defs/b","minimum":', _P(), '},"y":{"items":{"$ref":"#/$defs/a"}}}}')
mapped("inline_references", "part", "p_partkey", _REFS, _inlined(DRAFT2020), """'{"properties":{"x":{"allOf":[{"maximum":' || p_size || '},{"minimum":' || p_partkey || '}]},"y":{"items":{"maximum":' || p_size || '}}}}'""")
mapped("inline_references_draft7", "part", "p_partkey", _REFS, _inlined(DRAFT7), """'{"properties":{"x":{"maximum":' || p_size || '},"y":{"items":{"maximum":' || p_size || '}}}}'""")
mapped("walk_subschemas", "part", "p_partkey", lambda: _text('{"properties":{"', _BRAND(), '/":{"items":{"not":true}},"a":{"anyOf":[{},{"const":{"items":1}}]}}}'), lambda t: " ".join(at for at, _ in nodes(parse_json(t))),
       """' /properties/' || p_brand || '~1 /properties/' || p_brand || '~1/items /properties/' || p_brand || '~1/items/not /properties/a /properties/a/anyOf/0 /properties/a/anyOf/1'""")  # fmt: skip
_JOINS = ["/a/b", "#f", "?q=1", "//h.example/x", "urn:a:b"]
mapped("resolve_references", "pages", "page_id", lambda: _text("https://d", F.col("page_id"), ".example/x/y?z ", _pick("page_id", *_JOINS)), lambda t: resolve_uri(*t.split(" ")),
       "CASE page_id % 5 WHEN 0 THEN 'https://d' || page_id || '.example/a/b' WHEN 1 THEN 'https://d' || page_id || '.example/x/y?z#f' WHEN 2 THEN 'https://d' || page_id || '.example/x/y?q=1' WHEN 3 THEN 'https://h.example/x' ELSE 'urn:a:b' END")


# -- equality, exact numbers, formats, failures ---------------------------------------------------


def _json_docs(text: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("p_partkey", "p_size", text().alias("j"))


checked("kw_const_container", "part", {"const": {"s": "a:1.0,b", "n": [10, {"m": None}]}}, "p_partkey", "p_partkey % 3 <> 0 AND p_size = 10", _json_docs(lambda: _text('{"n":[', _SIZE(), F.when(_P() % 2 == 0, F.lit(".0")).otherwise(F.lit("")), ',{"m":null}],"s":"a:1', F.when(_P() % 3 == 0, F.lit("")).otherwise(F.lit(".0")), ',b"}')), column="j", parse=True)
checked("kw_enum_container", "part", {"enum": [[7, "7.0"], {"x": 1e2}, ["a:5.0,"]]}, "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN p_size = 7 WHEN 1 THEN p_size = 10 ELSE false END",
        _json_docs(lambda: F.when(_P() % 3 == 0, _text("[", _SIZE(), '.00,"', _SIZE(), '.0"]')).when(_P() % 3 == 1, _text('{"x":', _SIZE(), "e1}")).otherwise(_text('["a:', _SIZE(), ',"]'))), column="j", parse=True)
checked("kw_unique_objects", "part", {"uniqueItems": True}, "p_partkey", "p_partkey % 2 = 1 AND p_size <> 3", _json_docs(lambda: _text('[{"s":"', _SIZE(), ':1.0,"},{"s":"', _SIZE(), ":1", F.when(_P() % 2 == 0, F.lit(".0")).otherwise(F.lit("")), ',"},[', _SIZE(), "],[3e0]]")), column="j", parse=True)
checked("kw_multiple_of_extremes", "part", {"multipleOf": 0.3}, "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_size % 3 = 0 ELSE p_size % 3 = 0 END",
        _json_docs(lambda: F.when(_P() % 4 == 0, _text(_SIZE() * 3, "e25")).when(_P() % 4 == 1, _text(_SIZE(), "e-20")).when(_P() % 4 == 2, _text(_SIZE(), "00000000000000000000000000")).otherwise(_text(_SIZE(), "e-1"))), column="j", parse=True)
checked("kw_numbers_beyond_38_digits", "part", {"maximum": 10**45, "not": {"const": 7 * 10**44}}, "p_partkey", "p_size <= 10 AND p_size <> 7", _json_docs(lambda: _text(_SIZE(), F.repeat(F.lit("0"), 44))), column="j", parse=True, exact_numbers=True)


@query("SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS plain, '0.00' || p_size || '1' AS small, p_size || repeat('0', 12) AS large FROM part")
def number_notation(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", number_text_column(price).alias("plain"), number_text_column(_text(_SIZE(), "10e-", F.length(_SIZE().cast("string")) + 4)).alias("small"), number_text_column(_text(_SIZE(), ".0E12")).alias("large"))


_HOSTS = ["ab--cd.de", "123", "a.123", "xn--bcher-kva.example", "xn--a", "a.b.", "x."]
formatted("fmt_hostname_labels", "hostname", "customer", "c_custkey", lambda: _pick("c_custkey", *_HOSTS), "c_custkey % 7 IN (0, 3, 5)")
formatted("fmt_idn_hostname_labels", "idn-hostname", "customer", "c_custkey", lambda: _pick("c_custkey", *_HOSTS, "ü.123", "１２３", "ü.de."), "c_custkey % 10 IN (3, 5, 9)")
formatted("fmt_email_domains", "email", "customer", "c_custkey", lambda: F.concat(F.lit("a@"), _pick("c_custkey", *_HOSTS)), "c_custkey % 7 IN (0, 1, 2, 3)")
formatted("fmt_idn_email_domains", "idn-email", "customer", "c_custkey", lambda: F.concat(F.lit("ü@"), _pick("c_custkey", *_HOSTS, "ü.123", "ü--x.de")), "c_custkey % 9 IN (0, 1, 2, 3, 7, 8)")


@query("SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_size > 40 THEN '/p_size: maximum is 40 (maximum at /properties/p_size/maximum)' END, CASE WHEN p_retailprice < 950 THEN '/p_retailprice: minimum is 950 (minimum at /properties/p_retailprice/minimum)' END) AS text FROM (SELECT p_partkey, p_size, p_retailprice FROM part)")
def violations_as_text(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    rows = Contract({"allOf": [True], "properties": {"p_size": {"maximum": 40}, "p_retailprice": {"minimum": 950}}}).validate(df)
    ordered = F.array_sort("violations", lambda a, b: F.when(a["instance_path"] > b["instance_path"], -1).otherwise(1))
    return rows.select("p_partkey", violations_text(ordered).alias("text"))


@query("SELECT p_partkey, 'a/b~' AS first, p_brand AS second, p_size AS third FROM part")
def path_segments(spark, sf_dir):
    parts = instance_segments(_text("/a~1b~0/", _BRAND(), "/", _SIZE()))
    return table(spark, sf_dir, "part").select("p_partkey", parts[0]["key"].alias("first"), parts[1]["key"].alias("second"), parts[2]["idx"].alias("third"))


@query("SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def rows_to_instances(spark, sf_dir):
    @F.pandas_udf("string")
    def ordered(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))

    return rows_as_json(table(spark, sf_dir, "nation")).select(ordered("value").alias("value"))
