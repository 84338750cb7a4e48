"""Registered queries over the driver's tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import strings
from corvane.functions.formats import format_column
from corvane.functions.numbers import variant_text
from corvane.operators.contract import Contract, leaves, missing_references, targets_key
from corvane.operators.generate import schema_of, schema_rows
from corvane.operators.infer import infer_types
from corvane.streaming.frames import hold_last, render_half_blocks, ring_last

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(name: str, source: str, schema: dict, keys: str, condition: str, prepare: Callable[[DataFrame], DataFrame] | None = None, prepared: str | None = None, column: str | None = None, parse: bool = False, **options) -> None:
    """A query of each row's keys and whether it meets a schema (ok, 0 or 1); its SQL evaluates the condition."""
    contract = Contract(schema, **options)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = prepare(df) if prepare else df
        return df.select(*(k.strip() for k in keys.split(",")), contract.is_valid(df, column, parse).cast("int").alias("ok"))

    query(f"SELECT {keys}, CAST(coalesce({condition}, false) AS INTEGER) AS ok FROM {prepared or source}", name)(run)


# -- contracts and reports --------------------------------------------------------

LINEITEM = {
    "type": "object",
    "required": ["l_orderkey", "l_returnflag"],
    "properties": {"l_quantity": {"type": "number", "minimum": 1, "maximum": 45}, "l_discount": {"maximum": 0.08}, "l_returnflag": {"enum": ["A", "N"]}, "l_tax": {"exclusiveMaximum": 0.08}},
}
_RULES = (("maximum", "/l_discount", "l_discount > 0.08"), ("minimum", "/l_quantity", "l_quantity < 1"), ("maximum", "/l_quantity", "l_quantity > 45"), ("enum", "/l_returnflag", "l_returnflag NOT IN ('A','N')"), ("exclusiveMaximum", "/l_tax", "l_tax >= 0.08"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS keyword, '{p}' AS instance_path, count(*) AS n FROM lineitem WHERE {c} HAVING count(*) > 0" for k, p, c in _RULES))
def contract_lineitem_violations(spark, sf_dir):
    return Contract(LINEITEM).report(table(spark, sf_dir, "lineitem"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT ({' OR '.join(c for *_, c in _RULES)})")
def contract_valid_rows(spark, sf_dir):
    return Contract(LINEITEM).valid(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT first_path, first_keyword, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {c} THEN '{p}'" for _, p, c in _RULES) + " END AS first_path, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, _, c in _RULES) + " END AS first_keyword FROM lineitem) GROUP BY ALL")
def contract_first_violation_per_row(spark, sf_dir):
    df = Contract(LINEITEM).first_violation(table(spark, sf_dir, "lineitem"))
    return df.groupBy(F.col("violation.instance_path").alias("first_path"), F.col("violation.keyword").alias("first_keyword")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus, keyword, n FROM (SELECT l_linestatus, keyword, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT l_linestatus, '{k}' AS keyword FROM lineitem WHERE {c}" for k, _, c in _RULES) + ") GROUP BY ROLLUP (l_linestatus, keyword))")
def contract_report_rollup(spark, sf_dir):
    rows = Contract(LINEITEM).violations(table(spark, sf_dir, "lineitem"), keep=["l_linestatus"])
    return rows.rollup("l_linestatus", "keyword").agg(F.count(F.lit(1)).alias("n"))


DOCUMENT = {"required": ["lang", "text"], "properties": {"n_chars": {"minimum": 200, "maximum": 5000}, "lang": {"enum": ["en", "de"]}, "text": {"maxLength": 4000}}}


@query("SELECT source, keyword, count(*) AS n FROM (SELECT source, 'minimum' AS keyword FROM documents WHERE n_chars < 200 UNION ALL SELECT source, 'maximum' FROM documents WHERE n_chars > 5000 UNION ALL SELECT source, 'enum' FROM documents WHERE lang NOT IN ('en','de') UNION ALL SELECT source, 'maxLength' FROM documents WHERE length(text) > 4000) GROUP BY ALL")
def violations_by_source(spark, sf_dir):
    rows = Contract(DOCUMENT).violations(table(spark, sf_dir, "documents"), keep=["source"])
    return rows.groupBy("source", "keyword").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT keyword, count(*) AS n FROM (SELECT 'minimum' AS keyword FROM documents WHERE n_chars < 200 UNION ALL SELECT 'maximum' FROM documents WHERE n_chars > 5000 UNION ALL SELECT 'enum' FROM documents WHERE lang NOT IN ('en','de') UNION ALL SELECT 'maxLength' FROM documents WHERE length(text) > 4000) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 2")
def violations_topk_keyword(spark, sf_dir):
    rows = Contract(DOCUMENT).violations(table(spark, sf_dir, "documents"))
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(2)


NESTED = {"anyOf": [{"properties": {"p_size": {"maximum": 10}}}, {"properties": {"p_retailprice": {"minimum": 1200}}}], "required": ["p_brand"]}


@query("SELECT p_partkey, CASE WHEN p_size <= 10 OR p_retailprice >= 1200 THEN 0 ELSE 3 END AS n_all, CASE WHEN p_size <= 10 OR p_retailprice >= 1200 THEN 0 ELSE 2 END AS n_leaves, CASE WHEN p_size <= 10 OR p_retailprice >= 1200 THEN NULL ELSE '/p_retailprice' END AS last_path FROM part")
def violation_leaves(spark, sf_dir):
    df = Contract(NESTED).validate(table(spark, sf_dir, "part"))
    deep = leaves(F.col("violations"))
    return df.select("p_partkey", F.size("violations").alias("n_all"), F.size(deep).alias("n_leaves"), F.try_element_at(deep, F.lit(-1))["instance_path"].alias("last_path"))


@query("SELECT keyword, about_key, count(*) AS n FROM (SELECT 'maximum' AS keyword, 0 AS about_key FROM events WHERE json_extract(props, '$.k')::INT > 50 UNION ALL SELECT 'required', 1 FROM events) GROUP BY ALL")
def violation_targets_key(spark, sf_dir):
    rows = Contract({"required": ["missing"], "properties": {"k": {"maximum": 50}}}).violations(table(spark, sf_dir, "events"), "props", parse=True)
    return rows.groupBy("keyword", targets_key(F.col("keyword")).cast("int").alias("about_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def referential_contract(spark, sf_dir):
    return missing_references(table(spark, sf_dir, "orders"), ["o_custkey"], table(spark, sf_dir, "customer").filter("c_acctbal > 0"), ["c_custkey"]).select("o_orderkey")


# -- keywords ---------------------------------------------------------------------

checked("kw_type_events_props", "events", {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}, "event_id", "json_type(props) = 'OBJECT' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')", column="props", parse=True)
checked(
    "kw_type_by_value", "events", {"type": ["integer", "null"]}, "event_id", "event_id % 4 IN (0, 1, 3)", prepare=lambda df: df.withColumn("j", F.element_at(F.array(*map(F.lit, ["1.0", "7", '"7"', "null"])), (F.col("event_id") % 4 + 1).cast("int"))), column="j", parse=True
)
checked("kw_enum", "orders", {"properties": {"o_orderpriority": {"enum": ["1-URGENT", "5-LOW", 3]}}}, "o_orderkey", "o_orderpriority IN ('1-URGENT', '5-LOW')")
checked("kw_const", "orders", {"properties": {"o_orderstatus": {"const": "F"}}}, "o_orderkey", "o_orderstatus = 'F'")
checked("kw_multiple_of", "lineitem", {"properties": {"l_quantity": {"multipleOf": 5}, "l_extendedprice": {"multipleOf": 0.03}}}, "l_orderkey, l_linenumber, l_partkey, l_suppkey", "CAST(l_quantity AS DECIMAL(20,4)) % 5 = 0 AND CAST(l_extendedprice AS DECIMAL(20,4)) % 0.03 = 0")
checked("kw_numeric_bounds", "part", {"properties": {"p_size": {"minimum": 5, "maximum": 40.5}, "p_retailprice": {"minimum": 901.5}}}, "p_partkey", "p_size BETWEEN 5 AND 40.5 AND p_retailprice >= 901.5")
checked("kw_exclusive_bounds", "customer", {"properties": {"c_acctbal": {"exclusiveMinimum": 0, "exclusiveMaximum": 5000}}}, "c_custkey", "c_acctbal > 0 AND c_acctbal < 5000")
checked("kw_string_length", "documents", {"properties": {"text": {"minLength": 500, "maxLength": 3000}}}, "doc_id", "length(text) BETWEEN 500 AND 3000")
checked("kw_pattern", "customer", {"properties": {"c_name": {"pattern": r"^Customer#\d{8}[02468]$"}}}, "c_custkey", r"regexp_matches(c_name, '^Customer#\d{8}[02468]$')")
checked("kw_pattern_unsupported", "customer", {"properties": {"c_name": {"pattern": "(?=Customer)"}}}, "c_custkey", "false")
checked("kw_items", "embeddings", {"properties": {"embedding": {"items": {"minimum": -2.5, "maximum": 2.5}}}}, "vec_id", "len(list_filter(embedding, lambda x: x < -2.5 OR x > 2.5)) = 0")
checked("kw_prefix_items", "embeddings", {"properties": {"embedding": {"prefixItems": [{"minimum": 0}, {"maximum": 0.5}], "items": {"maximum": 3}}}}, "vec_id", "embedding[1] >= 0 AND embedding[2] <= 0.5 AND len(list_filter(embedding[3:], lambda x: x > 3)) = 0")
checked("kw_contains", "embeddings", {"properties": {"embedding": {"contains": {"exclusiveMinimum": 2.4}}}}, "vec_id", "len(list_filter(embedding, lambda x: x > 2.4)) > 0")
checked("kw_min_max_contains", "embeddings", {"properties": {"embedding": {"contains": {"minimum": 0.5}, "minContains": 15, "maxContains": 25}}}, "vec_id", "len(list_filter(embedding, lambda x: x >= 0.5)) BETWEEN 15 AND 25")
_WORDS = lambda df: df.select("doc_id", F.split("text", " ").alias("words"))
_WORDS_SQL = "(SELECT doc_id, string_split(text, ' ') AS words FROM documents)"
checked("kw_array_length", "documents", {"properties": {"words": {"minItems": 100, "maxItems": 400}}}, "doc_id", "len(words) BETWEEN 100 AND 400", _WORDS, _WORDS_SQL)
checked("kw_unique_items", "documents", {"properties": {"words": {"uniqueItems": True}}}, "doc_id", "len(words) = len(list_distinct(words))", _WORDS, _WORDS_SQL)
_HOLES = lambda df: df.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.when(F.col("p_size") < 40, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("price"))
_HOLES_SQL = "(SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS brand, CASE WHEN p_size < 40 THEN p_size END AS size, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS price FROM part)"
checked("kw_properties_required", "part", {"required": ["brand", "size"], "properties": {"price": {"minimum": 950}}}, "p_partkey", "brand IS NOT NULL AND size IS NOT NULL AND (price IS NULL OR price >= 950)", _HOLES, _HOLES_SQL)
checked("kw_null_as_null", "part", {"properties": {"brand": {"type": "string"}, "size": {"type": ["integer", "null"]}}}, "p_partkey", "brand IS NOT NULL", _HOLES, _HOLES_SQL, null_as="null")
checked("kw_property_count", "part", {"minProperties": 3, "maxProperties": 3}, "p_partkey", "1 + (brand IS NOT NULL)::INT + (size IS NOT NULL)::INT + (price IS NOT NULL)::INT = 3", _HOLES, _HOLES_SQL)
checked("kw_dependent_required", "part", {"dependentRequired": {"price": ["brand", "size"]}}, "p_partkey", "price IS NULL OR (brand IS NOT NULL AND size IS NOT NULL)", _HOLES, _HOLES_SQL)
checked("kw_dependent_schemas", "part", {"dependentSchemas": {"brand": {"properties": {"size": {"maximum": 30}}}}}, "p_partkey", "brand IS NULL OR size IS NULL OR size <= 30", _HOLES, _HOLES_SQL)
checked("kw_dependencies", "part", {"dependencies": {"brand": ["size"], "price": {"properties": {"size": {"minimum": 12}}}}}, "p_partkey", "(brand IS NULL OR size IS NOT NULL) AND (price IS NULL OR size IS NULL OR size >= 12)", _HOLES, _HOLES_SQL)
_MAP = lambda df: df.select("event_id", F.create_map(F.concat(F.lit("t_"), "event_type"), F.col("value"), F.lit("user"), F.col("user_id").cast("double")).alias("m"))
checked("kw_pattern_properties", "events", {"properties": {"m": {"patternProperties": {"^t_(click|view)$": {"maximum": 10}}}}}, "event_id", "event_type NOT IN ('click', 'view') OR value <= 10", _MAP)
checked("kw_additional_properties", "events", {"properties": {"m": {"properties": {"user": {}}, "patternProperties": {"^t_c": True}, "additionalProperties": {"minimum": 5}}}}, "event_id", "event_type LIKE 'c%' OR value >= 5", _MAP)
checked("kw_property_names", "events", {"properties": {"m": {"propertyNames": {"maxLength": 6}}}}, "event_id", "length('t_' || event_type) <= 6", _MAP)
checked("kw_map_count", "events", {"properties": {"m": {"minProperties": 2}}}, "event_id", "true", _MAP)
checked("kw_all_of", "lineitem", {"allOf": [{"properties": {"l_tax": {"maximum": 0.05}}}, {"properties": {"l_quantity": {"minimum": 10}}}]}, "l_orderkey, l_linenumber, l_partkey, l_suppkey", "l_tax <= 0.05 AND l_quantity >= 10")
checked("kw_any_of", "lineitem", {"anyOf": [{"properties": {"l_tax": {"maximum": 0.02}}}, {"properties": {"l_returnflag": {"const": "R"}}}]}, "l_orderkey, l_linenumber, l_partkey, l_suppkey", "l_tax <= 0.02 OR l_returnflag = 'R'")
checked("kw_one_of", "lineitem", {"oneOf": [{"properties": {"l_tax": {"maximum": 0.04}}}, {"properties": {"l_discount": {"minimum": 0.05}}}, {"properties": {"l_linenumber": {"const": 1}}}]}, "l_orderkey, l_linenumber, l_partkey, l_suppkey", "(l_tax <= 0.04)::INT + (l_discount >= 0.05)::INT + (l_linenumber = 1)::INT = 1")
checked("kw_not", "orders", {"not": {"properties": {"o_orderstatus": {"enum": ["F", "O"]}}}}, "o_orderkey", "o_orderstatus NOT IN ('F', 'O')")
checked("kw_if_then_else", "orders", {"if": {"properties": {"o_orderstatus": {"const": "F"}}}, "then": {"properties": {"o_totalprice": {"maximum": 200000}}}, "else": {"properties": {"o_totalprice": {"minimum": 100000}}}}, "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice <= 200000 ELSE o_totalprice >= 100000 END")
checked("kw_ref_inlined", "part", {"$defs": {"small": {"maximum": 20}, "alias": {"$ref": "#/$defs/small"}}, "properties": {"p_size": {"$ref": "#/$defs/alias", "minimum": 3}}}, "p_partkey", "p_size BETWEEN 3 AND 20")
checked("kw_false_schema", "part", {"properties": {"p_type": False}}, "p_partkey", "p_type IS NULL")
checked(
    "kw_unevaluated_properties", "events", {"properties": {"m": {"anyOf": [{"properties": {"user": {"maximum": 40}}}, {"properties": {"t_click": {}}}], "unevaluatedProperties": False}}}, "event_id",
    # user is evaluated by the first branch if it holds; t_click by the second, which always holds
    "user_id <= 40 AND event_type = 'click'", _MAP,
)
checked("kw_unevaluated_items", "embeddings", {"properties": {"embedding": {"prefixItems": [True], "contains": {"minimum": 0}, "unevaluatedItems": {"minimum": -1}}}}, "vec_id", "len(list_filter(embedding, lambda x: x >= 0)) > 0 AND len(list_filter(embedding[2:], lambda x: x < 0 AND x < -1)) = 0")
_B64 = lambda df: df.select("c_custkey", F.element_at(F.array(F.base64(F.col("c_name").cast("binary")), F.lit("YQ"), F.lit("a*b="), F.base64(F.concat(F.lit('{"a":'), "c_custkey", F.lit("}")).cast("binary"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("s"))
checked("kw_content_encoding", "customer", {"properties": {"s": {"contentEncoding": "base64"}}}, "c_custkey", "c_custkey % 4 IN (0, 3)", _B64, content=True)
checked("kw_content_media_type", "customer", {"properties": {"s": {"contentEncoding": "base64", "contentMediaType": "application/json"}}}, "c_custkey", "c_custkey % 4 = 3", _B64, content=True)
_TURNS = lambda df: df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
checked(
    "kw_array_of_objects", "conversations", {"properties": {"turns": {"items": {"properties": {"role": {"enum": ["user", "assistant"]}, "turn": {"maximum": 6}}}, "contains": {"properties": {"role": {"const": "assistant"}}}}}}, "conv_id", "ok_all AND has",
    _TURNS, "(SELECT conv_id, bool_and(role IN ('user','assistant') AND turn <= 6) AS ok_all, bool_or(role = 'assistant') AS has FROM conversations GROUP BY conv_id)",
)
checked(
    "kw_recursive_ref", "events", {"$defs": {"tree": {"type": "object", "properties": {"v": {"maximum": 80}, "c": {"items": {"$ref": "#/$defs/tree"}}}, "required": ["v"]}}, "$ref": "#/$defs/tree"}, "event_id", "json_extract(props, '$.k')::INT <= 80 AND event_id % 5 <> 0",
    lambda df: df.select("event_id", F.concat(F.lit('{"v":1,"c":[{"v":2},{"c":[],"v":'), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 5 == 0, F.lit(',"x":0},{"c":[]}]}')).otherwise(F.lit("}]}"))).alias("j")), column="j", parse=True,
)


# -- formats ----------------------------------------------------------------------


def formatted(name: str, fmt: str, source: str, key: str, text: Callable[[], Column], sql_condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.select(key, format_column(fmt, text()).cast("int").alias("ok"))

    query(f"SELECT {key}, CAST(coalesce({sql_condition}, false) AS INTEGER) AS ok FROM {source}", name)(run)


def _pad(c: Column, n: int = 2) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _pick(key: str, *texts: Column | str) -> Column:
    return F.element_at(F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts)), (F.col(key) % len(texts) + 1).cast("int"))


_K = lambda: F.col("o_orderkey")
_DATE = lambda: F.concat(F.lit(1896) + _K() % 210, F.lit("-"), _pad(_K() % 14), F.lit("-"), _pad(_K() % 33))
_DATE_OK = "try_cast((1896 + o_orderkey % 210) || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS DATE) IS NOT NULL"
_TIME = lambda: F.concat(_pad(_K() % 26), F.lit(":"), _pad(_K() % 61), F.lit(":"), _pad(_K() % 62), F.when(_K() % 7 == 0, F.lit("")).when(_K() % 2 == 0, F.lit(".5Z")).otherwise(F.lit("+00:30")))
# with +00:30 a leap second at 00:29 is UTC 23:59
_TIME_OK = "(o_orderkey % 7 <> 0 AND o_orderkey % 26 <= 23 AND o_orderkey % 61 <= 59 AND (o_orderkey % 62 <= 59 OR (o_orderkey % 62 = 60 AND CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 26 = 23 AND o_orderkey % 61 = 59 ELSE o_orderkey % 26 = 0 AND o_orderkey % 61 = 29 END)))"
formatted("fmt_date", "date", "orders", "o_orderkey", lambda: _DATE(), _DATE_OK)
formatted("fmt_time", "time", "orders", "o_orderkey", lambda: _TIME(), _TIME_OK)
formatted("fmt_date_time", "date-time", "orders", "o_orderkey", lambda: F.concat(_DATE(), F.when(_K() % 3 == 0, F.lit(" ")).otherwise(F.lit("T")), _TIME()), f"o_orderkey % 3 <> 0 AND {_DATE_OK} AND {_TIME_OK}")
_C = lambda: F.col("c_custkey")
_N = lambda: (_C() % 50).cast("string")
formatted("fmt_duration", "duration", "customer", "c_custkey", lambda: _pick("c_custkey", F.concat(F.lit("P"), _N(), F.lit("D")), F.concat(F.lit("P"), _N(), F.lit("Y1D")), F.concat(F.lit("PT"), _N(), F.lit("H5M")), "P", F.concat(F.lit("P"), _N(), F.lit("W")), F.concat(F.lit("P1Y2M"), _N(), F.lit("DT3S")), "P1WT2H", "PT"), "c_custkey % 8 IN (0, 2, 4, 5)")
formatted("fmt_uri", "uri", "pages", "page_id", lambda: F.concat(F.col("url"), F.when(F.col("page_id") % 5 == 0, F.lit(" x")).when(F.col("page_id") % 5 == 1, F.lit("%2")).otherwise(F.lit("%20"))), "page_id % 5 NOT IN (0, 1)")
formatted("fmt_uri_reference", "uri-reference", "pages", "page_id", lambda: _pick("page_id", F.regexp_extract("url", "//[^/]+(/[^?#]*)", 1), F.concat(F.lit("1:"), "url"), "?q#f", "a|b"), "page_id % 4 IN (0, 2)")
formatted("fmt_hostname", "hostname", "customer", "c_custkey", lambda: _pick("c_custkey", F.concat(F.lit("host-"), _N(), F.lit(".example.com")), F.concat(F.lit("-h"), _N()), F.concat(F.lit("h."), _N()), F.concat(F.lit("a_b"), _N()), F.repeat(F.lit("a"), (_C() % 70 + 1).cast("int")), F.lit("x.example.")), "CASE c_custkey % 6 WHEN 0 THEN true WHEN 4 THEN c_custkey % 70 + 1 <= 63 WHEN 5 THEN true ELSE false END")
formatted("fmt_ipv4", "ipv4", "customer", "c_custkey", lambda: F.concat_ws(".", (_C() % 300).cast("string"), _N(), F.lit("0"), F.when(_C() % 4 == 0, F.lit("01")).otherwise(F.lit("255"))), "c_custkey % 300 <= 255 AND c_custkey % 4 <> 0")
formatted("fmt_ipv6", "ipv6", "customer", "c_custkey", lambda: _pick("c_custkey", F.concat(F.lit("2001:db8::"), _N()), "::", "1:2:3:4:5:6:7", "::ffff:1.2.3.4", "1::2::3", "1.2.3.4", "fe80::1%eth0"), "c_custkey % 7 IN (0, 1, 3)")
formatted("fmt_uuid", "uuid", "customer", "c_custkey", lambda: F.regexp_replace(F.md5(F.col("c_name").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", F.when(_C() % 3 == 0, "$1-$2-$3$4-").otherwise("$1-$2-$3-$4-")), "c_custkey % 3 <> 0")
formatted("fmt_json_pointer", "json-pointer", "customer", "c_custkey", lambda: _pick("c_custkey", "", "/a/~0~1", F.concat(F.lit("/"), _N()), "a", "/~2", "/~"), "c_custkey % 6 IN (0, 1, 2)")
formatted("fmt_relative_json_pointer", "relative-json-pointer", "customer", "c_custkey", lambda: _pick("c_custkey", "0", "1#", F.concat(F.lit("2/"), _N()), "01", "/a", "1/~3"), "c_custkey % 6 IN (0, 1, 2)")
formatted("fmt_email", "email", "customer", "c_custkey", lambda: _pick("c_custkey", F.concat(F.lit("user"), _N(), F.lit("@example.com")), '"a b"@example.org', "x@[127.0.0.1]", "x@[IPv6:::1]", ".a@example.com", "a..b@example.com", "a@-x.com", "a@b@c", F.concat(F.repeat(F.lit("l"), (_C() % 80 + 1).cast("int")), F.lit("@e.de"))), "CASE WHEN c_custkey % 9 IN (0, 1, 2, 3) THEN true WHEN c_custkey % 9 = 8 THEN c_custkey % 80 + 1 <= 64 ELSE false END")
formatted("fmt_uri_template", "uri-template", "customer", "c_custkey", lambda: _pick("c_custkey", "/x/{id}", "{?a,b*}", "{x:3}", "{", "{a b}", "{x:0}", "/é{+path}"), "c_custkey % 7 IN (0, 1, 2, 6)")
formatted("fmt_regex", "regex", "customer", "c_custkey", lambda: _pick("c_custkey", "^a+b?$", "(a|b){2,3}", "[", "a{3,1}", "(?<n>x)\\d", ")", "*a"), "c_custkey % 7 IN (0, 1, 4)")
formatted("fmt_idn_hostname", "idn-hostname", "customer", "c_custkey", lambda: _pick("c_custkey", "bücher.example", "実例.テスト", "l·l.cat", "a·b", "-ü", "üa--x", "example"), "c_custkey % 7 IN (0, 1, 2, 6)")
formatted("fmt_idn_email", "idn-email", "customer", "c_custkey", lambda: _pick("c_custkey", "用户@例え.jp", "a@b.de", "@x.de", "ü.@x.de"), "c_custkey % 4 IN (0, 1)")
formatted("fmt_iri", "iri", "customer", "c_custkey", lambda: _pick("c_custkey", "http://é.example/ü?q#f", "/ü", "http://a b", "urn:x:y"), "c_custkey % 4 IN (0, 3)")
formatted("fmt_iri_reference", "iri-reference", "customer", "c_custkey", lambda: _pick("c_custkey", "é?ü", "/a/b", "\\x", "a<b"), "c_custkey % 4 IN (0, 1)")


# -- inference and merge ------------------------------------------------------------


@query("SELECT '' AS path, 32 AS bits, count(*) AS n FROM events UNION ALL SELECT '/k', bit_or(CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 4 WHEN 'BIGINT' THEN 4 WHEN 'DOUBLE' THEN 8 END), count(*) FROM events")
def infer_events_schema(spark, sf_dir):
    return infer_types(table(spark, sf_dir, "events"), "props")


@query("SELECT path, bit_or(bit) AS bits, count(*) AS n FROM (SELECT '' AS path, 32 AS bit FROM events UNION ALL SELECT '/a', CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 1 END FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT '/b', CASE WHEN event_id % 2 = 0 THEN 16 ELSE 2 END FROM events WHERE event_id % 3 = 0) GROUP BY path")
def infer_mixed_types(spark, sf_dir):
    a = F.element_at(F.array(F.lit('"a":1'), F.lit('"a":1.0'), F.lit('"a":null'), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    b = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit('"b":"x"')).otherwise(F.lit('"b":true')))
    return infer_types(table(spark, sf_dir, "events").select(F.concat(F.lit("{"), F.concat_ws(",", a, b), F.lit("}")).alias("j")), "j")


@query("SELECT path, bits, n FROM (SELECT '' AS path, 64 AS bits, count(*) AS n FROM events UNION ALL SELECT '/*', 4 | 1, sum(CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END)::BIGINT FROM events)")
def infer_array_items(spark, sf_dir):
    return infer_types(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.lit("[1,null,3]")).otherwise(F.lit("[4,5]")).alias("j")), "j")


@query("SELECT '/p_partkey' AS path, 4 AS bits, count(*) AS n FROM part UNION ALL SELECT '/p_name', 16, count(*) FROM part UNION ALL SELECT '/p_brand', 16, count(*) FROM part UNION ALL SELECT '/p_type', 16, count(*) FROM part UNION ALL SELECT '/p_size', 4, count(*) FROM part UNION ALL SELECT '/p_retailprice', 8, count(*) FROM part")
def infer_typed_columns(spark, sf_dir):
    return infer_types(table(spark, sf_dir, "part"))


_TABLES = {"region": ["r_regionkey integer", "r_name string"], "nation": ["n_nationkey integer", "n_name string", "n_regionkey integer"], "embeddings": ["vec_id integer", "embedding array", "label integer"], "events": ["event_id integer", "ts string", "user_id integer", "event_type string", "value number", "props string"]}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c.split()[0]}', '{c.split()[1]}', 1)" for t, cs in _TABLES.items() for c in cs) + ") AS v(table_name, column_name, json_type, nullable)")
def generate_schema_rows(spark, sf_dir):
    rows = [r for t in _TABLES for r in schema_rows(schema_of(table(spark, sf_dir, t)), t)]
    return spark.createDataFrame([(t, c, k, int(n)) for t, c, k, n in rows], "table_name string, column_name string, json_type string, nullable int")


# -- streams, strings, equality -------------------------------------------------------


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 8")
def ring_last_n_per_user(spark, sf_dir):
    return ring_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 8).select("event_id", "user_id")


@query("""WITH t AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS tick, arg_max(value, (ts, value)) AS v FROM events GROUP BY ALL),
s AS (SELECT event_type, unnest(range(min(tick), max(tick) + 1)) AS tick FROM t GROUP BY event_type)
SELECT s.event_type, s.tick, last_value(t.v IGNORE NULLS) OVER (PARTITION BY s.event_type ORDER BY s.tick ROWS UNBOUNDED PRECEDING) AS value FROM s LEFT JOIN t ON s.event_type = t.event_type AND s.tick = t.tick""")
def pacing_hold_last(spark, sf_dir):
    return hold_last(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], 3600)


@query("SELECT n_nationkey AS seq, '\x1b[38;2;' || (n_nationkey * 10) || ';0;7m\x1b[48;2;0;0;0m▀\x1b[38;2;1;2;3m\x1b[48;2;0;0;0m▀\x1b[0m\n' AS text FROM nation")
def render_half_block(spark, sf_dir):
    pix = F.unhex(F.concat(F.lpad(F.hex(F.col("n_nationkey") * 10), 2, "0"), F.lit("0007FF"), F.lit("010203FF")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), render_half_blocks(pix, F.lit(2), F.lit(1)).alias("text"))


_LINES = lambda: F.split("text", " ")
_LINES_SQL = "string_split(text, ' ')"


@query(f"SELECT doc_id, array_to_string({_LINES_SQL}, chr(10)) AS lf, array_to_string({_LINES_SQL}, chr(13) || chr(10)) AS crlf, array_to_string({_LINES_SQL}, chr(10)) || chr(10) AS closed FROM documents")
def str_join_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.join_lf(_LINES()).alias("lf"), strings.join_crlf(_LINES()).alias("crlf"), strings.lines_lf(_LINES()).alias("closed"))


@query("SELECT doc_id, regexp_replace(replace(text, '. ', ' ' || chr(9) || chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g') AS trimmed FROM documents")
def str_trim_line_ends(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.trim_line_ends(F.replace("text", F.lit(". "), F.lit(" \t\n"))).alias("trimmed"))


@query("SELECT c_custkey, c_name || chr(10) || repeat(' ', (c_custkey % 3)::INT) || c_mktsegment || chr(10) AS dedented FROM customer")
def str_dedent(spark, sf_dir):
    text = F.concat(F.lit("\n    "), "c_name", F.lit("\n    "), F.repeat(F.lit(" "), (F.col("c_custkey") % 3).cast("int")), "c_mktsegment", F.lit("\n  \t"))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.dedent(text).alias("dedented"))


@query("SELECT c_custkey, c_name || chr(10) || c_mktsegment AS kept FROM customer")
def str_strip_margin(spark, sf_dir):
    text = F.concat(F.lit("\n   |"), "c_name", F.lit("\n  no mark\n |"), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.strip_margin(text).alias("kept"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS rank, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS level FROM events")
def log_levels(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "Warning").otherwise(" info")
    return table(spark, sf_dir, "events").select("event_id", strings.level_rank(text).alias("rank"), strings.parse_level(text).alias("level"))


@query("SELECT event_id, 'event_type=' || event_type || ' value=' || CAST(value AS VARCHAR) || ' note=\"a b\"' AS line FROM events")
def log_lines(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("note", F.lit("a b"))
    return df.select("event_id", strings.log_line("logfmt", ["event_type", "value", "note"]).alias("line"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'fallback' ELSE 'unknown' END AS version FROM customer")
def version_fallback(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select("c_custkey", strings.first_known(F.when(k == 0, F.col("c_name")).otherwise(""), F.when(k == 1, F.lit("fallback"))).alias("version"))


@query("SELECT c_custkey, 'a/' || c_name || '~' AS key, 7 AS index FROM customer")
def pointer_functions(spark, sf_dir):
    path = F.concat(F.lit("/x/"), strings.pointer_escape(F.concat(F.lit("a/"), "c_name", F.lit("~"))), F.lit("/7"))
    parts = strings.pointer_segments(path)
    return table(spark, sf_dir, "customer").select("c_custkey", parts[1].alias("key"), strings.pointer_index(parts[2]).alias("index"))


@query("SELECT p_partkey, 1 AS equal_forms, CAST(p_size = 10 AS INTEGER) AS is_ten FROM part")
def canonical_json_equality(spark, sf_dir):
    size = F.col("p_size").cast("string")
    one = F.try_parse_json(F.concat(F.lit('{"b":'), size, F.lit(',"a":[1.0,{"y":null,"x":1e2}]}')))
    other = F.try_parse_json(F.concat(F.lit('{"a":[1,{"x":100,"y":null}],"b":'), size, F.lit(".0}")))
    ten = F.try_parse_json(F.lit('{"a":[1,{"x":100.0,"y":null}],"b":10}'))
    return table(spark, sf_dir, "part").select("p_partkey", (variant_text(one) == variant_text(other)).cast("int").alias("equal_forms"), (variant_text(one) == variant_text(ten)).cast("int").alias("is_ten"))


from corvane.plans import schema_queries  # noqa: E402, F401  registers its queries here
