"""Schema inference as a distributed aggregation, and the merge of schemas.

infer() flattens typed columns or JSON text into observations (document, path, type),
and one hash aggregation by path, combined before its only shuffle, folds them: types
as a bit mask, presence as a count, order and defaults by the least position. What is
collected is a row for each distinct path. merge() is the same fold on whole schemas.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.numbers import canonical_json, equal
from corvane.plans.model import clone, parse_json, plain

#: One bit for each type name (fixed order).
BITS = {"null": 1, "boolean": 2, "integer": 4, "number": 8, "string": 16, "object": 32, "array": 64}
MAX_DEPTH, MAX_NODES = 1000, 500_000


def type_bits(types: Any) -> int:
    names = types if isinstance(types, list) else [types]
    return reduce(lambda a, b: a | BITS[b], names, 0)


def types_of(bits: int) -> Any:
    """The widened type of observed bits: one type, number for integer and number, null beside; None for types that don't mix."""
    null, rest = bits & 1, bits & ~1
    if rest == 4 | 8:
        rest = 8
    if rest & (rest - 1):
        return None
    names = [n for n, b in BITS.items() if b == rest]
    if not names:
        return "null" if null else None
    return [names[0], "null"] if null else names[0]


def literal_type(x: Any) -> str:
    """The type by notation: 1 is an integer, 1.0 a number."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int):
        return "integer"
    if isinstance(x, (float, Decimal)):
        return "number"
    return "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def observations(value: Any, path: str = "", budget: list[int] | None = None, depth: int = 0) -> Iterator[tuple[str, int, str | None, bool]]:
    """(path, type bit, JSON of a scalar, is a typeless array) of a value and all below; "/*" is any item of an array.

    A mapping deeper than MAX_DEPTH, or beyond MAX_NODES visits, is an object of unknown members.
    """
    if budget is None:
        budget = [MAX_NODES]
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
    budget[0] -= 1
    kind = literal_type(value)
    if kind == "array":
        kinds = {literal_type(x) for x in value}
        mixed = types_of(reduce(lambda a, b: a | BITS[b], kinds, 0)) is None or kinds == {"null"}
        yield path, BITS[kind], canonical_json(value), mixed
        if not mixed and budget[0] > 0 and depth < MAX_DEPTH:
            for x in value:
                yield from observations(x, path + "/*", budget, depth + 1)
    elif kind == "object":
        yield path, BITS[kind], None, False
        if budget[0] > 0 and depth < MAX_DEPTH:
            for k, x in value.items():
                yield from observations(x, f"{path}/{k.replace('~', '~0').replace('/', '~1').replace('*', '~2')}", budget, depth + 1)
    else:
        yield path, BITS[kind], canonical_json(value), False


OBSERVED = "doc long, pos int, path string, bit int, json string, typeless boolean"


def flatten_json(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Observations of a column of JSON text: (doc, pos, path, bit, json, typeless). Null and text that isn't JSON observe nothing."""
    ordinal = F.col(order).cast("long") if order else F.monotonically_increasing_id()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                try:
                    value = parse_json(text)
                except (ValueError, TypeError, RecursionError):
                    continue
                rows += [(doc, i, *o) for i, o in enumerate(observations(value))]
            yield pd.DataFrame(rows, columns=["doc", "pos", "path", "bit", "json", "typeless"])

    return df.select(ordinal.alias("doc"), F.col(column).alias("text")).mapInPandas(run, OBSERVED)


def _typed(col: Column, kind: T.DataType, path: str) -> list[tuple[str, Column, Column | None]]:
    """(path, bit, JSON) of a typed column and the members below it that are not in arrays."""
    if isinstance(kind, T.StructType):
        below = [x for f in kind.fields for x in _typed(col.getField(f.name), f.dataType, f"{path}/{f.name}")]
        return [(path, F.when(col.isNull(), BITS["null"]).otherwise(BITS["object"]), None), *below]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        name = "integer"
    elif isinstance(kind, T.NumericType):
        name = "number"
    elif isinstance(kind, T.BooleanType):
        name = "boolean"
    elif isinstance(kind, T.ArrayType):
        name = "array"
    elif isinstance(kind, T.MapType):
        name = "object"
    else:
        name = "string"
    return [(path, F.when(col.isNull(), BITS["null"]).otherwise(BITS[name]), col.cast("string") if name not in ("array", "object") else None)]


def fold(observed: DataFrame) -> DataFrame:
    """One row for each path: bits (bit_or), documents that have it, first place, whether an array was typeless, first JSON."""
    first = F.min(F.struct("doc", "pos", "json"))
    return observed.groupBy("path").agg(
        F.bit_or("bit").alias("bits"), F.count_distinct("doc").alias("docs"), F.count(F.lit(1)).alias("n"), F.bool_or("typeless").alias("typeless"), first.alias("first"), F.min("json").alias("least"), F.max("json").alias("most")
    ).select("path", "bits", "docs", "n", "typeless", F.col("first.doc").alias("doc"), F.col("first.pos").alias("pos"), F.col("first.json").alias("json"), "least", "most")


def infer_types(df: DataFrame, column: str | None = None) -> DataFrame:
    """(path, bits, n): observed types of the columns of a table, or of a column of JSON text."""
    if column is not None:
        return flatten_json(df, column).groupBy("path").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    leaves = [x for f in df.schema.fields for x in _typed(F.col(f"`{f.name}`"), f.dataType, f"/{f.name}")]
    folded = df.agg(*(F.struct(F.bit_or(b).alias("bits"), F.count(F.lit(1)).alias("n")).alias(f"c{i}") for i, (_, b, _) in enumerate(leaves)))
    rows = [F.struct(F.lit(p).alias("path"), F.col(f"c{i}.bits").alias("bits"), F.col(f"c{i}.n").alias("n")) for i, (p, *_) in enumerate(leaves)]
    return folded.select(F.inline(F.array(*rows)))


def infer(df: DataFrame, column: str, order: str | None = None, defaults: bool = False, strict: bool = False, title: str | None = None, required: bool = False) -> dict:
    """A schema that accepts every document of a column of JSON text.

    Types widen (integer and number to number, null beside one other type); types that
    don't mix leave no constraint. With defaults the first value of each path stands as
    its default; strict closes objects; required lists members that all documents have.
    """
    rows = sorted(fold(flatten_json(df, column, order)).collect(), key=lambda r: (r.doc, r.pos))
    by = {r.path: r for r in rows}
    below: dict[str, list[str]] = {}
    for r in rows:
        if r.path:
            below.setdefault(r.path.rpartition("/")[0], []).append(r.path)

    def build(path: str, inside_items: bool) -> dict:
        r = by[path]
        out: dict[str, Any] = {}
        kind = types_of(r.bits)
        if kind is not None:
            out["type"] = kind
        only_object, only_array = r.bits & ~1 == BITS["object"], r.bits & ~1 == BITS["array"]
        children = [p for p in below.get(path, []) if not p.endswith("/*")]
        if only_object:
            if children:
                out["properties"] = {p.rpartition("/")[2].replace("~2", "*").replace("~1", "/").replace("~0", "~"): build(p, inside_items) for p in children}
            whole = [p.rpartition("/")[2].replace("~2", "*").replace("~1", "/").replace("~0", "~") for p in children if by[p].n >= r.n]
            if required and whole and not r.bits & 1:
                out["required"] = sorted(whole)
            out["additionalProperties"] = not strict
        if only_array and path + "/*" in by and not r.typeless:
            items = build(path + "/*", True)
            if items:
                out["items"] = items
        if defaults and r.json is not None and not inside_items and kind is not None:
            out["default"] = parse_json(r.json)
        return out

    schema = {"$schema": "http://json-schema.org/draft-07/schema#"} | ({"title": title} if title else {})
    return schema | (build("", False) if "" in by else {})


# -- merge ----------------------------------------------------------------------

#: How two values of a keyword combine (fixed groups).
LOWER = ("minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties")
UPPER = ("maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties")
EQUAL = (
    "pattern", "format", "multipleOf", "patternProperties", "propertyNames", "dependentRequired", "dependentSchemas", "dependencies", "unevaluatedItems", "unevaluatedProperties", "prefixItems", "additionalItems", "contains",
    "minContains", "maxContains", "definitions", "$defs", "contentEncoding", "contentMediaType", "contentSchema", "allOf", "anyOf", "oneOf", "not",
)
FIRST = ("$schema", "$id", "$comment", "$anchor", "$dynamicAnchor", "$vocabulary", "title", "description", "default", "examples")
#: Keywords that are merged by their members.
NESTED = frozenset(("type", "items", "properties", "additionalProperties"))
#: Marks a node whose types didn't mix, so that the fold stays associative; removed at the end.
MIXED = "x-corvane-mixed"


#: Keywords that say nothing about which values are valid.
SILENT = ("type", *FIRST, "deprecated", "readOnly", "writeOnly", "definitions", "$defs")


def constrains(s: dict) -> bool:
    """Whether a schema limits values by anything but its type; one without a type that doesn't stands for null."""
    return any(k not in SILENT and not k.startswith("x-") and not (k == "uniqueItems" and v is False) for k, v in s.items())


def _merge_types(a: dict, b: dict, out: dict) -> bool:
    """Sets the type of out; returns whether a side without a type that takes any type keeps out without one."""
    if "type" in a and "type" in b:
        bits = type_bits(a["type"]) | type_bits(b["type"])
        kind = a["type"] if type_bits(a["type"]) == type_bits(b["type"]) else types_of(bits)
        out.update({MIXED: True} if kind is None else {"type": kind})
        return False
    lacks = [s for s in (a, b) if "type" not in s]
    if any(map(constrains, lacks)):
        return True
    if len(lacks) == 1:
        kind = types_of(type_bits(a.get("type", b.get("type"))) | 1)
        if kind is not None:
            out["type"] = kind
    return False


def _merge_words(a: dict, b: dict, out: dict) -> None:
    """Titles, defaults and marks: the first side's; values: both sides'."""
    for k in FIRST:
        if k in a or k in b:
            out[k] = a[k] if k in a else b[k]
    for k in ("readOnly", "writeOnly"):
        if a.get(k) and b.get(k):
            out[k] = True
    if a.get("deprecated") or b.get("deprecated"):
        out["deprecated"] = True
    for k in [*a, *b]:
        if k.startswith("x-") and k != MIXED and k not in out:
            out[k] = a[k] if k in a else b[k]
    values = [s["enum"] if "enum" in s else [s["const"]] if "const" in s else None for s in (a, b)]
    if None not in values:
        if "const" in a and "const" in b and equal(a["const"], b["const"]):
            out["const"] = a["const"]
        elif len(values[0]) == len(values[1]) and all(map(equal, *values)):
            out["enum"] = values[0]
        else:
            every = {canonical_json(x): x for v in values for x in v}
            out["enum"] = [every[k] for k in sorted(every)]


def _merge_shared(a: dict, b: dict, out: dict) -> None:
    """Keywords that are kept only where both sides have them: looser bounds, common names, what is equal."""
    for keys, pick in ((LOWER, min), (UPPER, max)):
        for k in keys:
            if k in a and k in b:
                out[k] = pick(a[k], b[k])
    if a.get("uniqueItems") and b.get("uniqueItems"):
        out["uniqueItems"] = True
    if "required" in a and "required" in b and (common := sorted(set(a["required"]) & set(b["required"]))):
        out["required"] = common
    for k in EQUAL:
        if k in a and k in b and equal(_jsonable(a[k]), _jsonable(b[k])):
            out[k] = a[k]
    if "$ref" in a and a.get("$ref") == b.get("$ref") and all(equal(_jsonable(a.get(k, {})), _jsonable(b.get(k, {}))) for k in ("definitions", "$defs")):
        out["$ref"] = a["$ref"]
    condition = [{k: s[k] for k in ("if", "then", "else") if k in s} for s in (a, b)]
    if condition[0] and equal(_jsonable(condition[0]), _jsonable(condition[1])):
        out.update(condition[0])


def merge(a: Any, b: Any) -> Any:
    """A schema that accepts what either accepts: bounds loosen, required intersects, properties and enums unite, the rest stays where equal."""
    return _strip(_merge(a, b))


def merge_all(schemas: list[Any]) -> Any:
    """merge() over any number of schemas; the order only decides titles, defaults and the order of members."""
    return _strip(reduce(_merge, schemas)) if schemas else {}


def merge_by(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """(keys, merged): merge_all() of a column of schemas as JSON text for each key, in the order given.

    Equal schemas of a key are one, from the first place they have. The rest is ordered
    by range, so each task folds a run of every key, and only a schema for each run is
    gathered by key: a key's schemas never meet in one task unless they are that few.
    Null and text that is no schema says nothing; a key without any has no row.
    """
    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    distinct = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_schema")).agg(F.min(order).alias("_at"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = distinct.repartitionByRange(n, *keys, "_at", "_schema").sortWithinPartitions(*keys, "_at", "_schema")

    def folded(schemas: list[str]) -> str | None:
        parsed = []
        for text in schemas:
            try:
                parsed.append(parse_json(text))
            except ValueError:
                continue
        parsed = [s for s in parsed if isinstance(s, (dict, bool))]
        return canonical_json(reduce(_merge, parsed)) if parsed else None

    def fold_runs(frames: Iterator[pd.DataFrame], last_fold: bool) -> Iterator[pd.DataFrame]:
        names = [*keys, "merged"] if last_fold else [*keys, "_at", "_schema"]
        last, held, at, whose, out = None, None, None, None, []

        def close() -> None:
            if held is not None:
                out.append((*whose, canonical_json(_strip(parse_json(held)))) if last_fold else (*whose, at, held))

        for pdf in frames:
            for *key, schema, place in pdf[[*keys, "_schema", "_at"]].itertuples(index=False, name=None):
                if repr(key) != last:
                    close()
                    last, held, at, whose = repr(key), None, place, key
                held = folded([*([held] if held else []), schema])
            yield pd.DataFrame(out, columns=names)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    place = distinct.schema["_at"].dataType.simpleString()
    parts = runs.mapInPandas(lambda frames: fold_runs(frames, False), f"{kept}, _at {place}, _schema string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "_at").mapInPandas(lambda frames: fold_runs(frames, True), f"{kept}, merged string")


def _strip(s: Any) -> Any:
    if isinstance(s, dict):
        return {k: _strip(v) for k, v in s.items() if k != MIXED}
    return [_strip(x) for x in s] if isinstance(s, list) else s


def _merge(a: Any, b: Any) -> Any:
    if a is True or b is True:
        return True
    if a is False:
        return b
    if b is False:
        return a
    out: dict[str, Any] = {}
    if a.get(MIXED) or b.get(MIXED):
        _merge_words(a, b, out)
        return out | {MIXED: True}
    takes_any_type = _merge_types(a, b, out)
    _merge_words(a, b, out)
    if out.get(MIXED):  # of values of types that don't mix nothing more can be said
        return out
    if not a.keys() & b.keys() <= NESTED:
        _merge_shared(a, b, out)
    # a side without a type that limits values takes any object and any array: what only the other says of them isn't grafted onto it
    loose = ["type" not in s and constrains(s) for s in (a, b)]
    if isinstance(a.get("items"), list) or isinstance(b.get("items"), list):
        if "items" in a and "items" in b and equal(_jsonable(a["items"]), _jsonable(b["items"])):
            out["items"] = a["items"]
    elif "items" in a and "items" in b:
        out["items"] = _merge(a["items"], b["items"])
    elif "items" in a or "items" in b:
        has, lacks, free = (a, b, loose[1]) if "items" in a else (b, a, loose[0])
        if not free and not type_bits(lacks.get("type", [])) & BITS["array"]:
            out["items"] = has["items"]
    p, q = a.get("properties"), b.get("properties")
    if (p is not None or q is not None) and not (q is None and loose[1]) and not (p is None and loose[0]):
        p, q = p or {}, q or {}
        out["properties"] = {k: _merge(p[k], q[k]) if k in p and k in q else clone(p.get(k, q.get(k))) for k in [*p, *(k for k in q if k not in p)]}
    more = [s.get("additionalProperties", True) for s in (a, b)]
    if "additionalProperties" in a or "additionalProperties" in b:
        if True in more:
            if not takes_any_type:  # there it would say what no word says too
                out["additionalProperties"] = True
        elif more[0] is False or more[1] is False:
            out["additionalProperties"] = more[1] if more[0] is False else more[0]
        else:
            out["additionalProperties"] = _merge(*more)
    if takes_any_type and not constrains(out):
        out[MIXED] = True
    return out


def _jsonable(x: Any) -> Any:
    return x if not isinstance(x, tuple) else list(x)


def schema_text(schema: Any, indent: int | None = 2) -> str:
    """JSON text of a schema, with a line end."""
    import json

    return json.dumps(plain(schema), indent=indent, ensure_ascii=False) + "\n"
