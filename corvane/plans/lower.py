"""Lowering: a schema and the type of a value become one Column that is true, false and never null.

Typed columns fold statically (a keyword for another type lowers to nothing), VARIANT
columns test their type at run time. A null is JSON null or an absent member, as the
options say; what a schema says about JSON null is decided here, not at run time.
References are followed while lowering. Recursion ends with the type of typed data; on
VARIANT, and where a format needs Python inside an array, the plain evaluator runs in
an Arrow UDF over the JSON text of that value alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import formats as formats_module
from corvane.functions.numbers import canonical_json, exact, is_integral, is_multiple_column, is_number, variant_text
from corvane.functions.patterns import search, search_column
from corvane.plans.evaluator import Evaluator, Options, Seen, has_type
from corvane.plans.model import Violation, escape, is_false, is_true, plain

Predicate = bool | Column
VIOLATION = "struct<instance_path:string,schema_path:string,keyword:string,message:string,depth:int>"
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Formats whose Column runs Python.
PYTHON_FORMATS = frozenset({"email", "idn-email", "idn-hostname", "hostname", "regex"})


class NeedsEvaluator(Exception):
    """This part has no Column inside a lambda."""


def both(*parts: Predicate) -> Predicate:
    if any(p is False for p in parts):
        return False
    columns = [p for p in parts if p is not True]
    return reduce(lambda a, b: a & b, columns) if columns else True


def either(*parts: Predicate) -> Predicate:
    if any(p is True for p in parts):
        return True
    columns = [p for p in parts if p is not False]
    return reduce(lambda a, b: a | b, columns) if columns else False


def negate(p: Predicate) -> Predicate:
    return not p if isinstance(p, bool) else ~p


def as_column(p: Predicate) -> Column:
    return F.lit(p) if isinstance(p, bool) else p


@dataclass(frozen=True)
class Value:
    """A bound value: its Column, its type, and whether it can be JSON null."""

    col: Column
    dtype: T.DataType
    nullable: bool

    @property
    def dynamic(self) -> bool:
        return isinstance(self.dtype, T.VariantType)

    @property
    def kind(self) -> str:
        t = self.dtype
        if isinstance(t, (T.StringType, T.CharType, T.VarcharType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
            return "string"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, (T.StructType, T.MapType)):
            return "object"
        return "variant" if self.dynamic else "null"

    def is_kind(self, kind: str) -> Predicate:
        if not self.dynamic:
            return self.kind == kind
        shape = {"string": "STRING", "boolean": "BOOLEAN", "number": "(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}[kind]
        return F.schema_of_variant(self.col).rlike(rf"\A{shape}\z")

    def text(self) -> Column:
        """The string that a string value is in JSON."""
        if self.dynamic:
            return F.try_variant_get(self.col, "$", "string")
        if isinstance(self.dtype, T.BinaryType):
            return F.base64(self.col)
        if isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType)):
            zone = "XXX" if isinstance(self.dtype, T.TimestampType) else "'Z'"
            return F.date_format(self.col, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}")
        return self.col.cast("string") if isinstance(self.dtype, T.DateType) else self.col

    def number(self) -> Column:
        """The number as double, for comparison with double bounds."""
        if self.dynamic:
            return F.try_variant_get(self.col, "$", "double")
        return self.col.cast("string").cast("double") if isinstance(self.dtype, T.FloatType) else self.col

    def decimal(self) -> Column:
        """The number as decimal(38, 18) of its shortest text; null beyond."""
        if self.dynamic:
            return F.coalesce(F.try_variant_get(self.col, "$", "decimal(38,18)"), F.try_variant_get(self.col, "$", "double").cast("string").try_cast("decimal(38,18)"))
        return self.col.cast("string").try_cast("decimal(38,18)") if isinstance(self.dtype, (T.DoubleType, T.FloatType)) else self.col.try_cast("decimal(38,18)")

    def finite(self) -> Predicate:
        if isinstance(self.dtype, (T.DoubleType, T.FloatType)):
            return ~F.isnan(self.col) & (F.abs(self.col) < float("inf"))
        return True

    def element_type(self) -> tuple[T.DataType, bool]:
        return (T.VariantType(), False) if self.dynamic else (self.dtype.elementType, self.dtype.containsNull)

    def array(self) -> Column:
        return F.try_variant_get(self.col, "$", "array<variant>") if self.dynamic else self.col

    def map(self) -> tuple[Column, T.DataType, bool]:
        if self.dynamic:
            return F.try_variant_get(self.col, "$", "map<string,variant>"), T.VariantType(), False
        return self.col, self.dtype.valueType, self.dtype.valueContainsNull

    def json(self) -> Column:
        """JSON text of the value."""
        if self.dynamic or isinstance(self.dtype, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_json(self.col)
        if self.kind == "string":
            return F.to_json(F.array(self.text())).substr(F.lit(2), F.length(F.to_json(F.array(self.text()))) - 2)
        return self.col.cast("string")


def literal(x: Any) -> Column:
    if isinstance(x, Decimal):
        return F.lit(int(x)) if is_integral(x) and abs(x) < 2**63 else F.lit(float(x))
    return F.lit(x) if not isinstance(x, int) or abs(x) < 2**63 else F.lit(float(x))


class Lowering:
    """Lowers one schema document under given options."""

    def __init__(self, schema: Any, options: Options | None = None, null_as: str = "absent"):
        if null_as not in ("absent", "null"):
            raise ValueError("null_as is 'absent' or 'null'")
        self.evaluator = Evaluator(schema, options)
        self.schema, self.options, self.draft = self.evaluator.schema, self.evaluator.options, self.evaluator.draft
        self.registry, self.null_as = self.evaluator.registry, null_as
        self.lambdas = 0

    # -- binding -------------------------------------------------------------

    def member(self, v: Value, name: str) -> tuple[Predicate, Value | None]:
        """(is the member present, its value)."""
        if v.dynamic:
            quoted = name.replace("\\", "\\\\").replace("'", "\\'")
            simple = name.replace("_", "").replace("-", "").isalnum() and name.isascii()
            col = F.try_variant_get(v.col, f"$['{quoted}']" if not simple else f"$['{name}']", "variant") if simple else F.try_element_at(v.map()[0], F.lit(name))
            return col.isNotNull(), Value(col, T.VariantType(), False)
        if isinstance(v.dtype, T.MapType):
            m, value_type, nullable = v.map()
            return F.map_contains_key(m, name), Value(F.try_element_at(m, F.lit(name)), value_type, nullable)
        if name not in v.dtype.names:
            return False, None
        field = v.dtype[name]
        col = v.col.getField(name) if v.col is not None else F.col(f"`{name}`")
        if not field.nullable:
            return True, Value(col, field.dataType, False)
        if self.null_as == "null":
            return True, Value(col, field.dataType, True)
        return col.isNotNull(), Value(col, field.dataType, False)

    def names(self, v: Value) -> list[str] | None:
        """The possible member names of a struct; None if they aren't static."""
        return sorted(v.dtype.names) if isinstance(v.dtype, T.StructType) else None

    # -- predicates ----------------------------------------------------------

    def pred(self, s: Any, v: Value, scopes: tuple[str, ...] = (), open_: tuple = ()) -> Predicate:
        """Whether the value meets schema s."""
        if is_true(s):
            return True
        if is_false(s):
            return False
        if v.nullable:
            null = not self.evaluator._run(s, None, "", "", Seen(), list(scopes), set(), "")
            rest = self.pred(s, replace(v, nullable=False), scopes, open_)
            return both(v.col.isNotNull(), rest) if not null else either(v.col.isNull(), rest)
        key = (id(s), id(v))
        if key in open_:
            return True
        if v.dynamic and sum(k[0] == id(s) for k in open_) >= 1:
            return self.evaluated(s, v)
        open_ = (*open_, key)
        base = self.registry.base_of(s)
        scopes = scopes if scopes and scopes[-1] == base else (*scopes, base)
        try:
            return both(*(p for _, p in self.checks(s, v, scopes, open_)))
        except NeedsEvaluator:
            if self.lambdas:
                raise
            return self.evaluated(s, v)

    def evaluated(self, s: Any, v: Value) -> Column:
        """The plain evaluator over the value's JSON text."""
        if self.lambdas:
            raise NeedsEvaluator
        run = self._remote(s)

        @F.pandas_udf("boolean")
        def check(text: pd.Series) -> pd.Series:
            return text.map(lambda t: t is None or not run(t)).astype(bool)

        return check(v.json())

    def _remote(self, s: Any) -> Callable[[str], list[Violation]]:
        documents = {uri: json.dumps(plain(d)) for uri, d in self.registry.resources.items()}
        options = replace(self.options, resolver=None, draft=self.draft)
        where = next(at for at, node in self._places() if node is s)
        root = json.dumps(plain(self.schema))
        made: list = []

        def run(text: str) -> list[Violation]:
            from corvane.plans.model import parse_json
            from corvane.plans.refs import schema_map

            if not made:
                e = Evaluator(root, replace(options, resolver=schema_map(documents)))
                made.extend([e, e.registry.target(where)])
            e, node = made
            return e._run(node, parse_json(text), "", "", Seen(), [], set(), "")

        return run

    def _places(self):
        from corvane.plans.model import nodes

        for uri, document in self.registry.resources.items():
            for at, node in nodes(document):
                yield f"{uri}#{at}", node

    def checks(self, s: dict, v: Value, scopes: tuple, open_: tuple):
        """(keyword, predicate) of every keyword of s, in the order in which failures are listed."""
        draft, o = self.draft, self.options
        sub = lambda x, value=v: self.pred(x, value, scopes, open_)
        if "$ref" in s:
            yield "$ref", sub(self.registry.ref(s))
            if draft.ref_hides_siblings:
                return
        if "$dynamicRef" in s and draft.has_dynamic_ref:
            yield "$dynamicRef", sub(self.registry.dynamic_ref(s, list(scopes)))
        asserts, applies = "validation" not in o.without, "applicator" not in o.without
        if asserts:
            yield from self.value_checks(s, v)
        for kind, make in (("string", self.text_checks), ("array", self.array_checks), ("object", self.object_checks)):
            applies_to = v.is_kind(kind)
            if applies_to is not False:
                for keyword, p in make(s, v, asserts, applies, scopes, open_):
                    yield keyword, p if applies_to is True else either(negate(applies_to), p if isinstance(p, bool) else F.coalesce(p, F.lit(False)))
        if applies:
            if "allOf" in s:
                yield "allOf", both(*(sub(b) for b in s["allOf"]))
            if "anyOf" in s:
                yield "anyOf", either(*(sub(b) for b in s["anyOf"]))
            if "oneOf" in s:
                yield "oneOf", self._one(*(sub(b) for b in s["oneOf"]))
            if "not" in s:
                yield "not", negate(sub(s["not"]))
            if "if" in s:
                holds = sub(s["if"])
                yield "then", either(negate(holds), sub(s.get("then", True)))
                yield "else", either(holds, sub(s.get("else", True)))
        if draft.has_unevaluated and "unevaluated" not in o.without:
            yield from self.unevaluated_checks(s, v, scopes, open_)

    @staticmethod
    def _one(*parts: Predicate) -> Predicate:
        sure = sum(p is True for p in parts)
        columns = [p for p in parts if not isinstance(p, bool)]
        if sure > 1 or not columns:
            return sure == 1
        return reduce(lambda a, b: a + b, (c.cast("int") for c in columns)) == 1 - sure

    def value_checks(self, s: dict, v: Value):
        if "type" in s:
            names = s["type"] if isinstance(s["type"], list) else [s["type"]]
            yield "type", either(*(self.has_type(v, n) for n in names))
        if "enum" in s:
            yield "enum", self.is_one_of(v, s["enum"])
        if "const" in s:
            yield "const", self.is_one_of(v, [s["const"]])
        numeric = v.is_kind("number")
        if numeric is False:
            return
        guard = lambda p: p if numeric is True else either(negate(numeric), F.coalesce(as_column(p), F.lit(False)))
        if "multipleOf" in s:
            yield "multipleOf", guard(both(v.finite(), self.is_multiple(v, s["multipleOf"])))
        for keyword, test in (("minimum", lambda x, b: x >= b), ("maximum", lambda x, b: x <= b), ("exclusiveMinimum", lambda x, b: x > b), ("exclusiveMaximum", lambda x, b: x < b)):
            if keyword in s:
                bound = s[keyword]
                if isinstance(v.dtype, T.DecimalType):
                    x, b = v.col, F.lit(Decimal(exact(bound)))
                else:
                    x, b = v.number(), literal(bound)
                yield keyword, guard(both(test(x, b), v.finite()))

    def is_multiple(self, v: Value, step: Any) -> Predicate:
        if isinstance(v.dtype, INTEGERS) and is_integral(step) and abs(step) < 2**63:
            return v.col % F.lit(int(step)) == 0
        if isinstance(v.dtype, INTEGERS) and Decimal(exact(step)).as_tuple().exponent < 0:
            return is_multiple_column(v.col.cast("string"), step)
        exact_step = Decimal(exact(step))
        if len(exact_step.normalize().as_tuple().digits) > 18:
            return v.number() / F.lit(float(step)) == F.floor(v.number() / F.lit(float(step)))
        text = F.to_json(v.col) if v.dynamic else v.col.cast("string")
        plain = is_multiple_column(text, step)
        if -exact_step.as_tuple().exponent > 18 or abs(exact_step) >= 10**18:
            return plain
        x = v.decimal()  # where it is the number itself, its remainder tells
        return F.when(F.coalesce(x.cast("double") == v.number().cast("double"), F.lit(False)) & (F.abs(x) < 10**15), x % F.lit(exact_step).cast("decimal(38,18)") == 0).otherwise(plain)

    def has_type(self, v: Value, name: str) -> Predicate:
        if name == "number":
            return v.is_kind("number")
        if name != "integer":
            return v.is_kind(name)
        if isinstance(v.dtype, INTEGERS) or (isinstance(v.dtype, T.DecimalType) and v.dtype.scale == 0):
            return True
        numeric = v.is_kind("number")
        if numeric is False:
            return False
        x = v.number()
        whole = F.coalesce(x == F.floor(x), F.lit(False)) if not isinstance(v.dtype, (T.DoubleType, T.FloatType)) else ~F.isnan(v.col) & (F.abs(v.col) < float("inf")) & (x == F.rint(x))
        return both(numeric, whole)

    @staticmethod
    def constant(member: Any) -> Column:
        """A member as the engine itself writes its canonical JSON."""
        return variant_text(F.parse_json(F.lit(canonical_json(member))))

    def is_one_of(self, v: Value, members: list) -> Predicate:
        if v.kind == "string":
            strings = [m for m in members if isinstance(m, str)]
            return v.text().isin(strings) if strings else False
        if v.kind == "boolean":
            return either(*(v.col if m else ~v.col for m in members if isinstance(m, bool)))
        if v.kind == "number":
            numbers = [m for m in members if is_number(m)]
            if isinstance(v.dtype, INTEGERS):
                numbers = [m for m in numbers if is_integral(m)]
            return both(v.finite(), either(*(v.number() == literal(m) for m in numbers)))
        if not v.dynamic:
            if isinstance(v.dtype, T.NullType):
                return any(m is None for m in members)
            members = [m for m in members if isinstance(m, list if v.kind == "array" else dict)]
            if not members:
                return False
            return variant_text(F.try_parse_json(v.json())).isin([self.constant(m) for m in members])
        strings, numbers, rest = [m for m in members if isinstance(m, str)], [m for m in members if is_number(m)], [m for m in members if not isinstance(m, str) and not is_number(m)]
        number = v.number()
        return either(
            both(v.is_kind("string"), F.coalesce(v.text().isin(strings), F.lit(False))) if strings else False,
            *(both(v.is_kind("number"), F.coalesce(number == literal(m), F.lit(False))) for m in numbers),
            both(negate(either(v.is_kind("string"), v.is_kind("number"))), F.coalesce(variant_text(v.col).isin([self.constant(m) for m in rest]), F.lit(False))) if rest else False,
        )

    def text_checks(self, s: dict, v: Value, asserts: bool, applies: bool, scopes: tuple, open_: tuple):
        o, text = self.options, v.text()
        if asserts:
            if "minLength" in s:
                yield "minLength", F.char_length(text) >= int(s["minLength"])
            if "maxLength" in s:
                yield "maxLength", F.char_length(text) <= int(s["maxLength"])
            if "pattern" in s:
                yield "pattern", search_column(s["pattern"], text)
        name = s.get("format")
        if isinstance(name, str) and (o.formats or o.assert_formats) and "format" not in o.without:
            if name in o.custom_formats:
                custom = o.custom_formats[name]
                if isinstance(got := getattr(custom, "column", None), Callable):
                    yield "format", got(text)
                elif self.lambdas:
                    raise NeedsEvaluator
                else:
                    yield "format", formats_module._udf(custom)(text)
            elif name in formats_module.COLUMNS:
                if self.lambdas and name in PYTHON_FORMATS:
                    raise NeedsEvaluator
                yield "format", formats_module.format_column(name, text)
            elif o.assert_formats:
                yield "format", False
        if o.content and "content" not in o.without:
            encoding, media = s.get("contentEncoding"), s.get("contentMediaType")
            is_base64 = isinstance(encoding, str) and encoding.lower() == "base64"
            data: Column = text.cast("binary")
            if is_base64:
                raw = F.regexp_replace(text, r"[\r\n]", "") if self.draft.base64_line_breaks else text
                good = raw.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
                yield "contentEncoding", good
                data = F.when(good, F.try_to_binary(raw, F.lit("base64")))
            if isinstance(media, str) and media.split(";")[0].strip().lower() == "application/json" and (is_base64 or encoding is None):
                parsed = F.try_parse_json(data.cast("string")).isNotNull()
                yield "contentMediaType", either(negate(good), parsed) if is_base64 else parsed

    # -- arrays --------------------------------------------------------------

    def _inside(self, make: Callable):
        """Build a lambda's body: Python can't run in it."""

        def guarded(*args):
            self.lambdas += 1
            try:
                return make(*args)
            finally:
                self.lambdas -= 1

        return (lambda x: guarded(x)) if make.__code__.co_argcount == 1 else (lambda x, i: guarded(x, i))

    def tuple_part(self, s: dict) -> tuple[list, str]:
        """(schemas of the first items, keyword of the rest)."""
        key = self.draft.tuple_keyword
        is_tuple = isinstance(s.get(key), list)
        return (s[key] if is_tuple else []), ("additionalItems" if key == "items" and is_tuple else "items")

    def element(self, v: Value, x: Column) -> Value:
        kind, nullable = v.element_type()
        return Value(x, kind, nullable)

    def array_checks(self, s: dict, v: Value, asserts: bool, applies: bool, scopes: tuple, open_: tuple):
        array = v.array()
        sub = lambda x, value: self.pred(x, value, scopes, open_)
        if applies:
            first, rest = self.tuple_part(s)
            for i, each in enumerate(first):
                p = sub(each, self.element(v, F.try_element_at(array, F.lit(i + 1))))
                if p is not True:
                    yield self.draft.tuple_keyword, either(F.size(array) <= i, p)
            if isinstance(s.get(rest), (dict, bool)):
                if is_false(s[rest]):
                    yield rest, F.size(array) <= len(first)
                elif not is_true(s[rest]):
                    after = F.slice(array, len(first) + 1, F.greatest(F.size(array) - len(first), F.lit(0))) if first else array
                    yield rest, F.forall(after, self._inside(lambda x: as_column(sub(s[rest], self.element(v, x)))))
            if "contains" in s:
                hits = F.size(F.filter(array, self._inside(lambda x: as_column(sub(s["contains"], self.element(v, x))))))
                bounds = self.draft.has_contains_bounds and asserts
                least = int(s.get("minContains", 1)) if bounds else 1
                if least:
                    yield "minContains" if bounds and "minContains" in s else "contains", hits >= least
                if bounds and "maxContains" in s:
                    yield "maxContains", hits <= int(s["maxContains"])
        if asserts:
            if "minItems" in s:
                yield "minItems", F.size(array) >= int(s["minItems"])
            if "maxItems" in s:
                yield "maxItems", F.size(array) <= int(s["maxItems"])
            if s.get("uniqueItems") is True:
                kind, _ = v.element_type()
                if isinstance(kind, (T.VariantType, T.StructType, T.MapType, T.ArrayType)):
                    text = F.transform(array, lambda x: F.coalesce(variant_text(x if v.dynamic else F.try_parse_json(F.to_json(x))), F.lit("null")))
                else:
                    text = array
                yield "uniqueItems", F.size(F.array_distinct(text)) == F.size(array)

    # -- objects -------------------------------------------------------------

    def count(self, v: Value) -> Column:
        if isinstance(v.dtype, T.StructType):
            present = [self.member(v, n)[0] for n in v.dtype.names]
            fixed = sum(p is True for p in present)
            return reduce(lambda a, b: a + b, (p.cast("int") for p in present if not isinstance(p, bool)), F.lit(fixed))
        return F.size(F.map_keys(v.map()[0]))

    def object_checks(self, s: dict, v: Value, asserts: bool, applies: bool, scopes: tuple, open_: tuple):
        sub = lambda x, value: self.pred(x, value, scopes, open_)
        static = self.names(v)
        if applies:
            named, patterns = s.get("properties", {}), s.get("patternProperties", {})
            for name in sorted(named):
                present, value = self.member(v, name)
                if present is not False:
                    yield "properties", either(negate(present), sub(named[name], value))
            if static is not None:
                for pattern in sorted(patterns):
                    for name in static:
                        if search(pattern, name):
                            present, value = self.member(v, name)
                            yield "patternProperties", either(negate(present), sub(patterns[pattern], value))
                for name in static:
                    present, value = self.member(v, name)
                    if "additionalProperties" in s and name not in named and not any(search(p, name) for p in patterns):
                        yield "additionalProperties", either(negate(present), sub(s["additionalProperties"], value))
                for name in static if "propertyNames" in s else []:
                    if self.evaluator._run(s["propertyNames"], name, "", "", Seen(), list(scopes), set(), ""):
                        yield "propertyNames", negate(self.member(v, name)[0])
            else:
                m, kind, nullable = v.map()
                every = lambda test: F.forall(F.map_entries(m), self._inside(lambda e: as_column(test(e["key"], Value(e["value"], kind, nullable)))))
                for pattern in sorted(patterns):
                    yield "patternProperties", every(lambda k, x, p=pattern: either(negate(search_column(p, k)), sub(patterns[p], x)))
                if "additionalProperties" in s and not is_true(s["additionalProperties"]):
                    yield "additionalProperties", every(lambda k, x: either(self.is_named(s, k), sub(s["additionalProperties"], x)))
                if "propertyNames" in s:
                    yield "propertyNames", every(lambda k, x: sub(s["propertyNames"], Value(k, T.StringType(), False)))
        if asserts:
            for name in s.get("required", []):
                yield "required", self.member(v, name)[0]
            if "minProperties" in s:
                yield "minProperties", self.count(v) >= int(s["minProperties"])
            if "maxProperties" in s:
                yield "maxProperties", self.count(v) <= int(s["maxProperties"])
        for keyword, trigger, need in self.dependents(s, asserts, applies):
            present = self.member(v, trigger)[0]
            if isinstance(need, list):
                for name in need:
                    yield keyword, either(negate(present), self.member(v, name)[0])
            else:
                yield keyword, either(negate(present), sub(need, v))

    def is_named(self, s: dict, key: Column) -> Predicate:
        """Whether properties or patternProperties of s take a member."""
        named = sorted(s.get("properties", {}))
        return either(key.isin(named) if named else False, *(search_column(p, key) for p in sorted(s.get("patternProperties", {}))))

    def dependents(self, s: dict, asserts: bool, applies: bool):
        if self.draft.has_dependent and asserts:
            yield from (("dependentRequired", k, n) for k, n in sorted(s.get("dependentRequired", {}).items()))
        if self.draft.has_dependent and applies:
            yield from (("dependentSchemas", k, n) for k, n in sorted(s.get("dependentSchemas", {}).items()))
        yield from (("dependencies", k, n) for k, n in sorted(s.get("dependencies", {}).items()))

    # -- unevaluated ---------------------------------------------------------

    def unevaluated_checks(self, s: dict, v: Value, scopes: tuple, open_: tuple):
        if "unevaluatedItems" in s and (is_array := v.is_kind("array")) is not False:
            array = v.array()
            numbered = F.transform(array, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
            body = self._inside(lambda e: as_column(either(self.evaluates_item(s, v, e["i"], e["x"], scopes, open_, own=True), self.pred(s["unevaluatedItems"], self.element(v, e["x"]), scopes, open_))))
            p = F.forall(numbered, body)
            yield "unevaluatedItems", p if is_array is True else either(negate(is_array), F.coalesce(p, F.lit(False)))
        if "unevaluatedProperties" in s and (is_object := v.is_kind("object")) is not False:
            static = self.names(v)
            if static is not None:
                for name in static:
                    present, value = self.member(v, name)
                    yield "unevaluatedProperties", either(negate(present), self.evaluates(s, v, name, scopes, open_, own=True), self.pred(s["unevaluatedProperties"], value, scopes, open_))
            else:
                m, kind, nullable = v.map()
                body = self._inside(lambda e: as_column(either(self.evaluates(s, v, e["key"], scopes, open_, own=True), self.pred(s["unevaluatedProperties"], Value(e["value"], kind, nullable), scopes, open_))))
                p = F.forall(F.map_entries(m), body)
                yield "unevaluatedProperties", p if is_object is True else either(negate(is_object), F.coalesce(p, F.lit(False)))

    def _branches(self, s: dict, v: Value, scopes: tuple, open_: tuple):
        """(condition, subschema) of what runs on the same value beside s's own keywords."""
        holds = lambda x: self.pred(x, v, scopes, open_)
        if "$ref" in s:
            yield True, self.registry.ref(s)
        if "$dynamicRef" in s:
            yield True, self.registry.dynamic_ref(s, list(scopes))
        for branch in s.get("allOf", []):
            yield both(*(holds(b) for b in s["allOf"])), branch
        for keyword in ("anyOf", "oneOf"):
            for branch in s.get(keyword, []):
                yield holds(branch), branch
        if "if" in s:
            yield holds(s["if"]), s["if"]
            yield holds(s["if"]), s.get("then", True)
            yield negate(holds(s["if"])), s.get("else", True)
        for _, trigger, need in self.dependents(s, False, True):
            if not isinstance(need, list) and v.is_kind("object") is not False:
                yield self.member(v, trigger)[0], need

    def evaluates(self, s: Any, v: Value, key: str | Column, scopes: tuple, open_: tuple, own: bool = False) -> Predicate:
        """Whether s evaluates the member named key."""
        if not isinstance(s, dict):
            return False
        if "additionalProperties" in s or ("unevaluatedProperties" in s and not own):
            return True
        if isinstance(key, str):
            here: Predicate = key in s.get("properties", {}) or any(search(p, key) for p in s.get("patternProperties", {}))
        else:
            here = self.is_named(s, key)
        return either(here, *(both(when, self.evaluates(b, v, key, scopes, open_)) for when, b in self._branches(s, v, scopes, open_)))

    def evaluates_item(self, s: Any, v: Value, index: Column, x: Column, scopes: tuple, open_: tuple, own: bool = False) -> Predicate:
        """Whether s evaluates the item x at index."""
        if not isinstance(s, dict):
            return False
        first, rest = self.tuple_part(s)
        if rest in s or ("unevaluatedItems" in s and not own):
            return True
        parts: list[Predicate] = [index < len(first)] if first else []
        if "contains" in s:
            parts.append(self.pred(s["contains"], self.element(v, x), scopes, open_))
        return either(*parts, *(both(when, self.evaluates_item(b, v, index, x, scopes, open_)) for when, b in self._branches(s, v, scopes, open_)))

    # -- violations ----------------------------------------------------------

    def violations(self, s: Any, v: Value, at: Any = "", where: str = "", by: str = "", depth: int = 0, scopes: tuple = (), open_: tuple = ()) -> list[Column]:
        """Arrays of violation structs that end to end are the value's failures, in the evaluator's order."""
        if s is True:
            return []
        if is_false(s):
            return [self._one_row(at, where, by, "nothing is allowed here", depth)]
        if v.nullable:
            null = self.evaluator._run(s, None, "", where, Seen(), list(scopes), set(), by)
            rows = [self._one_row(at, x.schema_path, x.keyword, x.message, depth + d) for top in null for d, x in top.flat()]
            rest = self._joined(self.violations(s, replace(v, nullable=False), at, where, by, depth, scopes, open_))
            return [F.when(v.col.isNull(), self._joined(rows)).otherwise(rest)]
        key = (id(s), id(v))
        if key in open_:
            return []
        base = self.registry.base_of(s)
        inner = scopes if scopes and scopes[-1] == base else (*scopes, base)
        try:
            if v.dynamic and any(k[0] == id(s) for k in open_):
                raise NeedsEvaluator
            return self._violations(s, v, at, where, depth, inner, (*open_, key))
        except NeedsEvaluator:
            if self.lambdas:
                raise
            run = self._remote(s)

            @F.pandas_udf(f"array<{VIOLATION}>")
            def found(text: pd.Series) -> pd.Series:
                return text.map(lambda t: [(x.instance_path, x.schema_path, x.keyword, x.message, d) for top in (run(t) if t is not None else []) for d, x in top.flat()])

            prefix = at if isinstance(at, Column) else F.lit(at)
            return [F.transform(found(v.json()), lambda r: F.struct(F.concat(prefix, r["instance_path"]).alias("instance_path"), F.concat(F.lit(where), r["schema_path"]).alias("schema_path"), r["keyword"].alias("keyword"), r["message"].alias("message"), (r["depth"] + depth).alias("depth")))]

    @staticmethod
    def _one_row(at: Any, where: str, keyword: str, message: Any, depth: int) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.array(F.struct(text(at).alias("instance_path"), F.lit(where).alias("schema_path"), F.lit(keyword).alias("keyword"), text(message).alias("message"), F.lit(depth).alias("depth")))

    @staticmethod
    def _joined(arrays: list[Column]) -> Column:
        empty = F.array().cast(f"array<{VIOLATION}>")
        return F.concat(*(a.cast(f"array<{VIOLATION}>") for a in arrays)) if arrays else empty

    def _when(self, ok: Predicate, rows: list[Column]) -> list[Column]:
        """The rows where a predicate fails."""
        if ok is True:
            return []
        got = self._joined(rows)
        return [got] if ok is False else [F.when(ok, self._joined([])).otherwise(got)]

    @staticmethod
    def _path(at: Any, *segments: Any) -> Any:
        if isinstance(at, str) and all(isinstance(x, (str, int)) for x in segments):
            return at + "".join(f"/{escape(str(x))}" for x in segments)
        parts = [at if isinstance(at, Column) else F.lit(at)]
        for x in segments:
            parts += [F.lit("/"), F.replace(F.replace(x.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")) if isinstance(x, Column) else F.lit(escape(str(x)))]
        return F.concat(*parts)

    def _violations(self, s: dict, v: Value, at: Any, where: str, depth: int, scopes: tuple, open_: tuple) -> list[Column]:
        out: list[Column] = []
        o, draft = self.options, self.draft
        fail = lambda ok, keyword, message, causes=(): out.extend(self._when(ok, [self._one_row(at, f"{where}/{escape(keyword)}", keyword, message, depth), *causes]))
        inside = lambda x, value, path, *seg, d=depth: self.violations(x, value, path, where + "".join(f"/{escape(str(k))}" for k in seg), str(seg[0]), d, scopes, open_)
        same = lambda x, *seg: inside(x, v, at, *seg, d=depth + 1)
        ok = lambda x: self.pred(x, v, scopes, open_)
        for keyword, target in (("$ref", lambda: self.registry.ref(s)), ("$dynamicRef", lambda: self.registry.dynamic_ref(s, list(scopes)))):
            if keyword in s and (keyword == "$ref" or draft.has_dynamic_ref):
                fail(ok(target()), keyword, "the referenced schema fails", same(target(), keyword))
                if draft.ref_hides_siblings:
                    return out
        asserts, applies = "validation" not in o.without, "applicator" not in o.without
        said = {"minimum": "minimum is {}", "maximum": "maximum is {}", "exclusiveMinimum": "exclusiveMinimum is {}", "exclusiveMaximum": "exclusiveMaximum is {}", "multipleOf": "not a multiple of {}", "minLength": "shorter than {}", "maxLength": "longer than {}", "pattern": "doesn't match {}", "format": "not a {}", "contentEncoding": "not {}", "contentMediaType": "not {}", "enum": "not one of the listed values", "const": "not the one value allowed"}
        if asserts:
            for keyword, p in self.value_checks(s, v):
                message = f"{self.type_name(v)} is not {' or '.join(s['type'] if isinstance(s['type'], list) else [s['type']])}" if keyword == "type" and not v.dynamic and v.kind != "number" else None
                if keyword == "type" and message is None:
                    names = s["type"] if isinstance(s["type"], list) else [s["type"]]
                    message = F.concat(self.type_column(v), F.lit(f" is not {' or '.join(names)}"))
                fail(p, keyword, message if message is not None else said[keyword].format(s[keyword]))
        guard = lambda kind, p: p if v.is_kind(kind) is True else either(negate(v.is_kind(kind)), F.coalesce(as_column(p), F.lit(False)))
        if v.is_kind("string") is not False:
            for keyword, p in self.text_checks(s, v, asserts, applies, scopes, open_):
                fail(guard("string", p), keyword, said[keyword].format(s[keyword]))
        if v.is_kind("array") is not False:
            out += self._guarded(v, "array", lambda: self._array_violations(s, v, at, where, depth, asserts, applies, scopes, open_, inside))
        if v.is_kind("object") is not False:
            out += self._guarded(v, "object", lambda: self._object_violations(s, v, at, where, depth, asserts, applies, scopes, open_, inside, same, ok))
        if applies:
            if "allOf" in s:
                fail(both(*(ok(b) for b in s["allOf"])), "allOf", "not all branches hold", [c for i, b in enumerate(s["allOf"]) for c in same(b, "allOf", i)])
            for keyword in ("anyOf", "oneOf"):
                if keyword in s:
                    holds = [ok(b) for b in s[keyword]]
                    fail(either(*holds), keyword, "no branch holds", [c for i, b in enumerate(s[keyword]) for c in same(b, keyword, i)])
                    if keyword == "oneOf":
                        count = reduce(lambda a, b: a + b, (as_column(h).cast("int") for h in holds), F.lit(0))
                        fail(either(self._one(*holds), negate(either(*holds))), keyword, F.concat(count.cast("string"), F.lit(" branches hold")))
            if "not" in s:
                fail(negate(ok(s["not"])), "not", "the negated schema holds")
            if "if" in s:
                for keyword, when in (("then", ok(s["if"])), ("else", negate(ok(s["if"])))):
                    if keyword in s:
                        fail(either(negate(when), ok(s[keyword])), keyword, f"the {keyword} schema fails", same(s[keyword], keyword))
        if draft.has_unevaluated and "unevaluated" not in o.without:
            out += self._unevaluated_violations(s, v, at, where, depth, scopes, open_, inside)
        return out

    def _guarded(self, v: Value, kind: str, make: Callable[[], list[Column]]) -> list[Column]:
        rows = make()
        applies = v.is_kind(kind)
        return rows if applies is True or not rows else [F.when(applies, self._joined(rows)).otherwise(self._joined([]))]

    def type_name(self, v: Value) -> str:
        return v.kind

    def type_column(self, v: Value) -> Column:
        integer = self.has_type(v, "integer")
        number = F.when(as_column(integer), "integer").otherwise("number")
        if not v.dynamic:
            return number
        out = F.when(v.is_kind("number"), number)
        for kind in ("string", "boolean", "array", "object"):
            out = out.when(v.is_kind(kind), kind)
        return out.otherwise("null")

    def _array_violations(self, s, v, at, where, depth, asserts, applies, scopes, open_, inside) -> list[Column]:
        out: list[Column] = []
        array = v.array()
        if applies:
            first, rest = self.tuple_part(s)
            for i, each in enumerate(first):
                rows = inside(each, self.element(v, F.try_element_at(array, F.lit(i + 1))), self._path(at, i), self.draft.tuple_keyword, i)
                if rows:
                    out += self._when(F.size(array) <= i, rows)
            if isinstance(s.get(rest), (dict, bool)) and not is_true(s[rest]):
                body = self._inside(lambda x, i: F.when(i >= len(first), self._joined(inside(s[rest], self.element(v, x), self._path(at, i), rest))).otherwise(self._joined([])))
                out.append(F.flatten(F.transform(array, body)))
        checks = {}
        for keyword, p in self.array_checks(s, v, asserts, applies, scopes, open_):
            checks.setdefault(keyword, p)
        least = s.get("minContains", 1)
        said = {"contains": f"fewer than {least} matching items", "minContains": f"fewer than {least} matching items", "maxContains": f"more than {s.get('maxContains')} matching items", "minItems": f"fewer than {s.get('minItems')} items", "maxItems": f"more than {s.get('maxItems')} items", "uniqueItems": "items repeat"}
        for keyword, message in said.items():
            if keyword in checks:
                out += self._when(checks[keyword], [self._one_row(at, f"{where}/{keyword}", keyword, message, depth)])
        return out

    def _object_violations(self, s, v, at, where, depth, asserts, applies, scopes, open_, inside, same, ok) -> list[Column]:
        out: list[Column] = []
        row = lambda p, keyword, message, causes=(): out.extend(self._when(p, [self._one_row(at, f"{where}/{keyword}", keyword, message, depth), *causes]))
        static = self.names(v)

        def child(name: str, sub: Any, *seg) -> None:
            present, value = self.member(v, name)
            if present is not False:
                rows = inside(sub, value, self._path(at, name), *seg)
                if rows:
                    out.extend(self._when(negate(present), rows))

        if applies:
            named, patterns = s.get("properties", {}), s.get("patternProperties", {})
            for name in sorted(named):
                child(name, named[name], "properties", name)
            if static is not None:
                for pattern in sorted(patterns):
                    for name in static:
                        if search(pattern, name):
                            child(name, patterns[pattern], "patternProperties", pattern)
                for name in static if "additionalProperties" in s else []:
                    if name not in named and not any(search(p, name) for p in patterns):
                        child(name, s["additionalProperties"], "additionalProperties")
                for name in static if "propertyNames" in s else []:
                    found = self.evaluator._run(s["propertyNames"], name, "", f"{where}/propertyNames", Seen(), list(scopes), set(), "propertyNames")
                    rows = [self._one_row(self._path(at, name), x.schema_path, x.keyword, x.message, depth + d) for top in found for d, x in top.flat()]
                    if rows:
                        out += self._when(negate(self.member(v, name)[0]), rows)
            else:
                m, kind, nullable = v.map()
                entries = F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)) if kind != T.VariantType() else self._sorted_entries(m)

                def every(when, sub, *seg, key=False):
                    def body(e):
                        value = Value(e["key"], T.StringType(), False) if key else Value(e["value"], kind, nullable)
                        rows = self._joined(inside(sub, value, self._path(at, e["key"]), *seg))
                        take = when(e["key"])
                        return rows if take is True else F.when(as_column(take), rows).otherwise(self._joined([]))

                    out.append(F.flatten(F.transform(entries, self._inside(body))))

                for pattern in sorted(patterns):
                    every(lambda k, p=pattern: search_column(p, k), patterns[pattern], "patternProperties", pattern)
                if "additionalProperties" in s and not is_true(s["additionalProperties"]):
                    every(lambda k: negate(self.is_named(s, k)), s["additionalProperties"], "additionalProperties")
                if "propertyNames" in s:
                    every(lambda k: True, s["propertyNames"], "propertyNames", key=True)
        if asserts:
            for name in s.get("required", []):
                row(self.member(v, name)[0], "required", f"{name} is missing")
            if "minProperties" in s:
                row(self.count(v) >= int(s["minProperties"]), "minProperties", f"fewer than {s['minProperties']} members")
            if "maxProperties" in s:
                row(self.count(v) <= int(s["maxProperties"]), "maxProperties", f"more than {s['maxProperties']} members")
        for keyword, trigger, need in self.dependents(s, asserts, applies):
            present = self.member(v, trigger)[0]
            if isinstance(need, list):
                for name in need:
                    row(either(negate(present), self.member(v, name)[0]), keyword, f"{trigger} needs {name}")
            else:
                row(either(negate(present), ok(need)), keyword, f"{trigger} needs another schema", same(need, keyword, trigger))
        return out

    @staticmethod
    def _sorted_entries(m: Column) -> Column:
        """Entries by key, where values can't be compared."""
        return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.try_element_at(m, k).alias("value")))

    def _unevaluated_violations(self, s, v, at, where, depth, scopes, open_, inside) -> list[Column]:
        out: list[Column] = []
        if "unevaluatedItems" in s and v.is_kind("array") is not False:
            array = v.array()

            def item(x, i):
                rows = self._joined(inside(s["unevaluatedItems"], self.element(v, x), self._path(at, i), "unevaluatedItems"))
                return F.when(as_column(self.evaluates_item(s, v, i, x, scopes, open_, own=True)), self._joined([])).otherwise(rows)

            out += self._guarded(v, "array", lambda: [F.flatten(F.transform(array, self._inside(item)))])
        if "unevaluatedProperties" in s and v.is_kind("object") is not False:
            static = self.names(v)
            if static is not None:
                for name in static:
                    present, value = self.member(v, name)
                    done = self.evaluates(s, v, name, scopes, open_, own=True)
                    rows = inside(s["unevaluatedProperties"], value, self._path(at, name), "unevaluatedProperties")
                    if rows:
                        out += self._when(either(negate(present), done), rows)
            else:
                m, kind, nullable = v.map()

                def entry(e):
                    rows = self._joined(inside(s["unevaluatedProperties"], Value(e["value"], kind, nullable), self._path(at, e["key"]), "unevaluatedProperties"))
                    return F.when(as_column(self.evaluates(s, v, e["key"], scopes, open_, own=True)), self._joined([])).otherwise(rows)

                out += self._guarded(v, "object", lambda: [F.flatten(F.transform(self._sorted_entries(m), self._inside(entry)))])
        return out


__all__ = ["Lowering", "NeedsEvaluator", "Value", "has_type"]
