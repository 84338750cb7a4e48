"""Schema documents: parsing, drafts, keyword table, traversal and vetting (driver side).

A schema is plain data: a bool, or a dict as JSON gives it, with int for integers and
Decimal for all other numbers, so no literal loses digits.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

TYPES = ("null", "boolean", "string", "integer", "number", "object", "array")


class SchemaError(ValueError):
    """A schema document that can't be used."""


class UnsupportedDialect(SchemaError):
    """$schema names a draft that isn't known."""


class UnresolvedReference(SchemaError):
    """A reference without a target."""


class ReferenceCycle(SchemaError):
    """Inlining would never end."""


def parse_json(text: str | bytes) -> Any:
    """One JSON document with exact numbers; trailing data and non-finite literals are errors, of equal keys the last counts."""

    def refuse(name: str):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, parse_float=Decimal, parse_constant=refuse)


def parse_schema(text: str | bytes | dict | bool) -> Any:
    """A schema from JSON text or from parsed data; floats become the decimal that prints them."""
    try:
        schema = parse_json(text) if isinstance(text, (str, bytes)) else exact(text)
    except ValueError as e:
        raise SchemaError(str(e)) from e
    if not isinstance(schema, (bool, dict)):
        raise SchemaError("a schema is an object or a boolean")
    return schema


def exact(value: Any) -> Any:
    """Data with floats as Decimal of their shortest form, tuples as lists."""
    if isinstance(value, dict):
        return {str(k): exact(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [exact(v) for v in value]
    return Decimal(repr(value)) if isinstance(value, float) else value


def plain(value: Any) -> Any:
    """Data that json.dumps() takes: Decimals as int or float."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() and abs(value) < 10**300 else float(value)
    return value


@dataclass(frozen=True)
class Draft:
    """How a draft differs where it matters."""

    name: str
    uri: str
    ref_hides_siblings: bool
    tuple_keyword: str
    definitions: str
    has_dependent: bool
    has_unevaluated: bool
    has_contains_bounds: bool
    has_dynamic_ref: bool
    base64_line_breaks: bool


DRAFT7 = Draft("draft7", "http://json-schema.org/draft-07/schema", True, "items", "definitions", False, False, False, False, True)
DRAFT2020 = Draft("2020-12", "https://json-schema.org/draft/2020-12/schema", False, "prefixItems", "$defs", True, True, True, True, False)


def detect_draft(schema: Any, default: Draft = DRAFT2020) -> Draft:
    """The draft that $schema names; other dialects are errors unless they look like a custom metaschema of 2020-12."""
    uri = schema.get("$schema") if isinstance(schema, dict) else None
    if not isinstance(uri, str):
        return default
    for draft in (DRAFT7, DRAFT2020):
        if uri.rstrip("#") == draft.uri:
            return draft
    if "json-schema.org" in uri:
        raise UnsupportedDialect(uri)
    return default


#: keyword: (what it holds, group). What: a schema, a list or a map of schemas, either, or a value.
KEYWORDS: dict[str, tuple[str, str]] = {
    "type": ("value", "any"), "enum": ("value", "any"), "const": ("value", "any"),
    "multipleOf": ("value", "number"), "minimum": ("value", "number"), "maximum": ("value", "number"), "exclusiveMinimum": ("value", "number"), "exclusiveMaximum": ("value", "number"),
    "minLength": ("value", "string"), "maxLength": ("value", "string"), "pattern": ("value", "string"), "format": ("value", "string"),
    "contentEncoding": ("value", "string"), "contentMediaType": ("value", "string"), "contentSchema": ("schema", "annotation"),
    "prefixItems": ("list", "array"), "items": ("schema or list", "array"), "additionalItems": ("schema", "array"), "contains": ("schema", "array"), "minContains": ("value", "array"), "maxContains": ("value", "array"),
    "minItems": ("value", "array"), "maxItems": ("value", "array"), "uniqueItems": ("value", "array"),
    "properties": ("map", "object"), "patternProperties": ("map", "object"), "additionalProperties": ("schema", "object"), "propertyNames": ("schema", "object"),
    "required": ("value", "object"), "minProperties": ("value", "object"), "maxProperties": ("value", "object"),
    "dependentRequired": ("value", "object"), "dependentSchemas": ("map", "object"), "dependencies": ("map or lists", "object"),
    "allOf": ("list", "any"), "anyOf": ("list", "any"), "oneOf": ("list", "any"), "not": ("schema", "any"), "if": ("schema", "any"), "then": ("schema", "any"), "else": ("schema", "any"),
    "$ref": ("value", "any"), "$dynamicRef": ("value", "any"), "unevaluatedItems": ("schema", "array"), "unevaluatedProperties": ("schema", "object"),
    "definitions": ("map", "definitions"), "$defs": ("map", "definitions"),
    **{k: ("value", "annotation") for k in ("title", "description", "default", "examples", "readOnly", "writeOnly", "deprecated", "$comment")},
    **{k: ("value", "identifier") for k in ("$schema", "$id", "$anchor", "$dynamicAnchor", "$vocabulary")},
}


def assertion_keywords() -> list[str]:
    """The keywords that can make an instance invalid, in the order in which they are checked."""
    return [k for k, (_, group) in KEYWORDS.items() if group not in ("annotation", "identifier", "definitions") and k not in ("then", "else")]


def is_true(schema: Any) -> bool:
    return schema is True or schema == {}


def is_false(schema: Any) -> bool:
    return schema is False or (isinstance(schema, dict) and list(schema) == ["not"] and is_true(schema["not"]))


def escape(segment: str) -> str:
    """A key as a JSON Pointer segment."""
    return segment.replace("~", "~0").replace("/", "~1")


def unescape(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


def pointer(*segments: str | int) -> str:
    return "".join("/" + escape(str(s)) for s in segments)


def children(schema: Any) -> Iterator[tuple[tuple[str | int, ...], Any]]:
    """The direct subschemas with their segments: keywords in table order, keys of maps sorted."""
    if not isinstance(schema, dict):
        return
    for keyword, (holds, _) in KEYWORDS.items():
        value = schema.get(keyword)
        if keyword not in schema or holds == "value":
            continue
        if isinstance(value, list) and "list" in holds and holds != "map or lists":
            yield from (((keyword, i), v) for i, v in enumerate(value))
        elif isinstance(value, dict) and holds.startswith("map"):
            yield from (((keyword, k), value[k]) for k in sorted(value) if holds == "map" or isinstance(value[k], (dict, bool)))
        elif isinstance(value, (dict, bool)) and holds.startswith("schema"):
            yield (keyword,), value


PRUNE = object()


def walk(schema: Any, visit: Callable[[str, Any], Any]) -> None:
    """Visit every subschema before its children; a visit that returns PRUNE skips them; shared nodes are visited once."""
    seen: set[int] = set()

    def step(at: str, node: Any) -> None:
        if isinstance(node, dict):
            if id(node) in seen:
                return
            seen.add(id(node))
        if visit(at, node) is not PRUNE:
            for segments, child in children(node):
                step(at + pointer(*segments), child)

    step("", schema)


def nodes(schema: Any) -> list[tuple[str, Any]]:
    """All subschemas with their pointers, parents first."""
    found: list[tuple[str, Any]] = []
    walk(schema, lambda at, node: found.append((at, node)))
    return found


def clone(schema: Any) -> Any:
    """A deep copy; data that contains itself is an error."""
    try:
        json.dumps(schema, default=str)
    except (ValueError, RecursionError) as e:
        raise SchemaError("the schema contains itself") from e
    return copy.deepcopy(schema)


_COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")
_NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, Decimal, float)) and not isinstance(x, bool)


def vet(schema: Any, draft: Draft) -> None:
    """Raise SchemaError for keyword values that no instance could be checked against."""

    def check(at: str, node: Any) -> None:
        if isinstance(node, bool):
            return
        fail = lambda what: (_ for _ in ()).throw(SchemaError(f"{at or '/'}: {what}"))
        if not isinstance(node, dict):
            fail("a schema is an object or a boolean")
        kind = node.get("type")
        if "type" in node:
            names = kind if isinstance(kind, list) else [kind]
            if not names or any(n not in TYPES for n in names):
                fail(f"unknown type {kind!r}")
        if draft is DRAFT2020 and isinstance(node.get("items"), list):
            fail("items is a list; this draft has prefixItems")
        for k in _COUNTS:
            if k in node and not (_is_number(node[k]) and node[k] >= 0 and node[k] == int(node[k])):
                fail(f"{k} is not a count")
        for k in _NUMBERS:
            if k in node and not _is_number(node[k]):
                fail(f"{k} is not a number")
        if "multipleOf" in node and node["multipleOf"] <= 0:
            fail("multipleOf is not above zero")
        for k in ("required",):
            if k in node and not (isinstance(node[k], list) and all(isinstance(n, str) for n in node[k])):
                fail(f"{k} is not a list of names")
        for k, (holds, _) in KEYWORDS.items():
            if k in node and holds == "list" and not isinstance(node[k], list):
                fail(f"{k} is not a list")
            if k in node and holds == "map" and not isinstance(node[k], dict):
                fail(f"{k} is not an object")

    walk(schema, check)


@dataclass
class Violation:
    """One failure: where in the instance, which keyword of the schema, what, and the failures behind it."""

    instance_path: str
    schema_path: str
    keyword: str
    message: str
    causes: list[Violation] = field(default_factory=list)

    #: Keywords whose failure is about a member's presence, name, number or membership (fixed list).
    ABOUT_KEYS = ("required", "dependentRequired", "dependencies", "dependentSchemas", "propertyNames", "minProperties", "maxProperties", "additionalProperties", "unevaluatedProperties", "minItems", "maxItems", "minContains", "maxContains")

    def targets_key(self) -> bool:
        return self.keyword in self.ABOUT_KEYS

    def leaves(self) -> list[Violation]:
        """The deepest failures, in order."""
        return [self] if not self.causes else [x for c in self.causes for x in c.leaves()]

    def flat(self, depth: int = 0) -> Iterator[tuple[int, Violation]]:
        yield depth, self
        for c in self.causes:
            yield from c.flat(depth + 1)

    def text(self) -> str:
        """The tree as indented lines."""
        return "\n".join(f"{'  ' * d}{v.instance_path or '/'}: {v.message} ({v.keyword or 'false'} at {v.schema_path or '/'})" for d, v in self.flat())
