"""The plain evaluator: one instance against a schema, on the driver or inside an Arrow UDF.

It defines the semantics that the Column lowering must agree with, and serves what has
no finite Column: recursive references, dynamic references, runtime annotations.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from corvane.functions import formats as formats_module
from corvane.functions.numbers import canonical, equal, exact, is_finite, is_integral, is_multiple, is_number
from corvane.functions.patterns import search
from corvane.plans.model import Draft, Violation, detect_draft, escape, is_false, parse_json, parse_schema, vet
from corvane.plans.refs import Registry, Resolver


@dataclass
class Options:
    """How a schema is applied."""

    formats: bool = False
    content: bool = False
    draft: Draft | None = None
    resolver: Resolver | None = None
    base: str = ""
    custom_formats: dict[str, Callable[[str], bool]] = field(default_factory=dict)
    #: Vocabularies left out of validation: any of applicator, validation, unevaluated, content, format.
    without: frozenset[str] = frozenset()
    #: With the format-assertion vocabulary, unknown formats fail.
    assert_formats: bool = False


def type_of(x: Any) -> str:
    """The JSON type name; whole numbers are integers."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, str):
        return "string"
    if is_number(x):
        return "integer" if is_integral(x) else "number"
    return "array" if isinstance(x, list) else "object"


def has_type(x: Any, name: str) -> bool:
    kind = type_of(x)
    return kind == name or (name == "number" and kind == "integer")


def valid_content(text: str, encoding: str | None, media: str | None, line_breaks: bool) -> tuple[bool, bool]:
    """(encoding holds, media type holds) of a string; unknown names hold."""
    data = text.encode()
    if encoding is not None and encoding.lower() == "base64":
        raw = text.replace("\r", "").replace("\n", "") if line_breaks else text
        try:
            data = base64.b64decode(raw.encode("ascii"), validate=True)
        except (binascii.Error, ValueError, UnicodeEncodeError):
            return False, True
    elif encoding is not None:
        return True, True
    if media is not None and media.split(";")[0].strip().lower() == "application/json":
        try:
            parse_json(data.decode("utf-8"))
        except (ValueError, UnicodeDecodeError, RecursionError):
            return True, False
    return True, True


class Seen:
    """What a run of keywords evaluated: member names, item numbers, all items before `end`."""

    __slots__ = ("items", "end", "names", "all_items", "all_names")

    def __init__(self):
        self.names: set[str] = set()
        self.items: set[int] = set()
        self.end, self.all_items, self.all_names = 0, False, False

    def merge(self, other: Seen) -> None:
        self.names |= other.names
        self.items |= other.items
        self.end = max(self.end, other.end)
        self.all_items |= other.all_items
        self.all_names |= other.all_names


class Evaluator:
    """A compiled schema. violations() lists an instance's failures in keyword order, keys sorted."""

    def __init__(self, schema: Any, options: Options | None = None):
        self.options = options or Options()
        self.schema = parse_schema(schema)
        self.draft = self.options.draft or detect_draft(self.schema)
        self.options = self._vocabularies()
        vet(self.schema, self.draft)
        self.registry = Registry(self.schema, self.draft, self.options.resolver, self.options.base)
        self.checkers = {**formats_module.CHECKS, **self.options.custom_formats}

    def _vocabularies(self) -> Options:
        """The options, less what the document's own metaschema leaves out of its vocabularies."""
        o, uri = self.options, self.schema.get("$schema") if isinstance(self.schema, dict) else None
        if not self.draft.has_unevaluated or not isinstance(uri, str) or uri.rstrip("#") == self.draft.uri or o.resolver is None:
            return o
        meta = o.resolver(uri.rstrip("#"))
        listed = parse_schema(meta).get("$vocabulary") if meta is not None and not isinstance(meta, bool) else None
        if not isinstance(listed, dict):
            return o
        names = {u.rstrip("/").rpartition("/")[2] for u in listed}
        absent = {"applicator", "validation", "unevaluated", "content"} - names
        return replace(o, without=o.without | absent, assert_formats=o.assert_formats or "format-assertion" in names)

    def is_valid(self, instance: Any) -> bool:
        return not self.violations(instance)

    def violations(self, instance: Any) -> list[Violation]:
        return self._run(self.schema, instance, "", "", Seen(), [], set(), "")

    def validate_json(self, text: str) -> list[Violation]:
        try:
            return self.violations(parse_json(text))
        except ValueError as e:
            return [Violation("", "", "", f"not a JSON document: {e}")]

    def _run(self, schema: Any, x: Any, at: str, where: str, seen: Seen, scopes: list[str], open_: set, applied_by: str) -> list[Violation]:
        if schema is True:
            return []
        if is_false(schema):
            return [Violation(at, where, applied_by, "nothing is allowed here")]
        key = (id(schema), at)
        if key in open_:
            return []
        open_ = open_ | {key}
        base = self.registry.base_of(schema)
        if not scopes or scopes[-1] != base:
            scopes = [*scopes, base]
        draft, options, out = self.draft, self.options, []
        fail = lambda keyword, message, causes=(): out.append(Violation(at, f"{where}/{escape(keyword)}", keyword, message, list(causes)))

        def apply(sub: Any, value: Any, path: str, *segments: str | int, into: Seen | None = None) -> list[Violation]:
            into = Seen() if into is None else into
            return self._run(sub, value, path, where + "".join(f"/{escape(str(s))}" for s in segments), into, scopes, open_, str(segments[0]))

        if "$ref" in schema:
            causes = apply(self.registry.ref(schema), x, at, "$ref", into=seen)
            if causes:
                fail("$ref", "the referenced schema fails", causes)
            if draft.ref_hides_siblings:
                return out
        if "$dynamicRef" in schema and draft.has_dynamic_ref:
            target = self.registry.dynamic_ref(schema, scopes)
            causes = self._run(target, x, at, f"{where}/$dynamicRef", seen, scopes, open_, "$dynamicRef")
            if causes:
                fail("$dynamicRef", "the referenced schema fails", causes)
        asserts = "validation" not in options.without
        applies = "applicator" not in options.without
        if asserts:
            self._values(schema, x, fail)
        if isinstance(x, str):
            self._text(schema, x, fail)
        if isinstance(x, list):
            self._items(schema, x, at, seen, apply, fail, out, asserts, applies)
        if isinstance(x, dict):
            self._members(schema, x, at, seen, apply, fail, out, asserts, applies)
        if applies:
            self._compose(schema, x, at, seen, apply, fail, out)
        if draft.has_unevaluated and "unevaluated" not in options.without:
            self._unevaluated(schema, x, at, seen, apply, out)
        return out

    def _values(self, s: dict, x: Any, fail) -> None:
        if "type" in s:
            names = s["type"] if isinstance(s["type"], list) else [s["type"]]
            if not any(has_type(x, n) for n in names):
                fail("type", f"{type_of(x)} is not {' or '.join(names)}")
        if "enum" in s and not any(equal(x, e) for e in s["enum"]):
            fail("enum", "not one of the listed values")
        if "const" in s and not equal(x, s["const"]):
            fail("const", "not the one value allowed")
        if is_number(x):
            finite = is_finite(x)
            v = exact(x) if finite else x
            if "multipleOf" in s and not (finite and is_multiple(v, s["multipleOf"])):
                fail("multipleOf", f"not a multiple of {s['multipleOf']}")
            for keyword, test in (("minimum", lambda b: v >= b), ("maximum", lambda b: v <= b), ("exclusiveMinimum", lambda b: v > b), ("exclusiveMaximum", lambda b: v < b)):
                if keyword in s and not (finite and test(exact(s[keyword]))):
                    fail(keyword, f"{keyword} is {s[keyword]}")
        if isinstance(x, str):
            if "minLength" in s and len(x) < s["minLength"]:
                fail("minLength", f"shorter than {s['minLength']}")
            if "maxLength" in s and len(x) > s["maxLength"]:
                fail("maxLength", f"longer than {s['maxLength']}")
            if "pattern" in s and not search(s["pattern"], x):
                fail("pattern", f"doesn't match {s['pattern']}")

    def _text(self, s: dict, x: str, fail) -> None:
        o = self.options
        if "format" in s and (o.formats or o.assert_formats) and isinstance(s["format"], str) and "format" not in o.without:
            check = self.checkers.get(s["format"])
            if (check is None and o.assert_formats) or (check is not None and not check(x)):
                fail("format", f"not a {s['format']}")
        if o.content and "content" not in o.without and ("contentEncoding" in s or "contentMediaType" in s):
            encoded, typed = valid_content(x, s.get("contentEncoding"), s.get("contentMediaType"), self.draft.base64_line_breaks)
            if not encoded:
                fail("contentEncoding", f"not {s['contentEncoding']}")
            elif not typed:
                fail("contentMediaType", f"not {s['contentMediaType']}")

    def _items(self, s: dict, x: list, at: str, seen: Seen, apply, fail, out: list, asserts: bool, applies: bool) -> None:
        draft = self.draft
        if applies:
            is_tuple = draft.tuple_keyword in s and isinstance(s[draft.tuple_keyword], list)
            first = s[draft.tuple_keyword] if is_tuple else []
            for i, (sub, value) in enumerate(zip(first, x, strict=False)):
                out += apply(sub, value, f"{at}/{i}", draft.tuple_keyword, i)
            seen.end = max(seen.end, min(len(first), len(x)))
            rest = "additionalItems" if draft.tuple_keyword == "items" and is_tuple else "items"
            if rest in s and isinstance(s[rest], (dict, bool)):
                for i in range(len(first), len(x)):
                    out += apply(s[rest], x[i], f"{at}/{i}", rest)
                seen.all_items = True
            if "contains" in s:
                hits = [i for i, value in enumerate(x) if not apply(s["contains"], value, f"{at}/{i}", "contains")]
                seen.items.update(hits)
                bounds = draft.has_contains_bounds and asserts
                least = s.get("minContains", 1) if bounds else 1
                if len(hits) < least:
                    keyword = "minContains" if bounds and "minContains" in s else "contains"
                    fail(keyword, f"fewer than {least} matching items")
                if bounds and "maxContains" in s and len(hits) > s["maxContains"]:
                    fail("maxContains", f"more than {s['maxContains']} matching items")
        if asserts:
            if "minItems" in s and len(x) < s["minItems"]:
                fail("minItems", f"fewer than {s['minItems']} items")
            if "maxItems" in s and len(x) > s["maxItems"]:
                fail("maxItems", f"more than {s['maxItems']} items")
            if s.get("uniqueItems") is True and len(set(map(canonical, x))) < len(x):
                fail("uniqueItems", "items repeat")

    def _members(self, s: dict, x: dict, at: str, seen: Seen, apply, fail, out: list, asserts: bool, applies: bool) -> None:
        draft = self.draft
        path = lambda k: f"{at}/{escape(k)}"
        if applies:
            named = s.get("properties", {})
            for k in sorted(named):
                if k in x:
                    out += apply(named[k], x[k], path(k), "properties", k)
                    seen.names.add(k)
            matched: set[str] = set()
            for pattern in sorted(s.get("patternProperties", {})):
                for k in sorted(x):
                    if search(pattern, k):
                        matched.add(k)
                        out += apply(s["patternProperties"][pattern], x[k], path(k), "patternProperties", pattern)
            seen.names |= matched
            if "additionalProperties" in s:
                for k in sorted(x):
                    if k not in named and k not in matched:
                        out += apply(s["additionalProperties"], x[k], path(k), "additionalProperties")
                seen.all_names = True
            if "propertyNames" in s:
                for k in sorted(x):
                    out += apply(s["propertyNames"], k, path(k), "propertyNames")
        if asserts:
            for k in s.get("required", []):
                if k not in x:
                    fail("required", f"{k} is missing")
            if "minProperties" in s and len(x) < s["minProperties"]:
                fail("minProperties", f"fewer than {s['minProperties']} members")
            if "maxProperties" in s and len(x) > s["maxProperties"]:
                fail("maxProperties", f"more than {s['maxProperties']} members")
        both = []
        if draft.has_dependent and asserts:
            both += [("dependentRequired", k, v) for k, v in sorted(s.get("dependentRequired", {}).items())]
        if draft.has_dependent and applies:
            both += [("dependentSchemas", k, v) for k, v in sorted(s.get("dependentSchemas", {}).items())]
        both += [("dependencies", k, v) for k, v in sorted(s.get("dependencies", {}).items())]
        for keyword, k, need in both:
            if k not in x:
                continue
            if isinstance(need, list):
                for name in need:
                    if name not in x:
                        fail(keyword, f"{k} needs {name}")
            else:
                causes = apply(need, x, at, keyword, k, into=seen)
                if causes:
                    fail(keyword, f"{k} needs another schema", causes)

    def _compose(self, s: dict, x: Any, at: str, seen: Seen, apply, fail, out: list) -> None:
        def branches(keyword: str):
            got = []
            for i, sub in enumerate(s[keyword]):
                own = Seen()
                got.append((apply(sub, x, at, keyword, i, into=own), own))
            return got

        if "allOf" in s:
            got = branches("allOf")
            causes = [c for failed, _ in got for c in failed]
            if causes:
                fail("allOf", "not all branches hold", causes)
            else:
                for _, own in got:
                    seen.merge(own)
        for keyword in ("anyOf", "oneOf"):
            if keyword not in s:
                continue
            got = branches(keyword)
            passed = [own for failed, own in got if not failed]
            if not passed:
                fail(keyword, "no branch holds", [c for failed, _ in got for c in failed])
            elif keyword == "oneOf" and len(passed) > 1:
                fail(keyword, f"{len(passed)} branches hold")
            else:
                for own in passed:
                    seen.merge(own)
        if "not" in s and not apply(s["not"], x, at, "not"):
            fail("not", "the negated schema holds")
        if "if" in s:
            own = Seen()
            holds = not apply(s["if"], x, at, "if", into=own)
            if holds:
                seen.merge(own)
            branch = "then" if holds else "else"
            if branch in s:
                causes = apply(s[branch], x, at, branch, into=seen)
                if causes:
                    fail(branch, f"the {branch} schema fails", causes)

    def _unevaluated(self, s: dict, x: Any, at: str, seen: Seen, apply, out: list) -> None:
        if isinstance(x, list) and "unevaluatedItems" in s:
            if not seen.all_items:
                for i in range(seen.end, len(x)):
                    if i not in seen.items:
                        out += apply(s["unevaluatedItems"], x[i], f"{at}/{i}", "unevaluatedItems")
            seen.all_items = True
        if isinstance(x, dict) and "unevaluatedProperties" in s:
            if not seen.all_names:
                for k in sorted(x):
                    if k not in seen.names:
                        out += apply(s["unevaluatedProperties"], x[k], f"{at}/{escape(k)}", "unevaluatedProperties")
            seen.all_names = True


def static_result(schema: Any, value: Any, options: Options | None = None) -> bool:
    """Whether a constant meets a schema; Decimal and int literals are exact."""
    return Evaluator(schema, options).is_valid(Decimal(repr(value)) if isinstance(value, float) else value)
