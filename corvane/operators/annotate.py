"""Schemas from YAML values and their comments: four comment dialects, and their merge by priority.

A document is parsed to nodes with line marks; each dialect turns the comments beside a
node into a fragment, earlier dialects win field by field, and what no comment says is
inferred from the value. annotate_files() does this for each file on the executors and
merges the files' schemas.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession

from corvane.functions.numbers import canonical_json
from corvane.operators.infer import literal_type, merge_all, types_of
from corvane.plans.evaluator import has_type
from corvane.plans.model import TYPES, exact, parse_json
from corvane.sources.documents import clean_text, compose, construct, resolved, split_documents


@dataclass
class Note:
    """What a dialect says about a node."""

    schema: dict = field(default_factory=dict)
    required: bool | None = None
    skip: bool = False
    skip_properties: bool = False
    merge_properties: bool = False


@dataclass
class Node:
    """A member of a mapping: its dotted path, value, the comment lines above it and the one beside it."""

    path: str
    value: Any
    above: list[str]
    beside: str


Dialect = Callable[[Node, list[str]], Note | None]


class Lines(list):
    """The lines of a document; those that say something of a member elsewhere are looked for once, by its path."""

    @cached_property
    def params(self) -> dict[str, re.Match]:
        """The first `@param` or `@skip` of a path."""
        found: dict[str, re.Match] = {}
        for line in self:
            if "##" in line and (m := _SKIP.match(line) or _PARAM.match(line)):
                found.setdefault(m[1], m)
        return found

    @cached_property
    def docs(self) -> dict[str, tuple[int, str]]:
        """Place and text of the first `# path -- text` of a path."""
        found: dict[str, tuple[int, str]] = {}
        for i, line in enumerate(self):
            if "--" in line and (m := _DOC_PATH.match(line)):
                found.setdefault(m[1].strip("\"'"), (i, m[2]))
        return found


def normal_type(value: Any) -> Any:
    """A type list without repeats, null for "null"; a single type alone; unknown names dropped."""
    names = value if isinstance(value, list) else [value]
    names = ["null" if n is None else str(n).strip() for n in names]
    known = list(dict.fromkeys(n for n in names if n in TYPES))
    return known[0] if len(known) == 1 else known or None


#: A text that is a plain scalar, whatever stands around it.
_WORD = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_./-]*")


def scalar(text: str) -> Any:
    """A YAML scalar or flow value."""
    import yaml

    if _WORD.fullmatch(text):
        return exact(construct(yaml.ScalarNode(resolved(text), text)))
    try:
        return exact(construct(compose(text)))
    except yaml.YAMLError:
        return text


_SIGNS = re.compile(r"^\s*#+ ?")


def _bare(comment: str) -> str:
    return _SIGNS.sub("", comment)


# -- dialects -----------------------------------------------------------------------

_OPEN = re.compile(r"^\s*#\s*@schema\s*$")


def block_dialect(node: Node, lines: list[str]) -> Note | None:
    """Comments between two `# @schema` lines hold YAML with schema keywords; `required` may be a boolean."""
    marks = [i for i, x in enumerate(node.above) if _OPEN.match(x)]
    if len(marks) < 2:
        return None
    body = scalar("\n".join(_bare(x) for x in node.above[marks[0] + 1 : marks[1]]))
    if not isinstance(body, dict):
        return None
    note = Note()
    for k, v in body.items():
        if k == "required" and isinstance(v, bool):
            note.required = v
        elif k == "type":
            if (kind := normal_type(v)) is not None:
                note.schema["type"] = kind
        elif k in ("skip", "hidden"):
            note.skip = bool(v)
        elif k == "skipProperties":
            note.skip_properties = bool(v)
        elif k == "mergeProperties":
            note.merge_properties = bool(v)
        else:
            note.schema[k] = v
    rest = [_bare(x) for x in node.above[marks[1] + 1 :]]
    if rest and "description" not in note.schema:
        note.schema["description"] = "\n".join(rest).strip()
    return note


#: Keys whose value is text as it stands, a list, or YAML (fixed names); others say nothing.
_INLINE_TEXT = ("title", "description", "pattern", "$id", "$ref")
_INLINE_LIST = ("enum", "examples", "type", "item", "itemEnum", "itemRequired")
_INLINE_YAML = (
    "default", "const", "multipleOf", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "uniqueItems", "readOnly", "deprecated",
    "additionalProperties", "patternProperties", "allOf", "anyOf", "oneOf", "not", "unevaluatedProperties",
)
_INLINE_ITEM = {"itemProperties": "properties", "itemEnum": "enum", "itemRequired": "required", "itemRef": "$ref"}


_INLINE = re.compile(r"^\s*#\s*@schema\s+(\S.*)$")


def inline_dialect(node: Node, lines: list[str]) -> Note | None:
    """`# @schema key:value;key:value` beside or above a member; itemX is X of its items."""
    found = [m[1] for x in [*node.above, node.beside] if x and (m := _INLINE.match(x))]
    if not found:
        return None
    note, schema = Note(), {}
    for part in re.split(r";(?=\s*[$A-Za-z])", ";".join(found)):
        key, _, text = part.strip().partition(":")
        key, text = key.strip(), text.strip()
        if not key:
            continue
        if key in _INLINE_TEXT or key == "itemRef":
            plain = text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text
            if key != "itemRef":
                schema[key] = plain
            elif plain:
                schema.setdefault("items", {})["$ref"] = plain
            continue
        value = True if not text else scalar(text)
        if key in _INLINE_LIST and isinstance(value, str):
            value = [scalar(v.strip()) for v in value.strip("[]").split(",")]
        if key == "required":
            note.required = value if isinstance(value, bool) else note.required
        elif key == "hidden":
            note.skip = bool(value)
        elif key == "skipProperties":
            note.skip_properties = bool(value)
        elif key == "mergeProperties":
            note.merge_properties = bool(value)
        elif key == "nullable":
            schema["_nullable"] = bool(value)
        elif key in ("type", "item"):
            if (kind := normal_type(value)) is not None:
                (schema if key == "type" else schema.setdefault("items", {}))["type"] = kind
        elif key in _INLINE_ITEM:
            if text and value not in ([], {}, None):
                schema.setdefault("items", {})[_INLINE_ITEM[key]] = value
        elif key in _INLINE_LIST or key in _INLINE_YAML:
            schema[key] = value
    if schema.pop("_nullable", False) and "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        schema["type"] = normal_type([*kinds, "null"])
    note.schema = schema
    return note


_PARAM = re.compile(r"^\s*##\s*@param\s+(\S+)\s*(?:\[([^\]]*)\])?\s*(.*)$")
_SKIP = re.compile(r"^\s*##\s*@skip\s+(\S+)")


def file_dialect(node: Node, lines: list[str]) -> Note | None:
    """`## @param path [modifiers] text` and `## @skip path` anywhere in the file."""
    m = (lines if isinstance(lines, Lines) else Lines(lines)).params.get(node.path)
    if m is None:
        return None
    if m.re is _SKIP:
        return Note(skip=True)
    schema: dict[str, Any] = {"description": m[3].strip()} if m[3].strip() else {}
    for modifier in (x.strip() for x in (m[2] or "").split(",") if x.strip()):
        name, _, value = modifier.partition(":")
        if name in TYPES:
            schema["type"] = name
        elif name == "nullable":
            schema.setdefault("type", literal_type(node.value))
            schema["type"] = normal_type([schema["type"], "null"])
        elif name == "default":
            schema["default"] = scalar(value.strip())
    return Note(schema)


#: Type names of the doc-comment dialect (fixed values).
DOC_TYPES = {"string": "string", "int": "integer", "integer": "integer", "float": "number", "number": "number", "bool": "boolean", "boolean": "boolean", "list": "array", "array": "array", "object": "object", "dict": "object", "map": "object"}


_DOC_PATH = re.compile(r"^\s*#\s+(\S+)\s+--\s*(.*)$")


def doc_dialect(node: Node, lines: list[str]) -> Note | None:
    """`# -- text` above a member, `# path -- text` anywhere; `(type)` first, `@default -- value`, `@raw` keeps line ends."""
    comments = None
    for i, x in enumerate(node.above):
        if re.match(r"^\s*#\s+--(\s|$)", x):
            comments = [re.sub(r"^\s*#\s+--\s?", "", x), *(_bare(y) for y in node.above[i + 1 :])]
    if comments is None and (elsewhere := (lines if isinstance(lines, Lines) else Lines(lines)).docs.get(node.path)):
        i, first = elsewhere
        comments = [first]
        for y in lines[i + 1 :]:
            if not re.match(r"^\s*#", y) or re.match(r"^\s*#\s+\S*\s*--", y):
                break
            comments.append(_bare(y))
    if comments is None:
        return None
    schema: dict[str, Any] = {}
    raw, text = False, []
    for c in comments:
        if m := re.match(r"^\s*@default\s+--\s*(.*)$", c):
            continue
        if c.strip() == "@raw":
            raw = True
            continue
        if re.match(r"^\s*@\w+", c):
            continue
        text.append(c)
    if text and (m := re.match(r"^\(([^)]+)\)\s*(.*)$", text[0])):
        kinds = [DOC_TYPES.get(k.split("/")[0].strip().lower()) for k in re.split(r"[|,]", m[1])]
        if all(kinds):
            schema["type"] = normal_type(kinds)
        text[0] = m[2]
    joined = ("\n" if raw else " ").join(t.rstrip() if raw else t.strip() for t in text).strip()
    if joined:
        schema["description"] = joined
    return Note(schema)


DIALECTS: dict[str, Dialect] = {"block": block_dialect, "inline": inline_dialect, "file": file_dialect, "doc": doc_dialect}


def dialects(use: list[str | Dialect]) -> list[Dialect]:
    """Dialects by name, or a caller's own functions, in order of priority."""
    unknown = sorted({n for n in use if isinstance(n, str)} - set(DIALECTS))
    if unknown:
        raise KeyError(f"unknown dialects {unknown}; there are {sorted(DIALECTS)}")
    return [DIALECTS[n] if isinstance(n, str) else n for n in use]


def root_note(lines: list[str]) -> dict:
    """Keywords for the whole document: YAML in comments between two `# @schema.root` lines."""
    marks = [i for i, x in enumerate(lines) if "@schema.root" in x and re.match(r"^\s*#\s*@schema\.root\s*$", x)]
    body = scalar("\n".join(_bare(x) for x in lines[marks[0] + 1 : marks[1]])) if len(marks) > 1 else None
    return body if isinstance(body, dict) else {}


def fits(values: list, kinds: Any) -> bool:
    """Whether every value is of one of the types."""
    names = kinds if isinstance(kinds, list) else [kinds]
    return all(any(has_type(v, n) for n in names) for v in values)


def merge_notes(notes: list[Note]) -> Note:
    """Field by field the first that says something; a reference keeps others from filling in, enum and const count as one field.

    A type and values that contradict it never come from different notes: the earlier stays.
    """
    out = Note()
    for note in notes:
        out.skip |= note.skip
        out.skip_properties |= note.skip_properties
        out.merge_properties |= note.merge_properties
        out.required = note.required if out.required is None else out.required
        if "$ref" in out.schema:
            continue
        constrained = any(k not in ("title", "description", "default", "examples") for k in out.schema)
        for k, v in note.schema.items():
            if k == "$ref" and constrained:
                continue
            if k in ("enum", "const") and ("enum" in out.schema or "const" in out.schema):
                continue
            if k in ("enum", "const") and "type" in out.schema and not fits(v if k == "enum" else [v], out.schema["type"]):
                continue
            if k == "type" and ("enum" in out.schema or "const" in out.schema) and not fits(out.schema.get("enum", [out.schema.get("const")]), v):
                continue
            out.schema.setdefault(k, v)
    return out


# -- walk ---------------------------------------------------------------------------


def description_of(above: list[str]) -> str | None:
    """Plain comment lines above a member as prose; fenced blocks, marker lines and rules of signs are skipped."""
    if not above:
        return None
    text, fence = [], None
    for line in (_bare(x).strip() for x in above):
        if re.fullmatch(r"@schema(\.root)?", line):
            fence = None if fence == line else fence or line
        elif fence is None:
            text.append(line)
    text = [t for t in text if t and not re.match(r"^(@|--|##)", t) and re.search(r"\w", t)]
    return " ".join(text) or None


def yaml_schema(text: str, use: list[str | Dialect] | None = None, defaults: bool = False, strict: bool = False) -> dict:
    """The schema of a YAML text: its documents walked with their comments, then merged, then what the comments say of the root."""
    chosen = dialects(use if use is not None else list(DIALECTS))
    clean = clean_text(text)
    found = [_document(d, chosen, defaults, strict) for d in split_documents(clean)]
    return (merge_all(found) if found else {}) | root_note(clean.split("\n"))


def _document(text: str, chosen: list[Dialect], defaults: bool, strict: bool) -> dict:
    import yaml

    root = compose(text)
    lines = Lines(text.split("\n"))
    values: dict[int, Any] = {}

    def value_of(node: Any) -> Any:
        if id(node) not in values:
            values[id(node)] = exact(construct(node))
        return values[id(node)]

    def comments(key: Any, value: Any) -> tuple[list[str], str]:
        at, above = key.start_mark.line - 1, []
        while at >= 0 and lines[at].lstrip().startswith("#") and len(lines[at]) - len(lines[at].lstrip()) == key.start_mark.column:
            above.insert(0, lines[at])
            at -= 1
        line = lines[key.start_mark.line]
        inside = not isinstance(value, yaml.ScalarNode) or value.end_mark.line == key.start_mark.line
        rest = line[value.end_mark.column :] if inside and isinstance(value, yaml.ScalarNode) else line[key.end_mark.column :]
        beside = re.search(r"(?:^|\s)(#.*)$", rest) if "#" in rest else None
        return above, beside[1] if beside else ""

    def members(node: Any) -> list[tuple[Any, Any]]:
        """Key and value nodes, merge keys expanded: explicit keys first, then earlier sources."""
        own = [(k, v) for k, v in node.value if k.tag != "tag:yaml.org,2002:merge"]
        names = {k.value for k, _ in own}
        for k, v in node.value:
            if k.tag == "tag:yaml.org,2002:merge":
                for source in v.value if isinstance(v, yaml.SequenceNode) else [v]:
                    for kk, vv in members(source) if isinstance(source, yaml.MappingNode) else []:
                        if kk.value not in names:
                            names.add(kk.value)
                            own.append((kk, vv))
        return own

    def walk(node: Any, path: str, inside_items: bool, depth: int) -> dict:
        if isinstance(node, yaml.MappingNode):
            out: dict[str, Any] = {"type": "object"}
            properties, required, skipped = {}, [], False
            for key, value in members(node) if depth < 1000 else []:
                name = str(key.value)
                below = f"{path}.{name}" if path else name
                above, beside = comments(key, value)
                info = Node(below, value_of(value), above, beside)
                note = merge_notes([n for n in (d(info, lines) for d in chosen) if n is not None])
                if note.skip:
                    skipped = True
                    continue
                inferred = walk(value, below, inside_items, depth + 1) if not note.skip_properties else {"type": literal_type(info.value)}
                if "type" in note.schema and note.schema["type"] != inferred.get("type"):
                    inferred = {k: v for k, v in inferred.items() if k in ("default",)}
                if note.merge_properties and inferred.get("properties"):
                    inferred = {k: v for k, v in inferred.items() if k != "properties"} | {"additionalProperties": merge_all(list(inferred["properties"].values()))}
                if "$ref" in note.schema:
                    inferred = {}
                if ("enum" in note.schema or "const" in note.schema) and "type" not in note.schema:
                    inferred.pop("type", None)
                child = {**inferred, **note.schema}
                if "description" not in child and (prose := description_of(above)):
                    child["description"] = prose
                properties[name] = child
                if note.required:
                    required.append(name)
            if properties:
                out["properties"] = properties
            if required:
                out["required"] = sorted(required)
            out["additionalProperties"] = not strict or skipped
            return out
        value = value_of(node)
        kind = literal_type(value)
        out = {} if kind == "null" else {"type": kind}
        if isinstance(node, yaml.SequenceNode):
            kinds = {literal_type(x) for x in value}
            if kinds and kinds <= {"object", "null"} and "object" in kinds:
                out["items"] = merge_all([walk(x, path, True, depth + 1) for x in node.value if isinstance(x, yaml.MappingNode)])
            elif kinds:
                from corvane.operators.infer import BITS

                joined = types_of(sum(BITS[k] for k in kinds))
                if joined not in (None, "null") and "array" not in kinds:
                    out["items"] = {"type": joined}
        if defaults and not inside_items and kind != "object":
            out["default"] = value
        return out

    return walk(root, "", False, 0) if root is not None else {}


def annotate_files(spark: SparkSession, *paths: str, use: list[str | Dialect] | None = None, root: dict | None = None, **options: Any) -> dict:
    """The merged schema of YAML files: a schema for each file is made on the executors; files merge in order of their paths; `root` has the last word on the root's keywords."""
    dialects(use if use is not None else list(DIALECTS))
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.append((path, canonical_json(yaml_schema(content.decode("utf-8-sig", "replace"), use, **options))))
                except Exception:  # inference fails open: a file that doesn't parse says nothing
                    continue
            yield pd.DataFrame(out, columns=["path", "schema"])

    rows = files.mapInPandas(run, "path string, schema string").orderBy("path").toLocalIterator()
    return {"$schema": "http://json-schema.org/draft-07/schema#"} | merge_all([parse_json(r.schema) for r in rows]) | (root or {})
