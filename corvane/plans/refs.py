"""Reference resolution and inlining (driver side)."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from typing import Any
from urllib.parse import unquote, urljoin, urlsplit

from corvane.plans.model import DRAFT7, Draft, ReferenceCycle, SchemaError, UnresolvedReference, children, clone, parse_schema, unescape, vet

Resolver = Callable[[str], Any]


def resolve_uri(base: str, ref: str) -> str:
    """ref against base; a fragment or an empty reference keeps an opaque base."""
    if not base or urlsplit(ref).scheme:
        return ref
    head = base.split("#", 1)[0]
    if not ref or ref.startswith("#"):
        return head + ref
    if ":" in head and not urlsplit(head).netloc and not head.split(":", 1)[1].startswith("/"):
        return ref  # nothing is relative to an opaque identifier
    scheme = head.split(":", 1)[0]
    if "://" in head and scheme not in ("http", "https", "file", "ftp"):
        return scheme + urljoin("http" + head[len(scheme) :], ref)[4:]
    return urljoin(head, ref)


def split_fragment(uri: str) -> tuple[str, str]:
    head, _, fragment = uri.partition("#")
    return head, unquote(fragment)


def schema_map(schemas: Mapping[str, Any]) -> Resolver:
    """A catalog in memory; nothing else resolves."""
    return lambda uri: schemas.get(uri)


def file_resolver(root: str) -> Resolver:
    """Documents below a folder, by relative path or file URI; paths that leave the folder don't resolve."""
    top = os.path.realpath(root)

    def find(uri: str) -> Any:
        parts = urlsplit(uri)
        if parts.scheme not in ("", "file"):
            return None
        path = os.path.realpath(os.path.join(top, unquote(parts.path).lstrip("/") if not parts.path.startswith(top) else unquote(parts.path)))
        if os.path.commonpath([top, path]) != top or not os.path.isfile(path):
            return None
        with open(path, encoding="utf-8") as f:
            return parse_schema(f.read())

    return find


def chain(*resolvers: Resolver) -> Resolver:
    """The first resolver that knows a document."""

    def find(uri: str) -> Any:
        for resolver in resolvers:
            found = resolver(uri)
            if found is not None:
                return found
        return None

    return find


def strip_prefix(prefix: str, resolver: Resolver) -> Resolver:
    """Documents under a prefix, asked for by the rest."""
    return lambda uri: resolver(uri[len(prefix) :]) if uri.startswith(prefix) else None


class Registry:
    """All resources of a document and of those fetched for it: by URI, anchor and dynamic anchor."""

    def __init__(self, schema: Any, draft: Draft, resolver: Resolver | None = None, base: str = ""):
        self.draft, self.resolver = draft, resolver
        self.resources: dict[str, Any] = {}
        self.anchors: dict[str, Any] = {}
        self.dynamic: set[str] = set()
        self.base: dict[int, str] = {}
        self.missing: set[str] = set()
        self.keep: list[Any] = []
        self.root = schema
        self.add(schema, base, draft)

    def add(self, schema: Any, base: str, draft: Draft) -> None:
        """Index a document; what is known already stays."""
        self.keep.append(schema)
        self.resources.setdefault(base, schema)
        stack = [(schema, base)]
        while stack:
            node, base = stack.pop()
            if not isinstance(node, dict) or id(node) in self.base:
                continue
            hidden = draft.ref_hides_siblings and "$ref" in node
            own = node.get("$id")
            if isinstance(own, str) and not hidden:
                if draft is DRAFT7 and own.startswith("#"):
                    self.anchors.setdefault(base + own, node)
                else:
                    base = split_fragment(resolve_uri(base, own))[0]
                    self.resources.setdefault(base, node)
            self.base[id(node)] = base
            for key in ("$anchor", "$dynamicAnchor"):
                if isinstance(node.get(key), str) and draft is not DRAFT7:
                    self.anchors.setdefault(f"{base}#{node[key]}", node)
                    if key == "$dynamicAnchor":
                        self.dynamic.add(f"{base}#{node[key]}")
            stack += [(child, base) for _, child in children(node)]

    def base_of(self, node: Any) -> str:
        return self.base.get(id(node), "")

    def document(self, uri: str) -> Any:
        if uri not in self.resources and uri not in self.missing and self.resolver:
            found = self.resolver(uri)
            if found is None:
                self.missing.add(uri)
            else:
                made = parse_schema(found)
                vet(made, self.draft)
                self.add(made, uri, self.draft)
        if uri not in self.resources:
            raise UnresolvedReference(uri)
        return self.resources[uri]

    def target(self, uri: str) -> Any:
        """The schema of an absolute reference."""
        head, fragment = split_fragment(uri)
        if fragment and not fragment.startswith("/"):
            if f"{head}#{fragment}" not in self.anchors:
                self.document(head)
            try:
                return self.anchors[f"{head}#{fragment}"]
            except KeyError:
                raise UnresolvedReference(uri) from None
        node, base = self.document(head), head
        for segment in fragment.split("/")[1:]:
            key = unescape(segment)
            if isinstance(node, dict) and isinstance(node.get("$id"), str) and id(node) in self.base:
                base = self.base[id(node)]
            if isinstance(node, dict) and key in node:
                node = node[key]
            elif isinstance(node, list) and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < len(node):
                node = node[int(key)]
            else:
                raise UnresolvedReference(uri)
        if not isinstance(node, (dict, bool)):
            raise UnresolvedReference(uri)
        if isinstance(node, dict) and id(node) not in self.base:
            self.add_fragment(node, base)
        return node

    def add_fragment(self, node: Any, base: str) -> None:
        """Vet and index a schema found under an unknown keyword."""
        vet(node, self.draft)
        known = self.resources.get(base)
        self.add(node, base, self.draft)
        if known is not None:
            self.resources[base] = known

    def ref(self, node: dict) -> Any:
        return self.target(resolve_uri(self.base_of(node), node["$ref"]))

    def dynamic_ref(self, node: dict, scopes: list[str]) -> Any:
        """The static target; if that is a dynamic anchor, the outermost resource in scope with the same one."""
        uri = resolve_uri(self.base_of(node), node["$dynamicRef"])
        head, fragment = split_fragment(uri)
        found = self.target(uri)
        if fragment and not fragment.startswith("/") and f"{head}#{fragment}" in self.dynamic:
            for base in scopes:
                if f"{base}#{fragment}" in self.dynamic:
                    return self.anchors[f"{base}#{fragment}"]
        return found


def inline(schema: Any, draft: Draft, resolver: Resolver | None = None, on_failure: Callable[[str, Exception], Any] | None = None, max_depth: int = 100) -> Any:
    """The schema with every $ref replaced by its target.

    Draft 7 drops a reference's siblings; 2020-12 puts target and siblings in allOf.
    References in a cycle raise ReferenceCycle. on_failure(ref, error) may give a
    substitute for a reference that fails, or None to drop it; substitutes nest at
    most max_depth deep.
    """
    registry = Registry(clone(schema), draft, resolver)
    strip = ("$id", "$schema", "$anchor", "$dynamicAnchor", draft.definitions, "definitions", "$defs")

    def expand(node: Any, open_: tuple[int, ...], depth: int) -> Any:
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            rest = {} if draft.ref_hides_siblings else {k: v for k, v in node.items() if k != "$ref" and k not in strip}
            try:
                target = registry.ref(node)
                if id(target) in open_:
                    raise ReferenceCycle(node["$ref"])
                out = expand(target, (*open_, id(target)), depth)
            except SchemaError as e:
                if on_failure is None:
                    raise
                if depth >= max_depth:
                    raise ReferenceCycle(f"more than {max_depth} substitutions") from e
                got = on_failure(node["$ref"], e)
                if got is None:
                    return expand(rest, open_, depth)
                out = expand(parse_schema(got), open_, depth + 1)
            if isinstance(out, dict):
                out = {k: v for k, v in out.items() if k not in strip}
            if not rest:
                return out
            return {"allOf": [out, expand(rest, open_, depth)]}
        out = dict(node)
        for segments, child in children(node):
            if segments[0] in ("definitions", "$defs"):
                continue
            done = expand(child, open_, depth)
            if len(segments) == 1:
                out[segments[0]] = done
            else:
                held = out[segments[0]]
                if held is node[segments[0]]:
                    held = out[segments[0]] = list(held) if isinstance(held, list) else dict(held)
                held[segments[1]] = done
        return {k: v for k, v in out.items() if k not in ("definitions", "$defs")}

    return expand(registry.root, (id(registry.root),), 0)
