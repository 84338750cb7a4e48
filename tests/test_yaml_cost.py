"""YAML queries: a text is read once, by libyaml where that agrees with the plain parser, and in all tasks."""

import json
from decimal import Decimal

import pytest
import yaml
from corvane.functions.numbers import canonical_json
from corvane.operators import annotate
from corvane.operators.annotate import Node, yaml_schema
from corvane.plans.model import exact
from corvane.plans.queries import QUERIES
from corvane.sources import documents

SMALL = "/root/testdata/sf0.001"


def in_all_tasks(spark, name):
    return QUERIES[name](spark, SMALL).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def tree(node):
    if isinstance(node, yaml.ScalarNode):
        return node.tag, node.value, (node.start_mark.line, node.start_mark.column, node.end_mark.line, node.end_mark.column)
    return node and (node.tag, [(tree(k), tree(v)) for k, v in node.value] if isinstance(node, yaml.MappingNode) else [tree(x) for x in node.value], (node.start_mark.line, node.start_mark.column))


#: Texts that libyaml alone would take, place or end otherwise, errors, and what both read alike.
ODD = ["a: \tb", "k: v\n? ", "? a\n? b", "--- ", "\ufeffa: 1", "a: \ufeffb  # c", "|# c\n", "a: >-# c\n  b", "! ", "a: [1", "a: b: c", "a\u2028b: 1", "\r---", "%YAML 1.1\n---\na: 1", "", "# only", "a:", "é: '😀'  # c", "a: &x {b: [*y]}", "a: &x [1]\nb: *x\n<<: {c: 1}", "k: |\n  ---\n  t\n", "a: what? no!"]


def test_documents_merged(spark, monkeypatch):
    assert in_all_tasks(spark, "yaml_documents_merged")
    for text in ODD:
        found = []
        for read in (documents.compose, lambda t: yaml.compose(t, Loader=documents._loader())):
            try:
                found.append(tree(read(text)))
            except yaml.YAMLError as e:
                found.append(str(e))
        assert found[0] == found[1], text
    deep = "[" * 200_000 + "]" * 200_000  # in C this would end the process
    with pytest.raises(RecursionError):
        documents.compose(deep)
    if yaml.__with_libyaml__:
        monkeypatch.setattr("yaml.scanner.Scanner.fetch_more_tokens", None)
        assert yaml_schema("a: 1\n---\na: x\nb: 1.5\n---\nb: 2\n")["properties"] == {"a": {}, "b": {"type": "number"}}


def test_inline_comments(spark, monkeypatch):
    assert in_all_tasks(spark, "yaml_inline_comments")
    for word in ["x", "1", "010", "0x1F", "0o17", "1.5", "1e3", "1.", "true", "True", "no", "null", "Null", "2001-01-01", "a/b.c-d", "_", "1_000"]:
        assert repr(annotate.scalar(word)) == repr(exact(yaml.load(word, Loader=documents._loader())))  # noqa: S506  a SafeLoader
    monkeypatch.setattr(yaml, "load", None)  # words need no parser
    monkeypatch.setattr(annotate, "compose", None, raising=False)
    assert annotate.inline_dialect(Node("a", [], [], "# @schema type:array;nullable;itemRef:#/x;maxItems:5;const:null;unknown:1"), []).schema == {"type": ["array", "null"], "items": {"$ref": "#/x"}, "maxItems": 5, "const": None}


class Counted:
    """A pattern that counts the lines it is matched to."""

    def __init__(self, pattern):
        self.pattern, self.lines = pattern, 0

    def match(self, line):
        self.lines += 1
        return self.pattern.match(line)


def test_items(spark, monkeypatch):
    assert in_all_tasks(spark, "yaml_items")
    monkeypatch.setattr(annotate, "_PARAM", counted := Counted(annotate._PARAM))
    items = "".join(f"- k{i}: {i}\n" for i in range(40))
    schema = yaml_schema(f"## @param a.k3 [string] First\n## @param a.k3 Second\n## @skip a.k4\n# a.k5 -- Far\n# away\na:\n{items}b: 1\n")
    members = schema["properties"]["a"]["items"]["properties"]
    assert members["k3"] == {"type": "string", "description": "First"} and members["k5"] == {"type": "integer", "description": "Far away"} and "k4" not in members
    assert counted.lines <= 46  # each line once, not once for each member
    for value in ["a\"\u00e9\u2028\n", 10**30, -(10**18), 10**18 - 1, -7, 0, True, None, {"1": ["x"]}]:
        assert json.loads(canonical_json(value)) == value
    assert canonical_json({"b": 1200, "a": [-5, Decimal("1.50")]}) == '{"a":[-5,1.5],"b":1200}'
