"""Sources and sinks: JSON text, YAML files with comments, frames of a decoder process, schema and log files.

Readers give DataFrames; whole files are read by Spark's own readers, so any store that
Spark reads will do, and parsed in Arrow batches on the executors.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from functools import cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions.numbers import canonical_json
from corvane.operators.infer import schema_text


def parse_column(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """A column of JSON text as VARIANT; null where the text is no JSON document. Of equal keys the last counts if the session allows them."""
    return df.withColumn(name, F.try_parse_json(column))


def rows_as_json(df: DataFrame, name: str = "value", null_as: str = "absent") -> DataFrame:
    """Each row as JSON text: nulls left out, or written."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(null_as == "absent").lower()}).alias(name))


# -- YAML -------------------------------------------------------------------------


def clean_text(text: str) -> str:
    """Without byte order mark, with LF line ends."""
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


#: A line that ends in the sign of a block scalar.
_BLOCK = re.compile(r"(^|[:\-]\s+)[|>][+-]?\d?[+-]?\s*(#.*)?$")


def split_documents(text: str) -> list[str]:
    """The documents of a YAML text at `---` lines outside block scalars; those with nothing but comments join the next."""
    documents: list[list[str]] = [[]]
    block = None
    for line in clean_text(text).split("\n"):
        indent = len(line) - len(line.lstrip(" "))
        if block is not None and line.strip() and indent <= block:
            block = None
        if block is None and line.startswith("---") and (len(line) == 3 or line[3].isspace()):
            documents.append([line[3:].strip()] if line[3:].strip() else [])
            continue
        if block is None and line.startswith("...") and not line[3:].strip():
            documents.append([])
            continue
        if block is None and ("|" in line or ">" in line) and _BLOCK.search(line) and not line.lstrip().startswith("#"):
            block = indent
        documents[-1].append(line)
    out: list[str] = []
    carried: list[str] = []
    for lines in documents:
        if all(not x.strip() or x.lstrip().startswith("#") for x in lines):
            carried += [x for x in lines if x.strip()]
        else:
            out.append("\n".join([*carried, *lines]))
            carried = []
    return out


@cache
def _loader(compiled: bool = False):
    """A YAML loader with the core schema's scalars: only true and false are booleans, and numbers keep whether they are whole."""
    import yaml

    class Loader(yaml.CSafeLoader if compiled else yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
        ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
        ("tag:yaml.org,2002:merge", r"^(?:<<)$", ["<"]),
    ):
        Loader.add_implicit_resolver(tag, re.compile(pattern), first)
    return Loader


#: What libyaml takes or places otherwise than the plain parser: tabs, byte order marks, line ends other than LF, lone `?` and `!`, comments at a block scalar's sign, document and directive lines.
_UNLIKE = re.compile(r"[\t\r\ufeff\x85\u2028\u2029]|[?!](?:\s|$)|[|>][-+0-9]*#|^(?:---|\.\.\.|%)", re.MULTILINE)
#: libyaml's nodes are built by recursion in C, which nothing stops before the stack ends.
COMPILED_DEPTH = 1000


def _shallow(text: str) -> bool:
    """Whether no node can be deeper than COMPILED_DEPTH: each level has a sign of its own, those without brackets a column, which a list may share with its key."""
    if len(text) <= COMPILED_DEPTH:
        return True
    flow = text.count("[") + text.count("{")
    return flow + sum(map(text.count, "-:?")) <= COMPILED_DEPTH or flow + 2 * max(map(len, text.split("\n"))) < COMPILED_DEPTH


def compose(text: str) -> Any:
    """The node of a text of one document, None without one: by libyaml, where it is there and reads the text as the plain parser does; what it refuses is left to that."""
    import yaml

    if yaml.__with_libyaml__ and not _UNLIKE.search(text) and _shallow(text):
        try:
            return yaml.compose(text, Loader=_loader(compiled=True))
        except yaml.YAMLError:
            pass
    return yaml.compose(text, Loader=_loader())


@cache
def _resolver() -> Any:
    return _loader()("")


def resolved(text: str) -> str:
    """The tag of a plain scalar."""
    from yaml import ScalarNode

    return _resolver().resolve(ScalarNode, text, (True, False))


@cache
def _constructor() -> tuple[type, dict[str, Any]]:
    """What makes values of nodes, and its functions for the core schema's scalars, which need nothing of other nodes."""
    from yaml.constructor import SafeConstructor

    return SafeConstructor, {f"tag:yaml.org,2002:{t}": getattr(SafeConstructor(), f"construct_yaml_{t}") for t in ("null", "bool", "int", "float", "str")}


def construct(node: Any) -> Any:
    """The value of a node of compose()."""
    if node is None:
        return None
    maker, scalars = _constructor()
    if node.id == "scalar" and node.tag in scalars:
        return scalars[node.tag](node)
    return maker().construct_document(node)


def load_yaml(text: str) -> list[Any]:
    """The values of all documents of a YAML text; merge keys expanded, explicit keys and earlier sources first."""
    return [construct(compose(d)) for d in split_documents(text)]


def read_yaml(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, document, json): a row for each document of YAML files; files that don't parse give none."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, n, canonical_json(v)) for n, v in enumerate(load_yaml(content.decode("utf-8-sig", "replace")))]
                except Exception:  # inference fails open: a bad file constrains nothing
                    continue
            yield pd.DataFrame(rows, columns=["path", "document", "json"])

    return files.mapInPandas(run, "path string, document int, json string")


# -- sinks ------------------------------------------------------------------------


def write_schema(schema: Any, path: str, indent: int | None = 2) -> None:
    """One schema as a JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(schema_text(schema, indent))


def write_log(df: DataFrame, path: str, fmt: str = "json", level: str = "info", fields: list[str] | None = None) -> None:
    """Rows of at least a level as lines of text in a format; the level column is `level`."""
    from corvane.functions.strings import level_rank, log_line

    least = level_rank(F.lit(level))
    kept = df.filter(F.coalesce(level_rank(F.col("level")), F.lit(0)) >= least)
    kept.select(log_line(fmt, fields or df.columns).alias("value")).write.mode("overwrite").text(path)


# -- frames -----------------------------------------------------------------------


class FrameReader(DataSourceReader):
    """Runs a decoder that writes raw RGBA frames and reads them one by one; a short last frame ends the stream."""

    def __init__(self, options: dict):
        self.command, self.width, self.height = options["command"], int(options["width"]), int(options["height"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        size = 4 * self.width * self.height
        with subprocess.Popen(self.command, shell=True, stdout=subprocess.PIPE) as process:  # noqa: S602  the caller's own command
            seq = 0
            while len(pix := process.stdout.read(size)) == size:
                yield (seq, self.width, self.height, pix)
                seq += 1


class FrameSource(DataSource):
    """Data source `frames`: options command, width, height."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "seq bigint, width int, height int, pix binary"

    def reader(self, schema: Any) -> FrameReader:
        return FrameReader(self.options)


def decoder_command(path: str, fps: int, width: int, height: int) -> str:
    """The command line of a decoder that writes RGBA frames of a video to its output."""
    import shlex

    return f"ffmpeg -loglevel error -i {shlex.quote(path)} -vf fps={fps},scale={width}:{height} -f rawvideo -pix_fmt rgba -"
