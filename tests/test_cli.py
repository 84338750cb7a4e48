"""The command line, vocabularies, and the driver contract."""

import json
import os
import subprocess
import sys

import pytest
from corvane.__main__ import main, time_stages
from corvane.plans.evaluator import Evaluator, Options
from corvane.plans.refs import schema_map


def test_generate_infer_validate(spark, tmp_path, capsys):
    spark.createDataFrame([(1, '{"k":1}'), (9, '{"k":2.5}')], "a long, j string").write.parquet(str(tmp_path / "t"))
    assert main(["generate", str(tmp_path / "t"), "--title", "T"]) == 0
    assert json.loads(capsys.readouterr().out)["title"] == "T"
    assert main(["infer", str(tmp_path / "t"), "j", "--indent", "0"]) == 0
    assert json.loads(capsys.readouterr().out)["properties"] == {"k": {"type": "number"}}
    (tmp_path / "s.json").write_text('{"properties": {"a": {"maximum": 5}}}')
    assert main(["validate", str(tmp_path / "s.json"), str(tmp_path / "t")]) == 1
    assert capsys.readouterr().out == "1\tmaximum\t/a\n"
    (tmp_path / "v.yaml").write_text("a: 1\n")
    assert main(["annotate", str(tmp_path / "v.yaml"), "--dialects", "doc,inline", "--strict"]) == 0
    assert json.loads(capsys.readouterr().out)["additionalProperties"] is False


def test_stage_timer():
    got = time_stages({"a": "sleep 0.2", "b": "exit 3"}, parallel=True)
    assert got["stages"]["b"]["exit"] == 3 and got["longest"] >= 0.2 and got["sum"] >= got["longest"]


def test_vocabularies():
    meta = {"$id": "http://x/meta", "$vocabulary": {"https://json-schema.org/draft/2020-12/vocab/core": True, "https://json-schema.org/draft/2020-12/vocab/applicator": True}}
    find = schema_map({"http://x/meta": meta})
    schema = {"$schema": "http://x/meta", "properties": {"a": {"minimum": 5}, "b": False}}
    e = Evaluator(schema, Options(resolver=find))
    assert e.is_valid({"a": 1}) and not e.is_valid({"b": 1})
    asserted = {**meta, "$vocabulary": {**meta["$vocabulary"], "https://json-schema.org/draft/2020-12/vocab/format-assertion": True}}
    assert not Evaluator({"$schema": "http://x/meta", "format": "ipv4"}, Options(resolver=schema_map({"http://x/meta": asserted}))).is_valid("x")


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr


def test_registered_queries():
    entry = pytest.importorskip("__spark_entry__")
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 80
