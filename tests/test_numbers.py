"""Numbers and equality as Columns agree with the plain evaluator, at extreme magnitudes and inside strings too."""

import json
import random

import pytest
from corvane.functions.numbers import canonical_json, is_multiple, number_text, number_text_column, variant_text
from corvane.operators.contract import Contract
from corvane.plans.evaluator import Evaluator
from corvane.plans.model import parse_json
from pyspark.sql import functions as F

FIXED = ["3.0e25", "1e-20", "0", "-0.0", "0.3", "0.30", "1e20", "100000000000000000000", "0.1", "1.5e300", "123456789012345678901234567890", "7", "2.10", "-4.5", "1e-7", "99999999999999999999999999999999999999", "5e-324", "1.7976931348623157e308", "0.6", "1e15", "900719925474099.3"]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    texts = FIXED + [repr(rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30)) for _ in range(60)] + [f"{rng.randint(-(10**6), 10**6) * 3}e{rng.randint(-25, 25)}" for _ in range(60)]
    return spark.createDataFrame([(t, float(t)) for t in texts], "t string, d double")


@pytest.mark.parametrize("step", ["0.3", "3", "1e-7", "1e20", "0.000000000000000000001", "7e30", "2.5", "123456789.123"])
def test_multiple_of(numbers, step):
    contract = Contract(f'{{"multipleOf": {step}}}')
    for r in numbers.select("t", "d", contract.is_valid(numbers, "t", True).alias("text"), contract.is_valid(numbers, "d").alias("double")).collect():
        assert r.text == is_multiple(parse_json(r.t), parse_json(step)), r.t
        assert r.double == is_multiple(r.d, parse_json(step)), r.d


def test_number_text(numbers):
    for r in numbers.select("t", number_text_column(F.to_json(F.parse_json("t"))).alias("x")).collect():
        assert r.x == number_text(parse_json(r.t)), r.t


DOCUMENTS = [
    '{"s":"a:1.0,b"}', '{"s":"a:1,b"}', '{"s":"[1.0]"}', "[1.0]", "[1]", "[-0.0, 0]", '["1","1.0"]', '[{"s":"a:1.0,b"},{"s":"a:1,b"}]', "[1e20,100000000000000000000]", '[{"a":1,"b":[2.0]},{"b":[2],"a":1e0}]', "[0.1,1e-1]", '["\\"1.0", 1]', '{"b":{"y":1.50},"a":null}',
    "[[1e2],[100.0]]", '["é","\\u00e9"]', "[true,1]", "[null,null]", '{"1.0":1.0}', '{"1.0":1}', '[{"x":1e-3},{"x":0.001}]',
]


@pytest.mark.parametrize("schema", ['{"uniqueItems":true}', *(f'{{"const":{d}}}' for d in DOCUMENTS), '{"enum":[[100,{"a":1}],{"a":null,"b":{"y":1.5}},[[100],[1e2]]]}'])
def test_container_equality(spark, schema):
    docs = spark.createDataFrame([(d,) for d in DOCUMENTS], "j string")
    plain = Evaluator(schema)
    for r in docs.select("j", Contract(schema).is_valid(docs, "j", True).alias("ok")).collect():
        assert r.ok == (not plain.violations(parse_json(r.j))), r.j


def test_canonical_text_is_canonical(spark):
    docs = spark.createDataFrame([(d,) for d in DOCUMENTS], "j string")
    for r in docs.select("j", variant_text(F.parse_json("j")).alias("x")).collect():
        assert json.loads(r.x) == json.loads(r.j) and r.x == canonical_json(parse_json(r.j))
