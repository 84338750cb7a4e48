"""Contracts: a schema applied to the rows of a DataFrame, batch or streaming.

A contract adds narrow expressions to the plan: valid() is a filter that keeps column
pruning and predicate push-down, validate() adds an array of violations, violations()
has a row for each, and only report() shuffles (counts, combined before the shuffle).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.plans.evaluator import Options
from corvane.plans.lower import VIOLATION, Lowering, Value, as_column


def _has_long_number(column: str) -> Column:
    """Whether JSON text holds digits that VARIANT would round, or an exponent beyond doubles."""
    return F.coalesce(F.col(column).rlike(r"[0-9][0-9.]{37}|[0-9][eE][+-]?[0-9]{3}"), F.lit(False))


class Contract:
    """A schema with its options.

    null_as says what a SQL null in a column or struct field is: an "absent" member
    (the default) or a JSON "null". Nulls in arrays and maps are JSON null. With
    exact_numbers, JSON text that holds numbers of over 38 digits, or exponents of three
    digits, goes to the plain evaluator, as VARIANT would round them.
    """

    def __init__(self, schema: Any, null_as: str = "absent", exact_numbers: bool = False, **options: Any):
        self.schema, self.null_as, self.exact_numbers = schema, null_as, exact_numbers
        self.options = Options(**options)
        Lowering(schema, self.options, null_as)  # a schema that can't be used fails here

    def _lowering(self) -> Lowering:
        return Lowering(self.schema, self.options, self.null_as)

    def _row(self, df: DataFrame) -> Value:
        return Value(None, df.schema, False)

    def _column(self, df: DataFrame, column: str, parse: bool) -> Value:
        col, field = F.col(column), df.select(column).schema[0]
        if parse:
            return Value(F.try_parse_json(col), T.VariantType(), False)
        return Value(col, field.dataType, field.nullable and not isinstance(field.dataType, T.VariantType))

    def is_valid(self, df: DataFrame, column: str | None = None, parse: bool = False) -> Column:
        """A boolean Column, never null: the row, or one of its columns, meets the schema.

        With parse the column is JSON text; text that isn't JSON, and null, is invalid.
        """
        low = self._lowering()
        if column is None:
            return as_column(low.pred(low.schema, self._row(df)))
        v = self._column(df, column, parse)
        p = as_column(low.pred(low.schema, v))
        if not parse and not v.dynamic:
            return p
        p = F.coalesce(p, F.lit(False))
        if parse and self.exact_numbers:
            return F.when(_has_long_number(column), self._exact(column)).otherwise(v.col.isNotNull() & p)
        return v.col.isNotNull() & p if parse else p

    def valid(self, df: DataFrame, column: str | None = None, parse: bool = False) -> DataFrame:
        """The rows that meet the schema."""
        return df.filter(self.is_valid(df, column, parse))

    def invalid(self, df: DataFrame, column: str | None = None, parse: bool = False) -> DataFrame:
        """The rows that don't."""
        return df.filter(~self.is_valid(df, column, parse))

    def failures(self, df: DataFrame, column: str | None = None, parse: bool = False) -> Column:
        """An array Column of structs (instance_path, schema_path, keyword, message, depth); empty for valid rows."""
        low = self._lowering()
        if column is None:
            return low._joined(low.violations(low.schema, self._row(df)))
        v = self._column(df, column, parse)
        found = low._joined(low.violations(low.schema, v))
        if parse:
            bad = low._joined([low._one_row("", "", "", "not a JSON document", 0)])
            found = F.when(v.col.isNull(), bad).otherwise(found)
            return F.when(_has_long_number(column), self._exact(column, True)).otherwise(found) if self.exact_numbers else found
        return found

    def _exact(self, column: str, listed: bool = False) -> Column:
        """The plain evaluator on JSON text: for numbers of more digits than VARIANT keeps."""
        low = self._lowering()
        run = low._remote(low.schema) if isinstance(low.schema, dict) else (lambda text: low.evaluator.validate_json(text))

        def failures(text: str) -> list:
            try:
                return [(x.instance_path, x.schema_path, x.keyword, x.message, d) for top in run(text) for d, x in top.flat()]
            except ValueError:
                return [("", "", "", "not a JSON document", 0)]

        text = F.when(_has_long_number(column), F.col(column))  # the engine hands all rows to Python: the others as null
        if listed:
            return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else failures(t)), f"array<{VIOLATION}>")(text)
        return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else not failures(t)).astype(object), "boolean")(text)

    def validate(self, df: DataFrame, column: str | None = None, parse: bool = False, name: str = "violations") -> DataFrame:
        """All rows, with their violations."""
        return df.withColumn(name, self.failures(df, column, parse))

    def violations(self, df: DataFrame, column: str | None = None, parse: bool = False, keep: list[str] | None = None) -> DataFrame:
        """One row for each violation: the columns to keep, its number in the row (pos) and its fields."""
        keep = keep or []
        exploded = df.select(*keep, F.posexplode(self.failures(df, column, parse)).alias("pos", "v"))
        return exploded.select(*keep, "pos", "v.*")

    def first_violation(self, df: DataFrame, column: str | None = None, parse: bool = False, name: str = "violation") -> DataFrame:
        """All rows, with the first violation or null."""
        return df.withColumn(name, F.try_element_at(self.failures(df, column, parse), F.lit(1)))

    def report(self, df: DataFrame, column: str | None = None, parse: bool = False, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
        """Numbers of violations by keyword and instance path, and by other columns; with rollup their subtotals too."""
        by = by or []
        rows = self.violations(df, column, parse, keep=by)
        groups = [*by, "keyword", "instance_path"]
        return (rows.rollup(*groups) if rollup else rows.groupBy(*groups)).agg(F.count(F.lit(1)).alias("n"))


#: Keywords whose failure is about a member's presence, name, number or membership, as an SQL-side test.
def targets_key(keyword: Column) -> Column:
    from corvane.plans.model import Violation

    return keyword.isin(list(Violation.ABOUT_KEYS))


def leaves(violations: Column) -> Column:
    """Of an array of violations the deepest ones: those not followed by a deeper one."""
    following = lambda i: F.try_element_at(violations, (i + 2).cast("int"))["depth"]
    return F.filter(violations, lambda v, i: F.coalesce(following(i) <= v["depth"], F.lit(True)))


def violations_text(violations: Column) -> Column:
    """An array of violations as indented lines."""
    path = lambda p: F.when(p == "", "/").otherwise(p)
    keyword = lambda v: F.when(v["keyword"] == "", "false").otherwise(v["keyword"])
    line = lambda v: F.concat(F.repeat(F.lit("  "), v["depth"]), path(v["instance_path"]), F.lit(": "), v["message"], F.lit(" ("), keyword(v), F.lit(" at "), path(v["schema_path"]), F.lit(")"))
    return F.array_join(F.transform(violations, line), "\n")


def instance_segments(path: Column) -> Column:
    """A JSON Pointer as an array of (key, idx): idx is set where the segment is a number."""
    parts = F.filter(F.split(path, "/", -1), lambda p, i: i > 0)
    clean = lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.transform(parts, lambda p: F.struct(clean(p).alias("key"), p.try_cast("int").alias("idx")))


def missing_references(df: DataFrame, columns: list[str], other: DataFrame, other_columns: list[str]) -> DataFrame:
    """Rows whose key has no partner in another table (an extension: a referential contract)."""
    renamed = other.select(*(F.col(b).alias(a) for a, b in zip(columns, other_columns, strict=True)))
    return df.join(renamed, columns, "left_anti")
