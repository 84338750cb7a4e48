"""String and scalar functions: line joining, trimming, margins, dedent, levels, fallback chains, JSON Pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_lf(lines: Column) -> Column:
    """Array elements joined by LF, no end of line after the last."""
    return F.array_join(lines, "\n")


def join_crlf(lines: Column) -> Column:
    return F.array_join(lines, "\r\n")


def lines_lf(lines: Column) -> Column:
    """Array elements each closed by LF."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def lines_crlf(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\r\n"))), "")


def trim_line_ends(text: Column) -> Column:
    """Without blanks and tabs at the ends of lines; carriage returns stay."""
    return F.regexp_replace(text, r"[ \t]+(?=\r?(\n|\z))", "")


def strip_margin(text: Column, mark: str = "|") -> Column:
    """Each line without what stands up to its margin mark; lines without one are dropped."""
    cut = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.ltrim(x).startswith(mark), F.substring(F.ltrim(x), len(mark) + 1, 2**31 - 1)))
    return F.array_join(F.filter(cut, lambda x: x.isNotNull()), "\n")


def dedent(text: Column) -> Column:
    """Without a first line break, and without the indent that all lines that aren't blank share; blank lines become empty."""
    lines = F.split(F.regexp_replace(text, r"\A\n", ""), "\n", -1)
    indent = lambda x: F.length(F.regexp_extract(x, r"\A[ \t]*", 0))
    filled = F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"[ \t]", "")) > 0)
    least = F.coalesce(F.array_min(F.transform(filled, indent)), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.length(F.regexp_replace(x, r"[ \t]", "")) == 0, "").otherwise(F.substring(x, least + 1, F.length(x)))), "\n")


def first_known(*values: Column, default: str = "unknown") -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(default))


#: Level names in rising order (fixed values).
LEVELS = ("debug", "info", "warn", "error")
FORMATS = ("json", "logfmt", "text")


def parse_level(text: Column) -> Column:
    """The canonical level name, whatever the case; "warning" is "warn"; null for others."""
    low = F.lower(F.trim(text))
    low = F.when(low == "warning", "warn").otherwise(low)
    return F.when(low.isin(list(LEVELS)), low)


def level_rank(text: Column) -> Column:
    """The place of a level in rising order, from 0; null for unknown levels."""
    level = parse_level(text)
    out = F.lit(None).cast("int")
    for rank, name in enumerate(LEVELS):
        out = F.when(level == name, rank).otherwise(out)
    return out


def parse_log_format(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(list(FORMATS)), low)


def log_line(fmt: str, fields: Sequence[str]) -> Column:
    """The named columns as one log line in a format: json, logfmt or text."""
    if fmt == "json":
        return F.to_json(F.struct(*fields))
    text = lambda c: F.col(c).cast("string")
    if fmt == "logfmt":
        quoted = lambda c: F.when(text(c).rlike(r'[\s"=]|\A\z'), F.concat(F.lit('"'), F.replace(F.replace(text(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text(c))
        return F.concat_ws(" ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), quoted(c))) for c in fields))
    if fmt == "text":
        return F.concat_ws(" ", *(text(c) for c in fields))
    raise ValueError(f"unknown format {fmt!r}")


def pointer_escape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_segments(path: Column) -> Column:
    """The unescaped segments of a JSON Pointer; null where the text is none."""
    return F.when(path == "", F.array().cast("array<string>")).when(path.startswith("/"), F.transform(F.filter(F.split(path, "/", -1), lambda p, i: i > 0), pointer_unescape))


def pointer_index(segment: Column) -> Column:
    """A segment as an array index: digits without a leading zero; else null."""
    return F.when(segment.rlike(r"\A(0|[1-9][0-9]*)\z"), segment.try_cast("int"))
