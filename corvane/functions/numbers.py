"""Exact numbers and JSON-semantic equality, on the driver and as Columns."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal
from json.encoder import encode_basestring
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond so many digits a number is never expanded.
MAX_DIGITS = 4096


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)


def is_finite(x: Any) -> bool:
    return not isinstance(x, float) or math.isfinite(x)


def exact(x: Any) -> Decimal | int:
    """A finite number as int or Decimal; floats as the decimal that prints them."""
    return Decimal(repr(x)) if isinstance(x, float) else x


def is_integral(x: Any) -> bool:
    """Whether the value is whole, whatever its notation: 1.0 and 1e2 are."""
    if isinstance(x, int):
        return not isinstance(x, bool)
    if not is_finite(x):
        return False
    x = exact(x)
    _, digits, exponent = x.as_tuple()
    if not any(digits) or exponent >= 0:
        return True
    return len(digits) > -exponent - 1 and not any(digits[exponent:]) if -exponent <= len(digits) else False


def is_multiple(x: Any, step: Any) -> bool:
    """Whether x / step is whole, exactly; numbers of more than MAX_DIGITS digits by modular arithmetic of whole steps, else True."""
    a, b = Decimal(exact(x)), Decimal(exact(step))
    if not a:
        return True
    (_, da, ea), (_, db, eb) = a.as_tuple(), b.as_tuple()
    na, nb = int("".join(map(str, da))) if len(da) <= MAX_DIGITS else 0, int("".join(map(str, db)))
    if len(da) > MAX_DIGITS or abs(ea) > MAX_DIGITS or abs(eb) > MAX_DIGITS:
        if not is_integral(b):
            return True
        whole = nb * 10 ** min(eb, MAX_DIGITS) if eb >= 0 else nb // 10**-eb
        if ea < 0 and not is_integral(a):
            return False
        rest = 0
        for d in da if ea >= 0 else da[:ea]:
            rest = (rest * 10 + d) % whole
        return rest * pow(10, max(ea, 0), whole) % whole == 0
    low = min(ea, eb)
    return na * 10 ** (ea - low) % (nb * 10 ** (eb - low)) == 0


def canonical(x: Any) -> Any:
    """A hashable form: equal exactly for values that JSON takes as equal (1 = 1.0, true is no number, key order doesn't matter)."""
    if isinstance(x, bool) or x is None:
        return ("bool", x)
    if is_number(x):
        if not is_finite(x):
            return ("number", object())
        d = Decimal(exact(x))
        sign, digits, exponent = d.as_tuple()
        if not any(digits):
            return ("number", 0)
        text = "".join(map(str, digits)).lstrip("0")
        short = text.rstrip("0")
        return ("number", sign, short, exponent + len(text) - len(short))
    if isinstance(x, str):
        return ("string", x)
    if isinstance(x, list):
        return ("array", tuple(map(canonical, x)))
    return ("object", tuple(sorted((k, canonical(v)) for k, v in x.items())))


def equal(a: Any, b: Any) -> bool:
    return canonical(a) == canonical(b)


def number_text(x: Any) -> str:
    """The shortest plain notation of a number: 1 for 1.0, 100 for 1e2, 0.1 for 0.10."""
    if type(x) is int and -(10**18) < x < 10**18:
        return str(x)
    sign, digits, exponent = Decimal(exact(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    short = text.rstrip("0")
    exponent += len(text) - len(short)
    if not short:
        return "0"
    if exponent >= 0:
        out = short + "0" * exponent
    else:
        out = short.rjust(1 - exponent, "0")
        out = f"{out[:exponent]}.{out[exponent:]}"
    return "-" * sign + out


def canonical_json(x: Any) -> str:
    """JSON text of a value with sorted keys and numbers in shortest plain notation."""
    if type(x) is str:
        return encode_basestring(x)
    if isinstance(x, dict):
        return "{" + ",".join([f"{encode_basestring(k) if type(k) is str else json.dumps(k, ensure_ascii=False)}:{canonical_json(x[k])}" for k in sorted(x)]) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical_json, x)) + "]"
    if is_number(x):
        return number_text(x)
    return json.dumps(x, ensure_ascii=False)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x computed once however often the body reads it."""
    return F.transform(F.array(x), body)[0]


def shortest_text(x: Column) -> Column:
    """The shortest digits that read back as the same double; the engine's own text may have one more."""
    formats = F.array(*(F.lit(f"%.{n}e") for n in range(17)))
    texts = F.transform(formats, lambda f: F.call_function("format_string", f, x))
    return F.coalesce(F.get(F.filter(texts, lambda t: t.try_cast("double") == x), F.lit(0)), x.cast("string"))


def _printed(text: Column) -> Column:
    """A number as the engine printed it; of doubles with an exponent the shortest text."""
    return F.when(text.contains("E"), let(text.try_cast("double"), shortest_text)).otherwise(text)


def _notation(text: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """body(sign, digits without zeros at either end, places of the digits before the point) of a JSON number's text."""
    pattern = r"^(-?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$"

    def parts(t: Column) -> Column:
        part = lambda n: F.regexp_extract(t, pattern, n)
        return F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("digits"), (F.length(part(2)) + F.coalesce(part(4).try_cast("int"), F.lit(0))).alias("point"))

    def trimmed(p: Column) -> Column:
        short = F.ltrim(p["digits"], F.lit("0"))
        return F.struct(p["sign"].alias("sign"), F.rtrim(short, F.lit("0")).alias("digits"), (p["point"] - F.length(p["digits"]) + F.length(short)).alias("point"))

    return let(_printed(text), lambda t: let(parts(t), lambda p: let(trimmed(p), lambda q: body(q["sign"], q["digits"], q["point"]))))


def number_text_column(text: Column) -> Column:
    """number_text() of a Column of JSON numbers as the engine prints them."""

    def plain(sign: Column, digits: Column, point: Column) -> Column:
        n = F.length(digits)
        placed = (
            F.when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )
        return F.when(n == 0, F.lit("0")).otherwise(F.concat(sign, placed))

    return _notation(text, plain)


#: Strings, numbers, and what is between them in JSON text.
_TOKENS = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def variant_text(v: Column) -> Column:
    """Canonical JSON of a VARIANT: keys sorted, numbers outside strings as number_text() writes them. SQL null stays null."""
    text = F.to_json(v)
    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    shortest = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), number_text_column(t)).otherwise(t)), "")
    return F.when(text.rlike(r"[0-9][.eE]|-0"), shortest).otherwise(text)


def is_multiple_column(text: Column, step: int | Decimal) -> Column:
    """is_multiple() of a Column of number texts of at most 38 digits, exactly, for a step of at most 18 digits.

    With x = n * 10 ** e and step = s * 10 ** f: where e >= f, n * 10 ** (e - f) is taken
    modulo s by a table of powers; else s * 10 ** (f - e) has to divide n.
    """
    _, step_digits, f = Decimal(exact(step)).normalize().as_tuple()
    s = int("".join(map(str, step_digits)))
    constants = lambda numbers, kind: F.from_json(F.lit(json.dumps(numbers)), f"array<{kind}>")
    powers = constants([pow(10, k, s) for k in range(MAX_POWER + 1)], "decimal(19,0)")
    steps = [s * 10**k for k in range(39) if s * 10**k < 10**38]
    whole = F.lit(Decimal(s)).cast("decimal(19,0)")

    def divides(_: Column, digits: Column, point: Column) -> Column:
        n = F.when(F.length(digits) == 0, F.lit(0)).otherwise(digits.try_cast("decimal(38,0)"))
        up = point - F.length(digits) - f
        rest = (n % whole).cast("decimal(18,0)") * F.get(powers, F.least(up, F.lit(MAX_POWER)))
        down = F.get(constants(steps, "decimal(38,0)"), -up)
        return F.when(n == 0, F.lit(True)).when(up >= 0, rest % whole == 0).when(-up >= len(steps), F.lit(False)).otherwise(n % down == 0)

    return _notation(text, divides)


#: Powers of ten between a step and a double.
MAX_POWER = 700
