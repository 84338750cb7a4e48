"""Regular expressions of the linear-time dialect, translated for Python and for the engine's Java dialect.

The dialect has no look-around and no back-references; a pattern that uses them, or
that isn't one at all, never matches: validation fails closed.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\t\n\f\r "
_CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": _SPACE}
_ASCII = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t ", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_ESCAPES = {"a": "\\x07", "f": "\\f", "n": "\\n", "r": "\\r", "t": "\\t", "v": "\\x0B"}


class BadPattern(ValueError):
    """Not a pattern of the dialect."""


def _property(text: str, i: int, target: str) -> tuple[str, int]:
    """\\pN or \\p{Name} at i (after the letter p): (name, next place)."""
    if i < len(text) and text[i] == "{":
        end = text.find("}", i)
        if end < 0:
            raise BadPattern(text)
        return text[i + 1 : end], end + 1
    if i >= len(text):
        raise BadPattern(text)
    return text[i], i + 1


def translate(pattern: str, target: str = "java") -> str:
    """The pattern in the dialect of `target` (java or python's regex module); BadPattern if it isn't valid."""
    out, i, n, depth = [], 0, len(pattern), 0

    def escape_at(i: int, inside: bool) -> tuple[str, int]:
        if i >= n:
            raise BadPattern("trailing backslash")
        c = pattern[i]
        if c in _CLASSES:
            return (_CLASSES[c] if inside else f"[{_CLASSES[c]}]"), i + 1
        if c.lower() in _CLASSES:
            if inside:
                return (f"[^{_CLASSES[c.lower()]}]" if target == "java" else f"\\{c}"), i + 1
            return f"[^{_CLASSES[c.lower()]}]", i + 1
        if c in _ESCAPES:
            return _ESCAPES[c], i + 1
        if c in "pP":
            name, after = _property(pattern, i + 1, target)
            negated = (c == "P") != name.startswith("^")
            name = name.lstrip("^")
            if target == "java" and len(name) > 2:
                name = "Is" + name
            return f"\\{'P' if negated else 'p'}{{{name}}}", after
        if c == "x":
            if pattern[i + 1 : i + 2] == "{":
                end = pattern.find("}", i)
                digits = pattern[i + 2 : end]
            else:
                end, digits = i + 2, pattern[i + 1 : i + 3]
            if end < 0 or not re.fullmatch("[0-9A-Fa-f]{1,6}", digits) or int(digits, 16) > 0x10FFFF:
                raise BadPattern("bad \\x")
            return re.escape(chr(int(digits, 16))), end + 1
        if c in "01234567":
            if c != "0" and not (pattern[i + 1 : i + 2].isdigit()):
                raise BadPattern("back-reference")
            digits = re.match("[0-7]{1,3}", pattern[i:])[0]
            return re.escape(chr(int(digits, 8))), i + len(digits)
        if not inside and c in "AzbB":
            edge = {"A": r"\A", "z": r"\z" if target == "java" else r"\Z"}
            ascii_word = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
            return edge.get(c) or (ascii_word if c == "b" else f"(?!{ascii_word})"), i + 1
        if c == "Q" and not inside:
            end = pattern.find("\\E", i)
            end = n if end < 0 else end
            return re.escape(pattern[i + 1 : end]), min(n, end + 2)
        if c.isascii() and not c.isalnum():
            return "\\" + c, i + 1
        raise BadPattern(f"unknown escape \\{c}")

    def class_at(i: int) -> tuple[str, int]:
        start = i
        got = ["["]
        i += 1
        if pattern[i : i + 1] == "^":
            got.append("^")
            i += 1
        first = True
        while True:
            if i >= n:
                raise BadPattern("open class")
            c = pattern[i]
            if c == "]" and not first:
                return "".join(got) + "]", i + 1
            first = False
            if pattern.startswith("[:", i):
                end = pattern.find(":]", i)
                name = pattern[i + 2 : end]
                if end < 0 or name.lstrip("^") not in _ASCII:
                    raise BadPattern(pattern[start:])
                if name.startswith("^"):
                    got.append(f"[^{_ASCII[name[1:]]}]" if target == "java" else f"[^{_ASCII[name[1:]]}]")
                else:
                    got.append(_ASCII[name])
                i = end + 2
            elif c == "\\":
                part, i = escape_at(i + 1, True)
                got.append(part)
            else:
                got.append("\\" + c if c in "[]&~#" or (c == "-" and False) else c)
                i += 1

    while i < n:
        c = pattern[i]
        if c == "\\":
            part, i = escape_at(i + 1, False)
            out.append(part)
        elif c == "[":
            part, i = class_at(i)
            out.append(part)
        elif c == "(":
            if pattern.startswith("(?", i):
                m = re.match(r"\(\?(P?<(?P<name>[A-Za-z_]\w*)>|(?P<flags>[imsU]*(-[imsU]+)?)(?P<end>[:)]))", pattern[i:])
                if not m or (m["flags"] == "" and m["end"] == ")") or "U" in (m["flags"] or ""):
                    raise BadPattern("look-around")
                if m["name"]:
                    out.append("(")
                    depth += 1
                else:
                    out.append(f"(?{m['flags']}{m['end']}")
                    depth += m["end"] == ":"
                i += m.end()
            else:
                out.append("(")
                depth += 1
                i += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise BadPattern("unopened group")
            out.append(c)
            i += 1
        elif c == "$":
            out.append(r"\z" if target == "java" else r"\Z")
            i += 1
        elif c == "." and target == "java":
            out.append(r"[^\n]")
            i += 1
        elif c == "{":
            m = re.match(r"\{(\d+)(,(\d*))?\}", pattern[i:])
            if m and (int(m[1]) > 1000 or (m[3] and (int(m[3]) > 1000 or int(m[3]) < int(m[1])))):
                raise BadPattern("bad repeat")
            out.append(m[0] if m else r"\{")
            i += m.end() if m else 1
            if m and i < n and pattern[i] in "*+{" and re.match(r"[*+]|\{\d", pattern[i:]):
                raise BadPattern("repeat of a repeat")
        elif c in "*+?":
            if not out or (i and pattern[i - 1] in "(|" and (i < 2 or pattern[i - 2] != "\\")):
                raise BadPattern("nothing to repeat")
            out.append(c)
            i += 1
            if i < n and pattern[i] in "*+" or (i + 1 < n and pattern[i] == "?" and pattern[i + 1] in "*+?"):
                raise BadPattern("repeat of a repeat")
        elif c == "}":
            out.append(r"\}")
            i += 1
        else:
            out.append(c)
            i += 1
    if depth:
        raise BadPattern("open group")
    return "".join(out)


@cache
def _compiled(pattern: str):
    try:
        import regex

        return regex.compile(translate(pattern, "python"), regex.V1)
    except Exception:
        return None


def search(pattern: str, text: str) -> bool:
    """Whether the pattern matches anywhere; False for what is no pattern."""
    compiled = _compiled(pattern)
    return compiled is not None and compiled.search(text) is not None


@cache
def java_pattern(pattern: str) -> str | None:
    """The pattern for rlike(), None if it is no pattern of the dialect."""
    try:
        return translate(pattern, "java") if _compiled(pattern) is not None else None
    except BadPattern:
        return None


def search_column(pattern: str, text: Column) -> Column:
    """search() as a Column."""
    java = java_pattern(pattern)
    return F.lit(False) if java is None else text.rlike(java)
