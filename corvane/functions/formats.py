"""The 19 string formats: exact checks in Python, and Columns built from engine functions where they can say the same.

COLUMNS gives a Column for a text Column, true where the format holds. Formats whose
rules need a parser (internationalised names, mailboxes, regex) run the
Python check in an Arrow UDF, behind a cheap test where there is one.
"""

from __future__ import annotations

import calendar
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
TIME = r"([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?(?:[zZ]|([+-])([0-9]{2}):([0-9]{2}))"
DURATION = r"P(?:[0-9]+W|(?=[0-9T])(?:[0-9]+Y(?:[0-9]+M(?:[0-9]+D)?)?|[0-9]+M(?:[0-9]+D)?|[0-9]+D)?(?:T(?:[0-9]+H(?:[0-9]+M(?:[0-9]+S)?)?|[0-9]+M(?:[0-9]+S)?|[0-9]+S))?)"
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"


def _ipv6() -> str:
    """The grammar of IPv6 addresses: eight groups, or fewer around one double colon; the last two may be an IPv4 address."""
    group = "[0-9A-Fa-f]{1,4}"
    last = f"(?:{group}:{group}|{IPV4})"
    some = [f"(?:{group}:){{6}}{last}"]
    for before in range(8):
        head = f"(?:(?:{group}:){{0,{before - 1}}}{group})?" if before else ""
        tail = {6: group, 7: ""}.get(before, f"(?:{group}:){{{5 - before}}}{last}")
        some.append(f"{head}::{tail}")
    return f"(?:{'|'.join(some)})"


IPV6 = _ipv6()
POINTER = r"(?:/(?:[^/~]|~[01])*)*"
RELATIVE_POINTER = rf"(?:0|[1-9][0-9]*)(?:#|{POINTER})"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"

_HEX = "%[0-9A-Fa-f]{2}"
_UCS = "\\u00A0-\\uD7FF\\uF900-\\uFDCF\\uFDF0-\\uFFEF\\U00010000-\\U000EFFFD"


def _uri(other: str, private: str, scheme: bool) -> str:
    """The grammar of RFC 3986; with other and private characters, of RFC 3987. Groups: none."""
    plain = r"A-Za-z0-9\-._~" + other
    sub = "!$&'()*+,;="
    pchar = f"(?:[{plain}{sub}:@]|{_HEX})"
    segment, first = f"{pchar}*", f"{pchar}+"
    host = rf"(?:\[(?:{IPV6}|[vV][0-9A-Fa-f]+\.[{plain}{sub}:]+)\]|(?:[{plain}{sub}]|{_HEX})*)"
    authority = f"(?:(?:[{plain}{sub}:]|{_HEX})*@)?{host}(?::[0-9]*)?"
    tail = rf"(?:\?(?:{pchar}|[/?{private}])*)?(?:#(?:{pchar}|[/?])*)?"
    hier = f"(?://{authority}(?:/{segment})*|/(?:{first}(?:/{segment})*)?|{first}(?:/{segment})*|)"
    full = f"[A-Za-z][A-Za-z0-9+.\\-]*:{hier}{tail}"
    if scheme:
        return full
    no_colon = f"(?:[{plain}{sub}@]|{_HEX})+"
    relative = f"(?://{authority}(?:/{segment})*|/(?:{first}(?:/{segment})*)?|{no_colon}(?:/{segment})*|){tail}"
    return f"(?:{full}|{relative})"


URI, URI_REFERENCE = _uri("", "", True), _uri("", "", False)
IRI, IRI_REFERENCE = _uri(_UCS, "\\uE000-\\uF8FF\\U000F0000-\\U0010FFFD", True), _uri(_UCS, "\\uE000-\\uF8FF\\U000F0000-\\U0010FFFD", False)
_VARNAME = f"(?:[A-Za-z0-9_]|{_HEX})(?:\\.?(?:[A-Za-z0-9_]|{_HEX}))*"
_VARSPEC = rf"{_VARNAME}(?:\*|:[1-9][0-9]{{0,3}})?"
_LITERAL = f"(?:[\\x21\\x23\\x24\\x26-\\x3B\\x3D\\x3F-\\x5B\\x5D\\x5F\\x61-\\x7A\\x7E{_UCS}\\uE000-\\uF8FF\\U000F0000-\\U0010FFFD]|{_HEX})"
URI_TEMPLATE = rf"(?:{_LITERAL}|\{{[+#./;?&=,!@|]?{_VARSPEC}(?:,{_VARSPEC})*\}})*"


def _full(pattern: str) -> Callable[[str], bool]:
    compiled = re.compile(pattern)
    return lambda s: compiled.fullmatch(s) is not None


def check_date(s: str) -> bool:
    m = re.fullmatch(DATE, s)
    if not m:
        return False
    y, mo, d = map(int, m.groups())
    return 1 <= mo <= 12 and 1 <= d <= (calendar.monthrange(y or 4, mo)[1])


def check_time(s: str) -> bool:
    m = re.fullmatch(TIME, s)
    if not m:
        return False
    h, mi, sec = int(m[1]), int(m[2]), int(m[3])
    oh, om = int(m[5] or 0), int(m[6] or 0)
    if h > 23 or mi > 59 or sec > 60 or oh > 23 or om > 59:
        return False
    minute = (h * 60 + mi - (-1 if m[4] == "-" else 1) * (oh * 60 + om)) % 1440
    return sec < 60 or minute == 1439


def check_date_time(s: str) -> bool:
    return len(s) > 11 and s[10] in "tT" and check_date(s[:10]) and check_time(s[11:])


check_ipv6 = _full(IPV6)


def check_ascii_host(s: str, numeric_top: bool = False, last_dot: bool = True) -> bool:
    """LDH labels of at most 63, 253 in all; A-labels decode. A last dot after two labels or more, and an all-digit last label, where asked for."""
    labels = s.split(".")
    if last_dot and len(labels) > 2 and labels[-1] == "":
        labels = labels[:-1]
    if len(".".join(labels)) > 253 or not all(re.fullmatch(LABEL, x) for x in labels):
        return False
    if not numeric_top and labels[-1].isdigit():
        return False
    return all(check_a_label(x) for x in labels if x[:4].lower() == "xn--")


def check_a_label(label: str) -> bool:
    """An xn-- label that decodes to a label which encodes to it again."""
    try:
        text = label[4:].encode("ascii").decode("punycode")
        return not text.isascii() and check_u_label(text) and text.encode("punycode").decode("ascii").lower() == label[4:].lower()
    except (UnicodeError, ValueError):
        return False


#: Code points that IDNA 2008 allows by context only (fixed values).
_GREEK, _HEBREW = re.compile("[\\u0370-\\u03FF\\u1F00-\\u1FFF]"), re.compile("[\\u0591-\\u05F4\\uFB1D-\\uFB4F]")
_KANA_HAN = re.compile("[\\u3041-\\u309F\\u30A1-\\u30FA\\u30FC-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\U00020000-\\U0002FA1F\\u3005\\u3007]")
_ALLOWED_ANYWAY = set("ßς་・〇") | {"۽", "۾"}
_NEVER = {"ـ", "ߺ", "〮", "〯", "〱", "〲", "〳", "〴", "〵", "〻"}


def check_u_label(label: str) -> bool:
    """A label of IDNA 2008: normalised, allowed letters, digits and marks, no first mark, joiners and other signs in their contexts."""
    if not label or unicodedata.normalize("NFC", label) != label or label[:1] == "-" or label[-1:] == "-" or label[2:4] == "--":
        return False
    if unicodedata.category(label[0]).startswith("M"):
        return False
    digits = {0x0660: False, 0x06F0: False}
    for i, c in enumerate(label):
        before, after = label[i - 1] if i else "", label[i + 1] if i + 1 < len(label) else ""
        if c in "‌‍":
            joined = before and unicodedata.combining(before) == 9
            if not joined and not (c == "‌" and re.search("[\\u0620-\\u06D3].*", label[:i]) and re.match("[\\u0620-\\u06D3]", after)):
                return False
        elif c == "·":
            if before != "l" or after != "l":
                return False
        elif c == "͵":
            if not _GREEK.match(after):
                return False
        elif c in "׳״":
            if not _HEBREW.match(before):
                return False
        elif c == "・":
            if not _KANA_HAN.search(label):
                return False
        elif "٠" <= c <= "٩" or "۰" <= c <= "۹":
            digits[0x0660 if c <= "٩" else 0x06F0] = True
        elif c in _NEVER:
            return False
        elif c not in _ALLOWED_ANYWAY:
            if c.isascii():
                if not (c.isdigit() or c == "-" or "a" <= c.lower() <= "z"):
                    return False
            elif unicodedata.category(c) not in ("Ll", "Lo", "Lm", "Mn", "Mc", "Nd") or unicodedata.normalize("NFKC", c.casefold()) != c:
                return False
    return not all(digits.values())


def check_idn_host(s: str, numeric_top: bool = False, last_dot: bool = True, plain_labels: bool = False) -> bool:
    """Labels of IDNA 2008, 253 octets in all; plain_labels holds ASCII labels without the ACE prefix to the LDH rule alone."""
    labels = re.split("[.。．｡]", s)
    if last_dot and len(labels) > 2 and labels[-1] == "":
        labels = labels[:-1]
    coded = []
    for x in labels:
        if x.isascii():
            is_a_label = x[:4].lower() == "xn--"
            if not re.fullmatch(LABEL, x) or (is_a_label and not check_a_label(x)) or (x[2:4] == "--" and not is_a_label and not plain_labels):
                return False
            coded.append(x)
        else:
            mapped = unicodedata.normalize("NFKC", x.lower())
            if mapped.isascii() and re.fullmatch(LABEL, mapped):
                coded.append(mapped)
                continue
            if not check_u_label(unicodedata.normalize("NFC", x.lower())):
                return False
            coded.append("xn--" + x.lower().encode("punycode").decode("ascii"))
    if not numeric_top and coded[-1].isdigit():
        return False
    return all(0 < len(x) <= 63 for x in coded) and len(".".join(coded)) <= 253


_ATEXT = "[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
_ATEXT_UTF8 = "(?:[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]|[^\\x00-\\x7F])"


def _mailbox(s: str, atom: str, host: Callable[[str], bool], other: str) -> bool:
    m = re.fullmatch(rf'({atom}+(?:\.{atom}+)*|"(?:[\x20\x21\x23-\x5B\x5D-\x7E{other}]|\\[\x20-\x7E])*")@(.+)', s, re.DOTALL)
    if not m or len(m[1].encode()) > 64 or len(s.encode()) > 254:
        return False
    domain = m[2]
    if domain.startswith("[") and domain.endswith("]"):
        inside = domain[1:-1]
        if inside[:5].lower() == "ipv6:":
            return check_ipv6(inside[5:])
        return re.fullmatch(IPV4, inside) is not None
    return host(domain)


def check_email(s: str) -> bool:
    return s.isascii() and _mailbox(s, _ATEXT, lambda d: check_ascii_host(d, numeric_top=True, last_dot=False), "")


def check_idn_email(s: str) -> bool:
    return _mailbox(s, _ATEXT_UTF8, lambda d: check_idn_host(d, numeric_top=True, last_dot=False, plain_labels=True), "\\u0080-\\U0010FFFF")


def check_regex(s: str) -> bool:
    """Whether the text has the structure of an ECMA-262 pattern; escapes of the compatibility annex pass."""
    depth, i, n, repeatable = 0, 0, len(s), False
    while i < n:
        c = s[i]
        if c == "\\":
            if i + 1 >= n:
                return False
            e = s[i + 1]
            if e in "aZzAG" or (e in "pP" and s[i + 2 : i + 3] == "{" and "}" not in s[i:]):
                return False
            i, repeatable = i + 2, True
        elif c == "[":
            i += 1
            while i < n and s[i] != "]":
                i += 2 if s[i] == "\\" else 1
            if i >= n:
                return False
            i, repeatable = i + 1, True
        elif c == "(":
            if s.startswith("(?", i):
                m = re.match(r"\(\?(?::|=|!|<=|<!|<[A-Za-z_$][\w$]*>)", s[i:])
                if not m:
                    return False
                i += m.end()
            else:
                i += 1
            depth, repeatable = depth + 1, False
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
            i, repeatable = i + 1, True
        elif c in "*+?":
            if not repeatable:
                return False
            i, repeatable = i + 1, False
            if i < n and s[i] == "?":
                i += 1
        elif c == "{":
            m = re.match(r"\{(\d+)(?:,(\d*))?\}", s[i:])
            if m:
                if not repeatable or (m[2] and int(m[2]) < int(m[1])):
                    return False
                i, repeatable = i + m.end(), False
                if i < n and s[i] == "?":
                    i += 1
            else:
                i, repeatable = i + 1, True
        else:
            repeatable = c not in "|^$"
            i += 1
    return depth == 0


CHECKS: dict[str, Callable[[str], bool]] = {
    "date-time": check_date_time, "date": check_date, "time": check_time, "duration": _full(DURATION), "email": check_email, "idn-email": check_idn_email, "hostname": check_ascii_host, "idn-hostname": check_idn_host,
    "uri": _full(URI), "uri-reference": _full(URI_REFERENCE), "iri": _full(IRI), "iri-reference": _full(IRI_REFERENCE), "uri-template": _full(URI_TEMPLATE), "uuid": _full(UUID),
    "ipv4": _full(IPV4), "ipv6": check_ipv6, "json-pointer": _full(POINTER), "relative-json-pointer": _full(RELATIVE_POINTER), "regex": check_regex,
}


def _java(pattern: str) -> str:
    """A pattern of this module in Java's notation, anchored."""
    pattern = re.sub(r"\\U([0-9A-F]{8})", lambda m: f"\\x{{{m[1].lstrip('0')}}}", pattern)
    return rf"\A(?:{pattern})\z"


def _number(s: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(s, pattern, group).try_cast("int"), F.lit(0))


def date_column(s: Column) -> Column:
    y, m, d = (_number(s, _java(DATE), g) for g in (1, 2, 3))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return s.rlike(_java(DATE)) & m.between(1, 12) & d.between(1, last)


def time_column(s: Column) -> Column:
    h, m, sec, oh, om = (_number(s, _java(TIME), g) for g in (1, 2, 3, 5, 6))
    sign = F.when(F.regexp_extract(s, _java(TIME), 4) == "-", -1).otherwise(1)
    minute = F.pmod(h * 60 + m - sign * (oh * 60 + om), F.lit(1440))
    return s.rlike(_java(TIME)) & (h <= 23) & (m <= 59) & (oh <= 23) & (om <= 59) & ((sec < 60) | ((sec == 60) & (minute == 1439)))


def date_time_column(s: Column) -> Column:
    return s.substr(11, 1).isin("t", "T") & date_column(s.substr(1, 10)) & time_column(F.substring(s, 12, 2**31 - 1))


def host_column(s: Column) -> Column:
    trimmed = F.when(s.rlike(r"\.[^.]+\.\z"), F.regexp_replace(s, r"\.\z", "")).otherwise(s)
    plain = trimmed.rlike(_java(rf"{LABEL}(?:\.{LABEL})*")) & (F.length(trimmed) <= 253) & ~trimmed.rlike(r"(\A|\.)[0-9]+\z")
    odd = s.rlike("(?i)(^|\\.)xn--")
    return F.when(odd, _guarded(odd, check_ascii_host, s)).otherwise(plain)


def _udf(check: Callable[[str], bool]):
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and check(x)).astype(bool)

    return run


def _guarded(guard: Column, check: Callable[[str], bool], s: Column) -> Column:
    """The check where the guard holds. Python gets all rows of a batch, so the others go as null."""
    return _udf(check)(F.when(guard, s))


COLUMNS: dict[str, Callable[[Column], Column]] = {
    "date-time": date_time_column, "date": date_column, "time": time_column, "hostname": host_column,
    **{name: (lambda p: lambda s: s.rlike(_java(p)))(p) for name, p in (
        ("duration", DURATION), ("uuid", UUID), ("ipv4", IPV4), ("ipv6", IPV6), ("json-pointer", POINTER), ("relative-json-pointer", RELATIVE_POINTER), ("uri-template", URI_TEMPLATE),
        ("uri", URI), ("uri-reference", URI_REFERENCE), ("iri", IRI), ("iri-reference", IRI_REFERENCE),
    )},
    "email": lambda s: _guarded(s.rlike(r"\A[\x00-\x7F]+@[\x00-\x7F]+\z"), check_email, s),
    "idn-email": lambda s: _guarded(s.contains("@"), check_idn_email, s),
    "idn-hostname": lambda s: _udf(check_idn_host)(s), "regex": lambda s: _udf(check_regex)(s),
}


def format_column(name: str, s: Column) -> Column:
    """Whether a text Column holds a format; never null, false for null."""
    return F.coalesce(COLUMNS[name](s), F.lit(False))
