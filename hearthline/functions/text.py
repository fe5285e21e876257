"""Text and number parsing as Column functions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose into a base letter and combining marks, and their base letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(0x300 <= ord(m) <= 0x36F for m in marks):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: White space of Unicode but the plain space, and the byte order mark; a single plain space needs no replacing.
_SPACES = r"\t-\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def norm(s: Column) -> Column:
    """Without accents, lower-cased, white space collapsed and trimmed; '' for null."""
    letters, bases = _accents()
    text = F.coalesce(s, F.lit(""))
    ascii_ = F.octet_length(text) == F.char_length(text)  # such a text has no accents
    plain = F.when(ascii_, text).otherwise(F.regexp_replace(F.translate(text, letters, bases), "[̀-ͯ]", ""))
    return F.btrim(F.regexp_replace(F.lower(plain), f"[{_SPACES}][ {_SPACES}]*| [ {_SPACES}]+", " "))


def norm_text(s: str | None) -> str:
    """norm() of a Python string, for parameters."""
    plain = "".join(c for c in unicodedata.normalize("NFD", s or "") if not 0x300 <= ord(c) <= 0x36F)
    return " ".join(plain.lower().replace("﻿", " ").split())


def title_case(s: Column) -> Column:
    """Every word's first letter in upper case, the rest in lower case; '' for null."""
    parts = F.split(F.lower(F.btrim(F.coalesce(s, F.lit("")))), r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def positive(n: Column) -> Column:
    return F.when((n > 0) & (n < float("inf")), n)


def price(s: Column) -> Column:
    """Pesos from text: all its digits as one number; null if none or zero."""
    return positive(F.regexp_replace(s, "[^0-9]", "").try_cast("double"))


def area(s: Column) -> Column:
    """The first number of a text, with a comma or a dot before its decimals; null if none or zero."""
    return positive(F.replace(F.regexp_extract(s, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double"))


def first_int(s: Column) -> Column:
    """The first whole number of a text, signed."""
    return F.regexp_extract(s, r"-?\d+", 0).try_cast("int")


def round_half_up(n: Column, digits: int = 0) -> Column:
    """Rounded, halves towards plus infinity."""
    k = float(10**digits)
    return F.floor(n * k + 0.5) / k


def phone(s: Column) -> Column:
    """The first mobile number (3xx), else the first landline number (60x), without separators."""
    country = r"(?:\+?57[\s-]?)?"
    mobile = F.regexp_extract(s, country + r"(3\d{2}[\s-]?\d{3}[\s-]?\d{4})", 1)
    landline = F.regexp_extract(s, country + r"(60[\s-]?\d[\s-]?\d{3}[\s-]?\d{4})", 1)
    return F.regexp_replace(F.coalesce(F.nullif(mobile, F.lit("")), F.nullif(landline, F.lit(""))), r"[\s-]", "")


def overlaps(a: Column, b: Column) -> Column:
    """Whether either normalised text holds the other; false if one is empty."""
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def whole(n: Column, least: int) -> Column:
    """Text or number as an int of at least `least`, else null."""
    v = n.try_cast("double")
    return F.when((v >= least) & (v == F.floor(v)) & (v < 2**31), v.cast("int"))


def estrato(n: Column) -> Column:
    v = n.try_cast("double")
    return F.when(v.between(1, 6) & (v == F.floor(v)), v.cast("int"))


def number(n: Column) -> Column:
    """A finite number from text or number, else null."""
    v = n.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
