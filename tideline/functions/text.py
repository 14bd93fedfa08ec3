"""Values out of source columns: numbers in text, flags, keys, codes, pressures written as one text."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """The double that a text writes; NULL if it writes none. '1.0d', 'NaN' and '' write none."""
    t = text.cast("string")
    return F.when(t.rlike(NUMBER), F.trim(t).try_cast("double"))


def whole(text: Column) -> Column:
    """The whole number that a text writes, or NULL."""
    return F.round(number(text), 0).cast("long")


def held_text(text: Column) -> Column:
    """The text, where it is no number."""
    return F.when(number(text).isNull(), text)


def flag(col: Column, yes: Sequence[str], empty: str = "no") -> Column:
    """1 or 0 by a list of values for yes; empty: 'no' gives 0, 'yes' gives 1, 'keep' leaves NULL."""
    out = F.when(col.cast("string").isin(list(yes)), 1)
    if empty == "keep":
        return out.when(col.isNotNull(), 0)
    return out.when(col.isNull() & F.lit(empty == "yes"), 1).otherwise(0)


def scaled(text: Column, factor: float = 1.0, offset: float = 0.0, as_whole: bool = False) -> Column:
    """A number in another unit."""
    out = number(text) * factor + offset
    return F.round(out, 0).cast("long") if as_whole else out


def composite_key(*parts: Column) -> Column:
    """Parts joined by '-'; a missing part is empty but keeps its place."""
    return F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def local_key(salt: str, mapping: str, code: Column) -> Column:
    """An opaque key for a source code: 'k' and 15 hex digits of the SHA-256 of salt, mapping and code as a JSON list; NULL stays NULL.

    The code is written with JSON's escapes, so that quotes and backslashes in it do no harm.
    """
    head = json.dumps([salt or "", mapping], ensure_ascii=False)[:-1]
    text = F.regexp_replace(code.cast("string"), r'(["\\\\])', r"\\$1")
    for c in range(32):
        text = F.replace(text, F.lit(chr(c)), F.lit(json.dumps(chr(c))[1:-1]))
    return F.concat(F.lit("k"), F.substring(F.sha2(F.concat(F.lit(head + ', "'), text, F.lit('"]')), 256), 1, 15))


UNLISTED = "unlisted"


def listed_key(salt: str, mapping: str, code: Column, listed: Sequence[str]) -> Column:
    """The opaque key of a code that the mapping lists, 'unlisted' for any other; NULL stays NULL."""
    text = code.cast("string")
    return F.when(text.isin(list(listed)), local_key(salt, mapping, text)).when(text.isNotNull(), F.lit(UNLISTED))


def closed_kind(code: Column, kinds: Mapping[str, Sequence[str]] | None) -> Column:
    """The kind that lists a code, else 'other'. Without kinds a code is 'other' and NULL stays NULL."""
    if kinds is None:
        return F.when(code.isNotNull(), F.lit("other"))
    out = F
    for kind, codes in kinds.items():
        out = out.when(code.cast("string").isin(list(codes)), F.lit(kind))
    return out.otherwise(F.lit("other")) if kinds else F.lit("other")


def under_one_year(birth: Column, at: Column) -> Column:
    """Whether the first birthday is not reached, by dates written as yyyymmdd; one on 29 February is reached on 1 March."""
    written = lambda d: F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)
    return written(at) - written(birth) < 10000


def pressures(text: Column) -> Column:
    """struct(systolic, diastolic) of '110/70'; the first slash counts, and '110/' has no diastolic."""
    at = F.instr(text, "/")
    left = F.when(at > 0, number(F.substring(text, F.lit(1), at - 1)))
    right = F.when(at > 0, number(F.substring(text, at + 1, F.lit(20))))
    return F.struct(left.alias("systolic"), right.alias("diastolic"))


def cut(text: Column, width: int) -> Column:
    """The first `width` characters."""
    return F.substring(text, 1, width)


def repaired_end(start: Column, end: Column) -> Column:
    """The end, or the start where the end comes before it."""
    return F.when(end >= start, end).otherwise(F.when(end.isNotNull(), start))


def open_end(placed: Column, removed: Column, sentinel_year: int = 2100) -> Column:
    """NULL where the end is a stand-in date far ahead or lies before the start."""
    return F.when((F.year(removed) < sentinel_year) & (removed >= placed), removed)
