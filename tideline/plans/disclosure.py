"""Two ways to protect counts that leave the system; they are not to be mixed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blanked(df: DataFrame, counts: Sequence[str], most: int = 4) -> DataFrame:
    """Counts from 1 to `most` become NULL; 0 and larger ones stay."""
    return df.withColumns({c: F.when(F.col(c).between(1, most), None).otherwise(F.col(c)) for c in counts})


def floored(df: DataFrame, group: str, figures: Sequence[str] = (), step: int = 10, blank_small: bool = True) -> DataFrame:
    """Groups under `step` go; counts are cut down to a multiple of it. A figure under `step` in a kept group is NULL, or floored if not blank_small."""
    down = lambda c: F.col(c) - F.col(c) % step
    small = lambda c: F.when(F.col(c) >= step, down(c)) if blank_small else down(c)
    return df.where(F.col(group) >= step).withColumns({group: down(group)} | {c: small(c) for c in figures})


# Parts of names of columns whose values are never listed
NEVER_LISTED = ("NAME", "COMMENT", "ADDR", "TEXT", "NOTE", "DESC", "EMAIL", "PHONE")


# Types of short text and of whole numbers
SHORT_TEXT = ("CHAR", "VARCHAR", "NCHAR", "NVARCHAR")
WHOLE = ("TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT", "BIT")
SCALED = ("DECIMAL", "NUMERIC")


def listable(columns: Sequence[tuple[str, str]], private: Sequence[str] = NEVER_LISTED, longest: int = 70) -> list[str]:
    """Names of columns (name, type) whose values may be listed: whole numbers and text of a stated length up to `longest`, and none named like free text or persons.

    A type is written as in a catalogue, such as VARCHAR(20) or DECIMAL(9,0). Text of no stated length or MAX, and every other type, is not listed.
    """

    def short(kind: str) -> bool:
        m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\w+)\s*(?:,\s*(\d+)\s*)?\))?\s*", kind.upper())
        if not m:
            return False
        base, size, scale = m[1], m[2], m[3]
        if base in SHORT_TEXT:
            return bool(size) and size.isdigit() and 0 < int(size) <= longest
        return base in WHOLE or (base in SCALED and int(scale or 0) == 0)

    return [name for name, kind in columns if not any(p in name.upper() for p in private) and short(kind)]
