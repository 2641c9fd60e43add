"""Text sanitising and tolerant JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters removed from text (tab, line feed and carriage return stay).
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def sanitise(text: Column, max_length: int | None = None) -> Column:
    """SCA16: drop control characters, double backslashes, optionally truncate."""
    out = F.replace(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), CONTROL_CHARS, ""), F.lit("\\"), F.lit("\\\\"))
    return F.left(out, F.lit(max_length)) if max_length else out


def parse_id_list(raw: Column) -> Column:
    """SCA19: JSON text to an integer array; null, blank or invalid text gives an empty array."""
    parsed = F.from_json(F.trim(raw), "array<int>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array().cast("array<int>"))
