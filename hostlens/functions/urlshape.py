"""Shape of a raw URL text and the small value functions of the exploration reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_homepage(url: Column) -> Column:
    """No path (or just `/`), no query and no fragment; a lone `?` or `#` counts as none."""
    return url.rlike(r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)?(//[^/?#]*)?/?\??#?$")


def is_https(url: Column) -> Column:
    return F.lower(url).startswith("https://")


def scheme(url: Column) -> Column:
    """Lowercased scheme before the first colon; NULL when there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit("")))


def starts_with_www(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.lower(rest).startswith("www.")


def class_name(label: Column) -> Column:
    return F.when(label == 1, "phishing").when(label == 0, "legitimate")


def equal_width_bin(p: Column, bins: int = 10) -> Column:
    """Bin of a value in [0, 1]; the last bin is closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def day_index(ts: Column, start: str) -> Column:
    """1 on the start date (UTC session), 2 the day after, ..."""
    return F.datediff(F.to_date(ts), F.lit(start).cast("date")) + 1


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, NULL when y is 0."""
    return x / F.nullif(y, F.lit(0.0))


def md5_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the md5 of the joined parts: the same on any partitioning."""
    return md5_word(*parts) / F.lit(4294967296.0)


def md5_word(*parts, at: int = 0) -> Column:
    """32 bits of the md5 of the joined parts (word 0 to 3 of it), as a non-negative BIGINT."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 8 * at + 1, 8), 16, 10).cast("bigint")
