"""The rows with the largest counts, exactly, without sorting them anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12  # of the count that one pass settles


def largest(rows: DataFrame, size: int, n: str = "n", text: str = "text") -> DataFrame:
    """The `size` rows with the largest `n` (a whole number, 0 or more), ties by `text` ascending (byte order);
    all rows, if fewer. `text` is unique and neither is NULL.

    The cut is found digit by digit: the counts of rows per next BITS bits of `n` (at most 4096), then,
    among the rows that tie at the cut, per next character of `text`. Each pass is one small
    aggregate; the driver only sees its counts. `rows` should be stored, as each pass reads it.
    """
    most, total = rows.agg(F.max(n), F.count(F.lit(1))).first()
    if total <= size:
        return rows
    if size <= 0:
        return rows.where(F.lit(False))
    left, cut = size, 0
    for shift in reversed(range(0, max(int(most).bit_length(), 1), BITS)):
        digit = F.shiftrightunsigned(n, shift).bitwiseAND((1 << BITS) - 1)
        known = F.shiftrightunsigned(n, shift + BITS) == cut if shift + BITS < 63 else F.lit(True)
        counts = _counts(rows.where(known), digit)
        d, left = _pick(sorted(counts.items(), reverse=True), left)
        cut = cut << BITS | d
        tied = counts[d]
    kept = F.col(n) > cut
    if left == tied:
        return rows.where(kept | (F.col(n) == cut))
    return rows.where(kept | ((F.col(n) == cut) & _first(rows.where(F.col(n) == cut), left, text)))


def _first(tied: DataFrame, left: int, text: str) -> Column:
    """Whether a text is among the `left` first of its column."""
    prefix, c = "", F.col(text)
    while True:
        counts = _counts(tied.where(c.startswith(prefix)), F.substring(c, len(prefix) + 1, 1))
        letter, left = _pick(sorted(counts.items()), left)
        prefix += letter
        if not letter:  # the prefix is a whole text
            return c <= prefix
        if left == counts[letter]:
            return (c < prefix) | c.startswith(prefix)


def _counts(rows: DataFrame, key: Column) -> dict:
    return dict(rows.groupBy(key.alias("k")).agg(F.count(F.lit(1))).collect())


def _pick(counts: list[tuple], left: int) -> tuple:
    """The key that holds row number `left` of the keys in order, and its number there."""
    for key, n in counts:
        if left <= n:
            return key, left
        left -= n
    raise ValueError("fewer rows than asked for")
