"""Decision rule, signals and the scoring answer of one request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens.functions.lists import SIGNALS


def decision(probability: Column, free_hosting: Column, threshold) -> Column:
    """safe below the threshold; at or above it review on free hosting, else phishing."""
    return (
        F.when(probability < threshold, "safe")
        .when(free_hosting == 1, "review")
        .otherwise("phishing")
    )


def signals() -> Column:
    """Texts of the features that fired, in fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(f) > 0, text) for f, text in SIGNALS]))


def request_id(*keys: str) -> Column:
    """Random id, or one derived from source keys so that a replay gives the same id."""
    if not keys:
        return F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def rounded(probability: Column) -> Column:
    return F.round(probability, 4)
