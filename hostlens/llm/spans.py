"""Regular-expression matches with their positions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NEARBY = 60  # code points on either side that a context is taken from
SPAN = "struct<kind:string,rank:int,start:int,end:int,value:string,before:string,after:string>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: a pattern without a quantified group that backtracks (so texts may be of any
    length), a cheap test that every matching text passes, and a test of a match's text."""

    name: str
    pattern: str
    may_hold: Callable[[Column], Column]
    passes: Callable[[Column], Column]
    value: Callable[[Column], Column] = lambda match: match


def matches(text: Column, kind: Kind, rank: int) -> Column:
    """Array of SPAN: leftmost non-overlapping matches that pass, in code points, end exclusive.

    The text is cut at the matches; positions are running sums of the lengths of cuts and matches.
    """
    cuts = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.arrays_zip(cuts.alias("cut"), found.alias("match"), F.slice(cuts, 2, F.size(cuts)).alias("next"))
    empty = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["cut"])
        end = begin + F.length(pair["match"])
        span = F.struct(
            F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), begin.alias("start"), end.alias("end"),
            kind.value(pair["match"]).alias("value"), F.substring(pair["cut"], -NEARBY, NEARBY).alias("before"),
            F.substring(pair["next"], 1, NEARBY).alias("after"),
        ).cast(SPAN)
        out = F.when(kind.passes(pair["match"]), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.when(pair["match"].isNull(), state).otherwise(F.struct(end.alias("at"), out.alias("out")))

    return F.when(kind.may_hold(text), F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(empty)


def count_of(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long")


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    keys = F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    return F.transform(F.array_sort(keys), lambda s: F.struct(s["kind"], s["start"], s["end"]))


def written(spans: Column) -> Column:
    """kind:start:end of each span in order, joined by commas."""
    return F.array_join(
        F.transform(in_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
