"""Pattern matches with their places, from built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (value, start, stop, before, after), places in code points, stop exclusive.

    The text between the matches is what splitting by the pattern leaves, so running lengths give the places;
    before and after are up to ``context`` characters of it.  Null for a null text.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    if context:
        pairs = F.zip_with(pairs, F.slice(gaps, 2, F.greatest(F.size(values), F.lit(0))), lambda p, g: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), F.substring(g, 1, context).alias("after")))
    empty = "array<struct<value:string,start:int,stop:int,before:string,after:string>>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        before = F.right(x["gap"], F.lit(context)) if context else F.lit("")
        own = F.struct(x["value"].alias("value"), start.alias("start"), stop.alias("stop"), before.alias("before"), (x["after"] if context else F.lit("")).alias("after"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(own)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("out"))
    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def row_key(*columns: Column) -> Column:
    """A 64-bit key of a row's columns, nulls told from values."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))
