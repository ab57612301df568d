"""Places of pattern matches in a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: Column, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    ``value`` is the match or its group. The stretches between the matches give their places.
    """
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(group)) if group else hits
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.char_length(part["between"])
        end = begin + F.char_length(part["hit"])
        found = F.struct(begin.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, F.lit(-1)), F.lit(1), F.size(hits)).alias("between"),
        hits.alias("hit"),
        values.alias("value"),
    )
    return F.aggregate(parts, start, step, lambda state: state["out"])


def gated(gate: Column, found: Column) -> Column:
    """``found`` where the gate holds, else no matches: most texts have none."""
    return F.when(gate, found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
