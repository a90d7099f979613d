"""Native helpers for spans of a text: DataFrame functions only, offsets in code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(x) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Sums of the lengths before each place of an array of ints, in blocks, so that long arrays stay cheap."""
    size = 64
    blocks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / size).cast("int")), lambda b: F.slice(lengths, b * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))

    def scan(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, state, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def of_blocks(bs: Column) -> Column:
        return let(scan(F.transform(bs, total), F.lit(0)), lambda starts: F.flatten(F.zip_with(bs, starts, scan)))

    return let(blocks, of_blocks)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, match, part>>: leftmost non-overlapping matches; part is the group.

    Both functions find by the same engine from left to right; split() gives what stands between the matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("found"), part.alias("parts"))

    def place(x: Column) -> Column:
        gaps = F.transform(F.slice(x["gaps"], 1, F.size(x["found"])), lambda g: F.char_length(g))
        steps = F.zip_with(gaps, F.transform(x["found"], lambda m: F.char_length(m)), lambda g, m: g + m)
        starts = F.zip_with(running(steps), gaps, lambda s, g: s + g)
        return F.transform(F.arrays_zip(starts.alias("s"), x["found"].alias("m"), x["parts"].alias("p")), lambda z: F.struct(z["s"].alias("start"), (z["s"] + F.char_length(z["m"])).alias("end"), z["m"].alias("match"), z["p"].alias("part")))

    return F.when(text.rlike(pattern), let(found, place)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,part:string>>"))


def spans(found: Column, rank: int) -> Column:
    """Of matches: array<struct<start, rank, end>>, which sorts by start, then kind."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def listing(sorted_spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(sorted_spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
