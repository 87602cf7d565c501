"""Matches with positions, and choice among them by nearness to anchor words. All inside Columns."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


BUILT: dict[tuple, tuple] = {}
#: Characters of the private use area.
CUT, MID = "\ue000", "\ue001"


def once(key: tuple, build):
    """What ``build`` gives, built once for a JVM and key: Columns by name do not depend on the rows, and putting some thousands of their
    nodes together is the driver's work of seconds. The key must tell everything that the Columns depend on."""
    jvm = SparkContext._active_spark_context._jvm
    key = (id(jvm), *key)
    if key not in BUILT:
        if len(BUILT) >= 256:  # keys hold job configurations, of which there may be many
            BUILT.clear()
        BUILT[key] = (jvm, build())  # the JVM is held, so that its id stays its own
    return BUILT[key][1]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def find_all(c: Column | str, pattern: str, index: int = 0) -> Column:
    """array<struct<pos, value>> of every match (positions from 0); value is the given group.

    One pass of the pattern: every match is put between characters that the text does not hold, which tell it from the text between
    matches, so the lengths of what stands before give exact positions without a UDF.
    """
    x = F.replace(F.replace(text(c), F.lit(CUT), F.lit(" ")), F.lit(MID), F.lit(" "))
    parts = F.split(F.regexp_replace(x, pattern, f"{CUT}$0{MID}${index}{CUT}"), CUT, -1)  # between, match, between, match, between
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,value:string>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        own = F.instr(part, MID)
        found = F.concat(s["found"], F.array(F.struct(s["at"].alias("pos"), F.substring(part, own + 1, F.length(part)).alias("value"))))
        return F.struct((s["at"] + F.when(own > 0, own - 1).otherwise(F.length(part))).alias("at"), F.when(own > 0, found).otherwise(s["found"]).alias("found"))

    return F.when(text(c).rlike(pattern), F.aggregate(parts, start, step, lambda s: s["found"])).otherwise(F.array().cast("array<struct<pos:int,value:string>>"))


def literal_positions(low: Column, word: str) -> Column:
    """Positions of a word in a lower-cased text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + F.length(part)
        return F.struct((at + len(word)).alias("at"), F.concat(s["found"], F.array(at)).alias("found"))

    ahead = F.split(F.replace(low, F.lit(word), F.lit(CUT)), CUT, -1)
    return F.when(low.contains(word), F.aggregate(F.slice(ahead, 1, F.size(ahead) - 1), start, step, lambda s: s["found"])).otherwise(F.array().cast("array<int>"))


def keyword_positions(c: Column | str, words: list[str]) -> Column:
    """Positions (from 0) of every occurrence of every word, case ignored, overlaps included, in order.

    Words are searched one by one as they stand; those that can overlap themselves by a pattern that looks ahead."""
    low = [w.lower() for w in words]
    itself = [w for w in low if any(w.startswith(w[i:]) for i in range(1, len(w)))]

    def every(x: Column) -> Column:
        found = [literal_positions(x, w) for w in low if w not in itself]
        if itself:
            quoted = "|".join("".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch for ch in w) for w in itself)
            found.append(F.transform(find_all(x, f"(?={quoted})"), lambda m: m["pos"]))
        return found[0] if len(found) == 1 and not itself else F.sort_array(F.array_distinct(F.concat(*found)))

    return let(F.replace(F.lower(text(c)), F.lit(CUT), F.lit(" ")), every)


def nearest(candidates: Column, anchors: Column, value) -> Column:
    """The candidate nearest to an anchor; equal distances go to the largest ``value(candidate)``; no anchor: all equally far. Anchors are
    looked for only where there is a choice."""
    far = F.lit(10_000_000)

    def best(s: Column) -> Column:
        gap = lambda c: F.coalesce(F.array_min(F.transform(s["a"], lambda a: F.abs(c["pos"] - a))), far)
        return F.array_min(F.transform(s["c"], lambda c: F.struct(gap(c).alias("gap"), (-value(c)).alias("less"), c["value"].alias("value"))))

    return let(candidates, lambda c: F.when(F.size(c) <= 1, F.get(c, 0)["value"]).otherwise(let(F.struct(c.alias("c"), anchors.alias("a")), best)["value"]))


def candidate(kind: str, value: Column) -> Column:
    """A typed candidate: struct<kind, value>; '' and null values count as none."""
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def first_of_kind(found: Column, kind: str) -> Column:
    """The value of the first filled candidate of a kind, null where there is none."""
    return F.get(F.filter(found, lambda c: (c["kind"] == kind) & (c["value"] != "")), 0)["value"]


def first_read(found: Column, kind: str, read) -> Column:
    """read(value) of the first candidate of a kind that can be read."""
    every = F.transform(F.filter(found, lambda c: (c["kind"] == kind) & (c["value"] != "")), lambda c: read(c["value"]))
    return F.get(F.filter(every, lambda v: v.isNotNull()), 0)
