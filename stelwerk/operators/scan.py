"""All matches of a pattern with their offsets, without leaving the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters and their boundary as other regex engines have them; Java's own ``\\b`` differs beyond ASCII.
WORD = r"[\p{L}\p{N}_]"
BOUND = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


_FIRST = re.compile(r"\\b(\(?)([A-Za-z]+)(?=[^*+?{A-Za-z])")


def pattern(p: str) -> str:
    """A case-insensitive Unicode pattern with ``\\b`` put right. A boundary before plain letters is looked at behind them: the
    search then goes by the letters and meets the boundary only where they stand."""
    if m := _FIRST.match(p):
        p = f"{m[1]}{m[2]}(?<!{WORD}{m[2]})" + p[m.end() :]
    return "(?iuU)" + p.replace(r"\b", BOUND)


#: Parts of a text that are gone through in one array, so that no array grows part by part beyond it.
CHUNK = 512


def find_all(text: Column, regex: str) -> Column:
    """array<struct<start, end, text>>: the non-overlapping matches from left to right, 0-based half-open offsets.

    Each match is put between two control characters, the text is split at them, and the lengths of the parts are summed
    up, those of long texts by chunks of parts first: the time taken is in proportion to the text. The two characters count
    as spaces where the text itself has them. Null text gives null, no match an empty array; a pattern that matches nothing
    at all must not be used."""
    marked = F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02"))
    clean = F.when(marked, F.translate(text, "\x01\x02", "  ")).otherwise(text)
    parts = F.split(F.regexp_replace(clean, regex, "\x01$0\x02"), "[\x01\x02]", -1)
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        hit = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("text"))
        return F.struct(end.alias("at"), (~acc["is_match"]).alias("is_match"), F.when(acc["is_match"], F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    def found(some: Column, base: Column) -> Column:
        begin = F.struct(base.alias("at"), F.lit(False).alias("is_match"), empty.alias("found"))
        return F.aggregate(some, begin, step, lambda acc: acc["found"])

    def by_chunks(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x)))
        bases = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(sizes)), found))

    few = F.when(F.size(parts) <= CHUNK, found(parts, F.lit(0)))
    return F.when(F.size(parts) > 1, few.otherwise(by_chunks(parts))).when(text.isNotNull(), empty)
