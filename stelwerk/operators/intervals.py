"""Continuous periods and gaps from overlapping validity intervals.

Days are numbered from 0001-01-01. The days 0 .. 2**22 - 1 are the leaves of a binary tree whose nodes bear
heap numbers: the root is 1, the children of ``n`` are ``2n`` and ``2n + 1``, the leaf of day ``d`` is
``2**22 + d``. An interval is the disjoint union of at most 44 nodes, its canonical dyadic blocks. Blocks repeat
a lot between overlapping intervals, so their distinct set per entity, built by map-side partial aggregation, is
bounded by the calendar and not by the rows: a law with a third of all rows sends each block once per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Height of the tree: 2**22 days from 0001-01-01 reach beyond 9999-12-31.
HEIGHT = 22
#: Blocks below this level are merged per stretch of 2**SEGMENT days (eleven years): at most 8,191 blocks a group.
SEGMENT = 12
#: 0001-01-01 as days before 1970-01-01.
EPOCH = 719162

_DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{8}"


def tidy(c: Column) -> Column:
    """Without white space of any kind and invisible format characters at the ends."""
    plain = c.rlike(r"^(?:[!-~](?:[ -~]*[!-~])?)?$")
    return F.when(plain, c).otherwise(F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))


def parse_day(c: Column) -> Column:
    """A date in one of the notations yyyy-MM-dd, dd-MM-yyyy and yyyyMMdd (separators ``-``, ``/`` or ``.``, an
    optional time or zone after it); null for null, blank, other text and days that don't exist."""
    # Most dates are plain already and pay for one pattern only.
    plain = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(plain, F.when(F.substring(c, 1, 4) != "0000", c.try_cast("date"))).otherwise(_other_day(F.when(~plain, c)))


def _other_day(c: Column) -> Column:
    s = F.regexp_replace(tidy(c), rf"^({_DATE})(?:[T ].*|Z|[+-]\d{{2}}:?\d{{2}})$", "$1")
    s = F.regexp_replace(s, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1")
    s = F.regexp_replace(s, r"^(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})$", "$1-$2-$3")
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & (F.substring(s, 1, 4) != "0000"), s.try_cast("date"))


def dyadic_blocks(intervals: DataFrame) -> DataFrame:
    """``key, level, block``: the heap numbers of the canonical blocks of each half-open day range [s, e).

    At level k the left end rounds up to ``lo`` and the right end down to ``hi``; ``lo`` is a block if it is a right
    child, ``hi - 1`` if it is a left one, both only while ``lo < hi``, so on no level whose blocks are longer than the range.
    Each level is a row, and plain arithmetic on it: no arrays are built but the two candidates."""
    levels = intervals.select("key", "s", "e", F.explode(F.expr("sequence(0, length(bin(e - s)) - 1)")).alias("level"))
    at = levels.select("key", "level", F.expr("shiftright(s + shiftleft(1, level) - 1, level)").alias("lo"), F.expr("shiftright(e, level)").alias("hi"), F.expr(f"shiftleft(1, {HEIGHT} - level)").alias("top")).where("lo < hi")
    both = at.select("key", "level", F.explode(F.expr("array(if((lo & 1) = 1, top + lo, 0), if((hi & 1) = 1, top + hi - 1, 0))")).alias("block"))
    return both.where("block > 0")


def block_runs(blocks) -> list[tuple[int, int]]:
    """Half-open day ranges covered by the blocks, sorted, apart from each other: blocks under a block that is there
    go, pairs of siblings become their parent, level by level, and neighbours in the order of days are joined."""
    own: set[int] = set()
    for b in sorted(int(x) for x in blocks):  # a block's ancestors have smaller numbers
        a = b >> 1
        while a and a not in own:
            a >>= 1
        if not a:
            own.add(b)
    by_level: dict[int, set[int]] = {}
    for b in own:
        by_level.setdefault(b.bit_length(), set()).add(b)
    done: list[tuple[int, int]] = []
    for bits in range(HEIGHT + 1, 0, -1):
        here = by_level.pop(bits, set())
        for b in here:
            if b ^ 1 in here and b > 1:
                by_level.setdefault(bits - 1, set()).add(b >> 1)
            else:
                k = HEIGHT + 1 - bits
                i = b - (1 << (bits - 1))
                done.append((i << k, (i + 1) << k))
    runs: list[tuple[int, int]] = []
    for s, e in sorted(done):
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        else:
            runs.append((s, e))
    return runs


@F.pandas_udf(T.ArrayType(T.LongType()))
def _runs(blocks: pd.Series) -> pd.Series:
    return pd.Series([np.array([s << 32 | e for s, e in block_runs(b)], dtype=np.int64) for b in blocks])


def usable_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Distinct ``key, s, e`` (half-open day numbers) of the rows that can be used. The key is tidied and upper-case;
    a null or blank end is 9999-12-31; rows without key or start, with a date that is no day, or reversed, go."""
    blank_end = F.col(end).isNull() | (tidy(F.col(end)) == "")
    rows = df.select(
        F.upper(tidy(F.col(key))).alias("key"),
        (F.unix_date(parse_day(F.col(start))) + EPOCH).alias("s"),
        (F.when(blank_end, F.unix_date(F.lit("9999-12-31").cast("date"))).otherwise(F.unix_date(parse_day(F.col(end)))) + EPOCH + 1).alias("e"),
    )
    return rows.where((F.col("key") != "") & (F.col("s") < F.col("e"))).distinct()


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """``key, s, e``: the longest covered ranges of each key. Input: ``key, s, e`` half-open, 0 <= s < e.

    Blocks of SEGMENT levels and more are one group per key (at most 2,047 blocks), lower ones a group per key and
    stretch of 2**SEGMENT days. What the groups return is joined over their borders by one window per key, whose
    rows are bounded by the calendar."""
    blocks = dyadic_blocks(intervals)
    part = F.when(F.col("level") >= SEGMENT, F.lit(0)).otherwise(F.expr(f"shiftright(block, {SEGMENT} - level)"))
    sets = blocks.select("key", part.cast("int").alias("part"), F.col("block").cast("int").alias("block")).groupBy("key", "part").agg(F.collect_set("block").alias("blocks"))
    runs = sets.select("key", F.explode(_runs("blocks")).alias("r")).select("key", F.shiftright("r", 32).cast("int").alias("s"), F.col("r").bitwiseAND(0xFFFFFFFF).cast("int").alias("e"))
    by = Window.partitionBy("key").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int"))
    return opened.withColumn("g", F.sum("new").over(by)).groupBy("key", "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("g")


def _day(c: Column) -> Column:
    return F.date_format(F.date_from_unix_date((c - EPOCH).cast("int")), "yyyy-MM-dd")


def periods_and_gaps(df: DataFrame, key: str = "bwb_id", start: str = "geldigheidsperiode_startdatum", end: str = "geldigheidsperiode_einddatum") -> DataFrame:
    """``key, kind, start_date, end_date``: a row of kind ``period`` for each longest stretch of covered days of a key
    and of kind ``gap`` for each stretch of uncovered days between two of them, ends inclusive, ``yyyy-MM-dd``.

    Null, blank, impossible and reversed dates: see usable_intervals. Repeated rows count once, ranges that touch are
    one period, a key without usable rows has no result, an empty table gives no rows; other columns are not read."""
    runs = merge_intervals(usable_intervals(df, key, start, end))
    ahead = runs.withColumn("next", F.lead("s").over(Window.partitionBy("key").orderBy("s")))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("a"), F.col("next").alias("b")),
    )
    rows = ahead.select("key", F.inline(both)).where(F.col("b").isNotNull())
    return rows.select(F.col("key").alias(key), "kind", _day(F.col("a")).alias("start_date"), _day(F.col("b") - 1).alias("end_date"))
