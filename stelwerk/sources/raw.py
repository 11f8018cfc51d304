"""The landing table of raw records: one row per fetched payload, never changed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "_key string, source string, kind string, external_id string, fetched_at timestamp, payload_json string, payload_text string, meta map<string,string>"


def raw_rows(df: DataFrame, source: str | Column, kind: str | Column, external_id: Column | None = None, payload_json: Column | None = None, payload_text: Column | None = None, meta: Column | None = None, **more: Column) -> DataFrame:
    """Rows for the landing table, with a random key and the time of writing in whole seconds. ``meta`` is never null.
    ``more``: further columns behind them."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    none = F.create_map().cast("map<string,string>")
    return df.select(
        F.expr("uuid()").alias("_key"), lit(source).alias("source"), lit(kind).alias("kind"), text(external_id).alias("external_id"), F.date_trunc("second", F.current_timestamp()).alias("fetched_at"),
        text(payload_json).alias("payload_json"), text(payload_text).alias("payload_text"), (none if meta is None else F.coalesce(meta, none)).alias("meta"),
        *[c.alias(n) for n, c in more.items()],
    )


def append(rows: DataFrame, path: str) -> None:
    """Adds rows, partitioned by source and kind, under new keys each time; nothing is compared or replaced."""
    rows.withColumn("_key", F.expr("uuid()")).write.mode("append").partitionBy("source", "kind").parquet(path)


def scan(raw: DataFrame, source: str | None = None, kinds: Iterable[str] = (), since: dt.datetime | str | None = None) -> DataFrame:
    """Rows of a source and kinds fetched at ``since`` or later. All are predicates on columns, so partitions are pruned
    and the rest is pushed to the files."""
    if source is not None:
        raw = raw.where(F.col("source") == source)
    if kinds := list(kinds):
        raw = raw.where(F.col("kind").isin(kinds))
    if since is not None:
        raw = raw.where(F.col("fetched_at") >= F.lit(str(since)).cast(raw.schema["fetched_at"].dataType))
    return raw


def by_kind(raw: DataFrame, kinds: Iterable[str]) -> dict[str, DataFrame]:
    """One frame for each kind asked for; other kinds are left out."""
    return {k: raw.where(F.col("kind") == k) for k in kinds}


def field(name: str) -> Column:
    """A top-level field of the JSON payload as text; null where the payload is null or malformed."""
    return F.get_json_object("payload_json", f"$.{name}")
