"""Last-wins, first-wins, upserts, updates and insert-if-absent as set operations, and tables kept as a base and deltas."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key; partial aggregation, so a frequent key moves one row a task. Null
    keys are one key; nulls in the order come first; rows equal in the whole order: any of them, so make it unique."""
    kept = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As last_per_key, with the least ``order``."""
    kept = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """``value, position``: each value once, at its first position."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key isn't there yet, one per key (insert-if-absent). Null keys are never there and all stay one."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def by_content(df: DataFrame, keys: Sequence[str]) -> Column:
    """A number made of a row's other columns: an order that is the same in every run for rows that have none."""
    rest = sorted(c for c in df.columns if c not in keys)
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rest]))) if rest else F.lit(0)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] = (), merged: Sequence[str] = ("props",)) -> DataFrame:
    """The table after the incoming rows, with ``created`` (the key was not there). The last incoming row of a key in
    ``order`` counts, without one the last by_content.

    Struct columns in ``merged`` are merged field by field, an incoming field that isn't null wins; any other column is
    replaced where the key comes in. Columns of the result: those of ``existing``; null keys don't come in."""
    rows = incoming.where(F.col(key).isNotNull())
    last = last_per_key(rows, [key], order) if order else last_per_key(rows.withColumn("_order", by_content(rows, [key])), [key], ["_order"]).drop("_order")
    old, new = existing.alias("o"), last.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    came = F.col(f"n.{key}").isNotNull()
    cols: list[Column] = []
    for f in existing.schema.fields:
        o, n = F.col(f"o.`{f.name}`"), F.col(f"n.`{f.name}`") if f.name in last.columns else F.lit(None)
        if f.name in merged and f.name in last.columns:
            inner = last.schema[f.name].dataType.fieldNames()
            fields = [F.coalesce(n[g.name] if g.name in inner else F.lit(None), o[g.name]).cast(g.dataType).alias(g.name) for g in f.dataType.fields]
            value = F.when(n.isNull(), o).otherwise(F.struct(*fields))
        elif f.name == key:
            value = F.coalesce(n, o)
        else:
            value = F.when(came, n).otherwise(o) if f.name in last.columns else o
        cols.append(value.alias(f.name))
    return both.select(*cols, (came & F.col(f"o.{key}").isNull()).alias("created"))


def update(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] = (), merged: Sequence[str] = ("props",)) -> DataFrame:
    """As upsert, for keys that are there; rows with other keys don't come in. ``updated`` tells the rows that were met."""
    known = incoming.join(existing.select(key).distinct(), key, "left_semi")
    met = known.select(F.col(key).alias("_met")).distinct()
    done = upsert(existing, known, key, order, merged).drop("created")
    return done.join(met, done[key] == met["_met"], "left").withColumn("updated", F.col("_met").isNotNull()).drop("_met")


_AT = "_delta"


class Store:
    """Tables in a folder, each a base and deltas. A write adds a delta with the incoming rows only, so its cost is theirs; a
    read lays the deltas over the base in the order they were written; compact makes a new base of both. A delta or base
    counts once Spark has left its success mark, and has a name of its own, so readers, writers and runs that are tried
    again don't meet. What a key's rows hold is settled when they are read: by the merging rules of upsert."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _parts(self, table: str) -> list[str]:
        """The folders that count, base first, oldest first."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = sorted(p.getPath().getName() for p in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS")))
        bases = [n for n in names if n.endswith("-base")]
        first = bases[-1] if bases else ""
        return [n for n in names if n == first or n > first and not n.endswith("-base")]

    def _add(self, table: str, df: DataFrame, kind: str, partition_by: Sequence[str] = ()) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}-{kind}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{name}")
        return name

    def _part(self, table: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/{name}")

    def exists(self, table: str) -> bool:
        return bool(self._parts(table))

    def keys(self, table: str, key: str = "_key") -> DataFrame:
        """The distinct keys of a table; only that column is read."""
        parts = [self._part(table, n).select(key) for n in self._parts(table)]
        for p in parts[1:]:
            parts[0] = parts[0].unionByName(p)
        return parts[0].distinct()

    def read(self, table: str, key: str = "_key", merged: Sequence[str] = ("props",)) -> DataFrame:
        """The table as it is now. Without deltas that is the base itself; else the base's rows with keys of no delta pass
        as they are, and only the others are merged with the deltas, by aggregation per key."""
        if not (names := self._parts(table)):
            raise FileNotFoundError(f"{self.root}/{table} has nothing complete in it")
        if len(names) == 1:
            return self._part(table, names[0])
        has_base = names[0].endswith("-base")
        parts = [self._part(table, n) for n in names]
        columns = list(dict.fromkeys(c for p in parts for c in p.columns))
        # Each part says which columns it has: one that it lacks stays as it was, one that is null in it becomes null.
        rows = [p.select("*", F.lit(i).alias(_AT), F.struct(*[F.lit(i if c in p.columns else None).cast("int").alias(c) for c in columns]).alias("_has")) for i, p in enumerate(parts)]
        news = rows[1:] if has_base else rows
        for r in news[1:]:
            news[0] = news[0].unionByName(r, allowMissingColumns=True)
        changed = news[0]
        kept = None
        if has_base:
            met = changed.select(key).distinct()
            kept = parts[0].join(met, key, "left_anti")
            changed = changed.unionByName(rows[0].join(met, key, "left_semi"), allowMissingColumns=True)
        done = []
        for c in columns:
            if c == key:
                continue
            kind = changed.schema[c].dataType
            if c in merged and hasattr(kind, "fields"):
                inner = [F.max_by(F.col(c)[f], F.when(F.col(c)[f].isNotNull(), F.col(_AT))).alias(f) for f in kind.fieldNames()]
                done.append(F.when(F.max(F.when(F.col(c).isNotNull(), 1)).isNotNull(), F.struct(*inner)).alias(c))
            else:
                done.append(F.max_by(F.col(c), F.col("_has")[c]).alias(c))
        latest = changed.groupBy(key).agg(*done).select(*columns)
        return latest if kept is None else latest.unionByName(kept, allowMissingColumns=True)

    def write(self, table: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Replaces the table."""
        self._add(table, df, "base", partition_by)

    def compact(self, table: str, key: str = "_key", merged: Sequence[str] = ("props",)) -> None:
        """A new base of the base and its deltas; the old files stay for readers that have begun."""
        if len(self._parts(table)) > 1:
            self.write(table, self.read(table, key, merged))

    def upsert(self, table: str, incoming: DataFrame, key: str = "_key", order: Sequence[str] = ()) -> int:
        """Merges rows into the table, the last of each key in ``order`` (without one by_content), and returns how many keys are
        new. Null keys don't come in. Only the table's keys are read."""
        return self._upsert(table, incoming, key, order)[0]

    def _upsert(self, table: str, incoming: DataFrame, key: str, order: Sequence[str]) -> tuple[int, int]:
        rows = incoming.where(F.col(key).isNotNull())
        last = last_per_key(rows, [key], order) if order else last_per_key(rows.withColumn("_order", by_content(rows, [key])), [key], ["_order"]).drop("_order")
        before = self.keys(table, key) if self.exists(table) else None
        came = self._part(table, self._add(table, last, "delta")).select(key)
        n = came.count()
        return (n, n) if before is None else (came.join(before, key, "left_anti").count(), n)

    def update(self, table: str, incoming: DataFrame, key: str = "_key", order: Sequence[str] = ()) -> int:
        """As upsert for keys that are there, others don't come in; returns how many were met."""
        if not self.exists(table):
            return 0
        return self._upsert(table, incoming.join(self.keys(table, key), key, "left_semi"), key, order)[1]

    def append_new(self, table: str, incoming: DataFrame, keys: Sequence[str]) -> int:
        """Adds the rows whose key isn't there yet, of several the first by_content, and returns their number."""
        keys = list(keys)
        first = first_per_key(incoming.withColumn("_order", by_content(incoming, keys)), keys, ["_order"]).drop("_order")
        rows = first
        if self.exists(table):
            have = [self._part(table, n).select(*keys) for n in self._parts(table)]
            for h in have[1:]:
                have[0] = have[0].unionByName(h)
            rows = first.join(have[0].distinct(), keys, "left_anti")
        return self._part(table, self._add(table, rows, "delta")).count()
