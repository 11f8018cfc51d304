"""Per-key results that don't depend on how evenly the rows are spread over the keys.

The input is cut into splits of SPLIT rows. In each split the keys are dictionary-encoded to dense codes, and all results
of the split are dense arrays over those codes, filled by ``numpy.bincount`` and scatter reductions. The arrays are cut into
blocks by a hash of their keys, and what moves is one row per split and block, holding the arrays. A block's rows meet in
one task, which unites their dictionaries and adds the arrays up place by place. A key with a third of all rows arrives
there as one place of an array per split; blocks are even whatever the keys are, and a task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a split. Bounds the memory of the accumulators: there are no more codes than rows.
SPLIT = 1 << 17
#: Blocks the keys are dealt to: a task holds the accumulators of one block, 1 / BLOCKS of the keys.
BLOCKS = 1024
_NULL = "\x00"


def _coded(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes of a column's strings, null being one, and the hash of each code's string."""
    coded = col.combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.unify_dictionaries().combine_chunks()
    texts = coded.dictionary.fill_null(_NULL).to_numpy(zero_copy_only=False).astype(object)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pd.util.hash_array(texts, categorize=False) if len(texts) else np.zeros(0, np.uint64)


def _reduced(rows: pa.Table, own: list[str], first: np.ndarray | None = None) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The dense accumulators of the rows by the key columns ``own`` (and ``first``, a number per row, before them): one
    row per key with its keys and sums, ordered by ``first``; the keys' hashes; and where a row of each key stands. Rows are
    partial results, a plain row being one of itself."""
    code, mixed = np.zeros(rows.num_rows, dtype=np.int64) if first is None else first.astype(np.int64), np.zeros(rows.num_rows, dtype=np.uint64)
    for k in own:
        indices, hashes = _coded(rows[k])
        _, code = np.unique(code * (len(hashes) + 1) + indices, return_inverse=True)
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[indices]
    _, at, dense = np.unique(code, return_index=True, return_inverse=True)
    size = len(at)
    cols = {k: rows[k].take(pa.array(at)) for k in own}
    array = lambda c: rows[c].combine_chunks()
    added = lambda c: np.bincount(dense, weights=array(c).to_numpy(zero_copy_only=False).astype(float), minlength=size)
    cols["n"] = pa.array(added("n").astype(np.int64))
    if "total" in rows.column_names:
        cols["n_value"] = pa.array(added("n_value").astype(np.int64))
        cols["total"] = pa.array(added("total"))
        most, top = np.full(size, -np.inf), array("top")
        known = ~np.asarray(top.is_null())
        np.maximum.at(most, dense[known], top.fill_null(0.0).to_numpy(zero_copy_only=False)[known])
        cols["top"] = pa.array(most, mask=~np.isin(np.arange(size), dense[known]))
        when, rec = array("last_at"), array("last_rec").to_numpy(zero_copy_only=False)
        dated = ~np.asarray(when.is_null())
        when = when.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((rec, when, dated, dense))
        last = order[np.append(np.flatnonzero(np.diff(dense[order])), len(order) - 1)]
        cols["last_at"], cols["last_rec"] = pa.array(when[last], mask=~dated[last]), pa.array(rec[last])
    return pa.table(cols), mixed[at], at


def _plain(rows: pa.Table, keys: list[str]) -> pa.Table:
    """Input rows as partial results of themselves."""
    cols = {k: rows[k] for k in keys} | {"n": pa.array(np.ones(rows.num_rows, dtype=np.int64))}
    if "v" in rows.column_names:
        value = rows["v"].combine_chunks()
        known = ~np.asarray(value.is_null())
        value = value.fill_null(0.0).to_numpy(zero_copy_only=False)
        cols |= {"n_value": pa.array(known.astype(np.int64)), "total": pa.array(np.nan_to_num(value)), "top": pa.array(np.nan_to_num(value), mask=~known)}
        cols |= {"last_at": rows["at"], "last_rec": rows["rec"].combine_chunks().fill_null(-1)}
    return pa.table(cols)


def _blocks(done: pa.Table, hashes: np.ndarray, grouping: int, own: list[str], keys: list[str], blocks: int, schema: pa.Schema) -> pa.RecordBatch:
    """A split's accumulators cut into blocks: one row per block, its arrays as lists."""
    block = (hashes % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    offsets = pa.array(np.append(cut, len(block)).astype(np.int32))
    done = done.take(pa.array(order))
    lists = [pa.ListArray.from_arrays(offsets, (done[c].combine_chunks() if c in done.column_names else pa.nulls(len(block), pa.string())).cast(schema.field(c).type.value_type)) for c in schema.names[2:]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), grouping, dtype=np.int32)), pa.array(block[cut].astype(np.int32)), *lists], schema=schema)


def _flat(batch: pa.RecordBatch) -> tuple[pa.Table, np.ndarray]:
    """The places of the arrays of a batch of block rows, and (grouping, block) of each as one number."""
    label = batch["grouping"].to_numpy().astype(np.int64) << 32 | batch["block"].to_numpy().astype(np.int64)
    sizes = batch["n"].value_lengths().to_numpy()
    return pa.table({c: batch[c].flatten() for c in batch.schema.names[2:]}), np.repeat(label, sizes)


def dense_aggregate(df: DataFrame, sets: list[list[str]], value: str | None = None, at: str | None = None, rec: str | None = None, split: int = SPLIT, blocks: int = BLOCKS) -> DataFrame:
    """For each set of string key columns, of each key: ``n`` rows and, if ``value, at, rec`` are given, ``n_value`` rows with
    a value, ``total`` and ``top`` of the values, and the latest row as ``last_at`` (microseconds) and ``last_rec``;
    ``grouping`` is the set's index.

    Keys may be null, which is a key of its own; columns that aren't in a set are null in its rows. Null values are left
    out of total and top, NaN counts as 0. The latest row has the greatest ``at``, then the greatest ``rec``; a null ``at``
    is before all others. Rows that repeat count each time; an empty table gives no rows."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    sums = ["n bigint"] + (["n_value bigint", "total double", "top double", "last_at bigint", "last_rec bigint"] if value else [])
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    columns = [(k, "string") for k in keys] + [tuple(x.split()) for x in sums]
    arrow = pa.schema([("grouping", pa.int32()), ("block", pa.int32()), *[(c, pa.list_(kinds[t])) for c, t in columns]])
    flat = pa.schema([("grouping", pa.int32()), *[(c, kinds[t]) for c, t in columns]])

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _plain(pa.Table.from_batches(held), keys)
        for i, own in enumerate(sets):
            done, hashes, _ = _reduced(rows, own)
            yield _blocks(done, hashes, i, own, keys, blocks, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, split - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == split:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    def done(rows: pa.Table, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
        g = pa.array((labels >> 32).astype(np.int32))
        yield from pa.table({"grouping": g} | {c: rows[c] for c, _ in columns}, schema=flat).to_batches()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels = None, np.zeros(0, dtype=np.int64)  # the last block so far may go on in the next batch
        for b in batches:
            rows, own = _flat(b)
            rows, own = (rows, own) if held is None else (pa.concat_tables([held, rows]), np.concatenate((labels, own)))
            rows, _, at = _reduced(rows, keys, own)
            own = own[at]
            open_ = int(np.searchsorted(own, own[-1])) if len(own) else 0
            if open_:
                yield from done(rows.slice(0, open_), own[:open_])
            held, labels = rows.slice(open_), own[open_:]
        if held is not None:
            yield from done(held, labels)

    picked = [F.col(k).cast("string").alias(k) for k in keys]
    if value:
        picked += [F.col(value).cast("double").alias("v"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(rec).cast("bigint").alias("rec")]
    names = [(f"`{c}`", t) for c, t in columns]
    parts = df.select(*picked).mapInArrow(run, "grouping int, block int, " + ", ".join(f"{c} array<{t}>" for c, t in names))
    met = parts.repartition("grouping", "block").sortWithinPartitions("grouping", "block")
    return met.mapInArrow(add, "grouping int, " + ", ".join(f"{c} {t}" for c, t in names))


def distinct_per_key(df: DataFrame, sets: list[list[str]], member: str) -> DataFrame:
    """``grouping``, the key columns and ``n_distinct``: distinct non-null members of each key. The rows move by key
    *and* member, so a frequent key is spread over all tasks; only the counts meet by key. Repeats go map-side."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    forms = [F.struct(F.lit(i).alias("grouping"), *[(F.col(k) if k in s else F.lit(None)).cast("string").alias(k) for k in keys]) for i, s in enumerate(sets)]
    rows = df.where(F.col(member).isNotNull()).select(F.col(member).alias("_m"), F.inline(F.array(*forms)))
    return rows.distinct().groupBy("grouping", *keys).agg(F.count("*").alias("n_distinct"))


def key_report(df: DataFrame, sets: list[list[str]], value: str, at: str, rec: str, member: str) -> DataFrame:
    """dense_aggregate with the mean of the values and distinct_per_key joined to it, one row per key of each set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    got, many = dense_aggregate(df, sets, value, at, rec), distinct_per_key(df, sets, member)
    same = [got["grouping"] == many["grouping"], *[got[k].eqNullSafe(many[k]) for k in keys]]
    both = got.join(many, same, "left")
    mean = F.round(got["total"] / F.nullif(got["n_value"], F.lit(0)), 6)
    latest = F.timestamp_micros(got["last_at"])
    return both.select(got["grouping"], *[got[k] for k in keys], got["n"], mean.alias("mean_value"), got["top"].alias("max_value"), F.coalesce(many["n_distinct"], F.lit(0)).cast("bigint").alias("n_distinct"), latest.alias("latest_at"), got["last_rec"].alias("latest_rec"))


def heavy_keys(df: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """The keys (first column not null) that hold at least ``percent`` of all rows of ``df``, repeats counted, with
    ``n``. The number of all rows is a scalar subquery over the same table, so the whole stays one lazy plan."""
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    got = dense_aggregate(df, [keys])
    return got.where(F.col(keys[0]).isNotNull() & (F.col("n") * 100 >= total * F.lit(percent))).select(*keys, "n")
