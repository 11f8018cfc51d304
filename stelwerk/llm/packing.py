"""Texts in containers of fixed capacity.

Only lengths matter to the packing, and there are at most ``capacity`` different ones: the histogram of lengths, a few
thousand numbers whatever the number of texts, is packed on the driver by minimum bin slack. Each step opens a bin with
the longest length left, finds by bitset subset-sum the fullest combination the lengths left allow, and takes that bin
as often as the counts last, so there are no more steps than lengths, or few more. The texts are then given their places
by rank within their length. Ranks come from counts per block of texts, so no task sorts all texts of one length.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stelwerk.session import written

CAPACITY = 2048
#: Texts a block: the unit within which places of equal length are numbered.
BLOCK = 20_000
#: Blocks whose counts are added up together.
STRIDE = 1024


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where a vocabulary file lies: $TOKENIZER_DIR, else the installed package of public tokenizers, else /opt/tokenizers."""
    if at := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(at, name)
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers", name)


#: The pattern that splits text before merges, as published with the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc: str, text: str, path: str) -> DataFrame:
    """``doc_id, n_tokens`` of the texts that are neither null nor blank."""
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").rlike(r"(?U)\S"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) for t in b["t"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], n], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(df.dtypes)[doc]}, n_tokens bigint")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The combination of the lengths (descending, ``counts`` of each) with the greatest sum up to ``room``; among equal
    ones that of the longest lengths. Bit s of a bitset says that sum s can be reached."""
    mask = (1 << (room + 1)) - 1
    reach = [1]
    used = []
    for n in lengths:
        if n > room:
            continue
        bits, left, step = reach[-1], counts[n], 1
        while left and step * n <= room:  # copies in powers of two: any number up to the count
            take = min(step, left)
            bits |= bits << (take * n) & mask
            left -= take
            step *= 2
        reach.append(bits)
        used.append(n)
        if bits >> room & 1:
            break
    s = reach[-1].bit_length() - 1
    combo = []
    for k in range(len(used) - 1, -1, -1):
        n = used[k]
        while not reach[k] >> s & 1:
            combo.append(n)
            s -= n
    return combo


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (contents by length, number of such bins) that hold every item once. Lengths: 1 .. capacity."""
    left = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(left, reverse=True)
    bins = []
    while order:
        first = order[0]
        left[first] -= 1
        combo = Counter([first, *fullest([n for n in order if left[n]], left, capacity - first)])
        left[first] += 1
        times = min(left[n] // k for n, k in combo.items())
        bins.append((dict(combo), times))
        for n, k in combo.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return bins


def _places(bins: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each length, in the order of ranks: where a run of ranks starts (length << 40 | rank), its first container, how
    many of its items lie in one container."""
    rank: Counter = Counter()
    starts, firsts, each, container = [], [], [], 0
    for combo, times in bins:
        for n, k in combo.items():
            starts.append(n << 40 | rank[n])
            firsts.append(container)
            each.append(k)
            rank[n] += k * times
        container += times
    order = np.argsort(np.array(starts, dtype=np.int64))
    return tuple(np.array(x, dtype=np.int64)[order] for x in (starts, firsts, each)) + (np.int64(container),)


def _running(counts: DataFrame) -> DataFrame:
    """``block, before``: the sum of ``n`` over all blocks before each. Blocks are added up in groups of STRIDE; only the
    groups' sums, one row per STRIDE * BLOCK texts, meet in one task."""
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = counts.withColumn("stride", F.expr(f"block div {STRIDE}"))
    bases = grouped.groupBy("stride").agg(F.sum("n").alias("n")).select("stride", earlier(Window.orderBy("stride")).alias("base"))
    within = grouped.select("stride", "block", earlier(Window.partitionBy("stride").orderBy("block")).alias("within"))
    return within.join(bases, "stride").select("block", (F.col("base") + F.col("within")).alias("before"))


def pack(df: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``doc_id, part, n_tokens, container``: every text with tokens once, in one container if it fits.

    A longer text is cut into parts 0, 1, ... of ``capacity`` tokens, each alone in a container, and a rest that is packed
    like a text. Containers are numbered from 0 and hold at most ``capacity`` tokens. Null and blank texts are left out; texts
    of equal length are interchangeable and placed by block and id; an empty table gives no rows; repeated ids are placed
    one by one. Other columns are not read."""
    sizes = written(token_counts(df, doc, text, path or tokenizer_file()), "sizes")
    kind = dict(sizes.dtypes)["doc_id"]
    n_docs = sizes.count()
    blocks = max(1, -(-n_docs // BLOCK))
    keyed = sizes.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    whole = F.expr(f"n_tokens div {capacity}")
    rest = keyed.select("block", "doc_id", whole.alias("part"), F.expr(f"n_tokens % {capacity}").alias("length")).where("length > 0")
    counts = rest.groupBy("length", "block").agg(F.count("*").alias("n"))

    # One row per length: at most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    starts, firsts, each, packed = _places(minimum_bin_slack(histogram, capacity))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id")) - 1
    ranked = rest.withColumn("within", within).join(offsets, ["length", "block"]).select("doc_id", "part", "length", (F.col("offset") + F.col("within")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            key = length << 40 | rank
            k = np.searchsorted(starts, key, "right") - 1
            at = firsts[k] + (key - starts[k]) // each[k]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], b["length"], pa.array(at)], names=["doc_id", "part", "n_tokens", "container"])

    placed = ranked.mapInArrow(place, f"doc_id {kind}, part bigint, n_tokens bigint, container bigint")

    # Full parts have a container each: numbered behind the packed ones, by block.
    long = keyed.where(whole > 0)
    full = long.groupBy("block").agg(F.sum(whole).alias("n"))
    base = _running(full).select("block", F.col("before").alias("base"))
    inner = F.coalesce(F.sum(whole).over(Window.partitionBy("block").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = long.withColumn("inner", inner).join(base, "block")
    parts = numbered.select("doc_id", F.posexplode(F.sequence(F.lit(0), whole - 1)).alias("pos", "part"), (F.col("base") + F.col("inner")).alias("at"))
    alone = parts.select("doc_id", F.col("part").cast("bigint").alias("part"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.lit(int(packed)) + F.col("at") + F.col("pos")).cast("bigint").alias("container"))
    return placed.unionByName(alone)
