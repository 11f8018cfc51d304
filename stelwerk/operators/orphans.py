"""References to records that don't exist, or not at the time of the reference.

A Bloom filter over the parents' keys, built by partial aggregation and bounded by MAX_BITS, goes to all tasks: a key
it doesn't hold is certainly missing, and its row is done without a shuffle. More keys than one filter can tell apart are
cut into ranges of their hashes: the references are laid down by range once, and each range has a filter of its own, one
after the other, so that the filter stays as sharp and as small however many keys there are. Only the other references meet
the parents in an exact join, against one summary row per key. Keys with very many references (at most HOT_PARTS of them) join
apart, by a broadcast of their few summary rows, so no task gets a frequent key.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from stelwerk.session import written

#: Bits of one Bloom filter, at most 8 MB to broadcast, and bits a key. More keys make more filters, not fuller ones.
MAX_BITS = 1 << 26
KEY_BITS = 8
#: A key is hot if it has more than 1 / HOT_PARTS of all references, so there are fewer hot keys than this.
HOT_PARTS = 200


def bloom(parents: DataFrame, key: str, n: int) -> Column:
    """A scalar subquery: the Bloom filter (bytes) of the hashes of the ``n`` non-null keys. It is built by partial
    aggregation; the driver gets the one value, at most MAX_BITS bits, and hands it to the tasks."""
    made = InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", F.xxhash64(key), F.expr(f"{max(1, n)}L"), F.expr(f"{max(64, min(MAX_BITS, KEY_BITS * n))}L"))
    return parents.where(F.col(key).isNotNull()).agg(made.alias("bloom")).scalar()


def tried(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references with ``maybe``: false if their key is certainly none of the parents'. Written once."""
    n = parents.count()
    ranges = max(1, -(-n * KEY_BITS // MAX_BITS))
    if ranges == 1:
        return written(refs.withColumn("maybe", maybe_in(bloom(parents, "key", n), "key")), "tried")
    # Another hash than the filter's, so that a range is a fair part of the filter's keys.
    of = lambda df: F.pmod(F.hash(F.col("key")), F.lit(ranges))
    laid = written(refs.withColumn("range", of(refs)), "ranges", partition_by=("range",))
    done = []
    for r in range(ranges):
        filter_ = bloom(parents.where(of(parents) == r), "key", -(-n // ranges))
        done.append(written(laid.where(F.col("range") == r).drop("range").withColumn("maybe", maybe_in(filter_, "key")), "tried"))
    return refs.sparkSession.read.schema(done[0].schema).parquet(*[f for d in done for f in _folders(d)])


def _folders(df: DataFrame) -> list[str]:
    """The folder a written table lies in; none for one without rows, which has no files."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def maybe_in(filter_: Column, key: str) -> Column:
    """False only if the key is certainly not among those of the filter; false for all if there were none. Spark has the
    test as an expression of its own, for its runtime filters, but no function of that name: so it is made here."""
    jvm = SparkContext._active_spark_context._jvm
    made = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(made.expression(filter_._jc), made.expression(F.xxhash64(key)._jc))
    return F.coalesce(Column(made.column(test)), F.lit(False))


def parent_summary(parents: DataFrame) -> DataFrame:
    """Per key: ``first``, when its first row came, and ``open_from``, from when a row that is never deleted is there.
    A row without ``ingested_at`` counts as always there."""
    came = F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    return parents.select("key", came.alias("came"), "deleted_at").groupBy("key").agg(F.min("came").alias("first"), F.min(F.when(F.col("deleted_at").isNull(), F.col("came"))).alias("open_from"))


def orphans(refs: DataFrame, parents: DataFrame, side: str | None = None) -> DataFrame:
    """``src_table, in_month, rec_id, reason`` of the references without a parent at their own time.

    refs: ``src_table, rec_id, key, t``; parents: ``key, ingested_at, deleted_at``, any number of rows a key; times
    without zone. Null and blank keys are no references; keys compare exactly. A reference without ``t`` can only be
    ``missing``, its month is null. ``missing``: no parent has the key; ``late``: all come after t; ``deleted``: all
    that had come by t were deleted by t. Repeated parents change nothing; repeated references stay. ``side``: a column of
    both, without nulls; keys are the same only on one side, so references of several kinds are looked up in one pass."""
    refs = refs.where(F.col("key").rlike(r"(?U)\S"))
    if side:
        refs, parents = (df.withColumn("key", F.concat(F.col(side), F.lit("\x00"), F.col("key"))) for df in (refs, parents))
    refs = refs.select("src_table", "rec_id", "key", F.col("t").cast("timestamp_ntz").alias("t"))
    parents = parents.where(F.col("key").isNotNull()).select("key", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("ingested_at", "deleted_at")])
    known = tried(refs, parents)
    certain = known.where("not maybe").select("src_table", "rec_id", "t", F.lit("missing").alias("reason"))
    left = known.where("maybe").drop("maybe")

    # Fewer than HOT_PARTS keys can be this frequent, so both the list and their summaries are small.
    by_key = left.groupBy("key").agg(F.count("*").alias("n"))
    least = known.count() / HOT_PARTS
    hot = [r["key"] for r in by_key.where(F.col("n") > least).select("key").collect()]
    summary = parent_summary(parents)
    met = left.where(~F.col("key").isin(hot)).join(summary, "key", "left")
    if hot:
        few = F.broadcast(summary.where(F.col("key").isin(hot)))
        met = met.unionByName(left.where(F.col("key").isin(hot)).join(few, "key", "left"))
    plain = F.when(F.col("first").isNull(), "missing").when(F.col("first") > F.col("t"), "late").when(F.col("t").isNotNull() & (F.col("open_from").isNull() | (F.col("open_from") > F.col("t"))), "open")
    judged = met.withColumn("reason", plain).where(F.col("reason").isNotNull())

    # Only keys whose every row by t is deleted some time are left to look at; a key's rows that reach over t save it.
    ended = parents.where(F.col("deleted_at").isNotNull()).select(F.col("key").alias("k"), F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("came"), F.col("deleted_at").alias("went")).where(F.col("came") < F.col("went")).distinct()
    alive = (F.col("reason") == "open") & (F.col("key") == F.col("k")) & (F.col("came") <= F.col("t")) & (F.col("went") > F.col("t"))
    judged = judged.join(ended, alive, "left_anti").withColumn("reason", F.when(F.col("reason") == "open", "deleted").otherwise(F.col("reason")))
    rows = certain.unionByName(judged.select("src_table", "rec_id", "t", "reason"))
    return rows.select("src_table", F.date_format("t", "yyyy-MM").alias("in_month"), "rec_id", "reason")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month and reason: ``src_table, in_month, reason, n_orphans``."""
    return found.groupBy("src_table", "in_month", "reason").agg(F.count("*").alias("n_orphans"))
