"""Busiest keys of a stream, exactly, over more keys than a table of all of them could hold.

Every micro-batch leaves the counts of its own keys, the cells of a count-min sketch, and its few busiest keys.
Cells of batches add up, so the sketch of the whole stream is their sum: ``DEPTH`` rows of ``WIDTH`` counters, whatever
the number of keys.  A key's estimate is the least of its ``DEPTH`` counters.  It is never below the true count, and
above it by more than ``e / WIDTH`` of all requests with a probability of at most ``exp(-DEPTH)`` (0.7 % of keys, by
more than 0.008 % of requests).

A reader counts the busiest keys of the batches exactly; the n-th largest of these counts is a lower bound of the
n-th largest of all.  Only keys whose estimate reaches it can be among the first n, and only those are grouped.  So
the answer is that of a table of all keys, while what is shuffled are the candidates' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEPTH, WIDTH = 5, 1 << 15
#: Keys of each micro-batch that are tried first.  Any choice gives a right lower bound; a good one a higher bound.
LEADS = 100


def _bucket(key: Column, row: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(row)), F.lit(WIDTH)).cast("int")


def sketch_cells(counts: DataFrame, key: str = "key") -> DataFrame:
    """``row, bucket, n`` of the sketch of key counts; at most ``DEPTH * WIDTH`` rows, added up map-side."""
    places = [F.struct(F.lit(r).alias("row"), _bucket(F.col(key), r).alias("bucket")) for r in range(DEPTH)]
    return counts.select(F.explode(F.array(*places)).alias("place"), "n").groupBy("place.row", "place.bucket").agg(
        F.sum("n").alias("n"))


def start_key_counts(
    requests: DataFrame, key: str, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Writes counts, cells and leads of every micro-batch below ``path``; a repeated batch overwrites its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, f"batch_id={batch_id}"
        counted = batch.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/counts/{at}")
        written = spark.read.schema(counted.schema).parquet(f"{path}/counts/{at}")
        sketch_cells(written).write.mode("overwrite").parquet(f"{path}/cells/{at}")
        written.orderBy(F.desc("n"), "key").limit(LEADS).write.mode("overwrite").parquet(f"{path}/leads/{at}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _table(spark: SparkSession, path: str) -> Column:
    """The merged sketch as one value: ``DEPTH`` arrays of ``WIDTH`` counters, 1.3 MB whatever was counted."""
    cells = spark.read.parquet(f"{path}/cells").select("row", "bucket", "n")
    zeros = spark.range(DEPTH * WIDTH).select(
        (F.col("id") % DEPTH).cast("int").alias("row"), F.floor(F.col("id") / DEPTH).cast("int").alias("bucket"),
        F.lit(0).cast("bigint").alias("n"))
    full = cells.unionByName(zeros).groupBy("row", "bucket").agg(F.sum("n").alias("n"))
    rows = full.groupBy("row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda c: c["n"]).alias("counters"))
    return rows.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row", "counters"))), lambda r: r["counters"]).alias("t")).scalar()


def _total(spark: SparkSession, path: str) -> Column:
    """Requests counted so far: every row of cells adds up to them."""
    return spark.read.parquet(f"{path}/cells").filter(F.col("row") == 0).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()


def _estimate(table: Column, key: Column) -> Column:
    return F.least(*[F.get(F.get(table, F.lit(r)), _bucket(key, r)) for r in range(DEPTH)])


def estimated_counts(spark: SparkSession, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with ``estimate`` and ``may_exceed_by``: the count lies between ``estimate - may_exceed_by`` and
    ``estimate`` for all but ``exp(-DEPTH)`` of keys, and is never above it."""
    return keys.withColumns({
        "estimate": _estimate(_table(spark, path), F.col(key)),
        "may_exceed_by": F.ceil(F.lit(2.718281828459045) / WIDTH * _total(spark, path)),
    })


def candidates(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Counts of a batch, ``key, n``, for every key that can be among the first ``n``."""
    counts = spark.read.parquet(f"{path}/counts").select("key", "n")
    leads = spark.read.parquet(f"{path}/leads").groupBy("key").agg(F.sum("n").alias("seen"))
    # At most 10 n keys.
    tried = leads.orderBy(F.desc("seen"), "key").limit(10 * n).select("key")
    exact = counts.join(F.broadcast(tried), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
    least = exact.orderBy(F.desc("n")).limit(n).agg(
        F.when(F.count(F.lit(1)) == n, F.min("n")).otherwise(F.lit(0)).alias("least")).scalar()
    return counts.filter(_estimate(_table(spark, path), F.col("key")) >= least)


def read_hot_keys(spark: SparkSession, path: str, key: str, n: int) -> DataFrame:
    """The ``n`` busiest keys of all batches with their share, as ``metrics.hot_keys`` gives them; ties by key."""
    exact = candidates(spark, path, n).groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("requests"))
    return exact.orderBy(F.desc("requests"), key).limit(n).withColumn("share", F.round(F.col("requests") / _total(spark, path), 6))
