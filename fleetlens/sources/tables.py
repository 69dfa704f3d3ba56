"""Table sinks and maintenance over day-partitioned Parquet."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import clock
from fleetlens.operators.grain import pick, top_n


def append_table(df: DataFrame, path: str, time: str, batch: str, partition: str = "day") -> None:
    """Append the rows of one named batch to their local-day partitions.

    A batch owns a folder in each day it has rows of, and writing it again replaces these folders, so a job that is
    repeated after a failure leaves every row once. Days that an earlier attempt wrote and this one does not are emptied."""
    d = df if partition in df.columns else df.withColumn(partition, clock.local_day(time))
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path).where(F.col("batch") == batch).select(partition).distinct()
    except AnalysisException:  # the first batch of the table
        old = None
    d = d.withColumn("batch", F.lit(batch))
    if old is not None:
        gone = [r[0] for r in old.join(d.select(partition).distinct(), partition, "left_anti").collect()]  # days of one batch
        for day in gone:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={day}/batch={batch}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "batch").parquet(path)


def compact(spark: SparkSession, path: str, into: str, partition: str = "day", rows_per_file: int = 5_000_000) -> None:
    """The table rewritten with few files a day, under another path: batches of a day become one, called ``compacted``."""
    d = spark.read.parquet(path).withColumn("batch", F.lit("compacted"))
    d.repartition(partition, F.floor(F.rand(7) * 8)).write.option("maxRecordsPerFile", rows_per_file).partitionBy(partition, "batch").parquet(into)


def append_stream(df: DataFrame, path: str, time: str, checkpoint: str, trigger: dict | None = None):
    """Micro-batches appended to day partitions; the batch id makes a retried batch overwrite itself."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        d = batch.withColumn("day", clock.local_day(time)).withColumn("batch", F.lit(batch_id))
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows whose key is not stored yet, first writer winning within the batch."""
    first = top_n(new, keys, order, 1).drop("rank")
    return first.join(existing.select(*keys), keys, "left_anti")


def insert_counts(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows an ignoring insert stores and how many it finds duplicate."""
    stored = new.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("stored"))
    n = new.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stored.select("stored", (n - F.col("stored")).alias("duplicate"))


def merge_accumulate(base: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """Additive and extremum upsert; nulls never win an extremum."""
    u = base.unionByName(delta)
    return u.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs])


def latest_rows(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Last-wins dimension upsert; of rows at one instant a hash of the row decides."""
    return pick(df, keys, F.struct(F.col(ts), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])))


def overwrite_day(df: DataFrame, path: str, partitions: tuple[str, ...] = ("day", "arm_kind")) -> None:
    """Replace only the (day, arm) partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def trim_age(df: DataFrame, time: str, keep_ms: int, now_ms: int) -> DataFrame:
    """Rows within the retention age (S11); on day partitions whole days are pruned first."""
    d = df.where(F.col(time) >= now_ms - keep_ms)
    if "day" in df.columns:
        d = d.where(F.col("day") >= clock.local_day(F.lit(now_ms - keep_ms)))
    return d


def newest_cutoff(df: DataFrame, time: str, n: int, cell_ms: int = 3_600_000) -> DataFrame:
    """Timestamp of the n-th newest row (O4), one row, null when there are fewer.

    Counts per time cell find the cell that holds the n-th row; only that cell's distinct instants
    are ordered.
    """
    per = df.groupBy(F.col(time).alias("_t")).agg(F.count(F.lit(1)).alias("c")).withColumn("_cell", F.floor(F.col("_t") / cell_ms))
    cells = per.groupBy("_cell").agg(F.sum("c").alias("cc"))
    run = Window.partitionBy(F.lit(1)).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    hit = cells.withColumn("_to", F.sum("cc").over(run)).withColumn("_from", F.col("_to") - F.col("cc")).where(
        (F.col("_from") < n) & (F.col("_to") >= n))
    inner = Window.partitionBy("_cell").orderBy(F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = per.join(hit.select("_cell", "_from"), "_cell").withColumn("_run", F.col("_from") + F.sum("c").over(inner))
    return rows.where((F.col("_run") >= n) & (F.col("_run") - F.col("c") < n)).agg(F.max("_t").alias("cutoff"))


def trim_newest(df: DataFrame, time: str, n: int) -> DataFrame:
    """Row-cap retention: rows at or after the n-th newest instant."""
    cut = newest_cutoff(df, time, n).scalar()
    return df.where(cut.isNull() | (F.col(time) >= cut))


def replacement_check(prior: DataFrame, nxt: DataFrame, keys: list[str]) -> DataFrame:
    """Rows the next snapshot lost or altered (S13); empty when it may replace the prior one."""
    cols = [c for c in prior.columns if c not in keys]
    a = prior.select(*keys, F.struct(*cols).alias("_a"))
    b = nxt.select(*keys, F.struct(*[F.col(c) for c in cols]).alias("_b"))
    j = a.join(b, keys, "left")
    changed = reduce(or_, [~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in cols], F.lit(False))
    return j.where(F.col("_b").isNull() | changed).select(*keys, F.when(F.col("_b").isNull(), "lost").otherwise("altered").alias("violation"))


def input_receipt(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and newest instant of every input."""
    parts = [d.agg(F.count(F.lit(1)).alias("rows"), F.max(t).alias("watermark")).select(F.lit(n).alias("table_name"), "rows", "watermark")
             for n, (d, t) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def observed(df: DataFrame, name: str, time: str):
    """The same receipt taken while the frame is written, without another scan."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.max(time).alias("watermark")), o


def export_day(df: DataFrame, day: str, time: str, order: list[str]) -> DataFrame:
    """One local day of a table in order (S16); the range sort spreads the day over tasks."""
    d = F.lit(day).cast("date")
    lo, hi = clock.day_start_ms(d), clock.day_end_ms(d)
    return df.where((F.col(time) >= lo) & (F.col(time) < hi)).orderBy(*order)


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
