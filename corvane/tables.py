"""Reading tables, cutting lineage and distributed ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a temporary folder is used in local mode only; on a cluster it is an error, as executors would
    write to their own disks. Files are deleted when the driver ends, or by release().
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _TEMPORARY.get(spark.sparkContext.applicationId)
        if base is None:
            base = _TEMPORARY[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="corvane-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    folder = f"{base.rstrip('/')}/corvane-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TEMPORARY: dict[str, str] = {}
_FOLDERS: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended
        pass


def release(spark: SparkSession) -> None:
    """Deletes all tables that materialise() wrote for this application; results not yet read are lost."""
    _delete(spark, shared_folder(spark))


def materialise(df: DataFrame, name: str = "stage", sweep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. Runs a job.

    With sweep the job's shuffle files are removed at its end, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true" if sweep else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


def topk(df: DataFrame, by: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group in a total order, with their 1-based rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def below_counts(df: DataFrame, group: list[str], value: str, parts: int | None = None) -> DataFrame:
    """For each distinct (group, value): n, rows with it, and below, rows of the group with a smaller value.

    Groups may be of any size: equal rows are counted before the shuffle, values are range partitioned, each range
    is summed on its own, and only one total per (group, range) is combined across ranges. Null values are left out.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(parts, *group, value).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranks")
    local = ranged.withColumn("_in", F.sum("n").over(Window.partitionBy(*group, "_part").orderBy(value)) - F.col("n"))
    totals = ranged.groupBy(*group, "_part").agg(F.sum("n").alias("_t"))
    before = totals.select(*group, "_part", (F.sum("_t").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_t")).alias("_before"))
    return local.join(before, [*group, "_part"]).select(*group, value, "n", (F.col("_in") + F.col("_before")).alias("below"))


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The frame itself, a dictionary that is joined without keys; an error where it has more than `most` rows. Runs a job."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: split the dictionary")
    return df


def spread(df: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """A small table over all cores, before work that costs far more than its bytes tell; larger ones keep their partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < task_bytes * cores else df


#: Rows of a group that one task takes; larger groups are spread over range partitions, with the same result.
ONE_TASK = 100_000


def by_size(df: DataFrame, by: list[str], most: int = ONE_TASK, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most `most` rows, and those of larger groups, None if there are none. Rows with a null key are
    left out of the latter. sized is a frame cheaper to count, with at least as many rows of each group."""
    large = materialise((df if sized is None else sized).groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*by), "large")  # a row for each such group
    if large.isEmpty():
        return df, None
    return df.join(large, by, "left_anti"), df.join(large, by, "left_semi")


def running(df: DataFrame, by: list[str], order: list[str], sums: tuple[str, ...] = (), lasts: tuple[str, ...] = (), prev: tuple[str, ...] = (), following: tuple[str, ...] = (), most: int = ONE_TASK, sized: DataFrame | None = None) -> DataFrame:
    """Adds, in the total order within each group: sum_x up to and with the row, last_x that isn't null up to and with it, prev_x and next_x of its neighbours.

    Groups of more than `most` rows are range partitioned; each range is run through on its own, and only its totals and
    ends, a row for each (group, range), are carried from one range to the next.
    """
    small, large = by_size(df, by, most, sized)

    def local(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return d.select("*", *[F.sum(c).over(upto).alias(f"sum_{c}") for c in sums], *[F.last(c, True).over(upto).alias(f"last_{c}") for c in lasts],
                        *[F.lag(c).over(w).alias(f"prev_{c}") for c in prev], *[F.lead(c).over(w).alias(f"next_{c}") for c in following])

    out = local(small, by)
    if large is None:
        return out
    ranged = materialise(large.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    o = F.struct(*order)
    ends = ranged.groupBy(*by, "_part").agg(
        F.min(o).alias("_lo"), F.max(o).alias("_hi"), *[F.sum(c).alias(f"s_{c}") for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(f"l_{c}") for c in lasts],
        *[F.max_by(c, o).alias(f"p_{c}") for c in prev], *[F.min_by(c, o).alias(f"n_{c}") for c in following])
    w = Window.partitionBy(*by).orderBy("_part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_part", "_lo", "_hi", *[F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"s_{c}") for c in sums], *[F.last(f"l_{c}", True).over(before).alias(f"l_{c}") for c in lasts],
                        *[F.lag(f"p_{c}").over(w).alias(f"p_{c}") for c in prev], *[F.lead(f"n_{c}").over(w).alias(f"n_{c}") for c in following])
    j = local(ranged, [*by, "_part"]).join(carry, [*by, "_part"])
    return out.unionByName(j.select(
        *df.columns, *[(F.coalesce(f"sum_{c}", F.lit(0)) + F.col(f"s_{c}")).alias(f"sum_{c}") for c in sums], *[F.coalesce(f"last_{c}", f"l_{c}").alias(f"last_{c}") for c in lasts],
        *[F.when(o == F.col("_lo"), F.col(f"p_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in prev], *[F.when(o == F.col("_hi"), F.col(f"n_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in following]))


def has_column(df: DataFrame, name: str) -> Column:
    """The column, or null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None)
