"""Shared pieces of the training-data operators: text expressions, stored intermediate tables, split prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of every contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: What separates words of letters, digits and non-ASCII characters, after lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. One that is a single small file is dealt to all cores; larger ones have splits enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; other letters keep their case. A text of ASCII alone takes the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once; a plain reference inside a lambda is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, separator: str = SPACE) -> Column:
    """Array of words; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def run_hashes(w: Column, n: int) -> Column:
    """64-bit hashes of all runs of n elements of an array of word hashes, in order; the array must have n elements at least."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))


def shingles(tokens: Column, n: int) -> Column:
    """Sorted distinct 64-bit hashes of n-word shingles of an array of words.

    Fewer words than n, but not none, count as one shingle; none give an empty array. Words are hashed once each, shingles
    from their words' hashes.
    """
    def hashed(w: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.sort_array(F.array_distinct(F.when(F.size(w) >= n, run_hashes(w, n)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session without one gets a fresh folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Tables written to the shared folder, to cut lineage: a lost executor costs a reread, never a rerun of all steps.

    The folder goes when the application ends; drop() deletes tables that are done with before that.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.paths = spark, {}
        self.root = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
        at = self._path(self.root)
        fs = self._fs(at)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, at):
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """Writes df in the partitions it is computed in; or, if it is `small`, a row for each group of a grouping, moved to one file."""
        path = f"{self.root}/{name}-{len(self.paths)}"
        (df.repartition(1) if small else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for df in dfs:
            at = self._path(self.paths[id(df)][0])
            self._fs(at).delete(at, True)


def split_running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over all earlier rows of the same keys in (bucket, order), in two levels.

    A window over the keys alone would put a hot key into one task. Here a task holds one bucket of a key, and the
    buckets' totals, pre-aggregated, are summed in a second, small window. `bucket` must follow `order`. Keys may be null.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    outer = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_base"),
    )
    rows = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = F.col(bucket) == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(base, same).withColumn(out, F.col("_inner") + F.col("_base")).drop("_inner", "_base", "_b", *[f"_k_{k}" for k in keys])
