"""The index: rows (feature, tgt, win), its limits, filters and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build(sketches: DataFrame, max_locations: int = 254) -> DataFrame:
    """(feature, tgt, win) of sketched targets (owner = tgt), at most max_locations of a feature, least (tgt, win) first."""
    return cap_locations(sketches.select("feature", F.col("owner").cast("bigint").alias("tgt"), "win"), max_locations)


def cap_locations(index: DataFrame, n: int) -> DataFrame:
    """The first n locations of each feature; the rank filter is pushed below the shuffle, so a hot feature moves n rows a task."""
    order = Window.partitionBy("feature").orderBy("tgt", "win")
    return index.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def remove_overpopulated(index: DataFrame, limit: int) -> DataFrame:
    """Features of more than `limit` locations go, whole. Counts are pre-aggregated; the rest is an anti-join."""
    crowded = index.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("feature")
    return index.join(crowded, "feature", "left_anti")


def query_limit(asked: int | None, stored: int) -> int:
    """Locations that a feature may have at query time: one less than the limit asked for, never above that of the index."""
    return min((asked or stored) - 1, stored - 1)


def remove_ambiguous(index: DataFrame, lineages: DataFrame, rank: int, max_ambiguous: int) -> DataFrame:
    """Features with more than max_ambiguous (0 is 1) distinct ancestors at a rank go; a missing ancestor is one value. Rank 0 counts targets."""
    value = F.col("tgt") if rank == 0 else F.coalesce(F.element_at("lineage", rank + 1), F.lit(0))
    per = index.select("feature", "tgt").distinct()
    if rank:
        per = per.join(lineages.select("tgt", "lineage"), "tgt", "left")
    gone = per.select("feature", value.alias("v")).distinct().groupBy("feature").count().where(F.col("count") > max(1, max_ambiguous)).select("feature")
    return index.join(gone, "feature", "left_anti")


def add(index: DataFrame, more: DataFrame, max_locations: int = 254) -> DataFrame:
    """An index with further locations; the limit is applied again."""
    return cap_locations(index.unionByName(more), max_locations)


def bucket_statistics(index: DataFrame) -> DataFrame:
    """One row: features, locations, and of the locations of a feature the greatest, mean, sample deviation and skewness."""
    per = index.groupBy("feature").agg(F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("features"), F.sum("n").alias("locations"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("stddev"), F.skewness("n").alias("_s"))
    n = F.col("features")
    return out.withColumn("skewness", F.when(n > 1, F.col("_s") * F.pow((n - 1) / n, F.lit(1.5)))).drop("_s")


def feature_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("feature").agg(F.count("*").alias("n"))


def feature_map(index: DataFrame) -> DataFrame:
    """(feature, locations): `tgt:win` pairs in order; bounded by the limit of locations."""
    return index.groupBy("feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tgt", "win"))), lambda x: F.concat_ws(":", x["tgt"], x["win"])), ",").alias("locations"))


def content(index: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: features, locations, targets and ranked targets."""
    a = index.agg(F.countDistinct("feature").alias("features"), F.count("*").alias("locations"))
    return a.crossJoin(targets.agg(F.count("*").alias("targets"), F.sum((F.col("parent") != 0).cast("bigint")).alias("ranked_targets")))  # one row by one


def unique_names(targets: DataFrame, given: str = "name", order: str = "tgt") -> DataFrame:
    """Targets with repeated names told apart in `name`: the n-th of a given name gets `!1!2...!n-1` after it."""
    n = F.row_number().over(Window.partitionBy(given).orderBy(order))
    tail = F.when(n > 1, F.concat(F.lit("!"), F.array_join(F.sequence(F.lit(1), n - 1), "!"))).otherwise("")
    return targets.withColumn("_n", tail).withColumn("name", F.concat(given, "_n")).drop("_n")
