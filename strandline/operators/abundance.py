"""Read counts per taxon, and their estimate at a rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import NONE
from ..stored import stored
from .taxonomy import lowest_ancestor_from


def taxon_counts(classified: DataFrame) -> DataFrame:
    """(tax, n): classified reads of each taxon."""
    return classified.where("tax is not null").groupBy("tax").agg(F.count("*").cast("double").alias("n"))


def estimate(counts: DataFrame, lineages: DataFrame, taxa: DataFrame, rank: int) -> DataFrame:
    """(tax, n): counts moved up from below a rank, then down from above it to the taxa that have counts.

    Counts below the rank go to the lowest ancestor of that rank or above. Then, from the root down, a taxon with counted
    taxa under it (each under its nearest counted ancestor) shares its count among them by count and all counts below.
    A taxon's counted ancestors are all on its lineage, so the counts below each are one grouped sum, and what comes down to
    a taxon without others below it is a fold over its at most 21 ancestors: no loop over levels.
    """
    info = lineages.select("id", "lineage").join(taxa.select("id", "rank"), "id")
    rows = counts.join(info, F.col("tax") == F.col("id"))
    if rank:
        up = lowest_ancestor_from(F.col("lineage"), rank)
        rows = rows.withColumn("tax", F.when(F.col("rank") < rank, F.coalesce(up, "tax")).otherwise(F.col("tax")))
    merged = rows.groupBy("tax").agg(F.sum("n").alias("n")).join(info, F.col("tax") == F.col("id")).select("tax", "n", "rank", "lineage")
    merged = stored(merged, "counts")  # a row for each counted taxon; used four times
    above = merged.select("tax", F.col("n").alias("m"), F.posexplode("lineage").alias("r", "anc"), F.col("rank").alias("own")).where("anc is not null and r > own")
    above = above.join(merged.select(F.col("tax").alias("anc"), "n"), "anc")
    below = above.groupBy("anc").agg(F.sum("m").alias("w"))
    chains = above.join(below, "anc").groupBy("tax").agg(F.reverse(F.array_sort(F.collect_list(F.struct("r", "n", "w")))).alias("chain"))
    leaves = merged.join(below.select(F.col("anc").alias("tax")), "tax", "left_anti").join(chains, "tax", "left")
    down = F.aggregate(
        "chain", F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("w")),
        lambda a, x: F.struct((x["n"] + F.when(a["w"] > 0, a["f"] * (x["n"] + x["w"]) / a["w"]).otherwise(0.0)).alias("f"), x["w"].alias("w")),
    )
    return leaves.withColumn("_d", down).select("tax", (F.col("n") + F.coalesce(F.col("_d.f") * F.col("n") / F.col("_d.w"), F.lit(0.0))).alias("n"))


def abundance_table(counts: DataFrame, taxa: DataFrame, total: DataFrame) -> DataFrame:
    """(rank, name, taxid, n, pct): counts with names, and their percentage of all reads; a sequence shows its parent's id.

    The last row, of rank `none` and taxid 0, has the reads without a taxon. total: one row (total, unclassified).
    """
    rows = counts.join(taxa.select(F.col("id").alias("tax"), "rank", "name", "parent"), "tax").crossJoin(F.broadcast(total))  # one row
    taxid = F.when(F.col("tax") < 0, F.col("parent")).otherwise(F.col("tax"))
    pct = lambda n: F.when(F.col("total") > 0, 100 * F.col(n) / F.col("total")).otherwise(0.0).alias("pct")
    none = total.select(F.lit(NONE).alias("rank"), F.lit("unclassified").alias("name"), F.lit(0).cast("bigint").alias("taxid"), F.col("unclassified").cast("double").alias("n"), pct("unclassified"))
    return rows.select("rank", "name", taxid.alias("taxid"), "n", pct("n")).union(none)


def totals(reads: DataFrame, classified: DataFrame) -> DataFrame:
    """One row (total, unclassified): reads, and those without a taxon."""
    return reads.select("query_id").join(classified.select("query_id", "tax"), "query_id", "left").agg(F.count("*").alias("total"), F.sum(F.col("tax").isNull().cast("bigint")).alias("unclassified")).na.fill(0)
