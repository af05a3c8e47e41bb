"""Assignment of reads to taxa by a lowest-common-ancestor vote, and their ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.ranks import NONE
from ..options import ClassifyOptions
from .taxonomy import lca_rank, nearest_name, next_ranked_ancestor


def classify(candidates: DataFrame, lineages: DataFrame, options: ClassifyOptions, by: str = "tgt") -> DataFrame:
    """(query_id, tax, rank, hits) for each read with candidates (query_id, pos, tgt or tax, hits); tax is null if unclassified.

    The first candidate must have hits_min hits. Candidates after it join the vote while their hits are above
    hits_diff times the first's hits over hits_min; the vote's taxon goes up the first one's lineage, and is void above the
    highest rank. by: `tgt`, lineages by target, or `tax`, by taxon. A candidate is the lowest taxon of its lineage that is not
    below the lowest rank.
    """
    rows = candidates.join(lineages.select(by, "lineage"), by, "left")
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hits", "lineage"))).alias("c"))  # max_candidates bounds it
    top = F.element_at("c", 1)
    least = F.lit(options.hits_min)
    # Single precision, as thresholds are elsewhere.
    over = F.when(top["hits"] > least, (top["hits"] - least).cast("float") * F.lit(options.hits_diff).cast("float")).otherwise(F.lit(0).cast("float"))
    ranks = F.sequence(F.lit(0), F.lit(NONE - 1))
    first = lambda line: F.coalesce(F.get(F.filter(ranks, lambda r: (r >= options.lowest) & F.get(line, r).isNotNull()), F.lit(0)), F.lit(NONE))
    state = lambda rank, going: F.struct(rank.cast("int").alias("rank"), going.alias("going"))

    def vote(a: Column, c: Column) -> Column:
        joins = a["going"] & (c["hits"].cast("float") > F.col("over"))
        up = F.coalesce(lca_rank(F.col("line"), c["lineage"], a["rank"]), F.lit(NONE))
        return F.when(joins, state(up, up <= options.highest)).otherwise(state(a["rank"], F.lit(False)))

    start = per.select("query_id", "c", over.alias("over"), top["lineage"].alias("line"), top["hits"].alias("hits"))
    start = start.withColumn("own", first(F.col("line")))
    rank = F.aggregate(F.filter("c", lambda _, i: i > 0), state(F.col("own"), F.lit(True)), vote)["rank"]
    out = start.withColumn("rank", F.when(F.col("hits") >= least, rank)).withColumn("rank", F.when(F.col("rank") <= options.highest, F.col("rank")))
    return out.select("query_id", F.get("line", "rank").alias("tax"), F.coalesce("rank", F.lit(NONE)).alias("rank"), "hits")


def ground_truth(reads: DataFrame, targets: DataFrame, taxa: DataFrame, lineages: DataFrame) -> DataFrame:
    """(query_id, truth): the taxon that a read's header names, as its nearest ranked ancestor.

    In order: a target named by the accession with version; the next target whose name begins with the accession; the taxid
    in the header; a target named by all of the header, its first word, or a file name in it.
    """
    h = F.col("header")
    keys = {"k1": ids.accession_version(h), "k2": ids.accession_bare(h), "k4": h, "k5": ids.leading_word(h), "k6": ids.filename(h)}
    rows = reads.select("query_id", *[F.when(v != "", v).alias(k) for k, v in keys.items()], ids.taxon_id(h).alias("k3"))
    named = targets.groupBy("name").agg(F.min("id").alias("id"))
    for k in ("k1", "k4", "k5", "k6"):
        rows = rows.join(named.select(F.col("name").alias(f"_{k}"), F.col("id").alias(f"t{k}")), F.col(k) == F.col(f"_{k}"), "left")
    near = nearest_name(rows.where("k2 is not null").select(F.col("k2").alias("name")), targets).join(named.withColumnRenamed("name", "found"), "found")
    rows = rows.join(near.select(F.col("name").alias("_k2"), F.col("id").alias("tk2")), F.col("k2") == F.col("_k2"), "left")
    rows = rows.join(taxa.select(F.col("id").alias("tk3")), F.col("k3") == F.col("tk3"), "left")
    found = rows.select("query_id", F.coalesce("tk1", "tk2", "tk3", "tk4", "tk5", "tk6").alias("id"))
    lines = lineages.select("id", next_ranked_ancestor(F.col("lineage")).alias("truth"))
    return found.join(lines, "id", "left").select("query_id", "truth")
