"""Statistics of assignments against truth, per rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import N_RANKS, NONE
from .taxonomy import lca_rank


def correct_ranks(assigned: DataFrame, lineages: DataFrame) -> DataFrame:
    """(query_id, assigned, known, correct): lowest ranks of the assignment, the truth, and their common ancestor; `none` if there is none.

    assigned: (query_id, tax, truth); lineages: (id, lineage).
    """
    line = lambda c, out: lineages.select(F.col("id").alias(f"_{c}"), F.col("lineage").alias(out))
    rows = assigned.join(line("tax", "a"), F.col("tax") == F.col("_tax"), "left").join(line("truth", "b"), F.col("truth") == F.col("_truth"), "left")
    ranks = F.sequence(F.lit(0), F.lit(N_RANKS - 1))
    low = lambda c: F.coalesce(F.get(F.filter(ranks, lambda r: F.get(c, r).isNotNull()), F.lit(0)), F.lit(NONE))
    rows = rows.select("query_id", low(F.col("a")).alias("assigned"), low(F.col("b")).alias("known"), F.coalesce(lca_rank(F.col("a"), F.col("b"), F.lit(0)), F.lit(NONE)).alias("correct"))
    return rows.withColumn("correct", F.greatest("correct", "assigned", "known"))


def rank_statistics(ranks: DataFrame) -> DataFrame:
    """(rank, assigned, known, correct, wrong, and rates) for each rank: counts at it and below, but wrong at it and above.

    Reads without truth aren't known. A read counts as wrong one rank below its correct one, if that is above both its
    assigned and its known rank.
    """
    per = ranks.groupBy("assigned", "known", "correct").agg(F.count("*").alias("n"))  # at most 22**3 rows
    wrong = (F.col("known") != NONE) & (F.col("correct") > F.col("known")) & (F.col("correct") > F.col("assigned"))
    one = lambda r, what: F.struct(r.alias("rank"), F.lit(what).alias("what"))
    counts = [one(F.col("assigned"), "assigned"), one(F.col("known"), "known"), F.when(F.col("known") != NONE, one(F.col("correct"), "correct")), F.when(wrong, one(F.col("correct") - 1, "wrong"))]
    long = per.select(F.explode(F.array(*counts)).alias("x"), "n").where("x is not null").select("x.rank", "x.what", "n")
    at = long.groupBy("rank").pivot("what", ["assigned", "known", "correct", "wrong"]).agg(F.sum("n"))
    every = ranks.sparkSession.range(NONE + 1).select(F.col("id").cast("int").alias("rank")).join(at, "rank", "left").na.fill(0)
    below, above = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("assigned").over(Window.partitionBy())
    out = every.withColumn("total", total).where(F.col("rank") < NONE)
    out = out.select("rank", "total", *[F.sum(c).over(below).alias(c) for c in ("assigned", "known", "correct")], F.sum("wrong").over(above).alias("wrong"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return out.withColumns({"assigned_rate": rate(c("assigned"), c("total")), "sensitivity": rate(c("correct"), c("known")), "precision": rate(c("correct"), c("correct") + c("wrong"))})


def coverage_statistics(assigned: DataFrame, lineages: DataFrame, covered: DataFrame) -> DataFrame:
    """(rank, tp, fp, tn, fn): of reads with truth, whether the truth's taxon at a rank is in the index, against whether the read was assigned at that rank or below.

    covered: the taxa (tax) on lineages of targets.
    """
    line = lambda c, out: lineages.select(F.col("id").alias(f"_{c}"), F.col("lineage").alias(out))
    rows = assigned.where("truth is not null").join(line("tax", "a"), F.col("tax") == F.col("_tax"), "left").join(line("truth", "b"), F.col("truth") == F.col("_truth"), "left")
    at = rows.select(F.posexplode("b").alias("rank", "t"), "a").where("t is not null").select("rank", "t", (F.get("a", "rank").isNotNull()).alias("hit"))
    at = at.join(covered.select(F.col("tax").alias("_c")).distinct(), F.col("t") == F.col("_c"), "left")
    inside, hit = F.col("_c").isNotNull(), F.col("hit")
    count = lambda w: F.sum(w.cast("bigint"))
    return at.groupBy("rank").agg(count(inside & hit).alias("tp"), count(~inside & hit).alias("fp"), count(~inside & ~hit).alias("tn"), count(inside & ~hit).alias("fn"))


def confusion_rates(confusion: DataFrame) -> DataFrame:
    """Counts (tp, fp, tn, fn) with their rates; a rate without any case is 0."""
    c = F.col
    rate = lambda a, b: F.when(b != 0, a.cast("double") / b).otherwise(0.0)
    tp, fp, tn, fn = (c(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    out = confusion.withColumns({"sensitivity": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "precision": rate(tp, tp + fp), "negative_precision": rate(tn, tn + fn), "false_positive_rate": rate(fp, fp + tn), "false_negative_rate": rate(fn, fn + tp), "false_discovery_rate": rate(fp, fp + tp)})
    out = out.withColumns({"accuracy": rate(tp + tn, tp + tn + fp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "correlation": rate(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})
    return out.withColumns({"informedness": c("sensitivity") + c("specificity") - 1, "markedness": c("precision") + c("negative_precision") - 1})
