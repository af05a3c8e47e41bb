"""From features of reads to candidates: hits, window ranges, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hits(sketches: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, tgt, win, n): how often each location is hit by a read; a feature in several of its windows counts each time.

    Features that occur nowhere in the index leave by a runtime filter of the join; the limit of locations bounds its growth.
    """
    q = sketches.groupBy(F.col("owner").alias("query_id"), "feature").agg(F.count("*").alias("c"))
    return q.join(index, "feature").groupBy("query_id", "tgt", "win").agg(F.sum("c").alias("n"))


def max_windows(len1: Column, len2: Column, insert_size: int, stride: int) -> Column:
    """Consecutive target windows that a read, with its mate, can cover."""
    longest = F.greatest(len1 + F.coalesce(len2, F.lit(0)), F.lit(insert_size))
    return (2 + F.floor(longest / stride)).cast("bigint")


def window_ranges(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """(query_id, tgt, hits, beg, end): in each target, the range of at most n_win windows with most hits, the first of equals.

    A range ends at a hit window and begins at the first hit within n_win before it. reads: (query_id, n_win).
    """
    best = all_ranges(hits, reads).groupBy("query_id", "tgt").agg(F.max(F.struct("hits", (-F.col("end")).alias("_e"), "beg")).alias("x"))
    return best.select("query_id", "tgt", F.col("x.hits").alias("hits"), F.col("x.beg").alias("beg"), (-F.col("x._e")).alias("end"))


def all_ranges(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """Every range: one for each hit window at its end. Work grows with the hits times the windows of a range.

    A frame of fixed width slides over windows in units of the read's range, n_win - 1 steps. The width has a little more
    than one unit, for rounding; the next window is a whole step further.
    """
    rows = hits.join(reads.select("query_id", "n_win"), "query_id").withColumn("_u", F.col("win") / F.greatest(F.col("n_win") - 1, F.lit(0.5)))
    over = "OVER (PARTITION BY query_id, tgt ORDER BY _u RANGE BETWEEN 1.000001D PRECEDING AND CURRENT ROW)"
    return rows.select("query_id", "tgt", F.col("win").alias("end"), F.expr(f"sum(n) {over}").alias("hits"), F.expr(f"min(win) {over}").alias("beg"))


def top_candidates(ranges: DataFrame, k: int) -> DataFrame:
    """(…, pos): the k best ranges of each read, most hits first, then the lesser target."""
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "tgt")
    return ranges.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def top_candidates_at(ranges: DataFrame, lineages: DataFrame, rank: int, k: int) -> DataFrame:
    """The k best of each read after merging at a rank: each range counts for its target's lowest ancestor of that rank or above,
    the best range of a taxon stays (the lesser target of equals), and targets without such an ancestor are left out."""
    tax = F.get(F.filter(F.slice("lineage", rank + 1, 21 - rank), lambda x: x.isNotNull()), F.lit(0))
    rows = ranges.join(lineages.select("tgt", tax.alias("tax")).where("tax is not null"), "tgt")
    best = rows.groupBy("query_id", "tax").agg(F.max(F.struct("hits", (-F.col("tgt")).alias("_t"), "beg", "end")).alias("x"))
    best = best.select("query_id", "tax", (-F.col("x._t")).alias("tgt"), "x.hits", "x.beg", "x.end")
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "tgt")
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def hits_per_target(candidates: DataFrame) -> DataFrame:
    """(tgt, matches): `query/first window+further windows:hits`, by range, then read."""
    item = lambda x: F.concat(x["query_id"].cast("string"), F.lit("/"), x["beg"].cast("string"), F.lit("+"), (x["end"] - x["beg"]).cast("string"), F.lit(":"), x["hits"].cast("string"))
    return candidates.groupBy("tgt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("beg", "end", "query_id", "hits"))), item), ",").alias("matches"))


def coverage_filter(candidates: DataFrame, targets: DataFrame, percentile: float) -> DataFrame:
    """Candidates on targets that are left when the worst-covered go: in order of coverage (hit windows over windows; of equals
    the lesser target first), targets go while the running sum is at most percentile times the sum."""
    hit = candidates.select("tgt", F.explode(F.sequence("beg", "end")).alias("w")).distinct().groupBy("tgt").agg(F.count("*").alias("c"))
    cov = hit.join(targets.select("tgt", "windows"), "tgt").select("tgt", (F.col("c") / F.greatest("windows", F.lit(1))).alias("cov"))
    # One row a target that was hit.
    by_cov = Window.orderBy("cov", "tgt").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    kept = cov.withColumns({"_run": F.sum("cov").over(by_cov), "_all": F.sum("cov").over(every)}).where(F.round("_run", 9) > F.round(F.lit(percentile) * F.col("_all"), 9))
    return candidates.join(kept.select("tgt"), "tgt", "left_semi")
