"""The tree: lineages, ancestors, and lowest common ancestors as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import N_RANKS, NONE, ROOT
from ..stored import stored


def full_lineages(taxa: DataFrame, known_depth: int | None = None) -> DataFrame:
    """(id, depth, ancestor, rank): each taxon at depth 0 and all its ancestors; stops at a missing node or one that is its own parent.

    By doubling: a pass joins paths of up to d steps with paths of up to d, so log2(depth) passes reach the root; passes go
    on until none is longer. A caller who knows that no path has over known_depth steps saves the looking. A cycle is an error.
    """
    taxa = taxa.where("id is not null")
    own = taxa.select("id", F.lit(0).alias("depth"), F.col("id").alias("ancestor"))
    step = taxa.where("parent is not null and parent <> id").join(taxa.select(F.col("id").alias("_p")), F.col("parent") == F.col("_p")).select("id", F.lit(1).alias("depth"), F.col("parent").alias("ancestor"))
    paths, reach = own.union(step), 1
    while known_depth is None or reach < known_depth:
        if known_depth is None and reach >= 8:  # the plan would double with each pass
            paths = stored(paths, "paths")
            if paths.where(F.col("depth") == reach).isEmpty():
                break
            if reach > taxa.count():
                raise ValueError("the taxonomy has a cycle")
        far = paths.where(F.col("depth") == reach).select(F.col("id").alias("_i"), F.col("ancestor").alias("_a"))
        more = far.join(paths.where("depth > 0"), F.col("_a") == F.col("id")).select(F.col("_i").alias("id"), (F.col("depth") + reach).alias("depth"), "ancestor")
        paths, reach = paths.union(more), reach * 2
    rank = taxa.select(F.col("id").alias("_r"), "rank")
    return paths.join(rank, F.col("ancestor") == F.col("_r")).select("id", "depth", "ancestor", "rank")


def ranked_lineages(taxa: DataFrame, known_depth: int | None = None) -> DataFrame:
    """(id, lineage): an array by rank of the taxon or ancestor of that rank, null where there is none; of two, that nearest the root."""
    paths = full_lineages(taxa, known_depth).where(F.col("rank") < N_RANKS)
    per = paths.groupBy("id", "rank").agg(F.max(F.struct("depth", "ancestor")).alias("x")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x.ancestor"))).alias("m"))
    empty = F.create_map().cast("map<int,bigint>")
    slots = F.transform(F.sequence(F.lit(0), F.lit(N_RANKS - 1)), lambda r: F.try_element_at(F.coalesce("m", empty), r))
    return taxa.select("id").join(per, "id", "left").select("id", slots.alias("lineage"))


def next_ranked_ancestor(lineage: Column) -> Column:
    """The first ancestor with a rank, the taxon itself included."""
    return F.get(F.filter(lineage, lambda x: x.isNotNull()), F.lit(0))


def ancestor_at(lineage: Column, rank: int) -> Column:
    return F.get(lineage, F.lit(rank))


def lowest_ancestor_from(lineage: Column, rank: int) -> Column:
    return F.get(F.filter(F.slice(lineage, rank + 1, N_RANKS - rank), lambda x: x.isNotNull()), F.lit(0))


def lca_rank(a: Column, b: Column, lowest: Column) -> Column:
    """The least rank, from lowest on, at which two lineages have the same taxon; null if there is none."""
    ranks = F.filter(F.sequence(F.lit(0), F.lit(N_RANKS - 1)), lambda r: (r >= lowest) & (F.get(a, r) == F.get(b, r)))
    return F.get(ranks, F.lit(0))


def ranked_lca(a: Column, b: Column, lowest: Column) -> Column:
    return F.get(a, lca_rank(a, b, lowest))


def full_lca(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b, lca) for pairs of taxa: the common ancestor, of any rank, that is nearest to a."""
    x = paths.select(F.col("id").alias("a"), F.col("depth").alias("da"), "ancestor")
    y = paths.select(F.col("id").alias("b"), F.col("ancestor").alias("_y"))
    rows = pairs.select("a", "b").distinct().join(x, "a").join(y, "b").where("ancestor = _y")
    return rows.groupBy("a", "b").agg(F.min(F.struct("da", "ancestor")).alias("m")).select("a", "b", F.col("m.ancestor").alias("lca"))


def resolve_merged(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """Nodes with merged ids rewritten to new ones, and old ids kept as unranked children of them; the first of equal ids stays."""
    m = merged.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n"))
    old = merged.select(F.col("old_id").alias("id"), F.col("new_id").alias("parent"), F.lit("").alias("name"), F.lit(NONE).alias("rank"), F.lit(0).alias("_first"))
    new = nodes.join(m, F.col("id") == F.col("_o"), "left").withColumn("id", F.coalesce("_n", "id")).drop("_o", "_n")
    new = new.join(m, F.col("parent") == F.col("_o"), "left").withColumn("parent", F.coalesce("_n", "parent")).select("id", "parent", "name", "rank", F.lit(1).alias("_first"))
    order = Window.partitionBy("id").orderBy("_first", "parent", "rank", "name")
    return old.union(new).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("id", "parent", "name", F.when(F.col("id") == 1, ROOT).otherwise(F.col("rank")).alias("rank"))


def targets_below(lineages: DataFrame) -> DataFrame:
    """(tax, n): how many targets have the taxon in their lineage."""
    return lineages.select(F.explode("lineage").alias("tax")).where("tax is not null").groupBy("tax").agg(F.count("*").alias("n"))


def targets_at(lineages: DataFrame, rank: int) -> DataFrame:
    """(tax, n): targets of each taxon of a rank; those without one are under 0."""
    return lineages.groupBy(F.coalesce(ancestor_at(F.col("lineage"), rank), F.lit(0)).alias("tax")).agg(F.count("*").alias("n"))


def erase_above(taxa: DataFrame, rank: int) -> DataFrame:
    return taxa.where(F.col("rank") <= rank)


def nearest_name(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """(name, found): for each name the least of the longer names that begin with it.

    Names are cut to the lengths that are looked for, so that it's an equi-join on the prefix.
    """
    wanted = names.select("name").distinct()
    lengths = [r[0] for r in wanted.select(F.length("name").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return wanted.withColumn("found", F.lit(None).cast("string"))
    cut = taxa.select(F.col("name").alias("found"), F.explode(F.array(*map(F.lit, lengths))).alias("n")).where("length(found) > n").select("found", F.expr("substring(found, 1, n)").alias("_p"))
    per = cut.groupBy("_p").agg(F.min("found").alias("found"))
    return wanted.join(per, F.col("name") == F.col("_p"), "left").select("name", "found")
