"""Reports: DataFrames of what a run found, and their text forms."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import display_header
from ..functions.ranks import MAIN, NONE, RANKS, ROOT, rank_name
from ..options import FormatOptions, QueryOptions
from ..sources.database import Index


def taxon_text(rank: Column, name: Column, taxid: Column, options: FormatOptions) -> Column:
    """A taxon as rank:name(taxid), by what the options ask for; `--` for none."""
    after_rank, _, before, after = options.tokens
    body = taxid.cast("string") if options.taxids_only else F.concat(name, F.lit(before), taxid.cast("string"), F.lit(after)) if options.taxids else name
    text = body if options.omit_ranks else F.concat(F.when(rank == NONE, F.lit("--")).otherwise(rank_name(rank)), F.lit(after_rank), body)
    return F.coalesce(text, F.lit("--"))


def no_taxon(options: FormatOptions) -> str:
    """What stands for an unclassified read: one sign, or with separate columns an empty taxon for each rank."""
    if not options.separate_cols:
        return "0" if options.taxids_only and options.omit_ranks else "--"
    after_rank, between, before, after = options.tokens
    body = "0" if options.taxids_only else f"--{before}0{after}" if options.taxids else "--"
    one = body if options.omit_ranks else f"--{after_rank}{body}"
    return between.join([one] * ((options.highest if options.lineage else options.lowest) - options.lowest + 1))


def taxon_lines(taxa: DataFrame, lineages: DataFrame, options: FormatOptions) -> DataFrame:
    """(id, text): each taxon (id, name, rank) as text, or with lineage its ancestors, too, up to the highest rank.

    It begins at the taxon's rank or the lowest one, whichever is higher; a rank without a taxon is `--` with id 0. Taxa
    above the highest rank are left out: they count as none.
    """
    info = taxa.select("id", "rank", "name")
    low = F.greatest(F.col("rank"), F.lit(options.lowest))
    high = F.greatest(low, F.lit(options.highest)) if options.lineage else low
    rows = info.where(F.col("rank") <= options.highest).join(lineages.select(F.col("id").alias("_l"), "lineage"), F.col("id") == F.col("_l"))
    rows = rows.select("id", "lineage", F.explode(F.sequence(low, high)).alias("r")).select("id", "r", F.get("lineage", F.col("r")).alias("anc"))
    rows = rows.join(info.select(F.col("id").alias("_a"), "name"), F.col("anc") == F.col("_a"), "left")
    text = taxon_text(F.col("r"), F.coalesce("name", F.lit("--")), F.coalesce("anc", F.lit(0)), options)
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))).alias("x"))  # a row for each rank
    return per.select("id", F.array_join(F.transform("x", lambda e: e["t"]), options.tokens[1]).alias("text"))


def top_hits(candidates: DataFrame, taxa: DataFrame | None = None) -> DataFrame:
    """(query_id, top_hits): `name:hits` of targets, or `taxid:hits`, best first."""
    label = F.col("tax").cast("string") if taxa is None else F.col("name")
    rows = candidates if taxa is None else candidates.join(taxa.select("tgt", "name"), "tgt")
    items = F.array_sort(F.collect_list(F.struct("pos", F.concat(label, F.lit(":"), F.col("hits").cast("string")).alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), ",").alias("top_hits"))


def all_hits(hits: DataFrame, targets: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(query_id, all_hits): `name/win:n` of each location hit, by target and window; with ancestors (tgt, name), `ancestor:n`."""
    item = F.concat(F.col("name"), F.lit("/"), F.col("win").cast("string"), F.lit(":"), F.col("n").cast("string"))
    rows = hits.join(targets.select("tgt", "name"), "tgt")
    if ancestors is not None:
        rows = rows.join(ancestors.select("tgt", F.col("name").alias("_up")), "tgt", "left")
        item = F.concat(F.coalesce("_up", "name"), F.lit(":"), F.col("n").cast("string"))
    rows = rows.select("query_id", F.struct("tgt", "win", item.alias("t")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ",").alias("all_hits"))


def ancestor_names(target_lineages: DataFrame, taxa: DataFrame, rank: int) -> DataFrame:
    """(tgt, name): the name of each target's ancestor at a rank, where it has one."""
    rows = target_lineages.select("tgt", F.get("lineage", F.lit(rank)).alias("_a")).where("_a is not null")
    return rows.join(taxa.select(F.col("id").alias("_i"), "name"), F.col("_a") == F.col("_i")).select("tgt", "name")


def locations(candidates: DataFrame, window: int, stride: int) -> DataFrame:
    """(query_id, candidate_locations): the part of its target that each candidate's windows cover, best first."""
    span = F.concat(F.lit("["), (stride * F.col("beg")).cast("string"), F.lit(","), (stride * F.col("end") + window).cast("string"), F.lit("]"))
    items = F.array_sort(F.collect_list(F.struct("pos", span.alias("t"))))
    return candidates.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), " ").alias("candidate_locations"))


def hits_per_target(matches: DataFrame, targets: DataFrame, lines: DataFrame) -> DataFrame:
    """(sequence, windows_in_sequence, matches) of each target with hits; lines: (id, text) of targets, with or without lineage."""
    rows = matches.join(targets.select("tgt", "id", "windows"), "tgt").join(lines, "id")
    return rows.select(F.col("text").alias("sequence"), F.col("windows").alias("windows_in_sequence"), "matches")


def mapping(reads: DataFrame, classified: DataFrame, taxa: DataFrame, options: FormatOptions, tops: DataFrame | None = None, hits: DataFrame | None = None, truth: DataFrame | None = None, spans: DataFrame | None = None, lineages: DataFrame | None = None) -> DataFrame:
    """A row for each read: query_id, header, what of truth, all_hits, top_hits and candidate_locations is given, and taxon. Lineages are for options that show them."""
    options = options.normalised()
    if lineages is None:
        if options.lineage:
            raise ValueError("lineages are not given")
        lines = taxa.select(F.col("id").alias("_id"), taxon_text(F.col("rank"), F.col("name"), F.col("id"), options).alias("text"))
    else:
        lines = taxon_lines(taxa, lineages, options).withColumnRenamed("id", "_id")
    named = lambda df, c, out: df.join(lines, F.col(c) == F.col("_id"), "left").withColumn(out, F.coalesce("text", F.lit(no_taxon(options)))).drop("_id", "text")
    out = reads.select("query_id", display_header(F.col("header")).alias("header")).join(classified.select("query_id", "tax"), "query_id", "left")
    columns = ["query_id", "header"]
    if truth is not None:
        out, columns = out.join(named(truth, "truth", "truth"), "query_id", "left"), [*columns, "truth"]
    for extra, name in ((hits, "all_hits"), (tops, "top_hits"), (spans, "candidate_locations")):
        if extra is not None:
            out, columns = out.join(extra, "query_id", "left").na.fill("", [name]), [*columns, name]
    if options.map_view == "mapped":
        out = out.where("tax is not null")
    elif options.map_view == "none":
        out = out.limit(0)
    return named(out, "tax", "taxon").select(*columns, "taxon")


def as_text(report: DataFrame, options: FormatOptions) -> DataFrame:
    """Lines of a report; query ids are left out unless asked for."""
    options = options.normalised()
    columns = [c for c in report.columns if options.query_ids or c != "query_id"]
    return report.select(F.concat_ws(options.separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


#: Ranks that summaries list. Fixed values.
SUMMARY = ("sequence", "subspecies", "species", "genus", "family", "order", "class", "phylum", "kingdom", "domain", "root")


def summary(ranks: DataFrame) -> DataFrame:
    """Statistics of the ranks that summaries list, by name."""
    listed = [(RANKS.index(m), m) for m in SUMMARY]
    return ranks.join(ranks.sparkSession.createDataFrame(listed, "_r int, name string"), F.col("rank") == F.col("_r")).drop("_r")


def summary_table(ranks: DataFrame, paired: bool, coverage: DataFrame | None = None) -> DataFrame:
    """(place, line): queries, twice for pairs, and for each rank with reads what was classified, known, correct, and its rates."""
    rows = summary(ranks)
    if coverage is not None:
        rows = rows.join(coverage.select(F.col("rank").alias("_c"), "fp"), F.col("rank") == F.col("_c"), "left")
    percent = lambda c: F.concat(F.round(100 * c, 4).cast("string"), F.lit("%"))
    share = lambda n: F.concat(percent(F.col(n) / F.greatest("total", F.lit(1))), F.lit(" ("), F.col(n).cast("string"), F.lit(")"))
    parts = [("classified", share("assigned")), ("known", share("known")), ("correct", F.col("correct").cast("string")), ("precision", percent(F.col("precision"))), ("sensitivity", percent(F.col("sensitivity")))]
    if coverage is not None:
        parts.append(("false positives", F.coalesce(F.col("fp"), F.lit(0)).cast("string")))
    lines = F.array(*[F.struct((F.lit(100 * (i + 1)) + F.col("rank")).alias("place"), F.concat(F.col("name"), F.lit(f" {what}: "), text).alias("line")) for i, (what, text) in enumerate(parts)])
    out = rows.where("assigned > 0").select(F.explode(lines).alias("x")).select("x.place", "x.line")
    last = ranks.agg(F.max("total").alias("t"), F.max(F.when(F.col("rank") == ROOT, F.col("assigned"))).alias("a"))
    head = lambda place, text: F.struct(F.lit(place).alias("place"), text.alias("line"))
    none = F.col("t") - F.coalesce("a", F.lit(0))
    top = last.select(F.explode(F.array(head(0, F.concat(F.lit("queries: "), (F.coalesce("t", F.lit(0)) * (2 if paired else 1)).cast("string"))), head(1, F.concat(F.lit("unclassified: "), percent(none / F.greatest("t", F.lit(1))), F.lit(" ("), none.cast("string"), F.lit(")"))))).alias("x"))
    return top.select("x.place", "x.line").union(out)


def parameters(options: QueryOptions, index: Index) -> DataFrame:
    """(parameter, value) of a query, as it runs: with what follows from the index."""
    own = options.sketch or replace(index.sketch, stride=None)
    c = options.classify.normalised(own.size)
    rows = {"k": own.k, "sketch size": own.size, "window length": own.window, "window stride": own.step, "lowest rank": RANKS[c.lowest], "highest rank": RANKS[c.highest], "hits at least": c.hits_min, "hit difference": c.hits_diff, "candidates at most": c.max_candidates, "coverage percentile": c.cov_percentile, "insert size": c.insert_size, "read length at least": options.min_length, "read length at most": options.max_length, "locations per feature at most": options.max_locations or index.max_locations}
    return index.features.sparkSession.createDataFrame([(k, str(v)) for k, v in rows.items()], "parameter string, value string")


def target_info(index: Index) -> DataFrame:
    """(tgt, id, name, file, index, windows, and an id for each main rank; 0 where it's missing)."""
    cols = [F.coalesce(F.get("lineage", F.lit(RANKS.index(m))), F.lit(0)).alias(m) for m in MAIN if m != "sequence"]
    return index.targets.join(index.target_lineages, "tgt", "left").select("tgt", "id", "name", "file", "index", "windows", *cols)


def properties(index: Index) -> DataFrame:
    """(property, value) of an index's parameters."""
    s = index.sketch
    rows = [("k", s.k), ("sketch size", s.size), ("window length", s.window), ("window stride", s.step), ("max locations per feature", index.max_locations), ("ranks", NONE)]
    return index.features.sparkSession.createDataFrame([(a, str(b)) for a, b in rows], "property string, value string")


def lineage_info(index: Index, names: list[str] | None = None) -> DataFrame:
    """(name, and the id of each rank, 0 where it's missing) of targets, of all or of those named."""
    rows = index.targets.join(index.target_lineages, "tgt", "left")
    if names:
        rows = rows.where(F.col("name").isin(names))
    return rows.select("name", *[F.coalesce(F.get("lineage", F.lit(i)), F.lit(0)).alias(r) for i, r in enumerate(RANKS[:NONE])])
