"""What a user calls: build an index, add to it, query it, merge results."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.ranks import SEQUENCE
from ..operators import abundance, candidates, classify, evaluate, index, sketch, taxonomy
from ..options import BuildOptions, MergeOptions, QueryOptions
from ..sources.database import Index
from ..sources.sequences import filter_reads
from ..sources.taxonomy_files import assign_parents, first_parent, numbered_targets, target_id
from ..stored import stored


def make_targets(sequences: DataFrame, options: BuildOptions, offset: int = 0, sequence_map: DataFrame | None = None, file_map: DataFrame | None = None, accessions: DataFrame | None = None) -> DataFrame:
    """(tgt, id, name, given, parent, file, index, windows, seq) of sequences (file, index, header, seq), numbered by file and place.

    A name that repeats gets a suffix; `given` is as it was. The parent is that of the file, of the sequence in a map, or in the header; then, where
    there is none (for all with reset_taxa), that by the accession tables.
    """
    s = options.sketch
    rows = numbered_targets(sequences).withColumn("tgt", F.col("tgt") + offset).withColumn("name", ids.sequence_id(F.col("header"), options.sequence_id)).withColumn("gi", ids.gi(F.col("header")))
    by_file, by_name = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    if file_map is not None:
        rows = rows.join(file_map.select(F.col("seqid").alias("_f"), F.col("taxid").alias("_ft")), ids.filename(F.col("file")) == F.col("_f"), "left")
        by_file = F.col("_ft")
    if sequence_map is not None:
        rows = rows.join(sequence_map.select(F.col("seqid").alias("_s"), F.col("taxid").alias("_st")), F.col("name") == F.col("_s"), "left")
        by_name = F.col("_st")
    rows = rows.withColumn("parent", first_parent(by_file, by_name, ids.taxon_id(F.col("header"))))
    if accessions is not None:
        rows = assign_parents(rows.withColumn("parent", F.lit(0).cast("bigint")) if options.reset_taxa else rows, accessions)
    n, step = F.length("seq"), s.step
    full = F.floor((n - s.window) / step) + 1
    # The tail counts if it has a k-mer.
    count = F.when(n < s.k, 0).when(n <= s.window, 1).otherwise(full + (n - full * step >= s.k).cast("int"))
    rows = rows.select("tgt", target_id(F.col("tgt")).alias("id"), "name", F.col("name").alias("given"), F.coalesce("parent", F.lit(0)).cast("bigint").alias("parent"), "file", "index", count.cast("bigint").alias("windows"), "seq")
    return index.unique_names(rows, "given")


def all_lineages(taxa: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, lineage) of taxa and of targets, which are of the rank of sequences."""
    nodes = taxa.select("id", "parent", "rank").union(targets.select("id", "parent", F.lit(SEQUENCE).alias("rank")))
    return taxonomy.ranked_lineages(nodes)


def build_index(sequences: DataFrame, taxa: DataFrame, options: BuildOptions | None = None, **maps: DataFrame) -> Index:
    """An index of sequences (file, index, header, seq) under taxa (id, parent, name, rank)."""
    options = options or BuildOptions()
    targets = stored(make_targets(sequences, options, **maps), "targets")  # files are read once
    features = index.build(sketch.sketch(targets, "tgt", "seq", options.sketch), options.max_locations)
    lines = all_lineages(taxa, targets)
    out = Index(features, taxa, targets.drop("seq"), lines, options.sketch, options.max_locations)
    return clean_index(out, options)


def clean_index(out: Index, options: BuildOptions) -> Index:
    if options.remove_overpopulated:
        out = replace(out, features=index.remove_overpopulated(out.features, options.max_locations - 1))
    if options.remove_ambiguous_at is not None:
        out = replace(out, features=index.remove_ambiguous(out.features, out.target_lineages, options.remove_ambiguous_at, options.max_ambiguous))
    return out


def modify_index(old: Index, sequences: DataFrame, options: BuildOptions | None = None, **maps: DataFrame) -> Index:
    """An index with more targets, numbered after those it has."""
    options = replace(options or BuildOptions(), sketch=old.sketch, max_locations=old.max_locations)
    last = old.targets.agg(F.max("tgt")).first()[0]
    new = stored(make_targets(sequences, options, offset=0 if last is None else last + 1, **maps), "targets")
    features = index.add(old.features, sketch.sketch(new, "tgt", "seq", old.sketch).select("feature", F.col("owner").alias("tgt"), "win"), old.max_locations)
    targets = index.unique_names(old.targets.unionByName(new.drop("seq")), "given")
    return clean_index(Index(features, old.taxa, targets, all_lineages(old.taxa, targets), old.sketch, old.max_locations), options)


def replace_taxonomy(old: Index, taxa: DataFrame) -> Index:
    return replace(old, taxa=taxa, lineages=all_lineages(taxa, old.targets))


def held(db: Index) -> Index:
    """The index with its tables worked out and stored, to be queried without being saved."""
    return replace(db, **{n: stored(getattr(db, n), n) for n in ("features", "taxa", "targets", "lineages")})


@dataclass
class Answer:
    """What a query found; each is a DataFrame, and is worked out when it is used."""

    reads: DataFrame
    hits: DataFrame
    candidates: DataFrame
    classified: DataFrame
    counts: DataFrame


def all_taxa(db: Index) -> DataFrame:
    """(id, parent, name, rank) of taxa and targets."""
    return db.taxa.select("id", "parent", "name", "rank").union(db.targets.select("id", "parent", "name", F.lit(SEQUENCE).alias("rank")))


def query(db: Index, reads: DataFrame, options: QueryOptions | None = None, store_reads: bool = True) -> Answer:
    """Classifies reads (query_id, header, seq1, seq2, file) by an index. Reads are stored, as each output goes back to them; not so where they are stored already."""
    options = options or QueryOptions()
    own = options.sketch or replace(db.sketch, stride=None)
    c = options.classify.normalised(own.size)
    reads = filter_reads(reads, options.min_length, options.max_length, options.limit)
    if store_reads:
        reads = stored(reads, "reads")
    features = db.features
    if options.max_locations:
        features = index.remove_overpopulated(features, index.query_limit(options.max_locations, db.max_locations))
    hits = candidates.hits(sketch.sketch_pairs(reads, own), features)
    spans = reads.select("query_id", candidates.max_windows(F.length("seq1"), F.length("seq2"), c.insert_size, db.sketch.step).alias("n_win"))
    ranges = candidates.window_ranges(hits, spans)
    lines = db.target_lineages
    best = candidates.top_candidates(ranges, c.max_candidates) if c.lowest == SEQUENCE else candidates.top_candidates_at(ranges, lines, c.lowest, c.max_candidates)
    if c.cov_percentile:
        best = candidates.coverage_filter(best.where(F.col("hits") >= c.hits_min), db.targets, c.cov_percentile)
    classified = classify.classify(best, lines, c)
    return Answer(reads, hits, best, classified, abundance.taxon_counts(classified))


def evaluation(db: Index, answer: Answer) -> DataFrame:
    """Statistics per rank of an answer against the truth in its reads' headers."""
    return evaluate.rank_statistics(evaluate.correct_ranks(_with_truth(db, answer), db.lineages))


def _with_truth(db: Index, answer: Answer) -> DataFrame:
    truth = classify.ground_truth(answer.reads, db.targets, db.taxa, db.lineages)
    return truth.join(answer.classified.select("query_id", "tax"), "query_id", "left")


def coverage(db: Index, answer: Answer) -> DataFrame:
    """Per rank, whether the truth's taxa are in the index against whether reads were assigned there, with rates."""
    covered = taxonomy.targets_below(db.target_lineages).select("tax")
    return evaluate.confusion_rates(evaluate.coverage_statistics(_with_truth(db, answer), db.lineages, covered))


def merge_results(found: DataFrame, taxa: DataFrame, options: MergeOptions | None = None) -> DataFrame:
    """(query_id, tax, rank, hits) from the hits (query_id, tax, hits) of several result files.

    A taxon's hits in several files are not added: the most count. Candidates are merged at the lowest rank; unknown taxa are
    left out.
    """
    c = (options or MergeOptions()).normalised().classify
    lines = taxonomy.ranked_lineages(taxa)
    rows = found.where("tax is not null and hits > 0").join(lines.select(F.col("id").alias("_id"), "lineage"), F.col("tax") == F.col("_id"))
    rows = rows.select("query_id", taxonomy.lowest_ancestor_from(F.col("lineage"), c.lowest).alias("tax"), "hits").where("tax is not null")
    best = rows.groupBy("query_id", "tax").agg(F.max("hits").alias("hits")).withColumn("tgt", F.col("tax"))
    top = candidates.top_candidates(best, c.max_candidates)
    return classify.classify(top, lines.withColumnRenamed("id", "tax"), c, by="tax")
