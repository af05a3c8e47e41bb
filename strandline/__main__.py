"""Command line: build, modify, query, build+query, merge and info."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ranks import ALIASES, RANKS, SPECIES
from .operators import abundance, candidates, index, taxonomy
from .options import BuildOptions, ClassifyOptions, FormatOptions, MergeOptions, QueryOptions, SketchOptions
from .plans import api, report
from .sources import sequences, sinks, taxonomy_files
from .sources.database import Index
from .sources.results import read_results


def rank_of(name: str) -> int:
    name = name.lower()
    if ALIASES.get(name, name) not in RANKS:
        raise argparse.ArgumentTypeError(f"no rank: {name}")
    return RANKS.index(ALIASES.get(name, name))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    modes = top.add_subparsers(dest="mode", required=True)

    def sketching(p):
        for name, default in (("kmerlen", 16), ("sketchlen", 16), ("winlen", 127), ("winstride", None)):
            p.add_argument(f"--{name}", type=int, default=default)

    def building(p):
        p.add_argument("--taxonomy", required="build" in p.prog)
        p.add_argument("--taxpostmap", nargs="*", default=[])
        p.add_argument("--sequence-map", nargs="*", default=[])
        p.add_argument("--sequence-id-format", default="smart", choices=["smart", "ncbi", "acc", "acc_ver", "gi", "word", "filename", "all"])
        p.add_argument("--reset-taxa", action="store_true")
        p.add_argument("--parts", type=int, default=1)
        p.add_argument("--max-locations-per-feature", type=int, default=254)
        p.add_argument("--remove-overpopulated-features", action="store_true")
        p.add_argument("--remove-ambig-features", type=rank_of)
        p.add_argument("--max-ambig-per-feature", type=int, default=1)

    def classifying(p):
        p.add_argument("--lowest", type=rank_of, default=0)
        p.add_argument("--highest", type=rank_of, default=RANKS.index("domain"))
        p.add_argument("--hitmin", type=int, default=0)
        p.add_argument("--hitdiff", type=float, default=1.0)
        p.add_argument("--maxcand", type=int, default=2)
        p.add_argument("--cov-percentile", type=float, default=0.0)

    def formatting(p):
        p.add_argument("--out", required=True)
        for name in ("taxids", "taxids-only", "omit-ranks", "separate-cols", "queryids", "tophits", "allhits", "hits-per-ref", "abundances", "ground-truth", "precision", "align", "mapped-only", "no-map", "split-out", "no-summary", "no-query-params", "lineage", "locations", "taxon-coverage"):
            p.add_argument(f"--{name}", action="store_true")
        p.add_argument("--abundance-per", type=rank_of)
        p.add_argument("--separator", default="\t|\t")
        p.add_argument("--comment", default="# ")

    def querying(p):
        pairing = p.add_mutually_exclusive_group()
        pairing.add_argument("--pairfiles", action="store_true")
        pairing.add_argument("--pairseq", action="store_true")
        for name in ("insertsize", "min-readlen"):
            p.add_argument(f"--{name}", type=int, default=0)
        p.add_argument("--max-readlen", type=int, default=2**31 - 1)
        p.add_argument("--query-limit", type=int)
        classifying(p)
        formatting(p)

    for mode in ("build", "modify"):
        p = modes.add_parser(mode)
        p.add_argument("db")
        p.add_argument("files", nargs="+")
        building(p)
        if mode == "build":
            sketching(p)
    p = modes.add_parser("query")
    p.add_argument("db")
    p.add_argument("files", nargs="+")
    p.add_argument("--max-locations-per-feature", type=int)
    querying(p)
    p = modes.add_parser("build+query")
    p.add_argument("files", nargs="+")
    p.add_argument("--targets", nargs="+", required=True)
    p.add_argument("--save-database")
    building(p)
    sketching(p)
    querying(p)
    p = modes.add_parser("merge")
    p.add_argument("files", nargs="+")
    p.add_argument("--taxonomy", required=True)
    classifying(p)
    formatting(p)
    p = modes.add_parser("info")
    p.add_argument("db")
    p.add_argument("what", nargs="?", default="config", choices=["config", "targets", "lineages", "rank", "statistics", "locations", "featurecounts"])
    p.add_argument("names", nargs="*")
    p.add_argument("--out")
    return top


def build_options(a: argparse.Namespace, own: SketchOptions) -> BuildOptions:
    return BuildOptions(own, a.max_locations_per_feature, a.remove_overpopulated_features, a.remove_ambig_features, a.max_ambig_per_feature, a.sequence_id_format, a.reset_taxa, a.parts)


def maps(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    out = {}
    if a.sequence_map:
        rows = [taxonomy_files.read_assembly_map(spark, p) for p in a.sequence_map]
        table = rows[0]
        for r in rows[1:]:
            table = table.union(r.join(table.select("seqid"), "seqid", "left_anti"))  # the first file's mapping stays
        out |= {"sequence_map": table, "file_map": table}
    if a.taxpostmap:
        out["accessions"] = taxonomy_files.read_accession_map(spark, *a.taxpostmap)
    return out


def built(spark: SparkSession, a: argparse.Namespace, files: list[str]) -> Index:
    own = SketchOptions(a.kmerlen, a.sketchlen, a.winlen, a.winstride)
    return api.build_index(sequences.read_sequences(spark, *files), taxonomy_files.read_taxonomy(spark, a.taxonomy), build_options(a, own), **maps(spark, a))


def run_build(spark: SparkSession, a: argparse.Namespace) -> None:
    built(spark, a, a.files).save(a.db, a.parts)


def run_build_query(spark: SparkSession, a: argparse.Namespace) -> None:
    """Builds an index and queries it, without saving it unless asked to."""
    db = built(spark, a, a.targets)
    if a.save_database:
        db.save(a.save_database, a.parts)
        db = Index.load(spark, a.save_database)
    else:
        db = api.held(db)
    a.max_locations_per_feature = None
    answer_query(spark, a, db)


def run_modify(spark: SparkSession, a: argparse.Namespace) -> None:
    """The new index is written beside the old one, which it is read from, and then takes its place."""
    old = Index.load(spark, a.db)
    if a.taxonomy:
        old = api.replace_taxonomy(old, taxonomy_files.read_taxonomy(spark, a.taxonomy))
    new = api.modify_index(old, sequences.read_sequences(spark, *a.files), build_options(a, old.sketch), **maps(spark, a))
    new.save(f"{a.db}.new", a.parts)
    jvm = spark._jvm
    at, beside = jvm.org.apache.hadoop.fs.Path(a.db), jvm.org.apache.hadoop.fs.Path(f"{a.db}.new")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    before = jvm.org.apache.hadoop.fs.Path(f"{a.db}.old")
    fs.rename(at, before)
    fs.rename(beside, at)
    fs.delete(before, True)


def format_options(a: argparse.Namespace) -> FormatOptions:
    view = "none" if a.no_map else "mapped" if a.mapped_only else "all"
    return FormatOptions(a.taxids, a.taxids_only, a.omit_ranks, a.separate_cols, a.separator, a.comment, a.queryids or a.hits_per_ref, a.lineage, view, a.tophits, a.allhits, a.locations, a.ground_truth, a.lowest, a.highest).normalised()


def run_query(spark: SparkSession, a: argparse.Namespace) -> None:
    answer_query(spark, a, Index.load(spark, a.db))


def answer_query(spark: SparkSession, a: argparse.Namespace, db: Index) -> None:
    fmt = format_options(a)
    rows = sequences.read_sequences(spark, *a.files)
    reads = sequences.paired_files(rows) if a.pairfiles else sequences.paired_in_file(rows) if a.pairseq else sequences.unpaired(rows)
    c = ClassifyOptions(a.lowest, a.highest, a.hitmin, a.hitdiff, a.maxcand, a.cov_percentile, a.insertsize)
    asked = QueryOptions(c, None, a.min_readlen, a.max_readlen, a.query_limit, "none", a.max_locations_per_feature)
    answer = api.query(db, reads, asked)
    taxa = api.all_taxa(db)
    truth = api.classify.ground_truth(answer.reads, db.targets, db.taxa, db.lineages) if a.ground_truth else None
    by_sequence = a.lowest == 0
    tops = report.top_hits(answer.candidates, db.targets if by_sequence else None) if a.tophits else None
    hits = report.all_hits(answer.hits, db.targets, None if by_sequence else report.ancestor_names(db.target_lineages, taxa, a.lowest)) if a.allhits else None
    spans = report.locations(answer.candidates, db.sketch.window, db.sketch.step) if a.locations else None
    table = report.mapping(answer.reads, answer.classified, taxa, fmt, tops, hits, truth, spans, db.lineages)
    if fmt.map_view != "none":
        if a.split_out:
            sinks.write_table(table.join(answer.reads.select("query_id", "file"), "query_id"), f"{a.out}/mapping", fmt, "file")
        else:
            sinks.write_result_file(table, f"{a.out}/mapping", fmt, by_sequence)
    if a.hits_per_ref:
        lines = report.taxon_lines(taxa, db.lineages, replace(fmt, lowest=0))
        sinks.write_table(report.hits_per_target(candidates.hits_per_target(answer.candidates), db.targets, lines), f"{a.out}/hits_per_ref", fmt)
    total = abundance.totals(answer.reads, answer.classified)
    if a.abundances:
        sinks.write_table(abundance.abundance_table(answer.counts, taxa, total).orderBy(F.desc("rank"), "taxid"), f"{a.out}/abundances", fmt)
    if a.abundance_per is not None:
        sinks.write_table(abundance.abundance_table(abundance.estimate(answer.counts, db.lineages, taxa, a.abundance_per), taxa, total), f"{a.out}/abundance_estimate", fmt)
    if not a.no_summary:
        covered = api.coverage(db, answer) if a.taxon_coverage else None
        sinks.summary_lines(api.evaluation(db, answer), fmt, a.pairfiles or a.pairseq, covered).write.mode("overwrite").text(f"{a.out}/statistics")
        if covered is not None:
            covered.write.mode("overwrite").parquet(f"{a.out}/taxon_coverage")
    if not a.no_query_params:
        sinks.write_table(report.parameters(asked, db), f"{a.out}/parameters", fmt)
    if a.align:
        from .operators import align

        seqs = sequences.read_sequences(spark, *[r[0] for r in db.targets.select("file").distinct().collect()])  # file names only
        targets = db.targets.join(seqs.select("file", "index", "seq"), ["file", "index"]).select("tgt", "seq")
        align.alignments(answer.candidates, answer.reads, targets, db.sketch.window, db.sketch.step, answer.classified).write.mode("overwrite").parquet(f"{a.out}/alignments")


def run_merge(spark: SparkSession, a: argparse.Namespace) -> None:
    if len(a.files) < 2:
        raise SystemExit("merging takes two result files or more")
    taxa, fmt = taxonomy_files.read_taxonomy(spark, a.taxonomy), format_options(a)
    found = read_results(spark, *a.files)
    merged = api.merge_results(found, taxa, MergeOptions(ClassifyOptions(a.lowest, a.highest, a.hitmin, a.hitdiff, a.maxcand)))
    reads = found.groupBy("query_id").agg(F.min("header").alias("header"))
    sinks.write_table(report.mapping(reads, merged, taxa, replace(fmt, query_ids=True, lowest=max(a.lowest, SPECIES)), lineages=taxonomy.ranked_lineages(taxa)), f"{a.out}/mapping", replace(fmt, query_ids=True))
    if a.abundances:
        sinks.write_table(abundance.abundance_table(abundance.taxon_counts(merged), taxa, abundance.totals(reads, merged)), f"{a.out}/abundances", fmt)


def run_info(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    db = Index.load(spark, a.db)
    if a.what == "lineages":
        return report.lineage_info(db, a.names)
    if a.what == "targets":
        out = report.target_info(db)
        return out.where(F.col("name").isin(a.names)) if a.names else out
    if a.what == "rank":
        return taxonomy.targets_at(db.target_lineages, rank_of(a.names[0] if a.names else "species")).join(api.all_taxa(db).select(F.col("id").alias("tax"), "name"), "tax", "left")
    if a.what == "statistics":
        return index.bucket_statistics(db.features)
    if a.what == "locations":
        return index.feature_map(db.features)
    return index.feature_counts(db.features) if a.what == "featurecounts" else report.properties(db)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"strandline {a.mode}").getOrCreate()
    out = {"build": run_build, "build+query": run_build_query, "modify": run_modify, "query": run_query, "merge": run_merge, "info": run_info}[a.mode](spark, a)
    if isinstance(out, DataFrame):
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
        else:
            out.show(1000, truncate=False)


if __name__ == "__main__":
    main()
