"""Scans of taxonomy dumps and of tables that map sequences to taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import NONE, rank_from_name
from ..operators.taxonomy import resolve_merged


def _dump(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a dump, which end in tab, bar and, but for the last, tab."""
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|\s*$", ""), r"\t\|\t").alias("f"))


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def read_taxonomy(spark: SparkSession, path: str, merged: bool = True) -> DataFrame:
    """(id, parent, name, rank) from nodes.dmp, names.dmp and merged.dmp in a folder.

    Of names in a scientific class the first stays (by line); a node without one is `--`, an empty one `<id>`. Lines without
    a numeric id are left out.
    """
    nodes = _dump(spark, f"{path}/nodes.dmp").select(_number(F.get("f", F.lit(0))).alias("id"), _number(F.get("f", F.lit(1))).alias("parent"), rank_from_name(F.trim(F.get("f", F.lit(2)))).alias("rank")).where("id is not null")
    lines = spark.read.text(f"{path}/names.dmp").select("value", F.monotonically_increasing_id().alias("line"))
    f = F.split(F.regexp_replace("value", r"\t\|\s*$", ""), r"\t\|\t")
    names = lines.select("line", _number(F.get(f, F.lit(0))).alias("_id"), F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(3)).alias("kind")).where("kind like '%scientific%'")
    names = names.groupBy("_id").agg(F.min_by("name", "line").alias("name"))
    out = nodes.join(names, F.col("id") == F.col("_id"), "left")
    out = out.select("id", "parent", F.when(F.col("name").isNull(), "--").when(F.col("name") == "", F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">"))).otherwise(F.col("name")).alias("name"), "rank")
    if merged:
        m = _dump(spark, f"{path}/merged.dmp").select(_number(F.get("f", F.lit(0))).alias("old_id"), _number(F.get("f", F.lit(1))).alias("new_id")).where("old_id is not null")
    else:
        m = spark.createDataFrame([], "old_id bigint, new_id bigint")
    return resolve_merged(out, m)


def read_assembly_map(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, taxid, line) from a table of sequences and taxa; the last of the leading lines with # names its columns.

    Taken are `taxid` and `accession.version` or `assembly_accession`; without such names the first two columns. The first
    line of a seqid stays.
    """
    head = ""
    for row in spark.read.text(path).limit(64).collect():  # the header only
        if not row[0].startswith("#"):
            break
        head = row[0].lstrip("# ")
    names = [n.strip() for n in head.split("\t")]
    tax = names.index("taxid") if "taxid" in names else 1
    key = next((names.index(n) for n in ("accession.version", "assembly_accession") if n in names), 0)
    f = F.split("value", "\t")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).where("value not like '#%'")
    rows = lines.select(F.get(f, F.lit(key)).alias("seqid"), _number(F.get(f, F.lit(tax))).alias("taxid"), "line").where("seqid is not null and taxid is not null")
    return rows.groupBy("seqid").agg(F.min_by("taxid", "line").alias("taxid"), F.min("line").alias("line"))


def read_accession_map(spark: SparkSession, *paths: str) -> DataFrame:
    """(acc, acc_ver, taxid, gi, line) from accession tables, whose first line is a header."""
    rows = spark.read.option("sep", "\t").option("header", "true").schema("acc string, acc_ver string, taxid bigint, gi string").csv(list(paths), enforceSchema=True)
    return rows.withColumn("line", F.monotonically_increasing_id())


def assign_parents(targets: DataFrame, accessions: DataFrame) -> DataFrame:
    """Targets with a parent where they had none: from the table by name as accession with version, then by the name up to its version, then by gi; of several rows the first.

    Targets: (tgt, name, gi, parent); 0 is no parent.
    """
    bare = F.regexp_extract("name", r"^([^.]+)", 1)
    out = targets.withColumn("_bare", bare)
    for key, column in (("acc_ver", "name"), ("acc", "_bare"), ("gi", "gi")):
        found = accessions.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by("taxid", "line").alias("_t"))
        out = out.join(found, (F.col(column) == F.col("_k")) & (F.col("parent") == 0), "left").withColumn("parent", F.when(F.col("parent") == 0, F.coalesce("_t", F.lit(0))).otherwise(F.col("parent"))).drop("_k", "_t")
    return out.drop("_bare")


def first_parent(file_taxid: Column, mapped: Column, header_taxid: Column) -> Column:
    """The parent of a sequence: its file's taxid, else its mapped one, else that in its header; 0 if there is none."""
    given = lambda c: F.when(c > 0, c)
    return F.coalesce(given(file_taxid), given(mapped), given(header_taxid), F.lit(0))


def target_id(tgt: Column) -> Column:
    """The taxon id of a target: negative."""
    return -tgt - 1


def unranked(rank: Column) -> Column:
    return rank == NONE


def numbered_targets(sequences: DataFrame) -> DataFrame:
    """Sequences (file, index, …) with tgt from 0, by file and index: offsets of files, then places in them."""
    per = sequences.groupBy("file").agg(F.max("index").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sequences.join(per.select(F.col("file").alias("_f"), before.alias("_o")), F.col("file") == F.col("_f")).withColumn("tgt", F.col("_o") + F.col("index") - 1).drop("_f", "_o")
