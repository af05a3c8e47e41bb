"""Text and table sinks of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import FormatOptions
from ..plans.report import as_text


def write_table(report: DataFrame, path: str, options: FormatOptions, split_by: str | None = None) -> None:
    """Lines of a report under path; with split_by, a folder for each value of that column, such as each input file."""
    options = options.normalised()
    if split_by is None:
        as_text(report, options).write.mode("overwrite").text(path)
        return
    rows = report.drop(split_by).columns
    columns = [c for c in rows if options.query_ids or c != "query_id"]
    line = F.concat_ws(options.separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    # A folder's name is the file's, without what comes before the last slash.
    name = F.regexp_replace(F.substring_index(split_by, "/", -1), "[^A-Za-z0-9._-]", "_")
    report.select(name.alias("source"), line.alias("value")).write.mode("overwrite").partitionBy("source").text(path)


def layout(report: DataFrame, options: FormatOptions, by_sequence: bool) -> list[str]:
    """The comment lines that let a result file be merged: what was classified, and the columns."""
    options = options.normalised()
    columns = [c for c in report.columns if options.query_ids or c != "query_id"]
    return [f"{options.comment}Classification will be by {'sequence' if by_sequence else 'taxon'}.", f"{options.comment}TABLE_LAYOUT: {options.separator.join(columns)}"]


def write_result_file(report: DataFrame, path: str, options: FormatOptions, by_sequence: bool) -> None:
    """A mapping report that can be merged: its comment lines in one file, its rows in others."""
    spark = report.sparkSession
    as_text(report, options).write.mode("overwrite").text(path)
    spark.createDataFrame([(line,) for line in layout(report, options, by_sequence)], "value string").coalesce(1).write.mode("append").text(path)


def krona(abundance: DataFrame, path: str) -> None:
    """Counts with names, as tab-separated lines for charts: count, then name."""
    abundance.select(F.concat_ws("\t", F.col("n").cast("string"), "name").alias("value")).write.mode("overwrite").text(path)


def summarise_results(spark: SparkSession, *paths: str, rank: str = "species") -> DataFrame:
    """(file, unclassified, classified, precision, sensitivity) in percent, from the statistics of result files at a rank."""
    number = lambda what: F.max(F.when(F.col("value").rlike(rf"^\W*{what}"), F.regexp_extract("value", r"([0-9.]+)\s*%", 1).try_cast("double")))
    lines = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), "value")
    at = lambda section: F.max(F.when(F.col("value").rlike(rf"(?i)^\W*{section}\W+.*\b{rank}\b|^\W*{rank}\W+{section}"), F.regexp_extract("value", r"([0-9.]+)\s*%", 1).try_cast("double")))
    return lines.groupBy("file").agg(number("unclassified").alias("unclassified"), number("classified").alias("classified"), at("precision").alias("precision"), at("sensitivity").alias("sensitivity"))


def summary_lines(ranks: DataFrame, options: FormatOptions, paired: bool = False, coverage: DataFrame | None = None) -> DataFrame:
    """A summary's comment lines, in order: `species precision: 12.3%` and so on."""
    from ..plans.report import summary_table

    rows = summary_table(ranks, paired, coverage).repartition(1).sortWithinPartitions("place")  # a few lines for each rank
    return rows.select(F.concat(F.lit(options.comment), "line").alias("value"))
