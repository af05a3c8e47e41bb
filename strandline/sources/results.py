"""Result files of earlier runs, for merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, query_id, header, tax, hits) of each `taxid:hits` in the top-hits column of result files.

    A file needs a comment line `Classification` that doesn't name sequences, and a `TABLE_LAYOUT:` line that begins with
    query_id and has top_hits; else it is an error. Items that aren't `number:number` are left out.
    """
    lines = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), "value")
    comments = lines.where("value like '#%'")
    heads = comments.groupBy("file").agg(
        F.max(F.when(F.col("value").contains("Classification"), F.col("value"))).alias("kind"), F.max(F.when(F.col("value").contains("TABLE_LAYOUT"), F.col("value"))).alias("layout")
    ).collect()  # two lines a file
    if not heads:
        raise ValueError("no result file")
    places = {}
    for h in heads:
        if not h["kind"] or "sequence" in h["kind"]:
            raise ValueError(f"{h['file']}: not classified by taxa")
        columns = [c.strip() for c in (h["layout"] or "").partition("TABLE_LAYOUT:")[2].split("|")]
        if columns[0] != "query_id" or "top_hits" not in columns:
            raise ValueError(f"{h['file']}: no query_id or top_hits")
        places[h["file"]] = columns.index("top_hits")
    place = F.create_map(*[x for f, p in places.items() for x in (F.lit(f), F.lit(p))])[F.col("file")]
    f = F.split("value", r"\t\|\t")
    rows = lines.where("value not like '#%' and value <> ''").select("file", F.trim(F.get(f, F.lit(0))).try_cast("bigint").alias("query_id"), F.get(f, F.lit(1)).alias("header"), F.get(f, place).alias("top"))
    items = rows.where("query_id is not null").select("file", "query_id", "header", F.explode_outer(F.split("top", ",")).alias("x"))
    pair = lambda i: F.regexp_extract("x", r"^\s*(-?[0-9]+):([0-9]+)\s*$", i).try_cast("bigint")
    return items.select("file", "query_id", "header", pair(1).alias("tax"), pair(2).alias("hits"))


def partition_by_size(files: list[tuple[str, int]], limit: int) -> list[list[str]]:
    """Files, in order, in groups of at most `limit` bytes; a larger file is a group of its own."""
    out: list[list[str]] = []
    room = 0
    for name, size in files:
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(name)
        room -= size
    return out
