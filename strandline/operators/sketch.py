"""Sketching: windows of sequences become features, in one vectorised pass and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import sketches_of
from ..options import SketchOptions
from ..shipping import ship

#: Letters that are sketched at once, and as much of a longer text as it has.
LETTERS = 1_000_000


def windows(seqs: DataFrame, owner: str, seq: str, options: SketchOptions) -> DataFrame:
    """(owner, win, begin, window): the windows of each sequence that have at least k letters, as text."""
    n, w, s = F.length(seq), options.window, options.step
    full = F.floor((n - w) / s)
    last = F.when((full + 1) * s < n, full + 1).otherwise(full)
    number = F.when(n <= w, F.lit(0)).otherwise(last)
    rows = seqs.where(n > 0).select(F.col(owner).alias("owner"), seq, F.explode(F.sequence(F.lit(0).cast("bigint"), number.cast("bigint"))).alias("win"))
    begin = F.col("win") * s
    return rows.select("owner", "win", begin.alias("begin"), F.substring(F.col(seq), (begin + 1).cast("int"), F.lit(w)).alias("window")).where(F.length("window") >= options.k)


def kmers(seqs: DataFrame, owner: str, seq: str, k: int) -> DataFrame:
    """(owner, at, kmer) of every unambiguous k-mer, by expressions; U counts as T."""
    text = F.upper(F.col(seq))
    rows = seqs.where(F.length(seq) >= k).select(F.col(owner).alias("owner"), text.alias("s"), F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias("at"))
    return rows.select("owner", (F.col("at") - 1).cast("bigint").alias("at"), F.expr(f"substring(s, at, {k})").alias("kmer")).where(~F.col("kmer").rlike("[^ACGTU]"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where the files give fewer partitions than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sketch(seqs: DataFrame, owner: str, seq: str | Column, options: SketchOptions) -> DataFrame:
    """(owner, win, feature) rows of every sequence; null and short ones give none. Features above 2**63 wrap to negatives."""
    column = F.col(seq) if isinstance(seq, str) else seq
    kind = seqs.schema[owner].dataType.simpleString()
    o = options
    ship(seqs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, texts, letters = [], [], 0
            for i, text in enumerate(batch.column(1)):
                if (raw := text.as_py()) is None or len(raw) < o.k:
                    continue
                places.append(i)
                texts.append(raw.encode("ascii", "replace"))
                letters += len(raw)
                if letters > LETTERS:
                    yield emit(batch, places, texts)
                    places, texts, letters = [], [], 0
            if texts:
                yield emit(batch, places, texts)

    def emit(batch, places, texts):
        at, wins, features = sketches_of(texts, o.k, o.size, o.window, o.step, o.hash_name)
        owners = batch.column(0).take(pa.array(np.array(places, np.int64)[at]))
        return pa.record_batch([owners, pa.array(wins), pa.array(features.view(np.int64))], names=["owner", "win", "feature"])

    return spread(seqs.select(owner, column.alias("_seq"))).mapInArrow(run, f"owner {kind}, win bigint, feature bigint")


def sketch_pairs(reads: DataFrame, options: SketchOptions) -> DataFrame:
    """(owner, win, feature) of reads (query_id, seq1, seq2): both mates' sketches, the second's windows after the first's."""
    one = sketch(reads, "query_id", "seq1", options)
    return one.union(sketch(reads.where("seq2 is not null"), "query_id", "seq2", options))
