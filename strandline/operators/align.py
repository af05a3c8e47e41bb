"""Semi-global alignment of reads with slices of targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

MATCH, MISMATCH, GAP = 2, -1, -1
_PAIRS = bytes.maketrans(b"ACGTUacgtu", b"TGCAAtgcaa")


def revcomp(seq: str) -> str:
    return seq.encode("latin-1", "replace").translate(_PAIRS)[::-1].decode("latin-1")


def scores(query: str, subject: str) -> np.ndarray:
    """The table of best scores of alignments that end at each place; free ends, so its first row and column are 0.

    A row depends on itself only through gaps, which a running maximum gives: no loop over columns.
    """
    s = np.frombuffer(subject.encode("latin-1", "replace"), np.uint8)
    q = np.frombuffer(query.encode("latin-1", "replace"), np.uint8)
    table = np.zeros((len(q) + 1, len(s) + 1), np.int32)
    slope = -GAP * np.arange(len(s) + 1, dtype=np.int32)
    for i, c in enumerate(q, 1):
        up = table[i - 1]
        best = np.maximum(up[:-1] + np.where(s == c, MATCH, MISMATCH), up[1:] + GAP)
        table[i] = np.maximum.accumulate(np.concatenate(([0], best)).astype(np.int32) + slope) - slope
    return table


def _end(table: np.ndarray) -> tuple[int, int]:
    """Where the best alignment ends: in the last row or column, the corner first, then the last column's and row's greater scores."""
    rows, cols = table.shape[0] - 1, table.shape[1] - 1
    at, best = (rows, cols), table[rows, cols]
    for i in range(rows, -1, -1):
        if table[i, cols] > best:
            at, best = (i, cols), table[i, cols]
    for j in range(cols, -1, -1):
        if table[rows, j] > best:
            at, best = (rows, j), table[rows, j]
    return at


def align(query: str, subject: str) -> tuple[int, str, str]:
    """(score, query, subject) of the best semi-global alignment, gaps as `_`; of equal steps the diagonal, then that of a gap in the subject."""
    if not query or not subject:
        return 0, "", ""
    table = scores(query, subject)
    i, j = _end(table)
    score, a, b = int(table[i, j]), [], []
    while i and j:
        if table[i, j] == table[i - 1, j - 1] + (MATCH if query[i - 1] == subject[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            a.append(query[i])
            b.append(subject[j])
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
            a.append(query[i])
            b.append("_")
        else:
            j -= 1
            a.append("_")
            b.append(subject[j])
    return score, "".join(reversed(a)), "".join(reversed(b))


def align_score(query: str, subject: str) -> int:
    if not query or not subject:
        return 0
    table = scores(query, subject)
    return int(table[_end(table)])


def align_read(seq1: str, seq2: str | None, subject: str) -> tuple[int, str, str, str]:
    """(score, query, subject, strand): the strand on which the pair's scores sum to more, the reverse of equals; the first mate's alignment."""
    mates = [seq1] + ([seq2] if seq2 else [])
    forward = sum(align_score(m, subject) for m in mates)
    backward = sum(align_score(revcomp(m), subject) for m in mates)
    plus = forward > backward
    score, q, s = align(seq1 if plus else revcomp(seq1), subject)
    return score, q, s, "+" if plus else "-"


def align_udf(seq1: Column, seq2: Column, subject: Column) -> Column:
    """align_read on columns, in Arrow batches."""

    def run(seq1: pd.Series, seq2: pd.Series, subject: pd.Series) -> pd.DataFrame:
        rows = [align_read(a or "", b, s or "") for a, b, s in zip(seq1, seq2, subject, strict=True)]
        return pd.DataFrame(rows, columns=["score", "query", "subject", "strand"])

    return F.pandas_udf(run, "score int, query string, subject string, strand string")(seq1, seq2, subject)


def subject_slice(seq: Column, beg: Column, end: Column, window: int, stride: int) -> Column:
    """The part of a target that windows beg to end cover, as alignments take it."""
    return F.substring(seq, (stride * beg + 1).cast("int"), (stride * (end - beg) + window).cast("int"))


def alignments(candidates: DataFrame, reads: DataFrame, targets: DataFrame, window: int, stride: int, classified: DataFrame | None = None) -> DataFrame:
    """(query_id, tgt, score, query, subject, strand) for each read's first candidate; targets: (tgt, seq).

    Candidates that were merged at a rank (with `tax`) are aligned only where that is a sequence; with classified
    (query_id, tax), only reads that have a taxon are.
    """
    ship(candidates.sparkSession)
    top = candidates.where("pos = 1")
    if "tax" in top.columns:
        top = top.where("tax < 0")
    if classified is not None:
        top = top.join(classified.where("tax is not null"), "query_id", "left_semi")
    rows = top.join(reads.select("query_id", "seq1", "seq2"), "query_id").join(targets.select("tgt", "seq"), "tgt")
    out = rows.select("query_id", "tgt", align_udf(F.col("seq1"), F.col("seq2"), subject_slice(F.col("seq"), F.col("beg"), F.col("end"), window, stride)).alias("x"))
    return out.select("query_id", "tgt", "x.*")
