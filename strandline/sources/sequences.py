"""Scans of FASTA and FASTQ files, plain or gzip; single, paired in one file, or paired in two."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ..stored import stored

SCHEMA = "file string, index bigint, header string, seq string, qual string"


class FormatError(ValueError):
    """A file that is neither FASTA nor FASTQ."""


class _Block:
    """Records of the lines of a file, or of one of the blocks that it is split into.

    A line that starts with > or @ begins a record; what follows are data lines up to the next > or a + line, which is
    skipped, and after which one line has the qualities. Empty lines and carriage returns at ends of lines don't count.
    A file whose first line begins no record is no sequence file.

    A later block begins inside a record: lines before its first header (`lead`) belong to the block before. A header of
    FASTQ is known by the + two lines on, which a quality line never has; in blocks without such, headers begin with >.
    """

    def __init__(self, name: str, start: int):
        self.name, self.start, self.n = name, start, 0
        self.header: bytes | None = None
        self.parts: list[bytes] = []
        self.quality: bytes | None = None
        self.plus = self.open = False
        self.lead: list[bytes] = []
        self.first: list[bytes] | None = [] if start else None
        self.begun = False

    def feed(self, line: bytes) -> Iterator[tuple[int, bytes, bytes, bytes | None]]:
        """(number, header, sequence, qualities) of records that the line ends."""
        line = line.removesuffix(b"\r")
        if self.first is not None:
            self.first.append(line)
            full = [x for x in self.first if x]
            at = next((i for i, x in enumerate(full[:-2]) if x[:1] == b"@" and full[i + 2][:1] == b"+"), None)
            if at is not None or len(full) >= 8:
                yield from self._settle(full, at)
            return
        if not self.begun and self.header is None and not self.start:
            if line[:1] not in (b">", b"@"):
                raise FormatError(f"{self.name}: neither FASTA nor FASTQ")
            self.begun = True
        if self.open:
            self.quality, self.open = line, False
            return
        if not line:
            return
        mark = line[:1]
        if mark == b">" or mark == b"@" and (self.header is None and not self.lead or self.header is not None and (self.quality is not None or not self.parts)):
            if self.header is not None:
                yield self._done()
            self.header, self.parts, self.quality, self.plus = line[1:], [], None, False
            self.mark = mark
        elif self.header is None:
            self.lead.append(line)
        elif self.quality is None:
            if mark == b"+":
                self.plus = self.open = True
            else:
                self.parts.append(line)

    def _settle(self, full: list[bytes], at: int | None) -> Iterator[tuple]:
        self.first = None
        if at is None:
            at = next((i for i, x in enumerate(full) if x[:1] == b">"), len(full))
        self.lead, rest = [], full[at:]
        lead = full[:at]
        for line in rest:
            yield from self.feed(line)
        self.lead = lead + self.lead

    def _done(self) -> tuple:
        self.n += 1
        return self.n, self.header, b"".join(self.parts), self.quality

    def finish(self) -> Iterator[tuple]:
        """What is left: lines without any decision, then the last record."""
        if self.first is not None:
            yield from self._settle([x for x in self.first if x], None)

    def last(self) -> tuple | None:
        return self._done() if self.header is not None else None

    def raw(self) -> bytes:
        """The lines of the last record, which the next block may go on with."""
        lines = [self.mark + self.header, *self.parts, *([b"+"] if self.plus else []), *([self.quality] if self.quality is not None else [])]
        return b"\n".join(lines)


def records(data: bytes, name: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(header, sequence, qualities) of each record of a file's bytes."""
    if not data:
        return
    block = _Block(name, 0)
    for line in data.split(b"\n"):
        for _, *record in block.feed(line):
            yield _text(record)
    if (left := block.last()) is not None:
        yield _text(left[1:])


def _text(record) -> tuple[str, str, str | None]:
    return tuple(None if x is None else x.decode("utf-8", "replace") for x in record)


_ROWS = "file string, block bigint, index bigint, kind int, header string, seq string, qual string"
#: Kinds of rows: lines before a block's first header, whole records, and the block's last record, as its lines.
LEAD, WHOLE, LAST = 0, 1, 2


class _Batch:
    """Rows of _ROWS, given out in record batches of bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, file, block, n, kind, header, seq, qual=None) -> Iterator[pa.RecordBatch]:
        self.rows.append((file, block, n, kind, header, seq, qual))
        self.size += len(seq)
        if self.size > 1 << 24 or len(self.rows) >= 10_000:
            yield self.take()

    def take(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(kinds)
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "block", "index", "kind", "header", "seq", "qual"])
        self.rows, self.size = [], 0
        return out


def _parser(split: bool):
    """From lines (file, block, value), in order, to rows of _ROWS; without split, every block is a whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Batch(), None

        def end() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            for n, *record in now.finish():
                yield from out.add(now.name, now.start, n, WHOLE, *_text(record))
            if now.lead:
                yield from out.add(now.name, now.start, 0, LEAD, None, _text([b"\n".join(now.lead)])[0])
            raw = now.raw() if split and now.header is not None else None
            if (left := now.last()) is not None:
                n, *record = left
                yield from out.add(now.name, now.start, n, LAST, None, _text([raw])[0]) if split else out.add(now.name, now.start, n, WHOLE, *_text(record))

        for batch in batches:
            for name, start, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or (now.name, now.start) != (name, start):
                    yield from end()
                    now = _Block(name, start)
                for n, *record in now.feed(line):
                    yield from out.add(name, start, n, WHOLE, *_text(record))
        yield from end()
        if out.rows:
            yield out.take()

    return run


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last records of blocks, with what later blocks begin with, or are."""
    for batch in batches:
        out = _Batch()
        for file, block, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for more, (header, seq, qual) in enumerate(records(raw.encode(), file)):  # more than one where a block is too short to tell
                out.rows.append((file, block, n + more, WHOLE, header, seq, qual))
        if out.rows:
            yield out.take()


def read_sequences(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """(file, index, header, seq, qual) of all records of files, and of all files under folders; index counts from 1 in each file.

    Lines come from the text source, which unpacks .gz files as it goes and splits large plain ones. A task holds a record
    and a batch of rows, so files may have any size. Where files are split, records that a split cuts are put together from
    their lines, and records are numbered by a sum over the blocks before; the parsed rows are stored for that. Then FASTQ
    must have its sequence on one line; FASTA may have any.
    """
    ship(spark)
    source = spark.read.option("recursiveFileLookup", str(recursive).lower())
    # Files that may be split: plain ones above the least size of a split.
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    split = not source.format("binaryFile").load(list(paths)).select("path", "length").where((F.col("length") > least) & ~F.lower("path").endswith(".gz")).isEmpty()
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    if not split:
        return lines.mapInArrow(_parser(False), _ROWS).select("file", "index", "header", "seq", "qual")
    rows = stored(lines.mapInArrow(_parser(True), _ROWS), "records")
    order = Window.partitionBy("file").orderBy("block", "kind")
    cut = rows.where(f"kind <> {WHOLE}").withColumn("_g", F.sum((F.col("kind") == LAST).cast("int")).over(order))
    cut = cut.groupBy("file", "_g").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "index", "seq"))).alias("x"))  # one record
    cut = cut.select("file", F.col("x")[0]["block"].alias("block"), F.col("x")[0]["index"].alias("index"), F.array_join(F.transform("x", lambda e: e["seq"]), "\n").alias("raw"))
    whole = rows.where(f"kind = {WHOLE}").union(cut.mapInArrow(_stitched, _ROWS))
    per = whole.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each block
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("file").alias("_f"), F.col("block").alias("_b"), before.alias("_before"))
    whole = whole.join(per, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return whole.select("file", (F.col("_before") + F.col("index")).alias("index"), "header", "seq", "qual")


def unpaired(sequences: DataFrame) -> DataFrame:
    """(query_id, header, seq1, seq2, file): ids run on from 1 over files, in order of their names."""
    return _with_mates(sequences.withColumn("mate", F.lit(None).cast("string")))


def paired_in_file(sequences: DataFrame) -> DataFrame:
    """Records 1 and 2, 3 and 4, and so on are mates; an odd last one is alone."""
    pair = F.floor((F.col("index") - 1) / 2) + 1
    first = F.col("index") % 2 == 1
    rows = sequences.groupBy("file", pair.alias("index")).agg(F.max(F.when(first, F.col("header"))).alias("header"), F.max(F.when(first, F.col("seq"))).alias("seq"), F.max(F.when(~first, F.col("seq"))).alias("mate"))
    return _with_mates(rows)


def _with_mates(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("file").agg(F.max("index").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(F.col("file").alias("_f"), before.alias("_o"))
    rows = rows.join(offsets, F.col("file") == F.col("_f"))
    return rows.select((F.col("_o") + F.col("index")).alias("query_id"), "header", F.col("seq").alias("seq1"), F.col("mate").alias("seq2"), "file")


def paired_files(sequences: DataFrame) -> DataFrame:
    """Files, in order of their names, are taken two by two; records of the same index are mates, as far as the shorter goes.

    One file alone is unpaired; another odd number is an error.
    """
    names = [r[0] for r in sequences.select("file").distinct().orderBy("file").collect()]  # file names only
    if len(names) < 2:
        return unpaired(sequences)
    if len(names) % 2:
        raise ValueError(f"paired files come two by two, not {len(names)}")
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("file")]
    rows = sequences.withColumn("_p", place)
    one = rows.where("_p % 2 = 0")
    two = rows.where("_p % 2 = 1").select((F.col("_p") - 1).alias("_q"), F.col("index").alias("_i"), F.col("seq").alias("mate"))
    return _with_mates(one.join(two, (F.col("_p") == F.col("_q")) & (F.col("index") == F.col("_i"))).select("file", "index", "header", "seq", "mate"))


def filter_reads(reads: DataFrame, min_length: int = 0, max_length: int = 2**31 - 1, limit: int | None = None) -> DataFrame:
    """Reads with header and sequence whose first mate's length is in bounds; of each file the first `limit` at most."""
    out = reads.where((F.length("header") > 0) & F.length("seq1").between(max(1, min_length), max_length))
    if limit is None:
        return out
    order = Window.partitionBy("file").orderBy("query_id")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
