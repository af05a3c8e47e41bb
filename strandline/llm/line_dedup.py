"""Line dedup: two Bloom filters find lines that may repeat; only those are shuffled, to be confirmed and to find their first document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store

#: Filters are cut by a hash's top bits into slices of so many bits, each built by one task.
SLICE_BITS, PROBES = 1 << 20, 4
#: Bits of a filter: 16 a line, 2**26 at least and 2**29 (64 MB) at most. Past that more lines are suspected, none is missed.
MIN_BITS, MAX_BITS = 1 << 26, 1 << 29
#: Input partitions whose filters are merged at once, before those of all are.
MERGED = 64
#: Confirmed keys, of 24 bytes, that are sent to every worker; more are joined to their documents by a shuffle.
BROADCAST_KEYS = 2_000_000
_SPACE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, least: int) -> bytes | None:
    """The line stripped of white space, A-Z lower-cased; None under `least` code points."""
    key = line.strip(_SPACE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


def _digests_of(lines: list[bytes], least: int) -> list[bytes | None]:
    return [None if (k := key_of(x, least)) is None else hashlib.blake2b(k, digest_size=16).digest() for x in lines]


def _digests(text: bytes, least: int) -> list[bytes | None]:
    return _digests_of(text.split(b"\n"), least)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash's bits in the filter, a column for each probe: all in one slice."""
    size = min(SLICE_BITS, bits)
    part = (h >> np.uint64(40)) % np.uint64(bits // size) * np.uint64(size)
    step = (h >> np.uint64(17)) | np.uint64(1)
    return np.stack([part + ((h + np.uint64(i) * step) & np.uint64(size - 1)) for i in range(PROBES)], axis=1).astype(np.int64)


def _sliced(places: np.ndarray, bits: int) -> list[bytes]:
    """A filter with bits set at places, compressed slice by slice; a slice without any is empty."""
    size = min(SLICE_BITS, bits)
    places = np.sort(places, axis=None)
    ends = np.searchsorted(places, np.arange(bits // size + 1) * size)
    out = []
    for s in range(bits // size):
        if (own := places[ends[s] : ends[s + 1]]).size:
            marks = np.zeros(size, bool)
            marks[own - s * size] = True
            out.append(zlib.compress(np.packbits(marks, bitorder="little").tobytes(), 1))
        else:
            out.append(b"")
    return out


def _merge(rows) -> tuple[np.ndarray, np.ndarray]:
    """Filters (once, twice) of one slice, merged: what two of them have seen is seen twice."""
    once = twice = np.zeros(1, np.uint8)
    for o, t in rows:
        if o:
            o = np.frombuffer(zlib.decompress(o), np.uint8)
            once, twice = once | o, twice | once & o
        if t:
            twice = twice | np.frombuffer(zlib.decompress(t), np.uint8)
    return once, twice


FILTERS = "slice int, once binary, twice binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FILTERS, merged for each slice."""
    held: dict[int, tuple[bytes, bytes]] = {}
    for batch in batches:
        by: dict[int, list] = {}
        for s, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            by.setdefault(s, [held[s]] if s in held else []).append((o, t))
        for s, rows in by.items():
            held[s] = tuple(zlib.compress(x.tobytes(), 1) for x in _merge(rows))
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), *(pa.array([v[i] for v in held.values()], pa.binary()) for i in range(2))], names=["slice", "once", "twice"])


def twice_seen(docs: DataFrame, bits: int, least: int, text_col: str = "text") -> bytes:
    """The filter of line keys that may be in two documents or more, as packed bits. The driver gets at most MAX_BITS of it.

    Each input partition makes a once-seen and a twice-seen filter of its own. Filters are what moves, compressed, never lines
    or their hashes: those of MERGED partitions are merged slice by slice, then those of all.
    """
    size = min(SLICE_BITS, bits)
    slices = bits // size

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        waiting: list[np.ndarray] = []

        def add() -> None:
            nonlocal once, twice
            h, n = np.unique(np.concatenate([once, *waiting]), return_counts=True)
            once, twice = h, np.union1d(twice, h[n > 1])
            waiting.clear()

        for batch in batches:
            # Distinct in each document: a key repeated in one is seen once.
            found = [d[:8] for t in _texts(batch.column(0)) for d in set(_digests(t, least)) if d]
            waiting.append(np.frombuffer(b"".join(found), "<u8").astype(np.uint64))
            if sum(map(len, waiting)) > len(once) + 100_000:
                add()
        add()
        if len(once):
            rows = [_sliced(_slots(x, bits), bits) for x in (once, twice)]
            yield pa.record_batch([pa.array(range(slices), pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], names=["slice", "once", "twice"])

    rows = docs.select(text_col).mapInArrow(build, FILTERS)
    if docs.rdd.getNumPartitions() > MERGED:
        rows = rows.withColumn("group", F.floor(F.spark_partition_id() / MERGED)).repartition("slice", "group").select("slice", "once", "twice").mapInArrow(_merged, FILTERS)
    out = np.zeros((slices, size // 8), np.uint8)
    for row in rows.repartition(slices, "slice").mapInArrow(_merged, FILTERS).select("slice", "twice").collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out.tobytes()


def _marked(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether all of a hash's bits are set."""
    return ((packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of docs; kept is the text less lines that an earlier document has.

    A line's key is the line stripped of white space with A-Z lower-cased; keys of fewer than `least` code points don't count.
    A first scan puts line hashes into two Bloom filters, once-seen and twice-seen: a pair for each input partition, merged
    bit by bit. A second finds lines that the twice-seen filter has; only their 128-bit digests are shuffled, to be confirmed
    as in two documents and to find the least doc_id, pre-aggregated, so that a common line is a row for each task. A third
    scan drops confirmed lines from all but that document. Confirmed keys are broadcast up to broadcast_keys; beyond, each
    document gets its own by a join. The twice-seen filter is broadcast; its size is bounded by MAX_BITS, past which more
    lines are suspected and shuffled, with the same result. A key repeated only within one document is kept.

    Null and empty texts are one empty line. Rows of one doc_id are one document listed more than once; a null doc_id is one
    document, the last. Extra columns are ignored. No key is dropped that isn't in two documents.
    """
    spark = docs.sparkSession
    store = Store(spark)
    last = 2**63 - 1
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("_id"), F.col(text_col).alias("text"))
    if bits is None:
        lines = own.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
        bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * lines - 1).bit_length() if lines else 0))
    maybe = spark.sparkContext.broadcast(twice_seen(own, bits, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(maybe.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found = {d for d in _digests(t, least) if d}
                keys += found
                ids += [i] * len(found)
            h = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            held = _marked(packed, _slots(h[:, 0].astype(np.uint64), bits))
            yield pa.record_batch(
                [pa.array(np.array(ids, np.int64)[held]), pa.array(h[held, 0].astype("u8").view(np.int64)), pa.array(h[held, 1].astype("u8").view(np.int64))], names=["_id", "k1", "k2"]
            )

    found = store.put(own.mapInArrow(suspects, "_id bigint, k1 bigint, k2 bigint"), "suspects")
    first = found.groupBy("k1", "k2").agg(F.min("_id").alias("first"), F.max("_id").alias("_other")).where("first <> _other").select("k1", "k2", "first")
    first = store.put(first, "confirmed")
    schema = docs.select(F.col(id_col)).schema.simpleString()[7:-1]

    def dropping(gone_of):
        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t.split(b"\n") for t in _texts(batch.column(1))]
                n_lines = [len(x) for x in texts]
                digests = [d for x in texts for d in _digests_of(x, least)]
                gone = gone_of(digests, n_lines, batch)
                at, kept, n_dropped = 0, [], []
                for x in texts:
                    own = gone[at : at + len(x)]
                    at += len(x)
                    n = int(own.sum())
                    n_dropped.append(n)
                    kept.append(b"\n".join(line for line, g in zip(x, own, strict=True) if not g) if n else b"\n".join(x))
                texts_out = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.record_batch([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), texts_out], names=[id_col, "n_lines", "n_dropped", "kept"])

        return drop

    rows = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("_id"))
    out = f"{schema}, n_lines bigint, n_dropped bigint, kept string"
    if first.count() <= broadcast_keys:
        table = first.toArrow()  # broadcast_keys rows at most
        k1, k2, least_id = (table.column(i).to_numpy() for i in range(3))
        order = np.lexsort((k2.view(np.uint64), k1.view(np.uint64)))
        sent = spark.sparkContext.broadcast((k1[order].view(np.uint64), k2[order].view(np.uint64), least_id[order]))

        def by_key(digests, n_lines, batch):
            keys, others, firsts = sent.value
            gone = np.zeros(len(digests), bool)
            lines = np.array([i for i, d in enumerate(digests) if d], np.int64)
            if len(lines) and len(keys):
                h = np.frombuffer(b"".join(digests[i] for i in lines), "<u8").reshape(-1, 2)
                at = np.minimum(np.searchsorted(keys, h[:, 0]), len(keys) - 1)
                ids = np.repeat(np.array(batch.column(2).to_pylist(), np.int64), n_lines)[lines]
                gone[lines] = (keys[at] == h[:, 0]) & (others[at] == h[:, 1]) & (firsts[at] != ids)
            return gone

        return rows.mapInArrow(dropping(by_key), out)
    named = first.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "first")
    drops = found.join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).where("_id <> first")
    drops = drops.groupBy(F.col("_id").alias("_d")).agg(F.collect_set("k1").alias("drop"))
    rows = rows.join(drops, F.col("_id") == F.col("_d"), "left").select(id_col, text_col, "_id", "drop")

    def by_document(digests, n_lines, batch):
        gone, at = np.zeros(len(digests), bool), 0
        for n, drop in zip(n_lines, batch.column(3).to_pylist(), strict=True):
            if drop:
                drop = set(drop)
                gone[at : at + n] = [bool(d) and int.from_bytes(d[:8], "little", signed=True) in drop for d in digests[at : at + n]]
            at += n
        return gone

    return rows.mapInArrow(dropping(by_document), out)
