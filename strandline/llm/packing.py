"""Token-id output: documents are tokenized, split losslessly where overlong, and packed best-fit-decreasing into rows of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Ids and documents that are packed together, at most: what a task holds in memory, whatever the input.
GROUP_IDS, GROUP_DOCS = 2_000_000, 4_096
_encoders: dict[str, object] = {}


def encoder(name: str):
    """A function from text to ids (numpy uint32) of an installed public tokenizer, made once in each process; its end-of-document id."""
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[name] = (lambda text: np.array(e.encode_ordinary(text), np.uint32), max(ranks.values()) + 1)
    return _encoders[name]


class Capacities:
    """Open rows by free room, with a segment tree over the room: finds the fullest row that still takes a piece in log(length) steps."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        i = self.base + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (row, room) of least room of at least size; None if there is none."""
        i, count = self.base + size, self.count
        if not count[i]:
            # Up to the first ancestor that has a right sibling with rows, then down its left edge.
            while i > 1 and not (i % 2 == 0 and count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.base
        row = self.rows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return row, room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: the largest pieces first, each into the fullest row with room, else into a new one. Equal sizes keep their order."""
    open_rows, out = Capacities(length), []
    for piece in sorted(range(len(sizes)), key=lambda p: -sizes[p]):
        found = open_rows.take(sizes[piece])
        row, room = found or (len(out), length)
        if found is None:
            out.append([])
        out[row].append(piece)
        if room > sizes[piece]:
            open_rows.add(row, room - sizes[piece])
    return out


def _pack(docs: list[tuple[int | None, np.ndarray]], length: int, fill: int) -> Iterator[dict]:
    """Packed rows of one group. Pieces of a full row's length stand alone."""
    pieces = [(i, n, ids[at : at + length]) for i, ids in docs for n, at in enumerate(range(0, len(ids), length))]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        ids = np.full(length, fill, np.uint16 if fill < 65536 else np.uint32)
        ends = [0]
        for p in row:
            ids[ends[-1] : ends[-1] + len(pieces[p][2])] = pieces[p][2]
            ends.append(ends[-1] + len(pieces[p][2]))
        yield {"doc_ids": [pieces[p][0] for p in row], "parts": [pieces[p][1] for p in row], "cu_seqlens": ends, "n_tokens": ends[-1], "input_ids": ids.tobytes()}


SCHEMA = "doc_ids array<bigint>, parts array<int>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, input_ids binary"
_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("input_ids", pa.binary())])


def pack(docs: DataFrame, length: int = 4096, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each packed sequence of `length` ids: doc_ids, parts, cu_seqlens, position_resets, n_tokens, input_ids.

    A document is its ids and an end-of-document id, so an empty or null text is one id. Longer documents are cut every
    `length` ids: the parts of a document, in order, are all its ids. Each piece is in one row; cu_seqlens has 0 and the end
    of each piece, position_resets where positions start again from 0, and input_ids, little-endian uint16 (uint32 for
    vocabularies of 65536 and more), is filled up with the end-of-document id past n_tokens. Documents are packed in groups
    of at most GROUP_DOCS documents and about GROUP_IDS ids of an input partition: no shuffle, bounded memory, and a lost
    task is redone alike. One document's own ids are held at once, whatever its length.

    Repeated rows are packed as often as they occur; a null doc_id stays null in doc_ids. Extra columns are ignored. An
    empty table gives no rows.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer)
        group: list[tuple[int | None, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_pack(group, length, end))
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                for r in part:
                    r["position_resets"] = r["cu_seqlens"][:-1]
                yield pa.RecordBatch.from_pylist(part, schema=_ARROW)

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end))
                group.append((i.as_py(), ids))
                total += len(ids)
                if total >= GROUP_IDS or len(group) >= GROUP_DOCS:
                    yield from flush()
                    group.clear()
                    total = 0
        if group:
            yield from flush()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, SCHEMA)


def matrices(packed: DataFrame, length: int = 4096, rows: int = 256) -> DataFrame:
    """Binary output: (n_rows, ids, positions, cu_seqlens, row_splits) for each run of up to `rows` packed rows of a partition.

    ids and positions are C-order matrices of n_rows by `length`, positions as little-endian uint16 (uint32 from a length of
    65536); cu_seqlens runs on over all rows of the matrix and row_splits cuts it by rows. Write it as any table, to any store.
    """
    kind = np.uint16 if length <= 65536 else np.uint32

    def positions(cu: list[int]) -> bytes:
        out = np.arange(length, dtype=np.int64)
        out -= np.repeat(np.array([*cu[:-1], cu[-1]], np.int64), np.diff([*cu, length]))
        return out.astype(kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cus = part.column(0).to_pylist()
                running, splits = [0], [0]
                for n, cu in enumerate(cus):
                    running += [n * length + c for c in cu[1:]]
                    splits.append(len(running) - 1)
                yield pa.record_batch(
                    [pa.array([len(cus)], pa.int32()), pa.array([b"".join(part.column(1).to_pylist())]), pa.array([b"".join(map(positions, cus))]), pa.array([running], pa.list_(pa.int64())), pa.array([splits], pa.list_(pa.int32()))],
                    names=["n_rows", "ids", "positions", "cu_seqlens", "row_splits"],
                )

    return packed.select("cu_seqlens", "input_ids").mapInArrow(run, "n_rows int, ids binary, positions binary, cu_seqlens array<bigint>, row_splits array<int>")
