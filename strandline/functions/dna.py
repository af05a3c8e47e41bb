"""Nucleotide expressions and the vectorised k-mer kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2-bit codes of nucleotides; others are ambiguous.
_CODES = np.full(256, 4, np.uint8)
for _letters, _code in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
    for _letter in _letters:
        _CODES[ord(_letter)] = _code
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; case is kept, U becomes A, other characters stay."""
    return F.reverse(F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa"))


def num_kmers(seq: Column, k: int) -> Column:
    return F.greatest(F.lit(0), F.length(seq) - k + 1)


def kmer_value(kmer: Column) -> Column:
    """A k-mer of at most 31 unambiguous letters as a number, two bits a letter."""
    return F.conv(F.translate(F.upper(kmer), "ACGTU", "01233"), 4, 10).cast("bigint")


def canonical_value(kmer: Column) -> Column:
    """The less of a k-mer's and its reverse complement's value."""
    return F.least(kmer_value(kmer), kmer_value(reverse_complement(kmer)))


def hash32(x: Column) -> Column:
    """The default 32-bit feature hash, on a whole number below 2**32."""
    mix = lambda v: F.shiftright(v, 16).bitwiseXOR(v) * F.lit(0x45D9F3B)
    low = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))
    x = low(mix(low(mix(x.cast("bigint")))))
    return F.shiftright(x, 16).bitwiseXOR(x)


def np_hash32(x: np.ndarray) -> np.ndarray:
    low = np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & low
    return (x >> np.uint64(16)) ^ x


def np_fmix64(x: np.ndarray) -> np.ndarray:
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    return x ^ (x >> np.uint64(33))


def np_fmix32(x: np.ndarray) -> np.ndarray:
    low = np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B) & low
    x = (x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35) & low
    return x ^ (x >> np.uint64(16))


def np_splitmix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def np_nvidia32(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of shifts and sums."""
    low = np.uint64(0xFFFFFFFF)
    u = lambda n: np.uint64(n)
    x = x & low
    x = (x + u(0x7ED55D16) + (x << u(12))) & low
    x = (x ^ u(0xC761C23C) ^ (x >> u(19))) & low
    x = (x + u(0x165667B1) + (x << u(5))) & low
    x = ((x + u(0xD3A2646C)) ^ (x << u(9))) & low
    x = (x + u(0xFD7046C5) + (x << u(3))) & low
    return (x ^ u(0xB55A4F09) ^ (x >> u(16))) & low


def np_half(x: np.ndarray) -> np.ndarray:
    """64 bits to 32, by shifts and sums."""
    u = lambda n: np.uint64(n)
    x = ~x + (x << u(18))
    x = (x ^ (x >> u(31))) * u(21)
    x = x ^ (x >> u(11))
    x = x + (x << u(6))
    return (x ^ (x >> u(22))) & u(0xFFFFFFFF)


#: Hashes that options can name. Their constants are fixed values, by their definitions.
HASHES = {"default32": np_hash32, "fmix32": np_fmix32, "nvidia32": np_nvidia32, "fmix64": np_fmix64, "splitmix64": np_splitmix64, "halved64": np_half, "identity": lambda x: x}


def canonical_kmers(seq: bytes | np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers of a text at each place, as uint64; NONE (also a valid value for k = 32) where a letter is ambiguous."""
    raw = np.frombuffer(seq, np.uint8) if isinstance(seq, bytes) else seq
    n = len(raw) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    codes = _CODES[raw]
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    base = (codes & 3).astype(np.uint64)

    def rolled(b: np.ndarray, forward: bool) -> np.ndarray:
        """Values of k letters from values of halves: log2(k) passes over the text."""
        out, done, power, size, at = None, 0, b, 1, k
        while at:
            if at & 1:
                if out is None:
                    out, done = power, size
                else:
                    m = min(len(out), len(power) - done)
                    left, right = out[:m], power[done : done + m]
                    out = (left << np.uint64(2 * size)) | right if forward else left | (right << np.uint64(2 * done))
                    done += size
            at >>= 1
            if at:
                m = len(power) - size
                left, right = power[:m], power[size:]
                power = (left << np.uint64(2 * size)) | right if forward else left | (right << np.uint64(2 * size))
                size *= 2
        return out[:n]

    values = np.minimum(rolled(base, True), rolled(np.uint64(3) - base, False))
    values[bad[k:] != bad[:-k]] = NONE
    return values


def sketches_of(texts: list[bytes], k: int, size: int, window: int, stride: int, hash_name: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, window number, feature) of texts: the `size` least distinct hashes of each window's canonical k-mers.

    Only windows of at least k letters are numbered. For k over 16 the hash is of 64 bits. The greatest value of the hash's
    width is never a feature. Texts are laid end to end and worked on at once; no window reaches into the next text.
    """
    mix = HASHES[hash_name or ("default32" if k <= 16 else "fmix64")]
    none = NONE if k > 16 else np.uint64(0xFFFFFFFF)
    kmers = canonical_kmers(np.frombuffer(b"".join(texts), np.uint8), k)
    empty = np.empty(0, np.int64)
    if not len(kmers):
        return empty, empty, np.empty(0, np.uint64)
    bad = kmers == NONE
    hashed = mix(kmers)
    hashed[bad] = NONE
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    # Full windows every stride, then one shorter tail if it has any letter; a short text is one window.
    full = np.where(lengths > window, (lengths - window) // stride + 1, 0)
    count = np.where(lengths > window, full + (full * stride < lengths), lengths > 0)
    text = np.repeat(np.arange(len(texts)), count)
    win = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = (ends - lengths)[text] + win * stride
    end = np.minimum(start + window, ends[text]) - k + 1
    whole = end > start
    text, win, start, end = text[whole], win[whole], start[whole], end[whole]
    out: list[list[np.ndarray]] = [[empty], [empty], [np.empty(0, np.uint64)]]
    steps = np.arange(window - k + 1)
    for at in range(0, len(start), 16384):  # bounds memory for long texts
        s, e = start[at : at + 16384], end[at : at + 16384]
        index = s[:, None] + steps
        block = np.where(index < e[:, None], hashed[np.minimum(index, len(hashed) - 1)], NONE)
        block.sort(axis=1)
        fresh = np.ones(block.shape, bool)
        fresh[:, 1:] = block[:, 1:] != block[:, :-1]
        fresh &= block < none
        fresh &= np.cumsum(fresh, axis=1) <= size
        rows, _ = np.nonzero(fresh)
        for column, value in zip(out, (text[rows + at], win[rows + at], block[fresh]), strict=True):
            column.append(value)
    return tuple(np.concatenate(x) for x in out)


def sketches(seq: bytes, k: int, size: int, window: int, stride: int, hash_name: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window numbers, features) of one text."""
    return sketches_of([seq], k, size, window, stride, hash_name)[1:]


def query_windows(length: Column, k: int, stride: int) -> Column:
    """About how many windows a read has, one at least: its weight where reads are dealt out by size."""
    return F.greatest(F.lit(1), F.floor((length - k + stride) / stride))
