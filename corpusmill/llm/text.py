"""Words and shingles of whole texts as NumPy arrays, inside Arrow batches.

A batch is worked on in blocks of about BLOCK_BYTES of text (a longer text is a block of its own), so memory
stays bounded whatever the batch size is. Words are maximal runs of bytes other than ASCII white space; UTF-8
never uses those bytes inside a character.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

BLOCK_BYTES = 1 << 18
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Spans up to this many bytes are hashed together.
LONG_SPAN = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Gives memory that a task has freed back to the system: workers are kept for later stages, which need it elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only one C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for consecutive rows; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        to = min(to, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and per row the number of the first word (rows + 1 entries)."""
    space = _IS_SPACE[data]
    begin, end = ~space, ~space
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads] = ~space[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = ~space[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes of every span at a time; a span over LONG_SPAN bytes is hashed alone.

    Memory is a few times that of the spans' numbers, whatever the bytes; nothing is kept between calls.
    """
    size = np.asarray(ends - starts, np.int64)
    out = mix(size.astype(np.uint64) + _STEP)
    if not len(data):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    limbs = np.ndarray((len(data),), np.uint64, padded, strides=(1,))
    left, done = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(left):
        rest = size[left] - done
        out[left] = mix(out[left] ^ (limbs[starts[left] + done] & _MASKS[np.minimum(rest, 8)]))
        left, done = left[rest > 8], done + 8
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] ^= np.uint64(xxhash.xxh64_intdigest(data[starts[i] : ends[i]]))
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i; the caller drops those that cross a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * _STEP + words[j : n + j]
    return mix(out)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of k words of each row, and how many each has; a row of 1 to k-1 words has one, of all its words."""
    sizes = np.diff(first)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    at = ranges(first[:-1], np.where(sizes >= k, counts, 0))
    full = window_hashes(words, k)
    out, where = np.empty(int(counts.sum()), np.uint64), np.cumsum(counts) - counts
    long = np.repeat(sizes >= k, counts)
    out[long] = full[at] if len(at) else full[:0]
    for row in np.flatnonzero((sizes > 0) & (sizes < k)):
        h = np.uint64(sizes[row])
        for w in words[first[row] : first[row + 1]]:
            h = np.uint64((int(h) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[where[row]] = mix(np.array([h], np.uint64))[0]
    return out, counts


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the column text replaced by z, each text compressed alone: a third less to shuffle than Spark's own codec makes of it."""
    pack = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        keep = [i for i in range(batch.num_columns) if i != at]
        z = pa.array([pack((x.as_py() or "").encode()) for x in batch.column(at)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), z], names=[*(batch.schema.names[i] for i in keep), "z"])


def expanded(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The inverse of squeezed, a few rows at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for big in batches:
        for k in range(0, big.num_rows, rows):
            batch = big.slice(k, rows)
            text = pa.array([unpack(x.as_py()).decode() for x in batch.column(batch.schema.get_field_index("z"))], pa.string())
            yield batch.append_column("text", text)
