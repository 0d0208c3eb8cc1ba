"""Vectorised text kernels over Arrow string columns.

Every kernel works on the flat UTF-8 buffer of many documents at once, so the
cost of a document is a few NumPy passes over its bytes and no Python object is
made for a word.  Callers go through :func:`chunks`, which bounds the bytes that
one pass holds (a single longer document is a chunk of its own, never cut).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@functools.cache
def _trimmer() -> Callable[[int], int] | None:
    """The C library's own way to give free pages back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Return what this worker no longer holds: it waits for its next task beside others that need the memory."""
    pa.default_memory_pool().release_unused()
    if (give := _trimmer()) is not None:
        give(0)


def lean(run: Callable) -> Callable:
    """A function of batches that leaves little behind when its last batch is out."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return out


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 bytes, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
NOT_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, after the last, bytes, offsets) of runs of whole documents."""
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the ``n + 1`` word offsets of documents."""
    return marked_runs(~separators[data], offs)


def marked_runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal marked runs of each document, and the ``n + 1`` run offsets of documents."""
    size = len(inside)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < size]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that may overlap; equal spans have equal hashes wherever they lie.

    A polynomial modulo 2^64, so some pairs of long spans share a hash by construction: only for callers that
    compare bytes before two spans count as equal.
    """
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as words of eight bytes, the last one padded with zeros, and the ``n + 1`` offsets of spans in them."""
    size = ends - starts
    count = (size + 7) >> 3
    offs = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(offs[-1]) - np.repeat(offs[:-1], count)
    at = np.repeat(starts, count) + 8 * within
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))[at]
    left = np.minimum(np.repeat(size, count) - 8 * within, 8).astype(np.uint64)
    return eights & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (left << np.uint64(3)))), offs


def block_hashes(flat: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans from their blocks: a sum of mixed blocks, each salted with its place, and the size.

    The mixing isn't linear, so that no two spans share a hash by their pattern alone.
    """
    n = len(offs) - 1
    out = np.zeros(n, np.uint64)
    if len(flat):
        count = np.diff(offs)
        within = (np.arange(len(flat)) - np.repeat(offs[:-1], count)).astype(np.uint64)
        some = count > 0
        out[some] = np.add.reduceat(mix(flat ^ mix(within + np.uint64(0x9E3779B97F4A7C15))), offs[:-1][some])
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """:func:`block_hashes` of byte spans."""
    return block_hashes(*blocks(data, starts, ends), ends - starts)


def identities(h: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray], content: Callable[[int], object]) -> np.ndarray:
    """Numbers that two entries share if and only if they are equal, from hashes that equal entries share.

    ``equal(a, b)`` compares entries a[i] and b[i]. Where a hash has several contents, ``content`` tells them apart.
    """
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    same = h[a] == h[b]
    at = np.flatnonzero(same)
    wrong = at[~equal(a[at], b[at])]
    run = np.cumsum(np.concatenate([[False], ~same])[: len(h)])
    out = np.empty(len(h), np.int64)
    out[order] = run
    if len(wrong):
        numbers: dict[object, int] = {}
        for x in np.flatnonzero(np.isin(run, run[wrong])):
            out[order[x]] = len(h) + numbers.setdefault(content(int(order[x])), len(numbers))
    return out


def equal_blocks(flat: np.ndarray, offs: np.ndarray, sizes: np.ndarray, a: np.ndarray, other: np.ndarray, other_offs: np.ndarray, other_sizes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether span a[i] of one set of blocks equals span b[i] of another."""
    out = sizes[a] == other_sizes[b]
    at = np.flatnonzero(out & (sizes[a] > 0))
    if len(at):
        n = offs[a[at] + 1] - offs[a[at]]
        differ = flat[ranges(offs[a[at]], n)] != other[ranges(other_offs[b[at]], n)]
        out[at] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


def span_identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that spans share if and only if their bytes are equal, and the spans' hashes."""
    (flat, offs), sizes = blocks(data, starts, ends), ends - starts
    h = block_hashes(flat, offs, sizes)
    same = lambda a, b: equal_blocks(flat, offs, sizes, a, flat, offs, sizes, b)
    return identities(h, same, lambda k: data[starts[k] : ends[k]].tobytes()), h


def gram_identities(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers that positions share if and only if their ``k`` consecutive entries are equal."""
    h = gram_hashes(ids.astype(np.uint64), k)

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for j in range(k):
            out &= ids[a + j] == ids[b + j]
        return out

    return identities(h, same, lambda x: ids[x : x + k].tobytes())


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive entries at each of ``len(h) - k + 1`` positions."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xA0761D6478BD642F) + h[j : j + n]
    return mix(out)


def shingles(h: np.ndarray, word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word k-grams of every document and their document numbers.

    A document with words but fewer than ``k`` has one shingle, all its words.
    """
    count = np.diff(word_offs)
    grams = gram_hashes(h, k)
    whole = np.maximum(count - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), whole)
    first = np.repeat(word_offs[:-1], whole)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = grams[first + within] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for x, d in enumerate(short):
            own[x] = gram_hashes(h[word_offs[d] : word_offs[d + 1]], int(count[d]))[0] ^ np.uint64(int(count[d]))
        doc = np.concatenate([doc, short])
        out = np.concatenate([out, own])
    return out, doc


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each run of ``w`` consecutive entries (doubling, log w passes)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    done = 1
    while done * 2 <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[w - done : w - done + n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)`` for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep], counts[keep]
    at = np.cumsum(c) - c
    out[0] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)
