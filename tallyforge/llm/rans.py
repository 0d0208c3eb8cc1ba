"""Static range asymmetric numeral system over interleaved lanes.

One frequency table, scaled to ``2 ** SCALE`` slots, serves every block.  A block
deals its ids to lanes in turn; each lane is a 64-bit state that moves 32-bit
words, and one NumPy step serves all lanes.  Checkpoints keep the states and the
word position before every ``every``-th step, so a reader can start inside a
block.  The CRC32 of the ids closes each block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18
LANES = 2048
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIIQ")
MAGIC = b"RNS1"


class Table:
    """Frequencies of ids, each seen id at least one slot, and what decoding needs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.zeros(len(freq), np.uint64)
        np.cumsum(self.freq[:-1], out=self.cum[1:])
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq.astype(np.int64))
        self.both = (self.freq << np.uint64(32)) | self.cum

    @staticmethod
    def from_counts(counts: np.ndarray) -> "Table":
        counts = np.asarray(counts, np.float64)
        total, slots = counts.sum(), 1 << SCALE
        if not total:
            return Table(np.concatenate([[slots], np.zeros(max(len(counts) - 1, 0))]).astype(np.int64))
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * slots / total)), 0).astype(np.int64)
        over = int(freq.sum()) - slots
        for i in np.argsort(-freq, kind="stable"):
            if not over:
                break
            step = min(over, int(freq[i]) - 1) if over > 0 else over
            freq[i] -= step
            over -= step
        return Table(freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = 256) -> bytes:
    n = len(ids)
    lanes = int(max(1, min(lanes, n // 64)))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    states: list[np.ndarray] = []
    shift, room = np.uint64(SCALE), np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        sym = ids[t * lanes : (t + 1) * lanes]
        both = table.both[sym]
        f, c = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        a = x[: len(sym)]
        full = np.flatnonzero(a >= (f << room))
        out[t] = a[full].astype(np.uint32)
        a[full] >>= np.uint64(32)
        q = a // f
        x[: len(sym)] = (q << shift) + (a - q * f) + c
        if t % every == 0:
            states.append(x.copy())
    at = np.concatenate([[0], np.cumsum([len(w) for w in out])]).astype(np.uint32)
    marks = at[0:steps:every]
    head = _HEAD.pack(MAGIC, lanes, every, len(marks), int(at[-1]), zlib.crc32(ids.astype("<u4").tobytes()), n)
    return b"".join([head, marks.astype("<u4").tobytes(), *(s.astype("<u8").tobytes() for s in reversed(states)), *(w.astype("<u4").tobytes() for w in out)])


def decode(block: bytes, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, from the last checkpoint before ``start``.

    A whole block is held against its checksum.
    """
    magic, lanes, every, n_marks, n_words, crc, n = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    stop = n if stop is None else min(stop, n)
    if not n or start >= stop:
        return np.zeros(0, np.uint32)
    marks = np.frombuffer(block, "<u4", n_marks, _HEAD.size)
    base = _HEAD.size + 4 * n_marks
    words = np.frombuffer(block, "<u4", n_words, base + 8 * n_marks * lanes)
    mark = start // lanes // every
    x = np.frombuffer(block, "<u8", lanes, base + 8 * mark * lanes).astype(np.uint64)
    at, out = int(marks[mark]), []
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(mark * every, -(-stop // lanes)):
        a = x[: min(lanes, n - t * lanes)]
        slot = a & mask
        sym = table.of_slot[slot]
        both = table.both[sym]
        a = (both >> np.uint64(32)) * (a >> shift) + slot - (both & np.uint64(0xFFFFFFFF))
        low = np.flatnonzero(a < LOW)
        a[low] = (a[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
        x[: len(a)] = a
        out.append(sym)
    first = mark * every * lanes
    ids = np.concatenate(out)[start - first : stop - first]
    if start == 0 and stop == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids don't match its checksum")
    return ids
