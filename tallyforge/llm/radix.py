"""Substring removal by bytes: 100-byte strings that also start earlier.

Depth-limited radix sort: suffixes are ordered only through their first 100
bytes, most significant digit first.  The first digit, a suffix's minimiser and
its distance, deals suffixes to buckets (see ``repeats``); there each pass orders
every group by eight more bytes and drops the suffixes that are alone.  The
groups that are left after the last pass are exactly the repeated strings.

Null texts are empty; very long ones are sorted whole.  Null ids are first.  Rows with equal ids are ordered
by their group (a hash of id and text), then by text, so that one of two equal rows keeps its bytes.
An empty table gives none; columns with this module's own names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm import repeats as R

LENGTH = 100
GRAM = 16
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def radix_groups(data: np.ndarray, place: np.ndarray, which: np.ndarray, off: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes at ``place[which] + off`` whose first ``length`` bytes others of their group share."""
    eights = np.lib.stride_tricks.as_strided(data, (max(len(data) - 7, 0), 8), (1, 1))
    for at in [*range(0, length - 8, 8), length - 8]:
        if not len(which):
            break
        digit = np.ascontiguousarray(eights[place[which] + off + at]).view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((digit, group))
        which, off, group = R.grouped(which[order], off[order], group[order], digit[order])
    return which, off, group


def _order(length: int):
    def order(data: bytes, begin, sizes, counts, leads, m, doc):
        first: dict[bytes, int] = {}
        lead = np.array([first.setdefault(data[b : b + s], x) for x, (b, s) in enumerate(zip(begin.tolist(), sizes.tolist()))])
        again = lead != np.arange(len(lead))
        which, off, group = R.windows_of(counts, leads, m, np.flatnonzero(~again))
        which, off, group = radix_groups(np.frombuffer(data, np.uint8), begin, which, off, group, length)
        late = np.concatenate([[False], group[1:] == group[:-1]]) if len(group) else np.zeros(0, bool)
        which, off = which[late], off[late]
        by = np.lexsort((off, which))
        w, at, n = R.joined_places(off[by], which[by], length)
        whole = np.flatnonzero(again)
        return np.concatenate([w, whole]), np.concatenate([at, np.zeros(len(whole), np.int64)]), np.concatenate([n, counts[whole] + length - 1])

    return order


def _finish(docs: pa.Table, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Table:
    data, offs = K.flat(docs.column("text"))
    text = data.tobytes()
    count = docs.num_rows
    lo, hi = np.searchsorted(row, np.arange(count)), np.searchsorted(row, np.arange(count), "right")
    removed, spans, kept = np.zeros(count, np.int64), np.zeros(count, np.int64), []
    for x in range(count):
        own = text[offs[x] : offs[x + 1]]
        if lo[x] < hi[x]:
            mask = R.removed_mask(len(own), at[lo[x] : hi[x]], n[lo[x] : hi[x]])
            edge = np.flatnonzero(np.diff(np.concatenate([[1], mask.astype(np.int8), [1]])))
            removed[x] = mask.sum()
            spans[x] = np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1)
            own = b"".join(own[p:q] for p, q in zip(edge[::2].tolist(), edge[1::2].tolist()))
        kept.append(own)
    return pa.Table.from_arrays([docs.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], schema=_OUT)


def remove_repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, perhaps no longer valid UTF-8) of every row."""
    units = R.Units("bytes", length, GRAM, R.cut_bytes(GRAM), True)
    return R.repeated_places(docs, units, _order(length), _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", id_col=id_col, text_col=text_col, **options)


def digest(docs: DataFrame, **options) -> DataFrame:
    return remove_repeated_bytes(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
