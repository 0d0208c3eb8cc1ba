"""Substring removal by words: windows of 50 words that a smaller doc_id also has.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as
one packed string to its bucket, where the windows are sorted by their words and
so counted exactly (see ``repeats``).

Null and empty texts have no words; very long ones are cut into windows whole.  Rows with equal ids are
one document for the rule, so they don't remove each other's words; null ids count as smallest
(and are one document).  An empty table gives none; columns with this module's own names don't matter.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm import kernels as K
from tallyforge.llm import repeats as R

LENGTH = 50
GRAM = 8
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _order(length: int):
    def order(data: bytes, begin, sizes, counts, leads, m, doc):
        strings = [data[b : b + s] for b, s in zip(begin.tolist(), sizes.tolist())]
        first: dict[bytes, int] = {}
        lead = np.array([first.setdefault(s, x) for x, s in enumerate(strings)])
        again = doc > doc[lead]
        which, off, group = R.windows_of(counts, leads, m, np.flatnonzero(~again))
        cut: dict[int, list[int]] = {}
        rows = []
        for w, o, g in zip(which.tolist(), off.tolist(), group.tolist()):
            if w not in cut:
                at, spaces = -1, [-1]
                while (at := strings[w].find(b" ", at + 1)) >= 0:
                    spaces.append(at)
                cut[w] = [*spaces, len(strings[w])]
            rows.append((g, strings[w][cut[w][o] + 1 : cut[w][o + length]], int(doc[w]), w, o))
        rows.sort()
        found, before = [], (None, None, None)
        for g, window, d, w, o in rows:
            if (g, window) != before[:2]:
                before = (g, window, d)
            elif d > before[2]:
                found.append((w, o))
        found = np.array(sorted(found), np.int64).reshape(-1, 2)
        w, at, n = R.joined_places(found[:, 1], found[:, 0], length)
        whole = np.flatnonzero(again)
        return np.concatenate([w, whole]), np.concatenate([at, np.zeros(len(whole), np.int64)]), np.concatenate([n, counts[whole] + length - 1])

    return order


def _finish(docs: pa.Table, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Table:
    data, offs = K.flat(docs.column("text"))
    words, removed, kept = [], [], []
    for a, b, d, o in K.chunks(data, offs):
        canon, s, e, wo = R.canonical_words(d, o)
        text = canon.tobytes()
        lo, hi = np.searchsorted(row, np.arange(a, b)), np.searchsorted(row, np.arange(a, b), "right")
        for x in range(b - a):
            f, t = int(wo[x]), int(wo[x + 1])
            words.append(t - f)
            if lo[x] == hi[x]:
                removed.append(0)
                kept.append(text[s[f] : e[t - 1]].decode() if t > f else "")
                continue
            mask = R.removed_mask(t - f, at[lo[x] : hi[x]], n[lo[x] : hi[x]])
            removed.append(int(mask.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate([[1], mask.astype(np.int8), [1]])))
            kept.append(b" ".join(text[s[f + p] : e[f + q - 1]] for p, q in zip(edge[::2].tolist(), edge[1::2].tolist())).decode())
    return pa.Table.from_arrays([docs.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=_OUT)


def remove_repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row."""
    units = R.Units("words", length, gram, R.cut_words(gram), False)
    return R.repeated_places(docs, units, _order(length), _finish, "doc_id long, n_words long, n_removed long, kept_text string", id_col=id_col, text_col=text_col, **options)


def digest(docs: DataFrame, **options) -> DataFrame:
    from pyspark.sql import functions as F

    return remove_repeated_words(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
