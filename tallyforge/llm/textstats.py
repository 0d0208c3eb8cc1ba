"""Counts of whole texts, as vectors over a chunk of documents.

Words, lines and windows count as equal only if their bytes are: hashes sort them, bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallyforge.llm import kernels as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, _DIGIT = K.byte_table((0x41, 0x5A)), K.byte_table((0x30, 0x39))
_MARK = np.zeros(256, bool)
_MARK[list(b".!?")] = True

#: word_chars to n_repeat_words are the rules' base counts; the others serve learned rules and scores.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offs[1:]] - sums[offs[:-1]]


def _later_of_doc(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (document, identity), where an entry equals the one before it, and where the one after."""
    order = np.lexsort((ids, doc))
    a, b = ids[order], doc[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.concatenate([[False], same]), np.concatenate([same, [False]])


def counts(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Every count of a chunk's documents; also its word hashes and word offsets."""
    n = len(offs) - 1
    zero = np.zeros(n, np.int64)
    s, e, wo = K.words(data, offs, K.SPACE)
    ids, h = K.span_identities(data, s, e)
    out = {"n_words": np.diff(wo), "n_bytes": np.diff(offs)}
    solid = ~K.SPACE[data]
    out["word_chars"] = per_doc(solid & ((data & 0xC0) != 0x80), offs)
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = per_doc(table[data], offs)
    if not len(s):
        return out | {k: zero for k in COUNTS if k not in out}, h, wo
    of_word = np.repeat(np.arange(n), out["n_words"])
    _, before, _ = _later_of_doc(ids, of_word)
    out["n_distinct"] = out["n_words"] - np.bincount(np.sort(of_word)[before], minlength=n)
    # lines: from a document's start or after a newline to the next newline or its end
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offs[:-1][np.diff(offs) > 0], breaks + 1]))
    ends = np.sort(np.concatenate([offs[1:][np.diff(offs) > 0], breaks]))
    # a newline that ends a document opens an empty line, which has no word
    held = np.searchsorted(s, ends) > np.searchsorted(s, starts)
    starts, ends = starts[held], ends[held]
    of_line = np.searchsorted(offs, starts, "right") - 1
    out["n_lines"] = np.bincount(of_line, minlength=n)
    order, before, _ = _later_of_doc(K.span_identities(data, starts, ends)[0], of_line)
    out["n_dup_lines"] = np.bincount(of_line[order][before], minlength=n)
    # words in five-word windows that the text has twice or more
    windows = np.maximum(out["n_words"] - 4, 0)
    first = K.ranges(wo[:-1], windows)
    of_window = np.repeat(np.arange(n), windows)
    edge = np.zeros(len(s) + 1, np.int64)
    if len(first):
        order, before, after = _later_of_doc(K.gram_identities(ids, 5)[first], of_window)
        twice = first[order][before | after]
        edge[twice] += 1
        np.subtract.at(edge, twice + 5, 1)
    out["n_repeat_words"] = np.bincount(of_word, np.cumsum(edge[:-1]) > 0, n).astype(np.int64)
    return out, h, wo


def batches_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text): doc_id and COUNTS."""
    for batch in batches:
        data, offs = K.flat(batch.column(1))
        for a, b, d, o in K.chunks(data, offs):
            found, _, _ = counts(d, o)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
