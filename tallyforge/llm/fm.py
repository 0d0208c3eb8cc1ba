"""Quality score by a factorisation machine.

Inputs are a text's hashed words (their shares), structure statistics and its
length as metadata, each cut at quantiles into one-hot cells.  Pairs of inputs
interact through low-rank factors, summed in linear time as
``0.5 * ((sum v x)^2 - sum (v x)^2)``.  Labels, language, source and id are never inputs.

Null texts are empty; an empty text gets the score of its cells.  Rows are scored one
by one, repeated and null ids included, very long texts whole; an empty table gives none, and columns
with this module's own names don't matter.  Without labels every score is one half; documents with
contradictory labels are scored, but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm import textstats as S
from tallyforge.llm.common import bounded_batches
from tallyforge.llm.samples import agreed, sample_by_class, texts_to_fit

WORDS = 1 << 14
CELLS = 12
RANK = 4
#: Labelled rows of each quality that fitting takes, about.
EACH = 4000
RATIOS = ("n_words", "n_bytes", "chars_a_word", "symbols_a_word", "upper_share", "digit_share", "dup_lines", "repeat_words", "distinct_share", "words_a_line", "marks_a_word")


def ratios(c: dict[str, np.ndarray]) -> np.ndarray:
    w, b, n = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([c["n_words"], c["n_bytes"], c["word_chars"] / w, c["n_symbols"] / w, c["n_upper"] / b, c["n_digits"] / b, c["n_dup_lines"] / n, c["n_repeat_words"] / w, c["n_distinct"] / w, c["n_words"] / n, c["n_marks"] / w], axis=1).astype(np.float64)


def inputs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ratios of each document, and its (document, word bucket, share) entries."""
    found, h, wo = S.counts(K.LOWER[data], offs)
    found["n_upper"] = S.per_doc(S.UPPER[data], offs)
    n = np.diff(wo)
    doc = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(doc * WORDS + (h & np.uint64(WORDS - 1)).astype(np.int64), return_counts=True)
    doc = key // WORDS
    return ratios(found), (doc, key % WORDS, count / np.maximum(n, 1)[doc])


@dataclass
class Machine:
    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def entries(self, stats: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All inputs as (document, input, value), by document."""
        doc, bucket, share = words
        cells = np.stack([np.searchsorted(e, stats[:, k], "right") + WORDS + k * CELLS for k, e in enumerate(self.edges)], axis=1)
        d = np.concatenate([np.repeat(np.arange(len(stats)), cells.shape[1]), doc])
        order = np.argsort(d, kind="stable")
        return d[order], np.concatenate([cells.reshape(-1), bucket])[order], np.concatenate([np.ones(cells.size), share * 10])[order]

    def raw(self, n: int, d: np.ndarray, i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(d, np.arange(n))
        line = np.add.reduceat(self.w[i] * x, at)
        vx = self.v[i] * x[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        return self.bias + line + 0.5 * (s * s - np.add.reduceat(vx * vx, at, axis=0)).sum(axis=1), s


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = EACH, epochs: int = 8) -> Machine:
    """A machine fitted by Adagrad on a sample of labelled rows that aren't held out."""
    chosen = F.broadcast(sample_by_class(agreed(labels, label_col), "label", "doc_id", each).withColumnRenamed("doc_id", "of_doc"))  # 2.6 times ``each`` rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, F.col("doc_id") == F.col("of_doc"))
    got = texts_to_fit(rows.where("text is not null"), 4 * each)
    stats, parts, y = [], [], [label for _, label in got]
    n = 0
    for first in range(0, len(got), 1000):
        data, offs = K.flat(pa.array([text for text, _ in got[first : first + 1000]], pa.string()))
        for _, _, d, o in K.chunks(data, offs):
            a, (doc, bucket, share) = inputs(d, o)
            stats.append(a)
            parts.append((doc + n, bucket, share))
            n += len(a)
    stats = np.concatenate(stats) if stats else np.zeros((0, len(RATIOS)))
    edges = np.stack([np.quantile(stats[:, k], np.linspace(0, 1, CELLS + 1)[1:-1]) if n else np.zeros(CELLS - 1) for k in range(len(RATIOS))])
    rng = np.random.default_rng(11)
    size = WORDS + CELLS * len(RATIOS)
    m = Machine(edges, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if not n:
        return Machine(edges, 0.0, np.zeros(size), np.zeros((size, RANK)))
    y = np.asarray(y, np.float64)
    positive = y.mean()
    m.bias = float(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
    d, i, x = m.entries(stats, tuple(np.concatenate(c) for c in zip(*parts)))
    at = np.append(np.searchsorted(d, np.arange(n)), len(d))
    gw, gv = np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            own = np.sort(order[k : k + 64])
            take = K.ranges(at[own], at[own + 1] - at[own])
            dd, ii, xx = np.searchsorted(own, d[take]), i[take], x[take]
            raw, s = m.raw(len(own), dd, ii, xx)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own]) / len(own)
            m.bias -= 0.1 * g.sum()
            used, back = np.unique(ii, return_inverse=True)
            step = np.bincount(back, g[dd] * xx, len(used)) + 1e-6 * m.w[used]
            gw[used] += step**2
            m.w[used] -= 0.1 * step / np.sqrt(gw[used])
            vi = m.v[ii]
            part = g[dd][:, None] * xx[:, None] * (s[dd] - vi * xx[:, None])
            step = np.stack([np.bincount(back, part[:, r], len(used)) for r in range(RANK)], axis=1) + 1e-5 * m.v[used]
            gv[used] += step**2
            m.v[used] -= 0.05 * step / np.sqrt(gv[used])
    return m


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = K.flat(batch.column(1))
            for a, b, d, o in K.chunks(data, offs):
                raw, _ = m.raw(b - a, *m.entries(*inputs(d, o)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(K.lean(run), "doc_id long, score double")
