"""Benchmark passages in documents by Wu-Manber search over words.

A benchmark item's windows of 13 consecutive words (an item of fewer words is one
window) are the patterns.  For patterns of one length, a table over blocks of two
words tells how far a search may shift without passing an occurrence; where it
says zero, the block's bucket selects the patterns that end with it, and direct
comparison of the words confirms.  The searches of a chunk, one for each stretch
of a document, advance together.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.  Null and empty texts and
items have none; a very long text is searched whole.  Items of equal id are one item; one
without id marks words but isn't listed; equal items count once.  Documents are judged row by row,
repeated and null ids included.  An empty table gives none, an empty benchmark marks nothing, and columns with
this module's own names don't matter.

Items reach the executors in blocks of ``BLOCK_BYTES`` of text, and at most ``RESIDENT`` blocks at
a time, as arrays of about six times their text.  A benchmark of up to that much is searched in
one pass over the documents without a shuffle; a larger one in several, each with its own blocks, whose marks
are merged by row.  So memory doesn't follow the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import Scratch, bounded_batches, kept_rows, numbered, text_bytes, unused, written
from tallyforge.llm.repeats import canonical_words

LENGTH = 13
BLOCK_BYTES = 8 << 20
#: Blocks that a worker holds at a time.
RESIDENT = 4
STRETCH = 256
TABLE_BITS = 18


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document: text joined by single spaces, starts, ends, word offsets, hashes."""
    canon, s, e, wo = canonical_words(K.LOWER[data], offs, K.NOT_ALNUM)
    return canon.tobytes(), s, e, wo, K.span_hashes(canon, s, e)


def block_hash(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return h[at] if size == 1 else K.mix(h[at - 1] * np.uint64(0xA0761D6478BD642F) + h[at])


class Search:
    """Tables of the patterns of one length: windows that begin at the words ``first`` of a block of items."""

    def __init__(self, length: int, text: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray, first: np.ndarray, item: np.ndarray):
        self.length, self.block, self.text = length, min(2, length), text
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int16)
        for end in range(self.block - 1, length):
            blocks = block_hash(h, first + end, self.block)
            np.minimum.at(self.shift, (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.int16(length - 1 - end))
        self.ends = np.unique(block_hash(h, first + length - 1, self.block))
        lo, hi = s[first], e[first + length - 1]
        whole = K.span_hashes(np.frombuffer(text, np.uint8), lo, hi)
        order = np.lexsort((item, whole))
        whole, lo, hi, item = whole[order], lo[order], hi[order], item[order]
        new = np.ones(len(whole), bool)
        new[1:] = whole[1:] != whole[:-1]
        for k in np.flatnonzero(~new).tolist():  # equal hashes are equal patterns only if the words are
            new[k] = text[lo[k] : hi[k]] != text[lo[k - 1] : hi[k - 1]]
        at = np.flatnonzero(new)
        #: Patterns by hash, their place in the text, and the items that have each.
        self.whole, self.lo, self.hi = whole[at], lo[at].astype(np.int32), hi[at].astype(np.int32)
        self.of, self.items = np.append(at, len(item)).astype(np.int32), item.astype(np.int32)

    def run(self, text: bytes, s: np.ndarray, e: np.ndarray, wo: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and pattern numbers of every occurrence in a chunk."""
        n = np.maximum(np.diff(wo) - self.length + 1, 0)
        stretches = -(-n // STRETCH)
        within = K.ranges(np.zeros(len(n), np.int64), stretches) * STRETCH
        at = np.repeat(wo[:-1], stretches) + within + self.length - 1
        stop = np.minimum(at + STRETCH, np.repeat(wo[1:], stretches))
        found = []
        while len(at):
            block = block_hash(h, at, self.block)
            shift = self.shift[(block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.int64)
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                where = np.minimum(np.searchsorted(self.ends, block[zero]), len(self.ends) - 1)
                found.append(at[zero[self.ends[where] == block[zero]]])
            at = at + np.maximum(shift, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        last = np.concatenate([np.zeros(0, np.int64), *found])
        first = last - self.length + 1
        if not len(first):
            return first, first
        lo, hi = s[first], e[last]
        whole = K.span_hashes(np.frombuffer(text, np.uint8), lo, hi)
        begin, end = np.searchsorted(self.whole, whole), np.searchsorted(self.whole, whole, "right")
        sure = np.flatnonzero(begin < end)
        out = []
        for k, a, b, x, y in zip(first[sure].tolist(), lo[sure].tolist(), hi[sure].tolist(), begin[sure].tolist(), end[sure].tolist()):
            word = text[a:b]
            out += [(k, p) for p in range(x, y) if self.text[self.lo[p] : self.hi[p]] == word]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def items_of(self, doc: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) of the items that have the patterns found in documents."""
        many = len(self.whole)
        pairs = np.unique(doc * many + pattern)
        doc, pattern = pairs // many, pairs % many
        n = (self.of[pattern + 1] - self.of[pattern]).astype(np.int64)
        return np.repeat(doc, n), self.items[K.ranges(self.of[pattern].astype(np.int64), n)]


class Block:
    """The searches of a block of items (id, text), one for each pattern length."""

    def __init__(self, items: list[tuple[object, str | None]], length: int = LENGTH):
        data, offs = K.flat(pa.array([t or "" for _, t in items], pa.string()))
        text, s, e, wo, h = cut(data, offs)
        n = np.diff(wo)
        size = np.minimum(n, length)
        self.ids = [None if item is None else str(item) for item, _ in items]
        self.searches = []
        for k in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == k)
            windows = n[own] - k + 1
            self.searches.append(Search(k, text, s, e, h, K.ranges(wo[:-1][own], windows), np.repeat(own, windows)))


def passes_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, resident: int = RESIDENT) -> Iterator[list]:
    """Broadcast blocks of the benchmark, those of one pass over the documents at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    blocks = max(1, -(-text_bytes(items, "text") // block_bytes))
    spark, scratch = benchmark.sparkSession, Scratch(benchmark.sparkSession)
    if blocks > 1:  # dealt once, so that a block is read alone
        items = scratch.dealt(items.withColumn("place", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "place", "items")
    send = spark.sparkContext.broadcast
    for at in range(0, blocks, resident):
        own = [items.where(F.col("place") == k) if blocks > 1 else items for k in range(at, min(at + resident, blocks))]
        yield [send(Block([(r["item"], r["text"]) for r in block.collect()], length)) for block in own]
    scratch.clear()


def marked(texts: pa.Array, shared: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]]:
    """(first, after the last, word offsets, first words of occurrences, their words, items) for runs of texts."""
    data, offs = K.flat(texts)
    for a, b, d, o in K.chunks(data, offs):
        text, s, e, wo, h = cut(d, o)
        firsts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        listed: dict[int, set] = {}
        for block in shared:
            for search in block.value.searches:
                first, pattern = search.run(text, s, e, wo, h)
                if not len(first):
                    continue
                firsts.append(first)
                sizes.append(np.full(len(first), search.length))
                for doc, item in zip(*(x.tolist() for x in search.items_of(np.searchsorted(wo, first, "right") - 1, pattern))):
                    name = block.value.ids[item]
                    if name is not None:
                        listed.setdefault(doc, set()).add(name)
        yield a, b, wo, np.concatenate(firsts), np.concatenate(sizes), [sorted(listed.get(x, ())) for x in range(b - a)]


def covered(n: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of ``n`` that lie in the occurrences, summed: entry k has those before word k."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + size, minlength=n + 1)
    return np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])


def found(texts: pa.Array, shared: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[str]]]]:
    """(first, after the last, words, words hit, items) for runs of texts."""
    for a, b, wo, first, size, items in marked(texts, shared):
        hit = covered(int(wo[-1]), first, size)
        yield a, b, np.diff(wo), (hit[wo[1:]] - hit[wo[:-1]]).astype(np.int64), items


def _marks(shared: list):
    """(row, n_words, spans, items) of rows (row, text) with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, wo, first, size, items in marked(batch.column(1), shared):
                doc = np.searchsorted(wo, first, "right") - 1
                order = np.argsort(doc, kind="stable")
                doc, spans = doc[order], np.stack([first - wo[doc], size], axis=1)[order]
                at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
                own = doc[at]
                parts = [np.unique(x, axis=0).tobytes() for x in np.split(spans, at[1:])] if len(at) else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + a, pa.int64())), pa.array(np.diff(wo)[own], pa.int64()), pa.array(parts, pa.binary()), pa.array([items[x] for x in own], pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_words, lists of spans, items) with the number of words that the spans cover."""
    for batch in batches:
        hit = []
        for n, parts in zip(batch.column(1).to_pylist(), batch.column(2)):
            spans = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in parts]).reshape(-1, 2)
            hit.append(int(covered(n, spans[:, 0], spans[:, 1])[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), batch.column(3)], names=["row", "n_words", "n_hit", "items"])


def hits_by_pass(rows: DataFrame, passes: Iterable[list]) -> DataFrame:
    """(row, n_words, n_hit, items) of those of the written rows (row, text) that have occurrences in any pass."""
    scratch, parts = Scratch(rows.sparkSession), None
    for shared in passes:
        part = scratch.written(rows.mapInArrow(K.lean(_marks(shared)), "row long, n_words long, spans binary, items array<string>"), "marks")
        parts = part if parts is None else parts.unionByName(part)
        for block in shared:
            block.destroy()
    each = parts.groupBy("row").agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row has one mark a pass
    out = written(each.select("row", "n_words", "spans", "items").mapInArrow(K.lean(_merged), "row long, n_words long, n_hit long, items array<string>"), "hits")
    scratch.clear()
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = K.flat(batch.column(2))
        for a, b, d, o in K.chunks(data, offs):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(cut(d, o)[3]), pa.int64())], names=["row", "doc_id", "n_words"])


_OUT = "doc_id long, n_words long, n_hit long, items array<string>"


def occurrences(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) of every row; no shuffle if one pass is enough."""
    bounded_batches(docs.sparkSession)
    passes = passes_of(benchmark, **options)
    shared, more = next(passes), next(passes, None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if more is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, n, hit, items in found(batch.column(1), shared):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(hit), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

        return rows.mapInArrow(K.lean(run), _OUT)
    rows = written(numbered(rows)[0].select("row", "doc_id", "text"), "rows")
    hits = hits_by_pass(rows.select("row", "text"), chain([shared, more], passes))
    every = rows.mapInArrow(K.lean(_counted), "row long, doc_id long, n_words long")
    hits = hits.select(F.col("row").alias("of_row"), "n_hit", "items")
    return every.join(hits, F.col("row") == F.col("of_row"), "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that the rule doesn't call contaminated."""
    passes = passes_of(benchmark, **options)
    shared, more = next(passes), next(passes, None)
    if more is None:

        def keep(texts: pa.Array) -> np.ndarray:
            return np.concatenate([np.zeros(0, bool), *((hit == 0) | (20 * hit < n) for _, _, n, hit, _ in found(texts, shared))])

        return kept_rows(docs, text_col, keep)
    bounded_batches(docs.sparkSession)
    rows, row = numbered(docs)
    rows = written(rows, "rows")
    hits = hits_by_pass(rows.select(F.col(row).alias("row"), F.col(text_col).alias("text")), chain([shared, more], passes))
    bad = unused(rows, "bad")
    return rows.join(hits.where(contaminated()).select(F.col("row").alias(bad)), F.col(row) == F.col(bad), "left_anti").drop(row)


def contaminated() -> Column:
    """The rule: a twentieth of a document's words or more lie in windows of the benchmark."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = occurrences(docs, benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
