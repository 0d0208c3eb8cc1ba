"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its word 5-grams (words ``[^\x20\x09-\x0D]+``,
unchanged; fewer than five words are one gram).  Every gram runs Poisson
processes over the discretised weights (0,1], (1,2], (2,4], (4,8] ...; a point
has a time, a component and a place in its interval, and counts if its place
isn't above the gram's weight.  A component's value is its first time over all
grams, so two documents agree in it with a chance equal to their weighted
Jaccard similarity.  A process stops once its time passes the document's bound.

Equal bands make candidates, exact overlap decides, and classes are the
connected components of the links.  A band's bucket is first held against one
pivot.  Where the documents that met one pivot are still of several classes,
those outside the largest are indexed and the others stream past them; pairs
that meet in a bucket meet there too, but no candidate pair is ever a row.

The result is classes, so links that join nothing new are not looked for: within
a component, or inside one task between components that another of its links joins.

Every row counts: rows get numbers, equal texts are one text, and neither null ids
nor different texts under one id are dropped.  A row whose text is null, empty or
only white space is a class of its own.  An empty table has no classes, a very long
text is signed whole, and columns with names of this module's own stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import Scratch, bounded_batches, numbered, unused, written
from tallyforge.llm.components import components

BANDS, ROWS = 24, 4
SHINGLE = 5
THRESHOLD = (4, 5)
#: Members that one task holds against a pivot, or against a block of indexed ones.
SLICE = 2000
BLOCK = 2048


def multisets(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, gram) with their counts, in that order."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if not len(h):
        return h, doc, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return h[new], doc[new], np.diff(np.append(new, len(h)))


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) first times; documents without grams have infinity."""
    sig = np.full((n_docs, m), np.inf)
    total = np.bincount(doc, weight, n_docs) if len(doc) else np.zeros(n_docs)
    # an interval (2^(j-1), 2^j] is a process of its own; the last may be cut by the weight
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    of = np.repeat(np.arange(len(h)), blocks)
    level = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    below = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(below, 1)
    base = K.mix(h[of] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    reach = weight[of] - below
    bound = (np.log(m) + 5) / np.maximum(total, 1)
    todo, flat = total > 0, sig.reshape(-1)
    while todo.any():
        own = np.flatnonzero(todo[doc[of]])
        d, seed, size, ends = doc[of][own], base[own], length[own], reach[own]
        at, r = np.zeros(len(own)), 0
        while len(d):
            r += 1
            draw = K.mix(seed ^ np.uint64(r * 0xD1B54A32D192ED03 & (2**64 - 1)))
            at = at - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) / 2.0**53) / (m * size)
            live = np.flatnonzero(at <= bound[d])
            d, seed, size, ends, at, draw = d[live], seed[live], size[live], ends[live], at[live], K.mix(draw[live] + np.uint64(1))
            place = (draw >> np.uint64(32)) % size.astype(np.uint64)
            inside = np.flatnonzero(place.astype(np.int64) < ends)
            np.minimum.at(flat, d[inside] * m + (draw[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m, at[inside])
        todo = todo & np.isinf(sig).any(axis=1)
        sig[todo] = np.inf
        bound[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        out = K.mix(out * np.uint64(0xA0761D6478BD642F) + bits[:, :, r])
    return out.view(np.int64)


def _grams(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offs = K.flat(column)
    for a, b, d, o in K.chunks(data, offs, 2 << 20):
        s, e, wo = K.words(d, o, K.SPACE)
        yield a, b, *multisets(*K.shingles(K.spans(d, s, e), wo, k))


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, doc, weight in _grams(batch.column(2), k):
                keys = band_keys(signatures(h, doc, weight, b - a, bands * rows), bands, rows)
                digest = [hashlib.md5(t.as_buffer() or b"").digest() if t.is_valid else b"" for t in batch.column(2).slice(a, b - a)]
                size = np.bincount(doc, weight, b - a).astype(np.int64) if len(doc) else np.zeros(b - a, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digest, pa.binary()), pa.array(size), lists], names=["row", "doc_id", "digest", "size", "bands"])

    return run


def _held(k: int, over: int, under: int):
    """Links of a stream of groups, each a pivot and then its members; the pivot alone is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in batches:
            group, side, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            a_out, b_out = [], []
            for a, b, h, doc, weight in _grams(batch.column(4), k):
                at = np.searchsorted(doc, np.arange(b - a + 1))
                for x in range(b - a):
                    own = h[at[x] : at[x + 1]], weight[at[x] : at[x + 1]]
                    if side[a + x] == 0:
                        pivot = group[a + x], own
                    elif pivot is not None and pivot[0] == group[a + x]:
                        (ph, pw), (mh, mw) = pivot[1], own
                        where = np.minimum(np.searchsorted(ph, mh), len(ph) - 1)
                        same = ph[where] == mh
                        shared = int(np.minimum(pw[where[same]], mw[same]).sum())
                        if under * shared >= over * (int(pw.sum()) + int(mw.sum()) - shared):
                            a_out.append(group[a + x])
                            b_out.append(ids[a + x])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Those of the written, distinct pairs (a, b) whose gram multisets overlap enough.

    Members travel to their pivot; a pivot with many is dealt to several tasks,
    and each streams its members, so no group is ever held.  The number of slices
    of a pivot is a written table of one row each: in its join with the pairs Spark
    can split a pivot's rows, which it can't where the count is made in the same stage.
    """
    slices = written(pairs.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("p"), F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "slices")
    members = pairs.join(slices, F.col("a") == F.col("p")).select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("side"))
    pivots = slices.select(F.col("p").alias("id"), F.col("p").alias("a"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"))
    rows = members.unionByName(pivots).join(texts.hint("merge"), F.col("id") == F.col("of"))
    dealt = rows.select("a", "slice", "side", "id", "text").repartition("a", "slice").sortWithinPartitions("a", "slice", "side", "id")
    return dealt.mapInArrow(K.lean(_held(k, *threshold)), "a long, b long").distinct()


def _crossed(k: int, over: int, under: int):
    """Links across components in a stream of blocks: the indexed members of one, then those held against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            side, ids, component = (batch.column(c).to_numpy() for c in (3, 4, 5))
            a_out, b_out = [], []
            for a, b, h, doc, weight in _grams(batch.column(6), k):
                at = np.searchsorted(doc, np.arange(b - a + 1))
                for x in range(b - a):
                    if keys[a + x] != key:
                        key, held, index = keys[a + x], [], None
                        parent.clear()
                    mh, mw = h[at[x] : at[x + 1]], weight[at[x] : at[x + 1]]
                    if side[a + x] == 0:
                        held.append((int(ids[a + x]), int(component[a + x]), mh, mw))
                        continue
                    if not held:
                        continue
                    if index is None:
                        grams = np.concatenate([m[2] for m in held])
                        order = np.argsort(grams, kind="stable")
                        index = grams[order], np.repeat(np.arange(len(held)), [len(m[2]) for m in held])[order], np.concatenate([m[3] for m in held])[order], np.array([m[3].sum() for m in held]), np.array([m[1] for m in held])
                    grams, of, weights, sizes, classes = index
                    low = np.searchsorted(grams, mh)
                    n = np.searchsorted(grams, mh, "right") - low
                    where = K.ranges(low, n)
                    shared = np.bincount(of[where], np.minimum(weights[where], np.repeat(mw, n)), len(held))
                    for y in np.flatnonzero((under * shared >= over * (sizes + mw.sum() - shared)) & (classes != component[a + x])).tolist():
                        one, other = root(int(component[a + x])), root(held[y][1])
                        if one != other:  # between classes that links of this task join already nothing changes
                            parent[one] = other
                            a_out.append(int(ids[a + x]))
                            b_out.append(held[y][0])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def across(groups: DataFrame, placed: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between different components inside the groups (pivot, node), as many as join the components.

    A group's largest component needs no test within itself. The members outside
    it are indexed by gram in blocks, and all of the group's members stream past
    each block, a few thousand a task; only links leave the task.
    """
    rows = groups.join(placed.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("pivot", "node", F.coalesce("component", "node").alias("component"))
    shares = rows.groupBy("pivot", "component").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.max_by("component", F.struct(F.col("c"), -F.col("component"))).alias("main"))
    shares = written(shares.where("n > 2 and n > top").select(F.col("pivot").alias("p"), "main", F.ceil((F.col("n") - F.col("top")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "shares")
    rows = rows.join(shares, F.col("pivot") == F.col("p"))
    deal = lambda name, n: F.pmod(F.xxhash64(F.lit(name), F.col("node")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    indexed = rows.where("component <> main").select("pivot", deal("block", "blocks").alias("block"), every("slices").alias("slice"), F.lit(0).alias("side"), "node", "component")
    passing = rows.select("pivot", every("blocks").alias("block"), deal("slice", "slices").alias("slice"), F.lit(1).alias("side"), "node", "component")
    # a slice without indexed members has nothing to do
    sent = indexed.unionByName(passing).join(texts.hint("merge"), F.col("node") == F.col("of")).drop("of")
    dealt = sent.repartition("pivot", "block", "slice").sortWithinPartitions("pivot", "block", "slice", "side", "node")
    return dealt.mapInArrow(K.lean(_crossed(k, *threshold)), "a long, b long").distinct()


def classed(rows: DataFrame, *, k: int = SHINGLE, bands: int = BANDS, rows_a_band: int = ROWS, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Signed rows and the classes of their texts, from a written table (row, doc_id, text) of numbered rows.

    ``signed`` has (row, doc_id, digest, size, bands).  A class has a row for each of its
    texts: (of_digest, node, class_id, first); node is the number of the text's first row by
    (doc_id, null last; row), and ``first`` marks the text of the class that is least by
    (doc_id, null last; digest).
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    signed = written(rows.mapInArrow(K.lean(_signed(k, bands, rows_a_band)), "row long, doc_id long, digest binary, size long, bands array<bigint>"), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    digests = signed.where("size > 0").groupBy("digest").agg(least.alias("f"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    digests = scratch.written(digests.select("digest", F.col("f.row").alias("node"), F.col("f.doc_id").alias("doc_id"), "size", "bands"), "digests")
    banded = scratch.written(digests.select("node", "size", F.explode("bands").alias("bucket")), "banded")
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.min_by("size", "node").alias("of_size"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = scratch.written(buckets, "buckets")  # in a stage of its own, so that a large bucket can be split in the join
    crowd = scratch.written(banded.join(buckets, "bucket").select("node", "size", "pivot", "of_size").distinct(), "crowd")
    # the texts of documents that meet another: they cross the network whole once, and later joins read these alone;
    # joins of texts are merged at every size, so that what a small input shows holds for a large one
    met = crowd.select("node").distinct().hint("merge")
    texts = scratch.written(rows.select(F.col("row").alias("of"), "text").join(met, F.col("of") == F.col("node"), "left_semi"), "crowd-texts")
    near = F.least("size", "of_size") * threshold[1] >= F.greatest("size", "of_size") * threshold[0]
    tested = scratch.written(crowd.where((F.col("node") != F.col("pivot")) & near).select(F.col("pivot").alias("a"), F.col("node").alias("b")), "tested")
    links = scratch.written(verified(tested, texts, k, threshold), "verified")
    first = components(links)
    more = scratch.written(across(crowd.select("pivot", "node"), first, texts, k, threshold), "verified")
    final = first if more.isEmpty() else components(links.unionByName(more))
    placed = digests.select("digest", "node", "doc_id").join(final.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("digest", "node", "doc_id", F.coalesce("component", "node").alias("component"))
    firsts = placed.groupBy(F.col("component").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("f"))
    firsts = scratch.written(firsts.select("c", F.col("f.doc_id").alias("class_id"), F.col("f.digest").alias("d")), "firsts")
    classes = placed.join(firsts, F.col("component") == F.col("c")).select(F.col("digest").alias("of_digest"), "node", "class_id", (F.col("digest") == F.col("d")).alias("first"))
    classes = written(classes, "classes")
    scratch.clear()
    return signed, classes


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the least doc_id of its class; null if all are null)."""
    rows, _ = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    scratch = Scratch(docs.sparkSession)
    signed, classes = classed(scratch.written(rows.select("row", "doc_id", "text"), "rows"), **options)
    scratch.clear()
    found = signed.select("doc_id", F.when(F.col("size") > 0, F.col("digest")).alias("digest")).join(classes, F.col("digest") == F.col("of_digest"), "left")
    return found.select("doc_id", F.when(F.col("of_digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all their columns: one of each class, and every row whose text has no words.

    It is the row of least doc_id (null ids last; of one id's texts the least by digest; of
    rows that are equal in both, one).
    """
    rows, row = numbered(docs)
    rows = written(rows, "rows")
    signed, classes = classed(rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), **options)
    stay = unused(rows, "stay")
    kept = classes.where("first").select("node").unionByName(signed.where("size = 0").select(F.col("row").alias("node"))).select(F.col("node").alias(stay))
    return rows.join(kept, F.col(row) == F.col(stay), "left_semi").drop(row)
