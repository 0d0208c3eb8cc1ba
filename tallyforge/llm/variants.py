"""Spelling variants: words one edit apart, joined over their rarest positional bigrams.

Words are counted over the whole corpus.  Bigrams are ordered by the number of words
that have them, rarest first.  One edit destroys at most two of a word's bigrams and
moves the others by at most one place, so two words one edit apart share one of the
three rarest of each, at places that agree (equal lengths) or differ by the inserted
code point.  Where the third has equals in its word up to two of those count as well, so that
ties lose nothing (:func:`rarest`).  Words of a bucket (bigram, place, length) are compared by what is left
of them without one code point, in time linear in the bucket; a bucket of more than
``CELL`` words is split into blocks, and each pair of blocks meets in one cell.

A word's form is its near word of the largest count, if that is at least ``ratio``
times its own.  Counts grow by that ratio along a chain of forms, so that roots are
found in a few rounds of jumping; each round is a written table.

Null and empty texts have no words; a null id counts as an empty one where it salts an
alteration.  Repeated rows count each time.  Ties of forms go to the smallest in
code-point order.  Very long texts are cut in whole, words of any length take part; an
empty table has no words.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import Scratch, bounded_batches, written

#: Words of a bucket that one cell compares with another block of as many.
CELL = 20_000
#: Rows of a bucket's cell that are gathered before they are compared, at least.
GATHERED = 100_000
_LETTER = K.byte_table((0x41, 0x5A), (0x61, 0x7A))
_OWN, _SHORTER = 0, 1


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned CRC32 of each span after bytes whose CRC32 is ``before``; byte by byte over all spans, long ones one by one."""
    out, size = before.astype(np.uint32), ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -64) :]
    reg, at, longest = ~out[order], starts[order], size[order]
    for k in range(int(longest[0]) if len(order) else 0):
        n = int(np.searchsorted(-longest, -k))
        reg[:n] = _CRC[(reg[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (reg[:n] >> np.uint32(8))
    out[order] = ~reg
    for x in np.flatnonzero(size > 64):
        out[x] = zlib.crc32(data[starts[x] : ends[x]].tobytes(), int(before[x]))
    return out


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``[A-Za-z\\u00C0-\\u00FF]``: the latter are the UTF-8 byte C3 and the one after it."""
    inside = _LETTER[data] | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return K.marked_runs(inside, offs)


def words_of(ids: list, data: np.ndarray, offs: np.ndarray, least: int, altered: int | None) -> pa.StructArray:
    """Distinct words of a chunk of documents with their counts."""
    low = K.LOWER[data]
    s, e, wo = letter_runs(low, offs)
    wide = np.concatenate([[0], np.cumsum(low == 0xC3)])
    size = (e - s) - (wide[e] - wide[s])
    of_doc = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
    held = size >= least
    s, e, size, of_doc = s[held], e[held], size[held], of_doc[held]
    changed: list[str] = []
    if altered and len(s):
        seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        h = crc32_of_spans(low, s, e, seeds[of_doc])
        hit = h % np.uint32(altered) == 0
        for x in np.flatnonzero(hit):
            word = low[s[x] : e[x]].tobytes().decode()
            at = int(h[x]) % len(word)
            if len(word) > least:
                changed.append(word[:at] + word[at + 1 :])
        s, e = s[~hit], e[~hit]
    bounds = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    flat = low[K.ranges(s, e - s)]
    kept = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(bounds), pa.py_buffer(flat))
    return pa.concat_arrays([kept, pa.array(changed, pa.large_string())]).value_counts()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurrences: int = 5, altered: int | None = None) -> DataFrame:
    """(word, n): lower-cased letter runs of at least ``least`` code points that occur often enough.

    ``altered``: a run whose CRC32 with its document's id is divisible by it loses the code
    point at that CRC32 modulo its length first, as a misspelling would.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = K.flat(batch.column(1))
            for a, b, d, o in K.chunks(data, offs):
                found = words_of(ids[a:b], d, o, least, altered)
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

    words = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(K.lean(run), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point of words (that after C3, or the letter), and ``n + 1`` offsets."""
    data, offs = K.flat(column)
    single = data != 0xC3
    return data[single], np.concatenate([[0], np.cumsum(single)])[offs]


def _bigrams(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bigrams as 16 bits, their places, and the words they are of."""
    count = np.maximum(np.diff(offs) - 1, 0)
    at = K.ranges(offs[:-1], count)
    word = np.repeat(np.arange(len(count)), count)
    return codes[at].astype(np.int64) << 8 | codes[at + 1], at - offs[word], word


def bigram_order(words: DataFrame) -> np.ndarray:
    """Rank of each of the 65,536 bigrams of bytes, those in the fewest words first; at most 8,100 of them occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            gram, _, word = _bigrams(*_codes(batch.column(0)))
            total += np.bincount(np.unique(word << 16 | gram) & 0xFFFF, minlength=1 << 16)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(total[have])], names=["gram", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), counts))] = np.arange(1 << 16)
    return rank


def rarest(codes: np.ndarray, offs: np.ndarray, rank: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, bigram and place of the ``most`` rarest positional bigrams of each word, and of up to two more equal to the last of them.

    Of two words one edit apart, take the one whose last is rarer or as rare.  One of its three survives the
    edit; if it is rarer than the other's last, it is among the other's three.  If it is that very bigram, the at most two bigrams
    that the edit made can stand before it, so it is among the other's first five.
    """
    gram, place, word = _bigrams(codes, offs)
    order = np.lexsort((place, rank[gram], word))
    gram, place, word = gram[order], place[order], word[order]
    first = np.searchsorted(word, np.arange(len(offs)))
    within = np.arange(len(word)) - first[word]
    last = np.minimum(first[:-1] + most, first[1:]) - 1
    if len(word):
        kept = (within < most) | ((within < most + 2) & (gram == gram[np.maximum(last, 0)][word]))
    else:
        kept = np.zeros(0, bool)
    return word[kept], gram[kept], place[kept]


def _bucket(gram: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = K.mix(gram.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(16)))
    return K.mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bucket_rows(words: DataFrame, rank: np.ndarray) -> DataFrame:
    """(bucket, role, word, n): each word in the buckets of its own length and, as the shorter one, in those of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offs = _codes(batch.column(0))
            word, gram, place = rarest(codes, offs, rank)
            size = np.diff(offs)[word]
            for role, moved, longer in ((_OWN, 0, 0), (_SHORTER, 0, 1), (_SHORTER, 1, 1)):
                taken = batch.take(pa.array(word))
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(gram, place + moved, size + longer)), pa.array(np.full(len(word), role, np.int8)), taken.column(0), taken.column(1)], names=["bucket", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "bucket long, role byte, word string, n long")


def _equal_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of entries with equal keys, as two arrays of entries; the order that sorts the keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    end = np.searchsorted(k, k, "right")
    more = end - np.arange(len(k)) - 1
    return order[np.repeat(np.arange(len(k)), more)], order[K.ranges(np.arange(len(k)) + 1, more)], order


def near_pairs(cell: np.ndarray, own: np.ndarray, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell whose words differ by exactly one code point; each found by hash and compared."""
    size, starts = np.diff(offs), offs[:-1]
    power, inverse = K._power_tables(len(codes) + 2)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K._BYTES[codes] * power[: len(codes)], dtype=np.uint64)])
    salt = K.mix(cell.view(np.uint64))
    whole = sums[offs[1:]] - sums[starts]
    # every own word without the code point at each place: blanked for a replacement, closed up for an insertion
    mine = np.flatnonzero(own)
    row = np.repeat(mine, size[mine])
    at = K.ranges(starts[mine], size[mine])
    place = (at - starts[row]).astype(np.uint64)
    blank = (whole[row] - (sums[at + 1] - sums[at])) * inverse[starts[row]]
    x, y, _ = _equal_runs(K.mix(blank + K.mix(place + salt[row])))
    a, b, p = row[x], row[y], place[x].astype(np.int64)
    kept = (cell[a] == cell[b]) & (size[a] == size[b]) & (p == place[y].astype(np.int64))
    a, b = a[kept], b[kept]
    equal = _compared(codes, starts[a], starts[b], size[a], None) == 1
    a, b = a[equal], b[equal]
    closed = ((sums[at] - sums[starts[row]]) + (sums[offs[row + 1]] - sums[at + 1]) * inverse[1]) * inverse[starts[row]]
    key = K.mix(closed + salt[row])
    order = np.argsort(key, kind="stable")
    key = key[order]
    short = np.flatnonzero(~own)
    wanted = K.mix(whole[short] * inverse[starts[short]] + salt[short])
    low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
    c, entry = np.repeat(short, high - low), order[K.ranges(low, high - low)]
    d, p = row[entry], place[entry].astype(np.int64)
    kept = (cell[c] == cell[d]) & (size[c] + 1 == size[d])
    c, d, p = c[kept], d[kept], p[kept]
    equal = _compared(codes, starts[c], starts[d], size[c], p) == 0
    c, d = c[equal], d[equal]
    return np.concatenate([a, c]), np.concatenate([b, d])


def _compared(codes: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, without: np.ndarray | None) -> np.ndarray:
    """Places in which ``size`` code points from ``a`` differ from those from ``b``, the latter without one place."""
    if not len(a):
        return np.zeros(0, np.int64)
    x, y = K.ranges(a, size), K.ranges(b, size)
    if without is not None:
        y = y + (y - np.repeat(b, size) >= np.repeat(without, size))
    return np.add.reduceat((codes[x] != codes[y]).astype(np.int64), np.cumsum(size) - size)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each link among rows (cell, role, word, n) that come sorted by cell; a cell isn't cut."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        cell = rows.column(0).to_numpy()
        codes, offs = _codes(rows.column(2))
        a, b = near_pairs(cell, rows.column(1).to_numpy() == _OWN, codes, offs)
        words, n = rows.column(2).combine_chunks(), rows.column(3).combine_chunks()
        one, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        links = pa.table({"word": words.take(one), "other": words.take(other), "n_other": n.take(other)})
        return links.group_by(["word", "other", "n_other"]).aggregate([]).combine_chunks()

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from found(pa.Table.from_batches(held)).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < GATHERED:
            continue
        last = batch.column(0)[-1].as_py()
        # the last cell may go on in the next batch
        rest, done = [], []
        for b in held:
            cut = int(pc.sum(pc.not_equal(b.column(0), last)).as_py() or 0)
            done.append(b.slice(0, cut))
            rest.append(b.slice(cut))
        if any(b.num_rows for b in done):
            yield from whole(done)
            held = [b for b in rest if b.num_rows]
    if held:
        yield from whole(held)


def near_words(words: DataFrame, cell_words: int = CELL) -> DataFrame:
    """(word, other, n_other): every ordered pair of words that differ by exactly one code point, once."""
    rank = bigram_order(words)
    rows = bucket_rows(words, rank)
    hot = rows.groupBy("bucket").count().where(F.col("count") > cell_words).select(F.col("bucket").alias("hot"), F.ceil(F.col("count") / cell_words).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # a block meets each block, itself included, in the cell of both
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(F.col("bucket"), F.least(j, block), F.greatest(j, block)))
    rows = rows.join(hot, F.col("bucket") == F.col("hot"), "left")
    rows = rows.select(F.explode(F.when(F.col("blocks").isNull(), F.array("bucket")).otherwise(cells)).alias("cell"), "role", "word", "n")
    links = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(K.lean(_linked), "word string, other string, n_other long")
    return links.distinct()


def forms(words: DataFrame, ratio: int = 5, cell_words: int = CELL) -> DataFrame:
    """(word, n, form, form_n, n_near) of a written table (word, n)."""
    best = F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("other")))
    near = near_words(words, cell_words).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.n") >= ratio * F.col("n")
    form = F.when(taken, F.col("best.other")).alias("form")
    return words.join(near, F.col("word") == F.col("of"), "left").select("word", "n", form, F.when(taken, -F.col("best.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def with_roots(found: DataFrame) -> DataFrame:
    """A column ``root``: what a word's chain of forms ends in; ``found`` is written."""
    rounds = Scratch(found.sparkSession)
    roots = found.select(F.col("word").alias("of"), F.coalesce("form", "word").alias("root"))
    while True:
        ends = roots.select(F.col("of").alias("mid"), F.col("root").alias("end"))
        now = Scratch(found.sparkSession)
        jumped = now.written(roots.join(ends, F.col("root") == F.col("mid")).select("of", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "roots")
        rounds.clear()
        roots, rounds = jumped.select("of", "root"), now
        if jumped.where("moved").isEmpty():
            return found.join(roots, F.col("word") == F.col("of")).drop("of")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurrences: int = 5, ratio: int = 5, altered: int | None = None, cell_words: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts."""
    if least < 4:
        raise ValueError("words of fewer than four code points may share no bigram after an edit")
    scratch = Scratch(docs.sparkSession)
    words = scratch.written(vocabulary(docs, id_col, text_col, least, occurrences, altered), "words")
    found = written(forms(words, ratio, cell_words), "forms")
    scratch.clear()
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
