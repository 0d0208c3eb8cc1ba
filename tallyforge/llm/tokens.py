"""Token-ID output: whole texts as ids of a public tokenizer, in files of rANS blocks.

A token file is a folder of two Parquet tables: ``blocks`` (a run of whole
documents each, in ascending document order over ``part`` and ``block``) and
``table`` (the id frequencies that all blocks share).  Any store that Spark
writes to can hold it, and every block decodes by itself.

Null texts are empty: they have the end id only.  Rows with equal or null ids
are kept, ordered by a hash of their text and the text (null ids first), and can lie in several ranges.
An empty table gives an empty file; a very long text or word is encoded whole; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm import rans
from tallyforge.llm.common import bounded_batches, deleted, fresh_path, text_bytes

BLOCK_TOKENS = 1 << 19
#: Words whose ids a Python worker remembers, about 60 bytes each; others are encoded again, each time they come.
REMEMBERED = 500_000
#: Ids that all remembered words of a worker may have together, and that one may have.
REMEMBERED_IDS, WORD_IDS = 4_000_000, 255
#: Bytes of text that a range of documents holds, about, where the session's partitions would hold more.
RANGE_BYTES = 128 << 20

_BLOCKS = "part int, block int, before long, n_tokens long, doc_ids array<bigint>, counts array<bigint>, ids binary"
_FILE = "part int, block int, before long, n_tokens long, doc_ids array<bigint>, counts array<bigint>, payload binary"


class Store:
    """Ids of words: an open-addressed table in arrays, looked up for many words at once.

    A word is found by 64 bits of hash and taken only if its bytes are those that are kept.
    """

    def __init__(self, wide: np.dtype):
        self.size, self.pool, self.used = 0, np.zeros(1 << 16, wide), 0
        self.words, self.offs, self.sizes = np.zeros(1 << 16, np.uint64), np.zeros((1 << 12) + 1, np.int64), np.zeros(1 << 12, np.int64)
        self.start, self.count, self.h = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint8), np.zeros(1 << 12, np.uint64)
        self._allot(1 << 16)

    def _allot(self, slots: int) -> None:
        #: The word in each slot, by its number from 1; 0 is free.
        self.mask, self.slots = np.uint64(slots - 1), np.zeros(slots, np.int32)

    def find(self, h: np.ndarray, flat: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of words from 0, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot, left = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(left):
            there = self.slots[slot].astype(np.int64) - 1
            near = np.flatnonzero((there >= 0) & (self.h[there] == h[left]))
            hit = np.zeros(len(left), bool)
            hit[near] = K.equal_blocks(flat, offs, sizes, left[near], self.words, self.offs, self.sizes, there[near])
            out[left[hit]] = there[hit]
            on = ~hit & (there >= 0)
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def _place(self, number: np.ndarray) -> None:
        slot = (self.h[number] & self.mask).astype(np.int64)
        while len(number):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = number[free] + 1
            on = self.slots[slot] != number + 1
            number, slot = number[on], (slot[on] + 1) & int(self.mask)

    @staticmethod
    def _room(held: np.ndarray, need: int) -> np.ndarray:
        return held if need <= len(held) else np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)])

    def add(self, h: np.ndarray, flat: np.ndarray, offs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Words that aren't there yet, each once; ``ids`` are theirs in a row, WORD_IDS a word at most."""
        n, old, of_words = len(h), self.size, int(self.offs[self.size])
        self.pool = self._room(self.pool, self.used + len(ids))
        self.words = self._room(self.words, of_words + len(flat))
        self.offs = self._room(self.offs, old + n + 1)
        self.sizes, self.start, self.count, self.h = (self._room(x, old + n) for x in (self.sizes, self.start, self.count, self.h))
        self.pool[self.used : self.used + len(ids)] = ids
        self.words[of_words : of_words + len(flat)] = flat
        self.offs[old + 1 : old + n + 1] = of_words + offs[1:]
        self.sizes[old : old + n], self.h[old : old + n], self.count[old : old + n] = sizes, h, count
        self.start[old : old + n] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.size += n
        if 2 * self.size > len(self.slots):
            slots = len(self.slots)
            while 2 * self.size > slots:
                slots *= 2
            self._allot(slots)
            self._place(np.arange(self.size))
        else:
            self._place(np.arange(old, self.size))


class WordEncoder:
    """Ids of whole texts by way of their white-space-separated words.

    The tokenizers of this kind split at white space before they merge, so a
    text's ids are its words' ids in a row; repeated words are encoded once.
    Spellings that the normaliser maps together, or a closing stop or comma after a letter
    (a piece of its own), share the entry of the plain word.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model = self.tokenizer.model
        self.end, self.store = end_id, Store(self.wide)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        #: The printable character that stands for each byte in the vocabulary: the byte's own, or one after 255 in order.
        self.shown = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}

    @staticmethod
    def plain(word: bytes) -> tuple[bytes, bytes]:
        """The word that has the same pieces as this one up to a closing mark, and the mark."""
        if b"<|" in word:
            return word, b""
        if word.isascii():
            low = word.lower()
            return (low[:-1], low[-1:]) if low[-1] in b".," and low[-2:-1].isalpha() else (low, b"")
        text = word.decode()
        if max(text) >= "\u0300" or "\u0130" in text:
            return word, b""
        low = text.lower()
        return (low[:-1].encode(), low[-1:].encode()) if low[-1] in ".," and low[-2].isalpha() else (low.encode(), b"")

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of plain words. One of lower-case letters alone is a single piece, which the model takes as it is."""
        out: list[list[int]] = [[]] * len(words)
        rest, tokenize = [], self.model.tokenize
        for k, word in enumerate(words):
            if word.isascii():
                if word.isalpha() and word.islower():
                    out[k] = [t.id for t in tokenize(word.decode())]
                    continue
            else:
                text = word.decode()
                if text.isalpha() and max(text) < "\u0300" and text.lower() == text:
                    out[k] = [t.id for t in tokenize(word.decode("latin-1").translate(self.shown))]
                    continue
            rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        parts = [self.plain(w) for w in words]
        need = list({p for pair in parts for p in pair if p})
        found = dict(zip(need, self._encode(need)))
        found[b""] = []
        ids = [found[base] + found[mark] for base, mark in parts]
        return np.fromiter(chain.from_iterable(ids), self.wide), np.fromiter(map(len, ids), np.int64, len(ids))

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of documents in a row, the end id after each, and how many each has."""
        s, e, wo = K.words(data, offs, K.SPACE)
        (flat, at), sizes = K.blocks(data, s, e), e - s
        h = K.block_hashes(flat, at, sizes)
        number = self.store.find(h, flat, at, sizes)
        start, count, pool = self.store.start[number], self.store.count[number].astype(np.int64), self.store.pool
        new = np.flatnonzero(number < 0)
        if len(new):
            same = lambda a, b: K.equal_blocks(flat, at, sizes, new[a], flat, at, sizes, new[b])
            found = K.identities(h[new], same, lambda k: data[s[new[k]] : e[new[k]]].tobytes())
            _, first, back = np.unique(found, return_index=True, return_inverse=True)
            own, text = new[first], data.tobytes()
            ids, n = self._fresh([text[a:b] for a, b in zip(s[own].tolist(), e[own].tolist())])
            start[new], count[new] = (len(pool) + np.cumsum(n) - n)[back], n[back]
            pool = np.concatenate([pool, ids])
            if self.store.size < REMEMBERED and self.store.used < REMEMBERED_IDS:
                short = n <= WORD_IDS
                kept = own[short]
                blocks = np.diff(at)[kept]
                self.store.add(h[kept], flat[K.ranges(at[kept], blocks)], np.concatenate([[0], np.cumsum(blocks)]), sizes[kept], ids if short.all() else ids[np.repeat(short, n)], n[short])
        docs = len(wo) - 1
        ends = np.cumsum(np.concatenate([[0], count]))[wo[1:]] + np.arange(1, docs + 1)
        out = np.full(int(ends[-1]) if docs else 0, self.end, self.wide)
        out[K.ranges(np.cumsum(count) - count + np.repeat(np.arange(docs), np.diff(wo)), count)] = pool[K.ranges(start, count)]
        return out, np.diff(np.concatenate([[0], ends]))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; called where it is used."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _tokenised(name: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path(name), end_id)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, docs, counts, held = [], [], [], 0

        def flush():
            nonlocal block, before, ids, docs, counts, held
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([before], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "ids": pa.array([b"".join(ids)], pa.binary())})
            block, before, ids, docs, counts, held = block + 1, before + held, [], [], [], 0
            return row

        for batch in batches:
            data, offs = K.flat(batch.column(1))
            for a, b, d, o in K.chunks(data, offs):
                got, n = encode(d, o)
                ids.append(got.tobytes())
                docs += batch.column(0).slice(a, b - a).to_pylist()
                counts += n.tolist()
                held += len(got)
                if held >= block_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def _counted(wide: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                got = np.bincount(np.frombuffer(x.as_buffer(), wide))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return run


def write_token_file(docs: DataFrame, path: str, *, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_tokens: int = BLOCK_TOKENS) -> str:
    """Write the ids of every document, in ascending id order, as a token file at ``path``.

    One range shuffle puts documents in order; the ids are written once, as plain
    blocks beside the file, because the shared table needs all counts first.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    wide = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // RANGE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    plain = f"{path}/plain"
    ordered.mapInArrow(K.lean(_tokenised(tokenizer, end_id, block_tokens)), _BLOCKS).write.option("compression", "zstd").parquet(plain)
    blocks = spark.read.schema(_BLOCKS).parquet(plain)
    counts = blocks.select("ids").mapInArrow(K.lean(_counted(wide)), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    tally = np.zeros(max([0, *(r["symbol"] for r in counts)]) + 1, np.int64)
    for r in counts:
        tally[r["symbol"]] = r["n"]
    table = rans.Table.from_counts(tally)
    spark.createDataFrame([(int(s), int(table.freq[s])) for s in np.flatnonzero(table.freq)], "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table.freq)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rans.Table(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                payload = rans.encode(np.frombuffer(row.column(6)[0].as_buffer(), wide), own)
                yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([payload], pa.binary())], names=["part", "block", "before", "n_tokens", "doc_ids", "counts", "payload"])

    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    starts = totals.select(F.col("part").alias("of_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    file = blocks.mapInArrow(K.lean(encoded), _FILE)
    file.join(F.broadcast(starts), F.col("part") == F.col("of_part")).withColumn("start", F.col("start") + F.col("before")).drop("of_part", "before").write.option("compression", "none").parquet(f"{path}/blocks")
    deleted(spark, plain)
    return path


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size()


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32."""
    bounded_batches(spark)
    rows = spark.read.parquet(f"{path}/table").collect()  # a row for each id of the vocabulary at most
    freq = np.zeros(max([0, *(r["symbol"] for r in rows)]) + 1, np.int64)
    for r in rows:
        freq[r["symbol"]] = r["freq"]
    shared = spark.sparkContext.broadcast(freq)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                start, docs, counts = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values.to_numpy()
                raw = rans.decode(batch.column(3)[k].as_py(), table).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(parts, pa.binary()), pa.array([zlib.crc32(p) for p in parts], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "counts", "payload").mapInArrow(K.lean(decoded), "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and read each document's digest back."""
    path = write_token_file(docs, fresh_path(docs.sparkSession, "tokens"), **options)
    return read_token_file(docs.sparkSession, path).drop("ids")
