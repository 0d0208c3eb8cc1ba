"""Windows of a document that occur elsewhere, found exactly and in bounded memory.

Both substring removers share this frame and differ in their units (words or
bytes), in what counts as "elsewhere", and in how a bucket orders its windows.

1. Documents are dealt to groups of a few megabytes.  Each window of a group is
   known by its minimiser, the least hash of the k-grams inside it; equal windows
   have equal minimisers.  The minimisers go, four bytes each, to the bucket of
   their hash, which answers with those that several groups have.
2. A minimiser that more than ``HOT`` groups have says little, as common grams are everywhere.
   Its windows are known by two minimisers and their distance instead (the second by another
   hash), and the same question is asked of these.
3. Of a pair that is hot as well, it is asked of the windows themselves, eight bytes of hash each: most
   that hold the edge of a common passage are met once and needn't go on.
4. Runs of consecutive windows that share a minimiser (or a pair) travel as one packed
   string (a super-k-mer) to its bucket.  A string that its group has
   already is not sent again: it is known to be repeated.
5. The bucket sorts and compares the windows themselves and answers with the places of
   those that aren't the first.  Strings of a hot pair are compared in two
   rounds, as in a tournament: those of a share of the groups first (about the
   square root of all groups each), then those that are first in their share.
6. Each group merges the places and cuts the bytes.

The groups' texts cross the network once: the same exchange serves steps 1 to 4
and 6.  Hashes only tell which windows needn't be compared; what is removed has been
compared.  A group is chosen by id and text, so that neither null ids nor a repeated id
fill one group; rows equal in both share a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import bounded_batches, text_bytes

GROUP_BYTES = 4 << 20
BUCKET_BYTES = 3 << 20
#: Groups that may have a minimiser, or a pair, before it is split.
HOT = 128
#: Text of one pass: its arrays, eight bytes a unit, are to stay in a core's cache.
PASS_BYTES = 1 << 17


@dataclass(frozen=True)
class Units:
    """What a document is a sequence of.

    ``cut(data, offs)`` gives, for a chunk of documents, the canonical bytes, the
    byte start and end of each unit in them, the unit offsets of documents and the
    hashes of the k-grams at each unit.  ``bytes``: units are single bytes.
    """

    name: str
    length: int
    gram: int
    cut: Callable
    same_document: bool


def canonical_words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = K.SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document joined by one space: bytes, word starts, word ends, word offsets."""
    s, e, wo = K.words(data, offs, separators)
    size = e - s
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    out = np.full(int(ends[-1] + 1) if len(ends) else 0, 0x20, np.uint8)
    out[K.ranges(starts, size)] = data[K.ranges(s, size)]
    return out, starts, ends, wo


def cut_words(gram: int) -> Callable:
    def cut(data, offs):
        canon, starts, ends, wo = canonical_words(data, offs)
        return canon, starts, ends, wo, K.gram_hashes(K.span_hashes(canon, starts, ends), gram)

    return cut


def cut_bytes(gram: int) -> Callable:
    if gram != 16:
        raise ValueError("bytes are hashed sixteen at a time")

    def cut(data, offs):
        n = max(len(data) - 7, 0)
        eights = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data), (n, 8), (1, 1)).copy().view("<u8")[:, 0].astype(np.uint64) if n else np.zeros(0, np.uint64)
        both = eights[:-8] * np.uint64(0x9E3779B97F4A7C15) if n > 8 else np.zeros(0, np.uint64)
        both ^= both >> np.uint64(29)
        return data, None, None, offs, K.mix(both + eights[8:] if n > 8 else both)

    return cut


def runs(units: Units, unit_offs: np.ndarray, grams: np.ndarray, orders: int = 1) -> tuple[np.ndarray, ...]:
    """Super-k-mers of a chunk: key, first minimiser, document, first unit, number of windows, units to the first minimiser.

    The windows of one share an occurrence of each of the ``orders`` minimisers, the leftmost
    least grams by as many hashes, so two equal windows always lie equally far before them. The
    grams and their distances are one key.
    """
    counts = np.diff(unit_offs)
    windows = np.maximum(counts - units.length + 1, 0)
    have = np.flatnonzero(windows)
    none = np.zeros(0, np.int64)
    if not len(have):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none, none
    width, place = units.length - units.gram + 1, np.arange(len(grams), dtype=np.uint64)
    anchors, h = [], grams
    for k in range(orders):
        h = K.mix(h + np.uint64(0x9E3779B97F4A7C15)) if k else h
        # 33 bits of hash, then the place
        anchors.append(K.sliding_min(((h >> np.uint64(31)) << np.uint64(31)) | place, width))
    change = np.ones(len(anchors[0]) + 1, bool)
    change[1:-1] = anchors[0][1:] != anchors[0][:-1]
    for anchor in anchors[1:]:
        change[1:-1] |= anchor[1:] != anchor[:-1]
    first = unit_offs[:-1][have]
    change[first] = True
    change[first + windows[have]] = True
    edges = np.flatnonzero(change)
    starts = edges[:-1]
    n = np.diff(edges)
    of = np.searchsorted(first, starts, "right") - 1
    keep = (of >= 0) & (starts < (first + windows[have])[of])
    starts, n = starts[keep], n[keep]
    at = [(anchor[starts] & np.uint64((1 << 31) - 1)).astype(np.int64) for anchor in anchors]
    key = own = grams[at[0]]
    for other in at[1:]:
        key = K.mix(key * np.uint64(0xA0761D6478BD642F) + grams[other] + (other - at[0]).astype(np.uint64))
    return key, own, np.searchsorted(unit_offs, starts, "right") - 1, starts, n, at[0] - starts


def _pairs(units: Units, unit_offs: np.ndarray, grams: np.ndarray, found: tuple[np.ndarray, ...], on: np.ndarray) -> tuple[np.ndarray, ...]:
    """Those of one minimiser's super-k-mers ``found`` that are ``on``, by two minimisers: as :func:`runs` gives them, but
    looked for only in the stretches of windows that they are (a few hundredths of a text, where common grams are hot)."""
    _, _, doc, start, n, _ = (x[on] for x in found)
    at = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + n[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    first, doc = start[at], doc[at]
    size = (np.add.reduceat(n, at) if len(at) else at) + units.length - 1
    offs = np.concatenate([[0], np.cumsum(size)])
    key, own, stretch, start, n, lead = runs(units, offs, grams[np.minimum(K.ranges(first, size), len(grams) - 1)], 2)
    return key, own, doc[stretch], start - offs[stretch] + first[stretch], n, lead


def _passes(column: pa.ChunkedArray):
    return K.chunks(*K.flat(column), PASS_BYTES)


def _ordered(table: pa.Table) -> pa.Table:
    """A group's rows by (doc_id, text): the order that decides which of equal windows is first."""
    table = table.combine_chunks()
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order)


def _keys(minimisers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    spread = K.mix(minimisers ^ np.uint64(0x5851F42D4C957F2D))
    return ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), spread.astype(np.uint32)


def _by_bucket(g: int, bucket: np.ndarray, keys: np.ndarray) -> pa.Table:
    """(bucket, g, keys): a row for each bucket, its keys packed."""
    order = np.lexsort((keys, bucket))
    bucket, keys = bucket[order], keys[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    packed = [x.tobytes() for x in np.split(keys, at[1:])] if len(at) else []
    return pa.table({"bucket": pa.array(bucket[at], pa.int64()), "g": pa.array([g] * len(at), pa.int64()), "keys": pa.array(packed, pa.binary())})


def _listed(units: Units, buckets: int):
    """Step 1: the distinct keys of a group's minimisers."""

    def run(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for _, _, d, o in _passes(table.column("text")):
            _, _, _, uo, grams = units.cut(d, o)
            found.append(np.unique(runs(units, uo, grams)[0]))
        return _by_bucket(table.column("g")[0].as_py(), *_keys(np.unique(np.concatenate(found)), buckets))

    return run


def _pairs_listed(units: Units, buckets: int):
    """Step 2: the distinct keys of a group's pairs whose first minimiser is hot."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hot, found = _answered(answers, "hot_keys"), [np.zeros(0, np.uint64)]
        if docs.num_rows and len(hot):
            for _, _, d, o in _passes(docs.column("text")):
                _, _, _, uo, grams = units.cut(d, o)
                one = runs(units, uo, grams)
                found.append(np.unique(_pairs(units, uo, grams, one, _among(_full(one[0], buckets), hot))[0]))
        return _by_bucket(docs.column("g")[0].as_py() if docs.num_rows else 0, *_keys(np.unique(np.concatenate(found)), buckets))

    return run


def _shared(hot: int):
    """Steps 1 and 2, a bucket: (g, bucket, keys, hot_keys) that several groups have, and of these those of many."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
        g, bucket = table.column("g").to_numpy(), table.column("bucket")[0].as_py()
        every, count = np.unique(np.concatenate(keys), return_counts=True)
        some, many = every[count > 1], every[count > hot]
        plain, hots = [], []
        for k in keys:
            plain.append(k[_among(k, some)].tobytes())
            hots.append(k[_among(k, many)].tobytes())
        return pa.table({"g": pa.array(g, pa.int64()), "bucket": pa.array([bucket] * len(g), pa.int64()), "keys": pa.array(plain, pa.binary()), "hot_keys": pa.array(hots, pa.binary())})

    return run


def _answered(answers: pa.Table, column: str) -> np.ndarray:
    """Sorted keys of a group's answers, each with its bucket in the upper half."""
    bits = [np.uint64(b << 32) for b in answers.column("bucket").to_pylist()]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) | b for x, b in zip(answers.column(column), bits))]))


def _full(minimisers: np.ndarray, buckets: int) -> np.ndarray:
    bucket, key = _keys(minimisers, buckets)
    return key.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32))


def _window_hashes(units: Units, canon: np.ndarray, us, ue, first: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at the units ``first``."""
    last = first + units.length - 1
    return K.span_hashes(canon, first, last + 1) if us is None else K.span_hashes(canon, us[first], ue[last])


def _windows_listed(units: Units, buckets: int):
    """Step 3: the hashes of windows that have a hot pair; twice where the group has two."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        of = lambda step: _answered(answers.filter(pc.equal(answers.column("step"), step)), "hot_keys")
        hot, hot_pairs, found = of(1), of(2), [np.zeros(0, np.uint64)]
        if docs.num_rows and len(hot_pairs):
            for _, _, d, o in _passes(docs.column("text")):
                canon, us, ue, uo, grams = units.cut(d, o)
                one = runs(units, uo, grams)
                pair, _, _, start, n, _ = _pairs(units, uo, grams, one, _among(_full(one[0], buckets), hot))
                take = _among(_full(pair, buckets), hot_pairs)
                if take.any():
                    found.append(_window_hashes(units, canon, us, ue, K.ranges(start[take], n[take])))
        h, count = np.unique(np.concatenate(found), return_counts=True)
        h = np.repeat(h, np.minimum(count, 2))
        return _by_bucket(docs.column("g")[0].as_py() if docs.num_rows else 0, (K.mix(h) % np.uint64(buckets)).astype(np.int64), h)

    return run


def _windows_shared(table: pa.Table) -> pa.Table:
    """Step 3, a bucket: (g, windows) with the hashes that are met again, in the group or another."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    every, count = np.unique(np.concatenate(keys), return_counts=True)
    again = every[count > 1]
    return pa.table({"g": table.column("g").cast(pa.int64()), "windows": pa.array([np.unique(k[_among(k, again)]).tobytes() for k in keys], pa.binary())})


_BLOBS = ("local", "minimisers", "rows", "ats", "counts", "leads", "sizes", "strings")
_PACKED = pa.schema([("bucket", pa.int64()), ("share", pa.int64()), ("g", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in _BLOBS)])
_PACKED_SQL = "bucket long, share long, g long, ids array<bigint>, " + ", ".join(f"{c} binary" for c in _BLOBS)


def _strings(own: list[tuple]) -> dict:
    """Packed columns of strings (row, at, windows, string, minimiser, lead, id)."""
    whole = lambda c, kind: np.array([s[c] for s in own], kind).tobytes()
    return {"minimisers": whole(4, np.uint64), "ids": [s[6] for s in own], "rows": whole(0, np.int64), "ats": whole(1, np.int64), "counts": whole(2, np.int32), "leads": whole(5, np.int32), "sizes": np.array([len(s[3]) for s in own], np.int32).tobytes(), "strings": b"".join(s[3] for s in own)}


def _packed(units: Units, buckets: int, strings_in: int, shares: int):
    """Step 4: packed strings by bucket; places already known to be repeated go in a bucket of their group's own."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _PACKED.empty_table()
        g = docs.column("g")[0].as_py()
        docs = _ordered(docs)
        of = lambda step: answers.filter(pc.equal(answers.column("step"), step))
        shared, hot, pairs, hot_pairs = _answered(of(1), "keys"), _answered(of(1), "hot_keys"), _answered(of(2), "keys"), _answered(of(2), "hot_keys")
        again = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in of(3).column("windows"))]))
        ids = docs.column("doc_id").to_pylist()
        pieces = []
        for a, _, d, o in _passes(docs.column("text")):
            canon, us, ue, uo, grams = units.cut(d, o)
            one = runs(units, uo, grams)
            m, _, doc, start, n, lead = one
            found = [(m, _full(m, buckets), doc, start, n, lead)]
            if len(hot):
                on = _among(found[0][1], hot)
                pair, _, doc, start, n, lead = _pairs(units, uo, grams, one, on)
                found = [[x[~on] for x in found[0]], [pair, _full(pair, buckets), doc, start, n, lead]]
            pieces.append((a, canon, us, ue, uo, found))
        values, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for p in pieces for x in p[5])]), return_counts=True)
        twice = values[count > 1]
        seen: dict[bytes, int] = {}
        local: list[tuple[int, int, int]] = []
        sent: dict[bool, list[tuple]] = {False: [], True: []}
        for a, canon, us, ue, uo, found in pieces:
            parts = []
            for (m, full, doc, start, n, lead), known, warm in zip(found, (shared, pairs), (hot[:0], hot_pairs)):
                take = np.flatnonzero(_among(full, known) | _among(m, twice))
                first, off, k, hotter = start[take], np.zeros(len(take), np.int64), n[take], _among(full[take], warm)
                if hotter.any():  # of hot pairs the runs of windows that are met again
                    which = np.repeat(np.flatnonzero(hotter), k[hotter])
                    place = K.ranges(np.zeros(int(hotter.sum()), np.int64), k[hotter])
                    on = _among(_window_hashes(units, canon, us, ue, first[which] + place), again)
                    which, place, size = joined_places(place[on], which[on], 1)
                    cold = np.flatnonzero(~hotter)
                    hotter = np.arange(len(cold) + len(which)) >= len(cold)
                    take, first, off, k = (np.concatenate(x) for x in ((take[cold], take[which]), (first[cold], first[which] + place), (off[cold], place), (k[cold], size)))
                parts.append((m[take], doc[take], first, k, lead[take] - off, hotter))
            m, doc, first, n, lead, warm = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(first, kind="stable")  # a document's earlier rows are seen first
            m, doc, first, n, lead, warm = (x[order] for x in (m, doc, first, n, lead, warm))
            text = canon.tobytes()
            last = first + n + units.length - 2
            lo, hi = (first, last + 1) if us is None else (us[first], ue[last])
            for x, (b, e, hotter, row, at, k, ahead) in enumerate(zip(lo.tolist(), hi.tolist(), warm.tolist(), (doc + a).tolist(), (first - uo[doc]).tolist(), n.tolist(), lead.tolist())):
                string = text[b:e]
                before = seen.get(string)
                if before is None:
                    seen[string] = row
                elif units.same_document or ids[before] != ids[row]:
                    local.append((row, at, k + units.length - 1))
                    continue
                sent[hotter].append((row, at, k, string, m[x], ahead, ids[row]))
        out = [{"bucket": -1 - g, "share": -1, "g": g, "local": np.array(local, np.int64).tobytes()}] if local else []
        for hotter, own in sent.items():
            by: dict[int, list] = {}
            if own:
                for w, s in zip((K.mix(np.array([s[4] for s in own], np.uint64) + np.uint64(1)) % np.uint64(strings_in)).tolist(), own):
                    by.setdefault(w, []).append(s)
            share = int(K.mix(np.array([g], np.uint64))[0] % np.uint64(shares)) if hotter else -1
            out += [{"bucket": w, "share": share, "g": g, **_strings(x)} for w, x in by.items()]
        return pa.Table.from_pylist(out, schema=_PACKED)

    return run


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[at] == x


def _ranked(ids: pa.Array, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by id, null first, then by the others; and each entry's document number in that order."""
    none = np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    rank = np.lexsort((*then[::-1], ids, ~none))
    if not len(rank):
        return rank, rank
    ids, none = ids[rank], none[rank]
    return rank, np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))


def _compared(order: Callable, units: Units):
    """Step 5, a bucket: rows with the spots (``local``) in a group that ``order`` finds repeated.

    Of a share of a hot bucket's strings, also those that go on: with a window that isn't repeated there.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket, share = table.column("bucket")[0].as_py(), table.column("share")[0].as_py()
        if bucket < 0:
            return pa.Table.from_pylist([{"bucket": bucket, "share": -1, "g": -1 - bucket, "local": b"".join(x.as_py() for x in table.column("local"))}], schema=_PACKED)
        cat = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
        m, rows, ats, counts, leads, sizes = cat("minimisers", np.uint64), cat("rows", np.int64), cat("ats", np.int64), cat("counts", np.int32), cat("leads", np.int32), cat("sizes", np.int32)
        g = np.repeat(table.column("g").to_numpy(), [len(x.as_buffer()) // 8 for x in table.column("rows")])
        data = b"".join(x.as_py() for x in table.column("strings"))
        begin = np.cumsum(sizes.astype(np.int64)) - sizes
        ids = pa.concat_arrays([x.values for x in table.column("ids")])
        rank, doc = _ranked(ids, g, rows, ats)
        which, at, n = order(data, begin[rank], sizes[rank], counts[rank].astype(np.int64), leads[rank], m[rank], doc)
        place = rank[which]
        spots = np.stack([g[place], rows[place], ats[place] + at, n], axis=1)
        spots = spots[np.argsort(spots[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], spots[1:, 0] != spots[:-1, 0]])) if len(spots) else np.zeros(0, np.int64)
        out = [{"bucket": -1 - int(x[0, 0]), "share": -1, "g": int(x[0, 0]), "local": np.ascontiguousarray(x[:, 1:], np.int64).tobytes()} for x in np.split(spots, cuts[1:])] if len(cuts) else []
        if share >= 0:
            late = np.bincount(place, n - units.length + 1, len(rows))
            on = np.flatnonzero(late < counts)
            ids, by = ids.to_pylist(), {}
            for x in on.tolist():
                by.setdefault(int(g[x]), []).append((rows[x], ats[x], counts[x], data[begin[x] : begin[x] + sizes[x]], m[x], leads[x], ids[x]))
            out += [{"bucket": bucket, "share": -1, "g": k, **_strings(own)} for k, own in by.items()]
        return pa.Table.from_pylist(out, schema=_PACKED)

    return run


def windows_of(counts: np.ndarray, leads: np.ndarray, m: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the strings ``keep`` that share minimiser and distance with another: string, offset, group.

    This is the first digit: windows that differ in it can't be equal.
    """
    which = np.repeat(keep, counts[keep])
    off = np.arange(len(which)) - np.repeat(np.cumsum(counts[keep]) - counts[keep], counts[keep])
    digit = K.mix(m[which] + (leads[which] - off).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(digit, kind="stable")
    which, off, group = grouped(which[order], off[order], digit[order])
    return which, off, group


def grouped(which: np.ndarray, off: np.ndarray, *digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted windows without those that are alone with their digits, and group numbers."""
    if not len(which):
        return which, off, which
    new = np.zeros(len(which) + 1, bool)
    new[0] = new[-1] = True
    for d in digits:
        new[1:-1] |= d[1:] != d[:-1]
    alone = new[:-1] & new[1:]
    group = np.cumsum(new[:-1])
    return which[~alone], off[~alone], group[~alone]


def joined_places(at: np.ndarray, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows (string, offset), sorted, as runs: string, first offset, units covered."""
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)]))
    stop = np.append(new[1:], len(at)) - 1
    return which[new], at[new], at[stop] - at[new] + length


def removed_mask(n_units: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    edge = np.zeros(n_units + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_places(docs: DataFrame, units: Units, order: Callable, finish: Callable, schema: str, *, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """``finish(ordered documents, row, at, n)`` of every group, with the repeated windows' places in it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    total = text_bytes(docs, text_col)
    groups, buckets, strings_in = (max(1, -(-total // size)) for size in (group_bytes, 4 * group_bytes, bucket_bytes))
    shares = max(1, int(groups**0.5))
    own = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups)).alias("g"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a hundred megabytes a task or so, whatever the session asks for; a task holds one group at a time, so that
    # memory doesn't follow the tasks' size where the bound on their number makes them larger
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups // 32, 200_000))
    own = own.repartition(parts, "g")
    keys = "bucket long, g long, keys binary"
    asked = lambda rows, step: rows.groupBy("bucket").applyInArrow(_shared(hot), "g long, bucket long, keys binary, hot_keys binary").withColumn("step", F.lit(step))
    minimisers = asked(own.groupBy("g").applyInArrow(_listed(units, buckets), keys), 1)
    many = lambda answers: answers.where(F.octet_length("hot_keys") > 0).select("g", "bucket", "hot_keys", "step").groupBy("g")
    pairs = asked(own.groupBy("g").cogroup(many(minimisers)).applyInArrow(_pairs_listed(units, buckets), keys), 2)
    windows = own.groupBy("g").cogroup(many(minimisers.unionByName(pairs))).applyInArrow(_windows_listed(units, buckets), keys)
    windows = windows.groupBy("bucket").applyInArrow(_windows_shared, "g long, windows binary").withColumn("step", F.lit(3))
    answers = minimisers.unionByName(pairs).unionByName(windows, allowMissingColumns=True)
    packed = own.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_packed(units, buckets, strings_in, shares), _PACKED_SQL)
    first = packed.groupBy("bucket", "share").applyInArrow(_compared(order, units), _PACKED_SQL)
    places = first.groupBy("bucket").applyInArrow(_compared(order, units), _PACKED_SQL).select("g", "local")

    def last(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return finish(docs, *np.zeros((3, 0), np.int64))
        docs = _ordered(docs)
        spots = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in found.column("local"))]).reshape(-1, 3)
        spots = spots[np.argsort(spots[:, 0], kind="stable")]
        return finish(docs, spots[:, 0], spots[:, 1], spots[:, 2])

    return own.groupBy("g").cogroup(places.groupBy("g")).applyInArrow(last, schema)
