"""The operators against plain versions and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bagminhash, decisionlist, fm, kernels, langid, linededup, mixing, radix, rans, superkmers, textstats, tokens, wumanber
from tests.llm import brute

SPLIT = [{}, {"group_bytes": 4000, "bucket_bytes": 2000}, *({"group_bytes": 4000, "bucket_bytes": 2000, "hot": n} for n in (0, 1, 3))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("options", SPLIT)
def test_superkmers(spark, corpus, options):
    got = sorted(tuple(r) for r in superkmers.digest(frame(spark, corpus), **options).collect())
    assert got == brute.by_words(corpus)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("options", SPLIT)
def test_radix(spark, corpus, options):
    got = sorted(tuple(r) for r in radix.digest(frame(spark, corpus), **options).collect())
    assert got == brute.by_bytes(corpus)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("options", [SPLIT[0], *SPLIT[2:4]])
def test_repeats_without_ids(spark, corpus, options):
    """A third of the rows without id, a third under one id: who is first is the order that the operators state."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k, t) for k, t in corpus]
    rows += rows[:5]  # and some rows twice
    df = frame(spark, rows)
    none = lambda out: [(-1 if r[0] is None else r[0], *r[1:]) for r in out]
    got = sorted(none(tuple(r) for r in superkmers.digest(df, **options).collect()))
    assert got == brute.by_words(none(rows)) and sum(r[2] for r in got) > 0
    groups = max(1, -(-sum(len((t or "").encode()) for _, t in rows) // options.get("group_bytes", 4 << 20)))
    of = {(r["doc_id"], r["text"]): r["g"] for r in df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g")).collect()}
    first = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, of[r], r[1]))
    want = brute.by_bytes([(k, t) for k, (_, t) in enumerate(first)])
    want = sorted((-1 if first[k][0] is None else first[k][0], *rest) for k, *rest in want)
    assert sorted(none(tuple(r) for r in radix.digest(df, **options).collect())) == want


def test_shorter_windows(spark, corpus):
    got = sorted(tuple(r) for r in superkmers.digest(frame(spark, corpus), length=12, gram=4, group_bytes=3000).collect())
    assert got == brute.by_words(corpus, 12)


def test_near_duplicates(spark, corpus):
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(frame(spark, corpus)).collect()}
    want = brute.classes(corpus)
    empty = {i for i, t in corpus if not t.split()}
    assert {k: v for k, v in got.items() if k not in empty} == {k: v for k, v in want.items() if k not in empty}
    assert all(got[k] == k for k in empty)
    assert len(set(got.values())) < len(got)


def test_large_near_group(spark, words, monkeypatch):
    """Copies around the threshold, of which many don't link to the least id: blocks and slices of a few."""
    rng = random.Random(2)
    base = [rng.choice(words) for _ in range(110)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"z{k}{rng.random()}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    monkeypatch.setattr(bagminhash, "SLICE", 25)
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(1, 12, 60), rng.integers(1, 12, 60)
    sig = bagminhash.signatures(np.concatenate([h, h]), np.repeat([0, 1], 60), np.concatenate([a, b]), 2, 4096)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(truth, abs=0.035)
    assert np.isfinite(sig).all()


def test_rans():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint16), np.array([5], np.uint16), np.full(1000, 7, np.uint16), (rng.zipf(1.2, 200_001) % 49_408).astype(np.uint16)):
        table = rans.Table.from_counts(np.bincount(ids, minlength=10))
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all()
        for a, b in ((0, 3), (len(ids) // 2, len(ids) // 2 + 70), (max(len(ids) - 5, 0), len(ids) + 9)):
            assert (rans.decode(block, table, a, b) == ids[a:b]).all()
    broken = bytearray(block)
    broken[-3] ^= 255
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table)
    with pytest.raises(ValueError):
        rans.decode(b"none" + block[4:], table)


def test_tokens_are_the_tokenizers(spark, corpus):
    from tokenizers import Tokenizer

    hard = ["It's I'M we'LL d'l. Don't, x.,y a,. ...", "<|endoftext|> A<|ENDOFTEXT|>b <|x", "École ÉCOLE, café. İstanbul ªº µ ß ﬁ", "１２ 3.14 10,000.", "tab\tnew\nline\x0bvt nbsp em", "日本語 テキスト. Ω,", "ΑΣ. ΑΣ", "a" * 300, "!?., .", "é. ñ,", "﻿bom x‍y"]
    rows = corpus + [(1000 + k, t) for k, t in enumerate(hard)] + [(2000, None)]
    got = tokens.token_digest(frame(spark, rows), block_tokens=500, parts=3).orderBy("doc_id").collect()
    plain = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    start = 0
    for (i, t), r in zip(sorted(rows), got, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_very_long_words(spark):
    """A word of more ids than sixteen bits count, in three chunks of one worker, and one just around the store's bound."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    long = "".join(rng.choice("0123456789!?#") for _ in range(90_000))
    rows = [(k, f"start {t} end") for k, t in enumerate([long, "x " * 300_000, long, "plain " * 200_000, long, long[:255], long[:256], long[:255], long[:256], long[:257]])]
    got = tokens.token_digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), parts=1).collect()
    plain = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    assert max(map(len, want.values())) > 65_535
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def test_word_store():
    """Every word is found again by its bytes, also where words share a hash or differ by zeros at the end."""
    rng = np.random.default_rng(2)
    store, words = tokens.Store(np.dtype("<u2")), [str(k).encode() + b"x" * (k % 23) + b"\0" * (k % 2) for k in range(90_000)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts, sizes = ends - [len(w) for w in words], np.array([len(w) for w in words])
    h = rng.integers(0, 2**64, 90_000, dtype=np.uint64)
    h[:40] = h[0]
    for a in range(0, 90_000, 30_000):
        n, own = rng.integers(0, 4, 30_000), slice(a, a + 30_000)
        store.add(h[own], *kernels.blocks(data, starts[own], ends[own]), sizes[own], np.repeat(np.arange(a, a + 30_000) % 65_536, n).astype(np.uint16), n)
    found = store.find(h, *kernels.blocks(data, starts, ends), sizes)
    assert (found == np.arange(90_000)).all()
    some = np.flatnonzero(store.count[found])
    assert (store.pool[store.start[found[some]]] == some % 65_536).all()
    assert (store.find(h, *kernels.blocks(data, np.roll(starts, 1), np.roll(ends, 1)), np.roll(sizes, 1)) < 0)[40:].all()
    assert (store.find(h ^ np.uint64(1 << 62), *kernels.blocks(data, starts, ends), sizes) < 0).all()


def test_mixing(spark, corpus):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 4}") for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(2)).collect()}
    assert again == {k: r["taken"] for k, r in got.items()}
    sizes, source = {i: len(brute.WORD.findall(t)) for i, t, _ in rows}, {i: s for i, _, s in rows}
    order = sorted({s for s in source.values() if s is not None}) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    have = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in order}
    want, left, free = {}, sum(have.values()), set(order)
    while True:  # caps hold, the excess is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * have[s]}
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 3 * have[s]
            left -= want[s]
        free -= over
    for i, r in got.items():
        assert r["size"] == sizes[i] and r["source_size"] == have[source[i]] and r["target"] == pytest.approx(want[source[i]]) and 0 <= r["taken"] <= 3 * r["size"]
    # the plain queue: every pass of every document by its finish time, cut at the budget
    shuffled = lambda i: hashlib.md5(f"mix:{i}:{dict(corpus)[i]}".encode()).hexdigest()
    entries = []
    for k, s in enumerate(order):
        place = 0
        for _ in range(3):
            for i in sorted((i for i in sizes if source[i] == s), key=lambda i: (shuffled(i), i)):
                if sizes[i]:
                    entries.append(((place + sizes[i]) / want[s], k, place, i))
                place += sizes[i]
    left, taken = sum(have.values()), dict.fromkeys(sizes, 0)
    for _, _, _, i in sorted(entries):
        taken[i] += min(left, sizes[i])
        left -= min(left, sizes[i])
    assert {i: r["taken"] for i, r in got.items()} == taken
    for s in order:
        assert abs(sum(taken[i] for i in sizes if source[i] == s) - want[s]) <= max(sizes.values())
    times = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) == (2 * r["taken"] + r["size"]) // (2 * r["size"]) for i, r in got.items() if r["size"])


def hits(doc, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    d, hit, found = low(doc), set(), set()
    for item, text in items:
        w = low(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for x in range(len(d) - n + 1):
                if d[x : x + n] == w[k : k + n]:
                    hit.update(range(x, x + n))
                    found.add(str(item))
    return len(d), len(hit), ",".join(sorted(found))


def test_wu_manber(spark, words):
    rng = random.Random(6)
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(draw(rng.randint(1, 40)))) for k in range(25)] + [(90, "Big Fish"), (91, None), (92, "..."), (90, "other words"), (93, "ÉT été"), (94, "the " * 20)]
    docs = [(k, " ".join(draw(rng.randint(0, 60)) + (rng.choice(items)[1] or "x").split() + draw(5))) for k in range(60)] + [(100, None), (101, ""), (102, "BIG-fish; big"), (103, "ét été Ét"), (104, "the " * 900)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_bytes": 200, "resident": 100}, {"block_bytes": 1500, "resident": 1}):
        clean = wumanber.clean(frame(spark, docs), bench, **options)
        assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in docs for n, hit, _ in [hits(t, items)] if not hit or 20 * hit < n]
        got = {r["doc_id"]: r for r in wumanber.digest(frame(spark, docs), bench, **options).collect()}
        for i, t in docs:
            n, hit, found = hits(t, items)
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items_sha256"]) == (n, hit, hashlib.sha256(found.encode()).hexdigest()), t
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n) and r["n_items"] == len([x for x in found.split(",") if x])


def stats(text):
    w = brute.WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if brute.WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts(corpus):
    texts = [t for _, t in corpus if len(t) < 2500] + ["a\nb\na\n\n a\na \na", "x y z u v " * 4, "p #1 é\n\né", "\n", "end\n", None, "€uro ünï"]
    data, offs = kernels.flat(pa.array(texts, pa.string()))
    for size in (1 << 20, 300):
        at = 0
        for a, b, d, o in kernels.chunks(data, offs, size):
            assert a == at
            at = b
            found, _, _ = textstats.counts(d, o)
            for k in range(a, b):
                assert tuple(int(found[c][k - a]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == stats(texts[k]), texts[k]


def test_decision_list(spark):
    rng = np.random.default_rng(4)
    x = rng.random((4000, len(decisionlist.RATIOS)))
    junk = (x[:, 2] > 0.8) | ((x[:, 5] < 0.3) & (x[:, 6] > 0.6))
    rules = decisionlist.learn(x, junk)
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= decisionlist.covers(r, x)
    assert (got == junk).mean() > 0.97 and (junk[got]).mean() > 0.97
    row = spark.createDataFrame([(10, 50, 9, 0, 0, 60, 1, 3, 0, 1, 9)], ", ".join(f"{c} long" for c in textstats.COUNTS))
    one = [(decisionlist.Condition(2, True, 0.8),)]
    assert row.select(decisionlist.verdict(one).alias("k")).first()["k"] is False and row.select(decisionlist.verdict([]).alias("k")).first()["k"] is True
    assert str(one[0][0]) == "symbols_a_word >= 0.8"


def test_language(spark, corpus):
    rng = random.Random(1)
    common = {"en": "the and of thing with that", "de": "der und ung schen keit nicht", "fr": "le la eau tion pas être", "es": "el los ción mente para niño"}
    rows = [(k, " ".join(rng.choice(common[v].split()) + rng.choice(["", "s"]) for _ in range(rng.randint(3, 60))), v) for k, v in enumerate(rng.choices(list(common), k=800))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df, each=100)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == v for i, _, v in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "日本")], "doc_id long, text string"), langid.fit(df, each=100))
    assert [r["lang_pred"] == "und" for r in none.orderBy("doc_id").collect()] == [True, True, True, False]
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(df.where("false"))).collect()} == {"und"}


def test_factor_machine_identity():
    rng = np.random.default_rng(0)
    m = fm.Machine(np.sort(rng.random((len(fm.RATIOS), fm.CELLS - 1))), 0.3, rng.normal(size=fm.WORDS + fm.CELLS * len(fm.RATIOS)), rng.normal(size=(fm.WORDS + fm.CELLS * len(fm.RATIOS), fm.RANK)))
    stats_, words_ = rng.random((3, len(fm.RATIOS))), (np.array([0, 0, 2]), np.array([5, 9, 5]), np.array([0.5, 0.5, 1.0]))
    d, i, x = m.entries(stats_, words_)
    raw, _ = m.raw(3, d, i, x)
    for k in range(3):
        at = np.flatnonzero(d == k)
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for n, a in enumerate(at) for b in at[n + 1 :])
        assert raw[k] == pytest.approx(m.bias + m.w[i[at]] @ x[at] + pairs)


def test_quality(spark, words):
    rng = random.Random(3)
    rows = [(k, " ".join(("#" if k % 3 == 0 and rng.random() < 0.5 else "") + rng.choice(words) for _ in range(rng.randint(10, 60)))) for k in range(400)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in fm.score(docs, fm.fit(docs, labels, each=150)).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.7) == (k % 3 != 0) for k in held]) > 0.95
    kept = {r["doc_id"]: r["kept"] for r in decisionlist.judge(docs, decisionlist.fit(docs, labels, each=150)).collect()}
    assert np.mean([kept[k] == (k % 3 != 0) for k in held]) > 0.95


def test_lines(spark):
    page = lambda k, *lines: (k, "https://User@Site.example:80/a?b#c" if k else "http://other.example", "<html><script>x<b>1</b></script>" + "".join(f"<p> {x} </p>" for x in lines) + "<!-- c -->")
    rows = [page(k, "menu", f"own {k}", "menu" if k % 2 else "half") for k in range(1, 9)] + [page(0, "menu"), (99, None, None), (98, "odd", "plain"), (97, None, "a<br>b")]
    got = {r["page_id"]: r for r in linededup.remove_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string"), ratio=0.6).collect()}
    assert got[1]["kept_text"] == "own 1" and got[1]["n_lines"] == 3 and got[1]["n_removed"] == 2 and got[1]["host"] == "site.example"
    assert got[2]["kept_text"] == "own 2\nhalf" and got[0]["kept_text"] == "menu"
    assert (got[99]["n_lines"], got[99]["host"]) == (0, "") and got[97]["kept_text"] == "a\nb" and got[98]["host"] == ""


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_pairs_of_hot_stretches(monkeypatch, kind):
    """A second minimiser is looked for only where the first is hot, and gives what it gives over whole texts."""
    from tallyforge.llm import kernels as K
    from tallyforge.llm import repeats as R

    units = R.Units("bytes", 100, 16, R.cut_bytes(16), True) if kind == "bytes" else R.Units("words", 50, 12, R.cut_words(12), False)
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(map(str, rng.integers(0, 10**6, n)))
    common = prose(150)
    texts = [prose(2000) + " " + common + " " + prose(2000) if x % 3 == 0 else common + "x" if x == 1 else "" if x == 2 else prose(3000) for x in range(12)]
    docs = pa.table({"g": pa.array([0] * len(texts)), "text": texts})
    canon, us, ue, uo, grams = units.cut(*K.flat(docs.column("text")))
    one = R.runs(units, uo, grams)
    often, count = np.unique(one[0], return_counts=True)
    often, buckets = often[count > 3], 4
    assert len(often)
    on = np.isin(one[0], often)
    key, own, *rest = R.runs(units, uo, grams, 2)
    hot = np.isin(own, often)
    want = R._by_bucket(0, *R._keys(np.unique(key[hot]), buckets))
    run, seen = R.runs, []
    monkeypatch.setattr(R, "runs", lambda u, o, g, orders=1: (seen.append(len(g)) if orders == 2 else None, run(u, o, g, orders))[1])
    bucket, keys = R._keys(often, buckets)
    answers = pa.table({"bucket": pa.array(range(buckets)), "hot_keys": pa.array([np.sort(keys[bucket == b]).tobytes() for b in range(buckets)], pa.binary())})
    assert R._pairs_listed(units, buckets)(docs, answers).equals(want)
    assert 0 < sum(seen) < len(grams) / 4
    for got, x in zip(R._pairs(units, uo, grams, one, on), (key, own, *rest)):
        assert np.array_equal(got, x[hot])
