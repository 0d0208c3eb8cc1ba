"""Variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import queries, variants
from tests.llm.test_queries import DIR, read

LOW = {k: k + 32 for k in range(65, 91)}


def counted(rows, altered=199, least=6, occurrences=5):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if altered and h % altered == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += len(word) >= least
    return {w: n for w, n in total.items() if n >= occurrences}


def near(words):
    """Words that differ by one code point, by what is left without it."""
    out, blanked = {w: set() for w in words}, {}
    for w in words:
        for k in range(len(w)):
            blanked.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (x := w[:k] + w[k + 1 :]) in out:
                out[w].add(x)
                out[x].add(w)
    for group in blanked.values():
        for a in group:
            out[a].update(b for b in group if b != a)
    return out


def plain(words, ratio=5):
    links, form = near(words), {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(links[w]), words.get(form[w]))
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_op13(spark):
    assert found(queries.op13_spelling_variants(spark, DIR)) == plain(counted(read("documents", "doc_id", "text")))


def test_one_edit(spark):
    """Few letters and repeated bigrams, so that ties among the rarest are common; buckets are split as well."""
    rng = random.Random(6)
    draw = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
    words = {draw(): rng.choice([5, 6, 30, 150, 900]) for _ in range(1500)}
    words |= {"ab" * 400: 9, "ab" * 400 + "b": 50, "a" * 700: 5, "a" * 701: 25}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for cell in (variants.CELL, 40):
        got = found(variants.with_roots(variants.written(variants.forms(df, cell_words=cell), "forms")))
        assert got == plain(words)


def test_odd_documents(spark, odd):
    texts = [(1, "Straßen straßen STRAßEN strassen Straßen straßen"), (1, "Straßen straßen"), (2, None), (None, "straßenx " * 40), (None, None), (3, "x" * 300_000 + " " + "short " * 9), (4, "ÀÖ×Ø÷ÿÀÖ " * 6)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'clash' as word", "'clash' as n", "1 as cell").repartition(3)
    for altered in (None, 2):
        assert found(variants.variants(df, altered=altered)) == plain(counted(texts, altered))
    assert found(variants.variants(odd)) and variants.variants(odd.where("false")).collect() == []
    with pytest.raises(ValueError):
        variants.variants(df, least=3)


def test_crc():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 200)
    ends = starts + rng.integers(0, 130, 200)
    before = np.array([zlib.crc32(str(k).encode()) for k in range(200)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(starts, ends, before)]
    assert variants.crc32_of_spans(data, starts, ends, before).tolist() == want


def test_root_chains(spark):
    rows = [(f"w{k:02}", f"w{k + 1:02}" if k < 40 else None) for k in range(41)]
    got = variants.with_roots(variants.written(spark.createDataFrame(rows, "word string, form string"), "forms")).collect()
    assert len(got) == 41 and {r["root"] for r in got} == {"w40"}
