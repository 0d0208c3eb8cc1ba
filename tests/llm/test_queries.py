"""Every registered query of the subpackage over the driver's smallest tables, against SQL or a plain version."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tallyforge.llm import bagminhash, decisionlist, fm, kernels, langid, queries, textstats, tokens
from tallyforge.llm.common import table
from tests.compare import rows
from tests.llm import brute
from tests.llm.test_operators import stats

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


def read(name, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{DIR}/{name}.parquet", columns=list(columns)).to_pylist()]


@pytest.fixture(scope="module")
def docs():
    return read("documents", "doc_id", "text")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 13


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json")), 0, []
    for i, t in sorted(docs):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op1_rans_tokens(spark, DIR)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op2(spark, docs):
    want = brute.classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_bagminhash(spark, DIR).collect()}
    assert got == {i: want[i] if brute.grams(dict(docs)[i]) else i for i in want}


def test_op2_recall(spark):
    """Of all pairs at the threshold between ids divisible by 100 and every row of a larger table, nine tenths at least share a class."""
    at = DIR.replace("0.001", "0.01")
    rows = [(r["doc_id"], brute.grams(r["text"])) for r in pq.read_table(f"{at}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_bagminhash(spark, at).collect()}
    pairs = [(a, b) for a, g in rows if a % 100 == 0 and g for b, h in rows if a != b and g.keys() & h.keys() and brute.jaccard(g, h) >= 0.8]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_op4(spark, docs):
    got = queries.op4_superkmer_dedup(spark, DIR)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute.by_words(docs)


def test_op5(spark, docs):
    """The duels of each text, gram by gram, from the model that the query fits."""
    model = langid.fit(table(spark, DIR, "documents"))
    got = {r["doc_id"]: r for r in queries.op5_language(spark, DIR).collect()}
    assert len(got) == len(docs)
    names = ["family " + f for f in model.families]
    for i, text in docs:
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        assert got[i]["held_out"] == held(i)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        found, grams = Counter(), 0
        for n in (1, 2, 3):
            for k in range(len(data) - n + 1):
                number = sum(data[k + j] << (8 * j) for j in range(n))
                found[((number * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 17] += 1
                grams += 1
        least = dict.fromkeys(names + model.languages, 1.0)
        for (kind, a, b), w, scale in zip(model.duels, model.weights.astype(float), model.scale):
            margin = sum(w[g] * c for g, c in found.items()) * langid.SHARPNESS / len(data) + w[-1]
            chance = 1 / (1 + np.exp(-np.clip(margin * scale, -30, 30)))
            one, other = (a, b) if kind else ("family " + a, "family " + b)
            least[one], least[other] = min(least[one], chance), min(least[other], 1 - chance)
        family = max(model.families, key=lambda f: least["family " + f])
        lang = max((v for v in model.languages if langid.family_of(v) == family), key=least.get)
        seen = sum(c for g, c in found.items() if model.seen[g]) / grams
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(min(least["family " + family], least[lang]) * seen, abs=1e-4)


def test_op6(spark, docs):
    got = queries.op6_radix_dedup(spark, DIR)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute.by_bytes(docs)


def plain_counts(text):
    """The counts of a text, as Python says them."""
    words, lines = brute.WORD.findall(text), [x for x in text.split("\n") if brute.WORD.search(x)]
    n_words, chars, symbols, dup, repeat = stats(text)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_bytes": len(text.encode()), "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_marks": sum(c in ".!?" for c in text), "n_distinct": len(set(words))}


def test_op7(spark, docs):
    """The machine's polynomial of each text, pair by pair, from the machine that the query fits."""
    machine = fm.fit(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
    got = {r["doc_id"]: r for r in queries.op7_factor_quality(spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        text = text or ""
        assert got[i]["held_out"] == held(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.7) and 0 <= got[i]["score"] <= 1
        if len(text) > 2500:
            continue
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        upper = sum("A" <= c <= "Z" for c in text)
        c = {k: np.array([v]) for k, v in (plain_counts(lower) | {"n_upper": upper}).items()}
        x = {fm.WORDS + k * fm.CELLS + int((machine.edges[k] <= v).sum()): 1.0 for k, v in enumerate(fm.ratios(c)[0])}
        words = [w.encode() for w in brute.WORD.findall(lower)]
        for w, n in Counter(words).items():
            h = kernels.spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
            x[int(h) & (fm.WORDS - 1)] = x.get(int(h) & (fm.WORDS - 1), 0) + 10 * n / len(words)
        at, value = list(x), np.array(list(x.values()))
        vx = machine.v[at] * value[:, None]
        gram = vx @ vx.T
        raw = machine.bias + machine.w[at] @ value + (gram.sum() - np.trace(gram)) / 2
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))), abs=1e-6)


def test_op8(spark, docs):
    items, windows = read("benchmark", "item_id", "text"), {}
    for item, text in items:
        w = low_words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    got = {r["doc_id"]: r for r in queries.op8_wu_manber(spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        w, hit, found = low_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_op9(spark, docs):
    """Counts, base rules and the learned list, rule by rule in Python, from the rules that the query fits."""
    rules = decisionlist.fit(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
    got = {r["doc_id"]: r for r in queries.op9_decision_list(spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        c = plain_counts(text or "")
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        ratio = [c[over] / (max(c[under], 1) if under else 1) for _, over, under in decisionlist.RATIOS]
        junk = any(all(ratio[k.ratio] >= k.threshold if k.above else ratio[k.ratio] <= k.threshold for k in rule) for rule in rules)
        assert tuple(got[i][n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == tuple(c[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and not junk)


def test_pipeline(spark, docs):
    """Every row of the output is a document of the table that no stage may remove or that the mix repeats."""
    got = Counter(r["doc_id"] for r in __spark_entry__.queries()["pipeline"](spark, DIR).collect())
    classes = brute.classes([(i, t) for i, t in docs if any(c.isalpha() for c in t or "")])
    assert set(got) <= set(classes.values()) and max(got.values()) <= 3 and bagminhash.THRESHOLD == (4, 5)
    assert set(textstats.COUNTS) == set(plain_counts("x"))
