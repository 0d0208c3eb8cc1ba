"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest

import corpus_pipeline
from tallyforge.llm import bagminhash, decisionlist, fm, langid, linededup, mixing, radix, superkmers, tokens, wumanber


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", "x"), (None, "no id", "y"), (3, None, "z"), (None, None, None)], "item_id long, text string, hit string")


def labels(spark, rows=((1, 1, 0), (1, 1, 0), (7, 0, None), (None, 1, 1), (3, None, 0), (9, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "tokens": lambda d, s: tokens.token_digest(d, parts=2),
    "near": lambda d, s: bagminhash.near_duplicates(d),
    "mix": lambda d, s: mixing.mix(d),
    "words": lambda d, s: superkmers.digest(d),
    "language": lambda d, s: langid.predict(d, langid.fit(d)),
    "bytes": lambda d, s: radix.digest(d),
    "quality": lambda d, s: fm.score(d, fm.fit(d, labels(s))),
    "benchmark": lambda d, s: wumanber.digest(d, bench(s)),
    "rules": lambda d, s: decisionlist.judge(d, decisionlist.fit(d, labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](odd, spark).collect()
    assert len(got) == odd.count()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, odd, name):
    assert OPERATORS[name](odd.where("false"), spark).collect() == []


def test_odd_results(spark, odd):
    near = [(r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(odd).collect()]
    assert (8, 1) in near and (5, 4) in near and (3, 3) in near and (None, None) in near and near.count((1, 1)) == 2
    cut = {r["doc_id"]: r for r in superkmers.digest(odd).collect()}
    assert cut[5]["n_removed"] == cut[5]["n_words"] == 60_000 and cut[4]["n_removed"] == 0 and cut[2]["n_words"] == 0
    cut = {r["doc_id"]: r for r in radix.digest(odd).collect()}
    assert cut[5]["n_removed"] == cut[5]["n_bytes"] > 0 and cut[5]["n_spans"] == 1 and cut[4]["n_removed"] == 0
    found = {r["doc_id"]: r for r in wumanber.digest(odd, bench(spark)).collect()}
    assert found[8]["contaminated"] and found[8]["n_items"] == 1 and found[None]["n_items"] == 0
    said = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert said[2] == said[3] == said[6] == said[7] == "und"
    mixed = mixing.mix(odd).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://h/x", "<p>a</p>", "c"), (1, "http://h/x", "<p>a</p>", "c"), (None, None, None, None), (2, "http://h", "", "c"), (3, "http://h", "<p>a<p>" + "b " * 100_000, "c")], "page_id long, url string, html string, host string").withColumnsRenamed({})
    for extra in ("lines", "salt", "common", "key", "n"):
        pages = pages.selectExpr("*", f"'clash' as {extra}")
    got = linededup.remove_boilerplate(pages).collect()
    assert len(got) == 5 and linededup.remove_boilerplate(pages.where("false")).collect() == []
    assert [r["n_removed"] for r in got if r["page_id"] == 1] == [1, 1]


def tables(spark, docs, at):
    docs.write.parquet(f"{at}/documents.parquet")
    bench(spark).select("item_id", "text").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, odd, tmp_path):
    at = tables(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), tmp_path)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), at).count() == 0
        assert set(stage(spark, odd, at).columns) == set(odd.columns), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    end = corpus_pipeline.STAGES[-1][1](spark, docs, at)
    assert end.count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), at).count() == 0
    assert corpus_pipeline.run(spark, at).count() == docs.count()


def test_stages_decide(spark, corpus, words, tmp_path):
    """Each stage against a plain version of its decision."""
    from tests.llm import brute
    from tests.llm.test_operators import hits

    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    at = tables(spark, docs, tmp_path)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    text = dict(corpus)
    first = docs.where("text rlike '[a-zé]'")
    kept = corpus_pipeline.STAGES[1][1](spark, first, at)
    classes = brute.classes([(i, text[i]) for i in ids(first)])
    assert ids(kept) == sorted(set(classes.values()))
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, " ".join(text[ids(kept)[0]].split()[:20]))]
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    clean = corpus_pipeline.STAGES[2][1](spark, kept, at)
    bad = {i for i in ids(kept) for n, h, _ in [hits(text[i], items)] if h and 20 * h >= n}
    assert bad and ids(clean) == sorted(set(ids(kept)) - bad)
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, at)
    assert set(ids(mixed)) <= set(ids(clean))
    end = corpus_pipeline.STAGES[4][1](spark, mixed, at)
    assert ids(end) == ids(mixed)


NAMELESS = [
    (1, "alpha beta gamma delta epsilon zeta eta", "en", "a", 1),
    (1, "one two three four five six seven", "en", "a", 2),
    (1, "one two three four five six seven", "en", "a", 2),
    (None, "alpha beta gamma delta epsilon zeta eta", "de", "a", 3),
    (None, "red green blue white black brown pink", "en", "b", 4),
    (None, "red green blue white black brown pink", "en", "b", 5),
    (None, "north east south west up down left", "en", "b", 6),
    (3, "red green blue white black brown pink", "fr", "b", 7),
    (4, "", "en", "c", 8),
    (4, None, "en", "c", 9),
    (None, " ", "en", "c", 10),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_without_ids(spark, tmp_path):
    """Near-dedup, row by row: one of each text, whatever its ids, and every text without words."""
    docs = spark.createDataFrame(NAMELESS, COLUMNS)
    kept = sorted((r["doc_id"] or 0, r["n_chars"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect())
    assert kept == sorted([(1, 1), (1, 2), (3, 7), (0, 6), (4, 8), (4, 9), (0, 10)])
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in bagminhash.near_duplicates(docs).collect())
    assert got == sorted([("1", "1")] * 3 + [("None", "1"), ("None", "3"), ("None", "3"), ("None", "None"), ("3", "3"), ("4", "4"), ("4", "4"), ("None", "None")])


def test_mix_without_ids(spark, tmp_path):
    """Mixing takes rows without id and different texts of one id like any others; words alone decide."""
    docs = spark.createDataFrame([r for r in NAMELESS if r[3] == "b" and r[4] != 5] + NAMELESS[:2] + NAMELESS[8:], COLUMNS)
    taken = mixing.mix(docs).collect()
    assert len(taken) == docs.count() and sum(r["taken"] for r in taken) == 5 * 7
    stage = sorted(r["n_chars"] for r in corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect())
    assert len(stage) == 5 and set(stage) <= {1, 2, 4, 6, 7}
    one = spark.createDataFrame([(None, "a b c", "en", None, 1), (None, "d e", "en", None, 2), (7, "f", "en", None, 3), (7, "g h", "en", None, 4)], COLUMNS)
    assert sorted(r["n_chars"] for r in corpus_pipeline.STAGES[3][1](spark, one, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_mix_spread(spark):
    """Rows without id, or all with one, are dealt over the cells of their source like any others."""
    from tallyforge.llm.common import Scratch

    rows = [(k, None if k % 2 else 7, f"a b {k}", "a" if k % 3 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "row long, doc_id long, text string, source string")
    sized = df.withColumn("size", mixing.word_count(df.text)).withColumn("shuffle", mixing.shuffled(df.doc_id, df.text))
    assert sized.selectExpr("source", "substring(shuffle, 1, 3) as cell").groupBy("source", "cell").count().agg({"count": "max"}).first()[0] < 12
    scratch = Scratch(spark)
    queue = mixing.queued(sized, scratch).collect()
    scratch.clear()
    for source in ("a", None):
        own = sorted((r["start"], r["size"]) for r in queue if r["source"] == source)
        assert [a for a, _ in own] == [3 * k for k in range(len(own))]


def test_unknown_languages(spark, tmp_path):
    """A text in a language that no row is labelled with is rejected; clean ones and short ones stay."""
    rng = random.Random(12)
    common = {"en": "the and of thing with that", "de": "der und ung schen keit nicht"}
    rows = [(k, " ".join(rng.choice(common[v].split()) for _ in range(rng.randint(1, 40))), v, "a", 0) for k, v in enumerate(rng.choices(list(common), k=600))]
    odd = [(1000, "日本語のテキストはここにあります。これは長い文章です。", None, "a", 0), (1001, "Это русский текст, который не принадлежит ни к одному языку", None, "a", 0), (1002, "Zażółć gęślą jaźń", None, "a", 0), (1003, None, "en", "a", 0), (1004, "12 !", "en", "a", 0), (None, "the thing", None, "a", 0)]
    kept = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows + odd, COLUMNS), str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(r[0]) for r in [*rows, odd[-1]])


def test_clashing_labels(spark, odd):
    """A document with two labels is not learned from, whichever comes first; it is judged like any other."""
    docs = odd.where("doc_id is not null")
    one = labels(spark, [(1, 1, 0), (7, 0, 0), (9, 1, 0), (9, 0, 0), (8, 0, 1)])
    other = labels(spark, [(9, 0, 0), (8, 0, 1), (9, 1, 0), (7, 0, 0), (1, 1, 0)])
    without = labels(spark, [(1, 1, 0), (7, 0, 0), (8, 0, 1)])
    scores = [sorted((r["doc_id"], r["score"]) for r in fm.score(docs, fm.fit(docs, x)).collect()) for x in (one, other, without)]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == docs.count()


def test_bounded_samples(spark):
    """Fitting gathers no more rows and bytes than it says, equal rows once, and the same ones each time."""
    from tallyforge.llm import samples

    df = spark.createDataFrame([(k % 50, f"{k % 50} " + "x" * (10 * (k % 50)), k % 2) for k in range(200)], "doc_id long, text string, label int").repartition(3)
    got = samples.texts_to_fit(df, 30, total=4000, longest=400)
    assert got == samples.texts_to_fit(df.repartition(2), 30, total=4000, longest=400)
    assert 0 < len(got) <= 30 and sum(len(t) for t, _ in got) <= 4000 and len(set(got)) == len(got) and max(len(t) for t, _ in got) <= 400
    assert samples.texts_to_fit(df.where("false"), 30) == [] and samples.texts_to_fit(df, 30, total=0) == []


def test_hot_groups(spark, words):
    """A third of all rows without id, one id, one text, one host and one source: results as for any others."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, texts[0] if k % 2 else texts[k % 60], "en", "a" if k % 3 else "b", k) for k in range(240)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    for name in ("tokens", "near", "mix", "words", "bytes"):
        assert len(OPERATORS[name](docs, spark).collect()) == len(rows), name
    cut = radix.digest(docs, group_bytes=2000, bucket_bytes=2000, hot=0).collect()
    assert sum(r["n_removed"] == 0 for r in cut) >= len({r[1] for r in rows}) > sum(r["n_bytes"] - r["n_removed"] > 0 for r in cut) - 5
    classes = {r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert 7 in classes
    kept = bagminhash.without_copies(docs).collect()
    assert sorted(r["text"] for r in kept) == sorted({r[1] for r in rows})
