"""Words, lines and windows that share a hash stay apart."""

import zlib

import numpy as np
import pytest

from tallyforge.llm import bagminhash, kernels, textstats, tokens
from tests.llm.test_queries import plain_counts


def thue_morse(length, letters):
    other = str.maketrans(letters, letters[::-1])
    word = letters[0]
    while len(word) < length:
        word += word.translate(other)
    return word, word.translate(other)


SIZES = [1024, 2048, 4096]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))


def arrays(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])


@pytest.mark.parametrize("length", SIZES)
def test_words(plain, length):
    texts = [w for letters in ("x7", "ab", "éè") for w in thue_morse(length, letters)] + ["a\0", "a", "a\0\0"]
    encode = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"), 2)
    for _ in range(2):  # the second time from what is remembered
        ids, n = encode(*arrays([t + " " for t in texts]))
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def one_hash(monkeypatch):
    monkeypatch.setattr(kernels, "block_hashes", lambda flat, offs, sizes: np.zeros(len(sizes), np.uint64))
    monkeypatch.setattr(kernels, "gram_hashes", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))


@pytest.mark.parametrize("collide", [False, True])
def test_counts(monkeypatch, collide):
    """Counts by bytes, even if every hash is the same."""
    a, b = thue_morse(1024, "ab")
    texts = [f"{a} {b}\n{b} {a}\n{a} {b}", "", "p q r s t u p q r s t\np q", f"{a}\n{b}", " ".join([a, b] * 6), "a\0 a"]
    if collide:
        one_hash(monkeypatch)
    got, _, _ = textstats.counts(*arrays(texts))
    for k, t in enumerate(texts):
        assert {c: int(got[c][k]) for c in textstats.COUNTS} == plain_counts(t)


def test_colliding_words(monkeypatch, plain):
    one_hash(monkeypatch)
    encode = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"), 2)
    for text in ("one two three one", "two four, one Three"):
        ids, _ = encode(*arrays([text]))
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_near_duplicates(spark):
    """Texts without a common word are no copies."""
    pairs = [thue_morse(n, "ab") for n in SIZES]
    rows = [(k, " ".join(w[side] for w in pairs for _ in range(3))) for k, side in enumerate((0, 1, 0))]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_digest(spark, plain):
    a, b = thue_morse(1024, "x7")
    rows, start = [(0, f"{a} {b}"), (1, f"{b} {a}"), (2, "end")], 0
    got = sorted(tokens.token_digest(spark.createDataFrame(rows, "doc_id long, text string"), parts=1).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    for row, (i, t) in zip(got, rows):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(row) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
