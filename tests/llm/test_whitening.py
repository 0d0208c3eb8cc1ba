"""Whitening against plain integers and NumPy's own decomposition."""

import numpy as np
import pytest

from tallyforge.llm import queries, whitening
from tests.llm.test_queries import DIR, read

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, directions = np.linalg.eigh(cov)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return exact, centred, values[::-1][:most], directions[:, ::-1][:, :most], np.trace(cov)


def held_to(rows, ids, vectors, most=32):
    exact, centred, values, directions, trace = plain(vectors, most)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    k = len(values)
    assert len(got) == len(rows) == len(ids) * k
    for c in range(k):
        want = centred @ directions[:, c] / np.sqrt(values[c])
        have = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert got[ids[0], c + 1]["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    assert [got[i, 1]["deviation"] for i in ids] == exact
    assert {r["n"] for r in rows} == {len(ids)} and rows[0]["identity_error"] < 1e-9


def test_op11(spark):
    ids, vectors = zip(*read("embeddings", "vec_id", "embedding"))
    held_to(queries.op11_residue_whitening(spark, DIR).collect(), ids, vectors)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(np.float32(x)) for x in rng.normal(size=5)]) for k in range(40)]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [1.0, float("nan"), 1.0, 1.0, 1.0]), (94, [float("inf")] * 5), (95, [1.0, 2.0])]
    df = spark.createDataFrame([*good, *bad], SCHEMA).repartition(3).selectExpr("*", "'clash' as vector", "'clash' as key", "1 as n", "2 as component")
    held_to(whitening.components(df).collect(), [i for i, _ in good], [v for _, v in good])
    assert whitening.components(df.where("vec_id > 80 and vec_id < 95")).collect() == []
    assert whitening.components(df.where("false")).collect() == []
    # one vector and its copies have no spread: nothing to scale by
    one = whitening.components(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0])], SCHEMA)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in one)


def test_hot_vector(spark):
    """A third of all rows are one vector, and ids are null or repeated."""
    rng = np.random.default_rng(4)
    vectors = [[1.0, 2.0, 3.0] if k % 3 == 0 else [float(np.float32(x)) for x in rng.normal(size=3)] for k in range(90)]
    rows = whitening.components(spark.createDataFrame([(None if k % 2 else 7, v) for k, v in enumerate(vectors)], SCHEMA).repartition(7)).collect()
    assert len(rows) == 270
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(plain(vectors)[0])


def test_residues_are_exact(spark):
    """Scatter of large integers, more than a double or a long holds, from as many primes as they need."""
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**50), 2**50, (300, 3))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    moduli = whitening.primes(2 * 300 * 2**100)
    assert len(moduli) > 5 and all(all(p % q for q in range(2, 1025)) for p in moduli)
    got = whitening.scatter(whitening._vectors(df, "embedding"), 3, 1.0, 0, moduli)
    big = x.astype(object)
    assert (got[:3, :3] == big.T @ big).all() and (got[3, :3] == big.sum(0)).all() and got[3, 3] == 300
    wide = whitening.components(df, most=1).collect()
    assert len(wide) == 300 and {r["deviation"] for r in wide} == {None}
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))
