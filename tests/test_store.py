"""Tables that change whole or not at all, hashes of multisets, invariants counted while a plan runs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import grading as G
from tallyforge.operators import invariants as I
from tallyforge.operators.store import Table


def frame(spark, n, parts=3):
    return spark.range(n).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("é "), "id")).alias("text"), F.array("id").alias("list")).repartition(parts)


def test_versions(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    first = table.write(frame(spark, 100))
    assert first["committed"] and first["number"] == 1 and table.read().count() == 100
    again = table.write(frame(spark, 100, 7).orderBy(F.desc("id")))
    assert not again["committed"] and again["number"] == 1 and len(table.manifests()) == 1
    before = table.read()
    second = table.write(frame(spark, 101))
    assert second["number"] == 2 and table.read().count() == 101 and before.count() == 100 and table.read(1).count() == 100
    # nulls and empty texts, and rows that come twice, are other contents
    assert table.write(frame(spark, 101).fillna(""))["committed"] and table.write(frame(spark, 101).union(frame(spark, 1)))["committed"]
    assert table.sweep(keep=1) == 3 and table.read().count() == 102


def test_killed_writes(spark, tmp_path):
    """A write that fails half-way, and a manifest that was never renamed, leave the old table readable."""
    table = Table(spark, f"file://{tmp_path}/t")
    table.write(frame(spark, 10))
    bad = frame(spark, 1000, 4).withColumn("id", F.when(F.col("id") == 777, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception):
        table.write(bad)
    (tmp_path / "t/_manifests/.half").write_text('{"version": "none"')
    assert table.read().count() == 10 and len(table.manifests()) == 1
    assert table.write(frame(spark, 11))["number"] == 2 and table.read().count() == 11


def test_two_writers(spark, tmp_path):
    """Both found the same last manifest: the later one takes the next number and loses nothing."""
    one, two = (Table(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.write(frame(spark, 5))
    stale = two.manifests()
    one.write(frame(spark, 6))
    two.manifests = lambda: stale
    assert two.write(frame(spark, 7))["number"] == 3 and one.read().count() == 7 and one.read(2).count() == 6


def test_multiset_hash(spark):
    """A key with a third of all rows is hashed by partial sums: as plain sums are, whatever the partitioning."""
    rows = [(0 if k % 3 == 0 else k % 7, k % 50, None if k % 11 == 0 else str(k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, a long, b string")
    got = {r["key"]: r["sha256"] for r in G.content_hash(df, "key", "a", "b").collect()}
    assert got == {r["key"]: r["sha256"] for r in G.content_hash(df.repartition(11), "key", "a", "b").collect()}
    for key in range(7):
        lines = [f"{a}|{b or ''}".encode() for k, a, b in rows if k == key]
        sums = [sum(int(hashlib.sha256(x).hexdigest()[8 * j : 8 * j + 8], 16) for x in lines) for j in range(8)]
        assert got[key] == hashlib.sha256("|".join(map(str, [len(lines), *sums])).encode()).hexdigest()
    assert "collect_list" not in G.content_hash(df, "key", "a")._jdf.queryExecution().executedPlan().toString()


def test_invariants(spark):
    regions = spark.createDataFrame([("a", True, False), ("a", False, True), ("b", True, None), ("b", None, True)], "run_id string, model_visible boolean, digested boolean")
    late = regions.union(spark.createDataFrame([("c", True, True)], regions.schema))
    rule = {"scanned_before_truncation": I.scanned_before_truncation()}
    for df, broken in ((regions, 0), (late, 1)):
        out, seen = I.watched(df, f"scan-{broken}", **rule)
        assert out.count() == 4 + broken
        assert I.verdict(seen) == [("scanned_before_truncation", 4 + broken, broken, not broken)]
        assert {(r["run_id"], r["holds"]) for r in I.verdicts(df, "run_id", **rule).collect()} == {("a", True), ("b", True)} | ({("c", False)} if broken else set())
        if broken:
            with pytest.raises(ValueError, match="1 of 5 rows"):
                I.verdict(seen, failing=True)
            with pytest.raises(Exception, match="broken: scanned_before_truncation"):
                I.enforced(df, **rule).collect()
        else:
            assert I.enforced(df, **rule).count() == 4
