"""Segmented scans against plain loops, with a run that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import events as E
from tallyforge.operators import scan as S

RNG = random.Random(8)
ROWS = [(None if k % 11 == 0 else "hot" if k % 3 == 0 else f"r{k % 40}", k, RNG.choice([None, 1, 2, 3]), RNG.choice("ab")) for k in range(30_000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "run_id string, seq long, v long, c string").repartition(7).cache()


def by_run(back=False):
    out = {}
    for r in sorted(ROWS, key=lambda r: r[1], reverse=back):
        out.setdefault(r[0], []).append(r)
    return out


def plain(step, start, back=False):
    out = {}
    for own in by_run(back).values():
        state = start
        for r in own:
            state, shown = step(state, r)
            out[r[1]] = shown
    return out


def add(state, r):
    state += r[2] or 0
    return state, state


def last(state, r):
    state = state if r[2] is None else r[2]
    return state, state


def scans():
    return {
        "total": (S.total(F.col("v")), add, 0),
        "total_before": (S.total(F.col("v"), before=True), lambda s, r: (s + (r[2] or 0), s), 0),
        "ordinal": (S.ordinal(), lambda s, r: (s + 1, s + 1), 0),
        "count": (S.count(F.col("v") > 1), lambda s, r: (s + ((r[2] or 0) > 1),) * 2, 0),
        "last": (S.last_known(F.col("v")), last, None),
        "last_before": (S.last_known(F.col("v"), before=True), lambda s, r: (last(s, r)[0], s), None),
        "row_before": (S.row_before(F.col("v")), lambda s, r: ((r[2],), s), None),
        "most": (S.most(F.col("v")), lambda s, r: (max(s or 0, r[2] or 0) or None,) * 2, None),
        "least": (S.least(F.col("v")), lambda s, r: (min(s or 9, r[2] or 9) % 9 or None,) * 2, None),
    }


@pytest.mark.parametrize("back", [False, True])
def test_scans(rows, back):
    got = S.scanned(rows, ["run_id"], ["seq"], {k: s for k, (s, _, _) in scans().items()}, back=back).collect()
    assert len(got) == len(ROWS)
    for name, (_, step, start) in scans().items():
        want = plain(step, start, back)
        value = (lambda x: None if x is None else (x["v"],)) if name == "row_before" else lambda x: x
        assert {r["seq"]: value(r[name]) for r in got} == want, name


def test_no_run_is_one_task(rows):
    """The hot run is dealt by its parts; nothing is partitioned by the run alone but the table of parts."""
    plan = S.scanned(rows, ["run_id"], ["seq"], {"n": S.ordinal()})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k" in plan
    parts = rows.where("run_id = 'hot'").select(F.floor(F.col("seq") / S.PART).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) <= S.PART


def test_ranged(spark, rows):
    texts = rows.withColumn("name", F.md5(F.col("seq").cast("string")))
    got = S.scanned(S.ranged(texts, ["run_id"], ["name"]), ["run_id"], ["name"], {"n": S.ordinal()}, F.col("part"))
    plain_n = F.row_number().over(Window.partitionBy("run_id").orderBy("name"))
    assert got.select("run_id", "name", "n").exceptAll(texts.select("run_id", "name", plain_n.cast("long").alias("n"))).isEmpty()
    assert got.count() == len(ROWS)


def test_prefix_sets(spark):
    """A row a point, however many values came before; written out on request."""
    values = spark.createDataFrame([("a" if k % 3 else "hot", k, f"f{k * 7 % 900}" if k % 5 else None) for k in range(6000)], "run_id string, seq long, file string")
    points = values.where("seq % 50 = 0").select("run_id", F.col("seq").alias("at"))
    sizes = E.prefix_sizes(points, values, "file", "n").collect()
    sets = {(r["run_id"], r["at"]): r["files"] for r in E.seen_before(points, values, "file", "files").collect()}
    order = {}
    for r in E.first_sights(values, "file").collect():
        order.setdefault(r["run_id"], {})[r["ordinal"]] = r["value"]
    every = values.collect()
    assert len(sizes) == len(sets) == points.count()
    for r in sizes:
        want = sorted({x["file"] for x in every if x["run_id"] == r["run_id"] and x["seq"] <= r["at"] and x["file"]})
        assert sets[r["run_id"], r["at"]] == want
        assert sorted(order[r["run_id"]][k + 1] for k in range(r["n"])) == want


def test_events_of_a_hot_run(spark):
    rows = spark.createDataFrame([("hot" if k % 3 == 0 else f"r{k % 7}", k, RNG.choice("xy")) for k in range(12_000)], "run_id string, seq long, key string")
    window = Window.partitionBy("run_id").orderBy("seq")
    change = (~F.col("key").eqNullSafe(F.lag("key").over(window))).cast("int")
    want = rows.withColumn("c", F.coalesce(change, F.lit(1))).withColumn("island", F.sum("c").over(window)).drop("c")
    assert E.islands(rows, "key").exceptAll(want).isEmpty()
    gate = spark.createDataFrame([("hot", f"i{k % 900}", k, "b", "allow") for k in range(3000)], "run_id string, tool_use_id string, line_no long, barrier string, decision string")
    uses = spark.createDataFrame([("hot", k, f"i{k}") for k in range(0, 900, 2)], "run_id string, seq long, tool_use_id string")
    late = E.gate_join(uses, gate).where("join_status = 'gate_only'").orderBy("seq").collect()
    assert [r["tool_use_id"] for r in late] == sorted(f"i{k}" for k in range(1, 900, 2)) and [r["seq"] for r in late] == list(range(899, 899 + 450))
