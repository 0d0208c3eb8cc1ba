"""The stream of probes against the batch: order, late and repeated rows, retries, timers, empty state."""

import random
from datetime import datetime, timedelta

import pytest

from tallyforge.streaming import probes as P
from tallyforge.streaming import rates as ST

SCHEMA = "run_id string, seq long, ts timestamp, kind string, probe_id string, answers boolean, refusing boolean, parse_ok boolean"
START = datetime(2024, 1, 1)


def log():
    rng, rows = random.Random(6), []
    for run in ("hot", "r1", "r2", None):
        probe, at = 0, 0
        for seq in range(600 if run == "hot" else 60):
            at += rng.randint(1, 900)
            kind = rng.choices(["probe_in", "tool_use", "assistant"], [2, 2, 5])[0]
            if kind == "probe_in" and rng.random() < 0.7:
                probe += 1
            rows.append((run, seq, START + timedelta(seconds=at), kind, f"p{probe}" if kind == "probe_in" else None, rng.random() < 0.5, rng.random() < 0.4, rng.choice([True, False, None])))
    return rows


def run_stream(spark, batches, tmp_path, **options):
    """What a stream tells of files that come one after the other, and its last progress."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"k={k}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = P.stream_lifecycles(source, **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(map(tuple, spark.read.schema(P.OUT).parquet(str(out)).collect()), key=str), states


@pytest.mark.parametrize("patience", [1800, 100_000])
def test_stream_equals_batch(spark, tmp_path, patience):
    rows, rng = log(), random.Random(7)
    order = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 1500)))  # late by less than the watermark
    order = [r for row in order for r in ([row, row] if rng.random() < 0.1 else [row])]
    size = len(order) // 4
    end = max(r[2] for r in rows) + timedelta(days=9)
    beats = [[("~", k, end + timedelta(days=k), "heartbeat", None, None, None, None)] for k in range(2)]
    got, states = run_stream(spark, [order[:size], order[size : 2 * size], order[2 * size : 3 * size], order[3 * size :], *beats], tmp_path, patience=patience, late="30 minutes")
    # an id that is sent again after its patience is another probe to a stream: ids of the log come in a row
    spans = {}
    for r in rows:
        if r[4]:
            spans.setdefault((r[0], r[4]), []).append(r[2])
    once = {k for k, v in spans.items() if (max(v) - min(v)).total_seconds() <= patience}
    want = sorted((tuple(r) for r in P.lifecycles(spark.createDataFrame(order, SCHEMA), patience=patience).collect()), key=str)
    keep = lambda found: [r for r in found if (r[0], r[1]) in once]
    assert keep(got) == keep(want) and len(keep(got)) > 100 and {r[5] for r in got} == {"answered", "refused", "superseded", "unanswered"} - ({"unanswered"} if patience > 1800 and "unanswered" not in {r[5] for r in want} else set())
    assert max(r[3] for r in got) > 1 and states[-1] == 0 and max(states) > 0


def test_a_lost_answer(spark, tmp_path):
    """A timer closes a probe without an answer; what comes after its patience doesn't count."""
    at = lambda s: START + timedelta(seconds=s)
    first = [("r", 0, at(0), "probe_in", "a", None, None, None), ("s", 0, at(0), "probe_in", "b", None, None, None), ("s", 1, at(5), "assistant", None, True, True, False)]
    later = [("r", 1, at(9000), "assistant", None, True, False, True), ("~", 0, at(90_000), "heartbeat", None, None, None, None)]
    beat = [("~", 1, at(900_000), "heartbeat", None, None, None, None)]
    got, states = run_stream(spark, [first, later, beat], tmp_path, patience=3600, late="10 minutes")
    assert got == [("r", "a", 0, 1, None, "unanswered"), ("s", "b", 0, 1, 1, "refused")] and states[-1] == 0
    assert sorted(map(tuple, P.lifecycles(spark.createDataFrame(first + later, SCHEMA), patience=3600).collect())) == got


def test_drained(spark, tmp_path):
    rows = spark.createDataFrame(log(), SCHEMA)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.stream_of(spark, str(tmp_path / "in"), rows.schema)
    told = {tuple(r) for r in ST.drained(P.stream_lifecycles(stream, patience=60), mode="append").collect()}
    assert 100 < len(told)
    assert P.lifecycles(rows.where("false"), patience=60).collect() == []


def test_late_edits(spark, tmp_path):
    """An edit that comes in a later batch than rows after it is the first one all the same; idle runs leave no state."""
    schema = "run_id string, seq long, ts timestamp, is_edit boolean, tokens_in long"
    row = lambda run, seq, edit, day=0: (run, seq, START + timedelta(days=day, seconds=seq), edit, 1)
    batches = [[row("a", 5, False), row("a", 9, True), row("a", 7, False), row("b", 1, False)], [row("a", 6, True), row("a", 2, False), row("b", 3, False)], [row("c", 1, True, 40)], [row("c", 2, True, 80)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in ST.drained(ST.running_phases(read().drop("ts")), mode="update", keys=("run_id",)).collect()}
    assert got == {("a", 6, 9, 5, 2, 5), ("b", -1, -1, 2, 2, 2), ("c", 1, 2, 2, 0, 2)}
    query = ST.running_phases(read(), idle=86_400, late="1 hour").writeStream.foreachBatch(lambda df, k: df.count()).option("checkpointLocation", str(tmp_path / "check")).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1
