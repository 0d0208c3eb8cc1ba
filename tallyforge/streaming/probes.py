"""Probes of running logs: windows, answers, retries and outcomes, as a stream with timers and as a batch.

Rows: run_id, seq, ts, kind (probe_in, tool_use, assistant, heartbeat), probe_id, answers (whether
an assistant text answers a probe), refusing, parse_ok.  A probe opens a window that the
answer, the next tool call or the next probe closes.  Sendings of one probe_id are one probe: the first answer of any counts.
A probe is told once, ``patience`` after it was first sent: answered or refused if an answer came by then,
superseded if another was sent after it, else unanswered.

The stream keeps a state a run: rows that the watermark hasn't passed yet, the open window, and probes
whose patience isn't over. Event-time timers tell probes and drop what isn't needed; a run without open
probes has no state. Rows that come again are taken once, late rows within the watermark in their place. In the
order of a run time goes first, then ``seq``; an id isn't used again after its patience. A heartbeat row belongs to no run
and lets time pass where no log does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.scan import count, ranged, scanned

OUT = "run_id string, probe_id string, sent_seq long, n_sent long, answer_seq long, outcome string"
_COLUMNS = ("run_id", "seq", "ts", "kind", "probe_id", "answers", "refusing", "parse_ok")


def outcome(answered: Column, refused: Column, later: Column) -> Column:
    return F.when(refused, "refused").when(answered, "answered").when(later, "superseded").otherwise("unanswered")


def lifecycles(rows: DataFrame, *, patience: int) -> DataFrame:
    """(run_id, probe_id, sent_seq, n_sent, answer_seq, outcome) of a whole log; ``patience`` in seconds."""
    rows = rows.select(*_COLUMNS).where("kind <> 'heartbeat'").dropDuplicates(["run_id", "seq"])
    placed = ranged(rows, ["run_id"], ["ts", "seq"], "_range")
    placed = scanned(placed, ["run_id"], ["ts", "seq"], {"turn": count(F.col("kind") == "probe_in")}, F.col("_range")).where("turn > 0")
    at = F.struct("ts", "seq")
    probe, tool = F.col("kind") == "probe_in", F.col("kind") == "tool_use"
    answer = (F.col("kind") == "assistant") & F.coalesce("answers", F.lit(False))
    turns = placed.groupBy("run_id", "turn").agg(
        F.min(F.when(probe, F.struct("ts", "seq", "probe_id"))).alias("sent"), F.min(F.when(tool, at)).alias("tool"), F.min(F.when(answer, F.struct("ts", "seq", "refusing", "parse_ok"))).alias("answer")
    )
    open_ = F.col("answer").isNotNull() & (F.col("tool").isNull() | (F.struct(F.col("answer.ts"), F.col("answer.seq")) < F.col("tool")))
    turns = turns.select("run_id", F.col("sent.probe_id").alias("probe_id"), "sent", F.when(open_, F.col("answer")).alias("answer"))
    firsts = turns.groupBy(F.col("run_id").alias("_run"), F.col("probe_id").alias("_probe")).agg(F.min(F.struct("sent.ts", "sent.seq")).alias("first"))
    until = F.timestamp_seconds(F.unix_micros("first.ts") / 1e6 + patience)
    own = turns.join(firsts, F.col("run_id").eqNullSafe(F.col("_run")) & F.col("probe_id").eqNullSafe(F.col("_probe"))).drop("_run", "_probe").withColumn("until", until)
    own = own.withColumn("answer", F.when(F.col("answer.ts") <= F.col("until"), F.col("answer")))
    by = own.where(F.col("sent.ts") <= F.col("until")).groupBy("run_id", "probe_id", "first", "until").agg(F.count("*").alias("n_sent"), F.min_by("answer", F.when(F.col("answer").isNotNull(), F.struct("sent.ts", "sent.seq"))).alias("answer"))
    # the next sending of another or the same probe after the first one
    follow = turns.select("run_id", F.struct("sent.ts", "sent.seq").alias("sent_at")).withColumn("next", F.lead("sent_at").over(Window.partitionBy("run_id").orderBy("sent_at")))
    follow = follow.select(F.col("run_id").alias("_run"), "sent_at", "next")
    rows = by.join(follow, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("first") == F.col("sent_at")))
    refused = F.coalesce(F.col("answer.refusing") & ~F.coalesce(F.col("answer.parse_ok"), F.lit(False)), F.lit(False))
    said = outcome(F.col("answer").isNotNull(), refused, F.coalesce(F.col("next.ts") <= F.col("until"), F.lit(False)))
    return rows.select("run_id", "probe_id", F.col("first.seq").alias("sent_seq"), "n_sent", F.col("answer.seq").alias("answer_seq"), said.alias("outcome"))


def _step(state: dict, row: list, patience: int) -> None:
    """One row in the order of its run."""
    ts, seq, kind, probe, answers, refusing, parse_ok = row
    if [ts, seq] <= state["last"]:
        return
    state["last"] = [ts, seq]
    if kind == "probe_in":
        for other in state["probes"]:
            other["later"] = other["later"] or ts <= other["first"] + patience
        own = next((p for p in state["probes"] if p["id"] == probe and ts <= p["first"] + patience), None)
        if own is None:
            own = {"id": probe, "first": ts, "seq": seq, "n": 0, "answer": None, "refused": False, "later": False}
            state["probes"].append(own)
        own["n"] += 1
        state["open"] = state["probes"].index(own)
    elif kind == "tool_use":
        state["open"] = None
    elif kind == "assistant" and answers and state["open"] is not None:
        own = state["probes"][state["open"]]
        if own["answer"] is None and ts <= own["first"] + patience:
            own["answer"], own["refused"] = seq, bool(refusing and not parse_ok)
        state["open"] = None


def _run(patience: int):
    micros = patience * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else {"rows": [], "last": [-1, -1], "open": None, "probes": []}
        if not group.hasTimedOut:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    if r.kind != "heartbeat":
                        flag = lambda x: None if pd.isna(x) else bool(x)
                        state["rows"].append([int(r.micros), int(r.seq), r.kind, r.probe_id, flag(r.answers), flag(r.refusing), flag(r.parse_ok)])
        passed = group.getCurrentWatermarkMs() * 1000
        state["rows"].sort(key=lambda r: r[:2])
        ready = [r for r in state["rows"] if r[0] <= passed]
        state["rows"] = state["rows"][len(ready) :]
        for row in ready:
            _step(state, row, micros)
        done = [k for k, p in enumerate(state["probes"]) if p["first"] + micros < passed]
        out = [state["probes"][k] for k in done]
        if state["open"] in done:
            state["open"] = None
        elif state["open"] is not None:
            state["open"] -= sum(k < state["open"] for k in done)
        state["probes"] = [p for k, p in enumerate(state["probes"]) if k not in set(done)]
        waits = [r[0] for r in state["rows"][:1]] + [p["first"] + micros for p in state["probes"]]
        if waits:
            group.update((json.dumps(state),))
            group.setTimeoutTimestamp(max(min(waits) // 1000 + 1, group.getCurrentWatermarkMs() + 1))
        elif group.exists:
            group.remove()
        if out:
            said = lambda p: "refused" if p["refused"] else "answered" if p["answer"] is not None else "superseded" if p["later"] else "unanswered"
            frame = pd.DataFrame([(key[0], p["id"], p["seq"], p["n"], p["answer"], said(p)) for p in out], columns=["run_id", "probe_id", "sent_seq", "n_sent", "answer_seq", "outcome"])
            yield frame.astype({"answer_seq": "Int64"})

    return run


def stream_lifecycles(rows: DataFrame, *, patience: int, late: str = "2 hours") -> DataFrame:
    """The same of a stream, each probe told once its patience is over; append mode."""
    rows = rows.select(*_COLUMNS).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return rows.groupBy("run_id").applyInPandasWithState(_run(patience), OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)
