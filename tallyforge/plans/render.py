"""Results as text: fixed-width tables, Markdown, JSON, amounts.

What is streamed goes out row by row in the order of the rows, a partition at a time, so its length has no limit;
scorecards collect small tables and say so when one is longer than they show.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1000


def column_widths(header: Sequence[str], rows: Sequence[Sequence[str]]) -> list[int]:
    n = max([len(header), *(len(r) for r in rows)])
    at = lambda r, k: len(r[k]) if k < len(r) else 0
    return [max([at(header, k), *(at(r, k) for r in rows)]) for k in range(n)]


def _numeric(text: str) -> bool:
    return bool(text) and text.lstrip("-").replace(",", "").replace(".", "", 1).isdigit()


def table(header: Sequence[str], rows: Sequence[Sequence[str]], *, rule: bool = True) -> str:
    """Columns of numbers to the right, others to the left; short rows are filled up."""
    widths = column_widths(header, rows)
    right = [bool(rows) and all(_numeric(r[k]) for r in rows if k < len(r) and r[k]) for k in range(len(widths))]

    def line(r: Sequence[str]) -> str:
        cells = [(r[k] if k < len(r) else "") for k in range(len(widths))]
        return "  ".join(c.rjust(w) if g else c.ljust(w) for c, w, g in zip(cells, widths, right)).rstrip()

    return "\n".join([line(header), *(["  ".join("-" * w for w in widths)] if rule else []), *map(line, rows)])


def shown(value, digits: int = 3) -> str:
    return "" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def _cell(column) -> str:
    """SQL text of a value as :func:`shown` writes it, for measuring only."""
    name, kind = column.name, column.dataType.simpleString()
    quoted = f"`{name}`"
    return f"format_string('%.3f', {quoted})" if kind in ("double", "float") else f"cast({quoted} as string)"


def streamed_table(df: DataFrame, out: TextIO) -> None:
    """All rows as a fixed-width table: one pass measures the columns, one prints."""
    texts = [F.coalesce(F.expr(_cell(c)), F.lit("")) for c in df.schema]
    number = r"^-*[0-9,]*\.?[0-9,]+$|^-*[0-9,]+\.$"
    sizes = [F.max(F.length(t)).alias(f"w{k}") for k, t in enumerate(texts)]
    plain = [F.bool_and((t == "") | t.rlike(number)).alias(f"r{k}") for k, t in enumerate(texts)]
    found = df.agg(*sizes, *plain).first()
    widths = [max(len(name), found[f"w{k}"] or 0) for k, name in enumerate(df.columns)]
    right = [bool(found[f"r{k}"]) for k in range(len(widths))]

    def line(cells: Sequence[str]) -> str:
        return "  ".join(c.rjust(w) if g else c.ljust(w) for c, w, g in zip(cells, widths, right)).rstrip()

    print(line(df.columns), "  ".join("-" * w for w in widths), sep="\n", file=out)
    for r in df.toLocalIterator():
        print(line([shown(v) for v in r]), file=out)


def streamed_json(items: Iterable, out: TextIO, indent: int = 0) -> None:
    """A JSON array of the items, without a line's end; one item is held at a time."""
    pad, first = " " * indent, True
    out.write("[")
    for item in items:
        out.write(("\n" if first else ",\n") + "\n".join(f"{pad}  {x}" for x in json.dumps(item, indent=2).split("\n")))
        first = False
    out.write("]" if first else f"\n{pad}]")


def values(df: DataFrame) -> Iterator[list]:
    """Rows as JSON values, in their order."""
    for r in df.toLocalIterator():
        yield [v if isinstance(v, (int, float, type(None))) else str(v) for v in r]


def _first(df: DataFrame, most: int) -> tuple[list, str]:
    rows = df.limit(most + 1).collect()
    return rows[:most], f"The first {most} rows of more." if len(rows) > most else ""


def text_table(df: DataFrame, most: int = MOST) -> str:
    rows, more = _first(df, most)
    return "\n".join(x for x in (table(df.columns, [[shown(v) for v in r] for r in rows]), more) if x)


def markdown(df: DataFrame, most: int = MOST) -> str:
    rows, more = _first(df, most)
    lines = ["| " + " | ".join(shown(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *lines, *([f"\n{more}"] if more else [])])


def bullets(items: Sequence[str], mark: str = "-") -> str:
    return "\n".join(f"{mark} {x}" for x in items)


def truncated(text: str, width: int, ellipsis: str = "...") -> str:
    return text if len(text) <= width else text[: max(0, width - len(ellipsis))] + ellipsis[:width]


def scorecard(title: str, tables: dict[str, DataFrame], most: int = MOST) -> str:
    """A Markdown page of several tables."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df, most)}" for name, df in tables.items())]) + "\n"


#: How verdicts and criteria are marked.
VERDICTS = {"accepted": "ACCEPTED", "partial": "PARTIAL", "rejected": "REJECTED", "timeout": "TIMEOUT", "error": "ERROR"}
MET = {True: "met", False: "not met", None: "not evaluated"}


def grouped(value) -> str:
    return f"{value:,}" if isinstance(value, (int, float)) and not isinstance(value, bool) else "-"


#: What a version of accounting means to a reader.
ACCOUNTING = {"per_message_v2": "per message, each usage once", "per_line_v1": "per line, inflated: not to be compared with later runs"}


def run_report(record: dict, judge: dict | None = None, meta: dict | None = None, analysis: str | None = None) -> str:
    """A run's scorecard as Markdown: verdict, criteria, cost and timing, artifacts. What isn't known is a dash."""
    judge, meta = judge or {}, meta or {}
    tokens, timing, ops = (record.get(k) or {} for k in ("tokens", "timing", "operations"))
    score = judge.get("score")
    known = lambda d, k: "-" if d.get(k) is None else str(d[k])
    out = [f"# Run report: {meta.get('run_id') or (record.get('run') or {}).get('run_id') or '-'}", f"**Verdict:** {VERDICTS.get(judge.get('verdict'), judge.get('verdict') or '-')}, score {f'{score:.2f}' if isinstance(score, (int, float)) else '-'}, agent {meta.get('agent_id') or '-'}"]
    out.append(bullets([f"repository {meta.get('repo_url') or meta.get('repo_path') or '-'} at {(meta.get('base_repo_sha') or '-')[:10]}", f"started {known(meta, 'timestamp_start')}, ended {known(meta, 'timestamp_end')}"]))
    out.append("## Acceptance criteria")
    criteria = judge.get("criteria") or []
    rows = [[MET.get(c.get("met"), "not evaluated"), str(c.get("criterion") or "")[:80], str(c.get("source") or ""), str(c.get("evidence") or c.get("error") or "").replace("\n", " ")[:120]] for c in criteria]
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    out.append("\n".join([line(["", "criterion", "source", "evidence"]), "|---|---|---|---|", *map(line, rows)]) if rows else "No criteria were graded.")
    battery = judge.get("battery") or {}
    if rows and battery:
        out.append(f"Mechanical checks: {known(battery, 'passed')} of {known(battery, 'total')} passed" + (f", {battery['errored']} not evaluable" if battery.get("errored") else "") + ".")
    lost = sum(c.get("met") is None for c in criteria)
    if lost:
        out.append(f"{lost} of {len(criteria)} criteria could not be evaluated and are left out of the score.")
    version = tokens.get("accounting_version") or "per_line_v1"
    cost = [f"input {grouped(tokens.get('total_input'))}, output {grouped(tokens.get('total_output'))}, cache read {grouped(tokens.get('cache_read'))}", f"accounting {version}: {ACCOUNTING.get(version, 'unknown')}"]
    if tokens.get("cost_usd") is not None:
        cost.append(f"measured cost ${tokens['cost_usd']:.4f}")
    cost += [f"{side} drifts by {tokens[f'dedupe_delta_{side}']:+,} from the terminal result" for side in ("input", "output") if tokens.get(f"dedupe_delta_{side}")]
    cost.append(f"wall clock {known(timing, 'wall_clock_seconds')} s, first edit after {known(timing, 'time_to_first_edit_seconds')} s")
    own = ops.get("tool_calls_task")
    cost.append(f"tool calls {known(ops, 'tool_calls_total')}" + (f" ({own} of the task)" if own is not None and own != ops.get("tool_calls_total") else "") + f", turns {known(ops, 'turns_total')}, lines {known(ops, 'message_count')}")
    if ops.get("probes_sent") is not None:
        cost.append(f"probes {known(ops, 'probes_answered')} of {ops['probes_sent']} answered, resumes {known(ops, 'resumes_sent')}, denials {known(ops, 'permission_denials')}, most calls a message {known(ops, 'max_tool_uses_per_message')}")
    files = (record.get("navigation") or {}).get("files_edited") or []
    out += ["## Cost and timing", bullets([*cost, f"files edited: {', '.join(files) or '-'}"])]
    if meta.get("run_dir"):
        out += ["## Artifacts", bullets([f"diff {meta['run_dir']}/git.patch", f"transcript {meta['run_dir']}/transcript.jsonl"])]
    if analysis and analysis.strip():
        out += ["## Analysis by the agent", analysis.strip()]
    return "\n\n".join(out) + "\n"


def run_reports(runs: DataFrame) -> DataFrame:
    """(run_id, report) of runs (run_id, record, judge, meta: JSON or null, analysis): a report a row, made where the row lies.

    A document that lacks or can't be read is an empty one.
    """

    def read(text) -> dict:
        try:
            doc = json.loads(text) if isinstance(text, str) else {}
        except ValueError:
            doc = {}
        return doc if isinstance(doc, dict) else {}

    def told(batches):
        for pdf in batches:
            reports = [run_report(read(r.record), read(r.judge), {"run_id": r.run_id, **read(r.meta)}, r.analysis) for r in pdf.itertuples(index=False)]
            yield pdf[["run_id"]].assign(report=reports)

    return runs.select("run_id", "record", "judge", "meta", "analysis").mapInPandas(told, "run_id string, report string")
