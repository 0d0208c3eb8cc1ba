"""Six closed predicates over a run's diff, commands and files, and the lexers that feed them.

A predicate is eligible or not and fired or not; what isn't eligible can't fire.
Diffs and commands are read by state machines in Python, a batch of rows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import path_matches

_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def diff_files(text: str | None) -> list[dict]:
    """Files of a unified diff: path, status, old path, added (line number, text), removed lines, binary."""
    out: list[dict] = []
    now, line = None, 0
    for raw in (text or "").split("\n"):
        if raw.startswith("diff --git "):
            a, _, b = raw[11:].partition(" b/")
            now = {"path": b or a[2:], "status": "modified", "old_path": None, "added": [], "removed": [], "binary": False}
            out.append(now)
            line = 0
        elif now is None:
            continue
        elif line == 0 and raw.startswith("new file"):
            now["status"] = "added"
        elif line == 0 and raw.startswith("deleted file"):
            now["status"] = "deleted"
        elif line == 0 and raw.startswith("rename from "):
            now["status"], now["old_path"] = "renamed", raw[12:]
        elif line == 0 and raw.startswith("rename to "):
            now["path"] = raw[10:]
        elif raw.startswith("Binary files") or raw.startswith("GIT binary patch"):
            now["binary"] = True
        elif m := _HUNK.match(raw):
            line = int(m[1])
        elif line and raw.startswith("+"):
            now["added"].append({"line_no": line, "text": raw[1:]})
            line += 1
        elif line and raw.startswith("-"):
            now["removed"].append(raw[1:])
        elif line and raw.startswith(" "):
            line += 1
    return out


DIFF = "run_id string, path string, status string, old_path string, added array<struct<line_no:bigint,text:string>>, removed array<string>, binary boolean"


def changed_files(diffs: DataFrame) -> DataFrame:
    """One row a file of (run_id, diff)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"run_id": r, **f} for r, d in zip(pdf["run_id"], pdf["diff"]) for f in diff_files(d)]
            yield pd.DataFrame(rows, columns=["run_id", "path", "status", "old_path", "added", "removed", "binary"])

    return diffs.select("run_id", "diff").mapInPandas(run, DIFF)


def added_lines(files: DataFrame) -> DataFrame:
    return files.select("run_id", "path", F.explode("added").alias("a")).select("run_id", "path", "a.line_no", "a.text")


def shell_segments(command: str | None) -> list[str]:
    """Simple commands of a shell line: split at && || ; | & and newlines outside quotes and substitutions."""
    out, now, quote, depth, k = [], "", "", 0, 0
    text = command or ""
    while k < len(text):
        c = text[k]
        if c == "\\" and quote != "'":
            now, k = now + text[k : k + 2], k + 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif text.startswith("$(", k):
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif not depth and (text.startswith("&&", k) or text.startswith("||", k) or text.startswith(";;", k)):
            out, now, k = [*out, now], "", k + 2
            continue
        elif not depth and (c in ";|\n" or (c == "&" and text[k - 1 : k] not in "<>" and text[k + 1 : k + 2] != ">")):
            out, now, k = [*out, now], "", k + 1
            continue
        now, k = now + c, k + 1
    return [s.strip() for s in [*out, now] if s.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def segments(command: pd.Series) -> pd.Series:
    return command.map(shell_segments)


def strip_comments(text: str | None, suffix: str) -> str:
    """Comments blanked, so that line numbers and columns stay."""
    marks = ("#",) if suffix in ("py", "sh", "yaml", "yml", "toml") else ("//",) if suffix in ("js", "ts", "go", "rs", "c", "java") else ()
    out = []
    for line in (text or "").split("\n"):
        quote = ""
        for k, c in enumerate(line):
            if quote:
                quote = "" if c == quote and line[k - 1 : k] != "\\" else quote
            elif c in "'\"":
                quote = c
            elif any(line.startswith(m, k) for m in marks):
                line = line[:k] + " " * (len(line) - k)
                break
        out.append(line)
    return "\n".join(out)


def run_segments(commands: DataFrame) -> DataFrame:
    """(run_id, ordinal, segment): all simple commands of a run in order. Commands: run_id, seq, command."""
    rows = commands.select("run_id", "seq", F.posexplode(segments("command")).alias("k", "segment"))
    return rows.select("run_id", F.struct("seq", "k").alias("ordinal"), "segment")


@dataclass(frozen=True)
class Rule:
    """A predicate: flags and places by rows of files, lines or commands, their aggregates over a run, and the verdict.

    ``marks`` are columns of a row; a run's ``most`` are true if any row's is, its ``first`` are the least of all rows.
    """

    of: str
    most: dict[str, Column]
    first: dict[str, Column]
    eligible: Callable[[Callable[[str], Column]], Column]
    fired: Callable[[Callable[[str], Column]], Column]


def verdicts(runs: DataFrame, rules: list[tuple[str, Rule]], **tables: DataFrame) -> DataFrame:
    """(run_id, predicate, eligible, fired) of every run for every rule: one aggregate over the rows of all tables.

    Runs are rows of the same aggregate, so that nothing is joined and no side is sent to all executors.
    """
    marks = [(f"r{k}_{n}", rule.of, c, how) for k, (_, rule) in enumerate(rules) for how, columns in ((F.max, rule.most), (F.min, rule.first)) for n, c in columns.items()]
    parts = [runs.select("run_id", F.lit(1).cast("long").alias("runs"))]
    for of in dict.fromkeys(rule.of for _, rule in rules):
        parts.append(tables[of].where("run_id is not null").select("run_id", *(c.alias(n) for n, at, c, _ in marks if at == of)))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    by = rows.groupBy("run_id").agg(F.sum("runs").alias("runs"), *(how(n).alias(n) for n, _, _, how in marks)).where("runs > 0")
    told = []
    for k, (name, rule) in enumerate(rules):
        mark = lambda n, k=k: F.col(f"r{k}_{n}")
        ok = F.coalesce(rule.eligible(mark), F.lit(False))
        told.append(F.struct(F.lit(name).alias("predicate"), ok.alias("eligible"), (ok & F.coalesce(rule.fired(mark), F.lit(False))).alias("fired")))
    # a run that is there twice is told of twice
    each = by.select("run_id", "runs", F.explode(F.array(*told)).alias("v"))
    each = each.withColumn("v", F.explode(F.array_repeat("v", F.col("runs").cast("int"))))
    return each.select("run_id", "v.*")


def untouched(paths: list[str]) -> Rule:
    under = path_matches(F.col("path"), paths) | F.coalesce(path_matches(F.col("old_path"), paths), F.lit(False))
    return Rule("files", {"any": F.lit(True), "touched": under}, {}, lambda m: m("any"), lambda m: ~m("touched"))


def confined(paths: list[str]) -> Rule:
    return Rule("files", {"any": F.lit(True), "outside": ~path_matches(F.col("path"), paths)}, {}, lambda m: m("any"), lambda m: ~m("outside"))


def _content(pattern: str, paths: list[str] | None, present: bool, of: str) -> Rule:
    """Over lines, or over files with the lines that were added."""
    some, hit = (F.lit(True), F.col("text").rlike(pattern)) if of == "lines" else (F.size("added") > 0, F.exists("added", lambda a: a["text"].rlike(pattern)))
    where = path_matches(F.col("path"), paths) if paths else F.lit(True)
    return Rule(of, {"any": F.when(where, some), "hit": F.when(where, hit)}, {}, lambda m: m("any"), lambda m: m("hit") if present else ~m("hit"))


def present(pattern: str, paths: list[str] | None = None, of: str = "files") -> Rule:
    return _content(pattern, paths, True, of)


def absent(pattern: str, paths: list[str] | None = None, of: str = "files") -> Rule:
    return _content(pattern, paths, False, of)


def used(pattern: str) -> Rule:
    return Rule("segments", {"any": F.lit(True), "hit": F.col("segment").rlike(pattern)}, {}, lambda m: m("any"), lambda m: m("hit"))


def ordered(before: str, after: str) -> Rule:
    first = lambda p: F.when(F.col("segment").rlike(p), F.col("ordinal"))
    return Rule("segments", {}, {"b": first(before), "a": first(after)}, lambda m: m("a").isNotNull(), lambda m: m("b") < m("a"))


def path_untouched(runs: DataFrame, files: DataFrame, paths: list[str]) -> DataFrame:
    """Nothing under the paths changed; eligible if anything did at all."""
    return verdicts(runs, [("path_untouched", untouched(paths))], files=files)


def diff_confined(runs: DataFrame, files: DataFrame, paths: list[str]) -> DataFrame:
    """Every changed file is under the paths."""
    return verdicts(runs, [("diff_confined", confined(paths))], files=files)


def content_present(runs: DataFrame, lines: DataFrame, pattern: str, paths: list[str] | None = None) -> DataFrame:
    """A line (of a file or of those added: run_id, path, text) matches; eligible where such files have lines."""
    return verdicts(runs, [("content_present", present(pattern, paths, "lines"))], lines=lines)


def content_absent(runs: DataFrame, lines: DataFrame, pattern: str, paths: list[str] | None = None) -> DataFrame:
    return verdicts(runs, [("content_absent", absent(pattern, paths, "lines"))], lines=lines)


def command_used(runs: DataFrame, segs: DataFrame, pattern: str) -> DataFrame:
    return verdicts(runs, [("command_used", used(pattern))], segments=segs)


def command_order(runs: DataFrame, segs: DataFrame, before: str, after: str) -> DataFrame:
    """Some ``before`` precedes the first ``after``; eligible where an ``after`` ran."""
    return verdicts(runs, [("command_order", ordered(before, after))], segments=segs)


PREDICATES = {f.__name__: f for f in (path_untouched, diff_confined, content_present, content_absent, command_used, command_order)}


#: The parameters of each predicate: name, kind (globs, regex) and whether it must be given.
PARAMETERS = {
    "path_untouched": (("paths", "globs", True),),
    "diff_confined": (("paths", "globs", True),),
    "content_present": (("pattern", "regex", True), ("paths", "globs", False)),
    "content_absent": (("pattern", "regex", True), ("paths", "globs", False)),
    "command_used": (("pattern", "regex", True),),
    "command_order": (("before", "regex", True), ("after", "regex", True)),
}


def parameter_problems(name: str, given: dict) -> list[str]:
    """What is wrong with the parameters of a predicate; nothing, if it can run."""
    if name not in PARAMETERS:
        return [f"no predicate {name}"]
    known = {p: kind for p, kind, _ in PARAMETERS[name]}
    out = [f"{p}: unknown" for p in sorted(set(given) - set(known))] + [f"{p}: missing" for p, _, need in PARAMETERS[name] if need and p not in given]
    for p, value in given.items():
        kind = known.get(p)
        if kind == "globs" and (not isinstance(value, (list, tuple)) or not value or not all(isinstance(x, str) and x for x in value)):
            out.append(f"{p}: not a list of texts")
        elif kind == "regex":
            try:
                re.compile(value) if isinstance(value, str) and value else out.append(f"{p}: not a text")
            except re.error:
                out.append(f"{p}: not a pattern")
    return out


def manifest(spark: SparkSession) -> DataFrame:
    """(predicate, parameters, sha256) of the registry, so that a changed one shows."""
    rows = [(n, ",".join(f"{p}:{kind}{'' if need else '?'}" for p, kind, need in PARAMETERS[n])) for n in sorted(PREDICATES)]
    return spark.createDataFrame(rows, "predicate string, parameters string").withColumn("sha256", F.sha2(F.concat_ws("|", "predicate", "parameters"), 256))


def run_commands(gate: DataFrame, stream: DataFrame) -> DataFrame:
    """A run's commands from its gate log, else from its stream; each call once, in order."""
    once = lambda df: df.groupBy("run_id", "tool_use_id").agg(F.min_by(F.struct("seq", "command"), "seq").alias("v")).select("run_id", "tool_use_id", "v.*")
    have = gate.select(F.col("run_id").alias("_run")).distinct()
    return once(gate).unionByName(once(stream.join(have, F.col("run_id") == F.col("_run"), "left_anti")))
