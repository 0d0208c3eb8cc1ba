"""Transcripts of four dialects as normalised events.

A log is read in splits, and line numbers are its own; lines that are
no JSON object are passed over.  Fields come out of each line by path, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.scan import count, ordinal, row_before, scanned
from tallyforge.sources.lines import numbered_lines, present

INPUT = "map<string,string>"
TOOLS = f"array<struct<name:string,input:{INPUT},tool_use_id:string>>"


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """(run_id: the file, line_no from 1, line) of lines that hold a JSON object; a file that lacks is looked for with .gz, or without."""
    have = [p for p in (present(spark, path) for path in paths) if p]
    if not have:
        return spark.createDataFrame([], "run_id string, line_no long, line string")
    return json_objects(numbered_lines(spark, *have).select(F.col("path").alias("run_id"), "line_no", F.trim("line").alias("line")))


def json_objects(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull())


def at(path: str, line: Column | str = "line") -> Column:
    return F.get_json_object(line, path)


def count_at(path: str, line: Column | str = "line") -> Column:
    return F.coalesce(at(path, line).try_cast("bigint"), F.lit(0).cast("bigint"))


def _event(rows: DataFrame, **columns: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    given = {"ts": F.lit(""), "role": F.lit("assistant"), "message_id": F.lit(""), "tokens_in": zero, "tokens_out": zero, "cache_read": zero, "cache_write": zero, "tools": F.array().cast(TOOLS), "text": F.lit("")} | columns
    return rows.select("run_id", "line_no", F.col("sub") if "sub" in rows.columns else F.lit(0).alias("sub"), *(c.alias(n) for n, c in given.items()))


def _numbered(events: DataFrame) -> DataFrame:
    return scanned(events, ["run_id"], ["line_no", "sub"], {"seq": ordinal()}).withColumn("seq", F.col("seq") - 1).drop("sub")


def _tool(name: Column, id_: Column, **fields: Column) -> Column:
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(name.alias("name"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("input"), id_.alias("tool_use_id"))


# blocks of a message: a list of objects, each kept as text
BLOCKS = "array<string>"


def _blocks(path: str) -> Column:
    raw = at(path)
    return F.when(raw.startswith("["), F.from_json(raw, BLOCKS)).otherwise(F.array().cast(BLOCKS))


def messages(lines: DataFrame, *, include_aux: bool = False) -> DataFrame:
    """Events of message logs: user and assistant lines, usage on the first line of each message.

    The input of a turn is all of its prompt: what was sent, read from and written to the cache.
    """
    kind = at("$.type")
    wanted = ["user", "assistant", *(["attachment", "queued_command", "system"] if include_aux else [])]
    rows = lines.where(kind.isin(*wanted))
    role = F.coalesce(at("$.message.role"), F.when(kind.isin("attachment", "queued_command"), "probe_in").otherwise(kind))
    use = F.filter(_blocks("$.message.content"), lambda b: F.get_json_object(b, "$.type") == "tool_use")
    uses = F.transform(use, lambda b: F.struct(F.coalesce(F.get_json_object(b, "$.name"), F.lit("")).alias("name"), F.from_json(F.coalesce(F.get_json_object(b, "$.input"), F.lit("{}")), INPUT).alias("input"), F.coalesce(F.get_json_object(b, "$.id"), F.lit("")).alias("tool_use_id")))
    mid = F.coalesce(at("$.message.id"), F.lit(""))
    again = (mid != "") & (F.row_number().over(Window.partitionBy("run_id", mid, F.when(mid == "", F.col("line_no"))).orderBy("line_no")) > 1)
    once = lambda c: F.when(again, 0).otherwise(c).cast("bigint")
    u = lambda name: count_at(f"$.message.usage.{name}")
    read, wrote = u("cache_read_input_tokens"), u("cache_creation_input_tokens")
    said = F.array_join(F.transform(F.filter(_blocks("$.message.content"), lambda b: F.get_json_object(b, "$.type") == "text"), lambda b: F.get_json_object(b, "$.text")), "\n")
    said = F.when(at("$.message.content").startswith("["), said).otherwise(F.coalesce(at("$.message.content"), F.lit("")))
    out = _event(rows, ts=F.coalesce(at("$.timestamp"), F.lit("")), role=role, message_id=mid, tokens_in=once(u("input_tokens") + read + wrote), tokens_out=once(u("output_tokens")), cache_read=once(read), cache_write=once(wrote), tools=uses, text=said)
    return _numbered(out)


def tool_results(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, tool_use_id, is_error, text, truncated): what tools answered, with the one truncation sign."""
    rows = lines.where(at("$.type") == "user").select("run_id", "line_no", F.explode(F.filter(_blocks("$.message.content"), lambda b: F.get_json_object(b, "$.type") == "tool_result")).alias("b"), F.coalesce(at("$.toolUseResult.file.numLines"), at("$.tool_use_result.file.num_lines")).try_cast("bigint").alias("num"), F.coalesce(at("$.toolUseResult.file.totalLines"), at("$.tool_use_result.file.total_lines")).try_cast("bigint").alias("total"))
    body = F.get_json_object("b", "$.content")
    text = F.when(body.startswith("["), F.array_join(F.transform(F.from_json(body, BLOCKS), lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))), "\n")).otherwise(F.coalesce(body, F.lit("")))
    return rows.select("run_id", "line_no", F.get_json_object("b", "$.tool_use_id").alias("tool_use_id"), F.coalesce(F.get_json_object("b", "$.is_error") == "true", F.lit(False)).alias("is_error"), text.alias("text"), F.coalesce(F.col("num") < F.col("total"), F.lit(False)).alias("truncated"))


def terminal_result(lines: DataFrame) -> DataFrame:
    """A run's totals by its last result line."""
    rows = lines.where(at("$.type") == "result")
    u = lambda n: count_at(f"$.usage.{n}")
    read, wrote = u("cache_read_input_tokens"), u("cache_creation_input_tokens")
    denied = at("$.permission_denials")
    v = F.struct((u("input_tokens") + read + wrote).alias("total_input"), u("output_tokens").alias("total_output"), read.alias("cache_read"), wrote.alias("cache_write"), at("$.total_cost_usd").try_cast("double").alias("cost_usd"), at("$.num_turns").try_cast("bigint").alias("num_turns"), F.when(denied.startswith("["), F.json_array_length(denied)).cast("bigint").alias("permission_denials"), F.coalesce(at("$.is_error") == "true", F.lit(False)).alias("is_error"))
    return rows.groupBy("run_id").agg(F.max_by(v, "line_no").alias("v")).select("run_id", "v.*")


#: Shell words by class.
NAV_WORDS = ("cat", "head", "tail", "sed", "less", "more", "ls", "nl", "wc", "awk")
SEARCH_WORDS = ("grep", "rg", "ag", "find", "fd")
WRITE_WORDS = ("tee", "touch", "mv", "cp", "rm", "mkdir", "patch", "apply_patch")


def unwrapped(command: Column) -> Column:
    """The command inside ``bash -lc '...'``."""
    inner = F.regexp_extract(F.trim(command), r"""(?s)^(?:/bin/bash|bash)\s+-\w*c\s+(['"])(.+)\1$""", 2)
    return F.when(inner != "", inner).otherwise(F.trim(command))


def command_class(command: Column) -> Column:
    inner = unwrapped(F.coalesce(command, F.lit("")))
    word = F.element_at(F.split(F.split_part(inner, F.lit(" "), F.lit(1)), "/"), -1)
    writes = inner.rlike(r"(^|[^<>0-9&])>{1,2}\s*[^&\s]") | inner.rlike(r"\bsed\s+-i\b") | inner.rlike(r"<<\s*['\"]?\w+['\"]?")
    return F.when(inner == "", "exec").when(writes, "edit").when(word == "git", "git_op").when(word.isin(*SEARCH_WORDS), "search").when(word.isin(*NAV_WORDS), "nav").when(word.isin(*WRITE_WORDS), "edit").otherwise("exec")


def command_files(command: Column) -> Column:
    """Up to five words of a reading command that look like paths."""
    words = F.filter(F.split(unwrapped(command), r"\s+"), lambda w, k: (k > 0) & ~w.startswith("-") & ~w.startswith("'") & ~w.startswith("$") & (w.contains("/") | w.contains(".")))
    return F.when(command_class(command).isin("nav", "search"), F.slice(words, 1, 5)).otherwise(F.array().cast("array<string>"))


def _shell(command: Column, id_: Column) -> Column:
    return _tool(F.lit("Bash"), id_, command=command, cmd_class=command_class(command), read_file=F.get(command_files(command), F.lit(0)))


def items(lines: DataFrame) -> DataFrame:
    """Events of item logs: completed commands, messages, changed files; tokens as an event of their own a turn."""
    kind, item, id_ = at("$.type"), at("$.item.type"), F.coalesce(at("$.item.id"), F.lit(""))
    start = _event(lines.where(kind == "thread.started"), role=F.lit("user"), text=F.lit("__session_start__"))
    command = at("$.item.command")
    run = _event(lines.where((kind == "item.completed") & (item == "command_execution")), tools=F.array(_shell(F.coalesce(command, F.lit("")), id_)).cast(TOOLS))
    said = _event(lines.where((kind == "item.completed") & (item == "agent_message")), text=F.coalesce(at("$.item.text"), F.lit("")))
    changes = lines.where((kind == "item.completed") & (item == "file_change")).select("run_id", "line_no", "line", F.posexplode(F.from_json(at("$.item.changes"), BLOCKS)).alias("sub", "c")).where(F.coalesce(F.get_json_object("c", "$.path"), F.lit("")) != "")
    changed = _event(changes, tools=F.array(_tool(F.lit("Edit"), id_, file_path=F.get_json_object("c", "$.path"), cmd_class=F.lit("edit"))).cast(TOOLS))
    usage = _event(lines.where(kind == "turn.completed"), tokens_in=count_at("$.usage.input_tokens"), tokens_out=count_at("$.usage.output_tokens"), cache_read=count_at("$.usage.cached_input_tokens"), text=F.lit("__usage__"))
    out = start.unionByName(run).unionByName(said).unionByName(changed).unionByName(usage)
    # a turn's tokens need an event before them to belong to
    out = scanned(out, ["run_id"], ["line_no", "sub"], {"ahead": count(F.col("text") != "__usage__")})
    return _numbered(out.where("text <> '__usage__' or ahead > 0").drop("ahead"))


def upserted(lines: DataFrame) -> DataFrame:
    """Messages of an event-sourced log: each key's last value, in the order of first appearance."""
    bare = lines.where(at("$.type").isin("user", "gemini") & (F.coalesce(at("$.id"), F.lit("")) != "")).select("run_id", "line_no", F.lit(0).alias("sub"), F.col("line").alias("m"))
    snaps = lines.where(at("$['$set'].messages").isNotNull()).select("run_id", "line_no", F.posexplode(F.from_json(at("$['$set'].messages"), BLOCKS)).alias("sub", "m"))
    every = bare.unionByName(snaps).withColumn("id", F.get_json_object("m", "$.id")).where("id is not null")
    keys = every.select("run_id", "line_no", "sub", "id", F.explode(F.json_object_keys("m")).alias("key"), "m")
    values = keys.withColumn("value", F.to_json(F.variant_get(F.try_parse_json("m"), F.lit("$"), "map<string,variant>")[F.col("key")]))
    last = values.groupBy("run_id", "id", "key").agg(F.max_by("value", F.struct("line_no", "sub")).alias("value"), F.min(F.struct("line_no", "sub")).alias("first"))
    merged = last.groupBy("run_id", "id").agg(F.min("first").alias("first"), F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("v"))
    return merged.select("run_id", "id", F.col("first.line_no").alias("line_no"), F.col("first.sub").alias("sub"), "v")


def _gemini_tool(c: Column) -> Column:
    name, id_ = F.coalesce(F.get_json_object(c, "$.name"), F.lit("")), F.coalesce(F.get_json_object(c, "$.id"), F.lit(""))
    arg = lambda k: F.get_json_object(c, f"$.args.{k}")
    file = lambda tool: F.array(_tool(F.lit(tool), id_, file_path=F.coalesce(arg("file_path"), F.lit("")), cmd_class=F.lit(None)))
    other = lambda cls: F.array(_tool(F.lit("Bash"), id_, command=name, cmd_class=F.lit(cls)))
    many = F.transform(F.from_json(F.coalesce(arg("paths"), arg("files"), F.lit("[]")), BLOCKS), lambda p: _tool(F.lit("Read"), id_, file_path=p, cmd_class=F.lit(None)))
    typed = lambda x: x.cast(TOOLS)
    return F.when(name == "read_file", typed(file("Read"))).when(name == "read_many_files", typed(many)).when(name == "write_file", typed(file("Write"))).when(name.isin("replace", "edit"), typed(file("Edit"))).when(name == "run_shell_command", typed(F.array(_shell(F.coalesce(arg("command"), F.lit("")), id_)))).when(name == "search_file_content", typed(F.array(_tool(F.lit("Bash"), id_, command=F.concat(F.lit("grep "), F.coalesce(arg("pattern"), F.lit(""))), cmd_class=F.lit("search"))))).when(name.isin("glob", "list_directory"), typed(other("search"))).when(name == "google_web_search", typed(F.array(_tool(F.lit("WebSearch"), id_, query=arg("query"))))).when(name == "web_fetch", typed(F.array(_tool(F.lit("WebFetch"), id_, url=arg("url"))))).when(name == "save_memory", typed(other("exec"))).otherwise(typed(other("meta")))


def cumulative(lines: DataFrame) -> DataFrame:
    """Events of logs whose prompt counters grow over a run: each turn's part is the difference, never below zero."""
    v = F.col("v")
    plain = lambda k: F.get_json_object(F.concat(F.lit('{"x":'), v[k], F.lit("}")), "$.x")
    m = upserted(lines).withColumn("kind", plain("type"))
    m = m.withColumn("cached", F.coalesce(F.get_json_object(v["tokens"], "$.cached").try_cast("bigint"), F.lit(0))).withColumn("prompt", F.coalesce(F.get_json_object(v["tokens"], "$.input").try_cast("bigint"), F.lit(0)) + F.col("cached"))
    m = scanned(m, ["run_id", "kind"], ["line_no", "sub"], {"last": row_before(F.struct("prompt", "cached"))})
    step = lambda c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.col("last.v")[c], F.lit(0))).cast("bigint")
    m = m.withColumn("d_prompt", step("prompt")).withColumn("d_cached", step("cached")).drop("last")
    calls = F.flatten(F.transform(F.coalesce(F.from_json(v["toolCalls"], BLOCKS), F.array().cast(BLOCKS)), _gemini_tool))
    user = _event(m.where("kind = 'user'"), ts=F.coalesce(plain("timestamp"), F.lit("")), role=F.lit("user"))
    said = _event(m.where("kind = 'gemini'"), ts=F.coalesce(plain("timestamp"), F.lit("")), tokens_in=F.col("d_prompt"), tokens_out=F.coalesce(F.get_json_object(v["tokens"], "$.output").try_cast("bigint"), F.lit(0)), cache_read=F.col("d_cached"), tools=calls, text=F.coalesce(plain("content"), F.lit("")))
    return _numbered(user.unionByName(said))


def _step_tool(c: Column) -> Column:
    name, none = F.coalesce(F.get_json_object(c, "$.name"), F.lit("")), F.lit("")
    arg = lambda k: F.get_json_object(c, f"$.args.{k}")
    file = lambda tool, path: _tool(F.lit(tool), none, file_path=F.coalesce(path, F.lit("")), command=F.lit(None), cmd_class=F.lit(None), read_file=F.lit(None))
    one = lambda x: F.array(x).cast(TOOLS)
    return F.when(name.isin("view_file", "view_code_item"), one(file("Read", arg("AbsolutePath")))).when(name == "list_dir", one(file("Read", arg("DirectoryPath")))).when(name.isin("write_to_file", "create_file", "notebook_edit"), one(file("Write", arg("TargetFile")))).when(name.isin("replace_file_content", "multi_replace_file_content"), one(file("Edit", arg("TargetFile")))).when(name == "run_command", one(_shell(F.coalesce(arg("CommandLine"), F.lit("")), none))).when(name.isin("grep_search", "codebase_search", "find_by_name"), one(_tool(F.lit("Bash"), none, command=F.concat(F.lit("grep "), F.coalesce(arg("Query"), arg("Pattern"), F.lit(""))), cmd_class=F.lit("search"), read_file=F.coalesce(arg("SearchPath"), arg("SearchDirectory"))))).when(name.isin("search_web", "google_web_search"), one(_tool(F.lit("WebSearch"), none, query=arg("Query")))).when(name.isin("read_url_content", "open_browser_url", "read_browser_page") | name.startswith("Browser"), one(_tool(F.lit("WebFetch"), none, url=arg("Url")))).when(name.isin("invoke_subagent", "define_subagent", "manage_subagents"), one(_tool(F.lit("Agent"), none, description=F.coalesce(arg("Role"), F.lit("subagent"))))).when(name.isin("KnowledgeWriteToFile", "KnowledgeReplaceFileContent", "DeleteKnowledge"), one(file("Edit", F.concat(F.lit("memory/"), F.coalesce(arg("Path"), F.lit("knowledge")))))).otherwise(one(_tool(F.lit("Bash"), none, command=name, cmd_class=F.lit("meta"))))


def steps(lines: DataFrame) -> DataFrame:
    """Events of step streams: what users typed and what the planner called."""
    kind, ts = at("$.type"), F.coalesce(at("$.created_at"), F.lit(""))
    user = _event(lines.where(kind == "USER_INPUT"), ts=ts, role=F.lit("user"), text=F.coalesce(at("$.content"), F.lit("")))
    calls = F.flatten(F.transform(F.coalesce(F.from_json(at("$.tool_calls"), BLOCKS), F.array().cast(BLOCKS)), _step_tool))
    said = _event(lines.where(kind == "PLANNER_RESPONSE"), ts=ts, tools=calls, text=F.coalesce(at("$.content"), F.lit("")))
    return _numbered(user.unionByName(said))


def blob_tokens(spark: SparkSession, *paths: str) -> DataFrame:
    """Token totals of SQLite logs of protobuf messages, a row a file: sums of input and output, the largest prompt.

    Files come through Spark's own reader, from any store, and are opened in memory by the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *blob_totals(content)) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if not k else pa.int64()) for k, c in enumerate(zip(*rows))], names=["path", "total_input", "total_output", "peak_input", "calls"])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(run, "path string, total_input long, total_output long, peak_input long, calls long")


def blob_totals(content: bytes) -> tuple[int | None, int | None, int | None, int]:
    """Sums of input and output, the largest input and the number of calls of one log; nothing where it can't be read."""
    import sqlite3

    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        blobs = [bytes(b) for (b,) in db.execute("select data from gen_metadata order by idx") if b]
    except sqlite3.Error:
        return None, None, None, 0
    finally:
        db.close()
    found = [t for t in map(token_fields, blobs) if t]
    if not found:
        return None, None, None, 0
    ins, outs = zip(*found)
    return sum(ins), sum(outs), max(ins), len(found)


def wire_fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message: integers of varints, bytes of lengths."""
    out, at_, n = [], 0, len(data)

    def varint() -> int:
        nonlocal at_
        value = shift = 0
        while True:
            byte = data[at_]
            at_ += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    try:
        while at_ < n:
            tag = varint()
            kind = tag & 7
            if kind == 0:
                out.append((tag >> 3, varint()))
            elif kind == 2:
                size = varint()
                out.append((tag >> 3, data[at_ : at_ + size]))
                at_ += size
            elif kind in (1, 5):
                at_ += 8 if kind == 1 else 4
            else:
                break
    except IndexError:
        pass
    return out


def token_fields(data: bytes, depth: int = 4) -> tuple[int, int] | None:
    """Input and output counts: the first nested message with small integers in fields 2 and 3."""
    fields = dict(wire_fields(bytes(data)))
    if isinstance(fields.get(2), int) and isinstance(fields.get(3), int):
        return fields[2], fields[3]
    if depth:
        for value in fields.values():
            if isinstance(value, bytes) and value and (found := token_fields(value, depth - 1)):
                return found
    return None
