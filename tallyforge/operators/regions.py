"""Raw records to regions of text, each on a channel that says who put it in front of whom.

All in expressions: a record's blocks become an array of regions and are exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions import tools as T
from tallyforge.operators.scan import last_known, ordinal, scanned
from tallyforge.sources.transcripts import BLOCKS, at

#: Characters of a shell answer that stay attributed, and the marks in texts.
SHELL_CAP = 30_000
REMINDER = r"(?is)<system-reminder>.*?</system-reminder>"
PERSISTED = r"(?is)<persisted-output\b[^>]*>.*?</persisted-output>"
READ_CEILING = r"(?i)File content \([^)]*\) exceeds maximum allowed size \([^)]*\)"
#: Fixed value: what a run is told where it stopped before its end.
RESUME = "Continue the task from where you left off. Do not wait for further instructions: take the next action yourself, one tool call per message, until the task is complete."
REGION = "array<struct<channel:string,text:string,tool:string,tool_use_id:string,is_error:boolean,muted:boolean>>"


def record_kind(line: Column | str = "line") -> Column:
    """system_init, hook, assistant, user, result, attachment or other."""
    kind, sub = at("$.type", line), F.coalesce(at("$.subtype", line), F.lit(""))
    return F.when((kind == "system") & (sub == "init"), "system_init").when((kind == "system") & sub.startswith("hook"), "hook").when(kind.isin("assistant", "user", "result", "attachment"), kind).otherwise("other")


def _blocks(path: str) -> Column:
    raw = at(path)
    plain = F.when(raw.isNotNull(), F.array(F.to_json(F.struct(F.lit("text").alias("type"), raw.alias("text")))))
    return F.when(raw.startswith("["), F.from_json(raw, BLOCKS)).otherwise(F.coalesce(plain, F.array().cast(BLOCKS)))


def result_text(body: Column) -> Column:
    """The text of a tool's answer: a text, an object's text, or the texts of blocks in a row; what has no text is its JSON, images are nothing."""
    text = lambda x: F.get_json_object(x, "$.text")
    block = lambda x: F.when(~x.startswith("{"), x).when(text(x).isNotNull(), text(x)).when(F.coalesce(F.get_json_object(x, "$.type"), F.lit("text")) == "text", x).otherwise("")
    parts = F.transform(F.from_json(body, BLOCKS), block)
    return F.when(body.startswith("["), F.array_join(parts, "")).when(body.startswith("{"), F.coalesce(text(body), body)).otherwise(F.coalesce(body, F.lit("")))


def _region(channel, text: Column, tool: Column | None = None, id_: Column | None = None, error: Column | None = None, muted: Column | None = None) -> Column:
    none, no = F.lit(None).cast("string"), F.lit(False)
    return F.struct((F.lit(channel) if isinstance(channel, str) else channel).alias("channel"), text.alias("text"), (none if tool is None else tool).alias("tool"), (none if id_ is None else id_).alias("tool_use_id"), (no if error is None else error).alias("is_error"), (no if muted is None else muted).alias("muted"))


def interleaved(outside: Column, inside: Column, of_out, of_in) -> Column:
    """What ``of_out`` and ``of_in`` make of the parts outside and inside of marks, in the order of the text."""
    return F.flatten(F.transform(outside, lambda part, k: F.concat(of_out(part, k), F.when(k < F.size(inside), of_in(F.get(inside, k))).otherwise(F.array().cast(REGION)))))


def text_regions(text: Column, channel: Column) -> Column:
    """A text with its reminders apart; parts of white space alone go."""
    inside, outside = F.regexp_extract_all(text, F.lit(REMINDER), F.lit(0)), F.split(text, REMINDER)
    cut = interleaved(outside, inside, lambda p, k: F.when(F.trim(p) != "", F.array(_region(channel, p)).cast(REGION)).otherwise(F.array().cast(REGION)), lambda m: F.array(_region("system_reminder", m)).cast(REGION))
    return F.when(F.size(inside) > 0, cut).otherwise(F.array(_region(channel, text)).cast(REGION))


def shell_regions(body: Column, tool: Column, id_: Column, cap: int = SHELL_CAP) -> Column:
    """A shell's answer: attributed up to the cap, beyond it and inside persisted previews not."""
    inside, outside = F.regexp_extract_all(body, F.lit(PERSISTED), F.lit(0)), F.split(body, PERSISTED)

    def part(p: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(outside, 1, k), F.lit(0), lambda a, x: a + F.length(x))
        room = F.greatest(F.lit(cap) - before, F.lit(0))
        head, tail = F.substr(p, F.lit(1), room), F.substr(p, room + 1)
        both = F.array(_region("bash_stdout", head, tool, id_), _region("bash_unattributed", tail, tool, id_)).cast(REGION)
        return F.filter(both, lambda r: r["text"] != "")

    cut = interleaved(outside, inside, part, lambda m: F.array(_region("bash_unattributed", m, tool, id_)).cast(REGION))
    return F.when(body == "", F.array(_region("bash_stdout", body, tool, id_)).cast(REGION)).otherwise(cut)


def harness_channel(text: Column, resume: str = RESUME) -> Column:
    """Which text of the harness a user's block is: a checkpoint by its id, the resume by its words, else the task."""
    probe = F.size(X.find_probe_ids(text)) > 0
    return F.when(probe, "harness_probe").when(X.spaces_normal(text) == " ".join(resume.split()), "harness_resume").otherwise("harness_task_prompt")


def strings_in(document: Column) -> Column:
    """All texts that are values in a JSON document, in its order."""
    # every text with the colon that makes it a name, so that no match starts at a closing quote
    quoted = F.regexp_extract_all(document, F.lit(r'"(?:[^"\\]|\\.)*+"\s*:?'), F.lit(0))
    values = F.filter(quoted, lambda q: ~q.endswith(":"))
    return F.coalesce(F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>"), F.array().cast("array<string>"))


def _first_call(blocks: Column) -> tuple[Column, Column]:
    """The call that a message's first block with one is of, and the calls of all its blocks."""
    ids = F.transform(blocks, lambda b: F.coalesce(F.nullif(F.get_json_object(b, "$.tool_use_id"), F.lit("")), F.nullif(F.get_json_object(b, "$.toolUseId"), F.lit("")), F.when(F.get_json_object(b, "$.type") == "tool_use", F.nullif(F.get_json_object(b, "$.id"), F.lit("")))))
    return F.get(F.filter(ids, lambda x: x.isNotNull()), F.lit(0)), ids


def transcript_rows(lines: DataFrame, stream: DataFrame) -> DataFrame:
    """Lines of the log on disk with the place of the stream that each belongs to.

    By the call (the last place that names it), else by the message (the first), else the last known before, which is
    marked as approximate; before any it is 0. Both have run_id, line_no, line.
    """
    first, ids = _first_call(_blocks("$.message.content"))
    placed = scanned(stream, ["run_id"], ["line_no"], {"at": ordinal()}).withColumn("at", F.col("at") - 1)
    calls = placed.select("run_id", "at", F.explode(ids).alias("id")).where("id is not null").groupBy(F.col("run_id").alias("_c_run"), F.col("id").alias("_c_id")).agg(F.max("at").alias("tool_seq"))
    said = placed.where(at("$.message.id") != "").groupBy(F.col("run_id").alias("_m_run"), at("$.message.id").alias("_m_id")).agg(F.min("at").alias("message_seq"))
    rows = lines.select("run_id", "line_no", "line", first.alias("tool_use_id"), at("$.message.id").alias("message_id"))
    rows = rows.join(calls, (F.col("run_id") == F.col("_c_run")) & (F.col("tool_use_id") == F.col("_c_id")), "left").join(said, (F.col("run_id") == F.col("_m_run")) & (F.col("message_id") == F.col("_m_id")), "left")
    known = F.coalesce("tool_seq", "message_seq")
    rows = scanned(rows.withColumn("seq_approx", known.isNull()), ["run_id"], ["line_no"], {"seq": last_known(known)})
    return rows.select("run_id", "line_no", "line", "tool_use_id", F.coalesce("seq", F.lit(0)).alias("seq"), "seq_approx")


def transcript_regions(lines: DataFrame, stream: DataFrame, regions: DataFrame) -> DataFrame:
    """(run_id, line_no, seq, seq_approx, channel, text): what only the log on disk has.

    Marks of bytes that nobody saw (persisted outputs, sidecars; without text), attachments by their kind, and
    reminders that the stream doesn't replay. A text that its channel has already, there or here, isn't told again.
    """
    tur = at("$.toolUseResult")
    result = F.when(tur.startswith("{"), tur)
    path = F.coalesce(F.get_json_object(result, "$.persistedOutputPath"), F.get_json_object(result, "$.persisted_output_path"))
    size = lambda doc: F.aggregate(strings_in(F.coalesce(doc, F.lit("{}"))), F.lit(0), lambda n, x: n + F.length(x))
    hidden = size(result) - size(F.get_json_object(result, "$.file"))
    attachment = F.when(at("$.attachment").startswith("{"), at("$.attachment"))
    kind = F.coalesce(F.nullif(F.get_json_object(attachment, "$.type"), F.lit("")), F.nullif(at("$.attachmentType"), F.lit("")), F.lit("unknown"))
    is_attachment = F.coalesce(at("$.type") == "attachment", F.lit(False)) | attachment.isNotNull()
    part = lambda channel, text: F.struct(channel.alias("channel"), text.alias("text"))
    none = F.array().cast("array<struct<channel:string,text:string>>")
    texts = F.transform(F.filter(_blocks("$.message.content"), lambda b: F.get_json_object(b, "$.type") == "text"), lambda b: F.coalesce(F.get_json_object(b, "$.text"), F.lit("")))
    reminders = F.transform(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(REMINDER), F.lit(0)))), lambda m: part(F.lit("system_reminder"), m))
    named = part(F.concat(F.lit("attachment_"), F.regexp_replace(kind, r"[^A-Za-z0-9_.-]", "_")), F.array_join(strings_in(F.coalesce(attachment, F.lit("{}"))), "\n"))
    parts = F.concat(
        F.when(path != "", F.array(part(F.lit("persisted_output_ondisk"), F.lit("")))).otherwise(none),
        F.when(hidden > 0, F.array(part(F.lit("sidecar_only"), F.lit("")))).otherwise(none),
        F.when(is_attachment, F.array(named)).otherwise(F.coalesce(reminders, none)),
    )
    rows = transcript_rows(lines, stream).select("run_id", "line_no", "seq", "seq_approx", F.posexplode(parts).alias("k", "p"))
    rows = rows.select("run_id", "line_no", "k", "seq", "seq_approx", "p.channel", "p.text", F.sha2(F.col("p.text").cast("binary"), 256).alias("sha"))
    have = regions.where("text <> ''").select(F.col("run_id").alias("_run"), F.col("channel").alias("_channel"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha")).distinct()
    marks = rows.where(F.col("channel").isin("persisted_output_ondisk", "sidecar_only"))
    told = rows.where(~F.col("channel").isin("persisted_output_ondisk", "sidecar_only")).join(have, (F.col("run_id") == F.col("_run")) & (F.col("channel") == F.col("_channel")) & (F.col("sha") == F.col("_sha")), "left_anti")
    once = told.groupBy("run_id", "channel", "sha").agg(F.min(F.struct("line_no", "k", "seq", "seq_approx", "text")).alias("v")).select("run_id", "v.line_no", "v.seq", "v.seq_approx", "channel", "v.text")
    return marks.select("run_id", "line_no", "seq", "seq_approx", "channel", "text").unionByName(once)


def transcript_signals(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, tool_use_id, kind): sidechains, cut files, outputs kept on disk, and answers beside the message."""
    first, _ = _first_call(_blocks("$.message.content"))
    tur = at("$.toolUseResult")
    result = F.when(tur.startswith("{"), tur)
    size = lambda doc: F.aggregate(strings_in(F.coalesce(doc, F.lit("{}"))), F.lit(0), lambda n, x: n + F.length(x))
    cut = F.get_json_object(result, "$.file.numLines").try_cast("bigint") < F.get_json_object(result, "$.file.totalLines").try_cast("bigint")
    path = F.coalesce(F.get_json_object(result, "$.persistedOutputPath"), F.get_json_object(result, "$.persisted_output_path"))
    side = (at("$.isSidechain") == "true") | (at("$.is_sidechain") == "true")
    found = F.array(F.when(side, F.lit("sidechain")), F.when(cut, F.lit("truncated")), F.when(path != "", F.lit("truncated")), F.when(size(result) - size(F.get_json_object(result, "$.file")) > 0, F.lit("sidecar_only")))
    return lines.select("run_id", "line_no", first.alias("tool_use_id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("kind"))


def tool_index(lines: DataFrame) -> DataFrame:
    """(run_id, tool_use_id, tool, tool_input) of all calls; of a repeated id the later."""
    use = F.filter(_blocks("$.message.content"), lambda b: F.get_json_object(b, "$.type") == "tool_use")
    rows = lines.where(at("$.type") == "assistant").select("run_id", "line_no", F.posexplode(use).alias("k", "b"))
    v = F.struct(F.get_json_object("b", "$.name").alias("tool"), F.get_json_object("b", "$.input").alias("tool_input"))
    return rows.groupBy("run_id", F.get_json_object("b", "$.id").alias("tool_use_id")).agg(F.max_by(v, F.struct("line_no", "k")).alias("v")).select("run_id", "tool_use_id", "v.*")


def stream_regions(lines: DataFrame) -> DataFrame:
    """(run_id, seq, region_idx, channel, text, tool, tool_use_id, is_error, inbound, counts_toward_read) of raw records.

    Bytes that nobody saw have no text. A refused read of a large file is no region (see ``read_errors``).
    """
    rows = scanned(lines, ["run_id"], ["line_no"], {"seq": ordinal()}).withColumn("seq", F.col("seq") - 1).withColumn("kind", record_kind())
    said = rows.where("kind in ('assistant', 'user')").select("run_id", "seq", "kind", F.posexplode(_blocks("$.message.content")).alias("k", "b"))
    get = lambda p: F.get_json_object("b", p)
    said = said.withColumn("type", get("$.type")).withColumn("answers", F.coalesce(get("$.tool_use_id"), get("$.toolUseId")))
    tools = tool_index(lines).withColumnsRenamed({"run_id": "_run", "tool_use_id": "_id"})
    said = said.join(tools, (F.col("run_id") == F.col("_run")) & (F.col("answers") == F.col("_id")), "left")
    text, body = F.coalesce(get("$.text"), F.lit("")), result_text(get("$.content"))
    error = F.coalesce((get("$.is_error") == "true") | (get("$.isError") == "true"), F.lit(False))
    channel = T.channel_for_tool_result(F.col("tool"), F.get_json_object("tool_input", "$.output_mode"))
    one = lambda *a, **k: F.array(_region(*a, **k)).cast(REGION)
    tool, id_ = F.col("tool"), F.col("answers")
    of_result = F.when(error & body.rlike(READ_CEILING), F.array().cast(REGION)).when((channel == "bash_stdout") & ~error, shell_regions(body, tool, id_)).otherwise(one(channel, body, tool, id_, error, error & ~channel.isin("bash_stdout", "unknown_visible")))
    of_assistant = F.when(F.col("type").isin("thinking", "redacted_thinking"), one("self_thinking", F.coalesce(get("$.thinking"), text))).when(F.col("type") == "text", one(F.when(F.size(X.find_probe_ids(text)) > 0, "probe_answer").otherwise("self_text"), text)).when(F.col("type") == "tool_use", one("tool_input", F.coalesce(get("$.input"), F.lit("{}")), get("$.name"), get("$.id"))).otherwise(one("unknown_visible", F.substring("b", 1, 20_000)))
    of_user = F.when(F.col("type") == "tool_result", of_result).when(F.col("type") == "text", text_regions(text, harness_channel(text))).otherwise(one("unknown_visible", F.substring("b", 1, 20_000)))
    parts = said.select("run_id", "seq", "k", F.posexplode(F.when(F.col("kind") == "assistant", of_assistant).otherwise(of_user)).alias("j", "r"))
    listing = F.to_json(F.struct(*(at(f"$.{n}").alias(n) for n in ("tools", "mcp_servers", "slash_commands", "model", "permissionMode"))))
    init = rows.where("kind = 'system_init'").select("run_id", "seq", F.lit(0).alias("k"), F.lit(0).alias("j"), _region("system_init_listing", listing).alias("r"))
    every = parts.unionByName(init)
    every = scanned(every, ["run_id"], ["seq", "k", "j"], {"region_idx": ordinal()}).withColumn("region_idx", F.col("region_idx") - 1)
    c, muted = F.col("r.channel"), F.col("r.muted")
    return every.select("run_id", "seq", "region_idx", c.alias("channel"), F.when(T.model_visible(c), F.col("r.text")).otherwise("").alias("text"), F.col("r.tool").alias("tool"), F.col("r.tool_use_id").alias("tool_use_id"), F.col("r.is_error").alias("is_error"), (T.inbound(c) & ~muted).alias("inbound"), (T.counts_toward_read(c) & ~muted).alias("counts_toward_read"))


def read_errors(lines: DataFrame) -> DataFrame:
    """Answers that refused a file for its size: signals, not regions."""
    rows = lines.where(record_kind() == "user").select("run_id", "line_no", F.explode(_blocks("$.message.content")).alias("b")).where((F.get_json_object("b", "$.type") == "tool_result") & (F.get_json_object("b", "$.is_error") == "true"))
    return rows.where(result_text(F.get_json_object("b", "$.content")).rlike(READ_CEILING)).select("run_id", "line_no", F.get_json_object("b", "$.tool_use_id").alias("tool_use_id"), F.lit("read_error").alias("kind"))


def once_by_text(regions: DataFrame) -> DataFrame:
    """Regions of a second log without those that repeat a channel's text."""
    first = Window.partitionBy("run_id", "channel", F.sha2("text", 256)).orderBy("seq", "region_idx")
    return regions.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def unknown_visible(regions: DataFrame) -> DataFrame:
    """The tripwire: visible text on no known channel, a count a run."""
    return regions.where("channel = 'unknown_visible'").groupBy("run_id").agg(F.count("*").alias("n"))
