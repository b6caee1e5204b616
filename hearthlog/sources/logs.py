"""Session logs of three providers as turns; inventories; persisted runs.

Readers keep lines that don't parse, and JSON that is no object, out of the result. VARIANT columns
carry the JSON, so new fields need no schema.
"""

from __future__ import annotations

import json

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlog.functions.json import member, members, strings_within
from hearthlog.functions.text import parse_time, strip
from hearthlog.sources.ranges import RANGE_BYTES, plan_ranges, range_lines, readable
from hearthlog.sources.written import hadoop_path, listed_in_few_tasks, materialise

INVENTORY = "path string, provider string, mtime timestamp, size long"
_GLOBS = {"codex": "*.jsonl", "claude": "*.jsonl", "gemini": "*.json"}
_TEXT_TYPES = ("text", "input_text", "output_text")


def session_inventory(spark: SparkSession, roots: dict[str, str], globs: dict[str, str] = _GLOBS) -> DataFrame:
    """path, provider, mtime, size of the logs below each provider's root, oldest first; a missing root gives none."""
    out = spark.createDataFrame([], INVENTORY)
    for provider, root in roots.items():
        path, fs = hadoop_path(spark, root)
        if not fs.exists(path):
            continue
        with listed_in_few_tasks(spark):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs[provider]).load(root)
        files = files.select("path", F.lit(provider).alias("provider"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
        if provider == "gemini" and not root.rstrip("/").endswith("/chats"):
            files = files.where(F.col("path").contains("/chats/"))
        out = out.unionByName(files)
    return out.orderBy("mtime", "path")


def latest_sessions(files: DataFrame, n: int = 1, per: str | None = "provider") -> DataFrame:
    """The n newest files of each value of ``per``, or of all."""
    if per is None:
        return files.orderBy(F.col("mtime").desc(), "path").limit(n)
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.col("mtime").desc(), F.col("path")))
    return files.withColumn("n", rank).where(F.col("n") <= n).drop("n")


def latest_active_provider(turns: DataFrame, files: DataFrame) -> DataFrame:
    """provider, last_active: the provider whose newest session was active last."""
    last = turns.groupBy("provider", "file").agg(F.max("ts").alias("ts"))
    newest = files.groupBy("provider").agg(F.max_by("path", F.struct("mtime", "path")).alias("file"), F.max("mtime").alias("mtime"))
    active = newest.join(last, ["provider", "file"], "left").select("provider", F.coalesce("ts", "mtime").alias("last_active"))
    return active.orderBy(F.col("last_active").desc(), "provider").limit(1)


def _field(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def _is(v: str, path: str, kind: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get({v}, '{path}', 'variant')) LIKE '{kind}%'")


def _content(v: str, path: str, include_tools: bool, wide: bool = False) -> Column:
    """The text of a message: a string itself, or the text of its text items, one a line."""
    item = "CASE WHEN try_variant_get(i, '$.type', 'string') IN ('text', 'input_text', 'output_text') OR {w} THEN try_variant_get(i, '$.text', 'string') {t} END".format(
        w="try_variant_get(i, '$.text', 'string') IS NOT NULL" if wide else "false",
        t="WHEN try_variant_get(i, '$.type', 'string') = 'tool_use' THEN try_variant_get(i, '$.name', 'string')" if include_tools else "",
    )
    items = F.expr(f"array_join(filter(transform(try_variant_get({v}, '{path}', 'array<variant>'), i -> {item}), t -> trim(t) <> ''), '\n')")
    return F.coalesce(strip(F.when(_is(v, path, "STRING"), _field(v, path)).when(_is(v, path, "ARRAY"), items)), F.lit(""))


def _texts(spark: SparkSession, path: str, glob: str, whole: bool = False) -> DataFrame:
    """value: the lines of all files below a path, or their whole texts."""
    with listed_in_few_tasks(spark):
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=whole)


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, line (a number ascending in each file), v (the JSON of a line)."""
    text = _texts(spark, path, glob)
    return _objects(text.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line"), "value"))


def _objects(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.expr("try_parse_json(value)")).where(F.expr("schema_of_variant(v) LIKE 'OBJECT%'")).select("file", "line", "v")


def complete_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, start (zero), end, value: the lines of files that end in a line feed, and the offset after each, read by Spark from the
    start of each file with one sort per file. A byte-order mark, which Spark's reader drops, is not counted in offsets."""
    text = spark.read.option("lineSep", "\n").text(paths)
    at = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line"), "value")
    end = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("file").orderBy("line"))
    return at.withColumn("end", end).where(F.col("end") <= F.col("size")).select("file", F.lit(0).cast("long").alias("start"), "end", "value")


def _numbered(rows: DataFrame, provider: str) -> DataFrame:
    """Non-blank rows (file, line, at, role, ts_raw, text) as turns, numbered from one in each file."""
    index = F.row_number().over(Window.partitionBy("file").orderBy("line", "at")).cast("long")
    kept = rows.where(F.trim("text") != "")
    return kept.select(F.lit(provider).alias("provider"), "file", index.alias("msg_index"), "role", parse_time(F.col("ts_raw")).alias("ts"), "ts_raw", "text")


def _row(at: int, role: Column, text: Column) -> Column:
    return F.struct(F.lit(at).alias("at"), role.alias("role"), text.alias("text"))


def _emit(lines: DataFrame, ts: Column, rows: Column) -> DataFrame:
    return lines.select("file", "line", ts.alias("ts_raw"), F.explode(rows).alias("r")).select("file", "line", "ts_raw", "r.*")


def read_codex_turns(spark: SparkSession, path: str, include_tools: bool = False, include_cmds: bool = True, glob: str = "*.jsonl") -> DataFrame:
    """Messages of both event kinds, and shell commands as ``cmd`` rows."""
    return _numbered(codex_rows(_lines(spark, path, glob), include_tools, include_cmds), "codex")


def codex_rows(lines: DataFrame, include_tools: bool = False, include_cmds: bool = True) -> DataFrame:
    kind, inner = _field("v", "$.type"), _field("v", "$.payload.type")
    command = F.expr("try_variant_get(try_parse_json(try_variant_get(v, '$.payload.arguments', 'string')), '$.command', 'string')")
    item, event = kind == "response_item", kind == "event_msg"
    rows = F.filter(
        F.array(
            _row(0, F.when(item & (inner == "function_call") & (_field("v", "$.payload.name") == "shell_command") & F.lit(include_cmds), F.lit("cmd")), strip(command)),
            _row(1, F.when(item & (inner == "message"), F.coalesce(_field("v", "$.payload.role"), F.lit("assistant"))), _content("v", "$.payload.content", include_tools)),
            _row(2, F.when(event & (inner == "user_message"), "user").when(event & (inner == "agent_message"), "assistant"), strip(_field("v", "$.payload.message"))),
        ),
        lambda r: r["role"].isNotNull() & r["text"].isNotNull(),
    )
    return _emit(lines, _field("v", "$.timestamp"), rows)


_COMMAND = """coalesce({keys}, CASE WHEN schema_of_variant(try_variant_get({i}, '$.input', 'variant')) = 'STRING' THEN nullif(trim(try_variant_get({i}, '$.input', 'string')), '') END)"""


def _command(i: str) -> str:
    """The first non-blank string among the command fields of a tool call's input, or the input itself."""
    keys = ", ".join(f"CASE WHEN schema_of_variant(try_variant_get({i}, '$.input.{k}', 'variant')) = 'STRING' THEN nullif(trim(try_variant_get({i}, '$.input.{k}', 'string')), '') END" for k in ("command", "cmd", "script", "args"))
    wanted = " OR ".join(f"try_variant_get({i}, '$.input.{k}', 'variant') IS NOT NULL" for k in ("command", "cmd", "script"))
    return f"CASE WHEN {wanted} OR lower(try_variant_get({i}, '$.name', 'string')) RLIKE 'bash|shell|command|cmd' THEN {_COMMAND.format(keys=keys, i=i)} END"


def read_claude_turns(spark: SparkSession, path: str, include_tools: bool = False, include_cmds: bool = True, glob: str = "*.jsonl") -> DataFrame:
    """Commands of a message first, then its text if the role is user or assistant."""
    return _numbered(claude_rows(_lines(spark, path, glob), include_tools, include_cmds), "claude")


def claude_rows(lines: DataFrame, include_tools: bool = False, include_cmds: bool = True) -> DataFrame:
    inside = F.coalesce(_is("v", "$.message", "OBJECT"), F.lit(False))
    calls = F.expr(f"filter(transform(try_variant_get(v, '$.message.content', 'array<variant>'), i -> CASE WHEN try_variant_get(i, '$.type', 'string') = 'tool_use' THEN {_command('i')} END), c -> c IS NOT NULL)")
    commands = F.when(inside & F.lit(include_cmds), F.transform(F.coalesce(calls, F.array().cast("array<string>")), lambda c, at: F.struct(at.alias("at"), F.lit("cmd").alias("role"), c.alias("text")))).otherwise(F.array().cast("array<struct<at:int,role:string,text:string>>"))
    role = F.when(inside, _field("v", "$.message.role")).otherwise(_field("v", "$.role"))
    text = F.when(inside, _content("v", "$.message.content", include_tools)).otherwise(_content("v", "$.content", include_tools))
    message = F.when(role.isin("user", "assistant"), F.array(_row(1_000_000, role, text))).otherwise(F.array().cast("array<struct<at:int,role:string,text:string>>"))
    return _emit(lines, _field("v", "$.timestamp"), F.concat(commands, message))


def _documents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    text = _texts(spark, path, glob, True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value)").alias("d"))


def read_gemini_turns(spark: SparkSession, path: str, include_tools: bool = False, include_cmds: bool = True, glob: str = "*.json") -> DataFrame:
    """Content of each message, then its tool calls' commands, then (with tools) their displayed results."""
    m = _documents(spark, path, glob).select("file", F.expr("posexplode(try_variant_get(d, '$.messages', 'array<variant>'))").alias("line", "v"))
    kind = _field("v", "$.type")
    role = F.when(kind == "user", "user").when(kind.isin("gemini", "assistant", "model"), "assistant")
    empty = F.array().cast("array<struct<at:int,role:string,text:string>>")
    calls = "try_variant_get(v, '$.toolCalls', 'array<variant>')"
    command = _command("c").replace("$.input", "$.args")
    in_result = _command("c").replace("$.input", "$.result")
    commands = F.transform(F.expr(f"transform({calls}, c -> coalesce({command}, {in_result}))"), lambda c, at: F.struct((at * 2 + 1).alias("at"), F.lit("cmd").alias("role"), c.alias("text")))
    shown = F.transform(F.expr(f"transform({calls}, c -> try_variant_get(c, '$.resultDisplay', 'string'))"), lambda c, at: F.struct((at + 1_000_000).alias("at"), F.lit("tool").alias("role"), c.alias("text")))
    rows = F.concat(F.array(_row(0, role, _content("v", "$.content", include_tools))), F.coalesce(commands, empty) if include_cmds else empty, F.coalesce(shown, empty) if include_tools else empty)
    rows = F.filter(rows, lambda r: r["text"].isNotNull())
    return _numbered(_emit(m.where(role.isNotNull()), _field("v", "$.timestamp"), rows), "gemini")


def _gemini_raw(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Rows of the search flavour: content, then each tool call's displayed result and all strings inside its result, in the order of the text."""
    text = _texts(spark, path, glob, True)
    whole = text.select(F.col("_metadata.file_path").alias("file"), "value").where(F.expr("schema_of_variant(try_parse_json(value)) LIKE 'OBJECT%'"))
    said = whole.select("file", member(members(F.col("value"), "OBJECT"), "messages").alias("m"))
    said = said.select("file", F.posexplode(members(F.col("m.json"), F.col("m.kind"))).alias("line", "m")).where("m.kind = 'OBJECT'")
    said = said.select("file", "line", F.try_parse_json("m.json").alias("v"), member(members(F.col("m.json"), "OBJECT"), "toolCalls").alias("calls"))
    none = F.array().cast("array<string>")

    def told(call: Column) -> Column:
        inner = members(call["json"], call["kind"])
        shown, result = member(inner, "resultDisplay"), member(inner, "result")
        return F.concat(F.when(shown["kind"] == "STRING", F.array(shown["json"])).otherwise(none), strings_within(result["json"], result["kind"], ("output", "text", "content")))

    kind, text = F.coalesce(_field("v", "$.type"), F.lit("")), F.when(_is("v", "$.content", "STRING"), _field("v", "$.content"))
    content = F.when(strip(text) != "", text).when(_is("v", "$.content", "ARRAY"), _content("v", "$.content", False, True))
    parts = F.concat(F.array(content), F.flatten(F.transform(members(F.col("calls.json"), F.col("calls.kind")), told)))
    role = F.when(kind.isin("gemini", "assistant", "model"), "assistant").otherwise(kind)
    return _emit(said, F.coalesce(_field("v", "$.timestamp"), F.lit("")), F.array(_row(0, role, strip(F.array_join(F.filter(parts, lambda p: p != ""), "\n")))))


def read_raw_turns(spark: SparkSession, path: str, provider: str, glob: str | None = None) -> DataFrame:
    """The search flavour: timestamps kept, no command rows, any item with a text; tool results folded into the turn."""
    glob = glob or _GLOBS[provider]
    if provider == "gemini":
        return _numbered(_gemini_raw(spark, path, glob), "gemini")
    return _numbered(raw_rows(_lines(spark, path, glob), provider), provider)


def raw_rows(lines: DataFrame, provider: str) -> DataFrame:
    """Rows of the search flavour from lines (file, line, v) of codex or claude logs."""
    if provider == "codex":
        kind, inner = _field("v", "$.type"), _field("v", "$.payload.type")
        item, event = (kind == "response_item") & (inner == "message"), kind == "event_msg"
        role = F.when(item, _field("v", "$.payload.role")).when(event & (inner == "user_message"), "user").when(event & (inner == "agent_message"), "assistant")
        text = F.when(item, _content("v", "$.payload.content", False, True)).otherwise(_field("v", "$.payload.message"))
    else:
        # the message, or where it has no text or role the line itself, which only a user or an assistant speaks by
        inner, said = F.coalesce(F.nullif(_field("v", "$.message.role"), F.lit("")), _field("v", "$.type")), _content("v", "$.message.content", False, True)
        inside = F.coalesce(_is("v", "$.message", "OBJECT") & (said != "") & (inner != ""), F.lit(False))
        top = _field("v", "$.role")
        role = F.when(inside, inner).when(top.isin("user", "assistant"), top)
        text = F.when(inside, said).otherwise(_content("v", "$.content", False, True))
    return _emit(lines, _field("v", "$.timestamp"), F.array(_row(0, role, text))).where(F.col("role").isNotNull())


def resumed_turns(spark: SparkSession, todo: DataFrame, provider: str, raw: bool = True, range_bytes: int = RANGE_BYTES, counted: Accumulator | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, ends) of what files hold beyond what is known of them: complete lines after ``offset``, numbered on from ``msg_index``.

    todo: file, offset, size, msg_index. ends: file, offset after the last complete line. Only the bytes from ``offset`` to
    ``size`` are read, in ranges, and turns are numbered by range, so that a long log is no single task; the new lines and
    their rows are written tables. Where only Spark can open the files, they are read from their start. counted: adds up the bytes read.
    """
    first = todo.select("file").first()
    if first is None:
        none = spark.createDataFrame([], "file string, offset long")
        return spark.createDataFrame([], "provider string, file string, msg_index long, role string, ts timestamp, ts_raw string, text string"), none
    if readable(first.file):
        lines = range_lines(plan_ranges(todo.select("file", "offset", "size"), range_bytes), counted=counted)
    else:
        known = complete_lines(spark, [r.file for r in todo.select("file").distinct().collect()])
        lines = known.join(todo.select("file", "offset"), "file").where(F.col("end") > F.col("offset")).drop("offset")
    lines = materialise(lines, "new-lines")
    fresh = _objects(lines.withColumn("line", F.struct("start", "end")))
    rows = raw_rows(fresh, provider) if raw else {"codex": codex_rows, "claude": claude_rows}[provider](fresh)
    rows = materialise(rows.where(F.trim("text") != "").withColumn("start", F.col("line.start")), "new-rows")
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("file", "start", F.coalesce(before, F.lit(0)).alias("before")).join(todo.select("file", "msg_index"), "file")
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("line", "at"))
    turns = rows.withColumn("inside", inside).join(base, ["file", "start"]).withColumn("msg_index", F.col("msg_index") + F.col("before") + F.col("inside"))
    turns = turns.select(F.lit(provider).alias("provider"), "file", "msg_index", "role", parse_time(F.col("ts_raw")).alias("ts"), "ts_raw", "text")
    return turns, lines.groupBy("file").agg(F.max("end").alias("offset"))


def write_turns(turns: DataFrame, path: str) -> None:
    """Write turns by provider; providers that ``turns`` does not have keep theirs."""
    turns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider").parquet(path)


def write_run(artifacts: DataFrame | dict[str, DataFrame], path: str, run_id: str, manifest: dict | None = None) -> None:
    """One run's tables below ``run_id=...``: each kind (hits, window, chunks, summaries, final, ...) in a folder of its name, by
    provider where it has one, and the run's parameters with the kinds as one JSON row."""
    kinds = artifacts if isinstance(artifacts, dict) else {"data": artifacts}
    for kind, df in kinds.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("provider") if "provider" in df.columns else out).parquet(f"{path}/run_id={run_id}/{kind}")
    spark = next(iter(kinds.values())).sparkSession
    spark.createDataFrame([(run_id, sorted(kinds), json.dumps(manifest or {}, sort_keys=True))], "run_id string, kinds array<string>, parameters string").coalesce(1).write.mode("overwrite").json(f"{path}/run_id={run_id}/manifest")
