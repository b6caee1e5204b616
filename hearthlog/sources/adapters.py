"""Tables of other shapes as turns: (provider, file, msg_index, role, ts, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlog.sources.written import fresh_path

PROVIDERS = ("codex", "claude", "gemini")


def provider_of(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PROVIDERS)), (n % 3 + 1).cast("int"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(provider_of(F.col("conv_id")).alias("provider"), F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).cast("long").alias("msg_index"), "role", F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), "text")


def document_line_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return d.select(provider_of(F.col("doc_id")).alias("provider"), F.col("doc_id").cast("string").alias("file"), (F.col("i") + 1).cast("long").alias("msg_index"), F.when(F.col("i") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit(None).cast("timestamp").alias("ts"), "text")


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(provider_of(F.col("user_id")).alias("provider"), F.col("user_id").cast("string").alias("file"), i.alias("msg_index"), F.col("event_type").alias("role"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("props"), F.lit("")).alias("text"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory (path, provider, mtime, size) with one file per conversation."""
    return conversation_turns(spark, sf_dir).groupBy(F.col("file").alias("path"), "provider").agg(F.max("ts").alias("mtime"), F.sum(F.length("text")).cast("long").alias("size"))


def command_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns of each document's text: after a prompt or label, fenced and then prompted, and with prompts on all lines."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    label = F.element_at(F.array(*map(F.lit, ("$ ", " Command: ", "cmd:"))), (F.col("doc_id") % 3 + 1).cast("int"))
    texts = (F.concat(F.lit("intro\n"), label, "text"), F.concat(F.lit("```sh\n"), "text", F.lit("\n```\n> "), "text"), F.concat(F.lit("$ "), F.replace("text", F.lit("\n"), F.lit("\n> "))))
    each = d.select("doc_id", F.posexplode(F.array(*texts)).alias("i", "text"))
    return each.select(provider_of(F.col("doc_id")).alias("provider"), F.col("doc_id").cast("string").alias("file"), (F.col("i") + 1).cast("long").alias("msg_index"), F.when(F.col("i") == 0, "user").otherwise("assistant").alias("role"), "text")


def committed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which every third turn tells of a commit."""
    turns = conversation_turns(spark, sf_dir)
    sha = F.substring(F.md5(F.concat_ws(":", "file", "msg_index")), 1, 8)
    return turns.withColumn("text", F.when(F.col("msg_index") % 3 == 0, F.concat("text", F.lit(" pushed commit "), sha)).otherwise(F.col("text")))


def write_logs(spark: SparkSession, sf_dir: str, provider: str) -> str:
    """Conversations (users' and assistants' turns) as logs of a provider, one file each below a fresh shared folder; even turns have a command."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role IN ('user', 'assistant')")
    ts, even = F.date_format(F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("turn") % 2 == 0
    run = F.concat(F.lit("run "), F.col("turn").cast("string"))
    if provider == "codex":  # a command's line, then the message's, as an item or an event
        command = F.to_json(F.struct(F.lit("response_item").alias("type"), ts, F.struct(F.lit("function_call").alias("type"), F.lit("shell_command").alias("name"), F.to_json(F.struct(run.alias("command"))).alias("arguments")).alias("payload")))
        item = F.to_json(F.struct(F.lit("response_item").alias("type"), ts, F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("output_text").alias("type"), "text")).alias("content")).alias("payload")))
        event = F.to_json(F.struct(F.lit("event_msg").alias("type"), ts, F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload")))
        rows = c.select("conv_id", "turn", F.posexplode(F.array(F.when(even, command), F.when(F.col("turn") % 3 == 0, item).otherwise(event))).alias("at", "value")).where("value IS NOT NULL")
    elif provider == "claude":
        say = F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input"))
        tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name"), F.struct(run.alias("command")).alias("input"))
        value = F.to_json(F.struct(ts, F.struct("role", F.when(even, F.array(say, tool)).otherwise(F.array(say)).alias("content")).alias("message")))
        rows = c.select("conv_id", "turn", F.lit(0).alias("at"), value.alias("value"))
    else:
        call = F.array(F.struct(F.lit("run_shell").alias("name"), F.struct(run.alias("command")).alias("args")))
        message = F.struct("turn", F.when(F.col("role") == "user", "user").otherwise("gemini").alias("type"), F.col("text").alias("content"), ts, F.when(even, call).alias("toolCalls"))
        rows = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(message)).alias("messages"))).alias("value")).select("conv_id", F.lit(0).alias("turn"), F.lit(0).alias("at"), "value")
    path = f"{fresh_path(spark, provider)}/chats"
    lines = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "at")
    lines.select("conv_id", "value").write.partitionBy("conv_id").text(path)
    return path


def write_tool_results(spark: SparkSession, sf_dir: str) -> str:
    """Documents as messages of JSON logs, twenty a file below a fresh shared folder: the source said, and a tool call whose nested result holds text and language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = F.array(F.struct(F.struct(F.array(F.struct(F.col("text").alias("output"), F.lit(1).alias("content"))).alias("y")).alias("z"), F.struct(F.col("lang").alias("text")).alias("a")))
    call = F.array(F.struct(result.alias("result"), F.concat(F.lit("shown "), "doc_id").alias("resultDisplay")))
    kind = F.element_at(F.array(*map(F.lit, ("user", "gemini", "info"))), (F.col("doc_id") % 3 + 1).cast("int"))
    message = F.struct("doc_id", kind.alias("type"), F.col("source").alias("content"), call.alias("toolCalls"))
    path = f"{fresh_path(spark, 'tool-results')}/chats"
    each = d.select(F.floor(F.col("doc_id") / 20).alias("part"), message.alias("m")).groupBy("part").agg(F.to_json(F.struct(F.array_sort(F.collect_list("m")).alias("messages"))).alias("value"))
    each.write.partitionBy("part").text(path)
    return path
