"""Token budgets, chunks, prompts and map-reduce summaries of transcripts.

The summariser is the user's: a pandas function from a series of prompts to a series of summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions.batches import pieces
from hearthlog.functions.text import rstrip
from hearthlog.sources.written import hadoop_path, materialise

from .clean import rendered
from .windows import fetch_windows, project_of

#: Context sizes by the start of a model's name (in this order), and shares.
CONTEXT_LIMITS = {
    "gemma3:1b": 32768,
    "gemma3:4b": 128000,
    "gemma3:12b": 128000,
    "gemma3:27b": 128000,
    "granite4": 128000,
    "granite4:8b": 128000,
    "granite4:20b": 128000,
}
DEFAULT_CONTEXT_LIMIT = 32768
CHARS_PER_TOKEN = 4
INPUT_FRACTION = 0.7
OUTPUT_TOKENS = 1024
MAX_PASSES = 4
#: Rows and bytes of texts that are Python objects at a time.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20

#: Fixed value: what a summary prompt asks for.
DEFAULT_TEMPLATE = (
    "{{transcript}}\n\n"
    "========\n"
    "summarize the major categories of what i did in this conversation, "
    "what decisions where made and why, and what code artifacts we created "
    "or touched, and a list of common commands and their context:\n"
    "include .md, .yaml, and any code as artifacts\n"
    "Output Markdown (.md).\n"
)

Summariser = Callable[[pd.Series], pd.Series]


def token_estimate(length: Column) -> Column:
    return F.when(length == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(length / CHARS_PER_TOKEN))).cast("long")


def context_limit(model: Column) -> Column:
    limit = F.lit(DEFAULT_CONTEXT_LIMIT)
    for name, size in reversed(CONTEXT_LIMITS.items()):
        limit = F.when(model.startswith(name), size).otherwise(limit)
    return limit


def char_budget(model: Column, prompt_chars: int) -> Column:
    prompt = 0 if not prompt_chars else max(1, prompt_chars // CHARS_PER_TOKEN)
    return CHARS_PER_TOKEN * F.greatest(F.lit(1024), F.floor(context_limit(model) * INPUT_FRACTION) - prompt - OUTPUT_TOKENS)


def token_budget(transcripts: DataFrame, models: list[str], prompt_chars: int = 0) -> DataFrame:
    """provider, file, model, n_tokens, context_limit, char_budget, n_chunks: what each transcript costs with each model."""
    each = transcripts.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    size = F.length("text")
    budget = char_budget(F.col("model"), prompt_chars).cast("long")
    return each.select("provider", "file", "model", token_estimate(size).alias("n_tokens"), context_limit(F.col("model")).cast("long").alias("context_limit"), budget.alias("char_budget"), F.ceil(size / budget).cast("long").alias("n_chunks"))


def chunk_bounds(costs: np.ndarray, max_chars: int) -> list[int]:
    """Where chunks start and the last one ends, as line numbers: each goes on to the last line up to which the sum of the
    costs fits, and a line that fits nowhere is a chunk of its own."""
    upto = np.cumsum(costs)
    wide = np.append(np.flatnonzero(costs > max_chars), len(costs))
    bounds = [0]
    while bounds[-1] < len(costs):
        at = bounds[-1]
        fits = int(np.searchsorted(upto, upto[at] - costs[at] + max_chars, "right"))
        bounds.append(max(at + 1, min(fits, int(wide[np.searchsorted(wide, at)]))))
    return bounds


def chunk_text(text: str, max_chars: int) -> list[str]:
    """Neighbouring lines together up to ``max_chars`` (a line costs its length plus one); a longer line in pieces of that size."""
    lines = text.splitlines()
    bounds = chunk_bounds(np.array([len(x) + 1 for x in lines], np.int64), max_chars)
    chunks = ["\n".join(lines[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [c[i : i + max_chars] for c in chunks for i in range(0, max(len(c), 1), max_chars)]


def _schema(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def chunk_transcripts(transcripts: DataFrame, max_chars: int, by: tuple[str, ...] = ("provider", "file")) -> DataFrame:
    """by, chunk_index (from one), chunk_total, text. Chunks of a text are found one after the other, those of all texts in parallel."""
    chosen = transcripts.select(*by, F.coalesce("text", F.lit("")).alias("text"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE_ROWS, PIECE_BYTES):
            found = pa.array([chunk_text(t, max_chars) for t in batch.column(len(by)).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*by, "c"])

    found = chosen.mapInArrow(chunk, _schema(chosen, by) + ", c array<string>")
    chunks = found.select(*by, F.size("c").alias("chunk_total"), F.posexplode("c").alias("i", "text"))
    return chunks.select(*by, (F.col("i") + 1).alias("chunk_index"), "chunk_total", "text")


def render_prompt(text: Column, index: Column | None = None, total: Column | None = None, template: str = DEFAULT_TEMPLATE) -> Column:
    """The template with transcript and chunk numbers filled in; a transcript is appended where it has no place for one,
    and Markdown asked for where it is not."""
    if "markdown" not in template.lower() and ".md" not in template.lower():
        template = template.rstrip() + "\n\nOutput Markdown (.md).\n"
    if "{{transcript}}" not in template:
        template = template.rstrip() + "\n\nTranscript:\n{{transcript}}\n"
    number = lambda c: F.lit("") if c is None else c.cast("string")
    out = F.replace(F.lit(template), F.lit("{{chunk_index}}"), number(index))
    out = F.replace(out, F.lit("{{chunk_total}}"), number(total))
    return F.replace(out, F.lit("{{transcript}}"), text)


def first_sentences(n: int = 3) -> Summariser:
    """A summariser that needs no model: the first sentences of the prompt."""
    return lambda prompts: prompts.str.findall(r"[^.!?\n]+[.!?]?").map(lambda s: " ".join(x.strip() for x in s[:n]))


def _summarised(df: DataFrame, prompt: Column, summarise: Summariser, keep: tuple[str, ...]) -> DataFrame:
    chosen = df.select(*keep, prompt.alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE_ROWS, PIECE_BYTES):
            said = summarise(batch.column(len(keep)).to_pandas().rename("prompt")).astype(str)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said.to_numpy(), pa.string())], names=[*keep, "summary"])

    return chosen.mapInArrow(run, _schema(chosen, keep) + ", summary string")


_ANSWERS = "digest string, summary string, error string"


def _answered(df: DataFrame, prompt: Column, summarise: Summariser, keep: tuple[str, ...], answers: str, prompts_per_task: int) -> DataFrame:
    """The same by way of a table of answers, keyed by a digest of the prompt (template and text): only prompts without one are asked.

    A task asks few prompts. If asking fails, the error is kept as a row and raised when all tasks have ended, so that no other answer is
    lost; what a task wrote stays also if the job dies (Hadoop's committer of version 2).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield pd.DataFrame({"digest": batch["digest"], "summary": summarise(batch["prompt"]).astype(str).to_numpy(), "error": None})
            except Exception as e:  # noqa: BLE001  whatever the user's model raises is raised again below
                yield pd.DataFrame({"digest": batch["digest"], "summary": None, "error": repr(e)})

    spark = df.sparkSession
    asked = materialise(df.select(*keep, prompt.alias("prompt")).withColumn("digest", F.sha2("prompt", 256)), "prompts")
    path, fs = hadoop_path(spark, answers)
    read = lambda: spark.read.schema(_ANSWERS).parquet(answers) if fs.exists(path) else spark.createDataFrame([], _ANSWERS)
    new = asked.select("digest", "prompt").dropDuplicates(["digest"]).join(read().where("error IS NULL"), "digest", "left_anti")
    new = materialise(new, "new-prompts")
    if n := new.count():
        dealt = new.repartition(-(-n // prompts_per_task)).mapInPandas(run, _ANSWERS)
        dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(answers)
    known = read().where("error IS NULL").groupBy("digest").agg(F.min("summary").alias("summary"))
    failed = new.join(known, "digest", "left_anti").join(read().where("error IS NOT NULL"), "digest").select("error").first()
    if failed is not None:
        raise RuntimeError(f"prompts stay without an answer; one of the errors: {failed.error}")
    return asked.join(known, "digest").select(*keep, "summary")


def _joined(summaries: DataFrame, by: tuple[str, ...]) -> DataFrame:
    part = F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"), F.lit("/"), F.col("chunk_total").cast("string"), F.lit(" summary:\n"), F.col("summary"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("t")))), lambda x: x["t"])
    return summaries.groupBy(*by).agg(F.array_join(ordered, "\n\n").alias("text"))


def map_reduce_summarise(transcripts: DataFrame, summarise: Summariser, max_chars: int, mode: str = "chrono", template: str = DEFAULT_TEMPLATE, by: tuple[str, ...] = ("provider", "file"), answers: str | None = None, prompts_per_task: int = 16) -> DataFrame:
    """by, summary. ``chrono``: a labelled summary of every chunk. ``reduce``: while the joined summaries are over
    ``max_chars``, chunk and summarise them again (at most MAX_PASSES times), then consolidate; what fits at once is one call.

    Every pass of ``reduce`` is a written table, so that a model is asked once for a prompt, whatever is lost or read again.
    answers: a folder, one for each model (a run's, say), in which answers are kept as they come. A run that failed half-way goes on from there and asks no
    answered prompt again (prompts of one task, ``prompts_per_task`` at most, fail together).

    The numbers are filled into the template before the transcript, so that placeholders inside a transcript stay text.
    """

    def ask(df: DataFrame, prompt: Column, keep: tuple[str, ...]) -> DataFrame:
        return _summarised(df, prompt, summarise, keep) if answers is None else _answered(df, prompt, summarise, keep, answers, prompts_per_task)

    prompt = render_prompt(F.col("text"), F.col("chunk_index"), F.col("chunk_total"), template)
    keep = (*by, "chunk_index", "chunk_total")

    def summaries(texts: DataFrame) -> DataFrame:
        return ask(chunk_transcripts(texts, max_chars, by), prompt, keep)

    if mode == "chrono":
        return _joined(summaries(transcripts), by).withColumnRenamed("text", "summary")
    texts = materialise(transcripts.select(*by, "text"), "transcripts")
    over = texts.where(F.length("text") > max_chars)
    short = texts.where(F.length("text") <= max_chars)
    for _ in range(MAX_PASSES + 1):
        if over.isEmpty():
            break
        joined = _joined(materialise(summaries(over), "summaries"), by)
        over, short = joined.where(F.length("text") > max_chars), short.unionByName(joined.where(F.length("text") <= max_chars))
    return ask(short.unionByName(over), render_prompt(F.col("text"), template=template), by)


def joined_digests(digests: DataFrame) -> DataFrame:
    """query_id, text: the digests of each query as one text, in the order of provider and file."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("provider", "file", "text"))), lambda x: x["text"])
    return digests.groupBy("query_id").agg(F.array_join(parts, "\n\n---\n\n").alias("text"))


def conversation_digests(turns: DataFrame, spans: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, provider, file, text: a dated header and the full windowed turns of every conversation with hits."""
    inside = fetch_windows(turns, spans)
    line = F.struct("msg_index", rendered().alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n")
    body = inside.groupBy("query_id", "provider", "file").agg(text.alias("body"))
    dated = body.join(files.select("provider", F.col("path").alias("file"), "mtime"), ["provider", "file"], "left")
    project = F.nullif(project_of(), F.lit(""))
    head = F.concat(F.lit("[Session: "), F.concat_ws(" | ", F.date_format("mtime", "yyyy-MM-dd HH:mm"), "provider", F.substring_index("file", "/", -1), project), F.lit("]\n"))
    return dated.select("query_id", "provider", "file", F.concat(head, rstrip(F.col("body"))).alias("text"))
