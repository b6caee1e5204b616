"""Cleaning, filtering and rendering of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.text import one_line, split_lines, strip, tidy_lines

#: Texts that providers put before a user's own words.
PREAMBLES = {
    "codex": ("# AGENTS.md instructions", "<INSTRUCTIONS>", "<environment_context>"),
    "claude": ("Caveat: The messages below were generated by the user while running local commands.", "<command-name>", "<local-command-stdout>"),
}
#: Names of tags that tools inject, and decorated blocks.
ARTIFACT_TAG = r"[\w-]*(?:hook|reminder|caveat|notification|function[\w_]*|teammate-message)[\w-]*"
ARTIFACTS = rf"(?sU)<(?:{ARTIFACT_TAG})[^>]*>.*?</(?:{ARTIFACT_TAG})>"
INSIGHTS = r"(?s)`★ Insight[^`]*`\n.*?`─+`"

BY_FILE = ("provider", "file")


def is_preamble(provider: Column, role: Column, text: Column) -> Column:
    def holds(marks: tuple[str, ...]) -> Column:
        return F.greatest(*[text.contains(m) for m in marks])

    codex, claude = holds(PREAMBLES["codex"]), holds(PREAMBLES["claude"])
    return (role == "user") & F.when(provider == "codex", codex).when(provider == "claude", claude).otherwise(codex | claude)


def strip_artifacts(text: Column) -> Column:
    tags = F.when(text.contains("</"), F.regexp_replace(text, ARTIFACTS, "")).otherwise(text)
    insights = F.when(text.contains("★ Insight"), F.regexp_replace(tags, INSIGHTS, "")).otherwise(tags)
    squeezed = F.when(insights.contains("\n\n\n"), F.regexp_replace(insights, r"\n{3,}", "\n\n")).otherwise(insights)
    return strip(squeezed)


def _once(df: DataFrame, text: Column) -> DataFrame:
    """df with a new text, computed once: filters on it are not pushed below a generator, which would compute it again in each."""
    return df.withColumn("text", F.explode(F.array(text)))


def clean_turns(turns: DataFrame, artifacts: bool = True) -> DataFrame:
    """Tidy lines; drop empty turns and users' preambles; strip artifacts; number the survivors of each file from one."""
    out = _once(turns, tidy_lines(F.coalesce("text", F.lit("")))).where("text <> ''").where(~F.coalesce(is_preamble(F.col("provider"), F.col("role"), F.col("text")), F.lit(False)))
    if artifacts:
        out = _once(out, strip_artifacts(F.col("text"))).where("text <> ''")
    return out.withColumn("msg_index", F.row_number().over(Window.partitionBy(*BY_FILE).orderBy("msg_index")).cast("long"))


def contains_filter(turns: DataFrame, query: str | None) -> DataFrame:
    return turns if not query else turns.where(F.contains(F.lower("text"), F.lit(query.lower())))


def truncated(text: Column, max_chars: int) -> Column:
    return text if not max_chars else F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("…"))).otherwise(text)


def collapse_repeats(turns: DataFrame) -> DataFrame:
    """Without turns that repeat the role and text (white space apart) of the one before."""
    key = F.struct(F.col("role"), one_line(F.col("text")))
    before = F.lag(key).over(Window.partitionBy(*BY_FILE).orderBy("msg_index"))
    return turns.withColumn("same", F.coalesce(before == key, F.lit(False))).where(~F.col("same")).drop("same")


def result_command(text: Column) -> Column:
    """The command of the first line that starts with a prompt, ``command:`` or ``cmd:``; else null."""
    lines = F.transform(split_lines(text), strip)
    first = F.get(F.filter(lines, lambda x: x.rlike(r"(?i)^(?:[$>] |command:|cmd:)")), F.lit(0))
    return strip(F.regexp_replace(first, r"(?i)^(?:[$>] |command:|cmd:)", ""))


def extract_result_commands(turns: DataFrame) -> DataFrame:
    return turns.withColumn("command", result_command(F.col("text"))).where(F.col("command").isNotNull()).select(*BY_FILE, "msg_index", "command")


def inline_commands(text: Column) -> Column:
    """Commands of shell fences, then of prompt lines, each once."""
    fences = F.regexp_extract_all(text, F.lit(r"(?is)```(?:bash|sh|zsh|shell)?\n(.*?)```"), 1)
    bare = lambda x: F.when(x.rlike(r"^[$>] "), strip(F.substring(x, 3, 1 << 30))).otherwise(x)
    fenced = F.transform(F.filter(F.flatten(F.transform(fences, lambda f: F.transform(split_lines(f), strip))), lambda x: x != ""), bare)
    prompts = F.transform(F.filter(F.transform(split_lines(text), strip), lambda x: x.rlike(r"^[$>] ")), bare)
    return F.array_distinct(F.filter(F.concat(fenced, prompts), lambda x: x != ""))


def extract_inline_commands(turns: DataFrame) -> DataFrame:
    found = turns.where(F.col("role").isin("user", "assistant")).select(*BY_FILE, "msg_index", F.posexplode(inline_commands(F.col("text"))).alias("at", "command"))
    return found.select(*BY_FILE, "msg_index", (F.col("at") + 1).alias("ordinal"), "command")


def rendered(max_chars: int = 0) -> Column:
    """A turn as text: commands on one line, others below a label; assistants go by their provider."""
    text = truncated(F.col("text"), max_chars)
    label = F.when(F.col("role") == "assistant", F.col("provider")).otherwise(F.col("role"))
    return F.when(F.col("role") == "cmd", F.concat(F.lit("cmd: "), one_line(text))).otherwise(F.concat(label, F.lit(":\n"), text, F.lit("\n")))


def render_lines(turns: DataFrame, order: tuple[str, ...], max_chars: int = 0) -> DataFrame:
    line = turns.select(*BY_FILE, F.struct(*order, rendered(max_chars).alias("t")).alias("x"))
    return line.groupBy(*BY_FILE).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


def render_transcript(turns: DataFrame, max_chars: int = 0) -> DataFrame:
    """provider, file, text: one transcript per conversation, in order."""
    return render_lines(turns, ("msg_index",), max_chars)
