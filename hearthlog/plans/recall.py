"""User-facing compositions: recall, transcript reports, search with commits, clean reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.operators import clean, mentions, search, windows
from hearthlog.sources.written import materialise


@dataclass
class Recall:
    hits: DataFrame
    spans: DataFrame
    turns: DataFrame
    conversations: DataFrame


def recall(index: search.Index, queries: DataFrame, k: int = 20, window: int = 1, n_tokens: int = 250, **restrict) -> Recall:
    """Ranked hits of each provider with snippets, the merged windows around them and the turns inside."""
    ranked = materialise(search.search_per_provider(index, queries, k, **restrict), "hits")
    hits = search.with_turns(search.snippets(ranked, index, queries, n_tokens), index.turns)
    spans = windows.window_spans(ranked, window)
    return Recall(hits, spans, windows.fetch_windows(index.turns, spans), windows.conversation_hits(ranked))


def transcript_report(turns: DataFrame, files: DataFrame, commits: DataFrame, per_provider: int = 1, max_chars: int = 0) -> DataFrame:
    """provider, file, text, section: transcripts of the newest conversations, and the commits they mention."""
    from hearthlog.sources.logs import latest_sessions

    chosen = latest_sessions(files, per_provider).select(F.col("path").alias("file"), "provider")
    kept = clean.clean_turns(turns.join(chosen, ["provider", "file"], "left_semi"))
    section = mentions.commit_section(mentions.resolve_commits(mentions.scan_commits(kept), commits))
    return clean.render_transcript(kept, max_chars).join(section, ["provider", "file"], "left")


def search_with_commits(index: search.Index, queries: DataFrame, mode: str = "forward", k: int = 20, span: int = mentions.SPAN) -> DataFrame:
    """Deduplicated top hits with the commit mention that ``mode`` asks for: direct, forward, backward, between or auto."""
    hits = search.dedupe_hits(search.with_turns(search.bm25_topk(index, queries, k), index.turns))
    if mode == "direct":
        return mentions.direct_mention(hits)
    found = mentions.commit_mentions(index.turns)
    if mode in ("between", "auto"):
        return mentions.between_mention(hits, found, span, auto=mode == "auto")
    return mentions.nearest_mention(hits, found, mode, span)


def clean_report(turns: DataFrame, query: str | None = None, max_chars: int = 0, include_inline: bool = False) -> DataFrame:
    """provider, file, text: transcripts of tidy, filtered turns without repeats. Artifacts stay, as in the turns themselves.

    include_inline: the commands in each turn of a user or assistant that fit the query follow it, also where the
    turn itself is a repeat or does not fit. Turns are filtered as a whole, commands are taken from what is shown of them.
    """
    tidy = clean.clean_turns(turns, artifacts=False)
    shown = tidy.withColumn("full", F.col("text")).withColumn("text", clean.truncated(F.col("text"), max_chars))
    fits = F.contains(F.lower("full"), F.lit(query.lower())) if query else F.lit(True)
    lines = clean.collapse_repeats(shown.where(fits)).select(*clean.BY_FILE, "msg_index", F.lit(0).alias("at"), "role", "text")
    if include_inline:
        commands = clean.contains_filter(clean.extract_inline_commands(shown).withColumnRenamed("command", "text"), query)
        lines = lines.unionByName(commands.select(*clean.BY_FILE, "msg_index", F.col("ordinal").alias("at"), F.lit("cmd").alias("role"), "text"))
    return clean.render_lines(lines, ("msg_index", "at"))
