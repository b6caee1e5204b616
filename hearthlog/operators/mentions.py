"""Commit mentions in turns, and the mention nearest to a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns: words that speak of commits, phrases that tell of one made.
CONTEXT = r"(?i)\b(commit|pushed|merge|sha|hash)\b"
ACTIONS = (r"\bcommitted\b", r"\bpushed\b", r"\bcommit:\b", r"\bchanges committed\b", r"\bcommitted\s+\+\s+pushed\b", r"\bcommit\b.*\b(pushed|push)\b")
HASH = r"\b([0-9a-f]{7,40})\b"
SPAN = 200
_FAR = 1 << 40


def hashes(text: Column, need_context: bool = True, action_only: bool = False) -> Column:
    """Distinct abbreviated hashes in order of appearance; none without the words asked for."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(HASH), 1))
    ok = F.lit(True)
    if need_context:
        ok = ok & text.rlike(CONTEXT)
    if action_only:
        ok = ok & text.rlike("(?id)" + "|".join(f"(?:{a})" for a in ACTIONS))
    return F.when(ok, found).otherwise(F.array().cast("array<string>"))


def commit_mentions(turns: DataFrame, need_context: bool = True, action_only: bool = False, role: str | None = None) -> DataFrame:
    kept = turns if role is None else turns.where(F.col("role") == role)
    return kept.withColumn("hashes", hashes(F.col("text"), need_context, action_only)).where(F.size("hashes") > 0).select("provider", "file", "msg_index", "role", "hashes", "text")


def scan_commits(turns: DataFrame, start: int = 1, end: int | None = None, last: int | None = None, **how) -> DataFrame:
    """Mentions with start <= msg_index <= end; ``last``: among the last so many turns of each file instead."""
    if last is not None:
        turns = turns.withColumn("top", F.max("msg_index").over(Window.partitionBy("provider", "file"))).where(F.col("msg_index") > F.col("top") - last).drop("top")
    turns = turns.where(F.col("msg_index") >= start)
    return commit_mentions(turns if end is None else turns.where(F.col("msg_index") <= end), **how)


def direct_mention(hits: DataFrame) -> DataFrame:
    """Hits whose own text has hashes, whatever its words."""
    return hits.withColumn("hashes", hashes(F.col("text"), need_context=False)).where(F.size("hashes") > 0)


def _beside(hits: DataFrame, mentions: DataFrame, low: int, high: int, name: str) -> DataFrame:
    """hits with the index of the first (from low >= 0) or last (to high <= 0) mention at offsets low..high, or null.

    Hits and mentions of a file stand in one sorted stream, in descending order for what comes after. The nearest mention is the last
    one seen on the way to a row, whose frame only ever grows, and is compared with the span afterwards: one pass for any span.
    """
    by = ("provider", "file")
    marks = mentions.select(*by, F.col("msg_index").alias("i"), F.col("msg_index").alias("mention"), F.lit(None).cast(hits.select(F.struct("*")).schema[0].dataType).alias("hit"))
    asks = hits.select(*by, F.col("msg_index").alias("i"), F.lit(None).cast("long").alias("mention"), F.struct("*").alias("hit"))
    after = low >= 0
    order = Window.partitionBy(*by).orderBy(F.col("i").desc() if after else F.col("i"))
    seen = F.last("mention", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, -low if after else high))
    far = F.col("seen") - F.col("i")
    found = F.when(far.between(low, high), F.col("seen"))
    return marks.unionByName(asks).withColumn("seen", seen).where(F.col("hit").isNotNull()).select("hit.*", found.alias(name))


def nearest_mention(hits: DataFrame, mentions: DataFrame, direction: str = "forward", span: int = SPAN) -> DataFrame:
    """hits with ``mention_index``: the first mention at or after (forward), or the last at or before (backward), within the span.

    A span of zero or less is unlimited forward; backward it looks at the hit alone.
    """
    if direction == "forward":
        return _beside(hits, mentions, 0, span if span > 0 else _FAR, "mention_index")
    return _beside(hits, mentions, -max(span, 0), 0, "mention_index")


def between_mention(hits: DataFrame, mentions: DataFrame, span: int = SPAN, auto: bool = False) -> DataFrame:
    """hits with ``previous_index`` (the last mention before the hit) and ``next_index`` (the first one after that; without
    a previous one, the first in [1, 1 + span])."""
    reach = _FAR if auto or span <= 0 else span
    out = _beside(hits, mentions, -reach, -1, "previous_index")
    marks = mentions.select("provider", "file", F.col("msg_index").alias("m")).distinct()
    after = marks.withColumn("next_index", F.lead("m").over(Window.partitionBy("provider", "file").orderBy("m")))
    first = marks.groupBy("provider", "file").agg(F.min("m").alias("first_index"))
    out = out.join(after.withColumnRenamed("m", "previous_index"), ["provider", "file", "previous_index"], "left").join(first, ["provider", "file"], "left")
    following = F.when(F.col("next_index") - F.col("previous_index") - 1 <= reach, F.col("next_index"))
    start = F.when(F.col("first_index") <= 1 + reach, F.col("first_index"))
    return out.withColumn("next_index", F.when(F.col("previous_index").isNotNull(), following).otherwise(start)).drop("first_index")


def resolve_commits(mentions: DataFrame, commits: DataFrame, branch_only: bool = False, limit: int = 3) -> DataFrame:
    """provider, file, ordinal, hash, repo, sha, summary: each file's first ``limit`` distinct commits.

    commits: repo, sha, on_branch, summary. An abbreviation that several commits of a repository share is no commit
    of it; of several repositories the first by name wins.
    """
    each = mentions.select("provider", "file", "msg_index", F.posexplode("hashes").alias("at", "hash"))
    first = each.groupBy("provider", "file", "hash").agg(F.min(F.struct("msg_index", "at")).alias("seen"))
    known = (commits.where("on_branch") if branch_only else commits).withColumn("start", F.substring("sha", 1, 7))
    wanted = first.select("hash").distinct().withColumn("start", F.substring("hash", 1, 7))
    found = wanted.join(known, "start").where(F.startswith("sha", F.col("hash")))
    one = found.groupBy("hash", "repo").agg(F.count_distinct("sha").alias("n"), F.min(F.struct("sha", "summary")).alias("c")).where("n = 1")
    best = one.groupBy("hash").agg(F.min(F.struct("repo", F.col("c.sha").alias("sha"), F.col("c.summary").alias("summary"))).alias("c"))
    named = first.join(best, "hash").select("provider", "file", "hash", "seen", "c.*")
    named = named.groupBy("provider", "file", "repo", "sha", "summary").agg(F.min_by("hash", "seen").alias("hash"), F.min("seen").alias("seen"))
    ordinal = F.row_number().over(Window.partitionBy("provider", "file").orderBy("seen"))
    return named.withColumn("ordinal", ordinal).where(F.col("ordinal") <= limit).select("provider", "file", "ordinal", "hash", "repo", "sha", "summary")


def commit_section(resolved: DataFrame) -> DataFrame:
    """provider, file, section: the resolved commits of each conversation as text."""
    line = F.concat(F.col("repo"), F.lit(" "), F.col("sha"), F.lit("\n"), F.coalesce("summary", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("t")))), lambda x: x["t"])
    return resolved.groupBy("provider", "file").agg(F.concat(F.lit("git:\n"), F.array_join(lines, "\n")).alias("section"))
