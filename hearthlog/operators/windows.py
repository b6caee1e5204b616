"""Context windows around hits: merged intervals and what lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns on either side of a hit by verbosity (fixed values).
VERBOSITY_WINDOW = {1: 0, 2: 1, 3: 2, 4: 4, 5: 6, 6: 8, 7: 12, 8: 16, 9: 24, 10: 40}
OTHER_WINDOW = 6


def window_for(verbosity: int) -> int:
    return VERBOSITY_WINDOW.get(verbosity, OTHER_WINDOW)


def window_spans(hits: DataFrame, w: int, by: tuple[str, ...] = ("query_id", "provider", "file")) -> DataFrame:
    """by, start, end: [i - w, i + w] of every hit, from one up; overlapping and adjacent spans merged."""
    spans = hits.select(*by, F.greatest(F.lit(1), F.col("msg_index") - w).cast("long").alias("start"), (F.col("msg_index") + w).cast("long").alias("end"))
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", (before.isNull() | (F.col("start") > before + 1)).cast("int"))
    island = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def fetch_windows(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """query_id, start and the turns inside each span: a hash join on the file with the range as residual."""
    s = spans.withColumnRenamed("provider", "p").withColumnRenamed("file", "f")
    inside = (turns["provider"] == s["p"]) & (turns["file"] == s["f"]) & turns["msg_index"].between(s["start"], s["end"])
    return turns.join(s, inside).select("query_id", "provider", "file", "start", "msg_index", "role", "text")


def project_of(path: str = "file"):
    gemini = F.when(F.col(path).contains("/.gemini/"), "gemini-session")
    return F.coalesce(gemini, F.nullif(F.regexp_extract(path, r"/\.claude/projects/([^/]+)", 1), F.lit("")), F.lit(""))


def conversation_hits(hits: DataFrame) -> DataFrame:
    """query_id, provider, file, project, n_hits, n_total, first_rank: hits of each conversation."""
    each = hits.groupBy("query_id", "provider", "file").agg(F.count("*").alias("n_hits"), F.min("rank").alias("first_rank"))
    total = F.sum("n_hits").over(Window.partitionBy("query_id"))
    return each.withColumn("n_total", total).withColumn("project", project_of())


def compact_hits(hits: DataFrame, text: str = "snip") -> DataFrame:
    """One line per hit: provider, short name, index, role and the first 200 characters."""
    short = F.substring_index("file", "/", -1)
    line = F.concat_ws(" ", "provider", short, F.col("msg_index").cast("string"), "role", F.translate(F.substring(text, 1, 200), "\n", " "))
    return hits.select("query_id", "rank", line.alias("line"))
