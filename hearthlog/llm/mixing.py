"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source has a weight; together they share ``share`` times the size of the whole corpus. No source
gets more than ``max_epochs`` times its size: what is above is dealt to the others by weight, until none
is above. Documents of a source are then taken whole as often as all of it fits the target; the rest
goes to documents in the order of a seeded hash, each once more, until the target is reached. The last
one is taken in part (documents with the same id share that part), so that a source's words meet its
target but for rounding.

The place in seeded order where the target is reached is found from sums over 4,096 hash ranges a
source, then inside the one range that holds it; no task sees all documents of a source.

Defined cases: null text has size 0; a null source is a source, last in order; repeated rows are rows
of their own; with a total of 0 all targets are 0; an empty table gives an empty result. Internal
columns are made from id, text and source alone, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def seeded(id_: Column, seed: int) -> Column:
    """15 hex digits of a hash of the id: the seeded order."""
    return F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 15)


def _ranked(sources: DataFrame) -> DataFrame:
    """The place of each source by code point, null last, counted over sorted ranges."""
    placed = materialise(
        sources.repartitionByRange(F.col("no_source"), F.col("source_key")).sortWithinPartitions("no_source", "source_key").withColumn("m", F.monotonically_increasing_id()),
        "sources",
    ).withColumn("range", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND(2**33 - 1))
    before = placed.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before.select("range", "before"), "range").withColumn("rank", F.col("before") + F.col("at")).drop("m", "range", "at", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """no_source, source_key, source_size, target of each source.

    sizes: rows with no_source, source_key and size. Each round fixes the sources whose share would be
    above their limit; the driver sees three sums a round.
    """
    sources = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(_ranked(sources).withColumn("w", weight).withColumn("most", max_epochs * F.col("source_size")), "weighted-sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, fixed = 0.0, -1
    while True:
        full = F.col("w") * level >= F.col("most")
        row = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"), F.count_if(full).alias("n")).first()
        if row.n == fixed or not row.open:
            break
        fixed, level = row.n, (total - row.held) / row.open
    return ranked.select("no_source", "source_key", "source_size", F.least(F.col("w") * level, F.col("most")).alias("target") if total else F.lit(0.0).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words, repeats counted) of every row, and its ``row_col`` if given."""
    key, row = seeded(F.col(id_col), seed), [row_col] if row_col else []
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col), F.lit("")).alias("source_key"), key.alias("u"), F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("range"), *row,
        ),
        "sizes",
    )
    by = ["no_source", "source_key"]
    aims = targets(rows, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = materialise(aims.withColumn("whole", whole).withColumn("rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")), "targets")

    # the hash range in which the rest of each source is used up, then the key in it
    upto = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = rows.groupBy(*by, "range").agg(F.sum("size").alias("n")).withColumn("sum", F.sum("n").over(upto))
    edge = ranges.join(aims, by).where((F.col("sum") >= F.col("rest")) & (F.col("sum") - F.col("n") < F.col("rest"))).select(*by, "range", (F.col("rest") - F.col("sum") + F.col("n")).alias("left"))
    upto = Window.partitionBy(*by).orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.join(edge, [*by, "range"]).groupBy(*by, "u").agg(F.sum("size").alias("n"), F.first("left").alias("left")).withColumn("sum", F.sum("n").over(upto))
    cut = inside.where((F.col("sum") >= F.col("left")) & (F.col("sum") - F.col("n") < F.col("left"))).select(*by, F.col("u").alias("edge"), (F.col("left") - F.col("sum") + F.col("n")).alias("part"), F.col("n").alias("of"))
    plan = materialise(aims.join(cut, by, "left"), "mix-plan")
    extra = F.when(F.col("edge").isNull(), 0).when(F.col("u") < F.col("edge"), F.col("size")).when(F.col("u") == F.col("edge"), F.floor(F.col("size") * F.col("part") / F.col("of"))).otherwise(0)
    return rows.join(plan, by).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), *row)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", written: bool = False, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole repetition of a document, and one with the
    first words (joined by a space) for a repetition in part. Each row is repeated by its own plan, whatever its id.

    written: docs is a written table, whose rows are numbered where they stand; otherwise a copy is written first.
    """
    mark = free_name(docs, "__mix")
    row, size, taken, part = (f"{mark}{x}" for x in ("row", "size", "taken", "part"))
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    rows = rows if written else materialise(rows, "mix-rows")
    plan = plan_mix(rows, id_col=id_col, text_col=text_col, source_col=source_col, row_col=row, **how)
    each = plan.select(row, F.col("size").alias(size), F.col("taken").alias(taken))
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), 0), 1, F.col(part).cast("int")), " ")
    times = F.when(F.col(size) > 0, F.floor(F.col(taken) / F.col(size))).otherwise(0)
    rest = F.col(taken) - times * F.col(size)
    parts = F.concat(F.array_repeat(F.col(size), times.cast("int")), F.array_repeat(rest, (rest > 0).cast("int")))
    repeated = rows.join(each, row).withColumn(part, F.explode(parts))
    text = F.when(F.col(part) < F.col(size), words).otherwise(F.col(text_col))
    return repeated.withColumn(text_col, text).select(*docs.columns)
