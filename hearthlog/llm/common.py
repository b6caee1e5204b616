"""What the corpus operators share: the shared folder, written intermediate tables, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.functions.batches import pieces
from hearthlog.sources.written import fresh_path, materialise, release, shared_dir

__all__ = ["NULL_ID", "WORD", "free_name", "fresh_path", "id_back", "id_key", "materialise", "pieces", "release", "shared_dir", "table"]

#: A word is a run of characters other than space, tab, newline, VT, FF and CR.
#: ``bytes.split()`` without arguments splits UTF-8 text by the same rule.
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null id inside operators; results carry null again.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column starts with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def id_key(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def id_back(col: str) -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))
