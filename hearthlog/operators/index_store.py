"""An index in generations: an update writes what changed, readers see one commit, a merge makes one generation of all.

Each generation has the tables of ``operators.search`` for the turns that it brought, and ``replaced``: the files whose rows in earlier
generations no longer count (new, grown, rewritten and vanished ones alike). A commit names the generations in order. On
reading, an anti join of their union with the last generation that replaced each file leaves what counts, so that scores
are those of a full build.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.operators.search import Index, build_index, write_tables
from hearthlog.sources.store import last_number, load, publish
from hearthlog.sources.written import hadoop_path, release

_TABLES = ("turns", "postings", "turn_stats")


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = ("text",), most_generations: int = 8):
        self.spark, self.path, self.columns, self.most = spark, path.rstrip("/"), columns, most_generations

    def generations(self) -> list[str]:
        """Those of the last commit, the oldest first; none before the first one."""
        number = last_number(self.spark, self.path)
        return load(self.spark, self.path, number)["generations"] if number else []

    def update(self, turns: DataFrame, changed: DataFrame | None = None) -> None:
        """Turns of changed files (``file``: new, grown, rewritten, or vanished and so without turns) as a generation. Without
        ``changed`` they are the files of the turns. Beyond ``most_generations`` all are merged."""
        number, known = last_number(self.spark, self.path), self.generations()
        name = self._write(build_index(turns, self.columns), turns.select("file") if changed is None else changed.select("file"))
        publish(self.spark, self.path, number + 1, {"generations": [*known, name]})
        if len(known) + 1 > self.most:
            self.merge()

    def merge(self) -> None:
        """One generation of all that counts."""
        number = last_number(self.spark, self.path)
        if number:
            name = self._write(self.read(), self.spark.createDataFrame([], "file string"))
            publish(self.spark, self.path, number + 1, {"generations": [name]})

    def read(self) -> Index:
        names = self.generations()
        if not names:
            raise FileNotFoundError(f"no index at {self.path}")
        read = lambda table: [self.spark.read.parquet(f"{self.path}/{g}/{table}").withColumn("gen", F.lit(i)) for i, g in enumerate(names)]
        whole = {table: reduce(DataFrame.unionByName, read(table)) for table in (*_TABLES, "terms", "replaced")}
        if len(names) > 1:
            last = whole["replaced"].groupBy(F.col("file").alias("gone")).agg(F.max("gen").alias("at"))
            for table in _TABLES:
                df = whole[table]
                whole[table] = df.join(last, (df["file"] == last["gone"]) & (df["gen"] < last["at"]), "left_anti")
        return Index(*(whole[table].drop("gen") for table in _TABLES), whole["terms"])

    def vacuum(self) -> int:
        """Delete generations that the last commit does not name; how many. No run may be under way."""
        known, gone = {*self.generations(), "commits"}, 0
        folder, fs = hadoop_path(self.spark, self.path)
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in known:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def _write(self, index: Index, replaced: DataFrame) -> str:
        name = f"generation-{uuid.uuid4().hex}"
        write_tables(index, f"{self.path}/{name}")
        replaced.distinct().write.parquet(f"{self.path}/{name}/replaced")
        return name

