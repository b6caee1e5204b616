"""Tables in hash buckets of a key, changed by commits: readers see all of a change or nothing of it.

Rows lie in ``table/generation=.../bucket=...``. A commit is one small JSON file, ``commits/<number>.json``, that names the
generations of each bucket of each table. A change writes a new generation first (only the buckets that it
touches: rewritten where rows go, added to where rows only come), and then the commit, which appears by one rename that
fails if that number is taken. So a run that dies before it leaves the old rows readable, and a rerun gives the
same table; of two runs at once one fails. Buckets of many generations are rewritten on the way. What comes to the driver is bounded by
tables, buckets and generations, never by keys.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.sources.written import hadoop_path

Buckets = dict[str, list[str]]


@dataclass(frozen=True)
class Commit:
    number: int
    tables: dict[str, Buckets]


def _commit_path(path: str, number: int) -> str:
    return f"{path}/commits/{number:020d}.json"


def last_number(spark: SparkSession, path: str) -> int:
    """The number of the last commit below a path; zero before the first one."""
    folder, fs = hadoop_path(spark, f"{path}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)


def load(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(_commit_path(path, number), wholetext=True).first().value)


def publish(spark: SparkSession, path: str, number: int, row: dict) -> None:
    """Make a commit appear: written aside, then renamed, which fails if the number is taken."""
    jvm = spark.sparkContext._jvm
    target, fs = hadoop_path(spark, _commit_path(path, number))
    made, _ = hadoop_path(spark, f"{path}/commits/.{number}-{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(row | {"number": number}, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(fs.makeQualified(made), fs.makeQualified(target), options)


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "file", most_generations: int = 8):
        self.spark, self.path, self.buckets, self.key, self.most = spark, path.rstrip("/"), buckets, key, most_generations

    def latest(self) -> Commit:
        """The last commit; number zero and no tables before the first one."""
        number = last_number(self.spark, self.path)
        if not number:
            return Commit(0, {})
        row = load(self.spark, self.path, number)
        if row["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {row['buckets']} buckets, not {self.buckets}")
        return Commit(number, row["tables"])

    def read(self, table: str, schema: str, commit: Commit | None = None) -> DataFrame:
        """The rows of a table as of a commit (the last one)."""
        return self._rows(table, schema, (commit or self.latest()).tables.get(table, {}))

    def replace(self, changes: dict[str, tuple[DataFrame | None, DataFrame]], base: Commit | None = None) -> Commit:
        """One commit of changes to tables: (keys whose rows go, rows that come). base: the commit that the changes were made from."""
        base = base or self.latest()
        tables = {name: dict(held) for name, held in base.tables.items()}
        for table, (gone, new) in changes.items():
            held = tables.get(table, {})
            full = {b for b, generations in held.items() if len(generations) >= self.most}
            touched = full if gone is None else full | {str(r.bucket) for r in gone.select(self._bucket().alias("bucket")).distinct().collect()}
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
            old = self._rows(table, schema, {b: g for b, g in held.items() if b in touched})
            if gone is not None:
                old = old.join(gone.select(self.key).distinct(), self.key, "left_anti").select(*new.columns)
            generation = uuid.uuid4().hex
            kept = {b: g for b, g in held.items() if b not in touched}
            for b in self._write(table, old.unionByName(new), generation):
                kept[b] = [*kept.get(b, []), generation]
            tables[table] = kept
        commit = Commit(base.number + 1, tables)
        publish(self.spark, self.path, commit.number, {"buckets": self.buckets, "tables": tables})
        return commit

    def vacuum(self) -> int:
        """Delete generations and commits that the last commit does not name; how many generations went. No run may be under way."""
        last = self.latest()
        known, gone = {g for t in last.tables.values() for gs in t.values() for g in gs}, 0
        root, fs = hadoop_path(self.spark, self.path)
        for table in fs.listStatus(root) if fs.exists(root) else []:
            for generation in fs.listStatus(table.getPath()) if table.isDirectory() else []:
                name = generation.getPath().getName()
                if name.startswith("generation=") and name.removeprefix("generation=") not in known or name.endswith(".json") and name != f"{last.number:020d}.json":
                    fs.delete(generation.getPath(), True)
                    gone += name.startswith("generation=")
        return gone

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self, table: str, schema: str, held: Buckets) -> DataFrame:
        paths = [f"{self.path}/{table}/generation={g}/bucket={b}" for b, generations in sorted(held.items()) for g in generations]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, table: str, rows: DataFrame, generation: str) -> list[str]:
        """Write a generation; the buckets that it has. Rebalancing splits a bucket that holds much into several files."""
        path = f"{self.path}/{table}/generation={generation}"
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        folder, fs = hadoop_path(self.spark, path)
        return [n.removeprefix("bucket=") for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("bucket=")]
