"""Keyed tables as Parquet folders: projects, memories, sessions, plans and checkpoints.

Parquet has no update, so a change is an anti-join and a union written beside
the table and then swapped in.  The whole table is rewritten: these tables are
small beside the data they describe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import cached_plan, upsert


class Store:
    """A Parquet table with keys, split by `partition` if that is given."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], partition: str | None = None):
        self.spark, self.path, self.schema, self.keys, self.partition = spark, path, schema, keys, partition
        self.versions = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self.versions.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        if not self._fs().exists(self.versions):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _swap(self, df: DataFrame) -> None:
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        new, old = jvm.org.apache.hadoop.fs.Path(self.path + ".new"), jvm.org.apache.hadoop.fs.Path(self.path + ".old")
        out = df.write.mode("overwrite")
        (out.partitionBy(self.partition) if self.partition else out).parquet(self.path + ".new")
        fs.delete(old, True)
        if fs.exists(self.versions):
            fs.rename(self.versions, old)
        fs.rename(new, self.versions)
        fs.delete(old, True)

    def put(self, rows: DataFrame, newest: str | None = None) -> None:
        """Inserts, or replaces rows of equal keys; of several new ones the newest."""
        now = self.read()
        merged = upsert(now, rows.select(now.columns), self.keys, newest)
        self._swap(merged)

    def get(self, **key) -> DataFrame:
        df = self.read()
        for k, v in key.items():
            df = df.where(F.col(k) == v)
        return df

    def delete(self, **key) -> None:
        hit = F.lit(True)
        for k, v in key.items():
            hit &= F.col(k).eqNullSafe(F.lit(v))
        self._swap(self.read().where(~hit))

    def reset(self) -> None:
        """Empties the table."""
        self._swap(self.spark.createDataFrame([], self.schema))

    def newest(self, by: str, n: int) -> DataFrame:
        return self.read().orderBy(F.desc(by), *self.keys).limit(n)

    def counts(self, by: str) -> DataFrame:
        return self.read().groupBy(by).count().orderBy(F.desc("count"), by)


def tables_of(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder: the folders in it that aren't hidden or left over from a change."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else []
    names = [s.getPath().getName() for s in found if s.isDirectory()]
    return sorted(n for n in names if n[0] not in "._" and not n.endswith((".new", ".old")))


def reset_all(spark: SparkSession, folder: str) -> list[str]:
    """Empties every table of a folder, each keeps its columns; returns their names."""
    names = tables_of(spark, folder)
    for n in names:
        path = f"{folder}/{n}"
        Store(spark, path, spark.read.parquet(path).schema.simpleString()[7:-1].replace(":", " "), []).reset()
    return names


def replace_stage(session: DataFrame, stage: str, lines) -> DataFrame:
    """A session row's array `stages` of struct(name, lines) with one stage put in place, last."""
    kept = F.filter("stages", lambda s: s["name"] != stage)
    return session.withColumn("stages", F.concat(kept, F.array(F.struct(F.lit(stage).alias("name"), lines.alias("lines")))))


def accumulate(memory: Store, source: DataFrame, target: DataFrame, on: list[str], series: str, at) -> None:
    """Lines whose source and target both have text go into a translation memory."""
    s, t = source.select(*on, F.col("text").alias("source_text")), target.select(*on, F.col("text").alias("target_text"))
    rows = s.join(t, on).where("trim(source_text) <> '' and trim(target_text) <> ''")
    memory.put(rows.select(F.lit(series).alias("series_key"), "source_text", "target_text", at.alias("updated_at")).dropDuplicates(["series_key", "source_text"]), "updated_at")


def resume(store: Store, request: str, stage: str, expected: int) -> DataFrame | None:
    """The stored lines of a stage, if there are as many as expected."""
    rows = store.get(request=request, stage=stage)
    return rows if rows.count() == expected else None


def plan_rows(store: Store, signature: str, wanted: int) -> DataFrame:
    return cached_plan(store.read(), signature, wanted, "chunk")


def write_summary(df: DataFrame, path: str, order: list[str]) -> None:
    """A CSV with header, in order."""
    df.orderBy(*order).coalesce(1).write.option("header", True).csv(path)
