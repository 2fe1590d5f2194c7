"""Session, storage and join helpers of the corpus operators."""

from __future__ import annotations

import atexit
import os
import pickle
import shutil
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and bytes of a join side that is sent to every executor at most; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20
#: Rows of one key that a task of a salted join gets, about.
SALTED_ROWS = 100_000
#: Rows of one range partition, about.
RANGE_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this machine only in local mode, where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cuelake-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of an Arrow batch; Spark's default of 10,000 makes batches of long texts large.
BATCH_ROWS = 2_000


def with_package_path(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed on them, and keeps their batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    # freed arrays go back to the system rather than stay with an idle worker
    for name, value in (("MALLOC_ARENA_MAX", "1"), ("MALLOC_MMAP_THRESHOLD_", str(8 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(16 << 20)), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, parts)])


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: ends lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuelake-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> bool:
    """Lets the driver's JVM return freed native memory (compiler, threads, buffers of results) to the system; False where it
    can't.  The JVM has a command for it from 17.0.9 on, on Linux; a driver that plans many small jobs keeps 170 MB otherwise."""
    jvm = spark._jvm
    try:
        # by reflection on the public interface: the server's own class isn't open to py4j
        (invoke,) = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a table made by cut(); nothing may read it later."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cuelake-" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    with_package_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast; a column that is missing is null.  Clashing extra columns are left out."""
    have = set(df.columns)
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in types.items()))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it is shown to have `limit` rows and `most` bytes at most; otherwise df as it is, for a shuffled join."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind in ("array", "map", "struct"):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("c")))), F.lit(0))
        else:
            size += 16
    rows, held = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if rows <= limit and (held or 0) <= most else df


def salted_join(many: DataFrame, few: DataFrame, key: str | list[str], each: int = SALTED_ROWS) -> DataFrame:
    """many inner join few on a key that few holds once.  Where few isn't small, a key that `many` holds often is dealt over
    tasks of `each` rows about, and few's row for it is repeated as often.  `many` is read twice and should be a table."""
    key = [key] if isinstance(key, str) else key
    side = small_side(few)
    if side is not few:
        return many.join(side, key)
    hot = small_side(cut(many.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / each).alias("_salts")).where("_salts > 1"), "hot"))
    salt = lambda df, how: df.join(hot, key, "left").withColumn("_salt", how).drop("_salts")
    rest = [c for c in many.columns if c not in key]
    left = salt(many, F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_salts")), F.lit(0).cast("long")))
    right = salt(few, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1)))
    return left.join(right, [*key, "_salt"]).drop("_salt")


def partitions(spark: SparkSession, rows: float, rows_each: float) -> int:
    """Partitions for so many rows, as many as the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows / rows_each) + 1)


def crc_fold(column, modulus: int):
    """crc32 of a value's decimal text, modulo `modulus`; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str], group: str | None = None) -> DataFrame:
    """For each value: name of `sums`, adds the sum of the value over all earlier rows of the same group, in the global order (group, *order).

    Rows are range-partitioned by that order, each partition's total per group
    is added up (one row for each partition and group that meet), and a running
    sum inside a partition is shifted by what came before.  The range
    partitioning is written first, so that both uses see the same partitions.  A
    group with any share of the rows is spread over many partitions.  Rows that
    tie in the whole order get the same place in some order among themselves.
    """
    spark = df.sparkSession
    keys = ([group] if group else []) + order
    n = partitions(spark, df.count(), RANGE_ROWS)
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranges")
    by = ["_part"] + ([group] if group else [])
    totals = placed.groupBy(*by).agg(*(F.sum(v).alias(f"_total_{v}") for v in sums))
    earlier = (W.partitionBy(group) if group else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("_part").alias("_of"), *([F.col(group).alias("_group")] if group else []), *(F.coalesce(F.sum(f"_total_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in sums))
    on = F.col("_part") == F.col("_of")
    if group:
        on &= F.col(group).eqNullSafe(F.col("_group"))
    inside = W.partitionBy(*by).orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    run = placed.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_inside_{v}") for v in sums))
    joined = run.join(small_side(starts), on)
    return joined.select(*df.columns, *((F.col(f"_before_{v}") + F.col(f"_inside_{v}")).alias(out) for v, out in sums.items()))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, each: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and label of `each` documents of label 0 and of 1 at most, and how many labelled documents there are of each in all.

    Only rows whose crc32(doc_id as text) mod `fold` isn't `held_out` are read,
    none for a null doc_id or label.  Documents are chosen by a hash of doc_id,
    so a run on the same tables chooses the same ones.  Of a doc_id that is
    labelled twice the larger label holds; of one with several texts, the text of
    the smallest hash.
    """
    own = only(labels, doc_id="long", **{label: "int"}).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_fold(F.col("doc_id"), fold) != held_out))
    own = own.groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = own.where("label = 0").orderBy(order, "doc_id").limit(each).union(own.where("label = 1").orderBy(order, "doc_id").limit(each))
    chosen = F.broadcast(chosen)  # 2 * each rows
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, doc_id="long", text="string").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    return rows.select("doc_id", "text", "label"), counts


def _pairs(rows: pa.Table) -> list[tuple[str, int]]:
    rows = rows.sort_by([("doc_id", "ascending")])
    return list(zip(rows.column("text").to_pylist(), rows.column("label").to_pylist()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, each: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """The texts and labels of labelled_rows() in the order of doc_id, in the driver, and its counts."""
    rows, counts = labelled_rows(docs, labels, label, fold, held_out, each)
    return _pairs(rows.toArrow()), counts


def fitted(rows: DataFrame, counts: dict[int, int], model: type):
    """model(texts and labels in the order of doc_id, counts) for the rows of labelled_rows(), fitted by one task: the driver gets the model alone."""

    def fit(batches):
        found = [b for b in batches if len(b)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model(_pairs(pa.Table.from_batches(found)), counts))], pa.binary())], names=["model"])

    got = rows.coalesce(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(got[0].model) if got else model([], counts)
