"""Tables that runs keep between them: personas, results, and what is done already."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


POINTER = "_CURRENT"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds since 1970."""
    fs, p, _ = _fs(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def current(spark: SparkSession, path: str) -> str:
    """Where the rows of a table are: the version that its pointer names, or the folder itself if it never was replaced."""
    fs, p, jvm = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return path
    stream = fs.open(p)
    try:
        return f"{path}/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows if it was never written."""
    return spark.read.schema(schema).parquet(current(spark, path)) if exists(spark, path) else spark.createDataFrame([], schema)


@contextmanager
def locked(spark: SparkSession, path: str, wait_s: float = 60.0) -> Iterator[None]:
    """One writer of a table at a time, by a lock file beside it; raises if it is not free in time."""
    fs, p, _ = _fs(spark, f"{path}.lock")
    until = time.monotonic() + wait_s
    while not fs.createNewFile(p):
        if time.monotonic() > until:
            raise TimeoutError(f"{path}.lock is held by another writer")
        time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(p, False)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version and switch the pointer to it in one atomic rename.

    Readers always find a whole table, and a table can be made from itself. The version
    before stays for those that still read it; older ones are removed.
    """
    spark = df.sparkSession
    before = current(spark, path)
    version = f"_v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    fs, p, jvm = _fs(spark, f"{path}/{POINTER}")
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}.{version}")
    out = fs.create(new, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(p), how)
    for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = s.getPath().getName()
        if name.startswith("_v-") and name not in (version, before.rsplit("/", 1)[-1]):
            fs.delete(s.getPath(), True)


def insert_if_absent(new: DataFrame, path: str, keys: list[str], schema: str) -> tuple[int, int]:
    """Append rows whose keys are not there yet; (inserted, skipped). Repeated keys of ``new`` count once."""
    spark = new.sparkSession
    with locked(spark, path):
        have = read_or_empty(spark, path, schema).select(*keys)
        once = new.dropDuplicates(keys)
        fresh = once.join(have, keys, "left_anti").select(*[c.name for c in read_or_empty(spark, path, schema).schema.fields])
        total, inserted = once.count(), fresh.count()
        if inserted:
            fresh.write.mode("append").parquet(current(spark, path))
    return inserted, total - inserted


def upsert_latest(new: DataFrame, path: str, keys: list[str], schema: str, order: str | None = None) -> None:
    """Union with the table, the newest row of each key stays (new before old, then by ``order``)."""
    spark = new.sparkSession
    with locked(spark, path):
        replace_table(_latest(new, path, keys, schema, order), path)


def _latest(new: DataFrame, path: str, keys: list[str], schema: str, order: str | None) -> DataFrame:
    spark = new.sparkSession
    cols = [c.name for c in read_or_empty(spark, path, schema).schema.fields]
    both = read_or_empty(spark, path, schema).withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
    by = [F.col("_new").desc(), *([F.col(order).desc_nulls_last()] if order else [F.xxhash64(*cols)])]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_r = 1").select(*cols)


def merge_caches(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both caches; the value of ``first`` wins."""
    return first.select(*keys, F.col(value).alias("_a")).join(second.select(*keys, F.col(value).alias("_b")), keys, "full").select(*keys, F.coalesce("_a", "_b").alias(value))


def completed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of rows without an error."""
    ok = rows.where(F.coalesce(F.col("error"), F.lit("")) == "") if "error" in rows.columns else rows
    return ok.select(*keys).distinct()


def open_work(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet; keys are compared as text."""
    as_text = [F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)]
    left = todo.select("*", *as_text)
    names = [f"_k{i}" for i in range(len(keys))]
    return left.join(done.select(*as_text).distinct(), names, "left_anti").drop(*names)


def stored_personas(users: DataFrame, store: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """``users`` with ``p0_text`` of the shared store, else of the older per-user form, else null."""
    out = users.join(store.select("user_id", "community_id", F.col("p0_text").alias("_a")), ["user_id", "community_id"], "left")
    if legacy is None:
        return out.withColumnRenamed("_a", "p0_text")
    old = legacy.select("user_id", "community_id", F.col("p0_text").alias("_b"))
    return out.join(old, ["user_id", "community_id"], "left").withColumn("p0_text", F.coalesce(F.nullif("_a", F.lit("")), F.col("_b"))).drop("_a", "_b")
