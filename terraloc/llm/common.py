"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts can be long, so batches are small.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small, so that a Python worker's memory doesn't depend on how long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one on a local master; elsewhere executors wouldn't share that, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terraloc-")
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(_remove, spark, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/terraloc-{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't; its folder is the cluster's to clean
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a saved table that nothing will read any more."""
    for path in {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(name: str = "text") -> Column:
    """The column's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, deal: str | None = None) -> DataFrame:
    """Left join to a table with one row a key. Rows of a hot key on the left go to `salts` tasks, dealt by the column `deal` or by all, and each row on the right is sent to all of them.

    Both sides are shuffled: Spark would broadcast the right by its packed size, whose copies then fill the driver."""
    many = left.withColumn("_salt", F.pmod(F.xxhash64(*([deal] if deal else left.columns)), F.lit(salts)))
    one = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return many.join(one.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join to a saved table with one row a key, whose column `rows` tells how many rows of the left have the key.

    A key of over a quarter of an even share of all rows is hot: its rows are dealt to as many tasks as it holds such
    quarters, and only its row on the right is sent to all of them. Hot keys number at most 4 x partitions.
    """
    share = (right.agg(F.sum("rows")).first()[0] or 0) / (4 * partitions(left.sparkSession))
    cuts = F.ceil(F.col("rows") / max(share, 1000.0)).cast("int")
    hot = F.broadcast(right.select(*keys, cuts.alias("_cuts")).filter("_cuts > 1"))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_cuts", F.lit(1))).cast("int")).drop("_cuts")
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("rows")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def give_back() -> None:
    """Hands the memory that a Python process no longer uses to the system, which else stays with it for its next task or step."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def binary_lists(col) -> list[bytes]:
    """An Arrow binary column as Python bytes; null is empty."""
    return [x or b"" for x in col.to_pylist()]


def splits(lengths: np.ndarray) -> np.ndarray:
    """Where pieces of these lengths start and end, laid end to end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def by_size(texts: list[str], most: int = 1 << 20):
    """The texts in order, in lists of about `most` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
