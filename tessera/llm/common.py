"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that separate words: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Local folders that this process has made.
_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is never inlined, so an expensive array that a nested
    lambda reads for every element isn't computed anew for each of them.
    """
    return F.transform(F.array(value), body)[0]


def blank_parts(text: Column) -> Column:
    """What stands between blanks, empty between neighbouring ones: one part more than blanks."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " ", -1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(blank_parts(text), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bare(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with derived names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs in one process, a local one that goes with it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables made by written() that no later step reads, and lets go of the shuffle files of finished steps.

    Frames derived from such a table must have been written themselves.
    """
    for df in tables:
        if path := getattr(df, "_written_to", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            df._written_to = None


def shards(spark: SparkSession) -> int:
    """Key ranges for distributed prefix sums; results don't depend on it."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def array_of(df: DataFrame, size: int, index: str, value: str) -> Column:
    """A table of (index, value) with 0 <= index < size as one array, as a scalar subquery.

    ``size`` is a parameter of the model, so the row that the driver gets is bounded.
    Indexes without a row hold 0.
    """
    spark = df.sparkSession
    dense = spark.range(size).join(bare(df, index, value).withColumnRenamed(index, "id"), "id", "left")
    one = dense.agg(F.array_sort(F.collect_list(F.struct(F.col("id"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))).alias("a"))
    return one.select(F.col("a.v").alias("a")).scalar()


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of bounded bytes for the jobs run inside, however long single texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
