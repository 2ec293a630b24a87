"""What the operators of this subpackage share: reading, durable intermediate tables, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a word: space and the ASCII controls from tab to carriage return.
SEPARATORS = " \t\n\x0b\f\r"
#: Java regular expressions for a run of separators and for a word.
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class _Made(threading.local):
    """Folders that this thread's session made, in order."""

    def __init__(self):
        self.folders: list[str] = []


_made = _Made()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see.

    It lies below spark.checkpoint.dir. Only where that is unset (a local session, as in tests) a
    temporary folder is used, which the interpreter removes when it ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        base = found.rsplit("/", 1)[0] if found else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = tempfile.mkdtemp(prefix="turnwise-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/turnwise-{uuid.uuid4().hex}"
    _made.folders.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Folders made within are deleted at the end. Yields a function that writes a table to one that stays."""
    mark, kept = len(_made.folders), []

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        kept.append(_made.folders[-1])
        return out

    try:
        yield keep
    finally:
        for path in _made.folders[mark:]:
            if path not in kept:
                remove(spark, path)
        _made.folders[mark:] = kept


def tidy(f):
    """For a function of a table that is done with its intermediate tables when it ends: a table that it returns is written, all others are deleted."""

    @functools.wraps(f)
    def run(table: DataFrame, *args, **options):
        with scratch(table.sparkSession) as keep:
            out = f(table, *args, **options)
            return keep(out) if isinstance(out, DataFrame) else out

    return run


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents that are not held out: (doc_id, text, y), chosen by the hash of their id, as a written table.

    The sample of (doc_id, y) has a proven bound of ``rows`` rows of 16 bytes, so it is broadcast; only texts of the sample are shuffled, so that
    of rows of one id the least text counts once. Of several labels for one document the largest counts; null labels and ids do not.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.where(~held_out(F.col("doc_id"), modulus, remainder)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return materialize(found.repartition(docs.sparkSession.sparkContext.defaultParallelism).select("doc_id", "text", "y"))
