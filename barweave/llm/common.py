"""Shared plumbing: the scratch folder every executor can reach, and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}
#: Rows of a small table that one task writes.
ROWS_A_TASK = 100_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir() + "/barweave-scratch"
    return root.rstrip("/")


def _delete(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone: the folder's own retention applies then
        pass


@atexit.register
def _clean() -> None:
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is not None:
            _delete(path, spark)


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never the work before it. Where about how many rows
    there are is known, no more tasks write them than ROWS_A_TASK asks for.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_TASK)))
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/barweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a ``materialise``d table that no later stage reads."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        for path in [p for p in _MADE if f.endswith(p.split(":", 1)[-1].lstrip("/"))]:
            _delete(path, _MADE.pop(path))


def tables() -> set[str]:
    """The scratch tables that exist now, for a caller that knows when they are done with (see ``drop``)."""
    return set(_MADE)


def drop(paths: set[str]) -> None:
    for path in paths & set(_MADE):
        _delete(path, _MADE.pop(path))


def ranges(spark: SparkSession) -> int:
    """Into how many key ranges a corpus-wide dictionary is dealt: the cluster's own partition count."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: A table is broadcast where its counted rows take at most this; beyond, the same join shuffles.
BROADCAST_BYTES = 16 << 20


def if_small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df``, marked for broadcast if its rows, counted now, are few enough; ``row_bytes`` is a row's size or says it per row."""
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def give_back() -> None:
    """Hand freed memory back to the system: workers live on, and their next task may be of another kind."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc: nothing to trim
        pass


def rows(batches: Iterator) -> Iterator[tuple]:
    """(doc_id, text) pairs of Arrow batches; a null text stays None."""
    for batch in batches:
        if batch.num_rows:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
