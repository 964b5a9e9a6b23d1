"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set (tests)."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loamline-checkpoint-")
        )
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The files survive the loss of any executor, and what follows does not run
    the plan above again (so ids given by position stay what they were).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a table whose size the planner then knows.

    A checkpoint keeps the size that was guessed for its plan, and joins multiply
    guesses: over the rounds of a loop these grow without bound.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def returning_memory(run: Callable) -> Callable:
    """``run`` over a task's batches, after which the Python worker, which serves other tasks, gives unused memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
                if trim is not None:
                    trim(0)

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of ``text`` as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_name(col: Column) -> Column:
    """A grouping key that keeps a null source apart from every string."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col))


def sorted_names(keys: DataFrame, cols: list[str], name: str = "name") -> DataFrame:
    """Give the distinct rows of ``keys`` integer names in their sort order.

    Range partitions are sorted on their own, so the names ascend with gaps
    between partitions; no row passes through a single task. The caller cuts
    the result: the names hold for one execution.
    """
    spread = keys.select(*cols).distinct().repartitionByRange(partitions(keys.sparkSession), *cols)
    return spread.sortWithinPartitions(*cols).withColumn(name, F.monotonically_increasing_id())


#: Rows of a table that may be broadcast, a few tens of MB at the row sizes used here.
SMALL_ROWS = 200_000


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table that is counted first: broadcast when small, else an ordinary join that AQE may split."""
    return df.join(F.broadcast(small) if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else small, on, how)
