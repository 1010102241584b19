"""What the operators of this subpackage share: scratch tables, Arrow text helpers, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A text column is handled in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 8 << 20
BATCH_ROWS = 2000
#: Rows of two or three numbers that may be broadcast after counting them.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    context = spark.sparkContext
    if where := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return where.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="rallyframe-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read back: later work starts from the files, on any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Removes a table that stored() wrote and nothing will read again."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def without(docs: DataFrame, id: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in gone (one column), all columns as they are, whatever their names."""
    name = fresh("gone")
    gone = stored(gone.toDF(name).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id).eqNullSafe(F.col(name)), "left_anti")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes; one longer text makes a run of its own."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
    release()


def release() -> None:
    """Gives freed memory back to the system: an executor keeps its worker processes for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df itself; from now on its session's Arrow batches have at most BATCH_ROWS rows, as texts may be long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column, null as empty, at offset 0."""
    return pa.concat_arrays([pc.fill_null(batch.column(name), "")])


def coded_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a column of lists of strings: each value's code, where each row's codes start (and the end), the distinct values."""
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As coded_lists, of the maximal runs of bytes other than ASCII white space (space and 0x09-0x0D)."""
    codes, starts, words = coded_lists(pc.ascii_split_whitespace(texts))
    if "" in words:
        full = codes != words.index("")
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        codes = codes[full]
    return codes, starts, words


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low, low + 1, ... of n values for each row, and the row of each."""
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row], row
