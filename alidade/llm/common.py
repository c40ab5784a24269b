"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch are cut so that Python holds about this many bytes of text at once.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table by Spark, so that any store Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only in local mode, and only where none is set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="alidade-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


#: Paths of all tables of this process that are not deleted yet, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}
#: For each thread the paths that were written in the scopes it is in, the innermost last.
_SCOPES = threading.local()


def _remove_written() -> None:
    """Delete this process's tables when it ends; by Spark, or if that has stopped, where the folder is a local one."""
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  nothing more can be done at exit
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    _WRITTEN.clear()


def _delete(spark: SparkSession, path: str) -> None:
    """By Hadoop's file system, as Spark has no public way to delete a folder of any store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        if _WRITTEN.pop(df._alidade_path, None) is not None:
            _delete(df.sparkSession, df._alidade_path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of make, saved; all tables that this thread saved on the way are deleted."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        out = saved(make(), name)
    finally:
        own = scopes.pop()
    for path in own:
        if path != out._alidade_path and (spark := _WRITTEN.pop(path, None)) is not None:
            _delete(spark, path)
    if scopes:
        scopes[-1].append(out._alidade_path)
    return out


#: Has Spark remove the shuffle files of a query when it has ended; no saved table reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and survives lost executors.

    Tables last until they are released, their scope is settled, or the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/alidade-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN[path] = spark
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._alidade_path = path
    return out


#: Rows, and bytes of their values, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 16 << 20


def if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count of its rows and their bytes shows that it is small; else joins shuffle as ever."""
    wide = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    each = F.lit(8 * len(df.columns)).cast("long")
    for column in wide:
        each = each + column
    rows, size = df.agg(F.count("*"), F.sum(each)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as bytes, null as empty; every other column is ignored."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def id_field(docs: DataFrame, id_col: str, name: str = "id") -> T.StructField:
    return T.StructField(name, docs.schema[id_col].dataType, True)


def offsets_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row limits and the joined bytes of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary())
    n, start = len(column), column.offset
    _, limits, data = column.buffers()
    offsets = np.frombuffer(limits, np.int64, n + 1, start * 8) if n else np.zeros(1, np.int64)
    joined = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], joined[offsets[0] : offsets[-1]]


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by the bytes of their column `text`; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_and_bytes(batch.column("text"))[0]
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def map_texts(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """mapInArrow of a function of one small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield each(batch)

    return df.mapInArrow(run, schema)
