"""Helpers the operators share: tables, shared written hand-offs, Arrow text batches."""

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import weakref
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_handed = weakref.WeakKeyDictionary()  # hand-offs and their paths
SLICE_BYTES = 1 << 20  # text bytes worked on at once; bounds the memory of a task, not the text


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="turmalina-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df, name: str):
    """``df`` written to the shared folder and read back: later steps start from files that
    outlive any executor.  The files go when the session ends."""
    return written_in_parts(df.sparkSession, lambda part: df, 1, name)


def written_in_parts(spark, part_of, parts: int, name: str):
    """``part_of(0)`` to ``part_of(parts - 1)`` written one after another as one table, and read
    back: the shuffles of one part are gone before the next begins."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath.getParent())
    for part in range(parts):
        if part:
            df = None
            sweep(spark)
        df = part_of(part)
        df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _handed[out] = path
    return out


def sweep(spark):
    """Let Spark's cleaner see that the shuffles of finished steps are done with."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*frames):
    """Delete the files of hand-offs that nothing reads any more, and let Spark's cleaner see that
    the shuffles behind them are done with."""
    for df in frames:
        path = _handed.pop(df, None)
        if path is not None:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath.getParent(), True)
    if frames:
        sweep(frames[0].sparkSession)


_shipped = set()


def ship(spark):
    """Send this package's modules to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(package))
    path = os.path.join(tempfile.mkdtemp(prefix="turmalina-"), "turmalina_llm.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.write(os.path.join(os.path.dirname(package), "__init__.py"), "turmalina/__init__.py")
        for name in sorted(os.listdir(package)):
            if name.endswith(".py"):
                archive.write(os.path.join(package, name), os.path.relpath(os.path.join(package, name), root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


caches = {}  # name -> what a worker keeps from task to task, for the operators of that name alone


def release(keeps: str | None = None):
    """Give memory that was freed back to the system, and clear the caches of other names: Python
    workers serve one stage after another, and what each keeps for reuse would add up."""
    for name, kept in caches.items():
        if name != keeps:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextlib.contextmanager
def small_batches(spark, rows: int):
    """Within, Arrow batches have ``rows`` rows at most: for rows of many kilobytes, whose batches a
    task and its worker would else each hold several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_batches(df, function, schema: str, keeps: str | None = None):
    """``function(batches) -> batches`` over Arrow record batches, one call per partition.  A task
    that ``keeps`` another cache, or none, clears those that earlier operators left in its worker."""
    ship(df.sparkSession)

    def lean(batches):
        release(keeps)  # what the stage before it left
        yield from function(batches)
        release(keeps)

    return df.mapInArrow(lean, schema)


def text_slices(batches, text: str = "text", limit: int = SLICE_BYTES):
    """Arrow batches cut so that each holds about ``limit`` bytes of text; a longer text alone."""
    for batch in batches:
        offsets = column_bytes(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def column_bytes(column):
    """The bytes of a string or binary column and the rows' offsets in them; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def batch_of(schema: pa.Schema, **columns):
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array)
         else columns[f.name].cast(f.type) for f in schema], schema=schema)


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder
