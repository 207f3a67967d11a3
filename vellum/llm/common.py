"""What the operators share: tables, the shared folder, row-wise Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Batches that go to Python workers, in place of Spark's defaults: batches of 10,000 texts or 64 MB are held several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; a session that leaves Spark's batches as they are gets smaller ones from now on."""
    for key, (default, smaller) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, smaller)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder, as a URI or path, in the one that the cluster names in spark.checkpoint.dir.

    Where that is unset, it is set to a temporary folder if all of Spark is on this machine; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there, so that their lineage ends."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def put_file(uri: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all: a task that is lost or run twice leaves no half file."""
    fs, base = filesystem(uri)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{base}/{name}")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


_libc = ctypes.CDLL(None)
_caches: list[dict] = []
_stage: int | None = None


def stage_cache() -> dict:
    """What a Python worker keeps from task to task of a stage; it is empty when the next stage begins."""
    _caches.append({})
    return _caches[-1]


def _begun() -> None:
    global _stage
    context = TaskContext.get()
    if context is None or context.stageId() != _stage:
        for c in _caches:
            c.clear()
        _stage = context and context.stageId()


def _ended() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map whose worker gives its memory back after each task: workers live on, and an executor has several."""

    def g(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begun()
        yield from f(batches)
        _ended()

    return g


def packed_row(columns: list[str]):
    """A struct of the columns, whatever their names are."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in columns))


def row_schema(df: DataFrame, more: str) -> StructType:
    """The columns of df, whatever their names are, and more of them."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def arrow_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


__all__ = ["F", "StorageLevel", "arrow_batch", "filesystem", "lean", "packed_row", "put_file", "row_schema", "shared_folder", "stage_cache", "table", "texts_of", "written"]
