"""Reading packages into tables and writing tables as packages, with Spark.

Every file is read and parsed in the task that scans it, into one row of nested tables; the flat tables
are projections of that row, so a query reads only what it needs. A query of several tables parses once if it asks
``Corpus.stored`` to write these rows first. A package that is refused gives a row
with ``error`` (mode PERMISSIVE) or fails the query (FAILFAST).
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.packages import Limits
from .package import PackageError, open_package
from .wordml import TABLES, build, flatten

ERROR = "struct<check:string,detail:string>"


def _schema(id_type: str, tables: list[str]) -> str:
    nested = ", ".join(f"{t} array<struct<{', '.join(f.replace(' ', ':', 1) for f in TABLES[t].split(', '))}>>" for t in tables)
    return f"doc_id {id_type}, error {ERROR}, warnings array<string>, {nested}"


def _parse(tables: list[str], schema: StructType, limits: Limits, strict: bool):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
                row = {"doc_id": doc_id, "error": None, "warnings": [], **{t: [] for t in tables}}
                try:
                    found, row["warnings"] = flatten(open_package(content.as_py() or b"", limits, binary="parts" in tables), "parts" in tables)
                    row |= {t: found[t] for t in tables}
                except PackageError as e:
                    if strict:
                        raise
                    row["error"] = {"check": e.check, "detail": e.detail}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return f


@dataclass
class Corpus:
    """The tables of many documents, all keyed by doc_id."""

    parsed: DataFrame

    def table(self, name: str) -> DataFrame:
        return self.parsed.select("doc_id", F.explode(name).alias("__r")).select("doc_id", "__r.*")

    @property
    def documents(self) -> DataFrame:
        return self.parsed.select("doc_id", "error", "warnings")

    def stored(self, folder: str) -> Corpus:
        """This corpus, parsed once and for all: its tables written to a folder that all executors share, and read from there."""
        self.parsed.write.parquet(folder)
        return Corpus(self.parsed.sparkSession.read.schema(self.parsed.schema).parquet(folder))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; unset, a temporary one if all of Spark is on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def parse(files: DataFrame, tables: list[str] | None = None, limits: Limits = Limits(), mode: str = "PERMISSIVE") -> Corpus:
    """A corpus of files (doc_id, content); only the tables asked for are kept of each document."""
    tables = tables or [t for t in TABLES if t != "parts"]
    schema = _schema(files.schema["doc_id"].dataType.simpleString(), tables)
    struct = StructType.fromDDL(schema)
    return Corpus(files.select("doc_id", "content").mapInArrow(_parse(tables, struct, limits, mode == "FAILFAST"), schema))


def read(spark: SparkSession, path: str, tables: list[str] | None = None, limits: Limits = Limits(), mode: str = "PERMISSIVE") -> Corpus:
    """A corpus of the .docx files below a path; doc_id is the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return parse(files.select(F.col("path").alias("doc_id"), "content"), tables, limits, mode)


def read_stream(spark: SparkSession, path: str, tables: list[str] | None = None, limits: Limits = Limits()) -> Corpus:
    """As read, for files as they arrive; each is parsed on its own, so no state is kept."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return parse(files.select(F.col("path").alias("doc_id"), "content"), tables, limits)


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "doc_id"]
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in names}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([build(row)], pa.binary())], names=["doc_id", "content"])


def packages(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id, content: the package of each document of the tables (those of ``TABLES``, with doc_id).

    Rows of a document meet in one shuffle per table on doc_id; a document is the unit of a package.
    """
    grouped = []
    for name, df in tables.items():
        fields = [f.strip().split(" ", 1) for f in TABLES[name].split(", ")]
        columns = [(F.col(f) if f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in fields]
        grouped.append(df.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name)))
    whole = reduce(lambda a, b: a.join(b, "doc_id", "full"), grouped)
    return whole.mapInArrow(_build, f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, content binary")


def _save(folder: str):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                stem = str(doc_id).rpartition("/")[2].removesuffix(".docx")
                path = f"{base}/{stem}-{hashlib.sha256(str(doc_id).encode()).hexdigest()[:16]}.docx"
                part = f"{path}.{uuid.uuid4().hex}.part"  # of this attempt alone
                with fs.open_output_stream(part) as out:
                    out.write(content)
                fs.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(paths, pa.string())], names=["doc_id", "path"])

    return f


def save(contents: DataFrame, folder: str) -> DataFrame:
    """Writes packages (doc_id, content) as files of a folder that all executors share; returns doc_id and path. Lazy: an action on the result writes.

    A file is named by the last part of its doc_id and a hash of all of it, so that documents of one name don't meet.
    """
    return contents.mapInArrow(_save(folder), f"doc_id {contents.schema['doc_id'].dataType.simpleString()}, path string")
