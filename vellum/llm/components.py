"""Connected components of a graph whose edges are packed rows: arrays of int64 nodes, dealt by bucket of a node.

A round sends each edge to the buckets of both its nodes; there, what hangs together becomes a star around its least
node. When no bucket changes anything, every node but a root has one edge, that to its component's least node. A round
is one exchange and one written table; nothing but a flag of each bucket comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .ordered import parts_for
from .vectext import mix

EDGES = "bucket int, a binary, b binary"
#: Edges that a task holds before it sends them on.
HELD = 2_000_000


def bucket_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(nodes.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def packed(parts: int, bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The buckets that have values, and each column's values by bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cut))
    return some, [[c[order[cut[b] : cut[b + 1]]].tobytes() for b in some] for c in columns]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges (a, b): the least node of each other node's component, and that node; ascending."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], least)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def edge_rows(parts: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges by the buckets of both nodes."""
    x, y = np.concatenate((a, a)), np.concatenate((b, b))
    some, (left, right) = packed(parts, np.concatenate((bucket_of(a, parts), bucket_of(b, parts))), x, y)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["bucket", "a", "b"])


def _gathered(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    a, b, held = [], [], 0
    for batch in batches:
        for left, right in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a.append(np.frombuffer(left, np.int64))
            b.append(np.frombuffer(right, np.int64))
            held += len(a[-1])
        if held > HELD:
            x, y = _distinct(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x) // 2
    return np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _contract(parts: int):
    """Edges as they come, in blocks of at most HELD, as stars."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            for left, right in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a.append(np.frombuffer(left, np.int64))
                b.append(np.frombuffer(right, np.int64))
                held += len(a[-1])
                if held > HELD:
                    yield edge_rows(parts, *stars(np.concatenate(a), np.concatenate(b)))
                    a, b, held = [], [], 0
        if held:
            yield edge_rows(parts, *stars(np.concatenate(a), np.concatenate(b)))

    return f


def _round(parts: int):
    """The edges of one bucket as stars; a row of bucket -1 says that they were something else."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _distinct(*_gathered(batches))
        if not len(a):
            return
        root, node = stars(a, b)
        yield edge_rows(parts, root, node)
        x, y = _distinct(root, node)
        if not (np.array_equal(x, a) and np.array_equal(y, b)):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=["bucket", "a", "b"])

    return f


def _named(parts: int):
    """Of one bucket's edges: its nodes, each once, and their roots."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal bucket
            for batch in batches:
                bucket = batch.column("bucket")[0].as_py() if batch.num_rows else bucket
                yield batch

        a, b = _gathered(noted())
        if len(a):
            node, at = np.unique(np.concatenate((b, a)), return_index=True)
            root = np.concatenate((a, a))[at]
            own = bucket_of(node, parts) == bucket
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([node[own].tobytes()], pa.binary()), pa.array([root[own].tobytes()], pa.binary())], names=["bucket", "a", "b"])

    return f


def components(edges: DataFrame) -> DataFrame:
    """Per bucket one row: ``a``, its nodes that have an edge, and ``b``, the least node of each one's component.

    ``edges`` has packed nodes ``a`` and ``b``, in any number of rows; no edge joins a node to itself.
    """
    parts = parts_for(edges)
    now = written(edges.select("a", "b").mapInArrow(lean(_contract(parts)), EDGES), "edges")
    while True:
        now = written(now.where("bucket >= 0").repartitionById(parts, F.col("bucket")).mapInArrow(lean(_round(parts)), EDGES), "stars")
        if not now.where("bucket = -1").select("bucket").collect():  # a row a bucket at most
            break
    return written(now.repartitionById(parts, F.col("bucket")).mapInArrow(lean(_named(parts)), EDGES), "components")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["node", "component"])


def as_rows(found: DataFrame) -> DataFrame:
    """node, component."""
    return found.mapInArrow(lean(_rows), "node long, component long")
