"""Exact links of sets in the metric space of the Jaccard distance, by pivots, Voronoi cells and recursion.

A region is a table of sets. Some of its sets are pivots; what lies within the radius r = 1 - threshold of a pivot
is linked with it, so a pivot's ball is one component and its inner pairs need no comparison. Pivots of at least
``APART`` from each other are leaders. Each set's home is the Voronoi cell of its nearest leader, if that is at most
``REACH`` away, and the rest cell if not. If x is linked with y and at home with leader i, the triangle inequality gives

    d(y, i) <= d(x, i) + r <= REACH + r    and, for every leader j,    d(y, i) <= d(x, i) + r <= d(x, j) + r <= d(y, j) + 2 r

so copies of the boundary sets that keep both bounds go to cell i; and if x is in the rest cell, y's nearest leader is
over REACH - r away, and such sets are copied to the rest cell. Each linked pair is thus within one cell, and cells are
regions of the next level. A region ends when all its sets are known as one component, or when all sets outside
its largest component were pivots. What doesn't shrink is compared in blocks of pivots against the region.

A region of at most ``limit_bytes`` and ``limit_sets`` is joined by one task in memory (``connect``); a larger one is
dealt to slots of that size, its pivots to all of them, and no task ever holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .components import stars
from .ordered import parts_for
from .vectext import lookup, mix, ragged

REACH = 0.5
APART = 0.9
#: Pivots of a region in memory, and of one that isn't (and no more than ``limit_bytes`` of sets, about).
LEAF = 24
PIVOTS = 1000
#: Levels of regions that no task holds, before what is left of them is compared in blocks.
LEVELS = 4
LIMIT_BYTES = 8 << 20
LIMIT_SETS = 500
#: A cell of over this share of its region's sets is no progress.
PROGRESS = 0.9
#: Pairs of a shingle's place in a set and in a pivot that are counted together.
BLOCK = 500_000
_SLACK = 1e-9


def linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


def shared_with(pivots: list[np.ndarray], flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each pivot (row) with each set (column); the sets are ``n`` values of ``flat`` each."""
    values = np.concatenate(pivots)
    owner = np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    holders = np.diff(np.append(first, len(values)))
    at, there = lookup(values[first], flat)
    hit = np.flatnonzero(there)
    row, at = np.repeat(np.arange(len(n)), n)[hit], at[hit]
    pairs = np.cumsum(holders[at])
    out = np.zeros(len(n) * len(pivots), np.int32)
    start = 0
    while start < len(hit):
        stop = max(start + 1, int(np.searchsorted(pairs, pairs[start] + BLOCK, "right")))
        k = holders[at[start:stop]]
        key = np.repeat(row[start:stop] * len(pivots), k) + owner[ragged(first[at[start:stop]], k)]
        low, high = int(row[start]) * len(pivots), (int(row[stop - 1]) + 1) * len(pivots)
        out[low:high] += np.bincount(key - low, minlength=high - low).astype(np.int32)
        start = stop
    return out.reshape(len(n), len(pivots)).T


def leaders(distance: np.ndarray) -> np.ndarray:
    """Of pivots with these distances from each other, in order, those that are apart from all taken before."""
    out: list[int] = []
    for i in range(len(distance)):
        if not out or (distance[i, out] >= APART).all():
            out.append(i)
    return np.array(out, np.int64)


def cells(distance: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For distances of leaders (rows) to sets: each cell's number, -1 for the rest, and which sets are in it or at its boundary."""
    radius = 1 - percent / 100 + _SLACK
    nearest = distance.min(0)
    for i, d in enumerate(distance):
        yield i, (d <= REACH + radius) & (d <= nearest + 2 * radius)
    yield -1, nearest > REACH - radius


def connect(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> np.ndarray:
    """A number for each set, equal within a component; sets of equal ``label`` are one from the start."""
    k = len(sets)
    n = np.fromiter(map(len, sets), np.int64, k)
    ends = np.cumsum(n)
    label = np.arange(k) if label is None else label.copy()
    flat = np.concatenate(sets) if k else np.zeros(0, np.uint64)

    def compare(pivots: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        shared = shared_with([sets[p] for p in pivots], values, n[rows])
        for p, near in zip(pivots, linked(shared, n[rows][None], n[pivots][:, None], percent), strict=True):
            names = np.unique(label[rows[near]])
            if len(names) > 1 or names[0] != label[p]:
                label[np.isin(label, np.append(names, label[p]))] = label[p]
        return 1 - shared / (n[rows][None] + n[pivots][:, None] - shared)

    stack = [np.arange(k)]
    while stack:
        rows = stack.pop()
        names, which, size = np.unique(label[rows], return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        active = rows[which != size.argmax()]
        values = flat if len(rows) == k else flat[ragged(ends[rows] - n[rows], n[rows])]
        if len(active) <= LEAF:
            compare(active, rows, values)
            continue
        pivots = active[np.linspace(0, len(active) - 1, LEAF).astype(np.int64)]
        distance = compare(pivots, rows, values)
        lead = leaders(distance[:, np.searchsorted(rows, pivots)])
        parts = [rows[own] for _, own in cells(distance[lead], percent)]
        if max(map(len, parts)) > PROGRESS * len(rows):
            for i in range(0, len(active), LEAF):
                compare(active[i : i + LEAF], rows, values)
        else:
            stack += parts
    return label


def _regions(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """The rows of each key, one after the other; they come sorted by key."""
    key, held = None, [[] for _ in columns]
    for batch in batches:
        for k, *values in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if k != key and held[0]:
                yield key, held
                held = [[] for _ in columns]
            key = k
            for h, v in zip(held, values, strict=True):
                h.append(v)
    if held[0]:
        yield key, held


PACKED = "a binary, b binary"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])


def _join_small(percent: int):
    """Packed edges of stars around each component's least class."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for _, (cids, labels, raw) in _regions(batches, ["region"], ["cid", "label", "shingles"]):
            cid = np.array(cids, np.int64)
            known = np.array([c if x is None else x for c, x in zip(cids, labels, strict=True)], np.int64)
            _, start = np.unique(known, return_inverse=True)
            label = connect([np.frombuffer(x, np.uint64) for x in raw], percent, start)
            names, at = np.unique(label, return_inverse=True)
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, at, cid)
            other = least[at] != cid
            a.append(least[at][other])
            b.append(cid[other])
            held += len(b[-1])
            if held > 100_000:
                yield _edges(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
        if held:
            yield _edges(np.concatenate(a), np.concatenate(b))

    return f


def _split(columns: list[list]) -> tuple[dict, dict, np.ndarray, np.ndarray]:
    """Pivots (by class), rows and forest edges of a slot."""
    kind = np.array(columns[0])
    pick = lambda k, c: [columns[c][i] for i in np.flatnonzero(kind == k)]
    order = np.argsort(np.array(pick(1, 1), np.int64), kind="stable")
    sets = [np.frombuffer(x, np.uint64) for x in pick(1, 3)]
    pivots = {"cid": np.array(pick(1, 1), np.int64)[order], "label": [pick(1, 2)[i] for i in order], "sets": [sets[i] for i in order]}
    rows = {"cid": np.array(pick(2, 1), np.int64), "label": pick(2, 2), "raw": pick(2, 3)}
    both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in pick(0, 3)]
    a, b = np.concatenate(both, 1) if both else np.zeros((2, 0), np.int64)
    return pivots, rows, a, b


def _measured(pivots: dict, rows: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of pivots to rows, and which are linked."""
    sets = [np.frombuffer(x, np.uint64) for x in rows["raw"]]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    m = np.fromiter(map(len, pivots["sets"]), np.int64, len(pivots["sets"]))[:, None]
    shared = shared_with(pivots["sets"], np.concatenate(sets), n)
    return 1 - shared / (n[None] + m - shared), linked(shared, n[None], m, percent)


def _balls(percent: int):
    """A slot's links with the pivots, as edges; and the forest of pivots and known labels that they connect."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _, _), columns in _regions(batches, ["region", "block", "slot"], ["kind", "cid", "label", "shingles"]):
            pivots, rows, _, _ = _split(columns)
            if not len(pivots["cid"]) or not len(rows["cid"]):
                continue
            _, near = _measured(pivots, rows, percent)
            p, y = np.nonzero(near)
            a, b = pivots["cid"][p], rows["cid"][y]
            some = a != b
            known = np.array([c if x is None else x for c, x in zip(rows["cid"], rows["label"], strict=True)], np.int64)
            labelled = np.array([x is not None for x in rows["label"]], bool)
            first = near.argmax(0)  # every pivot within reach of a row hangs together with the row's first one
            meet = np.stack((pivots["cid"][first[y]], a))[:, pivots["cid"][first[y]] != a]
            names = np.stack((a, known[y]))[:, labelled[y] & (a != known[y])]
            forest = np.concatenate((meet, names), 1)
            forest = np.stack(stars(forest[0], forest[1])) if forest.shape[1] else forest
            a, b = stars(a[some], b[some])
            yield pa.RecordBatch.from_arrays([pa.array([region], pa.int64()), pa.array([np.ascontiguousarray(forest).tobytes()], pa.binary()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["region", "forest", "a", "b"])

    return f


CHILD = "region long, parent_sets long, cid long, label long, shingles binary"


def _route(percent: int, level: int):
    """A slot's rows, by the cells that they are at home in or at the boundary of."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _, _, sets), columns in _regions(batches, ["region", "block", "slot", "sets"], ["kind", "cid", "label", "shingles"]):
            pivots, rows, a, b = _split(columns)
            if not len(rows["cid"]):
                continue
            base = np.uint64(region & 0xFFFFFFFFFFFFFFFF) + np.uint64(level + 1)
            if len(pivots["cid"]):
                root, node = stars(a, b) if len(a) else (a, b)
                name = dict(zip(node.tolist(), root.tolist(), strict=True))
                distance, near = _measured(pivots, rows, percent)
                core = np.where(near.any(0), pivots["cid"][near.argmax(0)], 0)
                own = [x if x is not None else int(c) if hit else None for x, c, hit in zip(rows["label"], core, near.any(0), strict=True)]
                label = [None if x is None else name.get(x, x) for x in own]
                between, _ = _measured(pivots, {"raw": [x.tobytes() for x in pivots["sets"]]}, percent)
                lead = leaders(between)
                ids = np.append(pivots["cid"][lead], 0).view(np.uint64)
                parts = list(cells(distance[lead], percent))
            else:
                label, ids, parts = rows["label"], np.zeros(1, np.uint64), [(-1, np.ones(len(rows["cid"]), bool))]
            for i, inside in parts:
                at = np.flatnonzero(inside)
                if len(at):
                    child = int(mix(mix(np.array([base])) ^ ids[i : i + 1 or None])[0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), child)), pa.array(np.full(len(at), sets)), pa.array(rows["cid"][at]), pa.array([label[j] for j in at], pa.int64()), pa.array([rows["raw"][j] for j in at], pa.binary())], names=["region", "parent_sets", "cid", "label", "shingles"])

    return f


def _sizes(rows: DataFrame, limit_bytes: int, limit_sets: int) -> DataFrame:
    """Per region its sets, bytes, the largest label, the sets outside it, and whether it is done or large."""
    each = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("shingles")).alias("bytes"), F.max("parent_sets").alias("parent_sets"))
    named = F.when(F.col("label").isNotNull(), F.col("k"))
    out = each.groupBy("region").agg(F.sum("k").alias("sets"), F.sum("bytes").alias("bytes"), F.max_by("label", named).alias("top"), (F.sum("k") - F.coalesce(F.max(named), F.lit(0))).alias("active"), F.max("parent_sets").alias("parent_sets"))
    return out.withColumn("done", F.col("active") == 0).withColumn("large", (F.col("active") > 0) & ((F.col("bytes") > limit_bytes) | (F.col("sets") > limit_sets)))


def join_regions(placed: DataFrame, percent: int, limit_bytes: int = LIMIT_BYTES, limit_sets: int = LIMIT_SETS) -> tuple[DataFrame, bool]:
    """Packed edges that connect all links within regions, and whether a class can be in several stars.

    ``placed`` (region, cid, shingles: sorted distinct uint64 values) is a table that can be read repeatedly.
    """
    parts = parts_for(placed)
    rows = placed.select("region", F.lit(None).cast("long").alias("parent_sets"), "cid", F.lit(None).cast("long").alias("label"), "shingles")
    found: list[DataFrame] = []
    level = 0
    while True:
        sizes = written(_sizes(rows, limit_bytes, limit_sets), "region-sizes")
        small = rows.join(sizes.where("large or done").select("region"), "region", "left_anti")
        found.append(small.repartition(parts, "region").sortWithinPartitions("region").select("region", "cid", "label", "shingles").mapInArrow(lean(_join_small(percent)), PACKED))
        if not sizes.where("large").select("region").limit(1).collect():
            break
        final = _step(rows, sizes.where("large"), level, parts, percent, limit_bytes, limit_sets, found)
        if final is None:
            break
        rows, level = final, level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, len(found) > 1


def _step(rows: DataFrame, large: DataFrame, level: int, parts: int, percent: int, limit_bytes: int, limit_sets: int, found: list[DataFrame]) -> DataFrame | None:
    """One level of all large regions: edges go to ``found``, the cells are returned; None if there can't be any."""
    block = F.greatest(F.ceil(F.col("active") / PIVOTS), F.ceil(F.col("bytes") * F.col("active") / F.col("sets") / limit_bytes), F.lit(1))
    stuck = F.lit(level >= LEVELS) | (F.coalesce(F.col("sets") > PROGRESS * F.col("parent_sets"), F.lit(False)) & F.lit(level > 1))
    whole = stuck | ((F.col("active") <= PIVOTS) & (F.col("bytes") * F.col("active") / F.col("sets") <= 2 * limit_bytes))
    share = F.greatest(4 / F.col("active"), F.least(PIVOTS / F.col("active"), limit_bytes / F.col("bytes")))
    plan = large.select(
        "region", "sets", "top", whole.alias("whole"),
        F.greatest(F.ceil(F.col("bytes") / limit_bytes), F.ceil(F.col("sets") / limit_sets)).alias("slots"),
        F.when(whole, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0))).alias("share"),
        F.when(whole, block).otherwise(F.lit(1)).alias("blocks"),
    )
    inside = rows.join(plan, "region")
    random = F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(1 << 30)) / (1 << 30)
    active = F.col("label").isNull() | (F.col("label") != F.col("top"))
    key = ["region", "block", "slot", "sets", "whole", "kind", "cid", "label", "shingles"]
    slot = F.pmod(F.xxhash64("cid", F.lit(-1)), F.col("slots")).cast("int")
    block = F.pmod(F.xxhash64("cid", F.lit(-2)), F.col("blocks")).cast("int")
    to_blocks = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    to_slots = F.explode(F.sequence(F.lit(0), (F.col("slots") - 1).cast("int")))
    dealt = inside.withColumn("kind", F.lit(2)).withColumn("slot", slot).withColumn("block", to_blocks).select(key)
    pivots = inside.where(active & (random < F.col("share"))).withColumn("kind", F.lit(1)).withColumn("block", block).withColumn("slot", to_slots).select(key)
    both = dealt.unionByName(pivots)

    def by_slot(df: DataFrame, f: Callable, schema: str) -> DataFrame:
        return df.repartition(parts, "region", "block", "slot").sortWithinPartitions("region", "block", "slot").mapInArrow(lean(f), schema)

    balls = written(by_slot(both, _balls(percent), "region long, forest binary, a binary, b binary"), "balls")
    found.append(balls.select("a", "b").where(F.length("a") > 0))
    if not plan.where("not whole").select("region").limit(1).collect():
        return None
    forest = balls.where(F.length("forest") > 0).join(plan.where("not whole"), "region").withColumn("kind", F.lit(0)).withColumn("block", F.lit(0)).withColumn("cid", F.lit(0).cast("long")).withColumn("label", F.lit(None).cast("long"))
    forest = forest.withColumn("slot", to_slots).withColumn("shingles", F.col("forest")).select(key)
    return written(by_slot(both.where("not whole").unionByName(forest), _route(percent, level), CHILD), "cells")
