"""Exact k-nearest-neighbour join (F6) and nearest other-label row.

Rows fall into Voronoi cells of P pivots (a deterministic hash sample, P
bounded by a parameter).  The asking rows are dealt to blocks; each block
meets all rows (``blocks``), cell by cell, and keeps the k nearest so far of
each of its rows.  By the triangle inequality a row meets no members of a cell
that all are farther than its k-th nearest so far.  On rows without structure
no cell can be left out, so all rows meet all rows, in bounded memory;
``neighbor_graph`` is the linear, approximate form.

Similarity is cosine; distances are Euclidean between unit vectors
(d^2 = 2 - 2 cos), so the neighbour order is the cosine order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterscope.functions import vectors as vx
from utterscope.operators.blocks import ASK_ROWS, LAST, blocks_against_all, equal_keys, key_numbers, matrix, n_blocks, runs
from utterscope.operators.neighbor_graph import knn_join_sorted, neighbor_graph  # noqa: F401


HALF = 6e-13  # cosines are rounded to 12 places: over half a unit


def _celled(pivots: np.ndarray, names: list[str]):
    """Rows with the number of the nearest pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = _pivot_distances(matrix(pa.chunked_array([b.column(names.index("_u"))])), pivots).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])
    return run


def _pivot_distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (u * u).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * u @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


class _Nearest:
    """The ``k`` nearest rows so far of each asking key: itself first, then by
    cosine descending and key ascending.  Candidates gather until they are
    as many as the lists, so that lists are seldom ranked."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray, extra: list[str]):
        self.key, self.of = np.unique(ids, return_inverse=True)  # rows that repeat a key share a list
        self.k, self.extra = k, extra
        self.least, self.last = least, np.full(len(ids), LAST)  # what a candidate must reach, by cosine and key
        self.most = max(10_000, len(ids) * k)
        self.held: list[pa.Table] = []
        self.new = 0

    def add(self, row: np.ndarray, cos: np.ndarray, nb: np.ndarray, own: bool, members: pa.Table, at: np.ndarray) -> None:
        if not len(row):
            return
        columns = {"row": pa.array(row), "cos": pa.array(cos), "nb": pa.array(nb), "own": pa.array(np.full(len(row), own))}
        self.held.append(pa.table(columns | {f"nb_{c}": members[c].take(pa.array(at)) for c in self.extra}))
        self.new += len(row)
        if self.new >= self.most:
            self.rank()

    def rank(self) -> pa.Table | None:
        if not self.held:
            return None
        t = pa.concat_tables(self.held)
        row, cos, nb, own = (t[c].to_numpy() for c in ("row", "cos", "nb", "own"))
        of = self.of[row]
        order = np.lexsort((row, nb, -cos, ~own, of))
        of = of[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        order, of, place = order[place < self.k], of[place < self.k], place[place < self.k]
        t = t.take(pa.array(order)).combine_chunks()
        full = np.flatnonzero(place == self.k - 1)
        least, last = np.full(len(self.key), -np.inf), np.full(len(self.key), LAST)
        least[of[full]] = np.where(own[order[full]], np.inf, cos[order[full]])
        last[of[full]] = nb[order[full]]
        least, last = least[self.of], last[self.of]
        better = least >= self.least
        self.last = np.where(better, last, self.last)
        self.least = np.maximum(least, self.least)
        self.held, self.new = [t], 0
        return t.append_column("rank", pa.array((place + 1).astype(np.int32)))


def _compared(k: int, pivots: np.ndarray, key: str, extra: list[str]):
    """The nearest rows of each asking row, for blocks of ``blocks_against_all``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asking, met in runs(batches):
            ids = key_numbers(asking["_id"])
            u = matrix(asking["_u"])
            known = np.argsort(ids, kind="stable")
            far = _pivot_distances(u, pivots)
            lists = _Nearest(ids, k, asking["_least"].fill_null(-np.inf).to_numpy().copy(), extra)
            for tile in met:
                cells = tile["cell"].to_numpy()
                edges = np.r_[0, np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(cells)]
                for lo, hi in zip(edges[:-1], edges[1:]):
                    _meet(lists, ids, u, known, far[:, cells[lo]], pivots[cells[lo]],
                          tile.slice(lo, hi - lo))
            found = lists.rank()
            if found is None:
                continue
            rows = found["row"].combine_chunks()
            columns = {key: asking["_id"].take(rows), f"nb_{key}": pa.compute.if_else(
                pa.compute.equal(found["nb"], LAST), None, found["nb"]), "rank": found["rank"], "cos": found["cos"]}
            columns |= {c: asking[c].take(rows) for c in extra} | {f"nb_{c}": found[f"nb_{c}"] for c in extra}
            yield from pa.table(columns).combine_chunks().to_batches(max_chunksize=10_000)
    return run


def _meet(lists: _Nearest, ids: np.ndarray, u: np.ndarray, known: np.ndarray, far: np.ndarray, pivot: np.ndarray, members: pa.Table) -> None:
    """Compares the asking rows with some members of one cell, but those for
    which the triangle inequality says that no member is near enough."""
    mids, mu = key_numbers(members["_id"]), matrix(members["_u"])
    i, j = equal_keys(ids[known], mids)
    i = known[i]
    lists.add(i, np.round((u[i] * mu[j]).sum(1), 12), mids[j], True, members, j)
    radius = _pivot_distances(mu, pivot[None, :]).max()
    reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(lists.least, -1.0)))
    near = np.flatnonzero(far - radius <= reach + 1e-6)
    first = mids.min()
    for at in range(0, len(near), ASK_ROWS):
        rows = near[at:at + ASK_ROWS]
        cos = u[rows] @ mu.T
        # of equally near ones only the smaller key counts
        bound = lists.least[rows] + np.where(lists.last[rows] < first, HALF / 2, -HALF)
        hits = cos > bound[:, None]
        if np.count_nonzero(hits) > 4 * lists.k * len(rows) and lists.k < len(mids):
            kth = np.partition(cos, len(mids) - lists.k, axis=1)[:, len(mids) - lists.k]
            hits = cos > np.maximum(bound, kth - 2 * HALF)[:, None]
        i, j = np.nonzero(hits)
        c = np.round(cos[i, j], 12)
        of = rows[i]
        good = ((c > lists.least[of]) | ((c == lists.least[of]) & (mids[j] < lists.last[of]))) & (
            (ids[of] != mids[j]) | (mids[j] == LAST))
        lists.add(of[good], c[good], mids[j[good]], False, members, j[good])


def knn_join(df: DataFrame, key: str, vec: str, k: int = 20, n_pivots: int = 64, seed: int = 42, extra: list[str] | None = None,
             block_rows: int = 2048, least: DataFrame | None = None) -> DataFrame:
    """Top-k most cosine-similar rows per row: the row itself first, then by
    cosine (rounded to 12 places) descending and key ascending; the cosine
    with a zero vector is 0.  Output: (key, nb_<key>, rank, cos [, extra cols of
    both sides]).

    ``least`` (key, least), if given, holds a cosine that ``k`` rows are known
    to reach, itself counted: rows beneath it aren't listed.
    """
    from utterscope.session import written_table
    extra = list(extra or [])
    base = df.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("_id"), vx.unit(vx.as_double(vec)).alias("_u"), *extra)
    if least is None:
        base = base.withColumn("_least", F.lit(None).cast("double"))
    else:
        known = least.groupBy(F.col(key).alias("_id")).agg(F.min("least").alias("_least"))
        base = base.join(known, "_id", "left").select("_id", "_u", *extra, "_least")
    base = written_table(base, "points")
    blocks = n_blocks(base, "_u", block_rows)
    # pivots: the rows with the smallest seeded hash, one per block of rows, at
    # most n_pivots: they go to all tasks
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")))
    chosen = base.select("_u", h.alias("_h"), "_id").orderBy("_h", "_id").limit(
        max(1, min(n_pivots, -(-base.count() // block_rows)))).collect()
    pivots = np.array([r["_u"] for r in chosen], dtype=float)
    names = base.columns
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    points = written_table(base.mapInArrow(_celled(pivots, names), ", ".join(f"`{c}` {types[c]}" for c in names) + ", cell int"), "cells")
    schema = ", ".join([f"`{key}` long", f"`nb_{key}` long", "rank int", "cos double", *(f"`{c}` {types[c]}" for c in extra),
                        *(f"`nb_{c}` {types[c]}" for c in extra)])
    return blocks_against_all(points, "_id", ["cell", "_id"], blocks, _compared(k, pivots, key, extra), schema)


def nearest_other_label(knn: DataFrame, key: str, label: str) -> DataFrame:
    """within each row's top-k, the most similar row with a different
    label (none when all k share the row's label)."""
    diff = knn.where(F.col(label) != F.col(f"nb_{label}"))
    w = Window.partitionBy(key).orderBy("rank")
    return diff.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
