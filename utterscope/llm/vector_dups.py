"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered lexicographically by a string of random
hyperplane hashes and compared with a bounded window of neighbours.  Where
vectors crowd in a cone many share a long prefix, so besides that trees that
cut a sample at the medians of random projections deal all vectors to leaves,
inside which all pairs are compared; trees are added until the wanted share
of partners at the threshold, drawn beside sampled vectors, has met.  Pairs
whose cosine passes are united across passes and trees.  Inside a group found that way
all direct links are then counted in blocks, so a dense group larger than
the window loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.simhash import star_edges
from utterscope.llm.vectors import matrix, usable
from utterscope.operators.components import connected_components
from utterscope.session import reliable_checkpoint

HASH_BITS = 62
BLOCK = 1024  # members of a group that are compared at a time

LEAF = 1024  # vectors of a leaf, about
SAMPLE = 16_384  # sampled vectors that trees are built of, at least


def passes_needed(rows: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair just at the threshold has met with
    probability ``recall``: it meets in a pass if its hashes agree on the
    bits that cut ``rows`` down to a window."""
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(0.0, math.log2(max(rows, 1) / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 4


def _hash_rows(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                some = b.filter(pa.array(sizes == dim))
                x = matrix(some.column(1), dim)
                for p in range(passes):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([seed, p, int(dim)]).standard_normal((dim, HASH_BITS))
                    bits = (x @ planes[p, dim]) > 0
                    hashed = bits.astype(np.int64) @ (np.int64(1) << np.arange(HASH_BITS - 1, -1, -1))
                    n = len(hashed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, dtype=np.int32)), pa.array(np.full(n, dim, dtype=np.int32)),
                         pa.array(hashed), some.column(0), some.column(1)], names=["pass", "dim", "hash", "id", "v"])

    return run


def _window_links(threshold: float, window: int):
    """Edges between window neighbours whose cosine passes, as stars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            lists = [(p, d) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cuts = [0] + [i for i in range(1, len(lists)) if lists[i] != lists[i - 1]] + [len(lists)]
            src, dst = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                ids, x = part.column(3).to_numpy(), matrix(part.column(4), lists[lo][1])
                if tail is not None and tail[0] == lists[lo]:
                    ids, x = np.concatenate([tail[1], ids]), np.concatenate([tail[2], x])
                norm = np.sqrt((x * x).sum(axis=1))
                for step in range(1, min(window, len(ids) - 1) + 1):
                    cos = (x[:-step] * x[step:]).sum(axis=1) / (norm[:-step] * norm[step:])
                    near = np.flatnonzero(cos >= threshold)
                    src.append(ids[near])
                    dst.append(ids[near + step])
                tail = (lists[lo], ids[-window:], x[-window:])
            if src:
                a, c = star_edges(np.concatenate(src), np.concatenate(dst))
                yield pa.RecordBatch.from_pydict({"src": a, "dst": c})

    return run


class Tree:
    """Cuts of vectors at medians of random projections, until ``least`` of
    the given vectors are left in a leaf."""

    def __init__(self, x: np.ndarray, least: float, rng: np.random.Generator):
        planes, cuts, below, todo = [], [], [], [(np.arange(len(x)), None)]
        while todo:
            rows, of = todo.pop()
            node = len(below)
            if of is not None:
                below[of[0]][of[1]] = node
            plane = rng.standard_normal(x.shape[1])
            at = x[rows] @ plane
            cut = np.median(at)
            high = at > cut
            planes.append(plane)
            cuts.append(cut)
            below.append([-1, -1])  # a leaf
            if len(rows) > max(1, least) and high.any():
                todo += [(rows[~high], (node, 0)), (rows[high], (node, 1))]
        self.planes, self.cuts, self.below = np.array(planes), np.array(cuts), np.array(below)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node, inner = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = inner[self.below[node[inner], 0] >= 0]
            if not len(inner):
                return node
            now = node[inner]
            high = (x[inner] * self.planes[now]).sum(axis=1) > self.cuts[now]
            node[inner] = self.below[now, high.astype(np.int64)]


def grown_trees(x: np.ndarray, rows: int, threshold: float, recall: float, seed: int) -> list[Tree]:
    """Trees of the sampled unit vectors ``x`` of ``rows``, as many as let the
    share ``recall`` of drawn pairs at the threshold meet in a leaf."""
    rng = np.random.default_rng([seed, x.shape[1]])
    near = x[:4096]
    aside = rng.standard_normal(near.shape)
    aside -= (aside * near).sum(axis=1)[:, None] * near
    size = np.sqrt((aside * aside).sum(axis=1))[:, None]
    partners = threshold * near + math.sqrt(max(0.0, 1 - threshold * threshold)) * np.divide(
        aside, size, out=np.zeros_like(aside), where=size > 1e-9)
    trees, met = [], np.zeros(len(near), dtype=bool)
    while not trees or met.mean() < recall:
        trees.append(Tree(x, LEAF * len(x) / rows, rng))
        met |= trees[-1].leaves(near) == trees[-1].leaves(partners)
    return trees


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _leaf_links(distinct: DataFrame, threshold: float, recall: float, seed: int) -> DataFrame:
    """Edges between vectors of a leaf whose cosine passes, as stars."""
    trees = {}
    sized = distinct.select("id", "v", F.size("v").alias("dim"))
    for dim, rows in sized.groupBy("dim").count().collect():
        some = sized.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, 16 * rows // LEAF)).collect()
        trees[dim] = grown_trees(_unit(np.array([r.v for r in some])), rows, threshold, recall, seed)
    shared = distinct.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                some = b.filter(pa.array(sizes == dim))
                x = _unit(matrix(some.column(1), dim))
                for t, tree in enumerate(shared.value[int(dim)]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(np.full(len(x), dim, dtype=np.int32)),
                         pa.array(tree.leaves(x)), some.column(0), some.column(1)], names=["tree", "dim", "leaf", "id", "v"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())
        norm = np.sqrt((x * x).sum(axis=1))
        parts = []
        for i in range(0, len(ids), BLOCK):
            for j in range(i, len(ids), BLOCK):
                a, c = slice(i, i + BLOCK), slice(j, j + BLOCK)
                near = (x[a] @ x[c].T) / (norm[a][:, None] * norm[c][None, :]) >= threshold
                q, m = np.nonzero(np.triu(near, 1) if i == j else near)
                if len(q):
                    parts.append(star_edges(ids[a][q], ids[c][m]))
        return pd.DataFrame({"src": np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64),
                             "dst": np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)})

    dealt = distinct.select("id", "v").mapInArrow(deal, "tree int, dim int, leaf long, id long, v array<double>")
    return dealt.groupBy("tree", "dim", "leaf").applyInPandas(compare, "src long, dst long")


def _count_links(groups: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): per member of (component, id, copies, v) the rows of
    other members of its component whose cosine passes.  A component of many
    blocks is compared block by block, each pair of blocks a task of its own;
    only counts leave a task."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = other.select("component", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "id", "copies", "v")
    answers = other.select("component", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), "id", "copies", "v")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = pdf[pdf.asks], pdf[~pdf.asks]
        if q.empty or m.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "linked": pd.Series(dtype="int64")})
        x, y = (np.stack(p["v"].to_numpy()) for p in (q, m))
        norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
        near = (x @ y.T) / norm >= threshold
        near &= q["id"].to_numpy()[:, None] != m["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": q["id"], "linked": near @ m["copies"].to_numpy()})

    # dealt by block pair, or all blocks of a component would follow it into one task
    return (asks.union(answers).repartition("component", "i", "j").groupBy("component", "i", "j").applyInPandas(count, "id long, linked long")
            .groupBy("id").agg(F.sum("linked").alias("linked")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, window: int = 32, recall: float = 0.99,
                    seed: int = 17, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    ``n_links``: other rows linked directly (cosine at least ``threshold`` in
    double precision); ``component_id``: smallest id reachable by links,
    itself included; ``kept``: whether that is the row's own id.  Equal
    vectors are compared once and always linked.  Vectors that are null, zero
    or hold null or non-finite components, and rows without an id, link with
    nothing; vectors of different length never link; a repeated row counts as
    another row; an empty table gives an empty table.
    """
    rows = usable(vectors, id_col, vec_col)
    distinct = reliable_checkpoint(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    passes = passes_needed(distinct.count(), threshold, window, recall)
    ordered = (distinct.select("id", "v").mapInArrow(_hash_rows(passes, seed), "pass int, dim int, hash long, id long, v array<double>")
               .repartitionByRange("pass", "dim", "hash").sortWithinPartitions("pass", "dim", "hash", "id"))
    links = ordered.mapInArrow(_window_links(threshold, window), "src long, dst long")
    found = connected_components(links.union(_leaf_links(distinct, threshold, recall, seed)))
    found = reliable_checkpoint(found)
    linked = _count_links(found.join(distinct, "id").select("component", "id", "copies", "v"), threshold)
    nodes = (distinct.join(found, "id", "left").join(linked, "id", "left")
             .select("v", F.coalesce("component", "id").alias("component_id"),
                     (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    of_row = rows.join(nodes, "v").select("id", "n_links", "component_id").dropDuplicates(["id"])
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    return (ids.join(of_row, ids["vec_id"] == of_row["id"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
