"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to shards of bounded size.  Over its shard a task builds
trees, each a sorted array of long hash strings (signs of random projections
about their medians).  A query descends every tree to its longest prefix
match, then ascends all trees together, one bit at a time, until the rows
that share the prefix are enough; those are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.llm.vectors import usable

HASH_BITS = 32
SHARD_ROWS = 8192
QUERY_ROWS = 4096


class HashForest:
    """Sorted arrays of hash strings over the rows of a matrix."""

    def __init__(self, rows: np.ndarray, trees: int, seed: int):
        rng = np.random.default_rng([seed, rows.shape[1]])
        self.planes = [rng.standard_normal((rows.shape[1], HASH_BITS)) for _ in range(trees)]
        self.middles, self.keys, self.order = [], [], []
        for plane in self.planes:
            at = rows @ plane
            self.middles.append(np.median(at, axis=0))
            key = self._strings(at, self.middles[-1])
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.order.append(order)

    @staticmethod
    def _strings(at: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return (at > middle).astype(np.int64) @ (np.int64(1) << np.arange(HASH_BITS - 1, -1, -1))

    def candidates(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """Row numbers for each query: those that share the longest prefix
        at which all trees together hold ``enough`` entries, all rows if none
        does."""
        n, trees = len(queries), len(self.keys)
        strings = [self._strings(queries @ p, m) for p, m in zip(self.planes, self.middles)]
        lo = np.zeros((trees, n), dtype=np.int64)
        hi = np.full((trees, n), len(self.keys[0]), dtype=np.int64)
        open_ = np.arange(n)
        # descent: the longest prefix of each query over all trees; levels
        # below it are empty, so the ascent starts there
        depth = np.zeros(n, dtype=np.int64)
        for key, s in zip(self.keys, strings):
            at = np.searchsorted(key, s)
            for near in (np.minimum(at, len(key) - 1), np.maximum(at - 1, 0)):
                depth = np.maximum(depth, HASH_BITS - np.ceil(np.log2((key[near] ^ s) + 1)).astype(np.int64))
        for level in range(HASH_BITS, 0, -1):
            now = open_[depth[open_] >= level]
            if not len(now):
                continue
            shift = HASH_BITS - level
            begin = np.empty((trees, len(now)), dtype=np.int64)
            end = np.empty_like(begin)
            for t, (key, s) in enumerate(zip(self.keys, strings)):
                prefix = s[now] >> shift
                begin[t] = np.searchsorted(key, prefix << shift)
                end[t] = np.searchsorted(key, (prefix + 1) << shift)
            reached = (end - begin).sum(axis=0) >= enough
            lo[:, now[reached]], hi[:, now[reached]] = begin[:, reached], end[:, reached]
            open_ = np.setdiff1d(open_, now[reached], assume_unique=True)
        out = []
        for q in range(n):
            seen = np.zeros(len(self.keys[0]), dtype=bool)
            for t in range(trees):
                seen[self.order[t][lo[t, q]:hi[t, q]]] = True
            out.append(np.flatnonzero(seen))
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = 96, enough: int = 4000,
            seed: int = 23, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each
    query row, by Euclidean distance in double precision on the original
    vectors, ties to the smaller id; all rows but the query's own are indexed.

    ``enough``: prefix entries per shard at which the ascent stops.  Of equal
    vectors the k + 1 of smallest id are indexed, as no others can be among
    the k nearest.  Rows without an id and vectors that are null, zero or
    hold null or non-finite components take no part; vectors meet only those
    of their own length; fewer candidates than ``k`` are all returned; a
    repeated id counts once, with the vector that sorts first; an empty table
    gives an empty table.
    """
    rows = usable(vectors, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    marked = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    queries = rows.join(marked, "id", "left_semi")
    equal = Window.partitionBy("v").orderBy("id")
    indexed = rows.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1).drop("n")
    shards = max(1, -(-indexed.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    own_shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    own_block = F.pmod(F.xxhash64("id", F.lit("query")), F.lit(blocks)).cast("int")
    # the stated queries against all rows, in blocks
    dealt = indexed.select(own_shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                           F.lit(False).alias("asks"), "id", "v").union(
        queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), own_block.alias("block"),
                       F.lit(True).alias("asks"), "id", "v"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        for _, same in pdf.groupby(pdf["v"].map(len)):
            q, m = same[same.asks], same[~same.asks]
            if q.empty or m.empty:
                continue
            x, y = np.stack(q["v"].to_numpy()), np.stack(m["v"].to_numpy())
            ids = m["id"].to_numpy()
            forest = HashForest(y, trees, seed)
            for query, own, at in zip(x, q["id"].to_numpy(), forest.candidates(x, max(enough, k + 1))):
                at = at[ids[at] != own]
                apart = np.sqrt(np.square(y[at] - query).sum(axis=1))
                best = np.lexsort((ids[at], apart))[:k]
                found["query_id"] += [own] * len(best)
                found["vec_id"] += ids[at][best].tolist()
                found["score"] += apart[best].tolist()
        return pd.DataFrame(found).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.groupBy("shard", "block").applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
