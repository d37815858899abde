"""Interaction audit of text filters by truth-table survival words.

A document is a word of 2^k bits, one for each subset of the k <= 5 filters:
the bit is set if the document passes every filter of the subset.  A
carry-save positional popcount of the words of a part and label gives the
survivors of all subsets at once; what any order of the filters keeps,
removes or finds removed already follows from these counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import stretches, to_arrow
from utterscope.session import written_table

FILTERS = "ABCDE"
MAX_FILTERS = 5  # 2^5 subsets fill a 32-bit word
HOT_SHARE = 4096  # a text that more than one row in so many holds is hot: fewer than so many texts
MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))


def text_failures(text: str) -> int:
    """Bits of the failed text rules: 1 under 100 words, 2 distinct words
    under 80 % of the words, 4 capitals A-Z over 10 % of the code points,
    8 any of ``#$%&*|``.  Words are runs of anything but ASCII white space."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
            | (100 * capitals > 10 * len(text)) << 2 | (len(data.translate(None, MARKS)) < len(data)) << 3)


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, failed, digest): the text's failures and its SHA-256."""
    schema = "doc_id long, part string, failed int, digest binary"
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(2).to_pylist()
            for lo, hi in stretches(values):
                mine = values[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array([text_failures(t) for t in mine], type=pa.int32()),
                     pa.array([hashlib.sha256(t.encode()).digest() for t in mine])], schema=target)

    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text(part_col).alias("part"),
                       text(text_col).alias("text")).mapInArrow(run, schema)


def _copies_failed(judged: DataFrame, bit: int) -> DataFrame:
    """``judged`` with ``bit`` set in ``failed`` where a smaller id holds the
    same digest.

    First holders are found with partial minima, for repeated digests alone.
    Those of more than one row in ``HOT_SHARE`` (so fewer than ``HOT_SHARE``
    digests) are handed to all tasks; the others are joined by digest, where
    no digest has more than that share of the rows.
    """
    known = judged.filter("doc_id IS NOT NULL")
    total = known.count()
    held = written_table(known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("held"))
                         .filter("held > 1"), "held_texts")
    hot = F.col("held") * HOT_SHARE > total
    often = F.broadcast(held.filter(hot).select("digest", F.col("first").alias("hot_first")))
    marked = judged.join(often, "digest", "left")

    def fails(first: str) -> Column:
        return (F.col("failed") + F.when(F.col("doc_id") > F.col(first), bit).otherwise(0)).alias("failed")

    settled = marked.filter("hot_first IS NOT NULL").select("doc_id", "part", fails("hot_first"))
    rest = marked.filter("hot_first IS NULL").join(held.filter(~hot).select("digest", "first"), "digest", "left")
    return settled.union(rest.select("doc_id", "part", fails("first")))


def survival_words(failed: np.ndarray) -> np.ndarray:
    """The survival word of each failure mask: bit S is set if no filter of
    the subset S (bits as in the mask) is failed."""
    subsets = np.arange(1 << MAX_FILTERS)
    table = np.array([sum(1 << int(s) for s in subsets if not s & m) for m in subsets], dtype=np.uint32)
    return table[failed]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set.

    Carry-save adders take three words of a weight to one sum word of that
    weight and one carry word of twice the weight, until two words at most
    are left of each weight; only those are counted bit by bit.
    """
    counts = np.zeros(32, dtype=np.int64)
    level, weight = words.astype(np.uint32), 1
    bits = np.arange(32, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) >= 3:
            n = len(level) // 3
            a, b, c = level[:n], level[n:2 * n], level[2 * n:3 * n]
            differ = a ^ b
            carries.append((a & b) | (differ & c))
            level = np.concatenate([differ ^ c, level[3 * n:]])
        counts += weight * ((level[:, None] >> bits) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return counts


COUNT_SCHEMA = "part string, good boolean, toxic boolean, survivors array<long>"


def _subset_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors per subset of the rows (part, good, toxic, failed) of a task,
    by part and labels; parts are flushed when many are held."""
    target = to_arrow(COUNT_SCHEMA)
    held: dict[tuple, np.ndarray] = {}

    def flush():
        keys = list(held)
        out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], type=target.field(i).type) for i in range(3)]
                                         + [pa.array([held[k].tolist() for k in keys], type=target.field(3).type)], schema=target)
        held.clear()
        return out

    for b in batches:
        parts = b.column(0).dictionary_encode()
        names = parts.dictionary.to_pylist()
        label = (parts.indices.to_numpy().astype(np.int64) * 4
                 + b.column(1).to_numpy(zero_copy_only=False) * 2 + b.column(2).to_numpy(zero_copy_only=False))
        words = survival_words(b.column(3).to_numpy())
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        for mine in np.split(order, cuts):
            if len(mine):
                code = int(label[mine[0]])
                key = (names[code >> 2], bool(code & 2), bool(code & 1))
                held[key] = held.get(key, 0) + positional_popcount(words[mine])
        if len(held) > 10_000:
            yield flush()
    if held:
        yield flush()


def subset_survivors(judged: DataFrame) -> DataFrame:
    """(part, survivors, good, toxic): for each part the documents that each
    subset of filters lets through, all of them, the good and the toxic ones;
    arrays of 32 counts, indexed by the subset's bits.

    ``judged`` has (part, good, toxic, failed).  A part and label may hold
    most rows: tasks send 32 counts of it, not its documents.
    """
    counted = judged.select("part", "good", "toxic", "failed").mapInArrow(_subset_survivors, COUNT_SCHEMA)
    spread = counted.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "n"))
    summed = spread.groupBy("part", "subset").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    rows = F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic")))  # 32 of them
    listed = summed.groupBy("part").agg(rows.alias("rows"))
    return listed.select("part", F.col("rows.n").alias("survivors"), F.col("rows.good").alias("good"),
                         F.col("rows.toxic").alias("toxic"))


def order_report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the subset
    counts; see ``audit_filters``."""
    k = len(filters)
    if not 0 < k <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    everything = (1 << k) - 1

    def steps():
        for order in permutations(filters):
            before = 0
            for at, f in enumerate(order):
                yield "".join(order), at + 1, before, bit[f]
                before |= bit[f]

    grid = F.expr("array(" + ", ".join(f"named_struct('o', '{o}', 's', {s}, 'b', {b}, 'f', {f})" for o, s, b, f in steps()) + ")")
    rows = counts.withColumn("at", F.explode(grid)).select(
        "part", "survivors", "good", "toxic", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"),
        F.col("at.b").alias("before"), F.col("at.f").alias("own"))

    def survive(kind: str, subset) -> Column:
        return F.element_at(kind, subset + 1)

    own, before = F.col("own"), F.col("before")
    after = before.bitwiseOR(own)
    removed = survive("survivors", before) - survive("survivors", after)
    # a filter's removals over all orders: a subset of j others stands before it in j! (k - 1 - j)! of them
    shares = F.lit(0).cast("long")
    for i, f in enumerate(filters):
        own_sum = sum((factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
                       * (survive("survivors", F.lit(s)) - survive("survivors", F.lit(s | 1 << i)))
                       for s in range(1 << k) if not s >> i & 1), F.lit(0).cast("long"))
        shares = F.when(own == 1 << i, own_sum).otherwise(shares)
    return rows.select(
        "part", "filter_order", "step", survive("survivors", after).alias("kept"), removed.alias("removed"),
        (survive("survivors", F.lit(0)) - survive("survivors", own) - removed).alias("redundant"),
        (survive("survivors", F.lit(everything) - own) - survive("survivors", F.lit(everything))).alias("unique_fails"),
        (survive("good", before) - survive("good", after)).alias("good_lost"),
        (survive("toxic", before) - survive("toxic", after)).alias("toxic_lost"), shares.alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """What five filters do to each part of ``docs``, in each of their orders.

    The filters fail a text of under 100 words (A), with distinct words under
    80 % of the words (B), with capitals A-Z over 10 % of the code points (C),
    that holds any of ``#$%&*|`` (D), or that is the text of a smaller id,
    anywhere in the table (E).  One row per part, order and step:
    (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley), counts of documents; ``shapley`` is what
    the step's filter removes, summed over all orders.

    Null texts are empty, and copies of one another; null parts are the part
    ''.  Rows without an id hold no smaller id: they never fail E, nor make
    another row fail it.  Rows that repeat an id and its text don't fail E by
    each other; each counts.  A document is good (toxic) if any row of
    ``labels`` (doc_id, quality, toxic) of its id has quality (toxic) 1; null
    labels, and labels without a document, count for nothing.  An empty table
    gives an empty report; other columns of either table are left out.
    """
    judged = written_table(_judged(docs, id_col, text_col, part_col), "judged_texts")
    marked = _copies_failed(judged, 1 << FILTERS.index("E"))
    told = labels.filter(f"{id_col} IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good OR toxic")
    known = marked.filter("doc_id IS NOT NULL").join(told, F.col("doc_id") == F.col("label_id"), "left").select(
        "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "failed")
    nameless = marked.filter("doc_id IS NULL").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "failed")
    return order_report(subset_survivors(known.union(nameless)))
