"""Removal of repeated byte strings by bucket-pointer refinement.

Every window of 100 bytes that also starts earlier is a repeat.  Blocks of
windows with the same minimizer are compared whole first: of equal blocks the
earliest stays, the windows of the others are repeats.  Blocks that share a
minimizer but differ are brought together, and the suffixes of their bytes
are sorted: buckets of equal q-grams, refined by sorting on the bucket
pointers of later offsets, the refined pointers being used again for the next
and longer offset.  Suffixes that end in one bucket share 100 bytes; all but
the earliest are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.byte_windows import LENGTH, block_hashes, blocks
from utterscope.llm.common import texts, to_arrow
from utterscope.session import sized_broadcast, written_table

GRAM_BYTES = 7  # bytes of the first buckets
BUCKET_BYTES = 2_000_000  # bytes whose suffixes a task sorts together
HELD_BLOCKS = 600_000  # blocks that a task compares before it hands them on
MAX_SHARED = 16_384  # differing blocks of one minimizer that are sorted together
NO_ID = -(2**63)  # stands for a null id, before all others

REPEAT, FIRST = 0, 1
BLOCK_SCHEMA = "kind int, gram long, whole long, doc long, first long, count long"


def _runs(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows as few runs (doc, first, count): adjacent ones joined."""
    order = np.lexsort((first, doc))
    doc, first, count = doc[order], first[order], count[order]
    if not len(doc):
        return doc, first, count
    new = np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + count[:-1])]
    at = np.flatnonzero(new)
    ends = np.maximum.reduceat(first + count, at)
    return doc[at], first[at], ends - first[at]


def _block_batch(kind: int, gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, first: np.ndarray,
                 count: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind, dtype=np.int32), gram, whole, doc, first, count]
    schema = to_arrow(BLOCK_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema)],
                                      schema=schema)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts; those that repeat one of the same stretch of rows
    come out as repeats, so a common block leaves a task about once."""
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def flush() -> Iterator[pa.RecordBatch]:
        gram, whole, doc, first, count = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((first, doc, whole, gram))
        gram, whole, doc, first, count = (x[order] for x in (gram, whole, doc, first, count))
        new = np.r_[True, (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ((doc != doc[lead]) | (first != first[lead])).nonzero()[0]
        yield _block_batch(FIRST, *(x[new] for x in (gram, whole, doc, first, count)))
        runs = _runs(doc[again], first[again], count[again])
        spread = (runs[0] * 31 + runs[1]) * np.int64(0x2545F4914F6CDD1D)
        yield _block_batch(REPEAT, spread, spread, *runs)

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = text.encode()
            first, count, gram = blocks(data)
            if len(first):
                held.append((gram, block_hashes(data, first, count), np.full(len(first), doc), first, count))
                waiting += len(first)
            if waiting >= HELD_BLOCKS:
                yield from flush()
                waiting = 0
    if held:
        yield from flush()


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks that arrive by kind, minimizer, content, document and place:
    repeats as they are; later ones of equal blocks as repeats; the first of
    equal blocks if its minimizer has blocks that differ from it."""
    lead = None  # (gram, whole, doc, first) of the equal blocks at hand
    lone = None  # a first block of whose minimizer no other is known yet
    shared = None  # the minimizer at hand, known to have several blocks
    for b in batches:
        kind, gram, whole, doc, first, count = (c.to_numpy() for c in b.columns)
        old = kind == REPEAT
        if old.any():
            yield _block_batch(REPEAT, *(x[old] for x in (gram, whole, doc, first, count)))
        gram, whole, doc, first, count = (x[~old] for x in (gram, whole, doc, first, count))
        if not len(gram):
            continue
        new = np.r_[lead is None or (gram[0], whole[0]) != lead[:2], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])]
        of = np.cumsum(new)
        lead_doc = np.r_[lead[2] if lead else 0, doc[new]][of]
        lead_first = np.r_[lead[3] if lead else 0, first[new]][of]
        again = (doc != lead_doc) | (first != lead_first)
        yield _block_batch(REPEAT, *(x[again] for x in (gram, whole, doc, first, count)))
        lead = (gram[-1], whole[-1], lead_doc[-1], lead_first[-1])
        rows = [x[new] for x in (gram, whole, doc, first, count)]
        if lone is not None:
            rows = [np.r_[y, x] for x, y in zip(rows, lone)]
            lone = None
        g = rows[0]
        if not len(g):
            continue
        same = np.r_[g[0] == shared, g[1:] == g[:-1]] if shared is not None else np.r_[False, g[1:] == g[:-1]]
        several = same | np.r_[same[1:] & (g[1:] == g[:-1]), False]
        if several[-1]:
            shared = g[-1]
        else:
            lone, shared = [x[-1:] for x in rows], None
        yield _block_batch(FIRST, *(x[several] for x in rows))


def equal_windows(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each place of ``at``, the same exactly for places whose
    ``LENGTH`` bytes are equal, by bucket-pointer refinement of the suffixes
    of ``codes``."""
    n = len(codes)
    padded = np.r_[codes, np.zeros(LENGTH, dtype=np.uint8)].astype(np.int64)
    gram = np.zeros(n, dtype=np.int64)
    for k in range(GRAM_BYTES):
        gram = gram << 8 | padded[k:k + n]
    order = np.argsort(gram, kind="stable")
    pointer = np.empty(n + LENGTH, dtype=np.int64)
    pointer[n:] = -1

    def point(suffixes: np.ndarray, slots: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Set the pointers of sorted suffixes to the first slot of their
        bucket; returns which share one."""
        new = np.r_[True, key[1:] != key[:-1]]
        pointer[suffixes] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        return ~(new & np.r_[new[1:], True])

    slots = np.arange(n)
    open_ = point(order, slots, gram[order])
    depth = GRAM_BYTES
    while depth < LENGTH and open_.any():
        order, slots = order[open_], slots[open_]
        deeper = min(2 * depth, LENGTH)
        key = pointer[order] * (n + 1) + pointer[order + (deeper - depth)] + 1
        by = np.argsort(key, kind="stable")
        order = order[by]
        open_ = point(order, slots, key[by])
        depth = deeper
    return pointer[at]


RUN_SCHEMA = "doc long, first long, count long"


def _run_batch(doc, first, count) -> pa.RecordBatch:
    schema = to_arrow(RUN_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in _runs(doc, first, count)], schema=schema)


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Repeated windows of the blocks (doc, first, bytes) of a bucket."""
    table = table.combine_chunks()
    doc, first = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "first"))
    parts = table.column("bytes").to_pylist()
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    codes = np.frombuffer(b"".join(parts), dtype=np.uint8)
    windows = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(parts)), windows)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    number = equal_windows(codes, (np.cumsum(sizes) - sizes)[row] + inner)
    doc, place = doc[row], first[row] + inner
    order = np.lexsort((place, doc, number))
    number, doc, place = number[order], doc[order], place[order]
    new = np.r_[True, number[1:] != number[:-1]]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (doc != doc[lead]) | (place != place[lead])
    return pa.Table.from_batches([_run_batch(doc[again], place[again], np.ones(again.sum(), dtype=np.int64))])


CUT_SCHEMA = "gram long, doc long, first long, bytes binary"


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the blocks that are asked of each document."""
    schema = to_arrow(CUT_SCHEMA)
    for b in batches:
        for at in range(b.num_rows):
            data, doc = b.column(1)[at].as_py().encode(), b.column(0)[at].as_py()
            rows = [(a["gram"], doc, a["first"], data[a["first"]:a["first"] + a["count"] + LENGTH - 1])
                    for a in b.column(2)[at].as_py()]
            rows = [r for r in rows if len(r[3]) >= LENGTH]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every window of blocks, with its place."""
    for b in batches:
        for doc, first, data in zip(*(b.column(c).to_pylist() for c in ("doc", "first", "bytes"))):
            view, n = memoryview(data), len(data) - LENGTH + 1
            yield pa.RecordBatch.from_pydict({
                "x": np.array([xxhash.xxh3_64_intdigest(view[i:i + LENGTH]) for i in range(n)], dtype=np.uint64).view(np.int64),
                "y": np.array([xxhash.xxh64_intdigest(view[i:i + LENGTH]) for i in range(n)], dtype=np.uint64).view(np.int64),
                "doc": np.full(n, doc), "first": np.arange(first, first + n)})


def repeated_windows(docs: DataFrame, max_shared: int = MAX_SHARED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, first, count): runs of windows of (doc_id, text) that also start
    earlier; runs may overlap."""
    compared = written_table(
        docs.mapInArrow(_block_rows, BLOCK_SCHEMA).repartition("gram")
        .sortWithinPartitions("kind", "gram", "whole", "doc", "first").mapInArrow(_compare_blocks, BLOCK_SCHEMA), "blocks")
    known = compared.filter(F.col("kind") == REPEAT).select("doc", "first", "count")
    differing = compared.filter(F.col("kind") == FIRST)
    total = differing.agg(F.sum(F.col("count") + LENGTH - 1)).first()[0]
    if not total:
        return known

    def bytes_of(wanted: DataFrame) -> DataFrame:
        """Blocks with their bytes; what is asked of a document is bounded by
        its own length.  Every use deals the texts alike, so within a job
        they are shuffled once."""
        asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("gram", "first", "count")).alias("asked"))
        return (docs.withColumnRenamed("doc_id", "doc").join(asked, "doc").select("doc", "text", "asked")
                .mapInArrow(_cut_blocks, CUT_SCHEMA))

    common = written_table(differing.groupBy("gram").count().filter(F.col("count") > max_shared).select("gram"), "common")
    many = not common.isEmpty()
    common = sized_broadcast(common, 100_000) if many else common
    few = differing.join(common, "gram", "left_anti") if many else differing
    buckets = max(1, -(-int(total) // bucket_bytes))
    found = known.union(
        bytes_of(few).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).groupBy("bucket")
        .applyInArrow(_sort_bucket, RUN_SCHEMA))
    if not many:
        return found
    # a minimizer of very many differing blocks: windows one by one, dealt by content
    windows = bytes_of(differing.join(common, "gram", "left_semi")).mapInArrow(
        _window_rows, "x long, y long, doc long, first long")
    lead = windows.groupBy("x", "y").agg(F.min(F.struct("doc", "first")).alias("lead"), F.count("*").alias("n")).filter("n > 1")
    return found.union(windows.join(lead, ["x", "y"]).filter(F.struct("doc", "first") != F.col("lead")).select(
        "doc", "first", F.lit(1).cast("long").alias("count")))


KEPT_SCHEMA = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow(KEPT_SCHEMA)
    for b in batches:
        out = []
        for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            data = text.encode()
            spans: list[list[int]] = []
            for first, last in sorted((r["first"], r["first"] + r["count"] + LENGTH - 1) for r in runs or []):
                last = min(last, len(data))
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(last, spans[-1][1])
                else:
                    spans.append([first, last])
            at = [0, *(x for s in spans for x in s), len(data)]
            out.append((None if doc == NO_ID else doc, len(data), [s[0] for s in spans], [s[1] for s in spans],
                        b"".join(data[x:y] for x, y in zip(at[::2], at[1::2]))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def remove_repeats(docs: DataFrame, max_shared: int = MAX_SHARED, bucket_bytes: int = BUCKET_BYTES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): the UTF-8 bytes of every whole
    text without those covered by a 100-byte string that also starts earlier
    (smaller id, or earlier in the same text), and the removed runs.

    Strings are judged on the input.  A null text counts as empty; null ids
    count as one id before all others; rows that repeat an id and a text stay
    alike, as neither is earlier (rows with one id and different texts are
    judged as one document, place by place); an empty table gives an empty
    table; other columns are left out.
    """
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    runs = (repeated_windows(rows, max_shared, bucket_bytes).groupBy("doc")
            .agg(F.collect_list(F.struct("first", "count")).alias("runs")))
    return (rows.join(runs, rows["doc_id"] == runs["doc"], "left").select("doc_id", "text", "runs")
            .mapInArrow(_remove, KEPT_SCHEMA))
