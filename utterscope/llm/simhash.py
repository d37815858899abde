"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint of 64 bits is eight positional bytes.  Two fingerprints that
differ in at most four bits differ in at most four bytes, so they share at
least four positional bytes; the index lists fingerprints under twenty
triples of positions chosen so that any four positions hold one of the
triples.  Pairs on a list are tallied for shared positional bytes, those
that reach four are retained and verified by their bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from utterscope.llm.common import map_texts, texts
from utterscope.llm.rows import free_name
from utterscope.operators.components import connected_components
from utterscope.session import reliable_checkpoint, sized_broadcast

BYTES = 8
LANES = np.uint64(0x0101010101010101)
MAX_LIST = 1024  # longer lists go through shared midpoints instead of pairs


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any 4 positions hold one:
    positions in three groups on a ring, triples inside a group or with two
    positions in a group and one in the next (Turan's construction)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for g, nxt in zip(groups, groups[1:] + groups[:1]):
        out += [(*pair, one) for pair in combinations(g, 2) for one in nxt]
    return out


def shingle_hashes(text: str, words: int = 4) -> list[int]:
    """XXH64 (seed 42) of every run of ``words`` words of the text, A-Z in
    lower case, joined by single spaces; of all its words if there are
    fewer; none without words."""
    found = text.encode().lower().split()
    if not found:
        return []
    data = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(data, 42)]
    begins = np.cumsum([0] + [len(w) + 1 for w in found])
    digest = xxhash.xxh64_intdigest
    return [digest(data[s:e], 42) for s, e in zip(begins[:-words].tolist(), (begins[words:] - 1).tolist())]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` hashes the 64-bit value whose bits are set in
    over half of them; 0 for an empty run."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    # counts fit a byte in blocks of 255 hashes: eight counters per 64-bit lane
    blocks = (sizes[full] + 254) // 255
    first = np.repeat(np.cumsum(sizes[full]) - sizes[full], blocks)
    inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = first + 255 * inner
    doc_starts = np.cumsum(blocks) - blocks
    for shift in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(shift) & LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_starts, axis=0)
        over = (2 * counts > sizes[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(over).view(np.uint64).ravel() << np.uint64(shift)
    return out


def fingerprints_of(values: list[str], words: int) -> np.ndarray:
    """The fingerprints of texts, as signed longs."""
    fp = []
    for at in range(0, len(values), 50):
        hashed = [shingle_hashes(t, words) for t in values[at:at + 50]]
        flat = np.fromiter((h for x in hashed for h in x), dtype=np.uint64)
        fp.append(majority_bits(flat, np.array([len(x) for x in hashed], dtype=np.int64)))
    return np.concatenate(fp).view(np.int64) if fp else np.zeros(0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint (as a signed long) of every whole
    text; 0 for a text without words (null: empty)."""
    def batch(ids: list, values: list) -> dict:
        return {"doc_id": pa.array(ids, type=pa.int64()), "fp": pa.array(fingerprints_of(values, words), type=pa.int64())}

    return map_texts(texts(docs, id_col, text_col), batch, "doc_id long, fp long")


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex of the links (a, b) to the smallest vertex it
    reaches through them: as few as there are vertices."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _list_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints on the same list (keys ascending)."""
    left, right = [], []
    at, step = np.arange(len(keys)), 0
    while True:
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        apart = fps[at] ^ fps[at + step]
        shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        retained = shared >= BYTES - max_bits
        near = retained & (np.bitwise_count(apart) <= max_bits)
        left.append(fps[at[near]])
        right.append(fps[at[near] + step])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _linked(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(everything: bool) -> pa.RecordBatch | None:
            keys, fps = (np.concatenate(x) for x in zip(*held))
            cut = len(keys) if everything else int(np.searchsorted(keys, keys[-1]))
            held[:] = [(keys[cut:], fps[cut:])]
            a, b = star_edges(*_list_links(keys[:cut], fps[:cut], max_bits))
            return pa.RecordBatch.from_pydict({"src": a.view(np.int64), "dst": b.view(np.int64)})

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False),
                         batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if sum(len(k) for k, _ in held) >= 200_000:
                yield flush(False)
        if held:
            yield flush(True)

    return run


def _midpoints(max_bits: int):
    """Every value within half the bit distance of a fingerprint: two
    fingerprints are linked exactly if they share such a value."""
    half, odd = max_bits // 2, max_bits % 2
    masks = np.array([sum(1 << b for b in bits) for n in range(half + odd + 1) for bits in combinations(range(64), n)],
                     dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 50):
                some = fps[at:at + 50]
                points = (some.view(np.uint64)[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_pydict({"point": points, "fp": np.repeat(some, len(masks))})

    return run


def links(fps: DataFrame, max_bits: int = 4, max_list: int = MAX_LIST) -> DataFrame:
    """(src, dst): edges between distinct fingerprints (``fp``) that connect
    exactly those at most ``max_bits`` (4 at most) apart, directly or through
    others; as many edges as list entries at most, however dense a group."""
    if not 0 <= max_bits <= 4 or max_bits % 2:
        raise ValueError("max_bits must be 0, 2 or 4")
    def byte(p):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    index = fps.select("fp", F.explode(F.array(*[
        F.shiftleft(F.lit(i).cast("long"), 24).bitwiseOR(F.shiftleft(byte(p), 16))
        .bitwiseOR(F.shiftleft(byte(q), 8)).bitwiseOR(byte(r))
        for i, (p, q, r) in enumerate(covering_triples())])).alias("key"))
    long_lists = reliable_checkpoint(index.groupBy("key").count().filter(F.col("count") > max_list).select("key"))
    schema = "src long, dst long"
    if long_lists.isEmpty():
        return index.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_linked(max_bits), schema)
    long_lists = sized_broadcast(long_lists, 100_000)
    short = (index.join(long_lists, "key", "left_anti").select("key", "fp").repartition("key")
             .sortWithinPartitions("key").mapInArrow(_linked(max_bits), schema))
    points = (index.join(long_lists, "key", "left_semi").select("fp").distinct()
              .mapInArrow(_midpoints(max_bits), "point long, fp long"))
    centre = points.groupBy("point").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = (points.join(centre, "point").filter(F.col("fp") != F.col("dst"))
               .select(F.col("fp").alias("src"), "dst").distinct())
    return short.union(starred)


def _rooted(marked: DataFrame, max_bits: int, max_list: int) -> DataFrame:
    """(fp, doc, root) of the fingerprints of (doc_id, fp): the smallest id
    that has it and the fingerprint that stands for its component."""
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    found = connected_components(links(first.select("fp"), max_bits, max_list))
    return reliable_checkpoint(first.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "doc", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, max_list: int = MAX_LIST,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``fingerprint``: 16 lower-case hex digits; ``component_id``: the smallest
    doc_id that is reachable over fingerprints at most ``max_bits`` apart,
    the document itself included.  A text without words (null, empty, spaces)
    has fingerprint zero, linked like any other.  Null ids get a row and
    never become a component's id, unless it holds no other; repeated rows
    stay; an empty table gives an empty table; other columns are left out.
    """
    marked = reliable_checkpoint(fingerprints(docs, words, id_col, text_col))
    rooted = _rooted(marked, max_bits, max_list)
    named = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprints(docs: DataFrame, words: int, text_col: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each row's text as a last column."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = fingerprints_of([t or "" for t in b.column(at).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, type=pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_first(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when of each near-duplicate group only
    the document of smallest id does, and of those of one id that with the
    smallest fingerprint.  Of rows with the same id and fingerprint the first
    by the SHA-256 of its text stays; documents without an id, which no group
    can name, all stay.  An id that stands for different texts keeps each
    that is first in its group."""
    marked = reliable_checkpoint(fingerprints(docs, words, id_col, text_col).filter("doc_id IS NOT NULL"))
    kept = marked.join(_rooted(marked, max_bits, MAX_LIST).select("fp", "root"), "fp").groupBy("root").agg(
        F.min(F.struct("doc_id", "fp")).alias("first")).select("first.*")
    first, own, order = (free_name(docs, n) for n in ("kept_id", "own_print", "row_order"))
    repeated = reliable_checkpoint(marked.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(first)))
    ids = kept.select(F.col("doc_id").alias(first)).distinct()
    once = docs.join(repeated, docs[id_col] == repeated[first], "left_anti") if not repeated.isEmpty() else docs
    out = once.filter(F.col(id_col).isNotNull()).join(ids, F.col(id_col) == F.col(first), "left_semi").unionByName(
        docs.filter(docs[id_col].isNull()))
    if repeated.isEmpty():
        return out
    again = _with_fingerprints(docs.join(repeated, docs[id_col] == repeated[first], "left_semi"), words, text_col, own)
    among = kept.select(F.col("doc_id").alias(first), F.col("fp").alias("kept_print"))
    again = again.join(among, (F.col(id_col) == F.col(first)) & (F.col(own) == F.col("kept_print")), "left_semi")
    w = Window.partitionBy(id_col, own).orderBy(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256), F.hash("*"))
    ranked = again.withColumn(order, F.row_number().over(w)).filter(F.col(order) == 1)
    return out.unionByName(ranked.select(*docs.columns))
