"""How far the sources of a language diverge in their terms, with exact
integer arithmetic and late strings.

Counting shuffles fixed-width digests of terms and never the terms.  The
least and the greatest string of each digest that is kept tell whether it
stands for more than one term; such a digest is split, its terms being
counted again by their text.  Text is joined to the rows that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterscope.llm.common import stretches, to_arrow
from utterscope.session import sized_broadcast, written_table

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
MAX_GROUPS_BROADCAST = 1_000_000  # groups handed to all tasks, within the byte bound; more are joined by shuffle
MAX_DIGESTS_BROADCAST = 1_000_000  # kept digests handed to all tasks, likewise
HELD_ROWS = 1_000_000  # counts that a task combines before it sends them
PAIRS_AT_ONCE = 2_000_000

_IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_PLACES = np.random.default_rng(12).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Terms:
    """All terms of some texts in order: runs of letters A-Z, a-z and
    non-ASCII characters, A-Z in lower case."""

    def __init__(self, texts: list[str], bits: int = 64):
        parts = [t.encode() for t in texts]
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.data = b"\n".join(parts).lower()  # bytes: A-Z only
        self.codes = np.frombuffer(self.data, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.r_[False, _IN_TERM[self.codes], False].astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.text = np.searchsorted(begins, self.starts, side="right") - 1
        self.digest = self._hash(0)
        if bits < 64:
            self.digest = self.digest & np.uint64((1 << bits) - 1)

    def _hash(self, which: int) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(lengths.sum()) - first
        inside = self.codes[np.repeat(self.starts, lengths) + place]
        weighed = (inside.astype(np.uint64) + np.uint64(1)) * _PLACES[which][place & 255]
        return _finished(np.add.reduceat(weighed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * _PLACES[which][0])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each digest with each of its terms, once: digests, second hashes
        and numbers of occurrences."""
        check = self._hash(1) ^ (self.ends - self.starts).astype(np.uint64)
        order = np.lexsort((check, self.digest))
        d, c = self.digest[order], check[order]
        at = order[np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])] if len(order) else order
        return self.digest[at], check[at], at

    def spelled(self, at: np.ndarray) -> list[str]:
        return [self.data[a:b].decode() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))
    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))


def _numbered(read: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, lng, grp) of all groups, and the seed of the 64-bit
    numbers ``lng`` and ``grp``: the first under which none meet."""
    pairs = written_table(read.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        named = pairs.select("lang", "source", *_numbers(seed))
        apart = named.agg((F.count("*") == F.count_distinct("grp")) & (F.count_distinct("lang") == F.count_distinct("lng"))).first()[0]
        if apart:
            return named, seed
        seed += 1


def _numbers(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "lang").alias("lng"), F.xxhash64(F.lit(seed), "lang", "source").alias("grp")]


def _group_counts(bits: int):
    """(lng, digest, grp, n, docs): occurrences and documents of each digest
    in each group, combined within a task as far as memory is bounded."""
    def combined(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts, axis=1)
        order = np.lexsort(rows[:3])
        rows = rows[:, order]
        new = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
        return np.concatenate([rows[:3, new], np.add.reduceat(rows[3:], new, axis=1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            values, lng, grp = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for lo, hi in stretches(values):
                t = Terms(values[lo:hi], bits)
                if not len(t.digest):
                    continue
                digests, at = np.unique(t.digest, return_inverse=True)
                seen, n = np.unique(t.text * len(digests) + at, return_counts=True)
                owner = lo + seen // len(digests)
                one = np.stack([lng[owner], digests.view(np.int64)[seen % len(digests)], grp[owner], n, np.ones_like(n)])
                held.append(combined([one]))
                size += held[-1].shape[1]
            if size >= HELD_ROWS:
                rows = combined(held)
                held, size = [rows], rows.shape[1]
                if size >= HELD_ROWS // 2:
                    yield batch(rows)
                    held, size = [], 0
        if held:
            yield batch(combined(held))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["lng", "digest", "grp", "n", "docs"])

    return run


def _written_terms(bits: int):
    """(digest, term): each pair at least once, once in a task as far as
    memory is bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 0), dtype=np.uint64)  # digests in order, with the second hash of one term
        for b in batches:
            values = b.column(0).to_pylist()
            for lo, hi in stretches(values):
                t = Terms(values[lo:hi], bits)
                digests, checks, at = t.distinct()
                if seen.shape[1]:
                    place = np.minimum(np.searchsorted(seen[0], digests), seen.shape[1] - 1)
                    new = (seen[0, place] != digests) | (seen[1, place] != checks)
                    digests, checks, at = digests[new], checks[new], at[new]
                yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(t.spelled(at), type=pa.string())],
                                                 names=["digest", "term"])
                both = np.concatenate([seen if seen.shape[1] < HELD_ROWS else seen[:, :0], np.stack([digests, checks])], axis=1)
                seen = both[:, np.argsort(both[0], kind="stable")]
    return run


def _spelled_counts(bits: int):
    """(lng, digest, term, grp, n, docs) as ``_group_counts``, by text."""
    target = to_arrow("lng long, digest long, term string, grp long, n long, docs long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                t = Terms([b.column(0)[at].as_py()], bits)
                count: dict[tuple, int] = {}
                for d, x, y in zip(t.digest.view(np.int64).tolist(), t.starts.tolist(), t.ends.tolist()):
                    key = (d, t.data[x:y].decode())
                    count[key] = count.get(key, 0) + 1
                lng, grp = b.column(1)[at].as_py(), b.column(2)[at].as_py()
                rows = [(lng, d, s, grp, n, 1) for (d, s), n in count.items()]
                columns = zip(*rows) if rows else ([] for _ in target)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)
    return run


def _kept(counts: DataFrame, least: int, *key: str) -> DataFrame:
    """One row per term that at least ``least`` documents of its language
    hold: the key, its total and the counts of its groups."""
    by_group = counts.groupBy(*key, "grp").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_group.groupBy(*key).agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                      F.collect_list(F.struct("grp", "n")).alias("held")).filter(F.col("docs") >= least)


def kept_terms(read: DataFrame, seed: int, least: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lng, digest, split, total, held) and the strings
    (digest, term) of digests that stand for one term.

    ``split`` is null, or the term itself where its digest stands for several:
    those that the least and greatest strings of the digest show to differ.
    """
    rows = read.select("text", *_numbers(seed))
    terms = written_table(_kept(rows.mapInArrow(_group_counts(bits), "lng long, digest long, grp long, n long, docs long"),
                                least, "lng", "digest"), "kept_terms")
    wanted = sized_broadcast(terms.select("digest").distinct(), MAX_DIGESTS_BROADCAST)
    spelled = read.select("text").mapInArrow(_written_terms(bits), "digest long, term string")
    strings = written_table(spelled.join(wanted, "digest", "left_semi").groupBy("digest").agg(
        F.min("term").alias("least"), F.max("term").alias("greatest")), "term_strings")
    several = F.col("least") != F.col("greatest")
    one = strings.filter(~several).select("digest", F.col("least").alias("term"))
    whole = terms.select("lng", "digest", F.lit(None).cast("string").alias("split"), "total", "held")
    shared = strings.filter(several).select("digest")
    if shared.isEmpty():
        return whole, one
    again = rows.mapInArrow(_spelled_counts(bits), "lng long, digest long, term string, grp long, n long, docs long")
    apart = _kept(again.join(shared, "digest", "left_semi"), least, "lng", "digest", "term")
    split = apart.select("lng", "digest", F.col("term").alias("split"), "total", "held")
    return written_table(whole.join(shared, "digest", "left_anti").unionByName(split), "split_terms"), one


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), exact; null for a total of 0."""
    more, all_ = count + F.lit(1).cast("long"), F.when(total > 0, total)
    small = F.call_function("div", F.lit(UNIT).cast("long") * more, all_)
    large = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * more.cast("decimal(20,0)"), all_.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.when(more < 9_000_000_000, small).otherwise(large.cast("long"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both at most UNIT + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, other, value) from the rows (lng, digest, split, grp, p, p0) that
    arrive by term: over terms that both groups hold, the divergence less
    what it would add if one or the other or both hadn't held the term."""
    def sums(grp, p, p0, starts, lengths):
        """The pairs of the rows of whole terms, some at a time."""
        first, many = np.repeat(starts, lengths), np.repeat(lengths, lengths)
        names, number = np.unique(grp, return_inverse=True)
        lo = 0
        done = np.cumsum(many)
        while lo < len(grp):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
            i = np.repeat(np.arange(lo, hi), many[lo:hi])
            before = np.cumsum(many[lo:hi]) - many[lo:hi]
            j = np.repeat(first[lo:hi], many[lo:hi]) + np.arange(len(i)) - np.repeat(before, many[lo:hi])
            i, j = i[i != j], j[i != j]
            value = (_divergences(p[i], p[j]) - _divergences(p[i], p0[j]) - _divergences(p0[i], p[j])
                     + _divergences(p0[i], p0[j]))
            code, at = np.unique(number[i] * len(names) + number[j], return_inverse=True)
            total = np.zeros(len(code), dtype=np.int64)
            np.add.at(total, at, value)
            yield pa.RecordBatch.from_arrays([pa.array(names[code // len(names)]), pa.array(names[code % len(names)]),
                                              pa.array(total)], names=["grp", "other", "value"])
            lo = hi

    held: list[pa.RecordBatch] = []

    def flush(everything: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        lng, digest, grp, p, p0 = (t.column(c).to_numpy() for c in ("lng", "digest", "grp", "p", "p0"))
        split = t.column("split").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new = (lng[1:] != lng[:-1]) | (digest[1:] != digest[:-1]) | (split[1:] != split[:-1])
        starts = np.flatnonzero(np.r_[True, new])
        cut = len(lng) if everything else int(starts[-1])
        held[:] = [] if everything else t.slice(cut).to_batches()
        starts = starts[starts < cut]
        if cut:
            yield from sums(grp[:cut], p[:cut], p0[:cut], starts, np.diff(np.r_[starts, cut]))

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= 200_000:
            yield from flush(False)
            size = 0  # what is carried over is one term
    if held:
        yield from flush(True)


def audit_sources(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
                  text_col: str = "text", lang_col: str = "lang", source_col: str = "source", digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group (lang,
    source) is from the other sources of its language, and by which terms.

    Each language keeps the terms that ``least_documents`` of its rows hold
    (V of them).  In a group or language, a kept term that occurs ``count``
    times among N kept occurrences has
    p = 1 + floor(10^9 (count + 1) / (N + V)); p against q adds
    floor((p - q)^2 / q).  Part ``pair``: item is each other source of the
    language, value the sum over all kept terms with the item's p as q (0
    without kept terms), all ranks.  Part ``term``: item is each kept term
    that the group holds and of which its p exceeds the language's p, the q;
    the ``top`` first ranks.  Ranks go by value descending, then item.

    Null texts, languages and sources are ''.  Every row is a document,
    repeats included.  A group without terms has its pair rows; a language of
    one source has none; an empty table gives an empty table.  A term that
    very many documents hold reaches the shuffle as one row per task, group
    and term.  Terms that both groups of a pair hold are compared one by one,
    all others through the groups' histograms of counts, so rare terms cost
    nothing per pair.  ``digest_bits`` narrows the digests (for tests).
    """
    read = _read(docs, text_col, lang_col, source_col)
    named, seed = _numbered(read)
    terms, strings = kept_terms(read, seed, least_documents, digest_bits)
    held = written_table(terms.select("lng", "digest", "split", "total", F.explode("held").alias("of")).select(
        "lng", "digest", "split", "total", "of.grp", "of.n"), "held_terms")

    # sizes: kept occurrences and terms of each group, and of each language
    own = held.groupBy("grp").agg(F.sum("n").alias("size"), F.count("*").alias("n_terms"))
    langs = terms.groupBy("lng").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_size"))
    zero = F.lit(0).cast("long")
    groups = named.join(own, "grp", "left").join(langs, "lng", "left").select(
        "lng", "grp", "lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("size", "n_terms", "vocabulary", "lang_size")))
    groups = sized_broadcast(groups.withColumn("p0", share(zero, F.col("size") + F.col("vocabulary"))), MAX_GROUPS_BROADCAST)

    total = F.col("size") + F.col("vocabulary")
    rated = held.join(groups.drop("lang", "source", "lng"), "grp").select(
        "lng", "digest", "split", "grp", "n", "p0", share(F.col("n"), total).alias("p"),
        share(F.col("total"), F.col("lang_size") + F.col("vocabulary")).alias("q"))

    # terms, with text for those that may be in the first ranks
    first = Window.partitionBy("grp").orderBy(F.desc("value"))
    likely = rated.filter("p > q").select("grp", "digest", "split", divergence(F.col("p"), F.col("q")).alias("value")).withColumn(
        "place", F.rank().over(first)).filter(F.col("place") <= top)
    spelled = likely.join(strings, "digest", "left").select("grp", F.coalesce("split", "term").alias("item"), "value")
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("value"), "item"))).filter(
        F.col("rank") <= top)
    term_rows = ranked.join(groups, "grp").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # pairs of sources of a language; a pair is a row of the result
    other = groups.select("lng", F.col("grp").alias("other"), F.col("source").alias("item"), F.col("p0").alias("other_p0"),
                          F.col("n_terms").alias("other_terms"))
    pairs = groups.join(other, "lng").filter("grp != other")
    base = pairs.select("grp", "other", F.coalesce((F.col("vocabulary") - F.col("n_terms") - F.col("other_terms")) * divergence(
        F.col("p0"), F.col("other_p0")), zero).alias("value"))
    tally = rated.groupBy("lng", "grp", "p", "p0").agg(F.count("*").alias("terms"))  # terms of one count have one p
    sides = tally.join(other.select("lng", "other", "other_p0"), "lng").filter("grp != other")
    as_own = sides.select("grp", "other", (F.col("terms") * divergence(F.col("p"), F.col("other_p0"))).alias("value"))
    as_other = sides.select(F.col("other").alias("grp"), F.col("grp").alias("other"),
                            (F.col("terms") * divergence(F.col("other_p0"), F.col("p"))).alias("value"))
    both = rated.select("lng", "digest", "split", "grp", "p", "p0").repartition("lng", "digest", "split").sortWithinPartitions(
        "lng", "digest", "split").mapInArrow(_shared_sums, "grp long, other long, value long")
    summed = base.union(as_own).union(as_other).union(both).groupBy("grp", "other").agg(
        F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    by_value = Window.partitionBy("grp").orderBy(F.desc("value"), "item")
    pair_rows = summed.join(pairs.select("grp", "other", "lang", "source", "item"), ["grp", "other"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return pair_rows.union(term_rows)
