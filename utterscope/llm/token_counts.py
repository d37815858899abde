"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch of texts are held as one ragged numpy array of
symbols.  In every round each sequence finds its pair of lowest merge rank
and all sequences apply theirs at once; sequences without a known pair
leave.  What survives in a sequence is its number of tokens.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from utterscope.llm.common import map_texts, texts
from utterscope.llm.pretokens import CHUNK, ByteVocabulary, Chunks, pretokens, vocabulary

NO_RANK = np.int32(2**31 - 1)


class RankTable:
    """Merge ranks of symbol pairs: a few hash tables, each holding what
    found its slot taken in the one before.  An entry is the pair and, in
    the low bits, its rank."""

    def __init__(self, vocab: ByteVocabulary, bits: int = 18):
        self.merged = vocab.merged.astype(np.int32)
        self.width = np.int64(max(vocab.size, len(vocab.merged)).bit_length())
        if 3 * self.width > 62:
            raise ValueError("vocabularies up to 2^20 tokens only")
        keys = vocab.left << self.width | vocab.right
        ranks = np.arange(len(keys))
        self.tables = []
        while len(keys):
            odd = np.uint64((0x9E3779B97F4A7C15 + 2 * len(self.tables) * 0x632BE59BD9B4E019) % 2**64 | 1)
            shift = np.uint64(64 - bits)
            slot = (keys.view(np.uint64) * odd) >> shift
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << bits, -1, dtype=np.int64)
            held[slot[first]] = keys[first] << self.width | ranks[first]
            self.tables.append((odd, shift, held))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << self.width | right
        mixed, low = key.view(np.uint64), (np.int64(1) << self.width) - 1
        out = np.full(len(key), NO_RANK)
        for odd, shift, held in self.tables:
            got = held[(mixed * odd) >> shift]
            hit = np.flatnonzero(got >> self.width == key)
            out[hit] = got[hit] & low
        return out


def _pair_ranks(symbols: np.ndarray, owner: np.ndarray, table: RankTable, at: np.ndarray) -> np.ndarray:
    """Ranks of the pairs that begin at ``at``; none across sequences."""
    nxt = np.minimum(at + 1, len(symbols) - 1)
    rank = table.rank(symbols[at], symbols[nxt])
    rank[(owner[at] != owner[nxt]) | (nxt == at)] = NO_RANK
    return rank


def merge_by_rank(symbols: np.ndarray, owner: np.ndarray, table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence of a ragged array (``owner``: ascending sequence
    number of each symbol) to its end; returns the surviving symbols and
    their owners, in order."""
    done = []
    rank = _pair_ranks(symbols, owner, table, np.arange(len(symbols))) if len(symbols) else None
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        low = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
        active = low < NO_RANK
        done.append((symbols[~active], owner[~active]))
        # a run of hits is one symbol repeated: its merges are the 1st, 3rd, ...
        at = np.flatnonzero((rank == low) & active)
        begins = np.r_[True, np.diff(at) > 1][:len(at)]
        at = at[(np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]
        symbols[at] = table.merged[rank[at]]
        active[at + 1] = False
        merged = np.zeros(len(symbols), dtype=bool)
        merged[at] = True
        symbols, owner, rank, merged = symbols[active], owner[active], rank[active], merged[active]
        # only pairs that hold a merged symbol have another rank
        new = np.flatnonzero(merged[:-1] | merged[1:]) if len(symbols) else at[:0]
        rank[new] = _pair_ranks(symbols, owner, table, new)
        if len(symbols):
            rank[-1] = NO_RANK
    if not done:
        return symbols, owner
    symbols, owner = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(owner, kind="stable")
    return symbols[order], owner[order]


def ragged(pieces: list[bytes], vocab: ByteVocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First symbols of byte strings and the number of the string of each."""
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    symbols = vocab.byte_ids.astype(np.int32)[flat]
    if vocab.end_ids is not None:
        ends = (np.cumsum(lengths) - 1)[lengths > 0]
        symbols[ends] = vocab.end_ids[flat[ends]]
    return symbols, np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)


@lru_cache(maxsize=4)
def _counter(path: str) -> tuple[ByteVocabulary, Chunks]:
    vocab = vocabulary(path)
    ranks = RankTable(vocab)

    def learn(chunks: list[str]) -> list[int]:
        words = [pretokens(c) for c in chunks]
        _, owner = merge_by_rank(*ragged([w.encode() for ws in words for w in ws], vocab), ranks)
        chunk_of = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        return np.bincount(chunk_of[owner], minlength=len(words)).tolist()

    return vocab, Chunks(learn)


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under the byte-level BPE file at ``vocab_path``.

    Returns (doc_id, n_bytes, n_tokens), one row per input row: a null or
    empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept
    as they are; an empty table gives an empty table; other columns of
    ``docs`` are left out.  The string of an added token inside a text counts
    as that one token.  Row-wise: nothing is shuffled.
    """
    def batch(ids: list, values: list) -> dict:
        vocab, chunks = _counter(vocab_path)
        parts = [vocab.segments(t) for t in values]
        counts = iter(chunks.values([CHUNK.findall(s) for p in parts for s in p if isinstance(s, str)]))
        n = [sum(sum(next(counts)) if isinstance(s, str) else 1 for s in p) for p in parts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in values], "n_tokens": n}

    return map_texts(texts(docs, id_col, text_col), batch, "doc_id long, n_bytes long, n_tokens long")
