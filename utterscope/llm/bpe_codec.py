"""Exact BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a pre-token has exactly one BPE encoding, so it has exactly
one last token.  The vocabulary's automaton gives, for each prefix, the
tokens that are its suffixes, longest first; the last token is the one that
is compatible with the last token of the prefix before it.  Following the
back-pointers from the whole pre-token emits the ids.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import accumulate, chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import map_texts, texts, to_arrow
from utterscope.llm.pretokens import CHUNK, ByteVocabulary, Chunks, pretokens, vocabulary

PAIR_LIMIT = 600_000  # remembered pair tests of a worker


class PrefixEncoder:
    """Encodes byte strings under one vocabulary."""

    def __init__(self, vocab: ByteVocabulary):
        self.vocab = vocab
        self.rank_of_pair = {(a, b): r for r, (a, b) in enumerate(zip(vocab.left.tolist(), vocab.right.tolist()))}
        # the merge that makes a token, as (rank, left part, right part)
        self.made = {m: (r, a, b) for r, (m, a, b) in
                     enumerate(zip(vocab.merged.tolist(), vocab.left.tolist(), vocab.right.tolist()))}
        self.automaton = ahocorasick.Automaton()
        for token in {*vocab.byte_ids.tolist(), *self.made}:
            word = vocab.bytes_of[token].decode("latin-1")
            self.automaton.add_word(word, (token, len(word)))
        self.automaton.make_automaton()
        # (left, right) -> whether BPE leaves them side by side, remembered
        self.tested: dict[int, bool] = {}

    def _test(self, left: int, right: int) -> bool:
        if len(self.tested) >= PAIR_LIMIT:
            self.tested.clear()
        got = self.tested[left << 32 | right] = self._border_stays(left, right)
        return got

    def _border_stays(self, x: int, y: int) -> bool:
        """Whether no merge ever joins symbols across the border of the
        tokens ``x`` and ``y``.

        The symbols at the border are parts on the right edge of ``x`` and on
        the left edge of ``y``; each lives until the merge that absorbs it.
        Going back from the whole tokens, the border pair that is alive must
        have no merge that is due before either is absorbed (the leftmost of
        equal merges comes first).
        """
        endless = 1 << 40
        x_ends = y_ends = endless
        while True:
            due = self.rank_of_pair.get((x, y), endless)
            if due < x_ends and due <= y_ends and due < endless:
                return False
            x_made, y_made = self.made.get(x), self.made.get(y)
            if x_made is None and y_made is None:
                return True
            # undo the later of the two merges; of equal ones, the right one
            if y_made is None or (x_made is not None and x_made[0] > y_made[0]):
                x_ends, x = x_made[0], x_made[2]
            else:
                y_ends, y = y_made[0], y_made[1]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token.  All go through the automaton as one
        string, with a character that no token holds between them."""
        joined = "\u0100".join([p.decode("latin-1") for p in pieces])
        ends = list(accumulate(len(p) + 1 for p in pieces))
        last, back = [-1] * (len(joined) + 2), [0] * (len(joined) + 2)
        for begin in chain([0], ends):
            last[begin] = -2  # the empty prefix
        tested = self.tested
        for end, (token, size) in self.automaton.iter(joined):
            end += 1
            if last[end] != -1:
                continue
            begin = end - size
            before = last[begin]
            if before >= 0:
                stays = tested.get(before << 32 | token)
                if stays is None:
                    stays = self._test(before, token)
                if not stays:
                    continue
            last[end], back[end] = token, begin
        out = []
        for piece, end in zip(pieces, ends):
            at, ids = end - 1, []
            stop = at - len(piece)
            while at > stop:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[ByteVocabulary, Chunks]:
    vocab = vocabulary(path)
    encoder = PrefixEncoder(vocab)

    # words are remembered too: the same one occurs with other punctuation
    words = Chunks(lambda new: [array("i", ids).tobytes() for ids in encoder.encode([w.encode() for w in new])])

    def learn(chunks: list[str]) -> list[bytes]:
        return [b"".join(parts) for parts in words.values([pretokens(c) for c in chunks])]

    return vocab, Chunks(learn)


def encode_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text.

    A null or empty text has no ids; null ids, repeated rows and empty tables
    stay; other columns are left out.  The string of an added token inside a
    text becomes that token's id.
    """
    def batch(ids: list, values: list) -> dict:
        vocab, chunks = _encoder(vocab_path)
        parts = [vocab.segments(t) for t in values]
        found = iter(chunks.values([CHUNK.findall(s) for p in parts for s in p if isinstance(s, str)]))
        out = [b"".join(b"".join(next(found)) if isinstance(s, str) else array("i", [s]).tobytes() for s in p)
               for p in parts]
        ends = np.cumsum([0] + [len(o) // 4 for o in out]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(out), dtype=np.int32))
        return {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), flat)}

    return map_texts(texts(docs, id_col, text_col), batch, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for; a null list
    counts as empty, ids outside the vocabulary as nothing, bytes that are
    not UTF-8 become U+FFFD."""
    schema = "doc_id long, ids array<int>, text string"

    def run(batches):
        token = pa.array(vocabulary(vocab_path).bytes_of, type=pa.binary())
        target = to_arrow(schema)
        for b in batches:
            for at in range(0, b.num_rows, 50):
                part = b.slice(at, 50)
                ids = part.column(1).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                known = np.where((ids >= 0) & (ids < len(token)), ids, -1)
                data = token.take(pa.array(known, mask=known < 0)).fill_null(b"")
                # the bytes of all tokens lie one after the other
                offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset:data.offset + len(data) + 1]
                flat = data.buffers()[2].to_pybytes() if len(data) else b""
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                ends = offsets[np.cumsum(np.r_[0, sizes])] if len(data) else np.zeros(len(sizes) + 1, dtype=np.int32)
                out = [flat[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, type=pa.string())],
                                                 names=target.names).cast(target)

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"),
                          F.coalesce(F.col(ids_col), F.array().cast("array<int>")).cast("array<int>").alias("ids")
                          ).mapInArrow(run, schema)
