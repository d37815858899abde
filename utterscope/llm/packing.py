"""Packing of documents into training sequences by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary
digits of n: as many pieces of the longest length as fit, then one piece per
set bit, longest first.  Every piece is a sequence of its own, sequences of
equal length share a bucket, and so none crosses documents and none needs
padding.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import map_texts, texts
from utterscope.llm.pretokens import LOWER_WORDS, SPACES, Chunks, vocabulary
from utterscope.llm.token_counts import RankTable, merge_by_rank


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens (``longest``: a power of two)."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    vocab = vocabulary(path)
    ranks = RankTable(vocab)

    def plain(word: str) -> bool:
        return bool(_LATIN.fullmatch(word)) and not ("<|" in word and any(a in word for a in vocab.added))

    def _first_symbols(codes: np.ndarray, piece_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First symbols and piece of each byte, in UTF-8, of Latin-1 codes."""
        width = 1 + (codes >= 128)
        flat, owner = np.repeat(codes, width), np.repeat(piece_of, width).astype(np.int32)
        second = np.zeros(len(flat), dtype=bool)
        second[(np.cumsum(width) - 1)[width == 2]] = True
        wide = flat >= 128
        flat = np.where(second, 0x80 | flat & 0x3F, np.where(wide, 0xC0 | flat >> 6, flat)).astype(np.uint8)
        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else owner > 0
        return np.where(last, vocab.end_ids[flat], vocab.byte_ids[flat]).astype(np.int32), owner

    def learn(words: list[str]) -> list[bytes]:
        """Ids of words.  ASCII and Latin-1 words without an added token are
        merged as one ragged array, any other goes through the library."""
        joined = "\n".join(words)
        if _LATIN_LINES.fullmatch(joined) and "<|" not in joined:
            own = range(len(words))
        else:
            own = [i for i, w in enumerate(words) if plain(w)]
            joined = "\n".join([words[i] for i in own])
        pieces = LOWER_WORDS.findall(joined.lower())
        codes = np.frombuffer("".join(pieces).encode("latin-1"), dtype=np.uint8)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        starts = np.cumsum(sizes) - sizes
        line = codes[starts] == 10 if len(starts) else starts > 0
        word_of = np.cumsum(line)[~line]
        keep = codes != 10
        piece_of = np.repeat(np.cumsum(~line) - 1, sizes)[keep]
        symbols, owner = merge_by_rank(*_first_symbols(codes[keep], piece_of), ranks)
        ends = np.cumsum(np.bincount(word_of[owner], minlength=len(own)) * 4).tolist()
        data = symbols.astype("<u4").tobytes()
        got = [data[a:b] for a, b in zip([0, *ends], ends)]
        if len(own) == len(words):
            return got
        out = dict(zip(own, got))
        return [out[i] if i in out else np.array(tok.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                for i, w in enumerate(words)]

    return Chunks(learn)


# characters that lower-case and normalise by themselves, digits apart from
# those that are numbers only to Unicode
_LATIN = re.compile("[!-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]+")
_LATIN_LINES = re.compile("[\n!-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]+")
_WORD = re.compile(f"[^{SPACES}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _words(text: str) -> list[str]:
    """Runs of non-spaces; the four separators that only Python counts as
    white space are none to the tokenizer."""
    return _WORD.findall(text) if _SEPARATORS.search(text) else text.split()


def pack(docs: DataFrame, vocab_path: str, end_id: int = 1, longest: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, bucket,
    sequence_id, offset).

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit
    integers; ``bucket`` is the binary logarithm of the length;
    ``sequence_id`` differs for every piece, as each is its own sequence, and
    ``offset`` is therefore 0.  The vocabulary at ``vocab_path`` must keep
    white space out of its tokens: words between white space are encoded on
    their own and remembered.  ``end_id`` follows each document's last token,
    so an empty or null text is one piece of one token; null ids and repeated
    rows are documents like any other; an empty table has no pieces; other
    columns are left out.  Row-wise: nothing is shuffled.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def batch(ids: list, values: list) -> dict:
        found = _tokenizer(vocab_path).values([_words(t) for t in values])
        out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "bucket")}
        for doc, parts in zip(ids, found):
            data = b"".join(parts) + end
            start, total = 0, len(data) // 4
            for n in binary_pieces(total, longest):
                for k, v in zip(out, (doc, start, n, data[4 * start:4 * (start + n)], total, n.bit_length() - 1)):
                    out[k].append(v)
                start += n
        return out | {"doc_id": pa.array(out["doc_id"], type=pa.int64())}

    pieces = map_texts(texts(docs, id_col, text_col), batch,
                       "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces with one folder per bucket of equal lengths."""
    pieces.write.partitionBy("bucket").parquet(path)
