"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains on a text.  Votes agree only in
part, and none is taken for the truth: expectation-maximisation over the
counts of all vote patterns estimates how often each rule is right on good
and on bad texts, and a text is kept by its posterior probability of being
good instead of by passing every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import map_texts, texts
from utterscope.session import written_table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
CAPITALS = bytes(range(65, 91))
SENTENCE_ENDS = tuple(".!?:;…。！？\"”»'’)")
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
THRESHOLD = 0.5
MAX_RULES = 9  # 3^9 vote patterns at most reach the driver

GOOD, ABSTAIN, BAD = 1, 0, -1


@dataclass(frozen=True)
class Rule:
    """Votes good for a measure inside ``good``, bad outside ``fair`` (bounds
    included), else and for an undefined measure abstains."""
    measure: str
    good: tuple[float, float]
    fair: tuple[float, float]

    def votes(self, values: np.ndarray) -> np.ndarray:
        good = (values >= self.good[0]) & (values <= self.good[1])
        bad = (values < self.fair[0]) | (values > self.fair[1])
        return np.where(good, GOOD, np.where(bad, BAD, ABSTAIN))


RULES = (
    Rule("word_length", (3, 9), (2, 14)),
    Rule("symbols", (0, 0.02), (0, 0.1)),
    Rule("repeated_lines", (0, 0.1), (0, 0.3)),
    Rule("repeated_words", (0, 0.2), (0, 0.4)),
    Rule("letters", (0.85, 1), (0.7, 1)),
    Rule("lettered_words", (0.9, 1), (0.8, 1)),
    Rule("capitals", (0, 0.15), (0, 0.4)),
    Rule("sentence_ends", (0.5, 1), (0.1, 1)),
    Rule("line_words", (5, math.inf), (2, math.inf)),
)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words that the list holds twice or more."""
    if len(words) <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    window = ids[:len(ids) - size + 1]
    for j in range(1, size):  # pairs of (window so far, next word), renumbered so that they stay exact
        _, window = np.unique(window * len(numbers) + ids[j:len(ids) - size + 1 + j], return_inverse=True)
    twice = np.bincount(window)[window] >= 2
    covered = np.zeros(len(ids), dtype=bool)
    for j in range(size):
        covered[j:len(ids) - size + 1 + j] |= twice
    return int(covered.sum())


def _without(data: bytes, drop: bytes) -> int:
    return len(data.translate(None, drop))


def measures(text: str) -> dict[str, float]:
    """The counts of a text and the measures that the rules look at; NaN
    where a measure isn't defined."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    n_words, n_lines = len(words), len(lines)
    word_chars = len(text) - (len(data) - _without(data, SPACE))
    letters = len(text) - (len(data) - _without(data, NOT_LETTERS))
    n_symbols = len(data) - _without(data, SYMBOLS)
    n_dup_lines = n_lines - len(set(lines))
    n_repeat_words = repeated_words(words)
    ended = sum(x.rstrip(SPACE).decode().endswith(SENTENCE_ENDS) for x in lines)

    def share(a: float, b: float, least: int = 1) -> float:
        return a / b if b >= least else math.nan

    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words, "word_length": share(word_chars, n_words), "symbols": share(n_symbols, n_words),
        "repeated_lines": share(n_dup_lines, n_lines, 2), "repeated_words": share(n_repeat_words, n_words, 4),
        "letters": share(letters, word_chars),
        "lettered_words": share(sum(1 for w in words if _without(w, NOT_LETTERS)), n_words), "capitals": share(len(data) - _without(data, CAPITALS), letters),
        "sentence_ends": share(ended, n_lines), "line_words": share(n_words, n_lines),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def pattern_votes(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    """The votes (one row per pattern) that the numbers ``patterns`` stand for."""
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3 - 1


def vote_texts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    pattern) of (doc_id, text): the pattern has one base-3 digit per rule."""
    if not 0 < len(rules) <= MAX_RULES:
        raise ValueError(f"1 to {MAX_RULES} rules")

    def batch(ids: list, values: list) -> dict:
        told = [measures(t) for t in values]
        pattern = sum((r.votes(np.array([m[r.measure] for m in told], dtype=float)) + 1) * 3 ** i for i, r in enumerate(rules))
        return {"doc_id": ids, "pattern": pattern.astype(np.int32)} | {c: [m[c] for m in told] for c in COUNTS}

    return map_texts(docs, batch, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "pattern int")


@dataclass(frozen=True)
class Accuracies:
    """How often each rule that votes is right, on good and on bad texts, and
    the share of good texts."""
    on_good: np.ndarray
    on_bad: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes (one row each) is good;
        abstentions tell nothing."""
        for_good = np.log(self.on_good / (1 - self.on_bad))
        for_bad = np.log((1 - self.on_good) / self.on_bad)
        odds = math.log(self.prior / (1 - self.prior)) + (votes == GOOD) @ for_good + (votes == BAD) @ for_bad
        return 1 / (1 + np.exp(-odds))

    def log_likelihood(self, votes: np.ndarray) -> np.ndarray:
        good, bad = votes == GOOD, votes == BAD
        return np.logaddexp(math.log(self.prior) + good @ np.log(self.on_good) + bad @ np.log(1 - self.on_good),
                            math.log(1 - self.prior) + good @ np.log(1 - self.on_bad) + bad @ np.log(self.on_bad))


# What is believed of a rule before it is seen, with the weight of so many
# texts: seldom wrong on good texts, and blind to most kinds of bad ones.
BELIEF = (0.95, 0.3)
BELIEF_TEXTS = 10.0
STARTS = ((0.95, 0.3, 0.9), (0.8, 0.8, 0.5), (0.99, 0.1, 0.8))  # on good, on bad, prior


def _fit_from(start: tuple[float, float, float], votes: np.ndarray, counts: np.ndarray, rounds: int,
              tolerance: float) -> Accuracies:
    k = votes.shape[1]
    now = Accuracies(np.full(k, start[0]), np.full(k, start[1]), start[2])
    said_good, said_bad = votes == GOOD, votes == BAD
    for _ in range(rounds):
        good = now.posterior(votes) * counts
        bad = counts - good
        g1, g0, b1, b0 = good @ said_good, good @ said_bad, bad @ said_good, bad @ said_bad
        on_good = np.clip((g1 + BELIEF_TEXTS * BELIEF[0]) / (g1 + g0 + BELIEF_TEXTS), 0.001, 0.999)
        on_bad = np.clip((b0 + BELIEF_TEXTS * BELIEF[1]) / (b0 + b1 + BELIEF_TEXTS), 0.001, 0.999)
        new = Accuracies(on_good, np.maximum(on_bad, 1 - on_good), (good.sum() + 1) / (counts.sum() + 2))
        moved = max(abs(new.on_good - now.on_good).max(), abs(new.on_bad - now.on_bad).max(), abs(new.prior - now.prior))
        now = new
        if moved < tolerance:
            break
    return now


def fit_accuracies(votes: np.ndarray, counts: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10) -> Accuracies:
    """Expectation-maximisation over vote patterns (rows of ``votes``, each
    held by ``counts`` texts), from each of ``STARTS``; the likeliest result.

    A rule may say good of most bad texts, since each looks for one kind of
    fault, but not more often than of good ones: so the two classes can't
    change places.
    """
    return max((_fit_from(s, votes, counts, rounds, tolerance) for s in STARTS),
               key=lambda fit: float(counts @ fit.log_likelihood(votes)))


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, posterior, kept), one row per row of ``docs``.

    Words are runs of anything but ASCII white space; ``word_chars`` counts
    their code points, ``n_symbols`` the characters ``#*$%&|<>``,
    ``n_dup_lines`` the lines (between ``\\n``) with a word that equal an
    earlier one, ``n_repeat_words`` the words in three-word windows that the
    text holds twice or more.  ``base_failed``: under 50 words, or more than
    half of them repeated.  ``posterior`` is the probability of being good
    that the votes give; a text is kept if it reaches ``threshold`` and the
    base hasn't failed.

    All texts take part in the estimate, through the counts of their vote
    patterns (3 to the number of rules at most, whatever the rows), so the
    result doesn't depend on partitions.  Null texts are empty: no words,
    abstaining rules, base failed.  Rows with equal ids are judged each for
    itself, so are rows without one.  An empty table gives an empty table;
    other columns are left out.
    """
    spark = docs.sparkSession
    voted = written_table(vote_texts(texts(docs, id_col, text_col), rules), "votes")
    found = sorted((r.pattern, r.n) for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect())
    patterns, counts = np.array(found, dtype=np.int64).reshape(-1, 2).T
    votes = pattern_votes(patterns, len(rules))
    posterior = fit_accuracies(votes, counts).posterior(votes)
    told = F.broadcast(spark.createDataFrame(list(zip(patterns.tolist(), posterior.tolist())), "pattern int, posterior double"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return voted.join(told, "pattern").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), "posterior",
        (~failed & (F.col("posterior") >= threshold)).alias("kept"))
