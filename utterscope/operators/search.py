"""Classifier search (I3, E27) by successive halving over folds, with a
tree-structured density sampler.

Trials come in groups.  Every trial of a group is fitted for the first fold;
the better half goes on to the next one, the others are pruned and not fitted
further.  Settings of later groups are drawn where the better trials so far
lie dense and the worse ones don't.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Range:
    """A number between two bounds, even in its logarithm if ``log``; rounded
    if ``whole``."""
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def place(self, value: float) -> float:
        """Where a value lies, from 0 to 1."""
        a, b, x = (math.log(v) if self.log else v for v in (self.low, self.high, value))
        return (x - a) / (b - a) if b > a else 0.5

    def value(self, place: float) -> float:
        a, b = (math.log(v) if self.log else v for v in (self.low, self.high))
        x = a + min(1.0, max(0.0, place)) * (b - a)
        x = min(self.high, max(self.low, math.exp(x) if self.log else x))
        return round(x) if self.whole else x


@dataclass(frozen=True)
class Choice:
    """One of some values."""
    values: tuple


class DensitySampler:
    """Draws settings (name -> value) from a space of ranges and choices.

    The trials told so far are parted at the best ``share``.  Each range is
    drawn from kernels around the better ones (and the whole range), each
    choice by their counts; of ``tries`` draws the one is taken whose density
    among the better is largest against that among the others."""

    def __init__(self, space: dict, seed: int = 42, startup: int = 5, share: float = 0.25, tries: int = 24):
        self.space, self.startup, self.share, self.tries = space, startup, share, tries
        self.random = random.Random(seed)
        self.told: list[tuple[float, dict]] = []

    def tell(self, settings: dict, value: float) -> None:
        self.told.append((value, settings))

    def ask(self) -> dict:
        if len(self.told) < self.startup:
            return {n: self._anywhere(s) for n, s in self.space.items()}
        ranked = sorted(self.told, key=lambda t: -t[0])
        cut = max(1, math.ceil(self.share * len(ranked)))
        good, bad = [s for _, s in ranked[:cut]], [s for _, s in ranked[cut:]]
        draws = [{n: self._near(n, s, good) for n, s in self.space.items()} for _ in range(self.tries)]
        return max(draws, key=lambda d: sum(
            math.log(self._density(n, s, good, d[n]) / self._density(n, s, bad, d[n])) for n, s in self.space.items()))

    def _anywhere(self, side):
        return self.random.choice(side.values) if isinstance(side, Choice) else side.value(self.random.random())

    def _near(self, name, side, good):
        around = self.random.randrange(len(good) + 1)
        if around == len(good):
            return self._anywhere(side)
        if isinstance(side, Choice):
            return good[around][name]
        return side.value(self.random.gauss(side.place(good[around][name]), self._width(good)))

    def _width(self, trials) -> float:
        return max(0.05, 0.5 / (1 + len(trials)))

    def _density(self, name, side, trials, value) -> float:
        if isinstance(side, Choice):
            return (1 + sum(t[name] == value for t in trials)) / (len(side.values) + len(trials))
        width, x = self._width(trials), side.place(value)
        kernels = sum(math.exp(-0.5 * ((x - side.place(t[name])) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for t in trials)
        return (1 + kernels) / (1 + len(trials))


def halving_search(spark: SparkSession, space: dict, folds: int, evaluate: Callable[[dict, int], float], n_trials: int = 16,
                   group: int = 8, keep: float = 0.5, seed: int = 42, startup: int = 5, at_once: int = 4) -> DataFrame:
    """The trials table (trial, step, <settings>, f1, value): the score that
    ``evaluate(settings, fold)`` gives on each fold a trial reached, and its
    running mean; what E25 to E27 read.

    After each fold the best ``keep`` of a group (at least one; ties to the
    earlier) go on.  Up to ``at_once`` fits of a step run side by side, as
    they don't depend on each other; the order of the table and the draws
    don't depend on which ends first.
    """
    if folds < 1 or n_trials < 1 or group < 1:
        raise ValueError("folds, n_trials and group must be 1 or more")
    sampler = DensitySampler(space, seed, startup)
    rows: list[tuple] = []
    names = list(space)
    with ThreadPool(at_once) as pool:
        for begin in range(0, n_trials, group):
            alive = [(t, sampler.ask()) for t in range(begin, min(begin + group, n_trials))]
            totals = dict.fromkeys((t for t, _ in alive), 0.0)
            for step in range(folds):
                run = inheritable_thread_target(spark)(lambda trial, step=step: evaluate(trial[1], step))
                scores = pool.map(run, alive, chunksize=1)
                for (t, settings), f1 in zip(alive, scores):
                    totals[t] += f1
                    rows.append((t, step, *[settings[n] for n in names], float(f1), totals[t] / (step + 1)))
                ranked = sorted(alive, key=lambda a: (-totals[a[0]], a[0]))
                staying = ranked[:max(1, math.ceil(keep * len(ranked)))] if step + 1 < folds else []
                for t, settings in ranked[len(staying):]:
                    sampler.tell(settings, totals[t] / (step + 1))
                alive = sorted(staying, key=lambda a: a[0])
    kinds = ["double" if isinstance(s, Range) and not s.whole else "long" if isinstance(s, Range) or all(
        isinstance(v, int) for v in s.values) else "string" for s in space.values()]
    columns = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), f"trial int, step int, {columns}, f1 double, value double")
