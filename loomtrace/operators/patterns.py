"""Patterns over the labels of a walk, as array expressions.

A path is a row of tests, each on one label; between two of them lies either nothing or any number of labels.  One fold
from the last label to the first keeps two sets of tests as bits: those from which on the rest of the path fits if it
begins at the label just read, and those from which on it fits anywhere later.  Nothing is encoded as text, so
labels may hold any character, and the fold's state is two numbers whatever the length of the walk.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrows of a path, and the marks of a walk's ends.
NEXT, LATER, BEGIN, STOP = "->", "->>", "^", "$"
MOST_TESTS = 60


@dataclass(frozen=True)
class Test:
    """A test of one label: equal to, or beginning with, one of some texts; or none of them."""

    whole: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    negated: bool = False

    @classmethod
    def read(cls, text: str) -> Test:
        """``A``, ``A|B``, ``PREFIX*``, ``*``, and ``!`` before any of them."""
        text = text.strip()
        options = [x.strip().lower() for x in text.removeprefix("!").split("|")]
        if not all(options):
            raise ValueError("a test of a label is empty")
        return cls(tuple(x for x in options if not x.endswith("*")), tuple(x[:-1] for x in options if x.endswith("*")), text.startswith("!"))

    def on(self, label: Column) -> Column:
        low = F.lower(F.coalesce(label, F.lit("")))
        hits = [low.isin(*self.whole)] if self.whole else []
        hits += [F.startswith(low, F.lit(x)) for x in self.starts]
        hit = reduce(lambda a, b: a | b, hits)
        return ~hit if self.negated else hit


@dataclass(frozen=True)
class Path:
    """Tests in order; ``gaps[k]`` says whether labels may lie before test k, the last gap those after the last test."""

    tests: tuple[Test, ...]
    gaps: tuple[bool, ...]

    @classmethod
    def read(cls, text: str) -> Path:
        text = text.strip()
        open_start, open_end = not text.startswith(BEGIN), not text.endswith(STOP)
        words = re.split(r"(->>?)", text.removeprefix(BEGIN).removesuffix(STOP))
        names, arrows = [x.strip() for x in words[::2]], words[1::2]
        # "^ ->> A" and "A ->> $" open an end that a mark closes
        if not open_start and len(names) > 1 and not names[0] and arrows[0] == LATER:
            names, arrows, open_start = names[1:], arrows[1:], True
        if not open_end and len(names) > 1 and not names[-1] and arrows[-1] == LATER:
            names, arrows, open_end = names[:-1], arrows[:-1], True
        if len(names) > MOST_TESTS:
            raise ValueError(f"a path has {MOST_TESTS} tests at most")
        return cls(tuple(Test.read(x) for x in names), (open_start, *(x == LATER for x in arrows), open_end))

    def _mask(self, label: Column, state: Column) -> Column:
        """Which tests can begin the rest of the path at this label."""
        bits, last = [], len(self.tests) - 1
        for k, test in enumerate(self.tests):
            holds = test.on(label)
            if k == last:
                holds = holds if self.gaps[-1] else holds & state["end"]
            else:
                rest = state["later"] if self.gaps[k + 1] else state["next"]
                holds = holds & (rest.bitwiseAND(F.lit(2 << k)) != 0)
            bits.append(F.when(holds, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return reduce(lambda a, b: a + b, bits)

    def _step(self, state: Column, label: Column) -> Column:
        now = self._mask(label, state)
        return F.struct(now.alias("next"), state["later"].bitwiseOR(now).alias("later"), F.lit(False).alias("end"))

    def found(self, labels: Column) -> Column:
        """Whether the path occurs in the labels."""
        zero = F.lit(0).cast("bigint")
        done = F.aggregate(F.reverse(labels), F.struct(zero.alias("next"), zero.alias("later"), F.lit(True).alias("end")), self._step)
        return F.coalesce((done["later"] if self.gaps[0] else done["next"]).bitwiseAND(F.lit(1)) != 0, F.lit(False))

    def steps(self, labels: Column) -> Column:
        """The step (from 0) of each test in the first match, each as early as it can be; null without a match."""
        zero = F.lit(0).cast("bigint")
        start = F.struct(zero.alias("next"), zero.alias("later"), F.lit(True).alias("end"), F.array().cast("array<bigint>").alias("all"))
        fold = lambda s, x: F.struct(*(self._step(s, x)[n].alias(n) for n in ("next", "later", "end")), F.array_append(s["all"], self._mask(x, s)).alias("all"))
        masks = F.reverse(F.aggregate(F.reverse(labels), start, fold)["all"])
        # an array of one binds the masks, so that they are made once
        return F.when(self.found(labels), F.get(F.transform(F.array(masks), self._places), F.lit(0)))

    def _places(self, masks: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(masks) - 1)

        def first(k: int, after: Column) -> Column:
            return F.array_min(F.filter(places, lambda p: (p > after) & (F.get(masks, p).bitwiseAND(F.lit(1 << k)) != 0)))

        at = [first(0, F.lit(-1)) if self.gaps[0] else F.lit(0)]
        for k in range(1, len(self.tests)):
            at.append(first(k, at[-1]) if self.gaps[k] else at[-1] + 1)
        return F.array(*at)


def follows(labels: Column, pattern: str) -> Column:
    return Path.read(pattern).found(labels)


def path_steps(labels: Column, pattern: str) -> Column:
    return Path.read(pattern).steps(labels)


def path_start(labels: Column, pattern: str) -> Column:
    """The step (from 0) at which the first match of a path begins; null if there is none."""
    return F.get(path_steps(labels, pattern), F.lit(0))


def cycle_tests(text: str) -> tuple[Test, ...]:
    """The states of a cycle, parted by arrows or white space."""
    out = tuple(Test.read(x) for x in text.replace(NEXT, " ").split())
    if not out:
        raise ValueError("loop: needs one or more states")
    return out


def most_repeats(labels: Column, cycle: str) -> Column:
    """How often a cycle of labels repeats in a row at most, wherever in it the repetition begins: for each of its states,
    how many labels in a row have led up to it so far."""
    tests = cycle_tests(cycle)
    n, zero = len(tests), F.lit(0)

    def step(state: Column, label: Column) -> Column:
        runs = [F.when(t.on(label), state[f"r{(k - 1) % n}"] + 1).otherwise(zero) for k, t in enumerate(tests)]
        best = reduce(lambda a, b: F.when(a > b, a).otherwise(b), runs, state["best"])
        return F.struct(*(x.alias(f"r{k}") for k, x in enumerate(runs)), best.alias("best"))

    start = F.struct(*(zero.alias(f"r{k}") for k in range(n)), zero.alias("best"))
    return F.floor(F.aggregate(labels, start, step)["best"] / n).cast("int")


def pair_tests(name: str, text: str, arrow: str) -> tuple[Test, Test]:
    """The two ends of ``A -> B`` or ``A ~> B``."""
    source, found, target = text.partition(arrow)
    if not found:
        raise ValueError(f'{name}: needs "A {arrow} B"')
    return Test.read(source), Test.read(target)
