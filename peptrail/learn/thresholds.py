"""Accepted targets and order statistics from counts by the leading bits of a score, without a sort or a shuffle of rows.

A float's bits, with the sign turned round, order as the float does. A pass counts targets and decoys by a score's leading bits; from
these counts a bin's least possible error rate follows, so most bins can't hold the threshold. Only the bins that may hold it are counted
again, by their next bits, until single scores are left, whose counts are exact. Every pass adds up arrays of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from peptrail.learn.blocks import Block, Blocks, add_up

#: Bits that each level of counts looks at, of 4-byte and 8-byte floats.
SINGLE, DOUBLE = (12, 10, 10), (12, 13, 13, 13, 13)
#: Bins of a question that one pass refines.
ASK = 4

Request = tuple[int, int, int]  # slot, level, leading bits
Values = Callable[[Block], list[np.ndarray]]


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned integers that order as the floats do; both zeros are one."""
    whole = np.uint32 if v.dtype == np.float32 else np.uint64
    b = (v + v.dtype.type(0)).view(whole)
    top = whole(1) << whole(v.dtype.itemsize * 8 - 1)
    return np.where(b & top, ~b, b | top)


def float_of(bits: int, widths: tuple[int, ...]) -> float:
    kind, whole = (np.float32, np.uint32) if sum(widths) == 32 else (np.float64, np.uint64)
    top = 1 << (sum(widths) - 1)
    return float(np.array([bits ^ top if bits & top else bits ^ (2 * top - 1)], whole).view(kind)[0])


def counts(blocks: Blocks, values: Values, groups: int, requests: list[Request], widths: tuple[int, ...]) -> dict[Request, np.ndarray]:
    """[group, decoy or target, bin] of each request, in one pass; values(block)[slot] has NaN where a row doesn't take part.

    Rows are told apart by their fold if there is more than one group.
    """
    total, sizes = sum(widths), [2 * groups << widths[level] for _, level, _ in requests]
    whole = np.uint32 if total == 32 else np.uint64
    kind = np.float32 if total == 32 else np.float64

    def per_block(b: Block) -> np.ndarray:
        known, cache, out = values(b), {}, []
        side = (b.fold * 2 if groups > 1 else np.zeros(len(b.y), np.int32)) + b.y
        for (slot, level, lead), size in zip(requests, sizes):
            if slot not in cache:
                v = known[slot].astype(kind)
                on = ~np.isnan(v)
                cache[slot] = (ordered_bits(v[on]), side[on])
            key, of = cache[slot]
            below = total - sum(widths[: level + 1])
            if level:
                on = (key >> whole(below + widths[level])) == whole(lead)
                key, of = key[on], of[on]
            at = (key >> whole(below)).astype(np.int64) & ((1 << widths[level]) - 1)
            out.append(np.bincount((of.astype(np.int64) << widths[level]) + at, minlength=size))
        return np.concatenate(out)

    flat = add_up(blocks, per_block, sum(sizes), np.int64)
    return {r: part.reshape(groups, 2, -1) for r, part in zip(requests, np.split(flat, np.cumsum(sizes)[:-1]))}


@dataclass(frozen=True)
class Question:
    """Which targets of a slot are accepted, the score's direction, a group left out; of one ``race`` only the winner needs an answer."""

    slot: int
    descending: bool = True
    without: int | None = None
    race: object = None


@dataclass
class Answer:
    """Accepted targets, and the worst accepted score (negated if lower is better); None: none."""

    passing: int = 0
    threshold: float | None = None


@dataclass
class _Bin:
    """Scores with the same leading bits: counts of better ones, then their own."""

    level: int
    lead: int
    better: tuple[int, int]
    own: tuple[int, int]

    def least_rate(self) -> float:
        return (self.better[1] + 1) / max(1, self.better[0] + self.own[0])

    def rate(self) -> float:
        """Of a single score: decoys of a tie come first, so the rate is least behind the first of them or at the tie's end."""
        (bt, bd), (t, d) = self.better, self.own
        last = (bd + d + 1) / (bt + t) if bt + t else 1.0
        first = (bd + 2) / bt if d and bt else 1.0
        return float(np.float32(min(1.0, last, first)))


@dataclass
class _Search:
    question: Question
    fdr: float
    widths: tuple[int, ...]
    stack: list[_Bin] = field(default_factory=list)  # bins that may hold the threshold, the worst one last
    worst: _Bin | None = None
    surely: int = 0  # targets that are accepted at least
    done: bool = False
    answer: Answer = field(default_factory=Answer)

    def __post_init__(self) -> None:
        whole = _Bin(0, 0, (0, 0), (0, 0))
        self.stack, self.worst = [whole], whole

    def final(self, b: _Bin) -> bool:
        return b.level == len(self.widths)

    def wanted(self) -> list[_Bin]:
        if self.done:
            return []
        top = [b for b in self.stack[-ASK:] if not self.final(b)]
        return top + [b for b in (self.worst,) if b is not None and not self.final(b) and b not in top]

    def at_most(self) -> int:
        return self.answer.passing if self.done else sum(x for x in (self.stack[-1].better[0], self.stack[-1].own[0])) if self.stack else 0

    def children(self, b: _Bin, found: dict[Request, np.ndarray]) -> list[_Bin]:
        """Bins within b that aren't empty, from the best on."""
        c = found[(self.question.slot, b.level, b.lead)]
        c = c.sum(0) - (0 if self.question.without is None else c[self.question.without])
        at = np.flatnonzero(c.sum(0))
        if self.question.descending:
            at = at[::-1]
        out, (bt, bd) = [], b.better
        for i in at.tolist():
            d, t = int(c[0, i]), int(c[1, i])
            out.append(_Bin(b.level + 1, b.lead << self.widths[b.level] | i, (bt, bd), (t, d)))
            bt, bd = bt + t, bd + d
        return out

    def take(self, asked: list[_Bin], found: dict[Request, np.ndarray]) -> None:
        slack = self.fdr * (1 + 1e-6)  # rates are rounded to 4 bytes
        for b in asked:
            inner = self.children(b, found)
            if b is self.worst:
                self.worst = inner[-1] if inner else None
                if b.level == 0 and inner:
                    last = inner[-1]
                    t, d = (last.better[i] + last.own[i] for i in (0, 1))
                    # unless the worst score's own rate could be within the limit, a bin's end that is decides
                    if t and min(d + 1, last.better[1] + 2) / t > slack:
                        self.surely = max((x.better[0] + x.own[0] for x in inner if (x.better[1] + x.own[1] + 1) <= self.fdr * (1 - 1e-6) * (x.better[0] + x.own[0])), default=0)
            if b in self.stack:
                at = self.stack.index(b)
                self.stack[at : at + 1] = [x for x in inner if x.least_rate() <= slack]
        if self.worst is not None and not self.final(self.worst):
            return
        limit = self.worst.rate() if self.worst is not None else 0.0
        while self.stack and self.final(b := self.stack[-1]):
            # scores that are no better than the worst one's rate don't pass
            if (r := b.rate()) <= self.fdr and r < limit:
                v = float_of(b.lead, self.widths)
                self.answer = Answer(b.better[0] + b.own[0], v if self.question.descending else -v)
                self.done = True
                return
            self.stack.pop()
        self.done = not self.stack


def accepted(blocks: Blocks, values: Values, questions: list[Question], fdr: float, groups: int = 1) -> list[Answer]:
    """The answers to all questions, exact as by sorting; of a race only those that may win are followed to the end, the others are 0."""
    searches = [_Search(q, fdr, SINGLE) for q in questions]
    while True:
        best: dict = {}
        for s in searches:
            if s.question.race is not None:
                best[s.question.race] = max(best.get(s.question.race, 0), s.answer.passing if s.done else s.surely)
        live = [(s, s.wanted()) for s in searches if s.question.race is None or s.at_most() >= best[s.question.race] or s.worst is not None and s.worst.level == 0]
        requests = sorted({(s.question.slot, b.level, b.lead) for s, asked in live for b in asked})
        if not requests:
            return [s.answer for s in searches]
        found = counts(blocks, values, groups, requests, SINGLE)
        for s, asked in live:
            if asked:
                s.take(asked, found)


def medians(blocks: Blocks, values: Values, slots: int, decoys: bool = True) -> list[float | None]:
    """The exact median of each slot's decoys (or of all its rows); of an even number the middle ones' mean; None without any."""
    side = slice(0, 1) if decoys else slice(0, 2)
    paths: dict[tuple[int, int], list[int]] = {}  # (slot, which middle) -> [level, lead, rank within]
    first = counts(blocks, values, 1, [(s, 0, 0) for s in range(slots)], DOUBLE)
    n = [int(first[(s, 0, 0)][0, side].sum()) for s in range(slots)]
    for s in range(slots):
        for k in (0, 1):
            if n[s]:
                paths[(s, k)] = [0, 0, (n[s] - 1 + k) // 2]
    found = first
    for level, width in enumerate(DOUBLE):
        if level:
            asked = sorted({(s, level, p[1]) for (s, _), p in paths.items()})
            found = counts(blocks, values, 1, asked, DOUBLE) if asked else {}
        for (s, _), p in paths.items():
            ends = np.cumsum(found[(s, level, p[1])][0, side].sum(0))
            i = int(np.searchsorted(ends, p[2], side="right"))
            p[:] = [level + 1, p[1] << width | i, p[2] - (int(ends[i - 1]) if i else 0)]
    at = {key: float_of(p[1], DOUBLE) for key, p in paths.items()}
    return [(at[(s, 0)] + at[(s, 1)]) / 2 if n[s] else None for s in range(slots)]
