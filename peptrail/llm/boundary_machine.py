"""The boundary rules as finite transducers over events, with their transition functions and a prefix scan that composes them.

Three machines run over a document's events. The pair machines tell which brackets and quotes are matched within their paragraph: one
runs backwards and counts the closers still to come, one runs forwards and counts the openers still open, for each family on its own.
The main machine then knows nesting depth, whether the outermost pair opened a unit, whether a unit has begun and whether it is a claim,
and decides at each event whether a unit ends there. All states are small integers; the effect of a stretch of text on a machine is an
array that maps the state before it to the state after it, and such arrays compose: parts of a long document can be read at once, and a
prefix scan over their arrays gives the state that each part begins in.
"""

from __future__ import annotations

import numpy as np

from peptrail.llm.boundary_events import AFTER_CLOSER, CLAIM, CLOSE, FAMILIES, OPEN, PARA, QUOTE, STRONG, THAI_GAP

#: Deepest nesting that is told apart; deeper pairs count as that deep.
DEPTH = 7
PAIRS = len(FAMILIES)
#: Size of a pair machine: a counter of each family, then the parity (forwards) or presence (backwards) of straight quotes.
COUNT = DEPTH + 1

# Symbols of the main machine: an event's kind, resolved, with a bit for text before it.
BREAK, DOWN, UP, NUMBER, END, END_CLOSED, GAP, QUOTED = range(8)
SYMBOLS = 8
#: Families of brackets; a sentence wholly in one of them is a unit, one in quotes may go on.
BRACKETS = 3
#: State: depth * 8 + whole * 4 + begun * 2 + claim.
STATES = COUNT * 8
#: Before the first event: nothing open, no unit begun.
INITIAL = 0


def _step(state: int, symbol: int, text: bool) -> tuple[int, bool]:
    """The main machine's rules: the next state, and whether a unit ends at the event."""
    depth, whole, begun, claim = state >> 3, state >> 2 & 1, state >> 1 & 1, state & 1
    if text:
        begun = 1
        if depth == 0:
            whole = 0
    cut = False
    if symbol == BREAK:
        return INITIAL, True
    if symbol in (DOWN, QUOTED):
        if depth == 0:
            whole = int(symbol == DOWN and not begun)
        depth, begun = min(DEPTH, depth + 1), 1
    elif symbol == UP:
        depth = max(0, depth - 1)
    elif symbol == NUMBER:
        if depth == 0:
            cut = bool(begun and claim)
            if cut or not begun:
                claim, whole, begun = 1, 0, 1
    elif depth == 0 and not claim:
        cut = bool(begun) and (symbol != END_CLOSED or bool(whole))
        if cut:
            whole = begun = 0
    return depth << 3 | whole << 2 | begun << 1 | claim, cut


def compile_tables() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol * 2 + text] and cut[state, symbol * 2 + text] of the main machine."""
    step, cut = np.zeros((STATES, SYMBOLS * 2), np.int64), np.zeros((STATES, SYMBOLS * 2), bool)
    for s in range(STATES):
        for a in range(SYMBOLS * 2):
            step[s, a], cut[s, a] = _step(s, a >> 1, bool(a & 1))
    return step, cut


NEXT, CUT = compile_tables()
_NEXT, _CUT = NEXT.tolist(), CUT.tolist()


def identity_pairs() -> np.ndarray:
    return np.tile(np.arange(COUNT), (PAIRS + 1, 1))


def closers_to_come(found: list[tuple[int, int, int]]) -> np.ndarray:
    """Backwards over a stretch: [family, count after it] -> count before it; the last row is for straight quotes (0 or 1)."""
    f = identity_pairs()
    for _, kind, a in reversed(found):
        if kind == PARA:
            f[:] = 0
        elif kind == CLOSE:
            f[a] = np.minimum(DEPTH, f[a] + 1)
        elif kind == OPEN:
            f[a] = np.maximum(0, f[a] - 1)
        elif kind == QUOTE:
            f[PAIRS] = 1
    return f


def mark_openers(found: list[tuple[int, int, int]], after: list[int]) -> list[bool]:
    """For each event whether it is an opener with a closer to come; ``after``: the counts behind the stretch."""
    come, out = list(after), [False] * len(found)
    for i in range(len(found) - 1, -1, -1):
        _, kind, a = found[i]
        if kind == PARA:
            come = [0] * (PAIRS + 1)
        elif kind == CLOSE:
            come[a] = min(DEPTH, come[a] + 1)
        elif kind == OPEN:
            out[i] = come[a] > 0
            come[a] = max(0, come[a] - 1)
        elif kind == QUOTE:
            out[i] = come[PAIRS] > 0
            come[PAIRS] = 1
    return out


def openers_before(found: list[tuple[int, int, int]], matched: list[bool]) -> np.ndarray:
    """Forwards over a stretch: [family, open before it] -> open after it; a straight quote opens if none is open and one is to come."""
    f = identity_pairs()
    for (_, kind, a), m in zip(found, matched):
        if kind == PARA:
            f[:] = 0
        elif kind == OPEN and m:
            f[a] = np.minimum(DEPTH, f[a] + 1)
        elif kind == CLOSE:
            f[a] = np.maximum(0, f[a] - 1)
        elif kind == QUOTE:
            f[PAIRS] = np.where(f[PAIRS] > 0, 0, int(m))
    return f


def symbols(found: list[tuple[int, int, int]], extents: list[tuple[int, int]], matched: list[bool], before: list[int]) -> tuple[list[tuple[int, int, int, int]], tuple[int, int]]:
    """(symbol with its text bit, first, end, mark) of the main machine's events, and the extent of the text after the last one.

    first and end: what isn't blank since the event before (-1: nothing); mark: the place of a bracket or quote, which is text itself,
    else -1. Unmatched brackets and quotes are no events but text.
    """
    out: list[tuple[int, int, int, int]] = []
    opened = list(before)
    first = end = -1
    for (at, kind, a), m, (x, y) in zip(found, matched, extents):
        if x >= 0:
            first, end = (x if first < 0 else first), y
        symbol = mark = -1
        if kind == PARA:
            opened = [0] * (PAIRS + 1)
            symbol = BREAK
        elif kind == OPEN:
            if m:
                opened[a] = min(DEPTH, opened[a] + 1)
                symbol, mark = (DOWN if a < BRACKETS else QUOTED), at
        elif kind == CLOSE:
            if opened[a] > 0:
                opened[a] -= 1
                symbol, mark = UP, at
        elif kind == QUOTE:
            if opened[PAIRS]:
                opened[PAIRS] = 0
                symbol, mark = UP, at
            elif m:
                opened[PAIRS] = 1
                symbol, mark = QUOTED, at
        else:
            symbol = NUMBER if kind == CLAIM else GAP if kind == THAI_GAP else END if kind == STRONG else END_CLOSED
        if symbol < 0:
            first, end = (at if first < 0 else first), at + 1
            continue
        out.append((symbol * 2 + (first >= 0), first, end, mark))
        first = end = -1
    x, y = extents[-1]
    if x >= 0:
        first, end = (x if first < 0 else first), y
    return out, (first, end)


assert AFTER_CLOSER > STRONG  # kinds that symbols() tells apart by exclusion


def after_text(f: np.ndarray) -> np.ndarray:
    """States after text that no event follows."""
    return (f - ((f >> 2 & 1) << 2) * (f >> 3 == 0)) | 2


def run(marks: list[tuple[int, int, int, int]], rest: tuple[int, int], state: int = INITIAL) -> list[list[tuple[int, int]]]:
    """The extents of the pieces between the ends of units, from a given state; each piece is a list of at most one extent.

    The first piece continues what came before the stretch, the last one goes on behind it.
    """
    pieces: list[list[tuple[int, int]]] = []
    step, cut = _NEXT, _CUT
    begin, stop = -1, -1
    for a, first, end, mark in marks:
        if first >= 0:
            begin, stop = (first if begin < 0 else begin), end
        if cut[state][a]:
            pieces.append([(begin, stop)] if begin >= 0 else [])
            begin = -1
        if mark >= 0:
            begin, stop = (mark if begin < 0 else begin), mark + 1
        state = step[state][a]
    if rest[0] >= 0:
        begin, stop = (rest[0] if begin < 0 else begin), rest[1]
    pieces.append([(begin, stop)] if begin >= 0 else [])
    return pieces


def compose_scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of functions[k, ..., state] by doubling: log2(n) vectorised rounds."""
    f, gap = functions.copy(), 1
    while gap < len(f):
        g = f.copy()
        g[gap:] = np.take_along_axis(f[gap:], f[:-gap], axis=-1)
        f, gap = g, gap * 2
    return f


def _entering(functions: np.ndarray, first: int) -> np.ndarray:
    """For each stretch the state it begins in: functions[k, ..., state], first: the state before all."""
    prefix = compose_scan(functions)[..., first]
    return np.concatenate([np.full_like(prefix[:1], first), prefix[:-1]])


def pair_functions(found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A stretch's effect on the pair machines: [family, closers to come after it] -> before it, and [closers to come after it, family, open
    before it] -> open after it. Families don't touch each other, so one count stands for all."""
    ahead = [openers_before(found, mark_openers(found, [c] * (PAIRS + 1))) for c in range(COUNT)]
    return closers_to_come(found).astype(np.int8), np.stack(ahead).astype(np.int8)


def scan_pairs(back: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of a document's stretches, in order, the closers to come behind it and the openers open before it, by family."""
    come = _entering(back[::-1].astype(np.int64), 0)[::-1]
    at = np.arange(PAIRS + 1)
    chosen = np.stack([a[c, at] for a, c in zip(ahead, come)]).astype(np.int64)
    return come, _entering(chosen, 0)


def main_function(marks: list[tuple[int, int, int, int]], rest: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A stretch's effect on the main machine, by the state before it: the state after it, whether a unit ends in it, where the text behind
    its last end begins (-1: none); and where its text ends (-1: it has none)."""
    f, cut, begin, stop = np.arange(STATES), np.zeros(STATES, bool), np.full(STATES, -1), -1
    for a, first, end, mark in marks:
        if first >= 0:
            begin, stop = np.where(begin < 0, first, begin), end
        now = CUT[f, a]
        cut |= now
        begin = np.where(now, -1, begin)
        if mark >= 0:
            begin, stop = np.where(begin < 0, mark, begin), mark + 1
        f = NEXT[f, a]
    if rest[0] >= 0:
        begin, stop = np.where(begin < 0, rest[0], begin), rest[1]
    return after_text(f) if rest[0] >= 0 else f, cut, begin, stop


def scan_main(functions: np.ndarray, cut: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """For each of a document's stretches, in order, the state before it and the begin and end of the unit open there (-1: none)."""
    states = _entering(functions, INITIAL)
    open_at, open_to, at, to = [], [], -1, -1
    for k, s in enumerate(states.tolist()):
        open_at.append(at)
        open_to.append(to)
        if cut[k, s]:
            at, to = int(begin[k, s]), (int(stop[k]) if begin[k, s] >= 0 else -1)
        elif stop[k] >= 0:
            at, to = (int(begin[k, s]) if at < 0 else at), int(stop[k])
    return states, open_at, open_to


def units_of(marks: list[tuple[int, int, int, int]], rest: tuple[int, int], state: int, open_at: int, open_to: int, last: bool) -> list[tuple[int, int]]:
    """(start, end) of the units that end in a stretch, the first of which may have begun before it; of the last one all."""
    out: list[tuple[int, int]] = []
    pieces = run(marks, rest, state)
    for k, piece in enumerate(pieces):
        if piece:
            open_at, open_to = (piece[0][0] if open_at < 0 else open_at), piece[0][1]
        if (k + 1 < len(pieces) or last) and open_at >= 0:
            out.append((open_at, open_to))
            open_at = -1
    return out


Stretch = tuple[list[tuple[int, int, int]], list[tuple[int, int]]]  # events and extents


def join_stretches(stretches: list[Stretch]) -> list[tuple[int, int]]:
    """(start, end) of the units of a document given as consecutive stretches of events.

    Each machine's functions of all stretches are composed by a prefix scan (from the end for the backward one); a single stretch needs none.
    """
    if len(stretches) == 1:
        ((found, extents),) = stretches
        marks, rest = symbols(found, extents, mark_openers(found, [0] * (PAIRS + 1)), [0] * (PAIRS + 1))
        return units_of(marks, rest, INITIAL, -1, -1, True)
    come, before = scan_pairs(*map(np.stack, zip(*(pair_functions(f) for f, _ in stretches))))
    read = [symbols(f, e, mark_openers(f, c), b) for (f, e), c, b in zip(stretches, come.tolist(), before.tolist())]
    states, open_at, open_to = scan_main(*map(np.array, zip(*(main_function(m, r) for m, r in read))))
    each = zip(read, states.tolist(), open_at, open_to)
    return [u for k, ((marks, rest), s, x, y) in enumerate(each) for u in units_of(marks, rest, s, x, y, k + 1 == len(stretches))]
