"""The cutting-stock problem by column generation.

Remainders of given lengths, each as often as a histogram says, fill sequences
of ``capacity`` tokens.  A pattern is a multiset of lengths that fits a
sequence.  The linear program chooses how often each pattern is used; a
knapsack over its dual prices finds patterns that improve it, until none does.
A remainder may also be left to a stream that is cut at every sequence's end,
at its share of a sequence and ``CUT_COST`` more.

A solution is rounded down.  What that leaves is solved again, by whole
patterns around the longest length at a time; one that is no better than the
stream leaves its remainders to the stream.
"""

from __future__ import annotations

import numpy as np

#: What a cut adds to the cost of a remainder, in sequences.
CUT_COST = 0.02
#: The program is solved to within this share of the optimum, or so many sequences.
GAP, SLACK = 2e-3, 1.0
#: How far prices are drawn to those of the best bound.
DRAW = 0.7
#: Columns that one knapsack table hands over at most.
COLUMNS_A_ROUND = 128

Pattern = dict[int, int]  # place of a length -> copies


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room the greatest value of a multiset of
    lengths that fits, and the place of one of its lengths (-1: leave a token
    empty)."""
    places = np.flatnonzero(values > 0)
    own, size = values[places], lengths[places]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            gain = own[:n] + best[room - size[:n]]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], choice[room] = gain[k], places[k]
    return best, choice


def chosen(choice: np.ndarray, lengths: np.ndarray, room: int) -> Pattern:
    """The multiset behind an entry of the knapsack's table."""
    pattern: Pattern = {}
    while room > 0:
        if (k := int(choice[room])) < 0:
            room -= 1
        else:
            pattern[k] = pattern.get(k, 0) + 1
            room -= int(lengths[k])
    return pattern


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    best, choice = knapsack(values, lengths, capacity)
    return float(best[capacity]), chosen(choice, lengths, capacity)


def filled(first: int, left: np.ndarray, lengths: np.ndarray, at: np.ndarray, capacity: int, least: float) -> Pattern:
    """A pattern around one length: a pair or a single length that fills the
    sequence if there is one, else the longest that fits and on.  ``left`` is
    how many of each length are to be had (``least`` is the least that counts),
    ``at`` the place of each length."""
    have = np.zeros(capacity + 1)
    have[lengths] = left
    pattern, room = {first: 1}, capacity - int(lengths[first])
    have[lengths[first]] -= 1
    while room > 0:
        single, half = have[room], np.arange(1, (room + 1) // 2)
        pair = np.minimum(have[half], have[room - half])
        twice = have[room // 2] / 2 if room % 2 == 0 else 0.0
        options = [(single, [room]), (twice, [room // 2] * 2)]
        if len(pair):
            k = int(pair.argmax())
            options.append((pair[k], [int(half[k]), room - int(half[k])]))
        most, parts = max(options, key=lambda o: o[0])
        if most < least:
            fits = np.flatnonzero(have[: room + 1] >= least)
            if not len(fits):
                break
            parts = [int(fits[-1])]
        for n in parts:
            pattern[int(at[n])] = pattern.get(int(at[n]), 0) + 1
            have[n] -= 1
            room -= n
    return pattern


def greedy_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, whole: bool) -> list[tuple[Pattern, float, int]]:
    """Patterns and uses that exhaust the demand, the longest length first,
    and the place of the length that decides how often each is used; whole
    uses, or fractions, so that each pattern exhausts that length for good."""
    left = demand.astype(np.int64 if whole else float)
    at = np.full(capacity + 1, -1)
    at[lengths] = np.arange(len(lengths))
    out: list[tuple[Pattern, float, int]] = []
    k = len(lengths) - 1
    while k >= 0:
        if left[k] <= 0:
            k -= 1
            continue
        pattern = filled(k, left, lengths, at, capacity, 1 if whole else 1e-6)
        times, scarce = min((int(left[i]) // n if whole else left[i] / n, i) for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= n * times
        if not whole:
            left[scarce] = 0
        out.append((pattern, times, scarce))
    return out


def column_key(pattern: Pattern, cost: float) -> tuple:
    return (*sorted(pattern.items()), cost)


class Columns:
    """All columns so far: places and copies, padded to a common width, and costs."""

    def __init__(self) -> None:
        self.seen: dict[tuple, int] = {}
        self.patterns: list[Pattern] = []
        self.places, self.copies = np.zeros((0, 1), np.int64), np.zeros((0, 1))
        self.costs = np.zeros(0)

    def add(self, patterns: list[Pattern], costs: np.ndarray) -> None:
        fresh = []
        for p, c in zip(patterns, costs.tolist(), strict=True):
            if (key := column_key(p, c)) not in self.seen:
                self.seen[key] = len(self.patterns) + len(fresh)
                fresh.append((p, c))
        if not fresh:
            return
        width = max(self.places.shape[1], *(len(p) for p, _ in fresh))
        grow = ((0, len(fresh)), (0, width - self.places.shape[1]))
        self.places, self.copies = np.pad(self.places, grow), np.pad(self.copies, grow)
        for row, (p, _) in enumerate(fresh, len(self.patterns)):
            self.places[row, : len(p)], self.copies[row, : len(p)] = list(p), list(p.values())
        self.patterns += [p for p, _ in fresh]
        self.costs = np.append(self.costs, [c for _, c in fresh])

    def gains(self, prices: np.ndarray) -> np.ndarray:
        return (prices[self.places] * self.copies).sum(1) - self.costs


class Master:
    """The restricted linear program: revised simplex with an explicit
    inverse, one row for each length, so ``capacity`` rows at most whatever
    the number of documents.

    The first basis is ``start``, patterns each of which exhausts a
    length that no later one has: with the rows in that order it is
    triangular, so that from the last one on each changes a column of the
    inverse.  Lengths that are exhausted along with another go to the stream.
    """

    def __init__(self, demand: np.ndarray, stream: np.ndarray, start: list[tuple[Pattern, int, int]]) -> None:
        m = len(demand)
        self.columns = Columns()
        self.columns.add([{k: 1} for k in range(m)], stream)
        self.columns.add([p for p, _, _ in start], np.ones(len(start)))
        self.basis, self.level, self.inverse = np.arange(m), np.zeros(m), np.eye(m)
        for pattern, times, k in reversed(start):
            self.basis[k], self.level[k] = self.columns.seen[column_key(pattern, 1.0)], times
            column = self._column(self.basis[k])
            self.inverse[:, k] = -column / column[k]
            self.inverse[k, k] = 1 / column[k]
        self.cost = self.columns.costs[self.basis]
        self.level += 1e-7 * demand.sum() / m * (1 + np.random.default_rng(0).random(m))  # against cycling

    def _column(self, j: int) -> np.ndarray:
        used = np.flatnonzero(self.columns.copies[j])
        return (self.inverse[:, self.columns.places[j, used]] * self.columns.copies[j, used]).sum(1)

    def solve(self) -> np.ndarray:
        """Let columns in, the most gainful first, while any gains; the prices."""
        prices = (self.cost[:, None] * self.inverse).sum(0)
        while True:
            gains = self.columns.gains(prices)
            j = int(gains.argmax())
            if gains[j] <= 1e-9:
                return prices
            column = self._column(j)
            ratio = np.full(len(column), np.inf)
            np.divide(self.level, column, out=ratio, where=column > 1e-9)
            out = int(ratio.argmin())
            step = ratio[out]
            self.level = np.maximum(self.level - step * column, 0)
            self.level[out] = step
            row = self.inverse[out] / column[out]
            touched = np.flatnonzero(np.abs(column) > 1e-13)
            self.inverse[touched] -= column[touched, None] * row
            self.inverse[out] = row
            prices = prices - gains[j] * row
            self.basis[out], self.cost[out] = j, self.columns.costs[j]


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int = 1024, gap: float = GAP) -> tuple[list[tuple[Pattern, float]], float]:
    """Solve the relaxation: patterns with how often each is used, and the
    cost in sequences, within ``gap`` (or ``SLACK`` sequences) of the optimum.

    Prices are drawn toward those of the best bound so far, so that they do
    not swing between rounds.
    """
    if (m := len(lengths)) == 0:
        return [], 0.0
    stream = lengths / capacity + CUT_COST
    master = Master(demand, stream, greedy_patterns(lengths, demand, capacity, whole=False))
    bound, anchor = float(lengths @ demand) / capacity, None
    done = False
    while not done:
        prices, now = master.solve(), float(master.cost @ master.level)
        tried = [prices] if anchor is None else [DRAW * anchor + (1 - DRAW) * prices, prices]
        done = True
        for probe in tried:
            probe = np.minimum(probe, stream)
            best, choice = knapsack(probe, lengths, capacity)
            # Farley's bound: prices over the best pattern's value are feasible in the dual
            value = max(best[capacity], 1.0)
            if anchor is None or probe @ demand / value > bound:
                anchor = probe / value
                bound = max(bound, float(anchor @ demand))
            if now - bound <= max(gap * now, SLACK):
                break
            around = probe + best[capacity - lengths]
            fresh = []
            for k in np.argsort(-around, kind="stable")[:COLUMNS_A_ROUND].tolist():
                pattern = chosen(choice, lengths, capacity - int(lengths[k]))
                pattern[k] = pattern.get(k, 0) + 1
                if sum(prices[i] * n for i, n in pattern.items()) > 1 + 1e-9:
                    fresh.append(pattern)
            if fresh:
                master.columns.add(fresh, np.ones(len(fresh)))
                done = False
                break
    return [(master.columns.patterns[j], float(x)) for j, x in zip(master.basis.tolist(), master.level.tolist(), strict=True) if j >= m and x > 1e-6], float(master.cost @ master.level)


def whole_solution(lengths: np.ndarray, demand: np.ndarray, capacity: int = 1024) -> tuple[list[tuple[Pattern, int]], list[tuple[Pattern, int]]]:
    """Patterns and whole numbers of uses, within the demand: those of the
    linear program rounded down, and those sought for what these leave."""
    left, program, rest = demand.astype(np.int64), [], []
    for pattern, level in column_generation(lengths, demand, capacity)[0]:
        if times := min([int(level + 1e-4), *(int(left[k]) // n for k, n in pattern.items())]):
            program.append((pattern, times))
            for k, n in pattern.items():
                left[k] -= n * times
    for pattern, times, _ in greedy_patterns(lengths, left, capacity, whole=True):
        if sum(n * (lengths[k] / capacity + CUT_COST) for k, n in pattern.items()) >= 1:
            rest.append((pattern, int(times)))
    return program, rest
