"""Cheapest edits of many sequences of turns at once, the least audit among equals.

A sequence is a list of kinds, one for each turn and, at the end of a conversation, ``END``.
Nodes are (level, state): so many turns are behind, and the roles kept so far have led to
that state.  The cost DP runs from the last level to the first; of every node it leaves the
optimal arcs with the least edit.  Which of several targets is best is settled by prefix
doubling: nodes of a level are ranked by their least audits of 1, 2, 4, ... edits, and a
node's pointer leads to all nodes (of one level) that its least audit of that length reaches.
Equal audits use up equal numbers of turns, so ranks only ever compare nodes of one level.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# States: nothing kept, a system turn, an open user turn, an answered one.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NONE = -1
# Where a kept turn with this initial leads from each state; an empty role changes nothing.
NEXT = {
    "s": (SYSTEM, NONE, NONE, NONE),
    "u": (USER, USER, NONE, USER),
    "a": (NONE, NONE, ASSISTANT, NONE),
    "": (START, SYSTEM, USER, ASSISTANT),
}
ACCEPTED = (START, ASSISTANT)
# What the edits cost.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
# Edits by the order of their initials; the end of an audit comes before all.
LETTERS = "\0DIKR"
E, D, I, K, R = range(5)
END = ("end", False, False)
FAR = 10**9

Kind = tuple[str, bool, bool]


def kind_of(initial: str, must_go: bool, cut_off: bool) -> Kind:
    """What matters of a turn: its role's initial, and whether it is to be deleted or cut off."""
    return (initial if initial in NEXT else "?", must_go, cut_off and not must_go)


@cache
def _arcs(kind: Kind) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each state the arcs that use up the turn: (edit, target, cost)."""
    initial, must_go, cut_off = kind
    if kind == END:
        return tuple(((E, q, 0),) if q in ACCEPTED else () for q in range(STATES))
    out = []
    for q in range(STATES):
        arcs = [(D, q, DELETE)]
        if not must_go:
            more = CUT_OFF if cut_off else 0
            if initial in NEXT:
                arcs.append((K, NEXT[initial][q], more))
            arcs += [(R, NEXT[to][q], REROLE + more) for to in "ua"]
        out.append(tuple(a for a in arcs if a[1] != NONE))
    return tuple(out)


@cache
def level(kind: Kind, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """One level of the cost DP, from the costs of the next one.

    For each state its cost, the least first edit of its optimal paths, and the targets of
    that edit as a set of bits.  An insertion stays on the level, all others leave it.
    """
    cost = [
        min((c + after[t] for _, t, c in arcs), default=FAR) for arcs in _arcs(kind)
    ]
    inserts = [[NEXT[to][q] for to in "ua" if NEXT[to][q] != NONE] for q in range(STATES)]
    for _ in range(STATES):
        cost = [min([cost[q], *(INSERT + cost[t] for t in inserts[q])]) for q in range(STATES)]
    edits, targets = [], []
    for q in range(STATES):
        best = [(e, t) for e, t, c in _arcs(kind)[q] if c + after[t] == cost[q]]
        best += [(I, t) for t in inserts[q] if INSERT + cost[t] == cost[q]]
        least = min((e for e, _ in best), default=D)
        edits.append(least)
        targets.append(sum({1 << t for e, t in best if e == least}))
    return tuple(min(c, FAR) for c in cost), tuple(edits), tuple(targets)


def costs_through(kinds: list[Kind]) -> list[list[int]]:
    """Cost of the cheapest edits from each state before the turns to each state after them."""
    out = [[FAR] * STATES for _ in range(STATES)]
    for to in range(STATES):
        shift, costs = 0, tuple(0 if q == to else FAR for q in range(STATES))
        for kind in reversed(kinds):
            costs = level(kind, costs)[0]
            low = min(costs)
            if low >= FAR:
                break
            # Only differences are carried, so that few different levels are ever solved.
            shift, costs = shift + low, tuple(c - low if c < FAR else FAR for c in costs)
        for q in range(STATES):
            out[q][to] = costs[q] + shift if costs[q] < FAR else FAR
    return out


def before(through: list[list[int]], after: list[int]) -> list[int]:
    """Costs before a stretch of turns, from the costs after it."""
    return [min(min(m + a, FAR) for m, a in zip(row, after)) for row in through]


class Ranked:
    """Several sequences, solved together.

    ``after`` has for each sequence the costs of the states it may end in, and ``order`` how
    what follows ranks them (both all zero where the sequence ends with ``END``).
    """

    def __init__(
        self, sequences: list[list[Kind]], after: list[tuple[int, ...]], order: list[tuple[int, ...]]
    ) -> None:
        edits, targets, self.first, self.cost = [], [], [], []
        bits = tuple(1 << q for q in range(STATES))
        last = []
        for kinds, costs, ranks in zip(sequences, after, order):
            low = min(costs)
            shift, costs = low, tuple(c - low if c < FAR else FAR for c in costs)
            edits.append(ranks)
            targets.append(bits)
            last.append(len(edits) - 1)
            for kind in reversed(kinds):
                costs, edit, target = level(kind, costs)
                edits.append(edit)
                targets.append(target)
                low = min(costs)
                if low:
                    shift, costs = shift + low, tuple(c - low if c < FAR else FAR for c in costs)
            self.first.append(len(edits) - 1)
            self.cost.append([c + shift if c < FAR else FAR for c in costs])
        # Levels are kept from the last one back; the next level of i is i - 1.
        self.edit = np.array(edits, np.int8).reshape(-1, STATES)
        self.target = np.array(targets, np.uint8).reshape(-1, STATES)
        self.end = np.zeros(len(edits), bool)
        self.end[last] = True
        self.first = np.array(self.first, np.int64)
        self._rank()

    def _rank(self) -> None:
        n = len(self.edit)
        own = np.arange(n)[:, None]
        stays = self.end[:, None] | (self.edit == I)
        self.step = np.where(stays, own, own - 1)
        bits = (1 << np.arange(STATES)).astype(np.uint8)
        rank, jump, reach = self.edit.astype(np.int64), self.step, self.target
        settled = False
        while not settled:
            settled = bool(self.end[jump].all())
            there = (reach[:, :, None] & bits) != 0
            ranks = np.where(there, rank[jump], 99)
            best = ranks.min(axis=2)
            chosen = ranks == best[:, :, None]
            # What a chosen node reaches lies on one level, whichever of them it is.
            one = chosen.argmax(axis=2)
            beyond = np.bitwise_or.reduce(np.where(chosen, reach[jump], 0), axis=2)
            jump_beyond = np.take_along_axis(jump[jump], one[:, :, None], 2)[:, :, 0]
            key = rank * 128 + best
            rank = (key[:, None, :] < key[:, :, None]).sum(axis=2)
            jump, reach = jump_beyond, beyond.astype(np.uint8)
        self.rank, self.reach = rank, reach

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """For each sequence and state before it: the rank of its least audit among the four,
        and the states it may end in."""
        return self.rank[self.first], self.reach[self.first]

    def paths(self, entry: list[int]) -> list[list[tuple[int, int, int]]]:
        """The least path of each sequence from its entry state: (edit, turn, target state).

        Pointers to the best target are doubled; the nodes of a path and their places are
        then found by going 2^k edits ahead of all nodes known so far, k from high to low.
        """
        n = len(self.edit)
        ranks = np.where((self.target[:, :, None] >> np.arange(STATES)) & 1, self.rank[self.step], 99)
        best = ranks.argmin(axis=2)
        ahead = [(self.step * STATES + best).ravel()]
        ending = np.repeat(self.end, STATES)
        start = self.first * STATES + np.array(entry, np.int64)
        at = ahead[0][start]
        while not ending[at].all():
            ahead.append(ahead[-1][ahead[-1]])
            at = ahead[-1][at]
        place = np.full(n * STATES, -1, np.int64)
        place[start] = 0
        for k in range(len(ahead) - 1, -1, -1):
            known = np.flatnonzero((place >= 0) & ~ending)
            to = ahead[k][known]
            new = ~ending[to]
            place[to[new]] = place[known[new]] + (1 << k)
        nodes = np.flatnonzero((place >= 0) & ~ending)
        levels = nodes // STATES
        which = np.searchsorted(self.first, levels)
        order = np.lexsort((place[nodes], which))
        nodes, levels, which = nodes[order], levels[order], which[order]
        turns = self.first[which] - levels
        out: list[list[tuple[int, int, int]]] = [[] for _ in entry]
        edits, targets = self.edit.ravel()[nodes], ahead[0][nodes] % STATES
        for s, e, t, q in zip(which.tolist(), edits.tolist(), turns.tolist(), targets.tolist()):
            out[s].append((e, t, q))
        return out
