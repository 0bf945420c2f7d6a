"""Probabilistic automata learned from example strings by merging states of their prefix tree.

The prefix tree of the examples is folded state by state (red-blue order): a state joins an
accepted one if a Hoeffding bound finds neither their chances of ending nor those of any next
symbol, nor those of the states these lead to, different; otherwise it is accepted itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np


def symbol_classes() -> tuple[np.ndarray, int]:
    """A class for each byte: a-f, g-z, A-F, G-Z, digits, each of ``+/_.=-``, and all others."""
    table = np.full(256, 11, np.int64)
    for k, group in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", *"+/_.=-")):
        table[np.frombuffer(group.encode(), np.uint8)] = k
    return table, 12


CLASSES, N_CLASSES = symbol_classes()


@dataclass
class Automaton:
    """``move[state, symbol]`` is the next state, ``cost`` its negative log chance, ``end`` that of ending.

    A move never seen leads back to the first state at the cost of its smoothed chance. ``prior`` is the
    log of how many strings of this kind there are, of which the examples may be a sample.
    """

    move: np.ndarray
    cost: np.ndarray
    end: np.ndarray
    prior: float = 0.0

    def costs(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The negative log likelihood of each string, all strings a symbol at a time."""
        order = np.argsort(-sizes, kind="stable")
        state, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        left = sizes[order]
        for k in range(int(sizes.max(initial=0))):
            live = order[: int(np.searchsorted(-left, -k, side="left"))]
            symbol = symbols[starts[live] + k]
            total[live] += self.cost[state[live], symbol]
            state[live] = self.move[state[live], symbol]
        return total + self.end[state]


@dataclass
class _State:
    count: int = 0
    ends: int = 0
    next: dict[int, int] = field(default_factory=dict)


def learn(
    examples: list[list[int]], alpha: float = 0.01, least: int = 8, weights: list[float] | None = None, unseen: float = 0.1
) -> Automaton:
    """An automaton for ``examples`` of symbol classes; states seen fewer than ``least`` times always fit.

    States are merged by the examples as they are. ``weights`` tell for how many strings each stands,
    which the chances of moves and the prior follow. A move that was not seen counts as ``unseen`` examples.
    """
    states = [_State()]
    for example in examples:
        at = 0
        states[at].count += 1
        for symbol in example:
            if symbol not in states[at].next:
                states[at].next[symbol] = len(states)
                states.append(_State())
            at = states[at].next[symbol]
            states[at].count += 1
        states[at].ends += 1
    reach = sqrt(0.5 * log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > reach * (1 / sqrt(n1) + 1 / sqrt(n2))

    def fits(a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            p, q = states[a], states[b]
            if min(p.count, q.count) < least:
                continue
            if differ(p.ends, p.count, q.ends, q.count):
                return False
            for symbol in p.next.keys() | q.next.keys():
                x, y = p.next.get(symbol), q.next.get(symbol)
                if differ(states[x].count if x is not None else 0, p.count, states[y].count if y is not None else 0, q.count):
                    return False
                if x is not None and y is not None:
                    pairs.append((x, y))
        return True

    def fold(a: int, b: int) -> None:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            states[a].count += states[b].count
            states[a].ends += states[b].ends
            for symbol, y in states[b].next.items():
                if symbol in states[a].next:
                    pairs.append((states[a].next[symbol], y))
                else:
                    states[a].next[symbol] = y

    red = [0]
    while True:
        blue = sorted({(y, x, s) for x in red for s, y in states[x].next.items() if y not in red})
        if not blue:
            break
        b, parent, symbol = max(blue, key=lambda t: (states[t[0]].count, -t[0]))
        for r in red:
            if fits(r, b):
                states[parent].next[symbol] = r
                fold(r, b)
                break
        else:
            red.append(b)
    number = {x: k for k, x in enumerate(red)}
    move = np.zeros((len(red), N_CLASSES), np.int64)
    for x, k in number.items():
        for symbol, y in states[x].next.items():
            move[k, symbol] = number[y]
    return _counted(examples, move, weights or [1.0] * len(examples), unseen)


def _counted(examples: list[list[int]], move: np.ndarray, weights: list[float], unseen: float) -> Automaton:
    """Chances of moves and ends, from running the examples through the merged automaton."""
    # moves, and ends in the last column, of all strings and of the examples
    strings, seen = np.zeros((len(move), N_CLASSES + 1)), np.zeros(len(move))
    for example, weight in zip(examples, weights, strict=True):
        at = 0
        for symbol in example:
            strings[at, symbol] += weight
            seen[at] += 1
            at = move[at, symbol]
        strings[at, N_CLASSES] += weight
        seen[at] += 1
    # an example that was not seen weighs as those that were seen in its state
    whole = strings.sum(axis=1)
    strings += unseen * np.where(seen > 0, whole / np.maximum(seen, 1), 1.0)[:, None]
    cost = -np.log(strings / strings.sum(axis=1, keepdims=True))
    return Automaton(move, cost[:, :N_CLASSES], cost[:, N_CLASSES], log(max(sum(weights), 1.0)))
