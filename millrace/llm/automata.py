"""Probabilistic automata learned from example strings by state merging.

A prefix tree counts the examples. States are then visited breadth first; each is merged into the first accepted
state whose ending and continuing frequencies, and those of all successors in turn, agree within a Hoeffding bound,
or else accepted itself. Symbols are classes of bytes, so the automaton describes a format and not its examples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

CLASSES = 12
#: Class of each byte: digits, lower a-f, g-z, upper A-F, G-Z, the signs of common encodings, and 11 for the rest.
CLASS_OF = np.full(256, 11, np.int64)
for _k, _chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "-", "=", ".")):
    for _c in _chars:
        CLASS_OF[ord(_c)] = _k
CLASS_SIZE = np.bincount(CLASS_OF, minlength=CLASSES)
#: Coarse classes, for what formats have in common: a digit, a letter of either case, a sign, the rest.
COARSE = np.array([0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3])
#: Share of the background's probability that any byte has in any context, so that nothing costs without bound.
FLOOR = 0.001


@dataclass
class Automaton:
    """``step[s, c]`` is the next state, ``log_step[s, c]`` its log-probability with the byte within the class, ``log_end[s]`` that of ending."""

    step: np.ndarray
    log_step: np.ndarray
    log_end: np.ndarray
    class_of: np.ndarray = field(default_factory=lambda: CLASS_OF)

    def log_likelihood(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of many byte runs, one step of all of them at a time."""
        order = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        live = len(starts)
        for k in range(int(sizes[0]) if live else 0):
            live = int(np.searchsorted(-sizes, -k, side="left"))
            symbol = self.class_of[data[starts[:live] + k]]
            total[:live] += self.log_step[state[:live], symbol]
            state[:live] = self.step[state[:live], symbol]
        out = np.empty(len(starts))
        out[order] = total + self.log_end[state]
        return out


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def learn(examples: list[bytes], alpha: float = 0.05, smoothing: float = 0.02, coarse: bool = False) -> Automaton | None:
    """The automaton of the examples, over coarse classes if asked, the same for any order of them; None without any."""
    if not examples:
        return None
    class_of = COARSE[CLASS_OF] if coarse else CLASS_OF
    classes = int(class_of.max()) + 1
    class_size = np.bincount(class_of, minlength=classes)
    count, end, children = [0], [0], [{}]
    for example in sorted(examples):
        node = 0
        count[0] += 1
        for c in class_of[np.frombuffer(example, np.uint8)].tolist():
            if c not in children[node]:
                children[node][c] = len(count)
                count.append(0)
                end.append(0)
                children.append({})
            node = children[node][c]
            count[node] += 1
        end[node] += 1

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if _differ(end[a], count[a], end[b], count[b], alpha):
                return False
            for c in children[a].keys() | children[b].keys():
                x, y = children[a].get(c), children[b].get(c)
                if _differ(count[x] if x is not None else 0, count[a], count[y] if y is not None else 0, count[b], alpha):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            count[a] += count[b]
            end[a] += end[b]
            for c, y in children[b].items():
                x = children[a].get(c)
                if x is None:
                    children[a][c] = y
                elif x != y:
                    todo.append((x, y))

    red, blue = [0], [(0, c) for c in sorted(children[0])]
    accepted = {0}
    while blue:
        blue.sort(key=lambda e: (-count[children[e[0]][e[1]]], e))
        parent, c = blue.pop(0)
        node = children[parent].get(c)
        if node in accepted:
            continue
        target = next((r for r in red if compatible(r, node)), None)
        if target is None:
            red.append(node)
            accepted.add(node)
        else:
            children[parent][c] = target
            fold(target, node)
        known = {(r, s) for r in red for s in children[r] if children[r][s] not in accepted}
        blue = sorted(known)
    number = {s: i for i, s in enumerate(red)}
    dead = len(red)
    step = np.full((dead + 1, classes), dead)
    counts = np.full((dead + 1, classes + 1), smoothing)
    for s, i in number.items():
        for c, t in children[s].items():
            step[i, c] = number[t]
        counts[i, classes] += end[s]
    # The flow through each edge, by running the examples once more.
    for example in examples:
        i = 0
        for c in class_of[np.frombuffer(example, np.uint8)].tolist():
            counts[i, c] += 1
            i = step[i, c]
    probability = counts / counts.sum(axis=1, keepdims=True)
    log_step = np.log(probability[:, :classes]) - np.log(np.maximum(class_size, 1))
    return Automaton(step, log_step, np.log(probability[:, classes]), class_of)


#: Contexts of the background: the classes of the two bytes before, ``CLASSES`` standing for what precedes a run.
CONTEXTS = (CLASSES + 1) ** 2


def context_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each class, or the end (``CLASSES``), follows each context in the byte runs; flat, ``CONTEXTS`` rows."""
    code, _ = _contexts(data, starts, ends)
    return np.bincount(code, minlength=CONTEXTS * (CLASSES + 1))


def _contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each run and for its end, its context and class as one number; and where each run's begin."""
    size = ends - starts + 1
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    symbol = np.full(len(place), CLASSES)
    inside = place < np.repeat(size - 1, size)
    symbol[inside] = CLASS_OF[data[(np.repeat(starts, size) + place)[inside]]]
    one, two = np.full(len(place), CLASSES), np.full(len(place), CLASSES)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    one[place < 1], two[place < 2] = CLASSES, CLASSES
    return (two * (CLASSES + 1) + one) * (CLASSES + 1) + symbol, first


class Background:
    """The automaton of ordinary words, whose states are the classes of the last two bytes, from counts of all of them."""

    def __init__(self, counts: np.ndarray):
        n = np.asarray(counts, np.float64).reshape(CLASSES + 1, CLASSES + 1, CLASSES + 1)
        share = np.full(CLASSES + 1, 1 / (CLASSES + 1))
        for level in (n.sum(axis=(0, 1)), n.sum(axis=0), n):
            share = (level + share) / (level.sum(axis=-1, keepdims=True) + 1)
        share = (1 - FLOOR) * share + FLOOR / (CLASSES + 1)
        self.logs = (np.log(share) - np.log(np.append(np.maximum(CLASS_SIZE, 1), 1))).ravel()

    def log_likelihood(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of many byte runs."""
        code, first = _contexts(data, starts, ends)
        return np.add.reduceat(self.logs[code], first) if len(first) else np.zeros(0)
