"""A lexicon of words with number sequences, as a minimal acyclic transducer in one flat file.

Words are walked byte by byte; an arc carries a label and the numbers that are
certain once it is taken, pushed as near to the root as they go, and states
from which the same suffixes give the same numbers are one state. The file is
read through a memory map, so the workers of a machine share its pages, and
all words of a batch walk it together.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_ARCS = [("key", "<i8"), ("target", "<i4"), ("at", "<i4"), ("size", "<i4"), ("_", "<i4")]
_STATES = [("at", "<i4"), ("size", "<i4")]  # size -1: no word ends here


def _shared(a, b) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file's content for (word, numbers), which come in ascending order of distinct, non-empty words."""
    states: list[tuple] = []
    register: dict[tuple, int] = {}
    # open states lie along the last word; each is [arcs, numbers at a word's end or None], an arc [label, numbers, target]
    path: list[list] = [[[], None]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth:
            arcs, end = path.pop()
            state = (end, tuple(map(tuple, arcs)))
            number = register.setdefault(state, len(states))
            if number == len(states):
                states.append(state)
            if path:
                path[-1][0][-1][2] = number

    for word, numbers in entries:
        if word <= last:
            raise ValueError("words must be distinct, not empty and in ascending order")
        common, rest = _shared(word, last), tuple(numbers)
        close(common + 1)
        for label in word[common:]:
            path[-1][0].append([label, (), -1])
            path.append([[], None])
        path[-1][1] = ()
        for depth in range(common):
            arc, below = path[depth][0][-1], path[depth + 1]
            n = _shared(arc[1], rest)
            later, arc[1], rest = arc[1][n:], arc[1][:n], rest[n:]
            if later:  # what is no longer certain here moves one arc down
                for other in below[0]:
                    other[1] = later + other[1]
                if below[1] is not None:
                    below[1] = later + below[1]
        path[common][0][-1][1] = rest
        last = word
    close(0)

    places: dict[tuple, int] = {}
    pool: list[int] = []

    def place(numbers: tuple[int, ...]) -> int:
        if numbers not in places:
            places[numbers] = len(pool)
            pool.extend(numbers)
        return places[numbers]

    ends = np.array([(0, -1) if end is None else (place(end), len(end)) for end, _ in states], _STATES)
    arcs = np.array([(s << 8 | label, target, place(out), len(out), 0) for s, (_, own) in enumerate(states) for label, out, target in own], _ARCS)
    arcs.sort(order="key")
    header = np.array([len(arcs), len(states), len(pool)], "<i8")
    return header.tobytes() + arcs.tobytes() + ends.tobytes() + np.array(pool, "<i4").tobytes()


class Transducer:
    """Looks words up in a file made by compiled(); the root is the last state."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n_arcs, n_states, n_pool = (int(n) for n in raw[:24].view("<i8"))
        at = 24 + n_arcs * np.dtype(_ARCS).itemsize
        self.arcs = raw[24:at].view(_ARCS)
        self.keys = np.ascontiguousarray(self.arcs["key"])
        self.ends = raw[at : at + 8 * n_states].view(_STATES)
        self.pool = raw[at + 8 * n_states : at + 8 * n_states + 4 * n_pool].view("<i4")
        self.root = n_states - 1

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, sizes, numbers): whether each word is here, how many numbers it has, and the numbers of all, end to end."""
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(words), np.uint8)
        found, active, state = np.zeros(n, bool), np.flatnonzero(sizes > 0), np.full(n, self.root, np.int64)
        owners, starts, lengths = [], [], []

        def say(who: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
            some = size > 0
            owners.append(who[some])
            starts.append(at[some])
            lengths.append(size[some])

        step = 0
        while len(active) and len(self.keys):
            key = state[active] << 8 | flat[first[active] + step]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[place] == key
            active, arcs = active[there], self.arcs[place[there]]
            state[active] = arcs["target"]
            say(active, arcs["at"], arcs["size"])
            step += 1
            over = sizes[active] == step
            ends = self.ends[state[active[over]]]
            good = ends["size"] >= 0
            found[active[over][good]] = True
            say(active[over][good], ends["at"][good], ends["size"][good])
            active = active[~over]
        if not owners:
            return found, np.zeros(n, np.int64), np.zeros(0, np.int32)
        owner, start, length = np.concatenate(owners), np.concatenate(starts).astype(np.int64), np.concatenate(lengths).astype(np.int64)
        order = np.flatnonzero(found[owner])
        order = order[np.argsort(owner[order], kind="stable")]
        owner, start, length = owner[order], start[order], length[order]
        before = np.cumsum(length) - length
        numbers = self.pool[np.repeat(start - before, length) + np.arange(length.sum())]
        return found, np.bincount(owner, length, n).astype(np.int64), numbers
