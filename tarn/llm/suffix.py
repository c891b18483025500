"""Suffix and common-prefix arrays by external induced sorting.

The leftmost suffixes of rising stretches (*seeds*) are sorted by their stretches, named, and, where names repeat, ordered by
recursion on the string of names. All other suffixes are induced: a scan in rising order gives each falling suffix from the
one that follows it in the text, a scan in falling order each rising one. Between the scans' present place and the places
where suffixes belong they wait in a disk-backed priority queue, ordered by first symbol and arrival, which carries with each
suffix the length of the prefix that it shares with the one before it: one more than the least shared length that the scan
has passed since it last sent a suffix to that symbol. Scans work on whole queue blocks at a time, and large names are
written as two symbols, so that there are few blocks. Arrays beyond ``memory`` bytes live in files under ``folder``. Recursion
ends where the string of names is no longer than a block; that is sorted by doubled prefixes in memory.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np

#: Names above this many are written as two symbols.
ONE_SYMBOL = 256
#: A string of names of this length at most, a block's worth, is sorted in memory: where recursion ends.
IN_MEMORY = 1 << 15
_FAN = 12
_FAR = np.int32(2**31 - 1)


class Scratch:
    """Arrays in memory up to ``memory`` bytes each, beyond that in files under ``folder`` (None: always in memory)."""

    def __init__(self, folder: str | None = None, memory: int = 64 << 20, in_memory: int = IN_MEMORY):
        self.folder, self.memory, self.in_memory, self.files = folder, memory, in_memory, []

    def array(self, n: int, dtype) -> np.ndarray:
        dtype = np.dtype(dtype)
        if self.folder is None or n * dtype.itemsize <= self.memory:
            return np.empty(n, dtype)
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        self.files.append(path)
        return np.memmap(path, dtype=dtype, mode="w+", shape=(n,))

    def keep(self, values: np.ndarray) -> np.ndarray:
        out = self.array(len(values), values.dtype)
        out[:] = values
        return out

    def close(self) -> None:
        for path in self.files:
            if os.path.exists(path):
                os.remove(path)
        self.files.clear()


class BlockQueue:
    """A priority queue of (key, place, shared): least key first, then first come first served; popped a key at a time.

    Pushed blocks become sorted runs; when there are _FAN runs of a level they are merged into one of the next level, and
    runs beyond the scratch's memory lie in files.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels = scratch, [[]]

    def push(self, key: np.ndarray, place: np.ndarray, shared: np.ndarray) -> None:
        """Keys come sorted, and in the order of arrival where they are equal; none may be less than one already popped."""
        self.levels[0].append([key, place, shared, 0])  # the last is how many have been popped
        level = 0
        while len(self.levels[level]) >= _FAN:
            runs = self.levels[level]
            self.levels[level] = []
            parts = [[], [], []]
            for run in runs:
                for part, column in zip(parts, run):
                    part.append(column[run[3] :])
            key = np.concatenate(parts[0])
            order = np.argsort(key, kind="stable")
            merged = [*(self.scratch.keep(np.concatenate(part)[order]) for part in parts), 0]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All of one key, in the order of arrival."""
        places, shared = [], []
        for runs in reversed(self.levels):
            for run in runs:
                a = run[3]
                if a < len(run[0]) and run[0][a] == key:  # keys come rising, so smaller ones are gone
                    b = run[3] = a + int(np.searchsorted(run[0][a:], run[0][a], side="right"))
                    places.append(run[1][a:b])
                    shared.append(run[2][a:b])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(places), np.concatenate(shared)


class _Shared:
    """Least shared length that a scan has passed since it last sent a suffix to each symbol."""

    def __init__(self, symbols: int):
        self.least = np.full(symbols, _FAR, dtype=np.int32)
        self.sent = np.zeros(symbols, dtype=bool)

    def passed(self, lcp: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a block with shared lengths ``lcp`` whose members ``at`` (rising) go to symbols ``to``: the order of the
        members by symbol, and in that order the length each shares with the one sent there before."""
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        width = len(lcp)
        flat = np.empty((width.bit_length(), width), dtype=np.int32)  # least of 2 ** i in a row
        flat[0] = lcp
        for i in range(1, len(flat)):
            half, n = 1 << (i - 1), width + 1 - (1 << i)
            np.minimum(flat[i - 1, :n], flat[i - 1, half : half + n], out=flat[i, :n])

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Least of lcp[a:b] for each pair; none is empty."""
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            return np.minimum(flat[level, a], flat[level, b - (1 << level)])

        lead = np.ones(len(to), dtype=bool)
        lead[1:] = to[1:] != to[:-1]
        start = np.zeros(len(at), dtype=np.int64)
        start[1:] = at[:-1] + 1
        start[lead] = 0
        out = least(start, at + 1)
        heads = to[lead]
        out[lead] = np.minimum(out[lead], self.least[heads])
        out += 1
        out[lead] = np.where(self.sent[heads], out[lead], 0)
        np.minimum(self.least, lcp.min(), out=self.least)
        tails = np.flatnonzero(np.append(lead[1:], True))
        rest = np.full(len(tails), _FAR, dtype=np.int32)
        more = at[tails] + 1 < width
        if more.any():
            rest[more] = least(at[tails][more] + 1, np.full(int(more.sum()), width))
        self.least[heads] = rest
        self.sent[heads] = True
        return order, out

    def skip(self, lcp: np.ndarray) -> None:
        np.minimum(self.least, lcp.min(), out=self.least)


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Shared lengths of suffixes a and b of which ``known`` symbols are known to agree."""
    out = np.array(known, dtype=np.int32)
    live = np.flatnonzero(np.maximum(a, b) + out < len(text))
    while len(live):
        same = text[a[live] + out[live]] == text[b[live] + out[live]]
        live = live[same]
        out[live] += 1
        live = live[np.maximum(a[live], b[live]) + out[live] < len(text)]
    return out


def _induce(text: np.ndarray, symbols: int, seeds: np.ndarray, seed_lcp: np.ndarray | None, scratch: Scratch) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order, and shared lengths, from the seeds in order (None: only the order by stretches is wanted)."""
    n, lengths = len(text), seed_lcp is not None
    of_seed = text[seeds]
    seed_cut = np.searchsorted(of_seed, np.arange(symbols + 1))
    total = np.bincount(text, minlength=symbols)
    begin = np.concatenate(([0], np.cumsum(total)))
    sa, lcp = scratch.array(n, np.int64 if n >= 2**31 else np.int32), scratch.array(n, np.int32) if lengths else None
    falling = np.zeros(symbols, dtype=np.int64)
    none = np.zeros(0, np.int32)

    queue, passed = BlockQueue(scratch), _Shared(symbols)

    def send(place: np.ndarray, shared: np.ndarray, c: int, rising: bool, item_rising: bool) -> tuple[np.ndarray, np.ndarray]:
        """Send the block's predecessors to the queue; returns those that stay with the symbol of the block."""
        before = text[np.maximum(place - 1, 0)]
        wanted = place > 0
        if rising:
            wanted &= (before <= c) if item_rising else (before < c)
        else:
            wanted &= (before > c) if item_rising else (before >= c)
        at = np.flatnonzero(wanted)
        if not len(at):
            if lengths and len(shared):
                passed.skip(shared)
            return none, none
        to = before[at]
        if rising:
            to = (symbols - 1 - to).astype(to.dtype)
        if lengths:
            order, value = passed.passed(shared, at, to)
        else:
            order = np.argsort(to, kind="stable")
            value = np.zeros(len(order), np.int32)
        to, origin = to[order], place[at[order]] - 1
        own = symbols - 1 - c if rising else c
        split = np.searchsorted(to, to.dtype.type(own), side="right")  # of one type, else numpy copies all of them
        if split < len(to):
            queue.push(to[split:], origin[split:], value[split:])
        return origin[:split], value[:split]

    for c in range(symbols):
        place, shared = queue.pop(c)
        at = begin[c]
        while len(place):
            sa[at : at + len(place)] = place
            if lengths:
                lcp[at : at + len(place)] = shared
            at += len(place)
            place, shared = send(place, shared, c, False, False)
        falling[c] = at - begin[c]
        a, b = seed_cut[c], seed_cut[c + 1]
        if b > a:
            shared = none
            if lengths:
                shared = seed_lcp[a:b].copy()
                shared[0] = 0
                if falling[c]:
                    shared[0] = _extend(text, sa[at - 1 : at].astype(np.int64), seeds[a : a + 1], np.ones(1, np.int32))[0]
            send(seeds[a:b], shared, c, False, True)

    queue, passed = BlockQueue(scratch), _Shared(symbols)
    for c in range(symbols - 1, -1, -1):
        place, shared = queue.pop(symbols - 1 - c)
        if c == 0:
            place, shared = np.array([n - 1]), np.zeros(1, np.int32)
        end = begin[c + 1]
        while len(place):
            sa[end - len(place) : end] = place[::-1]
            if lengths:  # a suffix's length is shared with the next larger one: it stands one further up
                stop = min(end + 1, begin[c + 1])
                lcp[end - len(place) + 1 : stop] = shared[::-1][: stop - (end - len(place) + 1)]
            end -= len(place)
            place, shared = send(place, shared, c, True, True)
        first, m = begin[c], falling[c]
        if lengths and end < begin[c + 1]:
            lcp[end] = _extend(text, sa[end - 1 : end].astype(np.int64), sa[end : end + 1].astype(np.int64), np.ones(1, np.int32))[0] if m else 0
        if m:
            down = sa[first : first + m][::-1].astype(np.int64)
            shared = none
            if lengths:
                lcp[first] = 0
                shared = np.empty(m, np.int32)
                shared[1:] = lcp[first + 1 : first + m][::-1]
                shared[0] = lcp[end] if end < begin[c + 1] else 0
            send(down, shared, c, True, False)
    return sa, lcp


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the one that follows it; the last (the sentinel) counts as rising."""
    n = len(text)
    up = np.ones(n, dtype=bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if len(differs):
        changes = text[:-1] != text[1:]
        upto = np.cumsum(changes, dtype=np.int32 if n < 2**31 else np.int64)
        upto -= changes
        up[:-1] = (text[differs] < text[differs + 1])[upto]  # the sentinel differs from all, so every place has a next change
    return up


def _sort(text: np.ndarray, symbols: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Suffix and shared-length arrays of a text whose last symbol is 0 and occurs there alone."""
    n = len(text)
    up = _rising(text)
    is_seed = np.zeros(n, dtype=bool)
    is_seed[1:] = up[1:] & ~up[:-1]
    seeds = np.flatnonzero(is_seed)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    rough, _ = _induce(text, symbols, seeds[np.argsort(text[seeds], kind="stable")], None, scratch)
    ranked = np.asarray(rough)[is_seed[rough]].astype(np.int64)
    a, b = ranked[:-1], ranked[1:]
    same, live, d = np.zeros(len(a), dtype=bool), np.arange(len(a)), 0
    while len(live):
        live = live[np.maximum(a[live], b[live]) + d < n]
        ok = (text[a[live] + d] == text[b[live] + d]) & (up[a[live] + d] == up[b[live] + d])
        live = live[ok]
        if d:
            ends, other = is_seed[a[live] + d], is_seed[b[live] + d]
            same[live[ends & other]] = True
            live = live[~(ends | other)]
        d += 1
    names = np.zeros(n, dtype=np.int32 if n < 2**31 else np.int64)
    names[ranked] = np.concatenate(([0], np.cumsum(~same)))
    names = names[seeds]
    del rough, up, is_seed, a, b, live, ranked
    ends = np.append(seeds, n)
    if len(same) and same.any():
        order, agree = _doubled(names) if len(names) <= scratch.in_memory else suffix_array(names, scratch)
        first, second = order[:-1], order[1:]
        q = agree[1:]
        known = ends[np.minimum(first + q, len(seeds))] - ends[first]
        seed_lcp = np.concatenate(([0], _extend(text, seeds[first], seeds[second], known)))
    else:
        order = np.argsort(names)
        seed_lcp = np.concatenate(([0], _extend(text, seeds[order[:-1]], seeds[order[1:]], np.zeros(max(0, len(order) - 1), np.int32))))
    return _induce(text, symbols, seeds[order], seed_lcp.astype(np.int32), scratch)


def _doubled(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_array`` in memory: ranks by ever longer prefixes; shared lengths from the ranks, longest prefix first."""
    n = len(names)
    ranks, length = [np.unique(names, return_inverse=True)[1].astype(np.int64) + 1], 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - length] = ranks[-1][length:]
        key = ranks[-1].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.int64)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        ranks.append(rank.astype(np.int32) if n < 2**31 else rank)
        length *= 2
    a, b = order[:-1], order[1:]
    agree = np.zeros(max(0, n - 1), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        i, j = a + agree, b + agree
        ok = np.maximum(i, j) < n
        same = np.zeros(len(agree), dtype=bool)
        same[ok] = ranks[level][i[ok]] == ranks[level][j[ok]]
        agree[same] += 1 << level
    return order, np.concatenate(([0], agree))


def suffix_array(names: np.ndarray, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a sequence of non-negative numbers, and the length that each shares with the one before.

    An empty sequence gives empty arrays. The end of the sequence is less than any number.
    """
    scratch = scratch or Scratch()
    names = np.asarray(names)
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = int(names.max()) + 1
    width = 1 if kinds <= ONE_SYMBOL else 2
    base = kinds if width == 1 else math.isqrt(kinds - 1) + 1
    text = scratch.array(width * len(names) + 1, np.uint16 if base < 65535 else np.uint32)
    if width == 1:
        text[:-1] = names + 1
    else:
        text[:-1:2], text[1:-1:2] = names // base + 1, names % base + 1
    text[-1] = 0
    sa, lcp = _sort(text, base + 1, scratch)
    if width == 1:
        return np.asarray(sa[1:], dtype=np.int64), np.asarray(np.concatenate(([0], lcp[2:])), dtype=np.int64)
    kept = np.flatnonzero((sa[1:] & 1) == 0) + 1
    shared = np.minimum.reduceat(lcp, kept[:-1] + 1) if len(kept) > 1 else np.zeros(0, np.int32)
    if len(kept) > 1:  # from one kept suffix to the next, not beyond the last
        shared[-1] = lcp[kept[-2] + 1 : kept[-1] + 1].min()
    return np.asarray(sa[kept], dtype=np.int64) // 2, np.concatenate(([0], shared // 2)).astype(np.int64)
