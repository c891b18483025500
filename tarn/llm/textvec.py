"""Tokens of whole Arrow text columns as numpy arrays: no Python object per token.

A *word* is a maximal run of ASCII letters, digits, ``_`` and bytes of non-ASCII characters; a *symbol* is a maximal run of
other visible ASCII characters. A *chunk of text* (``by="space"``) is a maximal run of bytes above 32. Null and empty texts
have no tokens. Hashes are 64 bits wide and depend on the token's bytes alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tarn.llm.common import flat_binary

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_WORD = np.zeros(256, dtype=np.uint8)
_WORD[33:127] = 2
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = 1
_WORD[128:] = 1
_SPACE = (np.arange(256) > 32).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """Tokens of a column in order; row r has tokens ``rows[r]:rows[r + 1]``."""

    hash: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    raw: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


#: Bytes whose hashes are worked on at a time.
PIECE = 1 << 19
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        table = np.full(size, _BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def tokens(column: pa.Array, by: str = "word") -> Tokens:
    """Split every text of ``column``. by: "word" (words only), "all" (words and symbols) or "space" (chunks of text)."""
    raw, off = flat_binary(column)
    n = len(raw)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return Tokens(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z, np.zeros(0, np.uint8), raw)
    kind = (_SPACE if by == "space" else _WORD)[raw]
    if by == "word":
        kind = kind & 1
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[off] = True
    inside = kind != 0
    start = np.flatnonzero(edge[:n] & inside)
    end = np.flatnonzero(edge[1:] & inside) + 1
    del edge, inside
    hashed = mix(_sums(raw, start, end) ^ (end - start).astype(np.uint64) * _STEP)
    return Tokens(hashed, np.searchsorted(start, off), start, end, kind[start], raw)


def _sums(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial of the bytes of each span (none empty, in order); PIECE bytes are worked on at a time, and longer spans in
    parts, so that a very long text or token needs no more memory than its marks."""
    out = np.zeros(len(start), dtype=np.uint64)
    size = end - start
    upto = np.cumsum(size)
    i = 0
    while i < len(start):
        before = int(upto[i - 1]) if i else 0
        j = int(np.searchsorted(upto, before + PIECE, side="right"))
        if j == i:  # one span longer than a piece
            scale, step = 1, pow(int(_BASE), PIECE, 1 << 64)
            total = 0
            for a in range(int(start[i]), int(end[i]), PIECE):
                part = raw[a : min(a + PIECE, int(end[i]))].astype(np.uint64) + np.uint64(1)
                total += int((part * _power_table(PIECE)[: len(part)]).sum(dtype=np.uint64)) * scale
                scale = scale * step % (1 << 64)
            out[i] = np.uint64(total % (1 << 64))
            i += 1
            continue
        n = size[i:j]
        first = upto[i:j] - n - before
        place = np.arange(int(upto[j - 1]) - before, dtype=np.int64) - np.repeat(first, n)
        part = raw[place + np.repeat(start[i:j], n)].astype(np.uint64) + np.uint64(1)
        part *= _power_table(int(n.max()))[place]
        out[i:j] = np.add.reduceat(part, first)
        i = j
    return out


def hash_rows(column: pa.Array) -> np.ndarray:
    """Hash of each whole value of a string or binary column."""
    raw, off = flat_binary(column)
    size = np.diff(off)
    out = np.zeros(len(size), dtype=np.uint64)
    if len(raw):
        some = size > 0
        out[some] = _sums(raw, off[:-1][some], off[1:][some])
    return mix(out ^ size.astype(np.uint64) * _STEP)


def ngrams(hashed: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n tokens within a row, and each one's first token. Runs never cross rows."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = hashed[:count].copy()
    for j in range(1, n):
        g *= _STEP
        g += hashed[j : j + count]
    last = np.repeat(rows[1:], np.diff(rows))[:count]
    at = np.flatnonzero(np.arange(count) + n <= last)
    return mix(g[at]), at


def ngram_sets(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of n-gram hashes of each row, sorted, as (values, row offsets). A row of 1 to n-1 tokens has one shingle."""
    g, at = ngrams(t.hash, t.rows, n)
    row = np.searchsorted(t.rows, at, side="right") - 1
    counts = t.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(n - 1):
            has = counts[short] > j
            extra[has] = extra[has] * _STEP + t.hash[t.rows[short[has]] + j]
        g, row = np.concatenate([g, mix(extra + np.uint64(1))]), np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        keep = np.ones(len(g), dtype=bool)
        keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[keep], row[keep]
    return g, np.searchsorted(row, np.arange(len(counts) + 1))
