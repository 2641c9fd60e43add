"""SetSketch registers of shingle sets: exponentially spaced, truncated minima.

Register j of a set is ``floor(1 - log_b(x_j))`` cut to 0 .. q + 1, where x_j is the
smallest of the set's exponential random numbers of rate a for that register. The sketch of a
union is the larger of the registers, and two registers agree about as often as the sets' elements do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .texts import NOT_SPACE, hashes, mix, words

BASE, RATE, TOP = 1.001, 20.0, 65533
#: Bands of rows; sets of similarity 0.85 share a band but for one pair in a million.
BANDS, ROWS = 30, 6
M = BANDS * ROWS
WIDTH = 5

_draw = np.random.Generator(np.random.PCG64(20240607))
SALT = _draw.integers(0, 1 << 64, M, np.uint64, endpoint=False)
ODD = _draw.integers(0, 1 << 63, M, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): each text's distinct five-word shingles; with fewer words, all of them as one; without words, none."""
    got = words(column, NOT_SPACE)
    codes, distinct = got.coded()
    count = np.diff(got.first)
    if not len(codes):
        return np.zeros(len(count) + 1, np.int64), np.zeros(0, np.uint64)
    w = mix(hashes(distinct))[codes]
    text = np.repeat(np.arange(len(count), dtype=np.int64), count)
    with np.errstate(over="ignore"):
        n = max(0, len(w) - WIDTH + 1)
        h = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    start = np.arange(n)
    whole = start + WIDTH <= got.first[1:][text[:n]]
    h, at = mix(h[whole]), text[:n][whole]
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        own = []
        for i in short:
            x = np.uint64(count[i])
            with np.errstate(over="ignore"):
                for v in w[got.first[i] : got.first[i + 1]]:
                    x = (x ^ v) * np.uint64(0xC2B2AE3D27D4EB4F)
                    x ^= x >> np.uint64(31)
            own.append(x)
        h, at = np.concatenate([h, mix(np.array(own, np.uint64))]), np.concatenate([at, short])
    order = np.argsort(h)
    order = order[np.argsort(at[order].astype(np.uint16 if len(count) < 65536 else np.int64), kind="stable")]
    h, at = h[order], at[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[fresh], at[fresh]
    return np.searchsorted(at, np.arange(len(count) + 1)), h


def registers(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A row of M registers per text (uint16); texts without shingles have zeros."""
    out = np.zeros((len(first) - 1, M), np.uint16)
    some = first[1:] > first[:-1]
    if not some.any():
        return out
    starts = first[:-1][some]
    low = np.empty((len(starts), M), np.float64)
    with np.errstate(over="ignore"):
        for j in range(M):
            low[:, j] = np.minimum.reduceat(((h ^ SALT[j]) * ODD[j]) >> np.uint64(32), starts)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    out[some] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of registers."""
    r = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), r.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix((key ^ r[:, :, k]) * np.uint64(0x9E3779B97F4A7C15))
    return key


GRID = np.linspace(0.5, 1.0, 51)


def estimated(less: np.ndarray, more: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity, on a grid from 0.5, given how many registers are below and above and both sizes.

    The chances of a register being below, above or equal follow from the similarity and the
    relative sizes; the joint likelihood of the three counts is maximised, up to the largest similarity that
    the sizes allow.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * GRID), p(v - u * GRID)
    equal = np.clip(1 - up - down, 1e-9, 1)
    log = lambda x: np.log(np.maximum(x, 1e-9))
    score = more[:, None] * log(up) + less[:, None] * log(down) + (M - less - more)[:, None] * log(equal)
    return np.minimum(GRID[np.argmax(score, axis=1)], np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
