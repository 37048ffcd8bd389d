"""XXH64 of many byte spans at once (public algorithm, little endian)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# fixed values of the algorithm
P1, P2, P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
P4, P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buf[start:start+length] for every span. Spans are stepped
    through together: a step handles the next 32, 8, 4 or 1 bytes of all
    spans that still have them."""
    data = np.concatenate([buf, np.zeros(32, np.uint8)])
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    half = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    seed64 = U64(seed)
    at, left = start.astype(np.int64), length.astype(np.int64)
    h = np.full(len(at), seed64 + P5, U64)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), v, U64) for v in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            live = np.arange(len(long))
            while len(live):
                own = long[live]
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], wide[at[own] + 8 * k])
                at[own] += 32
                left[own] -= 32
                live = live[left[own] >= 32]
            out = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                out = (out ^ _round(np.zeros_like(out), acc[k])) * P1 + P4
            h[long] = out
        h += length.astype(U64)
        zero = U64(0)
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = _rotl(h[live] ^ _round(zero, wide[at[live]]), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        h[live] = _rotl(h[live] ^ (half[at[live]].astype(U64) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            h[live] = _rotl(h[live] ^ (data[at[live]].astype(U64) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        return h ^ (h >> U64(32))
