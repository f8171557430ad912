"""Hashes of words and of runs of words, a whole text at a time in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: A text is hashed in blocks of about so many bytes, cut at white space. No sum over
#: a block may reach 2^64: its bytes, at most 256 times 2^32 each, stay below 2^61.
BLOCK = 1 << 20

#: Words are polynomials over the integers modulo this prime, at a random point. Two
#: different words of n bytes meet with a probability of n / 2^61; modulo 2^64 there
#: would be words that meet at every point.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = int(np.random.Generator(np.random.PCG64(20_240_501)).integers(1 << 60, PRIME))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # ASCII white space


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, in halves of 31 and 30 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1  # times 2^31; 2^61 is 1 and 2^62 is 2
    middle = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _reduced(_reduced(a1 * b1 * np.uint64(2) + middle) + _reduced(a0 * b0))


_known: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Upper and lower bits of ``n`` or more powers of the base, and those of its inverse."""
    if not _known or len(_known[0]) < n:
        found = []
        for base in (_BASE, pow(_BASE, -1, PRIME)):
            power = np.ones(1, np.uint64)
            while len(power) < max(n, 1 << 16):  # the powers so far times the next one
                power = np.concatenate([power, times(power, np.uint64(pow(base, len(power), PRIME)))])
            found.append(power)
        _known[:] = found[0] >> np.uint64(32), found[0] & np.uint64(0xFFFFFFFF), found[1]
    return _known


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each hash over all 64 bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every run of bytes without ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        if ends[first] - base > BLOCK:  # a longer word would need longer tables
            digest = hashlib.blake2b(raw[base : ends[first]], digest_size=8).digest()
            hashes[first] = int.from_bytes(digest, "little")
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = int(ends[last - 1] - base)
        high, low, inverse = _powers(n)
        values = data[base : base + n].astype(np.uint64) + np.uint64(1)
        s, e = starts[first:last] - base, ends[first:last] - base

        def sums(power, values=values, n=n, s=s, e=e):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values * power[:n], out=total[1:])
            return _reduced(total[e] - total[s])

        upper = sums(high)  # times 2^32, which turns the 61 bits around
        upper = ((upper << np.uint64(32)) & _P) | (upper >> np.uint64(29))
        hashes[first:last] = mix(times(_reduced(upper + sums(low)), inverse[s]))
        first = last
    return starts, ends, hashes


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total = total * _STEP + hashes[j : j + n]
    return mix(total)
