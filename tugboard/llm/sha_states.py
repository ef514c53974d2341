"""SHA-256 over many messages at once, with the state after every 64 bytes in the open.

A digest as hex text is 64 bytes, one block of SHA-256. So a parent that hashes its children's digests
has, before each child, a state of eight words and nothing half read: it can be kept in 32 bytes, sent
to another task and resumed there, which the objects of the standard library do not allow.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle - 1)
    return low


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
# The first 32 bits behind the point, of the primes' cube and square roots.
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES], np.uint32)
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def start(n: int) -> np.ndarray:
    """The states of ``n`` messages of which nothing is read yet, one in each column."""
    return np.repeat(START[:, None], n, axis=1)


def resume(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states after one more block each: states (8, n), blocks (16, n) or (16, 1), big-endian words."""
    w = list(blocks)
    a, b, c, d, e, f, g, h = states
    with np.errstate(over="ignore"):
        for t in range(64):
            if t >= 16:
                early, late = w[(t - 15) % 16], w[(t - 2) % 16]
                w[t % 16] = (
                    w[t % 16] + w[(t - 7) % 16]
                    + (_turn(early, 7) ^ _turn(early, 18) ^ (early >> np.uint32(3)))
                    + (_turn(late, 17) ^ _turn(late, 19) ^ (late >> np.uint32(10)))
                )
            first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t % 16]
            second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
            a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
        return np.stack([a, b, c, d, e, f, g, h]) + states


def finish(states: np.ndarray, blocks_read: np.ndarray) -> np.ndarray:
    """The digests, (n, 32) bytes, of messages that end here after so many whole blocks."""
    last = np.zeros((16, states.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[15] = np.asarray(blocks_read, np.uint32) * np.uint32(512)
    ended = resume(states, last)
    return np.ascontiguousarray(ended.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def hex_text(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as (n, 64) bytes of lowercase hex."""
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return text


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as the n blocks (16, n) that their hex texts are."""
    return np.ascontiguousarray(hex_text(digests).view(">u4").astype(np.uint32).T)
