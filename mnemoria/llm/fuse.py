"""Binary fuse filters: static sets of 64-bit keys at about nine bits a key, with no false negatives."""

from __future__ import annotations

import math
import struct

import numpy as np

_U = np.uint64
_HEAD = struct.Struct("<QIII")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key + seed."""
    h = keys + _U(seed)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three slots of a hash, in three neighbouring segments."""
    first = ((h >> _U(32)) * _U(segment * segments)) >> _U(32)
    mask = _U(segment - 1)
    second = (first + _U(segment)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of ``keys`` (uint64, any order, repeats allowed).

    Slots held by one key alone are peeled off in rounds; in reverse order, each peeled key's slot is then set so that
    its three slots give its fingerprint.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 200):
        h = _mixed(keys, seed)
        slots = np.stack(_slots(h, segment, segments))
        count = np.bincount(slots.ravel(), minlength=size)
        # The sum of key numbers in a slot is the key's number once a single key is left there.
        total = np.bincount(slots.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
        left = np.ones(n, dtype=bool)
        rounds = []
        alone = np.flatnonzero(count == 1)
        while len(alone):
            found, at = np.unique(total[alone], return_index=True)
            rounds.append((found, alone[at]))
            left[found] = False
            touched = slots[:, found]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.subtract.at(total, row, found)
            alone = np.unique(touched)
            alone = alone[count[alone] == 1]
        if not left.any():
            break
    else:
        raise ArithmeticError("no filter found")
    table, prints = np.zeros(size, dtype=np.uint8), _print(h)
    for found, own in reversed(rounds):
        a, b, c = slots[:, found]
        table[own] = 0
        table[own] = prints[found] ^ table[a] ^ table[b] ^ table[c]
    return _HEAD.pack(seed, segment, segments, size) + table.tobytes()


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` may be in the filter: all that are, and about 1 in 256 of the others."""
    seed, segment, segments, _ = _HEAD.unpack_from(filter_bytes)
    table = np.frombuffer(filter_bytes, np.uint8, offset=_HEAD.size)
    h = _mixed(keys.astype(np.uint64), seed)
    a, b, c = _slots(h, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == _print(h)
