"""A static binary-fuse filter: about 18 bits a key, no false negative, a false positive in 65,536 other keys.

Each key has three places in neighbouring segments of one array; its 16-bit
fingerprint is the xor of what stands there. The array is filled by peeling: a
place that a single key has is that key's own, the key is taken away, and so
on; then the keys are written in the opposite order. Keys that own a place in
the same round don't touch one another's places, so a round is one numpy call.
"""

from __future__ import annotations

import math
import struct

import numpy as np

HEAD = struct.Struct("<QIII")
ATTEMPTS = 100


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts over the seeded keys."""
    h = keys + np.uint64(seed)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, span: int) -> np.ndarray:
    """The three places of each hash: (3, n)."""
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def _peeled(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the place each owns), or None where some keys hold one another."""
    n = places.shape[1]
    count = np.bincount(places.ravel(), minlength=size)
    who = np.zeros(size, dtype=np.int64)
    for row in places:
        np.bitwise_xor.at(who, row, np.arange(n))
    rounds, left = [], n
    alone = np.flatnonzero(count == 1)
    while len(alone):
        keys, at = np.unique(who[alone], return_index=True)
        rounds.append((keys, alone[at]))
        left -= len(keys)
        touched = places[:, keys]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(who, row, keys)
        near = np.unique(touched)
        alone = near[count[near] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> bytes:
    """The filter of some 64-bit keys, as bytes; the same keys give the same bytes. No keys: empty bytes."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    if not len(keys):
        return b""
    n = max(2, len(keys))
    segment = min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
    capacity = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    segments = max(1, -(-capacity // segment) - 2)
    span, size = segments * segment, (segments + 2) * segment
    for attempt in range(ATTEMPTS):
        seed = (attempt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        h = _mixed(keys, seed)
        places = _places(h, segment, span)
        rounds = _peeled(places, size)
        if rounds is None:
            continue
        prints, table = _prints(h), np.zeros(size, dtype=np.uint16)
        for owned, place in reversed(rounds):
            a, b, c = places[:, owned]
            table[place] = prints[owned] ^ table[a] ^ table[b] ^ table[c]
        return HEAD.pack(seed, segment, span, len(keys)) + table.tobytes()
    raise RuntimeError(f"no seed of {ATTEMPTS} gives a filter of {len(keys)} keys")


def may_contain(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter may hold it; true for all keys that it was built of."""
    keys = np.asarray(keys).astype(np.uint64)
    if not filter_bytes:
        return np.zeros(len(keys), dtype=bool)
    seed, segment, span, _ = HEAD.unpack_from(filter_bytes)
    table = np.frombuffer(filter_bytes, dtype=np.uint16, offset=HEAD.size)
    h = _mixed(keys, seed)
    a, b, c = _places(h, segment, span)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)
