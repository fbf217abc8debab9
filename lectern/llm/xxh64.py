"""XXH64 of many byte ranges at once."""

import numpy as np
import xxhash

#: The hash function's own multipliers (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer ranges are hashed one by one.
LONG = 1024


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, word):
    return _rotl(acc + word * P2, 31) * P1


def hash_ranges(data: bytes, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """uint64 hashes of data[start:start + size]."""
    n = len(data)
    pad = data + bytes(8)
    u64 = np.ndarray((n + 1,), "<u8", pad, 0, (1,))
    u32 = np.ndarray((n + 1,), "<u4", pad, 0, (1,))
    u8 = np.frombuffer(pad, np.uint8)
    s = np.uint64(seed)
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        short = np.flatnonzero(size <= LONG)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]], seed)
        at, left = start[short].copy(), size[short].copy()
        h = np.full(len(short), s + P5, np.uint64)
        big = np.flatnonzero(left >= 32)
        if len(big):
            v = [np.full(len(big), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(big))
            while len(live):
                p = at[big[live]]
                for k in range(4):
                    v[k][live] = _round(v[k][live], u64[p + 8 * k])
                at[big[live]] += 32
                left[big[live]] -= 32
                live = live[left[big[live]] >= 32]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                x = (x ^ _round(np.zeros(len(big), np.uint64), v[k])) * P1 + P4
            h[big] = x
        h += size[short].astype(np.uint64)
        for width in (8, 8, 8, 4, 1, 1, 1):
            i = np.flatnonzero(left >= width)
            if not len(i):
                continue
            p = at[i]
            if width == 8:
                h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), u64[p]), 27) * P1 + P4
            elif width == 4:
                h[i] = _rotl(h[i] ^ u32[p].astype(np.uint64) * P1, 23) * P2 + P3
            else:
                h[i] = _rotl(h[i] ^ u8[p].astype(np.uint64) * P5, 11) * P1
            at[i] += width
            left[i] -= width
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        out[short] = h
    return out
