"""SimHash fingerprints of whole texts with numpy (helpers that run inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
_SLICE = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every `width`-word shingle, repeats included; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: str | None, width: int) -> int:
    """64 bits, as a signed integer: bit b is 1 if more than half of the shingle hashes have it; 0 without words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])
