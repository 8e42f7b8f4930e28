"""HyperMinHash registers: leading-zero count and mantissa bits of the minimum in each bucket.

A set of 64-bit hashes is split by the top bits into ``BUCKETS`` buckets; each
register keeps, for the bucket's minimum, the number of leading zeros of the
remaining bits and the ``MANTISSA`` bits after the leading one (Yu and Weber,
"HyperMinHash: MinHash in LogLog space").  0 marks an empty bucket.
"""

from __future__ import annotations

import numpy as np

from weirflow.llm.shingles import U, mix

BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
ROWS = 4
BANDS = BUCKETS // ROWS
#: Sets of at most SMALL shingles are found by their exact prefix, sets of at least LARGE by bands; both hold in between.
#: A set of LARGE - 1 links only with sets of up to (LARGE - 1) * 4 / 3 <= SMALL, so every possible pair shares one way.
SMALL, LARGE = 32, 25
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=U))


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers of a sorted array of distinct hashes."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = (hashes >> U(64 - BUCKET_BITS)).astype(np.intp)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rest = hashes[first] << U(BUCKET_BITS)
        zeros = np.minimum(53 - np.frexp((rest >> U(11)).astype(np.float64))[1], 53)
        mantissa = ((rest << (zeros + 1).astype(U)) >> U(64 - MANTISSA)).astype(np.int64)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa
    return out


def band_keys(regs: np.ndarray, hashes: np.ndarray, share: float) -> np.ndarray:
    """Keys of which any two sets with a Jaccard similarity of ``share`` have one in common.

    Large sets: one key for each band of ROWS registers that is not wholly empty.  Small sets: the
    first n - ceil(share * n) + 1 hashes, of which two similar sets have one in common for certain.
    """
    n, keys = len(hashes), []
    if n >= LARGE:
        packed = regs.view(U) if regs.flags.c_contiguous else np.ascontiguousarray(regs).view(U)
        keys.append(mix(packed ^ _BAND_SALT)[packed != 0])
    if 0 < n <= SMALL:
        keys.append(mix(hashes[: n - int(np.ceil(share * n - 1e-9)) + 1] ^ U(0x5851F42D4C957F2D)))
    return np.concatenate(keys) if keys else np.empty(0, U)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two sets of sizes n and m expected to agree by chance, not by a common minimum.

    Chance agreement needs equal leading zeros and then equal mantissas, which are close to uniform.
    """
    level = 2.0 ** -np.arange(1, 55)

    def at(size):
        load = (np.asarray(size, float) / BUCKETS)[:, None]
        return np.exp(-load * level) - np.exp(-load * 2 * level)

    return BUCKETS * 2.0**-MANTISSA * (at(n) * at(m)).sum(1)


def jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray):
    """Collision-corrected similarity of rows of registers, and its standard error at ``share``'s worst case."""
    same = ((a == b) & (a != 0)).sum(1)
    used = np.maximum(((a | b) != 0).sum(1), 1)
    chance = np.minimum(expected_collisions(n, m), used - 0.5)
    return np.clip((same - chance) / (used - chance), 0, 1), np.sqrt(0.25 / used)
