"""Vectorised word windows of whole texts (runs inside Arrow-batched workers).

Words are ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` splits at exactly those
bytes.  Each word gets a 64-bit hash of its own (XXH3, which is no polynomial);
a window of k words is hashed by a multilinear form of its words' hashes with
fixed odd random factors, then mixed, so the cost of windows is a few numpy
passes over the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_FACTORS = np.random.default_rng(20240229).integers(1, 2**63 - 1, 64, dtype=np.uint64) * U(2) + U(1)
#: Bytes of text that a worker holds as Python objects at once (one longer text is held alone).
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def window_hashes(words: list[bytes], k: int = 5) -> np.ndarray:
    """Hash of each window of k words in order; of the whole sequence if it is shorter."""
    from xxhash import xxh3_64_digest

    n = len(words)
    if not n:
        return np.empty(0, U)
    own = np.frombuffer(b"".join(map(xxh3_64_digest, words)), U)
    k = min(k, n)
    total = own[: n - k + 1] * _FACTORS[0]
    for j in range(1, k):
        total += own[j : n - k + 1 + j] * _FACTORS[j]
    return mix(total ^ U(k))


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased."""
    h = window_hashes((text or b"").lower().split(), k)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as Python bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def slices(batches, column: int = -1, upto: int = SLICE_BYTES) -> Iterator:
    """Record batches cut so that a piece holds about ``upto`` bytes of the text in ``column``, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(column % batch.num_columns)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = (np.cumsum(size) - size) // upto
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield batch.slice(a, b - a)
