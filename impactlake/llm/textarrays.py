"""Texts of a batch as flat numpy arrays: code points, words and their hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64, slices

_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that a worker handles at a time; a longer text stands alone.
BATCH_BYTES = 500_000


def parts(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES):
    """Consecutive pieces of an Arrow batch with their texts (null stays None), each of about `most` bytes."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for s in slices(sizes, most):
        yield batch.slice(s.start, s.stop - s.start), texts.slice(s.start, s.stop - s.start).to_pylist()


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text begins (one more entry ends the last)."""
    joined = "\n".join(texts) + "\n" if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))]).astype(np.int64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, int(n).bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def forget_powers() -> None:
    """Drops the table of the longest text seen."""
    _powers.cache_clear()


class Words:
    """Words of a batch of texts: start, end (positions in codes), doc (index of the text), hash."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edge = np.diff(space.astype(np.int8), prepend=1, append=1)
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * up[:-1], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.space = space
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one text, and the index of each one's first word."""
        if len(self.start) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        last = len(self.start) - n + 1
        first = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        out = self.hash[first].copy()
        for k in range(1, n):
            out = mix64(out * np.uint64(0xFF51AFD7ED558CCD) + self.hash[first + k])
        return out, first


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For code points below 65,536: lower-case code or 0 for what is no letter; upper case; digit; letter."""
    low, upper, digit = np.zeros(65536, np.uint32), np.zeros(65536, bool), np.zeros(65536, bool)
    for c in range(65536):
        s = chr(c)
        if s.isalpha():
            one = s.lower()
            low[c] = ord(one) if len(one) == 1 else c
            upper[c] = s.isupper()
        digit[c] = s.isdigit()
    return low, upper, digit, low > 0


def lowered(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters; 0 for all else."""
    low = letters()[0]
    far = codes > 65535
    out = low[np.where(far, 0, codes)]
    if far.any():
        kinds = np.unique(codes[far])
        own = np.array([c if chr(c).isalpha() else 0 for c in kinds.tolist()], np.uint32)
        out[far] = own[np.searchsorted(kinds, codes[far])]
    return out
