"""Words, lines and their 64-bit hashes for whole batches of texts at once, in numpy."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: True for the bytes 9 to 13 and 32, which part words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII capitals to small letters; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Words of more bytes are hashed one by one.
CHUNKED = 64


@functools.cache
def byte_codes() -> np.ndarray:
    """A fixed random 64-bit code of each byte."""
    return np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (self._series(b, size) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.full(n, base & _MASK, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def rolling_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` values, len(values) - size + 1 of them: equal for equal runs.

    Made for steering: texts can be contrived whose different runs have equal numbers, so no result may depend on them.
    """
    if len(values) < size:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(values) - size + 1])


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` codes; each code is mixed into what the codes before it gave."""
    n = max(len(codes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size if n else 0):
        out = mix(out + codes[k : n + k] + np.uint64(k + 1))
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin: first[t] to first[t + 1]."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each word: eight bytes at a time are mixed into what the bytes before them gave."""
    out = mix((ends - starts).astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    live = np.flatnonzero((ends > starts) & (ends - starts <= CHUNKED))
    at = starts[live]
    while len(live):
        left = ends[live] - at
        chunk = eight[at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] ^ chunk) + np.uint64(BASE)
        going = left > 8
        live, at = live[going], at[going] + 8
    for k in np.flatnonzero(ends - starts > CHUNKED).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def content_hashes(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """xxh3 of raw[start:end] for each span, however long."""
    view = memoryview(raw)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:z]) for a, z in zip(starts, ends, strict=True)), np.uint64, len(starts))
