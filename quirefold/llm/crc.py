"""CRC-32 of many words and of their joins at once.

The checksum of joined parts follows from those of the parts: that of the first is carried over as many zero
bytes as the second has, which is linear, and added to that of the second.
"""

import zlib

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value of the common CRC-32
#: Longer words go through zlib one by one.
LONG = 64
#: Lengths with a table of their own; longer carries are put together from powers of two.
SHORT = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


STEP = _byte_table()


def _through(carry: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by its values for each of the four bytes, of all x."""
    return carry[0][x & 255] ^ carry[1][(x >> 8) & 255] ^ carry[2][(x >> 16) & 255] ^ carry[3][x >> 24]


def _carries() -> tuple[np.ndarray, list[np.ndarray]]:
    none = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    each = [none]
    for _ in range(SHORT):
        each.append(STEP[each[-1] & 255] ^ (each[-1] >> 8))
    powers = [each[SHORT]]
    for _ in range(32):
        powers.append(_through(powers[-1], powers[-1]))
    return np.stack(each[:SHORT]).ravel(), powers


CARRY, POWERS = _carries()


def carried(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums over n more zero bytes each."""
    at = (n & (SHORT - 1)) << 10
    out = CARRY[at + (crc & 255)] ^ CARRY[at + 256 + ((crc >> 8) & 255)] ^ CARRY[at + 512 + ((crc >> 16) & 255)] ^ CARRY[at + 768 + (crc >> 24)]
    high, k = n // SHORT, 0
    while high.any():
        own = high & 1 == 1
        out[own] = _through(POWERS[k], out[own])
        high, k = high >> 1, k + 1
    return out


def of_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The checksum of each span, byte by byte for all at once."""
    size = end - start
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at, left = start.copy(), np.flatnonzero(size <= LONG)
    for k in range(LONG):
        left = left[size[left] > k]
        if not len(left):
            break
        s = state[left]
        state[left] = STEP[(s ^ data[at[left] + k]) & 255] ^ (s >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]])
    return state


BLANK = np.uint32(zlib.crc32(b" "))


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of first, a blank and second, which is so many bytes long."""
    return carried(first, size + 1) ^ carried(np.full(len(size), BLANK, np.uint32), size) ^ second
