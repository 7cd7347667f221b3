"""Whole columns of text as flat UTF-8 bytes: words, lines and their 64-bit hashes without a Python loop.

The white space of all word contracts here is ASCII (space and 0x09 to 0x0D), so that bytes suffice.
Nulls count as empty texts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
PIECE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20_240_117)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E6D_62D0_6F6A_9A9B)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: What the last tasks of a worker left for the next of their kind, by owner; the first task of another kind drops it.
KEPT: dict[str, object] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2 to the 64."""
    if len(_powers.get("up", ())) <= n:
        m = max(n, 2 * PIECE) + 1
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58_476D_1CE4_E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D0_49BB_1331_11EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets."""
    KEPT.clear()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about PIECE bytes: first and end index, bytes, offsets."""
    buf, offs = flat(texts)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE, "right")) - 1)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def parts(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Like pieces(), with the index of each text; but a text longer than PIECE comes in several parts of about PIECE bytes,
    each cut behind a byte that is not inside, so that no run of inside bytes (a table by byte) is ever cut."""
    for at, end, buf, offs in pieces(texts):
        if len(buf) <= PIECE:
            yield np.arange(at, end), buf, offs
            continue
        start = 0
        while start < len(buf):
            stop, looked = min(len(buf), start + PIECE), start
            while stop < len(buf):
                outside = np.flatnonzero(~inside[buf[looked:stop]])
                if len(outside):
                    stop = looked + int(outside[-1]) + 1
                    break
                looked, stop = stop, min(len(buf), stop + PIECE)
            yield np.array([at]), buf[start:stop], np.array([0, stop - start])
            start = stop


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at the offsets."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offs[offs <= len(inside)]] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words; for each text, and after the last, the index of its first word."""
    start, end = runs(~SPACE[buf], offs)
    return start, end, np.searchsorted(start, offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines; for each text, and after the last, the index of its first line."""
    cut = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate((offs[:-1], cut + 1)), kind="stable")
    end = np.sort(np.concatenate((cut, offs[1:])), kind="stable")
    # text i begins after i texts' own first lines and all breaks before it
    return start, end, np.arange(len(offs)) + np.searchsorted(cut, offs)


class Hasher:
    """64-bit hashes of any byte ranges of buf, each in constant time."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE[buf] * up[: len(buf)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8_FEB8_6659_FD93))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each `width` consecutive hashes (in order); len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, q = np.zeros(n, np.uint64), np.uint64(0xC2B2_AE3D_27D4_EB4F)
    for j in range(width):
        out = out * q + h[j : j + n]
    return mixed(out + np.uint64(width))


def count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text."""
    out = [np.diff(words(buf, offs)[2]) for _, _, buf, offs in pieces(texts)]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
