"""Deterministic keyed draws.

``rand(seed)`` depends on how rows fall into partitions, so a re-run on a
different cluster (or after an executor loss) would draw different numbers.
Draws here are a pure function of the row key instead: the first 32 bits of
md5 over ``concat_ws('|', key..., seed)``. The same expression is available
in DuckDB, which is what lets the oracle SQL reproduce every draw.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit range of the md5 prefix and its open-interval divisor.
TWO_POW_32 = 4294967296.0
TWO_POW_32_PLUS_1 = 4294967297.0


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def keyed_bits(*parts) -> Column:
    """Integer in [0, 2^32) from the md5 of the joined key (bigint)."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def keyed_unit_open(*parts) -> Column:
    """Draw in (0, 1]: never zero, so it can seed a responsibility."""
    return (keyed_bits(*parts) + F.lit(1)) / F.lit(TWO_POW_32_PLUS_1)


def keyed_unit_half_open(*parts) -> Column:
    """Draw in [0, 1): the split coordinate (test when below alpha)."""
    return keyed_bits(*parts) / F.lit(TWO_POW_32)


# ---------------------------------------------------------------- the same draws inside a task


# Messages hashed at a time: the arrays of a step stay in the processor's cache.
MD5_ROWS = 16384
# Longest message of one MD5 block.
MD5_BLOCK = 55
_K = [np.uint32(int(abs(np.sin(np.float64(i + 1))) * 2**32)) for i in range(64)]
_TURNS = [r for rs in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in rs * 4]


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of one-block messages, as whole numbers; ``words`` is 16 x n."""
    n = words.shape[1]
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x) for x in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, _K[i], out=f)
        np.add(f, words[g], out=f)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        np.left_shift(f, np.uint32(_TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + start[0]).byteswap()


def _key_bytes(keys) -> tuple[np.ndarray, np.ndarray, list]:
    """Keys as text: a row of bytes each (empty if it alone fills a block), their lengths, and the texts."""
    texts = [str(x).encode() for x in keys]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(lengths[lengths <= MD5_BLOCK].max(initial=1)))
    rows = np.array([x if len(x) <= MD5_BLOCK else b"" for x in texts], dtype=f"S{width}")
    return rows.view(np.uint8).reshape(len(texts), width), lengths, texts


def unit_open_draws(left, i: np.ndarray, right, j: np.ndarray, numbers: list[int], seed: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """``keyed_unit_open(left[i], right[j], number, seed)`` for whole or text keys, in runs of rows: the rows
    and their draws by number. The same bits, by one MD5 over many rows at a time."""
    (of_left, n_left, left_texts), (of_right, n_right, right_texts) = _key_bytes(left), _key_bytes(right)
    tails = [f"{z}|{seed}".encode() for z in numbers]
    longest = max(map(len, tails), default=0)
    for lo in range(0, len(i), MD5_ROWS):
        rows = slice(lo, min(lo + MD5_ROWS, len(i)))
        x, y = i[rows], j[rows]
        nx, ny = n_left[x], n_right[y]
        long = nx + ny + 2 + longest > MD5_BLOCK
        message = np.zeros((len(x), 64), dtype=np.uint8)
        message[:, : of_left.shape[1]] = of_left[x]
        at = np.where(long, 0, nx)
        flat, first = message.reshape(-1), np.arange(len(x)) * 64
        flat[first + at] = ord("|")
        for n in np.unique(at[~long]):  # the second key follows the first
            some = np.flatnonzero((at == n) & ~long)
            room = min(of_right.shape[1], 64 - int(n) - 1)
            message[some, n + 1 : n + 1 + room] = of_right[y[some], :room]
        end = np.where(long, 0, nx + ny + 1)
        flat[first + end] = ord("|")
        draws = []
        for tail in tails:
            for k, byte in enumerate(tail + b"\x80"):
                flat[first + end + 1 + k] = byte
            bits = 8 * (end + 1 + len(tail))
            message[:, 56], message[:, 57] = bits & 255, bits >> 8
            heads = _md5_heads(np.ascontiguousarray(message.view("<u4").T)).astype(np.int64)
            for k in np.flatnonzero(long):
                text = left_texts[x[k]] + b"|" + right_texts[y[k]] + b"|" + tail
                heads[k] = int.from_bytes(hashlib.md5(text).digest()[:4], "big")
            draws.append((heads + 1) / TWO_POW_32_PLUS_1)
        yield rows, draws
