"""Seeded choices that any engine can repeat: all randomness is the MD5 of a seed and an id."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def digest(seed: str | Column, *ids: Column) -> Column:
    """Hex MD5 of seed:id:id..."""
    head = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.concat_ws(":", head, *[i.cast("string") for i in ids]).cast("binary"))


def uniform_int(seed: str | Column, *ids: Column) -> Column:
    """Whole number in 0..2^32-1."""
    return F.conv(F.substring(digest(seed, *ids), 1, 8), 16, 10).cast("long")


def uniform(seed: str | Column, *ids: Column) -> Column:
    """Number in [0, 1)."""
    return uniform_int(seed, *ids) / F.lit(float(RANGE))


def pick(n: int | Column, seed: str | Column, *ids: Column) -> Column:
    """Whole number in 0..n-1."""
    return F.pmod(uniform_int(seed, *ids), F.lit(n) if isinstance(n, int) else n)


SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
SINES = [int(abs(np.sin(i + 1.0)) * RANGE) for i in range(64)]
STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(words: np.ndarray) -> np.ndarray:
    """(4, n) words of the MD5 of messages of one block, (16, n)."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in STARTS)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[at]
        f += np.uint32(SINES[i])
        shift = SHIFTS[turn, i % 4]
        np.right_shift(f, np.uint32(32 - shift), out=t)
        f <<= np.uint32(shift)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), STARTS, strict=True)])


def digest_numbers(seed: str, ids: np.ndarray, width: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of ``digest`` of each id as whole numbers: in the order of both are the digests."""
    head, out = f"{seed}:".encode(), np.empty((len(ids), 2), ">u8")
    for first in range(0, len(ids), width):
        own = ids[first : first + width]
        if len(head) + 19 > 55 or own.min() < 0:  # more than a block, or a sign
            found = b"".join(hashlib.md5(head + str(x).encode(), usedforsecurity=False).digest() for x in own.tolist())
            out[first : first + width] = np.frombuffer(found, ">u8").reshape(-1, 2)
            continue
        lengths = np.searchsorted(10 ** np.arange(1, 19), own, "right") + 1
        for digits in np.unique(lengths):
            mine = np.flatnonzero(lengths == digits)
            message = np.zeros((len(mine), 64), np.uint8)
            message[:, : len(head)] = np.frombuffer(head, np.uint8)
            left = own[mine]
            for k in range(digits - 1, -1, -1):
                rest = left // 10
                message[:, len(head) + k] = left - rest * 10 + ord("0")
                left = rest
            message[:, len(head) + digits] = 0x80
            message[:, 56:] = np.frombuffer((8 * (len(head) + int(digits))).to_bytes(8, "little"), np.uint8)
            words = _md5_block(np.ascontiguousarray(message.view("<u4").T))
            out[first + mine] = np.ascontiguousarray(words.T).astype("<u4").view(">u8")
    return out[:, 0].astype(np.uint64), out[:, 1].astype(np.uint64)
