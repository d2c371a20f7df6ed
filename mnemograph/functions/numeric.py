"""Numbers and vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rounded(x: Column, digits: int) -> Column:
    """x to some places as engines round that scale a double first: what decides is the scaled double, not x's shortest decimal form."""
    return F.round(x * 10.0**digits) / 10.0**digits


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; a vector of no length stays."""
    n = norm(v)
    return F.when(n < 1e-9, doubles(v)).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length or is null."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-9) | (nb < 1e-9), F.lit(0.0)).otherwise(F.coalesce(dot(a, b) / (na * nb), F.lit(0.0)))


def age_days(at: Column, now: Column) -> Column:
    """Days from ``at`` to ``now``, never negative."""
    return F.greatest((F.unix_micros(now) - F.unix_micros(at)) / 86_400e6, F.lit(0.0))


def recency(at: Column, now: Column, days: float = 30.0) -> Column:
    """1 at ``now`` down to 0 after ``days``; 0.5 for an unknown time."""
    return F.coalesce(clip(1.0 - (F.unix_micros(now) - F.unix_micros(at)) / (86_400e6 * days)), F.lit(0.5))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -30.0, 30.0)))


# The start, additions and turns of MD5 (RFC 1321).
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_ADD = tuple(int(abs(math.sin(i + 1)) * 2**32) for i in range(64))
MD5_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def md5_heads(prefix: str, start: int, stop: int) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of prefix and each number from start up to stop, all worked out side by side.

    prefix is ASCII, and with a number at most 55 bytes long, so that a text is one block.
    """
    out = np.empty(stop - start, np.uint32)
    at = start
    while at < stop:
        # numbers of equal length, so that their digits stand in the same places
        digits = len(str(at))
        end = min(stop, 10**digits)
        number, text = np.arange(at, end, dtype=np.int64), [*prefix.encode("ascii")]
        text += [(number // 10**k % 10 + 48).astype(np.uint32) for k in reversed(range(digits))] + [128]
        if len(text) > 56:
            raise ValueError("the text is longer than one block")
        text += [0] * (56 - len(text)) + [*(8 * (len(prefix) + digits)).to_bytes(8, "little")]
        words = [sum((np.uint32(x) << np.uint32(8 * j) for j, x in enumerate(text[4 * i : 4 * i + 4])), np.uint32(0)) for i in range(16)]
        with np.errstate(over="ignore"):
            a, b, c, d = first = [np.full(len(number), x, np.uint32) for x in MD5_START]
            for i in range(64):
                turn = i // 16
                f = _md5_mix(turn, b, c, d)
                f += a
                f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16] + np.uint32(MD5_ADD[i])
                by = MD5_TURN[turn][i % 4]
                high = f << np.uint32(by)
                f >>= np.uint32(32 - by)
                f |= high
                f += b
                a, b, c, d = d, f, b, c
            out[at - start : end - start] = (a + first[0]).byteswap()
        at = end
    return out


def _md5_mix(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)
