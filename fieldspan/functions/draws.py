"""md5 of many short texts at once, for resampling: the built-in md5 takes several times as long a draw."""

from __future__ import annotations

import math

import numpy as np

K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
#: Numbers are hashed in runs that differ in the last four digits alone.
RUN = 10_000
_DIGITS = sum(((np.arange(RUN, dtype=np.uint32) // 10 ** (3 - p)) % 10 + 48).astype(np.uint32) << np.uint32(8 * p) for p in range(4))


def _head(words: list, n: int) -> np.ndarray:
    """The first 32 bits of md5 of one block: 16 words, each a number or an array of n. They are final after 61 of the 64 steps."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        w = words[WORD[i]]
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(K[i])
        else:
            f += np.uint32((K[i] + w) & 0xFFFFFFFF)
        f += a
        np.left_shift(f, np.uint32(TURN[i]), out=t)
        f >>= np.uint32(32 - TURN[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(0x67452301)
    return b.byteswap()


def md5_heads(before: str, start: int, stop: int):
    """Runs (j, heads): the first 32 bits of md5(before + str(j)) as numbers, for all j from start to stop."""
    while start < stop:
        low = len(str(start)) if start < RUN else 4
        end = min(stop, 10**low if start < RUN else start - start % RUN + RUN)
        known = (before + (str(start // RUN) if start >= RUN else "")).encode()
        tail = _DIGITS[start % RUN:start % RUN + end - start] >> np.uint32(8 * (4 - low))
        size = len(known) + low
        block = known + bytes(low) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
        words = [int(x) for x in np.frombuffer(block, "<u4")]
        k, bits = len(known) // 4, 8 * (len(known) % 4)
        for at, part in ((k, tail << np.uint32(bits)), *(((k + 1, tail >> np.uint32(32 - bits)),) if bits else ())):
            words[at] = part | np.uint32(words[at])
        yield start, _head(words, end - start)
        start = end
