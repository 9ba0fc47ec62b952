"""SHA-256 of many short texts at once, for tasks: numpy works on all texts word by word.

Only the first 60 bits are made, as `hashing.u60` has them.  Words that all texts share stay Python ints, so the rounds before the
first differing word cost nothing.  Texts of more than 55 bytes, and few at once, go through hashlib.
"""

from __future__ import annotations

import numpy as np

try:
    from _sha2 import sha256 as _sha256  # CPython's own costs less a call than OpenSSL's
except ImportError:
    from hashlib import sha256 as _sha256

#: Texts hashed at once (they stay in the cache), and texts below which hashlib is faster.
BATCH, FEW = 25_000, 5000
#: Bytes of a text that fit one block.
BLOCK = 55
_MASK = 0xFFFFFFFF


def _roots(power: int, count: int) -> list[int]:
    """First 32 bits of the fractions of the square (2) or cube (3) roots of the first primes."""
    out, p = [], 2
    while len(out) < count:
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            low, high, n = 0, p << 32, p << (32 * power)
            while low < high:  # integer root
                mid = (low + high + 1) // 2
                low, high = (mid, high) if mid**power <= n else (low, mid - 1)
            out.append(low & _MASK)
        p += 1
    return out


_START, _ROUND = _roots(2, 8), _roots(3, 64)
_BY = [np.array(i, np.uint32) for i in range(32)]
_and, _xor, _add, _right, _left = np.bitwise_and, np.bitwise_xor, np.add, np.right_shift, np.left_shift


def _turned(x: int, n: int) -> int:
    return ((x >> n) | (x << (32 - n))) & _MASK


def _turn(x: np.ndarray, n: int, out: np.ndarray, t: np.ndarray) -> None:
    """out = x turned right by n bits; x may be `out`, never `t`."""
    _right(x, _BY[n], t)
    _left(x, _BY[32 - n], out)
    _xor(out, t, out)


def _large(x: np.ndarray, a: int, b: int, c: int, out: np.ndarray, t: np.ndarray) -> None:
    """out = x turned by a ^ by b ^ by c (rising)."""
    _turn(x, c - b, out, t)
    _xor(out, x, out)
    _turn(out, b - a, out, t)
    _xor(out, x, out)
    _turn(out, a, out, t)


def _small(x: np.ndarray, a: int, b: int, c: int, out: np.ndarray, t: np.ndarray) -> None:
    """out = x turned by a ^ by b ^ shifted by c (a < b)."""
    _turn(x, b - a, out, t)
    _xor(out, x, out)
    _turn(out, a, out, t)
    _right(x, _BY[c], t)
    _xor(out, t, out)


def _extended(w: list, r: int, out: np.ndarray, t: np.ndarray) -> None:
    """Word r of the schedule in place of word r - 16."""
    at, terms = r % 16, [w[r % 16], w[(r - 7) % 16]]
    x, y = w[(r - 15) % 16], w[(r - 2) % 16]
    fixed = sum(v for v in terms if isinstance(v, int))
    if isinstance(x, int):
        fixed += _turned(x, 7) ^ _turned(x, 18) ^ (x >> 3)
    if isinstance(y, int):
        fixed += _turned(y, 17) ^ _turned(y, 19) ^ (y >> 10)
    fixed &= _MASK
    if all(isinstance(v, int) for v in (*terms, x, y)):
        w[at] = fixed
        return
    if isinstance(w[at], int):
        w[at] = np.full(len(out), fixed, np.uint32)
    elif fixed:
        _add(w[at], np.array(fixed, np.uint32), w[at])
    word = w[at]
    if not isinstance(terms[1], int):
        _add(word, terms[1], word)
    if not isinstance(x, int):
        _small(x, 7, 18, 3, out, t)
        _add(word, out, word)
    if not isinstance(y, int):
        _small(y, 17, 19, 10, out, t)
        _add(word, out, word)


def _first60(w: list, n: int) -> np.ndarray:
    """First 60 bits of the digests of n blocks; w: 16 words, an int where all blocks agree, else an array that is used up."""
    a, b, c, d, e, f, g, h = _START
    first = next((r for r in range(16) if not isinstance(w[r], int)), 16)
    for r in range(first):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[r] + w[r]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = (one + two) & _MASK, a, b, c, (d + one) & _MASK, e, f, g
    a, b, c, d, e, f, g, h = (np.full(n, x, np.uint32) for x in (a, b, c, d, e, f, g, h))
    s, t, ab, bc = np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, np.uint32), _xor(b, c)
    for r in range(first, 64):
        if r >= 16:
            _extended(w, r, s, t)
        word = w[r % 16]
        if isinstance(word, int):
            _add(h, np.array((word + _ROUND[r]) & _MASK, np.uint32), h)
        else:
            _add(h, word, h)
            _add(h, np.array(_ROUND[r], np.uint32), h)
        _large(e, 6, 11, 25, s, t)
        _add(h, s, h)
        _xor(f, g, s)
        _and(s, e, s)
        _xor(s, g, s)
        _add(h, s, h)
        _add(d, h, d)
        _xor(a, b, ab)  # the majority of a, b, c is b ^ ((a ^ b) & (b ^ c))
        _and(ab, bc, bc)
        _xor(bc, b, bc)
        _add(h, bc, h)
        _large(a, 2, 13, 22, s, t)
        _add(h, s, h)
        ab, bc = bc, ab
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    high = _add(a, np.array(_START[0], np.uint32)).astype(np.uint64) << np.uint64(28)
    return (high | (_add(b, np.array(_START[1], np.uint32)) >> _BY[4])).astype(np.int64)


def _block(text: list, n: int) -> np.ndarray:
    """First 60 bits for n texts of one length: each byte an int where they agree, else an array."""
    text = [*text, 0x80, *[0] * (BLOCK - len(text)), *(8 * len(text)).to_bytes(8, "big")]
    w = []
    for at in range(0, 64, 4):
        fixed = sum(v << 8 * (3 - i) for i, v in enumerate(text[at:at + 4]) if isinstance(v, int))
        word = fixed
        for i, v in enumerate(text[at:at + 4]):
            if not isinstance(v, int):
                word = word + (v.astype(np.uint32) << _BY[8 * (3 - i)]) if not isinstance(word, int) else (v.astype(np.uint32) << _BY[8 * (3 - i)]) + np.array(fixed, np.uint32)
        w.append(word)
    return _first60(w, n)


def _plain(texts: list[bytes]) -> np.ndarray:
    """First 60 bits of SHA-256 of each text, one by one."""
    sha = _sha256
    return (np.frombuffer(b"".join([sha(x).digest() for x in texts]), ">u8")[::4] >> np.uint64(4)).astype(np.int64)


def numbered(head: bytes, first: int, last: int, tail: bytes = b"") -> np.ndarray:
    """First 60 bits of SHA-256(head + i + tail) for the whole numbers i from `first` (0 or more) to last - 1, in decimal."""
    out, at = np.empty(max(last - first, 0), np.int64), first
    while at < last:
        digits = len(str(at))
        to = min(last, 10**digits, (at // BATCH + 1) * BATCH)
        if to - at < FEW or len(head) + digits + len(tail) > BLOCK:
            out[at - first:to - first] = _plain([b"%b%d%b" % (head, i, tail) for i in range(at, to)])
        else:
            low, high = str(at).encode(), str(to - 1).encode()
            same = next((j for j in range(digits) if low[j] != high[j]), digits)
            rest, places = np.arange(at, to, dtype=np.int64) - int(low[:same].ljust(digits, b"0")) if same else np.arange(at, to, dtype=np.int64), []
            rest = rest.astype(np.uint32)
            for _ in range(digits - same):
                up = rest // np.uint32(10)
                places.append(rest - up * np.uint32(10) + np.uint32(48))
                rest = up
            out[at - first:to - first] = _block([*head, *low[:same], *places[::-1], *tail], to - at)
        at = to
    return out


class Keys:
    """Texts to be hashed behind several heads; equal lengths are kept together."""

    def __init__(self, keys: list[bytes]):
        self.keys, length = keys, np.array([len(k) for k in keys], np.int64)
        self.parts = []
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            for i in range(0, len(at), BATCH):
                own = at[i:i + BATCH]
                self.parts.append((own, np.frombuffer(b"".join([keys[j] for j in own]), np.uint8).reshape(len(own), n)))

    def first60(self, head: bytes) -> np.ndarray:
        """First 60 bits of SHA-256(head + key) of each key."""
        out = np.empty(len(self.keys), np.int64)
        for at, text in self.parts:
            if len(at) < FEW or len(head) + text.shape[1] > BLOCK:
                out[at] = _plain([head + self.keys[j] for j in at])
            else:
                out[at] = _block([*head, *text.T], len(at))
        return out
