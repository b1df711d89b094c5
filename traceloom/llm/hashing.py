"""Vectorised fingerprints of words and of byte or word windows.

Everything here works on one numpy buffer that holds the UTF-8 bytes of many
documents, and is a pure function of those bytes, so any task computes the same
fingerprint for the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
_M1, _M2, _M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWER: list[np.ndarray] = []
#: Bytes of a span that are mixed here; longer spans get a digest.
_LONG = 64
#: The first k bytes of eight.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: Of the second, independent fingerprints.
SECOND = 0x632BE59BD9B4E019
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The fingerprint of two sequences joined, from the fingerprints of each."""
    return mix(left * _M3 + right)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every n consecutive items: doubles the length, then adds the bits of n."""
    total = len(h) - n + 1
    if total <= 0:
        return np.empty(0, dtype=U64)
    out, at, power, length = None, 0, h, 1
    parts = []
    rest = n
    while rest:
        if rest & 1:
            parts.append((length, power))
        rest >>= 1
        if rest:
            power = chain(power[: len(power) - length], power[length:])
            length *= 2
    for length, power in reversed(parts):
        piece = power[at : at + total]
        out = mix(piece + U64(length)) if out is None else chain(out, piece)
        at += length
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, _BASE_INV):
                p = np.full(size, U64(base), dtype=U64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _POWER[:] = both
    return _POWER[0], _POWER[1]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_SPACE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate(([0], edge))
    if solid[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprints of byte spans; another seed gives independent ones.

    A span is taken eight bytes at a time, each step a bijection of what came before, so
    that no regular text makes words collide. Spans over ``_LONG`` bytes get a digest.
    """
    size = ends - starts
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = mix(size.astype(U64) * _M3 + U64(seed))
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    for k in range(0, _LONG, 8):
        live = live[size[live] > k] if k else live
        if not len(live):
            break
        block = eight[starts[live] + k] & LOW_BYTES[np.minimum(size[live] - k, 8)]
        out[live] = mix(out[live] * _M1 + block)
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = U64(int.from_bytes(digest, "little"))
    return out


def byte_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums from which ``byte_window_hashes`` takes a window at any place.

    The symbol at a place is a nonlinear mix of the eight bytes there, so that no
    regular text makes the polynomial collide.
    """
    eight = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    sums = np.zeros(len(eight) + 1, dtype=U64)
    power, _ = _powers(len(eight) + 1)
    block = 1 << 15
    for at in range(0, len(eight), block):
        to = min(at + block, len(eight))
        sums[at + 1 : to + 1] = mix(eight[at:to] ^ U64(seed)) * power[at:to]
    return np.cumsum(sums, out=sums)


def byte_window_hashes(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n bytes (8 or more) from each place in ``at``."""
    _, inverse = _powers(len(sums))
    out = np.empty(len(at), dtype=U64)
    block = 1 << 15
    for k in range(0, len(at), block):
        p = at[k : k + block]
        out[k : k + block] = mix((sums[p + (n - 7)] - sums[p]) * inverse[p] + U64(n))
    return out


#: Bytes of letters and digits; bytes of other alphabets count as letters.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = True
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True


def letter_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words of letters and digits of many texts.

    Returns fingerprints, the text of each word, and the number of words of each text;
    then starts and ends of the words in the texts joined by one space.
    """
    data = lower_ascii(np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8))
    solid = _LETTER[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    last = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(last, starts, side="right")
    return span_hashes(data, starts, ends) if len(starts) else np.empty(0, U64), owner, np.bincount(owner, minlength=len(texts)), starts, ends
