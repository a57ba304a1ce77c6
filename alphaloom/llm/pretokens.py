"""Splits texts into the pre-tokens of the public byte-level tokenizers, with array operations.

The rule is public_tokenizers.PATTERN: a contraction; else letters, digits or other signs, each with one leading blank;
else white space, which leaves its last character to what follows. All of it depends on the classes of neighbouring
characters only, so that the places where pre-tokens begin can be computed for all characters at once.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import regex

from alphaloom.llm.shared import Powers, mix

LETTER, DIGIT, SPACE, OTHER, END = 0, 1, 2, 3, 4
#: Characters of a pre-token from which it is hashed by blake2b.
LONG = 64
_LIMIT = 0x110000
_SEPARATOR = _LIMIT  # stands between texts; no character
_ONE, _TWO = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.full(_LIMIT + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, _LIMIT)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            skip = [0 if i < 0xD800 else 0x800 for i in (m.start(), m.end() - 1)]
            table[m.start() + skip[0] : m.end() + skip[1]] = kind
    table[_SEPARATOR] = END
    return table


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with separators, where each pre-token begins and ends, and how many each text has."""
    parts, lengths = [], np.array([len(t) for t in texts], np.int64)
    place = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=place[1:])
    codes = np.full(int(place[-1]) + 2, _SEPARATOR, np.uint32)
    parts = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.ones(int(place[-1]), bool)
    inside[place[1:] - 1] = False
    codes[: len(inside)][inside] = parts
    kind = classes()[codes]
    n = len(inside)
    start = np.ones(len(codes) + 2, bool)
    start[1 : len(codes)] = kind[1:] != kind[:-1]
    start[:n][~inside] = True
    start[1:n][~inside[: n - 1]] = True
    solid = kind <= OTHER
    solid &= kind != SPACE
    after = np.flatnonzero(solid[1:n] & start[1:n] & (kind[: n - 1] == SPACE)) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    apostrophe = np.flatnonzero((codes[:n] == 39) & start[:n])
    a, b = codes[apostrophe + 1], codes[apostrophe + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for where, size in ((apostrophe[one], 2), (apostrophe[two], 3)):
        start[where + 1] = False
        start[where + size] = True
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n) if len(begin) else begin
    real = kind[begin] != END
    begin, end = begin[real], end[real]
    return codes, begin, end, np.diff(np.searchsorted(begin, place))


def keys(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each pre-token.

    Sums of powers modulo 2**64, which some patterns of over a thousand letters share by construction: longer pre-tokens
    are hashed by blake2b.
    """
    out = []
    for powers, seed in ((_ONE, 0x51ED270B), (_TWO, 0x2545F491)):
        up, down = powers(len(codes) + 1)
        values = mix(codes.astype(np.uint64) + np.uint64(seed << 24))
        c = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values * up[: len(codes)], out=c[1:])
        out.append(mix((c[end] - c[begin]) * down[begin] + (end - begin).astype(np.uint64)))
    for k in np.flatnonzero(end - begin > LONG).tolist():
        digest = hashlib.blake2b(codes[begin[k] : end[k]].tobytes(), digest_size=16).digest()
        out[0][k], out[1][k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return out[0], out[1]
