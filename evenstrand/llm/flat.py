"""Numpy kernels over flat token arrays: rolling hashes, word cuts, winnowed anchors.

All kernels work on one chunk of many texts laid end to end, so no Python loop
runs per token.  Hashes are 64-bit polynomials modulo 2**64 with a mixed value per
token, so a span's hash is two array reads and a product.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown as needed and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


class Spans:
    """Hashes of any span [start, end) of a flat array of token values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(BASE_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of every span of k tokens."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * powers(BASE_INVERSE, len(self.sums))[:n])


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes or tokens worked on at once; longer texts are worked on in pieces.
PIECE = 1 << 20


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^ \\t-\\r]+ of the texts in order, and the word offsets of each text (len+1)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(joined):
        end = min(len(joined), at + PIECE)
        while end < len(joined) and not SEPARATOR[joined[end - 1]]:  # a piece ends after a separator
            ahead = np.flatnonzero(SEPARATOR[joined[end : end + PIECE]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(len(joined), end + PIECE)
        piece = joined[at:end]
        edges = np.flatnonzero(np.diff(~SEPARATOR[piece], prepend=False, append=False))
        hashes.append(Spans(BYTE_VALUES[piece]).hash(edges[::2], edges[1::2]))
        starts.append(edges[::2] + at)
        at = end
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.searchsorted(np.concatenate(starts), ends)]) if starts else np.zeros(1, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


FIELDS = ("text", "first", "last", "at", "anchor", "stretch")


def anchors(values: np.ndarray, offsets: np.ndarray, k: int, window: int) -> dict[str, np.ndarray]:
    """The winnowed anchors of texts laid end to end.

    Each span of `window` tokens within a text has one anchor: its k-gram of least
    hash, the leftmost of equals.  Neighbouring spans with the same anchor form one
    row: text, first and last span start and the anchor's place (all relative to the
    text), the anchor's hash, and the hash of the whole stretch those spans cover.
    Which anchor a span has depends on the span alone, so equal spans always meet
    under one anchor.  Long inputs are worked on in overlapping pieces; a row that a
    piece cuts in two stays right, as rows are only bundles of spans.
    """
    parts = [_anchors(values, offsets, k, window, c) for c in range(0, max(1, len(values) - window + 1), PIECE)]
    return {f: np.concatenate([p[f] for p in parts]) for f in FIELDS}


def _anchors(values: np.ndarray, offsets: np.ndarray, k: int, window: int, begin: int) -> dict[str, np.ndarray]:
    piece = values[begin : begin + PIECE + window - 1]
    n = len(piece)
    if n < window:
        return {f: np.zeros(0, np.int64) for f in FIELDS}
    spans = Spans(piece)
    grams = spans.grams(k)
    bits = max(1, int(n).bit_length())
    key = ((grams >> _U(bits)) << _U(bits)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(key, window - k + 1) & _U((1 << bits) - 1)).astype(np.int64)
    s = np.arange(len(at))
    text = np.searchsorted(offsets, s + begin, "right") - 1
    valid = s + begin + window <= offsets[text + 1]
    s, text, at = s[valid], text[valid], at[valid]
    if not len(s):
        return {f: np.zeros(0, np.int64) for f in FIELDS}
    new = np.empty(len(s), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    first, last = s[head], s[np.append(head[1:], len(s)) - 1]
    text, at = text[head], at[head]
    return {
        "text": text,
        "first": first + begin - offsets[text],
        "last": last + begin - offsets[text],
        "at": at + begin - offsets[text],
        "anchor": grams[at].view(np.int64),
        "stretch": spans.hash(first, last + window).view(np.int64),
    }


def join_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as sorted maximal ranges; ranges that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
