"""K-mers of reads: as Spark expressions, and as numpy kernels over whole batches.

Both strands of a k-mer are one: the key is the larger of a window and its reverse
complement.  Up to k = 31 a key is two bits a base (A 0, C 1, G 2, T 3), a non-negative
long; beyond it is a 63-bit hash of 31-base words.  Keys of the two forms are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from evenstrand.functions.bases import reverse_complement, to_acgt

SHORT = 31


def layout(k: int) -> tuple[int, int]:
    """Word length and number of words of a long k-mer; length * number may fall short of k."""
    if k <= SHORT:
        return k, 1
    more, fewer = -(-k // SHORT), max(k // SHORT, 1)
    best = max((fewer, more), key=lambda n: (min(SHORT, k // n) * n, -n))
    return k // best, best


# expressions


def canonical(bases, start, k: int) -> Column:
    """The canonical form, as text, of the window at 1-based start (upper-case ACGT expected)."""
    window = F.substring(F.col(bases) if isinstance(bases, str) else bases, start, F.lit(k))
    return F.greatest(window, reverse_complement(window))


def code(kmer: Column) -> Column:
    """Two bits a base, as a long, of a k-mer of up to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def key(bases, start, k: int) -> Column:
    """The key of the window at 1-based start; null where it holds another letter than ACGT."""
    b = F.col(bases) if isinstance(bases, str) else bases
    size, words = layout(k)
    window = F.substring(b, start + (k - size * words), F.lit(size * words))
    out = _joined(F.translate(F.greatest(window, reverse_complement(window)), "ACGT", "0123"), size, words)
    return F.when(F.substring(b, start, F.lit(k)).rlike("^[ACGT]+$"), out)


def _joined(digits: Column, size: int, words: int) -> Column:
    """The key of a k-mer in base 4."""
    out = None
    for w in range(words):
        part = F.conv(F.substring(digits, F.lit(w * size + 1), F.lit(size)) if words > 1 else digits, 4, 10).cast("long")
        out = part if out is None else F.shiftleft(out, 25).bitwiseOR(F.shiftrightunsigned(out, 39)).bitwiseXOR(part)
    return out if words == 1 else out.bitwiseAND(F.lit(2**63 - 1))


def windows(bases, k: int) -> Column:
    """The keys of all windows of a read in order, null where one is invalid."""
    b = to_acgt(bases)
    n = F.length(b) - k + 1
    size, words = layout(k)
    # both strands of a clean read are put into base 4 once, not window by window
    strands = F.struct(F.translate(b, "ACGT", "0123").alias("f"), F.translate(F.reverse(b), "ACGT", "3210").alias("r"), n.alias("n"))
    larger = lambda s, i: F.greatest(F.substring(s["f"], i + (k - size * words), F.lit(size * words)), F.substring(s["r"], s["n"] + 1 - i, F.lit(size * words)))
    clean = F.transform(F.array(strands), lambda s: F.transform(F.sequence(F.lit(1), s["n"]), lambda i: _joined(larger(s, i), size, words)))[0]
    each = F.transform(F.sequence(F.lit(1), n), lambda i: key(b, i, k))
    return F.when((n >= 1) & b.rlike("^[ACGT]+$"), clean).when(n >= 1, each).otherwise(F.array().cast("array<long>"))


# kernels

CODES = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _c in _pair:
        CODES[ord(_c)] = _i


def _codes(base: np.ndarray, k: int, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Two-bit codes of every run of k bases and of its reverse complement, by doubling."""
    f = base.astype(kind)
    r = kind(3) - f
    have, fs, rs = 1, f, r
    out_f = out_r = None
    done, left = 0, k
    while True:
        if left & 1:
            if out_f is None:
                out_f, out_r = fs, rs
            else:
                n = len(fs) - done
                out_f = (out_f[:n] << kind(2 * have)) | fs[done : done + n]
                out_r = out_r[:n] | (rs[done : done + n] << kind(2 * done))
            done += have
        left >>= 1
        if not left:
            return out_f, out_r
        n = len(fs) - have
        fs, rs = (fs[:n] << kind(2 * have)) | fs[have:], rs[:n] | (rs[have:] << kind(2 * have))
        have *= 2


def _hash(parts: list[np.ndarray]) -> np.ndarray:
    x = parts[0]
    for p in parts[1:]:
        x = ((x << np.uint64(25)) | (x >> np.uint64(39))) ^ p
    return x


def packed(codes: np.ndarray) -> np.ndarray:
    """Two-bit codes, four a byte, the first one highest; the last byte is filled with zeros."""
    four = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]


def packed_keys(four: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Keys of the windows of up to 31 bases that begin at these places of packed codes."""
    return np.maximum(*packed_strands(four, at, k)).view(np.int64)


def packed_strands(four: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two-bit codes of these windows, and of their reverse complements."""
    padded = np.concatenate([four, np.zeros(9, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)
    byte, shift = at >> 2, ((at & 3) << 1).astype(np.uint64)
    f = eight[byte] << shift
    if 2 * k + 6 > 64:
        f |= padded[byte + 8].astype(np.uint64) >> (np.uint64(8) - shift)
    f >>= np.uint64(64 - 2 * k)
    return f, reverse(f, k)


def reverse(f: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of k-mers of up to 31 bases, both in two-bit codes."""
    r = ~f
    two, four_bits = np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
    r = (r >> np.uint64(2)) & two | (r & two) << np.uint64(2)
    r = (r >> np.uint64(4)) & four_bits | (r & four_bits) << np.uint64(4)
    return r.byteswap() >> np.uint64(64 - 2 * k)


def batch_keys(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, place, key) of every window of reads laid end to end; key -1 where invalid."""
    lengths = np.diff(offsets)
    many = np.maximum(lengths - k + 1, 0)
    read = np.repeat(np.arange(len(lengths)), many)
    place = np.arange(len(read)) - np.repeat(np.cumsum(many) - many, many)
    if not len(read):
        return read, place, np.zeros(0, np.int64)
    at = offsets[:-1][read] + place
    base = CODES[data]
    bad = base > 3
    clean = not bad.any()
    if not clean:
        bad = np.concatenate([[0], np.cumsum(bad)])
        valid = bad[at + k] == bad[at]
        base = np.minimum(base, 3)
    size, words = layout(k)
    if words == 1:
        keys = packed_keys(packed(base), at, k)
    else:
        f, r = _codes(base, size)
        start = at + (k - size * words)
        ahead = [f[start + w * size] for w in range(words)]
        back = [r[start + w * size] for w in reversed(range(words))]
        less = np.zeros(len(at), bool)
        open_ = np.ones(len(at), bool)
        for x, y in zip(ahead, back, strict=True):
            less |= open_ & (x < y)
            open_ &= x == y
        keys = np.where(less, _hash(back), _hash(ahead)) & np.uint64(2**63 - 1)
    keys = keys.astype(np.int64, copy=False)
    return read, place, keys if clean else np.where(valid, keys, -1)


def quality_filter(quals: np.ndarray, bases: np.ndarray, offsets: np.ndarray, read: np.ndarray, place: np.ndarray, k: int, min_quality: int, min_prob: float) -> np.ndarray:
    """Which windows hold only bases of min_quality or more and are right with min_prob or more (products by logarithm)."""
    # bases alike in quality are alike in chance; where the worst base would do k times, all windows pass
    worst = int(quals.min(initial=255)) - 33
    chances = np.concatenate([np.zeros(34), np.log1p(-np.power(10.0, -np.arange(1, 223) / 10.0))])
    if worst >= max(1, min_quality) and (min_prob <= 0 or k * chances[worst + 33] >= np.log(min_prob) + 1e-6):
        return np.ones(len(read), bool)
    at = offsets[:-1][read] + place
    q = quals.astype(np.int64) - 33
    low = np.concatenate([[0], np.cumsum(q < min_quality)])
    keep = low[at + k] == low[at]
    if min_prob > 0:
        sums, zeros = np.concatenate([[0.0], np.cumsum(chances[quals])]), np.concatenate([[0], np.cumsum(q <= 0)])
        keep &= (zeros[at + k] == zeros[at]) & (sums[at + k] - sums[at] >= np.log(min_prob) - 1e-9)
    return keep
