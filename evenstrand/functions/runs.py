"""Runs of windows: how k-mers travel when they are counted and looked up.

Neighbouring windows of a read mostly go to one bucket, as the bucket is that of the
window's minimizer, the least hash among its canonical m-mers.  They travel as one run, at
two bits a base: about a byte a window, where a k-mer alone takes eight.  Equal k-mers, of
either strand, have equal minimizers, so a bucket holds all windows of its k-mers.

A run has up to MOST windows, all counted or none.  A pack is the runs of one batch of
reads that go to one bucket: a byte per run (COUNTED, and the number of windows), then
their bases end to end.  What comes back is the depths of a pack's windows, in its order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from evenstrand.functions import kmers

#: Windows of a run at most; the bit of a run's byte that says it counts.
MOST, COUNTED = 127, 128
#: Letters of a minimizer.
MINIMIZER = 13
#: Windows worked on at once when a bucket is counted.
AT_ONCE = 1 << 21
#: The bucket of runs of windows that hold no k-mer; real buckets are smaller.
NONE = 0xFFFF
LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits, one for each of 32 bits."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _steps(many: np.ndarray) -> np.ndarray:
    """0, 1, .. n - 1 for each n of many, end to end."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def buckets_of(data: np.ndarray, k: int, buckets: int, core: bool = False) -> np.ndarray:
    """The bucket of the window that begins at each place of data (k letters or more).

    core: by the minimizer of the letters between the first and the last, so that windows that differ in one of these two meet.
    """
    if core:
        return _buckets_of(data[1:-1], k - 2, MINIMIZER - 2, buckets)
    return _buckets_of(data, k, MINIMIZER, buckets)


def _buckets_of(data: np.ndarray, k: int, m: int, buckets: int) -> np.ndarray:
    m = min(k, m)
    f, r = kmers._codes(np.minimum(kmers.CODES[data], 3), m, np.uint32)
    least = _mixed(np.maximum(f, r))
    have, span = 1, k - m + 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    return (_mixed(least ^ np.uint32(0x5BD1E995)).astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16)


def first_in_unit(unit: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a window is the first of its unit with its k-mer."""
    first = np.ones(len(key), bool)
    both = (key.view(np.uint64) + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    ordered = np.sort(both)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):  # equal pairs are among those of equal hashes
        low = np.uint64(44)
        some = np.zeros(1 << 20, bool)
        some[twice >> low] = True
        at = np.flatnonzero(some[both >> low])
        order = at[np.lexsort((at, key[at], unit[at]))]
        first[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (unit[order[1:]] != unit[order[:-1]])
    return first


def split(data: np.ndarray, read: np.ndarray, place: np.ndarray, offsets: np.ndarray, valid: np.ndarray, counts: np.ndarray, k: int, buckets: int, core: bool = False) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, bytes]]]:
    """The windows of a batch as runs: windows and bucket of each run, in order, and per bucket the number of runs and their pack.

    read, place: of each window; counts: whether it is counted.  Runs of NONE are in no pack.
    """
    if not len(read):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint16), {}
    at = offsets[:-1][read] + place
    bucket = np.where(valid, buckets_of(data, k, buckets, core)[at], np.uint16(NONE))
    counts = counts & valid
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (counts[1:] != counts[:-1]) | (read[1:] != read[:-1]))
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(new)))
    if many.max() > MOST:
        new |= (np.arange(len(new)) - np.repeat(head, many)) % MOST == 0
        head = np.flatnonzero(new)
        many = np.diff(np.append(head, len(new)))
    of = bucket[head]
    order = np.argsort(of, kind="stable")
    order = order[: np.searchsorted(of[order], NONE)]
    size, there = many[order] + k - 1, of[order]
    cuts = np.append(np.flatnonzero(np.append(True, there[1:] != there[:-1])) if len(there) else np.zeros(0, np.int64), len(order))
    per = np.add.reduceat(size, cuts[:-1]) if len(there) else np.zeros(0, np.int64)
    room = -(-per // 4) * 4
    base = np.cumsum(room) - room
    # a bucket's last run goes on to a whole byte; what it adds is never read
    size[cuts[1:] - 1] += room - per
    small = np.int32 if int(room.sum()) + len(data) < 1 << 31 else np.int64
    from_ = np.repeat((at[head][order] - (np.cumsum(size) - size)).astype(small), size)
    from_ += np.arange(len(from_), dtype=small)
    packed = kmers.packed(np.append(np.minimum(kmers.CODES[data], 3), np.zeros(3, np.uint8))[from_]).tobytes()
    runs = (many[order] | np.where(counts[head][order], COUNTED, 0)).astype(np.uint8).tobytes()
    packs = {}
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        packs[int(there[a])] = (b - a, runs[a:b] + packed[base[i] // 4 : (base[i] + room[i]) // 4])
    return many.astype(np.uint8), of, packs


def opened(packs: list[tuple[int, bytes]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some packs (number of runs, pack): key, whether counted, and where each pack's windows begin."""
    runs = np.concatenate([np.frombuffer(p, np.uint8, n) for n, p in packs])
    many = (runs & MOST).astype(np.int64)
    packed = np.concatenate([np.frombuffer(p, np.uint8, offset=n) for n, p in packs])
    rows = np.concatenate([[0], np.cumsum([n for n, _ in packs])])
    size = np.concatenate([[0], np.cumsum(many + k - 1)])
    room = np.cumsum([0] + [4 * (len(p) - n) for n, p in packs])
    base = size[:-1] + np.repeat(room[:-1] - size[rows[:-1]], np.diff(rows))
    ends = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(base - ends[:-1], many) + np.arange(ends[-1])
    if k <= kmers.SHORT:
        key = kmers.packed_keys(packed, at, k)
    else:
        codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], 1).ravel()
        key = kmers.batch_keys(LETTERS[codes], np.array([0, len(codes)]), k)[2][at]
    return key, np.repeat(runs >= COUNTED, many), ends[rows]


def _counted(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of key, its distinct values, the sum of n of each, and how often each comes."""
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    return order, key[head], sums, np.diff(np.append(head, len(key)))


def _portions(packs: list[tuple[int, bytes]]) -> list[list[tuple[int, bytes]]]:
    """packs in lists of about AT_ONCE windows."""
    out, size = [[]], 0
    for n, p in packs:
        if size >= AT_ONCE:
            out.append([])
            size = 0
        out[-1].append((n, p))
        size += int((np.frombuffer(p, np.uint8, n) & MOST).sum(dtype=np.int64))
    return out


def answered(packs: list[tuple[int, bytes]], k: int, least: int = 0) -> Iterator[bytes]:
    """For each pack of a bucket the depths of its windows: the size of a number, then the numbers. Depths under least are 0.

    Buckets of many windows are worked on in portions; memory then goes by distinct k-mers.
    """
    portions = _portions(packs)
    if len(portions) == 1:
        key, counted, ends = opened(packs, k)
        order, _, sums, often = _counted(key, counted)
        found = np.empty(len(key), np.int64)
        found[order] = np.repeat(np.where(sums >= least, sums, 0), often)
        yield from _numbers(found, ends)
        return
    keys, depths = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for some in portions:
        key, counted, _ = opened(some, k)
        _, key, n, _ = _counted(key, counted)
        _, keys, depths, _ = _counted(np.append(keys, key), np.append(depths, n))
    depths[depths < least] = 0
    for some in portions:
        key, _, ends = opened(some, k)
        order = np.argsort(key)  # asked in order, neighbours in the table are near in memory
        found = np.empty(len(key), np.int64)
        found[order] = depths[np.searchsorted(keys, key[order])]
        yield from _numbers(found, ends)


def _numbers(found: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        most = int(found[a:b].max(initial=0))
        kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64
        yield bytes([np.dtype(kind).itemsize]) + found[a:b].astype(kind).tobytes()


def places(many: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The places, in a batch, of the windows of its packs, end to end by bucket."""
    many = many.astype(np.int64)
    order = np.argsort(of, kind="stable")
    order = order[: np.searchsorted(of[order], NONE)]
    start = (np.cumsum(many) - many)[order]
    return np.repeat(start, many[order]) + _steps(many[order])


def placed(many: np.ndarray, of: np.ndarray, answers: list[bytes], to: np.ndarray | None = None) -> np.ndarray:
    """The depths of a batch's windows in order, -1 where there is no k-mer. answers: of its packs, by bucket; to: see places."""
    cov = np.full(int(many.sum(dtype=np.int64)), -1, np.int64)
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
    found = [np.frombuffer(x, kinds[x[0]], offset=1).astype(np.int64) for x in answers]
    to = places(many, of) if to is None else to
    got = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(got) != len(to):
        raise ValueError("packs of a batch of reads are missing: the reads came in another order when a lost stage was run again")
    cov[to] = got
    return cov


# other first or last bases

#: Of a window that has deep others: its number in its pack, whether the first base of the k-mer differs (LAST or FIRST), the deepest others' bases as bits, their depth.
OTHER = np.dtype([("window", "<u4"), ("side", "u1"), ("bases", "u1"), ("depth", "<i8")])
LAST, FIRST = 0, 1


def near(keys: np.ndarray, depths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all k-mers that differ from these in the last or first base alone: key, side that differs, the base of these there, their depth."""
    made = []
    forward = keys.view(np.uint64)
    for text in (forward, kmers.reverse(forward, k)):
        last = (text & np.uint64(3)).astype(np.uint8)
        for step in (1, 2, 3):
            other = text ^ np.uint64(step)
            back = kmers.reverse(other, k)
            own, both = other >= back, np.flatnonzero(other == back)
            made.append((np.maximum(other, back).view(np.int64), np.where(own, LAST, FIRST).astype(np.uint8), np.where(own, last, 3 - last), depths))
            made.append((other[both].view(np.int64), np.full(len(both), FIRST, np.uint8), 3 - last[both], depths[both]))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _others(keys: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted keys, at 2 * number + side: depth of the deepest that are near (0: none), and their bases as bits."""
    key, side, base, depth = found
    best, bits = np.zeros(2 * len(keys), np.int64), np.zeros(2 * len(keys), np.uint8)
    if not len(keys):
        return best, bits
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == key)
    slot, base, depth = 2 * at[hit] + side[hit], base[hit], depth[hit]
    np.maximum.at(best, slot, depth)
    top = depth == best[slot]
    np.bitwise_or.at(bits, slot[top], np.left_shift(1, base[top]).astype(np.uint8))
    return best, bits


def judged(packs: list[tuple[int, bytes]], k: int, least: int, high: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """As answered, with each pack's OTHERs of depth high or more, and the bucket's k-mers (sorted) and depths.

    known: such k-mers and depths from before; then nothing is counted.
    """
    portions, keys, depths = _portions(packs), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sorted_ = []
    for some in portions if known is None else []:
        key, counted, ends = opened(some, k)
        order, key, n, often = _counted(key, counted)
        if len(portions) == 1:
            keys, depths = key, n
            sorted_ = [(order, key, often, ends)]
        else:
            _, keys, depths, _ = _counted(np.append(keys, key), np.append(depths, n))
    if known is not None:
        keys, depths = known
    depths = np.where(depths < least, 0, depths)
    deep = depths >= high
    close = near(keys[deep], depths[deep], k)
    answers, others = [], []
    for some in portions if packs else []:
        if sorted_:
            order, key, often, ends = sorted_[0]
            depth = depths
        else:
            key, counted, ends = opened(some, k)
            order, key, _, often = _counted(key, counted)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            depth = np.where(keys[at] == key, depths[at], 0) if len(keys) else np.zeros(len(key), np.int64)
        found = np.empty(len(order), np.int64)
        found[order] = np.repeat(depth, often)
        answers += _numbers(found, ends)
        best, bits = _others(key, close)
        slot = np.flatnonzero(best)
        many, begin = often[slot >> 1], (np.cumsum(often) - often)[slot >> 1]
        window, slot = order[np.repeat(begin, many) + _steps(many)], np.repeat(slot, many)
        at = np.lexsort((slot, window))
        window, slot = window[at], slot[at]
        rows, pack = np.empty(len(window), OTHER), np.searchsorted(ends, window, side="right") - 1
        rows["window"], rows["side"], rows["bases"], rows["depth"] = window - ends[pack], slot & 1, bits[slot], best[slot]
        cuts = np.searchsorted(window, ends)
        others += [rows[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return answers, others, keys, depths
