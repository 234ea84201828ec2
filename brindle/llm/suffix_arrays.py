"""Suffix arrays by induced sorting, in whole-array steps, and permuted common prefixes.

``suffix_array`` follows induced sorting: suffixes are classified as smaller or larger than their successor, the leftmost-smaller
(LMS) substrings are sorted by inducing, named, and, where names repeat, their sequence is sorted in turn; from the sorted LMS
suffixes the larger and then the smaller suffixes are induced in one pass each.  A pass goes through the 256 buckets and handles
what stands in a bucket at once: what it induces within the bucket lies along runs of one byte and is written down in one step, and
what it induces elsewhere is dealt out by a stable sort of bytes, which is a radix sort, so a pass takes time in proportion to the text and
gives the order of the sequential scan.  The alphabet of names is as large as the text, for which buckets don't pay in whole-array steps; their sequence is
sorted by prefix doubling.

Suffixes need only be told apart by their first ``depth`` bytes; ties beyond come in any order.  Empty texts give an empty array.
"""

from __future__ import annotations

import numpy as np


def _places(n: int) -> type:
    """The type that holds places of a text of n bytes."""
    return np.int32 if n < 1 << 31 else np.int64


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at i is smaller than that at i + 1; the last one is larger than the empty suffix."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    up, same = t[:-1] < t[1:], t[:-1] == t[1:]
    kind = _places(n)
    decides = np.where(same, kind(n), np.arange(n - 1, dtype=kind))
    at = np.minimum.accumulate(decides[::-1])[::-1]  # the next place where neighbours differ
    out[:-1] = np.where(at < n, up[np.minimum(at, n - 2)], False)
    return out


def _spread(places: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append each place to the list of its character, keeping their order."""
    if not len(places):
        return
    order = np.argsort(chars, kind="stable")
    places, chars = places[order], chars[order]
    begin = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(chars)]):
        into[chars[a]].append(places[a:b])


def _runs(t: np.ndarray) -> np.ndarray:
    """How many bytes equal to each place's own stand right before it."""
    kind = _places(len(t))
    place = np.arange(len(t), dtype=kind)
    begins = np.where(np.r_[True, t[1:] != t[:-1]], place, kind(0))
    return place - np.maximum.accumulate(begins, out=begins)


def _along(first: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Places ``first`` and those that they induce in their own bucket, one byte further left at a time, in the order of the scan."""
    back = run[first]
    most = int(back.max(initial=0))
    if most > 32:  # long runs of one byte: all their places at once
        times = back + 1
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return (np.repeat(first, times) - step)[np.argsort(step, kind="stable")].astype(first.dtype)
    out, live = [first], first
    for k in range(1, most + 1):
        goes_on = back >= k
        live, back = live[goes_on] - 1, back[goes_on]
        out.append(live)
    return np.concatenate(out)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per character: its larger suffixes in order, and its smaller ones in falling order.  lms: LMS places in the order they are to have.

    A bucket's own places are those induced from other buckets and, from them, those along runs of its byte, which have the same type.
    """
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _spread(lms, t[lms], seeds)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = len(t) - 1
    larger[t[last]].append(np.array([last], lms.dtype))  # the empty suffix comes first of all
    run = _runs(t)

    def induce(now: np.ndarray, kind: bool, c: int, into: list[list[np.ndarray]]) -> None:
        """What places of bucket c induce in other buckets."""
        now = now[now > 0] - 1
        now = now[small[now] == kind]
        chars = t[now]
        other = chars != c
        _spread(now[other], chars[other], into)

    none = np.empty(0, lms.dtype)
    up, down = [none] * 256, [none] * 256
    for c in range(256):  # what a bucket was dealt is let go once it is in order
        if larger[c]:
            up[c], larger[c] = _along(np.concatenate(larger[c]), run), []
            induce(up[c], False, c, larger)
        if seeds[c]:
            now, seeds[c] = np.concatenate(seeds[c]), []
            induce(now, False, c, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c in range(255, -1, -1):
        if smaller[c]:
            down[c], smaller[c] = _along(np.concatenate(smaller[c]), run), []
            induce(down[c], True, c, smaller)
        if len(up[c]):
            induce(up[c][::-1], True, c, smaller)
    return up, down


def _names(t: np.ndarray, places: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings by place, equal for equal ones, and how many there are.  order: places sorted by substring."""
    n = len(t)
    ends = np.append(places[1:], n - 1)
    size = np.zeros(n, np.int64)
    size[places] = ends - places
    a, b = order[:-1], order[1:]
    same = (size[a] == size[b]) & (a != places[-1]) & (b != places[-1])
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        live = live[size[a[live]] > k]
        k += 1
    name = np.empty(n, np.int64)
    name[order] = np.append(0, np.cumsum(~same)) if len(order) else 0
    return name[places], int(len(order) - same.sum())


def _doubled(names: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of a sequence of names by their first ``steps`` names or more."""
    n, rank, width = len(names), names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < steps:
        key = (rank + 1) * (n + 2)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        sorted_ = key[order]
        fresh = np.r_[True, sorted_[1:] != sorted_[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        width *= 2
    return order


def _sorted_substrings(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """LMS places in the order of their substrings; what the pass held is let go before the next one."""
    falling = np.concatenate(_induce(t, small, lms)[1][::-1])
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    return falling[is_lms[falling]][::-1]


def suffix_array(text: bytes | np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of all suffixes, in order by their first ``depth`` bytes (all bytes if None)."""
    t = np.frombuffer(text, np.uint8) if isinstance(text, (bytes, bytearray)) else text
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = smaller_types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_places(n))
    if len(lms) > 1:
        order = _sorted_substrings(t, small, lms)
        names, kinds = _names(t, lms, order)
        if kinds < len(lms):  # LMS places are two bytes apart or more
            order = lms[_doubled(names, len(lms) if depth is None else depth // 2 + 2)]
        lms = order
        del names, order
    up, down = _induce(t, small, lms)
    return np.concatenate([x for c in range(256) for x in (up[c], down[c][::-1])])


def eights(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; past the end, zeros."""
    x = np.zeros(len(t) + 8, np.uint64)
    x[: len(t)] = t
    x[:-1] |= x[1:] << np.uint64(8)
    x[:-2] |= x[2:] << np.uint64(16)
    x[:-4] |= x[4:] << np.uint64(32)
    return x[: len(t)]


def shared_prefixes(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For the places in ``order`` (sorted suffixes): whether each shares ``length`` bytes or more with the one before it.

    Worked out in text order, by each place's predecessor (permuted common prefixes, cut off at ``length``): neighbouring places mostly
    have neighbouring predecessors, so memory is read in order.
    """
    before = np.full(len(t), -1, order.dtype)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before >= 0)
    x, live = eights(t), places
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        live = live[x[live + k] == x[before[live] + k]]
    shared = np.zeros(len(t), bool)
    shared[live] = True
    return shared[order]
