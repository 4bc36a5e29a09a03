"""Suffix arrays by induced sorting and permuted common prefixes, as whole-array steps.

A suffix is smaller (S) or larger (L) than the next one; a leftmost S suffix (LMS) starts a substring that ends with
the next of its kind. LMS substrings are sorted and named, and the string of names is sorted by the same function,
or, once most names differ, by ranking what is tied with what follows it. The order of the LMS suffixes then induces that of all: L suffixes bucket
by bucket from the left, S suffixes from the right.

A bucket is done in a fixed number of array operations: what it induces in itself are runs of its own symbol, so
they follow from run lengths; what it induces elsewhere is dealt out by one stable sort. Of a large
alphabet, stretches of buckets that induce nothing among themselves are done at once.
"""

from __future__ import annotations

import numpy as np

_AT_ONCE = 8_192  # suffixes of the buckets that are tried together
_FEW = 1_024  # alphabets up to this size go bucket by bucket


def suffix_array(t: np.ndarray, size: int | None = None) -> np.ndarray:
    """Starts of all suffixes of ``t`` (symbols 0 to ``size`` - 1) in order; a shorter one comes first."""
    n = len(t)
    if n <= 24:
        plain = t.tolist()
        return np.array(sorted(range(n), key=lambda i: plain[i:]), dtype=np.int32)
    size = int(t.max()) + 1 if size is None else size
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        names, distinct = _names(t, lms, size)
        if 2 * distinct < len(lms):
            lms = lms[suffix_array(names, distinct)]
        else:
            lms = lms[_few_ties(names)]
    return _Inducer(t, size, smaller).induce(lms)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last is larger than nothing at all."""
    n = len(t)
    step = np.full(n, -1, dtype=np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1]).astype(np.int8)
    decides = np.where(step != 0, np.arange(n, dtype=np.int32), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return step[decides] > 0


def _names(t: np.ndarray, lms: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings in text order, and how many differ.

    As many symbols as fit are packed into one number; substrings that still agree and go on are ranked by their
    next symbols. Where one ends and another goes on, the one that goes on is smaller, as its suffix is.
    """
    n, m = len(t), len(lms)
    length = np.append(lms[1:] - lms[:-1] + 1, n - lms[-1] + 1)
    bits = int(size).bit_length()
    per = max(1, 63 // bits)
    beyond = (1 << bits) - 1  # above every symbol

    def packed(who: np.ndarray, offset: int) -> np.ndarray:
        key = np.zeros(len(who), dtype=np.int64)
        for k in range(offset, offset + per):
            at = lms[who] + k
            inside = k < length[who]
            symbol = np.where(inside & (at < n), t[np.minimum(at, n - 1)], np.where(inside, 0, beyond))
            key = (key << bits) | symbol
        return key

    key = packed(np.arange(m), 0)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(m, dtype=bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    for offset in range(per, int(length.max()), per):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        group = np.cumsum(fresh) - 1
        goes_on = np.zeros(group[-1] + 1, dtype=bool)
        goes_on[group[length[order] > offset]] = True
        slots = np.flatnonzero(tied & goes_on[group])
        if not len(slots):
            break
        who, within = order[slots], group[slots]
        more = packed(who, offset)
        again = np.lexsort((more, within))
        order[slots] = who[again]
        more = more[again]
        fresh[slots[1:]] |= more[1:] != more[:-1]
    # the last substring ends with the text and is like no other; what equals it is larger
    last = int(np.flatnonzero(order == m - 1)[0])
    low = last - int(np.argmax(fresh[last::-1]))
    order[low + 1 : last + 1] = order[low:last]
    order[low] = m - 1
    if low + 1 < m:
        fresh[low + 1] = True
    names = np.empty(m, dtype=np.int32)
    names[order] = np.cumsum(fresh) - 1
    return names, int(fresh.sum())


def _few_ties(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string most of whose symbols differ: ties are settled by ranks of the symbols after them."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    fresh = np.ones(m, dtype=bool)
    fresh[1:] = names[order[1:]] != names[order[:-1]]
    h = 1
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        rank = np.full(m + 1, -1, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(m), 0))
        who = order[slots]
        after = rank[np.minimum(who + h, m)]
        again = np.lexsort((after, rank[who]))
        order[slots] = who[again]
        after, within = after[again], rank[who[again]]
        fresh[slots[1:]] |= (after[1:] != after[:-1]) | (within[1:] != within[:-1])
        h *= 2


class _Inducer:
    def __init__(self, t: np.ndarray, size: int, smaller: np.ndarray):
        n = len(t)
        self.t, self.smaller, self.n = t, smaller, n
        counts = np.bincount(t, minlength=size)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.used = np.flatnonzero(counts)
        self.few = len(self.used) <= _FEW
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = t[1:] != t[:-1]
        self.run_start = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the LMS suffixes in order."""
        self.sa = np.full(self.n, -1, dtype=np.int32)
        self.head, self.tail = self.start.copy(), self.end.copy()
        symbols = self.t[lms]
        n_lms = np.bincount(symbols, minlength=len(self.end))
        self.lms_start = self.end - n_lms
        placed = self.lms_start[symbols] + np.arange(len(lms)) - (np.cumsum(n_lms) - n_lms)[symbols]
        self.sa[placed] = lms
        self._put_left(np.array([self.n - 1], dtype=np.int32))  # the one the end itself induces
        self._pass(self.used, self._left_bucket, self._left_stretch)
        self.sa[placed] = -1
        self._pass(self.used[::-1], self._right_bucket, self._right_stretch)
        return self.sa

    def _pass(self, buckets: np.ndarray, one, many) -> None:
        if self.few:
            for c in buckets.tolist():
                one(c)
            return
        sizes = np.cumsum(self.end[buckets] - self.start[buckets])
        b, before = 0, 0
        while b < len(buckets):
            upto = max(int(np.searchsorted(sizes, before + _AT_ONCE, side="right")), b + 1)
            done = many(buckets, b, upto) if upto > b + 1 else 0
            if not done:
                one(int(buckets[b]))
                done = 1
            b += done
            before = int(sizes[b - 1])

    # from the left: L suffixes

    def _put_left(self, who: np.ndarray) -> None:
        symbols = self.t[who]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        counts = np.diff(np.append(first, len(symbols)))
        at = np.arange(len(symbols)) + np.repeat(self.head[symbols[first]] - first, counts)
        self.sa[at] = who[order]
        self.head[symbols[first]] += counts

    def _before_left(self, entries: np.ndarray) -> np.ndarray:
        who = entries[entries > 0] - 1
        return who[~self.smaller[who]]

    def _left_bucket(self, c: int) -> None:
        low, high = self.start[c], self.head[c]
        if high > low:
            entries = self._with_runs(self.sa[low:high])
            self.head[c] = low + len(entries)
            self.sa[low : self.head[c]] = entries
            who = self._before_left(entries)
            who = who[self.t[who] != c]
            if len(who):
                self._put_left(who)
        who = self._before_left(self.sa[self.lms_start[c] : self.end[c]])
        if len(who):
            self._put_left(who)

    def _with_runs(self, entries: np.ndarray) -> np.ndarray:
        """The entries, then those one before each within its run of equal symbols, then two before, and so on."""
        more = entries - self.run_start[entries]
        total = int(more.sum())
        if not total:
            return entries
        owner = np.repeat(np.arange(len(entries)), more)
        back = np.arange(total) - np.repeat(np.cumsum(more) - more, more) + 1
        order = np.argsort(back, kind="stable")
        return np.concatenate([entries, (entries[owner] - back)[order]]).astype(np.int32)

    def _left_stretch(self, buckets: np.ndarray, b: int, upto: int) -> int:
        entries = self.sa[self.start[buckets[b]] : self.end[buckets[upto - 1]]]
        who = self._before_left(entries[entries >= 0])
        if len(who):
            least = int(self.t[who].min())
            if least <= buckets[upto - 1]:
                upto = int(np.searchsorted(buckets, least))
                if upto <= b + 1:
                    return 0
                entries = self.sa[self.start[buckets[b]] : self.end[buckets[upto - 1]]]
                who = self._before_left(entries[entries >= 0])
            if len(who):
                self._put_left(who)
        return upto - b

    # from the right: S suffixes

    def _put_right(self, who: np.ndarray) -> None:
        symbols = self.t[who]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        counts = np.diff(np.append(first, len(symbols)))
        at = np.repeat(self.tail[symbols[first]] + first, counts) - np.arange(len(symbols)) - 1
        self.sa[at] = who[order]
        self.tail[symbols[first]] -= counts

    def _before_right(self, entries: np.ndarray) -> np.ndarray:
        who = entries[entries > 0] - 1
        return who[self.smaller[who]]

    def _right_bucket(self, c: int) -> None:
        low, high = self.tail[c], self.end[c]
        if high > low:
            entries = self._with_runs(self.sa[low:high][::-1])
            self.tail[c] = high - len(entries)
            self.sa[self.tail[c] : high] = entries[::-1]
            who = self._before_right(entries)
            who = who[self.t[who] != c]
            if len(who):
                self._put_right(who)
        who = self._before_right(self.sa[self.start[c] : self.head[c]][::-1])
        if len(who):
            self._put_right(who)

    def _right_stretch(self, buckets: np.ndarray, b: int, upto: int) -> int:
        entries = self.sa[self.start[buckets[upto - 1]] : self.end[buckets[b]]][::-1]
        who = self._before_right(entries[entries >= 0])
        if len(who):
            most = int(self.t[who].max())
            if most >= buckets[upto - 1]:
                upto = len(buckets) - int(np.searchsorted(buckets[::-1], most, side="right"))
                if upto <= b + 1:
                    return 0
                entries = self.sa[self.start[buckets[upto - 1]] : self.end[buckets[b]]][::-1]
                who = self._before_right(entries[entries >= 0])
            if len(who):
                self._put_right(who)
        return upto - b


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, ends: np.ndarray, separator: int = 0xFF) -> np.ndarray:
    """Per position, the bytes its suffix shares with the one before it in ``sa``, up to the nearer end of their strings.

    ``ends``: the end of each position's string, where a ``separator`` stands. Only where the bytes to the left
    differ, or a string begins, are bytes compared; any other position shares one byte less than the position before it.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    plain = np.ones(n, dtype=bool)
    left = data[:-1]
    plain[1:] = (left != data[before[1:] - 1]) | (left == separator)
    plain[before <= 0] = True
    own = np.flatnonzero(plain & (before >= 0))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    other = before[own]
    limit = np.minimum(ends[own] - own, ends[other] - other)
    shared = np.zeros(len(own), dtype=np.int64)
    live, i, j = np.arange(len(own)), own, other
    while len(live):
        differ = eights[i] ^ eights[j]
        alike = differ == 0
        stop = np.flatnonzero(~alike)
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        shared[live[stop]] += np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3
        live, i, j = live[alike], i[alike] + 8, j[alike] + 8
        shared[live] += 8
        more = shared[live] < limit[live]
        live, i, j = live[more], i[more], j[more]
    result = np.zeros(n, dtype=np.int64)
    result[own] = np.minimum(shared, limit)
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(plain, at, 0))
    result = np.maximum(result[last] - (at - last), 0)
    result[before < 0] = 0
    return result
