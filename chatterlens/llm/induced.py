"""Suffix and LCP arrays by external induced sorting, in numpy.

The text's S* suffixes (a smaller symbol after a greater one) are sorted first:
their substrings by one induction, the text of their names by recursion. Two
inductions then bring all suffixes into order. Both run over a monotone
priority queue of ``(symbol, place, common prefix)`` tuples: for each symbol a
queue that goes to disk once the tuples in memory pass a limit. The common
prefix of two neighbours induced from x and y is one more than the least common
prefix between x and y, so the tuples carry it along. Common prefixes are
counted up to ``cap``. The text itself is one array of symbols.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Pairs of suffixes that are compared at a time.
PAIRS = 250_000


class SymbolQueue:
    """Tuples by symbol, first in first out; at most ``limit`` in memory."""

    def __init__(self, symbols: int, limit: int, folder: str | None = None):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.limit, self.folder, self.file = 0, limit, folder, None
        self.spilled = 0

    def push(self, symbol: int, places: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((places, common))
        self.held += len(places)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.file.tell()
                    part[0].astype(np.int64).tofile(self.file)
                    part[1].astype(np.uint16).tofile(self.file)
                    parts[i] = (at, len(part[0]))
                    self.spilled += len(part[0])
        self.held = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The symbol's tuples in order, with those pushed meanwhile."""
        parts = self.parts[symbol]
        while parts:
            ready = 0
            while ready < len(parts) and isinstance(parts[ready][0], np.ndarray):
                ready += 1
            if ready:
                part = tuple(map(np.concatenate, zip(*parts[:ready])))
                del parts[:ready]
                self.held -= len(part[0])
                yield part
            else:
                part = parts.pop(0)
                self.file.seek(part[0])
                yield np.fromfile(self.file, np.int64, part[1]), np.fromfile(self.file, np.uint16, part[1])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value in every range, both ends included."""
    width = last - first + 1
    level = np.frexp(width)[1] - 1
    out = np.empty(len(first), dtype=values.dtype)
    row, size = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        some = level == k
        out[some] = np.minimum(row[first[some]], row[last[some] - size + 1])
        row, size = np.minimum(row[:-size], row[size:]) if len(row) > size else row, size * 2
    return out


class _Induction:
    """One sweep over the suffixes in order; induces those one place before."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, cap: int, limit: int, folder: str | None):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = SymbolQueue(symbols, limit, folder)
        self.since = np.zeros(symbols, dtype=np.uint16)  # least common prefix since a symbol was last induced

    def scan(self, places: np.ndarray, common: np.ndarray) -> None:
        """``common``: with the suffix scanned just before."""
        valid = np.flatnonzero((places > 0) & self.wanted[places - 1])
        targets = self.text[places[valid] - 1]
        order = np.argsort(targets, kind="stable")
        at, targets = valid[order], targets[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = targets[1:] != targets[:-1]
        low = range_minima(common, np.where(head, 0, np.concatenate([[0], at[:-1] + 1])), at)
        low[head] = np.minimum(low[head], self.since[targets[head]])
        bounds = np.append(np.flatnonzero(head), len(at))
        last = at[bounds[1:] - 1]
        np.minimum(self.since, common.min() if len(common) else self.cap, out=self.since)
        tail = last + 1 < len(places)
        ends = np.full(len(last), self.cap, dtype=np.uint16)
        ends[tail] = range_minima(common, last[tail] + 1, np.full(int(tail.sum()), len(places) - 1))
        self.since[targets[head]] = ends
        low = np.minimum(low + 1, self.cap).astype(np.uint16)
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            self.queue.push(int(targets[a]), places[at[a:b]] - 1, low[a:b])


def common_prefix(text: np.ndarray, x: np.ndarray, y: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of pairs of suffixes by direct comparison, up to ``cap``;
    texts of bytes are compared eight at a time."""
    if len(x) > PAIRS:
        return np.concatenate([common_prefix(text, x[i: i + PAIRS], y[i: i + PAIRS], cap) for i in range(0, len(x), PAIRS)])
    out = np.zeros(len(x), dtype=np.int64)
    live = np.arange(len(x))
    n = len(text)
    if text.dtype == np.uint8 and n >= 8:
        words = np.ndarray(n - 7, dtype="<u8", buffer=text, strides=(1,))
        while len(live):
            a, b = x[live] + out[live], y[live] + out[live]
            inside = (a < n - 7) & (b < n - 7) & (out[live] < cap)
            live, a, b = live[inside], a[inside], b[inside]
            live = live[words[a] == words[b]]
            out[live] += 8
        out = np.minimum(out, cap)
        live = np.arange(len(x))
    while len(live):
        a, b = x[live] + out[live], y[live] + out[live]
        inside = (a < n) & (b < n) & (out[live] < cap)
        live, a, b = live[inside], a[inside], b[inside]
        same = text[a] == text[b]
        live = live[same]
        out[live] += 1
    return out.astype(np.uint16)


def _number(n: int) -> type:
    """The narrowest kind of integer, of two, that holds places of a text of ``n`` symbols."""
    return np.int32 if n < 2**31 else np.int64


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (the empty suffix is least)."""
    n = len(text)
    settled = np.full(n, -1, dtype=np.int8)
    np.subtract(text[1:] > text[:-1], text[1:] < text[:-1], out=settled[:-1], dtype=np.int8)
    number = _number(n)
    where = np.where(settled != 0, np.arange(n, dtype=number), number(n))
    following = np.minimum.accumulate(where[::-1])[::-1]
    return settled[following] > 0


def _by_symbol(text: np.ndarray, places: np.ndarray, symbols: int) -> np.ndarray:
    return np.searchsorted(text[places], np.arange(symbols + 1))


def induce(
    text: np.ndarray, small: np.ndarray, stars: np.ndarray, star_common: np.ndarray, symbols: int, cap: int,
    limit: int, folder: str | None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the sorted S* suffixes: runs of (places, common
    prefixes with the one before), from the last symbol to the first, each run
    in descending order."""
    n = len(text)
    bounds = _by_symbol(text, stars, symbols)
    left = _Induction(text, ~small, symbols, cap, limit, folder)
    large = SymbolQueue(symbols, limit, folder)
    # The empty suffix comes first of all and induces the last one.
    if n and not small[n - 1]:
        left.queue.push(int(text[n - 1]), np.array([n - 1]), np.zeros(1, dtype=np.uint16))
    for c in range(symbols):
        last = None
        for places, common in left.queue.pop(c):
            common = common.copy()
            if last is None:
                common[0] = 0
            left.scan(places, common)
            large.push(c, places, common)
            last = places[-1]
        stop, places = bounds[c + 1], stars[bounds[c]: bounds[c + 1]]
        if len(places):
            common = star_common[bounds[c]: stop].copy()
            common[0] = 0 if last is None else common_prefix(text, np.array([last]), places[:1], cap)[0]
            left.scan(places, common)
    left.queue.close()
    right = _Induction(text, small, symbols, cap, limit, folder)
    for c in range(symbols - 1, -1, -1):
        last, gap = None, np.zeros(1, dtype=np.uint16)
        # Descending: a tuple's common prefix is with the one after it.
        for places, common in right.queue.pop(c):
            common = common.copy()
            if last is None:
                common[0] = 0
            right.scan(places, common)
            yield places, common
            last = places[-1]
        blocks = [x for x in large.pop(c)]
        for places, common in reversed(blocks):
            down = places[::-1]
            after = common_prefix(text, down[:1], np.array([last]), cap) if last is not None and not gap[0] else gap
            up = np.concatenate([after, common[:0:-1]]).astype(np.uint16)
            right.scan(down, up)
            yield down, up
            last, gap = places[0], common[:1] if common[0] else np.zeros(1, dtype=np.uint16)
    right.queue.close()
    large.close()


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array in memory, by ranks of doubling prefixes."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    size = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        if size < n:
            ahead[:-size] = rank[size:]
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(fresh)
        if n == 0 or rank[order[-1]] == n:
            return order
        size *= 2


def suffixes(
    text: np.ndarray, cap: int, limit: int = 4_000_000, base: int = 2_000_000, folder: str | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of suffixes in descending order with the common prefix of each and
    the one that follows it in ascending order (0 across first symbols).

    ``text`` holds symbols from 0 on. At most ``limit`` tuples of a queue stay
    in memory. A reduced text of up to ``base`` names is sorted in memory, a
    longer one by recursion.
    """
    text = np.ascontiguousarray(text)
    n = len(text)
    if not n:
        return
    symbols = int(text.max()) + 1
    small = _types(text)
    star = small.copy()
    star[1:] &= ~small[:-1]
    star[0] = False
    places = np.flatnonzero(star)
    if len(places):
        # Sort S* substrings by an induction from S* places that are ordered by symbol only.
        rough = places[np.argsort(text[places], kind="stable")]
        ordered = []
        for some, _ in induce(text, small, rough, np.zeros(len(rough), dtype=np.uint16), symbols, 1, limit, folder):
            ordered.append(some[star[some]])
        ordered = np.concatenate(ordered)[::-1]
        end = np.full(n, n, dtype=_number(n))
        end[places[:-1]] = places[1:]
        length = end[ordered] - ordered
        # Neighbours are the same substring if they agree up to and with the next S* place.
        equal = np.zeros(len(ordered), dtype=bool)
        x, y = ordered[:-1], ordered[1:]
        alike = (length[:-1] == length[1:]) & (end[x] < n) & (end[y] < n)
        most = int(length.max()) + 1
        pair = np.flatnonzero(alike)
        agreed = common_prefix(text, x[pair], y[pair], min(most, 65_000)).astype(np.int64)
        equal[1:][pair] = agreed > length[:-1][pair]
        name = np.zeros(n, dtype=_number(n))
        name[ordered] = np.cumsum(~equal) - 1
        reduced = name[places]
        del name, end, length, x, y, alike, pair, agreed, equal
        if int(reduced.max()) + 1 == len(places):
            ranked = ordered
        elif len(reduced) <= base:
            ranked = places[_doubling(reduced)]
        else:
            ranked = places[np.concatenate([p for p, _ in suffixes(reduced, 1, limit, base, folder)])[::-1]]
        common = np.zeros(len(ranked), dtype=np.uint16)
        common[1:] = common_prefix(text, ranked[:-1], ranked[1:], cap)
    else:
        ranked, common = places, np.zeros(0, dtype=np.uint16)
    yield from induce(text, small, ranked, common, symbols, cap, limit, folder)
