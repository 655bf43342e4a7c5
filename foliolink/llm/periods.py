"""Runs (maximal repetitions) in the word sequences of texts, from Lyndon arrays.

The first phase of a suffix sorter by grouping gives each position its longest Lyndon word: groups
of positions with equal words are taken from the greatest down, and every block before a
stretch of equal blocks takes them up, which splits its own group. Every run has a Lyndon root
under the order of words or the reverse one; extending each root to both sides by longest
common extensions gives the runs.

Many texts go through the phases side by side, each step on flat arrays of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import ranges

#: Bytes of text that are taken, words that are read, and words in which runs are looked for, at a time.
TEXTS, SLICE = 1 << 23, 1 << 19
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def lyndon_lengths(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position of the sequences ``symbols[bounds[k]:bounds[k + 1]]``.

    Each step takes the greatest group left of every sequence. Sorted places keep a group
    together: those of its positions that take blocks up move to the group's end, ordered by how many.
    """
    sizes, n = np.diff(bounds), len(symbols)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = n + len(sizes)  # one place after each sequence that no group has
    order = np.lexsort((symbols, owner))
    at = order + owner[order]  # the sorted places
    place = np.zeros(total, np.int64)
    place[at] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbols[order][1:] != symbols[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    starts = np.flatnonzero(fresh)
    group = np.full(total, -1, np.int64)
    group[at] = np.repeat(starts, np.diff(np.append(starts, n)))
    end = np.zeros(n + 1, np.int64)
    end[starts] = np.append(starts[1:], n)
    length = np.ones(total, np.int64)
    before = np.arange(-1, total - 1)  # the block that ends where this one begins
    moved = np.zeros(total, bool)

    low, high = bounds[:-1][sizes > 0], bounds[1:][sizes > 0]
    while len(high):
        greatest = group[at[high - 1]]
        members = np.sort(at[_ranges(greatest, high - greatest)])
        mine, previous = group[members], before[members]
        head = np.flatnonzero(group[previous] != mine)
        many = np.diff(np.append(head, len(members)))
        first, taker = members[head], previous[head]
        one = length[first]
        takes = group[taker] >= 0
        before[(first + many * one)[~takes]] = total - 1
        high = greatest
        left = high > low
        low, high = low[left], high[left]
        if not takes.any():
            continue
        taker, many, one = taker[takes], many[takes], one[takes]
        length[taker] += many * one
        before[taker + length[taker]] = taker

        own = group[taker]
        sort = np.argsort((own << 32) + many)
        taker, many, own = taker[sort], many[sort], own[sort]
        lead = np.flatnonzero(np.diff(own, prepend=-1))
        count = np.diff(np.append(lead, len(own)))
        cut = end[own[lead]] - count
        target = _ranges(cut, count)
        source = place[taker]
        there = at[target]
        moved[taker] = True
        displaced, vacated = there[~moved[there]], source[source < np.repeat(cut, count)]
        moved[taker] = False
        at[vacated], place[displaced] = displaced, vacated
        at[target], place[taker] = taker, target
        new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(many, prepend=-1) != 0))
        count = np.diff(np.append(new, len(own)))
        end[own[lead]] = cut
        end[target[new]] = target[new] + count
        group[taker] = np.repeat(target[new], count)
    return length[np.arange(n) + owner]


class Extensions:
    """Longest common extensions within sequences, from names of all stretches of 1, 2, 4, ... symbols (equal name: equal stretch)."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        n = len(symbols)
        self.low, self.high = (np.append(np.repeat(b, np.diff(bounds)), b[-1]) for b in (bounds[:-1], bounds[1:]))
        self.names = [np.append(symbols, -1)]
        whole = np.arange(n)
        width = 1
        while True:
            whole = whole[whole + 2 * width <= self.high[whole]]
            last = self.names[-1]
            whole = whole[last[whole + width] >= 0]
            values, name, times = np.unique(last[whole] * (n + 1) + last[whole + width], return_inverse=True, return_counts=True)
            if len(values) == len(whole):  # no stretch of this width occurs twice
                break
            level = np.full(n + 1, -1, np.int64)
            level[whole] = name
            self.names.append(level)
            # A stretch that occurs once has no equal wider one either.
            whole = whole[times[name] > 1]
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the symbols from ``a`` and those from ``b > a`` are the same."""
        far, high = np.zeros(len(a), np.int64), self.high[a]
        for k in range(len(self.names) - 1, -1, -1):
            x, y = np.minimum(a + far, len(self.low) - 1), np.minimum(b + far, len(self.low) - 1)
            name = self.names[k][x]
            far[(name >= 0) & (name == self.names[k][y]) & (b + far + (1 << k) <= high)] += 1 << k
        return far

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the symbols before ``a`` and those before ``b > a`` are the same."""
        far, low = np.zeros(len(a), np.int64), self.low[a]
        for k in range(len(self.names) - 1, -1, -1):
            x, y = a - far - (1 << k), b - far - (1 << k)
            inside = x >= low
            name = self.names[k][np.maximum(x, 0)]
            far[inside & (name >= 0) & (name == self.names[k][np.maximum(y, 0)])] += 1 << k
        return far


def runs_of(symbols: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """All runs of ``least`` symbols or more in the sequences, as rows ``start, length, period`` with starts in ``symbols``."""
    symbols, bounds = symbols.astype(np.int64), bounds.astype(np.int64)
    n = len(symbols)
    if not n:
        return np.empty((0, 3), np.int64)
    _, symbols = np.unique(symbols, return_inverse=True)
    # Both orders go through the groups side by side.
    lengths = lyndon_lengths(np.concatenate([symbols, symbols.max() - symbols]), np.concatenate([bounds, bounds[1:] + n]))
    root, period = np.tile(np.arange(n), 2), lengths
    low, high = (np.tile(np.repeat(b, np.diff(bounds)), 2) for b in (bounds[:-1], bounds[1:]))
    after = root + period
    # The root's run goes on for a symbol at least, to the right or to the left.
    goes_on = (after < high) & (symbols[root] == symbols[np.minimum(after, n - 1)])
    goes_on |= (root > low) & (symbols[root - 1] == symbols[after - 1])
    goes_on &= np.maximum(least, 2 * period) <= high - low
    root, period = root[goes_on], period[goes_on]
    root, period = np.unique(np.stack([root, period]), axis=1)
    reach = Extensions(symbols, bounds)
    left, right = reach.left(root, root + period), reach.right(root, root + period)
    length = left + period + right
    found = length >= np.maximum(least, 2 * period)
    return np.unique(np.stack([root - left, length, period], axis=1)[found], axis=0)


def suspects(symbols: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the stretches that hold all runs of ``least`` symbols or more.

    A run of period q and length at least max(least, 2 q) is covered by stretches of
    ``least // 2`` symbols that come again q further on; so what no such repeated stretch
    covers is no part of a run. Stretches count as equal by hash: a collision keeps more.
    """
    width = max(1, least // 2)
    starts, sizes = bounds[:-1], np.diff(bounds)
    for round_ in range(3):
        keep = sizes >= least
        starts, sizes = starts[keep], sizes[keep]
        if not len(starts):
            break
        total = int(sizes.sum())
        place = _ranges(starts, sizes)
        own = symbols[place].astype(np.uint64)
        unit = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        windows = total - width + 1
        h = unit[:windows] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(width):
            h = (h ^ own[k : k + windows]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        inside = np.flatnonzero(unit[:windows] == unit[width - 1 :])
        h = h[inside]
        bits = max(10, int(total).bit_length() + 2)
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        again = np.bincount(slot, minlength=1 << bits)[slot] > 1
        inside, h = inside[again], h[again]
        order = np.argsort(h)
        equal = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        inside = inside[twice]
        change = np.bincount(inside, minlength=total + 1) - np.bincount(inside + width, minlength=total + 1)
        covered = np.cumsum(change)[:total] > 0
        edge = np.ones(total, bool)
        edge[1:] = unit[1:] != unit[:-1]
        begins = covered & (edge | ~np.roll(covered, 1))
        ends = covered & np.roll(edge | ~covered, -1)
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        before = int(sizes.sum())
        starts, sizes = place[first], last - first + 1
        if int(sizes.sum()) > 0.9 * before:
            break
    keep = sizes >= least
    return starts[keep], sizes[keep]


def runs_in_texts(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the text of each run; the runs ``start, length, period``, by text, start and period."""
    counts: list[int] = []
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # symbols, sizes, text, offset

    def read(rows: list[list[bytes]], base: int) -> None:
        numbers: dict[bytes, int] = {}
        sizes = np.array([len(r) for r in rows], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for r in rows for w in r), np.int64, int(bounds[-1]))
        start, size = suspects(symbols, bounds, least)
        text = np.searchsorted(bounds, start, side="right") - 1
        kept.append((symbols[_ranges(start, size)], size, text + base, start - bounds[text]))

    rows, n = [], 0
    for text in texts:
        rows.append(text.split())
        counts.append(len(rows[-1]))
        n += counts[-1]
        if n >= SLICE:
            read(rows, len(counts) - len(rows))
            rows, n = [], 0
    read(rows, len(counts) - len(rows))

    symbols, sizes, text, offset = map(np.concatenate, zip(*kept))
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")  # sequences of like length go side by side
    part = np.cumsum(sizes[order]) // SLICE
    owners, runs = [np.empty(0, np.int64)], [np.empty((0, 3), np.int64)]
    for chosen in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else ():
        bounds = np.concatenate([[0], np.cumsum(sizes[chosen])])
        found = runs_of(symbols[_ranges(begin[chosen], sizes[chosen])], bounds, least)
        where = np.searchsorted(bounds, found[:, 0], side="right") - 1
        found[:, 0] += offset[chosen][where] - bounds[where]
        owners.append(text[chosen][where])
        runs.append(found)
    owner, run = np.concatenate(owners), np.concatenate(runs)
    order = np.lexsort((run[:, 2], run[:, 0], owner))
    return np.array(counts, np.int64), owner[order], run[order]


def collapse(text: bytes, runs: np.ndarray) -> bytes:
    """The text's words joined by a space, without those that a run has after its first period."""
    words = text.split()
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text without a run's repeats.

    A run is a stretch of consecutive words with smallest period q, at least ``least`` (2 or
    more) and 2 q words long, that no neighbouring word extends. Words are separated by ASCII
    white space. A null, empty or blank text has no words, no runs and an empty ``collapsed``.
    Columns of those names are replaced; repeated rows are treated each. A text is one row and
    is looked at whole, in memory that grows with the longest one.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    @F.arrow_udf(f"struct<n_words: bigint, runs: {RUNS}, collapsed: string>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for low, high in ranges(pc.binary_length(part).to_numpy(), TEXTS):
                texts = part[low:high].cast(pa.binary()).to_pylist()
                counts, owner, runs = runs_in_texts(texts, least)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                fields = [pa.array(runs[:, k], pa.int64()) for k in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                short = pa.array([collapse(t, runs[a:b]) for t, a, b in zip(texts, bounds, bounds[1:])], pa.binary()).cast(pa.string())
                yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, short], ["n_words", "runs", "collapsed"])

    found = of(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    name = "_found"
    while name in docs.columns:
        name = "_" + name
    whole = docs.withColumn(name, found)
    return whole.withColumns({c: F.col(name)[c] for c in ("n_words", "runs", "collapsed")}).drop(name)
