"""Periodic runs of words inside a document, found by uniting suffix classes from the longest common prefix down.

Two word positions i < j of one document belong to one class at level t when the words from i and from j agree for t
words. Edges between neighbours of the suffix array, taken by falling common prefix, unite classes as Kruskal's
algorithm does; every class is an ordered set of positions. Where a merge makes i and j neighbours at distance d, their
common prefix is the level l exactly, so ``[i, j + l)`` has period d and no word after it goes on. A smaller period
would have put a position of the class between i and j, so d is the smallest; if the words before i and j differ, the
stretch begins there, which reports each run once.

In a run as asked for here, positions one period apart agree for at least LENGTH - 1 words. Words outside every
repeated stretch of that length are in no class and are left out before the suffixes are sorted; they are stood in for
by symbols that occur once, so common prefixes stay what they are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import encoded, mixed, prepare, slices

#: A run has at least LENGTH words and TIMES periods.
LENGTH, TIMES = 6, 4
#: Bytes of text that are searched together.
TOGETHER = 2 << 20
#: Positions in one block of an ordered set.
BLOCK = 512
Change = Callable[[int | None, list[bytes]], list[bytes]]


class Positions:
    """An ordered set of word positions in blocks, so that an insertion moves a block and not the set."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, position: int):
        self.blocks, self.tops, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int, int]:
        """Inserts a position; the one before it and the one after it, -1 where there is none."""
        at = bisect_left(self.tops, position)
        last = at == len(self.tops)
        at -= last
        block = self.blocks[at]
        place = bisect_left(block, position)
        before = block[place - 1] if place else self.tops[at - 1] if at else -1
        after = -1 if last else block[place]
        if last:
            block.append(position)
            self.tops[at] = position
        else:
            insort(block, position, place, place)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.tops[at : at + 1] = [block[half - 1], block[-1]]
        return before, after


def suffixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``x``, whose last symbol occurs once, and the common prefix of each suffix with the next one.

    Prefix doubling; a position whose prefix is unique keeps its place and is not sorted again. ``levels[k]`` holds
    the first place of every position's class by its first 2**k symbols.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    heads = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        shared = np.flatnonzero(~(heads & np.append(heads[1:], True)))
        if not len(shared):
            break
        held = order[shared]
        key = rank[held] * (n + 1) + rank[np.minimum(held + width, n)] + 1
        moved = np.argsort(key, kind="stable")
        order[shared] = held = held[moved]
        key = key[moved]
        heads[shared] |= np.concatenate([[True], key[1:] != key[:-1]])
        firsts = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        rank[held] = firsts[shared]
        width *= 2
        levels.append(rank.astype(np.int32))
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + common, n)] == levels[k][np.minimum(b + common, n)]
        common += same.astype(np.int64) << k
    return order, common


def joined_neighbours(order: np.ndarray, common: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(i, j, level) of positions that a merge at ``level`` makes neighbours, where the stretch from i holds at least
    ``times`` periods j - i."""
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found = []

    def root(v: int) -> int:
        top = v
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    for a, b, level in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist(), strict=True):
        a, b = root(a), root(b)
        large, small = classes.pop(a, None) or Positions(a), classes.pop(b, None) or Positions(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        parent[b] = a
        widest = level // (times - 1)
        own = list(small)
        previous = -1
        for k, p in enumerate(own):
            before, after = large.add(p)
            if before >= 0 and before != previous and p - before <= widest:
                found.append((before, p, level))
            if after >= 0 and after - p <= widest and (k + 1 == len(own) or own[k + 1] > after):
                found.append((p, after, level))
            previous = p
        classes[a] = large
    return found


def runs_of(symbols: np.ndarray, text: np.ndarray, length: int = LENGTH, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period), sorted by start and period, of the runs in ``symbols``; those of different
    ``text`` (a number that does not fall along the array) never run on."""
    none = np.zeros((0, 3), dtype=np.int64)
    # the least common prefix that two positions one period apart have in any run
    gram = min(max(length - d, (times - 1) * d) for d in range(1, length + 1))
    n = len(symbols)
    if n <= gram:
        return none
    # places whose next words may occur again in their text: a table of counts first, then exact
    starts = np.flatnonzero(text[: n - gram + 1] == text[gram - 1 :])
    h = text[starts].astype(np.uint64) + np.uint64(1)
    for k in range(gram):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + symbols[starts + k].astype(np.uint64))
    slot = (h & np.uint64((1 << max(12, int(n).bit_length() + 2)) - 1)).astype(np.int64)
    starts = starts[np.bincount(slot)[slot] > 1]
    code = text[starts]
    for k in range(gram):
        _, code = np.unique(code * (int(symbols.max()) + 1) + symbols[starts + k], return_inverse=True)
    starts = starts[np.bincount(code, minlength=1)[code] > 1] if len(starts) else starts
    if not len(starts):
        return none
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + gram, -1)
    at = np.flatnonzero(np.cumsum(covered)[:n] > 0)
    _, named = np.unique(text[at] * (int(symbols.max()) + 1) + symbols[at], return_inverse=True)
    # a symbol of its own before the first stretch, between two and after the last
    cut = np.flatnonzero((np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])) + 1
    x = np.insert(named.astype(np.int64), cut, -1)
    back = np.insert(at, cut, -1)
    x, back = np.concatenate([[-1], x, [-1]]), np.concatenate([[-1], back, [-1]])
    apart = np.flatnonzero(x < 0)
    x[apart] = int(named.max()) + 1 + np.arange(len(apart))
    order, common = suffixes(x)
    seeds = np.array(joined_neighbours(order, common, gram, times), dtype=np.int64).reshape(-1, 3)
    i, j, level = seeds.T
    seeds = seeds[(x[i - 1] != x[j - 1]) & (j - i + level >= np.maximum(length, times * (j - i)))]
    i, j, level = seeds.T
    found = np.stack([back[i], j - i + level, j - i], axis=1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """The run with the greatest length by period, exactly; of equals the first, then the one of smallest period."""
    share = runs[:, 1] / runs[:, 2]
    near = runs[share >= share.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A loop at the end of every tenth text, by crc32 of its doc_id in decimal; without an id the words stay."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    a = h // 10 % len(words)
    period = 1 + (len(words) - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + i % period] for i in range(len(words) - a)]


FIELDS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, kept binary"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, in words, by start and period), best (the run of greatest
    length by period, null without runs) and kept (UTF-8: the words in no run after its first period, parted by one
    space) for every row.

    Words are what ASCII white space parts, in the whole text; ``change`` may turn the words of a row into others, given its doc_id.
    A row is searched on its own: null, empty and blank texts have no words and no runs, repeated rows give repeated
    results, a null doc_id is passed on, other columns are ignored, an empty table gives an empty result. There is no
    shuffle; a task holds one batch of texts, or one text that is longer, at about 300 bytes a word that recurs.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, data = b.column("doc_id").to_pylist(), encoded(b.column("text"))
            for first, last in slices(data, TOGETHER):
                yield _searched(ids[first:last], data[first:last], change)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FIELDS)


def _searched(ids: list[int | None], data: list[bytes], change: Change | None) -> pa.RecordBatch:
    words = [d.split() for d in data]
    if change is not None:
        words = [change(i, w) for i, w in zip(ids, words, strict=True)]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    table: dict[bytes, int] = {}
    symbols = np.fromiter((table.setdefault(w, len(table)) for own in words for w in own), dtype=np.int64, count=int(sizes.sum()))
    runs = runs_of(symbols, np.repeat(np.arange(len(words)), sizes))
    gone = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(gone)[:-1] == 0
    edges = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
    kept, best = [], []
    for k, own in enumerate(words):
        start = int(ends[k] - sizes[k])
        mine = runs[edges[k] : edges[k + 1]]
        mine[:, 0] -= start
        if len(mine):
            own = [own[i] for i in np.flatnonzero(stays[start : ends[k]]).tolist()]
        kept.append(b" ".join(own))
        best.append(dict(zip(("start", "length", "period"), strongest(mine), strict=True)) if len(mine) else None)
    listed = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(RUN))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), listed),
         pa.array(best, RUN), pa.array(kept, pa.binary())],
        names=["doc_id", "n_words", "runs", "best", "kept"],
    )
