"""Removal of byte strings that occur more than once, by column-wise construction of sorted suffixes.

The column-wise construction inserts one symbol per string each round and keeps the strings sorted by the suffix read
so far, with the common prefix of neighbours. Its rounds are as many as the longest string has symbols and each
passes over the collection, so it is not run over whole documents but over short stretches of them:

* Every 200-byte string is assigned to an anchor: the least of its 32-byte grams by hash, the leftmost of equals. The
  choice depends on the string alone, so equal strings have equal anchors. Strings of one document with one anchor are
  neighbours; together they make a stretch of at most 368 bytes around it.
* Stretches whose anchor occurs once hold no repeated string. Equal stretches are found by an aggregate with map-side
  combine; all their strings are repeated.
* Different stretches with one anchor are laid side by side, aligned at the anchor, and the columns are inserted from
  the right. Neighbours in the order of a column that agree for 200 symbols are equal strings. A group of any size is
  processed in tasks of bounded memory: stretches of a very frequent anchor are compared by a digest per string
  instead, which is an aggregate again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare, encoded, mixed, powers, prefix_hashes, row_key
from fieldlens.session import materialized

#: Bytes of a repeated string, of an anchor, and grams that a string has.
LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
#: Columns of aligned stretches: the anchor begins at column WINDOW - 1.
COLUMNS = WINDOW - 1 + LENGTH
MISSING = 256
#: Bits of the filter of repeated anchors, whatever the size of the input; a full filter lets more stretches through.
FILTER_BITS = 1 << 26
PARTS = 16
#: Stretches that are sorted together, and the largest group that is sorted at all.
TOGETHER, SHARE = 16384, 8192


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first and last string start, and anchor hash of every stretch, in text order."""
    n = len(data) - LENGTH + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    sums = prefix_hashes(np.frombuffer(data, dtype=np.uint8))
    grams = len(data) - GRAM + 1
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(len(data))[0][:grams])
    # leading bits of the hash, then the position: the least of a window is its leftmost smallest gram
    key = (h & np.uint64(0xFFFFFFFF80000000)) | np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // WINDOW)
    padded = np.full(blocks * WINDOW, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:grams] = key
    grid = padded.reshape(blocks, WINDOW)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n])
    at = (least & np.uint64(0x7FFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return at[first], first, last, h[at[first]]


def _place(at, first, last):
    return (at << 16) | ((at - first) << 8) | (at - last)


def _unplace(place: int) -> tuple[int, int, int]:
    at = place >> 16
    return at, at - ((place >> 8) & 255), at - (place & 255)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [anchors(d)[3] for d in encoded(b.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64))], names=["h"])


def repeated_filter(base: DataFrame) -> np.ndarray:
    """A bit per hash value, set where an anchor occurs more than once. Its size is fixed."""
    twice = base.select("text").mapInArrow(_hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    names, width = ["part", "bits"], FILTER_BITS // PARTS

    def mark(batches):
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for b in batches:
            bits[_slot(b.column("h").to_numpy().view(np.uint64))] = True
        parts = [(i, np.packbits(bits[i * width : (i + 1) * width]).tobytes()) for i in range(PARTS) if bits[i * width : (i + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=names)

    def unite(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("bits").to_pylist(), strict=True):
                held.setdefault(part, np.zeros(width // 8, dtype=np.uint8))
                held[part] |= np.frombuffer(raw, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())], names=names)

    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in twice.mapInArrow(mark, "part int, bits binary").repartition(PARTS, "part").mapInArrow(unite, "part int, bits binary").collect():
        bits[r["part"] * (width // 8) : (r["part"] + 1) * (width // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def stretches(base: DataFrame, bits: np.ndarray) -> DataFrame:
    """h, c, _id, _th, place: the stretches whose anchor may occur again; c is a digest of the stretch."""
    held = base.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            hs, cs, places, counts = [], [], [], []
            for data in encoded(b.column("text")):
                at, first, last, h = anchors(data)
                slot = _slot(h)
                keep = (held.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                at, first, last = at[keep], first[keep], last[keep]
                hs.append(h[keep])
                cs.append(np.array([xxhash.xxh3_64_intdigest(data[x : y + LENGTH]) for x, y in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64))
                places.append(_place(at, first, last))
                counts.append(len(at))
            join = lambda x, t: np.concatenate([*x, np.zeros(0, dtype=t)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(hs, np.uint64)), pa.array(join(cs, np.uint64)), pa.array(np.repeat(b.column("_id").to_numpy(), counts)),
                 pa.array(np.repeat(b.column("_th").to_numpy(), counts)), pa.array(join(places, np.int64))],
                names=["h", "c", "_id", "_th", "place"],
            )

    return base.select("text", "_id", "_th").mapInArrow(run, "h long, c long, _id long, _th long, place long")


def equal_neighbours(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For aligned strings (one row each, MISSING where a row has no symbol), which of the LENGTH-symbol strings that
    start in column c equal one of another row of the same group. Rows of a group must be together.

    Columns are inserted from the right. ``order`` holds the rows sorted by what has been inserted, ``until`` the
    column up to which a row agrees with the one before it in that order; both are updated by one stable sort on the
    new symbol, the common prefix of new neighbours being the least of those in between.
    """
    rows, columns = symbols.shape
    starts = columns - LENGTH + 1
    repeated = np.zeros((rows, starts), dtype=bool)
    order = np.arange(rows)
    heads = np.concatenate([[True], group[1:] != group[:-1]])
    until = np.where(heads, 0, columns)
    base = group.astype(np.int64) * (MISSING + 1)
    for c in range(columns - 1, -1, -1):
        key = base[order] + symbols[order, c]
        moved = np.argsort(key, kind="stable")
        ranked = key[moved]
        same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
        now = np.full(rows, c)
        i1 = np.flatnonzero(same)
        if len(i1):
            new, old = moved[i1], moved[i1 - 1]
            near = new == old + 1
            now[i1[near]] = until[new[near]]
            if not near.all():
                bounds = np.empty(2 * int((~near).sum()), dtype=np.int64)
                bounds[::2], bounds[1::2] = old[~near] + 1, new[~near] + 1
                now[i1[~near]] = np.minimum.reduceat(np.append(until, columns), bounds)[::2]
        order, until = order[moved], now
        if c < starts:
            hit = np.flatnonzero(until - c >= LENGTH)
            repeated[order[hit], c] = True
            repeated[order[hit - 1], c] = True
    return repeated


def _spans(repeated: np.ndarray, base: int) -> list[tuple[int, int]]:
    """Byte ranges that the marked string starts cover; base is the position of the first one."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    return [(base + int(a), base + int(b) - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_id", "_th", "_from", "_to"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of the stretches that occur once, from groups that come one after another."""
    held: list[tuple] = []

    def close(rows: list[tuple]) -> pa.RecordBatch:
        symbols = np.full((len(rows), COLUMNS), MISSING, dtype=np.int64)
        group = np.zeros(len(rows), dtype=np.int64)
        for i, (h, data, _, _, place, _) in enumerate(rows):
            at, first, _ = _unplace(place)
            left = WINDOW - 1 - (at - first)
            symbols[i, left : left + len(data)] = np.frombuffer(data, dtype=np.uint8)
            group[i] = group[i - 1] + (h != rows[i - 1][0]) if i else 0
        repeated = equal_neighbours(symbols, group)
        out = []
        for i in np.flatnonzero(repeated.any(axis=1)).tolist():
            _, _, key, th, place, once = rows[i]
            if once:
                at, first, last = _unplace(place)
                left = WINDOW - 1 - (at - first)
                # the columns of the row's own strings; the others take in what the row does not have
                out += [(key, th, a, b) for a, b in _spans(repeated[i, left : left + last - first + 1], first)]
        return _ranges(out)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("h", "data", "_id", "_th", "place", "once")), strict=True):
            if len(held) >= TOGETHER - SHARE and held[-1][0] != row[0]:
                yield close(held)
                held = []
            held.append(row)
    if held:
        yield close(held)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data, key, th, wanted in zip(encoded(b.column("text")), *(b.column(c).to_pylist() for c in ("_id", "_th", "wanted")), strict=True):
            for w in wanted:
                _, first, last = _unplace(w["place"])
                rows.append((w["h"], data[first : last + LENGTH], key, th, w["place"], w["once"]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "data", "_id", "_th", "place", "once"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of every string of the stretches of very frequent anchors."""
    for b in batches:
        rows = []
        for data, key, th, place, once in zip(*(b.column(c).to_pylist() for c in ("data", "_id", "_th", "place", "once")), strict=True):
            _, first, last = _unplace(place)
            rows += [(xxhash.xxh3_128_digest(data[i : i + LENGTH]), key, th, first + i, once) for i in range(last - first + 1)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["d", "_id", "_th", "_from", "once"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data, ranges in zip(encoded(b.column("text")), b.column("ranges").to_pylist(), strict=True):
            kept, removed, spans, end = [], 0, 0, 0
            start = 0
            for r in ranges or ():
                a, z = r["_from"], r["_to"]
                if a > end or not spans:
                    kept.append(data[start:a])
                    spans += 1
                    removed += z - a
                    start = end = z
                elif z > end:
                    removed += z - end
                    start = end = z
            kept.append(data[start:])
            rows.append((len(data), removed, spans, b"".join(kept)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row.

    Each byte covered by a 200-byte string that also starts elsewhere, in any row, goes; strings are judged on the
    input, overlaps count, matches never cross rows. Null text is empty; texts under 200 bytes stay whole. Rows
    repeated under one doc_id are rows of their own, so their long texts go in each. A null doc_id is passed on.
    Other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    found = materialized(stretches(base, repeated_filter(base)), "stretches")
    each = materialized(
        found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_th", "place")).alias("k")), "stretch-kinds"
    )
    whole = found.join(each.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi").select(
        "_id", "_th",
        (F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)).alias("_from"),
        (F.shiftright("place", 16) - F.col("place").bitwiseAND(255) + LENGTH).alias("_to"),
    )
    kinds = each.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1")
    differ = each.join(kinds, "h").select("k.*", "h", (F.col("n") == 1).alias("once"), (F.col("m") > SHARE).alias("hot"))

    def fetched(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy(F.col("_id").alias("_wid"), F.col("_th").alias("_wth")).agg(F.collect_list(F.struct("h", "place", "once")).alias("wanted"))
        texts = base.join(wanted, (F.col("_id") == F.col("_wid")) & (F.col("_th") == F.col("_wth")))
        # rows repeated with one id and text lend it once; doc_id is only kept so that all reads of the texts are one
        return texts.select("text", "_id", "_th", "wanted", "doc_id").mapInArrow(
            _fetched, "h long, data binary, _id long, _th long, place long, once boolean"
        )

    sorted_ranges = (
        fetched(differ.filter("not hot")).repartition("h").sortWithinPartitions("h")
        .mapInArrow(_sorted_groups, "_id long, _th long, _from long, _to long")
    )
    strings = fetched(differ.filter("hot")).mapInArrow(_digests, "d binary, _id long, _th long, _from long, once boolean")
    strings = strings.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("d").alias("_rd")).join(
        strings, F.col("_rd") == F.col("d")
    ).filter("once").select("_id", "_th", "_from", (F.col("_from") + LENGTH).alias("_to"))
    ranges = (
        whole.unionByName(sorted_ranges).unionByName(strings)
        .groupBy(F.col("_id").alias("_rid"), F.col("_th").alias("_rth")).agg(F.array_sort(F.collect_set(F.struct("_from", "_to"))).alias("ranges"))
    )
    return base.join(ranges, (F.col("_id") == F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left").select(
        "doc_id", "text", "ranges"
    ).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
