"""Near duplicates: word n-gram sets joined by Jaccard similarity with a count-vector R-tree.

1. Every text becomes its set of shingles (48-bit hashes), its size, a digest of the set and a count vector: the
   shingles are hashed into groups, and how many fall into each group is a point in as many dimensions.
2. The R-tree is split by shingles: sets that reach the threshold share one of their rarest shingles (as many as the
   threshold allows to differ, plus one), and the sets that share one form a block with a tree of its own. Rare is
   judged by a sketch of fixed size over all sets, so that shingles of common passages come last.
3. In the tree the sum of the coordinate-wise minima bounds the overlap of two sets, the sum over the upper corner of a
   box that of a set and the box. One more coordinate is how many shingles a set has from the block's on, in the order
   of rarity: in the block of the first shingle that two sets share, they share no more than the smaller such number.
   Sets that have a template in common but too little else are ruled out by it at the root.
4. First every set asks the tree of the sets before it in its block for the one of the highest bound; these pairs are
   verified exactly. A block of near copies is one component after one comparison per copy.
5. Then the trees of the blocks that still hold different components are searched for every pair across components that
   is not ruled out, and these are verified too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare, encoded, keep_rows, mixed, powers, prefix_hashes, row_key, slices
from fieldlens.llm.components import components
from fieldlens.session import materialized

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Groups of a count vector; cells of the rarity sketch, whatever the size of the input.
GROUPS, CELLS = 256, 1 << 18
#: Members that one task compares at once; larger blocks and stars are dealt to several tasks.
SHARE = 4096
#: Entries of a leaf of the R-tree, and boxes below a node.
LEAF = 16
#: Boxes of a level that a search for the nearest set goes into.
BEAM = 4
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_TURNS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(SHINGLE)]


def shingle_sets(data: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (already lower case), 48 bits each."""
    buffer = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    blank = _SPACES[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = prefix_hashes(buffer)
    power, _ = powers(len(buffer) + 1)
    words = mixed((sums[ends] - sums[starts]) * power[starts] + (ends - starts).astype(np.uint64) * _TURNS[0])
    offsets = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    cuts = np.searchsorted(starts, offsets)
    n = len(words)
    joined = np.zeros(max(0, n - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        joined += words[k : k + len(joined)] * _TURNS[k]
    joined = mixed(joined) >> np.uint64(16)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(joined[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * np.array(_TURNS[: b - a])).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short], dtype=np.uint64)) >> np.uint64(16))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes], list[int | None]]]:
    """Slices of the batches with the sets of their texts, packed, and the digests; no digest for an empty set."""
    for batch in batches:
        data = [d.lower() for d in encoded(batch.column("text"))]
        for a, b in slices(data):
            sets = shingle_sets(data[a:b])
            raw = [packed(s) for s in sets]
            yield batch.slice(a, b - a), sets, raw, [xxhash.xxh3_64_intdigest(r) - (1 << 63) if r else None for r in raw]


#: The cells of the sketch travel in so many parts.
PARTS = 16


def point(tokens: np.ndarray) -> bytes | None:
    """The count vector of a set: how many of its shingles fall into each group; a byte a group where that is enough."""
    if not len(tokens):
        return None
    counts = np.bincount(mixed(tokens) >> np.uint64(56), minlength=GROUPS)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def vectors(raw: list[bytes]) -> np.ndarray:
    if all(len(r) == GROUPS for r in raw):
        return np.frombuffer(b"".join(raw), dtype="u1").reshape(-1, GROUPS)
    return np.stack([np.frombuffer(r, dtype="u1" if len(r) == GROUPS else "<u4").astype("<u4") for r in raw])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest per row; at the end of the partition, how many of its sets have a shingle in each cell."""
    names = ["doc_id", "_id", "_th", "n", "sid", "vec", "part", "cells"]
    total = np.zeros(CELLS, dtype=np.int64)
    for b, sets, _, sids in _each_set(batches):
        tokens = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
        total += np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("_id"), b.column("_th"), pa.array(map(len, sets), pa.int64()), pa.array(sids, pa.int64()),
             pa.array(map(point, sets), pa.binary()), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names,
        )
    if total.any():
        cut = [c.tobytes() for c in np.split(total, PARTS)]
        none = pa.nulls(PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(cut, pa.binary())], names=names)


def rarity(counted: DataFrame) -> np.ndarray:
    """How many sets have a shingle in each cell; CELLS numbers in all, added up in tasks."""
    width = CELLS // PARTS

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                totals.setdefault(part, np.zeros(width, dtype=np.int64))
                totals[part] += np.frombuffer(raw, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["part", "cells"]
        )

    cells = np.zeros(CELLS, dtype=np.int64)
    for r in counted.repartition(PARTS, "part").mapInArrow(add, "part int, cells binary").collect():
        cells[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["cells"], dtype=np.int64)
    return cells


def rare_shingles(texts: DataFrame, cells: np.ndarray) -> DataFrame:
    """t, salt, salts, sid, rest: the rarest shingles of each set, as many as cannot all be missing in a linked set.

    The order (sketch, hash) is the same for all sets and is what ``t`` holds; ``rest`` counts the shingles of the set
    from ``t`` on. ``salts`` says how many parts the block of a common shingle is dealt to. A set that a partition has several times is reported once.
    """
    held = texts.sparkSession.sparkContext.broadcast(cells)

    def pick(batches):
        seen: set[int | None] = {None}
        for _, sets, _, found in _each_set(batches):
            ts, counts, sids, rests = [], [], [], []
            for sid, tokens in zip(found, sets, strict=True):
                if sid in seen:
                    continue
                seen.add(sid)
                n = len(tokens)
                most = n + (-PERCENT * n // 100) + 1
                common = held.value[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]
                order = (np.minimum(common, 32767).astype(np.int64) << 48) | tokens.astype(np.int64)
                chosen = np.argpartition(order, most - 1)[:most] if most < n else np.arange(n)
                chosen = chosen[np.argsort(order[chosen])]
                ts.append(order[chosen])
                counts.append(common[chosen])
                rests.append(n - np.arange(len(chosen)))
                sids.append(np.full(len(chosen), sid, dtype=np.int64))
            join = lambda x: np.concatenate([*x, np.zeros(0, dtype=np.int64)])
            sid, salts = join(sids), np.maximum(1, -(-join(counts) // (16 * SHARE)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(ts)), pa.array((sid % salts).astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(sid), pa.array(join(rests).astype(np.int32))],
                names=["t", "salt", "salts", "sid", "rest"],
            )

    return texts.select("text").mapInArrow(pick, "t long, salt int, salts int, sid long, rest int")


def full_sets(base: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, tokens of the sets named in ``wanted``, from one text each."""
    lenders = rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("_id", "_th")).alias("_k"))
    lenders = lenders.select(F.col("_k._id").alias("_lid"), F.col("_k._th").alias("_lth"))
    texts = base.join(lenders, (F.col("_id") == F.col("_lid")) & (F.col("_th") == F.col("_lth")), "left_semi")

    def spell(batches):
        seen: set[int | None] = {None}
        for _, sets, raw, sids in _each_set(batches):
            fresh = []
            for i, sid in enumerate(sids):
                if sid not in seen:  # rows repeated under one doc_id lie in one partition
                    seen.add(sid)
                    fresh.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sids[i] for i in fresh], pa.int64()), pa.array([raw[i] for i in fresh], pa.binary())], names=["sid", "tokens"]
            )

    return texts.select("text").mapInArrow(spell, "sid long, tokens binary")


def possible(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and count vectors do not rule out."""
    side = lambda c: points.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("vec").alias(f"v_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))

    def bound(batches):
        for b in batches:
            if b.num_rows:
                vec = [vectors(b.column(c).to_pylist()) for c in ("v_a", "v_b")]
                size = [b.column(c).to_numpy() for c in ("n_a", "n_b")]
                keep = CountTree.margin(vec[0], vec[1], size[0], size[1], size[0], size[1]) >= 0
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(bound, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Every set travels once per pair, its star's centre ``b`` once
    per SHARE pairs; the stars of a frequent centre are dealt to several tasks."""
    stars = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("salts"))
    spokes = (
        pairs.join(stars, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
        .join(sets.select(F.col("sid").alias("a"), "tokens"), "a").select("b", "salt", "a", "tokens")
    )
    hubs = (
        stars.join(sets.select(F.col("sid").alias("b"), "tokens"), "b")
        .select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "tokens")
    )

    def compare(batches):
        at, hub = None, None
        for batch in batches:
            out_a, out_b = [], []
            for b, salt, a, raw in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "a", "tokens")), strict=True):
                if a is None:
                    at, hub = (b, salt), unpacked(raw)
                elif at == (b, salt):
                    n = len(raw) // 6
                    least, most = (n, len(hub)) if n < len(hub) else (len(hub), n)
                    if 100 * least >= PERCENT * most:
                        # both are sorted; a shared shingle has its twin where it would be put
                        other = unpacked(raw)
                        place = np.searchsorted(hub, other)
                        place[place == len(hub)] = 0
                        both = int((hub[place] == other).sum())
                        if 100 * both >= PERCENT * (n + len(hub) - both):
                            out_a.append(a), out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    laid = spokes.unionByName(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return laid.mapInArrow(compare, "a long, b long")


class CountTree:
    """R-tree over count vectors, sizes and rests: leaves packed in the order of size, rest and first coordinates,
    boxes of boxes above. A box keeps its upper corner, its smallest size and its largest rest."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rests: np.ndarray):
        self.order = np.lexsort((*(points[:, k] for k in range(3)), rests, sizes))
        self.levels = [(points[self.order], sizes[self.order], rests[self.order])]
        while len(self.levels[-1][0]) > 1:
            high, low, rest = self.levels[-1]
            edges = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, edges), np.minimum.reduceat(low, edges), np.maximum.reduceat(rest, edges)))

    def _margins(self, level: int, who: np.ndarray, box: np.ndarray, points: np.ndarray, sizes: np.ndarray, rests: np.ndarray) -> np.ndarray:
        high, low, rest = self.levels[level]
        return self.margin(points[who], high[box], sizes[who], low[box], rests[who], rest[box])

    def _below(self, level: int, who: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        child = (box[:, None] * LEAF + np.arange(LEAF)).ravel()
        inside = child < len(self.levels[level - 1][0])
        return np.repeat(who, LEAF)[inside], child[inside]

    def near(self, points: np.ndarray, sizes: np.ndarray, rests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (query, entry) that the bounds do not rule out."""
        step = max(1, min(256, (1 << 20) // len(self.order)))
        for q in range(0, len(points), step):
            asked = points[q : q + step], sizes[q : q + step], rests[q : q + step]
            who, box = np.arange(len(asked[0])), np.zeros(len(asked[0]), dtype=np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                keep = self._margins(level, who, box, *asked) >= 0
                who, box = who[keep], box[keep]
                if level:
                    who, box = self._below(level, who, box)
            yield who + q, self.order[box]

    def nearest(self, points: np.ndarray, sizes: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, entry), one a query at most: an entry of high bound, by descent into the BEAM best boxes.
        In trees of at most BEAM * LEAF entries it is the highest. Queries that the bounds rule out have none."""
        asks, entries = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for q in range(0, len(points), 256):
            asked = points[q : q + 256], sizes[q : q + 256], rests[q : q + 256]
            who, box = np.arange(len(asked[0])), np.zeros(len(asked[0]), dtype=np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                value = self._margins(level, who, box, *asked)
                best = np.lexsort((box, -value, who))
                best = best[value[best] >= 0]
                place = np.arange(len(best)) - np.searchsorted(who[best], who[best])
                best = best[place < (BEAM if level else 1)]
                who, box = who[best], box[best]
                if level:
                    who, box = self._below(level, who, box)
            asks.append(who + q), entries.append(self.order[box])
        return np.concatenate(asks), np.concatenate(entries)

    @staticmethod
    def margin(a: np.ndarray, high: np.ndarray, size: np.ndarray, low: np.ndarray, rest: np.ndarray, most: np.ndarray) -> np.ndarray:
        """By how much the bound of the overlap passes what the threshold asks for; negative rules out."""
        # intersection >= PERCENT / (100 + PERCENT) * both sizes
        out = (100 + PERCENT) * np.minimum(rest, most).astype(np.int64) - PERCENT * (size + low)
        still = np.flatnonzero(out >= 0)
        for i in range(0, len(still), 1 << 12):
            j = still[i : i + (1 << 12)]
            overlap = np.minimum(a[j], high[j]).sum(axis=1, dtype=np.int64)
            out[j] = np.minimum(out[j], (100 + PERCENT) * overlap - PERCENT * (size[j] + low[j]))
        return out


def _each_block(members: DataFrame, columns: list[str], order: list, join_block) -> DataFrame:
    """a, b: what ``join_block`` yields for the columns of every block (t, salt), each set once, in the given order."""

    def run(batches):
        held: list[tuple] = []
        known: set[int] = set()
        at = None

        def close():
            if len(held) > 1:
                own = dict(zip(columns, zip(*held, strict=True), strict=True))
                own = {c: vectors(v) if c == "vec" else np.array(v) for c, v in own.items()}
                for a, b in join_block(own):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held.clear(), known.clear()

        for batch in batches:
            for t, salt, *row in zip(*(batch.column(c).to_pylist() for c in ("t", "salt", *columns)), strict=True):
                if (t, salt) != at:
                    yield from close()
                    at = (t, salt)
                if row[0] not in known:
                    known.add(row[0])
                    held.append(tuple(row))
        yield from close()

    laid = members.select("t", "salt", *columns).repartition("t", "salt").sortWithinPartitions("t", "salt", *order)
    return laid.mapInArrow(run, "a long, b long")


def nearest_pairs(members: DataFrame) -> DataFrame:
    """a, b: for every set of a block (t, salt) one before it, by ``_d`` and then ``sid``, that its R-tree finds near.

    The trees hold the first 1, 2, 4, ... sets of the block, and each is asked by as many as it holds, the next ones.
    """

    def join_block(own: dict[str, np.ndarray]):
        sid, size, rest, vec = own["sid"], own["n"], own["rest"], own["vec"]
        held = 1
        while held < len(sid):
            tree, asking = CountTree(vec[:held], size[:held], rest[:held]), slice(held, 2 * held)
            q, e = tree.nearest(vec[asking], size[asking], rest[asking])
            yield sid[asking][q], sid[e]
            held *= 2

    return _each_block(members, ["sid", "n", "rest", "vec", "_d"], [F.desc("_d"), "sid"], join_block)


def tree_pairs(members: DataFrame) -> DataFrame:
    """a, b: pairs of a block (t, salt) in different components that the R-tree cannot rule out; a is a query."""

    def join_block(own: dict[str, np.ndarray]):
        sid, ask, root = own["sid"], own["ask"], own["root"]
        tree = CountTree(own["vec"], own["n"], own["rest"])
        asking = np.flatnonzero(ask)
        for q, e in tree.near(own["vec"][asking], own["n"][asking], own["rest"][asking]):
            q = asking[q]
            # of two queries one asks
            keep = (root[q] != root[e]) & ((sid[q] > sid[e]) | ~ask[e])
            yield sid[q[keep]], sid[e[keep]]

    return _each_block(members, ["sid", "ask", "root", "n", "rest", "vec"], ["sid", F.desc("ask")], join_block)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; component_id is the smallest doc_id reachable by links.

    Words are split at ASCII white space after lower-casing A-Z. Texts with fewer words than a shingle have one
    shingle, their whole sequence; null and blank texts have none and are linked with nothing, not even each other.
    Equal sets are linked. Rows repeated under one doc_id are linked through it only if their sets are. A null
    doc_id never becomes a component_id unless all of the component are null. Other columns are ignored; an empty
    table gives an empty result.
    """
    named = _classes(docs)
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _th, n, sid, root: every row with its set and the name of its component; both null without a set."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    counted = materialized(
        base.mapInArrow(_sizes, "doc_id long, _id long, _th long, n long, sid long, vec binary, part int, cells binary"), "set-sizes"
    )
    rows = counted.filter("part is null").drop("part", "cells")
    cells = rarity(counted.filter("part is not null").select("part", "cells"))
    blocks = rare_shingles(base, cells).repartition("t", "salt")
    block = Window.partitionBy("t", "salt")
    shared = materialized(
        blocks.withColumn("_first", F.min("sid").over(block)).withColumn("_last", F.max("sid").over(block))
        .withColumn("_n", F.count("*").over(block)).withColumn("_m", F.sum(F.shiftrightunsigned(F.xxhash64("sid"), 28)).over(block))
        .filter((F.col("_first") < F.col("_last")) | (F.col("salts") > 1)),
        "blocks",
    )
    # the sets that share most of their shingles come first, as the origin of edited copies does
    points = rows.filter("sid is not null").groupBy("sid").agg(F.max("n").alias("n"), F.max("vec").alias("vec"))
    common = shared.groupBy("sid").agg(F.count("*").alias("_c"))
    points = materialized(points.join(common, "sid").select("sid", "n", "vec", (F.col("_c") / F.col("n")).alias("_d")), "points")
    # parts of blocks that look alike are asked once here; the search of what stays open takes all blocks
    alike = shared.filter("sid = _first").groupBy("salt", "_first", "_last", "_n", "_m").agg(F.min("t").alias("t")).select("t", "salt")
    asked = shared.filter("_first < _last").select("t", "salt", "sid", "rest").join(alike, ["t", "salt"], "left_semi")
    found = nearest_pairs(asked.join(points, "sid"))
    # the first sets of the parts of a dealt block meet the block's first one
    parts = shared.filter("salts > 1").join(points.select("sid", "_d"), "sid").groupBy("t", "salt").agg(F.max(F.struct("_d", "sid")).alias("_c"))
    tops = parts.groupBy("t").agg(F.max("_c").alias("_top"))
    hubs = parts.join(tops, "t").select(F.col("_c.sid").alias("a"), F.col("_top.sid").alias("b")).filter("a <> b").distinct()
    near = found.unionByName(possible(hubs, points)).distinct()
    near = materialized(near, "nearest-pairs")
    ends = lambda p: p.select(F.col("a").alias("sid")).unionByName(p.select(F.col("b").alias("sid"))).distinct()
    sets = materialized(full_sets(base, rows, ends(near)), "sets")
    links = materialized(linked(near, sets), "links")
    roots = components(links)

    # blocks of more than two sets that are not yet one component
    placed = shared.select("t", "salt", "salts", "sid", "rest").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "sid"))
    open_blocks = (
        placed.groupBy("t").agg(F.min("root").alias("main"), F.max("root").alias("_r"), F.count("*").alias("_n"),
                                F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("_m"))
        # blocks with the same members are one, the first in the order of rarity, where their rests are largest
        .filter("main < _r and _n > 2").groupBy("_n", "_m").agg(F.min(F.struct("t", "main")).alias("_b")).select("_b.*")
    )
    members = placed.join(open_blocks, "t").join(points, "sid")
    # in a dealt block the sets outside its main component ask in every part
    own = members.select("t", "salt", (F.col("root") != F.col("main")).alias("ask"), "sid", "root", "n", "rest", "vec")
    guests = members.filter("salts > 1 and root <> main").select(
        "t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("ask"), "sid", "root", "n", "rest", "vec"
    )
    pairs = tree_pairs(own.unionByName(guests)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialized(pairs.join(tried, ["a", "b"], "left_anti"), "tree-pairs")
    others = materialized(full_sets(base, rows, ends(pairs).join(sets.select("sid"), "sid", "left_anti")), "sets")
    more = materialized(linked(pairs, sets.unionByName(others)), "links")
    roots = components(links.unionByName(more))

    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every component, and all that have no shingle, with all their columns."""
    named = _classes(docs)
    first = named.filter("n > 0").groupBy("root").agg(F.min(F.struct("_id", "_th")).alias("k")).select("k.*")
    return keep_rows(docs, first.unionByName(named.filter("n = 0").select("_id", "_th")))
