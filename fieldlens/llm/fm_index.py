"""Benchmark passages in training documents, found by backward search in an FM-index of every shard of documents.

* A **shard** is what one task reads, cut where it holds SHARD symbols. Its index is one row: the alphabet, the
  Burrows-Wheeler transform as a wavelet tree (one bit vector a level, levels joined), the places of the sampled suffix
  positions, and the words each document has. The rows are written as a table, so a lost executor costs its shards.
* **Search** is backward, over all windows of a block at once: a range of suffixes a window, narrowed by two ranks a word.
* **Locate** walks each row of a range to the word before it until a sampled position is met.
* Windows come to the shards in blocks of a bounded number of (window, item) pairs, one broadcast each, however many
  there are. What a shard finds in a document is united to spans of words there before it is shuffled.

Words that no item has cannot be inside a window, so they part the text: a filter of fixed size, with a bit for each
word of the items, says which. What lies between two such words and is shorter than the shortest window is not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import encoded, prepare
from fieldlens.session import materialized

#: Words of a window.
WINDOW = 10
#: Bits of the filter of the items' words, whatever their number; a full filter indexes more text.
FILTER_BITS = 1 << 24
#: Symbols of a shard, text positions between two sampled ones, occurrences that are located together.
SHARD, SAMPLED, LOCATED = 1 << 20, 16, 1 << 18
#: (window, item) pairs of a block.
BLOCK = 1 << 16
#: Words whose hash a task remembers.
KNOWN = 1 << 18

#: a-z, 0-9 and every byte of a character beyond ASCII make words; A-Z become a-z, the rest parts words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


class Symbols(dict):
    """64-bit hashes of words, never 0; with a filter, 0 for words that it does not hold."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = bits

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word) or 1
        slot = h % FILTER_BITS
        if self.bits is not None and not self.bits[slot >> 6] >> (slot & 63) & 1:
            h = 0
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


# windows


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (hashes of its words, 8 bytes each), item_id string, each pair once. An item of fewer words, but not none, is one window; a null
    id counts as the empty one."""

    def cut(batches):
        symbols = Symbols()
        for b in batches:
            for key, data in zip(b.column("item_id").to_pylist(), encoded(b.column("text")), strict=True):
                words = symbols.of(words_of(data))
                if len(words):
                    raw = words.tobytes()
                    held = sorted({raw[i * 8 : (i + size) * 8] for i in range(max(1, len(words) - size + 1))})
                    # in pieces, so that a long item does not become one batch
                    for at in range(0, len(held), BLOCK):
                        piece = held[at : at + BLOCK]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(piece, pa.binary()), pa.array([key] * len(piece), pa.string())], names=["window", "item_id"]
                        )

    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return given.mapInArrow(cut, "window binary, item_id string").distinct()


def word_filter(pairs: DataFrame) -> np.ndarray:
    """A bit for the hash of every word of the windows. Its size is fixed, on the driver too."""

    def slots(batches):
        for b in batches:
            held = np.unique(np.frombuffer(b"".join(b.column("window").to_pylist()), dtype=np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)
            part = held >> 6
            bit = (np.uint64(1) << (held & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(bit)], names=["part", "bit"])

    found = pairs.select("window").mapInArrow(slots, "part int, bit long").groupBy("part").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[found.column("part").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


# index


def sorted_suffixes(x: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; positions whose prefix is unique are not sorted again."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    heads = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    width = 1
    while True:
        shared = np.flatnonzero(~(heads & np.append(heads[1:], True)))
        if not len(shared):
            return order
        held = order[shared]
        key = rank[held] * (n + 1) + rank[np.minimum(held + width, n)] + 1
        moved = np.argsort(key, kind="stable")
        order[shared] = held = held[moved]
        key = key[moved]
        heads[shared] |= np.concatenate([[True], key[1:] != key[:-1]])
        rank[held] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))[shared]
        width *= 2


class Bits:
    """A bit vector with ranks: packed words and the ones before each."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(bits) // 64 * 64 + 64, dtype=bool)
        padded[: len(bits)] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletTree:
    """Ranks of symbols in a sequence; level k holds bit ``depth - 1 - k`` of each symbol, nodes of a level joined
    with all left children first."""

    def __init__(self, levels: list[np.ndarray], n: int):
        self.levels = [Bits(p) for p in levels]
        self.zeros = [n - int(b.ones(np.array([n]))[0]) for b in self.levels]

    @staticmethod
    def build(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
        levels = []
        for k in range(depth - 1, -1, -1):
            bits = (symbols >> k) & 1 > 0
            levels.append(Bits.pack(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        return levels

    def places(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place in the lowest level; the difference to that of 0 is the rank of the symbol before i."""
        depth = len(self.levels)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(i)
            i = np.where((symbol >> (depth - 1 - k)) & 1 > 0, zeros + ones, i - ones)
        return i

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place and the place in the lowest level."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.at(i), bits.ones(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


INDEX = (
    "shard long, doc_id array<long>, n_words array<long>, n long, alphabet binary, starts binary, tree array<binary>, marks binary, samples binary, "
    "stretch_at binary, stretch_doc binary, stretch_word binary"
)
_KINDS = [
    pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(),
    pa.binary(), pa.binary(), pa.binary(),
]


def _indexed(shard: int, ids: list, sizes: list[int], parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """The index row of a shard; parts are (document, first word, symbols) of the stretches, in order."""
    lengths = np.array([len(p[2]) for p in parts], dtype=np.int64)
    at = np.cumsum(lengths + 1) - lengths
    # symbol 0 stands before, between and behind the stretches; as suffixes these places differ
    text = np.zeros(int((lengths + 1).sum()) + 1, dtype=np.uint64)
    for place, (_, _, own) in zip(at.tolist(), parts, strict=True):
        text[place : place + len(own)] = own
    alphabet, coded = np.unique(text, return_inverse=True)
    n, apart = len(text), text == 0
    order = sorted_suffixes(np.where(apart, np.cumsum(apart) - 1, coded + int(apart.sum())))
    last = coded[order - 1]
    sampled = (np.arange(n) % SAMPLED == 0) | np.concatenate([[True], apart[:-1]])
    marks = sampled[order]
    row = [
        shard, ids, sizes, n, alphabet.tobytes(), np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=len(alphabet)))]).tobytes(),
        [p.tobytes() for p in WaveletTree.build(last, max(1, int(len(alphabet) - 1).bit_length()))],
        Bits.pack(marks).tobytes(), order[marks].astype(np.int32).tobytes(), at.tobytes(),
        np.array([p[0] for p in parts], dtype=np.int32).tobytes(), np.array([p[1] for p in parts], dtype=np.int64).tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], schema=pa.schema(list(zip(_names(), _KINDS, strict=True))))


def _names() -> list[str]:
    return [c.split()[0] for c in INDEX.split(", ")]


def build_index(docs: DataFrame, bits: np.ndarray | None = None, shortest: int = WINDOW) -> DataFrame:
    """An FM-index row for every shard of ``docs`` (doc_id, text), to be written once. With ``bits`` only words of that
    filter are indexed; stretches of fewer than ``shortest`` words are not."""
    held = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        symbols = Symbols(None if held is None else held.value)
        base, count = TaskContext.get().partitionId() << 32, 0
        ids, sizes, parts, size = [], [], [], 0
        for b in batches:
            for key, data in zip(b.column("doc_id").to_pylist(), encoded(b.column("text")), strict=True):
                own = symbols.of(words_of(data))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own > 0, [False]]).astype(np.int8)))
                for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if end - start >= shortest:
                        parts.append((len(ids), start, own[start:end].copy()))
                        size += end - start + 1
                ids.append(key)
                sizes.append(len(own))
                if size >= SHARD or len(ids) >= SHARD:
                    yield _indexed(base + count, ids, sizes, parts)
                    ids, sizes, parts, size, count = [], [], [], 0, count + 1
        if ids:
            yield _indexed(base + count, ids, sizes, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class Shard:
    """Search in one row of the index."""

    def __init__(self, row: dict):
        self.n = row["n"]
        self.alphabet = np.frombuffer(row["alphabet"], dtype=np.uint64)
        self.starts = np.frombuffer(row["starts"], dtype=np.int64)
        self.tree = WaveletTree([np.frombuffer(p, dtype=np.uint64) for p in row["tree"]], self.n)
        self.marks = Bits(np.frombuffer(row["marks"], dtype=np.uint64))
        self.samples = np.frombuffer(row["samples"], dtype=np.int32)
        self.stretch_at, self.stretch_word = (np.frombuffer(row[c], dtype=np.int64) for c in ("stretch_at", "stretch_word"))
        self.stretch_doc = np.frombuffer(row["stretch_doc"], dtype=np.int32)
        # rank of a symbol before a row, from the place in the lowest level
        self.zero = self.tree.places(np.arange(len(self.alphabet)), np.zeros(len(self.alphabet), dtype=np.int64))

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.tree.places(symbol, i) - self.zero[symbol]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row behind the last of every pattern; a row of ``words`` (hashes) ends a pattern at its right."""
        symbol = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        used = np.arange(words.shape[1]) >= words.shape[1] - lengths[:, None]
        known = ((self.alphabet[symbol] == words) | ~used).all(axis=1)
        low, high = np.zeros(len(words), dtype=np.int64), np.where(known, self.n, 0)
        for k in range(words.shape[1] - 1, -1, -1):
            on = np.flatnonzero((low < high) & used[:, k])
            if len(on):
                both = self.step(np.tile(symbol[on, k], 2), np.concatenate([low[on], high[on]]))
                low[on], high[on] = both[: len(on)], both[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of every row."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            marked = self.marks.at(rows)
            out[left[marked]] = self.samples[self.marks.ones(rows[marked])] + steps
            left, rows = left[~marked], rows[~marked]
            symbol, place = self.tree.read(rows)
            rows = self.starts[symbol] + place - self.zero[symbol]
            steps += 1
        return out


# search


FOUND = "shard long, doc int, spans array<struct<start:long,end:long>>, items array<string>"


def _matches(shard: Shard, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the shard's text that an occurrence covers, and (document, window) of the occurrences, each once."""
    low, high = shard.search(words, lengths)
    cover = np.zeros(shard.n + 1, dtype=np.int64)
    pairs = np.zeros(0, dtype=np.int64)
    hit = np.flatnonzero(low < high)
    totals = np.concatenate([[0], np.cumsum(high[hit] - low[hit])])
    for first in range(0, int(totals[-1]), LOCATED):
        # occurrences first to first + LOCATED of all, of whichever windows they are
        number = np.arange(first, min(first + LOCATED, int(totals[-1])))
        which = np.searchsorted(totals, number, side="right") - 1
        window = hit[which]
        at = shard.locate(low[window] + number - totals[which])
        np.add.at(cover, at, 1)
        np.add.at(cover, at + lengths[window], -1)
        doc = shard.stretch_doc[np.searchsorted(shard.stretch_at, at, side="right") - 1]
        pairs = np.unique(np.concatenate([pairs, doc.astype(np.int64) * len(words) + window]))
    return np.cumsum(cover)[:-1] > 0, pairs


def _united(shard: Shard, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and word behind the last of the covered stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    own = np.searchsorted(shard.stretch_at, start, side="right") - 1
    shift = shard.stretch_word[own] - shard.stretch_at[own]
    return shard.stretch_doc[own], start + shift, end + shift


def search_block(index: DataFrame, block: pa.Table, size: int = WINDOW) -> DataFrame:
    """shard, doc (number in the shard), united spans and items of the documents in which a window of ``block`` occurs."""
    raw, names = block.column("window").to_pylist(), block.column("item_id").to_pylist()
    patterns = sorted(set(raw))
    place = {w: i for i, w in enumerate(patterns)}
    words = np.zeros((len(patterns), size), dtype=np.uint64)
    for i, w in enumerate(patterns):
        words[i, size - len(w) // 8 :] = np.frombuffer(w, dtype=np.uint64)
    lengths = np.array([len(w) // 8 for w in patterns], dtype=np.int64)
    owner = np.array([place[w] for w in raw])
    by = np.argsort(owner, kind="stable")
    held = index.sparkSession.sparkContext.broadcast((words, lengths, np.searchsorted(owner[by], np.arange(len(patterns) + 1)), [names[i] for i in by]))

    def run(batches):
        words, lengths, first, items = held.value
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                covered, pairs = _matches(shard, words, lengths)
                docs: dict[int, tuple[list, set]] = {}
                for doc, start, end in zip(*(c.tolist() for c in _united(shard, covered)), strict=True):
                    docs.setdefault(doc, ([], set()))[0].append({"start": start, "end": end})
                for doc, window in zip((pairs // len(words)).tolist(), (pairs % len(words)).tolist(), strict=True):
                    docs[doc][1].update(items[first[window] : first[window + 1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(docs), pa.int64()), pa.array(list(docs), pa.int32()),
                     pa.array([d[0] for d in docs.values()], SPANS),
                     pa.array([sorted(d[1]) for d in docs.values()], pa.list_(pa.string()))],
                    names=["shard", "doc", "spans", "items"],
                )

    return index.drop("doc_id", "n_words").mapInArrow(run, FOUND)


def _blocks(pairs: DataFrame) -> Iterator[pa.Table]:
    """The pairs, as many at a time as a block holds; they lie sorted by block, so that a block is read by itself."""
    n = -(-pairs.count() // BLOCK)
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("window", "item_id"), F.lit(max(n, 1))))
    dealt = materialized(dealt.repartitionByRange("block").sortWithinPartitions("block"), "window-blocks")
    for k in range(n):
        part = dealt.filter(F.col("block") == k).toArrow()
        if part.num_rows:
            yield part


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of a document from all blocks, those that meet made one."""
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            done: list[dict] = []
            for s in spans:
                if done and s["start"] <= done[-1]["end"]:
                    done[-1]["end"] = max(done[-1]["end"], s["end"])
                else:
                    done.append(s)
            out.append(done)
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc"), pa.array(out, SPANS), b.column("items")], names=["shard", "doc", "spans", "items"])


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (start and end in words, apart and in order: what to remove), items (ids as strings, sorted) of every row of ``docs``.

    Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z in lower case, over whole texts. A span unites the
    occurrences of windows: ``size`` consecutive words of an item, or all words of an item that has fewer. Null, empty
    and wordless texts have no words and no spans; a wordless item has no window. Repeated rows give repeated results,
    a null doc_id is passed on, items repeated under one id count once, a null item_id counts as the empty one. Other columns
    are ignored; without documents the result is empty, without items no document has spans. Words are told apart by
    64-bit hashes. A task holds the index of one shard, or of one document that is longer.
    """
    spark = docs.sparkSession
    prepare(spark)
    pairs = materialized(windows(items, size), "windows")
    shortest = pairs.agg(F.min(F.length("window"))).first()[0]
    index = materialized(build_index(docs, word_filter(pairs), (shortest or size * 8) // 8), "fm-index")
    found = spark.createDataFrame([], FOUND)
    for block in _blocks(pairs):
        found = found.unionByName(search_block(index, block, size))
    found = found.groupBy("shard", "doc").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).mapInArrow(_joined_spans, FOUND)
    found = found.select(F.col("shard").alias("_fs"), F.col("doc").alias("_fd"), "spans", "items")
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("_doc", "_row"))
    return rows.join(found, (F.col("_fs") == F.col("shard")) & (F.col("_fd") == F.col("_doc")), "left").select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.n_words").alias("n_words"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
