"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

A chunk's boundary state is the number of its leading characters that a piece from the chunk before covers. Per
chunk a matrix holds the best score from every state at its start to every state at its end. Matrices are combined
associatively in blocks; their prefixes give every chunk its entering scores, with which it finds its best paths by
itself. Which of them the document takes follows from the states, from the last chunk backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldlens.llm.base import give_back, pieces, prepare, row_key
from fieldlens.llm.unigram import Vocabulary, marked, model_bytes, vocabulary

#: Characters of a chunk; texts up to this length are one chunk.
CHUNK = 1 << 15
#: Chunks whose matrices are multiplied in one task.
BLOCK = 256
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = -np.inf


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: best score over every state in between."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


class Chunk:
    """A stretch of text, the characters after it that its last piece may reach, and where pieces cannot cross.

    ``head`` ends and ``tail`` begins at such a place; what lies between has one best path whatever comes in.
    """

    def __init__(self, vocab: Vocabulary, text: str, look: str):
        self.vocab, self.n, self.states = vocab, len(text), vocab.longest
        whole = text + look
        parts = vocab.words(whole)
        edges, at = [], 0
        for p in parts[:-1]:
            at += len(p)
            edges.append(at)
        # the cuts that lie behind every entering piece and inside the chunk
        inner = [e for e in edges if self.states <= e <= self.n]
        self.head_end, self.tail_at = (inner[0], inner[-1]) if inner else (self.n, None)
        if self.tail_at is None:
            self.head, self.middle, self.tail = whole, [], ""
        else:
            self.head, self.tail = whole[: self.head_end], whole[self.tail_at :]
            self.middle = parts[edges.index(self.head_end) + 1 : edges.index(self.tail_at) + 1]

    def outs(self, entering: int) -> np.ndarray:
        """Best score at every leaving state from one entering state, in a chunk without a cut."""
        out = np.full(self.states, NONE)
        if entering > self.n:  # a piece may cover a short chunk and reach beyond it
            out[entering - self.n] = 0
            return out
        ends = self.vocab.forward(self.head, {entering: 0}, self.n)[0][self.n : self.n + self.states]
        for j, s in enumerate(ends):
            if s is not None:
                out[j] = s
        return out

    def matrix(self) -> np.ndarray:
        """Best scores between the states, up to a constant of the chunk: what every path has in common, the stretch
        between the first and the last cut, decides nothing and is left out."""
        if self.tail_at is None:
            return np.stack([self.outs(i) for i in range(self.states)])
        room = self.n - self.tail_at
        ends = self.vocab.forward(self.tail, {0: 0}, room)[0][room : room + self.states]
        on = np.array([NONE if e is None else e for e in ends] + [NONE] * (self.states - len(ends)))
        heads = [self.vocab.forward(self.head, {i: 0}, self.head_end)[0][self.head_end] for i in range(self.states)]
        return np.stack([on + h for h in heads])

    def origins(self, entering: np.ndarray) -> np.ndarray:
        """The entering state that the best path to each leaving state comes from; -1 where none leads."""
        out = np.full(self.states, -1, dtype=np.int8)
        for j in range(self.states):
            if j <= len(self.tail if self.tail_at is not None else self.head) and j + self.n in self.through(entering):
                out[j] = j + self.n
        inside = self.inside(entering)
        if not inside:
            return out
        if self.tail_at is not None:
            _, start, piece = self.vocab.forward(self.head, inside, self.head_end)
            _, came = self.vocab.trace(self.head, start, piece, self.head_end)
            room = self.n - self.tail_at
            ends = self.vocab.forward(self.tail, {0: 0}, room)[0][room : room + self.states]
            out[[j for j, s in enumerate(ends) if s is not None]] = came
            return out
        best, start, piece = self.vocab.forward(self.head, inside, self.n)
        for j, s in enumerate(best[self.n : self.n + self.states]):
            if s is not None and (out[j] < 0 or s > entering[j + self.n]):
                out[j] = self.vocab.trace(self.head, start, piece, self.n + j)[1]
        return out

    def inside(self, entering: np.ndarray) -> dict[int, int]:
        return {i: int(s) for i, s in enumerate(entering) if s > NONE and i <= self.n}

    def through(self, entering: np.ndarray) -> set[int]:
        return {i for i, s in enumerate(entering) if s > NONE and i > self.n}

    def ids(self, entering: np.ndarray, came: int, leaving: int) -> bytes:
        """Ids of the pieces that start in this chunk, on the path between two states."""
        if came > self.n or (came == self.n and leaving == 0):
            return b""
        inside = {came: int(entering[came])}
        if self.tail_at is None:
            _, start, piece = self.vocab.forward(self.head, self.inside(entering), self.n)
            found, _ = self.vocab.trace(self.head, start, piece, self.n + leaving)
            return np.array(found, dtype="<i4").tobytes()
        _, start, piece = self.vocab.forward(self.head, self.inside(entering), self.head_end)
        first, _ = self.vocab.trace(self.head, start, piece, self.head_end)
        room = self.n - self.tail_at
        _, start, piece = self.vocab.forward(self.tail, {0: inside[came]}, room)
        last, _ = self.vocab.trace(self.tail, start, piece, room + leaving)
        middle = b"".join(map(self.vocab.word_ids, self.middle))
        return np.array(first, dtype="<i4").tobytes() + middle + np.array(last, dtype="<i4").tobytes()


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, ids (array of int), n_chunks for every row.

    Null and empty texts have no ids. Characters outside the vocabulary become byte pieces. Rows repeated under one
    doc_id are encoded each; a null doc_id is passed on; other columns are ignored; an empty table gives an empty
    result. A text of any length is encoded whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model_bytes(model))
    reach = vocabulary(held.value).longest - 1

    def listed(raw: list[bytes]) -> pa.ListArray:
        offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in raw)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))

    def spell_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(held.value)
        for b in pieces(batches):
            raw = [b"".join(map(vocab.word_ids, vocab.words(marked(t or "")))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed(raw), pa.array(np.ones(len(raw), dtype=np.int64))], names=["doc_id", "ids", "n_chunks"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with the characters that their last piece may reach."""
        for b in pieces(batches):
            rows = []
            for doc_id, key, th, text, copies in zip(*(b.column(c).to_pylist() for c in ("doc_id", "_id", "_th", "text", "_copies")), strict=True):
                s = marked(text)
                count = -(-len(s) // chunk)
                for k in range(count):
                    end = (k + 1) * chunk
                    rows.append((doc_id, key, th, copies, k, count, s[k * chunk : end], s[end : end + reach]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "_id", "_th", "_copies", "_k", "_n", "_text", "_look"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    schema = "doc_id long, _id long, _th long, _copies long, _k long, _n long, _text string, _look string"
    out_schema = "doc_id long, ids array<int>, n_chunks long"
    key = ["_id", "_th"]

    def stretches(batch: pa.RecordBatch) -> Iterator[tuple[dict, Chunk]]:
        vocab = vocabulary(held.value)
        for r in batch.to_pylist():
            yield r, Chunk(vocab, r["_text"], r["_look"])

    def matrices(batches):
        for b in pieces(batches, "_text"):
            out = [(r["_id"], r["_th"], r["_k"], c.matrix().tobytes()) for r, c in stretches(b)]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=[*key, "_k", "m"])

    def square(raw: bytes) -> np.ndarray:
        side = round((len(raw) // 8) ** 0.5)
        return np.frombuffer(raw).reshape(side, side)

    def multiply(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_k")
        ms = [square(m) for m in g["m"]]
        while len(ms) > 1:  # neighbours in pairs
            ms = [product(ms[i], ms[i + 1]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        return pd.DataFrame({"_id": g["_id"].iloc[:1], "_th": g["_th"].iloc[:1], "_block": g["_block"].iloc[:1], "m": [ms[0].tobytes()]})

    def advance(g: pd.DataFrame, by: str, first: np.ndarray) -> pd.DataFrame:
        g = g.sort_values(by)
        v, seen = first, []
        for m in g["m"]:
            seen.append(v.tobytes())
            v = (v[:, None] + square(m)).max(axis=0)
        return g.drop(columns=["m"]).assign(v=seen)

    def over_blocks(g: pd.DataFrame) -> pd.DataFrame:
        first = np.full(reach + 1, NONE)
        first[0] = 0
        return advance(g, "_block", first)[["_id", "_th", "_block", "v"]]

    def in_block(g: pd.DataFrame) -> pd.DataFrame:
        return advance(g.drop(columns=["v"]), "_k", np.frombuffer(g["v"].iloc[0]))[["_id", "_th", "_k", "v"]]

    def sources(batches):
        for b in pieces(batches, "_text"):
            out = [(r["_id"], r["_th"], r["_k"], c.origins(np.frombuffer(r["v"])).tobytes()) for r, c in stretches(b)]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=[*key, "_k", "o"])

    def backwards(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_k", ascending=False)
        state, leaving, came = 0, [], []
        for raw in g["o"]:
            leaving.append(state)
            state = int(np.frombuffer(raw, dtype=np.int8)[state])
            came.append(state)
        return g.drop(columns=["o"]).assign(leaving=leaving, came=came)

    def spell(batches):
        for b in pieces(batches, "_text"):
            out = [(*(r[n] for n in names[:6]), c.ids(np.frombuffer(r["v"]), r["came"], r["leaving"])) for r, c in stretches(b)]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=[*names[:6], "_ids"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key(), F.lit(1).cast("long").alias("_copies"))
    short = F.coalesce(F.length("text"), F.lit(0)) < chunk  # one more for the blank in front
    one = base.filter(short).select("doc_id", "text").mapInArrow(spell_short, out_schema)
    # long rows equal in id and text are encoded once and come back as often as they were
    long_rows = base.filter(~short).groupBy("doc_id", "_id", "_th").agg(F.first("text").alias("text"), F.sum("_copies").alias("_copies"))
    chunks = long_rows.mapInArrow(cut, schema).repartition("_id", "_th", "_k")
    kk = "_id long, _th long, _k long"
    block_of = F.floor(F.col("_k") / block).alias("_block")
    ms = chunks.mapInArrow(matrices, f"{kk}, m binary").select("*", block_of)
    blocks = ms.groupBy(*key, "_block").applyInPandas(multiply, "_id long, _th long, _block long, m binary")
    entering = blocks.groupBy(*key).applyInPandas(over_blocks, "_id long, _th long, _block long, v binary")
    entering = ms.join(entering, [*key, "_block"]).groupBy(*key, "_block").applyInPandas(in_block, f"{kk}, v binary")
    known = chunks.join(entering, [*key, "_k"])
    states = known.mapInArrow(sources, f"{kk}, o binary").groupBy(*key).applyInPandas(backwards, f"{kk}, leaving long, came long")
    spelt = known.join(states, [*key, "_k"]).mapInArrow(spell, "doc_id long, _id long, _th long, _copies long, _k long, _n long, _ids binary")
    many = (
        spelt.groupBy("doc_id", *key, "_copies", F.col("_n").alias("n_chunks"))
        .agg(F.array_sort(F.collect_list(F.struct("_k", "_ids"))).alias("_parts"))
        .withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select("doc_id", "n_chunks", F.transform("_parts", lambda p: p["_ids"]).alias("_ids"))
    )

    def unpack(batches):
        for b in batches:
            raw = [b"".join(parts) for parts in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed(raw), b.column("n_chunks")], names=["doc_id", "ids", "n_chunks"])
            give_back()

    return one.unionByName(many.mapInArrow(unpack, out_schema))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``encoded`` with a column ``text`` spelt from ``ids``; null ids give an empty text."""
    spark = encoded.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = vocabulary(held.value).texts
        for b in batches:
            out = []
            for ids in b.column("ids"):
                data = b"".join(map(texts.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else b""
                out.append((data[1:] if data[:1] == b" " else data).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "text"])

    rows = encoded.drop("text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))
