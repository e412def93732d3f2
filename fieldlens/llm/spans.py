"""Removal of repeated passages by sliding runs of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare, mixed, row_key
from fieldlens.session import materialized

#: Sentences of a run, and the fewest words it holds; a run with fewer words goes on to the next sentence.
SENTENCES, WORDS = 3, 15
#: A sentence ends at a mark before white space, at a full-width mark or at a line break. One of more words than this is
#: cut between words, at places that the words around them give, into pieces of at most so many.
LONGEST = 12
_END = re.compile(r"[.!?\u2026\u037e\u0589\u061f\u06d4\u0700-\u0702\u0964\u0965\u104a\u104b\u1362\u1367\u17d4\u17d5]+(?=\s)|[\u3002\uff01\uff0e\uff1f\uff61]+|\n")
_WORD = re.compile(r"\S+")
#: Run numbers and lengths share one number.
_LENGTH_BITS = 24


def cuts(words: list[str]) -> list[int]:
    """Numbers of words before each cut of a sentence; no piece has more than LONGEST words.

    Between two words is a cut if the hash of the two is the least, the first of equal ones, of LONGEST neighbouring
    places of the sentence. So a cut depends on the words near it and not on where the sentence began.
    """
    values = list(map(xxhash.xxh3_64_intdigest, map(add, words, words[1:])))
    if len(values) > 8 * LONGEST:
        windows = np.lib.stride_tricks.sliding_window_view(np.array(values, dtype=np.uint64), LONGEST)
        return (np.unique(np.arange(len(windows)) + windows.argmin(axis=1)) + 1).tolist()
    out, todo = [], [(0, len(values))]
    while todo:  # the least of a stretch is also the least of each window that holds it
        a, b = todo.pop()
        if b - a >= LONGEST:
            at = values.index(min(values[a:b]), a)
            out.append(at + 1)
            todo += (a, at), (at + 1, b)
    return sorted(out)


def sentences(text: str, places: bool = True) -> list[tuple[int, int, list[str]]]:
    """(from, to, words) of every sentence; together they cover the text, blanks belong to what is before them.

    Without ``places`` the words are the same and pieces of a long sentence have its from and to.
    """
    out: list[tuple[int, int, list[str]]] = []
    start = 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[start:end].split()
        if not words:
            if out:
                out[-1] = (out[-1][0], end, out[-1][2])
                start = end
            continue
        if len(words) <= LONGEST:
            out.append((start, end, words))
        elif not places:
            at = [0, *cuts(words), len(words)]
            out += [(start, end, words[i:j]) for i, j in zip(at, at[1:])]  # noqa: B905
        else:
            ends_of = [m.end() for m in _WORD.finditer(text, start, end)]
            i = 0
            for j in (*cuts(words), len(words)):
                last = end if j == len(words) else ends_of[j - 1]
                out.append((start, last, words[i:j]))
                start, i = last, j
        start = end
    if out and start < len(text):
        out[-1] = (out[-1][0], len(text), out[-1][2])
    return out


def runs(parts: list[tuple[int, int, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes and the length of the run that begins at each sentence, for those that have one."""
    n = len(parts)
    if n < SENTENCES:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),)
    each = np.array([xxhash.xxh3_64_intdigest(" ".join(w)) for _, _, w in parts], dtype=np.uint64)
    total = np.concatenate([[0], np.cumsum([len(w) for _, _, w in parts])])
    first = np.arange(n - SENTENCES + 1)
    end = np.maximum(first + SENTENCES, np.searchsorted(total, total[first] + WORDS))
    first, end = first[end <= n], end[end <= n]
    a, b = np.zeros(len(first), dtype=np.uint64), np.zeros(len(first), dtype=np.uint64)
    for k in range(int((end - first).max(initial=0))):
        # every run has its first sentences, and runs begin at 0, 1, 2 and so on
        on = slice(None) if k < SENTENCES else first + k < end
        h = each[k : k + len(first)] if k < SENTENCES else each[(first + k)[on]]
        a[on] = mixed(a[on] * np.uint64(0x9E3779B97F4A7C15) + h)
        b[on] = mixed(b[on] ^ (h * np.uint64(0xC2B2AE3D27D4EB4F)) + np.uint64(k))
    return a, b, end - first


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_a", "_b", "_id", "_th", "_at"]
    for batch in batches:
        ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
        found = [runs(sentences(t, False)) if t else runs([]) for t in batch.column("text").to_pylist()]
        counts = [len(f[0]) for f in found]
        at = [(np.arange(len(n)) << _LENGTH_BITS) | n for _, _, n in found]
        join = lambda x, t: np.concatenate([*x, np.zeros(0, dtype=t)]).astype(t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(join([f[0] for f in found], np.uint64).view(np.int64)), pa.array(join([f[1] for f in found], np.uint64).view(np.int64)),
             pa.array(np.repeat(ids, counts)), pa.array(np.repeat(ths, counts)), pa.array(join(at, np.int64))],
            names=names,
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, removed = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
            parts = sentences(text or "", bool(gone))
            if not gone:
                texts.append(text or "")
                total.append(len(parts))
                removed.append(0)
                continue
            drop = np.zeros(len(parts), dtype=bool)
            for at in gone:
                first = at >> _LENGTH_BITS
                drop[first : first + (at & ((1 << _LENGTH_BITS) - 1))] = True
            texts.append("".join(text[a:b] for (a, b, _), d in zip(parts, drop, strict=True) if not d))
            total.append(len(parts))
            removed.append(int(drop.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            names=["doc_id", "text", "n_sentences", "n_removed"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_sentences, n_removed: every row without the sentences that a repeated run covers.

    A run is SENTENCES consecutive sentences, and more until it holds WORDS words. Of equal runs, inside one
    document or in several, the first by doc_id and place stays. Words are compared exactly, white space is not.
    Wherever a repeated passage begins and ends, at most LONGEST words at each of its ends lie outside pieces that all
    its places share, so every passage of WORDS + 2 LONGEST words, white space between them, holds an equal run.

    Null text comes back empty; texts with fewer sentences than a run stay whole. Rows equal in doc_id and text
    count as one document and each comes back. A null doc_id comes before all others. Other columns are ignored; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    # written, because runs are counted first and then met with the repeated ones: texts are cut and hashed once
    found = materialized(base.select("_id", "_th", "text").mapInArrow(_hashed, "_a long, _b long, _id long, _th long, _at long"), "runs")
    repeated = materialized(
        found.groupBy("_a", "_b")
        .agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_th", "_at")).alias("_first"))
        .filter("_n > 1").select(F.col("_a").alias("_ra"), F.col("_b").alias("_rb"), "_first"), "repeated-runs"
    )
    later = found.join(repeated, (F.col("_a") == F.col("_ra")) & (F.col("_b") == F.col("_rb"))).filter(
        F.struct("_id", "_th", "_at") != F.col("_first")
    )
    # at most one entry per sentence of the row's own text
    gone = materialized(
        later.groupBy("_id", "_th").agg(F.collect_set("_at").alias("_gone")).withColumnsRenamed({"_id": "_gid", "_th": "_gth"}), "spans"
    )
    return (
        base.join(gone, (F.col("_id") == F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
        .select("doc_id", "text", "_gone").mapInArrow(_cut, "doc_id long, text string, n_sentences long, n_removed long")
    )
