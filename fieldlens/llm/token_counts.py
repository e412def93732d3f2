"""Token counts by a Viterbi pass that carries only the best score and its number of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare
from fieldlens.llm.sentencepiece_scan import MODEL
from fieldlens.llm.unigram import SCALE, marked, model_bytes, vocabulary


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, score for every row: the pieces of the best segmentation of the whole text, and its score.

    An Aho-Corasick automaton enumerates the vocabulary's matches by their end, the longest first. Per position only
    the best score and its count are carried; at equal scores the earliest start stays. A character outside the
    vocabulary is a match of its own that counts its bytes. A part that no piece can leave is counted once per worker.

    Null and empty texts have no tokens and score 0. Rows repeated under one doc_id are counted each; a null doc_id
    is passed on; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(held.value)
        for b in batches:
            score, count = [], []
            for text in b.column("text").to_pylist():
                costs = vocab.costs(vocab.words(marked(text or "")))
                score.append(sum([c[0] for c in costs]) / SCALE)
                count.append(sum([c[1] for c in costs]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count, pa.int64()), pa.array(score, pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
