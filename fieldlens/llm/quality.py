"""Quality rules: counts per document, and a linear-chain CRF that marks lines as content or boilerplate."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare, encoded
from fieldlens.operators.ordering import first_n

#: Labelled documents per class that the labeller is fitted on, chosen by a hash of doc_id.
SAMPLE_PER_CLASS = 400
#: Share of a document's words that must lie in content lines.
CONTENT_SHARE = 0.5
#: The characters counted as symbols, and the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FEATURES = 15
LETTERS = string.ascii_letters.encode()


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[int, ...]:
    """Indices of the features that hold for one line."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    text = line.decode("utf-8", "replace")
    letters = size - len(line.translate(None, LETTERS)) if line.isascii() else sum(map(str.isalpha, text))
    upper = text.upper() == text and text.lower() != text
    distinct = len(set(words))
    out = [0]
    out.append(1 if n < 4 else 2 if n < 12 else 3)
    if symbols * 20 > size:
        out.append(4)
    if symbols * 100 > size:
        out.append(5)
    if line.count(b"|") > 1:
        out.append(6)
    if upper:
        out.append(7)
    if line.count(b"!") * 20 > size:
        out.append(8)
    if line.rstrip()[-1:] in b".!?" and line.rstrip():
        out.append(9)
    if seen:
        out.append(10)
    if 2 * distinct <= n:
        out.append(11)
    if 5 * distinct <= 4 * n and n > 20:
        out.append(12)
    if 2 * letters < len(text):
        out.append(13)
    if b"http" in line or b"@" in line:
        out.append(14)
    return tuple(out)


def lines_of(data: bytes) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Features and word counts of the lines that have a word, and how many of them repeat an earlier line."""
    features, counts, seen, repeats = [], [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            features.append(line_features(line, words, again))
            counts.append(len(words))
    return features, counts, repeats


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs at least twice, all its occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    first: dict[tuple, int] = {}
    marked: set[int] | None = None
    if len(set(windows)) == len(windows):
        return 0
    marked = set()
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            marked.update((i, i + 1, i + 2, j, j + 1, j + 2))
    return len(marked)


def emissions(features: list[tuple[int, ...]], w: np.ndarray) -> np.ndarray:
    return np.array([[w[0, list(f)].sum(), w[1, list(f)].sum()] for f in features])


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequence; ties go to content (label 1)."""
    a, b = float(scores[0, 0]), float(scores[0, 1])
    t = trans.tolist()
    back = []
    for x, y in scores[1:].tolist():
        stay0, from1 = a + t[0][0], b + t[1][0]
        from0, stay1 = a + t[0][1], b + t[1][1]
        back.append((int(from1 >= stay0), int(stay1 >= from0)))
        a, b = max(stay0, from1) + x, max(from0, stay1) + y
    label = int(b >= a)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return np.array(out[::-1])


def _alike(docs: list[tuple[list[tuple[int, ...]], list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, labels, lengths) of documents with at least half as many lines as the longest beside them, so that arrays hold at most
    twice the lines there are."""
    docs = sorted(docs, key=lambda d: -len(d[0]))
    while docs:
        width = len(docs[0][0])
        n = sum(2 * len(f) >= width for f, _ in docs)
        x, y = np.zeros((n, width, FEATURES), dtype=np.float32), np.zeros((n, width), dtype=np.int8)
        for i, (features, labels) in enumerate(docs[:n]):
            for j, f in enumerate(features):
                x[i, j, list(f)] = 1
            y[i, : len(labels)] = labels
        yield x, y, np.array([len(f) for f, _ in docs[:n]])
        docs = docs[n:]


def _expected(x: np.ndarray, lengths: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected features per label and expected transitions, by forward and backward sums. Documents come longest first
    and advance together, one column of lines per step."""
    n, width = x.shape[:2]
    live = np.arange(width) < lengths[:, None]
    rows = live.sum(axis=0)  # the live rows of a column are its first ones
    e = x @ w.T
    alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    alpha[:, 0] = e[:, 0]
    for j in range(1, width):
        k = rows[j]
        before = alpha[:k, j - 1, :, None] + t
        alpha[:k, j] = np.logaddexp(before[:, 0], before[:, 1]) + e[:k, j]
    for j in range(width - 2, -1, -1):
        k = rows[j + 1]
        after = t + (e[:k, j + 1] + beta[:k, j + 1])[:, None, :]
        beta[:k, j] = np.logaddexp(after[:, :, 0], after[:, :, 1])
    last = alpha[np.arange(n), lengths - 1]
    z = np.logaddexp(last[:, 0], last[:, 1])
    p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
    joint = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
    return p.reshape(-1, 2).T @ x.reshape(-1, FEATURES), joint.sum(axis=(0, 1))


def fit_crf(docs: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features per label and of the transitions, by gradient ascent on the conditional likelihood.

    Gradients are summed over groups of documents of like lengths, so memory follows the lines and not the number of
    documents times the longest.
    """
    groups = list(_alike(docs))
    w, t = np.zeros((2, FEATURES)), np.zeros((2, 2))
    total = sum(int(lengths.sum()) for _, _, lengths in groups)
    first, speed = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    gold_w, gold_t = np.zeros_like(w), np.zeros_like(t)
    for x, y, lengths in groups:
        live = np.arange(y.shape[1]) < lengths[:, None]
        gold_w += np.stack([x[(y == k) & live].sum(axis=0, dtype=float) for k in (0, 1)])
        gold_t += np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & live[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, rounds + 1):
        sums = [_expected(x, lengths, w, t) for x, _, lengths in groups]
        slopes = (
            (gold_w - sum(s for s, _ in sums)) / total - decay * w,
            (gold_t - sum(s for _, s in sums)) / total - decay * t,
        )
        for i, (value, slope) in enumerate(zip((w, t), slopes, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * slope
            speed[i] = 0.999 * speed[i] + 0.001 * slope**2
            value += 0.2 * (first[i] / (1 - 0.9**step)) / (np.sqrt(speed[i] / (1 - 0.999**step)) + 1e-8)
    return w, t


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Fits the labeller on at most SAMPLE_PER_CLASS whole documents of either quality.

    The lines of a good document are content and those of a poor one boilerplate; a line that repeats an earlier
    line of its document is boilerplate in either. Without a labelled document there is no model.
    """
    prepare(docs.sparkSession)
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    h = F.xxhash64(F.lit(5), "doc_id")
    chosen = first_n(marked.withColumn("_h", h), ["quality"], [F.col("_h"), F.col("doc_id")], F.pmod("_h", F.lit(64)), SAMPLE_PER_CLASS)
    # at most twice SAMPLE_PER_CLASS rows
    rows = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias("_d"), "quality")), F.col("doc_id") == F.col("_d"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for text, quality in sorted(zip(group["text"], group["quality"], strict=True), key=str):
            features, _, _ = lines_of((text or "").encode())
            if features:
                found.append((features, [int(quality == 1 and 10 not in f) for f in features]))
        if not found:
            return pd.DataFrame({"w": [], "t": []})
        w, t = fit_crf(found)
        return pd.DataFrame({"w": [w.tobytes()], "t": [t.tobytes()]})

    fitted = rows.select("text", "quality", F.lit(0).alias("one")).groupBy("one").applyInPandas(fit, "w binary, t binary").collect()
    if not fitted:
        return None
    return np.frombuffer(fitted[0]["w"]).reshape(2, FEATURES), np.frombuffer(fitted[0]["t"]).reshape(2, 2)


def assess(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    ``kept`` is false where the base rules fail, else true if the words of the lines that the labeller marks as
    content are at least CONTENT_SHARE of all words. Null and blank texts have no words and fail. Without a model
    every line is content. Rows repeated under one doc_id are answered each; a null doc_id is passed on; other
    columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in encoded(batch.column("text")):
                words = data.split()
                n = len(words)
                chars = len(data.decode()) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
                features, counts, repeats = lines_of(data)
                repeat = repeated_words(words)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                share = 1.0 if n else 0.0
                if features and model is not None:
                    labels = viterbi(emissions(features, model[0]), model[1])
                    share = float((labels * np.array(counts)).sum() / n)
                rows.append((n, chars, len(data) - len(data.translate(None, SYMBOLS)), repeats, repeat, failed, not failed and share >= CONTENT_SHARE, share))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double",
    )
