"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare
from fieldlens.operators.ordering import first_n

#: Hashed byte n-grams of 1 to 3 bytes; square roots of their shares make a vector of length one.
DIMENSIONS = 4096
#: Documents per language that a classifier is fitted on, chosen by a hash of doc_id among the training rows.
SAMPLE_PER_LANG = 300
#: Rows of one fit of a pair, and of a family where there are few languages, shared by the classes that take part.
ROWS_PER_FIT = 1200
#: Rows that each language gives to the fit of a family at least, however many languages there are.
FAMILY_ROWS = 40
#: Families fitted in one task, which read the same rows, and the most families for which each has a task of its own.
FAMILIES_PER_TASK = 16
#: Chosen rows, each a few dozen bytes, that are sent to every executor; more are joined by a shuffle.
MOST_SENT = 1_000_000
UNKNOWN = "und"

#: Families of closely related languages by code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"only {lang}")


def vector(text: str) -> np.ndarray:
    """Unit vector of a whole text. Case and runs of white space don't count."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), dtype=np.uint8).astype(np.uint32)
    counts = np.bincount(b, minlength=DIMENSIONS)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    for h in (two, three):
        counts += np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 40) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    return descend(np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]), np.arange(len(x)), y, cost, rounds)


def descend(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 40) -> np.ndarray:
    """``fit_svm`` on rows of a matrix that has the column of ones, without a copy of it; ``y`` goes with ``rows``."""
    # both classes weigh the same in all, however many rows each has
    c = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    squares = np.concatenate([(x[rows[k : k + 1024]] ** 2).sum(axis=1) for k in range(0, len(rows), 1024)])
    alpha, w, diagonal = np.zeros(len(y)), np.zeros(x.shape[1]), squares + 1 / (2 * c)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            xi = x[rows[i]]
            gradient = y[i] * (xi @ w) - 1 + alpha[i] / (2 * c[i])
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * xi
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


@dataclass
class LanguageModel:
    """Families with one-versus-rest weights, and per family its languages with one-versus-one weights."""

    families: list[str]
    family_w: np.ndarray
    languages: dict[str, list[str]]
    pair_w: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.families:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        for start in range(0, len(texts), 256):
            x = np.stack([vector(t) for t in texts[start : start + 256]])
            x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
            margins = 3 * (x @ self.family_w.T)
            odds = np.exp(margins - margins.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1)
            for f, family in enumerate(self.families):
                rows = np.flatnonzero(best == f)
                names = self.languages[family]
                won = np.full((len(rows), len(names)), 1.0 if len(names) == 1 else 0.0)
                for i, a in enumerate(names):
                    for j in range(i + 1, len(names)):
                        p = 1 / (1 + np.exp(-3 * np.clip(x[rows] @ self.pair_w[a, names[j]], -20, 20)))
                        # the vote decides, the probability orders equal votes
                        won[:, i] += (p >= 0.5) + 1e-3 * p
                        won[:, j] += (p < 0.5) + 1e-3 * (1 - p)
                pick = won.argmax(axis=1)
                for r, k in zip(rows, pick, strict=True):
                    sure = 1.0
                    for j in range(len(names)):
                        if j != k:
                            a, b, sign = (names[k], names[j], 1) if k < j else (names[j], names[k], -1)
                            sure = min(sure, 1 / (1 + np.exp(-3 * np.clip(sign * (x[r] @ self.pair_w[a, b]), -20, 20))))
                    langs.append((start + r, names[k], float(odds[r, f] * sure)))
        langs.sort()
        scores = [s for _, _, s in langs]
        return [name for _, name, _ in langs], scores


def train(docs: DataFrame) -> LanguageModel:
    """Fits on at most SAMPLE_PER_LANG whole texts of each language of the rows given (text, lang, doc_id).

    Every lang value that has a usable row is learned. A pair sees at most ROWS_PER_FIT rows, a family at least
    FAMILY_ROWS of every language where there are so many; one task fits a pair or up to FAMILIES_PER_TASK families.
    Rows without lang or without a letter are left out. Only the weights, a vector of fixed length for each family
    and pair, come to the driver.
    """
    prepare(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    families = sorted({family_of(n) for n in names})
    languages: dict[str, list[str]] = {f: [] for f in families}
    for n in names:
        languages[family_of(n)].append(n)
    if not names:
        return LanguageModel([], np.zeros((0, DIMENSIONS + 1)), {}, {})
    per_family_fit = min(SAMPLE_PER_LANG, max(FAMILY_ROWS, ROWS_PER_FIT // len(names)))
    together = 1 if len(families) <= FAMILIES_PER_TASK else FAMILIES_PER_TASK
    blocks = range(0, len(families), together) if len(families) > 1 else ()
    number = {f: k for k, f in enumerate(families)}
    place_of = {n: k for k, n in enumerate(names)}
    h = F.xxhash64(F.lit(11), "doc_id")
    chosen = first_n(
        usable.select("lang", "doc_id", h.alias("_h")),
        ["lang"], [F.col("_h"), F.col("doc_id")], F.pmod("_h", F.lit(64)), SAMPLE_PER_LANG,
    )
    # y is the family's number in the task of a block of families, else the side of the pair
    tasks: dict[str, list[tuple[str, int, int]]] = {n: [] for n in names}
    for n in names:
        tasks[n] += [(f"families {k}", number[family_of(n)], per_family_fit) for k in blocks]
        for m in languages[family_of(n)]:
            if m != n:
                a, b = sorted((n, m))
                tasks[n].append((f"pair {place_of[a]} {place_of[b]}", 1 if n == a else -1, ROWS_PER_FIT // 2))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"task": [], "y": [], "x": []}
            for lang, text, place in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "place")), strict=True):
                x = vector(text).tobytes()
                for task, y, most in tasks[lang]:
                    if place <= most:
                        out["task"].append(task), out["y"].append(y), out["x"].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("task", pa.string()), ("y", pa.int32()), ("x", pa.binary())]))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        task = str(group["task"].iloc[0])
        group = group.sort_values(["y", "x"] if task.startswith("pair") else "x", ignore_index=True)  # the order of arrival must not matter
        classes = group["y"].to_numpy()
        x = np.ones((len(group), DIMENSIONS + 1), dtype=np.float32)
        for i, one in enumerate(group["x"]):
            x[i, :-1] = np.frombuffer(one, dtype=np.float32)
        if task.startswith("pair"):
            return pd.DataFrame({"task": [task], "w": [descend(x, np.arange(len(x)), classes.astype(np.float64)).astype(np.float32).tobytes()]})
        found = []
        first = int(task.split()[1])
        for f in range(first, min(first + together, len(families))):
            y = np.where(classes == f, 1.0, -1.0)
            rows = np.argsort(y, kind="stable")
            found.append((f"family {f}", descend(x, rows, y[rows]).astype(np.float32).tobytes()))
        return pd.DataFrame(found, columns=["task", "w"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    picked = chosen.withColumn("place", place).select(F.col("lang").alias("_l"), F.col("doc_id").alias("_d"), "place")
    if SAMPLE_PER_LANG * len(names) <= MOST_SENT:
        picked = F.broadcast(picked)
    rows = usable.join(picked, (F.col("lang") == F.col("_l")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    fitted = (
        rows.select("lang", "text", "place").mapInArrow(vectors, "task string, y int, x binary")
        .groupBy("task").applyInPandas(fit, "task string, w binary")
    )
    weights = {r["task"]: np.frombuffer(r["w"], dtype=np.float32) for r in fitted.collect()}
    family_w = np.stack([weights.get(f"family {k}", np.zeros(DIMENSIONS + 1, dtype=np.float32)) for k in range(len(families))])
    pairs = {tuple(names[int(k)] for k in t.split()[1:]): w for t, w in weights.items() if t.startswith("pair ")}
    return LanguageModel(families, family_w, languages, pairs)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row, from the whole text alone.

    Null text and text without a letter give ``und`` with score 0, and so does a model that has learned nothing.
    The score is the family's share times the weakest pairwise probability of the language. Rows repeated under
    one doc_id are answered each; other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, letters = b.num_rows, b.column("letters").to_pylist()
            langs, scores = [UNKNOWN] * n, [0.0] * n
            at = [i for i in range(n) if letters[i]]
            if at:
                texts = b.column("text")
                for i, lang, score in zip(at, *held.value.predict([texts[i].as_py() for i in at]), strict=True):
                    langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    """True for the fifth of the ids that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out() & F.col("doc_id").isNotNull())


def with_known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language was found, with all their columns; those answered ``und`` go."""
    held = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, _ = held.value.predict([t or "" for t in b.column("text").to_pylist()])
            keep = pa.array([x != UNKNOWN for x in found], pa.bool_())
            yield b.filter(keep)

    # a text without a letter is answered ``und`` before the classifier is asked
    return docs.filter(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
