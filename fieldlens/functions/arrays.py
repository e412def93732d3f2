"""Expressions over prediction vectors; everything stays inside the JVM and inside the row."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def exp_shifted(logits: str | Column) -> Column:
    z = _c(logits)
    return let(F.struct(z.alias("z"), F.array_max(z).alias("m")), lambda t: F.transform(t["z"], lambda v: F.exp(v - t["m"])))


def softmax(logits: str | Column) -> Column:
    """Max-subtracted exponentials over their sum."""
    return let(
        exp_shifted(logits),
        lambda e: let(F.struct(e.alias("e"), array_sum(e).alias("s")), lambda t: F.transform(t["e"], lambda v: v / t["s"])),
    )


def log_sum_exp(logits: str | Column) -> Column:
    z = _c(logits)
    return F.array_max(z) + F.log(array_sum(exp_shifted(z)))


def class_mask(logits: str | Column, keep: Sequence[int]) -> Column:
    """Logits with -inf outside the kept class ids: one lookup in a constant 0/1 vector per class."""
    wanted = set(keep)
    flags = constant([1 if i in wanted else 0 for i in range(max(wanted, default=-1) + 1)], "array<int>")
    return let(
        flags,
        lambda f: F.transform(_c(logits), lambda v, i: F.when(F.get(f, i) == 1, v).otherwise(F.lit(float("-inf")))),
    )


def temperature_scale(logits: str | Column, temperature: float) -> Column:
    return F.transform(_c(logits), lambda v: v / F.lit(float(temperature)))


def merge_to_binary_probs(probs: str | Column) -> Column:
    """[first class, all the others together]."""
    p = _c(probs)
    return F.array(p.getItem(0), array_sum(F.slice(p, F.lit(2), F.size(p) - 1)))


def top_k(probs: str | Column, k: int = 0) -> Column:
    """array<struct<neg_p, i>> of the k best classes, lower index first on ties; k <= 0 keeps all."""
    order = F.array_sort(F.transform(_c(probs), lambda p, i: F.struct((-p).alias("neg_p"), i.alias("i"))))
    return F.slice(order, 1, k) if k > 0 else order


def argmax(probs: str | Column) -> Column:
    return F.array_min(F.transform(_c(probs), lambda p, i: F.struct((-p).alias("neg_p"), i.alias("i"))))["i"]


def topk_predictions(probs: str | Column, names: Column, k: int = 0) -> Column:
    """array<struct<name, conf>> with confidence in percent, two decimals."""
    return let(
        names,
        lambda n: F.transform(
            top_k(probs, k), lambda t: F.struct(n[t["i"]].alias("name"), F.round(-t["neg_p"] * 100, 2).alias("conf"))
        ),
    )


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    x, y = _c(a), _c(b)
    dot = array_sum(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(array_sum(F.transform(x, lambda p: p * p))) * F.sqrt(array_sum(F.transform(y, lambda q: q * q)))
    return dot / norm


def constant(value, schema: str) -> Column:
    """A folded literal built from a Python value."""
    return F.from_json(F.lit(json.dumps(value)), schema)


class ClassTaxonomy:
    """The class list of one model head as constant columns.

    Its length is the length of the logits array every row carries, which bounds what is collected here.
    """

    def __init__(self, classes: DataFrame):
        rows = sorted(classes.select("class_id", "species", "genus", "family").collect(), key=lambda r: r["class_id"])
        if [r["class_id"] for r in rows] != list(range(len(rows))):
            raise ValueError("class ids must be 0..n-1")
        self.width = len(rows)
        self.names = {level: [r[level.lower()] for r in rows] for level in ("SPECIES", "GENUS", "FAMILY")}

    def name_array(self, level: str) -> Column:
        return constant(self.names[level], "array<string>")

    def groups(self, level: str) -> Column:
        """array<struct<name, ids>>: the classes of each higher taxon."""
        members: dict[str, list[int]] = {}
        for i, name in enumerate(self.names[level]):
            members.setdefault(name, []).append(i)
        value = [{"name": n, "ids": ids} for n, ids in members.items()]
        return constant(value, "array<struct<name:string,ids:array<int>>>")


def taxon_rollup(probs: str | Column, taxonomy: ClassTaxonomy, level: str) -> Column:
    """array<struct<name, conf>>, best first: class probabilities rounded to 3 and summed per higher taxon.

    Sums are whole thousandths, so they are exact. Ties go to the taxon of the more confident class. Work is
    linear in the number of classes and needs no shuffle.
    """
    p = _c(probs)
    summed = let(
        p,
        lambda v: F.transform(
            taxonomy.groups(level),
            lambda g: F.struct(
                (-F.aggregate(g["ids"], F.lit(0).cast("long"), lambda a, i: a + F.round(F.round(v[i], 3) * 1000).cast("long")))
                .alias("neg"),
                F.array_min(F.transform(g["ids"], lambda i: F.struct((-v[i]).alias("neg_p"), i.alias("i")))).alias("first"),
                g["name"].alias("name"),
            ),
        ),
    )
    return F.transform(F.array_sort(summed), lambda t: F.struct(t["name"].alias("name"), (-t["neg"] / 1000.0).alias("conf")))
