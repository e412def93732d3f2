"""The fit of the line labeller: expected counts by enumeration, memory by lines."""

import itertools
import random
import tracemalloc

import numpy as np

from fieldlens.llm import quality


def random_docs(rnd, sizes):
    return [([tuple(sorted(rnd.sample(range(quality.FEATURES), 3))) for _ in range(n)], [rnd.randrange(2) for _ in range(n)]) for n in sizes]


def test_expected_counts_equal_enumeration():
    rnd = random.Random(1)
    docs = random_docs(rnd, [1, 2, 3, 5, 6, 7, 7])
    rng = np.random.default_rng(2)
    w, t = rng.normal(size=(2, quality.FEATURES)), rng.normal(size=(2, 2))
    want_w, want_t = np.zeros_like(w), np.zeros_like(t)
    for features, _ in docs:
        paths = list(itertools.product((0, 1), repeat=len(features)))
        scores = [sum(w[y, list(f)].sum() for y, f in zip(p, features, strict=True)) + sum(t[a, b] for a, b in itertools.pairwise(p)) for p in paths]
        chances = np.exp(scores) / np.exp(scores).sum()
        for p, chance in zip(paths, chances, strict=True):
            for y, f in zip(p, features, strict=True):
                want_w[y, list(f)] += chance
            for a, b in itertools.pairwise(p):
                want_t[a, b] += chance
    groups = list(quality._alike(docs))
    assert len(groups) > 1 and sum(len(lengths) for _, _, lengths in groups) == len(docs)
    sums = [quality._expected(x, lengths, w, t) for x, _, lengths in groups]
    assert np.allclose(sum(s for s, _ in sums), want_w) and np.allclose(sum(s for _, s in sums), want_t)


def test_one_long_document_does_not_make_all_long():
    rnd = random.Random(3)
    docs = random_docs(rnd, [rnd.randint(1, 12) for _ in range(400)] + [5000])
    tracemalloc.start()
    w, t = quality.fit_crf(docs, rounds=2)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # 5,000 lines for each of 401 documents would take 240 MB in one array
    assert peak < 12 << 20 and np.isfinite(w).all() and np.isfinite(t).all()
