"""Each operator against a brute-force version, and its defined results for odd rows."""

import hashlib
import html
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldlens.llm import (
    components, exact_dedup, html_tree, langid, mixing, ngram_join, quality, sentencepiece_scan, spans, suffix_dedup, token_counts, unigram,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


LONG = " ".join(f"word{i % 700} other{i % 31}." for i in range(9000))
ODD = [
    (1, None, "en", "b"), (2, "", None, None), (3, " \t\n", "fr", "b"), (4, "one", "en", "a"), (5, LONG, "en", "a"), (6, LONG, None, "a"),
    (7, "Twice the same row, twice the same row here.", "en", ""), (7, "Twice the same row, twice the same row here.", "en", ""),
    (None, "no id has this text at all", "de", "b"), (8, "123 456 $$$", "en", "c"), (9, "a b ▁ ☃ \U0001f600", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, n long, _id string, h string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, blank, very long, repeated and id-less rows, with columns that clash with names used inside."""
    return spark.createDataFrame([(*r, True, 5, "x", "y", "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_every_operator_takes_an_empty_table(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert langid.with_known_language(empty).columns == empty.columns
    assert mixing.pareto_mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert sentencepiece_scan.decode(sentencepiece_scan.encode(empty)).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.one_per_group(empty).count() == 0
    assert quality.assess(empty, quality.train(empty, labels)).count() == 0
    assert spans.remove_repeats(empty).count() == 0
    assert token_counts.count_tokens(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.without_copies(empty).count() == 0
    assert html_tree.extract(pages).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 language ID


def test_language_of_held_out_documents(docs):
    found = langid.identify(docs, langid.train(langid.training_rows(docs))).withColumn("held", langid.held_out())
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = found.filter("held").collect()
    assert len(rows) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(docs, odd):
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd, model).collect()}
    assert {i for i, und in got if und} == {1, 2, 3, 8}
    kept = langid.with_known_language(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, None, 9}


def test_one_language_and_none(spark):
    one = spark.createDataFrame([(i, f"some words {i}", "xx") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(one, langid.train(one)).collect()} == {"xx"}
    none = one.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in langid.identify(none, langid.train(none)).collect()} == {("und", 0.0)}


def test_more_than_200_languages_are_all_learned(spark):
    """The rarest of 215 languages have two rows each and are still answered by their own name."""
    rng = np.random.default_rng(23)
    rows = []
    for k in range(215):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 30)), f"x\t{k:03d}" if k % 7 else f"en-{k}") for i in range(3 if k < 200 else 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(table)
    assert sum(map(len, model.languages.values())) == 215
    got = {r.doc_id: r.lang_pred for r in langid.identify(table, model).collect()}
    right = [got[d] == lang for d, _, lang in rows]
    assert all(right[600:]) and sum(right) >= 0.97 * len(rows)


# 2 mixing


def water(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = left / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= set(over)
        left -= 2 * sum(sizes[s] for s in over)


def test_mix_meets_targets(docs, texts):
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = defaultdict(int)
    for d, t in texts.items():
        sizes[source[d]] += len(WORD.findall(t))
    want = water(sizes)
    rows = mixing.pareto_mix(docs).collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(texts[r.doc_id])) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert len(rows) == len(texts)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    again = {(r.doc_id, r.taken) for r in mixing.pareto_mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_odd_rows(odd):
    rows = mixing.pareto_mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mixed_documents(odd).columns == odd.columns


# 3 SentencePiece, 8 token counts


@pytest.fixture(scope="module")
def vocab():
    return unigram.vocabulary(unigram.model_bytes(sentencepiece_scan.MODEL))


def whole(vocab, text):
    s = unigram.marked(text)
    best, start, piece = vocab.forward(s, {0: 0}, len(s))
    return vocab.trace(s, start, piece, len(s))[0], best[-1] / unigram.SCALE


def test_encoding_round_trip_and_counts(docs, texts, vocab):
    encoded = sentencepiece_scan.encode(docs, chunk=512, block=3).cache()
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert encoded.filter("n_chunks > 3").count() > 10
    for d, t in list(texts.items())[:60]:
        if len(t) < 6000:
            assert ids[d] == whole(vocab, t)[0]
    assert {r.doc_id: r.text for r in sentencepiece_scan.decode(encoded).collect()} == texts
    encoded.unpersist()
    counts = {r.doc_id: (r.n_tokens, r.score) for r in token_counts.count_tokens(docs).collect()}
    assert {d: n for d, (n, _) in counts.items()} == {d: len(i) for d, i in ids.items()}
    for d, t in list(texts.items())[:40]:
        if len(t) < 6000:
            assert counts[d][1] == pytest.approx(whole(vocab, t)[1])


def test_encoding_agrees_with_the_library(texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    raw = unigram.model_bytes(sentencepiece_scan.MODEL)

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(data, change):
        out = b""
        for f, v in unigram.fields(data):
            v = change(f, v)
            out += number(f << 3) + number(v) if isinstance(v, int) else number(f << 3 | (2 if len(v) != 4 or f in (1, 2, 3) else 5)) + (b"" if len(v) == 4 and f not in (1, 2, 3) else number(len(v))) + v
        return out

    pieces, spec = [], []
    for f, v in unigram.fields(raw):
        (pieces if f == 1 else spec).append((f, v))
    trainer = number(3 << 3) + number(1)  # model type: unigram
    for f, v in unigram.fields(dict(spec)[2]):
        if f in (4, 35):
            trainer += number(f << 3) + number(v)
    model = b"".join(number(1 << 3 | 2) + number(len(v)) + v for _, v in pieces) + number(2 << 3 | 2) + number(len(trainer)) + trainer
    model += number(3 << 3 | 2) + number(len(dict(spec)[3])) + dict(spec)[3]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    v = unigram.vocabulary(raw)
    words = sorted({w for t in list(texts.values())[:20] for w in t.split() if len(w) < 9 and w.isascii()})[:400]
    for w in words:
        # the exact lattice of the library; its scores are single precision, exact for words
        assert library.nbest_encode_as_ids(w, 2)[0] == np.frombuffer(v.word_ids(unigram.marked(w)), "<i4").tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 33, 100])
def test_chunk_scan_equals_the_whole(vocab, size):
    def scan(s):
        cs = [sentencepiece_scan.Chunk(vocab, s[i : i + size], s[i + size : i + size + vocab.longest - 1]) for i in range(0, len(s), size)]
        v = np.full(vocab.longest, -np.inf)
        v[0] = 0
        entering = []
        for c in cs:
            entering.append(v)
            v = (v[:, None] + c.matrix()).max(axis=0)
        state, out = 0, []
        for c, e in zip(reversed(cs), reversed(entering), strict=True):
            came = int(c.origins(e)[state])
            out.append(c.ids(e, came, state))
            state = came
        return np.frombuffer(b"".join(reversed(out)), "<i4").tolist()

    for t in ("ab" * 50 + " \n  ☃☃" + "q" * 70, "x", "  " * 20, "thethethe" * 30, "internationalisation " * 9, "ééü" * 20, " " * 40 + "a"):
        assert scan(unigram.marked(t)) == whole(vocab, t)[0]


def test_codec_odd_rows(odd):
    encoded = sentencepiece_scan.encode(odd, chunk=64, block=2)
    rows = sorted((r.doc_id or 0, r.text) for r in sentencepiece_scan.decode(encoded).collect())
    # the vocabulary's own blank mark reads as a blank
    assert rows == sorted((d or 0, (t or "").replace("▁", " ")) for d, t, *_ in ODD)
    counts = token_counts.count_tokens(odd).collect()
    assert len(counts) == len(ODD) and {r.n_tokens for r in counts if r.doc_id in (1, 2)} == {0}


# 4 repeated byte strings


def removed(texts):
    data = {k: t.encode() for k, t in texts.items()}
    seen = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    out = {}
    for k, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[k] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("share", [8192, 1])
def test_repeated_strings(docs, texts, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)  # 1: every group goes the way of very frequent anchors
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed(texts)


def test_repeated_strings_inside_and_at_the_limit(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(map(chr, rng.integers(33, 120, n)))
    p = noise(260)
    cases = {1: "abc" * 200, 2: noise(300) + p[:199] + "!" + noise(50), 3: p[:199] + "?" + noise(100), 4: noise(20) + p + noise(30) + p[:230],
             5: "é" * 150, 6: "é" * 99, 7: "x" * 200, 8: "x" * 199}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert got == removed(cases)


def test_repeated_strings_odd_rows(odd):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (1, 2, 5, 6)} == {1: 0, 2: 0, 5: len(LONG), 6: len(LONG)}


# 5 n-gram Jaccard join


def classes(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}



def test_mix_takes_equal_ranks_in_one_order(spark):
    """Rows without an id and of one size rank alike; which of them come twice depends on their texts."""
    rows = [(None, "b", f"x{k} y z") for k in range(60)] + [(k, "a", "one two three four") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = [
        sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in mixing.mixed_documents(docs.orderBy(F.rand(seed)).repartition(parts)).collect())
        for seed, parts in ((1, 2), (2, 7))
    ]
    assert taken[0] == taken[1]
    assert set(Counter(t for t, d in taken[0] if d < 0).values()) == {1, 2}

def test_near_duplicates(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == classes(texts)
    assert sum(d != c for d, (_, c) in got.items()) > 5


@pytest.mark.parametrize("share", [4096, 1])
def test_chains_and_stars(spark, monkeypatch, share):
    """Edited copies of which only some are linked, as a chain and around one origin; also with dealt blocks."""
    monkeypatch.setattr(ngram_join, "SHARE", share)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(words, 160))
    cases, current = {}, list(base)
    for d in range(20):
        current = list(current)
        for _ in range(4):
            current[rng.integers(len(current))] = f"edit{rng.integers(10**6)}"
        cases[d] = " ".join(current)
    for d in range(20, 60):
        copy = list(base)
        for _ in range(int(rng.integers(1, 7))):
            copy[rng.integers(len(copy))] = f"edit{rng.integers(10**6)}"
        cases[d] = " ".join(copy)
    for d in range(60, 70):
        cases[d] = " ".join([*base[:60], *rng.choice(words, 100)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(list(cases.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == classes(cases)


def test_count_tree_bounds():
    """The tree rules out no pair that reaches the threshold, and finds the entry of the highest bound in a small tree."""
    rng = np.random.default_rng(11)
    pool = np.unique(rng.integers(0, 1 << 48, 400, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool[: rng.integers(40, len(pool))], 30, replace=False)) for _ in range(40)]
    sets += [np.sort(np.concatenate([s[: 30 - k], rng.choice(pool[-50:], k, replace=False)])) for k, s in enumerate(sets[:8])]
    sets = [np.unique(s) for s in sets]
    vec = ngram_join.vectors([ngram_join.point(s) for s in sets])
    size = np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(vec, size, size)
    kept = {(int(q), int(e)) for qs, es in tree.near(vec, size, size) for q, e in zip(qs, es, strict=True)}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert (i, j) in kept
    bound = np.minimum(vec[:, None], vec[None]).sum(axis=2, dtype=np.int64)
    value = 180 * np.minimum(bound, np.minimum(size[:, None], size[None])) - 80 * (size[:, None] + size[None])
    q, e = tree.nearest(vec, size, size)
    assert q.tolist() == np.flatnonzero(value.max(axis=1) >= 0).tolist()
    assert (value[q, e] == value.max(axis=1)[q]).all()


def test_wide_counts_and_mixed_widths():
    few, many = np.arange(3, dtype=np.uint64), np.arange(200_000, dtype=np.uint64)
    got = ngram_join.vectors([ngram_join.point(few), ngram_join.point(many)])
    assert got.sum(axis=1).tolist() == [3, 200_000] and ngram_join.vectors([ngram_join.point(few)]).dtype == np.uint8


def templated(n):
    """14 words each, so 10 shingles, of which the first 8 are the same in all texts."""
    common = " ".join(f"t{k}" for k in range(12))
    return {d: f"{common} a{d} b{d}" for d in range(n)}


def test_template_is_ruled_out_by_the_tree(spark, monkeypatch):
    """Sets that share 8 of 10 shingles share a block but leave no pair to verify; near copies among them are found."""
    tried = []
    true_linked = ngram_join.linked
    monkeypatch.setattr(ngram_join, "linked", lambda pairs, sets: tried.append(pairs.count()) or true_linked(pairs, sets))
    cases = templated(300)
    long = " ".join(f"l{k}" for k in range(60))
    cases |= {1000: long, 1001: f"{long} more", 1002: f"less {long}"}
    rows = spark.createDataFrame(list(cases.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(rows).collect()}
    assert got == classes(cases)
    assert sum(tried) <= 4


def test_near_duplicates_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in ngram_join.near_duplicates(odd).collect()}
    assert {(1, False, 1), (2, False, 2), (3, False, 3), (5, True, 5), (6, True, 5), (7, True, 7), (None, True, None)} <= got
    kept = ngram_join.one_per_group(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 6 quality rules


def test_base_rules(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.assess(docs, quality.train(docs, labels)).collect()
    for r in rows:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        count, marked, seen, again = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if count[x] > 1:
                marked |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(marked), failed
        )
        assert not (failed and r.kept)
    good = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, good[r.doc_id]) for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(k for k, q in judged if q == 1) >= 0.97 * sum(1 for _, q in judged if q == 1)
    assert sum(k for k, q in judged if q == 0) <= 0.2 * max(1, sum(1 for _, q in judged if q == 0))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        scores, trans = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(scores[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(([int(c) for c in f"{n:06b}"] for n in range(64)), key=value)
        assert quality.viterbi(scores, trans).tolist() == best


def test_quality_odd_rows(odd):
    rows = {r.doc_id: r for r in quality.assess(odd, None).collect()}
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[5].n_words == len(LONG.split())


# 7 sentence spans


def test_sentences_cover_the_text(texts):
    for t in [*list(texts.values())[:50], "", "  ", "a", "\n\n a. b! c\n", " x" * 40]:
        parts = spans.sentences(t)
        assert "".join(t[a:b] for a, b, _ in parts) == (t if parts else "")
        assert all(0 < len(w) <= spans.LONGEST for _, _, w in parts)


def test_repeated_sentences(docs, texts):
    def runs(parts):
        for i in range(len(parts)):
            for n in range(spans.SENTENCES, len(parts) - i + 1):
                words = [w for _, _, ws in parts[i : i + n] for w in ws]
                if len(words) >= spans.WORDS:
                    yield i, n, tuple(tuple(ws) for _, _, ws in parts[i : i + n])
                    break

    parts = {d: spans.sentences(t) for d, t in texts.items()}
    first, gone = {}, defaultdict(set)
    for d in sorted(parts):
        for i, n, key in runs(parts[d]):
            if first.setdefault(key, (d, i)) != (d, i):
                gone[d].update(range(i, i + n))
    want = {d: (len(p), len(gone[d]), "".join(texts[d][a:b] for k, (a, b, _) in enumerate(p) if k not in gone[d]) if p else texts[d]) for d, p in parts.items()}
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in spans.remove_repeats(docs).collect()}
    assert got == want
    assert sum(n > 0 for _, n, _ in want.values()) > 5


def test_spans_odd_rows(odd):
    rows = spans.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].text == "" and by[6].text == "" and by[7].n_removed == 0


@pytest.mark.parametrize("marks", ["", ".", "\u3002", "\u061f"])
def test_passages_inside_foreign_sentences_lose_a_run(spark, marks):
    """Passages of 51 words, at all offsets from the start of a foreign sentence, with no mark or some inside."""
    rng = np.random.default_rng(17)
    words = lambda n: [f"v{k}" for k in rng.integers(10**9, size=n)]
    rows, want = [], {}
    for n in range(40):
        passage = words(51)
        if marks:
            for k in rng.integers(4, 47, size=2):
                passage[k] += marks
        rows.append((2 * n, " ".join([*words(int(rng.integers(40))), *passage, *words(20)])))
        front, back = words(n), words(int(rng.integers(30)))
        rows.append((2 * n + 1, " ".join([*front, *passage, *back])))
        want[2 * n + 1] = (front, passage, back)
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, (front, passage, back) in want.items():
        kept = got[d].text.split()
        assert [w for w in kept if w not in passage] == front + back
        assert len(kept) <= len(front + back) + 51 - spans.WORDS
        assert got[d - 1].n_removed == 0


def test_cuts_of_any_sentence():
    rng = np.random.default_rng(2)
    for n in [*range(13, 60), 96, 97, 98, 99, 500]:
        for kinds in (1, 2, 9, 10**6):
            s = [f"k{k}" for k in rng.integers(kinds, size=n)]
            at = [0, *spans.cuts(s), n]
            assert all(0 < b - a <= spans.LONGEST for a, b in zip(at, at[1:], strict=False))
            tail = spans.cuts(s + s[:100])  # the other way of finding them gives the same cuts
            assert [c for c in at[1:-1] if c <= n - spans.LONGEST] == [c for c in tail if c <= n - spans.LONGEST]
    parts = spans.sentences("\u4f60\u597d\u3002\u4e16\u754c\uff01 \u0645\u0631\u062d\u0628\u0627\u061f \u0928\u092e\u0938\u094d\u0924\u0947\u0964 end")
    assert len(parts) == 5


# 9 exact dedup


def test_exact_duplicates(docs, texts):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(d)
    want = {(d, min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()} == want


def test_exact_odd_rows(spark, odd):
    rows = exact_dedup.exact_duplicates(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert (by[2][0].keep_id, by[2][0].group_size, by[2][0].kept) == (1, 2, False)
    assert (by[6][0].keep_id, by[6][0].kept) == (5, False)
    assert sorted(r.kept for r in by[7]) == [False, True] and by[None][0].keep_id is None and by[None][0].kept
    kept = exact_dedup.without_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9]
    # a text with very many copies is cut by splitters and put together again
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'x', concat('a', id % 7)) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_duplicates(many.repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.keep_id, r.group_size, r.kept) for r in got)[(0, 1000, True)] == 1 and sum(r.kept for r in got) == 8


# 10 HTML extraction


def test_article_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = html_tree.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_site_frames_go_and_odd_pages(spark):
    def page(i):
        return (f"<html><head><title>t</title></head><body><div class='top box'>Our site since 1999</div><div id=main{i}><p>Text {i} of page &amp; {i * 7}"
                f"<p>more <b>of</b> it {i}<br>here</div><div class=comments><p>I like it {i}</div><div class='legal box'><p>All rights reserved</p></div></body>")

    rows = [(i, f"http://Site.example/{i}", page(i)) for i in range(12)]
    rows += [(100, "http://one.example/", None), (101, None, ""), (102, "x", "plain &lt;text&gt; only"), (103, "http://b/", "<p>open <a href='x>y'>link</a> <script>if (a<b) '</p>'</script> end"),
             (103, "http://b/", "<p>open <a href='x>y'>link</a> <script>if (a<b) '</p>'</script> end"), (None, "http://b/", "<div>" * 3000 + "deep"), (104, "http://c/", "<p " + "a='" * 500)]
    got = defaultdict(list)
    for r in html_tree.extract(spark.createDataFrame([Row(page_id=a, url=b, html=c, host="clash", low="clash") for a, b, c in rows])).collect():
        got[r.page_id].append(r.text)
    for i in range(12):
        assert got[i] == [f"Text {i} of page & {i * 7}\nmore of it {i} here"]
    assert got[100] == [""] and got[101] == [""] and got[102] == ["plain <text> only"] and got[103] == ["open link end"] * 2 and got[None] == ["deep"]


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("wrap", ["article", "div"])
def test_copies_of_few_articles_keep_their_text(spark, wrap):
    """Hosts of 20 and of 1,000 copies of one to three articles, with session ids in their links."""
    rows, want = [], {}
    for n in (20, 1000):
        for kinds in (1, 2, 3):
            for i in range(n):
                k, d = i % kinds, len(rows)
                rows.append((d, f"http://h{n}-{kinds}.example/{i}", f"<body><div class=top><p>Our site</p></div><{wrap} class=text><h1>Title {k}</h1><p>Story {k} <a href='/?s={i}'>on</a></p></{wrap}></body>"))
                frame = "" if wrap == "article" or kinds > 1 else "Our site\n"  # a host that says one thing has nothing to compare
                want[d] = f"{frame}Title {k}\nStory {k} on"
    assert extracted(spark, rows) == want


def test_class_words_do_not_drop_articles(spark):
    kept = ["content-with-sidebar", "col-md-8 has-sidebar", "article-body no-ads", "post hentry comments-open category-social", "entry tag-search"]
    gone = ["sidebar-left", "ad1", "comments", "site-nav", "social-share", "Cookie_Banner"]
    rows = [(i, "http://a/", f"<div class='{c}'><p>inside</p></div><p>after</p>") for i, c in enumerate(kept + gone)]
    rows += [(100 + i, "http://a/", f"<article class='{c}'><p>inside</p></article><p>after</p>") for i, c in enumerate(kept + gone)]
    rows += [(203, "http://a/", "<main><div class=widget><article><p>inside</p></article></div></main>"), (200, "http://a/", "<div class='widget'><p>x</p><article><p>inside</p><div class=share>s</div></article></div>"),
             (201, "http://a/", "<form><nav>n</nav><main><p>inside</p></main></form>"),
             (202, "http://a/", "<main><p>inside</p><div class=related><article>other</article></div></main><div class=related><article>other</article></div>")]
    want = {i: "inside\nafter" if i < len(kept) else "after" for i in range(len(kept + gone))}
    want |= {100 + i: "inside" for i in range(len(kept + gone))} | {203: "inside", 200: "inside", 201: "inside", 202: "inside"}
    assert extracted(spark, [(i, f"http://a{i}/", h) for i, _, h in rows]) == want


def test_elements_without_an_end_do_not_swallow_the_page(spark):
    cases = {
        "<article>a <svg width='1'/> b <math/> c</article>": "a b c",
        "<article>a <svg><g><svg/></g><svg>y</svg>x</svg> b <svg> c</article>": "a b c",
        "<article>a <svg> b <svg>x</svg> c</article>": "a b c",
        "<article>so <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>tex</annotation></math> holds</article>": "so x=1 holds",
        "<article>a <iframe src=x> b <script>x</script> c</article>": "a b c",
        "<article>a <script>x <b>": "a",
    }
    assert extracted(spark, [(i, f"http://a{i}/", h) for i, h in enumerate(cases)]) == dict(enumerate(cases.values()))
