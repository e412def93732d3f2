"""Conversation repair, periodic runs and benchmark windows against brute-force versions, and their results for odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from fieldlens.llm import catalog, fm_index, periodic_runs, turn_repair

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# 11 conversation structure repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def flagged(rows):
    """Rows as (initial, fault) in order; fault is one letter."""
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        fault = "b" if not last else "d" if (role, text) in seen else "" if last in ".!?" else "t"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(marks):
    """(cost, audit, output) from the end: a walk over rows done, last initial put out, insertions since the last row."""

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        options = [(0, "", ())] if i == len(marks) and last in ("", "a") else [(10**9, "", ())]

        def edit(cost, letter, initial, rest):
            options.append((cost + rest[0], letter + rest[1], ((letter, initial), *rest[2])))

        if inserted < 2:
            for x in follow.replace("s", ""):
                edit(5, "I", x, best(i, x, inserted + 1))
        if i < len(marks):
            initial, fault = marks[i]
            extra = 5 if fault == "t" else 0
            edit(2, "D", "", best(i + 1, last, 0))
            if fault not in ("b", "d"):
                if initial and initial in follow:
                    edit(extra, "K", initial, best(i + 1, initial, 0))
                for x in follow.replace("s", ""):
                    edit(1 + extra, "R", x, best(i + 1, x, 0))
        return min(options)

    for i in range(len(marks), 0, -50):
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def enumerated(marks):
    """Least (cost, audit) over all edit strings of bounded length, judged by the pattern alone."""
    found = []
    n = len(marks)
    for slots in itertools.product(["", "I", "II"], repeat=n + 1):
        for letters in itertools.product("DKR", repeat=n):
            audit = "".join(s + e for s, e in zip(slots, (*letters, ""), strict=True))
            cost, i, shape = 0, 0, []
            for e in audit:
                if e == "I":
                    cost += 5
                    shape.append("[ua]")
                    continue
                initial, fault = marks[i]
                i += 1
                if e == "D":
                    cost += 2
                    continue
                if fault in ("b", "d") or (e == "K" and initial not in ("s", "u", "a")):
                    break
                cost += (e == "R") + 5 * (fault == "t")
                shape.append("[ua]" if e == "R" else initial)
            else:
                k = len(shape)
                goals = [g for g in ("", *("s" * s + "ua" * m for s in (0, 1) for m in range(1, k + 1))) if len(g) == k]
                if any(re.fullmatch("".join(shape), g) for g in goals):
                    found.append((cost, audit))
    return min(found)


def reported(conv, rows):
    marks = flagged(rows)
    cost, audit, output = cheapest(marks)
    left, lines = iter(rows), []
    for edit, initial in output:
        if edit == "I":
            lines.append({"u": "user:", "a": "assistant:"}[initial])
            continue
        _, _, role, text = next(left)
        if edit != "D":
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
    turns = [t for _, t, _, _ in rows if t is not None]
    faults = [f for _, f in marks]
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marks, marks[1:])), cost, audit, sha("\n".join(lines)),  # noqa: B905
    )


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


def random_marks(rnd, n):
    return [(rnd.choice(["u", "a", "s", "u", "a", "x", ""]), rnd.choice(["", "", "", "t", "d", "b"])) for _ in range(n)]


def spelled(marks):
    """Cell of the whole and the ending, as the operator parses it."""
    if not marks:
        return 0, ""
    cell = turn_repair.parsed([turn_repair.row_cell(i, f in ("b", "d"), f == "t") for i, f in marks])
    ends = turn_repair.ENDINGS
    return min((c[0] + ends[q][0], c[1] + ends[q][1]) for (p, q), c in zip(turn_repair.PAIRS, cell, strict=True) if p == 0 and c)


def test_cells_equal_all_edit_strings():
    rnd = random.Random(5)
    for _ in range(150):
        marks = random_marks(rnd, rnd.randint(0, 4))
        assert spelled(marks) == enumerated(marks), marks
        assert cheapest(marks)[:2] == enumerated(marks), marks


def test_cells_equal_a_walk_over_long_conversations():
    rnd = random.Random(6)
    for n in (7, 8, 9, 31, 64, 150):
        for _ in range(8):
            marks = random_marks(rnd, n)
            assert spelled(marks) == cheapest(marks)[:2], marks


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    groups = {c: [] for c, *_ in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    expected = {c: reported(c, by_turn(own)) for c, own in groups.items()}
    found = {r.conv_id: tuple(r) for r in catalog.QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert found == expected


def test_repair_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "SEGMENT_BITS", 4)
    rnd = random.Random(9)
    long = [(3, t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["A.", "B.", f"{t}.", f"{t}", " \t", f"a\nb {t}! \n"])) for t in range(700)]
    rows = [
        (1, None, "user", "no turn."), (1, 4, "user", "first."), (1, 9, "assistant", "last?"), (2, 0, None, None), (2, 1, "user", None), (None, 0, "user", "x."),
        (None, 1, "assistant", "y."), (4, 0, "", "empty role."), (4, 1, "user", "u." * 200000), (4, 2, "assistant", "end!\x0b\x0c"), (5, None, "system", "only."),
        (6, 0, "user", "same."), (6, 0, "user", "same."), (6, 1, "assistant", "f"), (-7, -3, "user", "é."), (-7, 8, "assistant", "日本。"), *long,
    ]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, _key string, gaps int").repartition(5)
    for damaging in (False, True):
        groups = {c: [] for c, *_ in rows}
        for r in damage(rows) if damaging else [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows]:
            groups[r[0]].append(r)
        expected = {c: reported(c, by_turn(own)) for c, own in groups.items()}
        found = {r.conv_id: tuple(r) for r in turn_repair.repair(table, damaging).collect()}
        assert found == expected
    assert turn_repair.repair(table.limit(0)).count() == 0


# 12 periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                own = words[i : i + size]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(doc_id, text):
    words = SPACE.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 12000]
    assert len(short) > 150
    found = {r.doc_id: tuple(r) for r in catalog.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(docs)
    for r in short:
        assert found[r.doc_id] == collapsed(r.doc_id, r.text)
    assert sum(f[1] > 0 for f in found.values()) >= 10


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            n, k = rnd.randint(0, 60), rnd.choice([1, 2, 2, 3, 5])
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a = rnd.randrange(n)
                p = 1 + (n - a) // (3 + rnd.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        expected, start = [], 0
        for w in texts:
            expected += [(start + s, size, q) for s, size, q in brute_runs(w)]
            start += len(w)
        symbols = np.array([x for w in texts for x in w], dtype=np.int64)
        found = periodic_runs.runs_of(symbols, np.repeat(np.arange(len(texts)), [len(w) for w in texts])) if len(symbols) else np.zeros((0, 3))
        assert [tuple(r) for r in found.tolist()] == expected


def test_ordered_positions_over_many_blocks():
    rnd = random.Random(2)
    order = rnd.sample(range(5000), 5000)
    held, positions = [order[0]], periodic_runs.Positions(order[0])
    for p in order[1:]:
        before, after = max((x for x in held if x < p), default=-1), min((x for x in held if x > p), default=-1)
        if len(held) < 1500:
            assert positions.add(p) == (before, after)
        else:
            break
        held.append(p)
    assert list(positions) == sorted(held)


def test_runs_of_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b c " * 4), (6, "x " * 30000), (7, "é é\x0bé é é é q é"),
        (8, "p q r s t " * 3), (9, "p q r s t " * 4), (10, " ".join(f"w{i % 977} v{i % 31}." for i in range(1500))),
    ]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start int, kept string")
    found = periodic_runs.periodic_runs(table).collect()
    assert len(found) == len(rows)
    for r, (doc_id, text) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        words = SPACE.findall(text or "")
        runs = [(0, 30000, 1)] if doc_id == 6 else brute_runs(words)
        assert [tuple(x) for x in r.runs] == runs
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        assert (r.n_words, bytes(r.kept).decode()) == (len(words), " ".join(w for i, w in enumerate(words) if i not in gone))
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


# 13 benchmark windows


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def leaks(docs, items, size=10):
    wanted = {}
    for key, text in items:
        w = terms(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add("" if key is None else str(key))
    lengths = {len(w) for w in wanted}
    out = []
    for doc_id, text in docs:
        w = terms(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def test_leaks_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = sorted(tuple(r) for r in catalog.QUERIES["op13_benchmark_leaks"](spark, SF).collect())
    assert found == sorted(leaks(docs, items))
    assert any(r[-1] for r in found)


@pytest.mark.parametrize(("shard", "block", "located"), [(1 << 20, 1 << 16, 1 << 18), (40, 7, 5)])
def test_leaks_of_odd_rows(spark, monkeypatch, shard, block, located):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("LOCATED", located)):
        monkeypatch.setattr(fm_index, name, value)
    rnd = random.Random(4)
    prose = lambda n, k: " ".join(f"w{rnd.randrange(k)}" for _ in range(n))
    passage = prose(14, 50)
    items = [(1, passage), (2, passage.upper().replace(" ", "; ")), (3, "Łódź"), (4, "one two"), (None, "two three"), (5, None), (6, "..."), (4, "x y z"), (7, prose(25, 3))]
    docs = [
        (1, None), (2, ""), (3, "?!"), (4, f"Begin {passage} end {passage}"), (4, f"Begin {passage} end {passage}"), (None, f"null id {passage.replace(' ', ' - ')}"),
        (5, "one two three one-two"), (6, "ŁÓDŹ Łódź łódź"), (7, prose(3000, 3)), (8, passage[: len(passage) // 2]), (9, "x y z " * 5000), (10, "y z x"),
    ]
    table = spark.createDataFrame([(*d, 0, "s") for d in docs], "doc_id long, text string, shard int, items string").coalesce(1)
    given = spark.createDataFrame([(*i, "w") for i in items], "item_id long, text string, window string")
    found = fm_index.contamination(table, given).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), len(r["items"]), sha(",".join(r["items"])), bool(r.spans)) for r in found), key=repr)
    assert got == sorted(leaks(docs, items), key=repr)
    for r in found:
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))  # noqa: B905
    if shard == 40:
        return
    assert fm_index.contamination(table.limit(0), given).count() == 0
    clean = fm_index.contamination(table, given.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.spans for r in clean)


def test_index_ranks_and_places():
    rnd = random.Random(3)
    parts, at = [], 0
    for d in range(30):
        own = np.array([rnd.randrange(1, 9) for _ in range(rnd.randint(1, 40))], dtype=np.uint64)
        parts.append((d, at, own))
        at += 3
    row = fm_index._indexed(0, list(range(30)), [40] * 30, parts).to_pylist()[0]
    shard = fm_index.Shard(row)
    for n in (1, 2, 3, 5):
        for _ in range(40):
            pattern = np.array([[rnd.randrange(1, 10) for _ in range(n)]], dtype=np.uint64)
            low, high = shard.search(pattern, np.array([n]))
            expected = sorted(
                int(start) + i
                for start, (_, _, own) in zip(shard.stretch_at, parts, strict=True)
                for i in range(len(own) - n + 1)
                if (own[i : i + n] == pattern[0]).all()
            )
            assert sorted(shard.locate(np.arange(low[0], high[0])).tolist()) == expected
