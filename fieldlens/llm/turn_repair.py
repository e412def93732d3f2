"""Repair of conversations: the cheapest edits that make their roles ``(s?(ua)+)?``, by weighted CYK parsing of spans.

**Grammar.** The nonterminals are pairs (p, q) of what may precede and follow a span: nothing yet (0), a system turn
(1), a user turn (2), an assistant turn (3). In Chomsky normal form (p, q) -> (p, r) (r, q) for every r between, and
(p, q) -> row with any edit of the row that leads from p to q. Insertions are unit rules; their closure is taken into
the rules of a row, in front of the edit, and behind the last row once. A cell holds, for each pair, the least
(cost, audit), audit being the edits' initials. Two audits of one span and one p have as many row edits each and end
with one, so neither begins with the other, and the least audit of two joined spans is joined from least ones.

**Spans.** Rows lie in one order over the table; SEGMENT places of it in one conversation make a segment, so a
conversation of any length is many segments. In a segment all spans of up to BLOCK rows are parsed by length over every
split, and spans of blocks are joined by length. Over the segments of a conversation costs and the order of audits are
enough: the costs to the end are summed from the last segment, then the least audit is followed from the first. Texts
are not part of the parse; they are shuffled once, to be written in order beside the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare
from fieldlens.session import io_tasks, materialized

#: Rows of the order over the table that share a segment (a power of two), and of a span that is parsed over all splits.
SEGMENT_BITS, BLOCK = 10, 8
#: Costs of edits; TRUNCATED comes on top where a truncated row stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 50

_BLANKS = r" \t\n\u000b\u000c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role initial leads to, from where.
_STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLES = {"u": "user", "a": "assistant"}
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q == START or q >= SYSTEM and (p == START or p == q or q >= USER)]
_NUMBER = {pair: i for i, pair in enumerate(PAIRS)}
#: For each nonterminal the pairs it may be made of.
RULES = [[(_NUMBER[p, r], _NUMBER[r, q]) for r in range(4) if (p, r) in _NUMBER and (r, q) in _NUMBER] for p, q in PAIRS]
Cell = list[tuple[int, str] | None]


def _insertions(p: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) of what insertions alone lead to; a state is first reached at its least cost."""
    found, todo = {p: (p, 0, "")}, [p]
    for state in todo:
        for role in _ROLES:
            after = _STEPS.get((state, role))
            if after is not None and after not in found:
                found[after] = (after, found[state][1] + INSERT, found[state][2] + "I")
                todo.append(after)
    return list(found.values())


def row_cell(initial: str, gone: bool, truncated: bool) -> Cell:
    """Cell of one row, insertions before it included. ``gone`` rows can only be deleted."""
    cell: Cell = [None] * len(PAIRS)
    extra = TRUNCATED if truncated else 0
    for p in range(4):
        for r, cost, audit in _insertions(p):
            edits = [(r, DELETE, "D")]
            if not gone:
                edits += [(_STEPS[r, initial], extra, "K")] if (r, initial) in _STEPS else []
                edits += [(_STEPS[r, role], REROLE + extra, "R") for role in _ROLES if (r, role) in _STEPS]
            for q, more, letter in edits:
                i, value = _NUMBER[p, q], (cost + more, audit + letter)
                if cell[i] is None or value < cell[i]:
                    cell[i] = value
    return cell


def joined(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """Cell of two neighbouring spans; the lesser of it and ``into`` by nonterminal."""
    out = into if into is not None else [None] * len(PAIRS)
    for i, parts in enumerate(RULES):
        best = out[i]
        for x, y in parts:
            if left[x] is not None and right[y] is not None:
                cost = left[x][0] + right[y][0]
                if best is None or cost <= best[0]:
                    value = (cost, left[x][1] + right[y][1])
                    if best is None or value < best:
                        best = value
        out[i] = best
    return out


def parsed(rows: list[Cell]) -> Cell:
    """Cell of all rows: spans inside blocks by length and over every split, then spans of blocks by length."""
    spans = []
    for first in range(0, len(rows), BLOCK):
        block = rows[first : first + BLOCK]
        chart = {(i, 1): cell for i, cell in enumerate(block)}
        for length in range(2, len(block) + 1):
            for i in range(len(block) - length + 1):
                cell = None
                for split in range(1, length):
                    cell = joined(chart[i, split], chart[i + split, length - split], cell)
                chart[i, length] = cell
        spans.append(chart[0, len(block)])
    while len(spans) > 1:
        spans = [joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


#: (cost, audit) of the insertions behind the last row, from each state to an end.
ENDINGS = [min((cost, audit) for state, cost, audit in _insertions(p) if state in (START, ASSISTANT)) for p in range(4)]


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults made by crc32 of ``conv_id:turn`` modulo 20: 0 leaves the row out, 1 empties its text, 2 takes its end marks,
    3 repeats it, 4 makes its role user. Null values count as one space; turn itself stays null."""
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(_key(), F.lit(":"), turn)) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", code.alias("_code"),
        F.when(code == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).filter("_code != 0")
    copies = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_code", "_copy")


def _rows(conversations: DataFrame) -> DataFrame:
    """_key, turn, role, text and the digests that order rows of one turn; nulls are one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        _key().alias("_key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(1), text, role).alias("d2"),
    )


#: Rising order puts null turns first.
_ORDER = ["_key", "turn", "d1", "d2"]


def faults(conversations: DataFrame) -> DataFrame:
    """_key, _at (a place in an order by conversation and turn), turn, initial, blank, duplicate, truncated of every row."""
    end = F.expr(f"trim(TRAILING '{_BLANKS}' FROM text)")
    rows = _rows(conversations).withColumn("_end", end).select(
        "_key", "turn", "d1", "d2", F.substring("role", 1, 1).alias("initial"), (F.col("_end") == "").alias("blank"),
        (~F.substring("_end", -1, 1).isin(".", "!", "?")).alias("unended"),
    )
    rows = materialized(rows, "turns")
    rows = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("_at", F.monotonically_increasing_id())
    rows = materialized(rows, "turns-in-order")
    again = rows.groupBy("_key", "d1", "d2").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = again.select(F.col("_key").alias("_k"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "_first")
    rows = rows.join(again, (F.col("_key") == F.col("_k")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    return rows.select(
        "_key", "_at", "turn", "initial", "blank", duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("unended")).alias("truncated")
    )


_COUNTED = ["blank", "duplicate", "truncated"]
SEGMENTS = (
    "_key string, _seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "costs array<long>, places array<int>, audits array<string>"
)
_SEGMENT_KINDS = [
    pa.string(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()),
]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells and counts of segments, whose rows come one after another."""
    leaves: dict[tuple, Cell] = {}
    now, rows = None, []

    def close() -> tuple:
        cells = []
        for initial, blank, duplicate, truncated in rows:
            kind = (initial, blank or duplicate, truncated)
            if kind not in leaves:
                leaves[kind] = row_cell(*kind)
            cells.append(leaves[kind])
        # a nonterminal that the span cannot be (a system turn that is not there) costs more than any parse
        cell = [c or (NEVER, "") for c in parsed(cells)]
        initials = [r[0] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
        # the order of audits that lead away from one state
        places = [sum(other[1] < own[1] for (p, _), other in zip(PAIRS, cell, strict=True) if p == pair[0]) for pair, own in zip(PAIRS, cell, strict=True)]
        return (*now, *(sum(r[i] for r in rows) for i in (1, 2, 3)), illegal, initials[0], initials[-1], [c for c, _ in cell], places, [a for _, a in cell])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*done, strict=True), _SEGMENT_KINDS, strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")]
        )

    done = []
    for b in batches:
        for key, seg, *row in zip(*(b.column(c).to_pylist() for c in ("_key", "_seg", "initial", *_COUNTED)), strict=True):
            if (key, seg) != now:
                if rows:
                    done.append(close())
                now, rows = (key, seg), []
                if len(done) >= 256:
                    yield batch(done)
                    done = []
            rows.append(row)
    if rows:
        done.append(close())
    if done:
        yield batch(done)


CHOSEN = (
    "_key string, _seg long, _pair int, tail string, blank long, duplicate long, truncated long, illegal long, cost long"
)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nonterminal of every segment on the least parse of its conversation; totals stand with the last segment."""
    now, rows = None, []

    def close() -> list[tuple]:
        after, ahead = [c for c, _ in ENDINGS], []
        for row in reversed(rows):
            ahead.append(after)
            costs = row["costs"]
            after = [min(costs[i] + after[q] for i, (a, q) in enumerate(PAIRS) if a == p) for p in range(4)]
        out, state = [], START
        for row, after in zip(rows, reversed(ahead), strict=True):
            i = min((row["costs"][i] + after[q], row["places"][i], i) for i, (p, q) in enumerate(PAIRS) if p == state)[2]
            state = PAIRS[i][1]
            out.append([now, row["_seg"], i, "", 0, 0, 0, 0, 0])
        across = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
        cost = sum(row["costs"][o[2]] for row, o in zip(rows, out, strict=True)) + ENDINGS[state][0]
        out[-1][3:] = [ENDINGS[state][1], *(sum(r[c] for r in rows) for c in _COUNTED), sum(r["illegal"] for r in rows) + across, cost]
        return out

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]
    for b in _with_end(batches):
        done: list = []
        for row in b.to_pylist() if b is not None else [None]:
            if row is None or row["_key"] != now:
                done += close() if rows else []
                now, rows = row and row["_key"], []
            if row is not None:
                rows.append(row)
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CHOSEN.split(", ")]
            )


def parse(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report (_key, gaps, blank, duplicate, truncated, illegal, cost) and audits by segment (_key, _seg, audit)."""
    rows = materialized(faults(conversations), "faults")
    seg = F.shiftright("_at", SEGMENT_BITS).alias("_seg")
    # a number of tasks: the rows are a few bytes each, but parsing them is the work
    dealt = rows.select("_key", seg, "_at", "initial", *_COUNTED).repartition(io_tasks(rows.sparkSession), "_key", "_seg").sortWithinPartitions("_key", "_seg", "_at")
    segments = materialized(dealt.drop("_at").mapInArrow(_segments, SEGMENTS), "segments")
    chosen = segments.drop("audits").repartition("_key").sortWithinPartitions("_key", "_seg").mapInArrow(_chosen, CHOSEN)
    chosen = materialized(chosen, "chosen")
    named = chosen.select(F.col("_key").alias("_k"), F.col("_seg").alias("_s"), "_pair", "tail")
    audits = segments.join(named, (F.col("_key") == F.col("_k")) & (F.col("_seg") == F.col("_s"))).select(
        "_key", "_seg", F.concat(F.get("audits", F.col("_pair")), F.col("tail")).alias("audit")
    )
    numbered = rows.groupBy("_key", "turn").agg(F.count("*").alias("_n")).groupBy("_key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    totals = chosen.groupBy("_key").agg(*[F.sum(c).alias(c) for c in (*_COUNTED, "illegal", "cost")])
    return numbered.join(totals, "_key"), audits


TURNS = "_key string, position long, role string, text string"


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns as the audit says; a conversation's audit comes before its rows."""
    now, audit, at, state, position = None, [], 0, START, 0
    for b in batches:
        out = []

        def insertions():
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                role = "u" if (state, "u") in _STEPS else "a"
                state = _STEPS[state, role]
                out.append((now, position, _ROLES[role], ""))
                position += 1
                at += 1

        for key, piece, last, role, text in zip(*(b.column(c).to_pylist() for c in ("_key", "audit", "last", "role", "text")), strict=True):
            if key != now:
                now, audit, at, state, position = key, [], 0, START, 0
            if piece is not None:
                audit.append(piece)
                if last:
                    audit = "".join(audit)
                    insertions()
                continue
            letter = audit[at]
            at += 1
            if letter != "D":
                if letter == "R":
                    initial = "u" if (state, "u") in _STEPS else "a"
                    role = _ROLES[initial]
                state = _STEPS[state, role[0]]
                out.append((now, position, role, text))
                position += 1
            insertions()
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["_key", "position", "role", "text"]
        )


def repaired_turns(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """_key, position, role, text of the repaired conversations, in order inside every partition."""
    ends = audits.groupBy(F.col("_key").alias("_k")).agg(F.max("_seg").alias("_end"))
    pieces = audits.join(ends, F.col("_key") == F.col("_k")).select(
        "_key", F.lit(0).alias("_kind"), "_seg", F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", (F.col("_seg") == F.col("_end")).alias("last"),
    )
    texts = _rows(conversations).withColumns({
        "_kind": F.lit(1), "_seg": F.lit(0).cast("long"), "audit": F.lit(None).cast("string"), "last": F.lit(False),
    })
    laid = pieces.unionByName(texts).repartition("_key").sortWithinPartitions("_key", "_kind", "_seg", "turn", "d1", "d2")
    return laid.select("_key", "audit", "last", "role", "text").mapInArrow(_rendered, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """_key, sha256: the digest of ``role:text`` of a conversation's turns, parted by line feeds. The turns of a
    conversation come one after another; the digest goes on from row to row, so no conversation is held."""

    def run(batches):
        now, digest = None, None
        for b in _with_end(batches):
            out = []
            for key, role, text in zip(*(b.column(c).to_pylist() for c in ("_key", "role", "text")), strict=True) if b is not None else [(None, "", "")]:
                if key != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            columns = list(zip(*out, strict=True)) if out else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["_key", "sha256"])

    return turns.mapInArrow(run, "_key string, sha256 string")


def repair(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """One row per conv_id of ``conversations``, null included: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    Rows are taken by turn, null turns first, rows of one turn by a digest of role and text; null role and text are one space. With ``damage``
    the rows are ``damaged`` first. A conversation whose rows are all gone has zeros, an empty audit and the digest of the empty
    string. Repeated rows are duplicates; very long texts are only streamed; other columns are ignored; an empty table
    gives an empty result. Role and text of one conversation are told apart by 128 bits of hash. The digest of one
    conversation is one stream of its texts, which one task reads without holding it.
    """
    prepare(conversations.sparkSession)
    rows = damaged(conversations) if damage else conversations
    report, audits = parse(rows)
    audits = materialized(audits, "audits")
    hashed = digests(repaired_turns(rows, audits))
    whole = audits.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_seg", "audit"))).alias("_p")).select(
        "_key", F.array_join(F.transform("_p", lambda p: p["audit"]), "").alias("audit")
    )
    every = conversations.groupBy("conv_id").agg(F.count("*").alias("_n")).select("conv_id", _key().alias("_key"))
    found = every.join(report, "_key", "left").join(whole, "_key", "left").join(hashed, "_key", "left")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTED, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
