"""A unigram vocabulary read from a SentencePiece file: pieces, scores, bytes, and where no piece can cross.

Scores are kept as exact whole numbers (hundredths), so sums do not depend on where a text is cut.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick

BLANK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Scores are multiplied by this and rounded.
SCALE = 100
#: What an unknown character costs below the lowest score; fixed value of the file format's library.
UNKNOWN_PENALTY = 10
#: Distinct words remembered per Python worker; a full memory starts anew.
REMEMBERED = 150_000
#: Below any score.
LOWEST = -(1 << 60)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Vocabulary:
    """Matches of a text and what they cost. ``prefixes`` maps every prefix of a piece to its id, or -1."""

    texts: list[bytes]
    prefixes: dict[str, int]
    scores: list[int]
    bytes_ids: list[int]
    unknown_id: int
    unknown_score: int
    longest: int
    splitter: re.Pattern
    cuttable: bool
    automaton: ahocorasick.Automaton
    singles: frozenset[str]
    ids_of: dict[str, bytes] = field(default_factory=dict)
    cost_of: dict[str, tuple[int, int]] = field(default_factory=dict)

    @staticmethod
    def load(data: bytes) -> Vocabulary:
        prefixes: dict[str, int] = {}
        texts, scores, byte_ids, unknown, normal = [], [], [0] * 256, 0, []
        inside: set[str] = set()
        late_blank = False
        for number, value in fields(data):
            if number != 1:
                continue
            entry = dict(fields(value))
            piece = entry[1].decode()
            score = round(struct.unpack("<f", entry[2])[0] * SCALE) if 2 in entry else 0
            kind, i = entry.get(3, NORMAL), len(texts)
            scores.append(score)
            texts.append(piece.replace(BLANK, " ").encode() if kind in (NORMAL, USER) else b"")
            if kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
                texts[-1] = bytes([int(piece[3:5], 16)])
            elif kind == UNKNOWN:
                unknown = i
            elif kind in (NORMAL, USER):
                normal.append(score)
                for n in range(1, len(piece)):
                    prefixes.setdefault(piece[:n], -1)
                if prefixes.get(piece, -1) == -1:
                    prefixes[piece] = i
                inside.update(piece)
                late_blank |= BLANK in piece.lstrip(BLANK)
        automaton = ahocorasick.Automaton()
        for piece, i in prefixes.items():
            if i >= 0:
                automaton.add_word(piece, (len(piece), scores[i], i))
        automaton.make_automaton()
        # a word takes the blanks before it along; a line break is cut off if no piece contains one
        breaks = "" if "\n" in inside else "\n"
        splitter = re.compile(f"{breaks}|{BLANK}*[^{BLANK}{breaks}]+|{BLANK}+" if breaks else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        return Vocabulary(
            texts, prefixes, scores, byte_ids, unknown, min(normal) - UNKNOWN_PENALTY * SCALE,
            max(map(len, prefixes)), splitter, not late_blank, automaton,
            frozenset(p for p, i in prefixes.items() if i >= 0 and len(p) == 1),
        )

    def words(self, marked: str) -> list[str]:
        """The text in parts that no piece spans two of; the whole text if pieces may cross blanks."""
        return self.splitter.findall(marked) if self.cuttable else [marked] if marked else []

    def forward(self, s: str, starts: dict[int, int], limit: int) -> tuple[list, list, list]:
        """Best score, start and piece of every end position, from given scores at some positions.

        Pieces start before ``limit``. At equal scores the earliest start stays, which is the tokenizer's rule;
        what comes in from outside began earlier than anything inside.
        """
        n = len(s)
        best: list[int | None] = [None] * (n + 1)
        start, piece = [-1] * (n + 1), [-1] * (n + 1)
        for at, score in starts.items():
            best[at] = score
        prefixes, scores = self.prefixes, self.scores
        for i in range(limit):
            here = best[i]
            if here is None:
                continue
            known = False
            for j in range(i + 1, n + 1):
                found = prefixes.get(s[i:j])
                if found is None:
                    break
                if found >= 0:
                    total = here + scores[found]
                    known |= j == i + 1
                    if best[j] is None or total > best[j]:
                        best[j], start[j], piece[j] = total, i, found
            if not known:
                total = here + self.unknown_score
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], start[i + 1], piece[i + 1] = total, i, self.unknown_id
        return best, start, piece

    def trace(self, s: str, start: list, piece: list, end: int) -> tuple[list[int], int]:
        """Ids of the best path to ``end`` and the position where it came in; unknown characters become bytes."""
        parts = []
        while start[end] >= 0:
            at, found = start[end], piece[end]
            if found == self.unknown_id:
                parts.append([self.bytes_ids[b] for b in s[at:end].encode()])
            else:
                parts.append([found])
            end = at
        return [i for p in reversed(parts) for i in p], end

    def word_ids(self, word: str) -> bytes:
        """The ids of one part as little-endian 32-bit numbers."""
        got = self.ids_of.get(word)
        if got is None:
            if self.singles.issuperset(word):
                ids = self.known_ids(word)
            else:
                _, start, piece = self.forward(word, {0: 0}, len(word))
                ids, _ = self.trace(word, start, piece, len(word))
            got = struct.pack(f"<{len(ids)}i", *ids)
            if len(self.ids_of) >= REMEMBERED:
                self.ids_of.clear()
            if len(word) < 64:
                self.ids_of[word] = got
        return got

    def known_ids(self, word: str) -> list[int]:
        """Ids of a part whose characters all are pieces, so that every position is reached by a match.

        The automaton reports the matches by end, the longest first, so the first of equal scores began earliest.
        """
        n = len(word)
        best, back = [0] + [LOWEST] * n, [(0, 0, 0)] * (n + 1)
        for last, match in self.automaton.iter(word):
            end = last + 1
            total = best[end - match[0]] + match[1]
            if total > best[end]:
                best[end], back[end] = total, match
        ids = []
        while n:
            length, _, i = back[n]
            ids.append(i)
            n -= length
        ids.reverse()
        return ids

    def matches(self, word: str) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Matches by the place of their last character, the longest first; a character that is no piece is a match of
        its own, after the longer ones that end there. Its third number is not an id but its bytes, negative."""
        singles, at = self.singles, 0
        for last, match in self.automaton.iter(word):
            while at < last:
                if word[at] not in singles:
                    yield at, (1, self.unknown_score, -len(word[at].encode()))
                at += 1
            yield last, match
        for at in range(at, len(word)):
            if word[at] not in singles:
                yield at, (1, self.unknown_score, -len(word[at].encode()))

    def cost(self, word: str) -> tuple[int, int]:
        """Best score of a part and its number of pieces, without a path."""
        n = len(word)
        best, count = [0] + [LOWEST] * n, [0] * (n + 1)
        for last, (length, score, i) in self.automaton.iter(word) if self.singles.issuperset(word) else self.matches(word):
            end = last + 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - length] + (1 if i >= 0 else -i)
        return best[n], count[n]

    def costs(self, words: list[str]) -> list[tuple[int, int]]:
        """``cost`` of many parts; those that came before are remembered."""
        seen = self.cost_of
        got = list(map(seen.get, words))
        if None in got:
            for i, known in enumerate(got):
                if known is None:
                    word = words[i]
                    got[i] = seen.get(word) or self.cost(word)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    if len(word) < 64:
                        seen[word] = got[i]
        return got


_loaded: dict[int, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """One vocabulary per Python worker, with its memory of words."""
    key = hash(data)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary.load(data)
    return _loaded[key]


def marked(text: str) -> str:
    """Blanks as the vocabulary writes them, one in front; an empty text stays empty."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
