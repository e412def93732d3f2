"""Codec and token counts against a lattice that is written out on its own from the vocabulary file's pieces."""

import numpy as np
import pytest
from pyspark.sql import Row

from fieldlens.llm import sentencepiece_scan, token_counts, unigram

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lattice():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    pieces, as_byte, lowest = {}, {}, 0
    for i in range(library.get_piece_size()):
        piece, score = library.id_to_piece(i), round(library.get_score(i) * 100)
        if library.is_byte(i):
            as_byte[int(piece[3:5], 16)] = i
        elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            pieces[piece] = (i, score)
            lowest = min(lowest, score)
    longest = max(map(len, pieces))

    def best(text):
        """Every end looks back over all starts, the earliest first; a later one has to be better."""
        s = "▁" + text.replace(" ", "▁") if text else ""
        cells = [(0, None, ())]
        for end in range(1, len(s) + 1):
            cell = None
            for start in range(max(0, end - longest), end):
                found = pieces.get(s[start:end])
                if found:
                    ids, score = (found[0],), found[1]
                elif start == end - 1:
                    ids, score = tuple(as_byte[b] for b in s[start].encode()), lowest - 1000
                else:
                    continue
                if cell is None or cells[start][0] + score > cell[0]:
                    cell = (cells[start][0] + score, start, ids)
            cells.append(cell)
        at, out = len(s), []
        while at:
            _, start, ids = cells[at]
            out.append(ids)
            at = start
        return [i for ids in reversed(out) for i in ids], cells[-1][0] / 100

    return best


ODD = ["", " ", "☃", "☃☃ a☃b", "a" * 300, "naïve 漢字かな交じり文 \U0001f600\U0001f600x", "\n\n \t☃\n", "  the  the☃the " * 20, "ééü" * 40 + "͸the͸"]


def test_ids_and_counts_of_whole_texts(spark, lattice):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text and len(r.text) < 4000][:60]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(rows + ODD)])
    want = {i: lattice(t) for i, t in enumerate(rows + ODD)}
    assert {r.doc_id: r.ids for r in sentencepiece_scan.encode(docs, chunk=256, block=3).collect()} == {i: w[0] for i, w in want.items()}
    got = {r.doc_id: (r.n_tokens, r.score) for r in token_counts.count_tokens(docs).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(w[0]) for i, w in want.items()}
    assert [got[i][1] for i in want] == pytest.approx([w[1] for w in want.values()])


def test_counts_use_no_path(monkeypatch):
    vocab = unigram.Vocabulary.load(unigram.model_bytes(sentencepiece_scan.MODEL))
    words = [unigram.marked(t) for t in ODD if t]
    want = [len(np.frombuffer(vocab.word_ids(w), "<i4")) for w in words]

    def refused(*_):
        raise AssertionError("a path was traced")

    monkeypatch.setattr(unigram.Vocabulary, "forward", refused)
    monkeypatch.setattr(unigram.Vocabulary, "trace", refused)
    assert [vocab.cost(w)[1] for w in words] == want


def test_many_chunks_are_joined_whole(spark, lattice):
    """A text of thousands of chunks, twice under one id, comes back as often and whole."""
    text = "abc ☃ the cat \n" * 900
    docs = spark.createDataFrame([Row(doc_id=1, text=text), Row(doc_id=1, text=text), Row(doc_id=None, text=text + "x")])
    encoded = sentencepiece_scan.encode(docs, chunk=32, block=16).cache()
    rows = encoded.collect()
    assert sorted(r.n_chunks for r in rows) == [422, 422, 422] and [r.ids for r in rows if r.doc_id == 1] == [lattice(text)[0]] * 2
    assert sorted(r.text for r in sentencepiece_scan.decode(encoded).collect()) == sorted([text, text, text + "x"])
    encoded.unpersist()
