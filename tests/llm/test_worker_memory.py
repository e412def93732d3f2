"""What a Python worker holds between batches, and that slices of a batch are its rows."""

import re
import subprocess
import sys

import pyarrow as pa

from fieldlens.llm import sentencepiece_scan
from fieldlens.llm.base import pieces

#: A worker that has had a batch of many small rows: MB that it held more afterwards than before.
HELD = """
import re, sys
import numpy as np, pyarrow as pa, pyarrow.compute as pc
from fieldlens.llm.base import pieces

def mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", f.read()))) / 1024

def batches():
    yield pa.RecordBatch.from_pydict({"text": ["a"]})
    yield pa.RecordBatch.from_pydict({"text": [f"{i:040d}" for i in range(1_500_000)]})
    yield pa.RecordBatch.from_pydict({"text": ["b"]})

for b in pieces(batches()):
    if b.column("text")[0].as_py() == "a":
        pc.utf8_upper(b.column("text")), np.zeros(1)
        before = mb()
print(round(mb() - before))
"""


def test_pieces_are_the_rows_of_the_batch():
    texts = ["", None, "x" * 50, "ä" * 10, None, "y" * 200, "z", ""] * 3
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts}).slice(1)
    got = list(pieces(iter([batch.slice(0, 0), batch]), limit=60))
    assert [n for b in got for n in b.column("n").to_pylist()] == batch.column("n").to_pylist()
    assert [t for b in got for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    sizes = [[len((t or "").encode()) for t in b.column("text").to_pylist()] for b in got]
    assert all(s and (sum(s) <= 60 or len(s) == 1) for s in sizes) and len(got) > 6


def test_worker_hands_back_what_a_batch_needed():
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)})
    assert int(re.search(r"-?\d+", done.stdout)[0]) < 20


def test_encoding_works_in_slices(spark, monkeypatch):
    """One batch of several slices, long rows among them, is encoded as row by row."""
    texts = [f"word{i} and some more of it, " * (1 + i % 7) for i in range(60)] + [None, "", " ", "no blanks" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    plain = {r.doc_id: r.ids for r in sentencepiece_scan.encode(docs).collect()}
    # the function travels to the workers with this limit
    monkeypatch.setattr(sentencepiece_scan, "pieces", lambda batches, column="text": pieces(batches, column, limit=100))
    for chunk in (1 << 15, 64):
        got = sentencepiece_scan.encode(docs, chunk=chunk, block=2).collect()
        assert len(got) == len(texts) and {r.doc_id: r.ids for r in got} == plain
