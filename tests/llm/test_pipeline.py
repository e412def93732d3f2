"""Every stage of the pipeline against what it has to do with its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from fieldlens.llm import catalog, exact_dedup, langid, mixing, ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        made.write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_stages_do_their_work(steps):
    (docs, known), (_, single), (_, apart), (_, mixed), (_, tokens) = steps
    letters = {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    assert ids(known) == Counter(letters)
    assert ids(single) == Counter(r.doc_id for r in exact_dedup.exact_duplicates(known).filter("kept").collect())
    assert ids(apart) == Counter({r.component_id for r in ngram_join.near_duplicates(single).collect()})
    taken = {r.doc_id: r.taken // r.size for r in mixing.pareto_mix(apart).filter("taken > 0").collect()}
    assert ids(mixed) == Counter(taken)
    assert ids(tokens) == ids(mixed) and tokens.filter("n_tokens <> size(ids)").count() == 0


def test_registered_queries():
    numbers = {int(re.match(r"op(\d+)_", n).group(1)) for n in catalog.QUERIES}
    assert numbers == set(range(1, 14)) and set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert langid.UNKNOWN == "und"
