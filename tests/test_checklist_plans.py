from __future__ import annotations

import re

from fieldlens.operators import checklists


def _backbone(spark, path):
    rows = [(f"alpha beta{i}", i, None, "fam", "Alpha", "ACCEPTED", "SPECIES") for i in range(50)] + [(None, 99, None, "f", "Zeta", "ACCEPTED", "SPECIES")]
    spark.createDataFrame(rows, "name string, usage_key long, accepted_usage_key long, family string, genus string, status string, rank string").write.parquet(path)
    return spark.read.parquet(path)


def test_variants_of_names_are_not_broadcast(spark, tmp_path):
    names = [("alpha beta7",), ("alphx beta7",), ("Alpha  ",), ("alpha nothing",), ("zeta other",), ("none at all",), (None,), ("ALPHA BETA7",), ("alphx BETA7",)]
    spark.createDataFrame(names, "search_species string").write.parquet(str(tmp_path / "names"))
    out = checklists.backbone_match(spark.read.parquet(str(tmp_path / "names")), _backbone(spark, str(tmp_path / "backbone")), "s")
    got = {r.search_species: (r.match_type, r.accepted_taxon_key) for r in out.collect()}
    assert got == {"alpha beta7": ("EXACT", 7), "ALPHA BETA7": ("EXACT", 7), "alphx beta7": ("FUZZY", 7), "alphx BETA7": ("FUZZY", 7), "Alpha  ": ("HIGHERRANK", -1),
                   "alpha nothing": ("HIGHERRANK", -1), "zeta other": ("HIGHERRANK", -1), "none at all": ("NONE", -1), None: ("NONE", -1)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # only the genera, one row each, may be
    assert len(re.findall("BroadcastHashJoin", plan)) <= 1 and not re.findall(r"Broadcast\w+Join \[_[vnm]", plan)
