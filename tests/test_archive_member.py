from __future__ import annotations

from fieldlens.sources import tables


def test_lines_are_split_once(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("rights\tcoreid\tidentifier\tlast\nr\t1\ta\tz\n\t2\n\n\t\t\nr\t3\tb\tz\ttoo many\nr\tx\tc\t\nrights\tcoreid\tidentifier\tlast\nr\t4\td\n")
    rows = tables.archive_member(spark, str(path), {"coreid": "bigint", "identifier": "string"})
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([(1, "a"), (2, None), (None, None), (None, "c"), (4, "d")], key=repr)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
