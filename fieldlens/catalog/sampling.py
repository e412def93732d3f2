"""Cap, split and order queries."""

from __future__ import annotations

from fieldlens.catalog import query
from fieldlens.operators import sampling
from fieldlens.plans.fixtures import with_views
from fieldlens.session import materialized

IMAGES = with_views("images")
HASHED = IMAGES + """,
 h_ AS MATERIALIZED (SELECT image_path, coreid, acceptedTaxonKey, md5(concat_ws('|', '42', image_path)) AS h FROM images)"""
# quotas: ceil(frac * total) shared by largest remainder
SPLIT = with_views("images") + """,
 u_ AS MATERIALIZED (SELECT coreid, min(acceptedTaxonKey) AS k, md5(concat_ws('|', '42', CAST(coreid AS VARCHAR))) AS h FROM images GROUP BY coreid),
 c_ AS (SELECT k, count(*) AS n FROM u_ WHERE k IS NOT NULL GROUP BY k),
 t1_ AS (SELECT *, n >= 5 AS e, sum(CASE WHEN n >= 5 THEN n ELSE 0 END) OVER () AS tot FROM c_),
 t2_ AS (SELECT *, CAST(ceil(0.2e0 * tot) AS BIGINT) AS want FROM t1_),
 t3_ AS (SELECT *, CASE WHEN e THEN (want * n) // tot ELSE 0 END AS base, CASE WHEN e THEN (want * n) % tot ELSE -1 END AS rem FROM t2_),
 t4_ AS (SELECT *, row_number() OVER (ORDER BY rem DESC, k) AS r, want - sum(base) OVER () AS extra FROM t3_),
 t5_ AS (SELECT k, n, base + CASE WHEN e AND r <= extra THEN 1 ELSE 0 END AS q_test FROM t4_),
 v1_ AS (SELECT *, n - q_test AS m, n >= 10 AS e FROM t5_),
 v2_ AS (SELECT *, sum(CASE WHEN e THEN m ELSE 0 END) OVER () AS tot FROM v1_),
 v3_ AS (SELECT *, CAST(ceil({adjusted!r}e0 * tot) AS BIGINT) AS want FROM v2_),
 v4_ AS (SELECT *, CASE WHEN e THEN (want * m) // tot ELSE 0 END AS base, CASE WHEN e THEN (want * m) % tot ELSE -1 END AS rem FROM v3_),
 v5_ AS (SELECT *, row_number() OVER (ORDER BY rem DESC, k) AS r, want - sum(base) OVER () AS extra FROM v4_),
 v6_ AS (SELECT k, q_test, base + CASE WHEN e AND r <= extra THEN 1 ELSE 0 END AS q_val FROM v5_),
 d_ AS (SELECT u_.coreid, CASE WHEN row_number() OVER w <= q_test THEN 'test' WHEN row_number() OVER w <= q_test + q_val THEN 'val' ELSE 'train' END AS split
        FROM u_ JOIN v6_ ON u_.k = v6_.k WINDOW w AS (PARTITION BY u_.k ORDER BY h, u_.coreid)),
 split_ AS MATERIALIZED (SELECT i.image_path, i.coreid, i.acceptedTaxonKey, coalesce(d_.split, 'train') AS split FROM images i LEFT JOIN d_ ON d_.coreid = i.coreid)
""".format(adjusted=0.1 / (1 - 0.2))


def _split(t):
    return sampling.stratified_split(t.written("image_path", "coreid", "acceptedTaxonKey", "ord"), row_order="ord")


@query("group_cap", HASHED + """
SELECT image_path, acceptedTaxonKey FROM (SELECT *, row_number() OVER (PARTITION BY acceptedTaxonKey ORDER BY h, image_path) AS r FROM h_
 WHERE acceptedTaxonKey IS NOT NULL) q WHERE r <= 100""")
def group_cap(t):
    return sampling.group_cap(t.images.select("image_path", "acceptedTaxonKey"), "acceptedTaxonKey", 100)


@query("half_split", IMAGES + """
SELECT image_path, CAST(CASE WHEN row_number() OVER (ORDER BY image_path) <= floor(count(*) OVER () / 2) THEN 1 ELSE 2 END AS INT) AS half
FROM images WHERE lifeStage IS NULL""")
def half_split(t):
    return sampling.half_split(t.written("image_path", "lifeStage").filter("lifeStage IS NULL").select("image_path"), "image_path")


@query("systematic_sample", IMAGES + """
SELECT image_path FROM (SELECT image_path, row_number() OVER (ORDER BY image_path) AS r FROM images) q WHERE (r - 1) % 7 = 0""")
def systematic_sample(t):
    return sampling.systematic_sample(t.written("image_path"), "image_path", 7)


@query("shuffle", HASHED + "SELECT image_path, row_number() OVER (ORDER BY h, image_path) AS position FROM h_")
def shuffle(t):
    return sampling.shuffle(t.written("image_path"))


@query("random_pair_split", HASHED + """
SELECT image_path, CASE WHEN row_number() OVER (ORDER BY h, image_path) <= floor(0.8e0 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM h_""")
def random_pair_split(t):
    return sampling.random_pair_split(t.written("image_path"), "image_path")


@query("ratio_split", HASHED + """,
 r_ AS (SELECT *, row_number() OVER (PARTITION BY acceptedTaxonKey ORDER BY h, image_path) AS r, count(*) OVER (PARTITION BY acceptedTaxonKey) AS n
        FROM h_ WHERE acceptedTaxonKey IS NOT NULL)
SELECT image_path, acceptedTaxonKey, CASE WHEN n < 5 THEN 'test' WHEN r <= floor(n * 0.7e0) THEN 'train' WHEN r <= n - floor(n * 0.2e0) THEN 'val' ELSE 'test' END AS split FROM r_""")
def ratio_split(t):
    return sampling.ratio_split(t.written("image_path", "acceptedTaxonKey"), "acceptedTaxonKey")


@query("ratio_split_rounded", HASHED + """,
 r_ AS (SELECT *, row_number() OVER (PARTITION BY acceptedTaxonKey ORDER BY h, image_path) AS r, count(*) OVER (PARTITION BY acceptedTaxonKey) AS n
        FROM h_ WHERE acceptedTaxonKey IS NOT NULL)
SELECT image_path, acceptedTaxonKey, CASE WHEN r <= round_even(n * 0.75e0, 0) THEN 'train'
  WHEN r <= round_even(n * 0.75e0, 0) + round_even(n * 0.1e0, 0) THEN 'val' ELSE 'test' END AS split FROM r_""")
def ratio_split_rounded(t):
    return sampling.ratio_split(
        t.written("image_path", "acceptedTaxonKey"), "acceptedTaxonKey", train=0.75, val=0.1, test=0.15, rounded=True)


@query("stratified_split", SPLIT + "SELECT image_path, coreid, acceptedTaxonKey, split FROM split_")
def stratified_split(t):
    return _split(t).select("image_path", "coreid", "acceptedTaxonKey", "split")


@query("split_caps", SPLIT + """,
 r_ AS (SELECT *, row_number() OVER (PARTITION BY split, acceptedTaxonKey ORDER BY md5(concat_ws('|', '42', image_path)), image_path) AS r FROM split_
        WHERE acceptedTaxonKey IS NOT NULL),
 k_ AS (SELECT * FROM r_ WHERE r <= CASE split WHEN 'train' THEN 200 WHEN 'val' THEN 20 ELSE 40 END)
SELECT image_path, acceptedTaxonKey, split FROM k_ WHERE acceptedTaxonKey IN
 (SELECT acceptedTaxonKey FROM k_ WHERE split = 'train' GROUP BY acceptedTaxonKey HAVING count(*) >= 30)""")
def split_caps(t):
    # the split is a table of its own in the pipeline: written once, then capped; the row order has served its purpose
    return sampling.split_caps(materialized(_split(t).drop("ord"), "split"), "acceptedTaxonKey", 200, 30).select("image_path", "acceptedTaxonKey", "split")


@query("taxon_sample", with_views("crop_labels") + """
SELECT crop_id, label FROM (SELECT crop_id, label, md5(concat_ws('|', '42', CAST(crop_id AS VARCHAR))) AS h FROM crop_labels WHERE label = 'genus 3') q
WHERE CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) / 4294967296.0e0 < 0.5 ORDER BY h, crop_id LIMIT 10""")
def taxon_sample(t):
    return sampling.taxon_sample(t.crop_labels, "label", "genus 3", 10).select("crop_id", "label")
