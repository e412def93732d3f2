"""Checklist, count and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.catalog import query
from fieldlens.operators import checklists, joins, setops, stats
from fieldlens.plans.fixtures import with_views
from fieldlens.session import materialized

IMAGES = with_views("images")
CHECK = with_views("checklist")
LABELS = with_views("crop_labels", "taxonomy") + """,
 names_ AS (SELECT species AS name, genus, family FROM taxonomy UNION ALL SELECT DISTINCT genus, NULL, family FROM taxonomy
            UNION ALL SELECT DISTINCT family, NULL, family FROM taxonomy),
 higher_ AS MATERIALIZED (SELECT l.*, CASE taxon_rank WHEN 'SPECIES' THEN n.genus WHEN 'GENUS' THEN l.label END AS genus,
                   CASE WHEN taxon_rank = 'FAMILY' THEN l.label ELSE n.family END AS family
            FROM crop_labels l LEFT JOIN names_ n ON n.name = l.label)"""
LEVELS = LABELS + """,
 kept_ AS (SELECT * FROM higher_ WHERE NOT (taxon_rank = 'SPECIES' AND label IN (SELECT species FROM taxonomy WHERE speciesKey % 17 = 0))),
 levels_ AS (SELECT region, 'SPECIES' AS level, label AS name FROM kept_ WHERE taxon_rank = 'SPECIES'
             UNION ALL SELECT region, 'GENUS', genus FROM kept_ WHERE taxon_rank IN ('SPECIES', 'GENUS')
             UNION ALL SELECT region, 'FAMILY', family FROM kept_)"""
STATS = """,
 recorded_ AS MATERIALIZED (SELECT accepted_taxon_key, min(family) AS family, min(genus) AS genus, min(search_species) AS search_species,
               min(gbif_species) AS gbif_species, accepted_taxon_key % 37 AS image_count
               FROM checklist WHERE accepted_taxon_key <> -1 AND accepted_taxon_key % 3 <> 0 AND source = 'list_a' GROUP BY accepted_taxon_key
               UNION ALL SELECT 1000000, 'x', 'y', 'z', 'w', 5
               UNION ALL SELECT -1, 'NotAvail', 'NotAvail', min(search_species), 'NotAvail', -1 FROM checklist WHERE accepted_taxon_key = -1),
 observed_ AS MATERIALIZED (SELECT acceptedTaxonKey AS accepted_taxon_key, count(*) AS image_count FROM images
               WHERE acceptedTaxonKey IS NOT NULL GROUP BY acceptedTaxonKey)"""


def _labels(t):
    return joins.higher_taxon_join(t.crop_labels, joins.taxon_names(t.taxonomy))


def _excluded(t):
    return t.taxonomy.filter("speciesKey % 17 = 0").select("species")


def _recorded(t):
    c = t.checklist
    cols = [F.min(x).alias(x) for x in ("family", "genus", "search_species", "gbif_species")]
    listed = (
        c.filter("accepted_taxon_key <> -1 AND accepted_taxon_key % 3 <> 0 AND source = 'list_a'")
        .groupBy("accepted_taxon_key").agg(*cols).withColumn("image_count", F.col("accepted_taxon_key") % 37)
    )
    extra = c.agg(F.lit(1000000).cast("long").alias("accepted_taxon_key"), F.lit("x").alias("family"), F.lit("y").alias("genus"),
                  F.lit("z").alias("search_species"), F.lit("w").alias("gbif_species"), F.lit(5).cast("long").alias("image_count"))
    na = F.lit("NotAvail")
    gone = c.filter("accepted_taxon_key = -1").agg(
        F.lit(-1).cast("long").alias("accepted_taxon_key"), F.first(na).alias("family"), F.first(na).alias("genus"),
        F.min("search_species").alias("search_species"), F.first(na).alias("gbif_species"),
        F.lit(-1).cast("long").alias("image_count"))
    return listed.unionByName(extra).unionByName(gone)


def _observed(t):
    return (
        t.images.filter("acceptedTaxonKey IS NOT NULL").groupBy(F.col("acceptedTaxonKey").alias("accepted_taxon_key"))
        .agg(F.count("*").alias("image_count"))
    )


BACKBONE = """
 backbone_ AS MATERIALIZED (SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS name, p_partkey AS usage_key,
     CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 1 END AS accepted_usage_key, p_type AS family, split_part(p_name, ' ', 1) AS genus,
     CASE WHEN p_partkey % 5 = 0 THEN 'SYNONYM' ELSE 'ACCEPTED' END AS status, 'SPECIES' AS rank FROM part WHERE p_partkey % 2 = 0),
 asked_ AS MATERIALIZED (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', CAST(p_partkey AS VARCHAR))
     WHEN 1 THEN concat(replace(p_name, 'e', 'x'), ' ', CAST(p_partkey AS VARCHAR))
     WHEN 2 THEN concat(split_part(p_name, ' ', 1), ' unheard ', CAST(p_partkey AS VARCHAR))
     ELSE concat('nothing like it ', CAST(p_partkey AS VARCHAR)) END AS search_species FROM part)"""


@query("backbone_match", "WITH" + BACKBONE + """,
 exact_ AS (SELECT a.search_species, b.* FROM asked_ a JOIN backbone_ b ON a.search_species = b.name),
 fuzzy_ AS (SELECT a.search_species, b.*, row_number() OVER (PARTITION BY a.search_species ORDER BY levenshtein(a.search_species, b.name),
                   b.usage_key) AS rn
            FROM asked_ a JOIN backbone_ b ON levenshtein(a.search_species, b.name) <= 1
            WHERE a.search_species NOT IN (SELECT search_species FROM exact_)),
 genera_ AS (SELECT genus, min(family) AS family FROM backbone_ GROUP BY genus)
SELECT coalesce(e.accepted_usage_key, e.usage_key, f.accepted_usage_key, f.usage_key, -1) AS accepted_taxon_key,
       coalesce(e.family, f.family, g.family, 'NotAvail') AS family, coalesce(e.genus, f.genus, g.genus, 'NotAvail') AS genus,
       a.search_species, coalesce(e.name, f.name, 'NotAvail') AS gbif_species, coalesce(e.status, f.status, 'NotAvail') AS status,
       CASE WHEN e.name IS NOT NULL THEN 'EXACT' WHEN f.name IS NOT NULL THEN 'FUZZY' WHEN g.genus IS NOT NULL THEN 'HIGHERRANK' ELSE 'NONE' END AS match_type,
       CASE WHEN e.name IS NULL AND f.name IS NULL AND g.genus IS NOT NULL THEN 'GENUS' ELSE coalesce(e.rank, f.rank, 'NotAvail') END AS rank,
       'regional' AS source
FROM asked_ a LEFT JOIN exact_ e ON e.search_species = a.search_species LEFT JOIN fuzzy_ f ON f.search_species = a.search_species AND f.rn = 1
LEFT JOIN genera_ g ON g.genus = split_part(a.search_species, ' ', 1)""")
def backbone_match(t):
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    genus = F.substring_index("p_name", " ", 1)
    synonym = F.col("p_partkey") % 5 == 0
    backbone = t.part.filter("p_partkey % 2 = 0").select(
        name.alias("name"), F.col("p_partkey").alias("usage_key"), F.when(synonym, F.col("p_partkey") + 1).alias("accepted_usage_key"),
        F.col("p_type").alias("family"), genus.alias("genus"),
        F.when(synonym, "SYNONYM").otherwise("ACCEPTED").alias("status"), F.lit("SPECIES").alias("rank"))
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    asked = t.part.select(
        F.when(kind == 0, name).when(kind == 1, F.concat(F.replace("p_name", F.lit("e"), F.lit("x")), F.lit(" "), key))
        .when(kind == 2, F.concat(genus, F.lit(" unheard "), key)).otherwise(F.concat(F.lit("nothing like it "), key))
        .alias("search_species"))
    return checklists.backbone_match(asked, backbone, "regional")


@query("checklist_upsert", CHECK + """,
 main_ AS (SELECT * FROM checklist WHERE source = 'list_a'), inc_ AS (SELECT * FROM checklist WHERE source = 'list_b'),
 n_ AS (SELECT accepted_taxon_key, count(*) AS n FROM inc_ WHERE accepted_taxon_key <> -1 GROUP BY 1)
SELECT m.accepted_taxon_key, m.gbif_species, m.row_id, m.source || repeat(' list_b', coalesce(n_.n, 0)) AS source
FROM main_ m LEFT JOIN n_ ON n_.accepted_taxon_key = m.accepted_taxon_key
UNION ALL SELECT accepted_taxon_key, gbif_species, row_id, source FROM inc_
WHERE accepted_taxon_key = -1 OR accepted_taxon_key NOT IN (SELECT accepted_taxon_key FROM main_)""")
def checklist_upsert(t):
    c = t.checklist
    out = checklists.checklist_upsert(c.filter("source = 'list_a'"), c.filter("source = 'list_b'"), "list_b")
    return out.select("accepted_taxon_key", "gbif_species", "row_id", "source")


@query("checklist_upsert_dedup", CHECK + """,
 main_ AS (SELECT * FROM checklist WHERE source = 'list_a'), inc_ AS (SELECT * FROM checklist WHERE source = 'list_b'),
 n_ AS (SELECT accepted_taxon_key, count(*) AS n FROM inc_ WHERE accepted_taxon_key <> -1 GROUP BY 1)
SELECT m.accepted_taxon_key, m.row_id, m.source || repeat(' list_b', coalesce(n_.n, 0)) AS source
FROM main_ m LEFT JOIN n_ ON n_.accepted_taxon_key = m.accepted_taxon_key
UNION ALL SELECT accepted_taxon_key, row_id, source FROM inc_ WHERE accepted_taxon_key = -1
UNION ALL SELECT accepted_taxon_key, min(row_id), 'list_b' FROM inc_
WHERE accepted_taxon_key <> -1 AND accepted_taxon_key NOT IN (SELECT accepted_taxon_key FROM main_) GROUP BY accepted_taxon_key""")
def checklist_upsert_dedup(t):
    c = t.checklist
    out = checklists.checklist_upsert(c.filter("source = 'list_a'"), c.filter("source = 'list_b'"), "list_b", dedup_incoming=True)
    return out.select("accepted_taxon_key", "row_id", "source")


@query("checklist_compare", CHECK + """,
 a_ AS (SELECT DISTINCT gbif_species FROM checklist WHERE source = 'list_a'), b_ AS (SELECT DISTINCT gbif_species FROM checklist WHERE source = 'list_b')
SELECT coalesce(a_.gbif_species, b_.gbif_species) AS gbif_species,
       CASE WHEN b_.gbif_species IS NULL THEN 'a_only' WHEN a_.gbif_species IS NULL THEN 'b_only' ELSE 'both' END AS side
FROM a_ FULL OUTER JOIN b_ ON a_.gbif_species = b_.gbif_species""")
def checklist_compare(t):
    c = t.checklist
    return checklists.checklist_compare(c.filter("source = 'list_a'"), c.filter("source = 'list_b'"), "gbif_species")


@query("stats_reconcile", with_views("checklist", "images") + STATS + """,
 listed_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accepted_taxon_key ORDER BY row_id) AS rn FROM checklist
             WHERE accepted_taxon_key <> -1) q WHERE rn = 1)
SELECT r.accepted_taxon_key, r.family, r.genus, r.search_species, r.gbif_species,
       CASE WHEN l.accepted_taxon_key IS NULL THEN r.image_count ELSE coalesce(o.image_count, 0) END AS image_count
FROM recorded_ r LEFT JOIN listed_ l ON l.accepted_taxon_key = r.accepted_taxon_key LEFT JOIN observed_ o ON o.accepted_taxon_key = r.accepted_taxon_key
WHERE r.accepted_taxon_key <> -1
UNION ALL SELECT * FROM recorded_ WHERE accepted_taxon_key = -1
UNION ALL SELECT l.accepted_taxon_key, l.family, l.genus, l.search_species, l.gbif_species, o.image_count
FROM listed_ l JOIN observed_ o ON o.accepted_taxon_key = l.accepted_taxon_key
WHERE l.accepted_taxon_key NOT IN (SELECT accepted_taxon_key FROM recorded_)
UNION ALL SELECT DISTINCT -1, 'NotAvail', 'NotAvail', search_species, 'NotAvail', -1 FROM checklist
WHERE accepted_taxon_key = -1 AND search_species NOT IN (SELECT search_species FROM recorded_)""")
def stats_reconcile(t):
    return checklists.stats_reconcile(t.checklist, _recorded(t), _observed(t))


@query("synonym_expansion", CHECK + """
SELECT CASE WHEN accepted_taxon_key = -1 THEN search_species ELSE gbif_species END AS species, genus, family, accepted_taxon_key, NULL AS synonym_of FROM checklist
UNION ALL SELECT search_species, genus, family, accepted_taxon_key, gbif_species FROM checklist WHERE accepted_taxon_key <> -1 AND status = 'SYNONYM'""")
def synonym_expansion(t):
    return checklists.synonym_expansion(t.checklist)


@query("key_quality_report", CHECK + """
SELECT count(*) AS rows, count(DISTINCT search_species) AS unique_search_names,
       count(DISTINCT CASE WHEN gbif_species <> 'NotAvail' THEN gbif_species END) AS unique_gbif_names,
       count(CASE WHEN gbif_species <> 'NotAvail' THEN 1 END) AS gbif_names,
       count(DISTINCT CASE WHEN accepted_taxon_key <> -1 THEN accepted_taxon_key END) AS unique_keys,
       count(CASE WHEN accepted_taxon_key <> -1 THEN 1 END) AS keys, count(CASE WHEN accepted_taxon_key = -1 THEN 1 END) AS not_found,
       (SELECT count(*) FROM (SELECT accepted_taxon_key FROM checklist WHERE accepted_taxon_key <> -1 GROUP BY 1 HAVING count(*) > 1) q) AS duplicated_keys
FROM checklist""")
def key_quality_report(t):
    return checklists.key_quality_report(t.checklist)


@query("taxa_summary", with_views("checklist", "images") + STATS + """
SELECT c.source, count(DISTINCT c.family) AS families, count(DISTINCT c.genus) AS genera, count(DISTINCT c.gbif_species) AS species,
       CAST(coalesce(sum(o.image_count), 0) AS BIGINT) AS images
FROM checklist c LEFT JOIN observed_ o ON o.accepted_taxon_key = c.accepted_taxon_key WHERE c.accepted_taxon_key <> -1 GROUP BY c.source""")
def taxa_summary(t):
    return checklists.taxa_summary(t.checklist, _observed(t))


@query("taxon_hierarchy", CHECK + """
SELECT gbif_species, genus, family FROM (SELECT *, row_number() OVER (PARTITION BY gbif_species ORDER BY row_id) AS rn FROM checklist
 WHERE gbif_species <> 'NotAvail') q WHERE rn = 1""")
def taxon_hierarchy(t):
    return checklists.taxon_hierarchy(t.checklist)


@query("capped_sum", CHECK + """
SELECT CAST(sum(least(row_id % 1500, 1000)) AS BIGINT) AS total, count(*) AS taxa FROM checklist WHERE status = 'ACCEPTED'""")
def capped_sum(t):
    return checklists.capped_sum(t.checklist.withColumn("n", F.col("row_id") % 1500), "n")


@query("category_map", IMAGES + """
SELECT CAST(k AS VARCHAR) AS category, row_number() OVER (ORDER BY k) - 1 AS class_id
FROM (SELECT DISTINCT acceptedTaxonKey AS k FROM images WHERE acceptedTaxonKey IS NOT NULL) q""")
def category_map(t):
    return checklists.category_map(t.images, "acceptedTaxonKey")


@query("images_per_taxon", with_views("images", "taxonomy") + """,
 n_ AS (SELECT x.species, x.genus, x.family, coalesce(c.n, 0) AS n FROM taxonomy x LEFT JOIN
        (SELECT acceptedTaxonKey AS k, count(*) AS n FROM images GROUP BY 1) c ON c.k = x.speciesKey)
SELECT 'species' AS level, species AS name, CAST(sum(n) AS BIGINT) AS images FROM n_ GROUP BY species
UNION ALL SELECT 'genus', genus, CAST(sum(n) AS BIGINT) FROM n_ GROUP BY genus
UNION ALL SELECT 'family', family, CAST(sum(n) AS BIGINT) FROM n_ GROUP BY family""")
def images_per_taxon(t):
    return stats.images_per_taxon(t.images, t.taxonomy, "acceptedTaxonKey")


@query("storage_stats", with_views("verified") + """
SELECT count(DISTINCT split_part(image_path, '/', 1)) AS datasets, count(*) AS images, CAST(sum(file_size) AS BIGINT) AS bytes FROM verified""")
def storage_stats(t):
    return stats.storage_stats(t.verified)


@query("key_lookup_join", with_views("crop_labels", "taxonomy", "checklist") + """,
 l_ AS (SELECT DISTINCT search_species AS label FROM checklist WHERE row_id % 2 = 0 UNION SELECT gbif_species FROM checklist UNION SELECT species FROM taxonomy),
 s_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_species ORDER BY row_id) AS rn FROM checklist) q WHERE rn = 1),
 g_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gbif_species ORDER BY row_id) AS rn FROM checklist) q WHERE rn = 1)
SELECT l_.label, CASE WHEN s_.gbif_species <> l_.label THEN s_.gbif_species END AS synonym, x.speciesKey,
       coalesce(s_.accepted_taxon_key, g_.accepted_taxon_key) AS acceptedTaxonKey
FROM l_ LEFT JOIN s_ ON s_.search_species = l_.label LEFT JOIN g_ ON g_.gbif_species = l_.label LEFT JOIN taxonomy x ON x.species = l_.label""")
def key_lookup_join(t):
    c = t.checklist
    labels = (
        c.filter("row_id % 2 = 0").select(F.col("search_species").alias("label"))
        .union(c.select("gbif_species")).union(t.taxonomy.select("species")).distinct()
    )
    return joins.key_lookup_join(labels, c, t.taxonomy)


@query("rank_lookup_join", with_views("annotation_items", "taxon_db") + """
SELECT i.conv_id, i.pos, i.name, coalesce(d.rank, 'NA') AS rank FROM
 (SELECT conv_id, pos, CASE WHEN path_b IS NULL THEN path_a ELSE split_part(path_a, '/', -1) END AS name FROM annotation_items) i
LEFT JOIN taxon_db d ON d.name = i.name""")
def rank_lookup_join(t):
    name = F.when(F.col("path_b").isNull(), F.col("path_a")).otherwise(F.substring_index("path_a", "/", -1))
    return joins.rank_lookup_join(t.annotation_items.select("conv_id", "pos", name.alias("name")), t.taxon_db)


@query("higher_taxon_join", LABELS + "SELECT crop_id, taxon_rank, label, genus, family FROM higher_")
def higher_taxon_join(t):
    return _labels(t).select("crop_id", "taxon_rank", "label", "genus", "family")


@query("category_id_join", with_views("images") + """,
 map_ AS (SELECT CAST(k AS VARCHAR) AS category, row_number() OVER (ORDER BY k) - 1 AS class_id FROM (SELECT DISTINCT acceptedTaxonKey AS k FROM images
          WHERE acceptedTaxonKey IS NOT NULL AND acceptedTaxonKey % 9 <> 4) q)
SELECT i.image_path, i.acceptedTaxonKey, m.class_id FROM images i JOIN map_ m ON m.category = CAST(i.acceptedTaxonKey AS VARCHAR)
UNION ALL SELECT concat('unmatched ', CAST(count(*) AS VARCHAR)), acceptedTaxonKey, NULL FROM images
WHERE acceptedTaxonKey IS NULL OR acceptedTaxonKey % 9 = 4 GROUP BY acceptedTaxonKey""")
def category_id_join(t):
    rows = t.written("image_path", "acceptedTaxonKey")
    ids = checklists.category_map(rows.filter("acceptedTaxonKey % 9 <> 4"), "acceptedTaxonKey")
    matched, unmatched = joins.category_id_join(rows, ids, "acceptedTaxonKey")
    notes = unmatched.select(
        F.concat(F.lit("unmatched "), F.col("rows").cast("string")).alias("image_path"), "acceptedTaxonKey",
        F.lit(None).cast("long").alias("class_id"))
    return matched.select("image_path", "acceptedTaxonKey", "class_id").unionByName(notes)


@query("missing_species", with_views("crop_labels", "taxonomy") + """
SELECT DISTINCT acceptedTaxonKey FROM crop_labels WHERE acceptedTaxonKey IS NOT NULL AND acceptedTaxonKey NOT IN (-1, 0)
AND acceptedTaxonKey NOT IN (SELECT speciesKey FROM taxonomy)""")
def missing_species(t):
    return joins.missing_species(t.crop_labels, t.taxonomy)


@query("exclusion_filter", with_views("crop_labels", "taxonomy") + """
SELECT crop_id, label, acceptedTaxonKey FROM crop_labels WHERE taxon_rank <> 'ORDER' AND region = 'WesternEurope'
AND coalesce(acceptedTaxonKey <> -1, TRUE) AND (acceptedTaxonKey IS NULL OR acceptedTaxonKey NOT IN (SELECT speciesKey FROM taxonomy WHERE speciesKey % 17 = 0))""")
def exclusion_filter(t):
    excluded = t.taxonomy.filter("speciesKey % 17 = 0").select("speciesKey")
    return joins.exclusion_filter(t.crop_labels, excluded, "WesternEurope").select("crop_id", "label", "acceptedTaxonKey")


@query("seen_unseen_split", with_views("crop_labels") + """,
 train_ AS (SELECT DISTINCT acceptedTaxonKey FROM crop_labels WHERE region = 'WesternEurope' AND acceptedTaxonKey % 3 <> 0)
SELECT crop_id, acceptedTaxonKey, CASE WHEN acceptedTaxonKey IN (SELECT acceptedTaxonKey FROM train_) THEN 'seen' ELSE 'unseen' END AS part
FROM crop_labels WHERE region <> 'WesternEurope'""")
def seen_unseen_split(t):
    crops = t.crop_labels
    train = crops.filter("region = 'WesternEurope' AND acceptedTaxonKey % 3 <> 0")
    seen, unseen = joins.seen_unseen_split(crops.filter("region <> 'WesternEurope'"), train, "acceptedTaxonKey")
    cols = ["crop_id", "acceptedTaxonKey"]
    return seen.select(*cols, F.lit("seen").alias("part")).unionByName(unseen.select(*cols, F.lit("unseen").alias("part")))


@query("regional_mask_list", with_views("taxonomy", "crop_labels") + """
SELECT DISTINCT label AS species, CASE WHEN acceptedTaxonKey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nov_flag FROM crop_labels
WHERE taxon_rank = 'SPECIES' AND region = 'CentralAmerica' AND acceptedTaxonKey % 2 = 0
AND label IN (SELECT species FROM taxonomy WHERE speciesKey % 5 <> 0)""")
def regional_mask_list(t):
    regional = t.crop_labels.filter("taxon_rank = 'SPECIES' AND region = 'CentralAmerica'").select(
        F.col("label").alias("species"), F.when(F.col("acceptedTaxonKey") % 2 == 0, 1.0).otherwise(0.0).alias("nov_flag")).distinct()
    classes = t.taxonomy.filter("speciesKey % 5 <> 0").select("speciesKey")
    return joins.regional_mask_list(classes, t.taxonomy, regional, flag="nov_flag")


@query("checklist_accuracy_join", with_views("taxonomy", "images", "crop_labels") + """,
 list_ AS (SELECT speciesKey AS acceptedTaxonKey, species, CASE WHEN speciesKey % 6 = 5 THEN 'SYNONYM' ELSE 'ACCEPTED' END AS taxonomicStatus FROM taxonomy),
 train_ AS (SELECT acceptedTaxonKey, count(*) AS n FROM images WHERE acceptedTaxonKey % 4 <> 1 GROUP BY 1),
 test_ AS (SELECT acceptedTaxonKey, count(*) AS n FROM images WHERE l_suppkey % 5 = 0 AND acceptedTaxonKey IS NOT NULL GROUP BY 1),
 acc_ AS (SELECT acceptedTaxonKey, count(CASE WHEN l_suppkey % 3 = 0 THEN 1 END) AS correct, count(*) AS total FROM images
          WHERE l_suppkey % 5 = 1 AND acceptedTaxonKey IS NOT NULL GROUP BY 1),
 trap_ AS (SELECT label AS species, count(CASE WHEN crop_id % 3 = 0 THEN 1 END) AS top1, count(CASE WHEN crop_id % 3 < 2 THEN 1 END) AS top5,
                  count(*) AS total FROM crop_labels WHERE taxon_rank = 'SPECIES' GROUP BY 1)
SELECT l.species, l.acceptedTaxonKey, l.taxonomicStatus, t.n AS gbif_train_imgs, coalesce(e.n, 0) AS gbif_test_imgs,
       coalesce(round(a.correct / a.total * 100, 2), 0) AS gbif_test_top1_acc, coalesce(p.total, 0) AS traps_test_imgs,
       coalesce(round(p.top1 / p.total * 100, 2), 0) AS traps_test_top1_acc, coalesce(round(p.top5 / p.total * 100, 2), 0) AS traps_test_top5_acc
FROM list_ l JOIN train_ t ON t.acceptedTaxonKey = l.acceptedTaxonKey LEFT JOIN test_ e ON e.acceptedTaxonKey = l.acceptedTaxonKey
LEFT JOIN acc_ a ON a.acceptedTaxonKey = l.acceptedTaxonKey LEFT JOIN trap_ p ON p.species = l.species WHERE l.taxonomicStatus = 'ACCEPTED'""")
def checklist_accuracy_join(t):
    key = "acceptedTaxonKey"
    status = F.when(F.col("speciesKey") % 6 == 5, "SYNONYM").otherwise("ACCEPTED").alias("taxonomicStatus")
    listed = t.taxonomy.select(F.col("speciesKey").alias(key), "species", status)
    # one pass over the images gives the three per-taxon tables; written, or each of them would make its own
    per = materialized(t.images.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("all"), F.count_if(F.col("l_suppkey") % 5 == 0).alias("test"),
        F.count_if((F.col("l_suppkey") % 5 == 1) & (F.col("l_suppkey") % 3 == 0)).alias("correct"),
        F.count_if(F.col("l_suppkey") % 5 == 1).alias("total")), "per-taxon")
    traps = t.crop_labels.filter("taxon_rank = 'SPECIES'").groupBy(F.col("label").alias("species")).agg(
        F.count_if(F.col("crop_id") % 3 == 0).alias("top1"), F.count_if(F.col("crop_id") % 3 < 2).alias("top5"),
        F.count("*").alias("total"))
    return joins.checklist_accuracy_join(
        listed, per.filter(F.col(key) % 4 != 1).select(key, F.col("all").alias("n")),
        per.filter("test > 0").select(key, F.col("test").alias("n")), per.filter("total > 0").select(key, "correct", "total"), traps)


@query("column_zip", """
WITH a_ AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders),
 b_ AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders)
SELECT a_.pos, o_orderkey, o_totalprice, o_orderpriority FROM a_ JOIN b_ ON a_.pos = b_.pos""")
def column_zip(t):
    from fieldlens.operators.ordering import global_rank

    a = global_rank(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], "pos")
    b = global_rank(t.orders.select("o_orderkey", "o_orderpriority"), [F.col("o_orderkey")], "rpos").drop("o_orderkey")
    return joins.column_zip(a, b, "pos", "rpos")


FILES = """,
 f_ AS (SELECT crop_id, concat('trap', CAST(crop_id AS VARCHAR), '_', lower(taxon_rank), '-x-', label, '.jpg') AS filename, label,
               CASE WHEN crop_id % 4 = 0 THEN 'species 0' ELSE label END AS label_a,
               CASE WHEN crop_id % 6 = 0 THEN NULL WHEN crop_id % 5 = 0 THEN 'species 1' ELSE label END AS label_b FROM crop_labels)"""


def _files(t):
    rank = F.lower("taxon_rank")
    name = F.concat(F.lit("trap"), F.col("crop_id").cast("string"), F.lit("_"), rank, F.lit("-x-"), F.col("label"), F.lit(".jpg"))
    crops = t.crop_labels.select("crop_id", "label", name.alias("filename"))
    a = crops.select("filename", F.when(F.col("crop_id") % 4 == 0, "species 0").otherwise(F.col("label")).alias("label"))
    b = crops.filter("crop_id % 6 <> 0").select(
        "filename", F.when(F.col("crop_id") % 5 == 0, "species 1").otherwise(F.col("label")).alias("label"))
    return crops, a, b


@query("model_compare_join", with_views("crop_labels") + FILES + """
SELECT filename, label_a, label_b, label AS true_label, regexp_extract(filename, '_([a-z]+)-', 1) AS true_label_rank,
       filename LIKE '%_species-%' AND label_a = label AS correct_a, coalesce(filename LIKE '%_species-%' AND label_b = label, FALSE) AS correct_b FROM f_""")
def model_compare_join(t):
    _, a, b = _files(t)
    return joins.model_compare_join(a, b)


@query("model_compare_summary", with_views("crop_labels") + FILES + """
SELECT count(CASE WHEN s THEN 1 END) AS species_files, count(CASE WHEN s AND label_a = label THEN 1 END) AS correct_a,
       count(CASE WHEN s AND label_b = label THEN 1 END) AS correct_b,
       count(CASE WHEN s AND label_a = label THEN 1 END) / count(CASE WHEN s THEN 1 END) AS accuracy_a,
       count(CASE WHEN s AND label_b = label THEN 1 END) / count(CASE WHEN s THEN 1 END) AS accuracy_b
FROM (SELECT *, filename LIKE '%_species-%' AS s FROM f_) q""")
def model_compare_summary(t):
    _, a, b = _files(t)
    return joins.model_compare_summary(joins.model_compare_join(a, b))


@query("filename_parsers", with_views("crop_labels") + FILES + """
SELECT filename, label AS true_label, regexp_extract(filename, '_([a-z]+)-', 1) AS true_label_rank, NULL AS url_name, NULL AS url_stem FROM f_
UNION ALL SELECT url, NULL, NULL, split_part(rtrim(url, '/'), '/', -1), regexp_replace(split_part(rtrim(url, '/'), '/', -1), '(.)\\.[^.]*$', '\\1') FROM pages""")
def filename_parsers(t):
    from fieldlens.functions import names

    none = F.lit(None).cast("string")
    crops, _, _ = _files(t)
    files = crops.select("filename", names.true_label("filename").alias("true_label"), names.true_rank("filename").alias("true_label_rank"),
                         none.alias("url_name"), none.alias("url_stem"))
    urls = t.pages.select(F.col("url").alias("filename"), none.alias("true_label"), none.alias("true_label_rank"),
                          names.base_name("url").alias("url_name"), names.file_stem("url").alias("url_stem"))
    return files.unionByName(urls)


@query("taxon_level_counts", LEVELS + """
SELECT region, level, count(*) AS crops, count(DISTINCT name) AS taxa FROM levels_ GROUP BY region, level""")
def taxon_level_counts(t):
    return stats.taxon_level_counts(_labels(t), _excluded(t))


@query("taxon_histogram", LEVELS + "SELECT level, name, count(*) AS n FROM levels_ WHERE name IS NOT NULL GROUP BY level, name")
def taxon_histogram(t):
    return stats.taxon_histogram(_labels(t), _excluded(t))


@query("ordered_counts", with_views("occurrence") + """
SELECT speciesKey, count(*) AS n FROM occurrence WHERE speciesKey IS NOT NULL GROUP BY speciesKey""")
def ordered_counts(t):
    return setops.ordered_counts(t.occurrence, "speciesKey")


@query("append_union", with_views("verified", "lifestage_predictions") + """
SELECT image_path, width, NULL AS life_stage_prediction FROM verified
UNION ALL SELECT image_path, NULL, life_stage_prediction FROM lifestage_predictions""")
def append_union(t):
    t = t.frozen()
    return setops.append_union(t.verified.select("image_path", "width"), t.lifestage_predictions)


@query("distinct_keys", with_views("images") + "SELECT DISTINCT acceptedTaxonKey, lifeStage FROM images")
def distinct_keys(t):
    return setops.distinct_keys(t.images, "acceptedTaxonKey", "lifeStage")


@query("set_difference", with_views("crop_labels", "taxonomy") + """
SELECT acceptedTaxonKey FROM crop_labels EXCEPT SELECT speciesKey FROM taxonomy""")
def set_difference(t):
    return setops.set_difference(t.crop_labels, t.taxonomy.select(F.col("speciesKey").alias("acceptedTaxonKey")), "acceptedTaxonKey")
