"""Fixture views over the given tables, one SQL text shared by Spark and the oracle engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.session import materialized

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# declared, so that no query pays for reading footers to learn them
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "media": (("lineitem",), """
        SELECT l_orderkey AS coreid,
               concat('http://img.example/', CAST(l_partkey AS STRING), '_', CAST(l_suppkey % 20 AS STRING)) AS identifier,
               md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                             CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))) AS ord,
               l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice, l_shipdate
        FROM lineitem"""),
    "occurrence": (("orders",), """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE concat('ds', CAST(o_orderkey % 7 AS STRING)) END AS datasetKey,
               k AS speciesKey, (k % 40) % 8 AS familyKey, (k % 40) % 8 % 3 AS orderKey,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE k END AS acceptedTaxonKey,
               CASE o_orderstatus WHEN 'F' THEN 'Adult' WHEN 'O' THEN 'Larva' ELSE NULL END AS lifeStage,
               o_totalprice % 180 - 90 AS decimalLatitude,
               o_totalprice % 360 - 180 AS decimalLongitude,
               o_orderdate AS eventDate
        FROM (SELECT *, CASE WHEN o_custkey % 200 >= 150 AND o_orderkey % 10 <> 0 THEN o_custkey % 10
                             ELSE o_custkey % 200 END AS k FROM orders) x"""),
    "taxonomy": (("orders",), """
        SELECT DISTINCT o_custkey % 200 AS speciesKey,
               concat('species ', CAST(o_custkey % 200 AS STRING)) AS species,
               concat('genus ', CAST(o_custkey % 40 AS STRING)) AS genus,
               concat('family ', CAST((o_custkey % 40) % 8 AS STRING)) AS family
        FROM orders"""),
    "images": (("media", "occurrence"), """
        SELECT m.*, o.*, concat(coalesce(o.datasetKey, 'nan'), '/', CAST(m.coreid AS STRING),
               CASE WHEN m.cnt > 0 THEN concat('_', CAST(m.cnt AS STRING)) ELSE '' END, '.jpg') AS image_path
        FROM (SELECT *, row_number() OVER (PARTITION BY coreid ORDER BY ord) - 1 AS cnt FROM media) m
        JOIN occurrence o ON m.coreid = o.id"""),
    "verified": (("images",), """
        SELECT image_path,
               CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(round(l_quantity * 20) AS INT) END AS width,
               CAST(round(l_discount * 10000) AS INT) + 30 AS height,
               l_shipdate AS fetch_date, CAST(floor(l_extendedprice) AS BIGINT) AS file_size,
               l_suppkey % 29 = 0 AS corrupted
        FROM images WHERE l_suppkey % 10 <> 0 AND datasetKey IS NOT NULL"""),
    "lifestage_predictions": (("images",), """
        SELECT image_path, CASE WHEN l_suppkey % 6 = 0 THEN 'Larva' ELSE 'Adult' END AS life_stage_prediction
        FROM images WHERE lifeStage IS NULL AND l_suppkey % 3 = 0"""),
    "checklist": (("part",), """
        SELECT CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey % 900 END AS accepted_taxon_key,
               p_type AS family, p_brand AS genus,
               concat(p_name, ' ', CAST(p_partkey AS STRING)) AS search_species,
               CASE WHEN p_partkey % 11 = 0 THEN 'NotAvail'
                    ELSE concat(p_name, ' ', CAST(p_partkey % 900 AS STRING)) END AS gbif_species,
               CASE WHEN p_partkey % 11 = 0 THEN 'NotAvail' WHEN p_partkey >= 900 THEN 'SYNONYM' ELSE 'ACCEPTED' END AS status,
               CASE WHEN p_size % 10 = 0 THEN 'GENUS' ELSE 'SPECIES' END AS rank,
               CASE WHEN p_partkey % 7 < 4 THEN 'list_a' ELSE 'list_b' END AS source, p_partkey AS row_id
        FROM part"""),
    "boxes": (("events",), """
        SELECT event_id AS box_id, CAST(floor(event_id / 20) AS BIGINT) AS image, event_type,
               (event_id * 137) % 600 AS x1, (event_id * 53) % 400 AS y1,
               (event_id * 137) % 600 + 40 + event_id % 60 AS x2, (event_id * 53) % 400 + 40 + event_id % 50 AS y2,
               value / 500 AS score, event_id % 15 AS jitter
        FROM events"""),
    "det_boxes": (("boxes",), """
        SELECT image, box_id, x1, y1, x2, y2, score FROM boxes WHERE event_type <> 'signup'"""),
    "gt_boxes": (("boxes",), """
        SELECT image, box_id, x1 + jitter AS x1, y1 + jitter AS y1, x2 + jitter AS x2, y2 + jitter AS y2
        FROM boxes WHERE event_type IN ('click', 'view', 'signup')"""),
    "frame_boxes": (("events",), """
        SELECT CAST(floor(event_id / 400) AS BIGINT) AS deployment, CAST(floor(event_id / 4) AS BIGINT) % 100 AS frame,
               event_id AS box_id,
               (event_id % 4) * 150 + (event_id * 7) % 60 AS x1, 100 + (event_id * 5) % 40 AS y1,
               (event_id % 4) * 150 + (event_id * 7) % 60 + 80 AS x2, 100 + (event_id * 5) % 40 + 60 AS y2,
               CASE WHEN event_type = 'error' THEN 'nonmoth' ELSE 'moth' END AS class,
               CAST(floor(value / 5) AS INT) AS confidence
        FROM events"""),
    "video_predictions": (("events",), """
        SELECT CAST(floor(event_id / 500) AS BIGINT) AS video, event_id % 500 AS frame,
               CASE WHEN event_id % 23 = 0 THEN event_type
                    ELSE concat('c', CAST(CAST(floor(event_id / 50) AS BIGINT) % 5 AS STRING)) END AS class,
               0.45 + ((event_id * 13) % 55) / 100 AS confidence
        FROM events"""),
    "binary_predictions": (("labels",), """
        SELECT doc_id, CASE WHEN quality = 1 THEN 'Moth' ELSE 'Non-Moth' END AS gt,
               CASE WHEN toxic = 0 THEN 'Moth' ELSE 'Non-Moth' END AS pred, (doc_id * 37) % 101 AS conf
        FROM labels"""),
    # one annotation task per conversation, one item per turn; rev marks items the reviewer kept
    "annotation_items": (("conversations",), """
        SELECT conv_id, turn AS pos, CAST(floor(turn / 2) AS BIGINT) AS item_id,
               CASE turn % 3 WHEN 0 THEN 'rectangle' WHEN 1 THEN 'labels' ELSE 'taxonomy' END AS type,
               turn % 4 <> 1 AS rev, conv_id % 5 = 0 AS has_review, conv_id % 10 = 0 AS fixed,
               CASE (conv_id + turn) % 5 WHEN 0 THEN 'Moth' WHEN 1 THEN 'Non-Moth' WHEN 2 THEN 'Unidentifiable'
                    WHEN 3 THEN 'Unclassified' ELSE NULL END AS label,
               CASE (conv_id + turn) % 4 WHEN 0 THEN 'Lepidoptera' WHEN 3 THEN 'Lepidoptera/Fam9'
                    ELSE concat('Lepidoptera/Fam', CAST(conv_id % 4 AS STRING)) END AS path_a,
               CASE (conv_id + turn) % 4
                    WHEN 2 THEN concat('Lepidoptera/Fam', CAST(conv_id % 4 AS STRING), '/Gen', CAST(conv_id % 8 AS STRING))
                    WHEN 3 THEN concat('Lepidoptera/Fam', CAST(conv_id % 4 AS STRING), '/Gen', CAST(conv_id % 8 AS STRING),
                                       '/Sp', CAST(conv_id % 16 AS STRING))
                    ELSE NULL END AS path_b,
               CAST((conv_id * 7 + turn * 11) % 90 AS DOUBLE) + 0.5 AS x, CAST((conv_id * 5 + turn * 3) % 90 AS DOUBLE) + 0.25 AS y,
               CAST((conv_id + turn) % 30 AS DOUBLE) + 3.3 AS width, CAST((conv_id * 3 + turn) % 20 AS DOUBLE) + 2.7 AS height
        FROM conversations"""),
    "annotation_tasks": (("conversations",), """
        SELECT DISTINCT conv_id, concat('http://img.example/traps/t', CAST(CASE WHEN conv_id % 12 = 7 THEN conv_id - 6
                                 ELSE conv_id END AS STRING), '.jpg') AS image,
               concat(CASE conv_id % 6 WHEN 0 THEN 'Panama' WHEN 1 THEN 'Denmark' WHEN 2 THEN 'UK' WHEN 3 THEN 'Quebec'
                      WHEN 4 THEN 'Vermont' ELSE 'Nowhere' END, ' station ', CAST(conv_id % 9 AS STRING)) AS deployment
        FROM conversations"""),
    "taxon_db": (("conversations",), """
        SELECT DISTINCT name, CASE WHEN name = 'Lepidoptera' THEN 'ORDER' WHEN name LIKE 'Fam%' THEN 'FAMILY'
                                   WHEN name LIKE 'Gen%' THEN 'GENUS' ELSE 'SPECIES' END AS rank
        FROM (SELECT concat('Sp', CAST(conv_id % 16 AS STRING)) AS name FROM conversations
              UNION ALL SELECT concat('Gen', CAST(conv_id % 8 AS STRING)) FROM conversations
              UNION ALL SELECT concat('Fam', CAST(conv_id % 4 AS STRING)) FROM conversations
              UNION ALL SELECT 'Lepidoptera' FROM conversations) n"""),
    # crop labels at several ranks, keyed to the taxonomy view
    "crop_labels": (("orders",), """
        SELECT o_orderkey AS crop_id,
               CASE o_orderkey % 5 WHEN 3 THEN 'GENUS' WHEN 4 THEN 'FAMILY' ELSE 'SPECIES' END AS taxon_rank,
               CASE o_orderkey % 5 WHEN 3 THEN concat('genus ', CAST(o_custkey % 40 AS STRING))
                    WHEN 4 THEN concat('family ', CAST((o_custkey % 40) % 8 AS STRING))
                    ELSE concat('species ', CAST(o_custkey % 210 AS STRING)) END AS label,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN -1 ELSE o_custkey % 210 END AS acceptedTaxonKey,
               CASE o_orderkey % 3 WHEN 0 THEN 'NorthEasternAmerica' WHEN 1 THEN 'WesternEurope' ELSE 'CentralAmerica' END AS region
        FROM orders"""),
}

# every value of the vector is the score of one class
_LOGITS_SPARK = """
    SELECT vec_id, transform(embedding, (x, i) -> CAST(x AS DOUBLE) * 10
           + CASE WHEN i = label AND vec_id % 3 <> 0 THEN 4.0D ELSE 0.0D END) AS logits, label FROM embeddings"""
_LOGITS_ORACLE = """
    SELECT vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * 10
           + CASE WHEN i - 1 = label AND vec_id % 3 <> 0 THEN 4.0 ELSE 0.0 END) AS logits, label FROM embeddings"""
# one class per position of the vectors
_CLASSES_SPARK = "SELECT explode(sequence(0, max(size(embedding)) - 1)) AS class_id FROM {embeddings}"
_CLASSES_ORACLE = "SELECT CAST(unnest(range(0, max(len(embedding)))) AS INTEGER) AS class_id FROM embeddings"
_TAXA = """
    SELECT class_id, concat('sp', CAST(class_id AS STRING)) AS species, concat('g', CAST(class_id % 16 AS STRING)) AS genus,
           concat('f', CAST(class_id % 4 AS STRING)) AS family FROM ("""
# softmax, rounded ranks and the true taxon, shared by the evaluation oracles
_PROBS_ORACLE = """
    SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS probs
    FROM (SELECT vec_id, label, list_transform(logits, lambda z: exp(z - list_max(logits))) AS e FROM logits) q"""
_EVAL_ORACLE = """
    SELECT vec_id, label, u - 1 AS class_id, probs[u] AS p, round(probs[u], 3) AS p3,
           row_number() OVER (PARTITION BY vec_id ORDER BY probs[u] DESC, u) AS pos
    FROM (SELECT *, unnest(range(1, len(probs) + 1)) AS u FROM probs) q"""
_RANKED_ORACLE = """
    SELECT vec_id, level, gt, pred, conf, row_number() OVER (PARTITION BY vec_id, level ORDER BY conf DESC, first_pos) AS rk
    FROM (SELECT e.vec_id, lv.level,
                 max(CASE lv.level WHEN 'SPECIES' THEN g.species WHEN 'GENUS' THEN g.genus ELSE g.family END) AS gt,
                 CASE lv.level WHEN 'SPECIES' THEN t.species WHEN 'GENUS' THEN t.genus ELSE t.family END AS pred,
                 CASE WHEN lv.level = 'SPECIES' THEN max(e.p) ELSE round(sum(e.p3), 3) END AS conf, min(e.pos) AS first_pos
          FROM evaluated e JOIN class_taxonomy t ON t.class_id = e.class_id JOIN class_taxonomy g ON g.class_id = e.label,
               (SELECT unnest(['SPECIES', 'GENUS', 'FAMILY']) AS level) lv
          GROUP BY 1, 2, 4) q"""

# columns of the images that the views of verification and life stages read
_VERIFIED = ("datasetKey", "lifeStage", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_shipdate", "l_extendedprice")

_ORACLE_ONLY = {
    "logits": (("embeddings",), _LOGITS_ORACLE),
    "class_taxonomy": (("embeddings",), _TAXA + _CLASSES_ORACLE + ") k"),
    "probs": (("logits",), _PROBS_ORACLE),
    "evaluated": (("probs",), _EVAL_ORACLE),
    "ranked_predictions": (("evaluated", "class_taxonomy"), _RANKED_ORACLE),
}


def _closure(names: tuple[str, ...], views: dict) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in seen:
            return
        for dep in views[name][0]:
            visit(dep)
        seen.append(name)

    for n in names:
        visit(n)
    return seen


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause defining the named views and what they need, for the oracle engine."""
    views = {**_VIEWS, **_ORACLE_ONLY}
    parts = [f"{n} AS MATERIALIZED ({views[n][1]})" for n in _closure(names, views)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)


class Tables:
    """Given tables and fixture views of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, images: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._images = images

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        if name in _VIEWS:
            return self._view(name)
        raise AttributeError(name)

    def _view(self, name: str) -> DataFrame:
        needed = _closure((name,), _VIEWS)
        bases = sorted({d for n in needed for d in _VIEWS[n][0] if d in BASE})
        parts = [f"{b} AS (SELECT * FROM {{{b}}})" for b in bases]
        parts += [f"{n} AS ({_VIEWS[n][1]})" for n in needed]
        text = "WITH " + ",\n".join(parts) + f" SELECT * FROM {name}"
        return self.spark.sql(text, **{b: getattr(self, b) for b in bases})

    @property
    def images(self) -> DataFrame:
        from fieldlens.plans.dataset import image_metadata

        if self._images is None:
            self._images = image_metadata(self.media, self.occurrence)
        return self._images

    def written(self, *columns: str) -> DataFrame:
        """These columns of the image metadata, written once, for queries that read them several times."""
        return materialized(self.images.select(*columns), "images")

    def frozen(self, *columns: str) -> Tables:
        """The same tables with these columns of the image metadata, and those that verification results and predictions are made of,
        written once, for queries that read them several times."""
        return Tables(self.spark, self.sf_dir, self.written(*dict.fromkeys(("image_path", *_VERIFIED, *columns))))

    @property
    def verified(self) -> DataFrame:
        return self.images.filter((F.col("l_suppkey") % 10 != 0) & F.col("datasetKey").isNotNull()).select(
            "image_path",
            F.when(F.col("l_partkey") % 41 != 0, F.round(F.col("l_quantity") * 20).cast("int")).alias("width"),
            (F.round(F.col("l_discount") * 10000).cast("int") + 30).alias("height"),
            F.col("l_shipdate").alias("fetch_date"),
            F.floor("l_extendedprice").cast("long").alias("file_size"),
            (F.col("l_suppkey") % 29 == 0).alias("corrupted"),
        )

    @property
    def lifestage_predictions(self) -> DataFrame:
        return self.images.filter(F.col("lifeStage").isNull() & (F.col("l_suppkey") % 3 == 0)).select(
            "image_path",
            F.when(F.col("l_suppkey") % 6 == 0, "Larva").otherwise("Adult").alias("life_stage_prediction"),
        )

    @property
    def logits(self) -> DataFrame:
        text = _LOGITS_SPARK.replace("FROM embeddings", "FROM {embeddings}")
        return self.spark.sql(text, embeddings=self.embeddings)

    @property
    def class_taxonomy(self) -> DataFrame:
        return self.spark.sql(_TAXA + _CLASSES_SPARK + ") k", embeddings=self.embeddings)

    @property
    def tasks(self) -> DataFrame:
        """Nested annotation tasks; one task holds at most a few items per image, so the arrays stay short."""
        item = F.struct(
            F.col("item_id").cast("string").alias("id"),
            "type",
            F.struct(
                "x", "y", "width", "height",
                F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array("label")).alias("labels"),
                F.when(F.col("path_b").isNull(), F.array(F.split("path_a", "/")))
                .otherwise(F.array(F.split("path_a", "/"), F.split("path_b", "/"))).alias("taxonomy"),
            ).alias("value"),
        )
        grouped = self.annotation_items.groupBy("conv_id", "has_review", "fixed").agg(
            F.sort_array(F.collect_list(F.struct("pos", item.alias("item"))))["item"].alias("result"),
            F.sort_array(F.collect_list(F.when(F.col("rev"), F.struct("pos", item.alias("item")))))["item"].alias("kept"),
        )
        review = F.struct(
            F.when(F.col("fixed"), F.array(F.lit("edit"))).otherwise(F.array().cast("array<string>"))
            .alias("fixed_annotation_history"),
            F.col("kept").alias("fixed_annotation_history_result"),
        )
        empty = F.slice(F.array(review), 1, 0)
        annotations = F.array(
            F.struct("result", F.when(F.col("has_review"), F.array(review)).otherwise(empty).alias("reviews"))
        )
        return grouped.join(self.annotation_tasks, "conv_id").select(
            F.col("conv_id").alias("task_id"),
            F.struct("image", "deployment").alias("data"),
            annotations.alias("annotations"),
        )
