"""Taxon checklists: matching, merging, comparing and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_FOUND = -1
NOT_AVAILABLE = "NotAvail"


def _deletions(name: Column, edits: int) -> Column:
    """All strings left after removing up to ``edits`` characters; two names within ``edits`` edits share one."""
    variants = F.array(name)
    for _ in range(edits):
        shorter = F.flatten(
            F.transform(
                variants,
                lambda v: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))),
                    lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)),
                ),
            )
        )
        variants = F.array_distinct(F.concat(variants, shorter))
    return variants


def backbone_match(names: DataFrame, backbone: DataFrame, source: str, max_edits: int = 1) -> DataFrame:
    """Resolve searched names to accepted keys: EXACT, FUZZY, HIGHERRANK or NONE.

    ``backbone``: name, usage_key, accepted_usage_key, family, genus, status, rank. Fuzzy candidates come from an
    equi-join on shared deletion variants and are verified with ``levenshtein``, so no block is paired in full.
    Variants go by their hashes, with the names alone. Both joins of names are merged on disk: the planner takes a table
    of names for as small as its file and does not see how many variants a name has, and would send them through the driver.
    Unmatched and higher-rank names keep -1 / NotAvail.
    """
    clean = F.lower(F.trim(F.col("search_species")))
    asked = names.select("search_species").distinct().withColumn("_n", clean)
    known = backbone.withColumn("_n", F.lower(F.trim(F.col("name"))))
    info = F.struct("usage_key", "accepted_usage_key", "name", "family", "genus", "status", "rank")
    one = known.groupBy("_n").agg(F.min(info).alias("hit"))
    exact = asked.join(one.hint("merge"), "_n", "left")
    left = exact.filter(F.col("hit").isNull()).select("_n").distinct()
    hashes = F.transform(_deletions(F.col("_n"), max_edits), lambda v: F.xxhash64(v))
    tokens = left.filter(F.col("_n").isNotNull()).select("_n", F.explode(hashes).alias("_v"))
    offers = one.filter(F.col("_n").isNotNull()).select(F.col("_n").alias("_m"), F.explode(hashes).alias("_v"))
    distance = F.levenshtein("_n", "_m")
    pairs = tokens.join(offers.hint("merge"), "_v").withColumn("_d", distance).filter(F.col("_d") <= max_edits)
    fuzzy = (
        pairs.select(F.col("_n").alias("_a"), "_m", "_d").distinct()
        .join(one.hint("merge"), F.col("_m") == F.col("_n"))
        .groupBy("_a").agg(F.min(F.struct("_d", "hit")).alias("_best"))
        .select(F.col("_a").alias("_n"), F.col("_best.hit").alias("fuzzy_hit"))
    )
    genera = known.groupBy(F.lower("genus").alias("_g")).agg(F.min(F.struct("genus", "family")).alias("higher"))
    out = (
        exact.join(fuzzy.hint("merge"), "_n", "left")
        .withColumn("_g", F.substring_index("_n", " ", 1)).join(genera, "_g", "left")
        .withColumn("match", F.coalesce("hit", "fuzzy_hit"))
    )
    match_type = (
        F.when(F.col("hit").isNotNull(), "EXACT").when(F.col("fuzzy_hit").isNotNull(), "FUZZY")
        .when(F.col("higher").isNotNull(), "HIGHERRANK").otherwise("NONE")
    )
    na = F.lit(NOT_AVAILABLE)
    return out.select(
        F.coalesce("match.accepted_usage_key", "match.usage_key", F.lit(NOT_FOUND)).cast("long").alias("accepted_taxon_key"),
        F.coalesce("match.family", "higher.family", na).alias("family"),
        F.coalesce("match.genus", "higher.genus", na).alias("genus"),
        "search_species",
        F.coalesce("match.name", na).alias("gbif_species"),
        F.coalesce("match.status", na).alias("status"),
        match_type.alias("match_type"),
        F.when(F.col("match").isNull() & F.col("higher").isNotNull(), F.lit("GENUS"))
        .otherwise(F.coalesce("match.rank", na)).alias("rank"),
        F.lit(source).alias("source"),
    )


def checklist_upsert(
    main: DataFrame, incoming: DataFrame, tag: str, dedup_incoming: bool = False, order: str = "row_id"
) -> DataFrame:
    """Tag rows whose key also arrives, append rows that are new or have no key.

    The key list of ``main`` is fixed beforehand, so repeated new keys are all appended unless ``dedup_incoming``.
    """
    key = F.col("accepted_taxon_key")
    arriving = incoming.filter(key != NOT_FOUND).groupBy("accepted_taxon_key").agg(F.count("*").cast("int").alias("_n"))
    tagged = main.join(arriving, "accepted_taxon_key", "left").withColumn(
        "source", F.concat("source", F.repeat(F.lit(" " + tag), F.coalesce("_n", F.lit(0))))
    ).drop("_n")
    unseen = incoming.filter(key != NOT_FOUND).join(main.select("accepted_taxon_key"), "accepted_taxon_key", "left_anti")
    if dedup_incoming:
        unseen = (
            unseen.groupBy("accepted_taxon_key").agg(F.min_by(F.struct(*incoming.columns), order).alias("_row"))
            .select("_row.*")
        )
    return tagged.unionByName(unseen).unionByName(incoming.filter(key == NOT_FOUND))


def checklist_compare(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Each name with the side it is on: a_only, b_only or both; one grouping instead of three joins."""
    sides = a.select(column, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(column, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    found = sides.groupBy(column).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when(F.col("_b") == 0, "a_only").when(F.col("_a") == 0, "b_only").otherwise("both")
    return found.select(column, side.alias("side"))


def stats_reconcile(checklist: DataFrame, recorded: DataFrame, observed: DataFrame, order: str = "row_id") -> DataFrame:
    """Data statistics brought in line with the counts on disk.

    Listed keys on record take the observed count (0 without a folder), listed keys with a folder but no
    record are inserted, unknown taxa get one -1 row per searched name; other records stay.
    """
    cols = ["accepted_taxon_key", "family", "genus", "search_species", "gbif_species", "image_count"]
    key = F.col("accepted_taxon_key")
    listed = (
        checklist.filter(key != NOT_FOUND).groupBy("accepted_taxon_key")
        .agg(F.min_by(F.struct("family", "genus", "search_species", "gbif_species"), order).alias("c"))
    )
    known = recorded.filter(key != NOT_FOUND).select(
        "accepted_taxon_key", F.struct("family", "genus", "search_species", "gbif_species").alias("r"),
        F.col("image_count").alias("_rec"),
    )
    merged = known.join(listed, "accepted_taxon_key", "full_outer").join(
        observed.select("accepted_taxon_key", F.col("image_count").alias("_obs")), "accepted_taxon_key", "left"
    )
    kept = merged.filter(F.col("r").isNotNull() | F.col("_obs").isNotNull())
    count = F.when(F.col("c").isNull(), F.col("_rec")).otherwise(F.coalesce("_obs", F.lit(0)))
    info = F.coalesce("r", "c")
    keyed = kept.select(
        "accepted_taxon_key", *[info[c].alias(c) for c in cols[1:5]], count.cast("long").alias("image_count")
    )
    na = F.lit(NOT_AVAILABLE)
    missing = (
        checklist.filter(key == NOT_FOUND).select("search_species").distinct()
        .join(recorded.select("search_species"), "search_species", "left_anti")
        .select(F.lit(NOT_FOUND).cast("long").alias("accepted_taxon_key"), na.alias("family"), na.alias("genus"),
                "search_species", na.alias("gbif_species"), F.lit(-1).cast("long").alias("image_count"))
    )
    old_missing = recorded.filter(key == NOT_FOUND).select(*cols)
    return keyed.unionByName(old_missing).unionByName(missing)


def synonym_expansion(checklist: DataFrame) -> DataFrame:
    """One label row per checklist row, two for synonyms (own name with ``synonym_of``, and the accepted name)."""
    none = F.lit(None).cast("string")
    own = F.struct(F.col("search_species").alias("species"), none.alias("synonym_of"))
    synonym = F.struct(F.col("search_species").alias("species"), F.col("gbif_species").alias("synonym_of"))
    accepted = F.struct(F.col("gbif_species").alias("species"), none.alias("synonym_of"))
    labels = (
        F.when(F.col("accepted_taxon_key") == NOT_FOUND, F.array(own))
        .when(F.col("status") == "SYNONYM", F.array(synonym, accepted))
        .otherwise(F.array(accepted))
    )
    return checklist.select("genus", "family", "accepted_taxon_key", F.explode(labels).alias("l")).select(
        F.col("l.species").alias("species"), "genus", "family", "accepted_taxon_key", F.col("l.synonym_of").alias("synonym_of")
    )


def key_quality_report(checklist: DataFrame) -> DataFrame:
    """Unique, total, duplicated and not-found counts of names and keys."""
    named = F.when(F.col("gbif_species") != NOT_AVAILABLE, F.col("gbif_species"))
    keyed = F.when(F.col("accepted_taxon_key") != NOT_FOUND, F.col("accepted_taxon_key"))
    per_key = (
        checklist.filter(F.col("accepted_taxon_key") != NOT_FOUND).groupBy("accepted_taxon_key")
        .agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    )
    return checklist.agg(
        F.count("*").alias("rows"),
        F.countDistinct("search_species").alias("unique_search_names"),
        F.countDistinct(named).alias("unique_gbif_names"),
        F.count(named).alias("gbif_names"),
        F.countDistinct(keyed).alias("unique_keys"),
        F.count(keyed).alias("keys"),
        F.count_if(F.col("accepted_taxon_key") == NOT_FOUND).alias("not_found"),
    ).withColumn("duplicated_keys", per_key)


def taxa_summary(checklist: DataFrame, statistics: DataFrame) -> DataFrame:
    """Families, genera, species and images per list; unknown taxa left out."""
    counts = statistics.groupBy("accepted_taxon_key").agg(F.min("image_count").alias("image_count"))
    found = checklist.filter(F.col("accepted_taxon_key") != NOT_FOUND)
    return (
        found.join(counts, "accepted_taxon_key", "left").groupBy("source")
        .agg(
            F.countDistinct("family").alias("families"),
            F.countDistinct("genus").alias("genera"),
            F.countDistinct("gbif_species").alias("species"),
            F.coalesce(F.sum("image_count"), F.lit(0)).alias("images"),
        )
    )


def taxon_hierarchy(checklist: DataFrame, order: str = "row_id") -> DataFrame:
    """Species -> (genus, family), first listing wins, NotAvail left out."""
    return (
        checklist.filter(F.col("gbif_species") != NOT_AVAILABLE).groupBy("gbif_species")
        .agg(F.min_by(F.struct("genus", "family"), order).alias("t"))
        .select("gbif_species", "t.genus", "t.family")
    )


def capped_sum(checklist: DataFrame, count: str, cap: int = 1000, status: str = "status") -> DataFrame:
    return checklist.filter(F.col(status) == "ACCEPTED").agg(
        F.sum(F.least(F.col(count), F.lit(cap))).alias("total"), F.count("*").alias("taxa")
    )


def category_map(df: DataFrame, label: str, not_a_class: str | None = None) -> DataFrame:
    """Distinct labels in order -> class id from 0; numbers sort as numbers."""
    from fieldlens.operators.ordering import global_rank

    labels = df.select(label).distinct().dropna()
    if not_a_class is not None:
        labels = labels.filter(F.col(label) != not_a_class)
    placed = global_rank(labels, [F.col(label)], "_r")
    return placed.select(F.col(label).cast("string").alias("category"), (F.col("_r") - 1).alias("class_id"))
