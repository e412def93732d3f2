from __future__ import annotations

from fieldlens.catalog import checklists as catalog


def test_accuracy_join_counts_images_once(spark, tmp_path, monkeypatch):
    scans = []
    monkeypatch.setattr(catalog, "materialized", lambda df, purpose: scans.append(purpose) or df)

    class Given:
        taxonomy = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], "speciesKey long, species string")
        images = spark.createDataFrame([(2, 5), (2, 6), (2, None), (1, 5), (None, 5)], "acceptedTaxonKey long, l_suppkey long")
        crop_labels = spark.createDataFrame([("SPECIES", "b", 3)], "taxon_rank string, label string, crop_id long")

    rows = catalog.checklist_accuracy_join(Given).collect()
    assert scans == ["per-taxon"]
    assert [(r.species, r.gbif_train_imgs, r.gbif_test_imgs, r.gbif_test_top1_acc, r.traps_test_imgs) for r in rows] == [("b", 3, 1, 100.0, 1)]
