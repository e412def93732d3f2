"""Batch scoring of feature rows with a linear head."""

from __future__ import annotations

import io

import numpy as np
from pyspark import SparkFiles
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fieldlens.session import work_dir
from fieldlens.sources import files


class LinearHead:
    """weights [classes, dim], bias [classes] and class names; a model head, so its size is fixed."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, names: list[str]):
        self.weights, self.bias, self.names = weights, bias, names

    @classmethod
    def from_centroids(cls, labelled: DataFrame, features: str, label: str) -> LinearHead:
        """Nearest-centroid head: x.c - |c|^2/2 is largest for the closest class mean. Means are summed as vectors, map-side first."""
        mean = Summarizer.mean(array_to_vector(F.col(features).cast("array<double>")))
        parts = labelled.groupBy(label).agg(vector_to_array(mean).alias("c")).orderBy(label).collect()
        weights = np.array([row["c"] for row in parts])
        return cls(weights, -0.5 * (weights**2).sum(axis=1), [str(row[label]) for row in parts])

    def published(self, spark: SparkSession) -> str:
        """Hands the head to the executors as a file, which each fetches once and its workers map; the file's name."""
        path = work_dir(spark, "head") + ".npy"
        data = io.BytesIO()
        np.save(data, np.column_stack([self.weights, self.bias]))
        fs, target = files.open_fs(path)
        files.write_bytes(fs, target, data.getvalue())
        spark.sparkContext.addFile(path)
        return path.rsplit("/", 1)[1]


def batch_score(rows: DataFrame, head: LinearHead, row_id: str, features: str) -> DataFrame:
    """Best class name per row, one matrix product per batch; rows never leave their partition."""
    name, names = head.published(rows.sparkSession), rows.sparkSession.sparkContext.broadcast(head.names)

    def opened():
        both = np.load(SparkFiles.get(name), mmap_mode="r")
        weights, bias, classes = both[:, :-1], both[:, -1], np.array(names.value, dtype=object)

        def predict(x: np.ndarray) -> np.ndarray:
            return classes[np.argmax(x @ weights.T + bias, axis=1)]

        return predict

    # a batch's scores take about 32 MB
    scored = predict_batch_udf(
        opened, return_type=StringType(), batch_size=max(1, (4 << 20) // max(1, len(head.names))), input_tensor_shapes=[[head.weights.shape[1]]]
    )
    return rows.select(row_id, scored(F.col(features).cast("array<double>")).alias("prediction"))


def append_scores(existing: DataFrame | None, new: DataFrame, row_id: str) -> DataFrame:
    """Earlier and new predictions, one per row; an earlier one stays."""
    if existing is None:
        return new
    fresh = new.join(existing.select(row_id), row_id, "left_anti")
    return existing.unionByName(fresh)
