"""Query adaptation by ridge regression: one linear map on query vectors; documents stay as they are."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import TINY, widths, weighted_centroids
from tessera.operators.blocks import solve, spans, to_matrix
from tessera.sources.files import read_text, stored, write_text

#: Rows and columns of a block of the moments: 512 KB.
BLOCK = 256
RESERVED = ("normalize", "method")


@dataclass
class LinearQueryCalibrator:
    """q -> q @ weights, of unit length if normalize."""

    weights: np.ndarray
    normalize: bool = True
    method: str = "ridge"

    def __post_init__(self) -> None:
        self.weights = np.asarray(self.weights, np.float32)
        if self.weights.ndim != 2:
            raise ValueError("weights must be a matrix")

    def mapped(self, vector: Column) -> Column:
        weights, normalize = self.weights, self.normalize

        def apply(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            out = np.stack([np.asarray(v, np.float32) for v in vectors]) @ weights
            if normalize:
                out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), TINY)
            return pd.Series(list(out.astype(np.float32)))

        return F.pandas_udf(apply, "array<float>")(vector)

    def transform(self, queries: DataFrame, vector_col: str = "embedding") -> DataFrame:
        low, high = widths(queries, vector_col)
        if low is not None and {low, high} != {self.weights.shape[0]}:
            raise ValueError(f"queries are of width {low} to {high}; the map takes {self.weights.shape[0]}")
        return queries.withColumn(vector_col, self.mapped(F.col(vector_col)))

    def save(self, spark: SparkSession, path: str, **metadata) -> None:
        """Rows of the weights as Parquet, and a JSON file beside them."""
        if clash := set(RESERVED) & set(metadata):
            raise ValueError(f"reserved metadata: {sorted(clash)}")
        rows = [(i, row.tolist()) for i, row in enumerate(self.weights)]
        spark.createDataFrame(rows, "i int, row array<float>").coalesce(1).write.mode("overwrite").parquet(path)
        write_text(spark, f"{path}.json", json.dumps({"normalize": self.normalize, "method": self.method} | metadata, sort_keys=True, indent=2))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearQueryCalibrator:
        found = json.loads(read_text(spark, f"{path}.json", missing="{}"))
        rows = spark.read.parquet(path).orderBy("i").collect()
        return cls(np.array([r["row"] for r in rows], np.float32), found.get("normalize", True), found.get("method", "ridge"))


def moments(pairs: DataFrame, width: int, target_width: int, block: int = BLOCK) -> DataFrame:
    """pairs (source, target) -> (kind, i, j, values): blocks of the Gram matrix S'S (those with i >= j) and the cross moment S'T, row by row, summed in double.

    Each task multiplies its batches and sends on one row a block; whole blocks are added, in the tasks and after the shuffle.
    """
    rows, columns = spans(width, block), spans(target_width, block)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, cross, some = np.zeros((width, width)), np.zeros((width, target_width)), False
        for batch in batches:
            if len(batch):
                some = True
                s, t = (np.stack([np.asarray(v, np.float64) for v in batch[c]]) for c in ("source", "target"))
                gram += s.T @ s
                cross += s.T @ t
        if some:
            for kind, m, across in (("gram", gram, rows), ("cross", cross, columns)):
                for i, (a, b) in enumerate(rows):
                    for j, (c, d) in enumerate(across[: i + 1] if kind == "gram" else across):
                        yield pd.DataFrame({"kind": [kind], "i": [i], "j": [j], "values": [m[a:b, c:d].ravel()]})

    parts = pairs.select("source", "target").mapInPandas(sums, "kind string, i int, j int, values array<double>")
    total = parts.groupBy("kind", "i", "j").agg(Summarizer.sum(array_to_vector("values")).alias("values"))
    return total.withColumn("values", vector_to_array("values"))


def cells(found: DataFrame, width: int, target_width: int, block: int = BLOCK) -> DataFrame:
    """moments() -> (kind, i, j, value), a row per cell of both matrices."""
    own = F.when(F.col("kind") == "gram", F.lit(width)).otherwise(F.lit(target_width))
    across = F.least(F.lit(block), own - F.col("j") * block)
    each = found.select("kind", F.col("i").alias("bi"), F.col("j").alias("bj"), across.alias("n"), F.posexplode("values").alias("at", "value"))
    i, j = (F.col("bi") * block + F.expr("at div n")).cast("int"), (F.col("bj") * block + F.col("at") % F.col("n")).cast("int")
    lower = each.select("kind", i.alias("i"), j.alias("j"), "value")
    upper = each.where("kind = 'gram' and bi > bj").select("kind", j.alias("i"), i.alias("j"), "value")
    return lower.unionByName(upper)


def ridge_map(pairs: DataFrame, alpha: float, block: int = BLOCK) -> np.ndarray:
    """The float32 matrix W that solves (S'S + alpha I) W = S'T. The system is solved over its blocks; the driver gets one of them at a time, and W."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    r = pairs.agg(F.count(F.lit(1)).alias("n"), *[f(F.size(c)).alias(f"{n}_{c}") for c in ("source", "target") for n, f in (("min", F.min), ("max", F.max))]).first()
    if not r["n"]:
        raise ValueError("there are no rows to fit")
    if any(r[f"min_{c}"] != r[f"max_{c}"] for c in ("source", "target")):
        raise ValueError("vectors must be of one width")
    width, target_width = r["min_source"], r["min_target"]
    found = stored(moments(pairs, width, target_width, block), "moments")
    sizes = [b - a for a, b in spans(width, block)]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, i, j, v in zip(batch["kind"], batch["i"], batch["j"], batch["values"], strict=True):
                m = np.array(v, np.float64).reshape(sizes[i], -1)
                if kind == "gram" and i == j:
                    m = m + alpha * np.eye(len(m))
                out.append(m.tobytes())
            yield pd.DataFrame({"kind": batch["kind"], "i": batch["i"], "j": batch["j"], "m": out})

    system = found.mapInPandas(packed, "kind string, i int, j int, m binary")
    solved = solve(system.where("kind = 'gram'").drop("kind"), system.where("kind = 'cross'").drop("kind"), width, block)
    if not solved.condition <= 1e12:
        warnings.warn("the system is close to singular; raise alpha", stacklevel=2)
    return to_matrix(solved.x, width, target_width, block).astype(np.float32)


def fit_corpus_alignment(sources: DataFrame, documents: DataFrame, alpha: float = 1e-2, normalize: bool = True) -> LinearQueryCalibrator:
    """From documents encoded as queries (id, embedding) to the documents' own vectors (id, embedding)."""
    pairs = sources.select("id", F.col("embedding").alias("source")).join(documents.select("id", F.col("embedding").alias("target")), "id")
    return LinearQueryCalibrator(ridge_map(pairs, alpha), normalize, "corpus_alignment_ridge")


def gold_pairs(queries: DataFrame, documents: DataFrame, qrels: DataFrame, train_ids: DataFrame | None = None) -> DataFrame:
    """(id, source, target): each training query and the grade-weighted centroid of its relevant documents that exist."""
    rel = qrels.where("score > 0").select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("id"), "score")
    asked = queries.select(F.col("id").cast("string").alias("query_id"), F.col("embedding").alias("source"))
    if train_ids is not None:
        asked = asked.join(train_ids.select(F.col("id").cast("string").alias("query_id")).distinct(), "query_id", "left_semi")
    rel = rel.join(asked.select("query_id"), "query_id", "left_semi")
    centroids = weighted_centroids(documents.select(F.col("id").cast("string").alias("id"), "embedding").join(rel, "id"), "query_id", "score")
    return asked.join(centroids.withColumnRenamed("embedding", "target"), "query_id").withColumnRenamed("query_id", "id")


def fit_gold_supervised(queries: DataFrame, documents: DataFrame, qrels: DataFrame, train_ids: DataFrame | None = None, alpha: float = 1e-2, normalize: bool = True) -> LinearQueryCalibrator:
    """From queries to the centroids of their relevant documents. Queries without one are left out."""
    return LinearQueryCalibrator(ridge_map(gold_pairs(queries, documents, qrels, train_ids), alpha), normalize, "gold_centroid_ridge")
