"""Symmetric linear systems over blocks: elimination by block rows, as Spark jobs.

A matrix is a DataFrame (i, j, m): block (i, j) of at most `block` rows and columns, m being its values in binary, row by row. Of a symmetric matrix only the blocks with i >= j are there. The driver holds one diagonal block and its inverse at a time; all else stays in tasks.

Elimination. In step k the diagonal block D = A_kk is factored (by Cholesky; where it isn't positive definite, it is inverted as it is). Each further block becomes A_ij - A_ik D^-1 A_jk', and so do the blocks of the right side. Then the solution is found from the last block row up: X_k = D_k^-1 (B_k - sum of A_ik' X_i over i > k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import stored

#: Random right sides by which the inverse's norm is estimated.
PROBES = 8
_BLOCK = "i int, j int, m binary"


def spans(width: int, block: int) -> list[tuple[int, int]]:
    return [(i, min(i + block, width)) for i in range(0, width, block)]


def _read(m: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(m, np.float64).reshape(rows, -1)


def to_blocks(spark: SparkSession, a: np.ndarray, block: int, lower: bool = False) -> DataFrame:
    """The blocks of a matrix that the driver holds. lower: those with i >= j alone."""
    rows = [(i, j, bytearray(np.ascontiguousarray(a[r[0] : r[1], c[0] : c[1]]).tobytes())) for i, r in enumerate(spans(a.shape[0], block)) for j, c in enumerate(spans(a.shape[1], block)) if i >= j or not lower]
    return spark.createDataFrame(rows, _BLOCK)


@dataclass
class Solution:
    """x: blocks (i, j, m) of the solution. condition: an estimate of the Frobenius norms of the matrix and its inverse, multiplied; it is at least about the condition number."""

    x: DataFrame
    condition: float


def _mapped(frame: DataFrame, function) -> DataFrame:
    """function(i, j, array) -> array over each block."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"i": batch["i"], "j": batch["j"], "m": [function(i, j, m).tobytes() for i, j, m in zip(batch["i"], batch["j"], batch["m"], strict=True)]})

    return frame.mapInPandas(run, _BLOCK)


def _update(target: DataFrame, left: DataFrame, right: DataFrame, size, transposed: bool, inverse: np.ndarray) -> DataFrame:
    """target (i, j) - left (i) inverse right (j), for each block of target; right' if transposed. left and right are (n, m)."""
    rows = target.join(left.toDF("i", "_left"), "i").join(right.toDF("j", "_right"), "j")

    def run(batches):
        for batch in batches:
            out = []
            for i, j, m, a, b in zip(batch["i"], batch["j"], batch["m"], batch["_left"], batch["_right"], strict=True):
                a = _read(a, size(i))
                b = _read(b, size(j)).T if transposed else _read(b, len(inverse))
                out.append((_read(m, size(i)) - a @ (inverse @ b)).tobytes())
            yield pd.DataFrame({"i": batch["i"], "j": batch["j"], "m": out})

    return rows.select("i", "j", "m", "_left", "_right").mapInPandas(run, _BLOCK)


def _less(k: int, sizes: list[int]):
    """Over a column block's rows: block row k of the right side less what the solved rows below make of it."""

    def less(key, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(())
        for i, m, p in zip(part["i"], part["m"], part["_panel"], strict=True):
            total = total + (_read(m, sizes[k]) if p is None else -(_read(p, sizes[i]).T @ _read(m, sizes[i])))
        return pd.DataFrame({"i": [k], "j": [key[0]], "m": [total.tobytes()]})

    return less


def solve(a: DataFrame, b: DataFrame, width: int, block: int) -> Solution:
    """a (blocks with i >= j of a symmetric matrix of this width), b (blocks of the right side) -> a^-1 b. LinAlgError if a diagonal block can't be inverted."""
    spark, sizes = a.sparkSession, [hi - lo for lo, hi in spans(width, block)]
    size = sizes.__getitem__
    last = 1 + b.agg(F.max("j")).first()[0]
    signs = np.random.default_rng(0).choice([-1.0, 1.0], (width, PROBES))
    probes = [(i, last, bytearray(signs[lo:hi].tobytes())) for i, (lo, hi) in enumerate(spans(width, block))]
    right = stored(b.unionByName(spark.createDataFrame(probes, _BLOCK)), "right-side")
    a = stored(a, "matrix")

    def squares(frame: DataFrame, twice: bool) -> float:
        """The sum of all squares. twice: of a symmetric matrix, of which half the blocks are there."""

        def run(batches):
            for batch in batches:
                yield pd.DataFrame({"x": [float((np.frombuffer(m, np.float64) ** 2).sum()) * (2 if twice and i != j else 1) for i, j, m in zip(batch["i"], batch["j"], batch["m"], strict=True)]})

        return frame.mapInPandas(run, "x double").agg(F.sum("x")).first()[0] or 0.0

    norm = np.sqrt(squares(a, True))
    steps = []  # of (the panel below the diagonal block, its inverse, the block row of the right side)
    for k in range(len(sizes)):
        diagonal = _read(a.where((F.col("i") == k) & (F.col("j") == k)).first()["m"], sizes[k])
        try:
            root = np.linalg.inv(np.linalg.cholesky(diagonal))
            inverse = root.T @ root
        except np.linalg.LinAlgError:
            inverse = np.linalg.inv(diagonal)
        panel = a.where((F.col("j") == k) & (F.col("i") > k)).select("i", "m")
        own = right.where(F.col("i") == k)
        steps.append((panel, inverse, own))
        if k + 1 < len(sizes):
            # Another name for what is on both sides of a join.
            a = stored(_update(a.where(F.col("j") > k), panel, panel.select("i", "m"), size, True, inverse), "matrix")
            right = stored(_update(right.where(F.col("i") > k), panel, own.select("j", "m"), size, False, inverse), "right-side")
    found = None
    for k in range(len(sizes) - 1, -1, -1):
        panel, inverse, own = steps[k]
        if found is None:
            row = own
        else:
            # The sum over the rows below is taken within each column block.
            parts = found.join(panel.toDF("i", "_panel"), "i").select("i", "j", "m", "_panel").unionByName(own.select("i", "j", "m", F.lit(None).cast("binary").alias("_panel")))

            row = parts.groupBy("j").applyInPandas(_less(k, sizes), _BLOCK)
        row = stored(_mapped(row, lambda i, j, m, inverse=inverse: inverse @ _read(m, len(inverse))), "solution")
        found = row if found is None else found.unionByName(row)
    inverse_norm = np.sqrt(squares(found.where(F.col("j") == last), False) / PROBES)
    return Solution(found.where(F.col("j") < last), float(norm * inverse_norm))


def to_matrix(blocks: DataFrame, height: int, width: int, block: int) -> np.ndarray:
    """A matrix of which the driver has room."""
    out = np.zeros((height, width))
    rows, columns = spans(height, block), spans(width, block)
    for r in blocks.toLocalIterator():
        (a, b), (c, d) = rows[r["i"]], columns[r["j"]]
        out[a:b, c:d] = _read(r["m"], b - a)
    return out
