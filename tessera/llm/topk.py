"""Exact top-k by inner product, with candidates in the order of their norms.

Equal vectors are one: it keeps its k + 1 smallest rows, which is all that a query can take of it. Distinct vectors are cut into blocks of about block_rows by falling norm. The block with the longest vectors is searched first and gives every query a threshold, its (k + 1)-th best score. Then come rounds of one, two, four and so on further blocks. By Cauchy-Schwarz a query needs no block whose longest vector is too short for it, and is done once that holds for a round's first block; after each round the thresholds rise. Queries meet blocks in cells of about query_rows queries by a block, and only the cells that some query needs are made.

In a cell the vectors are rotated to the eigenvectors of the data's Gram matrix (the SVD's right side). The product of the first `head` coordinates and the norms of what is left bound the score from above; only pairs that reach the threshold, which rises chunk by chunk, are scored exactly. Bounds have room for rounding. Scores are sums of integers: exact in doubles up to 2**52, and in Python's integers beyond. A score that 64 bits can't hold counts, for the order too, as the nearest one that they can.

Vectors take no part if null or if a component is null or not finite. Components that are missing from a shorter vector count as zero, so an empty vector scores 0 with all. Components whose multiple overflows a double count as the largest double. Every row is a candidate but the query's own: rows that repeat an id, or id and vector, are rows of their own, also as queries. Ties go to the smaller id; a row of null id is a candidate after all others. Tables without vectors or without queries give no rows. Ids are integers; other columns don't matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import left_join_groups, staged

_CHUNK = 512
_HITS = "qkey long, vkey long, score long, first long"
_LONG = 1 << 63


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as whole doubles; null if the vector takes no part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    most = sys.float_info.max
    times = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(most)), F.lit(-most))
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: whole(times(x))))


def vector_matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([np.empty(0), *column.to_numpy()]).reshape(-1, width)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The eigenvectors of the Gram matrix, by falling eigenvalue. Each task sends its width x width sums. Vectors too long to square leave it alone: any rotation is right, this one only prunes best."""

    def gram(batches):
        sums = np.zeros((width, width))
        for batch in batches:
            x = vector_matrix(batch["v"], width)
            x = x[(np.abs(x) < 2.0**53).all(1)]
            sums += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "x": sums.ravel()})

    cells = vectors.select("v").mapInPandas(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros((width, width))
    for r in cells:
        sums[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(sums)[1][:, ::-1]


def pair_scores(q: np.ndarray, x: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """The inner products of rows, where exact by Python's integers."""
    with np.errstate(all="ignore"):
        out = np.where(exact, 0.0, np.einsum("ij,ij->i", q, x)).astype(np.int64)
    for i in np.flatnonzero(exact).tolist():
        product = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[i].tolist(), strict=True))
        out[i] = min(max(product, -_LONG), _LONG - 1)
    return out


def best_of_cell(queries: pd.DataFrame, block: pd.DataFrame, basis: np.ndarray, keep: int, head: int) -> pd.DataFrame:
    """The `keep` best candidates of each query: highest scores, ties to the smaller first id. queries: qkey, v, least; block: vkey, v, first."""
    if not len(queries) or not len(block):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("qkey", "vkey", "score", "first")})
    width = len(basis)
    q, x = vector_matrix(queries["v"], width), vector_matrix(block["v"], width)
    first = block["first"].to_numpy()
    least = queries["least"].to_numpy(float).copy()
    hits = np.empty((0, 3), np.int64)  # query, candidate, score
    with np.errstate(all="ignore"):  # products of huge vectors overflow; what isn't surely below a threshold is scored
        norms, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        order = np.argsort(-norms, kind="stable")
        q_rot = q @ basis
        q_head, q_rest = q_rot[:, :head], np.linalg.norm(q_rot[:, head:], axis=1)
        for i in range(0, len(order), _CHUNK):
            part = order[i : i + _CHUNK]
            if (q_norm * norms[part[0]] * (1 + 1e-9) + 1 < least).all():
                break
            x_rot = x[part] @ basis
            longest = np.outer(q_norm, norms[part])
            bound = q_head @ x_rot[:, :head].T + np.outer(q_rest, np.linalg.norm(x_rot[:, head:], axis=1)) + 1e-9 * longest + 1e-3
            huge = ~(longest < 2.0**52)
            # Clamped scores are at most 2**63 - 1, so a bound beyond that says no more.
            a, b = np.nonzero(~(bound < least[:, None]) | huge)
            if len(a) > bound.size // 8 and not huge.any():
                scores = (q @ x[part].T)[a, b].astype(np.int64)
            else:
                scores = pair_scores(q[a], x[part[b]], huge[a, b])
            reach = scores >= least[a]
            hits = np.vstack([hits, np.column_stack([a[reach], part[b[reach]], scores[reach]])])
            # Scores of one query, falling, then by first id. ~score falls where score rises, and never overflows.
            hits = hits[np.lexsort([first[hits[:, 1]], ~hits[:, 2], hits[:, 0]])]
            place = np.arange(len(hits)) - np.searchsorted(hits[:, 0], hits[:, 0])
            hits, place = hits[place < keep], place[place < keep]
            last = hits[place == keep - 1]
            least[last[:, 0]] = np.maximum(least[last[:, 0]], last[:, 2])
    return pd.DataFrame({"qkey": queries["qkey"].to_numpy()[hits[:, 0]], "vkey": block["vkey"].to_numpy()[hits[:, 1]], "score": hits[:, 2], "first": first[hits[:, 1]]})


def _blocks(distinct: DataFrame, count: int) -> DataFrame:
    """distinct with vkey, unique, and block: from 0 on by falling norm, `count` of them, however many partitions Spark makes of them."""
    dealt = distinct.repartitionByRange(count, F.desc("norm"), F.xxhash64("v")).withColumn("_part", F.spark_partition_id()).withColumn("vkey", F.monotonically_increasing_id())
    dealt = staged(dealt, "vector-parts")
    parts = (dealt.agg(F.max("_part")).first()[0] or 0) + 1
    return dealt.withColumn("block", F.expr(f"_part * {count} div {max(parts, count)}").cast("int")).drop("_part")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block_rows: int = 8192, query_rows: int = 4096, head: int = 16) -> DataFrame:
    """Of each row that is_query: its k highest scores among all other rows, ties to the smaller id: query_id, rank (from 1), vec_id, score."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("_query"), F.monotonically_increasing_id().alias("_uid"))
    rows = staged(rows.where("v is not null"), "scaled-vectors")
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    # The smallest rows of a vector: by id, null last.
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_uid").alias("uid"))
    smallest = rows.select("v", own.alias("_row")).withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("_row"))).where(F.col("_n") <= k + 1)
    firsts = smallest.groupBy("v").agg(F.sort_array(F.collect_list("_row")).alias("own"))
    sizes = rows.groupBy("v").agg(F.count(F.lit(1)).alias("_size"), F.max("_query").alias("_asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    first = F.coalesce(F.get("own", F.lit(0))["id"], F.lit(_LONG - 1))
    distinct = staged(firsts.join(sizes, "v").withColumn("norm", norm).withColumn("first", first), "distinct-vectors")
    distinct = _blocks(distinct, max(1, -(-distinct.count() // block_rows)))
    basis = rotation(distinct, width)
    longest = staged(distinct.groupBy("block").agg(F.max("norm").alias("longest")), "blocks")

    asked = distinct.where("_asks").select(F.col("vkey").alias("qkey"), "v", "norm")
    groups = max(1, -(-asked.count() // query_rows))
    asked = staged(asked.withColumn("group", F.pmod(F.xxhash64("qkey"), F.lit(groups))).withColumn("least", F.lit(float("-inf"))), "queries")
    candidates = distinct.select("vkey", "v", "first", "block")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_of_cell(left, right, basis, k + 1, head)

    def search(pairs: DataFrame) -> DataFrame:
        """The hits of queries in the blocks that they are paired with."""
        left = staged(pairs.select("qkey", "v", "least", "group", "block"), "query-blocks")
        cells = staged(left.select("group", "block").distinct(), "cells")
        among = candidates.join(cells, "block")
        return left.groupBy("group", "block").cogroup(among.groupBy("group", "block")).applyInPandas(cell, _HITS)

    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "first")
    reaches = ~(F.col("norm") * F.col("longest") * (1 + 1e-9) + 1 < F.col("least"))
    hits = asked.sparkSession.createDataFrame([], _HITS)
    start, stop, n_blocks = 0, 1, (longest.agg(F.max("block")).first()[0] or 0) + 1
    while start < n_blocks:
        stop = min(stop, n_blocks)
        if start:  # norms fall: who doesn't need the first of these blocks needs none from here on
            bound = longest.where(F.col("block") == start).first()["longest"]
            asked = asked.withColumn("longest", F.lit(bound)).where(reaches).drop("longest")
        if asked.isEmpty():
            break
        pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(start), F.lit(stop - 1)))).join(longest, "block").where(reaches)
        hits = hits.unionByName(search(pairs)).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
        hits = staged(hits, "hits")
        least = hits.groupBy("qkey").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).cast("double").alias("least"))
        asked = asked.drop("least").join(least, "qkey", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        asked = staged(asked, "queries")
        start, stop = stop, 2 * stop

    of_hit = F.transform("own", lambda r: F.struct(F.expr("~score").alias("less"), r["none"].alias("none"), r["id"].alias("id"), r["uid"].alias("uid"), F.col("score").alias("score")))
    ordered = F.slice(F.array_sort(F.flatten(F.collect_list(of_hit))), 1, k + 1)
    results = hits.join(distinct.select("vkey", "own"), "vkey").groupBy("qkey").agg(ordered.alias("_best"))
    results = staged(results.join(distinct.select(F.col("vkey").alias("qkey"), "v", "_size"), "qkey").select("v", "_size", "_best"), "results")
    found = left_join_groups(rows.where("_query").select("_id", "_uid", "v"), results, "v", "_size", rows.count())
    others = F.slice(F.filter("_best", lambda b: b["uid"] != F.col("_uid")), 1, k)
    found = found.select(F.col("_id").alias("query_id"), F.posexplode(others).alias("pos", "hit"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
