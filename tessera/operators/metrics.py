"""Ranking metrics: HitRate and Recall at cutoffs, MRR at 10 and graded NDCG at 10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 10
CUTOFFS = (1, 5, 10)


def gain(grade: Column, rank: Column) -> Column:
    """What a document of this grade adds to the DCG at this rank (from 1)."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def positives(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of the judgments above zero."""
    return qrels.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("score").alias("grade")).where("grade > 0")


def ideal_dcg(qrels: DataFrame) -> DataFrame:
    """(query_id, n_relevant, idcg): the DCG of the DEPTH highest grades, whether or not the documents exist."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ranked = positives(qrels).withColumn("rank", rank)
    return ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("rank") <= DEPTH, gain(F.col("grade"), F.col("rank")))).alias("idcg"))


def per_query(rankings: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row per query: query_id, hit_c and recall_c of each cutoff, rr and ndcg.

    queries (query_id) says which count; without it, those with judgments above zero. A query without a hit scores 0. A document that a ranking repeats counts once in recall and each time in the DCG. A query that has no judgment above zero has null metrics.
    """
    judged = ideal_dcg(qrels)
    base = judged if queries is None else queries.select(F.col("query_id").cast("string").alias("query_id")).join(judged, "query_id", "left")
    found = rankings.select("query_id", "doc_id", "rank").join(positives(qrels), ["query_id", "doc_id"])
    hits = found.groupBy("query_id").agg(
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= DEPTH, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        *[F.countDistinct(F.when(F.col("rank") <= c, F.col("doc_id"))).alias(f"found_{c}") for c in cutoffs],
    )
    some = F.col("n_relevant").isNotNull()
    out = base.join(hits, "query_id", "left")
    columns = []
    for c in cutoffs:
        n = F.coalesce(f"found_{c}", F.lit(0))
        columns += [F.when(some, F.when(n > 0, 1.0).otherwise(0.0)).alias(f"hit_{c}"), (n / F.col("n_relevant")).alias(f"recall_{c}")]
    rr = F.when(some, F.when(F.col("first") <= DEPTH, 1.0 / F.col("first")).otherwise(0.0))
    return out.select("query_id", *columns, rr.alias("rr"), F.when(some, F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0))).alias("ndcg"))


def summarise(scored: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row: num_queries, HitRate@c and Recall@c of each cutoff, MRR@10, NDCG@10. Raises where it is read if a query has no judgment above zero."""
    missing = F.assert_true(F.col("rr").isNotNull(), F.concat(F.lit("no positive judgment for query "), "query_id"))
    checked = scored.withColumn("rr", F.when(F.col("rr").isNull(), missing.cast("double")).otherwise(F.col("rr")))
    pairs = [x for c in cutoffs for x in (F.avg(f"hit_{c}").alias(f"HitRate@{c}"), F.avg(f"recall_{c}").alias(f"Recall@{c}"))]
    return checked.agg(F.count(F.lit(1)).alias("num_queries"), *pairs, F.avg("rr").alias(f"MRR@{DEPTH}"), F.avg("ndcg").alias(f"NDCG@{DEPTH}"))


def compute_metrics(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> dict[str, float]:
    """summarise() as a dict. ValueError if there is no query, if one has no judgment above zero, or if a ranking is of no query."""
    ids = queries.select(F.col("query_id").cast("string").alias("query_id"))
    extra = rankings.select("query_id").distinct().join(ids, "query_id", "left_anti").limit(5).collect()
    if extra:
        raise ValueError(f"rankings of unknown queries: {sorted(r[0] for r in extra)}")
    scored = per_query(rankings, qrels, queries, cutoffs).cache()
    try:
        bad = scored.where("rr is null").orderBy("query_id").limit(5).collect()
        if bad:
            raise ValueError(f"queries without a positive judgment: {[r['query_id'] for r in bad]}")
        found = summarise(scored, cutoffs).first().asDict()
    finally:
        scored.unpersist()
    if not found["num_queries"]:
        raise ValueError("there are no queries to score")
    return found


def metric_delta(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """other - baseline of each metric, over one-row tables of summarise()."""
    names = [c for c in baseline.columns if c != "num_queries"]
    stack = lambda df, to: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias(to)) for n in names])).alias("m")).select("m.*")
    return stack(baseline, "baseline").join(stack(other, "calibrated"), "metric").withColumn("delta", F.col("calibrated") - F.col("baseline"))
