import tempfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.operators.search import search


def frames(spark, queries, documents):
    q = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(queries)], "id string, embedding array<float>")
    d = spark.createDataFrame([(f"d{i}", i, v) for i, v in enumerate(documents)], "id string, pos long, embedding array<float>")
    return q, d.repartition(3)


def brute(queries, documents, k):
    out = []
    for i, q in enumerate(queries):
        score = np.array([np.float32(np.dot(np.float64(q), np.float64(d))) for d in np.float32(documents)])
        order = np.lexsort([np.arange(len(score)), np.where(np.isnan(score), np.inf, -score), np.isnan(score)])[:k]
        out += [(f"q{i}", n + 1, f"d{j}") for n, j in enumerate(order)]
    return sorted(out)


def ranked(hits):
    return sorted((r["query_id"], r["rank"], r["doc_id"]) for r in hits.collect())


@pytest.mark.parametrize("pilot", [0, 2])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_search_equals_brute_force(spark, broadcast_bytes, pilot):
    rng = np.random.default_rng(0)
    documents = rng.integers(-2, 3, (60, 4)).astype(float).tolist()  # many ties
    documents[7] = [float("nan")] * 4
    queries = rng.integers(-2, 3, (9, 4)).astype(float).tolist()
    for k in (1, 5, 100):
        hits = search(*frames(spark, queries, documents), k, broadcast_bytes=broadcast_bytes, query_rows=4, pilot=pilot)
        assert ranked(hits) == brute(queries, documents, k)


def test_documents_stay_where_they_are(spark):
    q, d = frames(spark, [[1.0, 0.0]] * 9, [[1.0, float(i)] for i in range(40)])
    plan = search(q, d.coalesce(2), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Generate", "CoGroup")) and plan.count("MapInPandas") == 1
    d.coalesce(2).write.mode("overwrite").parquet(path := tempfile.mkdtemp() + "/d")
    below = search(q, spark.read.parquet(path), 3)._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[-1]
    assert "Exchange" not in below


def test_search_limits(spark):
    q, d = frames(spark, [[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]])
    with pytest.raises(ValueError):
        search(q, d, 0)
    assert search(q, d.limit(0), 3).collect() == []
    assert search(q.limit(0), d, 3).collect() == []
    with pytest.raises(ValueError):
        search(q, frames(spark, [], [[1.0, 0.0, 0.0]])[1], 3)
    assert [r["doc_id"] for r in search(q, d, 2).orderBy("rank").collect()] == ["d0", "d1"]


QRELS = "query_id string, doc_id string, score int, pos long"


def ranking(spark, ids, query="q"):
    return spark.createDataFrame([(query, n + 1, d) for n, d in enumerate(ids)], "query_id string, rank int, doc_id string")


def test_graded_metrics(spark):
    qrels = spark.createDataFrame([("q", "d1", 2, 0), ("q", "d2", 1, 1), ("q", "d4", 1, 2), ("q", "d5", 0, 3)], QRELS)
    r = metrics.per_query(ranking(spark, ["d3", "d1", "d9", "d2"]), qrels).first()
    assert (r["hit_1"], r["hit_5"], r["recall_1"], r["rr"]) == (0.0, 1.0, 0.0, 0.5)
    assert r["recall_5"] == r["recall_10"] == pytest.approx(2 / 3)
    assert r["ndcg"] == pytest.approx(0.562456, abs=1e-6)


def test_first_hit_beyond_ten(spark):
    qrels = spark.createDataFrame([("q", "x", 1, 0)], QRELS)
    r = metrics.per_query(ranking(spark, [*map(str, range(10)), "x"]), qrels).first()
    assert r["rr"] == 0.0 and r["hit_10"] == 0.0


def test_repeat_counts_once_in_recall_and_twice_in_dcg(spark):
    qrels = spark.createDataFrame([("q", "x", 1, 0), ("q", "y", 1, 1)], QRELS)
    r = metrics.per_query(ranking(spark, ["x", "x"]), qrels).first()
    assert r["recall_5"] == 0.5 and r["ndcg"] == pytest.approx(1.0)


def test_query_without_hits_scores_zero(spark):
    qrels = spark.createDataFrame([("q", "x", 1, 0), ("p", "x", 1, 1)], QRELS)
    queries = spark.createDataFrame([("q",), ("p",)], "query_id string")
    found = metrics.compute_metrics(ranking(spark, ["x"]), qrels, queries)
    assert found["num_queries"] == 2 and found["MRR@10"] == 0.5
    assert list(found)[:3] == ["num_queries", "HitRate@1", "Recall@1"] and list(found)[-2:] == ["MRR@10", "NDCG@10"]


def test_what_raises(spark):
    qrels = spark.createDataFrame([("q", "x", 0, 0)], QRELS)
    queries = spark.createDataFrame([("q",)], "query_id string")
    with pytest.raises(ValueError, match="positive"):
        metrics.compute_metrics(ranking(spark, ["x"]), qrels, queries)
    with pytest.raises(ValueError, match="no queries"):
        metrics.compute_metrics(ranking(spark, ["x"]).limit(0), qrels, queries.limit(0))
    with pytest.raises(ValueError, match="unknown"):
        metrics.compute_metrics(ranking(spark, ["x"], "other"), qrels, queries)
    with pytest.raises(Exception, match="no positive judgment"):
        metrics.summarise(metrics.per_query(ranking(spark, ["x"]), qrels, queries)).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=12), st.integers(1, 15))
def test_ranks_and_scores(spark, documents, k):
    documents = [[float(x) for x in d] for d in documents]
    rows = search(*frames(spark, [[1.0, -1.0, 2.0]], documents), k).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, min(k, len(documents)) + 1))
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_delta(spark):
    one = spark.createDataFrame([(1, 0.25, 0.5)], "num_queries long, `MRR@10` double, `NDCG@10` double")
    two = one.select("num_queries", (F.col("`MRR@10`") * 2).alias("MRR@10"), "`NDCG@10`")
    assert {r["metric"]: r["delta"] for r in metrics.metric_delta(one, two).collect()} == {"MRR@10": 0.25, "NDCG@10": 0.0}


def test_tiles_count_what_tasks_hold(spark, monkeypatch):
    from tessera.operators import search as module

    rows = spark.range(0, 200, 1, 4).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97)).cast("float") for i in range(4)]).alias("embedding"))
    queries, names = rows.where("pos < 40"), []
    whole = sorted(module.search(queries, rows, 30).collect())
    monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or df)
    # 80 KB hold the vectors of all queries, but not the documents found.
    assert sorted(module.search(queries, rows, 30, broadcast_bytes=80_000).collect()) == whole and len(whole) == 1200
    assert 1 < names.count("hits") <= 4


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("narrow", [False, True])
def test_bounds_leave_few_pairs_and_lose_none(monkeypatch, narrow, odd):
    from tessera.operators import search as module

    rng = np.random.default_rng(5)
    make = lambda n: np.repeat(rng.integers(-99, 100, (n, 4)), 8, axis=1) / 64 if narrow else rng.integers(-99, 100, (n, 32)) / 64
    documents, queries = make(6000), make(300)
    documents[50:90] = documents[10]  # ties, and copies
    if odd:
        documents[100], documents[101], documents[102] = np.nan, np.inf, 0
        documents[200:203] *= 1e4
        documents[203] *= 1e30
        queries[7], queries[8], queries[9] = 0, np.nan, 1e30
    monkeypatch.setattr(module, "QUERY_TILE", 256)
    pairs, dense = [], module._Best._all
    monkeypatch.setattr(module._Best, "_all", lambda self, tile, x: pairs.append(len(x) * len(tile.ids)) or dense(self, tile, x))
    axes = module.spanned(queries)
    assert (axes is not None and axes.shape == (32, 4)) if narrow else axes is None
    best = module._Best(np.array([f"q{i}" for i in range(300)], object), queries.copy(), 10, np.full(300, -np.inf), axes)
    for i in range(0, 6000, 2500):
        part = documents[i : i + 2500].astype(np.float32)
        best.add(pd.DataFrame({"id": [f"d{j}" for j in range(i, i + len(part))], "pos": range(i, i + len(part)), "embedding": list(part)}))
    found = pd.concat(list(best.rows()))
    found["rank"] = found.groupby("query_id").cumcount() + 1
    with np.errstate(all="ignore"):
        assert sorted(zip(found["query_id"], found["rank"], found["doc_id"])) == brute(queries, documents, 10)
    # A tile with a query that has no bounds is scored whole, as are documents without them.
    assert sum(pairs) <= (300 * 8 + 300 % 256 * 6000 if odd else 0)


def test_the_search_runs_once_for_all_metrics(spark, monkeypatch):
    from tessera.plans import pipelines
    from tessera.sources.beir import Dataset

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    monkeypatch.setattr(pipelines, "search", lambda *_: ranking(spark, ["x", "y"]).mapInPandas(counted, "query_id string, rank int, doc_id string"))
    qrels = spark.createDataFrame([("q", "y", 1, 0)], QRELS)
    found = pipelines.evaluate_baseline(Dataset("d", None, None, qrels), spark.createDataFrame([("q",)], "id string"), None)
    assert found["MRR@10"] == 0.5 and runs.value == 2
