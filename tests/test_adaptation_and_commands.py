import json
import os

import numpy as np
import pytest

from test_collections import collection
from tessera.operators import adapt, blocks
from tessera.operators.encoders import HashEncoder
from tessera.plans import cli, pipelines


def vectors(spark, rows, names=None):
    return spark.createDataFrame([(names[i] if names else f"v{i}", i, list(map(float, r))) for i, r in enumerate(rows)], "id string, pos long, embedding array<float>")


def test_corpus_alignment(spark):
    found = adapt.fit_corpus_alignment(vectors(spark, np.eye(3)), vectors(spark, np.roll(np.eye(3), 1, 1)), 1e-6)
    assert found.weights.argmax(1).tolist() == [1, 2, 0] and found.method == "corpus_alignment_ridge"
    assert found.weights == pytest.approx(np.roll(np.eye(3), 1, 1) / (1 + 1e-6), abs=1e-6)


def test_gold_uses_declared_queries_only(spark):
    names = ["q1", "q2", "q3"]
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1, i) for i in (1, 2, 3)] + [("q1", "nowhere", 1, 9)], "query_id string, doc_id string, score int, pos long")
    train = spark.createDataFrame([("q1",), ("q2",)], "id string")
    queries, documents = vectors(spark, np.eye(3), names), vectors(spark, np.eye(3), ["d1", "d2", "d3"])
    found = adapt.fit_gold_supervised(queries, documents, qrels, train, 1e-3)
    assert found.weights[:2].argmax(1).tolist() == [0, 1] and not found.weights[2].any()
    assert found.transform(queries).orderBy("pos").collect()[2]["embedding"] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        adapt.fit_gold_supervised(queries, documents, qrels.where("doc_id = 'nowhere'"))


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    s, t = rng.normal(size=(40, 5)).astype(np.float32), rng.normal(size=(40, 3)).astype(np.float32)
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(s, t)], "source array<float>, target array<float>").repartition(4)
    s, t = s.astype(float), t.astype(float)
    assert adapt.ridge_map(pairs, 0.5) == pytest.approx(np.linalg.solve(s.T @ s + 0.5 * np.eye(5), s.T @ t), abs=1e-5)
    for frame, alpha in ((pairs, -1), (pairs.limit(0), 1)):
        with pytest.raises(ValueError):
            adapt.ridge_map(frame, alpha)
    flat = spark.createDataFrame([([1.0, 1.0], [1.0])], "source array<float>, target array<float>")
    with pytest.warns(UserWarning, match="singular"):
        adapt.ridge_map(flat, 1e-14)


@pytest.mark.parametrize("block", [1, 3, 4, 50])
def test_block_elimination_equals_numpy(spark, block):
    rng = np.random.default_rng(2)
    s, b = rng.normal(size=(30, 10)), rng.normal(size=(10, 7))
    a = s.T @ s + 0.1 * np.eye(10)
    found = blocks.solve(blocks.to_blocks(spark, a, block, lower=True), blocks.to_blocks(spark, b, block), 10, block)
    assert blocks.to_matrix(found.x, 10, 7, block) == pytest.approx(np.linalg.solve(a, b), rel=1e-9, abs=1e-12)
    exact = np.linalg.norm(a) * np.linalg.norm(np.linalg.inv(a))
    assert exact / 3 < found.condition < exact * 3 and found.condition > np.linalg.cond(a) / 3


def test_wide_moments(spark):
    """At width 1536 a task sends its sums in blocks, and the driver gets W alone."""
    rng = np.random.default_rng(3)
    s, t = rng.normal(size=(60, 1536)).astype(np.float32), rng.normal(size=(60, 40)).astype(np.float32)
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(s, t)], "source array<float>, target array<float>").repartition(3)
    found = adapt.moments(pairs, 1536, 40)
    assert found.count() == 6 * 7 // 2 + 6 and "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    s, t = s.astype(float), t.astype(float)
    assert adapt.ridge_map(pairs, 2.0, 512) == pytest.approx(np.linalg.solve(s.T @ s + 2 * np.eye(1536), s.T @ t), abs=1e-5)


def test_calibrator_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    adapt.LinearQueryCalibrator(np.eye(2)).save(spark, path, note=1)
    found = adapt.LinearQueryCalibrator.load(spark, path)
    assert found.method == "ridge" and found.normalize
    assert found.transform(vectors(spark, [[1, 0]])).first()["embedding"] == [1.0, 0.0]
    with pytest.raises(ValueError):
        found.transform(vectors(spark, [[1, 0, 0]]))
    with pytest.raises(ValueError):
        found.save(spark, path, method="x")
    with pytest.raises(ValueError):
        adapt.LinearQueryCalibrator(np.zeros(3))


@pytest.fixture
def toy(tmp_path):
    corpus = [{"_id": f"d{i}", "title": f"t{i}", "text": f"body {i}"} for i in range(12)]
    queries = [{"_id": f"q{i}", "text": f"question {i}"} for i in range(6)]
    collection(tmp_path / "datasets" / "toy", corpus, queries, {"test": [f"q{i}\td{i}\t1" for i in range(3)], "train": [f"q{i}\td{i}\t1" for i in range(3, 6)]})
    return tmp_path


def test_four_commands(spark, toy):
    root = ["--dataset-root", str(toy / "datasets")]
    made = cli.main(["encode-dataset", "--dataset", "toy", "--model", "hash", "--cache-root", str(toy / "cache"), *root], spark)
    assert (made["queries"], made["documents"]) == (3, 12) and made["cache"] == f"{toy}/cache/toy/hash/{made['fingerprint']}"
    train = cli.main(["encode-queries", "--dataset", "toy", "--model", "hash", "--cache-root", str(toy / "cache"), *root], spark)
    assert train["cache"].endswith("-query-only") and train["documents"] == 0
    runs = [cli.main(["evaluate", "--cache", made["cache"], "--search-k", k, "--results-root", str(toy / "results"), *root], spark) for k in ("1", "50")]
    assert json.loads((toy / "results/toy/hash/baseline.json").read_text()) == runs[1]
    runs = [{k: v for k, v in r.items() if "@" in k or k == "num_queries"} for r in runs]
    assert runs[0] == runs[1] and runs[0]["num_queries"] == 3 and len(runs[0]) == 7
    for mode, more in (("gold", ["--train-query-cache", train["cache"]]), ("corpus", ["--model", "hash", "--max-corpus-documents", "5"])):
        out = cli.main(["adapt", "--cache", made["cache"], "--mode", mode, "--adaptation-root", str(toy / "adapted"), *more, *root], spark)
        assert out["baseline"] == runs[0] and set(out["delta"]) == set(runs[0]) - {"num_queries"}
        folder = toy / "adapted/toy/hash" / made["fingerprint"]
        assert json.loads((folder / f"{mode}_metrics.json").read_text())["calibrator"] == out["calibrator"]
        assert adapt.LinearQueryCalibrator.load(spark, str(folder / f"{mode}_calibrator")).method == out["calibrator"]
        assert out["label_source"] == {"gold": "qrels_positive_centroid", "corpus": "same_document_query_protocol_alignment"}[mode]
        assert (out["train_query_cache"] == train["cache"]) if mode == "gold" else (out["corpus_documents_used"], out["query_model"]) == (5, "hash")
    for k in (0, -3):
        with pytest.raises(ValueError, match="search_k"):
            pipelines.evaluate(spark, made["cache"], str(toy / "datasets"), k)
        with pytest.raises(ValueError, match="search_k"):
            pipelines.run_adaptation(spark, made["cache"], "gold", str(toy / "datasets"), search_k=k)
    with pytest.raises(ValueError, match="no training query"):
        pipelines.run_adaptation(spark, made["cache"], "gold", str(toy / "datasets"), train_split="train")
    with pytest.raises(ValueError, match="needs a model"):
        pipelines.run_adaptation(spark, made["cache"], "corpus", str(toy / "datasets"))
    with pytest.raises(ValueError, match="from 1 to 12"):
        pipelines.run_adaptation(spark, made["cache"], "corpus", str(toy / "datasets"), model="hash", max_corpus_documents=13)
    with pytest.raises(ValueError, match="width"):
        pipelines.run_adaptation(spark, made["cache"], "corpus", str(toy / "datasets"), encoder=HashEncoder(8))
    with pytest.warns(UserWarning, match="share queries"):
        pipelines.run_adaptation(spark, made["cache"], "gold", str(toy / "datasets"), train_split="test", adaptation_root=str(toy / "a2"))
    with (toy / "datasets/toy/corpus.jsonl").open("a") as f:
        f.write('\n{"_id": "new", "text": "x"}')
    with pytest.raises(ValueError, match="documents aren't"):
        pipelines.evaluate(spark, made["cache"], str(toy / "datasets"))


def test_identity_changes_nothing(spark, toy):
    made = pipelines.encode_dataset(spark, "toy", "hash", str(toy / "datasets"), cache_root=str(toy / "cache"))
    from tessera.sources.beir import load_dataset
    from tessera.sources.store import load_store

    q, d, _ = load_store(spark, made["cache"])
    data = load_dataset(spark, "toy", str(toy / "datasets"))
    same = adapt.LinearQueryCalibrator(np.eye(64))
    assert pipelines.evaluate_calibrator(data, q, d, same) == pipelines.evaluate_baseline(data, q, d)


def test_keys_from_a_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# keys\nONE_KEY='a b'\nexport TWO_KEY=c # mine\nnot a line\nPATH=/nowhere\n")
    for key in ("ONE_KEY", "TWO_KEY"):
        monkeypatch.setenv(key, "")
        monkeypatch.delenv(key)
    assert cli.load_env(str(tmp_path / ".env")) == {"ONE_KEY": "a b", "TWO_KEY": "c", "PATH": "/nowhere"}
    assert (os.environ["ONE_KEY"], os.environ["TWO_KEY"]) == ("a b", "c") and os.environ["PATH"] != "/nowhere"
    assert cli.load_env(str(tmp_path / "none")) == {}
