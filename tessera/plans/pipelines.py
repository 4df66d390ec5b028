"""The four commands as functions: encode a dataset, encode queries, evaluate, adapt."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import document_text
from tessera.operators.adapt import LinearQueryCalibrator, fit_corpus_alignment, fit_gold_supervised
from tessera.operators.encoders import create_encoder, Encoder, HashEncoder, resolved
from tessera.operators.metrics import compute_metrics
from tessera.operators.search import search
from tessera.sources.beir import Dataset, first_places, load_dataset, load_split
from tessera.sources.files import stored, write_text
from tessera.sources.registry import DEFAULT_PATH, load_model_config
from tessera.sources.store import cache_fingerprint, encode_with_resume, keep_vectors, load_store, order_digest, save_store, with_vectors

BASELINE_CUTOFFS = (5, 10)
DEPTH = 10


#: Appends in which missing vectors are stored, so that an interrupted run keeps most of them.
CHUNKS = 16


def query_rows(dataset: Dataset) -> DataFrame:
    return dataset.queries.select(F.col("query_id").alias("id"), "pos", F.col("query_text").alias("text"))


def document_rows(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("doc_id").alias("id"), "pos", document_text(F.col("title"), F.col("text")).alias("text"))


def evaluate_baseline(dataset: Dataset, queries: DataFrame, documents: DataFrame, search_k: int = 10) -> dict:
    """Metrics of exact search. The depth is at least DEPTH, so search_k from 1 to that changes nothing."""
    if search_k < 1:
        raise ValueError("search_k must be at least 1")
    # The metrics read them more than once.
    rankings = stored(search(queries, documents, max(search_k, DEPTH)), "rankings")
    return compute_metrics(rankings, dataset.qrels, queries.select(F.col("id").alias("query_id")), BASELINE_CUTOFFS)


def evaluate_calibrator(dataset: Dataset, queries: DataFrame, documents: DataFrame, calibrator: LinearQueryCalibrator, search_k: int = 10) -> dict:
    return evaluate_baseline(dataset, calibrator.transform(queries), documents, search_k)


def _manifest(dataset: Dataset, encoder: Encoder, model: str, policy: str, fingerprint: str) -> dict:
    # The keys of manifests and results are read by others.
    return {
        "dataset": dataset.name, "split": dataset.split, "model_id": encoder.model_id, "model_name": model, "revision": encoder.revision, "dimension": encoder.dimension,
        "encoding_config": encoder.encoding_config, "cache_fingerprint": fingerprint, "missing_relevant_policy": policy,
    }


def _encode(spark, name, model, root, split, config, cache_root, download, policy, suffix, encoder, chunks) -> dict:
    encoder = resolved(encoder or create_encoder(load_model_config(model, config)))
    # Hash vectors cost nothing to make again, so they are made where lines are parsed; what a model or a paid service made is kept as it comes.
    light = isinstance(encoder, HashEncoder)

    def encode(texts: DataFrame, kind: str) -> DataFrame:
        return texts.select("id", "pos") if suffix and kind == "document" else with_vectors(texts, encoder.encode, kind)

    dataset = load_dataset(spark, name, root, split, download, policy, once=True, encode=encode if light else None)
    fingerprint = cache_fingerprint(dataset.name, split, encoder)
    folder = f"{cache_root}/{dataset.name}/{model}/{fingerprint}{suffix}"

    def vectors(kind: str) -> DataFrame:
        parts = f"{folder}/parts/{kind}"
        if light:
            rows = dataset.queries.withColumnRenamed("query_id", "id") if kind == "query" else dataset.corpus.withColumnRenamed("doc_id", "id")
            return keep_vectors(spark, rows, parts, encoder.dimension)
        return encode_with_resume(spark, encoder.encode, query_rows(dataset) if kind == "query" else document_rows(dataset.corpus), kind, parts, chunks or CHUNKS, encoder.dimension)

    queries = vectors("query")
    manifest = _manifest(dataset, encoder, model, policy, fingerprint)
    if suffix:
        manifest["cache_kind"] = "query_only"
        documents = queries.limit(0)
    else:
        documents = vectors("document")
    saved = save_store(spark, folder, queries, documents, manifest)
    return {"cache": folder, "queries": saved["n_queries"], "documents": saved["n_documents"], "fingerprint": fingerprint}


def encode_dataset(spark: SparkSession, dataset: str, model: str, dataset_root: str = "datasets", split: str = "test", models_config=DEFAULT_PATH, cache_root: str = "cache", download: bool = False, missing_relevant_policy: str = "error", encoder: Encoder | None = None, chunks: int | None = None) -> dict:
    """Encode both sides of a collection into a store of its own fingerprint."""
    return _encode(spark, dataset, model, dataset_root, split, models_config, cache_root, download, missing_relevant_policy, "", encoder, chunks)


def encode_queries(spark: SparkSession, dataset: str, model: str, dataset_root: str = "datasets", split: str = "train", models_config=DEFAULT_PATH, cache_root: str = "cache", download: bool = False, missing_relevant_policy: str = "error", encoder: Encoder | None = None, chunks: int | None = None) -> dict:
    """Encode a split's queries alone."""
    return _encode(spark, dataset, model, dataset_root, split, models_config, cache_root, download, missing_relevant_policy, "-query-only", encoder, chunks)


def _check_order(dataset: Dataset, queries: DataFrame, documents: DataFrame) -> None:
    for name, ours, stored in (("queries", dataset.queries.withColumnRenamed("query_id", "id"), queries), ("documents", dataset.corpus.withColumnRenamed("doc_id", "id"), documents)):
        if order_digest(ours) != order_digest(stored):
            raise ValueError(f"the store's {name} aren't the dataset's")


def evaluate(spark: SparkSession, cache: str, dataset_root: str = "datasets", search_k: int = 10, results_root: str = "results", missing_relevant_policy: str | None = None) -> dict:
    """Score a store against its dataset and write <results_root>/<dataset>/<model>/baseline.json."""
    if search_k < 1:
        raise ValueError("search_k must be at least 1")
    queries, documents, manifest = load_store(spark, cache)
    policy = missing_relevant_policy or manifest.get("missing_relevant_policy", "error")
    dataset = load_dataset(spark, manifest["dataset"], dataset_root, manifest["split"], missing_relevant_policy=policy, once=True, texts=False)
    _check_order(dataset, queries, documents)
    metrics = evaluate_baseline(dataset, queries, documents, search_k)
    keep = ("dataset", "split", "model_id", "model_name", "revision", "dimension", "cache_fingerprint")
    output = {k: manifest.get(k) for k in keep} | {"cache": cache, "search_k": search_k, "missing_relevant_policy": policy} | metrics
    name = manifest.get("model_name") or manifest["model_id"].replace("/", "__")
    write_text(spark, f"{results_root}/{dataset.name}/{name}/baseline.json", json.dumps(output, sort_keys=True, indent=2))
    return output


def run_adaptation(spark: SparkSession, cache: str, mode: str, dataset_root: str = "datasets", eval_split: str | None = None, train_split: str = "train", model: str | None = None, train_query_cache: str | None = None, models_config=DEFAULT_PATH, adaptation_root: str = "adaptation_results", alpha: float = 1e-2, search_k: int = 10, max_corpus_documents: int | None = None, encoder: Encoder | None = None) -> dict:
    """Fit a map on queries by judgments (gold) or by the corpus (corpus), score with and without it, and write both."""
    if mode not in ("gold", "corpus"):
        raise ValueError("mode must be gold or corpus")
    if search_k < 1:
        raise ValueError("search_k must be at least 1")
    queries, documents, manifest = load_store(spark, cache)
    name, split = manifest["dataset"], eval_split or manifest["split"]
    policy = manifest.get("missing_relevant_policy", "error")
    dataset = load_dataset(spark, name, dataset_root, split, missing_relevant_policy=policy, once=True, texts=mode == "corpus")
    _check_order(dataset, queries, documents)
    folder = f"{adaptation_root}/{name}/{manifest.get('model_name') or 'cache'}/{manifest.get('cache_fingerprint', 'unknown')}"
    if mode == "gold":
        train = load_split(spark, dataset, dataset_root, train_split, policy)
        sources = queries
        if train_query_cache:
            sources, _, other = load_store(spark, train_query_cache)
            for key in ("model_id", "revision", "dimension", "encoding_config"):
                if other.get(key) != manifest.get(key):
                    raise ValueError(f"the training queries' {key} isn't that of the store")
        ids = train.queries.select(F.col("query_id").alias("id"))
        shared = ids.join(sources, "id", "left_semi")
        if shared.isEmpty():
            raise ValueError("no training query has a vector")
        if not shared.join(dataset.queries.select(F.col("query_id").alias("id")), "id", "left_semi").isEmpty():
            warnings.warn("training and evaluation share queries; the gain is no estimate for new ones", stacklevel=2)
        calibrator = fit_gold_supervised(sources, documents, train.qrels, ids, alpha)
        provenance = {"train_split": train_split, "label_source": "qrels_positive_centroid", "train_query_cache": train_query_cache}
    else:
        if encoder is None and not model:
            raise ValueError("corpus mode needs a model")
        encoder = resolved(encoder or create_encoder(load_model_config(model, models_config)))
        if encoder.dimension != manifest["dimension"]:
            raise ValueError("the model's width isn't the store's")
        rows = document_rows(dataset.corpus)
        n = used = rows.count()
        if max_corpus_documents:
            used = max_corpus_documents
            if not 1 <= max_corpus_documents <= n:
                raise ValueError(f"max_corpus_documents must be from 1 to {n}")
            rows = first_places(rows, max_corpus_documents)
        parts = f"{folder}/corpus_query_parts"
        sources = encode_with_resume(spark, encoder.encode, rows, "query", parts, 1 if isinstance(encoder, HashEncoder) else CHUNKS, encoder.dimension, light=isinstance(encoder, HashEncoder))
        calibrator = fit_corpus_alignment(sources, documents, alpha)
        provenance = {"label_source": "same_document_query_protocol_alignment", "corpus_documents_used": used, "query_corpus_embedding_path": parts, "query_model": encoder.model_id, "query_model_revision": encoder.revision}
    baseline = evaluate_baseline(dataset, queries, documents, search_k)
    calibrated = evaluate_calibrator(dataset, queries, documents, calibrator, search_k)
    output = {
        "dataset": name, "eval_split": split, "cache": cache, "cache_fingerprint": manifest.get("cache_fingerprint"), "calibrator": calibrator.method, "alpha": alpha, "search_k": search_k,
        "baseline": baseline, "calibrated": calibrated, "delta": {k: calibrated[k] - baseline[k] for k in calibrated if k != "num_queries"},
    } | provenance
    calibrator.save(spark, f"{folder}/{mode}_calibrator", **output)
    write_text(spark, f"{folder}/{mode}_metrics.json", json.dumps(output, sort_keys=True, indent=2))
    return output
