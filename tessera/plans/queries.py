"""The queries of the retrieval operators over the driver's tables, and the same in DuckDB's SQL.

Protocol V: queries are the vectors whose id is divisible by 20, documents all vectors; relevant to a query are the vectors of its label with ids at most 50 away, but itself, of grade 2 if the ids differ by an even number and else 1.
Protocol T: queries are the documents whose id is divisible by 20, documents all documents, both encoded by digests of their whole texts.
Protocol F: as T, but written to files as a collection and read back.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import inner_product, l2_normalize, norm
from tessera.operators import adapt, metrics
from tessera.operators.encoders import HashEncoder, create_encoder, hash_words
from tessera.operators.search import search
from tessera.plans import pipelines
from tessera.sources import beir, store
from tessera.sources.files import read_text, shared_folder

WIDTH = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Protocol V: queries, documents, qrels."""
    rows = _table(spark, sf_dir, "embeddings")
    documents = rows.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("pos"), "embedding")
    asked = rows.where("vec_id % 20 = 0")
    near = asked.select(F.col("vec_id").alias("q"), "label", F.explode(F.sequence(F.col("vec_id") - 50, F.col("vec_id") + 50)).alias("d")).where("q <> d")
    same = near.join(rows.select(F.col("vec_id").alias("d"), "label"), ["d", "label"])
    grade = F.when(F.abs(F.col("q") - F.col("d")) % 2 == 0, 2).otherwise(1)
    qrels = same.select(F.col("q").cast("string").alias("query_id"), F.col("d").cast("string").alias("doc_id"), grade.alias("score"), F.col("d").alias("pos"))
    return documents.where("pos % 20 = 0"), documents, qrels


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def corpus_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.document_text(F.col("lang"), F.col("text")).alias("document_text"))


def dedupe_first_pos_last_value(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "role", "text", F.col("turn").alias("pos"))
    return beir.last_value_first_place(rows, ["conv_id"]).select("conv_id", "role", "text", "pos")


def _label_lines(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    line = F.concat_ws("\t", (F.col("doc_id") - F.col("doc_id") % 20).cast("string"), F.col("doc_id").cast("string"), F.col("quality").cast("string"))
    short = labels.select(F.col("doc_id").cast("string").alias("value"), (F.col("doc_id") + 10_000_000_000).alias("pos"))
    return labels.select(F.when(F.col("doc_id") % 2 == 0, F.concat(line, F.lit("\tmore"))).otherwise(line).alias("value"), F.col("doc_id").alias("pos")).unionByName(short)


def qrels_parse(spark, sf_dir):
    return beir.parse_qrels(_label_lines(spark, sf_dir))


def _dataset(spark, sf_dir) -> beir.Dataset:
    documents = _table(spark, sf_dir, "documents")
    queries = documents.where("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query_text"), F.col("doc_id").alias("pos"))
    corpus = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("title"), "text", F.col("doc_id").alias("pos"))
    qrels = beir.parse_qrels(_label_lines(spark, sf_dir))
    return beir.Dataset("labelled", beir.assemble(queries, qrels), corpus, qrels)


def dataset_assemble(spark, sf_dir):
    return _dataset(spark, sf_dir).samples().select("query_id", "query_text", F.array_join("relevant_doc_ids", ",").alias("relevant"), "pos")


def validate_missing(spark, sf_dir):
    whole = _dataset(spark, sf_dir)
    kept = whole.queries.where("pos % 40 <> 0")
    return beir.Dataset("cut", kept.unionByName(kept.where("pos % 100 = 20")), whole.corpus.where("title <> 'fr'"), whole.qrels).problems()


def sanitize_template_e5(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 0, F.lit(" \t\n")).otherwise(F.col("text"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", tx.sanitize(text).alias("text"))
    return rows.select("doc_id", tx.template("e5", F.col("text"), "query").alias("as_query"), tx.template("e5", F.col("text"), "document").alias("as_document"))


def sanitize_template_qwen3(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 0, F.lit(" \t\n")).otherwise(F.col("text"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", tx.sanitize(text).alias("text"))
    return rows.select("doc_id", tx.template("qwen3", F.col("text"), "query", "find it").alias("as_query"), tx.template("qwen3", F.col("text"), "document").alias("as_document"))


def hash_words_query(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", hash_words(F.coalesce("text", F.lit("")), "document").alias("w"))
    return rows.select("doc_id", *[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(8)])


def hash_encode(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    out = HashEncoder(WIDTH).encode(rows, "document")
    return out.select(F.col("pos").alias("doc_id"), *[F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"x{i}") for i in range(WIDTH)])


def l2_normalize_query(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * (F.col("vec_id") % 7)).cast("float")).alias("v"))
    unit = rows.select("vec_id", l2_normalize(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(norm(F.col("u")), 4).alias("norm"), *[F.round(F.get("u", F.lit(i)).cast("double"), 5).alias(f"x{i}") for i in range(WIDTH)])


def inner_product_query(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(inner_product(F.col("embedding"), F.col("other")), 6).alias("product"))


def topk_exact(spark, sf_dir):
    queries, documents, _ = _vectors(spark, sf_dir)
    return _ranked(search(queries, documents, 10))


def topk_text_ties(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    encoder = HashEncoder(WIDTH)
    return _ranked(search(encoder.encode(documents.where("pos % 20 = 0"), "query"), encoder.encode(documents, "document"), 10)).drop("score")


def topk_k_exceeds_n(spark, sf_dir):
    queries, documents, _ = _vectors(spark, sf_dir)
    few = _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return _ranked(search(queries, few.select(F.col("label").cast("string").alias("id"), F.col("label").alias("pos"), "embedding"), 50))


def topk_nan_last(spark, sf_dir):
    """Of 50 documents one is as it is, two are zeros of either sign, and the rest hold a NaN."""
    queries, documents, _ = _vectors(spark, sf_dir)
    kind = F.col("pos") % 50
    zero = F.when(kind == 2, -0.0).otherwise(0.0).cast("float")
    spoilt = F.transform("embedding", lambda x, i: F.when(kind == 1, x).when(kind.isin(2, 3), zero).when(i == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    hits = search(queries, documents.withColumn("embedding", spoilt), 50)
    return _ranked(hits).withColumn("score", F.when(~F.isnan("score"), F.col("score") + 0.0))


def doc_prefix_limit(spark, sf_dir):
    """The limit is what this query shows: the corpus's first 100 documents."""
    return _table(spark, sf_dir, "documents").orderBy("doc_id").limit(100).select("doc_id", "lang")


def _scored(spark, sf_dir, dropped: str | None = None):
    queries, documents, qrels = _vectors(spark, sf_dir)
    hits = search(queries, documents.where(f"not ({dropped})") if dropped else documents, 10)
    judged = queries.select(F.col("id").alias("query_id")).join(qrels, "query_id", "left_semi")
    return metrics.per_query(hits, qrels, judged, (5, 10))


def _rounded(df: DataFrame) -> DataFrame:
    rename = {"HitRate@5": "hit_5", "Recall@5": "recall_5", "HitRate@10": "hit_10", "Recall@10": "recall_10", "MRR@10": "mrr", "NDCG@10": "ndcg"}
    out = df.withColumnsRenamed(rename)
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in out.dtypes])


def metrics_per_query(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir))


def metrics_baseline(spark, sf_dir):
    return _rounded(metrics.summarise(_scored(spark, sf_dir), (5, 10)))


def metrics_missing_relevant(spark, sf_dir):
    return _rounded(metrics.summarise(_scored(spark, sf_dir, "pos % 3 = 0"), (5, 10)))


def ideal_dcg(spark, sf_dir):
    _, _, qrels = _vectors(spark, sf_dir)
    return _rounded(metrics.ideal_dcg(qrels))


def search_k_invariance(spark, sf_dir):
    """The metrics at a search depth below and above the one that they need."""
    queries, documents, qrels = _vectors(spark, sf_dir)
    judged = queries.join(qrels.select(F.col("query_id").alias("id")), "id", "left_semi")
    whole = beir.Dataset("vectors", judged, documents, qrels)
    found = [(k, m, round(float(v), 6)) for k in (3, 25) for m, v in pipelines.evaluate_baseline(whole, judged, documents, k).items()]
    return spark.createDataFrame(found, "search_k int, metric string, value double")


def _pairs(spark, sf_dir, width: int = WIDTH):
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, width).alias("source"), F.slice(F.reverse("embedding"), 1, width).alias("target"))


def ridge_gram(spark, sf_dir):
    found = adapt.moments(_pairs(spark, sf_dir), WIDTH, WIDTH, 24)
    return adapt.cells(found, WIDTH, WIDTH, 24).where("kind = 'gram'").select("i", "j", F.round("value", 5).alias("value"))


def ridge_cross(spark, sf_dir):
    return adapt.cells(adapt.moments(_pairs(spark, sf_dir), WIDTH, WIDTH), WIDTH, WIDTH).where("kind = 'cross'").select("i", "j", F.round("value", 5).alias("value"))


def _with_strangers(qrels: DataFrame) -> DataFrame:
    """Each query is judged to need a document that isn't there, too."""
    return qrels.unionByName(qrels.select("query_id", F.lit("nowhere").alias("doc_id"), F.lit(2).alias("score"), F.lit(-1).cast("long").alias("pos")).distinct())


def gold_centroid(spark, sf_dir):
    queries, documents, qrels = _vectors(spark, sf_dir)
    pairs = adapt.gold_pairs(documents, documents, _with_strangers(qrels), queries.select("id"))
    return pairs.select("id", F.posexplode("target").alias("i", "x")).select("id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def _weights(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(x), 4)) for (i, j), x in np.ndenumerate(w)], "i int, j int, w double")


def ridge_fit(spark, sf_dir):
    return _weights(spark, adapt.ridge_map(_pairs(spark, sf_dir), 0.01))


def ridge_fit_blocks(spark, sf_dir):
    """The same fit where the system doesn't fit in a block: 5 x 5 blocks, by elimination over them."""
    return _weights(spark, adapt.ridge_map(_pairs(spark, sf_dir), 0.01, 13))


def fit_corpus_alignment(spark, sf_dir):
    _, documents, _ = _vectors(spark, sf_dir)
    return _weights(spark, adapt.fit_corpus_alignment(documents.where("pos % 3 <> 0"), documents.withColumn("embedding", F.reverse("embedding"))).weights)


def fit_gold_supervised(spark, sf_dir):
    queries, documents, qrels = _vectors(spark, sf_dir)
    return _weights(spark, adapt.fit_gold_supervised(documents, documents, _with_strangers(qrels), queries.select("id")).weights)


def _turn(normalize: bool) -> adapt.LinearQueryCalibrator:
    """Reverses a vector and weighs its components from 1 up."""
    w = np.zeros((WIDTH, WIDTH), np.float32)
    w[np.arange(WIDTH)[::-1], np.arange(WIDTH)] = 1 + np.arange(WIDTH) / WIDTH
    return adapt.LinearQueryCalibrator(w, normalize)


def calibrate_transform(spark, sf_dir):
    queries, _, _ = _vectors(spark, sf_dir)
    out = _turn(True).transform(queries)
    return out.select("id", F.posexplode("embedding").alias("i", "x")).select("id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def calibrated_metrics_delta(spark, sf_dir):
    queries, documents, qrels = _vectors(spark, sf_dir)
    judged = queries.select(F.col("id").alias("query_id")).join(qrels, "query_id", "left_semi")
    # Both systems in one search, so the documents are read once.
    both = queries.withColumn("id", F.concat(F.lit("0:"), "id")).unionByName(_turn(True).transform(queries).withColumn("id", F.concat(F.lit("1:"), "id")))
    hits = search(both, documents, 10).withColumn("system", F.substring("query_id", 1, 1)).withColumn("query_id", F.expr("substring(query_id, 3)"))
    rows = [metrics.summarise(metrics.per_query(hits.where(F.col("system") == s), qrels, judged, (5, 10)), (5, 10)) for s in "01"]
    return metrics.metric_delta(*rows).select("metric", F.round("delta", 6).alias("delta"))


def resume_missing(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text")
    stored = store.with_key(documents.where("pos % 2 = 0")).select("text_key").distinct()
    return store.missing_texts(documents, stored).select("text_key", F.length("text").cast("long").alias("n_chars"))


def order_consistency(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    moved = rows.select("pos", F.when(F.col("pos") % 9 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id")).where("pos % 11 <> 0")
    return store.order_mismatches(rows, moved)


def _sources(spark, sf_dir) -> list[str]:
    return [r[0] for r in _table(spark, sf_dir, "documents").where("source is not null").select("source").distinct().collect()]


def cache_fingerprint(spark, sf_dir):
    """The store's name for each source as a dataset of its own."""
    found = [(x, s, store.cache_fingerprint(x, s, HashEncoder())) for x in _sources(spark, sf_dir) for s in ("test", "train")]
    return spark.createDataFrame(found, "source string, split string, fingerprint string")


def adapter_detect(spark, sf_dir):
    """The adapters of models that are named after each source."""
    names = [f"{kind}-{x}" for x in _sources(spark, sf_dir) for kind in ("intfloat/E5", "Qwen/Qwen3-Embedding", "thenlper/GTE", "other/model")]
    return spark.createDataFrame([(n, tx.adapter_of(n)) for n in names], "model string, adapter string")


def _collection(spark: SparkSession, sf_dir: str, qrels: DataFrame, train: DataFrame | None = None) -> str:
    """Write protocol F's files, with qrels (value, pos), and those of a split to train on, below a header -> the root folder; the collection's name is "written".

    Ids are under either key, every tenth document is there twice, every seventh has a null title, and there are blank lines.
    """
    root = f"{shared_folder(spark)}/tessera-collections/{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("title"), "text")
    name, even = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0
    ids = [F.when(even, name).alias("_id"), F.when(~even, name).alias("id")]

    def write(parts: list[DataFrame], path: str) -> None:
        lines = [p.select(F.lit(n).alias("part"), p.columns[0], "value") for n, p in enumerate(parts)]
        whole = lines[0]
        for more in lines[1:]:
            whole = whole.union(more)
        whole.orderBy(*whole.columns[:2]).select("value").write.text(f"{root}/written/{path}")

    # All documents, then blank lines, then some documents again, by one reading of the table.
    parts = F.filter(F.array(F.lit(0), F.when(F.col("doc_id") % 5 == 0, 1), F.when(F.col("doc_id") % 10 == 0, 2)), lambda p: p.isNotNull())
    lines = rows.select(F.explode(parts).alias("part"), "*").withColumn("text", F.when(F.col("part") != 1, F.col("text"))).orderBy("part", "doc_id")
    title = F.when(F.col("part") == 2, "again").otherwise(F.col("title")).alias("title")
    lines.select(F.when(F.col("part") == 1, " ").otherwise(F.to_json(F.struct(*ids, title, "text"))).alias("value")).write.text(f"{root}/written/corpus.jsonl")
    asked = rows.where("doc_id % 20 = 0")
    under = [F.when(F.col("doc_id") % 40 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 40 != 0, F.col("text")).alias("query")]
    write([asked.select("doc_id", F.to_json(F.struct(*ids, *under)).alias("value"))], "queries.jsonl")
    header = spark.createDataFrame([(0, "query-id\tcorpus-id\tscore")], "pos long, value string")
    for split, judged in (("test", qrels), ("train", train)):
        if judged is not None:
            write([header, judged.select("pos", "value")], f"qrels/{split}.tsv")
    return root


def collection_corpus(spark, sf_dir):
    return beir.load_corpus(spark, "written", _collection(spark, sf_dir, _label_lines(spark, sf_dir)))


def collection_dataset(spark, sf_dir):
    found = beir.load_dataset(spark, "Written", _collection(spark, sf_dir, _label_lines(spark, sf_dir)))
    return found.samples().select("query_id", "query_text", F.array_join("relevant_doc_ids", ",").alias("relevant"), "pos")


def encode_and_evaluate(spark, sf_dir):
    """The commands encode-dataset and evaluate, over the positive judgments."""
    root = _collection(spark, sf_dir, _label_lines(spark, sf_dir).where("get(split(value, '\t'), 2) > 0"))
    made = pipelines.encode_dataset(spark, "written", "hash", root, cache_root=f"{root}/cache")
    pipelines.evaluate(spark, made["cache"], root, results_root=f"{root}/results")
    found = json.loads(read_text(spark, f"{root}/results/written/hash/baseline.json"))
    rows = [(m, round(float(v), 6)) for m, v in found.items() if "@" in m or m == "num_queries"]
    return spark.createDataFrame(rows, "metric string, value double")


def _splits(spark, sf_dir) -> str:
    """A collection whose positive judgments are to train on, and those of every other query to test."""
    positive = _label_lines(spark, sf_dir).where("get(split(value, '\t'), 2) > 0")
    return _collection(spark, sf_dir, positive.where("get(split(value, '\t'), 0) % 40 = 0"), positive)


def encode_queries_command(spark, sf_dir):
    """The command encode-queries over the training split: the store's queries, and how many documents it has."""
    root = _splits(spark, sf_dir)
    made = pipelines.encode_queries(spark, "written", "hash", root, "train", cache_root=f"{root}/cache")
    queries, documents, manifest = store.load_store(spark, made["cache"])
    told = [F.lit(manifest["cache_kind"]).alias("kind"), F.lit(documents.count()).cast("long").alias("n_documents")]
    return queries.select(F.col("id").cast("long").alias("doc_id"), *told, *[F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"x{i}") for i in range(WIDTH)])


def _adapted(spark, sf_dir, mode: str, *told: str, **options) -> DataFrame:
    """The commands encode-dataset and adapt: the map as it was written, and what the written metrics say of it."""
    root = _splits(spark, sf_dir)
    made = pipelines.encode_dataset(spark, "written", "hash", root, cache_root=f"{root}/cache")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the splits share queries
        pipelines.run_adaptation(spark, made["cache"], mode, root, adaptation_root=f"{root}/adapted", **options)
    folder = f"{root}/adapted/written/hash/{made['fingerprint']}"
    found = json.loads(read_text(spark, f"{folder}/{mode}_metrics.json"))
    return _weights(spark, adapt.LinearQueryCalibrator.load(spark, f"{folder}/{mode}_calibrator").weights).select("*", *[F.lit(found[k]).alias(k) for k in told])


def adapt_gold_command(spark, sf_dir):
    """A map by judgments: of the training queries, those that the store has vectors of."""
    return _adapted(spark, sf_dir, "gold", "label_source", "eval_split")


def adapt_corpus_command(spark, sf_dir):
    """A map by the first half of the corpus, in the order of its file."""
    half = _table(spark, sf_dir, "documents").count() // 2
    return _adapted(spark, sf_dir, "corpus", "label_source", "corpus_documents_used", model="hash", max_corpus_documents=half).withColumn("corpus_documents_used", F.col("corpus_documents_used").cast("long"))


def stores_joined(spark, sf_dir):
    """A map from one store's vectors to another's, dealt by id into the same buckets: the products of what belongs together."""
    _, documents, _ = _vectors(spark, sf_dir)
    folder = f"{shared_folder(spark)}/tessera-stores/{uuid.uuid4().hex}"
    store.save_store(spark, folder, documents.where("pos % 3 <> 0"), documents.withColumn("embedding", F.reverse("embedding")), {"dimension": WIDTH})
    some, turned, _ = store.load_store(spark, folder)
    both = some.join(turned.select("id", F.col("embedding").alias("other")), "id")
    return both.select(F.col("pos").alias("vec_id"), F.round(inner_product(F.col("embedding"), F.col("other")), 5).alias("product"))


def store_round_trip(spark, sf_dir):
    queries, documents, _ = _vectors(spark, sf_dir)
    folder = f"{shared_folder(spark)}/tessera-stores/{uuid.uuid4().hex}"
    store.save_store(spark, folder, queries, documents, {"dimension": WIDTH})
    queries, documents, manifest = store.load_store(spark, folder)
    both = queries.withColumn("side", F.lit("query")).unionByName(documents.withColumn("side", F.lit("document")))
    number = F.when(F.col("side") == "query", manifest["n_queries"]).otherwise(manifest["n_documents"])
    return both.select("side", "id", "pos", number.cast("long").alias("n"), *[F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"x{i}") for i in range(WIDTH)])


def calibrator_round_trip(spark, sf_dir):
    queries, _, _ = _vectors(spark, sf_dir)
    path = f"{shared_folder(spark)}/tessera-stores/{uuid.uuid4().hex}"
    _turn(True).save(spark, path, note="turned")
    out = adapt.LinearQueryCalibrator.load(spark, path).transform(queries)
    return out.select("id", F.posexplode("embedding").alias("i", "x")).select("id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def encode_resumed(spark, sf_dir):
    """Half of the documents are encoded, then all: a text is stored once."""
    path = f"{shared_folder(spark)}/tessera-stores/{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text")
    encode = HashEncoder(WIDTH).encode
    store.encode_with_resume(spark, encode, rows.where("pos % 2 = 0"), "document", path)
    out = store.encode_with_resume(spark, encode, rows, "document", path, chunks=2)
    times = store.all_vectors(spark, path).groupBy("text_key").agg(F.count(F.lit(1)).alias("n_stored"))
    out = out.join(store.with_key(rows).select("id", "text_key"), "id").join(times, "text_key")
    return out.select(F.col("pos").alias("doc_id"), "n_stored", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"x{i}") for i in range(WIDTH)])


def encode_damaged(spark, sf_dir):
    """All documents are encoded in four parts; then one loses half its rows, one gets vectors of another width, one is no Parquet and one isn't committed. A second run mends them."""
    path = f"{shared_folder(spark)}/tessera-stores/{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text")
    encode = HashEncoder(WIDTH).encode
    store.encode_with_resume(spark, encode, rows, "document", path, 4, WIDTH)
    half, wide, broken, lost = store.good_parts(spark, path, WIDTH)
    for name, change in ((half, lambda df: df.where("substring(text_key, 1, 1) < '8'")), (wide, lambda df: df.withColumn("embedding", F.concat("embedding", "embedding")))):
        damaged = change(spark.read.parquet(f"{path}/{name}")).persist()
        damaged.count()
        damaged.write.mode("overwrite").parquet(f"{path}/{name}")
        damaged.unpersist()
    for name in store.names_in(spark, f"{path}/{broken}"):
        if name.endswith(".parquet"):
            store.write_text(spark, f"{path}/{broken}/{name}", "no table")
    store.forget(spark, path, lost)
    if store.good_parts(spark, path, WIDTH):
        raise AssertionError("a damaged part counts")
    out = store.encode_with_resume(spark, encode, rows, "document", path, 2, WIDTH)
    return out.select(F.col("pos").alias("doc_id"), *[F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"x{i}") for i in range(WIDTH)])


def order_ranges(spark, sf_dir):
    """In which ranges of 64 places two ordered lists differ."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    moved = rows.select("pos", F.when(F.col("pos") % 97 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id")).where("pos % 211 <> 5")
    return store.differing_ranges(store.range_digests(rows, 64), store.range_digests(moved, 64))


def search_cells(spark, sf_dir):
    """Exact search where the queries are too many to send to every task at once, and a few documents are searched first."""
    queries, documents, _ = _vectors(spark, sf_dir)
    # About four tiles, whatever the table: tiles of a fixed few queries would make passes without end.
    return _ranked(search(queries, documents, 10, broadcast_bytes=0, query_rows=-(-queries.count() // 4), pilot=4))


def order_digests(spark, sf_dir):
    """Whether two lists' digests agree: one in another order of rows, with two ids exchanged, and with the last row gone."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    swapped = rows.select("pos", F.when(F.col("pos") == 0, "1").when(F.col("pos") == 1, "0").otherwise(F.col("id")).alias("id"))
    cases = {"dealt": rows.repartition(3, "id"), "swapped": swapped, "cut": rows.where(F.col("pos") < rows.agg(F.max("pos")).first()[0])}
    whole = store.order_digest(rows)
    found = [(name, n, (n, digest) == whole) for name, df in cases.items() for n, digest in [store.order_digest(df)]]
    return spark.createDataFrame(found, "moved string, n long, same boolean")


def template_others(spark, sf_dir):
    rows, t = _table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    cases = {"gte_query": ("gte", "query", "find it"), "plain_query": ("sentence-transformers", "query", None), "told_query": ("sentence-transformers", "query", "find it: "), "told_document": ("sentence-transformers", "document", "find it: ")}
    return rows.select("doc_id", *[tx.template(adapter, t, kind, told).alias(name) for name, (adapter, kind, told) in cases.items()])


def _signs(text: str) -> list[float]:
    """A vector of 16 numbers, 3 or -3 by the bits of the text's digest; of unit length they are quarters."""
    return (6.0 * np.unpackbits(np.frombuffer(hashlib.sha256(text.encode()).digest()[:2], np.uint8)) - 3).tolist()


class StandInService:
    """Stands in for a hosted service: it turns every third call away and answers the others in reverse order, with vectors of the model's name and the text it was sent."""

    def __init__(self, address: str, turned_away: tuple[int, ...]) -> None:
        self.address, self.turned_away, self.calls = address, turned_away, 0

    def __call__(self, url: str, body: dict, headers: dict, timeout: float):
        if (url, headers["Authorization"]) != (f"{self.address}/embeddings", "Bearer stand-in"):
            return 401, "unknown address or key", None
        self.calls += 1
        if self.calls % 3 == 1:
            return self.turned_away[self.calls // 3 % len(self.turned_away)], "later", None
        data = [{"index": i, "embedding": _signs(f"0:{body['model']}:{t}")} for i, t in enumerate(body["input"])]
        return 200, "", {"data": data[::-1]}

    @staticmethod
    def wait(seconds: float) -> None:
        """Its answers don't depend on the time."""


class StandInModel:
    """Stands in for a local model that has a way of its own for queries."""

    def __init__(self, model_id: str, revision: str = "", device: str | None = None) -> None:
        self.model_id = model_id

    def get_sentence_embedding_dimension(self) -> int:
        return 16

    def encode(self, texts: list[str], **options) -> list[list[float]]:
        return [_signs(f"0:{self.model_id}:{t}") for t in texts]

    def encode_query(self, texts: list[str], **options) -> list[list[float]]:
        return [_signs(f"1:{self.model_id}:{t}") for t in texts]


def _encoded(rows: DataFrame, encoder, kind: str) -> DataFrame:
    out = encoder.encode(rows, kind)
    return out.select(F.col("pos").alias("doc_id"), F.lit(encoder.model_id).alias("model"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(16)])


def _united(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def hosted_encode(spark, sf_dir):
    """All documents by hosted models of each kind of provider, from registry entries; blank texts get the placeholder, two models' calls are bounded over all tasks."""
    key = "TESSERA_STAND_IN_KEY"
    spark.sparkContext.environment.setdefault(key, "stand-in")
    entries = [
        ("plain", "document", {"type": "openai-compatible", "base_url": "http://stand-in/v1/"}, {}),
        ("intfloat/e5", "document", {"type": "aiberm"}, {}),
        ("Qwen/Qwen3-Embedding", "query", {"type": "siliconflow"}, {"query_instruction": "find it", "calls_in_flight": 4}),
        ("other/model", "query", {"type": "openrouter"}, {"empty_text_placeholder": "(none)", "calls_in_flight": 2}),
    ]
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text")
    parts = []
    for model, kind, provider, more in entries:
        encoder = create_encoder({"model_id": model, "dimension": 16, "provider": provider | {"api_key_env": key}} | more)
        turned_away = (409, 503, 408) if provider["type"] == "aiberm" else (429, 503)
        encoder.provider.post, encoder.provider.sleep = StandInService(encoder.provider.base_url.rstrip("/"), turned_away), StandInService.wait
        parts.append(_encoded(rows, encoder, kind))
    return _united(parts)


def local_encode(spark, sf_dir):
    """All documents by local models of each adapter, from registry entries without a width; queries go the model's own way for them."""
    entries = [("intfloat/e5", "query", {}), ("intfloat/e5-large", "document", {}), ("Qwen/Qwen3-Embedding", "query", {"query_instruction": "find it"}), ("thenlper/gte", "document", {"max_seq_length": 512}), ("other/model", "query", {})]
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    for model, kind, more in entries:
        encoder = create_encoder({"model_id": model} | more)
        encoder.load = StandInModel
        parts.append(_encoded(rows, encoder, kind))
    return _united(parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    {"hash_words_query": "hash_words", "l2_normalize_query": "l2_normalize", "inner_product_query": "inner_product"}.get(f.__name__, f.__name__): f
    for f in (
        corpus_text, dedupe_first_pos_last_value, qrels_parse, dataset_assemble, validate_missing, sanitize_template_e5, sanitize_template_qwen3, hash_words_query, hash_encode,
        l2_normalize_query, inner_product_query, topk_exact, topk_text_ties, topk_k_exceeds_n, topk_nan_last, doc_prefix_limit, metrics_per_query, metrics_baseline,
        metrics_missing_relevant, ideal_dcg, search_k_invariance, ridge_gram, ridge_cross, gold_centroid, ridge_fit, ridge_fit_blocks, fit_corpus_alignment, fit_gold_supervised, calibrate_transform,
        calibrated_metrics_delta, resume_missing, order_consistency, cache_fingerprint, adapter_detect,
        collection_corpus, collection_dataset, encode_and_evaluate, encode_queries_command, adapt_gold_command, adapt_corpus_command, stores_joined, store_round_trip, calibrator_round_trip, encode_resumed, encode_damaged, search_cells, order_digests, order_ranges, template_others, hosted_encode, local_encode,
    )
}

_V = """
    e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
    rel AS (
        SELECT q.vec_id AS qid, e.vec_id AS did, CASE WHEN abs(q.vec_id - e.vec_id) % 2 = 0 THEN 2 ELSE 1 END AS grade
        FROM q JOIN e ON q.label = e.label AND abs(q.vec_id - e.vec_id) BETWEEN 1 AND 50
    ),
    ideal AS (
        SELECT qid, count(*) AS n_relevant, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) END) AS idcg
        FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS r FROM rel) GROUP BY qid
    )"""


def _hits(queries: str, documents: str, k: int) -> str:
    """The ranking of queries (vec_id, v) over documents (vec_id, v)."""
    return f"""(
        SELECT qid, did, score, rank FROM (
            SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank
            FROM (SELECT a.vec_id AS qid, b.vec_id AS did, list_inner_product(a.v, b.v)::FLOAT AS score FROM {queries} a, {documents} b)
        ) WHERE rank <= {k})"""


def _per_query(hits: str) -> str:
    return f"""(
        SELECT i.qid, CASE WHEN count(DISTINCT CASE WHEN f.rank <= 5 THEN f.did END) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_5,
               count(DISTINCT CASE WHEN f.rank <= 5 THEN f.did END)::DOUBLE / any_value(n_relevant) AS recall_5,
               CASE WHEN count(DISTINCT CASE WHEN f.rank <= 10 THEN f.did END) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_10,
               count(DISTINCT CASE WHEN f.rank <= 10 THEN f.did END)::DOUBLE / any_value(n_relevant) AS recall_10,
               coalesce(CASE WHEN min(f.rank) <= 10 THEN 1.0::DOUBLE / min(f.rank) END, 0)::DOUBLE AS rr,
               (coalesce(sum(CASE WHEN f.rank <= 10 THEN (2 ** f.grade - 1) / log2(f.rank + 1) END), 0) / any_value(idcg))::DOUBLE AS ndcg
        FROM ideal i LEFT JOIN (SELECT h.qid, h.did, h.rank, rel.grade FROM {hits} h JOIN rel ON h.qid = rel.qid AND h.did = rel.did) f ON f.qid = i.qid
        GROUP BY i.qid)"""


def _summary(hits: str) -> str:
    names = ", ".join(f"round(avg({a}), 6) AS {b}" for a, b in (("hit_5", "hit_5"), ("recall_5", "recall_5"), ("hit_10", "hit_10"), ("recall_10", "recall_10"), ("rr", "mrr"), ("ndcg", "ndcg")))
    return f"SELECT count(*) AS num_queries, {names} FROM {_per_query(hits)}"


_TEXT = "coalesce(text, '')"
#: What protocol F's documents are encoded from.
_DOCUMENT_TEXT = r"regexp_replace(CASE WHEN doc_id % 10 = 0 THEN 'again' WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(lang, '') END || chr(10) || coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_TEMPLATE_ROWS = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '[EMPTY]' ELSE text END AS t FROM documents)"
_WORD = "('0x' || substr(h, {a} + 7, 2) || substr(h, {a} + 5, 2) || substr(h, {a} + 3, 2) || substr(h, {a} + 1, 2))::BIGINT"
_WORDS = ", ".join(f"{_WORD.format(a=8 * i)} AS w{i}" for i in range(8))
_HASHED = "SELECT doc_id, {words} FROM (SELECT doc_id, sha256('0:{kind}:' || {text}) AS h FROM documents {where})"
_FLOATS = [f"(w{i}::FLOAT * (2.0 ** -32)::FLOAT - 0.5::FLOAT)" for i in range(8)]
_SQUARES = " + ".join(f"{x}::DOUBLE ** 2" for x in _FLOATS)


def _hash_vectors(kind: str, text: str, where: str = "") -> str:
    unit = ", ".join(f"({x} / sqrt(8 * ({_SQUARES})))::FLOAT::DOUBLE" for x in _FLOATS)
    return f"(SELECT doc_id AS vec_id, [{unit}] AS v FROM ({_HASHED.format(words=_WORDS, kind=kind, text=text, where=where)}))"


def _components(vector: str) -> str:
    return ", ".join(f"round({vector}[{i + 1}], 5) AS x{i}" for i in range(WIDTH))


#: A digest's eight numbers, repeated to the width.
_HASH_COLUMNS = ", ".join(f"round(v[{i % 8 + 1}], 5) AS x{i}" for i in range(WIDTH))
_SIGNS = ", ".join(f"CASE WHEN (('0x' || substr(h, 1, 4))::BIGINT >> {15 - i}) & 1 = 1 THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END AS x{i}" for i in range(16))
_BLANK = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = ''"
_WIDE = "flatten(list_transform(range(8), lambda k: {}))"
_LABEL_RELS = "(SELECT doc_id - doc_id % 20 AS qid, doc_id AS did, quality FROM labels)"
_TURNED = "(SELECT vec_id, list_transform(w, lambda x: (x / sqrt(list_inner_product(w, w)))::FLOAT::DOUBLE) AS v FROM (SELECT vec_id, list_transform(range(1, 65), lambda i: (v[65 - i] * (1 + (i - 1) / 64.0::DOUBLE))::FLOAT::DOUBLE) AS w FROM q))"
_FEW = "few AS (SELECT label AS vec_id, arg_min(embedding, vec_id) AS v0 FROM embeddings GROUP BY label)"
_MOMENT = "SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(a * b), 5) AS value FROM (SELECT i, j, v[i] AS a, v[{j}] AS b FROM e, range(1, 65) r(i), range(1, 65) s(j)) GROUP BY i, j"
_DELTA = "unnest([('HitRate@5', b.hit_5 - a.hit_5), ('Recall@5', b.recall_5 - a.recall_5), ('HitRate@10', b.hit_10 - a.hit_10), ('Recall@10', b.recall_10 - a.recall_10), ('MRR@10', b.rr - a.rr), ('NDCG@10', b.ndcg - a.ndcg)])"
#: The ridge map of pairs p (s, t), by elimination over the rows of (S'S + 0.01 I | S'T).
_SOLVED = """
    system AS (SELECT i, j, sum(s[i] * st[j]) + CASE WHEN i = j THEN 0.01::DOUBLE ELSE 0 END AS x FROM (SELECT s, list_concat(s, t) AS st FROM p), range(1, 65) a(i), range(1, 129) b(j) GROUP BY i, j),
    steps AS (
        SELECT 1 AS k, i, j, x FROM system
        UNION ALL
        SELECT r.k + 1, r.i, r.j, CASE WHEN r.i = r.k THEN r.x / d.x ELSE r.x - f.x * p.x / d.x END
        FROM steps r JOIN steps p ON p.i = r.k AND p.j = r.j JOIN steps f ON f.i = r.i AND f.j = r.k JOIN steps d ON d.i = r.k AND d.j = r.k WHERE r.k <= 64
    )
    SELECT (i - 1)::INT AS i, (j - 65)::INT AS j, round(x::FLOAT::DOUBLE, 4) AS w FROM steps WHERE k = 65 AND j > 64"""
_METRIC_ROWS = "unnest([('num_queries', num_queries), ('HitRate@5', hit_5), ('Recall@5', recall_5), ('HitRate@10', hit_10), ('Recall@10', recall_10), ('MRR@10', mrr), ('NDCG@10', ndcg)])"
_MEANS = "SELECT avg(hit_5) AS hit_5, avg(recall_5) AS recall_5, avg(hit_10) AS hit_10, avg(recall_10) AS recall_10, avg(rr) AS rr, avg(ndcg) AS ndcg FROM "

ORACLES: dict[str, str] = {
    "corpus_text": r"SELECT doc_id, regexp_replace(coalesce(lang, '') || chr(10) || coalesce(text, ''), '^\s+|\s+$', '', 'g') AS document_text FROM documents",
    "dedupe_first_pos_last_value": "SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, min(turn) AS pos FROM conversations GROUP BY conv_id",
    "qrels_parse": f"SELECT qid::VARCHAR AS query_id, did::VARCHAR AS doc_id, quality AS score, did AS pos FROM {_LABEL_RELS}",
    "dataset_assemble": f"""
        SELECT d.doc_id::VARCHAR AS query_id, d.text AS query_text, coalesce(string_agg(CASE WHEN quality > 0 THEN did::VARCHAR END, ',' ORDER BY did), '') AS relevant, min(did) AS pos
        FROM documents d JOIN {_LABEL_RELS} r ON r.qid = d.doc_id GROUP BY d.doc_id, d.text""",
    "validate_missing": f"""
        WITH kept AS (SELECT qid, min(did) AS pos FROM {_LABEL_RELS} GROUP BY qid HAVING min(did) % 40 <> 0)
        SELECT DISTINCT 'unknown query' AS problem, qid::VARCHAR AS id FROM {_LABEL_RELS} WHERE qid NOT IN (SELECT qid FROM kept)
        UNION ALL
        SELECT 'repeated query', qid::VARCHAR FROM kept WHERE pos % 100 = 20
        UNION ALL
        SELECT 'missing document', did::VARCHAR FROM {_LABEL_RELS} WHERE quality > 0 AND did NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr')""",
    "sanitize_template_e5": f"SELECT doc_id, 'query: ' || t AS as_query, 'passage: ' || t AS as_document FROM {_TEMPLATE_ROWS}",
    "sanitize_template_qwen3": f"SELECT doc_id, 'Instruct: find it' || chr(10) || 'Query:' || t AS as_query, t AS as_document FROM {_TEMPLATE_ROWS}",
    "hash_words": _HASHED.format(words=_WORDS, kind="document", text="coalesce(text, '')", where=""),
    "hash_encode": f"SELECT vec_id AS doc_id, {_HASH_COLUMNS} FROM {_hash_vectors('document', _TEXT)}",
    "l2_normalize": f"""
        WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * (vec_id % 7))::FLOAT::DOUBLE) AS v FROM embeddings),
        u AS (SELECT vec_id, list_transform(v, lambda x: (x / greatest(sqrt(list_inner_product(v, v)), 1e-12))::FLOAT::DOUBLE) AS u FROM s)
        SELECT vec_id, round(sqrt(list_inner_product(u, u)), 4) AS norm, {_components("u")} FROM u""",
    "inner_product": f"WITH {_V} SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS product FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "topk_exact": f"WITH {_V} SELECT qid::VARCHAR AS query_id, rank, did::VARCHAR AS doc_id, round(score::DOUBLE, 5) AS score FROM {_hits('q', 'e', 10)}",
    "topk_text_ties": f"""
        WITH a AS {_hash_vectors("query", _TEXT, "WHERE doc_id % 20 = 0")}, b AS {_hash_vectors("document", _TEXT)},
        a8 AS (SELECT vec_id, list_transform(v, lambda x: 8 * x) AS v FROM a)
        SELECT qid::VARCHAR AS query_id, rank, did::VARCHAR AS doc_id FROM {_hits("a8", "b", 10)}""",
    "topk_k_exceeds_n": f"WITH {_V}, {_FEW}, f AS (SELECT vec_id, list_transform(v0, lambda x: x::DOUBLE) AS v FROM few) SELECT qid::VARCHAR AS query_id, rank, did::VARCHAR AS doc_id, round(score::DOUBLE, 5) AS score FROM {_hits('q', 'f', 50)}",
    "topk_nan_last": f"""
        WITH {_V}, s AS (SELECT q.vec_id AS qid, e.vec_id AS did, CASE WHEN e.vec_id % 50 = 1 THEN list_inner_product(q.v, e.v)::FLOAT WHEN e.vec_id % 50 IN (2, 3) THEN 0::FLOAT END AS score FROM q, e)
        SELECT qid::VARCHAR AS query_id, rank, did::VARCHAR AS doc_id, round(score::DOUBLE, 5) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, did) AS rank FROM s) WHERE rank <= 50""",
    "doc_prefix_limit": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "metrics_per_query": f"WITH {_V} SELECT qid::VARCHAR AS query_id, hit_5, round(recall_5, 6) AS recall_5, hit_10, round(recall_10, 6) AS recall_10, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM {_per_query(_hits('q', 'e', 10))}",
    "metrics_baseline": f"WITH {_V} {_summary(_hits('q', 'e', 10))}",
    "metrics_missing_relevant": f"WITH {_V}, d AS (SELECT * FROM e WHERE vec_id % 3 <> 0) {_summary(_hits('q', 'd', 10))}",
    "ideal_dcg": f"WITH {_V} SELECT qid::VARCHAR AS query_id, n_relevant, round(idcg, 6) AS idcg FROM ideal",
    "search_k_invariance": f"WITH {_V}, m AS ({_summary(_hits('q', 'e', 10))}) SELECT k::INT AS search_k, x[1] AS metric, x[2]::DOUBLE AS value FROM (SELECT {_METRIC_ROWS} AS x FROM m), (SELECT unnest([3, 25]) AS k)",
    "ridge_gram": f"WITH {_V} {_MOMENT.format(j='j')}",
    "ridge_cross": f"WITH {_V} {_MOMENT.format(j='65 - j')}",
    "gold_centroid": f"""
        WITH {_V} SELECT qid::VARCHAR AS id, (i - 1)::INT AS i, round((sum(grade * v[i]) / sum(grade))::FLOAT::DOUBLE, 5) AS x
        FROM rel JOIN e ON e.vec_id = rel.did, range(1, 65) r(i) GROUP BY qid, i""",
    "ridge_fit": f"WITH RECURSIVE {_V}, p AS (SELECT v AS s, list_reverse(v) AS t FROM e), {_SOLVED}",
    "ridge_fit_blocks": f"WITH RECURSIVE {_V}, p AS (SELECT v AS s, list_reverse(v) AS t FROM e), {_SOLVED}",
    "fit_corpus_alignment": f"WITH RECURSIVE {_V}, p AS (SELECT v AS s, list_reverse(v) AS t FROM e WHERE vec_id % 3 <> 0), {_SOLVED}",
    "fit_gold_supervised": f"""
        WITH RECURSIVE {_V}, c AS (SELECT qid, i, (sum(grade * v[i]) / sum(grade))::FLOAT::DOUBLE AS x FROM rel JOIN e ON e.vec_id = rel.did, range(1, 65) r(i) GROUP BY qid, i),
        p AS (SELECT any_value(q.v) AS s, list(x ORDER BY i) AS t FROM c JOIN q ON q.vec_id = c.qid GROUP BY qid), {_SOLVED}""",
    "calibrate_transform": f"WITH {_V} SELECT vec_id::VARCHAR AS id, (i - 1)::INT AS i, round(v[i], 5) AS x FROM {_TURNED}, range(1, 65) r(i)",
    "calibrator_round_trip": f"WITH {_V} SELECT vec_id::VARCHAR AS id, (i - 1)::INT AS i, round(v[i], 5) AS x FROM {_TURNED}, range(1, 65) r(i)",
    "collection_corpus": """
        SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 10 = 0 THEN 'again' WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(lang, '') END AS title, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS pos
        FROM documents""",
    "collection_dataset": f"""
        SELECT d.doc_id::VARCHAR AS query_id, coalesce(d.text, '') AS query_text, coalesce(string_agg(CASE WHEN quality > 0 THEN did::VARCHAR END, ',' ORDER BY did), '') AS relevant, min(line) AS pos
        FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY did) AS line FROM {_LABEL_RELS}) r ON r.qid = d.doc_id GROUP BY d.doc_id, d.text""",
    "encode_and_evaluate": f"""
        WITH rel AS (SELECT qid, did, quality AS grade FROM {_LABEL_RELS} WHERE quality > 0),
        ideal AS (
            SELECT qid, count(*) AS n_relevant, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) END) AS idcg
            FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS r FROM rel) GROUP BY qid
        ),
        a AS {_hash_vectors("query", _TEXT, "WHERE doc_id IN (SELECT qid FROM rel)")}, b AS {_hash_vectors("document", _DOCUMENT_TEXT)},
        a8 AS (SELECT vec_id, list_transform(v, lambda x: 8 * x) AS v FROM a), m AS ({_summary(_hits("a8", "b", 10))})
        SELECT x[1] AS metric, x[2]::DOUBLE AS value FROM (SELECT {_METRIC_ROWS} AS x FROM m)""",
    "encode_queries_command": f"""
        SELECT vec_id AS doc_id, 'query_only' AS kind, 0::BIGINT AS n_documents, {_HASH_COLUMNS}
        FROM {_hash_vectors('query', _TEXT, f"WHERE doc_id IN (SELECT qid FROM {_LABEL_RELS} WHERE quality > 0)")}""",
    "adapt_gold_command": f"""
        SELECT *, 'qrels_positive_centroid' AS label_source, 'test' AS eval_split FROM (
            WITH RECURSIVE rel AS (SELECT * FROM {_LABEL_RELS} WHERE quality > 0 AND qid % 40 = 0),
            a AS {_hash_vectors("query", _TEXT)}, b AS {_hash_vectors("document", _DOCUMENT_TEXT)},
            c AS (SELECT qid, i, (sum(quality * v[i]) / sum(quality))::FLOAT::DOUBLE AS x FROM rel JOIN b ON b.vec_id = rel.did, range(1, 9) r(i) GROUP BY qid, i),
            p AS (SELECT {_WIDE.format("any_value(a.v)")} AS s, {_WIDE.format("list(x ORDER BY i)")} AS t FROM c JOIN a ON a.vec_id = c.qid GROUP BY qid), {_SOLVED})""",
    "adapt_corpus_command": f"""
        SELECT *, 'same_document_query_protocol_alignment' AS label_source, (SELECT count(*) // 2 FROM documents) AS corpus_documents_used FROM (
            WITH RECURSIVE half AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT count(*) // 2 FROM documents)),
            a AS {_hash_vectors("query", _DOCUMENT_TEXT)}, b AS {_hash_vectors("document", _DOCUMENT_TEXT)},
            p AS (SELECT {_WIDE.format("a.v")} AS s, {_WIDE.format("b.v")} AS t FROM a JOIN b USING (vec_id) WHERE vec_id IN (SELECT doc_id FROM half)), {_SOLVED})""",
    "stores_joined": f"WITH {_V} SELECT vec_id, round(list_inner_product(v, list_reverse(v)), 5) AS product FROM e WHERE vec_id % 3 <> 0",
    "store_round_trip": f"""
        WITH {_V} SELECT side, vec_id::VARCHAR AS id, vec_id AS pos, count(*) OVER (PARTITION BY side) AS n, {_components("v")} FROM (SELECT 'query' AS side, vec_id, v FROM q UNION ALL SELECT 'document', vec_id, v FROM e)""",
    "encode_resumed": f"SELECT vec_id AS doc_id, 1::BIGINT AS n_stored, {_HASH_COLUMNS} FROM {_hash_vectors('document', _TEXT)}",
    "encode_damaged": f"SELECT vec_id AS doc_id, {_HASH_COLUMNS} FROM {_hash_vectors('document', _TEXT)}",
    "order_ranges": """
        SELECT doc_id // 64 AS range, count(*) AS left_n, count(*) FILTER (doc_id % 211 <> 5) AS right_n FROM documents
        GROUP BY range HAVING bool_or(doc_id % 97 = 0 OR doc_id % 211 = 5)""",
    "search_cells": f"WITH {_V} SELECT qid::VARCHAR AS query_id, rank, did::VARCHAR AS doc_id, round(score::DOUBLE, 5) AS score FROM {_hits('q', 'e', 10)}",
    "order_digests": """
        SELECT 'dealt' AS moved, count(*) AS n, true AS same FROM documents UNION ALL SELECT 'swapped', count(*), false FROM documents
        UNION ALL SELECT 'cut', count(*), false FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents)""",
    "template_others": f"SELECT doc_id, {_TEXT} AS gte_query, {_TEXT} AS plain_query, 'find it: ' || {_TEXT} AS told_query, {_TEXT} AS told_document FROM documents",
    "hosted_encode": f"""
        SELECT doc_id, model, {_SIGNS} FROM (
            SELECT doc_id, model, sha256('0:' || model || ':' || before || CASE WHEN {_BLANK} THEN blank ELSE text END) AS h
            FROM documents, (VALUES ('plain', '', '[EMPTY]'), ('intfloat/e5', 'passage: ', '[EMPTY]'), ('Qwen/Qwen3-Embedding', 'Instruct: find it' || chr(10) || 'Query:', '[EMPTY]'), ('other/model', '', '(none)')) t(model, before, blank))""",
    "local_encode": f"""
        SELECT doc_id, model, {_SIGNS} FROM (
            SELECT doc_id, model, sha256(way || ':' || model || ':' || before || {_TEXT}) AS h
            FROM documents, (VALUES ('intfloat/e5', '1', 'query: '), ('intfloat/e5-large', '0', 'passage: '), ('Qwen/Qwen3-Embedding', '1', 'Instruct: find it' || chr(10) || 'Query:'), ('thenlper/gte', '0', ''), ('other/model', '1', '')) t(model, way, before))""",
    "calibrated_metrics_delta": f"""
        WITH {_V}, turned AS {_TURNED}, a AS ({_MEANS} {_per_query(_hits('q', 'e', 10))}), b AS ({_MEANS} {_per_query(_hits('turned', 'e', 10))})
        SELECT m[1] AS metric, round(m[2], 6)::DOUBLE AS delta FROM (SELECT {_DELTA} AS m FROM a, b)""",
    "resume_missing": """
        SELECT DISTINCT sha256(coalesce(text, '')) AS text_key, length(coalesce(text, '')) AS n_chars FROM documents
        WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)""",
    "order_consistency": """
        SELECT doc_id AS pos, doc_id::VARCHAR AS left_id, CASE WHEN doc_id % 11 <> 0 THEN doc_id::VARCHAR || 'x' END AS right_id FROM documents WHERE doc_id % 11 = 0 OR doc_id % 9 = 0""",
    "cache_fingerprint": """
        SELECT source, s AS split, substr(sha256('{"dataset":"' || source || '","dimension":64,"encoding_config":{"seed":0,"type":"sha256"},"model_id":"hash","revision":"0","split":"' || s || '"}'), 1, 20) AS fingerprint
        FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), (SELECT unnest(['test', 'train']) AS s)""",
    "adapter_detect": """
        SELECT name || '-' || source AS model, adapter FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
        (VALUES ('intfloat/E5', 'e5'), ('Qwen/Qwen3-Embedding', 'qwen3'), ('thenlper/GTE', 'gte'), ('other/model', 'sentence-transformers')) t(name, adapter)""",
}
