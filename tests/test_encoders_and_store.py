import hashlib
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.encoders import BatchEncoder, HashEncoder, HostedEncoder, SentenceTransformerEncoder, create_encoder, hash_vector, hash_words
from tessera.operators.providers import Provider, TransportError, create_provider
from tessera.sources import store
from tessera.sources.registry import load_model_config

TEXTS = "id string, pos long, text string"


def test_hash_words(spark):
    rows = spark.createDataFrame([("same",)], "t string")
    q, d = rows.select(hash_words(F.col("t"), "query"), hash_words(F.col("t"), "document")).first()
    assert q == [2799027991, 1701030158, 531756909, 954688397, 591193297, 897166939, 413381623, 2580374898]
    assert d == [1533136158, 3039419249, 2553402280, 3369955048, 2651287120, 1303120202, 476652305, 3128843826]


@pytest.mark.parametrize("dimension", [4, 8, 20, 64])
def test_hash_vectors_bit_for_bit(spark, sf, dimension):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", hash_vector(F.col("text"), "document", dimension, 3).alias("v")).collect()
    for r in rows:
        digest = hashlib.sha256(f"3:document:{r['text']}".encode()).digest()
        want = np.frombuffer((digest * (dimension // 8 + 1))[: dimension * 4], "<u4").astype(np.float32) / np.float32(2**32) - np.float32(0.5)
        assert np.array_equal(np.float32(r["v"]), want)


def test_hash_encoder(spark):
    rows = spark.createDataFrame([("a", 0, "same")], TEXTS)
    q, d = (HashEncoder(8).encode(rows, k).first()["embedding"] for k in ("query", "document"))
    assert q == pytest.approx([0.189375, -0.129764, -0.469621, -0.346693, -0.452345, -0.363412, -0.504027, 0.125822], abs=1e-6)
    assert np.linalg.norm(d) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        HashEncoder().encode(rows, "passage")


class Fake:
    """A picklable transport: answers from a list of statuses, then in reverse order of index."""

    def __init__(self, *statuses, short=0):
        self.statuses, self.short, self.bodies = list(statuses), short, []

    def __call__(self, url, body, headers, timeout):
        self.bodies.append(body)
        status = self.statuses.pop(0) if self.statuses else 200
        if status == "broken":
            raise TransportError("broken")
        if status != 200:
            return status, "no", None
        n = len(body["input"]) - self.short
        self.short = 0
        return 200, "", {"data": [{"index": i, "embedding": [3.0, 4.0 + i]} for i in reversed(range(n))]}


@pytest.fixture
def key(monkeypatch):
    monkeypatch.setenv("TEST_KEY", "k")


def provider(fake, **more):
    waits = []
    return Provider("http://x/v1/", "TEST_KEY", post=fake, sleep=waits.append, **more), waits


def test_retries(key):
    p, waits = provider(Fake(429, 500, "broken"))
    assert p.embed("m", ["a", "b"]) == [[3.0, 4.0], [3.0, 5.0]] and waits == [1, 2, 4]
    p, waits = provider(Fake(*[503] * 9), max_retries=6)
    with pytest.raises(RuntimeError, match="gave up"):
        p.embed("m", ["a"])
    assert waits == [1, 2, 4, 8, 16, 30]
    for fake in (Fake(400), Fake(404), Fake(409), Fake(short=1)):
        p, waits = provider(fake)
        with pytest.raises(RuntimeError):
            p.embed("m", ["a"])
        assert waits == []
    assert p.embed("m", []) == []


@pytest.mark.parametrize("fake", [Fake(408), Fake(409), Fake(short=1)])
def test_conflicts_retried(key, fake):
    p, waits = provider(fake, retry_conflicts=True)
    assert len(p.embed("m", ["a"])) == 1 and waits == [1]


def test_no_key(monkeypatch):
    monkeypatch.delenv("TEST_KEY", raising=False)
    with pytest.raises(RuntimeError, match="TEST_KEY"):
        provider(Fake())[0].embed("m", ["a"])


def test_create_provider():
    assert create_provider({}).provider_id == "siliconflow"
    assert create_provider({"type": "openrouter"}).base_url.endswith("openrouter.ai/api/v1")
    assert create_provider({"type": "aiberm"}).retry_conflicts
    assert create_provider({"type": "openai-compatible", "base_url": "u", "api_key_env": "E", "token": "t"}).settings == {"type": "openai-compatible", "base_url": "u", "api_key_env": "E"}
    for bad in ({"type": "openai-compatible"}, {"type": "else"}):
        with pytest.raises(ValueError):
            create_provider(bad)


def test_hosted_e5(spark):
    def post(url, body, headers, timeout):
        assert all(t in ("query: [EMPTY]", "passage: text") for t in body["input"])
        return 200, "", {"data": [{"index": i, "embedding": [3.0, 4.0]} for i in range(len(body["input"]))]}

    encoder = HostedEncoder("m", 2, Provider("u", "PATH", post=post), adapter="e5")
    for kind, text in (("query", " "), ("document", "text")):
        assert encoder.encode(spark.createDataFrame([("a", 0, text)], TEXTS), kind).first()["embedding"] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="width 3"):
        HostedEncoder("m", 3, Provider("u", "PATH", post=post), adapter="e5").encode(spark.createDataFrame([("a", 0, "text")], TEXTS), "document").collect()


def test_create_encoder():
    assert isinstance(create_encoder(load_model_config("hash")), HashEncoder)
    e5 = create_encoder(load_model_config("e5-base-v2"))
    assert isinstance(e5, HostedEncoder) and (e5.dimension, e5.adapter, e5.revision) == (768, "e5", "openrouter-api")
    assert isinstance(create_encoder({"model_id": "x/gte", "dimension": 3}), SentenceTransformerEncoder)
    with pytest.raises(KeyError):
        create_encoder({"adapter": "bge-m3", "model_id": "b", "dimension": 3})
    with pytest.raises(ValueError):
        create_encoder({"adapter": "e5", "model_id": "b", "provider": {}})
    with pytest.raises(KeyError, match="bge-m3"):
        load_model_config("absent")


def test_registry_without_models_key(tmp_path):
    (tmp_path / "m.yaml").write_text("one: {dimension: 3}\n")
    assert load_model_config("one", tmp_path / "m.yaml") == {"model_id": "one", "dimension": 3}


def test_fingerprints():
    assert store.cache_fingerprint("toy", "test", HashEncoder()) == "15c94895d6c3773f1868"
    assert store.cache_fingerprint("toy", "train", HashEncoder()) == "e451917ae29a4df7ffdb"


class Counting(BatchEncoder):
    model_id, revision, dimension, batch_size, adapter = "count", "1", 2, 2, ""

    def __init__(self, seen):
        self.seen = seen

    def starter(self):
        seen = self.seen

        def embed(texts, kind):
            with open(seen, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[len(t), 1.0] for t in texts]

        return lambda: embed


def test_resume_encodes_only_what_is_missing(spark, tmp_path):
    seen, path = tmp_path / "seen", f"file://{tmp_path}/parts"
    encoder = Counting(str(seen))
    rows = lambda *texts: spark.createDataFrame([(f"i{n}", n, t) for n, t in enumerate(texts)], TEXTS)
    first = store.encode_with_resume(spark, encoder.encode, rows("a", "bb", "a"), "query", path).orderBy("pos").collect()
    assert sorted(seen.read_text().split()) == ["a", "bb"] and [r["id"] for r in first] == ["i0", "i1", "i2"]
    again = store.encode_with_resume(spark, encoder.encode, rows("a", "ccc", "a"), "query", path, chunks=3).orderBy("pos").collect()
    assert sorted(seen.read_text().split()) == ["a", "bb", "ccc"]
    assert again[0]["embedding"] == first[0]["embedding"] and again[1]["embedding"] != first[1]["embedding"]
    with pytest.raises(ValueError):
        store.encode_with_resume(spark, encoder.encode, rows("a"), "text", path)


def test_parts_that_dont_count(spark, tmp_path):
    seen, path = tmp_path / "seen", f"file://{tmp_path}/parts"
    encoder = Counting(str(seen))
    rows = spark.createDataFrame([(f"i{n}", n, "x" * n) for n in range(12)], TEXTS)
    store.encode_with_resume(spark, encoder.encode, rows, "query", path, 2, 2)
    one, two = store.good_parts(spark, path, 2)
    assert store.good_parts(spark, path, 3) == [] and len(store.commits(spark, path)) == 2
    (tmp_path / "parts" / "part-0abc").mkdir()  # another run's, not finished
    store.forget(spark, path, one)
    assert store.good_parts(spark, path) == [two]
    seen.unlink()
    out = store.encode_with_resume(spark, encoder.encode, rows, "query", path, 1, 2)
    assert out.count() == 12 and len(seen.read_text().splitlines()) == 12 - spark.read.parquet(f"{path}/{two}").count()
    with pytest.raises(ValueError, match="instead of 5"):
        store.encode_with_resume(spark, encoder.encode, rows, "query", f"{path}-2", 1, 5)


def test_queries_of_a_local_model(monkeypatch):
    """A model with a way of its own for queries is asked that way; all local models have the same keys."""
    class Model:
        def __init__(self, *args, **more): ...

        def encode(self, texts, **more):
            return [[1.0, 0.0]] * len(texts)

        def encode_query(self, texts, **more):
            return [[0.0, 1.0]] * len(texts)

    monkeypatch.setitem(sys.modules, "sentence_transformers", SimpleNamespace(SentenceTransformer=Model))
    run = SentenceTransformerEncoder("m", 2).starter()()
    assert run(["a"], "query") == [[0.0, 1.0]] and run(["a"], "document") == [[1.0, 0.0]]
    del Model.encode_query
    assert SentenceTransformerEncoder("m", 2).starter()()(["a"], "query") == [[1.0, 0.0]]
    assert SentenceTransformerEncoder("m", 2, adapter="e5").encoding_config == {"adapter": "sentence-transformers", "batch_size": 32, "max_seq_length": None, "query_instruction": None}
    assert SentenceTransformerEncoder("m", 2, adapter="qwen3").encoding_config["query_instruction"].startswith("Given a web search")


def test_store_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("q1", 0, [1.0, 1.0]), ("q2", 1, [1.0, 0.0])], "id string, pos long, embedding array<float>")
    d = q.limit(0)
    saved = store.save_store(spark, str(tmp_path / "s"), q, d, {"dataset": "toy", "dimension": 2, "cache_kind": "query_only"})
    queries, documents, manifest = store.load_store(spark, str(tmp_path / "s"))
    assert manifest == saved and queries.count() == 2 and documents.count() == 0
    q.where("pos = 0").write.mode("overwrite").parquet(str(tmp_path / "s" / "queries"))
    with pytest.raises(ValueError):
        store.load_store(spark, str(tmp_path / "s"))


def test_order(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, pos long")
    b = spark.createDataFrame([("y", 0), ("x", 1)], "id string, pos long")
    assert store.order_digest(a) != store.order_digest(b) and store.order_mismatches(a, b).count() == 2
    assert store.order_mismatches(a, a).count() == 0


def test_joins_of_stores_move_no_vectors(spark, tmp_path):
    ids = spark.range(500).select(F.concat(F.lit("it's "), "id").alias("id"), F.col("id").alias("pos"))
    q = ids.withColumn("embedding", F.array(F.col("pos").cast("float"), F.lit(1.0).cast("float")))
    d = ids.where("pos % 3 = 0").withColumn("embedding", F.array(F.lit(2.0).cast("float"), F.col("pos").cast("float")))
    folder = str(tmp_path / "it's one")
    store.save_store(spark, folder, q, d, {"dimension": 2}, buckets=3)
    for _ in range(2):  # the second time as a session that doesn't know the tables
        queries, documents, _ = store.load_store(spark, folder)
        joined = queries.hint("merge").join(documents.select("id", F.col("embedding").alias("target")), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {r["id"]: (r["embedding"], r["target"]) for r in joined.collect()} == {f"it's {n}": ([n, 1.0], [2.0, n]) for n in range(0, 500, 3)}
        for table in spark.catalog.listTables():
            if table.name.startswith("tessera_"):
                spark.sql(f"DROP TABLE {table.name}")
    # Written anew, with fewer rows and in other buckets.
    store.save_store(spark, folder, q.limit(4), d.limit(0), {"dimension": 2}, buckets=2)
    queries, documents, manifest = store.load_store(spark, folder)
    assert (queries.count(), documents.count(), manifest["buckets"]) == (4, 0, 2)


def _service(folder, refusals):
    """A service that notes how many calls it answers at one time, over all processes, and refuses the first calls."""

    def post(url, body, headers, timeout):
        import os
        import time
        import uuid

        own = f"{folder}/now/{uuid.uuid4().hex}"
        open(own, "w").close()
        at_once = len(os.listdir(f"{folder}/now"))
        open(f"{folder}/seen/{at_once}-{uuid.uuid4().hex}", "w").close()
        time.sleep(0.02)
        os.remove(own)
        for n in range(refusals):
            try:
                os.close(os.open(f"{folder}/refused-{n}", os.O_CREAT | os.O_EXCL))
                return 429, "slow down", None
            except FileExistsError:
                pass
        return 200, "", {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]}

    def sleep(seconds):
        import uuid

        open(f"{folder}/slept/{seconds}-{uuid.uuid4().hex}", "w").close()

    for name in ("now", "seen", "slept"):
        (folder / name).mkdir(parents=True)
    return post, sleep


def test_calls_in_flight_are_bounded_and_tasks_wait_together(spark, tmp_path):
    texts = spark.range(0, 120, 1, 8).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    post, sleep = _service(tmp_path / "a", 1)
    encoder = HostedEncoder("m", 2, Provider("u", "PATH", post=post, sleep=sleep), batch_size=3, calls_in_flight=3)
    found = {r["id"]: r["embedding"] for r in encoder.encode(texts, "document").collect()}
    plain, _ = _service(tmp_path / "b", 0)
    expected = {r["id"]: r["embedding"] for r in HostedEncoder("m", 2, Provider("u", "PATH", post=plain), batch_size=3).encode(texts, "document").collect()}
    assert found == expected and len(found) == 120
    seen = [int(p.name.split("-")[0]) for p in (tmp_path / "a" / "seen").iterdir()]
    assert 1 < max(seen) <= 3 and len(seen) >= 41
    assert len(list((tmp_path / "a" / "slept").iterdir())) == 3  # one refusal: all three tasks waited once
    assert encoder.encoding_config == HostedEncoder("m", 2, encoder.provider, batch_size=3).encoding_config


def test_a_service_that_always_refuses_ends_the_job(spark, tmp_path):
    post, sleep = _service(tmp_path / "a", 1000)
    encoder = HostedEncoder("m", 2, Provider("u", "PATH", post=post, sleep=sleep, max_retries=1), calls_in_flight=2)
    with pytest.raises(Exception, match="gave up after 2 tries"):
        encoder.encode(spark.createDataFrame([("a", 0, "text")], TEXTS), "document")
    with pytest.raises(ValueError):
        HostedEncoder("m", 2, encoder.provider, calls_in_flight=0)


@pytest.mark.parametrize("waves", [1, 3])
def test_a_service_that_turns_away_single_calls_costs_few_rounds(spark, monkeypatch, waves):
    import time

    from tessera.operators import encoders
    from tessera.plans.queries import StandInService

    texts = spark.range(0, 360, 1, 8).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    if waves > 1:
        monkeypatch.setattr(encoders, "WAVE_BYTES", -(-360 * 4 // (2 * waves)))
    spark.sparkContext.environment["TESSERA_STAND_IN_KEY"] = "stand-in"
    provider = Provider("http://s", "TESSERA_STAND_IN_KEY", post=StandInService("http://s", (429, 503)), sleep=StandInService.wait)
    began = time.monotonic()
    bounded = HostedEncoder("m", 16, provider, batch_size=2, calls_in_flight=2).encode(texts, "document").collect()
    assert time.monotonic() - began < 30  # a round takes a second at least, and a third of 270 calls are turned away
    plain = HostedEncoder("m", 16, provider, batch_size=2).encode(texts, "document").collect()
    assert len(bounded) == 360 and sorted(bounded) == sorted(plain)


def test_light_encoding_moves_no_texts(spark, tmp_path):
    texts = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("c", 2, "x"), ("d", 3, None), ("e", 4, "")], TEXTS)
    encode, rows = HashEncoder(8).encode, lambda df: sorted((r["id"], r["pos"], tuple(r["embedding"])) for r in df.collect())
    expected = rows(store.encode_with_resume(spark, encode, texts, "document", str(tmp_path / "a")))
    store.encode_with_resume(spark, encode, texts.where("pos < 2"), "document", str(tmp_path / "b"), light=True)
    assert rows(store.encode_with_resume(spark, encode, texts, "document", str(tmp_path / "b"), width=8, light=True)) == expected and len(expected) == 5
    assert store.all_vectors(spark, str(tmp_path / "b")).count() == 3
