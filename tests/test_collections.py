import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import beir


def collection(folder, corpus, queries, qrels):
    (folder / "qrels").mkdir(parents=True)
    write = lambda name, rows: (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    write("corpus.jsonl", corpus)
    write("queries.jsonl", queries)
    for split, lines in qrels.items():
        (folder / "qrels" / f"{split}.tsv").write_text("\n".join(["query-id\tcorpus-id\tscore", *lines]))


def test_toy(spark, tmp_path):
    collection(tmp_path / "toy" / "toy", [{"_id": "d1", "title": "T", "text": "body"}], [{"_id": "q1", "text": "question"}], {"test": ["q1\td1\t1"]})
    d = beir.load_dataset(spark, "TOY", str(tmp_path))
    assert d.split == "test" and [r[0] for r in d.query_texts().collect()] == ["question"]
    assert d.corpus_documents().first().asDict() == {"doc_id": "d1", "title": "T", "text": "body", "pos": 0}
    assert [tuple(r)[:3] for r in d.qrels.collect()] == [("q1", "d1", 1)]
    assert d.samples().first()["relevant_doc_ids"] == ["d1"]


def test_corpus_alone(spark, tmp_path):
    (tmp_path / "toy").mkdir()
    (tmp_path / "toy" / "corpus.jsonl").write_text('{"_id": "d1", "text": "x"}\n')
    assert [r["doc_id"] for r in beir.load_corpus(spark, "toy", str(tmp_path)).collect()] == ["d1"]


def test_rows_of_a_corpus(spark, tmp_path):
    rows = [{"_id": "d1", "text": "a"}, "", "  ", {"_id": "d2", "title": None, "text": "b"}, {"id": 7, "text": 1.5}, {"_id": None, "id": "z", "text": 0}, {"_id": "f", "title": False, "text": "false"}, {"_id": "d1", "text": "c"}]
    (tmp_path / "c.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    got = [(r["doc_id"], r["title"], r["text"]) for r in beir.read_corpus(spark, str(tmp_path / "c.jsonl")).orderBy("pos").collect()]
    assert got == [("d1", "", "c"), ("d2", "", "b"), ("7", "", "1.5"), ("z", "", ""), ("f", "", "false")]


def test_malformed_json_raises(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "d1"}\n{"_id": ')
    with pytest.raises(Exception, match="MALFORMED"):
        beir.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()


def test_query_keys(spark, tmp_path):
    rows = [{"_id": "a", "query": "old"}, {"id": "b", "text": None, "query": "q"}, {"_id": "c"}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [(r[0], r[1]) for r in beir.read_queries(spark, str(tmp_path / "q.jsonl")).orderBy("pos").collect()] == [("a", "old"), ("b", "q"), ("c", "")]


def test_qrels_lines(spark, tmp_path):
    lines = ["h1\td\t1", "q\td\t0.9", "q\te\t1.9", "q\tf\t1e0\tmore", "q\tg", "", "q\td2\t1\r", "q\te\t2"]
    (tmp_path / "t.tsv").write_bytes("\n".join(lines).encode())
    got = [(r["doc_id"], r["score"]) for r in beir.read_qrels(spark, str(tmp_path / "t.tsv")).orderBy("pos").collect()]
    assert got == [("d", 0), ("e", 2), ("f", 1), ("d2", 1)]  # the first line is lost, whatever it holds


def test_bad_grade_raises(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("h\nq\td\tx\n")
    with pytest.raises(Exception, match="CAST"):
        beir.read_qrels(spark, str(tmp_path / "t.tsv")).collect()


def test_order_over_files_and_splits(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.txt").write_text("".join(f"{n}-{i:04d}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = beir.numbered_lines(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["pos"] for r in rows] == list(range(1500))
    assert [r["value"] for r in rows] == [f"{n}-{i:04d}" for n in range(3) for i in range(500)]


def test_validation(spark, tmp_path):
    collection(
        tmp_path / "v", [{"_id": "d1", "text": "x"}], [{"_id": "q1", "text": "a"}, {"_id": "q2", "text": "b"}],
        {"gone": ["q1\tdX\t1"], "zero": ["q1\tdX\t0"], "unknown": ["q9\td1\t1"], "ok": ["q1\td1\t1"]},
    )
    root = str(tmp_path)
    with pytest.raises(ValueError, match="missing document"):
        beir.load_dataset(spark, "v", root, "gone")
    assert beir.load_dataset(spark, "v", root, "gone", missing_relevant_policy="keep").qrels.count() == 1
    assert beir.load_dataset(spark, "v", root, "zero").queries.count() == 1
    with pytest.raises(ValueError, match="unknown query: q9"):
        beir.load_dataset(spark, "v", root, "unknown")
    assert [r["query_id"] for r in beir.load_dataset(spark, "v", root, "ok").queries.collect()] == ["q1"]
    with pytest.raises(FileNotFoundError):
        beir.load_dataset(spark, "v", root, "absent")
    with pytest.raises(FileNotFoundError):
        beir.load_dataset(spark, "w", root)
    with pytest.raises(ValueError):
        beir.load_dataset(spark, "w", root, download=True)
    with pytest.raises(RuntimeError):
        beir.load_dataset(spark, "fiqa", root, download=True)
    with pytest.raises(ValueError):
        beir.load_dataset(spark, "v", root, "ok", missing_relevant_policy="drop")


def test_null_keys_as_text(spark, tmp_path):
    rows = [{"_id": None, "id": "z", "text": "a"}, {"id": None, "text": "b"}, {"id": 3, "text": None}, {"text": "c"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = lambda df: [tuple(r)[:-1] for r in df.orderBy("pos").collect()]
    assert got(beir.read_corpus(spark, str(tmp_path / "c.jsonl"), "text")) == [("None", "", "c"), ("3", "", "")]
    assert got(beir.read_queries(spark, str(tmp_path / "c.jsonl"), "text")) == [("None", "c"), ("3", "None")]
    assert got(beir.read_queries(spark, str(tmp_path / "c.jsonl")))[0] == ("z", "a")
    with pytest.raises(ValueError):
        beir.read_corpus(spark, str(tmp_path / "c.jsonl"), "else")


def test_first_places_pass_no_single_task(spark):
    rows = spark.range(0, 3000, 1, 4).select(F.concat(F.lit("d"), "id").alias("doc_id"), (F.col("id") * 7 + 5).alias("pos"))
    for n in (1, 15, 1500, 2999, 3000, 4000):
        some = beir.first_places(rows, n, size=100)
        assert sorted(r["pos"] for r in some.collect()) == [i * 7 + 5 for i in range(min(n, 3000))]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Exchange" not in plan


def test_a_collection_without_texts(spark, tmp_path):
    folder = tmp_path / "toy"
    (folder / "qrels").mkdir(parents=True)
    (folder / "corpus.jsonl").write_text('{"_id": "a", "text": "x"}\n{"_id": "b", "text": "y"}\n{"_id": "a", "text": "z"}\n')
    (folder / "queries.jsonl").write_text('{"_id": "q", "text": "x"}\n{"_id": "r", "text": "y"}\n')
    (folder / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t1\n")
    (folder / "qrels" / "train.tsv").write_text("query-id\tcorpus-id\tscore\nr\tb\t1\n")
    whole, bare = (beir.load_dataset(spark, "toy", str(tmp_path), once=True, texts=texts) for texts in (True, False))
    assert (bare.corpus.columns, bare.queries.columns) == (["doc_id", "pos"], ["query_id", "pos"])
    assert sorted(bare.corpus.collect()) == sorted(whole.corpus.select("doc_id", "pos").collect()) and bare.queries.collect() == whole.queries.select("query_id", "pos").collect()
    train = beir.load_split(spark, bare, str(tmp_path), "train")
    assert [tuple(r) for r in train.queries.collect()] == [("r", 1)] and train.corpus is bare.corpus


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("a\nb\nc\n")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = beir.numbered_lines(spark, str(tmp_path / "c.jsonl"))
        assert sorted(map(tuple, lines.collect())) == [("a", 0), ("b", 1), ("c", 2)]
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_are_encoded_where_they_are_parsed(spark, tmp_path, monkeypatch):
    from tessera.operators.encoders import HashEncoder
    from tessera.plans import pipelines
    from tessera.sources import store

    corpus = [{"_id": "a", "title": "T", "text": "x"}, {"_id": "b", "text": "y"}, {"_id": "a", "text": " z "}, {"_id": "c", "text": "y"}]
    collection(tmp_path / "toy", corpus, [{"_id": "q", "text": "x"}, {"_id": "r", "query": "y"}, {"_id": "q", "query": "w"}], {"test": ["q\ta\t1", "r\tb\t1"]})
    keep, kept = beir.stored, {}
    monkeypatch.setattr(beir, "stored", lambda df, name: kept.update({name: df}) or keep(df, name))
    runs = [pipelines.encode_dataset(spark, "toy", "hash", str(tmp_path), cache_root=f"{tmp_path}/cache") for _ in range(2)]
    assert runs[0] == runs[1] and (runs[0]["queries"], runs[0]["documents"]) == (2, 3)
    assert all("text" not in kept[n].columns and "query_text" not in kept[n].columns for n in ("queries", "corpus"))
    shuffled = [p.split("\n")[0] for p in kept["corpus"]._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1:]]
    assert shuffled and not any("title" in p for p in shuffled)
    plain = beir.load_dataset(spark, "toy", str(tmp_path))
    for n, (rows, kind) in enumerate(((pipelines.query_rows(plain), "query"), (pipelines.document_rows(plain.corpus), "document"))):
        got = sorted(map(tuple, store.load_store(spark, runs[0]["cache"])[n].collect()))
        assert got == sorted(map(tuple, HashEncoder().encode(rows, kind).collect()))
    assert store.all_vectors(spark, f"{runs[0]['cache']}/parts/document").count() == 2
    one = pipelines.encode_queries(spark, "toy", "hash", str(tmp_path), "test", cache_root=f"{tmp_path}/cache")
    assert (one["queries"], one["documents"]) == (2, 0) and kept["corpus"].columns == ["doc_id", "pos"]
