import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx


@pytest.mark.parametrize("text", ["a", " a ", "\ta\n", " a　", "\x85a\x1c", "\x1f a b \x1d", "​a﻿", "", " "])
def test_strip_is_pythons(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(tx.strip(F.col("t"))).first()[0] == text.strip()


def test_document_text(spark):
    rows = spark.createDataFrame([("T", "b"), (None, "x"), ("T", None), (None, None)], "title string, text string")
    assert [r[0] for r in rows.select(tx.document_text(F.col("title"), F.col("text"))).collect()] == ["T\nb", "x", "T", ""]


def test_sanitize_before_template(spark):
    rows = spark.createDataFrame([("",), (" \t",), (None,), ("text",)], "t string")
    got = rows.select(tx.template("e5", tx.sanitize(F.col("t")), "query"), tx.template("e5", tx.sanitize(F.col("t")), "document")).collect()
    assert [tuple(r) for r in got] == [("query: [EMPTY]", "passage: [EMPTY]")] * 3 + [("query: text", "passage: text")]


def test_templates(spark):
    row = spark.createDataFrame([("t",)], "t string")
    one = lambda c: row.select(c).first()[0]
    assert one(tx.template("qwen3", F.col("t"), "query", "I")) == "Instruct: I\nQuery:t"
    assert one(tx.template("qwen3", F.col("t"), "query")).startswith("Instruct: Given a web")
    assert one(tx.template("qwen3", F.col("t"), "document")) == "t"
    assert one(tx.template("sentence-transformers", F.col("t"), "query", "I ")) == "I t"
    assert one(tx.template("bge-m3", F.col("t"), "query", "I ")) == "t"
    with pytest.raises(ValueError):
        tx.template("e5", F.col("t"), "passage")


def test_adapter_of():
    assert [tx.adapter_of(n) for n in ("a/E5", "Qwen3-x", "gte-b", "z")] == ["e5", "qwen3", "gte", "sentence-transformers"]


def test_normalize_and_product(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = rows.select(vx.l2_normalize(F.col("a")), vx.inner_product(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[0][1] == 11
    assert got[1][0] == [0.0, 0.0]


def test_widths(spark):
    two, three = (spark.createDataFrame([([1.0] * n,)], "embedding array<float>") for n in (2, 3))
    assert vx.check_widths(two, two) == 2
    assert vx.check_widths(two, two.limit(0)) == 2
    with pytest.raises(ValueError):
        vx.check_widths(two, three)


def test_weighted_centroid(spark):
    rows = spark.createDataFrame([("q", 1, [1.0, 0.0]), ("q", 3, [0.0, 1.0])], "k string, w int, embedding array<float>")
    assert vx.weighted_centroids(rows, "k", "w").first()["embedding"] == pytest.approx([0.25, 0.75])
    assert math.isclose(rows.select(vx.norm(F.col("embedding"))).first()[0], 1.0)


def test_centroids_are_sums_of_whole_vectors(spark):
    rows = spark.createDataFrame([("a", 2, [1.0, 0.0]), ("a", 1, [0.0, 3.0]), ("a", 0, [9.0, 9.0]), ("b", 0, [1.0, 1.0])], "k string, w int, embedding array<float>").repartition(3)
    found = vx.weighted_centroids(rows, "k", "w")
    assert [(r["k"], r["embedding"]) for r in found.collect()] == [("a", pytest.approx([2 / 3, 1.0]))]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_blank_is_what_strip_leaves_nothing_of(spark):
    spaces = [chr(c) for c in range(1 << 16) if chr(c).isspace()]
    texts = ["", *spaces, "".join(spaces), *[f"{s}a{s}" for s in spaces], "​", "\x00", "x" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.strip(F.col("t")), tx.is_blank(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(t, t.strip(), not t.strip()) for t in texts]


def test_a_text_is_hashed_once(spark):
    from tessera.operators.encoders import hash_vector

    plan = spark.createDataFrame([("a",)], "t string").select(hash_vector(F.col("t"), "query").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
