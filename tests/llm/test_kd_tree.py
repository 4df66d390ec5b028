"""Sharding against a k-d tree in plain Python."""

import collections
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

DIMS = ["source", "lang", "n_chars", "doc_id"]


def brute_tree(rows, names, first, last, spans, out):
    """rows: dicts. Sort a node's rows along its widest dimension, walk to the weighted quantile, and let the row of the closest size fill what is missing."""
    if last - first == 1:
        out.update({r["_uid"]: first for r in rows})
        return
    dim = max(names, key=lambda c: (spans[c][1] - spans[c][0], -names.index(c)))
    middle = (first + last) // 2
    gap = sum(r["size"] for r in rows) * (middle - first) // (last - first)
    order = sorted(rows, key=lambda r: (r[dim], r["_hash"]))
    low = []
    while order and order[0]["size"] < gap:
        gap -= order[0]["size"]
        low.append(order.pop(0))
    span = lambda part: {c: (min(r[c] for r in part), max(r[c] for r in part)) if part else (0, 0) for c in names}
    high = list(order)
    if high:
        closest = min(high, key=lambda r: (abs(r["size"] - gap), r["_hash"], r["_uid"]))
        if abs(closest["size"] - gap) < gap:
            high.remove(closest)
            low.append(closest)
    brute_tree(low, names, first, middle, span(low), out)
    brute_tree(high, names, middle, last, span(order), out)


@pytest.mark.parametrize("shards", [24, 5, 1])
@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_tree_equals_brute_force(spark, table, shards):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    stored, names = sharding.coordinates(docs, DIMS)
    rows = [r.asDict() for r in stored.collect()]
    want: dict = {}
    brute_tree(rows, names, 0, shards, {c: (min(r[c] for r in rows), max(r[c] for r in rows)) for c in names}, want)
    by_id = {r["_id"]: want[r["_uid"]] for r in rows}
    found = sharding.shard_documents(docs, DIMS, shards).collect()
    assert {r["doc_id"]: r["shard"] for r in found} == by_id
    held = collections.Counter()
    for r in found:
        held[r["shard"]] += r["size"]
    if table == "sf0.01":
        assert max(held.values()) / statistics.mean(held.values()) < 1.02


def test_values_lie_by_their_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (92 if i % 10 else 192), "rare" if i % 10 == 0 else None if i % 10 == 1 else "common", float("nan") if i == 3 else i * (1e308 / 99)) for i in range(100)], "doc_id long, text string, source string, weight double")
    stored, names = sharding.coordinates(docs, ["source", "weight"])
    places = sorted(dict(stored.groupBy("_id", names[0]).count().select("_id", names[0]).collect()).items())
    total = 100 * 100 + 10 * 100
    common, rare, null = places[2][1], places[0][1], places[1][1]
    assert [common, rare, null] == [0, int(80 * 100 / total * sharding._TOP), int((80 * 100 + 10 * 200) / total * sharding._TOP)]
    weights = dict(stored.select("_id", names[1]).collect())
    assert weights[3] == weights[0] == 0 and weights[99] == pytest.approx(sharding._TOP) and weights[50] == pytest.approx(sharding._TOP * 50 / 99, rel=1e-6)


def test_few_rows_equal_rows_and_one_giant(spark):
    for rows in ([], [(1, "a")], [(7, "same")] * 100, [(None, None)] * 48, [(1, "x" * 100_000), *((i, "y" * 10) for i in range(2, 60))]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = sharding.shard_documents(docs, ["doc_id"]).withColumn("n", F.lit(1)).collect()
        assert len(found) == len(rows)
        slots = collections.defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        if len(rows) in (48, 100):
            assert {len(s) for s in slots.values()} <= {2, 4, 5}
