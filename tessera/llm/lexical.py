"""Ranked lexical search by a two-level quantised index.

Terms are the maximal runs of ASCII letters and digits and of anything beyond ASCII, in the whole text, with only A-Z lower-cased. N documents have a term, with L terms in all, repeats included; n is a document's terms, df the documents that hold a term, tf its occurrences in one. A term weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))), and a document's score is the sum over an item's distinct terms of w * impact, with impact = (10^9 tf) div (1000 tf + 8m) and m = 10 + (90 n N) div L, all in 64-bit integers.

Index. Documents are cut into blocks; a block's postings are sorted by term. An impact is below 10^6 whatever the document, so level one keeps it as a byte, rounded up to the next of 255 steps: from a byte alone a score has an upper and a lower bound. Level two keeps tf and n. A first pass reads the bytes and takes each item's k-th highest lower bound; the second reads them again and rescores, in integers, every document whose upper bound reaches it. Each task sends on at most k documents an item, and the tasks' rows meet in two steps, so neither ties nor copies of a document make more.

Items are the queries, each against all documents. They are dealt into tiles of about tile_terms terms, and each tile has an index of its terms: so what goes to every task (a tile's terms) is bounded, and documents are neither shuffled nor copied. Term statistics cover all documents.

Null and empty texts, and those without a term, have no score and don't count in N. Items without a known term give no rows; items that repeat, also by id, are items of their own. Ties go to the smaller doc_id, null last; rows that repeat a doc_id are rows of their own. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import clear_scratch, first_of_each, scratch_mark, staged, written_since

#: What separates terms becomes a space, A-Z small letters; bytes beyond ASCII stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
STEPS, TOP = 255, 10**6
_OUT = "item_id {}, rank int, doc_id {}, score long"
_BLOCK = "ids array<long>, n array<int>, term array<int>, doc array<int>, tf array<int>, n_docs long, n_terms long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, repeats included."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 10 + 90 * n.astype(np.int64) * n_docs // n_terms
    tf = tf.astype(np.int64)
    return 10**9 * tf // (1000 * tf + 8 * m)


def rounded_up(exact: np.ndarray) -> np.ndarray:
    """Impacts as bytes."""
    return (-(-exact * STEPS // TOP)).astype(np.uint8)


#: The most and the least impact that a byte stands for.
_MOST = np.arange(STEPS + 1, dtype=np.int64) * TOP // STEPS
_LEAST = np.where(_MOST > 0, np.roll(_MOST, 1) + 1, 0)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(vocabulary, block_docs: int, block_postings: int):
    """Over (uid, text): blocks of documents with the postings of the vocabulary's terms. Every document counts, also those that hold none of these."""

    def block(held: list) -> pa.RecordBatch:
        ids, n = [h[0] for h in held], [h[1] for h in held]
        term = np.concatenate([np.empty(0, np.int32), *(h[2] for h in held)])
        doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(h[2]) for h in held])
        tf = np.concatenate([np.empty(0, np.int32), *(h[3] for h in held)])
        order = np.lexsort([doc, term])
        columns = [np.array(ids, np.int64), np.array(n, np.int32), term[order], doc[order], tf[order]]
        arrays = [pa.ListArray.from_arrays([0, len(c)], c) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([len(ids)], pa.int64()), pa.array([int(np.sum(n, dtype=np.int64))], pa.int64())], names=["ids", "n", "term", "doc", "tf", "n_docs", "n_terms"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, postings = vocabulary.value, [], 0
        for batch in batches:
            for uid, text in zip(batch.column("uid"), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                own = [(known[t], c) for t, c in Counter(found).items() if t in known]
                pair = np.array(own, np.int32).reshape(-1, 2)
                held.append((uid.as_py(), len(found), pair[:, 0], pair[:, 1]))
                postings += len(own)
                if len(held) >= block_docs or postings >= block_postings:
                    yield block(held)
                    held, postings = [], 0
        if held:
            yield block(held)

    return blocks


def _flat(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False) if len(column) == 1 else column.flatten().to_numpy(zero_copy_only=False)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Each block's arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield {name: one.column(name).flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(one.column(name).type) else one.column(name)[0].as_py() for name in one.schema.names}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _rows(batches):
        term, df = np.unique(block["term"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df, pa.int64())], names=["term", "df"])


def _quantised(n_docs: int, n_terms: int):
    """Blocks with level one: a byte a posting."""

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n, doc, tf = (one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n", "doc", "tf"))
                code = rounded_up(impact(tf, n[doc], n_docs, n_terms))
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("ids", "n", "term", "doc", "tf")), pa.array([code.tobytes()], pa.binary())], names=["ids", "n", "term", "doc", "tf", "code"])

    return quantised


def _sums(block: dict[str, np.ndarray], starts: np.ndarray, stops: np.ndarray, weights: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each document of a block, the sum of weight * value over an item's postings. A term's documents differ, so they can be added at once."""
    total = np.zeros(len(block["ids"]), np.int64)
    for i, j, w in zip(starts, stops, weights, strict=True):
        total[block["doc"][i:j]] += w * value[i:j]
    return total


def _places(block: dict[str, np.ndarray], tile) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(item, starts, stops, weights): where a block's postings of each item's terms lie."""
    edges = np.searchsorted(block["term"], np.arange(len(tile["weights"]) + 1, dtype=np.int32))
    for item, terms in enumerate(tile["items"]):
        there = terms[edges[terms] < edges[terms + 1]]
        if len(there):
            yield item, edges[there], edges[there + 1], tile["weights"][there]


def _lower_bounds(tile, k: int):
    """Level one: (item, lower), the k highest lower bounds of each item in the task."""

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64) for _ in tile.value["items"]]
        for block in _rows(batches):
            value = _LEAST[np.frombuffer(block["code"], np.uint8)]
            for item, *where in _places(block, tile.value):
                found = _sums(block, *where, value)
                found = np.concatenate([best[item], found[found > 0]])
                best[item] = np.partition(found, -k)[-k:] if len(found) > k else found
        item = np.repeat(np.arange(len(best)), [len(b) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *best]), pa.int64())], names=["item", "lower"])

    return lower


def _rescored(tile, thresholds: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Both levels: (item, uid, score), the k best of the documents whose upper bound reaches the item's threshold."""

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty((2, 0), np.int64) for _ in tile.value["items"]]  # score, uid; uids rise with the order of ties
        for block in _rows(batches):
            most = _MOST[np.frombuffer(block["code"], np.uint8)]
            for item, starts, stops, weights in _places(block, tile.value):
                reach = _sums(block, starts, stops, weights, most) >= max(thresholds[item], 1)
                if not reach.any():
                    continue
                score = np.zeros(len(block["ids"]), np.int64)
                for i, j, w in zip(starts, stops, weights, strict=True):
                    at = i + np.flatnonzero(reach[block["doc"][i:j]])
                    doc = block["doc"][at]
                    score[doc] += w * impact(block["tf"][at], block["n"][doc], n_docs, n_terms)
                at = np.flatnonzero(score > 0)
                found = np.concatenate([best[item], np.stack([score[at], block["ids"][at]])], axis=1)
                best[item] = found[:, np.lexsort([found[1], -found[0]])[:k]]
        item = np.repeat(np.arange(len(best)), [b.shape[1] for b in best])
        score, uid = np.concatenate([np.empty((2, 0), np.int64), *best], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (item, uid, score)], names=["item", "uid", "score"])

    return rescored


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(terms, pa.list_(pa.binary()))], names=["key", "terms"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", tile_terms: int = 1_000_000, block_docs: int = 4096, block_postings: int = 1 << 19) -> DataFrame:
    """item_col, rank (from 1), id_col, score: the k documents of the highest scores above 0 of each item."""
    spark = docs.sparkSession
    names = staged(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("key")), "items")
    asked = staged(names.select("key", "text").mapInArrow(_item_terms, "key long, terms array<binary>").where(F.size("terms") > 0), "item-terms")
    tiles = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // tile_terms)
    # A document's key: its id where that is its own, so that a task's k best are the first by id, null last. 64-bit ids are their own order.
    rows = docs.select(F.col(id_col).cast("long").alias("uid"), F.col(text_col).alias("text"))
    out = None
    for n in range(tiles):
        own = asked.where(F.pmod(F.xxhash64("key"), F.lit(tiles)) == n).collect()
        if not own:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in own for t in r["terms"]}))}
        mark = scratch_mark()
        known = spark.sparkContext.broadcast(vocabulary)
        postings = staged(rows.withColumn("uid", F.coalesce("uid", F.lit((1 << 63) - 1))).mapInArrow(_blocks(known, block_docs, block_postings), _BLOCK), "postings")
        n_docs, n_terms = postings.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        df = postings.select("term").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weights = np.zeros(len(vocabulary), np.int64)
        weights[df["term"].to_numpy()] = [weight(x, n_docs) for x in df["df"].to_pylist()]
        index = staged(postings.drop("n_docs", "n_terms").mapInArrow(_quantised(n_docs, n_terms), "ids array<long>, n array<int>, term array<int>, doc array<int>, tf array<int>, code binary"), "index")
        tile = spark.sparkContext.broadcast({"items": [np.array(sorted(vocabulary[bytes(t)] for t in r["terms"]), np.int32) for r in own], "weights": weights})
        lower = index.select("ids", "term", "doc", "code").mapInArrow(_lower_bounds(tile, k), "item long, lower long")
        lower = first_of_each(lower, ["item"], [F.desc("lower")], k).where(F.col("_n") == k).toArrow()
        thresholds = np.zeros(len(own), np.int64)
        thresholds[lower["item"].to_numpy()] = lower["lower"].to_numpy()
        hits = index.mapInArrow(_rescored(tile, thresholds, n_docs, n_terms, k), "item long, uid long, score long")
        hits = first_of_each(hits, ["item"], [F.desc("score"), "uid"], k)
        keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(own)], "item long, key long")
        hits = staged(hits.join(keys, "item").select("key", F.col("_n").cast("int").alias("rank"), "uid", "score"), "ranked")
        clear_scratch(spark, written_since(mark)[:-1])
        out = hits if out is None else out.unionByName(hits)
    kind = docs.schema[id_col].dataType.simpleString()
    if out is None:
        return spark.createDataFrame([], _OUT.format(items.schema[item_col].dataType.simpleString(), kind).replace("item_id", item_col).replace("doc_id", id_col))
    doc = F.when(F.col("uid") < (1 << 63) - 1, F.col("uid")).cast(kind)
    return out.join(names.select("key", F.col("item").alias(item_col)), "key").select(item_col, "rank", doc.alias(id_col), "score")
