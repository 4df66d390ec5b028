"""Hard-negative mining: for each anchor and each of its best positives, the best rows of another label whose score lies within a share of the positive's.

Components become floor(scale * x). Vectors are rotated to the principal axes of the data, which changes no inner product; the first `head` rotated components give a partial product, and the norms of what is left, with slack for rounding, bound the rest. Pairs that can't count are discarded by these bounds, and all others are verified by whole products of integers.

Passes. Anchors are cut into tiles of tile_bytes; a tile goes to all tasks, and the rows stay where they are. A pass looks for a tile's positives, a second one for its negatives. Each pass begins with a pilot over one row in `pilot`: the k-th best that it finds is a threshold which no later row below it can pass, so tasks send on little more than what counts. Each task keeps k rows an anchor (or an anchor and positive) at most, in order, so neither ties nor a hot label or vector make more; the tasks' rows meet in two steps.

An anchor's positives are its first n_positive other rows of the same label: highest score first, ties by the smaller id, null ids last. Its negatives for a positive of score p are the first n_negative rows of other labels with low * p <= score <= high * p, in integers (so none if p is negative). Rows take no part if label or vector is null, or if a component is null or not finite; missing components of shorter vectors count as zero. Rows that repeat an id, or id and vector, are rows of their own, as anchors too. An anchor without positives, or a positive without negatives, gives no row. Scores beyond 64 bits count as the nearest that they can hold. Empty tables give no rows. Labels and ids are integers; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import first_of_each, staged
from tessera.llm.topk import pair_scores, rotation, scaled, vector_matrix

#: Anchors and rows whose bounds are held at once.
ANCHOR_STEP, ROW_STEP = 1024, 1024
_HITS = "slot long, id long, none boolean, uid long, score long"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LONG = 1 << 63


@dataclass
class Wanted:
    """What a tile's anchors look for. Each anchor has `per` slots; a slot takes scores from low to high, and of those its k best that reach least."""

    same: bool
    per: int
    k: int
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


class _Kept:
    """The k best rows of each slot, by score, then by id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.empty((5, 0), np.int64)  # slot, id, none, uid, score

    def add(self, found: np.ndarray, least: np.ndarray) -> None:
        """found: further rows. least: raised to the k-th score of a slot that has k."""
        rows = np.concatenate([self.rows, found], axis=1)
        slot, ids, none, uid, score = rows
        rows = rows[:, np.lexsort([uid, ids, none, ~score, slot])]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, place < self.k]
        last = rows[:, place == self.k - 1]
        least[last[0]] = np.maximum(least[last[0]], last[4])


def survivors(q: np.ndarray, q_label: np.ndarray, x: np.ndarray, x_label: np.ndarray, basis: np.ndarray, head: int, same: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs, of the same label or not, that the bounds don't rule out: by a score surely below an anchor's low or above its high."""
    with np.errstate(all="ignore"):
        q_rot, x_rot = q @ basis, x @ basis
        longest = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
        part = q_rot[:, :head] @ x_rot[:, :head].T
        rest = np.outer(np.linalg.norm(q_rot[:, head:], axis=1), np.linalg.norm(x_rot[:, head:], axis=1)) + 1e-9 * longest + 1e-3
        # Bounds that aren't numbers, of huge vectors, rule nothing out.
        out = (part + rest < low[:, None]) | (part - rest > high[:, None])
        huge = ~(longest < 2.0**52)
        a, b = np.nonzero((~out | huge) & ((q_label[:, None] == x_label) == same))
        return a, b, pair_scores(q[a], x[b], huge[a, b])


def _search(anchors: tuple[np.ndarray, np.ndarray, np.ndarray], basis: np.ndarray, head: int, wanted: Wanted):
    """The best rows of each slot in a task. anchors: uid, label and vectors of a tile, sorted by label."""
    uid, label, vectors = anchors

    def found_in(part: pd.DataFrame, kept: list[_Kept], least: np.ndarray) -> None:
        part = part.sort_values("label", kind="stable")
        x, x_label = vector_matrix(part["v"], len(basis)), part["label"].to_numpy()
        none = part["_id"].isna().to_numpy()
        ids, x_uid = part["_id"].fillna(0).to_numpy(np.int64), part["_uid"].to_numpy()
        for n, i in enumerate(range(0, len(uid), ANCHOR_STEP)):
            own = slice(i, i + ANCHOR_STEP)
            q_label = label[own]
            slots = np.arange(i, i + len(q_label))[:, None] * wanted.per + np.arange(wanted.per)
            # Both sides are sorted, so rows of labels that the anchors lack are two slices.
            first, last = (np.searchsorted(x_label, q_label[0]), np.searchsorted(x_label, q_label[-1], "right")) if wanted.same else (0, len(x))
            for j in range(first, last, ROW_STEP):
                rows = slice(j, min(j + ROW_STEP, last))
                floor = np.maximum(wanted.low[slots], least[slots])
                a, b, score = survivors(vectors[own], q_label, x[rows], x_label[rows], basis, head, wanted.same, floor.min(1).astype(float), wanted.high[slots].max(1).astype(float))
                b = b + j
                other = uid[own][a] != x_uid[b]
                a, b, score = a[other], b[other], score[other]
                for p in range(wanted.per):
                    slot = slots[a, p]
                    fits = (score >= np.maximum(wanted.low[slot], least[slot])) & (score <= wanted.high[slot])
                    if fits.any():
                        kept[n].add(np.stack([slot[fits], ids[b[fits]], none[b[fits]], x_uid[b[fits]], score[fits]]), least)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, least = [_Kept(wanted.k) for _ in range(0, len(uid), ANCHOR_STEP)], wanted.least.copy()
        for batch in batches:
            if len(batch):
                found_in(batch, kept, least)
        for each in kept:
            slot, ids, none, x_uid, score = each.rows
            yield pd.DataFrame({"slot": slot, "id": pd.array(ids, "Int64").copy(), "none": none.astype(bool), "uid": x_uid, "score": score})

    return search


def _share(score: np.ndarray, times: int, over: int, up: bool) -> np.ndarray:
    """times * score / over, rounded up or down, by Python's integers; what 64 bits can't hold is cut."""
    whole = [-(-int(s) * times // over) if up else int(s) * times // over for s in score.tolist()]
    return np.array([min(max(x, -_LONG), _LONG - 1) for x in whole], np.int64)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, n_positive: int = 5, n_negative: int = 10, low: int = 30, high: int = 90, head: int = 16, tile_bytes: int = 64 << 20, pilot: int = 64) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. low and high are in hundredths of the positive's score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("label"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"), F.monotonically_increasing_id().alias("_uid"))
    rows = staged(rows.where("v is not null and label is not null"), "scaled-vectors")
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    padded = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    n_anchors = rows.where("_anchor").count()
    if not n_anchors:
        return spark.createDataFrame([], _OUT)
    basis = rotation(padded, width)
    tiles = -(-n_anchors * width * 8 // tile_bytes)
    candidates = padded.select("_id", "label", "v", "_uid")
    few = candidates.where(F.pmod(F.xxhash64("_uid"), F.lit(pilot)) == 0)
    order = [F.desc("score"), "none", "id", "uid"]

    def hits(anchors, wanted: Wanted) -> DataFrame:
        """(slot, place, id, uid, score) of a tile: first of a few rows, whose k-th scores then hold for all."""
        size = len(wanted.least)
        start = first_of_each(few.mapInPandas(_search(anchors, basis, head, wanted), _HITS), ["slot"], order, wanted.k)
        start = start.groupBy("slot").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == wanted.k).toArrow()
        wanted.least[start["slot"].to_numpy()] = start["score"].to_numpy()
        assert len(wanted.least) == size
        best = first_of_each(candidates.mapInPandas(_search(anchors, basis, head, wanted), _HITS), ["slot"], order, wanted.k)
        return staged(best.withColumn("id", F.when(~F.col("none"), F.col("id"))).drop("none"), "hits")

    out = None
    for n in range(tiles):
        own = padded.where(F.col("_anchor") & (F.pmod(F.xxhash64("_uid"), F.lit(tiles)) == n)).toPandas().sort_values(["label", "_uid"])
        if not len(own):
            continue
        anchors = own["_uid"].to_numpy(), own["label"].to_numpy(), vector_matrix(own["v"], width)
        lowest, highest = np.full(len(own), -_LONG), np.full(len(own), _LONG - 1)
        positives = hits(anchors, Wanted(True, 1, n_positive, lowest, highest, lowest.copy()))
        # At most n_positive a row of the tile.
        held = positives.select("slot", "_n", "score").toArrow()
        if not len(held):
            continue
        slot = held["slot"].to_numpy() * n_positive + held["_n"].to_numpy() - 1
        at_least, at_most = np.full(len(own) * n_positive, _LONG - 1), np.full(len(own) * n_positive, -_LONG)  # without a positive nothing fits
        at_least[slot], at_most[slot] = _share(held["score"].to_numpy(), low, 100, True), _share(held["score"].to_numpy(), high, 100, False)
        negatives = hits(anchors, Wanted(False, n_positive, n_negative, at_least, at_most, np.full(len(at_least), -_LONG)))
        ids = spark.createDataFrame([(i, None if x is None or x != x else int(x)) for i, x in enumerate(own["_id"].astype(object).tolist())], "anchor long, anchor_id long")
        pairs = positives.select((F.col("slot") * n_positive + F.col("_n") - 1).alias("slot"), F.col("slot").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = negatives.select("slot", F.col("_n").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        found = staged(found.join(pairs, "slot").join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _OUT) if out is None else out
