"""Exact search: the k documents of highest inner product for each query, ties to the earlier document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import first_of_each
from tessera.functions.vectors import sides
from tessera.sources.files import stored

#: So many bytes, a tile, are held by every task at a time: query vectors, which are sent to it, and the documents found.
BROADCAST_BYTES = 64 << 20
#: Bytes of a document that a task holds for a query: its row, its name, and their copies while rows are ranked.
HELD_BYTES = 256
#: One document in so many is searched first.
PILOT = 64
#: From so many documents on there is a second search of some before that of all.
MANY = 1 << 17
#: Scores are made for so many queries and documents at a time, 1 MB; the latter is a multiple of 8.
QUERY_TILE, DOC_TILE = 512, 512
#: Where more than one pair in so many is left by its bound, all of a tile are scored.
DENSE = 16
#: Rows that a task sends on at a time, or more.
FRAME_ROWS = 1 << 13
#: Tasks of a pass for each that runs at a time, at most; each takes a copy of the tile.
TASKS = 4
#: Bytes of pairs' vectors that are multiplied at a time.
PAIR_BYTES = 8 << 20
#: Vectors that are longer than this, or so many times longer than others, have no bounds.
LONGEST, OUTLIER = 1e15, 16.0
#: Axes hold a set of vectors if none of them has more than this share of its length beside them.
BESIDE = 1e-6
_HITS = "query_id string, doc_id string, doc_pos long, score float"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v) for v in column]).astype(np.float64) if len(column) else np.empty((0, 0))


def _lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def spanned(vectors: np.ndarray) -> np.ndarray | None:
    """Axes, as columns, that hold all vectors with bounds, if far fewer than the width do; products with these vectors are those of their places on the axes."""
    length = _lengths(vectors)
    some = vectors[(length <= LONGEST) & (length > 0)]
    if not len(some):
        return None
    some = some / _lengths(some)[:, None]
    values, axes = np.linalg.eigh(some.T @ some)
    axes = axes[:, values > 1e-13 * values[-1]]
    fits = axes.shape[1] <= vectors.shape[1] * 3 // 4 and _lengths(some - some @ axes @ axes.T).max() <= BESIDE
    return axes if fits else None


class _Tile:
    """Queries that are scored at a time, and the k best documents of each so far: (query, place, score, name) of rows. least: of each query a score that k documents are known to reach, or -inf."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, axes: np.ndarray | None):
        self.ids, self.queries, self.least = ids, queries, least
        length = _lengths(queries)
        self.bounded = bool((length <= LONGEST).all())
        self.heads = (queries if axes is None else queries @ axes).astype(np.float32) if self.bounded else None
        # What rounding to float, in the sums of a product of heads and in a score, and what lies beside the axes can make, for a document of length 1.
        self.slack = length * ((len(queries[0] if axes is None else axes[0]) + 8) * 2.0**-23 + (0 if axes is None else BESIDE))
        self.rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, object))
        self.more: list[tuple[np.ndarray, ...]] = []


class _Best:
    """The k best documents of each query so far: by score, NaN last, then by position.

    Products of floats along the queries' axes bound the scores; what can't reach a query's k-th score is out, and only the other pairs are scored in double. Vectors without bounds are scored with all others. Products, scores and rows are made and held in tiles of bounded size.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray, axes: np.ndarray | None):
        self.k, self.axes = k, axes
        order = np.argsort(~(_lengths(queries) <= LONGEST), kind="stable")  # queries without bounds share tiles
        self.tiles = [_Tile(ids[i], queries[i], least[i], axes) for i in (order[j : j + QUERY_TILE] for j in range(0, len(ids), QUERY_TILE))]
        self.part, self.mask = np.empty(QUERY_TILE * DOC_TILE, np.float32), np.empty(QUERY_TILE * DOC_TILE, bool)

    def add(self, docs: pd.DataFrame) -> None:
        vectors, pos, names = _matrix(docs["embedding"]), docs["pos"].to_numpy(), docs["id"].to_numpy(object)
        length = _lengths(vectors)
        finite = length[np.isfinite(length)]
        bounded = length <= min(LONGEST, OUTLIER * np.median(finite) if len(finite) else 0)
        for has, rows in ((True, np.flatnonzero(bounded)), (False, np.flatnonzero(~bounded))):
            for i in (rows[j : j + DOC_TILE] for j in range(0, len(rows), DOC_TILE)):
                x, longest = vectors[i], length[i].max()
                heads = np.zeros((x.shape[1] if self.axes is None else self.axes.shape[1], -(-len(i) // 8) * 8), np.float32)
                if has:
                    heads[:, : len(i)] = (x if self.axes is None else x @ self.axes).T
                for tile in self.tiles:
                    found = self._bounded(tile, heads, x, longest) if has and tile.bounded else None
                    q, d, score = found or self._all(tile, x)
                    if len(q):
                        tile.more.append((q, pos[i[d]], score, names[i[d]]))
                        if sum(len(m[0]) for m in tile.more) * 2 >= self.k * len(tile.ids):
                            self._rank(tile)

    def _bounded(self, tile: _Tile, heads: np.ndarray, x: np.ndarray, longest: float) -> tuple[np.ndarray, ...] | None:
        """(query, document, score) of the pairs that may count by their bounds; None if they are too many."""
        size = len(tile.ids) * heads.shape[1]
        part, mask = self.part[:size].reshape(len(tile.ids), -1), self.mask[:size].reshape(len(tile.ids), -1)
        np.matmul(tile.heads, heads, out=part)
        slack = tile.slack * longest + 1e-36  # floats below this one lose digits
        cut = tile.least - slack
        q, d = self._above(part, cut, mask, len(x))
        if len(q) * DENSE > size and len(x) > self.k:
            q, d = self._above(part, np.maximum(cut, np.partition(part[:, : len(x)], -self.k, axis=1)[:, -self.k] - 2 * slack), mask, len(x))
        if len(q) * DENSE > size:
            return None
        step = max(PAIR_BYTES // (16 * x.shape[1]), 1)
        score = [np.einsum("ij,ij->i", tile.queries[q[i : i + step]], x[d[i : i + step]]) for i in range(0, len(q), step)]
        score = np.concatenate([np.empty(0), *score]).astype(np.float32)
        some = score >= tile.least[q]
        return q[some], d[some], score[some]

    @staticmethod
    def _above(part: np.ndarray, cut: np.ndarray, mask: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, column), among the first n, of what isn't below its row's cut. Eight places are looked at in one."""
        np.greater_equal(part, np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None], out=mask)
        flat = mask.reshape(-1)
        at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
        q, d = np.divmod(at[flat[at]], part.shape[1])
        return q[d < n], d[d < n]

    def _all(self, tile: _Tile, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, document, score) of the pairs that may count, of all."""
        with np.errstate(all="ignore"):
            score = (tile.queries @ x.T).astype(np.float32)
        # What is below a query's k-th score is out, here or so far; equal ones stay until they are ranked.
        high = np.where(np.isnan(score), -np.inf, score)
        here = np.partition(high, -self.k, axis=1)[:, -self.k] if high.shape[1] > self.k else np.full(len(high), -np.inf)
        q, d = np.nonzero(high >= np.maximum(here, tile.least)[:, None])
        return q, d, score[q, d]

    def _rank(self, tile: _Tile) -> None:
        """Take what was found since into the tile's rows, and raise least."""
        q, pos, score, names = (np.concatenate(x) for x in zip(tile.rows, *tile.more, strict=True))
        void = np.isnan(score)
        order = np.lexsort([pos, np.where(void, 0, -score), void, q])
        ranked = q[order]
        order = order[np.arange(len(q)) - np.searchsorted(ranked, ranked) < self.k]
        tile.rows, tile.more = (q[order], pos[order], score[order], names[order]), []
        q, _, score, _ = tile.rows
        full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        tile.least[q[full]] = np.fmax(tile.least[q[full]], score[full])  # a NaN raises nothing

    def rows(self) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        for tile in self.tiles:
            self._rank(tile)
            q, *others = tile.rows
            held.append((tile.ids[q], *others))
            if tile is self.tiles[-1] or sum(len(x[0]) for x in held) >= FRAME_ROWS:
                ids, pos, score, names = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pd.DataFrame({"query_id": ids, "doc_id": names, "doc_pos": pos, "score": score})
                held = []


def search(queries: DataFrame, documents: DataFrame, k: int = 10, broadcast_bytes: int = BROADCAST_BYTES, query_rows: int = 1, pilot: int = PILOT) -> DataFrame:
    """queries (id, embedding), documents (id, pos, embedding) -> (query_id, rank, doc_id, doc_pos, score), rank from 1.

    k is cut to the number of documents; a query gets no row only if there is no document. Scores are sums in double, given and compared as float.

    Documents stay where they are. Queries are cut into tiles that, with the k documents that a task holds for each, take broadcast_bytes, or query_rows if that is more, and a pass takes a tile to all documents. Some documents are kept aside and searched first, in no more tasks than run at a time: one in `pilot`, then one in its square root. The k-th score found among fewer is one that all others have to reach, so tasks send on little more than what counts. Their rows meet in two steps.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = queries.select(F.col("id").cast("string").alias("id"), "embedding")
    documents = documents.select(F.col("id").cast("string").alias("id"), F.col("pos").cast("long").alias("pos"), "embedding")
    count, n_documents, width = sides(queries, documents)
    tiles = -(-count // max(broadcast_bytes // (16 * (width or 1) + HELD_BYTES * k), query_rows, 1))
    if tiles > 1:
        queries = stored(queries, "queries")
    order = [F.when(~F.isnan("score"), F.col("score")).desc_nulls_last(), "doc_pos"]
    slots, pilots = queries.sparkSession.sparkContext.defaultParallelism, []
    if pilot and n_documents >= 2 * k * pilot:
        one_in = lambda docs, n: docs.where(F.pmod(F.xxhash64("pos"), F.lit(n)) == 0)
        root = math.isqrt(pilot)
        more = n_documents >= MANY and 1 < root < pilot == root * root
        some = stored(one_in(documents, root if more else pilot), "pilot").coalesce(slots)
        pilots = [one_in(some, pilot), *([some] if more else [])]

    def hits(docs: DataFrame, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, axes: np.ndarray | None) -> DataFrame:
        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(ids, vectors, k, least, axes)
            for batch in batches:
                if len(batch):
                    best.add(batch)
            yield from best.rows()

        return first_of_each(docs.mapInPandas(block, _HITS), ["query_id"], order, k)

    out = None
    for n in range(tiles):
        local = (queries.where(F.pmod(F.xxhash64("id"), F.lit(tiles)) == n) if tiles > 1 else queries).toPandas()
        if not len(local):
            continue
        ids, vectors = local["id"].to_numpy(object), _matrix(local["embedding"])
        least, axes = np.full(len(ids), -np.inf), spanned(vectors)
        for few in pilots:
            known = hits(few, ids, vectors, least, axes).where((F.col("rank") == k) & ~F.isnan("score")).select("query_id", "score").toPandas()
            reached = local["id"].map(dict(zip(known["query_id"], known["score"], strict=True))).to_numpy(np.float32)
            # The same pair's score may differ in its last digit from one product to another.
            least = np.fmax(least, np.nextafter(reached, np.float32(-np.inf)))
        found = hits(documents.coalesce(TASKS * slots), ids, vectors, least, axes).select("query_id", "rank", "doc_id", "doc_pos", "score")
        if tiles > 1:
            found = stored(found, "hits")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else queries.sparkSession.createDataFrame([], "query_id string, rank int, doc_id string, doc_pos long, score float")
