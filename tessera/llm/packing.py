"""Best-fit packing of documents into token sequences, with certified repacking.

A document is its tokens and an end token. Only documents of over `capacity` tokens are cut, into pieces of `capacity`, of which the first may be shorter. Whole pieces are sequences of their own; the others are dealt at random to parts of about part_rows pieces, and each part is packed by best-fit decreasing.

Dual feasible functions bound from below how many sequences a part needs. A part that is within a fiftieth of a sequence of its bound is certified and final. One with a gap keeps its well-filled sequences and gives its loosest to a pool: several times those whose free room covers the gap. The pool is dealt to new parts, of four times the pieces, so that documents of different parts meet, and packed again by best-fit decreasing. A round that saves nothing is not used, and a deal of fewer parts is tried; this ends when nothing is given, when the pool was one part, or when `rounds` are over. certificate() says how far the whole is from its own bound.

Null text is empty and gives the end token alone. Pieces of one length are ordered by row and piece, so ties don't change the result. Rows that repeat an id are packed as documents of their own. Very long texts are cut like others, whole. An empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.tokens import encoder

_PIECES = "_uid long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = ["_id", *(x.split()[0] for x in _PIECES.split(", "))]
#: Sequence ids: the round in the top bits, then the part, then the sequence in the part. Whole pieces have a round of their own.
_ROUND, _PART, _WHOLE = 58, 24, 31
#: A part is certified if it needs at most so many sequences more than its bound. One with a gap gives so many times the sequences that the gap needs, and so many more, for documents to choose from.
_SLACK, _TIMES, _MORE = 0.02, 8, 64
#: No part of a pool has over about this many times part_rows pieces.
_LARGEST = 16


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row per piece: id_col, _uid (of the row of docs), piece, start, length, ids_crc32, and ids if with_ids."""
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = docs.schema[id_col].dataType
    schema = f"_id {id_type.simpleString()}, {_PIECES}" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, json_path).ids
        for batch in batches:
            row, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
            kept: list[np.ndarray] = []
            for i, text in enumerate(batch.column("_text")):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for n, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + capacity] if n else ids[:first]
                    row.append(i)
                    for name, value in zip(out, (n, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        out[name].append(value)
                    if with_ids:
                        kept.append(part.astype(np.int32))
            taken = batch.select(["_id", "_uid"]).take(pa.array(row, pa.int64()))
            columns = [*taken.columns, pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            names = ["_id", "_uid", *out]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)


def _bounds(count: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """Bounds on the sequences that count[x] pieces of length x need, by dual feasible functions, as (numerator, denominator)."""
    size = np.arange(capacity + 1, dtype=np.int64)
    yield int(count @ size), capacity
    # Pieces over capacity - e fill a sequence, those below e take no room, for any e up to half.
    sums, counts = np.cumsum(count * size), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        large = counts[capacity] - counts[capacity - e]
        yield int(large) * capacity + int(sums[capacity - e] - sums[e - 1]), capacity
    # Rounding to k-ths: floor((k + 1) x) / k, and x itself where (k + 1) x is whole.
    for k in range(1, 21):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        yield int(count @ weight), k * capacity


def bound_of(count: np.ndarray, capacity: int) -> tuple[int, float]:
    """The best bound, rounded up, and as it is."""
    found = list(_bounds(count, capacity))
    return max(-(-n // d) for n, d in found), max(n / d for n, d in found)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound on the number of sequences that some dual feasible functions give."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)[0]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's sequence, from 0, and its offset there."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room r
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        sequence[i], offset[i] = at, capacity - room
        by_room[room - length].append(at)
        rooms |= 1 << (room - length)
    return sequence, offset


def _pack_part(rows: pd.DataFrame, capacity: int, code: int, alone: bool) -> pd.DataFrame:
    """One part, packed; released marks what it gives to the pool, unless it is alone: the loosest sequences, for what it needs more than its bound, which isn't rounded up, since parts together may need less than one by one."""
    rows = rows.sort_values(["length", "_uid", "piece"], ascending=[False, True, True])
    lengths = rows["length"].to_numpy()
    sequence, offset = best_fit(lengths, capacity)
    room = capacity - np.bincount(sequence, weights=lengths).astype(np.int64)
    gap = len(room) - bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)[1]
    give = np.zeros(len(room), bool)
    if gap > _SLACK and not alone:
        loosest = np.argsort(-room, kind="stable")
        needed = int(np.searchsorted(np.cumsum(room[loosest]), gap * capacity)) + 1
        give[loosest[: _TIMES * needed + _MORE]] = True
    part = int(rows["_part"].iloc[0])
    return rows.assign(sequence_id=(code << _ROUND) + (part << _PART) + sequence, offset=offset, released=give[sequence])


def _pack(rows: DataFrame, total: int, code: int, capacity: int, part_rows: int) -> DataFrame:
    parts = max(1, round(total / part_rows))
    names = [*_COLUMNS, "sequence_id", "offset", "released"]
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, {_PIECES}, sequence_id long, offset long, released boolean"

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_part(pdf, capacity, code, parts == 1)[names]

    dealt = rows.select(*_COLUMNS, F.pmod(F.xxhash64("_uid", "piece", F.lit(code)), F.lit(parts)).alias("_part"))
    return staged(dealt.groupBy("_part").applyInPandas(packed, schema), f"packed-{code}")


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = 1024, part_rows: int = 32_000, rounds: int = 8) -> DataFrame:
    """Places for pieces(): its columns, sequence_id and offset. cut is read more than once, so give a stored table."""
    if not 0 <= rounds < _WHOLE:
        raise ValueError(f"rounds must be from 0 to {_WHOLE - 1}")
    cut = cut.withColumnRenamed(id_col, "_id")
    whole = cut.where(F.col("length") == capacity).select(*_COLUMNS, (F.monotonically_increasing_id() + F.lit(_WHOLE << _ROUND)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < capacity)
    placed = _pack(short, short.count(), 0, capacity, part_rows)
    final = [placed.where("not released")]
    pool = placed.where("released")
    many = 4 * part_rows
    n, sequences = pool.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
    for code in range(1, rounds + 1):
        if not n:
            break
        again = _pack(pool, n, code, capacity, many)
        if again.select("sequence_id").distinct().count() < sequences:
            final.append(again.where("not released"))
            pool = again.where("released")
            n, sequences = pool.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        elif n < 1.5 * many:  # it was one part: another deal is the same one
            break
        else:
            many = min(4 * many, _LARGEST * part_rows)  # fewer parts, since each leaves a gap of its own
    out = whole
    for rows in [*final, pool]:
        out = out.unionByName(rows.drop("released"))
    if "ids" in cut.columns:
        out = out.join(cut.select("_uid", "piece", "ids"), ["_uid", "piece"])
    return out.drop("_uid").withColumnRenamed("_id", id_col)


def certificate(packed: DataFrame, capacity: int = 1024) -> dict[str, int]:
    """Of packed rows (length, sequence_id): the sequences, the bound that no packing can go below, and the gap between them. At most `capacity` counts come to the driver."""
    counts = {r["length"]: r["count"] for r in packed.groupBy("length").count().collect()}
    sequences = packed.select("sequence_id").distinct().count()
    bound = bound_of(np.array([counts.get(x, 0) for x in range(capacity + 1)], np.int64), capacity)[0]
    return {"sequences": sequences, "bound": bound, "gap": sequences - bound}


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, part_rows: int = 32_000, rounds: int = 8, with_ids: bool = False, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids."""
    cut = staged(pieces(docs, id_col, text_col, capacity, end_id, with_ids, ranks_path, json_path), "pieces")
    out = pack(cut, id_col, capacity, part_rows, rounds)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
