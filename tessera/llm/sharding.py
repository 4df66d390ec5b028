"""Shards of equal bytes by a k-d tree over the documents' metadata, in DataFrame operations only.

The tree splits the set of shards in halves and the documents with it, until each leaf is a shard and holds its target bytes. A node takes the metadata dimension in which it is widest and cuts it at the weighted quantile that gives both sides the bytes of their shards. The quantile is exact: a node's order is by coordinate, then by a hash of row and id, and each pass sums the bytes by the next 16 bits of that order, for all nodes of a level at once, until one row is left at the cut. What lies before that row goes to the low side, and with it one of the rest: the one whose size comes closest to the bytes still missing there, if that is closer than nothing. So a cut is off by less than half of the smallest difference in size that one row can make, at any number of documents. All rows go through the tree.

Coordinates have 32 bits. A numeric column is scaled to its range; null, NaN and infinities are its least value. Other columns are ordered by the bytes of their values, so that each value takes up its share of the range: values are put in 2**16 buckets by hash, which are few enough to sort at any number of values, and null is a value. Ties in size go by hash, then by row.

Null text has 0 bytes. Very long texts are rows like others; a shard is at least as large as its largest text. Rows that repeat, and equal texts, are placed each: the law is bytes, and no row is tied to another. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import staged

DIGIT = 16
#: The order's columns and the shifts of their digits.
_PARTS = (("dim", (16, 0)), ("_hash", (48, 32, 16, 0)))
_KEY = sum(len(shifts) for _, shifts in _PARTS)
_TOP = (1 << 32) - 1
#: Rows that one task numbers, unless there would be over 10,000 such chunks a shard.
_CHUNK = 100_000


@dataclass
class _Node:
    first: int
    last: int  # not included
    bytes: int
    spans: dict[str, tuple[int, int]]  # bounds of what it holds, by dimension
    dim: str = ""
    wanted: int = 0
    before: int = 0
    key: list[int] = field(default_factory=list)  # the digits of the cut
    moved: int = -1  # the row from after the cut that goes to the low side
    low: "_Node | None" = None
    high: "_Node | None" = None

    @property
    def middle(self) -> int:
        return (self.first + self.last) // 2


def _digits(dim: str) -> list[Column]:
    return [F.shiftrightunsigned(F.col(dim if name == "dim" else name), s).bitwiseAND(F.lit((1 << DIGIT) - 1)) for name, shifts in _PARTS for s in shifts]


def _before_cut(node: _Node) -> Column:
    """Whether a row's place in the node's order is before the cut, whose unknown digits are 0."""
    key = iter(node.key + [0] * (_KEY - len(node.key)))
    (_, dim_shifts), (_, hash_shifts) = _PARTS
    cut, cut_hash = sum(next(key) << s for s in dim_shifts), sum(next(key) << s for s in hash_shifts)
    return (F.col(node.dim) < cut) | ((F.col(node.dim) == cut) & (F.col("_hash") < cut_hash))


def _leaf(node: _Node) -> Column:
    """The first shard of the leaf, or of the open node, that a row falls into."""
    if node.low is None:
        return F.lit(node.first)
    low = _before_cut(node) if node.moved < 0 else _before_cut(node) | (F.col("_uid") == node.moved)
    return F.when(low, _leaf(node.low)).otherwise(_leaf(node.high))


def _open(node: _Node) -> list[_Node]:
    if node.low is not None:
        return _open(node.low) + _open(node.high)
    return [node] if node.last - node.first > 1 else []


def coordinates(docs: DataFrame, dims: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """What the tree needs of each row, stored: _uid, _id, size, text_crc32, _hash and the coordinates, whose names come second."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = []
    for n, d in enumerate(dims):
        x = F.col(f"`{d}`")
        if isinstance(kinds[d], T.NumericType):
            x = x.cast("double")
            marks.append(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias(f"_raw{n}"))
        else:
            marks.append(F.pmod(F.xxhash64(x), F.lit(1 << DIGIT)).alias(f"_raw{n}"))
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *marks)
    rows = staged(rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_uid", "_id"), 2)), "sizes")
    numeric = [n for n, d in enumerate(dims) if isinstance(kinds[d], T.NumericType)]
    ends = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), *[f(f"_raw{n}").alias(f"{f.__name__}{n}") for n in numeric for f in (F.min, F.max)]).first()
    for n in range(len(dims)):
        if n in numeric:
            low, high = ends[f"min{n}"] or 0.0, ends[f"max{n}"] or 0.0
            # Halves, since the range itself may overflow.
            x = (F.col(f"_raw{n}") / 2 - low / 2) / max(high / 2 - low / 2, 5e-324)
            rows = rows.withColumn(f"_dim{n}", (F.least(F.coalesce(x, F.lit(0.0)), F.lit(1.0)) * _TOP).cast("long"))
        else:
            buckets = rows.groupBy(f"_raw{n}").agg(F.sum("size").alias("_bytes"))  # at most 2**16
            order = Window.orderBy(F.desc("_bytes"), f"_raw{n}").rowsBetween(Window.unboundedPreceding, -1)
            share = F.coalesce(F.sum("_bytes").over(order), F.lit(0)) / F.lit(float(max(ends["total"], 1)))
            rows = rows.join(F.broadcast(buckets.select(f"_raw{n}", (share * _TOP).cast("long").alias(f"_dim{n}"))), f"_raw{n}")
    names = [f"_dim{n}" for n in range(len(dims))]
    return staged(rows.select("_uid", "_id", "size", "text_crc32", "_hash", *names), "coordinates"), names


def _split(rows: DataFrame, root: _Node, names: list[str]) -> None:
    """Cut every open node of the tree."""
    nodes = {n.first: n for n in _open(root)}
    placed = rows.withColumn("_node", _leaf(root)).where(F.col("_node").isin(list(nodes)))
    for node in nodes.values():
        node.dim = max(names, key=lambda c: (node.spans[c][1] - node.spans[c][0], -names.index(c)))
        node.wanted = node.bytes * (node.middle - node.first) // (node.last - node.first)
        for shift in _PARTS[0][1]:  # digits in which all rows agree need no pass
            low, high = (x >> shift for x in node.spans[node.dim])
            if low != high:
                break
            node.key.append(low & (1 << DIGIT) - 1)
    waiting = {first for first, node in nodes.items() if node.bytes}
    while waiting:
        here, digit, need = F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("long")
        for first in waiting:
            node = nodes[first]
            parts = _digits(node.dim)
            mine = F.col("_node") == first
            inside = mine
            for part, at in zip(parts, node.key, strict=False):
                inside &= part == at
            here |= inside
            digit = F.when(mine, parts[len(node.key)]).otherwise(digit)
            need = F.when(mine, F.lit(node.wanted - node.before)).otherwise(need)
        sums = placed.where(here).groupBy("_node", digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("bytes").over(Window.partitionBy("_node").orderBy("digit"))  # of at most 2**16 digits a node
        cut = sums.withColumn("upto", upto).where(F.col("upto") >= need).groupBy("_node").agg(F.min(F.struct("digit", "bytes", "rows", "upto")).alias("cut"))
        for r in cut.select("_node", "cut.*").collect():
            node = nodes[r["_node"]]
            node.key.append(r["digit"])
            node.before += r["upto"] - r["bytes"]
            if r["rows"] == 1 or len(node.key) == _KEY:
                waiting.discard(r["_node"])
    low, gap = F.lit(True), F.lit(0)
    for first, node in nodes.items():
        mine = F.col("_node") == first
        low = F.when(mine, _before_cut(node)).otherwise(low)
        gap = F.when(mine, F.lit(node.wanted - node.before)).otherwise(gap)
    closest = F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "_hash", "_uid", "size", *names)).alias("closest")
    sides = placed.withColumn("_low", low).groupBy("_node", "_low").agg(F.sum("size").alias("bytes"), closest, *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).collect()
    of_side = {(r["_node"], r["_low"]): r for r in sides}
    for first, node in nodes.items():
        held = {side: of_side.get((first, side)) for side in (True, False)}
        spans = {side: {c: (r[f"min{c}"], r[f"max{c}"]) if r else (0, 0) for c in names} for side, r in held.items()}
        size = {side: r["bytes"] if r else 0 for side, r in held.items()}
        after = held[False]
        if after and after["closest"]["off"] < node.wanted - node.before:
            moved = after["closest"]
            node.moved = moved["_uid"]
            size[True] += moved["size"]
            size[False] -= moved["size"]
            for c in names:
                low_end, high_end = spans[True][c] if held[True] else (moved[c], moved[c])
                spans[True][c] = (min(low_end, moved[c]), max(high_end, moved[c]))
        node.low, node.high = _Node(node.first, node.middle, size[True], spans[True]), _Node(node.middle, node.last, size[False], spans[False])


def shard_documents(docs: DataFrame, dims: list[str], shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, size (UTF-8 bytes and 8), text_crc32, law, shard, slot (gapless from 0), grown_shard (null)."""
    rows, names = coordinates(docs, dims, id_col, text_col)
    ends = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).first()
    root = _Node(0, shards, ends["bytes"], {c: (ends[f"min{c}"] or 0, ends[f"max{c}"] or 0) for c in names})
    while _open(root):
        _split(rows, root, names)
    out = _numbered(rows.withColumn("shard", _leaf(root).cast("int")), ends["rows"], shards)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """slot: rows of a shard from 0 on. Chunks of a shard are numbered by themselves, after the rows of the chunks before."""
    chunks = max(1, min(count // (shards * _CHUNK), 10_000))
    rows = staged(rows.select("_uid", "_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("_uid"), F.lit(chunks)).alias("_chunk")), "sharded")
    sizes = rows.groupBy("shard", "_chunk").count()
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_uid"))
    return rows.withColumn("_number", number).join(F.broadcast(starts), ["shard", "_chunk"]).withColumn("slot", (F.col("_start") + F.col("_number") - 1).cast("long"))
