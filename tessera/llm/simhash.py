"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprint: texts are lower-cased (A-Z), split at ASCII white space into words and into shingles of `words` words, repeats included (fewer words: the whole sequence; none or null: fingerprint zero, linked like any other). A bit is 1 if set in over half the shingles' XXH64 (seed 42).

Links: distinct fingerprints at `distance` (2) or fewer differing bits. The 64 bits are four blocks; two differing bits leave two blocks alone, so linked fingerprints share one of six masked patterns of 32 bits. These patterns are the index's upper nodes, and fingerprints are dealt out by them. In a node they are sorted by Gray rank, and every run of FAN neighbours, and of FAN such runs, and so on, is a node with the pattern of bits that all its members share. A pair of nodes is pruned as soon as the differences of their shared bits add up to more than `distance`. A node with over HOT fingerprints is dealt again by pairs of blocks of its other 32 bits; what then shares 48 bits are at most 2**16 fingerprints. No pair is written out: each node gives at most one link per member, to its class's smallest.

Near copies by similarity: a fingerprint of 64 bits tells apart only copies that differ by a few shingles. near_dedup, which takes five words and a similarity of 0.8, uses fingerprints of `bits` (1024) bits of the same kind, but each distinct shingle counts once, since similarity is that of sets. Their angle estimates the cosine of two texts' shingles; texts whose shingle sets have Jaccard similarity s, and about the same size, have cosine 2s / (1 + s), so a similarity is a number of differing bits. The index above is used over their first 64 bits: each of its components is a node. What it can't tell shares an upper node of another kind, the MinHash bands: the least of the text's shingles in each of five orders, in 20 bands. Two texts agree on one order with a chance that is their similarity, so 0.8, 0.85, 0.9 share a band with a chance of 99.96, 99.999 and 99.99999 %, however many texts there are and however few shingles they have. A node's members are compared by all their bits: pairs far enough within the similarity join classes at once. The index's components and every fourth band go first, with these sure pairs alone; then the components and all bands. Pairs of different classes that aren't sure are never written out: a node gives its members that have one, and their shingle sets meet in one task a group, which decides each pair and gives the links that join the group's classes. A pair is left out only if its fingerprints differ by more than a true pair's do with a chance of 1e-9 (by Chernoff's bound, on bits that differ with the chance of the limit at most), and never if a text has fewer than FEW shingles. A node of many texts is no task's: at first its members link to a few pivots of it, in linear time, which makes a family of copies one class; then what is of other classes meets all the rest in cells, which Spark deals out. Nothing is left out; rows written are the texts times the bands at most, times the cells of a large node; comparisons inside tasks are the size of the node times the texts outside of its largest class.

Rows that repeat link like copies, also where they repeat an id with another text: texts are told apart by their hash. Null ids take part in near_groups, where a component's id is its smallest non-null one; near_dedup keeps them. Null and empty texts are texts without words, and near copies of each other. Very long texts are read whole, in steps of bounded memory. Ties don't arise: the smallest id of a group stays. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import left_join_groups, shared_dir, staged
from tessera.llm.components import components, joined, merged

SEED = 42
HOT = 4096
FAN = 8
_CHUNK = 1 << 16
#: Bands of near_dedup, and least shingles in each.
BANDS, ROWS = 20, 5
#: Texts with fewer distinct shingles are told apart by these alone.
FEW = 64
#: A node over NODE texts has so many of them as pivots.
NODE, PIVOTS = 1024, 16
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp) of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), words) for t in batch.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), fps], names=["_id", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(hashed, f"_id {docs.schema[id_col].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of (n, w) 64-bit words: rows are added in pairs, bit plane by bit plane."""
    planes = [words]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.vstack([p, np.zeros_like(p[:1])]) for p in planes]
        carry = np.zeros_like(planes[0][0::2])
        sums = []
        for p in planes:
            x, y = p[0::2], p[1::2]
            differ = x ^ y
            sums.append(differ ^ carry)
            carry = x & y | carry & differ
        planes = [*sums, carry]
    bits = np.unpackbits(np.concatenate(planes).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    return (bits << np.arange(len(planes))[:, None]).sum(0)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8"))


def _mixed(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    mixed = hashes[:, None] * odd
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


def wide_fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """The SimHash of `bits` bits of the distinct shingles: each one's XXH64 is mixed with an odd number per 64 bits."""
    odd = 2 * np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += bit_counts(_mixed(hashes[i : i + 4096], odd))
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def nodes_of(hashes: np.ndarray) -> list[int]:
    """The nodes, one per band, of a text with these shingles: a band's node is a hash of the least shingle in each of ROWS orders of its own."""
    least = np.full(len(_ODD), ~np.uint64(0))
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, _mixed(hashes[i : i + 1024], _ODD).min(0))
    return [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, ROWS))]


def chance(similarity: float, bands: int = BANDS) -> float:
    """That two texts of this Jaccard similarity share a node. The number of texts doesn't count."""
    return 1 - (1 - similarity**ROWS) ** bands


def text_hash(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """(_id, th, fp, nodes, few) of each row: th is a hash of the text, fp is binary, few says that there are fewer than FEW shingles."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), words) for t in batch.column("_text")]
            fps = pa.array([wide_fingerprint(h, bits) for h in hashes], pa.binary())
            nodes = np.array([nodes_of(h) for h in hashes], np.uint64).reshape(-1, BANDS).view(np.int64)
            few = pa.array([len(h) < FEW for h in hashes], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("th"), fps, pa.array(list(nodes), pa.list_(pa.int64())), few], names=["_id", "th", "fp", "nodes", "few"])

    rows = docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("th"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(hashed, f"_id {docs.schema[id_col].dataType.simpleString()}, th long, fp binary, nodes array<long>, few boolean")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def classes(fps: np.ndarray, distance: int, pairs: list[np.ndarray] | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint, in Gray order, the index of its class's smallest member. pairs: gets linked pairs (2, n) that join the classes. labels: the classes known before."""
    labels = np.arange(len(fps)) if labels is None else labels
    levels = [(fps, np.full(len(fps), ~np.uint64(0)))]  # of (pattern, mask of the bits that all share)
    width = FAN
    while len(levels[-1][0]) > FAN:
        starts = np.arange(0, len(fps), width)
        both, either = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        levels.append((both, ~(both ^ either)))
        width *= FAN
    top = len(levels[-1][0])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(top), np.arange(top), indexing="ij"))
    waiting = [(len(levels) - 1, a[a <= b], b[a <= b])]
    while waiting:
        level, a, b = waiting.pop()
        pattern, mask = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
        a, b = a[near], b[near]
        if level == 0:
            if pairs is not None:
                pairs.append(joined(labels, a, b, np.bitwise_count(fps[a] ^ fps[b])))
            labels = merged(labels, a, b)
            continue
        below = len(levels[level - 1][0])
        for i in range(0, len(a), _CHUNK // FAN**2):
            x = np.repeat(a[i : i + _CHUNK // FAN**2, None] * FAN + np.arange(FAN), FAN, axis=1)
            y = np.tile(b[i : i + _CHUNK // FAN**2, None] * FAN + np.arange(FAN), (1, FAN))
            fit = (x <= y) & (y < below)
            waiting.append((level - 1, x[fit], y[fit]))
    return labels


def _node_links(distance: int):
    """Over rows (node, part, fp), sorted by node and part: links (a, b) of each member to the smallest of its class there."""

    def links(node: np.ndarray, part: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        edges = np.flatnonzero((node[1:] != node[:-1]) | (part[1:] != part[:-1])) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(node)]])
        out = [np.empty((2, 0), np.uint64)]
        for k in np.flatnonzero(stops - starts > 1):
            own = fps[starts[k] : stops[k]].view(np.uint64)
            own = own[np.argsort(gray_rank(own))]
            labels = classes(own, distance)
            child = labels != np.arange(len(own))
            out.append(np.stack([own[child], own[labels[child]]]))
        pairs = np.concatenate(out, axis=1).view(np.int64)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("node", "part", "fp"), strict=True)]
            if len(held[0]):
                last = int(np.argmax((held[0] == held[0][-1]) & (held[1] == held[1][-1])))  # the last node may go on in the next batch
                yield links(*(h[:last] for h in held)) if last else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
                held = [h[last:] for h in held]
        if len(held[0]):
            yield links(*held)

    return linked


def _bits(column: str, start: int, width: int):
    return F.shiftrightunsigned(column, start).bitwiseAND(F.lit((1 << width) - 1))


def _under_pairs(rows: DataFrame, column: str, width: int, name: str) -> DataFrame:
    """Each row six times: name is a pair of the four blocks of column, with their bits; rest holds the other two blocks."""
    block = [_bits(column, i * width, width) for i in range(4)]
    forms = []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        k, l = ({0, 1, 2, 3} - {i, j})  # noqa: E741
        pattern = F.lit(n << 2 * width).bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j])
        forms.append(F.struct(pattern.cast("long").alias(name), F.shiftleft(block[k], width).bitwiseOR(block[l]).cast("long").alias("rest")))
    return rows.withColumn("_form", F.explode(F.array(*forms))).select(*[c for c in rows.columns if c != "rest"], "_form.*")


def links(distinct: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): links that join exactly the fingerprints (column fp, distinct) that the distance joins, directly or not."""
    if distance > 2:
        raise ValueError("two of four blocks are left alone only by two or fewer differing bits")
    dealt = _under_pairs(distinct.select("fp"), "fp", 16, "node")
    sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot)
    sizes = staged(sizes, "hot-nodes")
    n_hot = sizes.count()
    cold = dealt.withColumn("part", F.lit(-1).cast("long"))
    if n_hot:
        marked = dealt.join(F.broadcast(sizes), "node", "left") if n_hot <= 100_000 else left_join_groups(dealt, sizes, "node", "_size", 6 * distinct.count())
        again = _under_pairs(marked.where(F.col("_size").isNotNull()).drop("_size"), "rest", 8, "part")
        cold = marked.where(F.col("_size").isNull()).withColumn("part", F.lit(-1).cast("long")).drop("_size").unionByName(again)
    rows = cold.select("node", "part", "fp").repartition("node", "part").sortWithinPartitions("node", "part")
    return rows.mapInPandas(_node_links(distance), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, hot: int = HOT) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (the component's smallest id)."""
    prints = staged(fingerprints(docs, id_col, text_col, words).withColumnRenamed(id_col, "_id"), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("_size"), F.min("_id").alias("_least")), "distinct-fingerprints")
    joined = components(links(distinct, distance, hot)).withColumnRenamed("node", "fp")
    known = distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = known.groupBy("component").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_members"))
    groups = staged(left_join_groups(known, least.where("_members > 1"), "component", "_members", distinct.count()).select("fp", "_size", F.coalesce("component_id", "_least").alias("component_id")), "near-groups")
    out = left_join_groups(prints, groups, "fp", "_size", prints.count())
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pairs_between(words: np.ndarray, labels: np.ndarray, sure: int, most: int, few: np.ndarray | None = None) -> np.ndarray:
    """(a, b, apart) of a node's members, which are rows of 64-bit words: pairs at `sure` or fewer differing bits that join their classes (labels[x] is the smallest member of x's class), and all others at `most` or fewer whose classes stay apart. A pair merges classes only once it is sure. few: members whose pairs count however much they differ."""
    common = np.bincount(labels).argmax()
    rest = np.flatnonzero(labels != common)
    columns, place = np.ascontiguousarray(words.T), np.full(len(words), -1)
    place[rest] = np.arange(len(rest))
    few = np.zeros(len(words), bool) if few is None else few
    found, doubtful = [np.empty((3, 0), np.int64)], []
    step = max(1, _CHUNK // len(words))
    for i in range(0, len(rest), step):
        block = rest[i : i + step]
        apart = np.zeros((len(block), len(words)), np.int16)
        for c in columns:
            apart += np.bitwise_count(c[block, None] ^ c)
        x, b = np.nonzero(((apart <= most) | few[block, None] | few) & (labels[block, None] != labels) & ((place < 0) | (place > place[block, None])))
        a, apart = block[x], apart[x, b].astype(np.int64)
        near = apart <= sure
        # The distance is found again from the pair, since joined() gives the pairs alone.
        kept = joined(labels, a[near], b[near], apart[near])
        found.append(np.concatenate([kept, np.bitwise_count(words[kept[0]] ^ words[kept[1]]).sum(1, dtype=np.int64)[None]]))
        labels = merged(labels, a[near], b[near])
        doubtful.append(np.stack([a, b, apart])[:, ~near])
    return np.concatenate(found + [d[:, labels[d[0]] != labels[d[1]]] for d in doubtful], axis=1)


def _node_pairs(sure: int, most: int, members: bool = False):
    """Over rows (node, key, known, fp), sorted by node: pairs_between() of keys, known being their class. With (home, twin, nodes) too, a pair that isn't sure is given once: in the first band node that both are in, home being this row's, and in one cell of that, where twins, other than 0, differ. members: of these pairs, rows (member, group, node) are given instead, groups being what the pairs join in a node; sure pairs are (a, b, null)."""

    def pairs_of(node: np.ndarray, key: np.ndarray, known: np.ndarray, fps: np.ndarray, home=None, twin=None, nodes=None, few=None) -> pd.DataFrame:
        edges = np.flatnonzero(node[1:] != node[:-1]) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(node)]])
        out, grouped = [np.empty((3, 0), np.int64)], [np.empty((3, 0), np.int64)]
        words = np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1)
        few = np.zeros(len(fps), bool) if few is None else few.astype(bool)
        bands = None if nodes is None else np.frombuffer(b"".join(nodes), ">i8").reshape(len(nodes), -1).T

        def add(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
            if bands is not None:
                first = np.full(len(a), -1)
                for band in bands[::-1]:
                    first = np.where(band[a] == band[b], band[a], first)
                here = (apart <= sure) | (first == home[a]) & ((twin[a] == 0) | (twin[a] != twin[b]))
                a, b, apart = a[here], b[here], apart[here]
            if members:
                open_ = apart > sure
                x, y = a[open_], b[open_]
                a, b, apart = a[~open_], b[~open_], apart[~open_]
                some, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                group = merged(np.arange(len(some)), *at.reshape(2, -1))
                grouped.append(np.stack([key[some], key[some[group]], node[some]]))
            out.append(np.stack([key[a], key[b], apart]))

        two = starts[stops - starts == 2]
        apart = np.bitwise_count(words[two] ^ words[two + 1]).sum(1, dtype=np.int64)
        near = (known[two] != known[two + 1]) & ((apart <= most) | few[two] | few[two + 1])
        add(two[near], two[near] + 1, apart[near])
        for k in np.flatnonzero(stops - starts > 2):
            part = slice(starts[k], stops[k])
            _, first, place = np.unique(known[part], return_index=True, return_inverse=True)
            if len(first) > 1:
                a, b, apart = pairs_between(words[part], first[place], sure, most, few[part])
                add(a + starts[k], b + starts[k], apart)
        a, b, apart = np.concatenate(out, axis=1)
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": apart})
        if not members:
            return pairs
        x, group, node = np.concatenate(grouped, axis=1)
        both = [pairs.drop(columns="apart").assign(node=0, sure=True), pd.DataFrame({"a": x, "b": group, "node": node, "sure": False})]
        return pd.concat(both, ignore_index=True)

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            rows = [batch[c].to_numpy() for c in batch.columns]
            held = [np.concatenate(parts) for parts in zip(held, rows, strict=True)] if held else rows
            last = int(np.argmax(held[0] == held[0][-1])) if len(held[0]) else 0
            if last:
                yield pairs_of(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if held and len(held[0]):
            yield pairs_of(*held)

    return paired


def bits_apart(similarity: float, bits: int) -> int:
    """The expected number of differing bits of two texts of this Jaccard similarity."""
    return round(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_apart(similarity: float, bits: int, chance: float = 1e-9) -> int:
    """The differing bits that a pair of this Jaccard similarity or more exceeds with at most this chance: by Chernoff's bound for bits that differ with the chance that bits_apart() takes, or less."""
    p = bits_apart(similarity, bits) / bits
    for m in range(int(p * bits) + 1, bits):
        q = m / bits
        if bits * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))) >= -np.log(chance):
            return m
    return bits


def _shared(distinct: DataFrame, bands: list[int]) -> DataFrame:
    """(node, key, known, _size): distinct (key, known, nodes) in each node of these bands that holds more than one class."""
    dealt = staged(distinct.select(F.explode(F.array(*[F.get("nodes", F.lit(n)) for n in bands])).alias("node"), "key", "known"), "dealt")
    sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("_size"), F.min("known").alias("_low"), F.max("known").alias("_high"))
    sizes = staged(sizes.where("_low < _high").select("node", "_size"), "shared-nodes")
    return left_join_groups(dealt, sizes, "node", "_size", dealt.count()).where(F.col("_size").isNotNull())


def _pivot_links(rows: DataFrame, fps: DataFrame, sure: int) -> DataFrame:
    """rows (node, key, _size) of large nodes -> (a, b, apart): links of each member to its node's closest pivot and to the first one, at `sure` or fewer differing bits. A node's members are dealt out in groups of about NODE, each with the node's pivots."""
    groups = F.ceil(F.col("_size") / NODE).cast("long")
    members = rows.join(fps, "key").select("node", F.pmod(F.xxhash64("key"), groups).alias("group"), "key", "fp")
    drawn = rows.groupBy("node", F.pmod(F.xxhash64("key", "node"), F.lit(PIVOTS)).alias("_slot")).agg(F.min("key").alias("key"), F.max("_size").alias("_size")).join(fps, "key")
    drawn = staged(drawn, "pivots").select("node", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"), "key", "fp")

    def words_of(fps: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1)

    def linked(part: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"a": [], "b": [], "apart": []}, dtype=np.int64)
        pivots = pivots.sort_values("key")
        keys, key, words = pivots["key"].to_numpy(), part["key"].to_numpy(), words_of(part["fp"])
        apart = np.stack([np.bitwise_count(words ^ w).sum(1, dtype=np.int64) for w in words_of(pivots["fp"])], axis=1)
        apart[key[:, None] == keys] = 1 << 30
        out = []
        for at in (apart.argmin(1), (apart <= sure).argmax(1)):
            d = apart[np.arange(len(key)), at]
            out.append(np.stack([key, keys[at], d])[:, d <= sure])
        a, b, d = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": d})

    return members.groupBy("node", "group").cogroup(drawn.groupBy("node", "group")).applyInPandas(linked, "a long, b long, apart long").distinct()


def _cells(rows: DataFrame, most: int) -> DataFrame:
    """rows (node, key, known) of large nodes, known being their class -> (node, key, known, home, twin), node being a cell of about `most` members and home the node: any two of a node that are of different classes meet in a cell. Those that meet in several have the same twin in all of these but one, in which both have 0.

    A node's largest class and the rest of it are each dealt out by the key's hash into chunks; a cell holds one chunk of each, or two of the rest. So only the rest's number counts more than once.
    """
    per = rows.groupBy("node", "known").agg(F.count(F.lit(1)).alias("_n"))
    per = per.groupBy("node").agg(F.max(F.struct("_n", "known")).alias("_core"), F.sum("_n").alias("_all"))
    chunks = lambda n: F.ceil(n / F.lit(max(most // 2, 1))).cast("int")
    per = per.select("node", F.col("_core.known").alias("_common"), chunks(F.col("_core._n")).alias("_c"), chunks(F.col("_all") - F.col("_core._n")).alias("_r"), "_all").where("_r > 0")
    per = staged(per, "large-nodes")
    rows = left_join_groups(rows, per, "node", "_all", rows.count()).where(F.col("_r").isNotNull())
    core = F.col("known") == F.col("_common")
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("key", "node"), F.when(core, F.col("_c")).otherwise(F.col("_r"))).cast("int"))
    # Two of a chunk of the rest meet in each of its cells; that with the core's first chunk is the one that counts.
    cell = lambda x, y, twin=0: F.struct(F.xxhash64("node", x, y).alias("node"), F.lit(twin).alias("twin"))
    own = F.col("_chunk") + 1
    beside = F.transform(F.sequence(F.lit(0), F.col("_r") - 1), lambda j: cell(F.col("_chunk"), F.col("_c") + j))
    under = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda i: cell(i, F.col("_c") + F.col("_chunk"), F.when(i == 0, 0).otherwise(own)))
    others = F.filter(F.sequence(F.lit(0), F.col("_r") - 1), lambda j: j != F.col("_chunk"))
    across = F.transform(others, lambda j: cell(F.col("_c") + F.least(j, "_chunk"), F.col("_c") + F.greatest(j, "_chunk"), own))
    rows = rows.select(F.explode(F.when(core, beside).otherwise(F.concat(under, across))).alias("_cell"), "key", "known", F.col("node").alias("home"))
    return rows.select("_cell.node", "key", "known", "home", "_cell.twin")


def _close_pairs(distinct: DataFrame, bands: list[int], sure: int, most: int, node: int, pivots: bool = False, members: bool = False) -> DataFrame:
    """(a, b, apart): keys of distinct (key, known, fp, nodes) that share a node of these bands, known being their class: enough pairs at `sure` or fewer differing bits to join what they join, and all others at `most` or fewer between classes that those leave apart in a node. Nodes over `node` members give links to pivots only, or else are dealt again in cells. members: (a, b, node, sure), see _node_pairs()."""
    rows = staged(_shared(distinct, bands), "shared")
    # The members' band nodes go along, so that each unsure pair counts once.
    once = not pivots
    packed = F.unhex(F.array_join(F.transform("nodes", lambda n: F.lpad(F.hex(n), 16, "0")), ""))
    fps = distinct.select("key", "fp", *([packed.alias("nodes"), F.col("few") if "few" in distinct.columns else F.lit(False).alias("few")] if once else []))
    large = rows.where(F.col("_size") > node)
    rows = rows.where(F.col("_size") <= node).select("node", "key", "known", F.col("node").alias("home"), F.lit(0).alias("twin"))
    found = None
    if not large.isEmpty():
        if pivots:
            found = _pivot_links(large.select("node", "key", "_size"), fps, sure)
        else:
            rows = rows.unionByName(_cells(large.drop("_size"), node))
    rows = rows.join(fps, "key").select("node", "key", "known", "fp", *(["home", "twin", "nodes", "few"] if once else [])).repartition("node").sortWithinPartitions("node")
    if members:
        return staged(rows.mapInPandas(_node_pairs(sure, most, True), "a long, b long, node long, sure boolean"), "close-members")
    pairs = rows.mapInPandas(_node_pairs(sure, most), "a long, b long, apart long").distinct()
    return staged(pairs if found is None else pairs.unionByName(found), "close-pairs")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(key, text) -> (key, set): the distinct shingles' hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "set"])

    return rows.mapInArrow(hashed, "key long, set array<long>")


def _verified(similarity: float):
    """Over rows (node, group, key, known, set), sorted by node and group: links (a, b) that join what pairs of this similarity join in a group, known being the members' classes."""

    def links(key: np.ndarray, known: np.ndarray, sets: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        _, first, place = np.unique(known, return_index=True, return_inverse=True)
        labels, marked, out = first[place], np.zeros(ids.max() + 1, np.int64), [np.empty((2, 0), np.int64)]
        for i in range(len(key) - 1):
            if (labels[i + 1 :] == labels[i]).all():
                continue
            own = ids[starts[i] : starts[i + 1]]
            marked[own] = 1
            shared = np.add.reduceat(marked[ids[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
            marked[own] = 0
            linked = (shared / (sizes[i] + sizes[i + 1 :] - shared) >= similarity) & (labels[i + 1 :] != labels[i])
            b = i + 1 + np.flatnonzero(linked)
            b = b[np.unique(labels[b], return_index=True)[1]]  # one link a class
            out.append(np.stack([np.full(len(b), key[i]), key[b]]))
            labels = merged(labels, np.full(len(b), i), b)
        return np.concatenate(out, axis=1)

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            node, group = rows["node"].to_numpy(), rows["group"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((node[1:] != node[:-1]) | (group[1:] != group[:-1])) + 1]) if len(rows) else [0]
            yield from each(rows, edges)
            held = rows.iloc[edges[-1] :]  # the last group may go on in the next batch
        if held is not None and len(held):
            yield from each(held, [0, len(held)])

    def each(rows: pd.DataFrame, edges) -> Iterator[pd.DataFrame]:
        columns = [rows[c].to_numpy() for c in ("key", "known", "set")]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            a, b = links(*(c[i:j] for c in columns))
            yield pd.DataFrame({"a": a, "b": b})

    return verified


def _texts_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(key, text) of keys (key, least, th): the text of that id and hash."""
    side = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    return docs.select(F.col(id_col).alias("least"), text_hash(text_col).alias("th"), F.col(text_col).alias("text")).join(side, ["least", "th"]).select("key", "text")


def _with_index(distinct: DataFrame) -> DataFrame:
    """distinct, with a further node behind the bands: the component that the Gray-order index finds among the fingerprints' first 64 bits."""
    rows = distinct.drop("_size").withColumn("_short", F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long"))
    short = staged(rows.select(F.col("_short").alias("fp"), "key"), "short-fingerprints")
    sizes = staged(short.groupBy("fp").agg(F.count(F.lit(1)).alias("_size")), "distinct-short")
    groups = sizes.join(components(links(sizes)).withColumnRenamed("node", "fp"), "fp", "left").select(F.col("fp").alias("_short"), "_size", F.coalesce("component", "fp").alias("_component"))
    found = left_join_groups(rows, groups, "_short", "_size", short.count())
    return found.withColumn("nodes", F.concat("nodes", F.array(F.xxhash64(F.lit(BANDS), "_component")))).drop("_short", "_size", "_component")


def similar_links(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bits: int, broadcast_rows: int, node: int = NODE) -> DataFrame:
    """(a, b): links between keys of distinct (key, fp, nodes, few, least, th), least and th being the id and the text's hash of a document with that fingerprint."""
    edge = bits_apart(similarity, bits)
    sure, most = edge - round(2.5 * np.sqrt(edge * (1 - edge / bits))), most_apart(similarity, bits)
    distinct = staged(_with_index(distinct), "indexed")
    first = _close_pairs(distinct.select("key", F.col("key").alias("known"), "fp", "nodes"), [*range(0, BANDS, 4), BANDS], sure, sure, node, pivots=True)

    def labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.join(known.toDF("key", "known"), "key", "left").withColumn("known", F.coalesce("known", "key"))

    known = components(first.select("a", "b"))
    found = _close_pairs(staged(labelled(distinct.select("key", "fp", "nodes", "few"), known), "labelled"), list(range(BANDS + 1)), sure, most, node, members=True)
    links = known.toDF("a", "b").unionByName(found.where("sure").select("a", "b"))
    known = components(links)
    members = staged(labelled(found.where("not sure").select("node", F.col("b").alias("group"), F.col("a").alias("key")), known), "unsure-members")
    apart = members.groupBy("node", "group").agg(F.min("known").alias("_low"), F.max("known").alias("_high")).where("_low < _high").select("node", "group")
    members = staged(members.join(apart, ["node", "group"], "left_semi"), "open-members")
    asked = staged(members.select("key").distinct().join(distinct.select("key", "least", "th"), "key"), "asked")
    sets = staged(shingle_sets(_texts_of(docs, asked, id_col, text_col, broadcast_rows), words), "shingle-sets").dropDuplicates(["key"])
    rows = members.join(sets, "key").select("node", "group", "key", "known", "set").repartition("node", "group").sortWithinPartitions("node", "group")
    return staged(links.unionByName(rows.mapInPandas(_verified(similarity), "a long, b long")), "found-links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 1024, broadcast_rows: int = 1_000_000, node: int = NODE) -> DataFrame:
    """The rows of docs but those that link, directly or not, to one of a smaller id; rows of one id stay or go together, and rows of null id stay."""
    prints = staged(wide_fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words, bits), "wide-fingerprints")
    same = prints.groupBy("fp").agg(F.min(F.struct("_id", "th", "nodes", "few")).alias("_one"), F.count(F.lit(1)).alias("_size"))
    same = same.select("fp", F.col("_one._id").alias("least"), "_one.th", "_one.nodes", "_one.few", "_size")
    distinct = staged(same.withColumn("key", F.monotonically_increasing_id()), "distinct-wide")
    total = distinct.count()
    linked = components(similar_links(docs, distinct, id_col, text_col, words, similarity, bits, broadcast_rows, node)).withColumnRenamed("node", "key")
    known = staged(distinct.drop("fp", "nodes", "th", "few").join(linked, "key"), "linked")
    sizes = known.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("_members"))
    first = left_join_groups(known, sizes, "component", "_members", total).select("key", "first")
    groups = distinct.join(first, "key", "left").where(F.col("first").isNotNull() | (F.col("_size") > 1)).select("fp", "_size", F.coalesce("first", "least").alias("first"))
    groups = staged(groups, "wide-groups")
    gone = left_join_groups(prints, groups, "fp", "_size", prints.count()).where(F.col("_id") > F.col("first"))
    gone = staged(gone.select(F.col("_id").alias(id_col)).distinct(), "near-copies")
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(side, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
