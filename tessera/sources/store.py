"""The embedding store: Parquet vectors keyed by what was encoded, so that an interrupted or repeated run encodes only what is missing."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import delete, exists, names_in, qualified, read_text, stored, write_text

MANIFEST, LOG = "manifest.json", "_commits"
#: Rows of a range of an ordered list.
RANGE = 1 << 20


# The keys and their order are part of the stores' names.
def cache_fingerprint(dataset: str, split: str, model, encoding_config: dict | None = None) -> str:
    """20 hex digits over the dataset, the split and all that shapes the vectors."""
    config = model.encoding_config if encoding_config is None else encoding_config
    known = {"dataset": dataset, "split": split, "model_id": model.model_id, "revision": model.revision, "dimension": int(model.dimension), "encoding_config": config}
    return hashlib.sha256(json.dumps(known, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()[:20]


def with_key(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))


def missing_texts(texts: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(text_key, text): the distinct texts of texts that stored (text_key, embedding) lacks."""
    wanted = with_key(texts).groupBy("text_key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    return wanted if stored is None else wanted.join(stored, "text_key", "left_anti")


_PART = "text_key string, embedding array<float>"


def _digest(part: DataFrame) -> dict:
    """What a commit says of a part: rows, widths, and a sum over keys and vectors."""
    mixed = F.xxhash64("text_key", "embedding").cast("decimal(38,0)")
    n, low, high, total = part.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding")), F.sum(mixed)).first()
    return {"rows": n, "width": [low, high], "digest": str(total or 0)}


def commits(spark: SparkSession, path: str) -> dict[str, dict]:
    """The parts of a path that were finished, by name, with what was said of them."""
    return {name.removesuffix(".json"): json.loads(read_text(spark, f"{path}/{LOG}/{name}")) for name in names_in(spark, f"{path}/{LOG}") if name.endswith(".json")}


def good_parts(spark: SparkSession, path: str, width: int | None = None) -> list[str]:
    """The committed parts that hold what their commit says: all rows, with vectors of one width (this one, if given), unchanged. Files that are gone or can't be read count as rows that are missing.

    All parts are looked at in one pass.
    """
    said = commits(spark, path)
    if not said:
        return []
    read = spark.read.schema(_PART).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    there = [name for name in said if exists(spark, f"{path}/{name}")]
    if not there:
        return []
    rows = read.parquet(*[f"{path}/{name}" for name in there]).select("text_key", "embedding", F.regexp_extract("_metadata.file_path", r"/(part-[0-9a-f]+)/[^/]*$", 1).alias("part"))
    mixed = F.xxhash64("text_key", "embedding").cast("decimal(38,0)")
    sums = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.sum(mixed).alias("total")).collect()
    found = {r["part"]: {"rows": r["n"], "width": [r["low"], r["high"]], "digest": str(r["total"] or 0)} for r in sums}
    empty = {"rows": 0, "width": [None, None], "digest": "0"}
    return sorted(name for name in there if found.get(name, empty) == said[name] and (not said[name]["rows"] or said[name]["width"] == [width or said[name]["width"][0]] * 2))


def all_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(text_key, embedding) of all committed parts, as they are."""
    return spark.read.schema(_PART).parquet(*[f"{path}/{name}" for name in commits(spark, path)])


def forget(spark: SparkSession, path: str, name: str) -> None:
    """Take a part out of the log."""
    delete(spark, f"{path}/{LOG}/{name}.json")


def stored_vectors(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(text_key, embedding) of the good parts; a text that two writers stored is there once."""
    good = good_parts(spark, path, width)
    return _vectors_in(spark, path, good).dropDuplicates(["text_key"]) if good else spark.createDataFrame([], _PART)


def _vectors_in(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    return spark.read.schema(_PART).parquet(*[f"{path}/{name}" for name in parts])


def _commit(spark: SparkSession, vectors: DataFrame, path: str, width: int | None) -> None:
    """Write (text_key, embedding) as a part of its own, and what is in it to the log."""
    name = f"part-{uuid.uuid4().hex}"
    vectors.write.parquet(f"{path}/{name}")
    said = _digest(spark.read.schema(_PART).parquet(f"{path}/{name}"))
    if width is not None and said["rows"] and said["width"] != [width] * 2:
        raise ValueError(f"the encoder gave vectors of width {said['width'][0]} to {said['width'][1]} instead of {width}")
    write_text(spark, f"{path}/{LOG}/{name}.json", json.dumps(said))


def with_vectors(texts: DataFrame, encode: Callable[[DataFrame, str], DataFrame], kind: str) -> DataFrame:
    """texts (id, pos, text) -> (id, pos, text_key, embedding), each text encoded where it is."""
    keyed = with_key(texts).select(F.struct("id", "text_key").alias("id"), "pos", F.coalesce("text", F.lit("")).alias("text"))
    return encode(keyed, kind).select("id.id", "pos", "id.text_key", "embedding")


def keep_vectors(spark: SparkSession, rows: DataFrame, path: str, width: int | None = None) -> DataFrame:
    """with_vectors() rows -> (id, pos, embedding); of equal texts' vectors one is kept at path, if it is missing. The rows are read twice."""
    made = rows.select("text_key", "embedding").dropDuplicates(["text_key"])
    if good := good_parts(spark, path, width):
        made = made.join(_vectors_in(spark, path, good).select("text_key"), "text_key", "left_anti")
    _commit(spark, made, path, width)
    return rows.select("id", "pos", "embedding")


def encode_with_resume(spark: SparkSession, encode: Callable[[DataFrame, str], DataFrame], texts: DataFrame, kind: str, path: str, chunks: int = 1, width: int | None = None, light: bool = False) -> DataFrame:
    """texts (id, pos, text) -> (id, pos, embedding), with the vectors of distinct texts kept at path.

    The missing texts are found once and dealt into `chunks` parts. Each part is written to a folder of its own, and counts once its commit is in the log; so an interrupted part, or one that was damaged since, is encoded again, and runs at the same time don't touch each other's parts. width: parts of another one don't count. light: vectors cost less than moving their texts, so all texts are encoded once where they are, see keep_vectors().
    """
    if kind not in ("query", "document"):
        raise ValueError("kind must be query or document")
    if light:
        return keep_vectors(spark, stored(with_vectors(texts, encode, kind), "vectors"), path, width)
    todo = missing_texts(texts, stored_vectors(spark, path, width))
    rows = todo.select(F.col("text_key").alias("id"), F.lit(0).cast("long").alias("pos"), "text")
    if chunks > 1:
        rows = stored(rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "missing-texts")
    for n in range(chunks):
        some = rows.where(F.col("_part") == n).drop("_part") if chunks > 1 else rows
        _commit(spark, encode(some, kind).select(F.col("id").alias("text_key"), "embedding"), path, width)
    return with_key(texts).join(stored_vectors(spark, path, width), "text_key").select("id", "pos", "embedding")


def order_digest(rows: DataFrame, *more: Column) -> tuple:
    """The number of (id, pos) rows, and a digest that changes with any id or place; sums are combined within tasks. more: aggregates of the same pass."""
    mixed = F.xxhash64(F.col("id").cast("string"), F.col("pos").cast("long"))
    n, total, *rest = rows.agg(F.count(F.lit(1)), F.sum(mixed.cast("decimal(38,0)")), *more).first()
    return n, str(total or 0), *rest


def range_digests(rows: DataFrame, size: int = RANGE) -> DataFrame:
    """(range, n, digest) of (id, pos) rows: order_digest() of each range of `size` places."""
    mixed = F.xxhash64(F.col("id").cast("string"), F.col("pos").cast("long")).cast("decimal(38,0)")
    by_range = rows.groupBy(F.floor(F.col("pos") / size).cast("long").alias("range"))
    return by_range.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(mixed).cast("string"), F.lit("0")).alias("digest"))


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(range, left_n, right_n) where two range_digests() differ: where to look, without a join of the lists."""
    a, b = left.toDF("range", "left_n", "_a"), right.toDF("range", "right_n", "_b")
    both = a.join(b, "range", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")) | ~F.col("left_n").eqNullSafe(F.col("right_n")))
    return both.select("range", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


def order_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pos, left_id, right_id) where two (id, pos) lists differ."""
    a, b = left.select("pos", F.col("id").alias("left_id")), right.select("pos", F.col("id").alias("right_id"))
    return a.join(b, "pos", "full_outer").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def _table(where: str, buckets: int, id_type: str) -> str:
    """The name under which a side is known to the session's catalog: one for each place and layout."""
    return f"tessera_{hashlib.md5(f'{where} {buckets} {id_type}'.encode()).hexdigest()}"


def _bucketed(spark: SparkSession, where: str, buckets: int, id_type: str) -> DataFrame:
    """A side as a table, so that Spark knows how its files are dealt. The table refers to the files; dropping it leaves them."""
    table = _table(where, buckets, id_type)
    place = where.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (id {id_type}, pos BIGINT, embedding ARRAY<FLOAT>) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(table)
    return spark.table(table)


def save_store(spark: SparkSession, folder: str, queries: DataFrame, documents: DataFrame, manifest: dict, buckets: int | None = None) -> dict:
    """Write both sides, (id, pos, embedding), and a manifest with their sizes and order.

    Both are dealt by the hash of id into as many buckets, a sorted file each, so that joins of stores on id move no vectors. buckets: as many as a shuffle has partitions, if not given.
    """
    known = dict(manifest) | {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "id_types": {}}
    for name, side in (("queries", queries), ("documents", documents)):
        rows = side.select("id", F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<float>").alias("embedding"))
        known["id_types"][name] = rows.schema["id"].dataType.simpleString()
        where = qualified(spark, f"{folder}/{name}")
        table = _table(where, known["buckets"], known["id_types"][name])
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, where)
        rows.repartition(known["buckets"], "id").write.bucketBy(known["buckets"], "id").sortBy("id").option("path", where).saveAsTable(table)
        known[f"n_{name}"], known[f"{name}_order"] = order_digest(spark.table(table))
    write_text(spark, f"{folder}/{MANIFEST}", json.dumps(known, sort_keys=True, indent=2, default=str))
    return known


def load_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """queries, documents and the manifest; ValueError if they aren't what the manifest says, or vectors differ in width."""
    manifest = json.loads(read_text(spark, f"{folder}/{MANIFEST}"))
    names = ("queries", "documents")
    # Stores of before have no buckets.
    dealt = "buckets" in manifest
    sides = [_bucketed(spark, qualified(spark, f"{folder}/{name}"), manifest["buckets"], manifest["id_types"][name]) if dealt else spark.read.parquet(f"{folder}/{name}") for name in names]
    for name, side in zip(names, sides, strict=True):
        n, order, low, high = order_digest(side, F.min(F.size("embedding")), F.max(F.size("embedding")))
        if (n, order) != (manifest[f"n_{name}"], manifest[f"{name}_order"]):
            raise ValueError(f"{name} of {folder} aren't those of its manifest")
        if low != high or low is not None and low != manifest.get("dimension", low):
            raise ValueError(f"{name} of {folder} have vectors of width {low} to {high}")
    return *sides, manifest
