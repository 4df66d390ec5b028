"""What several corpus operators share: the scratch tables that cut lineage, and a join that survives hot keys."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groups that hold more than one row in this many, or more than MOST rows, are joined by broadcast. By counting, there are fewer of them than this number or than rows / MOST.
HOT_SHARE = 1000
MOST = 1_000_000

#: Scratch tables of this process that are there, with their numbers in the order of writing.
_written: dict[str, int] = {}
_numbers = count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a local session, as in tests, gets a folder of its own; a cluster has none that is safe."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = next(_numbers)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A number below those of all scratch tables yet to be written."""
    return next(_numbers)


def written_since(mark: int) -> list[str]:
    """The scratch tables written after the mark that are still there."""
    return [path for path, n in _written.items() if n > mark]


def clear_scratch(spark: SparkSession, paths: list[str], unless_read_by: DataFrame | None = None) -> None:
    """Delete these scratch tables, and take them off the list. Only once no DataFrame that reads them is still needed."""
    read = {name for f in unless_read_by.inputFiles() for name in f.split("/")} if unless_read_by is not None and paths else set()
    for path in [p for p in paths if p.rsplit("/", 1)[1] not in read]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        paths.remove(path)
        _written.pop(path, None)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. For texts of single bytes, lower() does just that, and much faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def left_join_groups(rows: DataFrame, groups: DataFrame, key: str, size_col: str, total: int) -> DataFrame:
    """rows left-joined to groups (one row a key; size_col says how many rows carry the key) on key.

    Keys with over total / HOT_SHARE rows, or over MOST, would each fill one task of a shuffled join. There are fewer than HOT_SHARE of them, or total / MOST, so they are broadcast; all other rows are shuffled. Null keys match nothing.
    """
    most = min(max(total // HOT_SHARE, 1), MOST)
    hot = F.broadcast(groups.where(F.col(size_col) > most))
    cold = groups.where(F.col(size_col) <= most)
    null = rows.where(F.col(key).isNull())
    full = rows.where(F.col(key).isNotNull())
    out = full.join(hot, key).unionByName(full.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
    extra = [f for f in groups.schema.fields if f.name != key]
    return out.unionByName(null.withColumns({f.name: F.lit(None).cast(f.dataType) for f in extra}))


def first_of_each(rows: DataFrame, keys: list[str], order: list, k: int, groups: int = 64) -> DataFrame:
    """The first k rows of each key, with their place _n from 1. Each task holds at most a few rows of a key; they meet in groups of tasks first, so that no task gets a row of every task."""
    part = Window.partitionBy(*keys, "_group").orderBy(*order)
    rows = rows.withColumn("_group", F.spark_partition_id() % groups).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_group", "_n")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k)
