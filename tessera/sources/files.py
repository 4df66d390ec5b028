"""Small text files beside the tables, through Hadoop's file systems, so that any path Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster without one is refused."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written once in the shared folder and read back: its lineage ends here, and a lost executor loses nothing. by: a column of few values, whose rows lie in folders of their own."""
    path = f"{shared_folder(df.sparkSession)}/tessera-stored/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system and folder, as tables need it."""
    p, fs = _path(spark, path)
    return str(fs.makeQualified(p).toString())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    p, fs = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str, missing: str | None = None) -> str:
    """The file's text; if it isn't there, missing, or FileNotFoundError."""
    if not exists(spark, path):
        if missing is None:
            raise FileNotFoundError(path)
        return missing
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
