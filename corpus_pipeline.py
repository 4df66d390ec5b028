"""A training-data pipeline over `documents`: each stage applies one operator of tessera.llm to all that the stage before kept.

Judge quality, drop exact copies, drop near copies, sample the mix of sources, and pack what is left into sequences. All stages but the last return the columns of documents; the last returns a row per piece. Empty tables give empty results; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import clear_scratch, scratch_mark, staged, written_since
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality_filter
from tessera.llm.simhash import near_dedup


def _stage(operator: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage, which first deletes what the stages before it stored for themselves. Their results are written by then; what docs itself still reads stays."""

    @wraps(operator)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = _own.setdefault((spark.sparkContext.applicationId, sf_dir), [])
        clear_scratch(spark, own, unless_read_by=docs)
        mark = scratch_mark()
        result = operator(spark, docs, sf_dir)
        own.extend(written_since(mark))
        return result

    return run_stage


#: Scratch tables of stages, by application and folder, so that runs over different tables leave each other's alone.
_own: dict[tuple[str, str], list[str]] = {}


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts. Without labels of both kinds all stay; null and empty texts are judged by their site alone, rows that repeat each, null labels teach nothing."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z, the row of the largest id; a null text counts as empty. Of rows that repeat an id too, one."""
    return exact_dedup(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that link at a similarity of 0.8, directly or not, those of the smallest id; rows of null id stay. Texts without words are near copies of each other."""
    return near_dedup(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the draw by their id keeps. Rows that repeat an id stay or go together; a row without an id is drawn by itself; null margins are a margin."""
    return mixed_documents(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece; null and empty texts are a piece of one token, very long ones are cut into pieces, and rows that repeat are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the fingerprints' components; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Of what they store in the shared folder, only the last stage's result is left."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        mark = scratch_mark()
        try:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        except BaseException:
            clear_scratch(spark, kept + written_since(mark))
            raise
        clear_scratch(spark, kept + written_since(mark)[:-1])
        kept = written_since(mark)
    return docs
