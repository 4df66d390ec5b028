"""Retrieval collections on disk: corpus.jsonl, queries.jsonl and qrels/<split>.tsv as DataFrames.

Every row carries pos, its place in the file from 0. An id that repeats keeps its first place and its last value. A key that is null counts as missing, so the other key is used; with null_keys="text" it counts as the text "None".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import document_text, is_blank
from tessera.sources.files import exists, stored

# Collections that can be downloaded.
REGISTERED = ("arguana", "fiqa", "scifact", "nfcorpus")
#: JSON values that count as empty where text is wanted, by their type.
_FALSY = {"BIGINT": ("0",), "DOUBLE": ("0", "0.0"), "BOOLEAN": ("false",)}
#: Rows (id, pos, text) and their kind, query or document -> (id, pos) and what stands for the texts.
Encode = Callable[[DataFrame, str], DataFrame]


@dataclass
class Dataset:
    """queries (query_id, query_text, pos), corpus (doc_id, title, text, pos), qrels (query_id, doc_id, score, pos)."""

    name: str
    queries: DataFrame
    corpus: DataFrame
    qrels: DataFrame
    split: str = "test"

    def query_texts(self) -> DataFrame:
        return self.queries.select("query_text", "pos").orderBy("pos").select("query_text")

    def corpus_documents(self) -> DataFrame:
        return self.corpus.orderBy("pos")

    def samples(self) -> DataFrame:
        """queries with relevant_doc_ids, in the order of the qrels file."""
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"])
        relevant = self.qrels.where("score > 0").groupBy("query_id").agg(ordered.alias("relevant_doc_ids"))
        return self.queries.join(relevant, "query_id", "left").withColumn("relevant_doc_ids", F.coalesce("relevant_doc_ids", F.array().cast("array<string>")))

    def problems(self, missing_relevant_policy: str = "error") -> DataFrame:
        """(problem, id): what validate() refuses."""
        unknown = self.qrels.select("query_id").distinct().join(self.queries, "query_id", "left_anti").select(F.lit("unknown query").alias("problem"), F.col("query_id").alias("id"))
        twice = self.queries.groupBy("query_id").count().where("count > 1").select(F.lit("repeated query").alias("problem"), F.col("query_id").alias("id"))
        out = unknown.unionByName(twice)
        if missing_relevant_policy != "keep":
            gone = self.qrels.where("score > 0").select("doc_id").distinct().join(self.corpus, "doc_id", "left_anti")
            out = out.unionByName(gone.select(F.lit("missing document").alias("problem"), F.col("doc_id").alias("id")))
        return out

    def validate(self, missing_relevant_policy: str = "error") -> Dataset:
        """self, or ValueError with the first five ids of a problem."""
        found = self.problems(missing_relevant_policy).orderBy("problem", "id").limit(5).collect()
        if found:
            raise ValueError("; ".join(f"{r['problem']}: {r['id']}" for r in found))
        return self


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, pos): the lines of a file or of a folder's files in the order of their names, numbered from 0 without gaps.

    Each split's lines are numbered by themselves and follow those of the splits before; only the splits' sizes are put in order and sent to all tasks, so lines stay where they are read.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"))
    splits = lines.groupBy("_file", "_start").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return lines.join(F.broadcast(splits), ["_file", "_start"]).select("value", (F.col("_before") + F.col("_n") - F.col("_first")).alias("pos"))


def _json_text(value: Column, key: str, falsy_is_empty: bool = False) -> Column:
    """A key of a JSON object as text; null if it is missing or null."""
    path = f"$.{key}"
    text = F.variant_get(value, path, "string")
    if not falsy_is_empty:
        return text
    kind = F.schema_of_variant(F.variant_get(value, path, "variant"))
    empty = F.lit(False)
    for name, values in _FALSY.items():
        empty |= (kind == name) & text.isin(*values)
    return F.when(empty | kind.startswith("DECIMAL") & (text.cast("double") == 0) | text.isin("[]", "{}") & (kind != "STRING"), F.lit("")).otherwise(text)


def _first_key(value: Column, *keys: str, null_keys: str, default: Column) -> Column:
    """The text of the first of these keys that is there."""
    if null_keys not in ("missing", "text"):
        raise ValueError("null_keys must be missing or text")
    out = default
    for key in reversed(keys):
        text = _json_text(value, key)
        if null_keys == "text":
            there = F.variant_get(value, f"$.{key}", "variant")
            out = F.when(there.isNotNull(), F.coalesce(text, F.lit("None"))).otherwise(out)
        else:
            out = F.coalesce(text, out)
    return out


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value: variant, pos) of each line that isn't blank. A malformed line raises when it is read."""
    return numbered_lines(spark, path).where(~is_blank(F.col("value"))).select(F.parse_json("value").alias("value"), "pos")


def last_value_first_place(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per key: the columns of its last row, at the place of its first."""
    others = [c for c in rows.columns if c not in (*keys, pos)]
    found = rows.groupBy(*keys).agg(F.min(pos).alias("_first"), *([F.max_by(F.struct(*others), pos).alias("_last")] if others else []))
    return found.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others], F.col("_first").alias(pos))


def _no_id(null_keys: str) -> Column:
    return F.lit("None" if null_keys == "text" else None).cast("string")


def _encoded(rows: DataFrame, key: str, text: Column, kind: str, encode: Encode) -> DataFrame:
    return encode(rows.select(F.col(key).alias("id"), "pos", text.alias("text")), kind).withColumnRenamed("id", key)


def read_corpus(spark: SparkSession, path: str, null_keys: str = "missing", encode: Encode | None = None) -> DataFrame:
    """(doc_id, title, text, pos). encode: its columns instead of title and text, made where lines are parsed, so that no text moves where rows of an id meet."""
    v = F.col("value")
    doc_id = _first_key(v, "_id", "id", null_keys=null_keys, default=_no_id(null_keys))
    fields = [F.coalesce(_json_text(v, k, True), F.lit("")).alias(k) for k in ("title", "text")]
    rows = read_jsonl(spark, path).select(doc_id.alias("doc_id"), *fields, "pos")
    if encode:
        rows = _encoded(rows, "doc_id", document_text(F.col("title"), F.col("text")), "document", encode)
    return last_value_first_place(rows, ["doc_id"])


def read_queries(spark: SparkSession, path: str, null_keys: str = "missing", encode: Encode | None = None) -> DataFrame:
    """(query_id, query_text, pos). encode: as for read_corpus()."""
    v = F.col("value")
    query_id = _first_key(v, "_id", "id", null_keys=null_keys, default=_no_id(null_keys))
    text = _first_key(v, "text", "query", null_keys=null_keys, default=F.lit(""))
    rows = read_jsonl(spark, path).select(query_id.alias("query_id"), text.alias("query_text"), "pos")
    if encode:
        rows = _encoded(rows, "query_id", F.col("query_text"), "query", encode)
    return last_value_first_place(rows, ["query_id"])


def parse_qrels(lines: DataFrame) -> DataFrame:
    """lines (value, pos) -> (query_id, doc_id, score, pos): tab-separated, three fields or more; grades are cut to whole numbers, and one that is no number raises."""
    fields = F.split(F.regexp_replace("value", r"[\r\n]+\z", ""), "\t")
    rows = lines.select(fields.alias("f"), "pos").where(F.size("f") >= 3)
    grade = F.trim(F.get("f", F.lit(2))).cast("double").cast("int")
    return last_value_first_place(rows.select(F.get("f", F.lit(0)).alias("query_id"), F.get("f", F.lit(1)).alias("doc_id"), grade.alias("score"), "pos"), ["query_id", "doc_id"])


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """The judgments of a split. The first line is a header, whatever it holds."""
    return parse_qrels(numbered_lines(spark, path).where("pos > 0"))


def assemble(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The queries that have judgments, in the order in which the judgments name them first."""
    order = qrels.groupBy("query_id").agg(F.min("pos").alias("pos"))
    return queries.drop("pos").join(order, "query_id")


def resolve_root(spark: SparkSession, name: str, root: str, download: bool = False) -> str:
    """The folder that holds the collection: <root>/<name>/<name> if it has a corpus, else <root>/<name>."""
    name = name.lower()
    for folder in (f"{root}/{name}/{name}", f"{root}/{name}"):
        if exists(spark, f"{folder}/corpus.jsonl"):
            return folder
    if not download:
        raise FileNotFoundError(f"no corpus.jsonl under {root}/{name}")
    if name not in REGISTERED:
        raise ValueError(f"{name} is none of {', '.join(REGISTERED)}")
    try:
        from beir import util
    except ImportError as e:
        raise RuntimeError("downloads need the beir package") from e
    return util.download_and_unzip(f"https://public.ukp.informatik.tu-darmstadt.de/thakur/BEIR/datasets/{name}.zip", f"{root}/{name}")


def load_dataset(spark: SparkSession, name: str, root: str = "datasets", split: str = "test", download: bool = False, missing_relevant_policy: str = "error", null_keys: str = "missing", once: bool = False, texts: bool = True, encode: Encode | None = None) -> Dataset:
    """once: the parsed collection is stored in the shared folder, so that whatever is done with it, each file is read once. Without texts, queries are (query_id, pos) and the corpus is (doc_id, pos), so parsing moves ids alone. encode: its columns stand for the texts, see read_corpus()."""
    if missing_relevant_policy not in ("error", "keep"):
        raise ValueError("missing_relevant_policy must be error or keep")
    folder = resolve_root(spark, name, root, download)
    if not exists(spark, path := f"{folder}/qrels/{split}.tsv"):
        raise FileNotFoundError(path)
    keep = stored if once else lambda df, name: df
    qrels = keep(read_qrels(spark, path), "qrels")
    queries, corpus = assemble(read_queries(spark, f"{folder}/queries.jsonl", null_keys, encode), qrels), read_corpus(spark, f"{folder}/corpus.jsonl", null_keys, encode)
    if not texts:
        queries, corpus = queries.select("query_id", "pos"), corpus.select("doc_id", "pos")
    found = Dataset(name.lower(), keep(queries, "queries"), keep(corpus, "corpus"), qrels, split)
    return found.validate(missing_relevant_policy)


def load_split(spark: SparkSession, dataset: Dataset, root: str, split: str, missing_relevant_policy: str = "error") -> Dataset:
    """Another split of a collection that is loaded, without query texts; the corpus isn't read again."""
    folder = resolve_root(spark, dataset.name, root)
    if not exists(spark, path := f"{folder}/qrels/{split}.tsv"):
        raise FileNotFoundError(path)
    qrels = stored(read_qrels(spark, path), "qrels")
    queries = stored(assemble(read_queries(spark, f"{folder}/queries.jsonl"), qrels).select("query_id", "pos"), "queries")
    return Dataset(dataset.name, queries, dataset.corpus, qrels, split).validate(missing_relevant_policy)


def first_places(rows: DataFrame, n: int, pos: str = "pos", size: int = 1 << 20) -> DataFrame:
    """The n rows of the smallest places, which are distinct; all, if there are fewer. Ranges of places are counted, then the places of one range: no task gets the rows that are kept."""
    left, edge = n, None
    for r in rows.groupBy(F.floor(F.col(pos) / size).alias("range")).agg(F.count(F.lit(1)).alias("rows")).orderBy("range").collect():
        if left <= r["rows"]:
            edge = rows.where(F.floor(F.col(pos) / size) == r["range"]).select(pos).orderBy(pos).offset(left - 1).first()[0]
            break
        left -= r["rows"]
    return rows if edge is None else rows.where(F.col(pos) <= edge)


def load_corpus(spark: SparkSession, name: str, root: str = "datasets", download: bool = False) -> DataFrame:
    """The corpus alone; queries and judgments aren't opened."""
    return read_corpus(spark, f"{resolve_root(spark, name, root, download)}/corpus.jsonl")
