"""Encoders: from a text column to vectors of unit length.

encode(df, kind) takes (id, pos, text) and gives (id, pos, embedding); kind is query or document.
"""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import DEFAULT_INSTRUCTION, EMPTY, adapter_of, sanitize, template
from tessera.functions.vectors import TINY, l2_normalize
from tessera.operators.providers import Provider, Refused, create_provider, pause
from tessera.sources.files import stored

KINDS = ("query", "document")


class Encoder(ABC):
    """What the store and the pipelines need of an encoder."""

    model_id: str
    revision: str
    dimension: int
    batch_size: int = 32

    @property
    def encoding_config(self) -> dict:
        return {}

    @abstractmethod
    def encode(self, df: DataFrame, kind: str) -> DataFrame: ...


def _checked(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError("kind must be query or document")
    return kind


def hash_words(text: Column, kind: str, seed: int = 0) -> Column:
    """The eight little-endian 32-bit words of the SHA-256 of "seed:kind:text"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{_checked(kind)}:"), text), 256)
    byte = lambda d, word, i: F.substring(d, 8 * word + 2 * i + 1, 2)
    # As a lambda's variable the digest is computed once, not once a byte.
    words = F.transform(F.array(digest), lambda d: F.array(*[F.conv(F.concat(*[byte(d, w, i) for i in (3, 2, 1, 0)]), 16, 10).cast("long") for w in range(8)]))
    return F.get(words, F.lit(0))


def hash_vector(text: Column, kind: str, dimension: int = 64, seed: int = 0) -> Column:
    """The words, repeated to the dimension, as floats from -0.5 to 0.5, not yet normalised. All steps are in float."""
    # A cast to double, or a division, would skip the rounding to float.
    values = F.transform(hash_words(text, kind, seed), lambda w: w.cast("float") * F.lit(2.0**-32).cast("float") - F.lit(0.5).cast("float"))
    return F.slice(F.flatten(F.array_repeat(values, -(-dimension // 8))), 1, dimension)


@dataclass
class HashEncoder(Encoder):
    """Deterministic vectors from digests, as plain column expressions."""

    dimension: int = 64
    seed: int = 0
    model_id: str = "hash"

    @property
    def revision(self) -> str:
        return str(self.seed)

    @property
    def encoding_config(self) -> dict:
        return {"type": "sha256", "seed": self.seed}

    def encode(self, df: DataFrame, kind: str) -> DataFrame:
        rows = df.select("id", "pos", hash_vector(F.col("text"), kind, self.dimension, self.seed).alias("embedding"))
        return rows.withColumn("embedding", l2_normalize(F.col("embedding")))


ENCODED = "id string, pos long, embedding array<float>"


def _unit_rows(part: pd.DataFrame, vectors: Sequence, dimension: int) -> pd.DataFrame:
    """The part's rows with their vectors, scaled to unit length."""
    found = np.asarray(vectors, np.float32)
    if found.shape != (len(part), dimension):
        raise ValueError(f"the encoder gave {found.shape} for {len(part)} texts of width {dimension}")
    found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), TINY)
    return pd.DataFrame({"id": part["id"], "pos": part["pos"], "embedding": list(found.astype(np.float32))})


class BatchEncoder(Encoder):
    """An encoder that runs Python over batches of prepared texts, once started per task."""

    adapter: str
    query_instruction: str | None = None

    @abstractmethod
    def starter(self) -> Callable[[], Callable[[list[str], str], Sequence]]:
        """A picklable function that, in the task, gives embed(texts, kind)."""

    def prepared(self, text: Column, kind: str) -> Column:
        return template(self.adapter, text, kind, self.query_instruction)

    def encode(self, df: DataFrame, kind: str) -> DataFrame:
        start, size, dimension = self.starter(), self.batch_size, self.dimension
        _checked(kind)

        def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            run = None
            for batch in batches:
                run = run or start()
                for i in range(0, len(batch), size):
                    part = batch.iloc[i : i + size]
                    yield _unit_rows(part, run(part["text"].tolist(), kind), dimension)

        return self.rows(df, kind).mapInPandas(embed, ENCODED)

    def rows(self, df: DataFrame, kind: str) -> DataFrame:
        return df.select("id", "pos", self.prepared(F.col("text"), kind).alias("text"))


def sentence_transformer(model_id: str, **options):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(model_id, **options)


@dataclass
class SentenceTransformerEncoder(BatchEncoder):
    """A local model, loaded once per task by load(model_id, revision=, device=). Documents never take the query path. Dimension 0 is read from the model."""

    model_id: str
    dimension: int = 0
    revision: str = "main"
    adapter: str = "sentence-transformers"
    batch_size: int = 32
    query_instruction: str | None = None
    device: str | None = None
    max_length: int | None = None
    load: Callable = field(default=sentence_transformer, repr=False)

    def resolve(self) -> None:
        """Read the width from the model, if it isn't given. Fingerprints and manifests need it."""
        if not self.dimension:
            self.dimension = self.load(self.model_id, revision=self.revision).get_sentence_embedding_dimension()

    def encode(self, df: DataFrame, kind: str) -> DataFrame:
        self.resolve()
        return super().encode(df, kind)

    @property
    def encoding_config(self) -> dict:
        # The keys are part of the stores' fingerprints. All local models have one adapter here.
        told = self.query_instruction or (DEFAULT_INSTRUCTION if self.adapter == "qwen3" else None)
        return {"adapter": "sentence-transformers", "batch_size": self.batch_size, "max_seq_length": self.max_length, "query_instruction": told}

    def starter(self):
        load, model_id, revision, device, length, size = self.load, self.model_id, self.revision, self.device, self.max_length, self.batch_size

        def start():
            model = load(model_id, revision=revision, device=device)
            if length:
                model.max_seq_length = length
            # A model may have a prompt of its own for queries.
            ways = {"query": getattr(model, "encode_query", model.encode), "document": model.encode}
            return lambda texts, kind: ways[kind](texts, batch_size=size, normalize_embeddings=True)

        return start


#: Seconds of calls that a task makes before it hears from the others. To hear from them takes about a second, since Spark looks once a second whether all are there.
ROUND_SECONDS = 8.0
#: Bytes of text that a task of bounded calls gets at a time.
WAVE_BYTES = 256 << 20


@dataclass
class HostedEncoder(BatchEncoder):
    """A hosted model. Blank texts become the placeholder before the template.

    calls_in_flight bounds the calls at one time over all executors: the texts are dealt over so many barrier tasks, each of which makes one call at a time. A task that is refused waits by itself and tries again; after ROUND_SECONDS, and at once when refused again, tasks tell each other how long to wait, and each waits for what the longest is more than its own; so a service that goes on refusing one isn't asked by the others meanwhile, and one that turns away single calls costs no more rounds. The tasks start together, so they are never more than the cluster has slots. Vectors are written as they come, since a barrier stage runs whole or not at all; texts of over WAVE_BYTES a task are dealt into several such stages, one after the other.
    """

    model_id: str
    dimension: int
    provider: Provider
    revision: str = "hosted"
    adapter: str = ""
    batch_size: int = 32
    query_instruction: str | None = None
    empty_text_placeholder: str = EMPTY
    calls_in_flight: int | None = None

    def __post_init__(self) -> None:
        if self.calls_in_flight is not None and self.calls_in_flight < 1:
            raise ValueError("calls_in_flight must be at least 1")

    def encode(self, df: DataFrame, kind: str) -> DataFrame:
        if self.calls_in_flight is None:
            return super().encode(df, kind)
        provider, model_id, batch_size, dimension = self.provider, self.model_id, self.batch_size, self.dimension
        _checked(kind)

        def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            others = BarrierTaskContext.get()
            parts = (batch.iloc[i : i + batch_size] for batch in batches for i in range(0, len(batch), batch_size))
            part, refused = next(parts, None), 0
            while True:
                # waited: the longest of the waits that this task had by itself in the round.
                wait = waited = 0.0
                stop = time.monotonic() + ROUND_SECONDS
                while part is not None and time.monotonic() < stop:
                    try:
                        found = provider.embed_once(model_id, part["text"].tolist())
                    except Refused as e:
                        refused += 1
                        if refused > provider.max_retries:
                            raise RuntimeError(f"gave up after {refused} tries: {e}") from e
                        wait = max(wait, pause(refused))
                        if refused > 1:
                            waited = 0.0
                            break
                        provider.sleep(pause(refused))
                        waited = wait
                        continue
                    yield _unit_rows(part, found, dimension)
                    part, refused = next(parts, None), 0
                told = [json.loads(t) for t in others.allGather(json.dumps([part is None, wait]))]
                longest = max(w for _, w in told)
                if longest > waited:
                    provider.sleep(longest - waited)
                if all(done for done, _ in told):
                    return

        tasks = min(self.calls_in_flight, df.sparkSession.sparkContext.defaultParallelism)
        rows = self.rows(df, kind)
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        waves = max(1, -(-size // (tasks * WAVE_BYTES)))
        if waves > 1:
            rows = stored(rows.withColumn("_wave", F.pmod(F.xxhash64("id", "pos"), F.lit(waves)).cast("int")), "hosted-texts", by="_wave")
        out = None
        for n in range(waves):
            some = rows.where(F.col("_wave") == n).drop("_wave") if waves > 1 else rows
            part = stored(some.repartition(tasks).mapInPandas(embed, ENCODED, barrier=True), "hosted-vectors")
            out = part if out is None else out.unionByName(part)
        return out

    @property
    def encoding_config(self) -> dict:
        # The keys are part of the stores' fingerprints.
        return {
            "adapter": self.adapter, "provider": self.provider.settings, "batch_size": self.batch_size, "query_instruction": self.query_instruction,
            "empty_text_placeholder": self.empty_text_placeholder, "normalization": "l2",
        }

    def prepared(self, text: Column, kind: str) -> Column:
        adapter = self.adapter if self.adapter in ("e5", "qwen3") else ""
        return template(adapter, sanitize(text, self.empty_text_placeholder), kind, self.query_instruction)

    def starter(self):
        provider, model_id = self.provider, self.model_id
        return lambda: lambda texts, kind: provider.embed(model_id, texts)


def resolved(encoder: Encoder) -> Encoder:
    """The encoder, with all known that is read from its model."""
    getattr(encoder, "resolve", lambda: None)()
    return encoder


LOCAL = ("e5", "qwen3", "gte", "sentence-transformers")


def create_encoder(config: dict) -> Encoder:
    """From a registry entry: hash, hosted if it names a provider, else a local model by adapter."""
    model_id = config.get("model_id", "")
    adapter = config.get("adapter", "auto")
    adapter = adapter_of(model_id) if adapter in (None, "", "auto") else adapter
    if "hash" in (adapter, model_id):
        return HashEncoder(config.get("dimension", 64), config.get("seed", 0))
    common = {k: config[k] for k in ("revision", "batch_size", "query_instruction") if k in config}
    if config.get("provider") is not None:
        if "dimension" not in config:
            raise ValueError(f"hosted model {model_id} needs a dimension")
        more = {k: config[k] for k in ("empty_text_placeholder", "calls_in_flight") if k in config}
        return HostedEncoder(model_id, config["dimension"], create_provider(config["provider"]), adapter=adapter, **common, **more)
    if adapter not in LOCAL:
        raise KeyError(f"no local encoder for adapter {adapter}")
    more = {k: config[k] for k in ("device",) if k in config} | {"max_length": config.get("max_seq_length", config.get("max_length"))}
    return SentenceTransformerEncoder(model_id, config.get("dimension") or 0, adapter=adapter, **common, **more)

