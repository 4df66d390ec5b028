"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier over surface features, trained from labels, gives each document's evidence: its log odds less the log odds of the training labels. Hosts and, below them, paths have rates of good documents. They are estimated from the classifier's probabilities over all documents: a host's rate is shrunk to the global rate and a path's to its host's, each by a prior of as many documents as the spread between the sites warrants (method of moments), so sparse sites stay near their parent. A document is kept if its evidence and its path's log odds add up to 0 or more.

Null text is empty text; null host or path is a site of its own. Labels that repeat for an id count as good if one of them is good; null labels don't count. Without labels of both kinds there is no evidence, all rates are one half and everything is kept. Rows that repeat are judged each, and all alike; a tie, log odds of exactly 0, is kept. Very long texts are measured whole. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import left_join_groups, staged

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*+=<>@^~_\\/", b"\"'()[]{}-`", bytes(range(128, 256)))
_OF_BYTE = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    _OF_BYTE[list(_bytes), _k] = 1


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters and of words, and sizes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _OF_BYTE / max(len(data), 1)
    words = data.split()
    n = max(len(words), 1)
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    fresh = len(set(words)) / n
    size = np.log1p(len(words))
    return np.array([1.0, *shares, repeats, marked, fresh * size, size, len(data) / n / 10, min(len(words), 3) / 3])


@dataclass
class Classifier:
    """Logistic weights over scaled features, and the log odds of the training labels."""

    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    prior: float

    def evidence(self, texts: pd.Series) -> np.ndarray:
        rows = np.stack([features(t) for t in texts]) if len(texts) else np.empty((0, len(self.weights)))
        return (rows - self.center) / self.scale @ self.weights - self.prior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 20_000, ridge: float = 1.0) -> Classifier | None:
    """Fit on at most train_rows labelled documents, drawn by their ids' hash. Only their features come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    sample = staged(known.orderBy(F.xxhash64(id_col), id_col).limit(train_rows), "labelled")
    measure = F.pandas_udf(lambda texts: pd.Series([features(t).tolist() for t in texts]), "array<double>")
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).orderBy(F.xxhash64(id_col), id_col, F.xxhash64(text_col)).limit(train_rows).select(measure(text_col).alias("x"), "_y").collect()
    y = np.array([r["_y"] for r in rows], float)
    if len(set(y > 0)) < 2:
        return None
    y = (y > 0).astype(float)
    x = np.array([r["x"] for r in rows])
    center, scale = x.mean(0), x.std(0)
    center[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (x - center) / scale
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(w, center, scale, float(np.log(y.mean() / (1 - y.mean()))))


def _evidence(model: Classifier | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.0)
    return F.pandas_udf(lambda texts: pd.Series(model.evidence(texts)), "double")(text)


def _prior_size(rates: DataFrame, parent: Column) -> float:
    """How many documents the prior is worth: what explains the spread of (good, n) around the parent's rate beyond chance."""
    rate = F.col("good") / F.col("n")
    chance = parent * (1 - parent) / F.col("n")
    spread, noise, variance = rates.agg(F.avg((rate - parent) * (rate - parent)), F.avg(chance), F.avg(parent * (1 - parent))).first()
    if spread is None:
        return 1.0
    return float(np.clip((variance or 0.0) / max(spread - noise, 1e-9) - 1, 1.0, 1e6))


def site_rates(scored: DataFrame, prior: float) -> DataFrame:
    """scored (site_host, site, evidence) -> one row per site: n, host_rate, path_rate. prior: log odds to read evidence as probability."""
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = staged(scored.groupBy("site_host", "site").agg(F.sum(p).alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = staged(paths.groupBy("site_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_paths")), "hosts")
    good, n = hosts.agg(F.sum("good"), F.sum("n")).first()
    overall = good / n if n else 0.5
    a = _prior_size(hosts, F.lit(overall))
    hosts = staged(hosts.select("site_host", "n_paths", ((F.col("good") + a * overall) / (F.col("n") + a)).alias("host_rate")), "host-rates")
    joined = staged(left_join_groups(paths, hosts, "site_host", "n_paths", paths.count()), "path-hosts")
    b = _prior_size(joined, F.col("host_rate"))
    return staged(joined.select("site", "n", "host_rate", ((F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate")), "site-rates")


def _with_sites(rows: DataFrame, host_col: str, path_col: str) -> DataFrame:
    """site_host and site as texts that are never null."""
    return rows.withColumn("site_host", F.to_json(F.struct(F.col(host_col).alias("h")))).withColumn("site", F.to_json(F.struct(F.col(host_col).alias("h"), F.col(path_col).alias("p"))))


def _rated(rows: DataFrame, sites: DataFrame, broadcast_sites: int) -> DataFrame:
    """rows with their site's rates: by broadcast if there are few sites, else by a join that is split for large sites."""
    if sites.count() <= broadcast_sites:
        return rows.join(F.broadcast(sites), "site", "left")
    return left_join_groups(rows, sites, "site", "n", sites.agg(F.sum("n")).first()[0])


def _posterior(model: Classifier | None) -> Column:
    rate = F.coalesce("path_rate", F.lit(0.5))
    rate = F.greatest(F.least(rate, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.lit(0.0) if model is None else F.col("evidence") + F.log(rate / (1 - rate))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", train_rows: int = 20_000, broadcast_sites: int = 100_000) -> DataFrame:
    """One row per row of docs: id_col, evidence, host_rate, path_rate, quality (a probability), kept."""
    model = train(docs, labels, id_col, text_col, train_rows=train_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), _evidence(model, F.col(text_col)).alias("evidence"))
    scored = staged(_with_sites(rows, "_host", "_path"), "evidence")
    sites = site_rates(scored, model.prior if model else 0.0)
    out = _rated(scored, sites, broadcast_sites).withColumn("_odds", _posterior(model))
    return out.select(F.col("_id").alias(id_col), "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-F.col("_odds")))).alias("quality"), (F.col("_odds") >= 0).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", train_rows: int = 20_000, broadcast_sites: int = 100_000) -> DataFrame:
    """The rows of docs that judge() keeps, whole. The rows aren't shuffled unless there are over broadcast_sites sites."""
    model = train(docs, labels, id_col, text_col, train_rows=train_rows)
    if model is None:
        return docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), F.col(text_col).alias("_text"))
    scored = _with_sites(whole, "_host", "_path").select("_row", "site_host", "site", _evidence(model, F.col("_text")).alias("evidence"))
    scored = staged(scored, "judged-documents")  # so that each text is measured once
    sites = site_rates(scored.select("site_host", "site", "evidence"), model.prior).select("site", "n", "path_rate")
    return _rated(scored, sites, broadcast_sites).where(_posterior(model) >= 0).select("_row.*")
