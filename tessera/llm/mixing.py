"""Mixing sources to target weights by iterative proportional fitting.

Documents weigh their tokens (runs of non-space characters). All documents are summed into cells of source, language and topic. Raking scales the cells, margin by margin, until each margin has its target shares; the margins' default targets flatten the natural shares by a power below 1. A cell's calibration is its raked weight over its own weight, and a document's probability is its cell's calibration over the largest one, so that the expected tokens of the sample have the target shares exactly.

A document is sampled if its id's hash, a number in [0, 1), is below its probability: rows that repeat an id stay or go together, and a null id hashes like an empty one. Null margins are values of their own. Null text has no tokens; it doesn't weigh and goes by its cell, and a cell without any tokens is kept whole. Targets that cells can't reach (no cell has that value with another value's) are approached as far as `sweeps` bring them; margin_error says how far that is. The cell that is rarest against its target is kept whole, so it sets the rate of the whole sample: with a cell of very few tokens and a large target most documents go, as exact shares without repeats demand; probability tells before anything is dropped. Very long texts weigh all their tokens. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import left_join_groups, staged

#: Powers that flatten the natural shares of source, language and topic.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by the forms in a text: contact data, licences, tables, or prose by length."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]"), "contact")
        .when(text.rlike(r"(?i)licen[cs]e|copyright|all rights reserved"), "legal")
        .when(text.rlike(r"\S \| \S"), "tabular")
        .when(F.length(text) < 1000, "note")
        .otherwise("prose")
    )


def flattened(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets (margin, share): natural shares of base to the power, made to add up to 1."""
    sums = cells.groupBy(margin).agg(F.sum("base").alias("share")).where("share > 0").withColumn("share", F.pow("share", F.lit(power)))
    total = sums.agg(F.sum("share")).first()[0] or 1.0
    return sums.withColumn("share", F.col("share") / total)


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 200, tolerance: float = 1e-6, small_cells: int = 100_000) -> DataFrame:
    """cells (the margins, base) with weight, which adds up to base's total and has each margin's target shares (margin, share), and margin_error: the largest remaining error of a margin's total, as a share of it.

    Up to small_cells cells are swept in one task; more of them by a join and an aggregation a margin and sweep.
    """
    total = cells.agg(F.sum("base")).first()[0] or 0
    for n, (margin, target) in enumerate(targets.items()):
        target = staged(target.select(margin, F.col("share").alias(f"_share{n}")), f"target-{margin}")
        cells = cells.join(F.broadcast(target) if target.count() <= small_cells else target, margin, "left")
    shares = [f"_share{n}" for n in range(len(targets))]
    cells = staged(cells.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in shares}).withColumn("weight", F.col("base").cast("double")), "cells-to-rake")
    margins = list(targets)
    if cells.count() <= small_cells:
        schema = T.StructType([*(f for f in cells.schema.fields if f.name not in shares), T.StructField("margin_error", T.DoubleType())])

        def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            if not parts:
                return
            table = pd.concat(parts)
            codes = [pd.factorize(table[m])[0] for m in margins]
            weight, off = table["weight"].to_numpy(), 0.0
            for _ in range(sweeps):
                off = 0.0
                for code, share in zip(codes, shares, strict=True):
                    sums = np.bincount(code, weight)
                    goal = np.zeros(len(sums))
                    goal[code] = table[share].to_numpy() * total
                    factor = np.where(sums > 0, goal / np.where(sums > 0, sums, 1), 1.0)
                    off = max(off, np.abs(factor - 1)[sums > 0].max(initial=0.0))
                    weight = weight * factor[code]
                if off <= tolerance:
                    break
            yield table.assign(weight=weight, margin_error=off)[schema.names]

        return staged(cells.coalesce(1).mapInPandas(swept, schema), "raked")
    moved = 0.0
    for _ in range(sweeps):
        off = F.lit(0.0)
        for margin, share in zip(margins, shares, strict=True):
            sums = cells.groupBy(margin).agg(F.sum("weight").alias("_sum"))
            factor = F.when(F.col("_sum") > 0, F.col(share) * total / F.col("_sum")).otherwise(1.0)
            cells = left_join_groups(cells, sums.join(cells.groupBy(margin).count(), margin), margin, "count", cells.count()).withColumn("_factor", factor)
            off = F.greatest(off, F.when(F.col("weight") > 0, F.abs(F.col("_factor") - 1)).otherwise(0.0))
            cells = staged(cells.withColumn("weight", F.col("weight") * F.col("_factor")).withColumn("_off", off).drop("_factor", "_sum", "count"), "raked")
            off = F.col("_off")
        moved = cells.agg(F.max("_off")).first()[0] or 0.0
        cells = cells.drop("_off")
        if moved <= tolerance:
            break
    return cells.drop(*shares).withColumn("margin_error", F.lit(moved))


def _marked(docs: DataFrame, id_col: str, text_col: str, source: Column, lang: Column, about: Column) -> list[Column]:
    value = lambda c: F.coalesce(c.cast("string"), F.lit("\u0000"))
    return [F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_at"), n_tokens(F.col(text_col)).alias("tokens"), value(source).alias("source"), value(lang).alias("lang"), value(about).alias("topic")]


def _draw(id_col: Column) -> Column:
    """A number in [0, 1) from the id alone; of a row without an id, from its place in the stored rows."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.concat(F.lit("row "), F.col("_at").cast("string")))), 1, 13), 16, 10).cast("double") / float(16**13)


def calibrated(rows: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None, sweeps: int = 200) -> DataFrame:
    """rows (tokens and the margins) -> cells: the margins, n (documents), base, weight, margin_error, probability. targets: (margin, share) for margins with targets of their own."""
    margins = list(powers)
    cells = staged(rows.groupBy(*margins).agg(F.sum("tokens").alias("base"), F.count(F.lit(1)).alias("n")), "cells")
    goals = {m: (targets or {}).get(m) or flattened(cells, m, p) for m, p in powers.items()}
    cells = rake(cells, goals, sweeps)
    ratio = F.when(F.col("base") > 0, F.col("weight") / F.col("base"))
    most = cells.agg(F.max(ratio)).first()[0] or 1.0
    return staged(cells.select(*margins, "n", "base", "weight", "margin_error", F.coalesce(ratio / most, F.lit(1.0)).alias("probability")), "calibrated")


def _given(rows: DataFrame, cells: DataFrame, margins: list[str], broadcast_cells: int) -> DataFrame:
    """rows with their cell's weight and probability."""
    key = lambda df: df.withColumn("_cell", F.to_json(F.struct(*margins)))
    cells = key(cells).select("_cell", "n", (F.col("weight") / F.col("base")).alias("calibration"), "probability")
    rows = key(rows).drop(*margins)
    if cells.count() <= broadcast_cells:
        return rows.join(F.broadcast(cells), "_cell")
    return left_join_groups(rows, cells, "_cell", "n", cells.agg(F.sum("n")).first()[0])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang", about: Column | None = None, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None, sweeps: int = 200, broadcast_cells: int = 100_000) -> DataFrame:
    """One row per row of docs: id_col, source, lang, topic, tokens, calibration (null for a cell without tokens), probability, kept."""
    about = topic(F.col(text_col)) if about is None else about
    rows = staged(docs.select(*_marked(docs, id_col, text_col, F.col(source), F.col(lang), about)), "weighed")
    cells = calibrated(rows, powers, targets, sweeps).withColumn("base", F.nullif(F.col("base"), F.lit(0)))
    shown = rows.withColumns({f"_{m}": F.when(F.col(m) != "\u0000", F.col(m)) for m in powers})
    out = _given(shown, cells, list(powers), broadcast_cells)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_{m}").alias(m) for m in powers], "tokens", "calibration", "probability", (_draw(F.col("_id")) < F.col("probability")).alias("kept"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang", about: Column | None = None, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None, sweeps: int = 200, broadcast_cells: int = 100_000) -> DataFrame:
    """The rows of docs that mix() keeps, whole."""
    about = topic(F.col(text_col)) if about is None else about
    marks = _marked(docs, id_col, text_col, F.col(source), F.col(lang), about)
    rows = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *marks), "weighed-documents")  # so that each text is read once
    cells = calibrated(rows.drop("_row", "_id", "_at"), powers, targets, sweeps).withColumn("base", F.nullif(F.col("base"), F.lit(0)))
    return _given(rows.drop("tokens"), cells, list(powers), broadcast_cells).where(_draw(F.col("_id")) < F.col("probability")).select("_row.*")
