"""Language identification by interpolated Kneser-Ney character models.

A text is read as code points: letters and marks, each in small form, and one space for any run of others. Every character, and the space that ends the text, is predicted from the order - 1 before it (spaces, at the start). Of each language the n-grams of the highest order are counted in all labelled texts; a shorter n-gram's count is the number of characters that come before it. With a count a, the context's sum T and number K of followers, and a discount D of the order (n1 / (n1 + 2 n2), held between 0.1 and 0.95), an n-gram has the probability max(a - D, 0) / T + D K / T times that of the n-gram without its first character; below one character all are alike.

The model. An n-gram that any language has is kept with its probabilities in all of them, and a context with the share that it leaves to shorter ones, so one search serves all languages. They are found by a hash of hash_bits bits, in sorted arrays: an order holds at most 2**hash_bits n-grams and as many contexts whatever the corpus, which bounds what is sent to the tasks (22 bits: 4 + 4 bytes times the languages, 4.2 million times). Of n-grams that share a hash, the smallest stays.

Prediction. The language of the lowest cross-entropy, in bits a character; ties go to the first by name. score is the share of right answers among calibration texts at the same lead over the second language (in bits over the whole text), made monotone: calibration texts are labelled texts that the model was not trained on, all that are given. accepted is false where the cross-entropy is above what all but a share `reject` of the calibration texts of that language and length reach: such a text is likely of none of the languages; lang_pred names the nearest all the same.

A text without a letter, null or empty, has lang_pred `und`, score 0, and isn't accepted; so have all texts if there is no labelled one. Rows that repeat are each counted and each predicted. Long texts are read in pieces, whole. An empty lang is a label like others; a null one isn't learned. Other columns don't matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

UNKNOWN = "und"
#: Characters read at a time, and n-grams held by a task that counts.
PIECE, HELD = 1 << 20, 1 << 19
_SPACE = 32
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: what it is read as, and whether it is a letter."""
    read, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for c in (*range(0x32400), *range(0xE0100, 0xE01F0)):  # beyond these planes there is none
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            read[c], letter[c] = ord(chr(c).lower()[0]), kind == "L"
    return read, letter


def pieces(text: str | None, order: int) -> Iterator[np.ndarray]:
    """The code points of a text as they are read, in pieces; each begins with the order - 1 before it. None of a text without a letter."""
    read, letter = _tables()
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[codes].any():
        return
    codes = read[codes]
    blank = codes == _SPACE
    codes = codes[~(blank & np.concatenate([[True], blank[:-1]]))]
    codes = np.concatenate([np.full(order - 1, _SPACE, np.uint32), codes[: len(codes) - (codes[-1] == _SPACE)], np.array([_SPACE], np.uint32)])
    for i in range(order - 1, len(codes), PIECE):
        yield codes[i - order + 1 : i + PIECE]


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the n-gram of this order that ends at each code point from the order-th on. codes: a text, or a text a column."""
    n, codes = len(codes) - order + 1, codes.astype(np.uint64)
    x = np.full((n, *codes.shape[1:]), order, np.uint64)
    for k in range(order):
        x += codes[order - 1 - k : order - 1 - k + n] * _ODD[k]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def gram_hashes(grams: list[str], order: int) -> np.ndarray:
    """The hashes of n-grams that are all of this order."""
    return hashes(np.array(grams, f"<U{order}").view(np.uint32).reshape(-1, order).T, order)[0]


class SortedHashes:
    """A sorted array of hashes, with a row of floats for each (and one of zeros, for what isn't there). A directory of their leading bits tells where to look."""

    def __init__(self, h: np.ndarray, rows: np.ndarray, bits: int):
        self.h, self.rows = h, np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)])
        lead = min(bits, max(8, len(h).bit_length() + 1))
        self.shift = np.uint64(bits - lead)
        self.starts = np.searchsorted(h >> self.shift, np.arange((1 << lead) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' places, and those of wanted that aren't there."""
        lead = (wanted >> self.shift).view(np.int64)
        at, stop = self.starts[lead], self.starts[lead + 1]
        more = np.flatnonzero(at < stop)
        while len(more):
            more = more[self.h[at[more]] < wanted[more]]
            at[more] += 1
            more = more[at[more] < stop[more]]
        gone = at >= stop
        some = np.flatnonzero(~gone)
        gone[some] = self.h[at[some]] != wanted[some]
        at[gone] = len(self.h)
        return at, np.flatnonzero(gone)


def _counts(order: int):
    """Over (lang, text): (lang, gram, n), counted within the task."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        return h[first], np.bincount(place, n).astype(np.int64), gram[first]

    def of(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # n-grams over the ends of pieces don't count.
        whole = np.concatenate(codes)
        ends = np.cumsum([len(c) for c in codes])[:-1]
        inside = np.ones(len(whole) - order + 1, bool)
        for k in range(order - 1):
            inside[ends - order + 1 + k] = False
        at = np.flatnonzero(inside)
        h, first, n = np.unique(hashes(whole, order)[at], return_index=True, return_counts=True)
        grams = np.ascontiguousarray(whole[at[first][:, None] + np.arange(order)])
        return h, n, grams.view(f"<U{order}").ravel()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        waiting, held = {}, {}

        def read(lang: int) -> None:
            held[lang] = merged([*([held[lang]] if lang in held else []), of(waiting.pop(lang)[0])])

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (_, n, gram) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), lang), pa.int32()), pa.array(gram.tolist(), pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for codes in pieces(text.as_py(), order):
                    parts, size = waiting.setdefault(lang, ([], 0))
                    parts.append(codes)
                    waiting[lang] = parts, size + len(codes)
                    if size + len(codes) >= PIECE:
                        read(lang)
            if sum(len(h[0]) for h in held.values()) > HELD:
                yield from rows()
        for lang in list(waiting):
            read(lang)
        yield from rows()

    return counted


@dataclass
class Model:
    """grams[n - 1] and contexts[n - 1] hold, for order n, the log2 probabilities and the log2 shares left over in each language."""

    langs: list[str]
    order: int
    bits: int
    floor: np.ndarray | None = None
    grams: list[SortedHashes] = field(default_factory=list)
    contexts: list[SortedHashes | None] = field(default_factory=list)
    #: Leads in bits and the share of right answers there; and (language, length class) -> most bits a character, with the class None for any.
    leads: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    shares: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    limits: dict = field(default_factory=dict)

    def cut(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """log2 of each character's probability (from the order-th of codes on) in each language."""
        at, open_ = self.grams[-1].find(self.cut(hashes(codes, self.order)))
        out = np.take(self.grams[-1].rows, at, axis=0)
        for order in range(self.order - 1, -1, -1):
            if not len(open_):
                break
            skip = self.order - order
            if order:
                # The context that is left is as long as the n-gram that is looked for next, and ends one character before.
                out[open_] += self.contexts[order].rows[self.contexts[order].find(self._some(codes, open_ + skip - 1, order))[0]]
                at, gone = self.grams[order - 1].find(self._some(codes, open_ + skip, order))
                out[open_] += self.grams[order - 1].rows[at]
                open_ = open_[gone]
            else:
                out[open_] += self.floor
        return out

    def _some(self, codes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
        """The cut hashes of the n-grams that begin at these places."""
        return self.cut(hashes(codes[starts[:, None] + np.arange(order)].T, order)[0]) if len(starts) else np.empty(0, np.uint64)


def _wide(rows: DataFrame, n_langs: int) -> DataFrame:
    """(lang, gram, a) -> (gram, a): an array of all languages."""
    each = [F.coalesce(F.sum(F.when(F.col("lang") == i, F.col("a"))), F.lit(0)).cast("double") for i in range(n_langs)]
    return rows.groupBy("gram").agg(F.array(*each).alias("a"))


def _hashed(order: int, bits: int):
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = gram_hashes(batch["gram"].tolist(), order) >> np.uint64(64 - bits)
            yield pd.DataFrame({"h": h.astype(np.int64), "gram": batch["gram"], "p": [np.log2(p).astype(np.float32) for p in batch["p"]]})

    return hashed


def _sorted_arrays(rows: DataFrame, n_langs: int, order: int, bits: int) -> SortedHashes:
    """(gram, p) -> at most 2**bits hashes with log2 p. The grams are all of this order."""
    kept = rows.mapInPandas(_hashed(order, bits), "h long, gram string, p array<float>").groupBy("h").agg(F.min_by("p", "gram").alias("p")).toArrow().combine_chunks()
    h = kept["h"].to_numpy().astype(np.uint64)
    by_hash = np.argsort(h)
    p = np.concatenate([np.empty(0, np.float32), *(c.flatten().to_numpy(zero_copy_only=False) for c in kept["p"].chunks)])
    return SortedHashes(h[by_hash], p.reshape(-1, n_langs)[by_hash], bits)


def train(labelled: DataFrame, order: int = 5, hash_bits: int = 22) -> Model:
    """labelled (lang, text) -> the languages' models."""
    labelled = labelled.where("lang is not null").select("lang", "text")
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    model = Model(langs, order, hash_bits)
    number = F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col("lang")) - 1
    counted = labelled.select(number.cast("int").alias("lang"), "text").mapInArrow(_counts(order), "lang int, gram string, n long")
    rows = staged(counted.groupBy("lang", "gram").agg(F.sum("n").alias("a")), "grams")
    by_order = {order: rows}
    for n in range(order - 1, 0, -1):
        rows = staged(rows.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("a")), "grams")
        by_order[n] = rows
    symbols = by_order[1].select("gram").distinct().count()
    if not symbols:
        return Model([], order, hash_bits)
    shorter = None
    for n in range(1, order + 1):
        seen = {r["lang"]: (r["one"], r["two"]) for r in by_order[n].groupBy("lang").agg(F.count_if(F.col("a") == 1).alias("one"), F.count_if(F.col("a") == 2).alias("two")).collect()}
        discounts = [min(max(one / (one + 2 * two) if one else 0.0, 0.1), 0.95) for one, two in (seen.get(i, (0, 0)) for i in range(len(langs)))]
        wide = _wide(by_order[n], len(langs)).withColumn("head", F.substring("gram", 1, n - 1))
        sums = [F.sum(F.get("a", F.lit(i))) for i in range(len(langs))]
        followers = [F.count_if(F.get("a", F.lit(i)) > 0).cast("double") for i in range(len(langs))]
        context = wide.groupBy("head").agg(F.array(*sums).alias("t"), F.array(*followers).alias("k"))
        d = F.array(*[F.lit(x) for x in discounts])
        at = lambda c, i: F.get(c, i)
        index = F.sequence(F.lit(0), F.lit(len(langs) - 1))
        left = F.transform(index, lambda i: F.when(at("t", i) > 0, at(d, i) * at("k", i) / at("t", i)).otherwise(1.0))
        context = staged(context.withColumn("left", left), "contexts")
        joined = wide.join(context, "head")
        if n == 1:
            joined = joined.withColumn("q", F.array_repeat(F.lit(1.0 / (symbols + 1)), len(langs)))
            leftover = context.first()["left"]
            model.floor = np.log2(np.array(leftover, float) / (symbols + 1)).astype(np.float32)
        else:
            joined = joined.withColumn("tail", F.substring("gram", 2, n - 1)).join(shorter.select(F.col("gram").alias("tail"), F.col("p").alias("q")), "tail")
        own = F.transform(index, lambda i: F.when(at("t", i) > 0, F.greatest(at("a", i) - at(d, i), F.lit(0.0)) / at("t", i)).otherwise(0.0) + at("left", i) * at("q", i))
        shorter = staged(joined.select("gram", own.alias("p")), "probabilities")
        model.grams.append(_sorted_arrays(shorter, len(langs), n, hash_bits))
        model.contexts.append(_sorted_arrays(context.select(F.col("head").alias("gram"), F.col("left").alias("p")), len(langs), n - 1, hash_bits) if n > 1 else None)
    return model


_RAW = "best int, bits double, lead double, n long"


def entropies(texts: list[str | None], model: Model) -> Iterator[tuple[int, float, float, int]]:
    """Of each text the best language, its bits a character, its lead over the second in bits, and the number of characters; -1 for a text without a letter."""
    step = max(PIECE // max(len(model.langs), 1), 1 << 14)
    waiting, totals, sizes, room = [], np.zeros((len(texts), max(len(model.langs), 1))), np.zeros(len(texts), np.int64), 0

    def read() -> None:
        """Texts side by side in one array; what would run over their ends is left out."""
        codes = np.concatenate([c for _, c in waiting])
        found = model.log_probabilities(codes)
        starts = np.cumsum([0, *(len(c) for _, c in waiting[:-1])])
        stops = starts + [len(c) - model.order + 1 for _, c in waiting]
        edges = np.stack([starts, stops], axis=1).ravel()
        sums = np.add.reduceat(np.vstack([found, np.zeros((1, found.shape[1]), np.float32)]), edges, axis=0, dtype=float)[::2]
        for (i, c), s in zip(waiting, sums, strict=True):
            totals[i] -= s
            sizes[i] += len(c) - model.order + 1

    if model.langs:
        for i, text in enumerate(texts):
            for whole in pieces(text, model.order):
                for j in range(0, len(whole) - model.order + 1, step):
                    waiting.append((i, whole[j : j + step + model.order - 1]))
                    room += len(waiting[-1][1])
                    if room >= step:
                        read()
                        waiting, room = [], 0
        if waiting:
            read()
    order = np.sort(totals, axis=1)
    for i, n in enumerate(sizes.tolist()):
        if not n:
            yield -1, 0.0, 0.0, 0
        else:
            yield int(totals[i].argmin()), order[i, 0] / n, order[i, 1] - order[i, 0] if totals.shape[1] > 1 else 0.0, n


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with text) -> without text, with best, bits, lead, n."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(entropies(batch.column("text").to_pylist(), sent.value))
            kept = [(f, batch.column(f)) for f in batch.schema.names if f != "text"]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *columns], names=[*(n for n, _ in kept), "best", "bits", "lead", "n"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), _RAW])
    return rows.mapInArrow(scored, schema)


#: Bins of a bit in which a quantile is looked for.
BINS = 64


def _quantiles(rows: DataFrame, keys: list[str], share: float) -> dict[tuple, tuple[int, float]]:
    """Of each key: its rows, and the exact quantile of bits, on the line between two rows. Bins are counted first, so only the values of the one or two that hold the quantile are looked at."""
    binned = rows.withColumn("bin", F.floor(F.col("bits") * BINS).cast("int"))
    bins: dict[tuple, list[tuple[int, int]]] = {}
    for *key, at, n in map(tuple, binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")).collect()):
        bins.setdefault(tuple(key), []).append((at, n))
    places, wanted = {}, []
    for key, counts in bins.items():
        at, counts = (sum(n for _, n in counts) - 1) * share, sorted(counts)
        ends = np.cumsum([n for _, n in counts])
        first, last = np.searchsorted(ends, [int(np.floor(at)), int(np.ceil(at))], side="right")
        places[key] = int(ends[-1]), at - (int(ends[first - 1]) if first else 0)
        wanted += [(*key, counts[i][0]) for i in {int(first), int(last)}]
    if not wanted:
        return {}
    some = F.broadcast(rows.sparkSession.createDataFrame(wanted, ", ".join(f"{k} int" for k in (*keys, "bin"))))
    values: dict[tuple, list[tuple[float, int]]] = {}
    for *key, bits, n in map(tuple, binned.join(some, [*keys, "bin"]).groupBy(*keys, "bits").agg(F.count(F.lit(1)).alias("n")).collect()):
        values.setdefault(tuple(key), []).append((bits, n))
    out = {}
    for key, (n, at) in places.items():
        found = sorted(values[key])
        low, high = (found[int(i)][0] for i in np.searchsorted(np.cumsum([k for _, k in found]), [np.floor(at), np.ceil(at)], side="right"))
        out[key] = n, float(low + (high - low) * (at - np.floor(at)))
    return out


def calibrate(model: Model, labelled: DataFrame, reject: float = 0.001) -> Model:
    """The model, with leads, shares and limits from all of labelled (lang, text). They should be texts that it wasn't trained on."""
    labelled = labelled.where("lang is not null").select("lang", "text")
    if not model.langs:
        return model
    names = F.array(*[F.lit(x) for x in model.langs])
    found = staged(_scored(labelled, model).where("best >= 0").withColumn("guess", F.get(names, F.col("best"))), "calibration")
    right = F.count_if(F.col("guess") == F.col("lang"))
    step = F.floor(4 * F.log2(1 + F.col("lead"))).cast("int")  # some hundred steps, whatever the texts
    steps = found.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), right.alias("right"), F.avg("lead").alias("lead")).orderBy("step").collect()
    if steps:
        # Pool adjacent violators; a pool counts one right answer and one wrong more than it has.
        blocks = []
        for r in steps:
            blocks.append([r["right"], r["n"], [r["lead"]]])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                a, n, at = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, blocks[-1][2] + at]
        model.leads = np.array([x for b in blocks for x in b[2]])
        model.shares = np.array([(b[0] + 1) / (b[1] + 2) for b in blocks for _ in b[2]])
    good = found.where("guess = lang").withColumn("class", F.floor(F.log2("n")).cast("int"))
    enough = int(np.ceil(1 / reject))
    for (best,), (_, most) in _quantiles(good, ["best"], 1 - reject).items():
        model.limits[best, None] = most
    for (best, length), (n, most) in _quantiles(good, ["best", "class"], 1 - reject).items():
        if n >= enough:
            model.limits[best, length] = most
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, lang_pred, score, bits (a character, null without a letter), accepted."""
    found = _scored(docs.select(F.col(id_col), F.col(text_col).alias("text")) if id_col != "text" else docs.select(F.col(text_col).alias("text")), model)
    names = F.array(*[F.lit(x) for x in model.langs]).cast("array<string>")
    some = F.col("best") >= 0
    leads, shares = model.leads.tolist(), model.shares.tolist()
    # Between two leads, the share lies on the line between theirs.
    score = F.lit(shares[0])
    for (x, a), (y, b) in zip(list(zip(leads, shares, strict=True)), list(zip(leads, shares, strict=True))[1:], strict=False):
        if y > x:
            score = F.when(F.col("lead") >= x, a + (b - a) * F.least((F.col("lead") - x) / (y - x), F.lit(1.0))).otherwise(score)
    limit = F.lit(float("inf"))
    for (best, length), most in sorted(model.limits.items(), key=lambda x: (x[0][1] is not None, x[0])):
        fits = F.col("best") == best
        if length is not None:
            fits &= F.floor(F.log2("n")) == length
        limit = F.when(fits, F.lit(most)).otherwise(limit)
    return found.select(
        id_col,
        F.when(some, F.get(names, F.greatest("best", F.lit(0)))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, score).otherwise(0.0).alias("score"),
        F.when(some, F.col("bits")).alias("bits"),
        (some & (F.col("bits") <= limit)).alias("accepted"),
    )


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5
