"""Secret scans in DataFrame operations only: fixed rules, and beside them two character Markov models, of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Rules (leftmost, non-overlapping per kind; matches that are too short are dropped afterwards, so they still take up their characters):
assign: a keyword, a separator and a value of 6 or more characters; access: AKIA..., 20 or more; hex: 24 or more lowercase hex digits.

Models: order 1, over ALPHABET, add-one smoothed, trained from labelled strings (1 random, 0 ordinary). Every maximal run of ALPHABET with min_length or more characters that touches no rule's span gets the sum over its characters of log P(c | previous, random) - log P(c | previous, ordinary); above min_score it becomes a span of kind markov. Numbers, such as those of cards, are ordinary strings, however long. If either label is missing from the sample, the models add nothing.

Spans are kind:start:end in code points, end exclusive, over the whole match, sorted by start and then by kind in the order above, joined by commas. Null text counts as empty: no spans. A very long text is one task's; n spans in it cost about n to the power of 1.5. Rows that repeat are scanned each, ties don't arise, an empty table gives no rows, and other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Without a lower bound the same runs would be found and the short ones then dropped; with it the short ones cost nothing.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_WIDTH = len(ALPHABET) + 1
#: Tasks over which the training sample is dealt.
SAMPLE_PARTS = 32
_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(items: Column) -> Column:
    """An array cut into about as many arrays as each of them has items."""
    step = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / step).cast("int"), F.lit(1)) - 1), lambda i: F.slice(items, i * step + 1, step))


def _starts(lengths: Column) -> Column:
    """Where each of these lengths begins, in a row. Appending to an array copies it, so it is done in chunks."""

    def within(own: Column, at: Column) -> Column:
        state = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(own, state, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def over(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda own: F.aggregate(own, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(chunks, within(sums, F.lit(0)), within))

    return _let(lengths, lambda own: _let(_chunks(own), over))


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """All matches of pattern as (start, kind, stop). keep: an array beside the matches, of whether each stays."""
    none = F.array().cast(_SPAN)
    # The pieces between the matches give the starts: each match begins where the pieces and matches before it end.
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("len")))
    if keep is None:
        pieces = F.transform(pieces, lambda p: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), (p["len"] > 0).alias("stays")))
    else:
        pieces = F.zip_with(pieces, keep, lambda p, k: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), F.coalesce(k, F.lit(False)).alias("stays")))

    def placed(own: Column) -> Column:
        starts = _starts(F.transform(own, lambda p: p["gap"] + p["len"]))
        spans = F.zip_with(own, starts, lambda p, at: F.struct(p["stays"].alias("stays"), F.struct((at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["len"]).alias("stop")).alias("span")))
        return F.transform(F.filter(spans, lambda x: x["stays"]), lambda x: x["span"]).cast(_SPAN)

    return F.when(text.rlike(pattern), _let(pieces, placed)).otherwise(none)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of others, which are sorted: only chunks of these that reach over a span are looked at."""

    def clear(chunks: Column) -> Column:
        overlap = lambda s, o: (o["start"] < s["stop"]) & (s["start"] < o["stop"])
        ends = F.transform(chunks, lambda own: F.struct(F.get(own, F.lit(0))["start"].alias("start"), F.array_max(F.transform(own, lambda o: o["stop"])).alias("stop"), own.alias("own")))
        return _let(ends, lambda known: F.filter(spans, lambda s: ~F.exists(known, lambda c: F.coalesce(overlap(s, c), F.lit(False)) & F.exists(c["own"], lambda o: overlap(s, o)))))

    return F.when(F.size(spans) > 0, _let(_chunks(others), clear)).otherwise(spans)


def base_spans(text: Column) -> list[Column]:
    """The spans of the three rules, an array each."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    return [_spans(text, ASSIGN, 0, long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2)]


def labelled_strings(spark: SparkSession, documents: DataFrame, labels: DataFrame, random_rows: int = 4000, document_rows: int = 2000) -> DataFrame:
    """A training sample (text, label), bounded by its two parameters. The documents are drawn by their ids' hash among the labelled ones.

    Label 1: what the rules find in document_rows labelled documents, and synthetic random strings, digests written in hex, base64 and upper-case alphabets, random_rows of each. Label 0: the words of document_rows documents labelled as of good quality, as they stand and in upper case, identifiers made of neighbouring words, the numbers in these documents, and synthetic numbers of 8 to 24 digits, with and without hyphens, random_rows of each.
    """
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    forms = F.array(F.substring(digest, 1, 40), base64, F.upper(F.regexp_replace(base64, "[+/]", "")))
    digits = F.regexp_replace(F.sha2(F.concat(F.lit("number "), F.col("id").cast("string")), 256), "[a-f]", "")
    numbers = F.array(F.expr("substring(digits, 1, 8 + cast(id % 17 as int))"), F.expr("concat_ws('-', substring(digits, 1, 4), substring(digits, 5, 4), substring(digits, 9, 4), substring(digits, 13, 4))"))
    numbers = spark.range(random_rows).withColumn("digits", digits).select(F.explode(numbers).alias("text"), F.lit(0).alias("label"))
    synthetic = spark.range(random_rows).select(F.explode(forms).alias("text"), F.lit(1).alias("label"))

    def drawn(which: str) -> DataFrame:
        ids = labels.where("doc_id is not null").where(which).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(document_rows)
        # A limit leaves one partition, and what follows makes a row per character.
        return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").limit(document_rows).repartition(SAMPLE_PARTS, "doc_id")

    text = F.coalesce(F.col("text"), F.lit(""))
    values = F.concat(F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ACCESS, HEX)])
    found = drawn("true").select(F.explode(values).alias("text"), F.lit(1).alias("label"))
    good = drawn("quality = 1 and coalesce(toxic, 0) = 0")
    numbers = numbers.unionByName(good.select(F.explode(F.regexp_extract_all(text, F.lit("[0-9]+(?:[/-][0-9]+)*"), F.lit(0))).alias("text"), F.lit(0).alias("label")))
    words = good.select(F.posexplode(F.split(F.col("text"), r"[^A-Za-z]+")), F.col("doc_id")).where("col <> ''").select("doc_id", "pos", F.col("col").alias("word"))
    after = F.coalesce(F.lead("word").over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(""))
    forms = F.array("word", F.upper("word"), F.concat_ws("_", "word", "after"), F.upper(F.concat_ws("_", "word", "after")), F.concat("word", F.initcap("after")))
    plain = words.withColumn("after", after).select(F.explode(forms).alias("text"), F.lit(0).alias("label"))
    return synthetic.unionByName(found).unionByName(plain).unionByName(numbers)


def fit(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of (previous, next) character pairs, row by row; 0 stands for the start and for other characters."""
    index = lambda i: F.expr(f"instr('{ALPHABET}', substring(text, {i}, 1))")
    steps = samples.where("length(text) > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.length("text"))))
    pairs = steps.select("label", F.when(F.col("i") == 1, 0).otherwise(index("i - 1")).alias("a"), index("i").alias("b")).where("b > 0")
    counts = {(r["label"], r["a"], r["b"]): r["count"] for r in pairs.groupBy("label", "a", "b").count().collect()}
    if {label for label, _, _ in counts} < {0, 1}:
        return None
    rows = {(label, a): sum(counts.get((label, a, b), 0) for b in range(1, _WIDTH)) for label in (0, 1) for a in range(_WIDTH)}
    log_p = lambda label, a, b: math.log((counts.get((label, a, b), 0) + 1) / (rows[label, a] + _WIDTH - 1))
    return [0.0 if b == 0 else round(log_p(1, a, b) - log_p(0, a, b), 4) for a in range(_WIDTH) for b in range(_WIDTH)]


def score(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a string of ALPHABET's characters. The ratios become one constant array in the plan."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    walk = F.aggregate(
        codes,
        F.struct(F.lit(0).alias("previous"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("previous"), (acc["sum"] + F.get(table, acc["previous"] * _WIDTH + c)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return walk


def _markov_spans(text: Column, base: Column, ratios: list[float], min_length: int, min_score: float) -> Column:
    pattern = f"[A-Za-z0-9+/_-]{{{min_length},}}"
    random = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: score(t, ratios) > min_score)
    return _let(_spans(text, pattern, 3, random), lambda found: _apart(found, base))


def scan(docs: DataFrame, ratios: list[float] | None, id_col: str = "doc_id", text_col: str = "text", min_length: int = 16, min_score: float = 12.0) -> DataFrame:
    """One row per row of docs: id_col, and base and added, sorted arrays of (start, kind, stop); kind is an index into KINDS.

    min_length and min_score were chosen on held-out strings: of random ones of 16 characters over 0.97 score above 12, of words of 9 letters or more under 0.02.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*base_spans(F.col("_text")))))
    added = F.array().cast(_SPAN) if ratios is None else _markov_spans(F.col("_text"), F.col("base"), ratios, min_length, min_score)
    return rows.withColumn("added", added).drop("_text")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What scan() found, as counts, a digest of the rules' spans and a list of all spans."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        id_col,
        number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )
