"""Language models, lexical search and hard negatives against plain Python, over hard and empty tables too."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import hard
from tessera.llm import hard_negatives, language, lexical, queries

SPACE = " "


def as_read(text):
    """A text as the models read it."""
    import unicodedata

    chars = [c.lower()[0] if unicodedata.category(c)[0] in "LM" else SPACE for c in text or ""]
    return re.sub(" +", " ", "".join(chars)).strip(" ") + " " if any(c.isalpha() for c in text or "") else ""


def kneser_ney(texts, order, symbols):
    """log2 p(gram) for any gram of `order` characters, by the definition."""
    counts = [None] * (order + 1)
    counts[order] = collections.Counter(t[i : i + order] for t in (SPACE * (order - 1) + as_read(x) for x in texts if as_read(x)) for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    total, kinds, discount = [collections.Counter() for _ in counts], [collections.Counter() for _ in counts], [0.0] * (order + 1)
    for n in range(1, order + 1):
        for g, a in counts[n].items():
            total[n][g[:-1]] += a
            kinds[n][g[:-1]] += 1
        one, two = (sum(a == x for a in counts[n].values()) for x in (1, 2))
        discount[n] = min(max(one / (one + 2 * two) if one else 0.0, 0.1), 0.95)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (symbols + 1)
        t = total[n][gram[:-1]]
        return p(gram[1:]) if not t else max(counts[n][gram] - discount[n], 0) / t + discount[n] * kinds[n][gram[:-1]] / t * p(gram[1:])

    return p


@pytest.mark.parametrize("order", [2, 3, 5])
def test_entropies_are_those_of_the_definition(spark, monkeypatch, order):
    monkeypatch.setattr(language, "PIECE", 1 << 12)  # texts in several pieces
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect() if r["lang"]]
    learned, asked = rows[:60], [r["text"] for r in rows[60:80]] + ["x", "漢字 kana", "", None, "12 3!"]
    model = language.train(spark.createDataFrame([(r["lang"], r["text"]) for r in learned], "lang string, text string").repartition(3), order, 60)
    symbols = len({c for r in learned for c in as_read(r["text"])})
    by = {x: kneser_ney([r["text"] for r in learned if r["lang"] == x], order, symbols) for x in model.langs}
    assert model.langs == sorted({r["lang"] for r in learned})
    for text, (best, bits, lead, n) in zip(asked, language.entropies(asked, model), strict=True):
        t = as_read(text)
        if not t:
            assert (best, n) == (-1, 0)
            continue
        padded = SPACE * (order - 1) + t
        sums = [-sum(math.log2(by[x](padded[i : i + order])) for i in range(len(t))) for x in model.langs]
        assert n == len(t) and best == int(np.argmin(sums))
        assert bits == pytest.approx(min(sums) / n, rel=1e-5) and lead == pytest.approx(sorted(sums)[1] - min(sums), rel=1e-3, abs=1e-2)


def test_language_of_held_out_texts(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op11_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""))
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 20 and np.mean(held) > 0.97


def test_held_out_texts_teach_nothing(spark, sf, tmp_path):
    """Whatever the held-out rows and all langs outside of training are, predictions stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = language.remainder(F.col("doc_id")) == 0
    docs.withColumn("lang", F.when(~held, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in df.collect())
    assert rows(queries.op11_language(spark, sf)) == rows(queries.op11_language(spark, str(tmp_path)))


def test_rejection(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.calibrate(language.train(docs.where("doc_id % 2 = 0")), docs.where("doc_id % 2 = 1"), reject=0.01)
    odd = [(1, "zxqj vvkq wwzx qqjz kkxv zzqw xjxj qkzv " * 8), (2, docs.where("doc_id = 3").first()["text"]), (3, "漢字仮名交じり文" * 9), (4, "7 % 5")]
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert not found[1]["accepted"] and found[2]["accepted"] and not found[3]["accepted"] and not found[4]["accepted"]
    assert (found[4]["lang_pred"], found[4]["score"]) == ("und", 0.0) and found[2]["score"] > 0.8


def test_all_labelled_texts_calibrate(spark):
    rng = np.random.default_rng(5)
    letters = {"aa": list("abcdefg "), "bb": list("efghijk ")}
    rows = [(n, lang, "".join(rng.choice(letters[lang], rng.integers(4, 40)))) for n in range(24_000) for lang in [("aa", "bb")[n % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = language.calibrate(language.train(docs.where("doc_id < 2000")), docs, reject=0.01)
    found = [(lang, *f) for (_, lang, _), f in zip(rows, language.entropies([t for *_, t in rows], model), strict=True)]
    right = [(best, bits, int(np.log2(n))) for lang, best, bits, _, n in found if best >= 0 and model.langs[best] == lang]
    expected = {}
    for best in (0, 1):
        for length in (None, *{c for *_, c in right}):
            bits = [b for k, b, c in right if k == best and length in (None, c)]
            if length is None or len(bits) >= 100:
                expected[best, length] = np.percentile(bits, 99)
    assert model.limits.keys() == expected.keys() and all(abs(model.limits[k] - v) < 1e-9 for k, v in expected.items())


@pytest.mark.parametrize("rows", [True, False])
def test_languages_of_hard_tables(spark, rows):
    docs = hard.documents(spark, rows)
    model = language.calibrate(language.train(docs), docs)
    found = [(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, model).collect()]
    assert len(found) == hard.count(docs)
    if rows:
        by = dict(found)
        assert (by[3], by[4], by[9]) == ("und", "und", "und") and by[7] == "fr" and by[100] == "en"
    assert {r["lang_pred"] for r in language.predict(docs, language.Model([], 5, 22)).collect()} <= {"und"}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_ranks(docs, items, k):
    terms = [(i, TERM.findall(small(t))) for i, t in docs]
    terms = [(i, t, collections.Counter(t)) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(len(t) for _, t, _ in terms)
    df = collections.Counter(x for _, _, c in terms for x in c)
    out = []
    for item, text in items:
        asked = [x for x in set(TERM.findall(small(text))) if x in df]
        scores = []
        for i, t, c in terms:
            m = 10 + 90 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in asked)
            scores += [(s, i)] * (s > 0)
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"tile_terms": 3, "block_docs": 4}, {"k": 3, "block_postings": 5}, {"k": 200}])
def test_ranks_of_hard_tables(spark, sizes):
    docs = hard.documents(spark)
    items = [(1, "Hello world"), (2, None), (3, ""), (4, "the very same COPY the the"), (4, "again, again!"), (None, "word1 and0 tail 漢字 é É"), (5, "no such thing anywhere"), (6, "xyzzy")]
    found = lexical.ranked(docs, spark.createDataFrame(items, "item_id long, text string"), **sizes)
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)
    assert got == brute_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], items, sizes.get("k", 10))


@pytest.mark.parametrize("some", [(True, False), (False, True), (False, False)])
def test_ranks_of_empty_tables(spark, some):
    items = spark.createDataFrame([(1, "hello")] * some[1], "item_id int, text string")
    found = lexical.ranked(hard.documents(spark, some[0]), items)
    assert hard.count(found) == 0 and found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_bytes_bound_impacts():
    exact = np.arange(0, 10**6, 7)
    code = lexical.rounded_up(exact)
    assert (lexical._LEAST[code] <= exact).all() and (exact <= lexical._MOST[code]).all()


def brute_negatives(rows, anchor, label, scale=256, n_positive=5, n_negative=10):
    kept = []
    for i, v, x in rows:
        if v is None or x is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(scale * c) for c in v], label(i, x)))
    out = []
    for n, (i, v, x) in enumerate(kept):
        if not anchor(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), j, y) for m, (j, w, y) in enumerate(kept) if m != n]
        score.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, y in [s for s in score if s[2] == x][:n_positive]:
            within = [s for s in score if s[2] != x and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, j, r + 1, k, p, s) for r, (s, k, _) in enumerate(within[:n_negative])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"tile_bytes": 64, "pilot": 2}, {"n_positive": 2, "n_negative": 3, "head": 2, "pilot": 1}])
def test_negatives_of_hard_tables(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "ANCHOR_STEP", 4)
    monkeypatch.setattr(hard_negatives, "ROW_STEP", 8)
    draw = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=6)], int(draw.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, rows[0][1], i % 3) for i in range(40)]  # one hot vector
    rows += [(100, rows[7][1], 1), (100, rows[7][1], 1), (300, None, 1), (301, [1.0, None], 0), (302, [float("nan")], 0), (303, rows[3][1], None), (None, rows[5][1], 1), (None, rows[5][1], 2), (304, [], 0), (305, [0.5], 2), (400, [0.0] * 6, 1), (306, [1e6] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("clash")).withColumn("_uid", F.lit(1)).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, label, **sizes)
    known = {k: sizes[k] for k in ("n_positive", "n_negative") if k in sizes}
    want = brute_negatives(rows, lambda i: i is not None and i % 10 == 0, lambda i, x: (x + 1) % 3 if i is not None and i % 7 == 0 else x, **known)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and want


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard.count(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"))) == 0
    df = spark.createDataFrame([(1, [1.0], 0), (100, [1.0], 0), (200, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard.count(hard_negatives.mine(df, F.col("vec_id") < 0, F.col("label"))) == 0
    assert hard.count(hard_negatives.mine(df, F.col("vec_id") == 200, F.col("label"))) == 0  # no positive
