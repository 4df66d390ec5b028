"""Exact top-k and token counts by section against plain Python."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_counts, topk

LIMIT = 2**63


def brute_top_k(rows, k, scale=64):
    """rows: (id, vector). Python's integers, every row but the query's own."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    whole = [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v))) for i, v in usable]
    out = collections.Counter()
    for n, (i, v) in enumerate(whole):
        if i is None or i % 20:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(v, w)), -LIMIT), LIMIT - 1), j) for m, (j, w) in enumerate(whole) if m != n]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out.update((i, rank, j, score) for rank, (score, j) in enumerate(scored[:k], 1))
    return out


def found(spark, rows, k, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("own", F.lit(2)).repartition(3)
    return collections.Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, **sizes).collect())


def test_falling_norms_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 100 / (1 + i // 8)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 240, 7)]
    cells = spark.sparkContext.accumulator(0)
    search = topk.best_of_cell

    def counted(*args):
        cells.add(1)
        return search(*args)

    monkeypatch.setattr(topk, "best_of_cell", counted)
    assert found(spark, rows, 5, block_rows=24, query_rows=4, head=3) == brute_top_k(rows, 5)
    groups, blocks = 4, 11
    assert 0 < cells.value < groups * blocks  # most cells are never made: their norms are too short


def test_equal_norms_and_small_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.choice((-1, 1))) for _ in range(6)]) for i in range(150)]
    assert found(spark, rows, 20, block_rows=10, query_rows=3, head=2) == brute_top_k(rows, 20)


def test_repeated_ids_huge_components_and_widths(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [2.0]), (3, [1.0, 0.5]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (None, None), (8, [1.0]), (9, []), (10, [-2.0, 1e15]), (11, [-0.0, 0.0]), (12, [1e200, 1.0]), (13, [-1e200, 3e18]), (40, [1e17, -1e17]), (14, [3e15 + 1, 3e15])]
    for k in (3, 30):
        assert found(spark, rows, k) == found(spark, rows, k, block_rows=2, query_rows=1, head=1) == brute_top_k(rows, k)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(20, None)], [(20, [1.0])], [(21, [1.0]), (None, [2.0])]])
def test_no_queries_or_no_candidates(spark, rows):
    assert found(spark, rows, 3) == {}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute_counts(tokenizer, text, spans, rule):
    """Tokens of each span by going through the bytes one by one."""
    owner = []
    for at, char in enumerate(text):
        mine = next((n for n, (a, b) in enumerate(spans) if a is not None and b is not None and a <= at < b), -1)
        owner += [mine] * len(char.encode())
    counts, at = collections.Counter(), 0
    for width in (len(t) for t in token_bytes(tokenizer, text)):
        own = owner[at : at + width]
        at += width
        if rule == "most":
            held = [o for o in own if o >= 0]
            counts[max(held, key=lambda o: (held.count(o), -held.index(o)), default=-1)] += 1
        else:
            counts[own[0] if rule == "first" else own[-1]] += 1
    return counts


def token_bytes(tokenizer, text):
    encoded, from_char = tokenizer.encode(text, add_special_tokens=False), {chr(c): b for b, c in byte_chars().items()}
    for i, token in zip(encoded.ids, encoded.tokens, strict=True):
        yield token.encode() if i == 50256 else bytes(from_char[c] for c in token)


def byte_chars():
    """Byte-level BPE's characters: printable bytes stand for themselves, the rest for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(rest)}


bound = st.none() | st.integers(-3, 40)
sample = st.tuples(st.text(max_size=30) | st.text("ab \n'1é漢", max_size=30) | st.just("x <|endoftext|> y"), st.lists(st.tuples(bound, bound), max_size=6))


@settings(max_examples=12, deadline=None)
@given(st.lists(sample, min_size=1, max_size=8))
def test_given_sections_equal_brute_force(spark, tokenizer, samples):
    df = spark.createDataFrame([(n, t, [{"start": a, "stop": b} for a, b in s]) for n, (t, s) in enumerate(samples)], "doc_id long, text string, parts array<struct<start:int,stop:int>>")
    for rule in token_counts.RULES:
        got = collections.defaultdict(dict)
        for r in token_counts.token_counts(df, sections_col="parts", rule=rule).collect():
            got[r["doc_id"]][r["section"]] = (r["start"], r["stop"], r["n_tokens"])
            assert r["doc_tokens"] == len(tokenizer.encode(samples[r["doc_id"]][0], add_special_tokens=False).ids)
        for n, (text, spans) in enumerate(samples):
            want = brute_counts(tokenizer, text, spans, rule)
            none = {-1: (0, 0, want[-1])} if want[-1] or not spans else {}
            assert got[n] == {i: (*s, want[i]) for i, s in enumerate(spans)} | none


def test_null_sections_and_fields(spark, tokenizer):
    df = spark.createDataFrame([(1, "a title", "The body <|endoftext|> of it", None), (2, None, "body", None), (3, None, None, None)], "doc_id long, title string, text string, parts array<struct<start:int,stop:int>>")
    assert [tuple(r) for r in token_counts.token_counts(df.where("doc_id = 2"), sections_col="parts").collect()] == [(2, -1, 0, 0, 1, 1)]
    got = {(r["doc_id"], r["section"]): (r["start"], r["stop"], r["n_tokens"]) for r in token_counts.token_counts(df, fields=["title", "text"]).collect()}
    whole = "a title\nThe body <|endoftext|> of it"
    want = brute_counts(tokenizer, whole, [(0, 7), (8, len(whole))], "first")
    assert got[1, 0] == (0, 7, want[0]) and got[1, 1] == (8, len(whole), want[1]) and got[1, -1][2] == want[-1]
    assert got[2, 0] == (0, 0, 0) and got[2, 1][2] == 1 and got[3, -1][2] == 1
    with pytest.raises(ValueError):
        token_counts.token_counts(df, fields=["title"], sections_col="parts")
    with pytest.raises(ValueError):
        token_counts.token_counts(df, rule="none")
