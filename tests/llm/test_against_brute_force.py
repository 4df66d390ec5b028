"""Operators that SQL can't express against plain Python over a whole small table."""

import base64
import collections
import hashlib
import html
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import expected, found
from tessera.llm import common, components, exact_dedup, html_extract, mixing, packing, quality, queries, secrets, simhash, token_counts
from tessera.llm.tokens import encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert found(queries.QUERIES[name](spark, sf)) == expected(queries.ORACLES[name], sf)


SPECIAL = st.lists(st.text("ab \n<|endoftext|>", max_size=8) | st.just("<|endoftext|>"), max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60) | st.text("ab \n'1", max_size=60) | SPECIAL)
def test_tokens_are_those_of_the_library(tokenizer, text):
    assert encoder().ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_of_the_tables(tokenizer, docs):
    for r in docs.values():
        assert encoder().ids(r["text"]).tolist() == tokenizer.encode(r["text"], add_special_tokens=False).ids


def test_long_runs_and_special_strings(tokenizer):
    for text in ("ab" * 5000, "x <|endoftext|> y", "漢" * 3000 + " tail <|endoftext|>", "<|endoftext|>" * 500):
        ids = encoder().ids(text)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder().width[ids].sum() == len(text.encode())
    assert encoder().ids("<|endoftext|>").tolist() == [50256]


@pytest.mark.parametrize("sizes", [{}, {"bits_per_hash": 1}, {"bits_per_hash": 8000, "max_bits": 1 << 15}, {"slots_per_row": 1}])  # one filter, a full one, ranges, many bits shared by chance
def test_exact_copies(spark, docs, sizes):
    frame = spark.createDataFrame([(i, r["text"]) for i, r in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact_dedup.duplicate_groups(frame, **sizes).collect()}
    groups = collections.defaultdict(list)
    for i, r in docs.items():
        groups[lower(r["text"])].append(i)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(frame, **sizes).collect()} == {max(ids) for ids in groups.values()}


def test_hot_copies_take_the_broadcast(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same")).when(F.col("id") % 7 == 0, F.concat(F.lit("two"), (F.col("id") / 14).cast("int"))).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.duplicate_groups(many)
    assert got.where("text_sha256 = sha2('same', 256)").select("keep_id", "group_size").distinct().collect() == [(4998, 1667)]
    kept = sorted(r[0] for r in got.where("kept").select("doc_id").collect())
    assert kept == sorted(r[0] for r in exact_dedup.exact_dedup(many).select("doc_id").collect())
    assert got.count() == 5000 and got.where("kept").select("text_sha256").distinct().count() == len(kept)


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(filter(None, blocks))


def test_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.QUERIES["op2_html_extract"](spark, sf).collect():
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_chrome_and_suffixes(spark):
    boiler = "welcome to our site please accept all of the cookies now"
    chrome = "<header>h</header><nav>n</nav><aside>a</aside><form>f</form><div class='cookie-notice'>c</div><div id=comments>m</div><div class=siteFooter>x</div><script>s</script>"
    pages = [
        (1, "http://a.com/1", f"<body>{chrome}<div>{boiler}</div><p>one story<p>its end</body>"),
        (2, "http://A.com/2", f"<body><div>{boiler}</div><p>another &amp; one<br>line</body>"),
        (3, "http://b.com/1", f"<body><div>{boiler}</div></body>"),
        (4, "http://a.com/3", f"<body>{chrome}<article><h1>T</h1><p>{boiler}</p><ul class=share><li>s</ul></article>{boiler}</body>"),
        (5, "http://a.com/4", f"<div>start {boiler} middle words {boiler} stop</div>"),
    ]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "one story\n\nits end", 2: "another & one line", 3: boiler, 4: f"T\n\n{boiler}", 5: "start middle words stop"}


def test_runs_over_short_blocks_and_copies(spark):
    menu = "<div>Home</div><div>About us</div><div>Contact</div><h2>Our latest local news</h2>"
    foot = "<div>Copyright 2020 Some Company</div><div>All rights reserved</div>"
    copy = "<p>this very page is there twice under two addresses of its host"
    pages = [(1, "http://a.com/1", f"<body>{menu}<p>one story of its own{foot}"), (2, "http://a.com/2", f"<body>{menu}<p>quite another{foot}"), (3, "http://b.com/1", copy), (4, "http://b.com/2", copy), (5, "http://c.com/1", menu)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    whole = copy.removeprefix("<p>")
    # The foot has seven words: no run of eight with what is before it in either page.
    end = "Copyright 2020 Some Company\n\nAll rights reserved"
    assert got == {1: f"one story of its own\n\n{end}", 2: f"quite another\n\n{end}", 3: whole, 4: whole, 5: "Home\n\nAbout us\n\nContact\n\nOur latest local news"}


def test_packing(spark, sf, docs, tokenizer):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), part_rows=40, with_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(docs[i]["text"], add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids.tolist() and [r["length"] for r in own[1:]] == [1024] * (len(own) - 1)
        for n, r in enumerate(own):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["piece"] == n and r["ids_crc32"] == zlib.crc32(part.tobytes())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 1024)
    assert len(sequences) <= bound + 2
    told = packing.certificate(spark.createDataFrame([(r["length"], r["sequence_id"]) for r in rows], "length long, sequence_id long"))
    assert told == {"sequences": len(sequences), "bound": bound, "gap": len(sequences) - bound}


@pytest.mark.parametrize("rounds", [0, 8])
def test_parts_come_near_one_pass_over_all(spark, rounds):
    rng = np.random.default_rng(4)
    lengths = np.clip(rng.lognormal(5, 1, 3000).astype(int) + 1, 1, 1023)
    cut = spark.createDataFrame([(n, n, 0, 0, int(x), 0) for n, x in enumerate(lengths)], "doc_id long, _uid long, piece int, start long, length long, ids_crc32 long")
    placed = packing.pack(cut, part_rows=300, rounds=rounds)
    whole = packing.best_fit(lengths, 1024)[0].max() + 1
    used = packing.certificate(placed)["sequences"]
    assert placed.count() == 3000 and (used <= 1.003 * whole or not rounds)
    with pytest.raises(ValueError):
        packing.pack(cut, rounds=99)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_below_the_best_packing(lengths):
    def fewest(left, rooms):
        if not left:
            return len(rooms)
        options = {r: i for i, r in enumerate(rooms) if r >= left[0]}
        return min([fewest(left[1:], [*rooms[:i], r - left[0], *rooms[i + 1 :]]) for r, i in options.items()] + [fewest(left[1:], [*rooms, 20 - left[0]])])

    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    best = fewest(lengths.tolist(), [])
    sequence, offset = packing.best_fit(lengths, 20)
    assert packing.lower_bound(lengths, 20) <= best <= (sequence.max() + 1 if len(lengths) else 0)


def test_raking(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    tokens = {r["doc_id"]: len(re.findall(r"\S+", r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert dict(zip(rows.doc_id, rows.tokens)) == tokens
    base = rows.groupby(["source", "lang", "topic"]).tokens.sum()
    weight = base.astype(float)
    for _ in range(200):
        for margin, power in mixing.POWERS.items():
            goal = base.groupby(margin).sum() ** power
            weight = weight * (goal / goal.sum() * base.sum() / weight.groupby(margin).sum()).reindex(weight.index, level=margin)
    ratio = weight / base
    want = rows.set_index(["source", "lang", "topic"]).index.map(ratio / ratio.max())
    assert np.allclose(rows.probability, want, atol=2e-3)
    draws = [int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 16**13 for i in rows.doc_id]
    assert (rows.kept == (np.array(draws) < rows.probability)).all()


@pytest.mark.parametrize("small_cells", [100_000, 0])
def test_raking_in_one_task_and_by_joins(spark, small_cells):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 50, (4, 3)) * (rng.random((4, 3)) < 0.8)
    cells = spark.createDataFrame([(f"a{i}", f"b{j}", int(base[i, j])) for i in range(4) for j in range(3)], "a string, b string, base long")
    goals = {"a": rng.random(4), "b": rng.random(3)}
    goals = {m: g / g.sum() for m, g in goals.items()}
    targets = {m: spark.createDataFrame([(f"{m}{i}", float(x)) for i, x in enumerate(g)], f"{m} string, share double") for m, g in goals.items()}
    weight = base.astype(float)
    for _ in range(20):
        for axis, goal in ((1, goals["a"]), (0, goals["b"])):
            sums = weight.sum(axis, keepdims=True)
            factor = np.where(sums > 0, goal.reshape(sums.shape) * base.sum() / np.where(sums > 0, sums, 1), 1)
            off = np.abs(factor - 1).max()
            weight = weight * factor
    found = mixing.rake(cells, targets, sweeps=20, tolerance=0, small_cells=small_cells).toPandas().set_index(["a", "b"])
    for i in range(4):
        for j in range(3):
            assert found.weight[f"a{i}", f"b{j}"] == pytest.approx(weight[i, j])
    assert found.margin_error.max() >= off * 0.99


def test_given_targets_are_met(spark, sf):
    want = spark.createDataFrame([("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1)], "lang string, share double")
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), targets={"lang": want}, powers={"lang": 1.0}).toPandas()
    got = (rows.tokens * rows.probability).groupby(rows.lang).sum()
    assert (got / got.sum()).to_dict() == pytest.approx({"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, abs=1e-6)


def test_section_counts(spark, sf, docs, tokenizer):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    by_doc = collections.defaultdict(dict)
    for r in token_counts.token_counts(frame).collect():
        by_doc[r["doc_id"]][r["section"]] = (r["start"], r["stop"], r["n_tokens"], r["doc_tokens"])
    for i, own in by_doc.items():
        text = docs[i]["text"]
        encoded = tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(n for _, _, n, _ in own.values()) == len(encoded) == next(iter(own.values()))[3]
        assert [text[a:b] for a, b, _, _ in (own[k] for k in sorted(own))] == text.splitlines(keepends=True) if "\r" not in text and "\x85" not in text else True
        at, line_of = 0, np.repeat(np.arange(len(own)), [len(text[a:b].encode()) for a, b, _, _ in (own[k] for k in sorted(own))])
        counts = collections.Counter()
        for width in encoder().width[encoded]:
            counts[int(line_of[at])] += 1
            at += width
        assert {k: v[2] for k, v in own.items() if v[2]} == counts


def test_crossing_tokens():
    spans = np.array([[0, 3], [3, 9]])
    tokens = np.array([2, 3, 4, 2])  # 0-2, 2-5, 5-9, 9-11
    assert token_counts.attribute(tokens, spans, "first").tolist() == [2, 1, 1]
    assert token_counts.attribute(tokens, spans, "last").tolist() == [1, 2, 1]
    assert token_counts.attribute(tokens, spans, "most").tolist() == [1, 2, 1]
    assert token_counts.attribute(tokens, spans[:0], "most").tolist() == [4]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("hot", [4096, 1])
def test_fingerprints_and_components(spark, docs, hot):
    texts = {i: r["text"] for i, r in docs.items()} | {1000 + i: t for i, t in enumerate(["", None, "one", "One", "one two", " ".join(map(str, range(400))), " ".join(map(str, range(399))), " ".join(map(str, range(1, 400)))])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_groups(frame, hot=hot).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    least = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {i: r["component_id"] for i, r in got.items()} == least


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.lists(st.integers(0, 63), max_size=4), max_size=60))
def test_gray_index_equals_brute_force(center, flips):
    fps = np.array(sorted({center ^ sum(1 << b for b in set(f)) for f in flips} | {center}), np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    pairs: list = []
    labels = simhash.classes(fps, 2, pairs)
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 2]
    least = brute_components(range(len(fps)), linked)
    assert labels.tolist() == [least[i] for i in range(len(fps))]
    assert brute_components(range(len(fps)), np.concatenate(pairs, axis=1).T.tolist()) == least


def test_bit_counts():
    words = np.random.default_rng(0).integers(0, 2**63, (777, 3)).astype(np.uint64)
    assert (simhash.bit_counts(words) == np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0)).all()


@pytest.mark.parametrize("one_task", [1 << 21, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100)


def five_words(text):
    words = lower(text).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_dedup_by_similarity(spark, docs):
    rng = np.random.default_rng(3)
    texts = {i: r["text"] for i, r in docs.items()}
    originals = [i for i, t in texts.items() if len(t.split()) > 60]
    for n, i in enumerate(originals):
        words = texts[i].split()
        for at in rng.choice(len(words), max(1, len(words) // 150), False):
            words[at] = "changed"
        texts[10_000 + n] = " ".join(words)
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = {i: five_words(t) for i, t in texts.items()}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    gone = [10_000 + n not in kept for n, i in enumerate(originals) if similar(i, 10_000 + n) >= 0.8]
    assert len(gone) > 50 and np.mean(gone) >= 0.95
    for i in set(texts) - kept:
        assert max(similar(i, j) for j in texts if j < i) >= 0.7


def test_near_dedup_uses_the_gray_order_index(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{n}" for n in range(5000)]
    texts = {i: " ".join(rng.choice(vocabulary, 400)) for i in range(0, 40, 2)}
    texts |= {i + 1: t + " more" for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = simhash.wide_fingerprints(docs, "doc_id", "text", 5, 1024)
    # No two share a band.
    distinct = prints.select(F.col("_id").alias("key"), "fp", F.transform(F.sequence(F.lit(0), F.lit(simhash.BANDS - 1)), lambda n: F.xxhash64("_id", n)).alias("nodes"), "few", F.col("_id").alias("least"), "th")
    short = {r["_id"]: int.from_bytes(r["fp"][:8], "big") for r in prints.collect()}
    expected = {(i, i + 1) for i in range(0, 40, 2) if (short[i] ^ short[i + 1]).bit_count() <= 2}
    found = {(min(r), max(r)) for r in simhash.similar_links(docs, distinct, "doc_id", "text", 5, 0.8, 1024, 1000).select("a", "b").distinct().collect()}
    assert len(expected) > 10 and {(a, b) for a, b in found if a != b} == expected


def test_candidates_at_the_limit_at_any_size():
    rng = np.random.default_rng(5)
    met = []
    for _ in range(1500):  # sets of similarity 0.8: 80 shared of 100
        hashes = rng.integers(0, 2**63, 100).astype(np.uint64)
        met.append(bool(set(simhash.nodes_of(np.sort(hashes[:90]))) & set(simhash.nodes_of(np.sort(hashes[10:])))))
    assert np.mean(met) >= 0.997 and simhash.chance(0.8) >= 0.999


def templated_family(members, length=220):
    """Texts of one template with slots filled anew: pairs lie on both sides of similarity 0.8."""
    rng = np.random.default_rng(11)
    template = [f"w{i}" for i in range(length)]
    texts = {}
    for n in range(members):
        own, at = list(template), rng.choice(length, rng.integers(2, 7), False)
        for i in at:
            own[i] = f"x{rng.integers(0, 3)}"
        texts[n] = " ".join(own)
    return texts


def test_templated_family_equals_brute_force(spark):
    texts = templated_family(300)
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = {i: five_words(t) for i, t in texts.items()}
    least = brute_components(texts, [(a, b) for a in texts for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    assert kept == {i for i in texts if least[i] == i}


def test_texts_that_share_an_id_are_told_apart(spark):
    """100 texts at similarity 0.85 to a kept one, under ids that other texts have too: each goes, as under an id of its own."""
    rng = np.random.default_rng(23)
    rows, copies = [], []
    for n in range(100):
        words = [f"w{n}x{i}" for i in range(300)]
        near = list(words)
        for at in range(20, 300, 60):  # five words of 300 change 25 of 296 shingles each way
            near[at] = "changed"
        a, b = five_words(" ".join(words)), five_words(" ".join(near))
        assert 0.8 < len(a & b) / len(a | b) < 0.87
        rows.append((n, " ".join(words)))
        copies.append((1000 + n, " ".join(near)))
        rows += [(n, " ".join(f"q{rng.integers(1 << 40)}" for _ in range(50))), (1000 + n, " ".join(f"q{rng.integers(1 << 40)}" for _ in range(50)))]
    for shift in (0, 5000):  # shared ids, then ids of their own
        frame = spark.createDataFrame(rows + [(i + shift, t) for i, t in copies], "doc_id long, text string").repartition(4)
        kept = {r["text"] for r in simhash.near_dedup(frame).collect()}
        assert sum(t in kept for _, t in copies) == 0


def test_families_of_short_texts_equal_brute_force(spark):
    """Few shingles: fingerprints say little, sets decide."""
    rng = np.random.default_rng(29)
    texts = {n: " ".join(f"v{x}" for x in np.where(rng.random(14) < 0.06, rng.integers(100, 103, 14), np.arange(14) + 20 * (n % 3))[: rng.integers(3, 15)]) for n in range(150)}
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = {i: five_words(t) for i, t in texts.items()}
    least = brute_components(texts, [(a, b) for a in texts for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    assert kept == {i for i in texts if least[i] == i}


def test_a_cut_by_a_bound():
    m = simhash.most_apart(0.8, 1024)
    q, p = m / 1024, simhash.bits_apart(0.8, 1024) / 1024
    assert 200 < m < 300 and np.exp(-1024 * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p)))) <= 1e-9


def test_a_rejected_pair_stands_for_no_other():
    zero = np.zeros(16, np.uint64)
    flipped = lambda bits: np.packbits([i in bits for i in range(1024)], bitorder="little").view(np.uint64)
    c, a, b, d = zero, flipped(range(150)), flipped(range(140)) ^ flipped(range(500, 510)), flipped(range(100))
    words = np.stack([c, a, b, d])
    got = {(min(p), max(p), n) for *p, n in simhash.pairs_between(words, np.arange(4), 20, 160).T.tolist()}
    assert got == {(1, 2, 20), (0, 1, 150), (0, 2, 150), (0, 3, 100), (1, 3, 50), (2, 3, 50)}


def test_large_nodes_are_dealt_out_and_lose_nothing(spark):
    texts = templated_family(300)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = [{r["doc_id"] for r in simhash.near_dedup(frame, node=node).collect()} for node in (1024, 8)]
    assert kept[0] == kept[1]
    rows = spark.range(500).selectExpr("id % 2 as node", "id as key", "if(id < 400, 0, id % 7 + 1) as known")
    cells = collections.defaultdict(set)
    for r in simhash._cells(rows, 60).collect():
        cells[r["node"]].add(r["key"])
    known = {r["key"]: r["known"] for r in rows.collect()}
    met = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    assert {(a, b) for a in known for b in known if a < b and a % 2 == b % 2 and known[a] != known[b]} <= met
    assert max(map(len, cells.values())) < 120


def test_unsure_pairs_are_given_once(spark):
    """Brute force over the shared nodes, with nodes dealt out in cells and without."""
    rng = np.random.default_rng(17)
    members, bands = 240, simhash.BANDS
    words = rng.integers(0, 2**63, 16).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 63, (members, 16)).astype(np.uint64))
    nodes = np.arange(bands) * 100 + rng.integers(0, 3, (members, bands))
    known = np.where(np.arange(members) < 90, 0, np.arange(members))
    rows = [(i, int(known[i]), words[i].tobytes(), nodes[i].tolist()) for i in range(members)]
    distinct = spark.createDataFrame(rows, "key long, known long, fp binary, nodes array<long>")
    pair = lambda a, b: int(np.bitwise_count(words[a] ^ words[b]).sum())
    true = {(a, b, pair(a, b)) for a in range(members) for b in range(a + 1, members) if known[a] != known[b] and (nodes[a] == nodes[b]).any()}
    for node in (1024, 16):
        shared = simhash._close_pairs(distinct, list(range(bands)), 0, 1024, node)
        assert {tuple(r) for r in shared.collect()} == true
    # Before pairs are made distinct there are as many.
    homes = distinct.select(simhash.F.explode("nodes").alias("node"), "key", "known")
    packed = {i: nodes[i].astype(">i8").tobytes() for i in range(members)}
    dealt = simhash._cells(homes, 16).toPandas().sort_values("node", kind="stable")
    frame = dealt.assign(fp=[words[k].tobytes() for k in dealt["key"]], nodes=[packed[k] for k in dealt["key"]])[["node", "key", "known", "fp", "home", "twin", "nodes"]]
    made = [tuple(r) for out in simhash._node_pairs(0, 1024)(iter([frame])) for r in out.itertuples(index=False)]
    assert len(made) == len(set(made)) and set(made) == true


RULES = [
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secrets(spark, sf, docs):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = {i: r["text"] for i, r in docs.items()} | {5000: f"é password = 'abc' token: xyz123 tokenKEY=secret=AAAAAAAA AKIA{'Q' * 30} AKIA12 {'deadbeef' * 4}", 5001: f"𝒳 use {key} for it", 5002: None, 5003: "a_rather_long_identifier_of_words"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ratios = secrets.fit(secrets.labelled_strings(spark, frame, spark.read.parquet(f"{sf}/labels.parquet")))
    got = {r["doc_id"]: r for r in secrets.report(secrets.scan(frame, ratios)).collect()}
    for i, text in texts.items():
        base = sorted((m.start(), k, m.end()) for k, (pattern, keep) in enumerate(RULES) for m in pattern.finditer(text or "") if keep(m))
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
    assert got[5001]["spans"] == f"markov:6:{6 + len(key)}" and got[5003]["n_markov"] == 0


def test_models_on_held_out_strings(spark, sf):
    ratios = secrets.fit(secrets.labelled_strings(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    digests = [hashlib.sha256(f"held {i}".encode()) for i in range(100)]
    forms = {"hex": [d.hexdigest()[:16] for d in digests], "base64": [base64.b64encode(d.digest()).decode()[:16] for d in digests], "base32": [base64.b32encode(d.digest()).decode()[:16] for d in digests], "digits": [str(int(d.hexdigest(), 16))[:16] for d in digests]}
    tables = "benchmark conversations"
    words = {r[0] for t in tables.split() for r in spark.read.parquet(f"{sf}/{t}.parquet").select(F.explode(F.split("text", r"[^A-Za-z]+"))).distinct().collect() if len(r[0]) > 8}
    forms |= {"words": list(words), "camel": [a + b.title() for a, b in zip(sorted(words), sorted(words)[1:])], "snake": [f"{a}_{b}" for a, b in zip(sorted(words), sorted(words)[1:])]}
    rows = spark.createDataFrame([(t, kind) for kind, texts in forms.items() for t in texts], "t string, kind string")
    hits = dict(map(tuple, rows.select("kind", (secrets.score(F.col("t"), ratios) > 12).cast("int").alias("hit")).groupBy("kind").agg(F.avg("hit")).collect()))
    assert min(hits[k] for k in ("hex", "base64", "base32", "digits")) > 0.97 and max(hits[k] for k in ("words", "camel", "snake")) < 0.02, hits


def test_markov_spans_equal_plain_python(spark, sf, docs):
    """Every maximal run of 16 or more that touches no rule's span, by its sum of log ratios; numbers are never spans, planted keys are."""
    keys = [base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode().strip("=")[: 16 + i % 24] for i in range(40)]
    numbers = ["4111111111111111", "12345678901234567890123", "2024-11-28/2023-01-01", "0049-171-1234567-89"]
    texts = {i: r["text"] for i, r in docs.items()} | {7000 + i: f"see {k} and password={k}x there" for i, k in enumerate(keys)} | {8000 + i: f"card {n} paid" for i, n in enumerate(numbers)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ratios = secrets.fit(secrets.labelled_strings(spark, frame, spark.read.parquet(f"{sf}/labels.parquet")))
    width, found = len(secrets.ALPHABET) + 1, 0
    for r in secrets.scan(frame, ratios).collect():
        base = [(x["start"], x["stop"]) for x in r["base"]]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", texts[r["doc_id"]] or ""):
            codes = [0, *(secrets.ALPHABET.index(c) + 1 for c in m[0])]
            if sum(ratios[a * width + b] for a, b in zip(codes, codes[1:])) > 12.0 and not any(a < m.end() and m.start() < b for a, b in base):
                want.append((m.start(), m.end()))
                assert not m[0].strip("-/").replace("-", "").replace("/", "").isdigit()
        assert [(x["start"], x["stop"]) for x in r["added"]] == want
        found += len(want) * (7000 <= r["doc_id"] < 8000)
    assert found >= 38


def test_planted_random_strings(spark, sf):
    """Random strings that no rule takes are put into documents of a table; the models find them, and next to nothing else."""
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ratios = secrets.fit(secrets.labelled_strings(spark, frame, labels))
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    planted = {}
    for i, text in texts.items():
        key = base64.b64encode(hashlib.sha256(f"plant {i}".encode()).digest()).decode()[: 20 + i % 20]
        at = len(text) // 2
        at = text.find(" ", at) if text.find(" ", at) >= 0 else len(text)
        texts[i] = f"{text[:at]} {key} {text[at:]}"
        planted[i] = f"markov:{at + 1}:{at + 1 + len(key)}"
    got = {r["doc_id"]: r["spans"].split(",") for r in secrets.report(secrets.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ratios)).collect()}
    assert sum(planted[i] in got[i] for i in texts) >= 0.97 * len(texts)
    others = [texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for i in texts for s in got[i] if s.startswith("markov") and s != planted[i]]
    assert all(re.fullmatch(r"[0-9+/_-]{16,}", o) for o in others), others  # card numbers


def test_many_spans_in_one_text(spark):
    text = " ".join(["deadbeef" * 4, "wJalrXUtnFEMIK7MDENGbPxRfiCY", "token=abcdefgh"] * 8000)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ratios = secrets.fit(secrets.labelled_strings(spark, frame, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")))
    assert ratios is not None
    begin = time.monotonic()
    found = secrets.report(secrets.scan(frame, ratios)).first()
    assert (found["n_hex"], found["n_assign"]) == (8000, 8000) and time.monotonic() - begin < 30
    spans = [tuple(map(int, s.split(":")[1:])) for s in found["spans"].split(",")]
    assert spans == sorted(spans) and {text[a:b][:5] for a, b in spans} <= {"deadb", "wJalr", "token"}


def test_quality_on_held_out_labels(spark):
    where = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    judged = quality.judge(spark.read.parquet(f"{where}/documents.parquet"), labels.where("doc_id % 2 = 0")).drop("quality")
    rows = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.05


def brute_prior(rate, n, parent):
    spread, noise, variance = np.mean((rate - parent) ** 2), np.mean(parent * (1 - parent) / n), np.mean(parent * (1 - parent) * np.ones(len(rate)))
    return np.clip(variance / max(spread - noise, 1e-9) - 1, 1, 1e6)


@pytest.mark.parametrize("broadcast_sites", [100_000, 0])
def test_judgements_equal_brute_force(spark, broadcast_sites):
    """Grouped empirical Bayes in numpy over a whole table, and the filter's rows."""
    where = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    rows = quality.judge(frame, labels, broadcast_sites=broadcast_sites).toPandas().merge(frame.select("doc_id", "source", "lang", "text").toPandas(), on="doc_id")
    model = quality.train(frame, labels)
    assert np.allclose(rows.evidence, model.evidence(rows.text))
    rows["p"] = 1 / (1 + np.exp(-(rows.evidence + model.prior)))
    hosts = rows.groupby("source").p.agg(["sum", "count"])
    overall = hosts["sum"].sum() / hosts["count"].sum()
    a = brute_prior((hosts["sum"] / hosts["count"]).to_numpy(), hosts["count"].to_numpy(), np.full(len(hosts), overall))
    host_rate = (hosts["sum"] + a * overall) / (hosts["count"] + a)
    paths = rows.groupby(["source", "lang"]).p.agg(["sum", "count"])
    parent = paths.index.get_level_values(0).map(host_rate).to_numpy()
    b = brute_prior((paths["sum"] / paths["count"]).to_numpy(), paths["count"].to_numpy(), parent)
    path_rate = (paths["sum"] + b * parent) / (paths["count"] + b)
    want = path_rate.loc[list(zip(rows.source, rows.lang))].to_numpy()
    assert np.allclose(rows.host_rate, rows.source.map(host_rate)) and np.allclose(rows.path_rate, want)
    odds = rows.evidence + np.log(want / (1 - want))
    assert np.allclose(rows.quality, 1 / (1 + np.exp(-odds))) and (rows.kept == (odds >= 0)).all() and 0 < rows.kept.sum() < len(rows)
    kept = {r["doc_id"] for r in quality.quality_filter(frame, labels, broadcast_sites=broadcast_sites).collect()}
    assert kept == set(rows.doc_id[rows.kept])


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [("h1", "h1/a", 9.0)] * 200 + [("h1", "h1/b", -9.0)] + [("h2", "h2/a", -9.0)] * 200 + [("h2", "h2/b", 9.0)]
    got = {r["site"]: r["path_rate"] for r in quality.site_rates(spark.createDataFrame(rows, "site_host string, site string, evidence double"), 0.0).collect()}
    assert got["h1/a"] > 0.9 > got["h1/b"] and got["h2/a"] < 0.1 < got["h2/b"]


def test_shards(spark, sf, docs):
    rows = queries.QUERIES["op7_sharding"](spark, sf).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(docs) and set(sizes) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= largest


def test_scratch_is_cleared_and_shared(spark, tmp_path):
    mark = common.scratch_mark()
    one, two = common.staged(spark.range(3), "one"), common.staged(spark.range(4), "two")
    common.clear_scratch(spark, common.written_since(mark), unless_read_by=two)
    assert two.count() == 4 and len(common.written_since(mark)) == 1
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        one.count()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)


def test_pipeline(spark, sf, docs, tokenizer):
    rows = corpus_pipeline.run(spark, sf).collect()
    good = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    last = {lower(docs[i]["text"]): i for i in sorted(good)}
    left = set(last.values())
    sets = {i: five_words(docs[i]["text"]) for i in left}
    least = brute_components(left, [(a, b) for a in left for b in left if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    left = {i for i in left if least[i] == i}
    frame = spark.createDataFrame([docs[i] for i in sorted(left)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    mixed = {r["doc_id"] for r in mixing.mix(frame).where("kept").collect()}
    length = collections.Counter()
    for r in rows:
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(tokenizer.encode(docs[i]["text"], add_special_tokens=False).ids) + 1 for i in mixed}
