"""Main text: repeated substrings against brute force, and structure by small pages."""

import collections
import random
import time

import pytest

from tessera.llm import html_extract


def brute_covered(streams, least):
    """streams: (host, body, tokens) -> for each, which tokens lie in a substring of `least` tokens that another body of the host has."""
    bodies = collections.defaultdict(set)
    for host, body, tokens in streams:
        for i in range(len(tokens) - least + 1):
            bodies[host, tuple(tokens[i : i + least])].add(body)
    out = []
    for host, _, tokens in streams:
        covered = [False] * len(tokens)
        for i in range(len(tokens) - least + 1):
            if len(bodies[host, tuple(tokens[i : i + least])]) > 1:
                covered[i : i + least] = [True] * least
        out.append(covered)
    return out


@pytest.mark.parametrize("least", [2, 5, 8, 13])
def test_repeated_substrings_equal_brute_force(spark, monkeypatch, least):
    rng = random.Random(least)
    shared = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(least - 1, 3 * least))] for _ in range(12)]
    pages, streams = [], []
    for n in range(150):
        host = rng.choice(["a.com", "a.com", "b.com", "c.org"])
        pieces = [rng.choice(shared) if rng.random() < 0.4 else [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 20))] for _ in range(rng.randint(1, 6))]
        chrome = [rng.random() < 0.3 for _ in pieces]
        body = "".join(f"<nav>{' '.join(p)}</nav>" if c else f"<p>{' '.join(p)}</p>" for p, c in zip(pieces, chrome))
        copies = 2 if rng.random() < 0.1 else 1
        for _ in range(copies):
            pages.append((len(pages), f"http://{host}/{len(pages)}", body))
            own = "\n".join(" ".join(p) for p, c in zip(pieces, chrome) if not c)
            streams.append((host, own, [w for p in pieces for w in p], [c for p, c in zip(pieces, chrome) for _ in p], pieces, chrome))
    covered = brute_covered([s[:3] for s in streams], least)
    for limit in (html_extract._BROADCAST, 0):
        monkeypatch.setattr(html_extract, "_BROADCAST", limit)
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
        got = {r["page_id"]: r for r in html_extract.extract(df, min_tokens=least).collect()}
        for n, (_, _, tokens, _, pieces, chrome) in enumerate(streams):
            assert (got[n]["n_tokens"], got[n]["n_repeated"]) == (len(tokens), sum(covered[n]))
            at, kept = 0, []
            for p, c in zip(pieces, chrome):
                if not c:
                    kept.append(" ".join(w for i, w in enumerate(p, at) if not covered[n][i]))
                at += len(p)
            assert got[n]["text"] == "\n\n".join(filter(None, kept))
    assert any(any(c) for c in covered) and not all(all(c) for c in covered)


def text_of(page):
    found = html_extract.blocks(page)
    return [found[n].text for n in html_extract.text_blocks(found)[1]]


def test_structure():
    assert text_of("<main>intro<article><p>one<p>two</article>outro</main>") == ["one", "two"]
    assert text_of("<main>the text</main><article>a teaser</article>") == ["the text"]
    assert text_of("<article><p class='notice-board'>stays<p class='cookie-notice'>goes<div class='ad-slot'>goes</div><p>on</article>") == ["stays", "on"]
    assert text_of("<article class='post ad-free'><p>text<article class='comment'><p>mine</article></article>") == ["text"]
    assert text_of("<article><header><h1>T</h1></header><p>a <span class=ad>buy</span> b<aside>x</aside><footer>f</footer></article>") == ["T", "a b"]
    assert text_of("<div>open</b></i></div></section></p>text<nav>menu") == ["open", "text"]
    assert text_of("<div role='main'><p>x</div><div>y</div>") == ["x"]
    assert text_of("") == [] and text_of("plain") == ["plain"]


def test_names_that_only_hold_such_a_word():
    """Main text stays whatever its class says, comments, teasers and hidden parts go."""
    inner = "<div class='{}'><p>on</div>"
    for name in ("share-price", "modal-verbs", "social-history", "widget-theory", "menu-planning recipe"):
        assert text_of(f"<article><p>text{inner.format(name)}</article>") == ["text", "on"], name
    for name in ("share-buttons", "social-links", "cookie-notice", "ad-slot", "adslot", "gdpr", "responses", "related-posts", "newsletter-signup", "user-review", "reader-comments"):
        assert text_of(f"<article><p>text{inner.format(name)}</article>") == ["text"], name
    body = "<p>" + "long text of the article itself " * 9
    assert text_of(f"<main><article>{body}</article><article class='user-review'><p>mine</article></main>") == [body[3:].strip()]
    assert text_of(f"<main><article>{body}</article><article><a href=x>Another story</a><p>More</article></main>") == [body[3:].strip()]
    assert text_of(f"<main><article>{body}</article><article><p>A second part of it.</article></main>") == [body[3:].strip(), "A second part of it."]
    assert text_of(f"<article>{body}<p style='display: none'>unseen<p style='color:red'>seen</article>") == [body[3:].strip(), "seen"]
    assert text_of("<article class='review'><p>A film.</article>") == ["A film."]


@pytest.mark.parametrize("form", ["<div>|</section>", "<div><b>|</i>", "<p>|</article>", "<span>|</div>", "<|", "<a b=\"|", "<!--|", "<nav>|</nav", "&amp|;", "<div><article>|</main>", "<title>|"])
def test_broken_pages_take_linear_time(form):
    start, end = form.split("|")

    def seconds(n):
        at = time.process_time()
        html_extract.blocks(start * n + end * n)
        return time.process_time() - at

    few = min(seconds(10_000) for _ in range(3))
    assert min(seconds(40_000) for _ in range(3)) < 10 * few + 0.05
