"""Main text of web pages: structure tells what a page says of itself, and a suffix array of its host what pages repeat.

Structure. A page is read into blocks, one per block-level element, in page order. What is inside scripts and styles isn't text. What is inside forms, menus, headers, footers, sidebars, notices, adverts and comments, by element, role, or class and id names, is chrome. Inside an article an element is chrome only if a name ends in such a word (cookie-notice, not notice-board), or has one and ends in a word for a part of a page (share-buttons and social-links, not share-price and social-history). An article or main is chrome only if a name is such a word, or one of what readers write (user-review), or if it is a teaser: most of its words are links, and another article of the page is four times as long. What is hidden, by attribute or by style, is chrome. The text of a page is its articles inside main, else main, else its articles; these blocks are whole, even if other pages repeat them. Where a page has none of them, its open blocks (all that isn't chrome) make the text, less what the host repeats.

Suffixes. The token streams of all pages of a host, chrome and articles included, are taken together, and a token is covered if it lies in a substring of min_tokens or more that a page of other contents of the host has too. A substring may run over the ends of blocks. Pages of the same text blocks are copies and don't cover each other. Covered tokens of open blocks go; unique runs stay. n_repeated tells for every page how many tokens are covered.

The array is sparse, and no task holds a host. Any substring of min_tokens holds a sample: of each row of neighbouring suffixes, the one whose first tokens, three quarters of min_tokens, have the least hash. Only samples are dealt out, as hashes of 8 bytes, combined within tasks first; those that pages share lead to the full suffixes around them, whose first min_tokens tokens are dealt out and compared in the same way. What a page shares comes back to it by its own hash. So the work is in proportion to the tokens, a host of any size is spread over all tasks, and a passage on very many pages is a row per task.

White space within a block becomes one space, character references are decoded, blocks are joined by two line feeds. Null or empty html gives empty text and counts no tokens. Very long and broken pages take linear time: unmatched end tags cost one look each. Rows that repeat are pages of their own, which are copies. A null url is a host of its own. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import left_join_groups, staged

# Elements of HTML by their role, and words in class and id names that mark chrome.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
CHROME = frozenset("aside button dialog footer form head iframe menu nav noscript object select svg template".split())
BLOCK = frozenset("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACE = frozenset("br td th".split())
CHROME_NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that end the names of parts of a page, whatever they hold; who writes below an article, and what; names that are one word of two.
PARTS = frozenset("area bar block box button buttons container form group icons item items links list module panel posts row section signup slot stack stream thread unit wrap wrapper".split())
READERS = frozenset("community customer guest member reader readers user users visitor".split())
READER_TEXTS = frozenset("answer answers comment comments feedback opinion opinions replies reply response responses review reviews".split())
ONE_WORD_NAMES = frozenset("adslot adunit adbox gdpr teaser teasers responses replies recommended recommendations".split())
CHROME_ROLES = frozenset("banner complementary contentinfo form navigation search".split())

#: A comment, a declaration, or a tag. Quantifiers never give back, so no page takes more than linear time.
_MARKUP = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>|/?+([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z)))""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"""\bstyle\s*+=\s*+["'][^"']*?(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+>?", re.I) for tag in RAW}
_MAIN_ROLE = re.compile(r"""role\s*=\s*["']?main\b""", re.I)
#: A teaser has this share of its characters in links, and so many times fewer than the longest article.
LINKED, LONGER = 0.5, 4


#: Elements that hold text rather than other parts of a page.
TEXT = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th tr".split())
#: What a block is part of; a page's text is the greatest of the last three that it has.
CHROME_PART, OPEN, ARTICLE, MAIN, ARTICLE_IN_MAIN = range(5)


class Block(NamedTuple):
    part: int
    text: str
    #: The number of the outermost article that it is in, from 1; 0 outside. And how many characters of it are in links.
    article: int = 0
    linked: int = 0


def _is_chrome(tag: str, rest: str, is_core: bool, in_core: bool) -> bool:
    if not is_core and (tag in CHROME or tag == "header" and not in_core):
        return True
    if "=" not in rest and "hidden" not in rest or tag in ("body", "html"):
        return False
    if ("style" in rest or "STYLE" in rest) and _UNSEEN.search(rest):
        return True
    for name, value in _NAMES.findall(rest):
        value = value.strip("\"'")
        name = name.lower()
        if name == "hidden" or name == "role" and value.lower() in CHROME_ROLES and not in_core:
            return True
        if name not in ("class", "id"):
            continue
        words = [[w.lower() for w in _WORDS.findall(n)] for n in value.split()]
        if any(own and own[-1] in READER_TEXTS and READERS & set(own[:-1]) for own in words):
            return True
        if is_core:  # else only a whole name counts
            words = [w for w in words if len(w) == 1]
        elif in_core:
            words = [w if w[-1:] and w[-1] in PARTS else w[-1:] for w in words]
        if any(w in CHROME_NAMES or w in ONE_WORD_NAMES and not is_core for own in words for w in own):
            return True
    return False


class _Open:
    """The open elements. Pushing, popping and asking for one take constant time."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, bool, bool, bool, bool]] = []  # tag, whether it is a block, chrome, an article, main
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.chrome = self.article = self.main = 0
        self.links = self.articles = 0

    def push(self, tag: str, chrome: bool, article: bool, main: bool) -> None:
        n, block = len(self.tags), tag in BLOCK
        self.places[tag].append(n)
        self.tags.append((tag, block, chrome, article, main))
        if block:
            self.blocks.append(n)
        elif tag == "a":
            self.links += 1
        if chrome:
            self.chrome += 1
        elif article:
            self.articles += not self.article
            self.article += 1
        elif main:
            self.main += 1

    def pop(self) -> None:
        tag, block, chrome, article, main = self.tags.pop()
        self.places[tag].pop()
        if block:
            self.blocks.pop()
        elif tag == "a":
            self.links -= 1
        if chrome:
            self.chrome -= 1
        elif article:
            self.article -= 1
        elif main:
            self.main -= 1

    def close(self, tag: str) -> None:
        """End the element, if an end tag has a start tag; that of an inline element has none beyond the block it is in."""
        own = self.places.get(tag)
        if own and (tag in BLOCK or not self.blocks or own[-1] > self.blocks[-1]):
            for _ in range(len(self.tags) - own[-1]):
                self.pop()

    def part(self) -> int:
        if self.article:
            return ARTICLE_IN_MAIN if self.main else ARTICLE
        return MAIN if self.main else OPEN


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in page order. Chrome inside a paragraph comes before it, as a block of its own."""
    found: list[Block] = []
    parts: list[str] = []
    aside: list[str] = []
    open_ = _Open()
    at = linked = 0

    def flush() -> None:
        nonlocal linked
        for part, own in ((CHROME_PART, aside), (open_.part(), parts)):
            if not own:
                continue
            text = "".join(own)
            own.clear()
            if text := " ".join((html.unescape(text) if "&" in text else text).split()):
                found.append(Block(part, text, open_.articles if open_.article and part else 0, linked if part else 0))
        linked = 0

    search = _MARKUP.search
    while m := search(page, at):
        begin, end = m.span()
        if begin > at:
            (aside if open_.chrome else parts).append(page[at:begin])
            if open_.links and not open_.chrome:
                linked += begin - at
        at = end
        tag, rest = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if open_.chrome:
            if tag in BLOCK or tag in SPACE:
                aside.append(" ")
        elif tag in BLOCK:
            if parts or aside:
                flush()
        elif tag in SPACE:
            parts.append(" ")
        if page[begin + 1] == "/":
            open_.close(tag)
        elif tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not rest.endswith("/>"):
            if open_.tags and open_.tags[-1][0] == "p" and tag in BLOCK:  # a paragraph ends where a block begins
                open_.pop()
            if "=" in rest or "hidden" in rest or tag in CHROME or tag in ("article", "header", "main"):
                main = tag == "main" or "role" in rest and bool(_MAIN_ROLE.search(rest))
                core = main or tag == "article"
                chrome = _is_chrome(tag, rest, core, bool(open_.article or open_.main))
                open_.push(tag, chrome, core and not main and not chrome, main and not chrome)
            else:
                open_.push(tag, False, False, False)
    if at < len(page):
        (aside if open_.chrome else parts).append(page[at:])
    flush()
    return found


def text_blocks(found: list[Block]) -> tuple[bool, list[int]]:
    """Whether the page has an article or main, and which of its blocks make its text."""
    best = max((b.part for b in found), default=OPEN)
    best = best if best > OPEN else OPEN
    kept = [n for n, b in enumerate(found) if b.part == best]
    sizes: dict[int, list[int]] = {}
    for n in kept:
        size = sizes.setdefault(found[n].article, [0, 0])
        size[0] += len(found[n].text)
        size[1] += found[n].linked
    if 0 not in sizes and len(sizes) > 1:
        longest = max(size for size, _ in sizes.values())
        kept = [n for n in kept if not (sizes[found[n].article][1] >= LINKED * sizes[found[n].article][0] and LONGER * sizes[found[n].article][0] <= longest)]
    return best > OPEN, kept


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_2 = np.uint64(0xBF58476D1CE4E5B9)
_HIGH = np.uint64(29)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of text, whose words are separated by one space: the sum of hashes of its bytes at their places."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(raw == 32)
    edges = np.zeros(len(gaps) + 2, np.int64)
    np.add(gaps, 1, out=edges[1:-1])
    edges[-1] = len(raw)
    starts = edges[:-1]
    mixed = np.arange(len(raw), dtype=np.uint64)
    mixed -= np.repeat(starts.view(np.uint64), edges[1:] - starts)
    mixed <<= np.uint64(8)
    mixed += raw
    mixed += np.uint64(1)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX_2
    mixed ^= mixed >> np.uint64(29)
    mixed[gaps] = 0
    return np.add.reduceat(mixed, starts)


def windows(tokens: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` neighbouring tokens, whose hashes are given."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, high = tokens[:n] * _MIX, np.empty(n, np.uint64)
    for k in range(1, length):
        np.right_shift(out, _HIGH, out=high)
        out ^= high
        out ^= tokens[k : k + n]
        out *= _MIX
    np.right_shift(out, _HIGH, out=high)
    out ^= high
    return out


def samples(hashes: np.ndarray, among: int) -> np.ndarray:
    """The places of the least of each `among` neighbouring hashes."""
    if len(hashes) <= among:
        return np.array([hashes.argmin()]) if len(hashes) else np.empty(0, np.int64)
    n = len(hashes) - among + 1
    least, at = hashes[:n], np.zeros(n, np.int64)
    for k in range(1, among):
        at[hashes[k : k + n] < least] = k
        least = np.minimum(least, hashes[k : k + n])
    at += np.arange(n)  # never falls from one row to the next
    return at[np.diff(at, prepend=-1) > 0]


class _Page(NamedTuple):
    found: list[Block]
    has_core: bool
    text: list[int]
    tokens: np.ndarray


def _host_hash(host: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")))


def _read(page: str, host: str) -> _Page:
    """A page's blocks, and its token stream as hashes that tell hosts apart."""
    found = blocks(page)
    tokens = word_hashes(" ".join([b.text for b in found]))
    tokens ^= _host_hash(host)
    tokens *= _MIX
    return _Page(found, *text_blocks(found), tokens)


def _body(page: _Page, host: str) -> int:
    """A hash of a page's text."""
    return xxhash.xxh64_intdigest("\n".join([host, *[page.found[n].text for n in page.text]]).encode("utf-8", "surrogatepass"))


class _Known:
    """Sorted keys, and a table by their first bits, which sorts out most values that aren't there at one look."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(int(len(keys)).bit_length() + 3, 8))
        self.table = np.zeros(1 << int(np.uint64(64) - self.shift), bool)
        self.table[keys >> self.shift] = True

    def places_of(self, values: np.ndarray) -> np.ndarray:
        """The places of the values that are among the keys."""
        near = np.flatnonzero(self.table[values >> self.shift])
        if not len(near):
            return near
        wanted = values[near]
        return near[self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted]


def _around(tokens: np.ndarray, known: _Known, length: int, min_tokens: int) -> np.ndarray:
    """Hashes of the windows of min_tokens that hold a known window of `length`."""
    at = known.places_of(windows(tokens, length))
    if not len(at):
        return np.empty(0, np.uint64)
    full = windows(tokens, min_tokens)
    wanted = np.zeros(len(full) + min_tokens, bool)
    for k in range(min_tokens - length + 1):
        wanted[at[at >= k] - k] = True
    return full[wanted[: len(full)]]


#: So many shared keys at most, of 8 bytes each, are broadcast; beyond that each page gets its own by a shuffled join.
_BROADCAST = 500_000


class _Shared:
    """The keys that pages of a host have in common, found from rows (page, body, keys) of pages: pages of different contents, or for samples, which only lead to what is then compared, any."""

    def __init__(self, rows: DataFrame, contents: bool) -> None:
        keys = rows.select("page", "body", F.explode("keys").alias("key"))
        bodies = [F.min("body").alias("_low"), F.max("body").alias("_high")] if contents else []
        repeated = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), *bodies).where("_low < _high" if contents else "_size > 1")
        repeated = staged(repeated.select("key", "_size"), "repeated")
        self.everywhere = self.by_page = None
        if repeated.count() <= _BROADCAST:
            found = np.array([r["key"] for r in repeated.select("key").collect()], np.int64).view(np.uint64)
            self.everywhere = rows.sparkSession.sparkContext.broadcast(np.sort(found))
        else:
            keys = staged(keys.select("page", "key").distinct(), "page-keys")
            own = left_join_groups(keys, repeated, "key", "_size", repeated.agg(F.sum("_size")).first()[0]).where(F.col("_size").isNotNull())
            self.by_page = staged(own.groupBy("page").agg(F.collect_list("key").alias("known")), "shared-keys")

    def given_to(self, pages: DataFrame) -> DataFrame:
        return pages.withColumn("known", F.lit(None).cast("array<long>")) if self.by_page is None else pages.join(self.by_page, "page", "left")


class _KnownOf:
    """What is shared of all pages' keys, or of one page's."""

    def __init__(self, everywhere) -> None:
        self.everywhere = None if everywhere is None else _Known(everywhere.value)

    def __call__(self, cell: pa.ListScalar) -> _Known:
        return self.everywhere or _Known(np.sort(cell.values.to_numpy().view(np.uint64)) if cell.is_valid else np.empty(0, np.uint64))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = 8) -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars, n_tokens (of all blocks), n_repeated (those covered)."""
    if min_tokens < 2:
        raise ValueError("min_tokens must be 2 or more")
    sample = max(min_tokens * 3 // 4, 1)
    among = min_tokens - sample + 1
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("\u0000"))
    html_of = F.coalesce(F.col(html_col), F.lit(""))
    page = F.unhex(F.md5(F.concat_ws("\u0000", host, html_of).cast("binary")))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), html_of.alias("_html"), host.alias("_host"), page.alias("page"))

    def dealt(choose, shared: _Shared | None):
        """Of each page, its keys: what choose() takes of its tokens and of what is known to be shared."""
        alone, everywhere = shared is None, shared and shared.everywhere

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known_of = None if alone else _KnownOf(everywhere)
            for batch in batches:
                body, keys = [], []
                for text, at, cell in zip(batch.column("_html"), batch.column("_host"), batch.column("known"), strict=True):
                    own = _read(text.as_py(), host_of := at.as_py())
                    body.append(0 if alone else _body(own, host_of))  # samples are compared whatever the contents
                    keys.append(np.unique(choose(own.tokens, cell if alone else known_of(cell))).view(np.int64))
                columns = [batch.column("page"), pa.array(np.array(body, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["page", "body", "keys"])

        return read

    def sampled(tokens: np.ndarray, _) -> np.ndarray:
        found = windows(tokens, sample)
        return found[samples(found, among)]

    def full(tokens: np.ndarray, known: _Known) -> np.ndarray:
        return _around(tokens, known, sample, min_tokens)

    keyed = "page binary, body long, keys array<long>"
    bare = rows.select("_html", "_host", "page")
    samples_shared = _Shared(bare.withColumn("known", F.lit(None).cast("array<long>")).mapInArrow(dealt(sampled, None), keyed), contents=False)
    shared = _Shared(samples_shared.given_to(bare).mapInArrow(dealt(full, samples_shared), keyed), contents=True)
    everywhere = shared.everywhere

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_of = _KnownOf(everywhere)
        for batch in batches:
            out, n_tokens, n_repeated = [], [], []
            for text, at, cell in zip(batch.column("_html"), batch.column("_host"), batch.column("known"), strict=True):
                own = _read(text.as_py(), at.as_py())
                gone = np.zeros(len(own.tokens) + 1, np.int64)
                starts = known_of(cell).places_of(windows(own.tokens, min_tokens))
                gone[starts] += 1  # no place comes twice
                gone[starts + min_tokens] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                if own.has_core:
                    kept = [own.found[n].text for n in own.text]
                else:
                    words = [b.text.split(" ") for b in own.found]
                    begin = np.cumsum([0, *map(len, words)])
                    kept = [" ".join(w for w, g in zip(words[n], covered[begin[n] :], strict=False) if not g) for n in own.text]
                out.append("\n\n".join(filter(None, kept)))
                n_tokens.append(len(covered))
                n_repeated.append(int(covered.sum()))
            columns = [batch.column("_id"), batch.column("_url"), pa.array(out, pa.string()), pa.array(n_tokens, pa.int64()), pa.array(n_repeated, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_url", "text", "n_tokens", "n_repeated"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    final = shared.given_to(rows).mapInArrow(cut, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string, n_tokens long, n_repeated long")
    return final.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_tokens", "n_repeated")
