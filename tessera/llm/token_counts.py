"""Token counts of a document's fields or sections, from one encoding of the whole document.

The document is encoded once; the tokens' spans are then joined as intervals to the sections' spans, inside the task that has the text. Spans are half-open. A token may cross a section's boundary; rule says where it goes:
first: to the section that holds its first byte; last: to the one that holds its last; most: to the one with most of its bytes, on a tie the one it meets first.
Tokens whose byte or bytes no section holds are counted under section -1, so the counts of a document add up to its tokens.

A document is a text column, or several fields (text columns), which are put together with `joint` between them; a null field is empty. Sections are the fields, given spans in the caller's order, or else the lines of the text, each with its line feed. Of given spans, what lies outside the text is cut off; a null span, a null bound, or a stop that isn't after the start makes a section that holds nothing, with 0 tokens; what several spans claim belongs to the first of them in the caller's order. Null or empty text without sections gives one row, of section -1 and 0 tokens. Very long texts take linear time. Rows that repeat are counted each, an empty table gives none, and other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder

RULES = ("first", "last", "most")


def _byte_at(text: str) -> np.ndarray | None:
    """The byte offset of each code point and of the end; None where they are equal."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])


def _lines(text: str) -> np.ndarray:
    """(start, stop) of each line in code points."""
    lengths = np.fromiter(map(len, text.split("\n")), np.int64) + 1
    stops = np.minimum(np.cumsum(lengths), len(text))
    starts = np.concatenate([[0], stops[:-1]])
    return np.stack([starts, stops], 1)[stops > starts]


def held(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (start, stop) in any order -> sorted stretches that don't overlap, and the span that holds each: of several, the first."""
    if (spans[:, 0] < spans[:, 1]).all() and (spans[1:, 0] >= spans[:-1, 1]).all():
        return spans, np.arange(len(spans))
    ends = np.unique(spans[spans[:, 0] < spans[:, 1]])
    order = [i for i in np.argsort(spans[:, 0], kind="stable").tolist() if spans[i, 0] < spans[i, 1]]
    stretches, owner, open_, at = [], [], [], 0
    for start, stop in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        while at < len(order) and spans[order[at], 0] <= start:
            heappush(open_, order[at])
            at += 1
        while open_ and spans[open_[0], 1] <= start:
            heappop(open_)
        if open_:
            stretches.append((start, stop))
            owner.append(open_[0])
    return np.array(stretches, np.int64).reshape(-1, 2), np.array(owner, np.int64)


def _holder(at: np.ndarray, stretches: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The span that holds each byte, or -1."""
    i = np.searchsorted(stretches[:, 0], at, "right") - 1
    return np.where((i >= 0) & (at < stretches[i, 1]), owner[i], -1)


def attribute(token_bytes: np.ndarray, spans: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each span, and last of none. token_bytes: the tokens' lengths; spans: (start, stop) in bytes."""
    stops = np.cumsum(token_bytes)
    starts = stops - token_bytes
    stretches, owner = held(spans)
    if not len(stretches):
        return np.append(np.zeros(len(spans), np.int64), len(stops))
    if rule == "last":
        to = _holder(stops - 1, stretches, owner)
    else:
        to = _holder(starts, stretches, owner)
        if rule == "most":
            # Only tokens with an end of a stretch inside them can have bytes of several sections.
            ends = np.unique(stretches)
            for t in np.flatnonzero(np.searchsorted(ends, stops, "left") > np.searchsorted(ends, starts, "right")).tolist():
                counts = Counter(_holder(np.arange(starts[t], stops[t]), stretches, owner).tolist())
                counts.pop(-1, None)
                to[t] = max(counts, key=counts.__getitem__, default=-1)  # the first met, on a tie
    return np.bincount(to % (len(spans) + 1), minlength=len(spans) + 1)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", ranks_path: str | None = None, json_path: str | None = None, fields: list[str] | None = None, joint: str = "\n") -> DataFrame:
    """One row per section: id_col, section (its index, -1: no section), start, stop (code points), n_tokens, doc_tokens.

    sections_col: an array of structs of start and stop, in code points; start and stop are given back as they came. fields: text columns that make the document, instead of text_col, and its sections. Section -1 is given only where it has tokens or there is no other.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if fields and sections_col:
        raise ValueError("sections are either the fields or given")
    text, sections = F.coalesce(F.col(text_col), F.lit("")), F.lit(None).cast("array<array<bigint>>")
    if fields:
        parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
        text, spans, at = F.concat_ws(joint, *parts), [], F.lit(0).cast("long")
        for part in parts:
            spans.append(F.array(at, at + F.length(part)))
            at = at + F.length(part) + len(joint)
        sections = F.array(*spans)
    elif sections_col:
        sections = F.coalesce(F.transform(sections_col, lambda s: F.array(s["start"].cast("long"), s["stop"].cast("long"))), F.array().cast("array<array<bigint>>"))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), sections.alias("_sections"))
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, section int, start long, stop long, n_tokens long, doc_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, json_path)
        for batch in batches:
            row, section, start, stop, n_tokens, doc_tokens = ([] for _ in range(6))
            for i, (value, spans) in enumerate(zip(batch.column("_text"), batch.column("_sections"), strict=True)):
                text = value.as_py()
                shown = spans.as_py()
                if shown is None:
                    chars = _lines(text)
                    shown = chars.tolist()
                else:
                    chars = np.array([[0, 0] if None in s else s for s in shown], np.int64).reshape(-1, 2)
                chars = np.clip(chars, 0, len(text))
                at = _byte_at(text)
                ids = encode.ids(text)
                found = attribute(encode.width[ids], chars if at is None else at[chars], rule).tolist()
                numbers = list(range(len(shown)))
                if found[-1] or not shown:
                    shown, numbers = [*shown, (0, 0)], [*numbers, -1]
                row += [i] * len(shown)
                section += numbers
                start += [s[0] for s in shown]
                stop += [s[1] for s in shown]
                n_tokens += found[: len(shown) - 1] + [found[-1]] if numbers[-1] < 0 else found[:-1]
                doc_tokens += [len(ids)] * len(shown)
            columns = [batch.column("_id").take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, stop, n_tokens, doc_tokens))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "section", "start", "stop", "n_tokens", "doc_tokens"])

    return rows.mapInArrow(count, schema).withColumnRenamed("_id", id_col)
