"""Text preparation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "[EMPTY]"
#: What a Python str.strip() removes, at either end.
_SPACE = "".join(chr(c) for c in range(1 << 16) if chr(c).isspace())

# Templates that the encoders were trained with.
E5_QUERY, E5_DOCUMENT = "query: ", "passage: "
DEFAULT_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; trim() would take spaces only."""
    # A pattern for the end would be tried at each white space of a text.
    return F.btrim(text, F.lit(_SPACE))


def is_blank(text: Column) -> Column:
    """Whether there is nothing but white space; a text is read as far as its first other character."""
    return F.ltrim(text, F.lit(_SPACE)) == ""


def document_text(title: Column, text: Column) -> Column:
    """Title and text as one string; nulls are empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def sanitize(text: Column, placeholder: str = EMPTY) -> Column:
    """The text, or the placeholder where there is nothing but white space."""
    return F.when(is_blank(F.coalesce(text, F.lit(""))), F.lit(placeholder)).otherwise(text)


def e5(text: Column, kind: str) -> Column:
    return F.concat(F.lit(E5_QUERY if kind == "query" else E5_DOCUMENT), text)


def qwen3(text: Column, kind: str, instruction: str = DEFAULT_INSTRUCTION) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), text) if kind == "query" else text


def instructed(text: Column, kind: str, instruction: str | None) -> Column:
    """A query instruction in front, without a separator."""
    return F.concat(F.lit(instruction), text) if instruction and kind == "query" else text


def template(adapter: str, text: Column, kind: str, instruction: str | None = None) -> Column:
    """What an encoder of this adapter gets to see."""
    if kind not in ("query", "document"):
        raise ValueError("kind must be query or document")
    if adapter == "e5":
        return e5(text, kind)
    if adapter == "qwen3":
        return qwen3(text, kind, instruction or DEFAULT_INSTRUCTION)
    if adapter == "sentence-transformers":
        return instructed(text, kind, instruction)
    return text


def adapter_of(model_id: str) -> str:
    """The adapter that a model's name points to."""
    name = model_id.lower()
    return next((a for a in ("e5", "qwen3", "gte") if a in name), "sentence-transformers")
