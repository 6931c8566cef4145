"""Column functions on text and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_text(text: Column, fold: bool = False) -> Column:
    """White space collapsed and trimmed, null as empty; ``fold`` for caseless comparison."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.replace(F.lower(out), F.lit("ß"), F.lit("ss")) if fold else out


def token_set(text: Column) -> Column:
    """Distinct ``[a-z0-9]+`` tokens of the folded text."""
    return F.array_distinct(F.regexp_extract_all(normalise_text(text, True), F.lit("[a-z0-9]+"), F.lit(0)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays without repeats; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(token_set(a), token_set(b))


def operation_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a vertical bar."""
    return F.sha2(F.concat_ws(chr(124), *[p.cast("string") for p in parts]), 256)
