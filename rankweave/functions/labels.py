"""Hand-typed category labels as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories in the order of their enumeration, from 0.
CATEGORIES = {
    "shape": ["Head", "Torso", "Tail"],
    "span": ["StripeLocal", "CrossStripe"],
    "intent": ["Lexical", "Conceptual", "Mixed"],
}


def word(label: Column) -> Column:
    """Letters and digits of a label."""
    return F.lower(F.regexp_replace(label, r"[^\p{L}\p{Nd}]", ""))


def number(label: Column) -> Column:
    """The number that a label is, without leading zeros, else empty."""
    found = F.regexp_extract(F.lower(F.regexp_replace(label, r"[^\p{L}\p{Nd}.-]", "")), r"^\.*0*(\d+)(?:\.0*)?\.?$", 1)
    return F.when(label.rlike(r"\d"), found).otherwise(F.lit(""))


def edits(spelled: Column, names: list[str]) -> Column:
    """The edits to each name; null for a name spelled right, which needs none."""
    lowered = [n.lower() for n in names]
    return F.when(~spelled.isin(lowered), F.array(*[F.levenshtein(spelled, F.lit(n)) for n in lowered]))


def place(spelled: Column, numbered: Column, far: Column, names: list[str]) -> Column:
    """The place from 0 of the category that a hand-typed label evidently names, or null.

    Case, blanks and punctuation do not matter; a bare number is the category's place in the enumeration (a
    negative one names nothing); a misspelling counts when exactly one name is nearest, at most two edits and half
    its length away.
    """
    near = F.array_min(far)
    unique = F.size(F.filter(far, lambda d: d == near)) == 1
    out = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        typo = unique & (far[i] == near) & (near <= 2) & (near * 2 <= len(n))
        out = F.when((spelled == n.lower()) | (numbered == str(i)) | F.coalesce(typo, F.lit(False)), i).otherwise(out)
    return F.when(F.length(spelled) > 0, out)


def name_at(at: Column, names: list[str]) -> Column:
    return F.when(at.isNotNull(), F.get(F.array(*[F.lit(n) for n in names]), at))


def named(spelled: Column, numbered: Column, far: Column, names: list[str]) -> Column:
    """The category a hand-typed label evidently names, or null; see ``place``."""
    return name_at(place(spelled, numbered, far, names), names)


def category(label: Column, names: list[str]) -> Column:
    return named(word(label), number(label), edits(word(label), names), names)
