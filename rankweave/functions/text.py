"""Text as Spark columns: tokens, weights of terms, cleaning of catalog fields, parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that carry no weight in a query or a document.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his in is it its of on or she that the "
    "their them they this to was were what when where which who will with you your"
).split()
TOKEN = r"[\p{L}\p{Nd}]{2,}"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str, stop: bool = True) -> Column:
    """Lower-case runs of letters and digits of two characters or more, without stop words; null gives an empty list."""
    found = F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    if not stop:
        return found
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def query_terms(text: Column | str) -> Column:
    """The distinct tokens of a query in order of first appearance."""
    return F.array_distinct(tokenize(text))


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)), with df at least 0 and n at least 1."""
    d = F.greatest(df.cast("double"), F.lit(0.0))
    return F.log(F.lit(1.0) + (F.greatest(n.cast("double"), F.lit(1.0)) - d + F.lit(0.5)) / (d + F.lit(0.5)))


def bm25(weight: Column, tf: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """One term's part of a score; where the mean length is not above 0 every text counts as of mean length."""
    mean = F.when(mean_length > 0, mean_length).otherwise(F.greatest(length.cast("double"), F.lit(1.0)))
    return weight * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / mean))


def normalize_language(code: Column | str) -> Column:
    """Blank gives null, every code that begins with ``en`` gives ``en``, others are trimmed."""
    c = F.trim(_col(code))
    return F.when(c == "", None).when(F.lower(c).startswith("en"), "en").otherwise(c)


def parse_year(text: Column | str) -> Column:
    """A year written as a number, cut to a whole one; null where it is none."""
    return F.trim(_col(text)).try_cast("double").try_cast("int")


def parse_rating(text: Column | str) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(_col(text).cast("string").try_cast("double"), F.lit(0.0))


def split_authors(text: Column | str) -> Column:
    """Names of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_grade(text: Column | str) -> Column:
    """The first digit of an answer if it is 0 to 3, else null."""
    digit = F.regexp_extract(_col(text), r"\p{Nd}", 0)
    return F.when(digit.isin("0", "1", "2", "3"), digit.cast("int"))


def split_custom_id(text: Column | str) -> tuple[Column, Column]:
    """``query~doc`` cut at the first tilde; both null unless both parts are there."""
    pattern = r"(?s)^([^~]+)~(.+)$"
    good = _col(text).rlike(pattern)
    return F.when(good, F.regexp_extract(_col(text), pattern, 1)), F.when(good, F.regexp_extract(_col(text), pattern, 2))


def embedding_input(title: Column, authors: Column, blurb: Column) -> Column:
    """What is embedded for a document."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" by "), F.coalesce(F.array_join(authors, ", "), F.lit("")), F.lit(". "), F.coalesce(blurb, F.lit("")))


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """A number with a fixed number of decimals, a dash for null, a plus sign where wanted."""
    text = F.format_string(f"%{'+' if signed else ''}.{digits}f", value)
    return F.when(value.isNull(), F.lit("—")).otherwise(text)


def p_value(value: Column) -> Column:
    return F.when(value < 0.0001, F.lit("<0.0001")).otherwise(fixed(value, 4))
