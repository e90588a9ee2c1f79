"""Reading level of each document (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import percentiles, summed_by_range
from .common import durable, settled

# Vowels of the Latin alphabets read here.
VOWELS = "aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüýÿ"
# Hyphenation patterns between vowels in Liang's notation, an odd number divides, a higher even one forbids.
PATTERNS = "i1a i1o i1u e1o u1a u1o y1a y1o a1o o1a ti2a ti2o ti2u ci2a ci2o ci2u si2o gi2a gi2o xi2o ge2o qu2a qu2o gu2a gu2o".split()
#: Words that a clause is credited with at most.
CLAUSE = 12.0
#: Level limits on the median grade where there are no labels to fit them to.
DEFAULT_LIMITS = (1.9, 7.6, 12.5, 16.0)
#: The share and number of occurrences that show that running text writes a word in small letters.
SMALL_SHARE, SEEN = 0.9, 20
COUNTS = ["words", "letters", "sentences", "marks", "syllables", "long_syllables", "long_words"]
#: Characters of text that are counted at once, and distinct words whose counts a worker keeps.
SLICE, KEPT_WORDS = 4_000_000, 200_000
_STOP, _MARK, _SHORT = "\ue000", "\ue001", "\ue002"
_BREAKS = "[.!?…。！？]+[\"”’'»)\\]]*(?:\\s+|$)|\n[ \t]*\n|\n[ \t]*[-*•]"
_MARKS = "[,;:、，；：](?:\\s+|$)|\\s[—–-]+\\s+|—|\\("
_INITIALS = r"(?i)(^|[^\pL])(\pL(?:\.\pL)?|[b-df-hj-np-tv-xz]{2,4})\."
_GROUP, _SILENT = re.compile(f"[{VOWELS}]+"), re.compile(f"[^laeiouy\\W]e$|[^dt{VOWELS}\\W]ed$|[^sxzchg{VOWELS}\\W]es$")


def _table(patterns: list[str]) -> dict[str, list[int]]:
    """Letters of each pattern, and the number before each letter and after the last."""
    out = {}
    for p in patterns:
        numbers, letters = [0], ""
        for ch in p:
            if ch.isdigit():
                numbers[-1] = int(ch)
            else:
                letters += ch
                numbers.append(0)
        out[letters] = numbers
    return out


_TABLE = _table(PATTERNS)
_LONGEST = max(map(len, _TABLE))


def divisions(word: str) -> list[int]:
    """The highest number that any pattern has at each place of the word; place i is before letter i."""
    best = [0] * (len(word) + 1)
    for i in range(len(word)):
        for n in range(2, min(_LONGEST, len(word) - i) + 1):
            for k, v in enumerate(_TABLE.get(word[i : i + n], ())):
                best[i + k] = max(best[i + k], v)
    return best


def syllables(word: str) -> int:
    """Syllables of a lower-case word by hyphenation-style rules.

    Each group of vowels is one, each odd place between two of its vowels one more; a silent e, ed or es after a
    consonant that lets it fall silent is none; one at least.
    """
    groups = [m.span() for m in _GROUP.finditer(word)]
    n = len(groups)
    if any(b - a > 1 for a, b in groups):
        cut = divisions(word)
        n += sum(cut[i] % 2 for a, b in groups for i in range(a + 1, b))
    if len(word) > 3 and _SILENT.search(word):
        n -= 1
    return max(1, n)


def cleaned(texts: pa.Array) -> pa.Array:
    """Texts without markup, entities, broken encodings and combining marks; stops, marks and words stand apart.

    A stop after an initial or a vowelless abbreviation ends no sentence, and a capital after it begins none.
    """

    def swap(a: pa.Array, sign: str | None, *rules: tuple[str, str]) -> pa.Array:
        if sign is None or pc.any(pc.match_substring(a, sign)).as_py():
            for pattern, to in rules:
                a = pc.replace_substring_regex(a, pattern, to)
        return a

    a = pc.fill_null(texts, "")
    a = swap(a, "\r", (r"\r\n?", "\n"))
    a = swap(a, "<", (r"<[/!?\pL][^<>]*>", "\n\n"))
    a = swap(a, "&", (r"&(?:[A-Za-z]{2,8}|#\d{2,5});", " "))
    a = swap(a, "â€", ("â€[™˜]", "'"), ("â€.", ""))
    a = swap(a, "Â", ("Â", ""))
    a = swap(a, "Ã", ("Ã.", "é"))
    if not pc.all(pc.string_is_ascii(a)).as_py():
        a = swap(a, None, (r"[\pM\x{e000}-\x{e002}]+", ""))
    a = swap(a, None, (_INITIALS, f"\\1\\2 {_SHORT} "), (_BREAKS, f" {_STOP} "), (_MARKS, f" {_MARK} "))
    return swap(a, None, (r"[^\pL'’ \x{e000}-\x{e002}]+", " "))


@dataclass
class _Tokens:
    """The words, stops and marks of some texts in order: the text of each, its entry in ``names``, and traits by entry."""

    text: np.ndarray
    entry: np.ndarray
    names: list[str]
    word: np.ndarray
    capital: np.ndarray
    follows: np.ndarray


def _tokens(texts: pa.Array) -> _Tokens:
    lists = pc.utf8_split_whitespace(cleaned(texts))
    coded = pc.list_flatten(lists).dictionary_encode()
    text, entry = np.asarray(pc.list_parent_indices(lists)), np.asarray(coded.indices)
    raw = coded.dictionary.to_pylist()
    names = [x.strip("'’") for x in raw]
    word = np.array([x not in ("", _STOP, _MARK, _SHORT) for x in names], dtype=bool)
    capital = np.array([len(x) > 1 and x[0].isupper() and x[1:].islower() for x in names], dtype=bool)
    follows = np.zeros(len(entry), dtype=bool)  # a word straight after a word of the same text
    if len(entry):
        is_word = word[entry]
        follows[1:] = is_word[1:] & is_word[:-1] & (text[1:] == text[:-1])
    return _Tokens(text, entry, names, word, capital, follows)


def text_counts(texts: pa.Array, small: set[str], known: dict[str, tuple[int, int]]) -> np.ndarray:
    """The ``COUNTS`` of each text, a row each.

    A sentence begins at the first word of a text, at the first after a stop, and at a capitalised word of ``small``.
    """
    n, t = len(texts), _tokens(texts)
    letters, sounds = np.zeros(len(t.names)), np.zeros(len(t.names))
    if len(known) > KEPT_WORDS:
        known.clear()
    for i, name in enumerate(t.names):
        if t.word[i]:
            low = name.lower()
            got = known.get(low)
            if got is None:
                got = known[low] = (len(low), syllables(low))
            letters[i], sounds[i] = got
    opens = np.array([c and x.lower() in small for c, x in zip(t.capital, t.names)], dtype=bool)
    stop, mark = (np.array([x == s for x in t.names], dtype=bool) for s in (_STOP, _MARK))
    is_word = t.word[t.entry] if len(t.entry) else np.zeros(0, dtype=bool)
    # the last stop, and the last word, before or at each place
    place = np.arange(len(t.entry))
    last = lambda yes: np.maximum.accumulate(np.where(yes, place, -1)) if len(place) else place
    begins = np.r_[True, t.text[1:] != t.text[:-1]] if len(place) else np.zeros(0, dtype=bool)
    edge = np.maximum(last(begins) - 1, last(stop[t.entry])) if len(place) else place
    before = np.r_[-1, last(is_word)[:-1]] if len(place) else place
    first = is_word & (before <= edge)
    sentence = first | (t.follows & opens[t.entry]) if len(place) else first
    total = lambda v: np.bincount(t.text, weights=v, minlength=n)
    by = lambda v: total(v[t.entry])
    return np.stack([total(is_word), by(letters), total(sentence), by(mark), by(sounds), by(sounds >= 3), by(letters > 6)], axis=1)


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``size`` characters; a longer text is a range of its own."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, x in enumerate(lengths):
        if held and held + x > size:
            yield start, i
            start, held = i, 0
        held += int(x)
    if start < len(lengths):
        yield start, len(lengths)


def _texts(column: pa.Array) -> pa.Array:
    """Bytes as strings; where some are no UTF-8 they are read with the replacement character."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


def counts(docs: DataFrame, keys: list[str], text: str = "text", small: list[str] = [], size: int = SLICE) -> DataFrame:
    """Words, letters, sentences, marks within them, syllables, words of three syllables and of seven letters of each text.

    Counted by Arrow kernels over many texts at once; only distinct words are looked at in Python. ``small`` travels with
    the task; Spark broadcasts it where it is long.
    """
    src = docs.select(*keys, F.col(text).cast("binary").alias("_text"))
    words = set(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _texts(batch.column(len(keys)))
            got = np.concatenate([text_counts(raw.slice(a, b - a), words, known) for a, b in _slices(raw, size)])
            out = pa.Table.from_batches([batch]).select(keys)
            for i, name in enumerate(COUNTS):
                out = out.append_column(name, pa.array(got[:, i], pa.float64()))
            yield from out.to_batches()

    head = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(run, head + "".join(f", {c} double" for c in COUNTS))


def small_words(docs: DataFrame, text: str = "text", at_most: int | None = None, size: int = SLICE, capitals: bool = False) -> list[str]:
    """The words that running text writes in small letters, the commonest first; with ``at_most`` only so many.

    Counted where a word follows another, so that the first word of a sentence says nothing. With ``capitals`` only
    words that running text has with a capital too: the others begin no sentence in these documents, so no count
    of theirs is another without them. The words are held in memory; they are a part of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _texts(batch.column(0))
            for a, b in _slices(raw, size):
                t = _tokens(raw.slice(a, b - a))
                seen = np.bincount(t.entry[t.follows], minlength=len(t.names))
                rows = [(x.lower(), int(c), bool(up)) for x, c, up in zip(t.names, seen, t.capital) if c and (up or x.islower())]
                yield pa.RecordBatch.from_pydict({"word": pa.array([r[0] for r in rows], pa.string()), "low": pa.array([0 if r[2] else r[1] for r in rows], pa.int64()), "all": pa.array([r[1] for r in rows], pa.int64())})

    found = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, "word string, low long, all long")
    sums = found.groupBy("word").agg(F.sum("low").alias("low"), F.sum("all").alias("all"))
    kept = sums.filter((F.col("low") >= SEEN) & (F.col("low") >= F.col("all") * SMALL_SHARE))
    ordered = (kept.filter(F.col("all") > F.col("low")) if capitals else kept).orderBy(F.col("low").desc(), "word")
    return (ordered if at_most is None else ordered.limit(at_most)).select("word").toArrow().column("word").to_pylist()


def grade(counted: DataFrame) -> DataFrame:
    """Replace the counts by ``grade``, the median of six classic estimates; null for texts without words.

    A sentence counts with its words, but at most ``CLAUSE`` for each of its clauses, which marks divide: so run-on
    and unpunctuated text is not taken for learned prose. Longer sentences never make a grade fall.
    """
    w = F.greatest(F.col("words"), F.lit(1.0))
    n = F.greatest(F.col("sentences"), F.lit(1.0))
    wps = F.least(w / n, F.lit(CLAUSE) * (F.lit(1.0) + F.col("marks") / n))
    letters, sounds, hard, long_ = (F.col(c) / w for c in ("letters", "syllables", "long_syllables", "long_words"))
    # The published coefficients of Flesch-Kincaid, Gunning fog, automated readability, Coleman-Liau, LIX (by four) and SMOG.
    grades = [
        0.39 * wps + 11.8 * sounds - 15.59,
        0.4 * (wps + 100.0 * hard),
        4.71 * letters + 0.5 * wps - 21.43,
        5.88 * letters - 29.6 / wps - 15.8,
        (wps + 100.0 * long_) / 4.0,
        1.043 * F.sqrt(30.0 * hard * wps) + 3.1291,
    ]
    ranked = settled(counted, _sorted=F.sort_array(F.array(*grades)))
    middle = (F.col("_sorted")[2] + F.col("_sorted")[3]) / 2
    graded = settled(ranked, grade=F.when(F.col("words") > 0, F.round(middle, 6)))
    return graded.drop(*COUNTS, "_sorted")


def limits(pairs: list[tuple[float, float]]) -> tuple[float, ...]:
    """The four limits between five levels that disagree with the fewest ratings; of equally good limits the middle one.

    A limit without ratings on both sides keeps its default; limits never fall. Equal grades are never divided. This is
    for pairs held in memory; ``fit`` gives the same for tables of any size.
    """
    out: list[float] = []
    g = np.array([x for x, _ in pairs], dtype=float)
    level = np.array([x for _, x in pairs], dtype=float)
    for i, default in enumerate(DEFAULT_LIMITS):
        above = level > i + 1.5 - 1e-9
        at = default
        if above.any() and not above.all():
            order = np.argsort(g, kind="stable")
            a = above[order].astype(int)
            wrong = np.concatenate([[0], np.cumsum(a)]) + np.concatenate([[0], np.cumsum(1 - a)])[-1] - np.concatenate([[0], np.cumsum(1 - a)])
            edges = np.concatenate([[g[order][0] - 1], (g[order][1:] + g[order][:-1]) / 2, [g[order][-1] + 1]])
            apart = np.concatenate([[True], g[order][1:] != g[order][:-1], [True]])
            best = np.flatnonzero(apart & (wrong == wrong[apart].min()))
            at = float(edges[best[len(best) // 2]])
        out.append(max([at, *out[-1:]]))
    return tuple(out)


def ratings(labels: DataFrame, id_col: str = "doc_id", level: str = "reading_level") -> DataFrame:
    """(id, _level): of every rated document the median of the valid ratings (1 to 5)."""
    return labels.filter(F.col(level).between(1, 5) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.median(level).alias("_level"))


def fit(graded: DataFrame, rated: DataFrame, id_col: str = "doc_id") -> tuple[float, ...]:
    """The ``limits`` of graded documents and their ``ratings``, all of them, without bringing the pairs into one place.

    Ratings are counted by grade and limit. A limit below a grade has as many disagreements more than one below all
    grades as lower grades have ratings above it less those below it: sums by range of the grade. Only a few figures
    for each limit reach the driver.
    """
    known = graded.filter("grade is not null").join(rated, id_col)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), (F.col("_level") > i + 1.5 - 1e-9).cast("long").alias("_above")) for i in range(len(DEFAULT_LIMITS))]))
    counted = durable(known.select("grade", sides.alias("_s")).groupBy("_s._i", "grade").agg(F.sum("_s._above").alias("_above"), F.count(F.lit(1)).alias("_n")))
    ends = counted.groupBy("_i").agg(F.sum("_above").alias("_above"), F.sum("_n").alias("_n"), F.max("grade").alias("_top"))
    both = {r["_i"]: r["_top"] for r in ends.filter("_above > 0 and _above < _n").collect()}
    middle: dict[int, float] = {}
    if both:
        # a place above all grades, whose limit is as far from them as that below all
        top = graded.sparkSession.createDataFrame([(i, x + 2.0, 0, 0) for i, x in both.items()], counted.schema)
        places = counted.filter(F.col("_i").isin(list(both))).unionByName(top)
        summed = durable(summed_by_range(places, ["_i"], [F.col("grade")], 2 * F.col("_above") - F.col("_n"), "_more"))
        least = {r["_i"]: r["_least"] for r in summed.groupBy("_i").agg(F.min("_more").alias("_least")).collect()}
        is_best = F.col("_more") == F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("_i"))
        # of an even number of best places the upper middle one, so the percentile is taken from above
        best = percentiles(summed.filter(is_best).withColumn("_down", -F.col("grade")), ["_i"], "_down", {"_at": 0.5})
        chosen = {r["_i"]: -r["_at"] for r in best.collect()}
        lower = F.max(F.when(F.col("grade") < F.element_at(F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv]), F.col("_i")), F.col("grade")))
        middle = {r["_i"]: (chosen[r["_i"]] + (chosen[r["_i"]] - 2 if r["_lower"] is None else r["_lower"])) / 2 for r in summed.groupBy("_i").agg(lower.alias("_lower")).collect()}
    out: list[float] = []
    for i, default in enumerate(DEFAULT_LIMITS):
        out.append(max([middle.get(i, default), *out[-1:]]))
    return tuple(out)


def graded(docs: DataFrame, keys: list[str], text: str = "text", small: list[str] = []) -> DataFrame:
    """(keys, grade) of each text. No shuffle."""
    return grade(counts(docs, keys, text, small))


def levelled(grades: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """Add ``level`` 1 to 5 by the limits; without a grade there is none."""
    level = F.lit(1)
    for x in at:
        level = level + (F.col("grade") >= F.lit(float(x))).cast("int")
    return grades.withColumn("level", level.cast("int"))


def levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, grade, level): level 1 to 5; null, empty and unworded texts have neither.

    Whole texts are read, however long. Layout does not count: tags, list marks, line ends, capitals, missing stops and
    run-on clauses are evened out. The words that running text writes small are learned from all documents, in a pass of
    their own, and the limits from all valid ratings. The grades of all documents, three numbers each, are written once
    to the shared folder, from which the limits are fitted and the levels made. Equal texts get equal levels; other
    columns are not read; empty tables give no rows, and without valid ratings the default limits hold.
    """
    grades = durable(graded(docs.select(id_col, text), [id_col], text, small_words(docs, text, capitals=True)))
    return levelled(grades, fit(grades, ratings(labels, id_col), id_col))
