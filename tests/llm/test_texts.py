import os

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankweave.llm import readability, tokens

HAVE = os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.BYTE_BPE))
TEXTS = [(1, "It's a dragon, isn't it?  Two  blanks\n\nand lines"), (2, None), (3, ""), (4, " "), (5, "naïve 🙂 العربية 日本 é"), (6, "<|endoftext|> is text"), (7, "a'll  　\t x\r\n"), (8, "a'll  　\t x\r\n")]


@pytest.mark.skipif(not HAVE, reason="no rank file")
def test_ids_and_round_trip(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    enc = tokens.encoder(tokens.rank_file())
    got = tokens.encode(df, ["doc_id"])
    ids = {r["doc_id"]: list(r["ids"]) for r in got.collect()}
    assert ids == {k: enc.encode_ordinary(t) if t else [] for k, t in TEXTS}
    assert dict(rows(tokens.decode(got, ["doc_id"]))) == {k: t or "" for k, t in TEXTS}
    assert dict(rows(tokens.encode(df, ["doc_id"], counts_only=True))) == {k: len(v) for k, v in ids.items()}
    assert tokens.encode(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.skipif(not HAVE, reason="no rank file")
def test_library_of_the_same_vocabulary_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = tokens.encoder(tokens.rank_file())
    for _, text in TEXTS:
        if text:
            assert t.encode(text, add_special_tokens=False).ids == tokens.encode_text(enc, text)


@pytest.mark.skipif(not HAVE, reason="no rank file")
@pytest.mark.parametrize("size", [1, 3, 10, 50])
def test_safe_pieces_change_no_id(size):
    enc = tokens.encoder(tokens.rank_file())
    long = " ".join(t for _, t in TEXTS if t) * 5 + "x" * 500 + "   tail  \n end's 12 34"
    assert "".join(tokens.safe_pieces(long, size)) == long
    assert tokens.encode_text(enc, long, size) == enc.encode_ordinary(long)


@pytest.mark.skipif(not HAVE, reason="no rank file")
def test_broken_bytes_and_long_text(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe end")), (2, bytearray(b"word " * 300_000))], "doc_id long, text binary")
    got = dict(rows(tokens.encode(df, ["doc_id"], counts_only=True)))
    assert got[1] > 3 and got[2] >= 300_000


EASY = "The dog ran. The cat sat. I like the hat. We fed the fox."
HARD = "Notwithstanding the historiographical objections, the incommensurable mediation of dialectic necessarily adjudicates any ideological heterogeneity."


SMALL = ["the", "we", "in", "at"]


def levelled(spark, texts, small=SMALL):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("level", F.lit("clash"))
    got = readability.levelled(readability.graded(df, ["doc_id"], small=small), readability.DEFAULT_LIMITS)
    return {r["doc_id"]: r for r in got.collect()}


def test_levels_do_not_depend_on_layout(spark):
    g = levelled(spark, [EASY, HARD, None, "", " 12 !?", EASY.upper(), f"<p>{EASY}</p>", EASY.replace(". ", "\n\n"), EASY.replace(". ", " and then "), "- " + EASY.replace(". ", "\n- "), HARD * 2000, "кошка сидит", EASY.replace(".", "").lower()])
    assert g[0]["level"] <= 2 and g[1]["level"] == 5 and g[10]["level"] == 5 and g[11]["level"] is not None
    assert all(g[i]["level"] is None and g[i]["grade"] is None for i in (2, 3, 4))
    assert all(g[i]["level"] <= 2 for i in (5, 6, 7, 8, 9, 12))


def test_markup_of_any_length_is_no_text(spark):
    g = levelled(spark, ["The cat sat.", '<a href="' + "incomprehensibility " * 40 + '">The cat sat.</a>', "3 < 4 and 5 > 2, the cat sat."])
    assert g[0]["grade"] == g[1]["grade"] and g[2]["grade"] is not None


@pytest.mark.parametrize("marks", [0, 3])
@pytest.mark.parametrize("word", ["cat", "historical", "incommensurability"])
def test_longer_sentences_never_make_a_text_easier(spark, word, marks):
    """The same words in sentences of ever more of them, without marks or with three in each sentence."""
    lengths = [1, 2, 5, 8, 12, 13, 17, 18, 19, 25, 30, 40, 59, 60, 61, 62, 90, 150, 400]
    one = lambda n: " ".join(word + ("," if i < marks and i < n - 1 else "") for i in range(n)) + ". "
    g = levelled(spark, [one(n) * 30 for n in lengths])
    grades = [g[i]["grade"] for i in range(len(lengths))]
    assert grades == sorted(grades)


def test_syllables():
    counts = {"cat": 1, "make": 1, "table": 2, "wanted": 2, "jumped": 1, "churches": 2, "hmm": 1, "beautiful": 3, "nation": 2, "social": 2, "radio": 3, "lion": 2, "guardian": 3, "question": 2, "area": 2, "queue": 1, "dialect": 3}
    assert {w: readability.syllables(w) for w in counts} == counts


def test_counts():
    count = lambda *texts: readability.text_counts(pa.array(texts, pa.string()), set(SMALL), {}).tolist()
    assert count("Dr. Who left. He ran!")[0][:4] == [5, 14, 2, 0]
    assert count("It is, well; so. One (two) three: end")[0][2:4] == [2, 4]
    # a capital on a word that is usually small begins a sentence; one after an initial does not, nor does a name
    assert [r[2] for r in count("we ran The dog sat In a hat", "J. The dog", "we saw Rosa", "THE DOG SAT AT HOME", "... !", None)] == [3, 1, 1, 1, 0, 0]
    whole = count(EASY, HARD, None, "x" * 50)
    assert np.array_equal(np.concatenate([count(t) for t in (EASY, HARD, None, "x" * 50)]), whole)


def test_slices_change_no_count(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([EASY, HARD, None, "", EASY * 9])], "doc_id int, text string")
    want = rows(readability.counts(df, ["doc_id"], small=SMALL))
    assert want == rows(readability.counts(df, ["doc_id"], small=SMALL, size=10)) and len(want) == 5
    broken = spark.createDataFrame([(1, bytearray(b"the \xff cat sat"))], "doc_id int, text binary")
    assert readability.counts(broken, ["doc_id"]).first()["words"] == 3


def test_small_words(spark):
    text = "Then the cat and the dog ran, but in the park Rosa and the fox sat. The end of the day. "
    df = spark.createDataFrame([(text * 30,), (None,), ("",)], "text string")
    got = readability.small_words(df)
    assert "the" in got and "and" in got and "rosa" not in got and got == readability.small_words(df.repartition(3))
    assert readability.small_words(df, at_most=1) == ["the"] and readability.small_words(df.limit(0)) == []


def test_limits():
    pairs = [(g, level) for level in range(1, 6) for g in (level * 3.0, level * 3.0 + 1)]
    cut = readability.limits(pairs)
    assert cut == tuple(level * 3 + 2.0 for level in range(1, 5))
    assert readability.limits([]) == readability.DEFAULT_LIMITS and list(cut) == sorted(cut)


@pytest.mark.parametrize("seed", range(3))
def test_limits_by_ranges_are_those_of_pairs_in_memory(spark, seed):
    """Tied grades, even numbers of best places, limits outside all grades, limits with ratings on one side only."""
    rng = np.random.default_rng(seed)
    n = [40, 9, 300][seed]
    grades = rng.integers(0, [12, 4, 90][seed], n) / 2
    level = np.clip(np.round(grades / 3 + rng.normal(0, [1, 3, 1][seed], n)), 1, 4 if seed else 5)
    pairs = [(float(g), float(x)) for g, x in zip(grades, level)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "doc_id int, grade double, _level double")
    got = readability.fit(df.select("doc_id", "grade"), df.select("doc_id", "_level"))
    assert got == pytest.approx(readability.limits(pairs))
    assert readability.limits(pairs) == readability.limits(sorted(pairs, key=lambda p: (p[0], -p[1]))) == readability.limits(sorted(pairs))


def test_equal_grades_are_not_divided():
    """No limit can part the ratings at 2.0; parted in memory they would seem to agree with a limit of 2.0."""
    assert readability.limits([(1.0, 1), (2.0, 1), (2.0, 1), (2.0, 5), (3.0, 5)]) == (2.5,) * 4


def test_every_rating_counts(spark):
    """60,000 rated documents; each limit lies between two neighbours, which no part of them need hold."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") / 1000).alias("grade"))
    labels = docs.select("doc_id", (F.floor(F.col("doc_id") / 12_000) + 1).alias("reading_level"))
    assert readability.fit(docs, readability.ratings(labels)) == pytest.approx((11.9995, 23.9995, 35.9995, 47.9995))


def test_no_small_word_is_left_out(spark):
    """2,500 words, more than were once kept; those never met with a capital change no count and may be left out."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    words = [word(i) for i in range(2_500)]
    df = spark.createDataFrame([(i, "so " + " ".join(words)) for i in range(20)] + [(20, "so " + " ".join(w.capitalize() for w in words[:2_200]))], "doc_id int, text string")
    got = readability.small_words(df)
    assert set(got) == set(words) and set(readability.small_words(df, capitals=True)) == set(words[:2_200])
    assert readability.levels(df, df.select("doc_id", F.lit(3).alias("reading_level"))).filter("doc_id = 20").first()["grade"] == readability.graded(df, ["doc_id"], small=got).filter("doc_id = 20").first()["grade"]


def test_unrated_documents_teach_which_words_are_small(spark):
    """The grade of a text without stops follows from what the other texts write small, whether or not they are rated."""
    prose = [(i, "Rosa and the fox ran, but in the park the dog sat on the mat. ") for i in range(30)]
    run_on = "Rosa walked home The dog sat on the mat The fox ran in the park"
    docs = spark.createDataFrame([*prose, (99, run_on)], "doc_id int, text string")
    labels = spark.createDataFrame([(99, 2)], "doc_id int, reading_level int")
    want = readability.graded(docs.filter("doc_id = 99"), ["doc_id"], small=["the"]).first()["grade"]
    assert want != readability.graded(docs.filter("doc_id = 99"), ["doc_id"]).first()["grade"]
    for some in (labels, labels.limit(0)):
        assert readability.levels(docs, some).filter("doc_id = 99").first()["grade"] == want


def test_held_out_accuracy(spark, small):
    """A model fitted on one half of the hand ratings tells demanding texts apart in the other half."""
    d = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "reading_labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = readability.levels(docs, labels.filter(half == 0)).filter("level is not null")
    truth = labels.filter((half == 1) & F.col("reading_level").between(1, 5)).groupBy("doc_id").agg(F.median("reading_level").alias("y"))
    agree = got.join(truth, "doc_id").select(F.avg(((F.col("level") >= 4) == (F.col("y") >= 4)).cast("int"))).first()[0]
    assert agree > 0.9


def test_levels_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(1, None), (None, 3), (2, 9)], "doc_id long, reading_level int")
    assert readability.levels(docs, labels).count() == 0
    some = spark.createDataFrame([(1, EASY, "x"), (1, EASY, "x"), (2, None, "x")], "doc_id long, text string, grade string")
    got = rows(readability.levels(some, labels).select("doc_id", "level"))
    assert got == rows(readability.levels(some, labels.limit(0)).select("doc_id", "level")) and len(got) == 3
    assert readability.fit(readability.graded(some, ["doc_id"]), readability.ratings(labels)) == readability.DEFAULT_LIMITS


@pytest.mark.skipif(not HAVE, reason="no rank file")
def test_pieces_change_no_id_of_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert rows(tokens.encode(docs, ["doc_id"], size=40)) == rows(tokens.encode(docs, ["doc_id"]))
