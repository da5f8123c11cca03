import re

import pytest
from pyspark.sql import functions as F

from seekstone.functions.text import STOPWORDS, fold, is_blank, strip, words

TEXTS = [
    None,
    "",
    " \t\n　",
    "Hello, World_1 x",
    "Straße GROSS ẞ ﬁne ﬀ",
    "ΑΣ ΣΑΣ final ς",
    "İstanbul ǰ ΐ ŉ",
    "日本語 テキスト１２",
    "a​b é \x1c x\x1f",
    "don't can't",
    "Ꭰꭰ ſ K Å",
    "x" * 5000,
    "😀 emoji 👩‍💻",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "n int, t string")


def test_words_equal_python(df):
    for r in df.select("t", words(F.col("t")).alias("w")).collect():
        assert r["w"] == [w.casefold() for w in re.findall(r"\w+", r["t"] or "")], r["t"]


def test_words_as_written_and_stopwords(df):
    for r in df.select("t", words(F.col("t"), lowercase=False).alias("w"), words(F.col("t"), stopwords=["hello", "x"]).alias("s")).collect():
        found = re.findall(r"\w+", r["t"] or "")
        assert r["w"] == found
        assert r["s"] == [w.casefold() for w in found if w.casefold() not in ("hello", "x")]


def test_fold_and_strip(df):
    for r in df.filter("t IS NOT NULL").select("t", fold(F.col("t")).alias("f"), strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b")).collect():
        assert r["f"] == r["t"].casefold()
        assert r["s"] == r["t"].strip()
        assert r["b"] == (not r["t"].strip())


def test_stopwords_are_lower_case_and_unique():
    assert len(set(STOPWORDS)) == len(STOPWORDS) and all(w == w.lower() for w in STOPWORDS)
