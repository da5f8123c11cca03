import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seekstone.llm import lookalike
from seekstone.llm.lookalike import Looks, Speller, Trie, _prototypes, look_classes, lookalike_pairs, visual_forms
from seekstone.llm.packing import fill, make_plan, pack
from seekstone.llm.splitting import split_oversized
from seekstone.llm.tokenizing import Tree, token_counts, token_ids, vocabulary_path

TREE = Tree(vocabulary_path(), leaf=12)


# splitting


def pieces(spark, rows, size, overlap):
    df = spark.createDataFrame([(i, t, "doc", 7) for i, t in rows], "id string, body string, kind string, start int")
    return split_oversized(df, F.col("kind"), "id", "body", F.lit(size), F.lit(overlap)).orderBy("record_id", "piece_index").collect()


def test_pieces_are_whole_bounded_and_overlap(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc  .\n。") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    texts += ["x" * 999, "word " * 300, "日本語。" * 100, " \n" * 50, "", "fits", "😀" * 90]
    rows = [(f"{n:03}", t) for n, t in enumerate(texts)] + [("null", None)]
    for size, overlap in ((20, 0), (20, 7), (50, 49), (1, 0)):
        held = {}
        for r in pieces(spark, rows, size, overlap):
            held.setdefault(r["record_id"], []).append(r)
        for key, text in rows:
            text = (text or "").strip()
            assert (key in held) == (len(text) > size)
            whole = ""
            for n, r in enumerate(held.get(key, [])):
                assert r["piece_index"] == n and r["piece"] == text[r["start"] : r["end"]] and len(r["piece"]) <= size
                assert r["fresh_start"] == len(whole) and 0 <= r["fresh_start"] - r["start"] <= overlap
                whole += text[r["fresh_start"] : r["end"]]
            assert whole == (text if key in held else "")


def test_cuts_prefer_better_boundaries(spark):
    text = "One two three four.\n\nFive six seven. Eight nine ten eleven twelve thirteen"
    got = [r["piece"] for r in pieces(spark, [("a", text)], 30, 0)]
    assert got[0] == "One two three four.\n\n" and got[1] == "Five six seven. "
    assert all(p[-1].isspace() for p in got[:-1])


def test_sizes_are_checked(spark):
    with pytest.raises(Exception, match="ChunkingError"):
        pieces(spark, [("a", "long text here")], 5, 5)
    assert pieces(spark, [], 5, 1) == []


# tokenizing


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st \n\té日本1 ,.!😀"), max_size=120))
def test_tree_concatenation_is_exact(text):
    assert TREE.encode([text])[0] == TREE.encoding.encode_ordinary(text)


def test_long_runs_are_exact():
    rng = random.Random(5)
    for alphabet in ("a", "abcdefgh", "日本語東京", "01", "=-"):
        text = "".join(rng.choice(alphabet) for _ in range(4000))
        assert TREE.encode([text])[0] == TREE.encoding.encode_ordinary(text)


def test_ids_of_a_table(spark):
    texts = [None, "", " ", "plain text", "<|endoftext|>", "x" * 100, "many words " * 30, "plain text"]
    df = spark.createDataFrame([(n, t, "k", [1]) for n, t in enumerate(texts)], "doc_id bigint, text string, key string, ids array<int>")
    for spread in (10**6, 50):  # with 50, long texts go over many tasks
        got = {r["doc_id"]: r["ids"] for r in token_ids(df, "doc_id", "text", leaf_chars=16, spread_chars=spread).collect()}
        assert got == {n: TREE.encoding.encode_ordinary(t or "") for n, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text").collect()}
    assert counts == {n: len(ids) for n, ids in got.items()}
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_ids_equal_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(vocabulary_path().replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = ["Ein Größter Test, don't 12 3's\n\n  x", "日本語のテキスト" * 20, "<|endoftext|> a"]
    assert TREE.encode(texts) == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


# packing


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(k, n, 0, 0) for k, n in sizes], "doc string, n int, part int, length int")
    return pack(df, "doc", "n", capacity)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_every_item_is_packed_once(spark, capacity):
    rng = random.Random(capacity)
    sizes = [(f"d{n}", rng.choice([1, 2, 3, 5, 30, 40, 63, 64, 65, 200])) for n in range(200)] + [("z", 0), ("y", None), ("x", -3)]
    rows = packed(spark, sizes, capacity).collect()
    room, units = {}, {}
    for r in rows:
        spans = room.setdefault(r["container"], [])
        spans.append((r["offset"], r["offset"] + r["length"]))
        units.setdefault(r["doc"], []).append((r["start"], r["length"]))
    for spans in room.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for key, n in sizes:
        parts = sorted(units.get(key, []))
        assert sum(length for _, length in parts) == max(n or 0, 0)
        assert len(parts) == (-(-n // capacity) if n and n > 0 else 0)
    assert sorted(room) == list(range(len(room)))


def test_little_is_left_over(spark):
    rng = random.Random(9)
    sizes = [(f"d{n}", min(2048, max(1, int(rng.lognormvariate(5.5, 1))))) for n in range(3000)]
    one = fill(packed(spark, sizes, 2048), 2048).collect()[0]
    assert one["used"] == sum(n for _, n in sizes) and one["unused_share"] < 0.01
    assert packed(spark, [], 2048).count() == 0


def test_one_length_for_all(spark):
    rows = packed(spark, [("same", 5)] * 50, 16).collect()
    assert len(rows) == 50 and len({r["container"] for r in rows}) == 17


def test_patterns_are_used():
    import numpy as np

    histogram = np.zeros(65, dtype=np.int64)
    histogram[[40, 24, 30, 20, 14]] = 10
    assert make_plan(histogram, 64).containers == 20  # 40 + 24 and 30 + 20 + 14


# visually identical text


ALIKE = [
    ("ﬁle caf́e".replace("f́e", "fé"), "file café"),
    ("ｆｕｌｌ１", "full1"),
    ("a​b­c﻿", "abc"),
    ("a b c", "a b c"),
    ("сосna pay", "cocna pay"),
    ("ｶﾞｷﾞ", "ガギ"),
    ("Ελ", "Eλ"),
    ("non‑breaking‐x", "non-breaking-x"),
    ("Kelvin", "Kelvin"),
    ("x\r\ny", "x\ny"),
]
UNLIKE = [("a", "A"), ("e", "é"), ("m2", "m²"), ("a b", "a  b"), ("a,b", "a.b"), ("a b", "b a"), ("1", "2"), ("👩‍💻", "👩💻"), ("½", "1⁄2")]


LOOKS = Looks()


def look(text):
    return [LOOKS.shape(w) if n % 2 == 0 else w.replace("\r\n", "\n").replace("\xa0", " ") for n, w in enumerate(lookalike._BLANK.split(text))]


@pytest.mark.parametrize("vocabulary", [[], ["file", "café", "full1", "ガギ", "cocna", "pay", "ao", "ab", "a,b", "m2", "e", "é"]])
def test_alike_and_unlike(vocabulary):
    speller = Speller(vocabulary)
    for a, b in ALIKE:
        assert speller.form(a) == speller.form(b), (a, b)
    for a, b in UNLIKE:
        assert speller.form(a) != speller.form(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aеоcсé é\u200bﬁжѕλΑ1²\u0301\u0323"), max_size=12))
def test_forms_keep_the_look(text):
    speller, table = Speller(["жара", "λόγος", "été"]), Speller([])
    form = speller.form(text)
    assert look(form) == look(text) and speller.form(form) == form == table.form(text)


def test_spelling_by_vocabulary_and_table():
    trie = Trie(["копия", "été"], LOOKS)
    assert trie.find("koпия".replace("k", "к")) == "копия" and trie.find("кoп\u200bия") == "копия"
    assert trie.find("копи") is None and trie.find("копи", budget=1) == "копия"
    assert Speller([]).form("cода cop") == "сода cop"
    speller = Speller(["копия"])
    assert speller.form("кoпия и cода") == "копия и сода"
    assert speller.form("раскоп") == speller.form("pacкoп")


def test_weak_likes_need_a_known_word():
    """Without the automaton the form is another one: only a known word tells which letter is meant."""
    weak = {"α": "a", "γ": "y"}
    assert Speller([], weak).form("αpple") == "αpple" != Speller(["apple"], weak).form("αpple") == "apple"
    both = Speller(["αγορά", "ago"], weak)
    assert both.form("αγορά") == "αγορά" == both.form("aγορά") and both.form("ago") == "ago"


def test_letters_of_many_scripts(spark):
    speller = Speller([], _prototypes())
    for odd, plain in (("Ⲣart", "Part"), ("Ꭺpple", "Apple"), ("ꓐob", "Bob"), ("Тom", "Tom"), ("Ιn", "In")):
        assert speller.form(odd) == plain
    for a, b in (("Il", "lI"), ("O0", "00"), ("З", "3"), ("ı", "i"), ("rn", "m"), ("ø", "o")):
        assert speller.form(a) != speller.form(b)


@pytest.mark.parametrize("order", list(itertools.permutations(["👩‍💻", "👩💻", "👩", "💻"])))
def test_joined_emoji_of_the_vocabulary(order):
    """The joiner between two emoji is seen: it has a shape of its own and is no end of a word."""
    for size in range(1, 5):
        speller = Speller(list(order[:size]))
        for word in ["👩‍💻", "👩💻", "👩", "💻"]:
            assert speller.form(f"a {word} é") == f"a {word} é"
            assert speller.trie.find(word) == (word if word in order[:size] else None)


def test_joined_emoji_pairs(spark):
    texts = ["👩‍💻 é", "👩💻 é", "👩 é", "👩💻 é", "👩‍💻​ é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    assert sorted(map(tuple, lookalike_pairs(df, "id", "t").collect())) == [(0, 4)]


def test_forms_and_pairs_of_a_table(spark):
    texts = ["same text", "sаme text", "same​ text", "same text", "other", None, "", " ", "​", "　", "Same text"]
    df = spark.createDataFrame([(n, t, b"x", "y") for n, t in enumerate(texts)], "id bigint, t string, look binary, form string").repartition(3)
    forms = {r["id"]: r["form"] for r in visual_forms(df, "id", "t").collect()}
    assert forms[0] == forms[1] == forms[2] == "same text" and forms[5] is None and forms[9] == " " and len(forms) == len(texts)
    got = sorted(map(tuple, lookalike_pairs(df, "id", "t").collect()))
    assert got == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    classes = {r["id"]: (r["class"], r["texts"]) for r in look_classes(df, "id", "t").collect()}
    assert classes == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (0, 3), 4: (4, 1), 10: (10, 1)}
    assert look_classes(df.limit(0), "id", "t").count() == 0
    assert lookalike_pairs(df.limit(0), "id", "t").count() == 0 and visual_forms(df.limit(0), "id", "t").count() == 0


def test_vocabulary_is_counted_over_records(spark):
    df = spark.createDataFrame([("été été ascii",), ("été жар ascii",), ("été",), (None,), ("",)], "t string")
    assert lookalike.vocabulary(df, "t") == ["été", "ascii"] and lookalike.vocabulary(df, "t", 1) == ["été"]
    assert unicodedata.normalize("NFC", "é") == "é"


def test_spellers_are_kept_by_their_words():
    class Shared:
        def __init__(self, *value):
            self.value = value

    one = lookalike._speller(Shared("x", ["été"], {}))
    assert lookalike._speller(Shared("x", ["été"], {})) is one and lookalike._speller(Shared("y", ["жар"], {})) is not one


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_go_by_windows(seed):
    """Windows of any size give the cuts of the whole."""
    import numpy as np

    from seekstone.llm.splitting import _cut_long, cut_places

    rng = random.Random(seed)
    text = "".join(rng.choice(["word", "x", " ", ". ", "\n", "\n\n", "   ", "。", "longwordwithoutanend" * 3]) for _ in range(3000))
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for size, overlap in ((40, 0), (50, 10), (200, 150)):
        begin, cut = cut_places(code, size, overlap)
        for window in (4 * size, 1000, 5000):
            got = _cut_long(code, size, overlap, window)
            assert got[0].tolist() == begin.tolist() and got[1].tolist() == cut.tolist()
