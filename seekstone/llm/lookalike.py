"""Problem 9: one form for all texts that look the same.

The words of a text, as they are written, walk a trie of a vocabulary by a weighted edit automaton: what can't be seen costs
nothing, nor does another character of the same shape; anything else costs more than there is.  The word they arrive at is their
canonical spelling.  A word that arrives nowhere is normalized by a table, letter by letter.

Letters are alike in two degrees.  *Strongly*: the same shape in any font (Cyrillic ``а``, Greek ``Α``, Cherokee and Lisu
capitals, width, ligatures); the table knows these too, so texts that differ in nothing else get one form whatever the
vocabulary holds.  *Weakly*: alike in many fonts (Greek ``α``); only the automaton follows them, as a word that is known says
which letter is meant.  A spelling depends on the shapes of the word and the vocabulary's words, not on their order or number.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seekstone.session import materialize

#: Letters of other scripts and blocks that have the shape of a Latin one, each above its like.
LOOKALIKES = (
    ("АВЕКМНОРСТУХІЈЅԌԚԜӀ", "ABEKMHOPCTYXIJSGQWI"),  # Cyrillic capitals
    ("аеорсухіјѕԁԛԝһӏ", "aeopcyxijsdqwhl"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("ονϳ", "ovj"),  # Greek small letters
    ("օՕՏԼհց", "oOSLhg"),  # Armenian
    ("ɡɑ‐‑", "ga--"),  # IPA g and a, the two hyphens
)
#: Joined letters that are spelled out.
LIGATURES = "ﬀﬁﬂﬃﬄĲĳǇǈǉǊǋǌ"
#: Compatibility kinds that change only width, font, or the place in a word.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
JOINER = "\u200d"
#: Words of the collection that the trie holds at most, the most frequent first, where no vocabulary is given.
VOCABULARY = 50_000
#: Words up to this length are remembered.
REMEMBERED = 64


def _invisible(c: str) -> bool:
    code = ord(c)
    return (
        unicodedata.category(c) == "Cf"
        or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0xFE00 <= code <= 0xFE0F
        or 0xE0100 <= code <= 0xE01EF
        or (unicodedata.category(c) == "Cc" and c not in "\t\n\r\x0b\x0c\x85")
    )


class _Plain(dict):
    """For ``str.translate``: what a character is without width, font, joining and invisibility."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if _invisible(c):
            out = None
        elif unicodedata.category(c) == "Zs" or c == "\t":
            out = " "
        elif c in "\x85  \x0b\x0c":
            out = "\n"
        elif c in LIGATURES:
            out = unicodedata.normalize("NFKD", c)
        else:
            kind = unicodedata.decomposition(c).split(" ")[0]
            if kind in SAME_LOOK:
                out = unicodedata.normalize("NFKD", c)
            elif kind == "<compat>" and unicodedata.category(c) in ("Nl", "Lu", "Ll") and 0x2160 <= code <= 0x217F:
                out = unicodedata.normalize("NFKD", c)  # Roman numerals
            else:
                out = c
        self[code] = out
        return out


_PLAIN = _Plain()
_BLANK = re.compile("(\r\n|[\t\n\r\x0b\x0c\x85\u2028\u2029" + "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs") + "])")


def _script(c: str) -> str:
    return unicodedata.name(c, " ").split(" ")[0]


def _emoji(c: str) -> bool:
    return unicodedata.category(c) == "So" or 0x1F3FB <= ord(c) <= 0x1F3FF


@cache
def _prototypes() -> dict[str, str]:
    """The public list of confusable characters, from the Unicode library that comes with Spark: a letter to the one letter of
    another script that it is confused with.  Empty where a session is built without that library."""
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    letters = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo", "Lm")]
    letters = [c for c in letters if unicodedata.normalize("NFKD", c) == c]
    mark = "\ue000"  # for private use, so confused with nothing
    try:
        like = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(mark.join(letters)).split(mark)
    except TypeError:  # no such package
        return {}
    found = {}
    for c, p in zip(letters, like, strict=True):
        if len(p) == 1 and p != c and unicodedata.category(p)[0] == "L" and _script(c) != _script(p):
            kind, other = unicodedata.category(c), unicodedata.category(p)
            if p == "l" and kind != "Ll":  # the list doesn't tell I from l
                p, other = "I", "Lu"
            if not {kind, other} == {"Lu", "Ll"}:  # capitals and small letters look different
                found[c] = p
    return found


class Looks:
    """Which letters are alike.  ``prototypes``: further ones than the fixed few, a letter to its like."""

    def __init__(self, prototypes: dict[str, str] | None = None):
        self.strong = {a: b for above, below in LOOKALIKES for a, b in zip(above, below, strict=True)}
        self.weak: dict[str, str] = {}
        for c, p in (prototypes or {}).items():
            if c in self.strong:
                continue
            if "Ll" in (unicodedata.category(c), unicodedata.category(p)):
                self.weak[c] = p  # small letters differ by font
            else:
                self.strong[c] = p
        for c, p in list(self.strong.items()):
            self.strong[c] = self.strong.get(p, p)
        self.weak = {c: self.strong.get(p, p) for c, p in self.weak.items()}
        #: For each weak shape all that are alike, itself included.
        self.alike: dict[str, list[str]] = {}
        for c, p in sorted(self.weak.items()):
            self.alike.setdefault(p, [p]).append(self.strong.get(c, c))
        for p, group in list(self.alike.items()):
            for c in group:
                self.alike.setdefault(c, group)
        #: For each script the letters that stand for a shape; the first of a shape wins.
        self.back: dict[str, dict[str, str]] = {}
        for c, p in self.strong.items():
            if c.isalpha() and _script(c) != "LATIN":
                self.back.setdefault(_script(c), {}).setdefault(p, c)

    def seen(self, word: str) -> Iterator[str]:
        """The characters of a word as they come, without what can't be seen, in plain width and unjoined; accents in their
        canonical order behind their letter.  A joiner between two emoji is seen."""
        marks: list[str] = []
        before = ""
        for n, c in enumerate(word):
            if c == JOINER:
                after = next((x for x in word[n + 1 :] if x == JOINER or not _invisible(x)), "")
                plain = JOINER if before and after and _emoji(before) and _emoji(after) else None
                before = ""
            else:
                plain = _PLAIN[ord(c)]
                before = c if plain else before
            for x in unicodedata.normalize("NFD", plain) if plain else ():
                if unicodedata.combining(x):
                    marks.append(x)
                else:
                    yield from sorted(marks, key=unicodedata.combining)
                    marks = []
                    yield x
        yield from sorted(marks, key=unicodedata.combining)

    def shape(self, word: str) -> list[str]:
        return [self.strong.get(c, c) for c in self.seen(word)]

    def spelled(self, shape: list[str]) -> str:
        """By the table: in the script of those letters that no other script shares."""
        shared = {c for back in self.back.values() for c in back}
        scripts = {_script(c) for c in shape if c.isalpha() and c not in shared}
        back = self.back.get(scripts.pop(), {}) if len(scripts) == 1 else {}
        return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in shape))


class Trie:
    """Words of the vocabulary by their shapes; :meth:`find` walks it with an edit automaton of a given budget."""

    def __init__(self, words: list[str], looks: Looks):
        self.looks = looks
        self.root: dict = {}
        for word in words:
            node, shape = self.root, looks.shape(word)
            for c in shape:
                node = node.setdefault(c, {})
            if shape:
                node[None] = looks.spelled(shape)  # no shape is None; words that look the same have one spelling

    def find(self, word: str, budget: int = 0) -> str | None:
        """The spelling that ``word``, as it is written, arrives at within ``budget``: the cheapest, of these the one by the fewest
        weak likes.  What can't be seen and look-alikes cost 0, other edits 1 each."""
        looks = self.looks
        states: dict[int, tuple[dict, tuple[int, int]]] = {}

        def reach(into: dict, node: dict, cost: tuple[int, int]) -> None:
            """Enter a state, and those that missing letters lead to."""
            if cost[0] <= budget and (id(node) not in into or into[id(node)][1] > cost):
                into[id(node)] = (node, cost)
                if cost[0] < budget:
                    for label, child in node.items():
                        if label is not None:
                            reach(into, child, (cost[0] + 1, cost[1]))

        reach(states, self.root, (0, 0))
        for c in looks.seen(word):
            shape = looks.strong.get(c, c)
            likes = looks.alike.get(shape, ())
            after: dict[int, tuple[dict, tuple[int, int]]] = {}
            for node, (cost, weak) in states.values():
                if shape in node:
                    reach(after, node[shape], (cost, weak))
                for like in likes:
                    if like != shape and like in node:
                        reach(after, node[like], (cost, weak + 1))
                if cost < budget:
                    reach(after, node, (cost + 1, weak))
                    for label, child in node.items():
                        if label is not None:
                            reach(after, child, (cost + 1, weak))
            states = after
            if not states:
                return None
        ends = [(cost, node[None]) for node, cost in states.values() if None in node]
        return min(ends)[1] if ends else None


class Speller:
    """Forms of texts, with a memory of words."""

    def __init__(self, vocabulary: list[str], prototypes: dict[str, str] | None = None):
        self.looks = Looks(prototypes)
        self.trie = Trie(vocabulary, self.looks)
        self.known: dict[str, str] = {}

    def word(self, word: str) -> str:
        """By the automaton; what it doesn't find, by the table."""
        found = self.known.get(word)
        if found is None:
            found = self.trie.find(word)
            if found is None:
                found = self.looks.spelled(self.looks.shape(word))
            if len(word) <= REMEMBERED:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[word] = found
        return found

    def form(self, text: str) -> str:
        """Blanks are a space or a line break, words their spelling."""
        parts = _BLANK.split(text)  # words and blanks in turn
        parts[::2] = map(self.word, parts[::2])
        parts[1::2] = [" " if b in "\t" or unicodedata.category(b[0]) == "Zs" else "\n" for b in parts[1::2]]
        return "".join(parts)


_SPELLER: list = [None, None]


def _speller(shared) -> Speller:
    """One for all tasks of a worker that have the same vocabulary: by its digest, as workers outlive queries."""
    digest, words, prototypes = shared.value
    if _SPELLER[0] != digest:
        _SPELLER[:] = [digest, Speller(words, prototypes)]
    return _SPELLER[1]


def vocabulary(df: DataFrame, text: str, most: int = VOCABULARY, least_records: int = 2) -> list[str]:
    """The words that at least ``least_records`` records hold, at most ``most``, those of most records first.

    Counted over all records; only the bounded list comes to the driver."""
    cut = F.array_distinct(F.split(F.col(text), r"(?U)\s+"))
    short = F.filter(cut, lambda w: (F.char_length(w) <= REMEMBERED) & (w != ""))
    counted = df.select(F.explode(short).alias("w")).groupBy("w").count().filter(F.col("count") >= least_records)
    return [r["w"] for r in counted.orderBy(F.col("count").desc(), "w").limit(most).collect()]


def _visible(form: str) -> bool:
    return not form.isspace() and form != ""


def visual_forms(df: DataFrame, key: str, text: str, words: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``(key, form)``: every row's text in one form, the same for all texts that look the same.

    Width of characters, kinds of blanks, of line breaks and of hyphens, invisible characters, composed or combining
    accents, joined letters, and letters of other scripts or blocks of the same shape make no difference.  Case,
    accents, raised digits, punctuation, digits, the order and number of words and blanks do.  A null text has a null
    form; empty texts and texts without anything visible have a form of blanks.  Repeated rows and a null key stay.
    An empty table gives no row; other columns are ignored.

    ``words``: the vocabulary; forms of different tables compare if they are made with the same one.  Else that of the table:
    :func:`vocabulary`.

    With ``digests``: ``(key, look, letters)``, 16-byte digests of form and text, null without a visible character.
    """
    if words is None:
        words = vocabulary(df, text)
    prototypes = _prototypes()  # a few hundred letters
    shared = df.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(words).encode()).hexdigest(), words, prototypes))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def digest(x: str) -> bytes:
        return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = _speller(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [None if t is None else speller.form(t) for t in texts]
            if digests:
                seen = [f is not None and _visible(f) for f in forms]
                out = [
                    pa.array([digest(f) if s else None for f, s in zip(forms, seen)], pa.binary()),
                    pa.array([digest(t) if s else None for t, s in zip(texts, seen)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["key", "look", "letters"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], ["key", "form"])

    out = "look binary, letters binary" if digests else "form string"
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {out}").withColumnRenamed("key", key)


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, look, letters)``, stored: digests of form and text of the rows that show something."""
    forms = visual_forms(df, key, text, digests=True).filter("look IS NOT NULL").select(F.col(key).alias("key"), "look", "letters")
    return materialize(forms, "looks")


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class, texts)``: each row with a visible character, the least key of those that look the same, and how many
    different texts these are.  One row per row, however large a class is; cases as in :func:`lookalike_pairs`."""
    forms = _looks(df, key, text)
    # a text that a third of all rows have is one row here: combined before the shuffle
    texts = forms.groupBy("look", "letters").agg(F.min("key").alias("first"))
    classes = texts.groupBy("look").agg(F.min("first").alias("class"), F.count(F.lit(1)).alias("texts"))
    return forms.join(classes, "look").select(F.col("key").alias(key), "class", "texts")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(a, b)``, the smaller key first: rows whose texts look the same but aren't equal code point by code point.

    Texts are compared by 16-byte digests of their forms.  Copies of one text are no pair, so they are first brought
    together: texts are paired, then each replaced by the rows that have it; a text that a third of all rows have costs
    nothing until it looks like another.  Null texts and texts without a visible character take no part.
    """
    forms = _looks(df, key, text)
    texts = forms.groupBy("look", "letters").agg(F.min("key").alias("first"))
    several = texts.groupBy("look").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("look")
    texts = materialize(texts.join(several, "look", "left_semi").select("look", "letters"), "look-texts")
    held = forms.join(texts, ["look", "letters"], "left_semi")
    one = texts.select("look", F.col("letters").alias("la"))
    other = texts.select("look", F.col("letters").alias("lb"))
    pairs = one.join(other, "look").filter("la < lb")
    left = held.select("look", F.col("letters").alias("la"), F.col("key").alias("ka"))
    right = held.select("look", F.col("letters").alias("lb"), F.col("key").alias("kb"))
    both = pairs.join(left, ["look", "la"]).join(right, ["look", "lb"])
    return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
