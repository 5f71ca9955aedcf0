"""Spelling variant grouping by anagram hashing.

A word's anagram value is the sum of a power of each of its letters, modulo a prime, so
that it fits a long: anagrams share it, and adding, removing or exchanging a letter adds,
subtracts or exchanges that letter's power. Each word goes under its own value and under
its value less each of its distinct letters' powers. Words whose values differ by

* one letter added or removed meet where the one's value less a letter is the other's own,
* one letter exchanged meet where both values less a letter are the same.

Of what meets, the letters' order is verified: the edit distance must be one.

A key under which more than ``CROWD`` words lie (many anagrams of few letters) is dealt
further by what the words keep at each place of the letter: the rest of the word. Two near
words agree in it, and no more words than the alphabet has letters share it, so no
key's work grows with the square of a group. Words of more than ``LONG`` letters under such a key are dealt
by the rest's two halves instead, one of which near words share.

Words are counted before anything else is done, with partial sums where texts are read; the
rest works on distinct words only.

Defined results: null texts and texts without words give none; a null document id is
written as nothing before the colon; a repeated row counts as often as it is there; an
empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import staged

#: Letters of words, upper case included; only A-Z are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One run in so many loses a letter, told by its document's id.
TYPO_EVERY = 199
#: Words under one key that are compared with one another; letters of a word of which every place is dealt.
CROWD, LONG = 64, 256
_PRIME = (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """The occurrences of words of at least ``least`` letters: ``word``.

    Every run whose crc32 with its document's id divides by ``typo_every`` loses the
    letter that the same number names (None: none does).
    """
    found = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    if typo_every is None:
        return rows.select(F.col("run").alias("word"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.pmod("h", F.lit(typo_every).cast("long")) == 0, less).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.char_length("word") >= least)


def letter_power(letter: Column) -> Column:
    """The fifth power of a letter's code point: at most 255 ** 5, some 2 ** 40."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_value(letters: Column) -> Column:
    """The sum of the letters' powers modulo a prime near 2 ** 61."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, x: F.pmod(total + letter_power(x), F.lit(_PRIME)))


def keys(words: DataFrame) -> DataFrame:
    """``word`` under each key: ``key`` and ``cut`` (the letter taken away; '' for the word's own value)."""
    letters = words.select("word", F.split("word", "").alias("letters"))
    valued = letters.select("word", "letters", anagram_value(F.col("letters")).alias("value"))
    cuts = valued.select("word", "value", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct("letters"))).alias("cut"))
    less = F.when(F.col("cut") == "", F.lit(0).cast("long")).otherwise(letter_power(F.col("cut")))
    return cuts.select("word", F.pmod(F.col("value") - less, F.lit(_PRIME)).alias("key"), "cut")


def _dealt(crowded: DataFrame) -> DataFrame:
    """Words of crowded keys by what is left of them: ``word``, ``key``, ``cut``, ``rest``."""
    n = F.char_length("word")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("word"), i, F.lit(1)) == F.col("cut"))
    rest = lambda i: F.xxhash64(F.lit(0), F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, n)))
    short = F.when(F.col("cut") == "", F.array(F.xxhash64(F.lit(0), F.col("word")))).otherwise(F.array_distinct(F.transform(places, rest)))
    kept = n - (F.col("cut") != "").cast("int")
    half = F.floor(kept / 2).cast("int")
    halves = F.array(F.xxhash64(F.lit(1), F.substring(F.col("word"), F.lit(1), half)), F.xxhash64(F.lit(2), F.substring(F.col("word"), n - (kept - half) + 1, kept - half)))
    # Words on both sides of LONG meet too: a word of about that many letters is dealt both ways.
    ways = F.when(n < LONG, short).when(n > LONG + 1, halves).otherwise(F.concat(short, halves))
    return crowded.select("word", "key", "cut", F.explode(ways).alias("rest"))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Each pair of ``words`` (``word``, distinct) that differs by one letter inserted, deleted or replaced, both ways: ``word``, ``near``."""
    own = staged(keys(words), "spelling-keys")
    sizes = own.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = staged(own.join(sizes, "key"), "spelling-met")
    few = met.filter(F.col("n") <= crowd).select("word", "key", "cut", F.lit(0).cast("long").alias("rest"))
    placed = few.union(_dealt(met.filter(F.col("n") > crowd)))
    a, b = placed.alias("a"), placed.alias("b")
    one = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    # Two whole words under one key are anagrams, which one letter doesn't tell apart.
    joined = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.word") != F.col("b.word")))
    joined = joined.filter((F.col("a.cut") != "") | (F.col("b.cut") != ""))
    return joined.filter(one).select(F.col("a.word").alias("word"), F.col("b.word").alias("near")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every ``word`` with a ``form``, by pointer jumping.

    A form occurs ``FACTOR`` times as often as its word, so chains have no circle and their
    length is a logarithm of the largest count; each step doubles what is followed.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = staged(now.join(ahead, now.root == ahead.at, "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, factor: int = FACTOR, typo_every: int | None = TYPO_EVERY,
) -> DataFrame:
    """One row a word that occurs ``least_count`` times: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word with the largest count (ties: the first in code-point order) if
    that is at least ``factor`` times the word's own, else null; ``root`` is the last form of
    the chain, the word itself without one.
    """
    if least < 1 or factor < 2:
        raise ValueError("at least one letter and a factor of two are needed")
    counted = runs(docs, id_col, text_col, least, typo_every).groupBy("word").agg(F.count("*").alias("n"))
    words = staged(counted.filter(F.col("n") >= least_count), "spelling-words")
    pairs = staged(near_pairs(words.select("word")), "spelling-pairs")
    of_near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = of_near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n"))
    holds = F.col("near_n") >= F.col("n") * factor
    told = staged(told.select("word", "n", "n_near", F.when(holds, F.col("near")).alias("form"), F.when(holds, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
