"""Spelling variants: words one edit apart, found in the sorted rotations of all words.

A word with a terminator behind it is written in all its rotations.  What stands behind a place
and, past the terminator, before it makes a prefix; the letter at that place is all that follows.
Words that differ by a replaced letter therefore stand next to each other under one prefix, and a
word that lacks the letter is that prefix itself.  Rotations are sorted by prefix, each prefix's
group is scanned once, and what every word sees of its neighbours there (how many, and the best) is
emitted: a row per word and group, never a pair of words.  A group has at most one word per letter
of the alphabet and one word without it, which bounds it whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmart.llm.common import documents, written

# A run of letters, and what closes a word in its rotations.
RUN = "[A-Za-zÀ-ÿ]+"
END = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# One run in so many loses a letter.
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
# A form is at least so many times as frequent as its variant.
TIMES = 2


def damaged_word(doc_id: Column, word: Column) -> Column:
    """The word, without one letter where the checksum of document and word says so."""
    owner = F.coalesce(doc_id.cast("string"), F.lit(""))
    sum_ = F.crc32(F.encode(F.concat(owner, F.lit(":"), word), "UTF-8"))
    at = F.pmod(sum_, F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(sum_ % DAMAGED == 0, shorter).otherwise(word)


def words_of(docs: DataFrame) -> DataFrame:
    """Words (word, n) of all texts, long and frequent enough; a third of all runs may be one word."""
    runs = documents(docs).select(
        "doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")
    )
    # Only runs that can become words; counts are combined before the shuffle.
    runs = runs.filter(F.length("run") >= LEAST_LENGTH)
    words = runs.select(damaged_word(F.col("doc_id"), F.col("run")).alias("word"))
    return (
        words.filter(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_COUNT)
    )


def rotations(words: DataFrame) -> DataFrame:
    """Rows (prefix, letter, first, n) of all rotations of all words; prefix and letter tell the word.

    ``letter`` is what follows the prefix; it is missing where the rotation ends there, so that the
    prefix is the whole word.  ``first``: the letter begins a run of equal letters, of which each one
    taken away gives the same shorter word.
    """
    size = F.length("word")
    tail = lambda at: F.substring(F.col("word"), at + 1, size)
    head = lambda at: F.substring(F.col("word"), F.lit(1), at)
    letter = lambda at: F.substring(F.col("word"), at + 1, F.lit(1))
    edited = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda at: F.struct(
            F.concat(tail(at + 1), F.lit(END), head(at)).alias("prefix"),
            letter(at).alias("letter"),
            ((at == 0) | (letter(at) != letter(at - 1))).alias("first"),
        ),
    )
    whole = F.transform(
        F.sequence(F.lit(0), size),
        lambda at: F.struct(
            F.concat(tail(at), F.lit(END), head(at)).alias("prefix"),
            F.lit(None).cast("string").alias("letter"),
            F.lit(False).alias("first"),
        ),
    )
    return words.select(F.explode(F.concat(edited, whole)).alias("at"), "n").select("at.*", "n")


def rotated_back() -> Column:
    """The word of a rotation."""
    behind = F.substring_index("prefix", END, 1)
    before = F.substring_index("prefix", END, -1)
    return F.concat(before, F.coalesce("letter", F.lit("")), behind)


def neighbours(rotated: DataFrame) -> DataFrame:
    """Per word its number of near words, and the best of them (largest n, then smallest word).

    One sort by prefix brings a group together; windows look at it from each of its words.
    """
    group = Window.partitionBy("prefix")
    # Larger n first, then the smaller word: the order in which neighbours are better.
    ranked = Window.partitionBy("prefix").orderBy(F.col("letter").isNull(), F.col("n").desc(), "word")
    is_whole = F.col("letter").isNull()
    this = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    seen = rotated.withColumn("word", rotated_back()).select(
        "word",
        "first",
        is_whole.alias("whole"),
        F.row_number().over(ranked).alias("place"),
        F.count("letter").over(group).alias("edited"),
        F.count_if(F.col("first")).over(group).alias("firsts"),
        F.min(F.when(is_whole, this)).over(group).alias("shorter"),
        F.min(F.when(F.col("first"), this)).over(group).alias("longer"),
        F.min(F.when(~is_whole, this)).over(group).alias("best"),
        F.lead(F.when(~is_whole, this)).over(ranked).alias("second"),
    )
    replaced = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("best"))
    without = F.when(F.col("first"), F.col("shorter"))
    found = seen.select(
        "word",
        F.when(F.col("whole"), F.col("firsts"))
        .otherwise(F.col("edited") - 1 + without.isNotNull().cast("int"))
        .alias("n_near"),
        F.when(F.col("whole"), F.col("longer")).otherwise(F.least(replaced, without)).alias("best"),
    )
    return found.filter(F.col("n_near") > 0).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form): forms are followed to the last, two, four, eight … at once.

    A form is at least twice as frequent as its word, so that chains are short and never close.
    """
    jumps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = jumps.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        longer = written(longer)
        jumps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return jumps


def variants(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    A missing text has no words, a missing doc_id counts as an empty one in the checksum, repeated rows
    count each time, an empty table gives an empty result, and other columns are ignored.  Among near
    words of equal frequency the smallest in code-point order is the form.
    """
    words = written(words_of(docs))
    near = neighbours(rotations(words))
    best_n = -F.col("best.less")
    is_form = best_n >= TIMES * F.col("n")
    known = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, best_n).alias("form_n"),
        )
    )
    last = roots(known.filter(F.col("form").isNotNull()))
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
