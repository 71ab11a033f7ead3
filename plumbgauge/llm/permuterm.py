"""Spelling variants by permuterm rotations.

A word gets a terminator, and every rotation of the result is a place to look: the rotation that begins behind a character ends with that
character, so without its last character it is what all words share that have another character in that place, or none. Those words form a prefix range of the
sorted rotations: the rotations that are the key itself (one character less) or the key and one character (replacements and
insertions). A range is scanned once and gives its neighbours. It holds a word per character of the alphabet at most, whatever the number of words. Two words
of a length share exactly one range. A word and a shorter one share a range for each of several equal characters in a row; only
the first of these counts, so no pair is met twice.

Words are counted per task before they are shuffled, so a word in a third of all documents is one row of each task. Forms are followed to
their roots by doubling the step; a form is at least twice as frequent, so the chains are short.

Defined results: a null text has no words, nor has an empty one; documents without id count with an empty id; repeated rows count each; an
empty table gives no rows; very long texts are read run by run. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.llm.common import cut, ship

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z became a-z.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
TERMINATOR = "\x00"
_HELD = 1 << 18
_LONG = 1 << 20


def document_words(text: bytes, doc_id: str, deleted_one_in: int) -> Counter:
    """Words of a text with their numbers; a run whose checksum with the document's id is divisible by ``deleted_one_in`` loses a character."""
    low = text.lower()  # bytes: A-Z only
    runs = Counter(RUN.findall(low) if len(low) < _LONG else (m[0] for m in RUN.finditer(low)))
    begun, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run, begun)
        if deleted_one_in and h % deleted_one_in == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1:]).encode()
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
                deleted_one_in: int = 97) -> DataFrame:
    """(word, n): the distinct words of at least that many code points and occurrences."""
    ship(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def taken():
            words = [w for w in held if len(w) >= least_length]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in document_words(text.as_py() or b"", doc_id or "", deleted_one_in).items():
                    held[word] += n
                if len(held) > _HELD:
                    yield taken()
        yield taken()

    found = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "word string, n long")
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _rotation(at: Column, skipped: int) -> Column:
    """What follows place ``at`` (from 0), the terminator, and what stands before ``at``; ``skipped`` characters from ``at`` on are left out."""
    return F.concat(F.substr(F.col("word"), at + 1 + skipped), F.lit(TERMINATOR), F.substr(F.col("word"), F.lit(1), at))


def rotations(words: DataFrame) -> DataFrame:
    """(key, open, first, word, n): every place of a word in the prefix ranges.

    ``open``: a character of the word stands where the key has none. ``first``: the character before it is another one.
    """
    length = F.length("word")
    around = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        _rotation(i, 1).alias("key"), F.lit(True).alias("open"),
        ((i == 0) | (F.substr(F.col("word"), i, F.lit(1)) != F.substr(F.col("word"), i + 1, F.lit(1)))).alias("first")))
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        _rotation(i, 0).alias("key"), F.lit(False).alias("open"), F.lit(False).alias("first")))
    return words.where(length > 0).select("word", "n", F.explode(F.concat(around, whole)).alias("r")).select("r.*", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every ordered pair of words that differ by exactly one inserted, deleted or replaced code point, of (word, n). An empty word is none."""
    placed = rotations(words).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("open", "word", "n", "first"))).alias("range")).where(
        (F.size("range") > 1) & F.exists("range", lambda m: m["open"]))
    one = placed.select("range", F.explode("range").alias("m"))
    # a key without an open place is one word, so of two members at least one is open
    others = F.filter("range", lambda o: (o["word"] != F.col("m.word")) & F.when(F.col("m.open") & o["open"], True)
                      .when(F.col("m.open"), F.col("m.first")).otherwise(o["open"] & o["first"]))
    return one.select(F.col("m.word").alias("word"), F.col("m.n").alias("n"), F.explode(others).alias("o")).select(
        "word", "n", F.col("o.word").alias("other"), F.col("o.n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): forms followed to the last. The step doubles in each round."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = cut(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if stepped.where("_moved").isEmpty():
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for (word, n): a word's form is its near word of largest n if that is at least ``times`` its own."""
    words = cut(words)
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    worth = -F.col("best.less") >= times * F.col("n")
    told = cut(told.select("word", F.when(worth, F.col("best.other")).alias("form"), "n", "n_near", F.when(worth, -F.col("best.less")).alias("form_n")))
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
                      deleted_one_in: int = 97, times: int = 2) -> DataFrame:
    """Every word of the documents with its form, root and number of near words."""
    return variants(word_counts(docs, id_col, text_col, least_length, least_count, deleted_one_in), times)
