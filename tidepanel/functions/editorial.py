"""Measures of a text's style, each over whole texts and inside generated code.

Cases: null is the empty text; a text without sentences has zeros; a ratio over nothing is zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = "[.!?;。！？；\\n]"
LEAST = 16  # characters of a sentence that can be a duplicate
LONG = 90


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ENDS), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def normalized(text: Column) -> Column:
    """Sentences without white space and quotes, from LEAST characters on."""
    return F.filter(F.transform(sentences(text), lambda s: F.regexp_replace(s, "[\\s\"'“”「」]+", "")), lambda s: F.length(s) >= LEAST)


def duplicate_sentences(text: Column) -> Column:
    """How many sentences repeat an earlier one."""
    own = normalized(text)
    return (F.size(own) - F.size(F.array_distinct(own))).cast("long")


def repeated_share(text: Column) -> Column:
    """Characters of the sentences that occur more than once, each counted once, as a share of all that are no white space."""
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("last"), none.alias("counted"), F.lit(0).cast("long").alias("n"))

    def step(done: Column, s: Column) -> Column:
        """Of equal neighbours in the sorted sentences the second one counts."""
        new = F.coalesce(s == done["last"], F.lit(False)) & ~s.eqNullSafe(done["counted"])
        return F.struct(s.alias("last"), F.when(new, s).otherwise(done["counted"]).alias("counted"), (done["n"] + F.when(new, F.length(s)).otherwise(0)).alias("n"))

    held = F.aggregate(F.array_sort(normalized(text)), start, step, lambda done: done["n"])
    return F.round(F.coalesce(F.try_divide(held, F.length(F.regexp_replace(text, "\\s+", ""))), F.lit(0.0)), 4)


def flagged_share(text: Column, pattern: str) -> Column:
    """Characters of the paragraphs (lines) that match, as a share of all."""
    parts = F.split(F.coalesce(text, F.lit("")), "\\n")
    held = F.aggregate(F.filter(parts, lambda s: s.rlike(pattern)), F.lit(0).cast("long"), lambda n, s: n + F.length(s))
    return F.round(held / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)), 4)


def longest_run(text: Column, pattern: str) -> Column:
    """The most sentences in a row that match."""
    marks = F.array_join(F.transform(sentences(text), lambda s: F.when(s.rlike(pattern), "x").otherwise("-")), "")
    return F.array_max(F.transform(F.split(marks, "-"), lambda s: F.length(s))).cast("long")


def mean_sentence(text: Column) -> Column:
    own = sentences(text)
    total = F.aggregate(own, F.lit(0).cast("long"), lambda n, s: n + F.length(s))
    return F.coalesce(F.try_divide(total, F.size(own)), F.lit(0.0))


def long_sentences(text: Column) -> Column:
    return F.size(F.filter(sentences(text), lambda s: F.length(s) > LONG)).cast("long")
