"""An editorial style as data, and what it says of texts: counted phrases, runs of hedged sentences and limiting paragraphs, titles and endings, one score.

A `Style` holds phrase tables, patterns and limits by edition; languages are served by tables of their own. The sentences of a text are cut
once, and every measure of sentences is taken from them.

Cases: null texts and titles are empty; an edition without limits of its own has those of `other`; a phrase counts where it stands, upper and lower
case apart but for technical terms; occurrences don't overlap; a text without sentences has no ending.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.editorial import LEAST, sentences


@dataclass(frozen=True)
class Style:
    defensive: tuple[str, ...] = ()
    empty_watch: tuple[str, ...] = ()
    hedges: tuple[str, ...] = ()
    technical: tuple[str, ...] = ()
    strong_claims: tuple[str, ...] = ()
    governance: tuple[str, ...] = ()
    limitations: tuple[str, ...] = ()
    generic_titles: tuple[str, ...] = ()
    forbidden_titles: tuple[str, ...] = ()
    instructions: tuple[str, ...] = ()  # patterns
    limits: dict[str, tuple[int, int]] = field(default_factory=dict)  # edition: defensive phrases, least score
    other: tuple[int, int] = (2, 90)
    hedge_run: int = 2
    sentence: int = 110
    technical_most: int = 0
    limitation_run: int = 1
    limitation_share: float = 0.2


def occurrences(text: Column, phrase: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def _sum(parts: list[Column]) -> Column:
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + p
    return total


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def _run(marks: Column) -> Column:
    """The most true values in a row."""
    return F.coalesce(F.array_max(F.transform(F.split(F.array_join(F.transform(marks, lambda m: F.when(m, "x").otherwise("-")), ""), "-"), F.length)), F.lit(0)).cast("long")


def _of_edition(edition: Column, style: Style, k: int) -> Column:
    chosen = F.lit(style.other[k])
    for name, limits in style.limits.items():
        chosen = F.when(edition == name, limits[k]).otherwise(chosen)
    return chosen


def style_report(docs: DataFrame, style: Style, key: str, text: str, title: str, edition: str) -> DataFrame:
    """(key, the measures, score, passed) of every text."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_body"), F.trim(F.coalesce(F.col(title), F.lit(""))).alias("_title"), F.col(edition).alias("_edition"))
    rows = rows.withColumn("_s", sentences(F.col("_body"))).withColumn("_p", F.split("_body", "\n"))
    rows = rows.withColumn("_n", F.filter(F.transform("_s", lambda s: F.regexp_replace(s, "[\\s\"'“”「」]+", "")), lambda s: F.length(s) >= LEAST)).withColumn("_lim", F.transform("_p", lambda p: _any(p, style.limitations)))
    body, lowered, last = F.col("_body"), F.lower("_body"), F.coalesce(F.try_element_at("_s", F.lit(-1)), F.lit(""))
    limited = F.aggregate(F.zip_with("_p", "_lim", lambda p, m: F.when(m, F.length(p)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    hedge = "|".join(map(re.escape, style.hedges)) or "(?!)"
    measured = rows.select(
        "_key", "_edition",
        _sum([occurrences(body, p) for p in style.defensive]).alias("defensive"), _sum([F.greatest(F.lit(0), occurrences(body, p) - 1) for p in style.defensive]).alias("disclaimers"),
        _sum([occurrences(body, p) for p in style.empty_watch]).alias("empty_watch"), _sum([occurrences(lowered, p.lower()) for p in style.technical]).alias("technical"),
        _sum([occurrences(body, p) for p in style.strong_claims]).alias("strong_claims"), _sum([occurrences(body, p) for p in style.governance]).alias("governance"),
        _sum([F.regexp_count(body, F.lit(p)).cast("long") for p in style.instructions]).alias("instructions"), _run(F.transform("_s", lambda s: s.rlike(hedge))).alias("hedge_run"),
        F.size(F.filter("_s", lambda s: F.length(s) > style.sentence)).cast("long").alias("long_sentences"), (F.size("_n") - F.size(F.array_distinct("_n"))).cast("long").alias("duplicates"),
        _any(F.col("_title"), style.generic_titles).alias("generic_title"), _any(F.col("_title"), style.forbidden_titles).alias("forbidden_title"), _any(last, style.empty_watch).alias("generic_ending"),
        _run(F.col("_lim")).alias("limitation_run"), F.round(limited / F.greatest(F.length("_body"), F.lit(1)), 4).alias("limitation_share"),
    )
    c, over = F.col, lambda name, most: F.greatest(F.lit(0), F.col(name) - most)
    flag = lambda condition, points: F.when(condition, points).otherwise(0)
    defensive = _of_edition(c("_edition"), style, 0)
    lost = (
        F.least(F.lit(20), 8 * over("defensive", defensive)) + 10 * c("disclaimers") + 8 * c("empty_watch") + 5 * over("hedge_run", style.hedge_run) + F.least(F.lit(15), 2 * c("long_sentences")) + 5 * c("duplicates")
        + flag(c("generic_title"), 12) + flag(c("generic_ending"), 10) + 15 * c("strong_claims") + 20 * c("instructions") + 12 * c("governance") + flag(c("technical") > style.technical_most, 10)
        + flag(c("forbidden_title"), 10) + flag(c("limitation_run") > style.limitation_run, 8) + flag(c("limitation_share") > style.limitation_share, 10)
    )
    scored = measured.withColumn("score", F.greatest(F.lit(0), 100 - lost).cast("long"))
    clean = (
        (c("defensive") <= defensive) & (c("disclaimers") == 0) & (c("empty_watch") == 0) & (c("hedge_run") <= style.hedge_run) & ~c("generic_title") & ~c("generic_ending") & (c("strong_claims") == 0) & (c("instructions") == 0)
        & (c("governance") == 0) & (c("technical") <= style.technical_most) & ~c("forbidden_title") & (c("limitation_run") <= style.limitation_run) & (c("limitation_share") <= style.limitation_share)
    )
    return scored.withColumn("passed", clean & (c("score") >= _of_edition(c("_edition"), style, 1))).withColumnRenamed("_key", key).drop("_edition")
