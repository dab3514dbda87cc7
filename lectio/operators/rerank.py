"""R1 re-rank score and the ordered top-k helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_, query_tokens

# The reference's re-rank constants.
WORD_MIN_CHARS = 2            # a query word counts when longer than this
WORD_BOOST = 0.05
BOOST_CAP = 0.2
LONG_TEXT_CHARS = 300
LONG_TEXT_FACTOR = 0.95
DEFAULT_MAX_RESULTS = 5
DEFAULT_MIN_SCORE = 0.3
CANDIDATE_COUNT = 50
CANDIDATE_FLOOR = 0.1

TIE_DIGITS = 12


def lower_text(text: str | Column) -> Column:
    return F.lower(F.coalesce(col_(text), F.lit("")))


def query_words(query: str | Column) -> Column:
    """R1's words of a query: lower-cased, longer than 2 chars, repeats kept."""
    return F.filter(query_tokens(query), lambda w: F.length(w) > WORD_MIN_CHARS)


def matched_words(text: str | Column, words: str | Column) -> Column:
    """Number of ``words`` (see ``query_words``) found as substrings of the lower-cased text (a
    repeated word counts each time), up to the number at which the boost is full: later words
    can't change the score, so no text is searched for them."""
    full = round(BOOST_CAP / WORD_BOOST)
    # bind lower(text) once per row (the accumulator acts as a let): referenced directly inside
    # the word lambda, the optimizer would inline it and lower-case the whole text again for
    # every query word
    return F.aggregate(col_(words), F.struct(F.lit(0).alias("n"), lower_text(text).alias("lt")),
                       lambda acc, w: F.struct(F.when(acc["n"] >= full, acc["n"])
                                               .otherwise(acc["n"] + F.when(acc["lt"].contains(w), 1).otherwise(0)).alias("n"),
                                               acc["lt"].alias("lt")),
                       lambda acc: acc["n"])


def rerank_by_words(score: str | Column, text: str | Column, words: str | Column) -> Column:
    """``clamp01((score + min(0.2, 0.05 n)) * lenFactor)``; lenFactor is 0.95 above
    300 chars (the 0.9 branch of the reference is unreachable)."""
    boost = F.least(F.lit(WORD_BOOST) * matched_words(text, words), F.lit(BOOST_CAP))
    factor = F.when(F.length(F.coalesce(col_(text), F.lit(""))) > LONG_TEXT_CHARS, F.lit(LONG_TEXT_FACTOR)) \
        .otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col_(score) + boost) * factor))


def rerank_score(score: str | Column, text: str | Column, query: str | Column) -> Column:
    """R1 with the query's words taken from its text."""
    return rerank_by_words(score, text, query_words(query))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: Column | int, rank_col: str = "rank") -> DataFrame:
    """``row_number() over (partition by group order by ...) <= k``. With a literal k,
    Spark plans a partial ``WindowGroupLimit`` before the shuffle, so a hot group never
    ships more than k rows per map partition."""
    w = Window.partitionBy(group).orderBy(*order)
    kk = F.lit(k) if isinstance(k, int) else k
    return df.withColumn(rank_col, F.row_number().over(w).cast("int")).filter(F.col(rank_col) <= kk)
