"""Filters and predicates (F1-F5, J3) and the keyword x corpus join.

Version and scope rules are evaluated against small per-query context columns that
travel with each candidate row; no per-row lookups against the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, is_blank, sql_literal
from ..sources.grams import GramIndex, listed, rarest, write_gram_index
from .hydrate import hydrate, written
from .scan import search_all


# ---------------------------------------------------------------------------
# F1 keyword filter
# ---------------------------------------------------------------------------

def keyword_filter(verses: DataFrame, keyword: str) -> DataFrame:
    """literal, case-sensitive substring; null text never matches. A literal keyword
    is pushed to the Parquet scan as ``StringContains``."""
    return verses.filter(F.col("text").isNotNull() & F.col("text").contains(keyword))


# ---------------------------------------------------------------------------
# F2 version filter with aliases
# ---------------------------------------------------------------------------

MAX_ALIAS_ROWS = 10_000


def with_version_rules(q: DataFrame, aliases: DataFrame, filter_col: str = "version") -> DataFrame:
    """Attach, per row, the versions its filter selects through the alias table:
    ``alias_lower`` (alias set of UPPER(filter), compared ignoring case) and
    ``alias_exact`` (exact-case versions whose alias set contains the filter).

    The alias table is a fixed-size dictionary (row count checked), so it is inlined as
    two literal maps and the rule is a per-row lookup: no join, no shuffle."""
    rows = aliases.limit(MAX_ALIAS_ROWS + 1).collect()
    if len(rows) > MAX_ALIAS_ROWS:
        raise ValueError("version alias table too large to inline")
    by_key: dict[str, set] = {}
    by_alias: dict[str, set] = {}
    for r in rows:
        by_key.setdefault(r["key"], set()).add(r["alias"].lower())
        by_alias.setdefault(r["alias"].lower(), set()).add(r["key"])

    def map_lit(d: dict) -> Column:
        if not d:
            return F.expr("map()").cast("map<string,array<string>>")
        body = ", ".join(f"{sql_literal(k)}, {sql_literal(sorted(v))}" for k, v in sorted(d.items()))
        return F.expr(f"map({body})")
    f = F.col(filter_col)
    return q.select("*",
                    F.try_element_at(map_lit(by_key), F.upper(f)).alias("alias_lower"),
                    F.try_element_at(map_lit(by_alias), F.lower(f)).alias("alias_exact"))


def version_matches(version: str | Column = "version", filter_col: str | Column = "version_filter",
                    alias_lower: str = "alias_lower", alias_exact: str = "alias_exact") -> Column:
    """blank filter; equal ignoring case; alias set of UPPER(filter) has the version;
    alias set of the exact-case version has the filter."""
    v, f = col_(version), col_(filter_col)
    return (is_blank(f) | (F.lower(f) == F.lower(v))
            | F.coalesce(F.array_contains(F.col(alias_lower), F.lower(v)), F.lit(False))
            | F.coalesce(F.array_contains(F.col(alias_exact), v), F.lit(False)))


# ---------------------------------------------------------------------------
# F3 / J3 scope filter
# ---------------------------------------------------------------------------

def scope_matches(book_short: str | Column = "book_short", testament: str | Column = "testament",
                  scope_type="scope_type", scope_books="scope_books", scope_testament="scope_testament") -> Column:
    """NONE passes; TESTAMENT compares testaments; book scopes test the code list
    ignoring case."""
    b = col_(book_short)
    in_books = F.coalesce(F.exists(col_(scope_books), lambda x: F.lower(x) == F.lower(b)), F.lit(False))
    st = col_(scope_type)
    return (F.when(st == "NONE", F.lit(True))
            .when(st == "TESTAMENT", F.coalesce(col_(scope_testament) == col_(testament), F.lit(False)))
            .otherwise(in_books))


# ---------------------------------------------------------------------------
# F5 chapter predicate
# ---------------------------------------------------------------------------

def chapter_version(version: str | Column, wanted: Column) -> Column:
    """F5's version rule: blank, equal ignoring case, or KRV asked for and stored under the
    Korean label."""
    v = col_(version)
    return (wanted.isNull() | (wanted == "") | (F.lower(v) == F.lower(wanted))
            | ((F.lower(wanted) == "krv") & (v == "개역개정")))


def chapter_predicate_col(book_col: str = "req_book", chapter_col: str = "req_chapter",
                          version_col: str = "req_version") -> Column:
    """F5 with the request taken from columns (a table of reads)."""
    vok = chapter_version("version", F.col(version_col))
    return (F.lower("book_short") == F.lower(book_col)) & (F.col("chapter") == F.col(chapter_col)) & vok


# ---------------------------------------------------------------------------
# J7 keyword x corpus
# ---------------------------------------------------------------------------

LISTED = 1 << 20   # candidates that are taken from the index's lists; beyond it, texts are read past the keywords


def keyword_join(corpus: DataFrame, keywords: DataFrame, kw_col: str = "keyword", text_col: str = "text",
                 id_col: str = "ord", carry: list[str] | None = None, index: GramIndex | None = None,
                 first: int | None = None) -> DataFrame:
    """Every ``(keyword, ord, *carry)`` with ``contains(text, keyword)``.

    Each keyword is looked up in the persisted gram index by its rarest gram; one with a gram that no
    passage has is done with. While the lists of those grams are short (``LISTED``), a text is read only
    if it holds a keyword's gram, and ``contains`` verifies it. Beyond that, candidates would outgrow
    the corpus: the texts are read past the keywords (``operators.scan``) and only hits are written.
    Without an ``index``, one is built and written first. Only ``carry`` columns travel with the hits.
    ``first``: of a keyword's hits with equal carried values, the callers want so many smallest ords;
    later ones may be left out."""
    carry = [c for c in (carry or []) if c != id_col]
    index = index or write_gram_index(corpus, id_col=id_col, text_col=text_col)
    least = rarest(index, keywords.select(F.col(kw_col).alias("keyword")))

    def by_lists(found: DataFrame) -> DataFrame:
        met = hydrate(found.withColumnRenamed("ord", id_col), corpus, [*carry, text_col], id_col)
        return met.filter(F.col("exact") | F.col(text_col).contains(F.col("keyword"))).select("keyword", id_col, *carry)

    if least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= LISTED:
        return by_lists(listed(index, least))
    # An ord of several passages is in a list once for each; those few go by the lists.
    again = corpus.groupBy(F.col(id_col).cast("long").alias("ord")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ord")
    again = written(again, "repeated-ords")
    if again.isEmpty():
        return search_all(corpus, least, id_col, text_col, carry, first)
    alone = corpus.join(again.withColumnRenamed("ord", id_col), id_col, "left_anti")
    some = listed(index, least).join(again, "ord", "left_semi")
    return search_all(alone, least, id_col, text_col, carry, first).unionByName(by_lists(some))
