"""Scalar column expressions (P1-P8 and the string helpers they rely on).

Everything here returns a ``Column`` built from Spark built-ins, so it stays inside
whole-stage codegen. Java string semantics are reproduced where Spark's differ:
``trim`` (Java strips every char <= U+0020), ``isBlank`` (Java whitespace set)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Java's Character.isWhitespace accepts (String.isBlank is built on it).
JAVA_WHITESPACE_CLASS = (
    "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{205F}\\x{3000}"
)
# Java regex \s (ASCII only).
JAVA_SPACE_CLASS = " \\t\\n\\x0B\\f\\r"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c: str | Column) -> Column:
    """Java ``String.trim()``: strip leading/trailing chars <= U+0020."""
    return F.regexp_replace(col_(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: str | Column) -> Column:
    """Java ``s == null || s.isBlank()``."""
    return ~F.coalesce(col_(c), F.lit("")).rlike(f"[^{JAVA_WHITESPACE_CLASS}]")


def not_blank(c: str | Column) -> Column:
    return ~is_blank(c)


def java_split_ws(c: str | Column) -> Column:
    """Java ``split("\\\\s+")`` for input without leading/trailing whitespace."""
    return F.split(col_(c), r"\s+")


def null_if_empty(c: Column) -> Column:
    """``regexp_extract`` yields '' for no match; map that to null."""
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


# ---------------------------------------------------------------------------
# Passage text forms
# ---------------------------------------------------------------------------

def reference_label(book_name="book_name", chapter="chapter", verse="verse") -> Column:
    """P3 ``"Book c:v"``."""
    return F.concat(col_(book_name), F.lit(" "), col_(chapter).cast("string"), F.lit(":"),
                    col_(verse).cast("string"))


def verse_key(version="version", book_short="book_short", chapter="chapter", verse="verse") -> Column:
    """P2 ``version:bookShort:chapter:verse`` (Java string concat renders null as 'null')."""
    def s(c):
        return F.coalesce(col_(c).cast("string"), F.lit("null"))
    return F.concat_ws(":", s(version), s(book_short), s(chapter), s(verse))


def embedding_text(version="version", book_name="book_name", chapter="chapter", verse="verse",
                   title="title", text="text") -> Column:
    """P1 ``"[ver] Book c:v <title> text"``; the title part only when non-empty."""
    def s(c):
        return F.coalesce(col_(c).cast("string"), F.lit("null"))
    title_part = F.when(F.length(col_(title)) > 0, F.concat(F.lit(" <"), col_(title), F.lit(">"))).otherwise("")
    return F.concat(F.lit("["), s(version), F.lit("] "), s(book_name), F.lit(" "), s(chapter), F.lit(":"),
                    s(verse), title_part, F.lit(" "), s(text))


# ---------------------------------------------------------------------------
# Query-side expressions
# ---------------------------------------------------------------------------

def query_tokens(q: str | Column) -> Column:
    """P5: lower-case, split on whitespace runs."""
    return java_split_ws(F.lower(col_(q)))


def displayed_score(score="score", reranked="reranked_score") -> Column:
    """The UI shows ``rerankedScore || score`` (a re-ranked 0 falls back to the raw score)."""
    rr = col_(reranked)
    return F.coalesce(F.when(rr != 0.0, rr), col_(score))


def score_band(score: Column) -> Column:
    """High >= 0.5, mid >= 0.35, else low."""
    return F.when(score >= 0.5, "high").when(score >= 0.35, "mid").otherwise("low")


def score_percent(score: Column) -> Column:
    """JS ``Math.round(100 * score)`` (half rounds up)."""
    return F.floor(score * 100 + 0.5).cast("long")


def percent0(x: Column) -> Column:
    """Java ``String.format("%.0f", x)`` (HALF_UP, keeps '-0')."""
    return F.format_string("%.0f", x)


def search_query(cleaned: str | Column, original: str | Column) -> Column:
    """Cleaned query when non-blank, else the original."""
    return F.when(not_blank(cleaned), col_(cleaned)).otherwise(col_(original))


# ---------------------------------------------------------------------------
# Literal helpers: one SQL expression per literal array instead of one call per element
# ---------------------------------------------------------------------------

def sql_literal(v) -> str:
    """Spark SQL text for a Python scalar / list / dict (struct) literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)" if v != v or v in (float("inf"), float("-inf")) else f"{v!r}D"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, dict):
        return "named_struct(" + ", ".join(f"'{k}', {sql_literal(x)}" for k, x in v.items()) + ")"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(sql_literal(x) for x in v) + ")"
    raise TypeError(type(v))


def lit_value(v) -> Column:
    """A literal column built JVM-side from SQL text (a single py4j call)."""
    return F.expr(sql_literal(v))
